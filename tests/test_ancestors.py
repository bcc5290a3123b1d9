from groundwork.operators import threads as H

SCHEMA = "id long, parent_id long, thread_key string"


def test_ancestors_at_any_depth(spark):
    runs = spark.createDataFrame([(i, i - 1 if i else None, "t") for i in range(300)], SCHEMA)
    art = spark.createDataFrame([(0,), (200,)], "id long")
    got = {r["id"]: (r["ancestor"], r["depth"]) for r in H.nearest_ancestor(runs, art).collect()}
    assert got == {i: (0, i) if i <= 200 else (200, i - 200) for i in range(1, 300)}


def test_cycles_end_without_an_own_artifact(spark):
    runs = spark.createDataFrame([(1, 3, "c"), (2, 1, "c"), (3, 2, "c"), (4, 3, "c"), (5, 6, "d"), (6, 5, "d"), (7, 1, "e")], SCHEMA)
    art = spark.createDataFrame([(1,)], "id long")
    assert {r["id"]: (r["ancestor"], r["depth"]) for r in H.nearest_ancestor(runs, art).collect()} == {2: (1, 1), 3: (1, 2), 4: (1, 3)}
    assert H.nearest_ancestor(runs.limit(0), art).collect() == []
