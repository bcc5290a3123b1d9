from pyspark.sql import functions as F

from groundwork.operators import candidates as C


def both(spark, n):
    user = spark.range(n).select(F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("u"), F.col("id") % 500)).alias("url"), F.lit("text").alias("text"), (F.lit(n) - F.col("id")).alias("ord"))
    search = spark.createDataFrame([("u1", "a", 1), ("v", "b", 2), (None, "c", 2), (None, "d", None)], "url string, text string, ord long")
    return user, search


def test_sources_are_numbered_in_order(spark):
    user, search = both(spark, 3000)
    seen, want = set(), []
    rows = [(0, *r) for r in user.collect()] + [(1, *r) for r in search.collect()]
    for origin, url, text, ord_ in sorted(rows, key=lambda r: (r[0], r[3] is not None, r[3] or 0, r[1] is not None, r[1] or "")):
        if url is None or url not in seen:
            seen.add(url)
            want.append((f"S{len(want) + 1}", len(want) + 1, origin, url, text, ord_))
    got = C.merge_sources(user, search).select("source_id", "n", "origin", "url", "text", "ord").orderBy("n").collect()
    assert [tuple(r) for r in got] == want


def test_no_window_holds_all_sources(spark):
    plan = C.merge_sources(*both(spark, 100))._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x and "total" not in x]
    assert windows and all(x.count("], [") == 2 for x in windows)  # functions, partition, order
