import pytest

from groundwork.llm import decontaminate

ITEM = " ".join(f"word{i} of{i}" for i in range(20))
CLEAN = " ".join(f"other{i}" for i in range(40))


@pytest.mark.parametrize("limit", [8_000_000, 0])
def test_each_row_is_judged_by_itself(spark, limit):
    p = decontaminate.Leak(broadcast_chars=limit)
    rows = [(None, ITEM, "a"), (None, CLEAN, "b"), (1, ITEM, "c"), (1, CLEAN, "d"), (1, CLEAN, "d"), (2, ITEM, "e"), (2, ITEM, "e"), (3, None, "f"), (None, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM + " more"), (2, None)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench, p)
    assert kept.columns == docs.columns
    assert sorted(r["row"] for r in kept.collect()) == ["b", "d", "d", "f", "g"]
    found = decontaminate.contaminated(docs, bench, p)
    assert found.columns == ["doc_id", "item_id", "coverage", "longest", "n_tiles"]
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in found.collect()) == sorted([(i, 1) for i in (0, 1, 2, 2)] * 2)
