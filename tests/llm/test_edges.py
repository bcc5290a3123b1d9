"""Each operator and stage on nulls, empty and very long texts, repeats, empty tables and extra columns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from groundwork.llm import chat, decontaminate, html_text, license_scan, mixing, near_dup, pii, quality, secret_scan, token_counts

CLASH = ("kept", "n_words", "size", "copies", "rep", "bucket", "root", "a", "b", "h", "spans", "row", "key", "target")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASH]])
PROSE = " ".join(f"word{i} of the{i} plain text{i * 3}." for i in range(60))
LONG = " ".join(f"w{i}" for i in range(150_000))


def rows():
    texts = [PROSE, PROSE, None, "", " \n\t", "one", "a b c d", LONG, "x" * 200_000, "é ß 😀 \x00 end", PROSE.replace("word7 ", "")]
    out = [(i, t, "en", "s" if i % 2 else None, None if t is None else len(t), *["c"] * len(CLASH)) for i, t in enumerate(texts)]
    return [*out, out[0], (None, PROSE, None, None, None, *[None] * len(CLASH)), (None, None, None, None, None, *[None] * len(CLASH))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(PROSE.split()[8:40])), (2, None), (3, "too short"), (None, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")


OPERATORS = {
    "mix": mixing.plan, "copies": mixing.mix_sources, "trees": token_counts.revised_counts, "licences": license_scan.scan, "quality": quality.judge, "clean": quality.keep_clean,
    "secrets": secret_scan.scan, "redact": secret_scan.redact, "classes": near_dup.classes, "one": near_dup.keep_one, "pii": pii.scan,
}
A_ROW_EACH = {"mix", "trees", "licences", "quality", "secrets", "redact", "pii"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edges(docs, name):
    got = OPERATORS[name](docs).collect()
    if name in A_ROW_EACH:
        assert len(got) == len(rows())
    if name == "classes":
        of = {r["doc_id"]: r["class_id"] for r in got}
        assert of[0] == of[1] == of[10] == 0 and of[2] == 2 and of[3] == 3 and of[4] == 4 and None in of
        assert len(got) == len({r[0] for r in rows()})
    if name == "one":
        assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [0, 2, 3, 4, 5, 6, 7, 8, 9] and sum(r["doc_id"] is None for r in got) == 2
    if name in ("clean", "one", "redact"):
        assert set(got[0].asDict()) == set(SCHEMA.fieldNames())
    if name == "quality":
        assert {r["doc_id"]: r["kept"] for r in got if r["doc_id"] in (0, 2, 3, 5, 7)} == {0: True, 2: False, 3: False, 5: False, 7: True}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_decontamination_edges(spark, docs, bench):
    for limit in (8_000_000, 1):
        p = decontaminate.Leak(broadcast_chars=limit)
        found = decontaminate.contaminated(docs, bench, p).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"], r["item_id"]) for r in found if r["doc_id"] is not None) == [(False, 0, 1), (False, 0, 1), (False, 1, 1), (False, 10, 1)]
        assert sum(r["doc_id"] is None for r in found) == 1
        assert decontaminate.contaminated(docs, bench.limit(0), p).count() == 0
        assert decontaminate.contaminated(docs.limit(0), bench, p).count() == 0
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows()) - 5


def test_chat_edges(spark):
    c = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, None, "x"), (3, 0, "assistant", "a b c d"), (3, 0, "assistant", "a b c d"), (None, 0, "assistant", "z")], "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in chat.format_pairs(chat.stale_reply_pairs(c)).collect()}
    assert set(got) == {1, 3}  # a row without a conv_id is of no conversation
    assert got[1]["n_prefix"] == 2 and got[1]["chosen"] == "" and got[1]["chosen_spans"] == []
    assert chat.format_pairs(chat.stale_reply_pairs(c.limit(0))).collect() == []


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<article><p>a &amp; b<p>c\n d"), (4, "plain"), (5, "<<<>&#x;</p></div>"), (6, "<div>" * 300 + "deep"), (7, "<article><p>" + "long " * 50_000 + "</p></article>")], "page_id long, html string")
    got = {r["page_id"]: r["main_text"] for r in html_text.extract(pages.withColumn("main_text", F.lit("old"))).collect()}
    assert got[1] == "" and got[2] == "" and got[3] == "a & b\nc d" and len(got[7]) == 249_999
    assert html_text.extract(pages.limit(0)).collect() == []


def test_every_stage_takes_edges(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, read.limit(0), str(tmp_path)).collect() == []
        out = stage(spark, read, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == read.columns
        got = out.collect()
        ids, texts = sorted((r["doc_id"] for r in got), key=str), [r["text"] for r in got]
        if name == "quality_rules":  # nulls, empty and short texts go; repeats and rows without an id are judged alike
            assert ids == sorted([0, 0, 1, 7, 10, None], key=str) and all(texts)
        if name == "near_duplicates":  # one of each class, texts without words and rows without an id each for themselves
            assert ids == sorted([0, 2, 3, 4, 5, 6, 7, 8, 9, None, None], key=str)
        if name == "decontamination":  # no row leaks, null texts stay
            assert len(got) == len(rows()) and texts.count(None) == 2
        if name == "secrets":  # a row each, nulls stay null
            assert ids == sorted((r[0] for r in rows()), key=str) and texts.count(None) == 2 and texts.count("") == 1
        if name == "mixture":  # each row at most twice; both sources, the null one included, are taken
            assert all(n <= 2 for n in Counter((r["doc_id"], r["copy"]) for r in got).values()) and max(r["copy"] for r in got) <= 2 and {r["source"] for r in got} == {"s", None}


def test_no_place_is_taken_once_too_often(spark):
    """At a rate of 2 and an offset just below one copy, and with classes split into blocks."""
    rows = [(i, "a", "w " * (1 + i % 3)) for i in range(4096)] + [(9000 + i, "b", "x " * 400) for i in range(40)] + [(9999, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for seed in range(3):
        for spread in (1, 1000):
            out = mixing.plan(docs, mixing.Mix(weights=(1, 7), share_percent=190, seed=seed, spread=spread)).toPandas()
            assert len(out) == len(rows) and out["copies"].max() <= 2
            for _, g in out.groupby("source"):
                assert abs((g["size"] * g["copies"]).sum() - g["target"].iloc[0]) <= 2 * g["size"].max()
                assert abs(g["copies"].sum() - len(g) * g["target"].iloc[0] / g["source_size"].iloc[0]) <= 1


def test_clashing_ids_lose_no_text(spark):
    """Texts that share a doc_id are documents of their own; large graphs give the same classes."""
    other, third = PROSE.replace("word", "name"), PROSE.replace("the", "a")
    near = PROSE.replace("word59 ", "")
    docs = spark.createDataFrame([(1, PROSE), (2, near), (2, other), (3, third), (3, third + " "), (4, other), (5, ""), (5, None)], "doc_id long, text string")
    left = sorted((r["doc_id"], r["text"] or "") for r in near_dup.keep_one(docs).collect())
    assert [(i, t.strip()) for i, t in left] == [(1, PROSE), (2, other), (3, third), (5, "")]
    for p in (near_dup.NearDup(), near_dup.NearDup(small_graph=0)):
        assert {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs, p).collect()} == {1: 1, 2: 1, 3: 3, 4: 2, 5: 5}


def test_hot_buckets_are_split(spark, monkeypatch):
    """The same classes when buckets are dealt in parts."""
    import random

    r = random.Random(2)
    base = [f"w{r.randrange(500)}" for _ in range(80)]
    texts = []
    for i in range(60):
        ws = list(base)
        for _ in range(r.randrange(6)):
            ws[r.randrange(80)] = f"x{r.randrange(10**6)}"
        texts.append((i, " ".join(ws)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted(map(tuple, near_dup.classes(docs).collect()))
    monkeypatch.setattr(near_dup, "TOGETHER", 3)
    assert sorted(map(tuple, near_dup.classes(docs).collect())) == want
