"""Whitening and search over vectors, held against numpy on whole tables and on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.llm import queries, topk, whitening

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), *[T.StructField(c, T.StringType()) for c in ("x", "q", "score", "rank", "n", "block", "component")]])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *["c"] * 7) for i, v in rows], SCHEMA).repartition(3)


def plain(xs, k=4):
    """Eigenvectors and whitened rows of the distinct ``xs``."""
    u = np.unique(xs, axis=0)
    mean = u.mean(0)
    cov = (u - mean).T @ (u - mean) / len(u)
    values, vectors = np.linalg.eigh(cov)
    return u, mean, values[::-1][:k], vectors[:, ::-1][:, :k], np.trace(cov)


def test_whitening_of_the_table(spark, sf):
    got = queries.op11_lanczos_whitening(spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    xs = np.floor(256 * np.stack(table["embedding"]).astype(float))
    u, mean, values, vectors, trace = plain(xs)
    assert len(got) == 4 * len(table) and (got["n"] == len(u)).all() and (got["identity_error"] < 1e-12).all()
    for c in range(1, 5):
        mine = got[got["component"] == c].set_index("vec_id").loc[table["vec_id"]]
        want = (xs - mean) @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        sign = np.sign(mine["whitened"].to_numpy() @ want)
        assert np.abs(sign * mine["whitened"].to_numpy() - want).max() < 1e-10
        assert np.abs(mine["explained"] - values[c - 1] / trace).max() < 1e-12
        assert (mine["deviation"].to_numpy() == ((len(u) * xs - u.sum(0)) ** 2).sum(1)).all()


def test_whitening_of_odd_rows(spark):
    draw = np.random.default_rng(3)
    rows = [(i, (draw.integers(-9, 9, 5) / 256).tolist()) for i in range(40)]
    odd = [(100, None), (101, [0.1, None, 0, 0, 0]), (102, [float("nan")] * 5), (103, [float("inf"), 0, 0, 0, 0]), (104, [0.5, 0.25]), (None, rows[0][1]), rows[1], (105, [-0.0] * 5)]
    got = whitening.whiten(frame(spark, rows + [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in odd])).toPandas()
    kept = rows + [(104, [0.5, 0.25, 0, 0, 0]), (None, rows[0][1]), rows[1], (105, [0] * 5)]
    assert len(got) == 4 * len(kept) and got["vec_id"].isna().sum() == 4
    u, mean, values, vectors, trace = plain(np.floor(256 * np.array([v for _, v in kept])))
    mine = got[(got["component"] == 1) & (got["vec_id"] == 7)]["whitened"].iloc[0]
    assert abs(abs(mine) - abs((np.floor(256 * np.array(rows[7][1])) - mean) @ vectors[:, 0] / np.sqrt(values[0]))) < 1e-12
    assert np.allclose(sorted(set(got["explained"]), reverse=True), values / trace, rtol=1e-12) and got["identity_error"].max() < 1e-12


def test_equal_and_missing_variance(spark):
    """Equal eigenvalues are found as often as they occur; a component without variance is not returned."""
    corners = [[a / 256, b / 256, c / 256, 0.0, 1.0] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    got = whitening.whiten(frame(spark, list(enumerate(corners * 2)))).toPandas()
    assert set(got["component"]) == {1, 2, 3} and len(got) == 48 and np.allclose(got["explained"], 1 / 3) and (got["n"] == 8).all()
    three = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(three[:8].T @ three[:8] / 8, np.eye(3), atol=1e-12)
    for rows in ([], [(1, [0.5, 0.5])], [(1, [0.5]), (2, [0.5])], [(1, []), (2, [])], [(1, None)]):
        assert whitening.whiten(frame(spark, rows)).collect() == []


def test_steps_end_early_where_little_is_left(spark):
    draw = np.random.default_rng(5)
    scales = np.array([9000.0, 4000, 2000, 900, 300] + [2.0] * 25)
    xs = [(int(i), ((draw.standard_normal(30) * scales).round() / 256).tolist()) for i in range(300)]
    df = frame(spark, xs)
    rows = df.select(whitening.scaled(df, "embedding", 256).alias("x"))
    made = whitening.fit(rows, 30)
    _, _, values, vectors, _ = plain(np.floor(256 * np.array([v for _, v in xs])))
    assert made.steps < 30 and np.allclose(made.values, values, rtol=1e-12)
    assert np.allclose(np.abs(made.vectors @ vectors), np.eye(4), atol=1e-12)


def test_large_values_stay_exact(spark):
    rows = [(1, [1e13, 2.0]), (2, [-1e13, 0.0]), (3, [3.0, 1e300])]
    got = {(r["vec_id"], r["component"]): r["deviation"] for r in whitening.whiten(frame(spark, rows)).collect()}
    assert got and all(v is None for v in got.values())
    rows = [(1, [4e4, 2.0]), (2, [-4e4, 0.0])]
    assert {r["deviation"] for r in whitening.whiten(frame(spark, rows)).collect()} == {(2 * 256 * 40_000) ** 2 + 512**2}


def brute(rows, every, k):
    out = []
    fine = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    for q, x in {(i, tuple(v)) for i, v in fine if i is not None and i % every == 0}:
        scores = [(-sum(a * b for a, b in zip(x, v, strict=False)), i is None, i or 0, i) for i, v in fine if i != q]
        out += [(q, n + 1, s[3], -s[0]) for n, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("p", [topk.TopK(), topk.TopK(first=20, growth=2, group=4, block=7), topk.TopK(k=1, lists=9, first=1), topk.TopK(k=500)])
def test_search_against_all_scores(spark, p):
    draw = np.random.default_rng(11)
    rows = [(int(i), (draw.integers(-4, 5, 6) / 8).tolist()) for i in range(230)]
    rows += [(300 + i, rows[0][1]) for i in range(60)]  # one common vector, all ties
    rows += [(None, rows[3][1]), rows[5], (1000, None), (1010, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (1020, [float("nan")] * 6), (1030, [1.0, -1.0]), (1040, []), rows[10]]
    got = topk.search(frame(spark, rows), F.col("vec_id") % 10 == 0, p=p).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 10, p.k)


def test_search_on_few_and_large(spark):
    assert topk.search(frame(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert topk.search(frame(spark, [(10, [1.0])]), F.col("vec_id") % 10 == 0).collect() == []
    rows = [(10, [1e6, 1e6]), (11, [1e6, 1.0]), (12, [-1e6, 3e6]), (13, [1e12, 1e12])]  # beyond what doubles hold, and beyond long
    got = [tuple(r) for r in topk.search(frame(spark, rows), F.col("vec_id") == 10).orderBy("rank").collect()]
    want = sorted(((sum(int(1024 * a) * int(1024 * b) for a, b in zip(rows[0][1], v, strict=True)), i) for i, v in rows[1:]), reverse=True)
    assert [(g[2], g[3]) for g in got] == [(i, min(s, 2**63 - 1)) for s, i in want]
