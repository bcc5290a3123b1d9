"""The divergence audit against a plain version, on texts that share and lack terms."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from groundwork.llm import divergence

SCHEMA = T.StructType([*[T.StructField(c, T.StringType()) for c in ("text", "lang", "source")], *[T.StructField(c, T.StringType()) for c in ("p", "p0", "at", "term", "n", "value", "part")]])


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["c"] * 7) for r in rows], SCHEMA).repartition(3)


def plain(rows, least=10, top=10):
    docs = [((t or ""), (g or ""), (s or "")) for t, g, s in rows]
    bags = [(g, s, Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))) for t, g, s in docs]
    df, counts = Counter(), defaultdict(Counter)
    for g, s, bag in bags:
        df.update((g, t) for t in bag)
        counts[g, s].update(bag)
    out = []
    for lang in {g for g, _ in counts}:
        kept = [t for (g, t), n in df.items() if g == lang and n >= least]
        of = {s: {t: c[t] for t in kept} for (g, s), c in counts.items() if g == lang}
        of[None] = {t: sum(c[t] for c in of.values()) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()} for s, c in of.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in [s for s in of if s is not None]:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in of if o not in (None, s)]
            terms = [(-f(p[s][t], p[None][t]), t) for t in kept if of[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                order = sorted(found, key=lambda v: (v[0], v[1].encode()))
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(order) if part == "pair" or i < top]
    return sorted(out)


def texts(seed, n, sources, words):
    draw = random.Random(seed)
    for _ in range(n):
        s = draw.choice(sources)
        some = [draw.choice(words) if draw.random() < 0.7 else f"{s or 'x'}{draw.randrange(3)}word" for _ in range(draw.randrange(60))]
        yield " ".join(w.upper() if draw.random() < 0.2 else w for w in some) or None, draw.choice(["en", "de", None]), s


@pytest.mark.parametrize("p", [divergence.Audit(), divergence.Audit(least=2, top=3, held=1, pairs=1, parts=3)])
def test_against_a_plain_version(spark, p):
    words = ["alpha", "béta", "ÉCART", "ß", "gamma-delta", "漢字", "😀", "a", "rare9tail", "it's", *[f"w{i}x{chr(97 + i % 26)}" for i in range(30)]]
    rows = [*texts(1, 400, ["s1", "s2", "s3", None, "ω", "S9"], words), ("only here", "fr", "s1"), ("", "fr", "s2"), (None, "it", "s7"), *[("alpha beta " * 9000, "en", "hot")] * 3]
    got = [tuple(r) for r in divergence.audit(frame(spark, rows), p).collect()]
    assert sorted(got) == plain(rows, p.least, p.top)


def test_shares_are_exact_beyond_long(spark):
    n, total, terms = 3 * 10**15 + 7, 9 * 10**17 + 1, 12_345_679
    of = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    assert of.select(divergence.share(of["n"], of["total"], of["terms"])).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * terms)


def test_shared_paths_count_once(spark):
    """Rows of equal beginnings: a node gives its corrections once, times the rows that pass it."""
    made = divergence._tree(10)
    import pyarrow as pa

    node = lambda at, p: {"at": at, "p": p, "p0": 5}
    paths = [([node(1, 90), node(2, 40)], 3), ([node(1, 90), node(2, 40), node(4, 70)], 2), ([node(1, 90), node(3, 60)], 1), ([node(2, 30)], 4)]
    kind = pa.list_(pa.struct([("at", pa.int32()), ("p", pa.int64()), ("p0", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array([p for p, _ in paths], kind), pa.array([n for _, n in paths], pa.int64())], names=["lang", "path", "n"])
    got, want = Counter(), Counter()
    for b in made(iter([batch])):
        for r in b.to_pylist():
            got[r["a"], r["b"]] += r["v"]
    f = divergence._apart
    for path, n in paths:
        for i, y in enumerate(path):
            for x in path[:i]:
                want[x["at"], y["at"]] += n * (f(x["p"], y["p"]) - f(x["p"], 5) - f(5, y["p"]) + f(5, 5))
    assert got == want


def test_empty_and_single(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
    assert divergence.audit(frame(spark, [(None, None, None)])).collect() == []
    assert [tuple(r) for r in divergence.audit(frame(spark, [("x", None, "b"), ("y", None, "a")])).orderBy("source").collect()] == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]
