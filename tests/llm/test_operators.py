"""Operators against brute force, exact round trips, SQL or held-out accuracy."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from groundwork.llm import bagminhash, chat, decontaminate, html_text, license_scan, mixing, near_dup, pii, secret_scan, sql, tiling, token_counts, token_trees
from groundwork.llm.html_blocks import blocks
from groundwork.llm.spans import redacted
from groundwork.llm.queries import ORACLE_SQL, QUERIES
from groundwork.llm.text import TERM, WORD
from groundwork.sources.tables import table

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(spark):
    return dict(table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    flat = lambda d: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in d[cols].itertuples(index=False))
    assert flat(got) == flat(want)


def test_targets_fill_under_caps(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, None: 500}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), mixing.Mix()).collect()}
    weights, total, capped = dict(zip(["a", "b", "c", None], (5, 2, 1, 5), strict=True)), 1.5 * sum(sizes.values()), set()
    while True:  # plain resharing
        rest = total - sum(2 * sizes[s] for s in capped)
        share = {s: rest * w / sum(weights[x] for x in weights if x not in capped) for s, w in weights.items() if s not in capped}
        over = {s for s, t in share.items() if t > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    want = {s: 2.0 * sizes[s] if s in capped else share[s] for s in sizes}
    assert got == pytest.approx(want)


def test_mix_repeats_itself_and_comes_near(spark, sf):
    docs = table(spark, sf, "documents")
    a, b = mixing.plan(docs).toPandas(), mixing.plan(docs.repartition(5)).toPandas()
    key = ["doc_id", "copies"]
    assert sorted(map(tuple, a[key].values)) == sorted(map(tuple, b[key].values))
    assert a["copies"].max() <= 2
    assert abs((a["size"] * a["copies"]).sum() / (1.5 * a["size"].sum()) - 1) < 0.1
    assert mixing.mix_sources(docs).count() == a["copies"].sum()


def test_common_prefix_is_rendered_once(spark):
    turns = "array<struct<turn:int,role:string,text:string>>"
    a, b = [(0, "user", "q"), (1, "assistant", "yes"), (2, "user", "r")], [(0, "user", "q"), (1, "assistant", "no")]
    r = chat.format_pairs(spark.createDataFrame([(1, a, b)], f"pair_id int, chosen_turns {turns}, rejected_turns {turns}")).first()
    assert r["n_prefix"] == 1 and r["prompt"] == "<|user|>\nq<|end|>\n"
    said = [r["chosen"][s["start"] : s["end"]] for s in r["chosen_spans"]]
    assert said == ["yes<|end|>\n"] and [r["rejected"][s["start"] : s["end"]] for s in r["rejected_spans"]] == ["no<|end|>\n"]


def test_trees_equal_full_counts_under_edits():
    count, r = token_counts.counter(token_counts.Vocabulary().path), random.Random(3)
    alphabet = "ab é1 \n\t.,' 😀*"
    for _ in range(600):
        x, edits, p = "".join(r.choices(alphabet, k=r.randint(0, 300))), [], 0
        while p < len(x) and r.random() < 0.8:
            a = r.randint(p, len(x))
            b = r.randint(a, min(len(x), a + 20))
            edits.append((a, b, "".join(r.choices(alphabet, k=r.randint(0, 12)))))
            p = b
        tree = token_trees.build(x, count, 16)
        new, y, _ = token_trees.edit(tree, x, edits, count, 16) if edits else (tree, x, 0)
        for a, b, w in reversed(edits):
            x = x[:a] + w + x[b:]
        assert y == x and new.total == count(x) and sum(new.lengths) == len(x) and new.sums[1] == sum(new.sums[new.size :])


def test_edits_encode_only_their_surroundings(spark, sf, texts):
    rows = token_counts.revised_counts(table(spark, sf, "documents")).collect()
    count = token_counts.counter(token_counts.Vocabulary().path)
    assert all(r["n_before"] == count(texts[r["doc_id"]]) and r["n_after"] == count(r["text"]) for r in rows)
    assert sum(r["n_encoded"] for r in rows) < 0.25 * sum(map(len, texts.values()))


def test_recount_applies_given_edits(spark):
    docs = spark.createDataFrame([(1, "one two three " * 60), (2, None)], "doc_id long, text string")
    trees = token_counts.build_trees(docs)
    rows = trees.selectExpr("*", "case when doc_id = 1 then array(named_struct('start', 4, 'end', 7, 'new', 'five six'), named_struct('start', 5, 'end', 9, 'new', 'overlaps')) end as edits")
    got = {r["doc_id"]: r for r in token_counts.recount(rows).collect()}
    count = token_counts.counter(token_counts.Vocabulary().path)
    assert got[1]["text"].startswith("one five six three one") and got[1]["n_after"] == count(got[1]["text"]) and got[1]["n_encoded"] < 800
    assert (got[2]["text"], got[2]["n_before"], got[2]["n_after"]) == ("", 0, 0)


def test_main_text_on_held_out_pages():
    model, wrong, total = html_text.trained(html_text.Pages()), 0, 0
    for html, labels in html_text.labelled(120, 991):
        got, want = html_text.main_blocks(html, model), [b.text for b, y in zip(blocks(html), labels, strict=True) if y]
        wrong, total = wrong + sum(((Counter(got) - Counter(want)) + (Counter(want) - Counter(got))).values()), total + len(labels)
    assert wrong <= 0.01 * total


def test_main_text_of_the_given_pages(spark, sf):
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in QUERIES["op4_main_text"](spark, sf).collect())
    html = table(spark, sf, "pages").first()["html"]
    got = html_text.main_blocks(html, html_text.trained(html_text.Pages()))
    heading = re.search("<h1>(.*?)</h1>", html)[1]
    assert got[0] == " ".join(__import__("html").unescape(heading).split()) and not any("example.com" in x for x in got)


def test_licence_counts_match_brute_force(spark, sf, texts):
    for r in QUERIES["op5_license_labels"](spark, sf).collect():
        ws = re.findall(TERM, texts[r["doc_id"]].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        at = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"]) == (len(ws), len(at))
        assert (r["first_word"], r["last_word"]) == (min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_licence_needs_its_phrases():
    index = license_scan.Index({}, 1000, license_scan.Scan())
    scan = lambda t: index.scan(license_scan.terms(t))["labels"]
    assert scan("This work is licensed under the GNU General Public License, version 3.") == "gpl-3"
    assert scan("Licensed under the BSD 3-Clause License") == "bsd-3"
    assert scan("Licensed under the GNU General Public, version 3") == "" and scan("a public version of the general license") == ""


def test_tiles_of_reordered_passages():
    a, b, c = list(range(10)), list(range(20, 29)), list(range(40, 52))
    item, doc = a + b + c, [99, *c, 98, *a, 97, *b, 96]
    found = tiling.tiles(item, doc, 5)
    assert sum(n for _, _, n in found) == len(item) and [n for _, _, n in found] == [12, 10, 9]
    assert all(item[i : i + n] == doc[j : j + n] for i, j, n in found)
    r = random.Random(5)
    for _ in range(200):
        p, t = [r.randint(0, 4) for _ in range(r.randint(0, 25))], [r.randint(0, 4) for _ in range(r.randint(0, 40))]
        got = tiling.tiles(p, t, 3) if p else []
        assert all(p[i : i + n] == t[j : j + n] and n >= 3 for i, j, n in got)
        for side, size in ((0, len(p)), (1, len(t))):
            marks = [0] * size
            for tile in got:
                for k in range(tile[side], tile[side] + tile[2]):
                    marks[k] += 1
            assert max(marks, default=0) <= 1
        free_p, free_t = set(range(len(p))), set(range(len(t)))
        for i, j, n in got:
            free_p -= set(range(i, i + n))
            free_t -= set(range(j, j + n))
        assert not any(p[i : i + 3] == t[j : j + 3] and {i, i + 1, i + 2} <= free_p and {j, j + 1, j + 2} <= free_t for i in range(len(p) - 2) for j in range(len(t) - 2))


def test_leaks_against_all_pairs(spark, sf, texts):
    items = {r["item_id"]: decontaminate.terms(r["text"]) for r in table(spark, sf, "benchmark").collect()}
    want = set()
    for d, text in texts.items():
        ws = decontaminate.terms(text)
        for i, item in items.items():
            if set(zip(*(item[k:] for k in range(5)), strict=False)) & set(zip(*(ws[k:] for k in range(5)), strict=False)):
                number: dict = {}
                found = tiling.tiles([number.setdefault(w, len(number)) for w in item], [number.setdefault(w, len(number)) for w in ws], 5)
                if sum(n for _, _, n in found) >= 0.5 * len(item):
                    want.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in QUERIES["op6_tiling_leaks"](spark, sf).collect()} == want


ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def sha(spans, kinds):
    order = sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in order).encode()).hexdigest()


def test_secret_base_matches_brute_force(spark, sf, texts):
    for r in QUERIES["op8_secret_spans"](spark, sf).collect():
        t = texts[r["doc_id"]]
        want = [("assign", *m.span()) for m in re.finditer(ASSIGN, t) if len(m[1]) >= 6] + [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert r["base_sha256"] == sha(want, ["assign", "access", "hex"]) and r["n_hex"] == sum(k == "hex" for k, _, _ in want)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(filter(None, r["spans"].split(",")))


def test_secret_tagger_on_held_out_lines():
    p = secret_scan.Tagger()
    model, hit, false, miss = secret_scan.trained(p), 0, 0, 0
    for text, gold in secret_scan.labelled(300, 4321):
        got = [(a, b) for _, a, b in secret_scan.tagged_spans(text, p, model)]
        meets = lambda x, ys: any(a < x[1] and x[0] < b for a, b in ys)
        hit, miss, false = hit + sum(meets(g, got) for g in gold), miss + sum(not meets(g, got) for g in gold), false + sum(not meets(g, gold) for g in got)
    assert hit >= 0.97 * (hit + miss) and false <= 0.03 * hit
    assert secret_scan.tagged_spans("plain words only, no digits here", p, model) == []


def test_bagminhash_is_unbiased():
    r = np.random.default_rng(1)
    base = r.integers(1, 2**62, 300).astype(np.uint64)
    edited = base.copy()
    edited[r.choice(300, 8, replace=False)] = 7
    docs = [base, edited, np.concatenate([base[:40]] * 9), np.concatenate([base[:40]] * 7), base[:2], base[:0]]
    starts = np.cumsum([0, *map(len, docs)])
    sig = bagminhash.signatures(np.concatenate(docs), starts, m=4096)
    bag = lambda w: Counter(zip(*(w[i:].tolist() for i in range(5)), strict=False))
    for i, j in ((0, 1), (2, 3)):
        a, b = bag(docs[i]), bag(docs[j])
        true = (a & b).total() / (a | b).total()
        assert abs((sig[i] == sig[j]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 4096)
    assert (sig[5] == 0).all() and (sig[4] != 0).all()


def brute_classes(texts, threshold=0.8):
    bags, ids = [], defaultdict(list)
    for d, t in texts.items():
        if ws := tuple(re.findall(TERM, (t or "").lower())):
            ids[ws].append(d)
    for ws in ids:
        bags.append(Counter(zip(*(ws[j:] for j in range(5)), strict=False)) if len(ws) >= 5 else Counter([ws]))
    parent = list(range(len(bags)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            both = (a & bags[j]).total()
            if both and both >= threshold * (a.total() + bags[j].total() - both) - 1e-9:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, members in enumerate(ids.values()):
        groups[find(i)] += members
    return {d: d for d in texts} | {d: min(g) for g in groups.values() for d in g}


def test_classes_match_brute_force(spark, texts):
    r = random.Random(9)
    base = [f"w{r.randint(0, 300)}" for _ in range(90)]
    more = {}
    for i in range(70):  # a star of edited copies, and texts that share only a passage
        ws = list(base)
        for _ in range(r.choice((0, 1, 1, 2, 2, 3, 6))):
            ws[r.randrange(len(ws))] = f"new{i}{r.random()}"
        more[10_000 + i] = " ".join(ws)
        more[20_000 + i] = " ".join([f"own{i}.{k}" for k in range(40)] + base[:50])
    both = dict(list(texts.items())[:60]) | more
    docs = spark.createDataFrame(list(both.items()), "doc_id long, text string")
    assert dict(near_dup.classes(docs).collect()) == brute_classes(both)


def test_pii_base_matches_brute_force(spark, sf, texts):
    for r in QUERIES["op10_pii_spans"](spark, sf).collect():
        t = texts[r["doc_id"]]
        digits = lambda s: re.sub("[^0-9]", "", s)
        luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits(s)[::-1])) % 10 == 0
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(m[0])]
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
        assert r["base_sha256"] == sha(want, ["email", "ip", "card", "phone"])
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(filter(None, r["spans"].split(",")))


def test_pii_base_on_awkward_texts():
    plain = lambda t: [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for t in ("a@b.c%d@e.f", "@@a@b.c@d.e", "x@y", "a.b@c-d.e.f.", "%@a.b", "a@b.c-@d.e", "é@b.c a@b..c"):
        assert [s for s in pii.base_spans(t) if s[0] == "email"] == plain(t), t


def test_labelers_reliability():
    count = {pii.code("card", (1, 1, 0, 0, 0, 1), "4" * 16): 90, pii.code("card", (0, -1, 0, -1, 0, -1), "4" * 13): 40, pii.code("phone", (0, 0, 1, 1, 0, 1), "(555) 555-5555"): 30, pii.code("ip", (0, -1, 0, -1, 0, -1), "300.1.1.1"): 20}
    accepted = pii.trained(list(count.items())).accepted
    kinds = sorted((pii.KINDS[pii.decode(c)[0]], int(pii.decode(c)[1].sum())) for c in accepted)
    assert kinds == [("card", 3), ("phone", 3)]


def test_pipeline_against_a_plain_version(spark, sf, texts, duck):
    """The stages' documents: quality by SQL, classes and leaks by brute force, copies by the mix."""
    kept = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({sql.OP7}) WHERE kept").fetchall()}
    docs = table(spark, sf, "documents")
    out = docs
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf).persist()
        seen.append(dict(out.select("doc_id", "text").collect()))
    assert set(seen[0]) == kept
    classes = brute_classes(seen[0])
    assert set(seen[1]) == {d for d in seen[0] if classes[d] == d}
    items = [decontaminate.terms(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    leaks = {d for d, t in seen[1].items() if any(" ".join(i) in " ".join(decontaminate.terms(t)) for i in items)}
    assert set(seen[2]) == set(seen[1]) - leaks and set(seen[3]) == set(seen[2])
    p = secret_scan.Tagger()
    model = secret_scan.trained(p)
    assert all(seen[3][d] == redacted(t, secret_scan.find(t, p, model)) for d, t in seen[2].items())
    ran = corpus_pipeline.run(spark, sf)
    taken = Counter(r["doc_id"] for r in ran.select("doc_id").collect())
    assert set(taken) <= set(seen[3]) and max(taken.values()) <= 2 and p.reach > 0
    words = {d: len(re.findall(WORD, t)) for d, t in seen[3].items()}
    assert abs(sum(words[d] * n for d, n in taken.items()) / (1.5 * sum(words.values())) - 1) < 0.15
