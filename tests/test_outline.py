"""Outlines, scopes, bibliographies and papers on random documents, against plain loops."""

import random
import re

import pytest

from groundwork.operators import outline as O

SCHEMA = "doc_id int, ord int, type string, level int, text string, bibliography_id string"
NAMES = ["Abstract", "摘要", "Introduction", "2. Method", "2.1 Data set", "3 Results", "第4章 结论", "A. Proofs", "References", "5. Works cited.", "参考文献", "Bibliography", "Data", "!!", "", None, "B method"]


def documents(seed, n):
    draw, out = random.Random(seed), []
    for d in range(n):
        box = None
        for i in range(draw.randrange(22)):
            box = draw.choice([box, box, box, None, "b1", "b2"]) if draw.random() < 0.5 else box if draw.random() < 0.5 else None
            if draw.random() < 0.45:
                out.append((d, i, "heading", draw.choice([1, 2, 3, 4, None]), draw.choice(NAMES), box))
            else:
                out.append((d, i, draw.choice(["paragraph", "list_item", "table"]), None, f"text {i}", box))
    return out


def level(b):
    return 2 if b[3] is None else b[3]


def is_references(text):
    bare = re.sub(r"^(?:(?:第\s*)?\d+(?:\.\d+)*(?:\s*[章节.:：、-]\s*|\s+)|[A-Za-z](?:[.:：]\s*|\s+))", "", (text or "").strip())
    return re.sub(r"[.:：。\s]+$", "", bare).lower() in ("reference", "references", "bibliography", "works cited", "参考文献", "引用文献")


def ranges(blocks):
    out, i = [], 0
    while i < len(blocks):
        b = blocks[i]
        if b[5]:
            end = i + 1
            while end < len(blocks) and blocks[end][5] == b[5]:
                end += 1
        elif b[2] == "heading" and is_references(b[4]):
            end, box = i + 1, blocks[i + 1][5] if i + 1 < len(blocks) else None
            while end < len(blocks) and (blocks[end][5] == box if box else not (blocks[end][2] == "heading" and level(blocks[end]) <= level(b))):
                end += 1
        else:
            i += 1
            continue
        out.append((i, end))
        i = end
    return out


def by_doc(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(scope="module")
def made(spark):
    rows = documents(4, 300)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4).persist()


def test_intervals_and_paths(made):
    rows, blocks = made
    got = {(r["doc_id"], r["open"]): (r["close"], r["path"]) for r in O.outline(blocks).collect()}
    want = {}
    for d, bs in by_doc(rows).items():
        count = {}
        for b in bs:
            if b[2] == "heading":
                count = {k: v for k, v in count.items() if k <= level(b)}
                count[level(b)] = count.get(level(b), 0) + 1
                close = next((x[1] for x in bs if x[1] > b[1] and x[2] == "heading" and level(x) <= level(b)), None)
                want[d, b[1]] = (close, [count[k] for k in sorted(count)])
    assert got == want and len(got) > 500


def test_bibliographies(made):
    rows, blocks = made
    got = {(r["doc_id"], r["ord"]): (r["type"], r["translation_policy"]) for r in O.annotate_bibliography(blocks).collect()}
    want = {}
    for bs in by_doc(rows).values():
        inside = {i for a, b in ranges(bs) for i in range(a, b)}
        for i, b in enumerate(bs):
            kind = "reference" if i in inside and b[2] in ("paragraph", "list_item") else b[2]
            want[b[0], b[1]] = (kind, "preserve-original" if i in inside else None)
    assert got == want and any(p for _, p in want.values())


def test_main_part_of_papers(spark, made):
    rows, blocks = made
    docs = spark.createDataFrame([(d, None, False) for d in range(300)], "doc_id int, url string, scholarly boolean")
    got = by_doc([tuple(r) for r in O.crop_paper_main(blocks, docs).select("doc_id", "ord", "boundary").orderBy("doc_id", "ord").collect()])
    papers = {r["doc_id"] for r in O.paper_documents(blocks, docs).collect()}
    plain = lambda t: re.sub(r"[\W_]+", "", re.sub(r"^\s*(?:第\s*)?(?:[a-z]|\d+(?:\.\d+)*)(?:\s*[章节.:：-]|\s+|$)", "", (t or "").lower()))
    for d, bs in by_doc(rows).items():
        found = ranges(bs)
        assert [r[1] for r in got[d]] == [b[1] for b in (bs[: found[0][1]] if found else bs)] and all(r[2] == bool(found) for r in got[d])
        heads = [b[4] or "" for b in bs if b[2] == "heading"]
        assert (d in papers) == bool(found and any(plain(h) in ("abstract", "摘要") for h in heads) and any(re.match(r"\s*(?:第\s*)?\d+(?:\.\d+)*(?:\s*[章节.:：、-]|\s+)\s*\S", h) for h in heads))
    urls = [(1, "https://arxiv.org/abs/2401.00001v2", False), (2, "https://arxiv.org/list/cs", False), (3, None, True), (4, "https://www.alphaxiv.org/pdf/2401.00001.pdf", None), (5, None, None)]
    none = blocks.filter("false")
    assert sorted(r[0] for r in O.paper_documents(none, spark.createDataFrame(urls, "doc_id int, url string, scholarly boolean")).collect()) == [1, 3, 4]


TARGETS = [("2", None), ("2.1", None), ("9", None), ("method", None), ("Data set", "results"), ("references", None), ("intro", "Works Cited"), ("结论", None), ("results", "abstract"), ("a", None), ("!!", None), ("introduction and more", None)]


def number(t):
    m = re.match(r"\s*(?:第\s*)?([A-Za-z]|\d+(?:\.\d+)*)(?:\s*[章节.]|\s+|$)", t or "")
    return m[1].lower() if m else ""


def name(t):
    return re.sub(r"[\W_]+", "", re.sub(r"^\s*(?:第\s*)?(?:[a-z]|\d+(?:\.\d+)*)(?:\s*[章节.:：-]|\s+|$)", "", (t or "").lower()))


def find(heads, target, after):
    for b in heads:
        if b[1] < after:
            continue
        own = name(b[4])
        if number(target):
            hit = number(b[4]) == number(target)
        elif not name(target):
            hit = False
        elif is_references(target):
            hit = is_references(b[4])
        else:
            hit = own and (own in name(target) or name(target) in own)
        if hit:
            return b
    return None


@pytest.mark.parametrize("target", range(len(TARGETS)))
def test_scopes(spark, made, target):
    rows, blocks = made
    start, end = TARGETS[target]
    r = spark.createDataFrame([(d, start, end) for d in range(300)], "doc_id int, start string, end string")
    got = {x["doc_id"]: x for x in O.section_ranges(blocks, r).collect()}
    kept = by_doc([tuple(x) for x in O.slice_sections(blocks, r).select("doc_id", "ord", "text").orderBy("doc_id", "ord").collect()])
    docs = by_doc(rows)
    for d in range(300):
        bs = docs.get(d, [])
        heads = [b for b in bs if b[2] == "heading"]
        s = find(heads, start, -1)
        same = end is None or (name(start), number(start)) == (name(end), number(end))
        e = s if same else s and find(heads, end, s[1])
        x = got[d]
        if not (s and e):
            assert x["error"] == ("end" if s else "start") and d not in kept
            assert x["available"] == "；".join(b[4] or "" for b in heads[:16] if b[4] is not None) or not heads
            continue
        stop = next((b[1] for b in heads if b[1] > e[1] and level(b) <= level(e)), None)
        assert (x["open"], x["close"], x["error"]) == (s[1], stop, None)
        want = [b[4] for b in bs if b[1] >= s[1] and (stop is None or b[1] < stop)]
        assert [k[2] for k in kept[d]] == want and [k[1] for k in kept[d]] == list(range(len(want)))
