"""Lists, pictures and display formulas of Markdown, against plain loops."""

import random

from groundwork.operators import structure as S

MD = """# T
1. one
  - sub
  - sub two
    3) deep
2. two
text
$$
a + b

c
$$
$$x^2$$
![alt](https://a.example/i.png "Title")
![only alt](i.png)
```
$$ no formula
1. no item
```
5) five
6) six
$$open"""


def test_items_formulas_and_pictures(spark):
    d = spark.createDataFrame([(1, MD), (2, None), (3, "$$"), (4, "a $$x$$ b\n$$y\nz$$ \nplain")], "doc_id int, text string")
    got = S.markdown_blocks(d).orderBy("doc_id", "ord").collect()
    one = [(r["type"], r["text"], r["ordinal"], r["delimiter"], r["depth"]) for r in got if r["doc_id"] == 1]
    assert one == [
        ("heading", "T", None, None, None), ("list_item", "1. one", 1, ".", 0), ("list_item", "  - sub", None, None, 1), ("list_item", "  - sub two", None, None, 1), ("list_item", "    3) deep", 3, ")", 2), ("list_item", "2. two", 2, ".", 0), ("paragraph", "text", None, None, None),
        ("equation", "a + b\n\nc", None, None, None), ("equation", "x^2", None, None, None), ("figure", '![alt](https://a.example/i.png "Title")', None, None, None), ("figure", "![only alt](i.png)", None, None, None), ("code", "```\n$$ no formula\n1. no item\n```", None, None, None),
        ("list_item", "5) five", 5, ")", 0), ("list_item", "6) six", 6, ")", 0), ("equation", "open", None, None, None),
    ]
    assert [(r["src"], r["caption"]) for r in got if r["type"] == "figure"] == [("https://a.example/i.png", "Title"), ("i.png", "only alt")]
    assert [(r["type"], r["text"]) for r in got if r["doc_id"] == 4] == [("paragraph", "a $$x$$ b"), ("equation", "y\nz"), ("paragraph", "plain")]
    assert not [r for r in got if r["doc_id"] in (2, 3)]
    paths = [(r["list"], r["path"]) for r in S.list_numbers(S.markdown_blocks(d)).filter("doc_id = 1").orderBy("ord").collect()]
    assert paths == [(1, [1]), (1, [1, 1]), (1, [1, 2]), (1, [1, 2, 3]), (1, [2]), (2, [5]), (2, [6])]


def display(lines):
    """The lines that are of a display formula, by a loop."""
    out, inside = [], False
    for i, x in enumerate(lines):
        t = x.strip()
        if inside:
            out.append(i)
            inside = not t.endswith("$$")
        elif t.startswith("$$"):
            out.append(i)
            inside = not t[2:].endswith("$$")
    return out


def test_display_formulas_on_random_lines(spark):
    draw = random.Random(6)
    docs = [(i, "\n".join(draw.choice(["$$", "$$a", "b$$", "$$c$$", "d", "x $$ y", "$$$$"]) for _ in range(draw.randrange(1, 12)))) for i in range(300)]
    got = {}
    for r in S.markdown_blocks(spark.createDataFrame(docs, "doc_id int, text string")).collect():
        if r["type"] != "equation":
            got.setdefault(r["doc_id"], []).append((r["ord"], r["text"]))
    for i, text in docs:
        lines = text.split("\n")
        inside = set(display(lines))
        want = [x for j, x in enumerate(lines) if j not in inside]
        assert [x for _, t in sorted(got.get(i, [])) for x in t.split("\n")] == want, text
