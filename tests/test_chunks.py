import random
import re

from groundwork.operators import threads as H


def made(draw):
    word = lambda: draw.choice(["word", "x", "[a label of it](⟦001⟧)", "[l](https://a.example/b?c=d)", "⟦002⟧", "$x + y$", "$$a\nb$$", "\n", "long" * 9, "[no](link (here))", "5$"])
    return " ".join(word() for _ in range(draw.randrange(60)))


def test_no_protected_span_is_cut():
    draw = random.Random(8)
    for _ in range(2000):
        text, limit = made(draw), draw.choice([5, 20, 40, 100])
        spans = [m.span() for m in re.finditer(H.PROTECTED, text)]
        parts = H._cuts(text, limit, spans)
        assert "".join(parts) == text and (all(parts) or parts == [""])
        ends, at = set(), 0
        for p in parts:
            at += len(p)
            ends.add(at)
        assert not any(a < e < b for a, b in spans for e in ends)
        longest = max([b - a for a, b in spans], default=0)
        assert max(map(len, parts)) <= max(limit, longest)


def test_plain_text_is_cut_as_before(spark):
    d = spark.createDataFrame([(1, "aa bb cc dd " * 30), (2, None), (3, "x" * 95), (4, "see [the long label](https://a.example/page) end")], "doc int, text string")
    got = {}
    for r in H.chunk_text(d, ["doc"], 20, protected=H.PROTECTED).orderBy("doc", "n").collect():
        got.setdefault(r["doc"], []).append(r["part"])
    assert got[2] == [""] and got[3] == ["x" * 20] * 4 + ["x" * 15] and got[4] == ["see ", "[the long label](https://a.example/page)", " end"]
    assert all(len(p) <= 20 for p in got[1]) and "".join(got[1]) == "aa bb cc dd " * 30
