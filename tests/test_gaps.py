import random
import re

import pytest

from groundwork.operators import evidence as E


def joined(plan):
    """Rows that the joins of a plan that has run have made."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return joined(plan.finalPhysicalPlan())
    below = [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if "Join" in name else 0
    return own + sum(map(joined, below))


def frames(spark, missing, excerpts):
    return spark.createDataFrame(missing, "sent_id long, token string"), spark.createDataFrame(excerpts, "excerpt_id long, quote string")


def test_a_common_number_does_not_bring_each_sentence_to_each_excerpt(spark):
    missing, excerpts = [(s, t) for s in range(200) for t in ("7", str(100 + s % 9))], [(x, f"7 of {100 + x % 9}.") for x in range(300)]
    found = E.numeric_gap_candidates(*frames(spark, missing, excerpts))
    got = sorted(tuple(r) for r in found.collect())
    assert got == [(s, i + 1, s % 9 + 9 * i, 2) for s in range(200) for i in (0, 1)]
    assert joined(found._jdf.queryExecution().executedPlan()) <= 200 * 2 * 3  # 2 for each of its keys; every pair: 60,000 and more


def best(missing, excerpts, top):
    held = [(x, len(q), set(re.findall(r"\d+", q))) for x, q in excerpts if q]
    out = []
    for s in {s for s, _ in missing}:
        lacks = {t for own, t in missing if own == s}
        order = sorted((-len(lacks & has), size, x) for x, size, has in held if lacks & has)[:top]
        out += [(s, i + 1, x, -n) for i, (n, _, x) in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize(("most", "rows"), [(24, 300_000), (3, 0), (0, 10)])
def test_gaps_by_pairs_and_by_single_numbers_are_those_of_all_pairs(spark, most, rows):
    draw = random.Random(most)
    excerpts = [(x, draw.choice([None, "no number", *["No " + " and ".join(str(draw.randrange(12)) for _ in range(draw.choice([1, 2, 3, 9]))) + "."] * 8])) for x in range(120)]
    missing = [(s, draw.choice([None, "", "99", *map(str, range(12))])) for s in range(30) for _ in range(draw.choice([1, 2, 5, 12]))]
    for top in (1, 3):
        got = E.numeric_gap_candidates(*frames(spark, missing, excerpts), top, most, rows).collect()
        assert sorted(tuple(r) for r in got) == best(missing, excerpts, top)
