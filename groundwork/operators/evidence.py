"""Evidence: quotes, grounding, citations, numbers, style."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundwork.functions.columns import collapsed, numeric_tokens
from groundwork.plans.lineage import checkpointed


def _run(hashes: str, at: Column | int, k: int) -> Column:
    """The hash of k words in a row from place ``at`` on, from the hashes of the words."""
    return F.xxhash64(*[F.get(F.col(hashes), (F.lit(at) if isinstance(at, int) else at) + i) for i in range(k)])


def _made(**cols: Column) -> Column:
    """The columns, computed once: they leave through a generator, so that no later expression has
    them evaluated again at each of its steps."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))


def _grams(word: str, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substring(F.col(word), i, F.lit(n)))


def find_quotes(passages: DataFrame, docs: DataFrame, k: int = 5, gram: int = 4) -> DataFrame:
    """(item_id, doc_id): documents that contain a passage, modulo white space.

    A document with the passage has all of its interior words in a row (the first and the last may
    be parts of words), so one interior run of k words, by its hash, finds every candidate;
    ``contains`` decides. Hashes meet in a join, which Spark does where the documents are read as
    long as the passages' hashes are small, and by a shuffle of hashes beyond that; texts meet
    passages only as candidates. A passage of fewer than k + 2 words has no such run: the first
    ``gram`` characters of its longest word stand in one of the document's distinct words.
    """
    p = passages.select("item_id", collapsed(F.col("text")).alias("quote")).filter(F.length("quote") >= 8)
    p = p.withColumn("ws", F.split("quote", " "))
    long_ = p.filter(F.size("ws") >= k + 2).select("item_id", _made(hs=F.transform("ws", lambda w: F.xxhash64(w)))).select("item_id", _run("hs", 1, k).alias("h"))
    longest = F.array_max(F.transform("ws", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    short = p.filter(F.size("ws") < k + 2).select("item_id", F.left(longest, F.lit(gram)).alias("h"))
    d = docs.select("doc_id", collapsed(F.col("text")).alias("body"))
    worded = d.select("doc_id", F.split("body", " ").alias("ws"))
    hashed = worded.select("doc_id", _made(hs=F.transform("ws", lambda w: F.xxhash64(w)))).filter(F.size("hs") >= k)
    runs = F.transform(F.sequence(F.lit(0), F.size("hs") - k), lambda i: _run("hs", i, k))
    found = _candidates(hashed.select("doc_id", F.explode(runs).alias("h")), long_)
    sizes = [r["n"] for r in short.select(F.length("h").alias("n")).distinct().collect()]  # at most ``gram`` numbers
    if sizes:
        word = worded.select("doc_id", F.explode(F.array_distinct("ws")).alias("w"))
        grams = F.concat(*[_grams("w", n) for n in sorted(sizes)])
        found = found.unionByName(_candidates(word.select("doc_id", F.explode(grams).alias("h")), short))
    both = found.join(p.select("item_id", "quote"), "item_id").join(d, "doc_id")
    return both.filter(F.col("body").contains(F.col("quote"))).select("item_id", "doc_id").distinct()


def _candidates(each: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, item_id) where a document has a passage's key."""
    return each.join(wanted, "h").select("doc_id", "item_id").distinct()


def ground_quotes(claims: DataFrame, locators: DataFrame) -> DataFrame:
    """Claims (card_id, claim_idx, locator_id, quote, text) with code: null where the quote stands in
    its locator and the quote has all numbers of the claim."""
    both = claims.join(locators.select("card_id", "locator_id", F.col("text").alias("_source")), ["card_id", "locator_id"], "left")
    quote = collapsed(F.col("quote"))
    found = (F.length(quote) >= 8) & collapsed(F.col("_source")).contains(quote)
    lacking = F.size(F.array_except(numeric_tokens(F.col("text")), numeric_tokens(F.col("quote")))) > 0
    return both.withColumn("code", F.when(~F.coalesce(found, F.lit(False)), "QUOTE_NOT_FOUND").when(lacking, "NUMERIC_MISMATCH")).drop("_source")


def grounding_report(grounded: DataFrame) -> DataFrame:
    return grounded.groupBy(F.coalesce("code", F.lit("ACCEPTED")).alias("code")).agg(F.count("*").alias("n"))


def gate_evidence_cards(grounded: DataFrame, claims: int = 3, locators: int = 2, most: int = 15) -> DataFrame:
    """(card_id, verified, locators, proposed, accepted, partial): a card is accepted with enough verified
    claims from enough locators, of at most ``most`` that were proposed."""
    ok = F.col("code").isNull()
    by = grounded.groupBy("card_id").agg(F.count_if(ok).alias("verified"), F.countDistinct(F.when(ok, F.col("locator_id"))).alias("locators"), F.count("*").alias("proposed"))
    accepted = (F.col("verified") >= claims) & (F.col("locators") >= locators) & (F.col("proposed") <= most)
    return by.withColumn("accepted", accepted).withColumn("partial", F.col("accepted") & (F.col("verified") < F.col("proposed")))


def rejected_claims(grounded: DataFrame) -> DataFrame:
    """(card_id, claim_idx, code) of the claims that were not verified."""
    return grounded.filter("code is not null").select("card_id", "claim_idx", "code")


def ungrounded_numbers(claims: DataFrame, sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, token: numbers of ``claims`` (keys, text) that no row of ``sources`` (keys, text) has."""
    tokens = lambda d: d.select(*keys, F.explode(numeric_tokens(F.col("text"))).alias("token")).distinct()
    return tokens(claims).join(tokens(sources), [*keys, "token"], "left_anti")


def _token_keys(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (tokens, sorted and distinct) for each token a, with b empty, and for each pair a < b of
    those with ``most`` tokens or fewer."""
    each = rows.select("*", F.posexplode("tokens").alias("_at", "a"))
    after = F.when(F.size("tokens") <= most, F.slice("tokens", F.col("_at") + 2, F.size("tokens"))).otherwise(F.array().cast("array<string>"))
    return each.select("*", F.explode(F.concat(F.array(F.lit("")), after)).alias("b")).drop("_at")


def _best_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], top: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= top).drop("_n")


def _gap_index(excerpts: DataFrame, top: int, most: int) -> DataFrame:
    """(kind, a, b, excerpt_id, size): what sentences look up. Of excerpts with the same numbers the
    first ``top`` by size and id are as good as all. Kind 0: of the excerpts with a number, the first
    ``top`` and those of more than ``most`` numbers; 1: the others with a pair; 2: all with a number."""
    held = excerpts.select("excerpt_id", F.length("quote").alias("size"), F.explode(numeric_tokens(F.col("quote"))).alias("token"))
    sets = held.groupBy("excerpt_id").agg(F.min("size").alias("size"), F.array_sort(F.collect_set("token")).alias("tokens"))
    keyed = _token_keys(_best_by(sets, ["tokens"], ["size", "excerpt_id"], top), most)
    single, long_ = F.col("b") == "", F.size("tokens") > most
    parts = (keyed.filter(single & long_), 0), (_best_by(keyed.filter(single & ~long_), ["a"], ["size", "excerpt_id"], top), 0), (keyed.filter(~single), 1), (keyed.filter(single), 2)
    return functools.reduce(DataFrame.unionByName, [d.select(F.lit(kind).alias("kind"), "a", "b", "excerpt_id", "size") for d, kind in parts])


def numeric_gap_candidates(missing: DataFrame, excerpts: DataFrame, top: int = 2, most: int = 24, broadcast_rows: int = 300_000) -> DataFrame:
    """For the missing tokens of each sentence (sent_id, token) the best excerpts (excerpt_id, of one
    excerpt, and quote): more covered numbers, then shorter, then the smaller id.

    An excerpt that covers one number of a sentence can be among its best only if it is among the best
    of that number; one that covers c has c * (c - 1) / 2 of its pairs. So sentences look up the best
    excerpts of their numbers and all of their pairs, and not every excerpt of each number. Sentences
    and excerpts of more than ``most`` numbers meet by single numbers. An index of up to ``broadcast_rows`` rows
    goes to all executors.
    """
    index = checkpointed(_gap_index(excerpts, top, most))
    index = F.broadcast(index) if index.count() <= broadcast_rows else index
    sentences = missing.groupBy("sent_id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    kind = F.when(F.size("tokens") > most, 2).when(F.col("b") == "", 0).otherwise(1)
    met = _token_keys(sentences, most).select("sent_id", kind.alias("kind"), "a", "b").join(index, ["kind", "a", "b"])
    by = met.groupBy("sent_id", "excerpt_id").agg(F.min("size").alias("size"), F.count_if(F.col("kind") != 1).alias("ones"), F.count_if(F.col("kind") == 1).alias("pairs"))
    covered = F.greatest("ones", F.round((1 + F.sqrt(1 + 8 * F.col("pairs"))) / 2).cast("long"))
    by = by.select("sent_id", "excerpt_id", "size", covered.alias("covered"))
    rank = F.row_number().over(W.partitionBy("sent_id").orderBy(F.col("covered").desc(), "size", "excerpt_id"))
    return by.withColumn("rank", rank).filter(F.col("rank") <= top).select("sent_id", "rank", "excerpt_id", "covered")


def gaps_nowhere(missing: DataFrame, excerpts: DataFrame) -> DataFrame:
    """(sent_id, token): missing tokens that no excerpt has."""
    held = excerpts.select(F.explode(numeric_tokens(F.col("quote"))).alias("token")).distinct()
    return missing.select("sent_id", "token").distinct().join(held, "token", "left_anti").select("sent_id", "token")


def resolve_excerpt_refs(refs: DataFrame, excerpts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References (claim_id, card_id, excerpt_id) with their quotes, each once, and those that name
    none of their card's excerpts (card_id, excerpt_id, quote), with its first and last id, in order
    of their numbers, as the range that would do."""
    one = refs.dropDuplicates(["claim_id", "card_id", "excerpt_id"])
    n = F.regexp_extract("excerpt_id", r"(\d+)$", 1).try_cast("long")
    span = excerpts.groupBy("card_id").agg(F.min_by("excerpt_id", n).alias("first_id"), F.max_by("excerpt_id", n).alias("last_id"))
    lost = one.join(excerpts.select("card_id", "excerpt_id").distinct(), ["card_id", "excerpt_id"], "left_anti").join(span, "card_id", "left")
    return one.join(excerpts.select("card_id", "excerpt_id", "quote"), ["card_id", "excerpt_id"]), lost


SENTENCE_END = r"(?<=[。！？!?;；])|\n"


def unmapped_sentences(bodies: DataFrame, claims: DataFrame) -> DataFrame:
    """(body_id, n, sentence): sentences of bodies (body_id, text) with numbers that no claim
    (body_id, sentence) has."""
    parts = F.transform(F.split("text", SENTENCE_END), lambda x: F.trim(x))
    rows = bodies.select("body_id", F.posexplode(parts).alias("n", "sentence")).filter((F.col("sentence") != "") & (F.size(numeric_tokens(F.col("sentence"))) > 0))
    said = claims.select("body_id", F.trim("sentence").alias("sentence")).distinct()
    return rows.join(said, ["body_id", "sentence"], "left_anti").select("body_id", "n", "sentence")


def nearest_sentences(bodies: DataFrame, claims: DataFrame, least: int = 4) -> DataFrame:
    """(body_id, sentence, nearest, shared): for claims' sentences that do not stand in their body, the
    body's sentence with the longest common beginning, of ``least`` characters or more. Beginnings of
    ``least`` characters meet in a join; the first of equals stays."""
    lost = claims.select("body_id", F.trim("sentence").alias("sentence")).distinct().join(bodies, "body_id").filter(~F.col("text").contains(F.col("sentence")) & (F.length("sentence") >= least)).select("body_id", "sentence", F.left("sentence", F.lit(least)).alias("_k"))
    parts = F.transform(F.split("text", SENTENCE_END), lambda x: F.trim(x))
    own = bodies.select("body_id", F.posexplode(parts).alias("n", "nearest")).filter(F.length("nearest") >= least).withColumn("_k", F.left("nearest", F.lit(least)))
    both = lost.join(own, ["body_id", "_k"])
    size = F.least(F.length("sentence"), F.length("nearest"))
    shared = F.coalesce(F.array_position(F.zip_with(F.split(F.left("sentence", size), ""), F.split(F.left("nearest", size), ""), lambda a, b: a == b), False), F.lit(0))
    both = both.withColumn("shared", F.when(shared == 0, size).otherwise(shared - 1).cast("int"))
    best = F.row_number().over(W.partitionBy("body_id", "sentence").orderBy(F.col("shared").desc(), "n"))
    return both.withColumn("_r", best).filter("_r = 1").select("body_id", "sentence", "nearest", "shared")


def trim_refs(tokens: DataFrame, refs: DataFrame, most: int = 6) -> DataFrame:
    """``refs`` (claim_id, ord) cut to ``most``: those that first cover a token of the sentence
    (``tokens``: claim_id, ord, token) stay, the rest fills up in order."""
    first = tokens.groupBy("claim_id", "token").agg(F.min("ord").alias("ord")).select("claim_id", "ord", F.lit(1).alias("_cover")).distinct()
    marked = refs.join(first, ["claim_id", "ord"], "left").withColumn("_cover", F.coalesce("_cover", F.lit(0)))
    rank = F.row_number().over(W.partitionBy("claim_id").orderBy(F.col("_cover").desc(), "ord"))
    return marked.withColumn("_rank", rank).filter((F.col("_rank") <= most) | (F.col("_cover") == 1)).drop("_rank", "_cover")


#: Marks of citations: in square or corner brackets but not as a link's label, and S with a number in round ones.
_CITED = r"(?:\[(S?\d+)\]|【(S?\d+)】)(?!\()|[（(]\s*(S\d+)\s*[）)]"
#: A number alone in round brackets: a mark where a stop stands before, or a mark or nothing after.
_BARE = r"(?<=[。！？.!?])\s*[（(]\s*(\d+)\s*[）)]|[（(]\s*(\d+)\s*[）)](?=\s*(?:[，。；、,.!?！？;:：]|$))"


def resolve_citations(bodies: DataFrame, sources: DataFrame, listed: DataFrame | None = None, article: str = "article_id") -> tuple[DataFrame, DataFrame]:
    """(body_id, source_id, number) by first use of the marks [S1], [1], 【1】, (S1) and, where the
    article has such a source and punctuation tells a mark, (1); and (body_id, source_id) of marks
    without a source. A body without a mark has the sources of ``listed`` (body_id, source_id, ord),
    else all of its article, in order. ``bodies`` (article_id, body_id, text) and ``sources``
    (article_id, source_id, ord) meet by article; frames without that column are of one article."""
    of = lambda d: F.col(article) if article in d.columns else F.lit(0)
    ids = lambda c, g: F.regexp_extract_all("text", F.lit(c), F.lit(g))
    b = bodies.select(of(bodies).alias("_article"), "body_id", "text")
    named = sources.select(of(sources).alias("_article"), "source_id", (F.col("ord") if "ord" in sources.columns else F.lit(0)).cast("long").alias("_ord")).distinct()
    found = F.concat(*[F.transform(ids(c, g), lambda x: F.struct(x.alias("n"), F.lit(sure).alias("sure"))) for c, gs, sure in ((_CITED, (1, 2, 3), True), (_BARE, (1, 2), False)) for g in gs])
    marks = b.select("_article", "body_id", "text", F.explode(F.filter(found, lambda x: x["n"] != "")).alias("m"))
    bare = F.regexp_replace("m.n", "^S", "")
    place = F.regexp_instr("text", F.concat(F.lit(r"[\[【（(]\s*S?"), bare, F.lit(r"\s*[\]】）)]")))
    used = marks.select("_article", "body_id", F.concat(F.lit("S"), bare).alias("source_id"), "m.sure", place.cast("long").alias("at"))
    used = used.groupBy("_article", "body_id", "source_id").agg(F.min("at").alias("at"), F.bool_or("sure").alias("sure"))
    known = used.join(named, ["_article", "source_id"]).select("body_id", "source_id", "at")
    lost = used.filter("sure").join(named, ["_article", "source_id"], "left_anti").select("body_id", "source_id")
    rest = b.select("_article", "body_id").join(known.select("body_id").distinct(), "body_id", "left_anti")
    every = known
    if listed is not None:
        own = rest.join(listed, "body_id").select("body_id", "source_id", F.col("ord").cast("long").alias("at"))
        every, rest = every.unionByName(own), rest.join(own.select("body_id").distinct(), "body_id", "left_anti")
    every = every.unionByName(rest.join(named, "_article").select("body_id", "source_id", F.col("_ord").alias("at")))
    number = F.row_number().over(W.partitionBy("body_id").orderBy("at", "source_id"))
    return every.select("body_id", "source_id", number.alias("number")), lost


def lint_style(texts: DataFrame, rules: Sequence[tuple[str, str]], id_: str, text: str) -> DataFrame:
    """id, rule, hit: the first match of each rule (name, pattern) that a text breaks."""
    hits = F.array(*[F.struct(F.lit(n).alias("rule"), F.regexp_extract(text, p, 0).alias("hit")) for n, p in rules])
    return texts.select(id_, F.explode(F.filter(hits, lambda h: h["hit"] != "")).alias("h")).select(id_, "h.rule", "h.hit")


def multiset_gaps(source: DataFrame, target: DataFrame, keys: Sequence[str], token: str = "token") -> DataFrame:
    """keys, token, n_source, n_target where the two sides have a token not equally often."""
    count = lambda d, name: d.groupBy(*keys, token).agg(F.count("*").alias(name))
    both = count(source, "n_source").join(count(target, "n_target"), [*keys, token], "full_outer").fillna(0, ["n_source", "n_target"])
    return both.filter("n_source <> n_target")
