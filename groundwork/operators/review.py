"""Pages, releases and translations under review: gates, lints, failures, receipts, equivalence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.columns import host
from groundwork.operators.latest import top_per


# Wordings and addresses of challenges, walls and logins, and the sizes up to which they count.
CHALLENGE_WORDS = r"(?i)captcha|verify (?:you are|that you are) human|checking your browser|access denied|just a moment|attention required|security check|请输入验证码"
CHALLENGE_HINT = r"(?i)challenges\.cloudflare\.com|google\.com/recaptcha|recaptcha\.net|hcaptcha\.com/1/api\.js|cf-chl-[a-z_-]+|__cf_chl_"
CHALLENGE_PARTS = r"""(?is)<script\b[^>]*\ssrc\s*=\s*["'][^"']*(?:challenges\.cloudflare\.com|recaptcha|hcaptcha\.com)|<iframe\b[^>]*\ssrc\s*=\s*["'][^"']*(?:recaptcha|hcaptcha\.com)|\sid\s*=\s*["']?cf-chl-|<form\b[^>]*\saction\s*=\s*["'][^"']*challenge|__cf_chl_"""
CHALLENGE_TITLE = r"(?i)^(?:just a moment(?:\.{1,3})?|attention required!?|access denied!?|verify (?:you are|that you are) human!?|security check|captcha)$"
WALL = r"(?i)subscribe to continue|sign in to continue|log in to continue|订阅后继续|登录后查看全文"
LOGIN_PATH = r"(?i)^[a-z]+://[^/?#]+[^?#]*/(?:login|signin)(?:[/?#]|$)"
PROMPT_CHARS, ARTICLE_CHARS, WALL_CHARS = 1500, 500, 5000


def flag_unusable_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, visible, article, blocks, html and, if there are, title and url) with the reason
    why one cannot be read. A challenge is told by what it is built of, by its title, or by a wording in
    a short page; only pages whose markup has such a wording or address at all are looked at."""
    said = lambda c: F.coalesce(F.col(c), F.lit("")) if c in pages.columns else F.lit("")
    v, a, html = F.length(said("visible")), F.length(said("article")), said("html")
    words = F.concat_ws(" ", said("title"), said("visible"))
    hinted = html.rlike(CHALLENGE_WORDS) | html.rlike(CHALLENGE_HINT) | words.rlike(CHALLENGE_WORDS)
    short = words.rlike(CHALLENGE_WORDS) & (v < PROMPT_CHARS) & (a < ARTICLE_CHARS)
    challenge = hinted & (html.rlike(CHALLENGE_PARTS) | F.trim(said("title")).rlike(CHALLENGE_TITLE) | short)
    wall = said("visible").rlike(WALL) & (v < WALL_CHARS)
    login = said("url").rlike(LOGIN_PATH) & (v < WALL_CHARS)
    shell = (a < ARTICLE_CHARS) & (F.coalesce("blocks", F.lit(0)) < 3) & html.rlike(r"""(?i)id=["'](?:root|app|__next)["']""")
    return pages.withColumn("reason", F.when(v == 0, "empty").when(challenge, "challenge").when(wall, "login-wall").when(login, "login-page").when(shell, "client-shell"))


# fixed values: captions that claim rights of others
FOREIGN_RIGHTS = r"(?i)third.party|courtesy|reproduced|used with permission|all rights reserved|copyright|©|转载|经许可"


def eligible_figures(figures: DataFrame, most: int = 3, issue: str | None = None) -> DataFrame:
    """Figures (doc_id, ord, url, caption) with a caption that claims no rights of others and a web
    address: the first ``most`` of a document and, where ``issue`` is a column, of an issue."""
    caption = F.trim(F.coalesce("caption", F.lit("")))
    ok = figures.filter((caption != "") & F.col("url").rlike("^https?:") & ~caption.rlike(FOREIGN_RIGHTS))
    own = top_per(ok, ["doc_id"], [F.col("ord")], most)
    return own if issue is None else top_per(own, [issue], [F.col("doc_id"), F.col("ord")], most)


def drop_retracted(documents: DataFrame, corrections: DataFrame) -> DataFrame:
    bad = corrections.filter(F.exists("update_types", lambda x: F.lower(x).rlike("retract|withdraw"))).select(F.lower("doi").alias("_doi")).distinct()
    return documents.join(bad, F.lower(documents["doi"]) == bad["_doi"], "left_anti")


# fixed values: private and reserved IPv4 ranges
PRIVATE = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")


def ipv4(text: Column) -> Column:
    """An IPv4 literal as a number; null for anything else."""
    p = F.split(text, r"\.")
    n = sum((p[i].try_cast("long") * (1 << (8 * (3 - i))) for i in range(1, 4)), p[0].try_cast("long") * (1 << 24))
    return F.when(text.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"), n)


def flag_private_hosts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Whether the host is local or a literal in a private range: the ranges are a fixed list of
    comparisons, so no join takes place."""
    h = host(F.col(url))
    n, inside = ipv4(h), F.lit(False)
    for block in PRIVATE:
        base, bits = block.split("/")
        low = sum(int(x) << (8 * (3 - i)) for i, x in enumerate(base.split(".")))
        inside = inside | n.between(low, low + (1 << (32 - int(bits))) - 1)
    local = (h == "localhost") | h.endswith(".local") | h.endswith(".localhost") | (h == "") | F.col(url).rlike(r"^[a-z]+://[^/]*@") | ~F.lower(url).rlike("^https?://")
    return urls.withColumn("private", F.coalesce(local | F.coalesce(inside, F.lit(False)), F.lit(True)))


# fixed values: marks of unfinished output
RESIDUE = (
    ("placeholder", r"SL_INLINE_\d"), ("object", r"\[object Object\]"), ("path", r"/(?:Users|home|private|var)/"), ("control", r"[\x00-\x08\x0B\x0C\x0E-\x1F]"),
    ("tex", r"\\[a-zA-Z]{2,}"),
)


def lint_output_residue(articles: DataFrame, id_: str = "article_id", text: str = "text") -> DataFrame:
    """(id, rule, n, hit): marks of unfinished output in articles, with their number and the first of
    them; code between backticks or fences may have them."""
    prose = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?s)```.*?(?:```|$)", " "), r"`[^`\n]*`", " ")
    a = articles.select(id_, prose.alias("_t"))
    hits = F.array(*[F.struct(F.lit(n).alias("rule"), F.regexp_count("_t", F.lit(p)).cast("long").alias("n"), F.regexp_extract("_t", p, 0).alias("hit")) for n, p in RESIDUE])
    return a.select(id_, F.explode(F.filter(hits, lambda h: h["n"] > 0)).alias("h")).select(id_, "h.*")


def classify_failures(runs: DataFrame) -> DataFrame:
    """runs (code, profile, remote) with status and retryable."""
    code = F.coalesce("code", F.lit(""))
    passing = code.rlike("^(?:ECONNRESET|ENOTFOUND|EAI_AGAIN|HTTP_5\\d\\d|HTTP_429|NETWORK)$")
    person = code.rlike("^(?:AUTH|QUOTA|HTTP_401|HTTP_403)")
    status = F.when(person, "needs_input").when(F.col("remote"), "needs_review").otherwise("failed")
    retry = ~person & ~F.col("remote") & (passing | ((code == "TIMEOUT") & (F.col("profile") == "daily")))
    return runs.withColumn("status", status).withColumn("retryable", retry)


def reconcile_receipts(operations: DataFrame, before: DataFrame, observed: DataFrame) -> DataFrame:
    """operations (op_id, identity) with the draft (draft_id, identity) that appeared since ``before``
    (draft_id) if exactly one has that identity, else needs_review."""
    fresh = observed.join(before.select("draft_id"), "draft_id", "left_anti")
    met = operations.join(fresh, "identity", "left").groupBy("op_id").agg(F.count("draft_id").alias("n"), F.min("draft_id").alias("draft_id"))
    one = F.col("n") == 1
    return met.select("op_id", F.when(one, "resolved").otherwise("needs_review").alias("status"), F.when(one, F.col("draft_id")).alias("draft_id"))


#: Fixed values, in milliseconds: how old a notice may be whose receipt is looked for, how long before and
#: after it began its message may stand, and how far ahead of now.
RECEIPT_AGE, EARLY, LATE, AHEAD = 48 * 3_600_000, 60_000, 600_000, 60_000


def reconcile_notices(operations: DataFrame, messages: DataFrame, now: int, user: str, bot: str, channel: str, mark: str = r"\[[^\[\]\s]+\]") -> DataFrame:
    """(op_id, state, ts) of notices (op_id, channel, marker, started_ms) whose sending is uncertain, by
    messages (channel, ts, sent_ms, thread_ts, user, bot_id, text). A receipt is a root message of the
    bot in the notice's window that bears its marker. One receipt is ``sent``; none is ``pending`` as
    long as the window is open; else, and for old notices or another channel, ``needs_review``.

    ``mark`` matches markers. Messages meet notices by channel, marker and stretch of time as long as a
    window, of which a window meets two; a marker that many messages bear meets those of its window
    only."""
    width = EARLY + LATE
    to = F.least(F.lit(now + AHEAD), F.col("started_ms") + LATE)
    fine = F.coalesce((F.col("started_ms") >= now - RECEIPT_AGE) & (F.col("channel") == channel), F.lit(False))
    o = operations.withColumn("_from", F.col("started_ms") - EARLY).withColumn("_to", to)
    near = o.filter(fine & (F.col("_from") <= F.col("_to"))).select("op_id", "channel", "marker", "_from", "_to", F.explode(F.expr(f"sequence(_from div {width}, _to div {width})")).alias("_bin"))
    roots = messages.filter((F.col("user") == user) & (F.col("bot_id") == bot) & (F.col("thread_ts").isNull() | (F.col("thread_ts") == F.col("ts"))))
    said = roots.select("channel", "ts", "sent_ms", F.expr(f"sent_ms div {width}").alias("_bin"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({mark})"), F.lit(1)))).alias("marker"))
    met = near.join(said, ["channel", "marker", "_bin"]).filter(F.col("sent_ms").between(F.col("_from"), F.col("_to")))
    found = met.groupBy("op_id").agg(F.countDistinct("ts").alias("_n"), F.min("ts").alias("_ts"))
    n = F.coalesce("_n", F.lit(0))
    state = F.when(fine & (n == 1), "sent").when(fine & (n == 0) & (F.lit(now) < F.col("started_ms") + LATE), "pending").otherwise("needs_review")
    return o.join(found, "op_id", "left").select("op_id", state.alias("state"), F.when(state == "sent", F.col("_ts")).alias("ts"))


def route_notices(notices: DataFrame, aliases: DataFrame) -> DataFrame:
    """Channel and root of each notice: by alias, else by its thread key ``channel:ts``."""
    a = aliases.select("thread_key", F.col("channel").alias("_c"), F.col("root").alias("_r"))
    part = lambda i: F.nullif(F.regexp_extract("thread_key", r"^([^:]+):(.+)$", i), F.lit(""))
    return notices.join(a, "thread_key", "left").withColumn("channel", F.coalesce("_c", part(1))).withColumn("root", F.coalesce("_r", part(2))).drop("_c", "_r")


def inherit_evidence(runs: DataFrame, cards: DataFrame) -> DataFrame:
    """(run_id, card_id): cards of a run's parent with the same thread, profile and context."""
    p = runs.select(F.col("id").alias("parent_id"), "thread_key", "profile", "context_hash")
    kin = runs.select(F.col("id").alias("run_id"), "parent_id", "thread_key", "profile", "context_hash").join(p, ["parent_id", "thread_key", "profile", "context_hash"])
    return kin.join(cards.select(F.col("run_id").alias("parent_id"), "card_id"), "parent_id").select("run_id", "card_id")


EXACT = r"(https?://[^\s)\]]+|\\[A-Za-z]+|⟦[^⟧]+⟧|(?<![A-Za-z0-9])[A-Z]{2,}(?:-[A-Z0-9]+)*\d*(?![A-Za-z0-9]))"


def exact_tokens(text: Column) -> Column:
    """Tokens that a translation must keep: links, TeX commands, placeholders, names in capitals."""
    return F.regexp_extract_all(text, F.lit(EXACT), F.lit(1))


# fixed values: magnitudes of amounts
MAGNITUDES = {"k": 3, "thousand": 3, "m": 6, "million": 6, "b": 9, "bn": 9, "billion": 9, "t": 12, "trillion": 12, "万": 4, "十万": 5, "百万": 6, "千万": 7, "亿": 8, "十亿": 9, "百亿": 10, "千亿": 11, "万亿": 12}
_AMOUNT = r"[-+]?\d+(?:[,.]\d+)*"
_AMOUNTS = (
    rf"(?i)(?<![A-Za-z0-9.,])({_AMOUNT})(?:\s*(%|‰)|\s*(percent|per\s+cent)(?![A-Za-z])|\s*(bn|[kmbt])(?![A-Za-z0-9])|(?:\s*[-‐‑]\s*|\s*)(thousand|million|billion|trillion)(?![A-Za-z])|\s*(万亿|千亿|百亿|十亿|千万|百万|十万|亿|万))?"
)
#: Chinese numerals of the ordinal and the plain form, up to ninety-nine.
_HAN = "零一二三四五六七八九"
_HAN_NUMBER = rf"(?:第)([一二三四五六七八九]?十[一二三四五六七八九]?|[{_HAN}])(?=[级期步章节条个届位次])"


def _han(x: Column) -> Column:
    """A Chinese numeral of up to ninety-nine as a number."""
    digit = lambda c: F.instr(F.lit(_HAN), c) - 1
    tens, ones = F.regexp_extract(x, "^(.?)十", 1), F.regexp_extract(x, "十(.)$", 1)
    ten = F.when(tens == "", 1).otherwise(digit(tens)) * 10 + F.when(ones == "", 0).otherwise(digit(ones))
    return F.when(x.contains("十"), ten).otherwise(digit(x)).cast("string")


def amounts(text: Column) -> Column:
    """The amounts of a text as tokens ``NUM:n``, ``PCT:n`` or ``PERMILLE:n``: signs kept, thousands
    separators and trailing zeros dropped, magnitudes in words or letters multiplied out."""
    t = F.replace(F.replace(text, F.lit("−"), F.lit("-")), F.lit("**"), F.lit(""))
    parts = F.regexp_extract_all(t, F.lit(_AMOUNTS), F.lit(0))
    unit = lambda x: F.lower(F.regexp_extract(x, rf"(?i)^{_AMOUNT}[\s‐‑-]*(.*)$", 1))
    power = F.create_map(*[F.lit(x) for w, n in MAGNITUDES.items() for x in (w, 10**n)])

    def one(x: Column) -> Column:
        kind = F.when(unit(x).rlike("^(?:%|percent|per\\s+cent)$"), "PCT:").when(unit(x) == "‰", "PERMILLE:").otherwise("NUM:")
        bare = F.regexp_replace(F.regexp_extract(x, f"^({_AMOUNT})", 1), ",|^\\+", "")
        times = F.coalesce(F.element_at(power, unit(x)), F.lit(1))
        value = (bare.try_cast("decimal(24,6)") * times.cast("decimal(13,0)")).cast("decimal(38,6)").cast("string")
        return F.concat(kind, F.coalesce(F.regexp_replace(F.regexp_replace(value, r"0+$", ""), r"\.$", ""), bare))

    ordinals = F.transform(F.regexp_extract_all(t, F.lit(_HAN_NUMBER), F.lit(1)), lambda x: F.concat(F.lit("NUM:"), _han(x)))
    return F.concat(F.transform(parts, one), ordinals)


_WORDED = r"(?i)(?<![A-Za-z])(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|dozens?|hundreds?|thousands?|millions?|billions?|trillions?|percent|half|halves|third|quarters?|twice|double|triple)(?![A-Za-z])"


def translation_equivalence(units: DataFrame) -> DataFrame:
    """unit_id, kind, token, n_source, n_target, severity of exact tokens and amounts that source and
    target of a unit (unit_id, source, target) have not equally often. What the target lacks is an
    error; an amount that it has more often is a warning where the source has number words and no
    amount is lacking, else an error. Tokens and amounts are counted within the unit's row."""
    def side(c: str) -> Column:
        exact = F.transform(exact_tokens(F.col(c)), lambda x: F.struct(F.lit("exact").alias("kind"), x.alias("token")))
        return F.concat(exact, F.transform(amounts(F.regexp_replace(c, EXACT, " ")), lambda x: F.struct(F.lit("number").alias("kind"), x.alias("token"))))

    u = units.select("unit_id", side("source").alias("s"), side("target").alias("t"), F.col("source").rlike(_WORDED).alias("worded"))
    how_many = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    counted = F.transform(F.array_union("s", "t"), lambda x: F.struct(x["kind"].alias("kind"), x["token"].alias("token"), how_many(F.col("s"), x).alias("n_source"), how_many(F.col("t"), x).alias("n_target")))
    gaps = u.select("unit_id", "worded", F.filter(counted, lambda x: x["n_source"] != x["n_target"]).alias("g"))
    lacking = F.exists("g", lambda x: (x["kind"] == "number") & (x["n_target"] < x["n_source"]))
    rows = gaps.withColumn("_lacks", lacking).select("unit_id", "worded", "_lacks", F.explode("g").alias("g"))
    mild = (F.col("g.kind") == "number") & (F.col("g.n_target") > F.col("g.n_source")) & F.col("worded") & ~F.col("_lacks")
    return rows.select("unit_id", "g.*", F.when(mild, "warning").otherwise("error").alias("severity"))


def untranslated_units(units: DataFrame) -> DataFrame:
    """Units whose source has 40 Latin letters or more and is no list of names, and whose target is
    still Latin (10 words or more, fewer than 4 Han characters)."""
    letters, words = F.regexp_count("source", F.lit("[A-Za-z]")), F.regexp_count("source", F.lit("[A-Za-z]+"))
    names = F.regexp_count("source", F.lit(r"(?<![A-Za-z])[A-Z][A-Za-z]*")) >= 0.7 * words
    return units.filter((letters >= 40) & ~names & (F.regexp_count("target", F.lit("[A-Za-z]+")) >= 10) & (F.regexp_count("target", F.lit(r"\p{IsHan}")) < 4))


def assess_units(violations: DataFrame) -> DataFrame:
    """unit_id, errors, warnings."""
    return violations.groupBy("unit_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def asset_budget(assets: DataFrame, most: int = 80, each: int = 10 << 20, total: int = 40 << 20) -> DataFrame:
    """article_id, n, bytes (each content once), largest, fits."""
    one = assets.groupBy("article_id", "sha256").agg(F.max("size").alias("size"), F.count("*").alias("k"))
    by = one.groupBy("article_id").agg(F.sum("k").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    return by.withColumn("fits", (F.col("n") <= most) & (F.col("largest") <= each) & (F.col("bytes") <= total))


def page_coverage(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, missing: pages (doc_id, page) that a document (doc_id, page_count) should have."""
    want = expected.select("doc_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page"))
    return want.join(pages.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_list("page")).alias("missing"))


def extraction_coverage(expected: DataFrame, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, rules, score, accepted): whether the extraction of a document is whole.

    expected and found (doc_id, page) are its pages, sizes (doc_id, parsed, extracted, layer, images,
    referenced) characters without white space of the parser's text, of the blocks and of the text
    layer, and images. Pages must be the same; blocks hold half of a parser's text of 1,000 characters
    or more; where the layer has 200 characters a page, the parser holds 35 and blocks 25 percent of
    it; images are referenced. The score, from 0 to 5, loses one for each rule; 3 are accepted."""
    per = lambda d, name: d.groupBy("doc_id").agg(F.count_distinct("page").alias(name), F.bit_xor(F.xxhash64("page")).alias(f"{name}_set"))
    # distinct rows first: a repeated page would cancel itself out
    both = per(expected.select("doc_id", "page").distinct(), "wanted").join(per(found.select("doc_id", "page").distinct(), "got"), "doc_id", "left").join(sizes, "doc_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rich = n("layer") >= 200 * F.col("wanted")
    rules = F.array_compact(F.array(
        F.when((n("got") != F.col("wanted")) | (n("got_set") != F.col("wanted_set")), F.lit("pages")), F.when((n("parsed") >= 1000) & (n("extracted") < 0.5 * n("parsed")), F.lit("blocks-of-parser")),
        F.when(rich & (n("parsed") < 0.35 * n("layer")), F.lit("parser-of-layer")), F.when(rich & (n("extracted") < 0.25 * n("layer")), F.lit("blocks-of-layer")), F.when(n("referenced") < n("images"), F.lit("images")),
    ))
    return both.select("doc_id", rules.alias("rules")).withColumn("score", 5 - F.size("rules")).withColumn("accepted", F.col("score") >= 3)


BLOCK_TYPES = ("heading", "paragraph", "list_item", "quote", "code", "table", "figure", "equation", "reference")


def document_completeness(documents: DataFrame, blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc_id, reason): null where a document's blocks (type, text) are there, of known types, and an
    HTML document has 120 characters of text or something to look at."""
    by = blocks.groupBy(doc).agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("type").isin(*BLOCK_TYPES), F.lit(False))).alias("unknown"), F.count_if(F.col("type").isin("figure", "table", "equation")).alias("visual"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("size"),
    )
    reason = F.when(F.col("n").isNull(), "empty").when(F.col("unknown") > 0, "unknown-type").when((F.col("kind") == "html") & (F.col("size") < 120) & (F.col("visual") == 0), "too-short")
    return documents.select(doc, "kind").join(by, doc, "left").select(doc, reason.alias("reason"))


def repair_targets(errors: DataFrame, items: DataFrame) -> DataFrame:
    """Items (draft_id, item) to rewrite: errors (draft_id, scope) of an item hit it, one without a
    scope hits all items of its draft, one of the header none."""
    e = errors.withColumn("item", F.regexp_extract("scope", r"^item (\d+)$", 1).try_cast("int")).withColumn("all", F.coalesce("scope", F.lit("")) == "")
    whole = e.filter("all").select("draft_id").distinct()
    return items.join(e.filter("item is not null").select("draft_id", "item").distinct(), ["draft_id", "item"], "left_semi").unionByName(items.join(whole, "draft_id", "left_semi")).distinct()
