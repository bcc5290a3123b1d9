"""Candidates: URLs, identity, time windows, scores, slots, entity resolution, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundwork.functions.columns import canonical_url, collapsed, day_or_instant, event_identity, host
from groundwork.operators.latest import top_per
from groundwork.plans.lineage import checkpointed


def canonicalize_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("canonical_url", canonical_url(F.col(url)))


def group_by_canonical(df: DataFrame, id_: str, url: str = "url") -> DataFrame:
    """canonical_url, n_pages, first_id: one row for each address."""
    return canonicalize_urls(df, url).filter("canonical_url is not null").groupBy("canonical_url").agg(F.count("*").alias("n_pages"), F.min(id_).alias("first_id"))


def normalize_candidates(raw: DataFrame) -> DataFrame:
    """Rows with a title and a public URL: title collapsed, canonical URL, bare DOI, identity."""
    out = raw.withColumn("title", collapsed(F.col("title"))).withColumn("url", canonical_url(F.col("url"))).filter("title <> '' and url is not null")
    out = out.withColumn("doi", F.regexp_replace(F.lower("doi"), r"^https?://(?:dx\.)?doi\.org/", ""))
    return out.withColumn("event_id", event_identity(F.col("url"), F.col("event_id"), F.col("doi")))


def normalize_dates(raw: DataFrame, now: Column, dates: Sequence[str] = ("published_at", "updated_at", "event_at")) -> DataFrame:
    """Candidates with dates (text) as instants, null where they are none; the event's date is the
    publication's where it has none, date_precision is its own, and first_seen_at, fetched_at are
    ``now`` where they are missing."""
    out = raw.withColumn("event_at", F.coalesce("event_at", "published_at"))
    parsed = {c: day_or_instant(F.col(c)) for c in dates}
    out = out.withColumns({**{c: x["at"] for c, x in parsed.items()}, "date_precision": parsed["event_at"]["precision"]})
    return out.withColumns({c: F.coalesce(F.col(c), now) if c in raw.columns else now for c in ("first_seen_at", "fetched_at")})


def temporal_status(at: Column, precision: Column, verified: Column, cutoff: Column, window: Column, supplement: Column) -> Column:
    """unverified, future, current, supplement or old. A day is the interval to its end, an instant
    a point; the future is tested on the start."""
    end = at + F.expr("interval 1 day")
    since = lambda bound: F.when(precision == "day", end > bound).otherwise(at >= bound)
    return F.when(at.isNull() | ~F.coalesce(verified, F.lit(False)), "unverified").when(at > cutoff, "future").when(since(window), "current").when(since(supplement), "supplement").otherwise("old")


def keep_in_window(df: DataFrame, read: bool = False) -> DataFrame:
    """Before reading all but old and future stay; after reading only current and supplement do."""
    return df.filter(F.col("status").isin("current", "supplement")) if read else df.filter(~F.col("status").isin("old", "future"))


# fixed values: weights of the score
STATUS_WEIGHT = {"current": 40, "supplement": 15, "unverified": 5}
FINANCE = (
    r"(?i)(?<![A-Za-z0-9_])(?:financ\w*|trading|invest\w*|portfolio|backtest\w*|econometric\w*|stocks?|bonds?|forex|cryptocurrenc\w*|securities)(?![A-Za-z0-9_])"
    r"|(?<![A-Za-z0-9_])(?:financial|stock|bond|capital|prediction|equity|commodity|crypto)\s+markets?(?![A-Za-z0-9_])"
    r"|(?<![A-Za-z0-9_])(?:asset\s+(?:pricing|allocation)|option\s+pricing|quantitative\s+(?:finance|trading|investment))(?![A-Za-z0-9_])"
    r"|金融|交易|投资|回测|股票|债券|资产配置|资产定价|量化金融|量化投资|量化交易"
)
MODELS = r"(?i)(?<![A-Za-z0-9_])(LLM|language model|foundation model|agent|transformer|reasoning|generative AI|machine learning)(?![A-Za-z0-9_])|大模型|语言模型|机器学习|智能体|时序"
SERIES = r"(?i)time.series|forecast|probabilistic|时序|时间序列|预测"
NOTICE = r"(?i)careers|hiring|webinar|conference registration|招聘|报名"


def score(status: Column, text: Column, official: Column, paper: Column) -> Column:
    weight = F.lit(-100)
    for name, n in STATUS_WEIGHT.items():
        weight = F.when(status == name, n).otherwise(weight)
    has = lambda p, n: F.when(text.rlike(p), n).otherwise(0)
    both = F.when(text.rlike(FINANCE) & text.rlike(MODELS), 25).otherwise(0)
    return weight + has(FINANCE, 18) + has(MODELS, 12) + both + has(SERIES, 10) + F.when(official, 8).otherwise(0) + F.when(paper, 8).otherwise(0) - has(NOTICE, 80)


def attach_profile(urls: DataFrame, catalog: DataFrame, url: str = "url", code_hosts: Sequence[str] = ()) -> DataFrame:
    """``urls`` with the profile_id of the first row of ``catalog`` (profile_id, domain, ord) whose
    domain is the host or a parent of it; at one of ``code_hosts`` the domain must be host/owner/repo
    or host/owner instead. Keys meet in an equi-join of each distinct URL."""
    bare = F.regexp_replace(host(F.col(url)), r"^www\.", "")
    parts = F.split(bare, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    owner, repo = (F.lower(F.regexp_extract(url, rf"^[A-Za-z]+://[^/]+/+([^/?#]+){more}", i)) for i, more in ((1, ""), (2, "/+([^/?#]+)")))
    places = F.array(F.concat_ws("/", bare, owner, repo), F.concat_ws("/", bare, owner))
    keys = F.when(bare.isin(*code_hosts), places).otherwise(suffixes) if code_hosts else suffixes
    keyed = urls.select(url).distinct().withColumn("domain", F.explode(keys)).join(catalog, "domain")
    best = keyed.groupBy(url).agg(F.min(F.struct("ord", "profile_id"))["profile_id"].alias("profile_id"))
    return urls.join(best, url, "left")


def select_deep_reads(candidates: DataFrame, slots: Sequence[tuple[str, Sequence[str], int]], maximum: int = 12) -> DataFrame:
    """``slots``: (column, values, n). Each takes the top n of its group; what is taken twice leaves
    its place to the final fill by score. Order: score desc, id."""
    order = [F.col("score").desc(), F.col("id")]
    parts = [top_per(candidates.filter(F.col(c).isin(*values)).withColumn("_slot", F.lit(i)), ["_slot"], order, n) for i, (c, values, n) in enumerate(slots)]
    rest = candidates.withColumn("_slot", F.lit(len(slots))).orderBy(*order).limit(maximum)
    picked = rest
    for p in parts:
        picked = picked.unionByName(p)
    return top_per(picked, ["id"], [F.col("_slot")]).orderBy("_slot", *order).limit(maximum).drop("_slot")


def resolve_with_primary(candidates: DataFrame, primary: DataFrame, key: str, own: Sequence[str], order: str | None = None, most: int | None = None) -> DataFrame:
    """Columns of the primary record, nulls included, replace those of candidates that share ``key``;
    columns in ``own`` stay with the candidate. Of several records of a key the last in ``order``
    counts; where ``most`` is given, the first ``most`` keys in order are asked for, as one batch."""
    last = top_per(primary, [key], [F.col(order).desc_nulls_last()] if order else [F.xxhash64(*primary.columns)])
    p = (last.drop(order) if order and order not in candidates.columns else last).withColumn("_found", F.lit(True))
    if most is not None:
        p = p.join(F.broadcast(candidates.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(key).limit(most)), key, "left_semi")
    taken = [c for c in primary.columns if c != key and c in candidates.columns and c not in own]
    joined = candidates.alias("c").join(p.alias("p"), F.col(f"c.{key}") == F.col(f"p.{key}"), "left")
    pick = lambda c: F.when(F.col("p._found"), F.col(f"p.{c}")).otherwise(F.col(f"c.{c}")).alias(c) if c in taken else F.col(f"c.{c}")
    return joined.select(*[pick(c) for c in candidates.columns])


def exclude_delivered(candidates: DataFrame, ledger: DataFrame, runs: DataFrame, thread: str | None = None) -> DataFrame:
    """Candidates whose event no finished, live run with a media id of another thread has delivered."""
    done = runs.filter("status = 'done' and not dry_run and coalesce(media_id, '') <> ''")
    done = done.filter(F.col("thread_key") != thread) if thread is not None else done
    sent = ledger.join(done.select(F.col("id").alias("run_id")), "run_id").select("event_id").distinct()
    return candidates.join(sent, "event_id", "left_anti")


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """order columns and first, the number from 1 of the first row with these values in ``order``.
    Only the order columns move: their values, each once with its count, are sorted over ranges,
    counted by range, and each range starts where the ones before it end."""
    each = rows.groupBy(*order).agg(F.count("*").alias("n"))
    each = checkpointed(each.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = each.withColumn("part", F.shiftright("at", 33))
    ends = part.groupBy("part").agg(F.sum("n").alias("total")).withColumn("end", F.sum("total").over(W.orderBy("part")))
    within = F.sum("n").over(W.partitionBy("part").orderBy("at"))
    starts = F.broadcast(ends.select("part", (F.col("end") - F.col("total")).alias("start")))
    return part.withColumn("upto", within).join(starts, "part").select(*order, (F.col("start") + F.col("upto") - F.col("n") + 1).alias("first"))


def merge_sources(user: DataFrame, search: DataFrame) -> DataFrame:
    """(url, text, ord) of both, user rows first: of rows that share a URL the first stays, rows
    without a URL all stay; source_id S1, S2, ... by first appearance."""
    both = user.withColumn("origin", F.lit(0)).unionByName(search.withColumn("origin", F.lit(1)))
    order = [F.col("origin"), F.col("ord")]
    named = top_per(both.filter("url is not null"), ["url"], order).unionByName(both.filter("url is null"))
    firsts = _numbered(named, ["origin", "ord"]).withColumnsRenamed({"origin": "_origin", "ord": "_ord"})
    placed = named.join(firsts, (F.col("origin") == F.col("_origin")) & F.col("ord").eqNullSafe(F.col("_ord")))
    tied = F.row_number().over(W.partitionBy("origin", "ord").orderBy("url"))
    placed = placed.withColumn("n", (F.col("first") + tied - 1).cast("int")).drop("_origin", "_ord", "first")
    return placed.withColumn("source_id", F.concat(F.lit("S"), F.col("n")))


def resolve_entities(rows: DataFrame, id_: str, keys: Sequence[str]) -> DataFrame:
    """(id, entity): rows that share a value of any column of ``keys`` are one entity, transitively;
    the entity is its smallest id. Each row is linked to the smallest id of each of its keys, then
    smallest labels spread over the links until none changes; rounds go to the shared folder."""
    pairs = rows.select(F.col(id_).alias("id"), F.explode(F.array(*[F.concat(F.lit(f"{k}:"), F.col(k).cast("string")) for k in keys])).alias("key")).filter("key is not null")
    lead = pairs.groupBy("key").agg(F.min("id").alias("to"))
    links = pairs.join(lead, "key").select("id", "to").filter("id <> to").distinct()
    links = checkpointed(links.union(links.select(F.col("to").alias("id"), F.col("id").alias("to"))))
    labels = checkpointed(links.select("id").distinct().withColumn("entity", F.col("id")))
    while True:
        low = links.join(labels.select(F.col("id").alias("to"), "entity"), "to").groupBy("id").agg(F.min("entity").alias("low"))
        near = labels.join(low, "id").select("id", F.least("entity", "low").alias("entity"), F.col("entity").alias("was"))
        jump = labels.select(F.col("id").alias("entity"), F.col("entity").alias("next"))
        moved = checkpointed(near.join(jump, "entity", "left").select("id", F.least("entity", F.coalesce("next", "entity")).alias("entity"), "was"))
        labels = moved.select("id", "entity")
        if not moved.filter("entity <> was").take(1):
            break
    return rows.select(F.col(id_).alias("id")).join(labels, "id", "left").select("id", F.coalesce("entity", "id").alias("entity"))


MERGED = ("doi", "discovery_published_at")


def deduplicate_candidates(candidates: DataFrame, delivered: DataFrame, limit: int = 80, most: int = 120) -> DataFrame:
    """One row for each event among candidates (event_id, url, doi, arxiv_base, arxiv_version, date_verified,
    official, provider, discovery_published_at, score, arrival; event_id is unique): rows that share an
    address, DOI or preprint are one event, transitively. The row with a verified date wins, then the official one, then
    the higher preprint version, then the earlier arrival; it takes a DOI and a discovery date that it
    lacks from the next row in that order. providers lists where it was found, keys by what. Events in
    ``delivered`` (event_id) go; the best ``limit``, at most ``most``, stay, by score and id."""
    entity = resolve_entities(candidates, "event_id", ["url", "doi", "arxiv_base"]).withColumnRenamed("id", "event_id")
    rows = candidates.join(entity, "event_id")
    rank = F.struct(
        (~F.coalesce("date_verified", F.lit(False))).alias("v"), (~F.coalesce("official", F.lit(False))).alias("o"), (-F.coalesce("arxiv_version", F.lit(0))).alias("x"), F.col("arrival").alias("a"), F.col("event_id").alias("e"),
    )
    keys = F.array_compact(F.array("url", F.concat(F.lit("doi:"), F.col("doi")), F.concat(F.lit("arxiv:"), F.col("arxiv_base"))))
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in MERGED]
    plain = [F.min_by(c, rank).alias(c) for c in ("event_id", "url", "arxiv_base", "arxiv_version", "date_verified", "official", "score")]
    by = rows.groupBy("entity").agg(*plain, *first, F.count("*").alias("n_found"), F.array_sort(F.collect_set("provider")).alias("providers"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(keys)))).alias("keys"))
    return by.join(delivered.select("event_id").distinct(), "event_id", "left_anti").orderBy(F.col("score").desc(), "event_id").limit(min(most, limit))
