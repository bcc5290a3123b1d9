"""Readers of landed files, each with an explicit schema, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.functions.columns import arxiv_identity, canonical_url, collapsed, day_or_instant

_LINK = "array<struct<_href:string,_rel:string>>"
ATOM = f"id string, title string, published string, updated string, summary string, license string, link {_LINK}"
RSS = "title string, link string, description string, pubDate string, `dc:date` string"
CANDIDATE = ("title", "url", "summary", "published", "updated", "event_at", "event_type", "license_url", "source_id", "provider")


def read_feeds(spark: SparkSession, path: str, source_id: str, kind: str = "atom") -> DataFrame:
    """Candidates of RSS or Atom files. A versioned arXiv entry with an update is a revision, whose
    event is the update."""
    if kind == "atom":
        raw = spark.read.format("xml").schema(ATOM).option("rowTag", "entry").load(path)
        alternate = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("")).isin("", "alternate"))
        raw = raw.select("title", F.coalesce(F.get(alternate, F.lit(0))["_href"], F.col("id")).alias("url"), "summary", "published", "updated", F.col("license").alias("license_url"))
    else:
        raw = spark.read.format("xml").schema(RSS).option("rowTag", "item").load(path)
        raw = raw.select("title", F.col("link").alias("url"), F.col("description").alias("summary"), F.coalesce("pubDate", "dc:date").alias("published"), F.lit(None).cast("string").alias("updated"), F.lit(None).cast("string").alias("license_url"))
    version = F.regexp_extract(F.coalesce(arxiv_identity(F.col("url"))["version"], F.lit("")), r"(\d+)", 1).try_cast("int")
    out = raw.withColumn("title", collapsed(F.col("title"))).withColumn("url", canonical_url(F.col("url"))).filter("title <> '' and url is not null")
    for c in ("published", "updated"):
        out = out.withColumn(c, day_or_instant(F.col(c)))
    revised = (version > 1) & F.col("updated").isNotNull()
    out = out.withColumn("event_type", F.when(revised, "paper-revision").otherwise("publication")).withColumn("event_at", F.when(revised, F.col("updated")).otherwise(F.col("published")))
    return out.select(*[F.lit(source_id if c == "source_id" else kind).alias(c) if c in ("source_id", "provider") else F.col(c) for c in CANDIDATE])


_LOCATION = "struct<landing_page_url:string,pdf_url:string>"
PAYLOADS = {
    "release": "id string, repository string, name string, tag_name string, html_url string, published_at string, draft boolean, prerelease boolean, private boolean, body string",
    "works": f"title string, display_name string, doi string, publication_date string, landing_page_url string, best_oa_location {_LOCATION}, primary_location {_LOCATION}, authorships array<struct<author:struct<display_name:string>>>",
    "daily-papers": "title string, summary string, publishedAt string, paper struct<id:string,title:string,summary:string,publishedAt:string,submittedOnDailyAt:string>",
    "paper-index": "title string, url string, abstract string, passage string, arxiv_id string, created string, updated string",
    "search": "title string, url string, text string, content string, snippet string, publishedDate string, published_date string",
}
PAYLOAD = ("title", "url", "summary", "doi", "published", "discovered", "date_verified", "event_id", "kind", "official", "pdf_url", "authors", "provider")


def read_api_payloads(spark: SparkSession, path: str, provider: str, official: bool = False) -> DataFrame:
    """Candidates (title, url, summary, doi, published, discovered, date_verified, event_id, kind, official,
    pdf_url, authors, provider) of landed JSON lines of a provider.

    Releases of public repositories are official, with a date that counts and an identity of their own;
    drafts, prereleases and private repositories are dropped. Days of an index of works, of daily
    papers, of a paper index and of a search only say when a thing was discovered: published is null.
    Daily papers and index entries need a paper's identity, which gives their address; a search result
    is a paper where its address is one, and official as the caller says. Rows without title or address
    are dropped; a search result without a title is called by its address."""
    raw = spark.read.schema(PAYLOADS[provider]).json(path)
    none, no = F.lit(None).cast("string"), F.lit(False)
    unnamed = F.array().cast("array<string>")
    row = lambda **c: raw.select(*[c.get(n, {"date_verified": no, "official": no, "authors": unnamed}.get(n, none)).alias(n) for n in PAYLOAD[:-1]], F.lit(provider).alias("provider"))
    paper = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"^(\d{4}\.\d{4,5})(?:v\d+)?$", 1), F.lit("")), arxiv_identity(c)["base_id"])
    at = lambda id_: F.concat(F.lit("https://arxiv.org/abs/"), id_)
    pdf = lambda id_: F.concat(F.lit("https://arxiv.org/pdf/"), id_)
    if provider == "release":
        raw = raw.filter("not coalesce(draft, false) and not coalesce(prerelease, false) and not coalesce(private, false)")
        title = F.trim(F.concat_ws(" ", "repository", F.coalesce("name", "tag_name")))
        out = row(title=title, url=F.col("html_url"), summary=F.col("body"), published=F.col("published_at"), date_verified=F.lit(True), event_id=F.concat(F.lit("release:"), F.lower("repository"), F.lit(":"), F.col("id")), kind=F.lit("release"), official=F.lit(True))
    elif provider == "works":
        at_ = F.coalesce("best_oa_location", "primary_location")
        out = row(title=F.coalesce("display_name", "title"), url=F.coalesce(at_["landing_page_url"], "landing_page_url", "doi"), doi=F.col("doi"), discovered=F.col("publication_date"), kind=F.lit("paper"), pdf_url=at_["pdf_url"], authors=F.coalesce(F.array_compact(F.col("authorships.author.display_name")), unnamed))
    elif provider == "daily-papers":
        id_ = paper(F.col("paper.id"))
        out = row(title=F.coalesce("title", F.col("paper.title")), url=at(id_), summary=F.coalesce(F.col("paper.summary"), "summary"), discovered=F.coalesce(F.col("paper.publishedAt"), "publishedAt"), kind=F.lit("paper"), pdf_url=pdf(id_))
    elif provider == "paper-index":
        id_ = F.coalesce(paper(F.col("arxiv_id")), paper(F.col("url")))
        out = row(title=F.col("title"), url=at(id_), summary=F.coalesce("passage", "abstract"), kind=F.lit("paper"), pdf_url=pdf(id_))  # its dates are of indexing
    else:
        id_ = paper(F.col("url"))
        out = row(title=F.coalesce("title", "url"), url=F.col("url"), summary=F.coalesce("text", "content", "snippet"), discovered=F.coalesce("publishedDate", "published_date"), kind=F.when(id_.isNotNull(), "paper").otherwise("news"), official=F.lit(official), pdf_url=pdf(id_))
    return out.withColumn("published", day_or_instant(F.col("published"))).withColumn("discovered", day_or_instant(F.col("discovered"))).filter("title <> '' and url is not null")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


# fixed values: first bytes of image files
MAGIC = {"png": "^89504E470D0A1A0A", "jpg": "^FFD8FF", "gif": "^47494638", "webp": "^52494646.{8}57454250"}


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """path, kind (by first bytes), size, sha256 of image files."""
    raw = spark.read.format("binaryFile").load(path)
    head, text = F.hex(F.substring("content", 1, 16)), F.substring("content", 1, 256).cast("string")
    kind = F.lit(None).cast("string")
    for name, p in MAGIC.items():
        kind = F.when(head.rlike(p), name).otherwise(kind)
    kind = F.when(kind.isNull() & text.rlike(r"(?s)^\s*(?:<\?xml.*)?<svg"), "svg").otherwise(kind)
    return raw.select("path", kind.alias("kind"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


MESSAGE = "workspace string, channel string, user string, thread_key string, ts string, version double, text string, bot boolean, edit boolean"


def read_message_stream(spark: SparkSession, path: str, workspace: str, users: tuple[str, ...]) -> DataFrame:
    """Messages of one workspace by known people; bots are dropped."""
    s = spark.readStream.schema(MESSAGE).json(path)
    return s.filter((F.col("workspace") == workspace) & F.col("user").isin(*users) & ~F.coalesce("bot", F.lit(False)))


_SAID = "user string, bot_id string, subtype string, ts string, thread_ts string, text string, edited struct<ts:string>, files array<struct<id:string>>"
EVENT = f"team string, channel string, event_ts string, received double, {_SAID}, message struct<{', '.join(f'{n}:{t}' for n, t in (x.strip().split(' ', 1) for x in _SAID.split(', ')))}>"
# How a link stands in a message, what stops or repeats a run, and how old a first message may be, in seconds.
LINKED = r"<(https?://[^>|]+)(?:\|[^>]*)?>"
CANCEL, RETRY = r"(?i)^(?:停止(?:当前任务|进程)?|取消(?:任务)?|stop(?: the current task)?|cancel(?: task)?|abort)$", "(?i)^(?:重试|retry)$"
FIRST_AGE = 300


def message_events(events: DataFrame, threads: DataFrame, team: str, channel: str, user: str, bot: str) -> DataFrame:
    """(thread_key, at, ts, version, command, text, n_files) of one person's messages in one channel, from
    events of ``EVENT``, streamed or not, and the threads (thread_key) that are known.

    An edit counts as its message. Bots and other subtypes than shared files are dropped. Outside of a
    known thread a message has to name the bot, must not stand in a thread, and is received within five
    minutes. The bot's name and the marks of links go from the text; a message without text and files is
    dropped. The version is the time of the edit, else of the event of an edit, else of the message;
    command is cancel or retry where a message in a known thread says nothing else, else message."""
    edit = F.col("subtype") == "message_changed"
    own = F.struct(*[F.col(x.strip().split(" ")[0]) for x in _SAID.split(", ")])
    e = events.filter((F.col("team") == team) & (F.col("channel") == channel)).select("channel", "event_ts", "received", F.coalesce(edit, F.lit(False)).alias("_edit"), F.when(edit, F.col("message")).otherwise(own).alias("m"))
    e = e.filter((F.col("m.user") == user) & F.col("m.bot_id").isNull() & (F.col("m.subtype").isNull() | (F.col("m.subtype") == "file_share")) & F.col("m.ts").isNotNull())
    e = e.withColumn("thread_key", F.concat("channel", F.lit(":"), F.coalesce("m.thread_ts", "m.ts")))
    e = e.join(threads.select("thread_key", F.lit(True).alias("_known")).distinct(), "thread_key", "left")
    known, named, inside = F.col("_known").isNotNull(), F.contains(F.coalesce("m.text", F.lit("")), F.lit(f"<@{bot}>")), F.col("m.thread_ts").isNotNull()
    fresh = F.coalesce(F.col("received") - F.col("m.ts").cast("double"), F.lit(0.0)) <= FIRST_AGE
    e = e.filter((known & (inside | named)) | (~known & ~inside & named & fresh))
    text = F.regexp_replace(F.replace(F.coalesce("m.text", F.lit("")), F.lit(f"<@{bot}>"), F.lit("")), LINKED, "$1")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(a), F.lit(b))
    e = e.withColumn("text", F.regexp_replace(text, r"^\s+|\s+$", "")).withColumn("n_files", F.coalesce(F.array_size("m.files"), F.lit(0)))
    version = F.coalesce(F.col("m.edited.ts"), F.when(F.col("_edit"), F.col("event_ts")), F.col("m.ts")).cast("double")
    command = F.when(known & F.col("text").rlike(CANCEL), "cancel").when(known & F.col("text").rlike(RETRY), "retry").otherwise("message")
    at = F.timestamp_millis((F.coalesce("event_ts", "m.ts").cast("double") * 1000).cast("long"))
    return e.filter((F.col("text") != "") | (F.col("n_files") > 0)).select("thread_key", at.alias("at"), F.col("m.ts").alias("ts"), version.alias("version"), command.alias("command"), "text", "n_files")


METRIC = T.StructType([*[T.StructField(c, T.StringType()) for c in ("at", "stage", "role", "outcome", "provider")], *[T.StructField(c, T.DoubleType()) for c in ("duration_ms", "wait_ms", "attempt", "count", "bytes")], *[T.StructField(c, T.BooleanType()) for c in ("cache_hit", "retrying")]])


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry with allowed keys only: labels must be plain, numbers finite and not negative."""
    raw = spark.read.schema(METRIC).json(path)
    label = {c: F.when(F.col(c).rlike("^[a-z0-9_.-]{1,80}$"), F.col(c)) for c in ("stage", "role", "outcome", "provider")}
    number = {c: F.when((F.col(c) >= 0) & (F.col(c) < float("inf")), F.col(c)) for c in ("duration_ms", "wait_ms", "attempt", "count", "bytes")}
    return raw.withColumns({**label, **number, "at": F.to_timestamp("at")})


def write_articles(articles: DataFrame, path: str) -> None:
    """Articles (issue_date, ...) by day, replacing the days that are written."""
    articles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("issue_date").parquet(path)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
