"""Queries over the driver-style tables, one for each job that these tables can feed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions.columns import canonical_url, host, numeric_tokens
from groundwork.operators import candidates as C
from groundwork.operators import documents as D
from groundwork.operators import drafts as V
from groundwork.operators import evidence as E
from groundwork.operators import latest as L
from groundwork.operators import ledgers as G
from groundwork.operators import pages as P
from groundwork.operators import review as R
from groundwork.operators import structure as S
from groundwork.operators import terms as T
from groundwork.operators import threads as H
from groundwork.operators import upserts as U
from groundwork.plans.lineage import shared_folder
from groundwork.sources.tables import table

CUTOFF, WINDOW, SUPPLEMENT = "2024-01-29 00:00:00", "2024-01-28 00:00:00", "2024-01-22 00:00:00"


def _at(text: str):
    return F.to_timestamp(F.lit(text))


def _first_line(text: str):
    return F.split(text, "\n")[0]


def find_quotes(spark: SparkSession, sf: str) -> DataFrame:
    return E.find_quotes(table(spark, sf, "benchmark"), table(spark, sf, "documents"))


def quote_report(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's first line as a claim, quoted from its second locator or, for even ids, its first."""
    docs = table(spark, sf, "documents")
    places = D.build_locators(docs.select("doc_id", "text"), separator="\n").select(F.col("doc_id").alias("card_id"), "locator_id", "text")
    where = F.when(F.col("doc_id") % 2 == 0, "L1").otherwise("L2")
    claims = docs.select(F.col("doc_id").alias("card_id"), F.lit(1).alias("claim_idx"), where.alias("locator_id"), _first_line("text").alias("quote"), _first_line("text").alias("text"))
    return E.grounding_report(E.ground_quotes(claims, places))


def evidence_cards(spark: SparkSession, sf: str) -> DataFrame:
    """All locators of each document as claims on themselves."""
    docs = table(spark, sf, "documents")
    places = D.build_locators(docs.select("doc_id", "text"), separator="\n").select(F.col("doc_id").alias("card_id"), "n", "locator_id", "text")
    claims = places.select("card_id", F.col("n").alias("claim_idx"), "locator_id", F.col("text").alias("quote"), "text")
    return E.gate_evidence_cards(E.ground_quotes(claims, places.drop("n")))


def canonical_pages(spark: SparkSession, sf: str) -> DataFrame:
    return C.group_by_canonical(table(spark, sf, "pages"), "page_id")


def page_host_profile(spark: SparkSession, sf: str) -> DataFrame:
    catalog = spark.createDataFrame([("blogs", "example.com", 2), ("nets", "example.net", 3), ("orgs", "org", 4), ("all-com", "com", 5)], "profile_id string, domain string, ord int")
    return C.attach_profile(table(spark, sf, "pages").select("page_id", "url"), catalog).select("page_id", "profile_id")


def event_identities(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    raw = raw.withColumn("doi", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), "page_id"))).withColumn("event_id", F.lit(None).cast("string"))
    return C.normalize_candidates(raw).select("page_id", "title", "url", "event_id")


def entity_resolution(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    rows = p.select("page_id", F.regexp_replace(canonical_url(F.col("url")), r"\?.*$", "").alias("address"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return C.resolve_entities(rows, "page_id", ["address", "title"])


def page_link_references(spark: SparkSession, sf: str) -> DataFrame:
    return D.link_references(_links(spark, sf), "page_id")


def _links(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(found)).alias("url"))


def unverified_links(spark: SparkSession, sf: str) -> DataFrame:
    links = _links(spark, sf)
    allowed = D.link_references(links, "page_id").filter("n_sources % 3 > 0")
    return D.unverified_links(links, allowed)


def content_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return D.content_duplicates(table(spark, sf, "documents"))


def license_gate(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("source") == "src0", "by/4.0/").when(F.col("source") == "src1", "by-nc/4.0/").otherwise("by/3.5/")
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("https://creativecommons.org/licenses/"), kind).alias("license_url"), (F.col("lang") != "de").alias("license_verified"))
    return D.gate_licenses(docs).select("doc_id", "permitted")


def text_gate(spark: SparkSession, sf: str) -> DataFrame:
    return D.gate_text_length(table(spark, sf, "documents").select("doc_id", "text"), low=400, high=20_000).select("doc_id", "eligible", "reason")


def credential_hits(spark: SparkSession, sf: str) -> DataFrame:
    return D.scan_credentials(_with_credentials(spark, sf))


def _with_credentials(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, of which some end in a credential, by turns."""
    tail = F.expr("CASE doc_id % 7 WHEN 0 THEN concat(' token=abc', doc_id, '&a=1') WHEN 1 THEN concat(' API_KEY=x-', doc_id, ' end') WHEN 2 THEN concat(' (xoxb-1234-', doc_id, ')') ELSE '' END")
    return table(spark, sf, "documents").select("doc_id", F.concat("text", tail).alias("text"))


def redacted_docs(spark: SparkSession, sf: str) -> DataFrame:
    return D.redact(_with_credentials(spark, sf)).select("doc_id", F.md5("text").alias("digest"))


def locators(spark: SparkSession, sf: str) -> DataFrame:
    return D.build_locators(table(spark, sf, "documents").select("doc_id", "text"), separator="\n").select("doc_id", "locator_id", F.length("text").alias("size"))


def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return D.build_excerpts(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])


def numeric_index(spark: SparkSession, sf: str) -> DataFrame:
    return D.numeric_index(table(spark, sf, "documents").select("doc_id", "text"))


def ungrounded_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of a document that do not stand in its first line."""
    docs = table(spark, sf, "documents")
    return E.ungrounded_numbers(docs.select("doc_id", "text"), docs.select("doc_id", _first_line("text").alias("text")), ["doc_id"])


def style_hits(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("insult", r"idiot|scum|trash"), ("loud", r"[A-Z]{4,}!!"), ("rights", r"All rights reserved")]
    return E.lint_style(table(spark, sf, "documents").select("doc_id", "text"), rules, "doc_id", "text")


def temporal_status(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    day = F.col("event_type") == "view"
    at = F.when(day, F.date_trunc("day", "ts")).otherwise(F.col("ts"))
    status = C.temporal_status(at, F.when(day, "day").otherwise("instant"), F.col("event_type") != "error", _at(CUTOFF), _at(WINDOW), _at(SUPPLEMENT))
    return e.select("event_id", status.alias("status"))


def in_window(spark: SparkSession, sf: str) -> DataFrame:
    return C.keep_in_window(temporal_status(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


def candidate_scores(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    status = F.when(F.col("quality") == 1, "current").when(F.col("toxic") == 1, "old").otherwise("unverified")
    text = F.concat_ws(" ", F.expr("CASE source WHEN 'src0' THEN 'Forecast of stock returns' WHEN 'src2' THEN 'On asset  pricing' WHEN 'src3' THEN 'Prediction Markets' WHEN 'src4' THEN '量化交易' WHEN 'src5' THEN 'Webinar: hiring' ELSE '' END"), F.when(F.col("lang") == "en", "A language model").otherwise(""), "text")
    return d.select("doc_id", C.score(status, text, F.col("lang") == "fr", F.col("source") == "src1").alias("score"))


def top_slots(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "lang", F.col("n_chars").alias("score"))
    return C.select_deep_reads(d, [("lang", ["fr"], 4), ("source", ["src0"], 3), ("source", ["src1"], 3), ("lang", ["de", "es"], 2)]).select("id", "score")


def exclude_delivered(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ledger = e.filter("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("event_id"), F.col("event_id").alias("run_id"))
    runs = e.select(F.col("event_id").alias("id"), F.lit("done").alias("status"), (F.col("value") < 20).alias("dry_run"), F.col("props").alias("media_id"), F.col("event_type").alias("thread_key"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("event_id"), "c_name")
    return C.exclude_delivered(people, ledger, runs)


def merge_sources(spark: SparkSession, sf: str) -> DataFrame:
    user = table(spark, sf, "documents").select(F.sha2("text", 256).alias("url"), "text", F.col("doc_id").alias("ord"))
    search = table(spark, sf, "benchmark").select(F.sha2("text", 256).alias("url"), "text", F.col("item_id").alias("ord"))
    return C.merge_sources(user, search).select("source_id", "origin", "ord")


def latest_revision(spark: SparkSession, sf: str) -> DataFrame:
    return L.latest_revision(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


def thread_input(spark: SparkSession, sf: str) -> DataFrame:
    made = H.assemble_thread_input(table(spark, sf, "conversations").filter("role <> 'assistant'"), "conv_id", "turn")
    return made.select("conv_id", "n", F.md5("input").alias("digest"))


def thread_directives(spark: SparkSession, sf: str) -> DataFrame:
    return H.last_directive(table(spark, sf, "conversations").filter("role = 'user'"), "conv_id", "turn", {"asks": r"^(Th[a-z]+)", "ends": r"([a-z]+)\.$"})


def ancestor_chain(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    runs = c.select(key.alias("id"), F.when(F.col("turn") > 0, key - 1).alias("parent_id"), F.col("conv_id").alias("thread_key"))
    return H.nearest_ancestor(runs, c.filter("role = 'user'").select(key.alias("id")))


def unit_context(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("type", F.when(F.col("role") == "user", "heading").otherwise("paragraph"))
    made = D.unit_context(c, "conv_id", "turn")
    return made.select("conv_id", "turn", *[F.md5(x).alias(x) for x in ("section", "before", "after")])


def quota_ledger(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", F.get_json_object("props", "$.k").cast("long").alias("units"))
    return G.quota_ledger(e, ["user_id", "day"], ["event_id"], 120).withColumn("day", F.col("day").cast("string"))


def issue_windows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(G.issue_date(F.col("ts")).cast("string").alias("issue_date")).agg(F.count("*").alias("n"))


def issue_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return G.issue_gaps(table(spark, sf, "events").select(G.issue_date(F.col("ts")).alias("issue_date")), "2023-12-20", "2024-02-10").select(F.col("issue_date").cast("string").alias("issue_date"))


def next_per_lane(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "publishing").otherwise("done")
    runs = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("lane"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("ready_at"))
    return L.next_per_lane(runs, _at("1998-01-01 00:00:00")).select("lane", "id", "status")


def outbox_page(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    n = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", F.col("ts")).alias("sent_at"), F.when(F.col("event_type") == "error", "error").alias("blocked_reason"), F.col("ts").alias("due_at"))
    return L.outbox_page(n, _at(CUTOFF)).select("id", "due_at")


def audit_tail(spark: SparkSession, sf: str) -> DataFrame:
    return L.audit_rows(table(spark, sf, "events"), "event_id", 50).select("event_id", "user_id", "event_type")


def stage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = G.stage_metrics(table(spark, sf, "events"), ["event_type"], "value")
    return m.select("event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "least", "most")


def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return G.usage_rollup(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"])


def admission_report(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"))
    return G.admission_report(o, 1_000_000)


def pack_batches(spark: SparkSession, sf: str) -> DataFrame:
    return H.pack_batches(table(spark, sf, "conversations"), "conv_id", "turn", chars=700, items=3).select("conv_id", "turn", "batch")


def incremental_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer key up to 900 as a table, those of a few dates put over it in two turns."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("string").alias("day"), F.lit(0).alias("version"))
    root = f"{shared_folder(spark)}/upserts-{uuid.uuid4().hex}"
    U.create(o.filter("o_custkey % 10 < 9"), root, ["o_orderkey"])
    for n in (1, 2):
        U.upsert(o.filter(f"o_orderkey % 1000 < {n * 3}").withColumn("version", F.lit(n)), root, ["o_orderkey"], [F.col("version").desc()])
    return U.current(spark, root, o.schema)


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    made = H.chunk_text(table(spark, sf, "documents"), ["doc_id"], 500)
    return made.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum(F.length("part")).alias("size"), F.max(F.length("part")).alias("longest"))


def latest_messages(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    base, more = e.filter("event_type <> 'error'"), e.filter("event_type = 'error' or value > 50")
    return L.upsert_latest(base, more, ["user_id", "event_type"], [F.col("event_id").desc()])


def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    base = L.top_per(e.filter("event_type = 'signup'"), ["user_id"], [F.col("event_id")])
    return L.insert_ignore(base, e.filter("event_type <> 'signup'"), ["user_id"], [F.col("event_id")])


def debounced_threads(spark: SparkSession, sf: str) -> DataFrame:
    return G.debounced(table(spark, sf, "events"), "user_id", "ts", "2 hours")


def diff_blocks(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    target = c.filter("role <> 'system'").withColumn("text", F.when(F.col("turn") == 2, F.upper("text")).otherwise(F.col("text")))
    return D.diff_preserved_blocks(c, target, ["conv_id", "turn"])


def fingerprint_reuse(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    cache = d.filter("lang = 'en'").select(L.fingerprint("lang", "text").alias("fingerprint"))
    return L.reuse_by_fingerprint(d, cache, ["lang", "text"]).select("doc_id", "fingerprint", "hit")


def multiset_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    """Digits and capitals of each conversation's first turn against its second."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]?)"), F.lit(1))).alias("token"))
    return E.multiset_gaps(c.filter("turn = 0").drop("turn"), c.filter("turn = 1").drop("turn"), ["conv_id"])


def attempt_budgets(spark: SparkSession, sf: str) -> DataFrame:
    return G.attempt_budgets(table(spark, sf, "events").filter("event_type = 'error'"), "user_id", 14)


def transition_audit(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ["view", "click", "purchase", "signup", "error"]
    allowed = spark.createDataFrame([(a, b) for a in kinds for b in kinds if a != "error" and b != "signup"], "from_status string, to_status string")
    log = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return L.audit_transitions(log, allowed, "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "from_status", "to_status")


def key_violations(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    twice = L.duplicate_keys(li, ["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("n")).select(F.lit("lineitem key").alias("rule"), "n")
    lost = L.orphans(li, table(spark, sf, "orders"), [("l_orderkey", "o_orderkey")]).agg(F.count("*").alias("n")).select(F.lit("lineitem order").alias("rule"), "n")
    return twice.unionByName(lost)


def retry_plan(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    runs = e.select("event_id", F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), (F.col("value") > 5).alias("retryable"), F.lit(None).cast("string").alias("media_id"), (F.col("user_id") % 3).alias("retry_count"), F.col("ts").alias("created_at"))
    return G.retry_plan(runs, _at(CUTOFF)).select("event_id", "retry_at")


def recent_reasons(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", "event_id", F.concat(F.lit("user "), (F.col("user_id") % 40).cast("string")).alias("reason"))
    return G.recent_reasons(e, "event_type", "event_id")


def host_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def number_totals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(F.size(numeric_tokens(F.col("text")))).cast("long").alias("n"))


def page_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of each page's article, counted by type."""
    return D.document_manifest(P.extract_blocks(table(spark, sf, "pages")), "page_id").select("page_id", "n_paragraphs", "n_headings")


def private_hosts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    url = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("http://10.0.0."), (F.col("page_id") % 250).cast("string"), F.lit("/"))).otherwise(F.col("url"))
    return R.flag_private_hosts(p.select("page_id", url.alias("url"))).select("page_id", "private")


def draft_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as drafts, turns as items of 200 characters."""
    c = table(spark, sf, "conversations")
    items = c.select(F.col("conv_id").alias("draft_id"), F.col("turn").cast("int").alias("item"), F.col("role").alias("event_id"), _first_line("text").alias("heading"), F.col("text").alias("body"), F.lit(200).alias("target"))
    return V.validate_drafts(items, low=600, high=1500).groupBy("rule").agg(F.count("*").alias("n"))


def frozen_contexts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(G.issue_date(F.col("ts")).cast("string").alias("issue_date"), F.col("ts").alias("started_at"))
    return V.freeze_context(e)


def asset_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as assets of their source."""
    d = table(spark, sf, "documents").select(F.col("source").alias("article_id"), F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("size"))
    return R.asset_budget(d, most=50, each=20_000, total=200_000)


def instruction_units(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("type", F.lit("paragraph"))
    units = D.unit_context(c, "conv_id", "turn").withColumn("unit_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return T.instructions_per_unit(units, [("hinre", "x1"), ("éaument", "x2")])


def retranslation_plan(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "text")
    return V.plan_retranslation(c, ["term"], ["hinre", "éaument"]).select("doc_id", "ord")


def quota_state(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    b = e.groupBy(F.col("event_type").alias("provider"), F.date_trunc("week", "ts").alias("period_start")).agg(F.count("*").alias("used"))
    b = b.select("provider", F.date_format("period_start", "yyyy-MM-dd").alias("period"), "period_start", "used", F.lit(500).cast("long").alias("limit_units"))
    return V.quota_status(b, _at(CUTOFF), {"view": 480, "click": 470, "error": 480, "purchase": 420, "signup": 900})
