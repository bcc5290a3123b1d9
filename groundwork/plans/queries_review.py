"""Queries of page structure, review, drafts and evidence over the driver-style tables. Where a job's
input is not among the tables, it is derived from all rows of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators import candidates as C
from groundwork.operators import documents as D
from groundwork.operators import drafts as V
from groundwork.operators import evidence as E
from groundwork.operators import ledgers as G
from groundwork.operators import directives as W
from groundwork.operators import findings as N
from groundwork.operators import outline as O
from groundwork.operators import pages as P
from groundwork.operators import review as R
from groundwork.operators import structure as S
from groundwork.operators import terms as T
from groundwork.plans.lineage import checkpointed
from groundwork.sources.tables import table


def page_structure(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of every page."""
    return P.extract_blocks(table(spark, sf, "pages")).select("page_id", "ord", "type", "level", F.md5("text").alias("digest"))


def page_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a head that says author, dates, a title of its own or a record, by turns."""
    head = F.expr("""concat('<head>', CASE WHEN page_id % 2 = 0 THEN concat('<meta property="og:title" content="Page ', page_id, '">') ELSE '' END,
      CASE WHEN page_id % 3 = 0 THEN concat('<meta name="author" content="A', page_id, '">') ELSE '' END,
      CASE WHEN page_id % 5 = 0 THEN concat('<script type="application/ld+json">{"@type": "ScholarlyArticle", "url": "', url, '", "datePublished": "2024-01-0', 1 + page_id % 9, '"}</script>')
           WHEN page_id % 5 = 1 THEN '<script type="application/ld+json">{"@type": "NewsArticle", "url": "https://elsewhere.example/", "datePublished": "1999-01-01"}</script><meta name="date" content="2023-12-31">' ELSE '' END)""")
    pages = table(spark, sf, "pages").select("page_id", "url", F.replace(F.col("html"), F.lit("<head>"), head).alias("html"))
    return P.page_metadata(pages).drop("url").withColumn("title", F.md5("title"))


def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as a table: its key spans the rows of its items, the note of each spans two columns."""
    li = table(spark, sf, "lineitem")
    row = F.expr("concat('<td>', l_linenumber, '<td colspan=2>', l_returnflag, l_linestatus, '</td><td>', cast(l_quantity as long), '</td></tr>')")
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("html"))))
    by = li.groupBy("l_orderkey").agg(rows.alias("r"))
    body = F.array_join(F.transform("r", lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.concat(F.lit("<th rowspan="), F.size("r"), F.lit(">"), F.col("l_orderkey"), F.lit("</th>"))).otherwise(F.lit("")), x["html"])), "")
    pages = by.select(F.col("l_orderkey").alias("page_id"), F.lit("https://shop.example/").alias("url"), F.concat(F.lit("<article><table>"), body, F.lit("</table></article>")).alias("html"))
    return P.table_cells(P.extract_blocks(pages)).drop("ord")


def inline_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn as a paragraph with a link, a citation and a formula."""
    html = F.expr("""concat('<article><p>', role, ' <a href="/t/', turn, '">turn ', turn, '</a> says <a href="#bib', turn, '">[', turn + 1, ']</a> that <math alttext="x_', turn, '"><mi>x</mi></math> holds.</p></article>')""")
    c = table(spark, sf, "conversations").select(F.expr("conv_id * 1000 + turn").alias("page_id"), F.lit("https://chat.example/a/").alias("url"), html.alias("html"))
    return P.inline_fragments(P.extract_blocks(c)).drop("ord")


def _turn_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as documents: user turns are headings, those of level one open with every fourth turn."""
    c = table(spark, sf, "conversations")
    return c.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.expr("CASE WHEN role = 'user' THEN 'heading' WHEN turn % 5 = 3 THEN 'figure' WHEN role = 'system' THEN 'list_item' ELSE 'paragraph' END").alias("type"),
        F.expr("CASE WHEN role = 'user' THEN CASE WHEN turn % 4 = 0 THEN 1 ELSE 2 END END").alias("level"), F.expr("CASE WHEN role = 'user' AND turn = 2 THEN 'References' ELSE text END").alias("text"), F.expr("CASE WHEN turn % 5 = 3 THEN concat('fig ', turn) END").alias("caption"),
    )


def bibliography(spark: SparkSession, sf: str) -> DataFrame:
    return O.annotate_bibliography(_turn_blocks(spark, sf)).select("doc_id", "ord", "type")


def visual_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return S.number_visuals(O.annotate_bibliography(_turn_blocks(spark, sf))).filter("number is not null").select("doc_id", "ord", "type", "number")


def section_slices(spark: SparkSession, sf: str) -> DataFrame:
    b = _turn_blocks(spark, sf).filter("type <> 'figure'")
    return O.slice_sections(b, b.select("doc_id", F.lit("references").alias("start"), F.lit(None).cast("string").alias("end")).distinct()).select("doc_id", "ord", F.md5("text").alias("digest"))


def paper_main(spark: SparkSession, sf: str) -> DataFrame:
    papers = table(spark, sf, "conversations").filter("conv_id % 2 = 0").select(F.col("conv_id").alias("doc_id"))
    return O.crop_paper_main(_turn_blocks(spark, sf), papers).select("doc_id", "ord", "boundary")


def flat_documents(spark: SparkSession, sf: str) -> DataFrame:
    return S.flatten_documents(_turn_blocks(spark, sf)).select("doc_id", F.md5("text").alias("digest"))


def translation_units(spark: SparkSession, sf: str) -> DataFrame:
    b = _turn_blocks(spark, sf).withColumn("translation_policy", F.expr("CASE WHEN ord = 1 THEN 'preserve-original' END"))
    return S.translation_units(b).select("doc_id", "unit_id", "kind", F.md5("text").alias("digest"))


def translation_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Against a translation that lost the figures of odd documents and all of every seventh."""
    b = _turn_blocks(spark, sf)
    return V.translation_completeness(b, b.filter("doc_id % 7 <> 0 and not (doc_id % 2 = 1 and type = 'figure')")).select("doc_id", "figures_source", "figures_target", "chars_source", "chars_target", "complete")


def document_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as HTML documents of their items, and as many that have no block; items of one carrier's
    line are figures, the sixth is of no known type. Orders of few items are short."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    kind = F.expr("CASE WHEN l_linenumber = 6 THEN 'odd' WHEN l_returnflag = 'R' THEN 'figure' ELSE 'paragraph' END")
    blocks = li.select(F.col("l_orderkey").alias("doc_id"), kind.alias("type"), F.expr("concat('Item ', l_linenumber, ' is part ', l_partkey, ' of supplier ', l_suppkey, '.')").alias("text"))
    docs = o.select(F.col("o_orderkey").alias("doc_id")).unionByName(o.select((-F.col("o_orderkey") - 1).alias("doc_id"))).withColumn("kind", F.lit("html"))
    return R.document_completeness(docs, blocks)


def extraction_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as pages: the first turn of every third conversation is lost, every fifth keeps a tenth."""
    c = table(spark, sf, "conversations")
    expected = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"))
    found = expected.filter("not (doc_id % 3 = 0 and page = 0)")
    n = F.sum(F.length("text"))
    sizes = c.groupBy(F.col("conv_id").alias("doc_id")).agg(n.alias("layer")).select("doc_id", "layer", F.expr("CASE WHEN doc_id % 4 = 1 THEN layer div 5 ELSE layer END").alias("parsed"), F.expr("CASE WHEN doc_id % 5 = 0 THEN layer div 10 ELSE layer END").alias("extracted"), F.lit(2).alias("images"), F.expr("cast(doc_id % 3 as int)").alias("referenced"))
    return R.extraction_coverage(expected, found, sizes).withColumn("rules", F.array_join("rules", ","))


def page_gaps(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    pages = li.filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"))
    want = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max("l_linenumber").alias("page_count"))
    return R.page_coverage(pages, want).withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


def output_residue(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a mark of unfinished output after their text, by turns."""
    mark = F.expr("CASE doc_id % 6 WHEN 0 THEN ' SL_INLINE_4 SL_INLINE_5' WHEN 1 THEN ' [object Object]' WHEN 2 THEN ' see /home/user/x and `/home/user/y`' WHEN 3 THEN concat(' bell', chr(7)) WHEN 4 THEN ' of \\\\\\\\frac{1}{2}' ELSE ' `[object Object]`' END")
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), F.concat(F.regexp_replace("text", "`", ""), mark).alias("text"))
    return R.lint_output_residue(a).select("article_id", "rule", "n")


def eligible_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Items of orders as figures of documents, parts as issues."""
    caption = F.expr("CASE WHEN l_returnflag = 'A' THEN 'Courtesy of the museum' WHEN l_linestatus = 'F' AND l_linenumber % 3 = 0 THEN '图片转载' WHEN l_linenumber = 2 THEN ' ' ELSE concat('Figure ', l_linenumber) END")
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.expr("concat(CASE WHEN l_suppkey % 5 = 0 THEN 'ftp' ELSE 'https' END, '://img.example/', l_partkey)").alias("url"), caption.alias("caption"), F.col("l_orderkey").alias("o"))
    return R.eligible_figures(f.withColumn("issue", F.expr("o % 97")), issue="issue").select("issue", "doc_id", "ord")


def retracted_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents left after corrections made of the labels: toxic ones are retracted or withdrawn."""
    d = table(spark, sf, "documents").select("doc_id", F.expr("concat('10.1/ABC', doc_id)").alias("doi"))
    kinds = F.expr("CASE WHEN toxic = 1 AND doc_id % 2 = 0 THEN array('erratum', 'Retraction') WHEN toxic = 1 THEN array('withdrawal') ELSE array('correction') END")
    return R.drop_retracted(d, table(spark, sf, "labels").select(F.expr("concat('10.1/abc', doc_id)").alias("doi"), kinds.alias("update_types"))).select("doc_id")


def thread_materials(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with a file and a link each; pictures and the covers of even conversations are left out."""
    c = table(spark, sf, "conversations")
    files = F.expr("""concat('[{"url":"https://f.example/', conv_id % 9, '/', turn, '","mimetype":"', CASE WHEN turn % 2 = 0 THEN 'image/png' ELSE 'application/pdf' END, '"}]')""")
    m = c.select(F.col("conv_id").alias("thread_key"), files.alias("files"), F.expr("concat(role, ' see https://l.example/', turn % 3, ' there')").alias("text"))
    covers = c.filter("conv_id % 2 = 0 and turn = 0").select(F.col("conv_id").alias("thread_key"), F.lit("https://l.example/0").alias("url"))
    return V.select_materials(m, covers, most=4)


def failure_classes(spark: SparkSession, sf: str) -> DataFrame:
    code = F.expr("CASE user_id % 7 WHEN 0 THEN 'ECONNRESET' WHEN 1 THEN 'HTTP_503' WHEN 2 THEN 'AUTH_EXPIRED' WHEN 3 THEN 'QUOTA' WHEN 4 THEN 'TIMEOUT' WHEN 5 THEN 'PARSE' END")
    e = table(spark, sf, "events").select("event_id", code.alias("code"), F.expr("CASE WHEN event_type = 'view' THEN 'daily' ELSE 'article' END").alias("profile"), (F.col("value") > 10).alias("remote"))
    return R.classify_failures(e).select("event_id", "status", "retryable")


def unusable_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages: some are empty, ask for a login or for a human in words, in their title or by
    what they are built of, come from a login address, or are an empty shell."""
    d = table(spark, sf, "documents").withColumn("k", F.expr("doc_id % 12"))
    d = d.select("doc_id", F.expr("CASE k WHEN 0 THEN '' WHEN 1 THEN 'Please verify that you are human' WHEN 2 THEN concat('Log in to continue ', text) WHEN 6 THEN concat('no captcha here ', text) ELSE text END").alias("visible"),
      F.expr("CASE WHEN k < 3 THEN '' ELSE text END").alias("article"), F.expr("cast(doc_id % 5 as int)").alias("blocks"), F.expr("CASE WHEN k = 5 THEN 'https://a.example/Login?next=x' WHEN k = 8 THEN 'https://a.example/x?to=/login' ELSE 'https://a.example/login-news' END").alias("url"), F.expr("CASE WHEN k = 4 THEN 'Just a moment...' WHEN k = 7 THEN 'Just a moment of news' ELSE 'News' END").alias("title"),
      F.expr("""concat(CASE k WHEN 1 THEN '<p>verify that you are human</p>' WHEN 3 THEN '<script async src="https://www.google.com/recaptcha/api.js"></script>' WHEN 4 THEN '<title>Just a moment...</title>' WHEN 6 THEN '<p>no captcha here' WHEN 7 THEN '<title>Just a moment of news</title>' WHEN 9 THEN '<form method="post" action="/cdn/challenge">attention required</form>' ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN '<div id="root"></div>' ELSE '<p>' END)""").alias("html"))
    return R.flag_unusable_pages(d).select("doc_id", "reason")


def primary_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Pages take title and date of the last of several records of their key."""
    p = table(spark, sf, "pages")
    mine = p.select("page_id", F.expr("page_id % 50").alias("base"), F.expr("concat('found ', page_id)").alias("title"), F.lit("2024-01-01").alias("dated"), F.col("url"))
    records = p.select(F.expr("page_id % 40").alias("base"), F.expr("concat('record ', page_id)").alias("title"), F.expr("CASE WHEN page_id % 3 > 0 THEN concat('2024-02-', page_id) END").alias("dated"), F.expr("concat('https://r/', page_id)").alias("url"), F.col("page_id").alias("arrival"))
    return C.resolve_with_primary(mine, records, "base", ["url"], order="arrival", most=35).select("page_id", "title", "dated")


def deduplicated_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as candidates that share addresses, DOIs and preprints; those delivered are every eleventh."""
    p = table(spark, sf, "pages")
    rows = p.select(
        F.expr("concat('e', page_id)").alias("event_id"), F.expr("concat('https://x.example/', page_id div 2)").alias("url"), F.expr("CASE WHEN page_id % 5 = 0 THEN concat('10.1/', page_id div 10) END").alias("doi"),
        F.expr("CASE WHEN page_id % 7 < 2 THEN cast(page_id div 7 as string) END").alias("arxiv_base"), F.expr("cast(page_id % 3 as int)").alias("arxiv_version"), F.expr("page_id % 4 = 1").alias("date_verified"), F.expr("page_id % 6 = 3").alias("official"),
        F.expr("concat('p', page_id % 3)").alias("provider"), F.expr("CASE WHEN page_id % 2 = 1 THEN concat('2024-01-', page_id) END").alias("discovery_published_at"), F.expr("cast(length(url) + page_id % 13 as int)").alias("score"), F.col("page_id").alias("arrival"),
    )
    out = C.deduplicate_candidates(rows, rows.filter("arrival % 11 = 0").select("event_id"), limit=100)
    return out.select("event_id", "doi", "discovery_published_at", "score", F.array_join("providers", ",").alias("providers"), F.size("keys").cast("long").alias("n_keys"), "n_found")


def collection_health(spark: SparkSession, sf: str) -> DataFrame:
    """Days as runs, event types as slots."""
    e = table(spark, sf, "events").select(F.to_date("ts").cast("string").alias("run_id"), F.expr("concat(event_type, user_id % 3)").alias("slot_id"), (F.col("value") > 30).alias("ok"))
    rules = [("papers", "a", ["view0"], 1), ("papers", "b", ["view1", "view2", "click0"], 2), ("practice", "a", ["click0", "click1", "click2"], 2), ("finance", "a", ["purchase0", "purchase1"], 2), ("finance", "b", ["error0"], 1)]
    sections, whole = G.collection_health(e, rules, needed=("papers", "practice"))
    pivot = sections.groupBy("run_id").agg(*[F.bool_or(F.when(F.col("section") == s, F.col("ok"))).alias(s) for s in ("papers", "practice", "finance")])
    return pivot.join(whole, "run_id")


def issue_states(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.to_date("ts").alias("issue_date"), (F.col("event_type") == "purchase").alias("done"))
    return G.issue_states(e, "2024-02-05").withColumn("issue_date", F.col("issue_date").cast("string"))


def _telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), F.expr("CASE WHEN event_type = 'error' AND value > 5 THEN 'failed' ELSE 'ok' END").alias("outcome"), F.expr("cast(user_id % 3 as double)").alias("attempt"), (F.col("value") > 40).alias("retrying"), F.expr("coalesce(user_id % 2 = 0, false)").alias("cache_hit"), F.col("value").alias("duration_ms"))


def stage_report(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of stages with the exact percentile; the sketched one is held against its exact rank,
    which two percent of the rows at most may part from 0.95."""
    e = _telemetry(spark, sf)
    made = checkpointed(G.stage_report(e, ["event_type"]))
    ranks = G.quantile_ranks(e.filter(~F.isnan("duration_ms")), F.broadcast(made.select("event_type", F.col("p95_sketch").alias("value"))), ["event_type"])
    close = F.col("p95_sketch").isNull() | (F.col("below") <= 0.97) & (F.col("upto") >= 0.93)
    held = made.join(ranks.withColumnRenamed("event_type", "_type"), F.col("event_type").eqNullSafe(F.col("_type")), "left")
    return held.select("event_type", "n", "failures", "retries", F.round("hit_rate", 6).alias("hit_rate"), F.round("p95", 6).alias("p95"), close.alias("p95_close"))


def duration_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches kept by day and stage, merged to stages: their number and whether three quantiles have
    their ranks, within two percent of the rows."""
    e = _telemetry(spark, sf)
    m = G.merged_sketches(G.duration_sketches(e, ["event_type", "day"]), ["event_type"])
    told = m.select("event_type", "n", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), G.sketch_quantile(m, q).alias("value")) for q in (0.05, 0.5, 0.95)])).alias("t")).select("event_type", "n", "t.*")
    ranks = G.quantile_ranks(e.withColumn("q", F.explode(F.array(*[F.lit(q) for q in (0.05, 0.5, 0.95)]))), told, ["event_type", "q"])
    return told.join(ranks, ["event_type", "q"]).select("event_type", "q", "n", ((F.col("below") <= F.col("q") + 0.02) & (F.col("upto") >= F.col("q") - 0.02)).alias("close"))


def receipts(spark: SparkSession, sf: str) -> DataFrame:
    """Operations by content of orders, drafts that appeared by items: one match resolves one."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    ops = o.select(F.col("o_orderkey").alias("op_id"), F.expr("concat('k', o_orderkey)").alias("identity"))
    seen = li.select(F.expr("concat(l_orderkey, '-', l_linenumber)").alias("draft_id"), F.expr("concat('k', l_orderkey)").alias("identity"), "l_linenumber")
    return R.reconcile_receipts(ops, seen.filter("l_linenumber > 2").select("draft_id"), seen.drop("l_linenumber"))


def notice_receipts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as sent notices, their items as messages that bear their mark, some too early or late, in
    another channel, by another sender or inside a thread."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    begun = "(1700000000 + o_orderkey * 37 % 400000) * 1000"
    ops = o.select(F.col("o_orderkey").alias("op_id"), F.lit("C1").alias("channel"), F.expr("concat('[notice:', o_orderkey, ']')").alias("marker"), F.expr(begun).alias("started_ms"))
    sent = F.expr("(1700000000 + l_orderkey * 37 % 400000) * 1000 - 120000 + l_partkey % 9 * 90000")
    says = F.expr("concat('done [notice:', l_orderkey, '] of [', l_linenumber, ']')")
    messages = li.select(F.expr("CASE WHEN l_suppkey % 7 = 0 THEN 'C2' ELSE 'C1' END").alias("channel"), F.expr("concat(l_orderkey, '.', l_linenumber)").alias("ts"), sent.alias("sent_ms"), F.expr("CASE WHEN l_linenumber = 3 THEN '1.0' END").alias("thread_ts"), F.expr("CASE WHEN l_linenumber = 4 THEN 'U2' ELSE 'U1' END").alias("user"), F.lit("B1").alias("bot_id"), says.alias("text"))
    return R.reconcile_notices(ops, messages, 1700000000000 + 300_000_000, "U1", "B1", "C1").select("op_id", "state", "ts")


def notice_routes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.expr("CASE WHEN user_id % 4 = 0 THEN concat('t', user_id) ELSE concat('C', user_id, ':', event_id) END").alias("thread_key"))
    aliases = table(spark, sf, "customer").filter("c_custkey % 8 = 0").select(F.expr("concat('t', c_custkey)").alias("thread_key"), F.expr("concat('A', c_nationkey)").alias("channel"), F.col("c_name").alias("root"))
    return R.route_notices(e, aliases).select("event_id", "channel", "root")


def inherited_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as runs, the one before as parent, items as cards of a run."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr("o_orderkey - 1").alias("parent_id"), F.expr("o_custkey % 3").alias("thread_key"), F.col("o_orderstatus").alias("profile"), F.expr("substring(o_orderpriority, 1, 1)").alias("context_hash"))
    cards = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("card_id"))
    return R.inherit_evidence(o, cards)


def citation_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with marks of sources in all forms; a link's label is no mark. Each conversation is an
    article with three to six sources of its own."""
    body = F.expr("CASE turn % 4 WHEN 0 THEN concat('See [S', 1 + turn % 6, '] and 【', 1 + conv_id % 6, '】, or [2](https://x).') WHEN 1 THEN concat('It holds (S', 1 + conv_id % 9, ').') WHEN 2 THEN concat('It is so (', 1 + conv_id % 6, '), and (7 of them) too.') ELSE 'No mark.' END")
    c = table(spark, sf, "conversations")
    bodies = c.select(F.col("conv_id").alias("article_id"), F.expr("conv_id * 1000 + turn").alias("body_id"), body.alias("text"))
    sources = c.select(F.col("conv_id").alias("article_id")).distinct().select("article_id", F.explode(F.expr("sequence(1, cast(3 + article_id % 4 as int))")).alias("ord")).select("article_id", F.expr("concat('S', ord)").alias("source_id"), "ord")
    known, lost = E.resolve_citations(bodies, sources)
    return known.unionByName(lost.withColumn("number", F.lit(0)))


def excerpt_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Every item refers to the item of its number plus one, in its order."""
    li = table(spark, sf, "lineitem")
    excerpts = li.select(F.col("l_orderkey").alias("card_id"), F.expr("concat('E', l_linenumber)").alias("excerpt_id"), F.col("l_shipdate").cast("string").alias("quote"))
    refs = li.select(F.expr("l_orderkey * 10 + l_linenumber").alias("claim_id"), F.col("l_orderkey").alias("card_id"), F.expr("concat('E', l_linenumber + 1)").alias("excerpt_id"))
    ok, lost = E.resolve_excerpt_refs(refs.unionByName(refs), excerpts)
    return ok.select("claim_id", "quote", F.lit(None).cast("string").alias("span")).unionByName(lost.select("claim_id", F.lit(None).cast("string").alias("quote"), F.concat_ws("-", "first_id", "last_id").alias("span")))


def _numbers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf, "lineitem")
    missing = li.select(F.col("l_orderkey").alias("sent_id"), F.expr("cast(1000 + l_partkey % 500 as string)").alias("token"))
    excerpts = table(spark, sf, "part").select(F.col("p_partkey").alias("excerpt_id"), F.expr("concat('No ', 1000 + p_partkey % 400, ' and ', 1000 + p_size, '.')").alias("quote"))
    return missing, excerpts


def numeric_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return E.numeric_gap_candidates(*_numbers(spark, sf))


def numbers_nowhere(spark: SparkSession, sf: str) -> DataFrame:
    return E.gaps_nowhere(*_numbers(spark, sf))


def dated_months(spark: SparkSession, sf: str) -> DataFrame:
    """Orders told with their date, the month in three ways, and one that is no date."""
    told = F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat('Ordered on ', date_format(o_orderdate, 'MMMM d, yyyy'), '.') WHEN 1 THEN concat('Ordered in ', date_format(o_orderdate, 'MMMM yyyy'), '.') WHEN 2 THEN concat('On ', date_format(o_orderdate, 'd MMMM'), ', in the year ', year(o_orderdate), '.') ELSE concat(date_format(o_orderdate, 'MMMM d'), ' samples. In ', year(o_orderdate), ' more.') END")
    return D.numeric_index(table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), told.alias("text")))


def number_words(spark: SparkSession, sf: str) -> DataFrame:
    told = F.expr("concat('Zero ', p_size, ' single twenty-', 'ONE Nineteen phones, -', p_size, ' −', p_partkey, ' +', cast(p_retailprice as long))")
    return D.numeric_index(table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), told.alias("text")))


def amount_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts in words, letters and Chinese magnitudes against the same in digits."""
    u = table(spark, sf, "part").select(
        F.col("p_partkey").alias("unit_id"), F.expr("concat('It cost ', p_size, ' million and ', p_partkey, '.50 percent of ', p_size, 'K, step one.')").alias("source"),
        F.expr("concat('价格 ', p_size * 100, ' 万，', p_partkey, '.5%，', p_size * 1000, CASE WHEN p_partkey % 10 = 0 THEN ' 和 7' ELSE '' END, CASE WHEN p_partkey % 15 = 0 THEN '，第十二章' ELSE '' END)").alias("target"),
    )
    return R.translation_equivalence(u).select("unit_id", "token", "n_source", "n_target", "severity")


def unmapped_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Items as sentences of an order's body; those with a claim are the even ones."""
    li = table(spark, sf, "lineitem")
    s = F.expr("concat('Item ', l_linenumber, ' has ', cast(l_quantity as long), ' pieces;')")
    body = li.groupBy(F.col("l_orderkey").alias("body_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", s.alias("s")))), lambda x: x["s"]), " ").alias("text"))
    claims = li.filter("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("body_id"), s.alias("sentence"))
    return E.unmapped_sentences(body, claims).select("body_id", "sentence")


def nearest_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that say a quantity wrong, with the sentence that begins like them."""
    li = table(spark, sf, "lineitem")
    body = li.groupBy(F.col("l_orderkey").alias("body_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("P"), x["l_linenumber"].cast("string"), F.lit(" is part "), x["l_partkey"].cast("string"), F.lit("."), F.lit("\n"))), "").alias("text"))
    claims = li.select(F.col("l_orderkey").alias("body_id"), F.expr("concat('P', l_linenumber, ' is part of it.')").alias("sentence"))
    return E.nearest_sentences(body, claims)


def findings_rollup(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "events").select(F.expr("cast(user_id % 3 as int)").alias("pass"), F.col("event_type").alias("scope"), F.expr("CASE WHEN value > 20 THEN 'high' ELSE 'low' END").alias("severity"), F.expr("concat('r', user_id % 5)").alias("reason"))
    return V.rollup_findings(i).withColumn("warnings", F.array_join("warnings", ","))


def findings_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Events as findings in nine wordings, some of which name a date or a passage; the draft before
    has these in every second event, the draft after in every third."""
    said = "concat('event value ', cast(round(value) as bigint), ' of user ', user_id)"
    reason = F.expr(f"""CASE event_id % 9 WHEN 0 THEN 'C1：稿件将数字写成了 5，遗漏背景' WHEN 1 THEN concat('稿件没有交代 ', user_id) WHEN 2 THEN '稿件称收益为 3%，原文没有报告'
      WHEN 3 THEN concat('遗漏：原文“', {said}, '”') WHEN 4 THEN concat('未交代 2024年1月', 1 + user_id % 28, '日至2月3日 的背景') WHEN 5 THEN '措辞可以更好'
      WHEN 6 THEN '原文没有写在正文里' WHEN 7 THEN '没有写在导语' ELSE '稿件没有称其为实测' END""")
    draft = f"concat({said}, '，2024年1月', 1 + user_id % 28, '日至2月3日')"
    e = table(spark, sf, "events").select("event_id", F.expr("cast(user_id % 3 as int)").alias("pass"), F.col("event_type").alias("scope"), reason.alias("reason"), "value", F.expr(f"CASE WHEN event_id % 2 = 0 THEN {draft} ELSE 'nothing' END").alias("before"), F.expr(f"CASE WHEN (event_id div 9) % 3 = 0 THEN {draft} ELSE 'nothing' END").alias("after"))
    return N.classify_findings(e, e.filter("value > 60").select("scope", "reason")).select("event_id", "verdict")


def dropped_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as findings: the draft before has brand, name and type, the draft after lost one of them."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("finding_id"), F.expr("concat('the ', p_name, ' of ', p_type, ' by ', p_brand, ' is missing')").alias("finding"), F.expr("concat(p_brand, ' makes the ', p_name, ' of ', p_type)").alias("before"), F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(p_brand, ' makes the ', p_name) WHEN 1 THEN concat('the ', p_type, ' of ', p_brand) ELSE concat('it is the ', p_name, ' of ', p_type) END").alias("after"))
    return N.dropped_spans(p)


def term_instructions(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the benchmark as terms, each with its own beginning as the target, in conversations."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1))).alias("source_term")).distinct()
    terms = words.select("source_term", F.expr("concat(source_term, 'x')").alias("target_term"), F.xxhash64("source_term").alias("h"))
    terms = terms.select("source_term", "target_term", F.expr("h >> 2").alias("ord"))
    units = table(spark, sf, "conversations").select(F.expr("conv_id * 1000 + turn").alias("unit_id"), "text", F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    return T.instructions_per_unit(units, terms)


def _numbered_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as documents: users' turns are headings of three levels with a number, the fourth
    is one of references under another name."""
    text = F.expr("CASE WHEN role <> 'user' THEN text WHEN turn = 4 THEN concat('6. ', CASE WHEN conv_id % 2 = 0 THEN '参考文献' ELSE 'Bibliography.' END) ELSE concat(turn, '. ', text) END")
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.expr("CASE WHEN role = 'user' THEN 'heading' ELSE 'paragraph' END").alias("type"), F.expr("CASE WHEN role = 'user' THEN 1 + (conv_id + turn) % 3 END").alias("level"), text.alias("text"))


def heading_outline(spark: SparkSession, sf: str) -> DataFrame:
    """The section of each heading, and its place among those around it."""
    return O.outline(_numbered_turns(spark, sf)).select("doc_id", "open", "close", "level", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


def section_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Scopes by number, by another name of the references, by ranges, and by what no heading has."""
    b = _numbered_turns(spark, sf)
    start = F.expr("CASE doc_id % 5 WHEN 0 THEN '2' WHEN 1 THEN '99' WHEN 2 THEN 'references' WHEN 3 THEN '2' ELSE 'no such name at all' END")
    end = F.expr("CASE doc_id % 5 WHEN 0 THEN 'works cited' WHEN 3 THEN '1' END")
    r = b.select("doc_id", start.alias("start"), end.alias("end")).distinct()
    return O.section_ranges(b, r).select("doc_id", "open", "close", "error", F.md5("available").alias("available"))


def thread_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as threads that ask for pages, terms, titles and sections by turns."""
    said = F.expr("""CASE (conv_id + turn) % 6 WHEN 0 THEN concat('翻译第', 1 + turn, '-', 2 + turn + conv_id % 5, '页') WHEN 1 THEN concat('术语 t', conv_id % 3, ' 译为 u', turn, '\n术语 w → v', turn) WHEN 2 THEN concat('标题改为《', role, ' ', turn, '》')
      WHEN 3 THEN concat('只翻译第', turn, '节') WHEN 4 THEN '请刷新来源' ELSE concat('第', turn, '页 ', regexp_replace(text, '\\\\s+', ' ')) END""")
    made = W.thread_requests(table(spark, sf, "conversations").select("conv_id", "turn", said.alias("text")), "conv_id", "turn")
    terms = F.array_join(F.transform("terms", lambda t: F.concat_ws("=", t["source"], t["target"])), ",")
    return made.select("conv_id", F.col("scope.kind").alias("kind"), F.col("scope.start").alias("start"), F.col("scope.end").alias("end"), "title", terms.alias("terms"), "refresh", F.md5("body").alias("body"))


def document_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as PDFs, pages of papers, releases and texts by turns; some name sections, lost a page
    or are encrypted."""
    k = "doc_id % 5"
    text = F.expr(f"CASE WHEN {k} = 0 AND doc_id % 3 > 0 THEN concat(text, ' Methodology and References') ELSE text END")
    heads = F.expr("CASE doc_id % 4 WHEN 0 THEN array('1 Introduction', '2 Results') WHEN 1 THEN array('Background', 'Background') ELSE array('引言', '实验') END")
    d = table(spark, sf, "documents").select("doc_id", F.expr(f"element_at(array('pdf', 'paper', 'release', 'text', 'odd'), cast(1 + {k} as int))").alias("kind"), text.alias("text"), heads.alias("headings"), F.expr("doc_id % 110").alias("expected_pages"), F.expr("doc_id % 110 - CASE WHEN doc_id % 35 = 0 THEN 1 ELSE 0 END").alias("pages"), F.expr("doc_id % 40 = 0").alias("encrypted"))
    return D.gate_documents(d).select("doc_id", "reason", "eligible")


def whole_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as drafts, their turns as items, each with a fault of its own by turns."""
    c = table(spark, sf, "conversations")
    body = F.expr("""concat(regexp_replace(text, '[0-9<`\\\\[⟦/]', ' '), CASE (conv_id + turn) % 8 WHEN 0 THEN ' 今日发布' WHEN 1 THEN ' [a](https://a.example/x?utm_source=y)' WHEN 2 THEN ' [b](https://b.example/)' WHEN 3 THEN ' ⟦001⟧' WHEN 4 THEN ' ![i](https://a.example/i.png)' WHEN 5 THEN ' <iframe src=x>' ELSE '' END)""")
    items = c.select(F.col("conv_id").alias("draft_id"), F.col("turn").cast("int").alias("item"), F.lit("c").alias("card_id"), F.expr("CASE WHEN turn % 5 = 4 THEN NULL WHEN turn = 3 AND conv_id % 4 = 0 THEN 'e0' ELSE concat('e', turn) END").alias("event_id"),
      F.expr("CASE turn % 4 WHEN 1 THEN concat(role, ' `x`') WHEN 2 THEN repeat('长', 121) ELSE role END").alias("heading"), body.alias("body"), F.expr("CASE WHEN turn % 6 = 5 THEN 'minor' ELSE 'lead' END").alias("importance"), F.expr("CASE WHEN turn % 2 = 0 THEN 'supplement' ELSE 'current' END").alias("temporal_status"))
    drafts = c.select(F.col("conv_id").alias("draft_id")).distinct().select("draft_id", F.expr("CASE draft_id % 5 WHEN 0 THEN '' WHEN 1 THEN '2024年的新闻' WHEN 2 THEN repeat('题', 65) WHEN 3 THEN '第十二期' ELSE '模型' END").alias("title"), F.expr("CASE draft_id % 3 WHEN 0 THEN '导语' WHEN 1 THEN '导语有 12 项' END").alias("intro"))
    return V.validate_whole_drafts(drafts, items, drafts.select("draft_id", F.lit("https://a.example/x").alias("url")))


def review_triage(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as units, their translation cut in two ways."""
    c = table(spark, sf, "conversations")
    u = c.select(F.expr("conv_id * 1000 + turn").alias("unit_id"), F.expr("concat(text, CASE WHEN turn % 2 = 0 THEN ' 7' ELSE '' END)").alias("source"), F.expr("CASE WHEN conv_id % 3 = 0 THEN text WHEN conv_id % 3 = 1 THEN concat(text, '。') ELSE concat(left(text, 10), repeat('。', 60)) END").alias("target"), F.expr("CASE WHEN turn = 1 THEN 'Results' ELSE 'Method' END").alias("section"), F.expr("conv_id % 17 = 0").alias("repaired"), F.expr("cast(conv_id % 13 = 0 as int)").alias("warnings"))
    return V.review_triage(u).select("unit_id", "review_reason")


def highlight_lints(spark: SparkSession, sf: str) -> DataFrame:
    bold = F.expr("CASE turn % 5 WHEN 0 THEN concat('**', left(text, 1), '** ', text) WHEN 1 THEN concat('**', text, '**') WHEN 2 THEN concat(text, ' **open') WHEN 3 THEN concat(text, ' **aa** **bb** **cc** **dd**') ELSE text END")
    return V.lint_highlights(table(spark, sf, "conversations").select(F.expr("conv_id * 1000 + turn").alias("unit_id"), bold.alias("text")))


def corrected_terms(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), F.col("text").alias("source"), F.col("text").alias("target"))
    return T.apply_terms(u, [("hinre", "the", "THE"), ("éau", "la ", "LA "), ("THE", "and", "&")]).select("unit_id", F.md5("target").alias("digest"))


def untranslated(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose translation is their own text, or has four Han characters before it."""
    u = table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), F.col("text").alias("source"), F.expr("CASE WHEN doc_id % 4 = 0 THEN concat('已经翻译', text) ELSE text END").alias("target"))
    return R.untranslated_units(u).select("unit_id")


def assessed_units(spark: SparkSession, sf: str) -> DataFrame:
    return R.assess_units(amount_tokens(spark, sf))


def trimmed_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Items as references, parts as the numbers that they cover."""
    li = table(spark, sf, "lineitem").select(F.expr("l_orderkey div 4").alias("claim_id"), F.expr("(l_orderkey % 4) * 10 + l_linenumber").alias("ord"), F.expr("cast(l_suppkey % 5 as string)").alias("token"))
    return E.trim_refs(li, li.select("claim_id", "ord").distinct(), most=4)


def narrowed_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as items; the last sentence of the first is unsupported, in every third draft three are."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("draft_id"), F.col("turn").alias("item"), F.expr("concat(regexp_replace(text, '\\\\s+', ' '), ' Odd claim ', turn, '.')").alias("body"))
    out = c.filter("item = 0 or (draft_id % 3 = 0 and item < 3)").select("draft_id", "item", F.expr("concat(' Odd claim ', item, '.')").alias("sentence"))
    return V.narrow_drafts(c, out).select("draft_id", "item", "narrowed", F.md5("body").alias("digest"))


def assembled_articles(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "conversations").select(F.col("conv_id").alias("issue_date"), F.col("turn").alias("ord"), F.col("role").alias("heading"), F.col("text").alias("body"), F.expr("CASE WHEN turn % 2 = 0 THEN array(concat('- S', turn)) ELSE cast(array() as array<string>) END").alias("sources"))
    return S.assemble_articles(i).select("issue_date", "n_items", F.md5("markdown").alias("digest"))


def repair_items(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("draft_id"), F.col("l_linenumber").alias("item"))
    errors = table(spark, sf, "orders").select(F.col("o_orderkey").alias("draft_id"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'header' WHEN 1 THEN concat('item ', 1 + o_custkey % 4) WHEN 2 THEN '' END").alias("scope"))
    return R.repair_targets(errors, items)


def digest_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Days as runs, events as candidates, purchases as cards and items."""
    e = table(spark, sf, "events").withColumn("run_id", F.to_date("ts").cast("string"))
    c = e.select("run_id", (F.col("value") > 20).alias("deep_read"), (F.col("event_type") != "error").alias("eligible"))
    cards = e.filter("event_type = 'purchase'").select("run_id", (F.col("value") > 30).alias("accepted"), F.col("user_id").alias("card_id"))
    return V.digest_stats(c, cards, cards.filter("accepted").select("run_id", "card_id"))


def text_links(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of pages in prose, in brackets and before marks."""
    t = F.expr("concat('See ', url, ', or (', url, '#a).\\n“', url, '?q=1”')")
    return D.extract_links(table(spark, sf, "pages").select("page_id", t.alias("text")), "page_id", "text")


def markdown_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as Markdown: a heading, the text, a list, a fence, a table row."""
    lines = F.expr("concat('## ', role, '\\n', regexp_replace(text, '[\\\\r\\\\n]+', ' '), '\\n\\n- one\\n- two\\n\\n```\\n# no heading\\n```\\n| a | b |\\n| 1 | 2 |\\n> said')")
    made = S.markdown_blocks(table(spark, sf, "conversations").select(F.expr("conv_id * 1000 + turn").alias("doc_id"), lines.alias("text")))
    return made.select("doc_id", "ord", "type", "level", F.md5("text").alias("digest"))


def list_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as nested lists of their turns, with a formula of several lines between two lists."""
    line = F.expr("concat(repeat('  ', cast(turn % 3 as int)), CASE WHEN turn % 3 = 1 THEN '- ' ELSE concat(turn + 1 + conv_id % 3, CASE WHEN turn % 2 = 1 THEN ') ' ELSE '. ' END) END, 'turn of the ', role, CASE WHEN turn = 3 THEN '\\n$$\\nx + y\\n$$' ELSE '' END)")
    text = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return S.list_numbers(S.markdown_blocks(text)).select("doc_id", "ord", "depth", "ordinal", "delimiter", "list", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


def formulas(spark: SparkSession, sf: str) -> DataFrame:
    """Parts told with inline and display formulas, money, and a formula in code."""
    t = F.expr("concat('Let $x_', p_size, ' = ', p_partkey, '$ and $$y^{', p_size, '}$$ cost $5 and $6, not `$z_1$`.')")
    return S.extract_formulas(table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), t.alias("text")))


def ungrounded_formulas(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    bodies = li.select(F.col("l_orderkey").alias("card_id"), F.col("l_linenumber").alias("n"), F.expr("concat('x_', l_linenumber, ' = ', l_suppkey)").alias("tex"))
    known = li.filter("l_linenumber <> 2").select(F.col("l_orderkey").alias("card_id"), F.expr("concat(' x_', l_linenumber, '=', l_suppkey)").alias("tex"))
    return S.ground_formulas(bodies, known).select("card_id", "n")


def preambles(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as papers: turn 3 is the introduction, the title stands again in even ones."""
    c = table(spark, sf, "conversations")
    b = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.expr("CASE WHEN turn = 3 THEN 'heading' WHEN turn = 1 THEN 'figure' ELSE 'paragraph' END").alias("type"), F.expr("CASE WHEN turn = 3 THEN '1. Introduction' ELSE text END").alias("text"))
    docs = c.filter("turn = 0").select(F.col("conv_id").alias("doc_id"), F.expr("CASE WHEN conv_id % 2 = 0 THEN text ELSE 'another title' END").alias("title"), F.expr("array(left(text, 3), concat('no ', role, ' ', conv_id))").alias("authors"))
    return V.drop_repeated_preamble(b, docs).select("doc_id", "ord")
