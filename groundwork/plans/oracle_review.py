"""SQL, for DuckDB, that checks the queries of page structure, review, drafts and evidence. It holds
its own values."""

from __future__ import annotations

_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


def _shown(x: str) -> str:
    """Markup taken out, line breaks kept as lines."""
    bare = _CLEAN.format(x=f"regexp_replace(regexp_replace({x}, '<br>', chr(10), 'g'), '<[^>]*>', '', 'g')")
    return f"array_to_string(list_filter(list_transform(string_split({bare}, chr(10)), lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g'))), lambda y: y <> ''), chr(10))"


_BLOCKS = f"""(SELECT page_id, h, t, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ord FROM
  (SELECT page_id, i, h, {_shown('raw')} AS t FROM (SELECT page_id, i, ps[i] AS raw, i = 2 AS h FROM (SELECT page_id, ps, unnest(generate_series(1, len(ps))) AS i
    FROM (SELECT page_id, string_split_regex(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?p>|</?h1>') AS ps FROM pages)))) WHERE t <> '')"""
_TURNS = """(SELECT conv_id AS doc_id, turn AS ord, CASE WHEN role = 'user' THEN 'heading' WHEN turn % 5 = 3 THEN 'figure' WHEN role = 'system' THEN 'list_item' ELSE 'paragraph' END AS type,
  CASE WHEN role = 'user' THEN CASE WHEN turn % 4 = 0 THEN 1 ELSE 2 END END AS level, CASE WHEN role = 'user' AND turn = 2 THEN 'References' ELSE text END AS text, CASE WHEN turn % 5 = 3 THEN 'fig ' || turn END AS caption FROM conversations)"""
#: Turn 2 opens a bibliography as a heading of level two, so the next heading of any level closes it.
_BIB = f"""(SELECT t.doc_id, t.ord, CASE WHEN r.ord IS NOT NULL AND t.ord > r.ord AND NOT EXISTS (SELECT 1 FROM {_TURNS} c WHERE c.doc_id = t.doc_id AND c.type = 'heading' AND c.ord > r.ord AND c.ord <= t.ord)
  AND t.type IN ('paragraph', 'list_item') THEN 'reference' ELSE t.type END AS type, t.text FROM {_TURNS} t LEFT JOIN (SELECT doc_id, ord FROM {_TURNS} WHERE text = 'References') r ON r.doc_id = t.doc_id)"""
_NUMBERED = """(SELECT conv_id AS doc_id, turn AS ord, role = 'user' AS h, CASE WHEN role = 'user' THEN 1 + (conv_id + turn) % 3 END AS level,
  CASE WHEN role <> 'user' THEN text WHEN turn = 4 THEN '6. ' || CASE WHEN conv_id % 2 = 0 THEN '参考文献' ELSE 'Bibliography.' END ELSE turn || '. ' || text END AS text FROM conversations)"""


def _siblings(n: int) -> str:
    """Headings of level n since the last one above that level, up to the heading a."""
    return f"""CASE WHEN a.level >= {n} THEN (SELECT count(*) FROM {_NUMBERED} c WHERE c.h AND c.doc_id = a.doc_id AND c.level = {n} AND c.ord <= a.ord
      AND NOT EXISTS (SELECT 1 FROM {_NUMBERED} d WHERE d.h AND d.doc_id = a.doc_id AND d.level < {n} AND d.ord > c.ord AND d.ord <= a.ord)) ELSE 0 END"""


_MISSING = "(SELECT l_orderkey AS sent_id, (1000 + l_partkey % 500)::VARCHAR AS token FROM lineitem)"
_HELD = "(SELECT p_partkey AS excerpt_id, length('No ' || (1000 + p_partkey % 400) || ' and ' || (1000 + p_size) || '.') AS size, (1000 + p_partkey % 400)::VARCHAR AS a, (1000 + p_size)::VARCHAR AS b FROM part)"
_E6 = "(SELECT *, ('t' || user_id) AS tk FROM events)"

SQL: dict[str, str] = {
    "page_structure": f"SELECT page_id, ord::INT AS ord, CASE WHEN h THEN 'heading' ELSE 'paragraph' END AS type, CASE WHEN h THEN 1 END AS level, md5(t) AS digest FROM {_BLOCKS}",
    "page_metadata": f"""SELECT page_id, md5(CASE WHEN page_id % 2 = 0 THEN 'Page ' || page_id ELSE trim(regexp_replace({_CLEAN.format(x="regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '\\s+', ' ', 'g')) END) AS title,
      CASE WHEN page_id % 3 = 0 THEN 'A' || page_id END AS author, CASE page_id % 5 WHEN 0 THEN '2024-01-0' || (1 + page_id % 9) WHEN 1 THEN '2023-12-31' END AS published, NULL::VARCHAR AS modified, page_id % 5 = 0 AS scholarly FROM pages""",
    "table_cells": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus, l_quantity::BIGINT::VARCHAR || '<') - 1 AS i FROM lineitem)
      SELECT l_orderkey AS page_id, i::INT AS row, col, text FROM (SELECT l_orderkey, i, unnest([0, 1, 2, 3, 4]) AS col, unnest([l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_returnflag || l_linestatus, '', l_quantity::BIGINT::VARCHAR]) AS text FROM r)""",
    "inline_fragments": """SELECT conv_id * 1000 + turn AS page_id, '⟦00' || k || '⟧' AS token, CASE k WHEN 1 THEN '[turn ' || turn || '](https://chat.example/t/' || turn || ')' WHEN 2 THEN '[' || (turn + 1) || ']' ELSE 'x_' || turn END AS value,
      CASE k WHEN 1 THEN 'link' WHEN 2 THEN 'citation' ELSE 'math' END AS kind FROM conversations, (SELECT unnest([1, 2, 3]) AS k)""",
    "bibliography": f"SELECT doc_id, ord, type FROM {_BIB}",
    "visual_numbers": f"""SELECT * FROM (SELECT doc_id, ord, type, CASE WHEN type = 'figure' THEN count(*) FILTER (type = 'figure') OVER w WHEN type = 'reference' THEN ord - max(CASE WHEN type <> 'reference' THEN ord END) OVER w END::BIGINT AS number
      FROM {_BIB} WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) WHERE number IS NOT NULL""",
    "section_slices": f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM {_TURNS} WHERE type <> 'figure'), s AS (SELECT doc_id, min(ord) AS a FROM t WHERE type = 'heading' AND contains(lower(text), 'references') GROUP BY 1),
      e AS (SELECT t.doc_id, min(t.ord) AS z FROM t JOIN s USING (doc_id) WHERE t.type = 'heading' AND t.ord > a AND level <= 2 GROUP BY 1)
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1)::INT AS ord, md5(text) AS digest FROM t JOIN s USING (doc_id) LEFT JOIN e USING (doc_id) WHERE ord >= a AND ord < coalesce(z, 1000000)""",
    "paper_main": f"""WITH t AS (SELECT * FROM {_TURNS} WHERE doc_id % 2 = 0), s AS (SELECT doc_id, min(ord) AS a FROM t WHERE text = 'References' GROUP BY 1), e AS (SELECT t.doc_id, min(ord) AS z FROM t JOIN s USING (doc_id) WHERE type = 'heading' AND ord > a GROUP BY 1)
      SELECT doc_id, ord, a IS NOT NULL AS boundary FROM t LEFT JOIN s USING (doc_id) LEFT JOIN e USING (doc_id) WHERE z IS NULL OR ord < z""",
    "flat_documents": f"SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY ord) FILTER (trim(text) <> '')) AS digest FROM {_TURNS} GROUP BY 1",
    "translation_units": f"""SELECT doc_id, 'b' || ord AS unit_id, 'text' AS kind, md5(text) AS digest FROM {_TURNS} WHERE ord <> 1 AND type <> 'figure' UNION ALL SELECT doc_id, 'c' || ord, 'caption', md5(caption) FROM {_TURNS} WHERE ord <> 1 AND type = 'figure'""",
    "translation_completeness": f"""WITH a AS (SELECT doc_id, count(*) FILTER (type = 'figure') AS figures_source, sum(length(text))::BIGINT AS chars_source FROM {_TURNS} GROUP BY 1),
      b AS (SELECT doc_id, count(*) FILTER (type = 'figure') AS figures_target, sum(length(text))::BIGINT AS chars_target FROM {_TURNS} WHERE doc_id % 7 <> 0 AND NOT (doc_id % 2 = 1 AND type = 'figure') GROUP BY 1)
      SELECT doc_id, figures_source, coalesce(figures_target, 0) AS figures_target, chars_source, coalesce(chars_target, 0) AS chars_target, figures_source = coalesce(figures_target, 0) AND coalesce(chars_target, 0) > 0 AS complete FROM a LEFT JOIN b USING (doc_id)""",
    "document_completeness": """WITH b AS (SELECT l_orderkey, bool_or(l_linenumber = 6) AS odd, bool_or(l_linenumber <> 6 AND l_returnflag = 'R') AS seen, sum(length('Item ' || l_linenumber || ' is part ' || l_partkey || ' of supplier ' || l_suppkey || '.')) AS n FROM lineitem GROUP BY 1)
      SELECT o_orderkey AS doc_id, CASE WHEN n IS NULL THEN 'empty' WHEN odd THEN 'unknown-type' WHEN n < 120 AND NOT seen THEN 'too-short' END AS reason FROM orders LEFT JOIN b ON l_orderkey = o_orderkey UNION ALL SELECT -o_orderkey - 1, 'empty' FROM orders""",
    "extraction_coverage": """WITH s AS (SELECT conv_id AS doc_id, count(*) AS wanted, bool_or(turn = 0) AND conv_id % 3 = 0 AS lost, sum(length(text)) AS layer FROM conversations GROUP BY 1),
      t AS (SELECT *, CASE WHEN doc_id % 4 = 1 THEN layer // 5 ELSE layer END AS parsed, CASE WHEN doc_id % 5 = 0 THEN layer // 10 ELSE layer END AS extracted FROM s),
      r AS (SELECT doc_id, list_filter([CASE WHEN lost THEN 'pages' END, CASE WHEN parsed >= 1000 AND extracted < 0.5 * parsed THEN 'blocks-of-parser' END, CASE WHEN layer >= 200 * wanted AND parsed < 0.35 * layer THEN 'parser-of-layer' END,
        CASE WHEN layer >= 200 * wanted AND extracted < 0.25 * layer THEN 'blocks-of-layer' END, CASE WHEN doc_id % 3 < 2 THEN 'images' END], lambda x: x IS NOT NULL) AS rs FROM t)
      SELECT doc_id, array_to_string(rs, ',') AS rules, (5 - len(rs))::INT AS score, len(rs) <= 2 AS accepted FROM r""",
    "page_gaps": """WITH w AS (SELECT l_orderkey AS doc_id, unnest(generate_series(1, max(l_linenumber))) AS page FROM lineitem GROUP BY 1)
      SELECT doc_id, string_agg(page::VARCHAR, ',' ORDER BY page) AS missing FROM w WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = doc_id AND l_linenumber = page AND l_returnflag <> 'R') GROUP BY 1""",
    "output_residue": """SELECT doc_id AS article_id, CASE doc_id % 6 WHEN 0 THEN 'placeholder' WHEN 1 THEN 'object' WHEN 2 THEN 'path' WHEN 3 THEN 'control' ELSE 'tex' END AS rule, CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 1 END::BIGINT AS n FROM documents WHERE doc_id % 6 < 5""",
    "eligible_figures": """WITH f AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_orderkey % 97 AS issue FROM lineitem WHERE l_returnflag <> 'A' AND NOT (l_linestatus = 'F' AND l_linenumber % 3 = 0) AND l_linenumber <> 2 AND l_suppkey % 5 <> 0),
      d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) <= 3) SELECT issue, doc_id, ord FROM d QUALIFY row_number() OVER (PARTITION BY issue ORDER BY doc_id, ord) <= 3""",
    "retracted_documents": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "thread_materials": """WITH u AS (SELECT DISTINCT conv_id AS thread_key, 'https://l.example/' || (turn % 3) AS url FROM conversations WHERE NOT (conv_id % 2 = 0 AND turn % 3 = 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0))
        UNION ALL SELECT DISTINCT conv_id, 'https://f.example/' || (conv_id % 9) || '/' || turn FROM conversations WHERE turn % 2 = 1) SELECT *, count(*) OVER (PARTITION BY thread_key) > 4 AS too_many FROM u""",
    "failure_classes": """SELECT event_id, CASE WHEN user_id % 7 IN (2, 3) THEN 'needs_input' WHEN value > 10 THEN 'needs_review' ELSE 'failed' END AS status,
      user_id % 7 NOT IN (2, 3) AND value <= 10 AND (user_id % 7 IN (0, 1) OR (user_id % 7 = 4 AND event_type = 'view')) AS retryable FROM events""",
    "unusable_pages": """SELECT doc_id, CASE k WHEN 0 THEN 'empty' WHEN 1 THEN 'challenge' ELSE CASE WHEN n = 0 AND k NOT IN (2, 6) THEN 'empty' WHEN k IN (3, 4, 9) OR (k = 6 AND n + 16 < 1500 AND n < 500) OR (k = 7 AND n < 500) THEN 'challenge'
        WHEN k = 2 AND n + 19 < 5000 THEN 'login-wall' WHEN k = 5 AND n < 5000 THEN 'login-page' WHEN (CASE WHEN k = 2 THEN 0 ELSE n END) < 500 AND doc_id % 5 < 3 AND doc_id % 2 = 0 THEN 'client-shell' END END AS reason
      FROM (SELECT doc_id, doc_id % 12 AS k, length(text) AS n FROM documents)""",
    "primary_overlay": """WITH k AS (SELECT DISTINCT page_id % 50 AS base FROM pages ORDER BY 1 LIMIT 35), r AS (SELECT page_id % 40 AS base, max(page_id) AS last FROM pages GROUP BY 1)
      SELECT page_id, CASE WHEN last IS NULL THEN 'found ' || page_id ELSE 'record ' || last END AS title, CASE WHEN last IS NULL THEN '2024-01-01' WHEN last % 3 > 0 THEN '2024-02-' || last END AS dated
      FROM pages LEFT JOIN (SELECT * FROM r SEMI JOIN k USING (base)) r ON page_id % 50 = r.base""",
    "deduplicated_candidates": """WITH RECURSIVE p AS (SELECT page_id AS a, page_id // 2 AS u, CASE WHEN page_id % 5 = 0 THEN page_id // 10 END AS d, CASE WHEN page_id % 7 < 2 THEN page_id // 7 END AS x, (page_id % 3)::INT AS v, page_id % 4 = 1 AS ok, page_id % 6 = 3 AS off,
        CASE WHEN page_id % 2 = 1 THEN '2024-01-' || page_id END AS found, (length(url) + page_id % 13)::INT AS score FROM pages),
      e AS (SELECT l.a AS f, r.a AS t FROM p l JOIN p r ON l.u = r.u UNION SELECT l.a, r.a FROM p l JOIN p r ON l.d = r.d UNION SELECT l.a, r.a FROM p l JOIN p r ON l.x = r.x),
      c AS (SELECT a, a AS t FROM p UNION SELECT c.a, e.t FROM c JOIN e ON c.t = e.f), g AS (SELECT a, min(t) AS entity FROM c GROUP BY 1),
      o AS (SELECT p.*, entity, row_number() OVER (PARTITION BY entity ORDER BY ok DESC, off DESC, v DESC, a) AS r FROM p JOIN g USING (a)),
      m AS (SELECT entity, arg_min(a, r) AS w, arg_min(d, r) AS d, arg_min(found, r) AS found, arg_min(score, r) AS score, string_agg(DISTINCT 'p' || (a % 3), ',' ORDER BY 'p' || (a % 3)) AS providers,
        count(DISTINCT u) + count(DISTINCT d) + count(DISTINCT x) AS n_keys, count(*) AS n_found FROM o GROUP BY 1)
      SELECT 'e' || w AS event_id, '10.1/' || d AS doi, found AS discovery_published_at, score, providers, n_keys, n_found FROM m WHERE w % 11 <> 0 ORDER BY score DESC, 'e' || w LIMIT 100""",
    "collection_health": """WITH s AS (SELECT ts::DATE::VARCHAR AS run_id, event_type || (user_id % 3) AS slot, bool_or(value > 30) AS ok FROM events GROUP BY ALL),
      r AS (SELECT run_id, count(*) FILTER (ok AND slot = 'view0') >= 1 OR count(*) FILTER (ok AND slot IN ('view1', 'view2', 'click0')) >= 2 AS papers, count(*) FILTER (ok AND slot LIKE 'click%') >= 2 AS practice,
        count(*) FILTER (ok AND slot IN ('purchase0', 'purchase1')) >= 2 OR bool_or(ok AND slot = 'error0') AS finance, coalesce(string_agg(slot, ',' ORDER BY slot) FILTER (NOT ok), '') AS failed FROM s GROUP BY 1)
      SELECT *, papers AND practice AS healthy FROM r""",
    "issue_states": """WITH d AS (SELECT unnest(generate_series(DATE '2024-01-07', DATE '2024-02-05', INTERVAL 1 DAY))::DATE AS d)
      SELECT d::VARCHAR AS issue_date, CASE WHEN d IN (SELECT ts::DATE FROM events WHERE event_type = 'purchase') THEN 'done' WHEN d >= DATE '2024-01-30' THEN 'catch-up' ELSE 'expired' END AS state FROM d""",
    "stage_report": """SELECT event_type, count(*) AS n, count(*) FILTER (event_type = 'error' AND value > 5) AS failures, count(*) FILTER (value > 40 OR user_id % 3 > 1) AS retries, round(avg(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END), 6) AS hit_rate, round(quantile_cont(value, 0.95), 6) AS p95, true AS p95_close FROM events GROUP BY 1""",
    "duration_quantiles": "SELECT event_type, q, count(*) AS n, true AS close FROM events, (SELECT unnest([0.05::DOUBLE, 0.5::DOUBLE, 0.95::DOUBLE]) AS q) GROUP BY ALL",
    "notice_receipts": """WITH o AS (SELECT o_orderkey, (1700000000 + o_orderkey * 37 % 400000) * 1000 AS s FROM orders), m AS (SELECT l_orderkey, l_orderkey || '.' || l_linenumber AS ts, (1700000000 + l_orderkey * 37 % 400000) * 1000 - 120000 + l_partkey % 9 * 90000 AS sent
        FROM lineitem WHERE l_suppkey % 7 <> 0 AND l_linenumber NOT IN (3, 4)),
      n AS (SELECT o_orderkey, s, count(DISTINCT ts) AS n, min(ts) AS ts FROM o LEFT JOIN m ON l_orderkey = o_orderkey AND sent BETWEEN s - 60000 AND least(1700300060000, s + 600000) GROUP BY ALL)
      SELECT o_orderkey AS op_id, CASE WHEN s < 1700300000000 - 172800000 THEN 'needs_review' WHEN n = 1 THEN 'sent' WHEN n = 0 AND 1700300000000 < s + 600000 THEN 'pending' ELSE 'needs_review' END AS state,
        CASE WHEN s >= 1700300000000 - 172800000 AND n = 1 THEN ts END AS ts FROM n""",
    "receipts": """WITH n AS (SELECT l_orderkey, count(*) AS n, any_value(l_linenumber) AS x FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)
      SELECT o_orderkey AS op_id, CASE WHEN n = 1 THEN 'resolved' ELSE 'needs_review' END AS status, CASE WHEN n = 1 THEN o_orderkey || '-' || x END AS draft_id FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""",
    "notice_routes": """SELECT event_id, CASE WHEN user_id % 4 <> 0 THEN 'C' || user_id WHEN c_custkey IS NOT NULL THEN 'A' || c_nationkey END AS channel, CASE WHEN user_id % 4 <> 0 THEN event_id::VARCHAR ELSE c_name END AS root
      FROM events LEFT JOIN customer ON user_id % 4 = 0 AND c_custkey = user_id AND c_custkey % 8 = 0""",
    "inherited_evidence": """SELECT c.o_orderkey AS run_id, l_linenumber AS card_id FROM orders c JOIN orders p ON p.o_orderkey = c.o_orderkey - 1 AND p.o_custkey % 3 = c.o_custkey % 3 AND p.o_orderstatus = c.o_orderstatus AND left(p.o_orderpriority, 1) = left(c.o_orderpriority, 1)
      JOIN lineitem ON l_orderkey = p.o_orderkey""",
    "citation_numbers": """WITH b AS (SELECT conv_id * 1000 + turn AS body_id, turn % 4 AS k, 1 + turn % 6 AS s, 1 + conv_id % 6 AS c, 1 + conv_id % 9 AS r, 3 + conv_id % 4 AS most FROM conversations),
      m AS (SELECT body_id, most, k, unnest(CASE k WHEN 0 THEN [s, c] WHEN 1 THEN [r] WHEN 2 THEN [c] ELSE [] END) AS n, unnest(CASE k WHEN 0 THEN [1, 2] WHEN 3 THEN [] ELSE [1] END) AS i FROM b),
      d AS (SELECT body_id, most, k, n, min(i) AS i FROM m GROUP BY ALL), g AS (SELECT body_id, n, row_number() OVER (PARTITION BY body_id ORDER BY i) AS number FROM d WHERE n <= most)
      SELECT body_id, 'S' || n AS source_id, number FROM g UNION ALL SELECT body_id, 'S' || n, 0 FROM d WHERE n > most AND k <> 2
      UNION ALL SELECT body_id, 'S' || n, n FROM (SELECT body_id, unnest(generate_series(1, most)) AS n FROM b WHERE body_id NOT IN (SELECT body_id FROM g))""",
    "excerpt_refs": """SELECT a.l_orderkey * 10 + a.l_linenumber AS claim_id, b.l_shipdate::VARCHAR AS quote, CASE WHEN b.l_orderkey IS NULL THEN 'E' || m.lo || '-E' || m.hi END AS span FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) a
      LEFT JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1) m ON m.l_orderkey = a.l_orderkey""",
    "numeric_gaps": f"""WITH c AS (SELECT sent_id, excerpt_id, any_value(size) AS size, count(DISTINCT token) AS covered FROM {_MISSING} m JOIN {_HELD} h ON token = a OR token = b GROUP BY 1, 2)
      SELECT sent_id, rank, excerpt_id, covered FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY covered DESC, size, excerpt_id)::INT AS rank FROM c) WHERE rank <= 2""",
    "numbers_nowhere": f"SELECT DISTINCT sent_id, token FROM {_MISSING} WHERE token NOT IN (SELECT a FROM {_HELD} UNION ALL SELECT b FROM {_HELD})",
    "dated_months": """WITH t AS (SELECT o_orderkey, o_orderkey % 4 AS k, year(o_orderdate)::VARCHAR AS y, day(o_orderdate)::VARCHAR AS d, month(o_orderdate)::VARCHAR AS m FROM orders),
      x AS (SELECT o_orderkey AS doc_id, unnest(CASE k WHEN 1 THEN [y, m] WHEN 3 THEN [y, d] ELSE [y, d, m] END) AS token FROM t) SELECT doc_id, token, count(*) AS n FROM x GROUP BY ALL""",
    "number_words": """WITH x AS (SELECT p_partkey AS doc_id, unnest(['0', p_size::VARCHAR, '1', '20', '1', '19', '-' || p_size, '-' || p_partkey, p_retailprice::BIGINT::VARCHAR]) AS token FROM (SELECT p_partkey, p_size, trunc(p_retailprice) AS p_retailprice FROM part)) SELECT doc_id, token, count(*) AS n FROM x GROUP BY ALL""",
    "amount_tokens": """WITH f AS (SELECT p_partkey AS unit_id FROM part WHERE p_partkey % 10 = 0) SELECT unit_id, 'NUM:7' AS token, 0 AS n_source, 1 AS n_target, 'warning' AS severity FROM f UNION ALL SELECT p_partkey, 'NUM:12', 0, 1, 'warning' FROM part WHERE p_partkey % 15 = 0""",
    "unmapped_sentences": "SELECT l_orderkey AS body_id, 'Item ' || l_linenumber || ' has ' || l_quantity::BIGINT || ' pieces;' AS sentence FROM lineitem WHERE l_linenumber % 2 = 1",
    "nearest_sentences": """SELECT l_orderkey AS body_id, 'P' || l_linenumber || ' is part of it.' AS sentence, 'P' || l_linenumber || ' is part ' || l_partkey || '.' AS nearest, length('P' || l_linenumber || ' is part ')::INT AS shared FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)""",
    "findings_rollup": """SELECT (user_id % 3)::INT AS pass, event_type AS scope, count(*) FILTER (value > 20) AS high, coalesce(string_agg(DISTINCT CASE WHEN value <= 20 THEN 'r' || (user_id % 5) END, ',' ORDER BY CASE WHEN value <= 20 THEN 'r' || (user_id % 5) END), '') AS warnings FROM events GROUP BY 1, 2""",
    "findings_kinds": """WITH q AS (SELECT DISTINCT event_type, user_id FROM events WHERE value > 60), x AS (SELECT *, event_id % 9 AS k, event_id % 2 = 0 AND (event_id // 9) % 3 <> 0 AS lost FROM events),
      r AS (SELECT *, CASE k WHEN 1 THEN '1 ' || user_id WHEN 3 THEN '3 ' || round(value)::BIGINT || ' ' || user_id WHEN 4 THEN '4 ' || (user_id % 28) ELSE k::VARCHAR END AS said FROM x),
      a AS (SELECT DISTINCT event_type, said FROM r WHERE value > 60)
      SELECT event_id, CASE WHEN k IN (1, 3, 4, 7, 8) AND user_id % 3 > 0 AND NOT (k IN (3, 4) AND lost) AND a.said IS NULL THEN 'deferred' ELSE 'blocking' END AS verdict FROM r LEFT JOIN a USING (event_type, said)""",
    "dropped_spans": """WITH p AS (SELECT p_partkey AS finding_id, 'the ' || p_name || ' of ' || p_type || ' by ' || p_brand || ' is missing' AS f, p_brand || ' makes the ' || p_name || ' of ' || p_type AS b,
        CASE p_partkey % 3 WHEN 0 THEN p_brand || ' makes the ' || p_name WHEN 1 THEN 'the ' || p_type || ' of ' || p_brand ELSE 'it is the ' || p_name || ' of ' || p_type END AS a FROM part),
      s AS (SELECT *, unnest(generate_series(1, length(f) - 7)) AS i FROM p), e AS (SELECT *, unnest(generate_series(i + 7, length(f))) AS j FROM s)
      SELECT finding_id, (i - 1)::INT AS start, f[i:j] AS span FROM e WHERE contains(b, f[i:j]) AND NOT contains(a, f[i:j]) AND (i = 1 OR NOT contains(b, f[i - 1:j])) AND (j = length(f) OR NOT contains(b, f[i:j + 1]))""",
    "term_instructions": """WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS source_term FROM benchmark)
      SELECT conv_id * 1000 + turn AS unit_id, source_term, source_term || 'x' AS target_term FROM (SELECT conv_id, turn, lower(text) AS text FROM conversations) JOIN t ON contains(text, source_term)""",
    "heading_outline": f"""SELECT a.doc_id, a.ord AS open, (SELECT min(b.ord) FROM {_NUMBERED} b WHERE b.h AND b.doc_id = a.doc_id AND b.ord > a.ord AND b.level <= a.level) AS close, a.level::INT AS level,
        array_to_string(list_filter([{_siblings(1)}, {_siblings(2)}, {_siblings(3)}], lambda x: x > 0), '.') AS path FROM {_NUMBERED} a WHERE a.h""",
    "section_scopes": f"""WITH h AS (SELECT *, CASE WHEN ord = 4 THEN 6 ELSE ord END AS n FROM {_NUMBERED} WHERE h), d AS (SELECT DISTINCT doc_id FROM {_NUMBERED}),
      s AS (SELECT doc_id, min(ord) FILTER (CASE doc_id % 5 WHEN 0 THEN n = 2 WHEN 2 THEN ord = 4 WHEN 3 THEN n = 2 ELSE false END) AS a FROM d LEFT JOIN h USING (doc_id) GROUP BY 1),
      e AS (SELECT s.doc_id, a, CASE WHEN s.doc_id % 5 IN (0, 3) THEN min(ord) FILTER (ord >= a AND CASE WHEN s.doc_id % 5 = 0 THEN ord = 4 ELSE n = 1 END) ELSE a END AS b, coalesce(string_agg(text, '；' ORDER BY ord) FILTER (text IS NOT NULL), '无') AS named FROM s LEFT JOIN h ON h.doc_id = s.doc_id GROUP BY s.doc_id, a)
      SELECT e.doc_id, CASE WHEN b IS NOT NULL THEN a END AS open, (SELECT min(x.ord) FROM h x JOIN h y ON y.doc_id = x.doc_id AND y.ord = e.b WHERE x.doc_id = e.doc_id AND x.ord > y.ord AND x.level <= y.level) AS close,
        CASE WHEN a IS NULL THEN 'start' WHEN b IS NULL THEN 'end' END AS error, md5(CASE WHEN a IS NULL OR b IS NULL THEN named END) AS available FROM e""",
    "thread_requests": """WITH c AS (SELECT conv_id, turn, role, text, (conv_id + turn) % 6 AS k, turn > min(turn) OVER (PARTITION BY conv_id) AS later FROM conversations),
      s AS (SELECT conv_id, arg_max({'kind': CASE WHEN k = 3 THEN 'sections' ELSE 'pages' END, 'a': CASE k WHEN 0 THEN 1 + turn ELSE turn END, 'b': CASE k WHEN 0 THEN 2 + turn + conv_id % 5 ELSE turn END}, turn) AS v FROM c WHERE k IN (0, 3) OR (k = 5 AND NOT later AND turn > 0) GROUP BY 1),
      z AS (SELECT conv_id FROM c WHERE k = 5 AND NOT later AND turn = 0),
      t AS (SELECT conv_id, source, arg_max(target, turn) AS target, min(turn) AS at0, any_value(i) AS i FROM (SELECT conv_id, turn, 't' || (conv_id % 3) AS source, 'u' || turn AS target, 0 AS i FROM c WHERE k = 1 UNION ALL SELECT conv_id, turn, 'w', 'v' || turn, 1 FROM c WHERE k = 1) GROUP BY ALL),
      g AS (SELECT conv_id, string_agg(source || '=' || target, ',' ORDER BY at0, i) AS terms FROM t GROUP BY 1),
      o AS (SELECT conv_id, arg_max(role || ' ' || turn, turn) FILTER (k = 2) AS title, bool_or(k = 4) AS refresh,
        md5(coalesce(string_agg(CASE k WHEN 0 THEN '翻译第' || (1 + turn) || '-' || (2 + turn + conv_id % 5) || '页' WHEN 3 THEN '只翻译第' || turn || '节' ELSE trim('第' || turn || '页 ' || regexp_replace(text, '\\s+', ' ', 'g')) END, chr(10) ORDER BY turn) FILTER (k IN (0, 3, 5)), '')) AS body FROM c GROUP BY 1)
      SELECT conv_id, CASE WHEN v IS NOT NULL THEN v.kind WHEN z.conv_id IS NOT NULL THEN 'invalid-pages' ELSE 'auto' END AS kind, coalesce(v.a::VARCHAR, CASE WHEN z.conv_id IS NOT NULL THEN '0' END) AS start, coalesce(v.b::VARCHAR, CASE WHEN z.conv_id IS NOT NULL THEN '0' END) AS end,
        title, coalesce(terms, '') AS terms, refresh, body FROM o LEFT JOIN s USING (conv_id) LEFT JOIN z USING (conv_id) LEFT JOIN g USING (conv_id)""",
    "document_gates": """WITH d AS (SELECT doc_id, doc_id % 5 AS k, doc_id % 110 AS p, text || CASE WHEN doc_id % 5 = 0 AND doc_id % 3 > 0 THEN ' Methodology and References' ELSE '' END AS t FROM documents),
      r AS (SELECT doc_id, CASE WHEN k = 4 THEN 'unknown-kind' WHEN k = 0 AND NOT p BETWEEN 1 AND 100 THEN 'page-count' WHEN k = 0 AND doc_id % 40 = 0 THEN 'encrypted' WHEN length(trim(t)) < CASE k WHEN 0 THEN 1200 WHEN 1 THEN 1500 WHEN 2 THEN 80 ELSE 120 END THEN 'too-short' WHEN length(trim(t)) > 160000 THEN 'too-long'
        WHEN k = 0 AND doc_id % 35 = 0 THEN 'pages-lost' WHEN k = 0 AND doc_id % 3 = 0 THEN 'no-body' WHEN k = 1 AND doc_id % 4 = 1 THEN 'abstract-only' END AS reason FROM d) SELECT doc_id, reason, reason IS NULL AS eligible FROM r""",
    "whole_drafts": """WITH c AS (SELECT conv_id AS draft_id, turn AS item, (conv_id + turn) % 8 AS k, regexp_replace(text, '[0-9<`\\[⟦/]', ' ', 'g') AS t FROM conversations),
      i AS (SELECT *, CASE WHEN item % 5 = 4 THEN NULL WHEN item = 3 AND draft_id % 4 = 0 THEN 'e0' ELSE 'e' || item END AS e, length(regexp_replace(t, '[*_`~#>\\s]', '', 'g')) + CASE k WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 5 WHEN 4 THEN 1 WHEN 5 THEN 12 ELSE 0 END AS size FROM c),
      b AS (SELECT draft_id, count(*) AS n, count(e) - count(DISTINCT e) AS twice, sum(size) + CASE draft_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 6 ELSE 0 END AS size, bool_or(k = 4) AS img, bool_or(k = 5) AS emb, bool_or(k = 3) AS inn, bool_or(k = 2) AS lnk FROM i GROUP BY draft_id)
      SELECT draft_id, item::INT AS item, unnest(list_filter([CASE WHEN e IS NULL OR item % 6 = 5 THEN 'evidence-or-field-missing' END, CASE WHEN item % 4 IN (1, 2) THEN 'heading-not-plain' END, CASE WHEN item % 2 = 0 AND k = 0 THEN 'supplement-as-today' END], lambda x: x IS NOT NULL)) AS rule FROM i
      UNION ALL SELECT draft_id, NULL, unnest(list_filter([CASE WHEN draft_id % 5 IN (0, 2) THEN 'title' END, CASE WHEN draft_id % 5 IN (1, 3) THEN 'title-dated' END, CASE WHEN draft_id % 3 = 2 OR n > 7 THEN 'items' END, CASE WHEN size < CASE WHEN n < 4 THEN n * 300 ELSE 3000 END THEN 'draft-too-short' END,
        CASE WHEN size > 5000 THEN 'draft-too-long' END, CASE WHEN twice > 0 THEN 'event-twice' END, CASE WHEN draft_id % 3 = 1 THEN 'intro-number' END, CASE WHEN img THEN 'image-in-body' END, CASE WHEN emb THEN 'embedded' END, CASE WHEN inn THEN 'inner-mark' END, CASE WHEN lnk THEN 'link-not-verified' END], lambda x: x IS NOT NULL)) FROM b""",
    "list_paths": """WITH i AS (SELECT conv_id AS doc_id, turn + 1 AS n, turn % 3 AS d, CASE WHEN turn % 3 <> 1 THEN turn + 1 + conv_id % 3 END AS o, CASE WHEN turn > 3 THEN 2 ELSE 1 END AS list FROM conversations),
      j AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) + list - 1 AS ord FROM i),
      u AS (SELECT a.doc_id, a.n, k, coalesce((SELECT max(b.n) FROM j b WHERE b.doc_id = a.doc_id AND b.list = a.list AND b.n <= a.n AND b.d < k), -1) AS since FROM j a, (SELECT unnest([0, 1, 2]) AS k) WHERE k <= a.d),
      p AS (SELECT u.doc_id, u.n, k, count(*) + coalesce(arg_min(c.o, c.n) FILTER (c.o IS NOT NULL), 1) - 1 AS v FROM u JOIN j a USING (doc_id, n) JOIN j c ON c.doc_id = u.doc_id AND c.list = a.list AND c.d = k AND c.n > since AND c.n <= u.n GROUP BY ALL)
      SELECT doc_id, ord::INT AS ord, d::INT AS depth, o AS ordinal, CASE WHEN o IS NOT NULL THEN CASE WHEN n % 2 = 0 THEN ')' ELSE '.' END END AS delimiter, list, (SELECT string_agg(v::VARCHAR, '.' ORDER BY k) FROM p WHERE p.doc_id = j.doc_id AND p.n = j.n) AS path FROM j""",
    "review_triage": """WITH u AS (SELECT conv_id * 1000 + turn AS unit_id, conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN ' 7' ELSE '' END AS s, CASE conv_id % 3 WHEN 0 THEN text WHEN 1 THEN text || '。' ELSE left(text, 10) || repeat('。', 60) END AS t FROM conversations),
      n AS (SELECT *, len(regexp_extract_all(s, '[.!?](?:\\s|$)|[。！？]')) AS ns, len(regexp_extract_all(t, '[.!?](?:\\s|$)|[。！？]')) AS nt FROM u),
      r AS (SELECT unit_id, CASE WHEN conv_id % 17 = 0 THEN 'repaired' WHEN conv_id % 13 = 0 THEN 'warnings' WHEN nt < ns THEN 'sentence-loss' WHEN length(s) > 200 AND length(t) < 0.15 * length(s) THEN 'too-short' WHEN turn = 1 THEN 'section'
        WHEN regexp_matches(s, '(?i)(?:^|[^A-Za-z])(?:not|no|never|without|unless|except|only|must)(?:$|[^A-Za-z])|[0-9]') THEN 'risk-words' END AS review_reason FROM n) SELECT * FROM r WHERE review_reason IS NOT NULL""",
    "highlight_lints": """WITH c AS (SELECT conv_id * 1000 + turn AS unit_id, turn % 5 AS k, length(text) AS n FROM conversations)
      SELECT unit_id, 'length' AS rule FROM c WHERE k = 0 OR (k = 1 AND (n < 2 OR n > 64)) UNION ALL SELECT unit_id, 'unbalanced' FROM c WHERE k = 2 UNION ALL SELECT unit_id, 'too-many' FROM c WHERE k = 3
      UNION ALL SELECT unit_id, 'coverage' FROM c WHERE k = 1 OR (k = 0 AND 1 > 0.45 * (n + 2)) OR (k = 3 AND 8 > 0.45 * (n + 12))""",
    "corrected_terms": """WITH a AS (SELECT doc_id, lower(text) AS l, text AS t FROM documents), b AS (SELECT doc_id, l, CASE WHEN contains(l, 'hinre') THEN replace(t, 'the', 'THE') ELSE t END AS t FROM a), c AS (SELECT doc_id, l, CASE WHEN contains(l, 'éau') THEN replace(t, 'la ', 'LA ') ELSE t END AS t FROM b)
      SELECT doc_id AS unit_id, md5(CASE WHEN contains(l, 'the') THEN replace(t, 'and', '&') ELSE t END) AS digest FROM c""",
    "untranslated": """SELECT doc_id AS unit_id FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS letters, len(regexp_extract_all(text, '[A-Za-z]+')) AS words, len(regexp_extract_all(regexp_replace(text, '[A-Za-z]*[a-z][A-Za-z]*', ' \\0 ', 'g'), '[A-Za-z]+')) AS _w,
        len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: regexp_matches(w, '^[A-Z]'))) AS names FROM documents) WHERE letters >= 40 AND names < 0.7 * words AND words >= 10 AND doc_id % 4 <> 0""",
    "assessed_units": """SELECT unit_id, 0::BIGINT AS errors, count(*) AS warnings FROM (SELECT p_partkey AS unit_id FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 15 = 0) GROUP BY 1""",
    "trimmed_refs": """WITH r AS (SELECT l_orderkey // 4 AS claim_id, (l_orderkey % 4) * 10 + l_linenumber AS ord, (l_suppkey % 5) AS token FROM lineitem), f AS (SELECT DISTINCT claim_id, ord FROM (SELECT claim_id, token, min(ord) AS ord FROM r GROUP BY 1, 2)),
      n AS (SELECT d.claim_id, d.ord, f.ord IS NOT NULL AS first, row_number() OVER (PARTITION BY d.claim_id ORDER BY f.ord IS NULL, d.ord) AS k FROM (SELECT DISTINCT claim_id, ord FROM r) d LEFT JOIN f USING (claim_id, ord)) SELECT claim_id, ord FROM n WHERE first OR k <= 4""",
    "narrowed_drafts": """WITH c AS (SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') AS b, ' Odd claim ' || turn || '.' AS s FROM conversations), p AS (SELECT *, length(regexp_replace(regexp_replace(b || s, '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[*_`~#>\\s]', '', 'g')) AS n FROM c),
      k AS (SELECT conv_id, count(*) AS k FROM c WHERE turn = 0 OR (conv_id % 3 = 0 AND turn < 3) GROUP BY 1)
      SELECT conv_id AS draft_id, turn AS item, ok AS narrowed, md5(CASE WHEN ok THEN trim(b) ELSE b || s END) AS digest FROM (SELECT *, (turn = 0 OR (conv_id % 3 = 0 AND turn < 3)) AND coalesce(k, 0) <= 2 AND length(replace(s, ' ', '')) <= 0.15 * n AS ok FROM p LEFT JOIN k USING (conv_id))""",
    "assembled_articles": """SELECT conv_id AS issue_date, count(*) AS n_items, md5(string_agg('## ' || role || chr(10) || chr(10) || trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g')) || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || '- S' || turn ELSE '' END, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1""",
    "repair_items": """SELECT DISTINCT l_orderkey AS draft_id, l_linenumber AS item FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 4 >= 2 OR (o_orderkey % 4 = 1 AND l_linenumber = 1 + o_custkey % 4)""",
    "digest_stats": """SELECT ts::DATE::VARCHAR AS run_id, count(*) AS candidates, count(*) FILTER (value > 20) AS read, count(*) FILTER (value > 20 AND event_type = 'error') AS ineligible, count(*) FILTER (event_type = 'purchase' AND value > 30) AS verified,
      count(DISTINCT user_id) FILTER (event_type = 'purchase' AND value > 30) AS selected, count(DISTINCT user_id) FILTER (event_type = 'purchase' AND value > 30) < 4 AS degraded FROM events GROUP BY 1""",
    "text_links": "SELECT page_id, url FROM pages UNION ALL SELECT page_id, url || '#a' FROM pages UNION ALL SELECT page_id, url || '?q=1' FROM pages",
    "markdown_blocks": """SELECT conv_id * 1000 + turn AS doc_id, k AS ord, ty AS type, CASE WHEN k = 1 THEN 2 END AS level, md5(CASE k WHEN 1 THEN role WHEN 2 THEN regexp_replace(text, '[\\r\\n]+', ' ', 'g') WHEN 3 THEN '- one' WHEN 4 THEN '- two' WHEN 5 THEN '```' || chr(10) || '# no heading' || chr(10) || '```'
      WHEN 6 THEN '| a | b |' || chr(10) || '| 1 | 2 |' ELSE '> said' END) AS digest FROM conversations, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS k, unnest(['heading', 'paragraph', 'list_item', 'list_item', 'code', 'table', 'quote']) AS ty)""",
    "formulas": """SELECT p_partkey AS doc_id, 0 AS n, 'inline' AS kind, 'x_' || p_size || ' = ' || p_partkey AS tex FROM part UNION ALL SELECT p_partkey, 1, 'display', 'y^{' || p_size || '}' FROM part""",
    "ungrounded_formulas": "SELECT a.l_orderkey AS card_id, a.l_linenumber AS n FROM lineitem a WHERE l_linenumber = 2",
    "preambles": """SELECT c.conv_id AS doc_id, c.turn AS ord FROM conversations c LEFT JOIN (SELECT conv_id FROM conversations WHERE turn = 3) i USING (conv_id) WHERE NOT (i.conv_id IS NOT NULL AND c.turn < 3 AND c.turn <> 1 AND c.conv_id % 2 = 0)""",
    "chunks": """WITH RECURSIVE r AS (SELECT doc_id, text AS rest, ''::VARCHAR AS part, 0 AS n FROM documents
        UNION ALL SELECT doc_id, substr(rest, e + 1), substr(rest, 1, e), n + 1 FROM (SELECT *, CASE WHEN length(rest) <= 500 THEN length(rest)
          ELSE CASE WHEN regexp_matches(substr(rest, 251, 250), '[ \\n]') THEN 250 + length(regexp_extract(substr(rest, 251, 250), '(?s)^(.*[ \\n])', 1)) ELSE 500 END END AS e FROM r WHERE rest <> '' OR n = 0))
      SELECT doc_id, count(*) AS parts, sum(length(part))::BIGINT AS size, max(length(part))::INT AS longest FROM r WHERE n > 0 GROUP BY 1""",
    "excerpts": """WITH RECURSIVE p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '(\\n)([^\\n])', '\\1' || chr(1) || '\\2', 'g'), '([.!?。！？]\\s)([A-Z“"‘(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM documents),
      r AS (SELECT doc_id, ps, 1 AS i, ''::VARCHAR AS open, ''::VARCHAR AS done, 0 AS n FROM p
        UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN full_ THEN '' ELSE g END, CASE WHEN full_ THEN g ELSE '' END, CASE WHEN full_ THEN n + 1 ELSE n END FROM (SELECT *, length(trim(regexp_replace(g, '[\\s\\x{00a0}\\x{3000}\\x{feff}]+', ' ', 'g'))) >= 8 AS full_ FROM (SELECT *, open || ps[i] AS g FROM r WHERE i <= len(ps)))),
      d AS (SELECT doc_id, n, done FROM r WHERE done <> ''), l AS (SELECT doc_id, open, n FROM r WHERE i > len(ps) AND open <> '')
      SELECT d.doc_id, d.n::INT AS n, d.done || CASE WHEN l.open IS NOT NULL THEN l.open ELSE '' END AS quote FROM d LEFT JOIN l ON l.doc_id = d.doc_id AND l.n = d.n UNION ALL SELECT doc_id, 1, open FROM l WHERE n = 0""",
}
