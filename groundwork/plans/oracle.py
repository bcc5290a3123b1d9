"""SQL, for DuckDB, that checks the queries over the driver-style tables."""

from __future__ import annotations

CUTOFF, WINDOW, SUPPLEMENT = "2024-01-29 00:00:00", "2024-01-28 00:00:00", "2024-01-22 00:00:00"
DROPPED_PARAMETERS = "(?i)^(utm_|fbclid$|gclid$|ref$|api[_-]?key$|token$|x-amz-|x-goog-)|signature|credential|authorization"
_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def _ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{00a0}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g'))"


_P = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(?:\\?(.*))?$'"
_CANON = f"""(SELECT *, CASE WHEN lower(regexp_extract(bare, {_P}, 1)) IN ('http', 'https') AND regexp_extract(bare, {_P}, 2) <> '' AND NOT contains(regexp_extract(bare, {_P}, 2), '@')
  THEN lower(regexp_extract(bare, {_P}, 1)) || '://' || lower(regexp_extract(bare, {_P}, 2)) || CASE WHEN regexp_extract(bare, {_P}, 3) = '' THEN '/' ELSE regexp_extract(bare, {_P}, 3) END
    || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END END AS canon
  FROM (SELECT *, list_filter(string_split(regexp_extract(bare, {_P}, 4), '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '{DROPPED_PARAMETERS}')) AS ps
        FROM (SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages)))"""
_NUM = "[-+]?(?:\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?)(?:[eE][-+]?\\d+)?"


def _tokens(x: str) -> str:
    """Numbers and number words; the tables' texts tell no months."""
    digits = f"list_transform(regexp_extract_all(regexp_replace(replace({x}, '−', '-'), '(\\d)[-+]', '\\1 ', 'g'), '{_NUM}'), lambda y: ltrim(replace(y, ',', ''), '+'))"
    words = f"list_transform(regexp_extract_all(lower({x}), '\\b(?:{'|'.join(_WORDS)}|single)\\b'), lambda y: CASE WHEN y = 'single' THEN '1' ELSE (list_position({_WORDS}, y) - 1)::VARCHAR END)"
    return f"list_concat({digits}, {words})"


_LINES = "(SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS n FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents))"
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_LINKS = "(SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS url FROM pages)"
_STATUS = f"""(SELECT event_id, CASE WHEN event_type = 'error' THEN 'unverified' WHEN t0 > TIMESTAMP '{CUTOFF}' THEN 'future'
  WHEN CASE WHEN d THEN t0 + INTERVAL 1 DAY > TIMESTAMP '{WINDOW}' ELSE t0 >= TIMESTAMP '{WINDOW}' END THEN 'current'
  WHEN CASE WHEN d THEN t0 + INTERVAL 1 DAY > TIMESTAMP '{SUPPLEMENT}' ELSE t0 >= TIMESTAMP '{SUPPLEMENT}' END THEN 'supplement' ELSE 'old' END AS status
  FROM (SELECT event_id, event_type, event_type = 'view' AS d, CASE WHEN event_type = 'view' THEN date_trunc('day', ts) ELSE ts END AS t0 FROM events))"""


def _has(p: str, n: int) -> str:
    return f"CASE WHEN regexp_matches(t, '{p}') THEN {n} ELSE 0 END"


_FINANCE = (
    "(?i)\\b(financ\\w*|trading|invest\\w*|portfolio|backtest\\w*|econometric\\w*|stocks?|bonds?|forex|cryptocurrenc\\w*|securities)\\b|\\b(?:financial|stock|bond|capital|prediction|equity|commodity|crypto)\\s+markets?\\b"
    "|\\b(?:asset\\s+(?:pricing|allocation)|option\\s+pricing|quantitative\\s+(?:finance|trading|investment))\\b|金融|交易|投资|回测|股票|债券|资产配置|资产定价|量化金融|量化投资|量化交易"
)
_MODELS = "(?i)\\b(LLM|language model|foundation model|agent|transformer|reasoning|generative AI|machine learning)\\b|大模型|语言模型|机器学习|智能体|时序"


def _top(where: str, n: int, slot: int) -> str:
    return f"(SELECT id, score, {slot} AS slot FROM d WHERE {where} ORDER BY score DESC, id LIMIT {n})"


SQL: dict[str, str] = {
    "find_quotes": f"""SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, {_ws('text')} AS q FROM benchmark) b JOIN (SELECT doc_id, {_ws('text')} AS t FROM documents) d ON contains(t, q) WHERE length(q) >= 8""",
    "quote_report": f"""WITH l AS {_LINES}, c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS n, split_part(text, chr(10), 1) AS q, split_part(text, chr(10), 1) AS t FROM documents)
      SELECT CASE WHEN NOT coalesce(length({_ws('q')}) >= 8 AND contains({_ws('l.text')}, {_ws('q')}), false) THEN 'QUOTE_NOT_FOUND'
        WHEN len(list_filter({_tokens('t')}, lambda z: NOT list_contains({_tokens('q')}, z))) > 0 THEN 'NUMERIC_MISMATCH' ELSE 'ACCEPTED' END AS code, count(*) AS n
      FROM c LEFT JOIN l USING (doc_id, n) GROUP BY 1""",
    "evidence_cards": f"""WITH l AS {_LINES}, c AS (SELECT doc_id, n, length({_ws('text')}) >= 8 AS ok FROM l)
      SELECT *, accepted AND verified < proposed AS partial FROM (SELECT doc_id AS card_id, count(*) FILTER (ok) AS verified, count(DISTINCT n) FILTER (ok) AS locators, count(*) AS proposed,
        count(*) FILTER (ok) >= 3 AND count(DISTINCT n) FILTER (ok) >= 2 AND count(*) <= 15 AS accepted FROM c GROUP BY 1)""",
    "canonical_pages": f"SELECT canon AS canonical_url, count(*) AS n_pages, min(page_id) AS first_id FROM {_CANON} WHERE canon IS NOT NULL GROUP BY 1",
    "page_host_profile": """WITH k(profile_id, dom, ord) AS (VALUES ('blogs', 'example.com', 2), ('nets', 'example.net', 3), ('orgs', 'org', 4), ('all-com', 'com', 5)),
      h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host FROM pages)
      SELECT page_id, arg_min(profile_id, ord) AS profile_id FROM h LEFT JOIN k ON host = dom OR ends_with(host, '.' || dom) GROUP BY 1""",
    "event_identities": f"""SELECT page_id, title, canon AS url, CASE WHEN page_id % 3 = 0 THEN 'doi:10.1/' || page_id ELSE 'url:' || sha256(canon) END AS event_id
      FROM (SELECT *, {_ws(_TITLE)} AS title FROM {_CANON}) WHERE canon IS NOT NULL AND title <> ''""",
    "entity_resolution": f"""WITH RECURSIVE p AS (SELECT page_id, regexp_replace(canon, '\\?.*$', '') AS a, {_TITLE} AS t FROM {_CANON}),
      e AS (SELECT x.page_id AS u, y.page_id AS v FROM p x JOIN p y ON x.a = y.a UNION SELECT x.page_id, y.page_id FROM p x JOIN p y ON x.t = y.t),
      r AS (SELECT page_id AS id, page_id AS v FROM p UNION SELECT r.id, e.v FROM r JOIN e ON r.v = e.u)
      SELECT id, min(v) AS entity FROM r GROUP BY id""",
    "page_link_references": f"SELECT url, count(DISTINCT page_id) AS n_sources, min(page_id) AS first_source FROM {_LINKS} GROUP BY url",
    "unverified_links": f"WITH l AS {_LINKS} SELECT page_id, url FROM l WHERE url NOT IN (SELECT url FROM l GROUP BY url HAVING count(DISTINCT page_id) % 3 > 0)",
    "content_duplicates": "SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents",
    "license_gate": "SELECT doc_id, source = 'src0' AND lang <> 'de' AS permitted FROM documents",
    "text_gate": "SELECT doc_id, n BETWEEN 400 AND 20000 AS eligible, CASE WHEN n < 400 THEN 'too-short' WHEN n > 20000 THEN 'too-long' END AS reason FROM (SELECT doc_id, length(trim(text)) AS n FROM documents)",
    "credential_hits": """SELECT doc_id, CASE WHEN doc_id % 7 = 2 THEN 'token' ELSE 'pair' END AS kind, CASE doc_id % 7 WHEN 0 THEN 'token=abc' || doc_id WHEN 1 THEN 'KEY=x-' || doc_id ELSE 'xoxb-1234-' || doc_id END AS hit FROM documents WHERE doc_id % 7 <= 2
      UNION ALL SELECT doc_id, 'pair', unnest(regexp_extract_all(text, '(?i)(?:access_token|appsecret|secret|token|key|password)=[^&\\s]+')) FROM documents""",
    "redacted_docs": """SELECT doc_id, md5(regexp_replace(text, '(?i)(access_token|appsecret|secret|token|key)=([^&\\s]+)', '\\1=[REDACTED]', 'g')
      || CASE doc_id % 7 WHEN 0 THEN ' token=[REDACTED]&a=1' WHEN 1 THEN ' API_KEY=[REDACTED] end' WHEN 2 THEN ' ([REDACTED])' ELSE '' END) AS digest FROM documents""",
    "locators": f"SELECT doc_id, 'L' || n AS locator_id, length(text)::INT AS size FROM {_LINES}",
    "numeric_index": f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents) GROUP BY ALL",
    "number_totals": f"SELECT source, sum(len({_tokens('text')}))::BIGINT AS n FROM documents GROUP BY 1",
    "ungrounded_numbers": f"""SELECT doc_id, token FROM (SELECT DISTINCT doc_id, unnest({_tokens('text')}) AS token FROM documents)
      EXCEPT SELECT doc_id, unnest({_tokens("split_part(text, chr(10), 1)")}) FROM documents""",
    "style_hits": """SELECT doc_id, rule, hit FROM (SELECT doc_id, rule, regexp_extract(text, p) AS hit FROM documents, (VALUES ('insult', 'idiot|scum|trash'), ('loud', '[A-Z]{4,}!!'), ('rights', 'All rights reserved')) r(rule, p)) WHERE hit <> ''""",
    "temporal_status": f"SELECT * FROM {_STATUS}",
    "in_window": f"SELECT status, count(*) AS n FROM {_STATUS} WHERE status NOT IN ('old', 'future') GROUP BY 1",
    "candidate_scores": f"""SELECT doc_id, (CASE s WHEN 'current' THEN 40 WHEN 'supplement' THEN 15 WHEN 'unverified' THEN 5 ELSE -100 END + {_has(_FINANCE, 18)} + {_has(_MODELS, 12)}
        + CASE WHEN regexp_matches(t, '{_FINANCE}') AND regexp_matches(t, '{_MODELS}') THEN 25 ELSE 0 END + {_has('(?i)time.series|forecast|probabilistic|时序|时间序列|预测', 10)}
        + CASE WHEN lang = 'fr' THEN 8 ELSE 0 END + CASE WHEN source = 'src1' THEN 8 ELSE 0 END - {_has('(?i)careers|hiring|webinar|conference registration|招聘|报名', 80)})::INT AS score
      FROM (SELECT doc_id, lang, source, CASE WHEN quality = 1 THEN 'current' WHEN toxic = 1 THEN 'old' ELSE 'unverified' END AS s,
        CASE source WHEN 'src0' THEN 'Forecast of stock returns' WHEN 'src2' THEN 'On asset  pricing' WHEN 'src3' THEN 'Prediction Markets' WHEN 'src4' THEN '量化交易' WHEN 'src5' THEN 'Webinar: hiring' ELSE '' END || ' ' || CASE WHEN lang = 'en' THEN 'A language model' ELSE '' END || ' ' || text AS t
        FROM documents JOIN labels USING (doc_id))""",
    "top_slots": f"""WITH d AS (SELECT doc_id AS id, source, lang, n_chars AS score FROM documents), u AS (SELECT * FROM {_top("lang = 'fr'", 4, 0)} UNION ALL SELECT * FROM {_top("source = 'src0'", 3, 1)}
      UNION ALL SELECT * FROM {_top("source = 'src1'", 3, 2)} UNION ALL SELECT * FROM {_top("lang IN ('de', 'es')", 2, 3)} UNION ALL SELECT * FROM {_top("true", 12, 4)})
      SELECT id, score FROM (SELECT id, any_value(score) AS score, min(slot) AS slot FROM u GROUP BY id) ORDER BY slot, score DESC, id LIMIT 12""",
    "exclude_delivered": """SELECT c_custkey::VARCHAR AS event_id, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND NOT value < 20)""",
    "merge_sources": """WITH b AS (SELECT sha256(text) AS url, 0 AS origin, doc_id AS ord FROM documents UNION ALL SELECT sha256(text), 1, item_id FROM benchmark),
      f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY origin, ord) AS k FROM b) SELECT 'S' || row_number() OVER (ORDER BY origin, ord) AS source_id, origin, ord FROM f WHERE k = 1""",
    "latest_revision": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1",
    "thread_input": """SELECT conv_id, count(*) AS n, md5(string_agg(CASE WHEN k = 1 THEN text ELSE '[follow-up] ' || text END, chr(10) || chr(10) ORDER BY turn)) AS digest
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role <> 'assistant') GROUP BY conv_id""",
    "thread_directives": """SELECT conv_id, arg_max(a, turn) FILTER (a <> '') AS asks, arg_max(e, turn) FILTER (e <> '') AS ends
      FROM (SELECT conv_id, turn, regexp_extract(text, '^(Th[a-z]+)', 1) AS a, regexp_extract(text, '([a-z]+)\\.$', 1) AS e FROM conversations WHERE role = 'user') GROUP BY conv_id""",
    "ancestor_chain": """SELECT c.conv_id * 1000 + c.turn AS id, max(u.conv_id * 1000 + u.turn) AS ancestor, (c.turn - max(u.turn))::INT AS depth
      FROM conversations c JOIN conversations u ON u.conv_id = c.conv_id AND u.turn < c.turn AND u.role = 'user' GROUP BY c.conv_id, c.turn""",
    "unit_context": """SELECT conv_id, turn, md5(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS section,
      md5(left(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 1200)) AS before, md5(left(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), 1200)) AS after FROM conversations""",
    "quota_ledger": """WITH RECURSIVE q AS (SELECT user_id, ts::DATE AS day, event_id, (props->>'$.k')::BIGINT AS units, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS i FROM events),
      r AS (SELECT *, units <= 120 AS allowed, CASE WHEN units <= 120 THEN units ELSE 0 END AS used_after FROM q WHERE i = 1
        UNION ALL SELECT q.*, r.used_after + q.units <= 120, CASE WHEN r.used_after + q.units <= 120 THEN r.used_after + q.units ELSE r.used_after END FROM r JOIN q ON q.user_id = r.user_id AND q.day = r.day AND q.i = r.i + 1)
      SELECT user_id, day::VARCHAR AS day, event_id, units, allowed, used_after FROM r""",
    "issue_windows": "SELECT (ts - INTERVAL 1 HOUR)::DATE::VARCHAR AS issue_date, count(*) AS n FROM events GROUP BY 1",
    "issue_gaps": "SELECT d::DATE::VARCHAR AS issue_date FROM (SELECT unnest(generate_series(DATE '2023-12-20', DATE '2024-02-10', INTERVAL 1 DAY)) AS d) WHERE d::DATE NOT IN (SELECT (ts - INTERVAL 1 HOUR)::DATE FROM events)",
    "next_per_lane": """SELECT lane, id, status FROM (SELECT o_orderpriority AS lane, o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' ELSE 'publishing' END AS status,
      row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate <= TIMESTAMP '1998-01-01') WHERE k = 1""",
    "outbox_page": f"SELECT event_id AS id, ts AS due_at FROM events WHERE event_type NOT IN ('view', 'error') AND ts <= TIMESTAMP '{CUTOFF}' ORDER BY event_id LIMIT 30",
    "audit_tail": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 50",
    "stage_metrics": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1",
    "usage_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS calls, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL",
    "admission_report": "SELECT count(*) FILTER (o_orderstatus = 'O') AS active, 1000000 - count(*) FILTER (o_orderstatus = 'O') AS free FROM orders",
    "pack_batches": """WITH RECURSIVE q AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
      r AS (SELECT conv_id, turn, i, n AS used, 1 AS held, 1::BIGINT AS batch FROM q WHERE i = 1
        UNION ALL SELECT q.conv_id, q.turn, q.i, CASE WHEN r.used + q.n > 700 OR r.held >= 3 THEN q.n ELSE r.used + q.n END, CASE WHEN r.used + q.n > 700 OR r.held >= 3 THEN 1 ELSE r.held + 1 END,
          CASE WHEN r.used + q.n > 700 OR r.held >= 3 THEN r.batch + 1 ELSE r.batch END FROM r JOIN q ON q.conv_id = r.conv_id AND q.i = r.i + 1)
      SELECT conv_id, turn, batch FROM r""",
    "latest_messages": """WITH u AS (SELECT user_id, event_type, event_id, value FROM events WHERE event_type <> 'error' UNION ALL SELECT user_id, event_type, event_id, value FROM events WHERE event_type = 'error' OR value > 50)
      SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM u) WHERE k = 1""",
    "insert_ignore": """WITH b AS (SELECT user_id, 'signup' AS event_type, min(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY 1)
      SELECT * FROM b UNION ALL SELECT user_id, arg_min(event_type, event_id), min(event_id) FROM events WHERE event_type <> 'signup' AND user_id NOT IN (SELECT user_id FROM b) GROUP BY 1""",
    "debounced_threads": """WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
      SELECT user_id, min(ts) AS started, max(ts) AS last_edit, max(ts) + INTERVAL 2 HOUR AS ready_at, count(*) AS n FROM g GROUP BY user_id, k""",
    "diff_blocks": "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'missing' ELSE 'changed' END AS change FROM conversations WHERE role = 'system' OR (turn = 2 AND upper(text) <> text)",
    "fingerprint_reuse": "SELECT doc_id, sha256(lang || chr(31) || text) AS fingerprint, sha256(lang || chr(31) || text) IN (SELECT sha256(lang || chr(31) || text) FROM documents WHERE lang = 'en') AS hit FROM documents",
    "multiset_equivalence": """WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]?')) AS token FROM conversations WHERE turn <= 1)
      SELECT * FROM (SELECT conv_id, token, count(*) FILTER (turn = 0) AS n_source, count(*) FILTER (turn = 1) AS n_target FROM t GROUP BY ALL) WHERE n_source <> n_target""",
    "attempt_budgets": "SELECT user_id, count(*) AS spent, greatest(14 - count(*), 0) AS left, CASE WHEN count(*) < 14 THEN 'retry' ELSE 'stop' END AS next_action FROM events WHERE event_type = 'error' GROUP BY 1",
    "transition_audit": """SELECT user_id, event_id, f AS from_status, event_type AS to_status FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events) WHERE f = 'error' OR (f IS NOT NULL AND event_type = 'signup')""",
    "key_violations": """SELECT 'lineitem key' AS rule, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
      UNION ALL SELECT 'lineitem order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
    "retry_plan": f"""SELECT event_id, TIMESTAMP '{CUTOFF}' + CASE WHEN user_id % 3 = 0 THEN INTERVAL 60 SECOND ELSE INTERVAL 300 SECOND END AS retry_at FROM events
      WHERE event_type = 'error' AND value > 5 AND user_id % 3 < 2 AND ts > TIMESTAMP '{CUTOFF}' - INTERVAL 1 DAY""",
    "recent_reasons": """SELECT event_type, k::INT AS rank, reason FROM (SELECT event_type, reason, row_number() OVER (PARTITION BY event_type ORDER BY last DESC, reason) AS k
      FROM (SELECT event_type, 'user ' || (user_id % 40) AS reason, max(event_id) AS last FROM events GROUP BY ALL)) WHERE k <= 6""",
    "incremental_upsert": "SELECT o_orderkey, o_custkey, o_orderdate::DATE::VARCHAR || ' 00:00:00' AS day, CASE WHEN o_orderkey % 1000 < 6 THEN 2 ELSE 0 END AS version FROM orders WHERE o_custkey % 10 < 9 OR o_orderkey % 1000 < 6",
    "host_counts": "SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1",
    "page_manifest": """SELECT page_id, len(list_filter(b, lambda x: NOT regexp_matches(x, '^<[hH]'))) AS n_paragraphs, len(list_filter(b, lambda x: regexp_matches(x, '^<[hH]'))) AS n_headings
      FROM (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(a, '<(h[1-6]|p|li|blockquote)([ >])', chr(1) || '<\\1\\2', 'g'), chr(1)), lambda y: y), lambda x: regexp_matches(x, '^<(h[1-6]|p|li|blockquote)[ >]')
        AND trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) <> '') AS b FROM (SELECT page_id, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS a FROM pages)) WHERE len(b) > 0""",
    "private_hosts": "SELECT page_id, page_id % 5 = 0 AS private FROM pages",
    "draft_limits": """WITH i AS (SELECT conv_id, turn, role, split_part(text, chr(10), 1) AS h, length(regexp_replace(regexp_replace(text, '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[*_`~#>\\s]', '', 'g')) AS n FROM conversations),
      d AS (SELECT conv_id, count(*) AS k, count(DISTINCT role) AS e, sum(n) AS n FROM i GROUP BY 1),
      r AS (SELECT 'item-too-long' AS rule FROM i WHERE n > 230 UNION ALL SELECT 'heading-missing' FROM i WHERE trim(h) = '' UNION ALL SELECT 'heading-ends-in-stop' FROM i WHERE regexp_matches(h, '[.。!！]\\s*$')
        UNION ALL SELECT 'too-many-items' FROM d WHERE k > 7 UNION ALL SELECT 'event-twice' FROM d WHERE e < k UNION ALL SELECT 'draft-too-short' FROM d WHERE n < CASE WHEN k < 4 THEN k * 300 ELSE 600 END
        UNION ALL SELECT 'draft-too-long' FROM d WHERE n > 1500)
      SELECT rule, count(*) AS n FROM r GROUP BY 1""",
    "frozen_contexts": """SELECT issue_date, cutoff_at, cutoff_at - INTERVAL 24 HOUR AS window_start, cutoff_at - INTERVAL 7 DAY AS supplement_start
      FROM (SELECT (ts - INTERVAL 1 HOUR)::DATE::VARCHAR AS issue_date, min(ts) AS cutoff_at FROM events GROUP BY 1)""",
    "asset_budgets": """SELECT source AS article_id, sum(k)::BIGINT AS n, sum(size)::BIGINT AS bytes, max(size)::BIGINT AS largest, sum(k) <= 50 AND max(size) <= 20000 AND sum(size) <= 200000 AS fits
      FROM (SELECT source, max(length(text)) AS size, count(*) AS k FROM documents GROUP BY source, sha256(text)) GROUP BY 1""",
    "instruction_units": """WITH n AS (SELECT conv_id || '-' || turn AS unit_id, lower(text || chr(10) || coalesce(left(lag(text) OVER w, 1200), '') || chr(10) || coalesce(left(lead(text) OVER w, 1200), '')) AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      SELECT unit_id, s AS source_term, x AS target_term FROM n, (VALUES ('hinre', 'x1'), ('éaument', 'x2')) v(s, x) WHERE contains(t, s) OR contains(t, x)""",
    "retranslation_plan": """SELECT doc_id, ord FROM (SELECT conv_id AS doc_id, turn AS ord, h OR coalesce(lag(h) OVER w, false) OR coalesce(lead(h) OVER w, false) AS near
      FROM (SELECT *, contains(lower(text), 'hinre') OR contains(lower(text), 'éaument') AS h FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE near""",
    "quota_state": """WITH b AS (SELECT event_type AS provider, date_trunc('week', ts) AS s, count(*) AS used FROM events GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY s DESC) AS k FROM b WHERE s <= TIMESTAMP '2024-01-29'),
      d AS (SELECT provider, strftime(s, '%Y-%m-%d') AS period, used, least(500, CASE provider WHEN 'view' THEN 480 WHEN 'click' THEN 470 WHEN 'error' THEN 480 WHEN 'purchase' THEN 420 ELSE 900 END)::BIGINT AS capacity FROM c WHERE k = 1)
      SELECT *, greatest(capacity - used, 0) AS remaining, CASE WHEN capacity <= used THEN 'exhausted' WHEN greatest(capacity - used, 0) * 10 <= capacity THEN 'low' ELSE 'ok' END AS state FROM d""",
}
