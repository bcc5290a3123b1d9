"""SQL, for DuckDB, with which the queries that SQL can express are checked."""

from __future__ import annotations

_BINS = " ".join(f"WHEN size >= {128 << k} THEN {k} * 128 + (size >> {k})" for k in range(39, 0, -1))

OP1 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS k FROM documents
), c AS (SELECT *, CASE {_BINS} ELSE size END AS bin FROM d
), b AS (SELECT *, k % (1 + floor(sqrt(count(*) OVER (PARTITION BY source, bin)))::BIGINT // 10) AS block FROM c
), s AS (
  SELECT source, sum(size)::HUGEINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, source_size * 2 AS cap, row_number() OVER (ORDER BY source_size * 2 * (10 // w), source NULLS LAST) AS i FROM s
), r AS (
  SELECT *, (sum(source_size) OVER ())::HUGEINT * 150
            - 100 * coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS room,
         (sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS ws FROM o
), f AS (SELECT room, ws FROM r WHERE cap * ws * 100 > room * w ORDER BY i LIMIT 1
), t AS (
  SELECT r.source, r.source_size, CASE WHEN cap * r.ws * 100 <= r.room * w OR f.ws IS NULL THEN cap ELSE f.room * w END AS num,
         CASE WHEN cap * r.ws * 100 <= r.room * w OR f.ws IS NULL THEN 1::HUGEINT ELSE f.ws * 100 END AS den FROM r LEFT JOIN f ON true
), p AS (
  SELECT b.doc_id, b.size, t.source_size, num, num::DOUBLE / den::DOUBLE AS target, den * source_size AS unit,
         (row_number() OVER (PARTITION BY b.source ORDER BY bin DESC, block, b.size DESC, k, doc_id))::HUGEINT AS n,
         (den * source_size * ('0x' || substr(md5('17:' || coalesce(b.source, '')), 1, 8))::BIGINT) // 4294967296 AS u
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       CASE WHEN source_size > 0 THEN size * ((n * num + u) // unit - ((n - 1) * num + u) // unit) ELSE 0 END::BIGINT AS taken FROM p
"""

_HEAD = "'<|' || x.role || '|>' || chr(10)"
_RENDER = f"coalesce(string_agg({_HEAD} || x.text || '<|end|>' || chr(10), '' ORDER BY x.i) FILTER"
_HALF = "array_to_string(string_split(u.text, ' ')[1:len(string_split(u.text, ' ')) // 2], ' ')"
OP2 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'unknown'), coalesce(text, '')) AS i FROM conversations
), l AS (SELECT conv_id, max(i) AS last FROM c WHERE role = 'assistant' GROUP BY conv_id
), u AS (SELECT c.*, l.last FROM c JOIN l USING (conv_id) WHERE c.i <= l.last
), stale AS (
  SELECT conv_id, text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS k FROM u WHERE role = 'assistant') WHERE k = 2
), f AS (SELECT conv_id, min(i) AS first FROM u WHERE role = 'assistant' GROUP BY 1
), x AS (
  SELECT u.conv_id, u.i, u.role, 'chosen' AS side, u.last, u.text FROM u
  UNION ALL
  SELECT u.conv_id, u.i, u.role, 'rejected', u.last,
         CASE WHEN u.conv_id % 2 = 1 THEN CASE WHEN u.i = f.first THEN {_HALF} ELSE u.text END
              WHEN u.i < u.last THEN u.text WHEN s.conv_id IS NOT NULL THEN s.text ELSE {_HALF} END
  FROM u JOIN f USING (conv_id) LEFT JOIN stale s USING (conv_id)
), m AS (
  SELECT a.conv_id, coalesce(min(a.i) FILTER (a.text <> b.text) - 1, max(a.last)) AS n_prefix
  FROM x a JOIN x b ON a.conv_id = b.conv_id AND a.side = 'chosen' AND b.side = 'rejected' AND a.i = b.i GROUP BY 1
), y AS (
  SELECT x.*, m.n_prefix, sum(CASE WHEN x.i > m.n_prefix THEN length({_HEAD}) + length(x.text) + 8 ELSE 0 END) OVER (PARTITION BY x.conv_id, side ORDER BY x.i)::BIGINT AS ends FROM x JOIN m USING (conv_id)
)
SELECT x.conv_id, any_value(x.n_prefix)::BIGINT AS n_prefix,
  {_RENDER} (WHERE side = 'chosen' AND x.i <= x.n_prefix), '') AS prompt,
  {_RENDER} (WHERE side = 'chosen' AND x.i > x.n_prefix), '') AS chosen,
  {_RENDER} (WHERE side = 'rejected' AND x.i > x.n_prefix), '') AS rejected,
  coalesce(string_agg((ends - length(x.text) - 8) || ':' || ends, ',' ORDER BY x.i) FILTER (side = 'chosen' AND x.i > x.n_prefix AND x.role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg((ends - length(x.text) - 8) || ':' || ends, ',' ORDER BY x.i) FILTER (side = 'rejected' AND x.i > x.n_prefix AND x.role = 'assistant'), '') AS rejected_spans
FROM y x GROUP BY x.conv_id
"""

_PHRASES = (
    "all rights reserved|click here|cookie policy|enable javascript|lorem ipsum|privacy policy|read more|share this|sign up|skip to content|subscribe to|terms of service|terms of use|use cookies"
    "|alle rechte vorbehalten|hier klicken|weiterlesen|datenschutzerklärung|javascript aktivieren|verwendet cookies|zum inhalt springen|newsletter abonnieren|nutzungsbedingungen"
    "|tous droits réservés|cliquez ici|lire la suite|politique de confidentialité|activer javascript|utilise des cookies|aller au contenu|conditions d''utilisation"
    "|todos los derechos reservados|haga clic aquí|leer más|política de privacidad|habilitar javascript|utiliza cookies|saltar al contenido|términos de uso"
)


def _marks(chars: str, text: str) -> str:
    return f"(length({text}) - length(translate({text}, '{chars}', '')))"


_N = "(length(x) - length(translate(x, ' ' || chr(9), '')) + 1)"
_BAR = _marks("|»›•·", "x")
_FAILS = (
    f"{_marks('!?#*$%&|<>{}[]~^=_\\@', 'x')} > 0.4::DOUBLE * {_N} OR ({_BAR} >= 3 AND {_BAR} > 0.2::DOUBLE * {_N})"
    f" OR ({_N} >= 4 AND NOT regexp_matches(x, '\\p{{Ll}}') AND regexp_matches(x, '\\p{{Lu}}'))"
    f" OR (len(ls) > 1 AND {_N} >= 12 AND NOT regexp_matches(x, '[.,!?…:;。，！？；：]'))"
    f" OR ({_N} <= 20 AND regexp_matches(lower(x), '{_PHRASES}'))"
)
OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d
), k AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)
), dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM k) WHERE n > 1
), cov AS (SELECT r, count(DISTINCT i + j) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         {_marks('#*$%&|<>', 't')}::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         length(array_to_string(ls, '')) AS whole,
         coalesce(length(array_to_string(list_distinct(list_filter(ls, lambda x: NOT ({_FAILS}))), '')), 0) AS kept_chars
  FROM w LEFT JOIN cov USING (r)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND kept_chars >= 0.5::DOUBLE * whole AS kept FROM b
"""

OP12 = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""

_SHARE = "1 + (1000000000::HUGEINT * (coalesce({n}, 0)::HUGEINT + 2)) // ({total}::HUGEINT + 2 * {terms})"
_APART = "((p - q) * (p - q)) // (p + q)"
OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL
), l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL
), v AS (SELECT lang, count(*) AS terms FROM k GROUP BY lang
), g AS (
  SELECT a.lang, a.source, coalesce(v.terms, 0) AS terms, coalesce(t.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t ON t.lang = a.lang AND t.source = a.source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_SHARE.format(n="c.n", total="g.total", terms="g.terms")} AS p
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT l.lang, l.term, {_SHARE.format(n="l.n", total="s.total", terms="v.terms")} AS q
  FROM l JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY lang) s USING (lang)
), pairs AS (
  SELECT lang, source, item, sum({_APART}) AS value
  FROM (SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source)
  GROUP BY ALL
), rows_ AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, {_APART} FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows_
) WHERE part = 'pair' OR rank <= 10
"""
