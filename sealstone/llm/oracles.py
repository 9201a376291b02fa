"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NON_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(column: str) -> str:
    return f"list_filter(string_split_regex({LOWER.format(f'coalesce({column}, {chr(39)*2})')}, '{NON_WORD}'), lambda x: x <> '')"


OP1 = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(w) AS m, array_to_string(w, ' ') AS k FROM b WHERE len(w) BETWEEN 1 AND 12
  UNION
  SELECT DISTINCT item_id, 13, array_to_string(w[i:i+12], ' ') FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM b WHERE len(w) >= 13)
),
sizes AS (SELECT DISTINCT m FROM win),
occ AS (
  SELECT doc_id, m, i, array_to_string(w[i:i+m-1], ' ') AS k
  FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)
),
hit AS (SELECT doc_id, o.m, i, item_id FROM occ o JOIN win USING (m, k)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
  ) GROUP BY doc_id
),
base AS (
  SELECT doc_id, lang, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper_, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digit_,
    length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS wide_,
    length(regexp_replace(t, '[^!"''()+,./:;=?@\[\\\]^_`{}~-]', '', 'g')) AS point_, length(t) AS chars
  FROM d
),
shorts AS (SELECT lang, x, count(*) AS c FROM (SELECT lang, unnest(w) AS x FROM d) WHERE length(x) <= 5 GROUP BY ALL),
common AS (SELECT lang, x, r FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, x) AS r FROM shorts) WHERE r <= 24),
hits AS (SELECT doc_id, lang, r, count(*) AS c FROM (SELECT doc_id, lang, unnest(w) AS x FROM d) JOIN common USING (lang, x) GROUP BY ALL),
bins AS (
  SELECT doc_id, lang, 'w' AS kind, r AS b, c::DOUBLE AS c FROM hits
  UNION ALL SELECT doc_id, lang, 'w', 25, n_words - coalesce((SELECT sum(c) FROM hits h WHERE h.doc_id = base.doc_id), 0) FROM base
  UNION ALL SELECT doc_id, lang, 'c', 1, upper_ FROM base UNION ALL SELECT doc_id, lang, 'c', 2, digit_ FROM base
  UNION ALL SELECT doc_id, lang, 'c', 3, n_symbols FROM base UNION ALL SELECT doc_id, lang, 'c', 4, point_ FROM base
  UNION ALL SELECT doc_id, lang, 'c', 5, wide_ FROM base UNION ALL SELECT doc_id, lang, 'c', 6, chars - word_chars FROM base
  UNION ALL SELECT doc_id, lang, 'c', 7, word_chars - upper_ - digit_ - n_symbols - point_ - wide_ FROM base
),
own AS (SELECT doc_id, lang, kind, b, c / nullif(sum(c) OVER (PARTITION BY doc_id, kind), 0) AS p FROM bins),
ref AS (SELECT lang, kind, b, sum(c) / nullif(sum(sum(c)) OVER (PARTITION BY lang, kind), 0) AS q FROM bins GROUP BY lang, kind, b),
size AS (SELECT lang, sum(n_words) AS n FROM base GROUP BY lang),
js AS (
  SELECT doc_id, kind, sqrt(greatest(sum(
    (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)) AS js
  FROM (
    SELECT x.doc_id, ref.kind, coalesce(p, 0) AS p, q FROM (SELECT DISTINCT doc_id, lang FROM base) x JOIN ref USING (lang)
    LEFT JOIN own ON own.doc_id = x.doc_id AND own.kind = ref.kind AND own.b = ref.b
  ) GROUP BY ALL
),
far AS (SELECT doc_id, max(CASE WHEN kind = 'c' THEN js > 0.35 ELSE js > 0.47 END) AS far FROM js GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(again.n, 0) > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * coalesce(again.n, 0) > 50 * n_words) AND NOT (coalesce(far, false) AND size.n >= 5000) AS kept
FROM base JOIN size USING (lang) LEFT JOIN again USING (doc_id) LEFT JOIN far USING (doc_id)
"""

#: Texts as hexadecimal digits, two a byte; every 200-byte window by its MD5.
OP2 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
part AS (SELECT rid, n, b, substr(h, 2 * b + 1, 910) AS x FROM (SELECT rid, n, h, unnest(range(0, n - 199, 256)) AS b FROM d WHERE n >= 200)),
w AS (SELECT rid, b + q AS p, md5_number(substr(x, 2 * q + 1, 400)) AS k FROM (SELECT rid, b, x, unnest(range(0, least(256, n - 199 - b))) AS q FROM part)),
again AS (SELECT rid, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
edge AS (SELECT rid, p, CASE WHEN p - lag(p) OVER (PARTITION BY rid ORDER BY p) <= 200 THEN 0 ELSE 1 END AS s FROM again),
span AS (SELECT rid, min(p) AS lo, max(p) + 200 AS hi FROM (SELECT rid, p, sum(s) OVER (PARTITION BY rid ORDER BY p) AS g FROM edge) GROUP BY rid, g),
cut AS (SELECT rid, lo, hi, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) AS since FROM span),
kept AS (
  SELECT rid, sum(hi - lo)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS h
  FROM cut JOIN d USING (rid) GROUP BY rid
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

OP4 = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS total, role, text FROM conversations
),
p AS (SELECT conv_id, n, total, string_agg(md5(role || chr(0) || text), '') OVER (PARTITION BY conv_id ORDER BY n) AS h FROM t),
whole AS (SELECT n, h, min(conv_id) AS conv_id, count(*)::BIGINT AS copies FROM p WHERE n = total GROUP BY n, h),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n < p.total AND p.n = w.n AND p.h = w.h))
SELECT conv_id, k.n::BIGINT AS n_turns, copies,
  string_agg('<|im_start|>' || role || chr(10) || regexp_replace(text, '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') || '<|im_end|>' || chr(10), '' ORDER BY t.n) AS rendered
FROM kept k JOIN t USING (conv_id) GROUP BY conv_id, k.n, copies
"""

ORACLES = {"op1_decontaminate": OP1, "op2_suffix": OP2, "op4_chat": OP4, "op7_quality": OP7}
