"""DuckDB SQL of the catalogue's queries."""

from __future__ import annotations

from .bindings import MODEL, PURGE_AT, RANKS

LOW, WARN, REVIEW = "BAIXO RISCO", "ATENÇÃO", "REVISAR"
DECIDE = f"CASE WHEN {{0}} >= 35 THEN '{REVIEW}' WHEN {{0}} >= 15 THEN '{WARN}' ELSE '{LOW}' END"

BASE = f"""
base AS (
  SELECT doc_id AS id, source AS reference, source || '/' || doc_id AS filename, lang, n_chars, text, sha256(text) AS sha256,
    TIMESTAMP '2024-01-01' + to_hours(doc_id::INT) + INTERVAL 90 DAY AS expires_at, strlen(text) - length(text) AS extra,
    length(text) - length(replace(text, chr(10), '')) AS lines, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS dup
  FROM documents
),
rules AS (
  SELECT id, 0 AS r, 'blur' AS code, 10 AS points, 'baixo' AS severity FROM base WHERE n_chars < 600
  UNION ALL SELECT id, 1, 'resolution', 8, 'baixo' FROM base WHERE n_chars < 300
  UNION ALL SELECT id, 2, 'editing_software', 25, 'alto' FROM base WHERE contains(text, '***') OR contains(text, '###')
  UNION ALL SELECT id, 3, 'nonstandard_quantization', 4, 'baixo' FROM base WHERE extra > 0
  UNION ALL SELECT id, 4, 'field_email', 18, 'alto' FROM base WHERE contains(text, '@')
  UNION ALL SELECT id, 5, 'typography_inconsistent', 10, 'médio' FROM base WHERE contains(text, '!!')
  UNION ALL SELECT id, 6, 'exact_duplicate', 45, 'alto' FROM base WHERE dup
),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r) - 1 AS pos FROM rules),
scored AS (SELECT base.*, s.score, {DECIDE.format('s.score')} AS decision FROM base JOIN (SELECT base.id, least(100, coalesce(sum(points), 0))::BIGINT AS score FROM base LEFT JOIN f USING (id) GROUP BY base.id) s USING (id)),
ev AS (
  SELECT event_id, ts, user_id AS analysis_id, CASE event_type WHEN 'purchase' THEN 'legitimate' WHEN 'error' THEN 'confirmed_fraud' WHEN 'click' THEN 'inconclusive' ELSE 'pending' END AS status,
    json_extract_string(props, '$.k')::BIGINT AS note, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events
),
cur AS (SELECT analysis_id, status, note, version FROM ev QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY version DESC) = 1),
state AS (SELECT scored.*, coalesce(cur.status, 'pending') AS status, coalesce(cur.version, 0) AS version FROM scored LEFT JOIN cur ON analysis_id = id),
ev_rows AS (SELECT s.id, 1 - quality AS label, lang AS kind, reference AS origin, score FROM scored s JOIN labels ON doc_id = s.id),
th AS (
  SELECT score, p1, n1, sum(p1) OVER w AS tp, sum(n1) OVER w AS fp, sum(p1) OVER () AS p, sum(n1) OVER () AS n
  FROM (SELECT score, count(*) FILTER (label = 1) AS p1, count(*) FILTER (label = 0) AS n1 FROM ev_rows GROUP BY score) WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
)
"""

_M = list(zip(MODEL["features"], MODEL["mean"], MODEL["std"], MODEL["coef"]))
PARTS = f""",
model AS (SELECT * FROM (VALUES {', '.join(f"('{f}', {m}::DOUBLE, {s or 1.0}::DOUBLE, {c}::DOUBLE)" for f, m, s, c in _M)}) t(feature, mean, std, coef)),
feats AS (
  SELECT id, 'chars' AS feature, n_chars::DOUBLE AS value FROM base UNION ALL SELECT id, 'extra_bytes', extra FROM base
  UNION ALL SELECT id, 'lines', lines FROM base UNION ALL SELECT id, 'at', 1 FROM base WHERE contains(text, '@')
),
parts AS (SELECT base.id, model.feature, value, coalesce(coef * (value - mean) / std, 0) AS contribution FROM base CROSS JOIN model LEFT JOIN feats ON feats.id = base.id AND feats.feature = model.feature),
logit AS (SELECT id, round(1 / (1 + exp(-m)), 4) AS probability, round_even(100 / (1 + exp(-m)), 0)::BIGINT AS score FROM (SELECT id, sum(contribution) + {MODEL['intercept']} AS m FROM parts GROUP BY id))
"""
RATES = """round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 4) AS fpr, tp + fp AS flagged"""

HASH_MEDIAN = """
h AS (SELECT vec_id AS id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > m THEN 1::HUGEINT << (63 - i) ELSE 0::HUGEINT END)) AS h
  FROM (SELECT vec_id, embedding, list_sort(embedding[2:64])[32] AS m FROM embeddings))
"""
HASH_GRADIENT = """
h AS (SELECT vec_id AS id, list_sum(list_transform(range(63), lambda i: CASE WHEN embedding[i + 2] > embedding[i + 1] THEN 1::HUGEINT << (62 - i) ELSE 0::HUGEINT END)) AS h FROM embeddings)
"""
_WORDS = ", ".join(f"list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > r[{k + 1}] THEN 1::HUGEINT << (63 - i) ELSE 0::HUGEINT END)) AS w{j}" for j, k in enumerate(RANKS))
SHOTS = f"""
plain AS (SELECT vec_id AS v, {_WORDS} FROM (SELECT *, list_sort(embedding[2:64]) AS r FROM embeddings)),
shots AS (
  SELECT v * 3 + j AS id, 'f' || CASE WHEN j = 2 AND v % 5 = 0 THEN v * 3 ELSE v * 3 + j END AS sha256,
    CASE WHEN j = 1 THEN xor(w0, (1::HUGEINT << (v % 62)::INT) | (1::HUGEINT << (v * 7 % 62)::INT)) ELSE w0 END AS w0,
    CASE WHEN j = 2 AND v % 5 <> 0 THEN xor(w1, (1::HUGEINT << (v % 24)::INT) - 1) ELSE w1 END AS w1, w2,
    CASE WHEN j = 1 THEN xor(w3, 1::HUGEINT << (v % 62)::INT) ELSE w3 END AS w3
  FROM plain, range(3) t(j)
),
classes AS (SELECT w0, w1, w2, w3, min(id) AS id FROM shots GROUP BY ALL),
far AS (SELECT x.id AS a, y.id AS b, (bit_count(xor(x.w0, y.w0))::BIGINT + bit_count(xor(x.w1, y.w1)) + bit_count(xor(x.w2, y.w2)) + bit_count(xor(x.w3, y.w3))) AS distance FROM classes x JOIN classes y ON x.id < y.id),
members AS (SELECT s.id, c.id AS first_id FROM shots s JOIN classes c USING (w0, w1, w2, w3)),
priors AS (SELECT id, first_id AS a, 0::BIGINT AS distance FROM members WHERE id > first_id UNION ALL SELECT b, a, distance FROM far WHERE distance <= 32)
"""
GRADIENT_SHOTS = """
g AS (SELECT id * 2 + j AS id, CASE WHEN j = 1 THEN xor(h, (1::HUGEINT << (id % 10)::INT) - 1) ELSE h END AS h FROM h, range(2) t(j)),
gc AS (SELECT h, min(id) AS id FROM g GROUP BY h)
"""
NEAREST = "SELECT id, a AS nearest_id, distance FROM priors WHERE distance <= {0} QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, a) = 1"
RECEIPTS = """
r AS (SELECT *, strftime(o_orderdate, '%d/%m/%Y') AS date FROM orders)
"""
GRID = """
g AS (SELECT p_size AS image, p_partkey AS block, q AS quality,
  ((p_partkey * 7919 + q * 104729) % 97 + 200) / 50.0::DOUBLE * CASE WHEN q = 70 AND p_partkey % 5 <> 0 THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS mse FROM part, range(50, 100, 5) t(q)),
d AS (SELECT * FROM (SELECT image, block, quality, ((lag(mse) OVER w + lead(mse) OVER w) / 2 - mse) / (mse + 0.05::DOUBLE) AS dip FROM g WINDOW w AS (PARTITION BY image, block ORDER BY quality)) WHERE dip IS NOT NULL)
"""


def _b(sql: str, more: str = "") -> str:
    return f"WITH {BASE}{more} {sql}"


ORACLES = {
    "findings_explode": _b("SELECT id, pos, code, points::BIGINT AS points, severity FROM f"),
    "additive_score": _b("SELECT id, score, decision FROM scored"),
    "decision_counts": _b("SELECT decision, count(*) AS n FROM scored GROUP BY decision"),
    "explanation_topk": _b("SELECT id, rank, code, points::BIGINT AS points FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY points DESC, r) - 1 AS rank FROM f) WHERE rank < 3"),
    "pointed_codes": _b("SELECT base.id, coalesce(string_agg(code, ',' ORDER BY r), '-') AS codes FROM base LEFT JOIN f USING (id) GROUP BY base.id"),
    "contribution_topk": _b("SELECT id, rank, feature, round(contribution, 6) AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(contribution) DESC, feature) AS rank FROM parts WHERE value IS NOT NULL AND abs(contribution) > 1e-6) WHERE rank <= 2", PARTS),
    "logistic_score": _b(f"SELECT id, probability, score, {DECIDE.format('score')} AS decision FROM logit", PARTS),
    "max_score": _b(f"SELECT s.id, s.score AS additive, l.score AS logistic, greatest(s.score, l.score) AS score, CASE WHEN s.score >= l.score THEN 'additive' ELSE 'logistic' END AS winner, {DECIDE.format('greatest(s.score, l.score)')} AS decision FROM scored s JOIN logit l USING (id)", PARTS),
    "feature_impute": _b("SELECT feature, round(avg(value), 4) AS mean, round(CASE WHEN sqrt(var_pop(value) * count(value) / (SELECT count(*) FROM base)) < 1e-9 THEN 1 ELSE sqrt(var_pop(value) * count(value) / (SELECT count(*) FROM base)) END, 4) AS std FROM feats GROUP BY feature", PARTS),
    "category_gate": "WITH c AS (SELECT 'lang' AS name, lang AS value FROM documents UNION SELECT 'reference', source FROM documents) SELECT name || '=' || value AS feature FROM c WHERE name IN (SELECT name FROM c GROUP BY name HAVING count(*) BETWEEN 2 AND 8)",
    "onehot_matrix": "WITH c AS (SELECT doc_id AS id, 'lang' AS name, lang AS value FROM documents UNION ALL SELECT doc_id, 'reference', source FROM documents), o AS (SELECT DISTINCT name, value AS option FROM c), k AS (SELECT name FROM o GROUP BY name HAVING count(*) BETWEEN 2 AND 8) SELECT id, name || '=' || option AS feature, CASE WHEN value = option THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM c JOIN o USING (name) JOIN k USING (name)",
    "review_queue": _b(f"SELECT id, reference, score, decision, status, version FROM state WHERE status = 'pending' AND decision IN ('{WARN}', '{REVIEW}') ORDER BY score DESC, id LIMIT 50"),
    "listing_filtered": _b(f"SELECT id, filename, score, decision FROM scored WHERE decision = '{WARN}' AND reference = 'src0' ORDER BY id DESC LIMIT 50"),
    "decision_floor": _b(f"SELECT id, score, decision FROM scored WHERE decision IN ('{WARN}', '{REVIEW}')"),
    "review_versions": _b("SELECT event_id, analysis_id, version, status FROM ev"),
    "current_review": _b("SELECT * FROM cur"),
    "history_page": _b("SELECT analysis_id, version, status, note FROM ev WHERE analysis_id = 7 AND version > 2 ORDER BY version LIMIT 20"),
    "stats_overview": _b(f"SELECT count(*) AS analyses, count(*) FILTER (status <> 'pending') AS reviewed, count(*) FILTER (status = 'confirmed_fraud') AS confirmed, {', '.join(f'''count(*) FILTER (decision = '{d}') AS decision_{i}''' for i, d in enumerate((LOW, WARN, REVIEW)))}, {', '.join(f'''count(*) FILTER (status = '{s}') AS status_{s}''' for s in ('pending', 'confirmed_fraud', 'legitimate', 'inconclusive'))} FROM state"),
    "reversal_rate": _b(f"SELECT count(*) FILTER (status = 'legitimate') AS legitimate, count(*) FILTER (status = 'confirmed_fraud') AS confirmed, round(count(*) FILTER (status = 'legitimate') / nullif(count(*) FILTER (status IN ('legitimate', 'confirmed_fraud')), 0), 4) AS rate FROM state WHERE decision = '{REVIEW}'"),
    "labels_export": _b("SELECT state.id, CASE WHEN status = 'confirmed_fraud' THEN 1 ELSE 0 END::BIGINT AS label, coalesce(string_agg(code, ',' ORDER BY r), '') AS codes FROM state LEFT JOIN f USING (id) WHERE status IN ('confirmed_fraud', 'legitimate') GROUP BY state.id, status"),
    "purge_survivors": _b(f"SELECT id, reference FROM base WHERE expires_at > TIMESTAMP '{PURGE_AT}'"),
    "purge_removed": _b(f"SELECT id FROM base WHERE expires_at <= TIMESTAMP '{PURGE_AT}'"),
    "purge_history": _b(f"SELECT analysis_id, count(*) AS n FROM ev WHERE analysis_id NOT IN (SELECT id FROM base WHERE expires_at <= TIMESTAMP '{PURGE_AT}') GROUP BY analysis_id"),
    "orphan_reviews": _b("SELECT analysis_id, version FROM ev WHERE analysis_id NOT IN (SELECT id FROM base)"),
    "redacted_report": "SELECT doc_id AS id, '' AS ocr_text, source FROM documents",
    "expiry_buckets": _b("SELECT strftime(expires_at, '%Y-%m-%d') AS day, count(*) AS n FROM base GROUP BY day"),
    "grouping_rollup": _b("SELECT lang, decision, count(*) AS n, sum(score)::BIGINT AS points FROM scored GROUP BY ROLLUP (lang, decision)"),
    "exact_duplicates": _b("SELECT sha256, count(*) AS n, min(id) AS first_id FROM base GROUP BY sha256 HAVING count(*) > 1"),
    "first_duplicate": _b("SELECT b.id, first_id, a.reference AS first_reference FROM (SELECT *, min(id) OVER (PARTITION BY sha256) AS first_id FROM base) b JOIN base a ON a.id = first_id WHERE b.id > first_id"),
    "duplicate_top5": _b("SELECT sha256, rank, id FROM (SELECT sha256, id, row_number() OVER (PARTITION BY sha256 ORDER BY id) AS rank, count(*) OVER (PARTITION BY sha256) AS c FROM base) WHERE c > 1 AND rank <= 5"),
    "prior_duplicates": _b("SELECT id, row_number() OVER (PARTITION BY sha256 ORDER BY id) - 1 AS earlier FROM base"),
    "hash_median": f"WITH {HASH_MEDIAN} SELECT id, lpad(lower(hex(h::UBIGINT)), 16, '0') AS hex FROM h",
    "hash_gradient": f"WITH {HASH_GRADIENT} SELECT id, lpad(lower(hex(h::UBIGINT)), 16, '0') AS hex FROM h",
    "hamming_near": f"WITH {SHOTS} SELECT a, b, distance FROM far WHERE distance <= 8",
    "hamming_near_gradient": f"WITH {HASH_GRADIENT}, {GRADIENT_SHOTS} SELECT x.id AS a, y.id AS b, bit_count(xor(x.h, y.h))::BIGINT AS distance FROM gc x JOIN gc y ON x.id < y.id WHERE bit_count(xor(x.h, y.h)) <= 6",
    "hash_members": f"WITH {SHOTS} SELECT id, first_id FROM members",
    "nearest_prior": f"WITH {SHOTS} {NEAREST.format(8)}",
    "nearest_listed": f"WITH {HASH_GRADIENT}, l AS (SELECT n_nationkey AS pos, ('0x' || substr(md5(n_name), 1, 16))::UBIGINT::HUGEINT AS n FROM nation) SELECT id, lpad(lower(hex(n::UBIGINT)), 16, '0') AS nearest, bit_count(xor(h, n))::BIGINT AS distance, bit_count(xor(h, n)) <= 24 AS within FROM h, l QUALIFY row_number() OVER (PARTITION BY id ORDER BY bit_count(xor(h, n)), pos) = 1",
    "duplicate_detail": f"WITH {SHOTS}, near AS ({NEAREST.format(32)}), f AS (SELECT sha256, min(id) AS first FROM shots GROUP BY sha256) SELECT s.id, s.id > first AS exact_duplicate, nearest_id, distance AS nearest_distance, s.id <= first AND coalesce(distance <= 8, false) AS near_duplicate FROM shots s JOIN f USING (sha256) LEFT JOIN near USING (id)",
    "confusion": _b(f"SELECT tp, fp, fn, tn, {RATES} FROM (SELECT count(*) FILTER (label = 1 AND score >= 15) AS tp, count(*) FILTER (label = 0 AND score >= 15) AS fp, count(*) FILTER (label = 1 AND score < 15) AS fn, count(*) FILTER (label = 0 AND score < 15) AS tn FROM ev_rows)"),
    "per_code_metrics": _b(f"SELECT code, tp, fp, fn, tn, {RATES} FROM (SELECT code, tp, fp, p - tp AS fn, n - fp AS tn FROM (SELECT code, count(*) FILTER (label = 1) AS tp, count(*) FILTER (label = 0) AS fp FROM ev_rows JOIN f USING (id) GROUP BY code), (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM ev_rows))"),
    "per_kind": _b("SELECT kind, count(*) AS n, round(avg((score >= 35)::INT), 4) AS at_review, round(avg((score >= 15)::INT), 4) AS at_attention, round(avg(score), 1) AS mean_score FROM ev_rows WHERE label = 1 GROUP BY kind"),
    "per_origin": _b("SELECT origin, count(*) AS n, round(avg((score >= 35)::INT), 4) AS at_review, round(avg((score >= 15)::INT), 4) AS at_attention, round(avg(score), 1) AS mean_score FROM ev_rows WHERE label = 0 GROUP BY origin"),
    "top_codes": _b(", t AS (SELECT kind, code, count(DISTINCT id) AS c, min((id, pos)) AS first FROM ev_rows JOIN f USING (id) GROUP BY kind, code), s AS (SELECT kind, count(*) AS n FROM ev_rows GROUP BY kind), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY c DESC, first) AS r FROM t) SELECT kind, string_agg(code || ' (' || c || '/' || n || ')', ', ' ORDER BY r) AS top FROM k JOIN s USING (kind) WHERE r <= 4 GROUP BY kind"),
    "pr_curve": _b("SELECT score, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM th"),
    "pr_auc": _b("SELECT round(sum(p1 / p * tp / (tp + fp)), 4) AS pr_auc FROM th"),
    "roc_auc": _b("SELECT round(sum((tp - p1 + p1 / 2) * n1) / (max(p) * max(n)), 4) AS roc_auc FROM th"),
    "best_threshold": _b("SELECT threshold, cost FROM (SELECT score::DOUBLE AS threshold, (fp + (p - tp) * 5)::DOUBLE AS cost FROM th UNION ALL SELECT max(score) + 1, max(p) * 5 FROM th) ORDER BY cost, threshold LIMIT 1"),
    "strip_accents_text": "SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents",
    "normalize_text": "SELECT doc_id, md5(trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^0-9a-z]+', ' ', 'g'))) AS digest FROM documents",
    "normalize_code": "SELECT c_custkey, translate(regexp_replace(upper(c_name || ' ' || c_mktsegment), '[^0-9A-Z|]', '', 'g'), 'OQIL|ZSB', '00111258') AS code FROM customer",
    "digit_runs": "SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]{3,}'), ',') AS runs FROM documents",
    "find_dates_numeric": f"WITH {RECEIPTS} SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dates FROM r",
    "find_money": f"WITH {RECEIPTS} SELECT o_orderkey, o_totalprice::DECIMAL(18, 2)::VARCHAR AS amounts FROM r",
    "parse_money_variants": "SELECT o_orderkey, o_totalprice::DECIMAL(18, 2)::VARCHAR AS br, o_totalprice::DECIMAL(18, 2)::VARCHAR AS prefixed, o_totalprice::DECIMAL(18, 2)::VARCHAR AS us, NULL::VARCHAR AS none FROM orders",
    "infer_kind": "SELECT * FROM (VALUES ('data', 'x', 'date'), ('valor total', '1', 'money'), ('nota fiscal', '12', 'code'), ('order', '1', 'number'), ('campo', '04/09/2026', 'date'), ('campo', 'R$ 10,00', 'money'), ('campo', '1.250,00', 'money'), ('campo', '12345', 'number'), ('campo', 'AB-12', 'code'), ('campo', 'Maria Silva', 'text'), ('Código', 'x', 'code'), ('CPF', 'x', 'number')) t(name, value, kind)",
    "digit_confusions": "SELECT p_partkey, 'Pedido ' || CASE WHEN len(regexp_replace('7' || p_partkey || '9', '[01]', '', 'g')) * 2 >= len('7' || p_partkey || '9') THEN '7' || p_partkey || '9' ELSE translate('7' || p_partkey || '9', '01', 'Ol') END || ' OLIVEIRA' AS fixed FROM part",
    "match_field": "SELECT field, kind, matched, conflict, (SELECT count(DISTINCT o_custkey) FROM orders) AS n FROM (VALUES ('data', 'date', true, false), ('valor', 'money', true, false), ('destinatario', 'text', true, false), ('data de emissao', 'date', false, true), ('codigo', 'code', false, false)) t(field, kind, matched, conflict)",
    "match_field_orders": "SELECT field, kind, matched, conflict, (SELECT count(*) FROM orders) AS n FROM (VALUES ('data', 'date', true, false), ('valor', 'money', true, false), ('destinatario', 'text', true, false), ('data de emissao', 'date', false, true), ('codigo', 'code', false, false)) t(field, kind, matched, conflict) UNION ALL SELECT 'pedido', 'number', o_orderkey > 99, o_orderkey <= 99, count(*) FROM orders GROUP BY ALL",
    "typography_outliers": "WITH w AS (SELECT l_orderkey AS line, l_linenumber AS word, l_quantity AS h, l_extendedprice / 1000 AS b, median(l_quantity) OVER (PARTITION BY l_orderkey) AS mh, median(l_extendedprice / 1000) OVER (PARTITION BY l_orderkey) AS mb, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), o AS (SELECT *, (h - mh) / mh AS hd, (b - mb) / mh AS bd FROM w WHERE n >= 3 AND mh > 0), k AS (SELECT *, count(*) OVER (PARTITION BY line) AS c FROM o WHERE abs(hd) >= 0.3 OR abs(bd) >= 0.35) SELECT line, word::BIGINT AS word, round(hd, 9) AS height_dev, round(bd, 9) AS baseline_dev FROM k WHERE c <= n / 2",
    "line_text": "WITH w AS (SELECT conv_id AS doc, turn // 2 AS line, turn, role || ':' || left(text, 20) AS t FROM conversations), l AS (SELECT doc, line, min(turn) AS top, string_agg(t, ' ' ORDER BY turn, t) AS t FROM w GROUP BY ALL) SELECT doc, string_agg(t, chr(10) ORDER BY top, line) AS text FROM l GROUP BY doc",
    "line_text_whole": "WITH w AS (SELECT conv_id AS doc, turn // 2 AS line, turn, role || ':' || text AS t FROM conversations), l AS (SELECT doc, line, min(turn) AS top, string_agg(t, ' ' ORDER BY turn, t) AS t FROM w GROUP BY ALL) SELECT doc, string_agg(t, chr(10) ORDER BY top, line) AS text FROM l GROUP BY doc",
    "ghost_dip": f"WITH {GRID} SELECT image::BIGINT AS image, quality::BIGINT AS quality, round(median(dip), 6) AS median_dip, count(*) AS n FROM d GROUP BY ALL",
    "ghost_candidate": f"WITH {GRID}, ok AS (SELECT image, quality FROM g GROUP BY ALL HAVING median(mse) >= 0.02), m AS (SELECT image, quality, median(dip) AS md FROM d JOIN ok USING (image, quality) GROUP BY ALL), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY image ORDER BY md DESC, quality) = 1), a AS (SELECT image, quality, md, median(abs(dip - md)) AS mad, count(*) AS blocks FROM d JOIN b USING (image, quality) GROUP BY ALL), t AS (SELECT *, least(0.25::DOUBLE * md, md - 1.4826::DOUBLE * mad) AS threshold FROM a) SELECT t.image::BIGINT AS image, t.quality::BIGINT AS quality, round(md, 6) AS median_dip, round(mad, 6) AS mad, round(threshold, 6) AS threshold, count(*) FILTER (dip < threshold) AS suspicious, any_value(blocks) AS blocks FROM t JOIN d USING (image, quality) GROUP BY ALL",
    "shift_clusters": "WITH p AS (SELECT l_linenumber AS image, l_partkey % 200 - 100 AS dx, l_suppkey % 200 - 100 AS dy FROM lineitem), n AS (SELECT image, CASE WHEN dx < 0 OR (dx = 0 AND dy < 0) THEN -dx ELSE dx END AS dx, CASE WHEN dx < 0 OR (dx = 0 AND dy < 0) THEN -dy ELSE dy END AS dy FROM p), b AS (SELECT image, floor(dx / 10)::BIGINT AS bx, floor(dy / 10)::BIGINT AS by_, count(*) AS n FROM n WHERE dx * dx + dy * dy >= 1600 GROUP BY ALL) SELECT x.image::BIGINT AS image, x.bx, x.by_ AS \"by\", x.n, sum(y.n)::BIGINT AS support FROM b x JOIN b y ON x.image = y.image AND abs(x.bx - y.bx) <= 1 AND abs(x.by_ - y.by_) <= 1 GROUP BY ALL HAVING sum(y.n) >= 10",
    "box_iou_hit": "WITH x AS (SELECT l_returnflag, l_partkey % 100 AS x, l_suppkey % 60 AS y, l_quantity::INT + 1 AS w, 20 AS h FROM lineitem), i AS (SELECT *, greatest(0, least(x + w, 70) - greatest(x, 30)) * greatest(0, least(y + h, 45) - greatest(y, 20)) AS inter FROM x) SELECT l_returnflag, count(*) FILTER ((x + w / 2 BETWEEN 30 AND 70 AND y + h / 2 BETWEEN 20 AND 45) OR inter / (w * h + 1000 - inter) >= 0.2) AS hits, count(*) AS n FROM i GROUP BY l_returnflag",
    "tile_statistics": "SELECT l_partkey % 16 AS bx, l_suppkey % 16 AS \"by\", round(avg(l_quantity * l_quantity), 4) AS mse, round(stddev_pop(l_quantity), 4) AS std, round(quantile_cont(l_quantity, 0.95), 4) AS p95 FROM lineitem GROUP BY ALL",
}
