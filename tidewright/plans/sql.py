"""SQL counterparts of the registered queries, for any engine with list functions."""

from __future__ import annotations

from ..operators.scoring import GENERIC

_SPACE = r"\s\p{Z}\x0B\x{85}\x{1C}-\x{1F}"
_GENERIC = ", ".join(f"'{g}'" for g in GENERIC)


def _label(c: str, default: str | None = None) -> str:
    read = f"lower(regexp_replace({c}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'))"
    return read if default is None else f"coalesce({read}, '{default}')"


def _text(cargo: str, commodity: str) -> str:
    return rf"regexp_replace(coalesce({cargo}, '') || ' ' || coalesce({commodity}, ''), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


_UNIT = """
usable AS (
  SELECT shipment_id, confidence_state, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM shipment_classifications
  WHERE len(embedding) = 384 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
unit AS (SELECT shipment_id, confidence_state, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM usable)
"""
_CENTROIDS = """
cent AS (
  SELECT c.name, list_transform(t.centroid, lambda x: CAST(x AS DOUBLE)) AS v FROM category_centroids t
  JOIN classification_categories c ON c.id = t.category_id WHERE c.is_active)
"""
_KEYWORDS = """
kw AS (
  SELECT c.name, lower(k.keyword) AS keyword, coalesce(CAST(k.weight AS DOUBLE), 1.0) AS weight FROM category_keywords k
  JOIN classification_categories c ON c.id = k.category_id WHERE c.is_active AND k.keyword IS NOT NULL),
scoring_kw AS (SELECT kw.* FROM kw WHERE name IN (SELECT name FROM cent)),
total AS (SELECT name, sum(weight) AS total FROM scoring_kw GROUP BY name)
"""


def _req(source: str = "classify_requests") -> str:
    return rf"""
req AS (
  SELECT *, CASE WHEN length(lower(text)) < 10 THEN 'too_short' WHEN lower(text) IN ({_GENERIC}) THEN 'generic' ELSE 'ok' END AS quality
  FROM (SELECT row_number() OVER () AS rid, shipment_id, requested_at, threshold, cargo_description, {_text("cargo_description", "commodity_description")} AS text FROM {source}))
"""


_REQUESTS = _req()
_HITS = "hits AS (SELECT r.rid, r.shipment_id, r.requested_at, k.name, k.keyword, k.weight FROM req r JOIN scoring_kw k ON contains(lower(r.text), k.keyword))"
_FINAL = f"""
{_UNIT}, {_CENTROIDS}, {_KEYWORDS}, {_REQUESTS}, {_HITS},
kws AS (SELECT h.rid, h.name, round(sum(h.weight) / any_value(t.total), 3) AS keyword_score FROM hits h JOIN total t USING (name) GROUP BY h.rid, h.name),
sem AS (SELECT u.shipment_id, c.name, round(list_dot_product(u.v, c.v), 4) AS semantic_score FROM unit u CROSS JOIN cent c),
final AS (
  SELECT r.rid, r.shipment_id, r.requested_at, s.name, s.semantic_score, coalesce(k.keyword_score, 0.0) AS keyword_score,
         round(s.semantic_score * 0.8 + coalesce(k.keyword_score, 0.0) * 0.2, 4) AS final_score
  FROM req r JOIN sem s USING (shipment_id) LEFT JOIN kws k ON k.rid = r.rid AND k.name = s.name WHERE r.quality = 'ok')
"""


def _hashed(name: str, source: str, key: str) -> str:
    """name (key, pos, x): the hashed words of the texts of source at length 1."""
    return rf"""
{name}_w AS (SELECT {key}, unnest(regexp_extract_all(lower(upper(text)), '[\p{{L}}\p{{N}}]+')) AS w FROM {source}),
{name}_h AS (SELECT {key}, CAST('0x' || md5(w)[1:8] AS BIGINT) % 768 AS h FROM {name}_w),
{name}_x AS (SELECT {key}, h // 2 AS pos, sum(CASE WHEN h % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM {name}_h GROUP BY ALL),
{name} AS (SELECT {key}, pos, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS x FROM {name}_x WHERE x <> 0)
"""


_TRAINED = rf"""
picked AS (
  SELECT id, category AS name, text FROM (
    SELECT id, category, text, row_number() OVER (PARTITION BY category ORDER BY md5('7|' || id), id) AS r
    FROM (SELECT id, {_label("category_name")} AS category, {_text("cargo_text", "commodity_text")} AS text FROM shipment_labels WHERE {_label("split", "train")} = 'train')
    WHERE category IN (SELECT name FROM classification_categories WHERE is_active)) WHERE r <= 2000),
{_hashed("train_v", "picked", "id")},
train_s AS (SELECT name, pos, sum(x) AS s FROM train_v JOIN picked USING (id) GROUP BY ALL),
train_n AS (SELECT name, count(*) AS sample_count FROM picked WHERE id IN (SELECT id FROM train_v) GROUP BY name),
cent AS (SELECT name, pos, s / sqrt(sum(s * s) OVER (PARTITION BY name)) AS x FROM train_s)
"""


def _predicted(req: str) -> str:
    """final (rid, ...) of the texts of req by the model that is built from labels."""
    return f"""
{_TRAINED}, {_KEYWORDS}, {req}, {_HITS},
kws AS (SELECT h.rid, h.name, round(sum(h.weight) / any_value(t.total), 3) AS keyword_score FROM hits h JOIN total t USING (name) GROUP BY h.rid, h.name),
{_hashed("req_v", "(SELECT rid, text FROM req WHERE quality = 'ok')", "rid")},
dots AS (SELECT v.rid, c.name, sum(v.x * c.x) AS d FROM req_v v JOIN cent c USING (pos) GROUP BY ALL),
sem AS (
  SELECT rid, name, round(coalesce(d, 0.0), 4) + 0.0 AS semantic_score
  FROM (SELECT DISTINCT rid FROM req_v) CROSS JOIN (SELECT DISTINCT name FROM cent) LEFT JOIN dots USING (rid, name)),
final AS (
  SELECT r.rid, r.shipment_id, r.requested_at, s.name, s.semantic_score, coalesce(k.keyword_score, 0.0) AS keyword_score,
         round(s.semantic_score * 0.8 + coalesce(k.keyword_score, 0.0) * 0.2, 4) AS final_score
  FROM req r JOIN sem s USING (rid) LEFT JOIN kws k ON k.rid = r.rid AND k.name = s.name)
"""


def _banded(threshold: str, floor: str, final: str = _FINAL) -> str:
    return f"""
{final},
top AS (SELECT rid, greatest(0.0, max(final_score)) AS max_score, arg_min(name, (-final_score, name)) AS best FROM final GROUP BY rid),
banded AS (
  SELECT r.rid, r.shipment_id, r.requested_at, t.max_score, t.best, {threshold} AS threshold,
         CASE WHEN t.max_score IS NULL OR t.max_score < {floor} THEN 'unclassified' WHEN t.max_score < {threshold} THEN 'low_confidence' ELSE 'classified' END AS confidence_state,
         CASE WHEN t.max_score IS NULL THEN 'insufficient_input' WHEN t.max_score < {floor} THEN 'low_similarity' END AS reason
  FROM req r LEFT JOIN top t USING (rid)),
over AS (SELECT b.rid, string_agg(f.name, ',' ORDER BY f.name) AS names FROM banded b JOIN final f ON f.rid = b.rid AND f.final_score >= b.threshold WHERE b.confidence_state = 'classified' GROUP BY b.rid)
"""


_OWN = "coalesce(r.threshold, 0.45)"


def _bands(threshold: str = "0.45", floor: str = "0.35", final: str = _FINAL, columns: str = "reason, max_score") -> str:
    return f"""
WITH {_banded(threshold, floor, final)}
SELECT shipment_id, requested_at, confidence_state, {columns},
       CASE confidence_state WHEN 'classified' THEN names WHEN 'low_confidence' THEN best ELSE '' END AS categories
FROM banded LEFT JOIN over USING (rid) WHERE threshold BETWEEN 0 AND 1
"""


def _grouped(split: str) -> str:
    return f"""(SELECT shipment_id, max(cargo_text) AS cargo_description, max(commodity_text) AS commodity_description, list_sort(list(DISTINCT {_label('category_name')})) AS expected,
  NULL::TIMESTAMP AS requested_at, NULL::DOUBLE AS threshold FROM shipment_labels WHERE {_label('split', 'train')} = '{split}' GROUP BY shipment_id)"""


def _pred(split: str, thresholds: str, floor: str = "0.35") -> str:
    return rf"""
{_predicted(_req(_grouped(split)))},
labelled AS (SELECT q.rid AS sample, g.expected FROM req q JOIN {_grouped(split)} g USING (shipment_id)),
topped AS (SELECT rid AS sample, greatest(0.0, max(final_score)) AS top, arg_min(name, (-final_score, name)) AS best, list(name) AS names, list(final_score) AS scores FROM final GROUP BY rid),
cut AS (SELECT unnest([{thresholds}])::DOUBLE AS threshold),
pred AS (
  SELECT l.sample, l.expected, c.threshold,
         CASE WHEN coalesce(t.top, 0.0) < {floor} THEN [] WHEN t.top < c.threshold THEN [t.best]
              ELSE list_transform(list_filter(list_zip(t.names, t.scores), lambda x: x[2] >= c.threshold), lambda x: x[1]) END AS predicted
  FROM labelled l LEFT JOIN topped t USING (sample) CROSS JOIN cut c),
counted AS (
  SELECT threshold, len(list_intersect(predicted, expected)) AS tp, len(list_filter(predicted, lambda x: NOT list_contains(expected, x))) AS fp,
         len(list_filter(expected, lambda x: NOT list_contains(predicted, x))) AS fn FROM pred),
summed AS (SELECT threshold, count(*) AS n_samples, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM counted GROUP BY threshold),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM summed),
swept AS (
  SELECT threshold, n_samples, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1 FROM pr)
"""


_GRID = "0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60"
_SWEEP = _pred("validation", _GRID)
_LAST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY requested_at DESC NULLS LAST, cargo_description DESC NULLS LAST, commodity_description DESC NULLS LAST, coalesce(threshold, 0.45) DESC) AS r
  FROM classify_requests WHERE persist AND coalesce(threshold, 0.45) BETWEEN 0 AND 1) WHERE r = 1)"""
_BUILT = f"""
labelled AS (SELECT shipment_id, unnest(categories) AS name FROM shipment_classifications),
{_UNIT},
flat AS (SELECT l.name, unnest(u.v) AS x, unnest(range(384)) AS pos FROM labelled l JOIN unit u USING (shipment_id) WHERE l.name IS NOT NULL),
summed AS (SELECT name, pos, sum(x) AS s, count(*) AS sample_count FROM flat GROUP BY name, pos),
built AS (SELECT name, sample_count, pos, s / sqrt(sum(s * s) OVER (PARTITION BY name)) AS x FROM summed)
"""
_POINTS = f"{_UNIT}, pts AS (SELECT shipment_id AS id, v FROM unit WHERE {_label('confidence_state', 'classified')} = 'unclassified')"
_DIST = f"{_POINTS}, dist AS (SELECT a.id, b.id AS other, sqrt(greatest(2 - 2 * list_dot_product(a.v, b.v), 0)) AS d FROM pts a JOIN pts b ON a.id <> b.id)"
_CORE = f"{_DIST}, core AS (SELECT id, max(d) AS core FROM (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS r FROM dist) WHERE r <= 5 GROUP BY id)"


def _queue(state: str, columns: str) -> str:
    return f"SELECT {columns} FROM shipment_classifications WHERE {_label('confidence_state', 'classified')} = '{state}'"


SQL: dict[str, str] = {
    "active_centroids": "SELECT t.category_id, c.name, t.sample_count, len(t.centroid) AS dim FROM category_centroids t JOIN classification_categories c ON c.id = t.category_id WHERE c.is_active",
    "active_keywords": f"WITH {_CENTROIDS}, {_KEYWORDS} SELECT name, keyword, weight FROM kw",
    "text_quality": f"WITH {_REQUESTS} SELECT shipment_id, requested_at, text, quality FROM req",
    "keyword_hits": f"WITH {_CENTROIDS}, {_KEYWORDS}, {_REQUESTS}, {_HITS} SELECT shipment_id, requested_at, name, keyword FROM hits",
    "keyword_scores": f"""
WITH {_CENTROIDS}, {_KEYWORDS}, {_REQUESTS}, {_HITS}
SELECT h.shipment_id, h.requested_at, h.name, round(sum(h.weight) / any_value(t.total), 3) AS keyword_score
FROM hits h JOIN total t USING (name) GROUP BY h.rid, h.shipment_id, h.requested_at, h.name HAVING keyword_score > 0""",
    "semantic_scores": f"WITH {_UNIT}, {_CENTROIDS} SELECT u.shipment_id, c.name, round(list_dot_product(u.v, c.v), 4) + 0.0 AS semantic_score FROM unit u CROSS JOIN cent c",
    "blended_scores": f"WITH {_FINAL} SELECT shipment_id, requested_at, name, semantic_score + 0.0 AS semantic_score, keyword_score, final_score + 0.0 AS final_score FROM final",
    "classify_bands": _bands(),
    "classify_bands_tuned": _bands("0.40", "0.20"),
    "classify_batch": _bands(_OWN),
    "predict_batch": _bands(_OWN, final=_predicted(_REQUESTS)),
    "stream_classify": _bands(_OWN, columns="max_score"),
    "request_errors": """
SELECT shipment_id, requested_at, 'cargo_description' AS error FROM classify_requests WHERE cargo_description IS NULL UNION ALL
SELECT shipment_id, requested_at, 'commodity_description' FROM classify_requests WHERE commodity_description IS NULL UNION ALL
SELECT shipment_id, requested_at, 'threshold' FROM classify_requests WHERE NOT threshold BETWEEN 0 AND 1""",
    "persist_results": f"""
WITH {_banded(_OWN, '0.35', _predicted(_req(_LAST)))},
new AS (
  SELECT shipment_id, CASE WHEN rid IN (SELECT rid FROM req_v) THEN 384 ELSE -1 END AS dim,
         CASE confidence_state WHEN 'classified' THEN names WHEN 'low_confidence' THEN best ELSE '' END AS categories,
         CASE WHEN max_score IS NULL THEN 0 ELSE (SELECT count(DISTINCT name) FROM cent) END AS n_scores, confidence_state, reason, CAST(threshold AS DECIMAL(4, 3)) AS threshold_used,
         'enc-384-v2' AS model_version, TIMESTAMP '2026-01-01 00:00:00' AS classified_at
  FROM banded LEFT JOIN over USING (rid))
SELECT shipment_id, dim::INT AS dim, categories, n_scores::INT AS n_scores, confidence_state, reason, threshold_used, model_version, classified_at FROM new UNION ALL
SELECT shipment_id, coalesce(len(embedding), -1)::INT, array_to_string(categories, ','), cardinality(scores)::INT, confidence_state, reason, threshold_used, model_version, classified_at
FROM shipment_classifications WHERE shipment_id NOT IN (SELECT shipment_id FROM new)""",
    "health": f"WITH {_CENTROIDS} SELECT 'ok' AS status, count(*)::INT AS categories_loaded, 'enc-384-v2' AS model_version FROM cent",
    "scores_json": f"""
WITH {_banded('0.45', '0.35')}
SELECT b.shipment_id, b.requested_at, f.name, f.semantic_score + 0.0 AS semantic_score, f.keyword_score, f.final_score + 0.0 AS final_score,
       CASE b.confidence_state WHEN 'classified' THEN f.final_score >= b.threshold WHEN 'low_confidence' THEN f.name = b.best ELSE false END AS matched,
       (SELECT count(*) FROM hits h WHERE h.rid = f.rid AND h.name = f.name)::INT AS hits
FROM banded b JOIN final f USING (rid)""",
    "response_envelope": f"""
WITH {_banded(_OWN, '0.35')}
SELECT b.shipment_id, b.requested_at, q.cargo_description, b.confidence_state, b.threshold, b.reason,
       CASE b.confidence_state WHEN 'classified' THEN (SELECT count(*) FROM final f WHERE f.rid = b.rid AND f.final_score >= b.threshold) WHEN 'low_confidence' THEN 1 ELSE 0 END::INT AS n_categories,
       'enc-384-v2' AS model_version, (SELECT count(*) FROM cent)::INT AS total_categories, '2026-01-01T00:00:00Z' AS classified_at
FROM banded b JOIN req q USING (rid) WHERE b.threshold BETWEEN 0 AND 1""",
    "low_confidence_top1": f"WITH {_banded('0.45', '0.35')} SELECT shipment_id, requested_at, best AS category, max_score FROM banded WHERE confidence_state = 'low_confidence'",
    "multi_label_assign": f"WITH {_banded('0.45', '0.35')} SELECT b.shipment_id, b.requested_at, f.name AS category FROM banded b JOIN final f ON f.rid = b.rid AND f.final_score >= 0.45 WHERE confidence_state = 'classified'",
    "l2_normalise": f"WITH {_UNIT} SELECT shipment_id, unnest(range(384))::INT AS pos, round(unnest(v), 6) + 0.0 AS value FROM unit",
    "centroid_build": f"WITH {_BUILT} SELECT name, sample_count, pos::INT AS pos, round(x, 6) + 0.0 AS value FROM built",
    "centroid_upsert": f"""
WITH {_BUILT}, new AS (SELECT DISTINCT c.id AS category_id, b.sample_count::INT AS sample_count, TIMESTAMP '2026-01-01 00:00:00' AS updated_at FROM built b JOIN classification_categories c USING (name))
SELECT * FROM new UNION ALL SELECT category_id, sample_count, updated_at FROM category_centroids WHERE category_id NOT IN (SELECT category_id FROM new)""",
    "split_assign": "SELECT id, CASE WHEN regexp_matches(shipment_id, '[0-9]*9$') THEN 'test' WHEN regexp_matches(shipment_id, '[0-9]*[78]$') THEN 'validation' ELSE 'train' END AS split FROM shipment_labels",
    "split_distribution": f"SELECT {_label('split', 'train')} AS split, count(*) AS n FROM shipment_labels GROUP BY 1",
    "train_rows_per_category": f"SELECT {_label('category_name')} AS category, count(*) AS n FROM shipment_labels WHERE {_label('split', 'train')} = 'train' GROUP BY 1",
    "sample_per_category": f"""
SELECT category, id, rank FROM (
  SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY md5('7|' || id), id)::INT AS rank
  FROM (SELECT id, {_label('category_name')} AS category FROM shipment_labels WHERE {_label('split', 'train')} = 'train')
  WHERE category IN (SELECT name FROM classification_categories WHERE is_active)) WHERE rank <= 2000""",
    "labels_grouped": f"""
SELECT shipment_id, max(cargo_text) AS cargo_text, max(commodity_text) AS commodity_text, array_to_string(list_sort(list(DISTINCT {_label('category_name')})), ',') AS expected
FROM shipment_labels WHERE {_label('split', 'train')} = 'validation' GROUP BY shipment_id""",
    "csv_label_sets": f"SELECT coalesce(cargo_description, '') AS cargo, coalesce(commodity_description, '') AS commodity, array_to_string(expected, ',') AS expected FROM {_grouped('test')}",
    "centroids_from_labels": f"WITH {_TRAINED} SELECT name, sample_count, pos::INT AS pos, round(x, 6) + 0.0 AS value FROM cent JOIN train_n USING (name) WHERE round(x, 6) <> 0",
    "threshold_sweep": f"WITH {_SWEEP} SELECT * FROM swept",
    "best_threshold": f"WITH {_SWEEP} SELECT threshold, f1 FROM swept ORDER BY f1 DESC, threshold LIMIT 1",
    "sweep_report": f"WITH {_SWEEP} SELECT threshold, printf('%10.2f  %10.4f  %8.4f  %8.4f  %5d  %5d  %5d  %5d', threshold, precision, recall, f1, tp, fp, fn, n_samples) AS line FROM swept",
    "csv_sweep": f"WITH {_pred('test', _GRID)} SELECT * FROM swept",
    "per_category_prf": f"""
WITH {_pred("validation", "0.35, 0.45, 0.55")},
rows_ AS (SELECT threshold, predicted, expected, unnest(list_distinct(list_concat(predicted, expected))) AS category FROM pred),
n AS (SELECT threshold, category, count(*) FILTER (list_contains(predicted, category) AND list_contains(expected, category)) AS tp,
  count(*) FILTER (list_contains(predicted, category) AND NOT list_contains(expected, category)) AS fp, count(*) FILTER (NOT list_contains(predicted, category)) AS fn FROM rows_ GROUP BY ALL)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS recall FROM n""",
    "test_confirmation": f"WITH {_pred('test', '0.45')} SELECT * FROM swept",
    "embed_batches": f"""
WITH texts AS (SELECT id, cargo_text || ' ' || commodity_text AS text FROM shipment_labels WHERE cargo_text IS NOT NULL AND commodity_text IS NOT NULL), {_hashed("v", "texts", "id")}
SELECT id, pos::INT AS pos, round(x, 5) AS value FROM v""",
    "missing_centroids": "SELECT id, name FROM classification_categories WHERE id NOT IN (SELECT category_id FROM category_centroids)",
    "centroid_freshness": "SELECT c.name, t.sample_count, t.updated_at FROM category_centroids t JOIN classification_categories c ON c.id = t.category_id WHERE c.is_active",
    "review_queue": _queue("unclassified", "shipment_id, reason, classified_at"),
    "low_confidence_queue": _queue("low_confidence", "shipment_id, array_to_string(categories, ',') AS categories, classified_at"),
    "contains_all": "SELECT shipment_id, array_to_string(categories, ',') AS categories FROM shipment_classifications WHERE list_has_all(categories, ['circuitry'])",
    "nearest_neighbours": f"""
WITH {_UNIT}, ref AS (SELECT v FROM unit ORDER BY shipment_id LIMIT 1)
SELECT s.shipment_id, round(1 - list_dot_product(u.v, r.v), 6) + 0.0 AS distance FROM shipment_classifications s LEFT JOIN unit u USING (shipment_id) CROSS JOIN ref r
ORDER BY distance NULLS LAST, shipment_id LIMIT 10""",
    "knn_join": f"""
WITH {_UNIT}, pair AS (
  SELECT q.shipment_id AS query_id, x.shipment_id AS neighbour_id, round(list_dot_product(q.v, x.v), 6) AS similarity FROM unit q JOIN unit x ON q.shipment_id <> x.shipment_id
  WHERE CAST(regexp_extract(q.shipment_id, '([0-9]+)$', 1) AS BIGINT) % 20 = 0)
SELECT query_id, neighbour_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id) AS r FROM pair) WHERE r <= 5""",
    "upsert_merge": """
WITH new AS (SELECT shipment_id, 'requested' AS confidence_state, max(requested_at) AS classified_at FROM classify_requests WHERE persist GROUP BY shipment_id)
SELECT * FROM new UNION ALL SELECT shipment_id, confidence_state, classified_at FROM shipment_classifications WHERE shipment_id NOT IN (SELECT shipment_id FROM new)""",
    "insert_ignore": """
SELECT name, display_name FROM classification_categories UNION ALL
SELECT DISTINCT category_name, 'unnamed' FROM shipment_labels WHERE category_name IS NOT NULL AND category_name NOT IN (SELECT name FROM classification_categories)""",
    "seed_keyword_join": """
WITH seed(name, keyword) AS (VALUES ('circuitry', 'oscillators'), ('pantry', 'preserves'), ('pantry', 'cordials'), ('foundry', 'castings'), ('no_such_category', 'nothing')),
new AS (SELECT c.id AS category_id, s.keyword FROM seed s JOIN classification_categories c USING (name))
SELECT category_id, keyword FROM category_keywords UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM category_keywords k WHERE k.category_id = n.category_id AND k.keyword = n.keyword)""",
    "cascade_delete": """
WITH gone AS (SELECT id, name FROM classification_categories WHERE name = 'pantry')
SELECT 'category_keywords' AS table_name, count(*) AS n FROM category_keywords WHERE category_id NOT IN (SELECT id FROM gone) UNION ALL
SELECT 'category_centroids', count(*) FROM category_centroids WHERE category_id NOT IN (SELECT id FROM gone) UNION ALL
SELECT 'shipment_labels', count(*) FROM shipment_labels WHERE category_name IS NULL OR category_name NOT IN (SELECT name FROM gone)""",
    "constraint_violations": """
SELECT 'label_split' AS rule, count(*) AS violations FROM shipment_labels WHERE split NOT IN ('train', 'validation', 'test') UNION ALL
SELECT 'label_text_null', count(*) FROM shipment_labels WHERE cargo_text IS NULL OR commodity_text IS NULL UNION ALL
SELECT 'label_category_unknown', count(*) FROM shipment_labels l WHERE NOT EXISTS (SELECT 1 FROM classification_categories c WHERE c.name = l.category_name) UNION ALL
SELECT 'keyword_repeated', count(*) FROM (SELECT category_id, keyword FROM category_keywords GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL
SELECT 'label_shipment_repeated', count(*) FROM (SELECT shipment_id FROM shipment_labels GROUP BY 1 HAVING count(*) > 1) UNION ALL
SELECT 'classification_state', count(*) FROM shipment_classifications WHERE confidence_state NOT IN ('classified', 'low_confidence', 'unclassified') UNION ALL
SELECT 'classification_vector', count(*) FROM shipment_classifications WHERE len(embedding) <> 384""",
    "row_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("classification_categories", "category_keywords", "category_centroids", "shipment_labels", "shipment_classifications", "classify_requests")
    ),
    "unclassified_vectors": f"WITH {_POINTS} SELECT id AS shipment_id FROM pts",
    "core_distance": f"WITH {_CORE} SELECT id, round(core, 5) AS core FROM core",
    "mutual_reachability": f"WITH {_CORE} SELECT d.id, round(min(round(greatest(d.d, a.core, b.core), 6)), 5) AS reach FROM dist d JOIN core a ON a.id = d.id JOIN core b ON b.id = d.other GROUP BY d.id",
    "category_summary": """
WITH given AS (SELECT shipment_id AS id, coalesce(categories[1], '-1') AS cluster FROM shipment_classifications)
SELECT cluster, count(*) AS size, array_to_string(list(id ORDER BY id)[1:10], ',') AS sample_ids FROM given GROUP BY cluster""",
    "category_hint": f"""
WITH labelled AS (SELECT shipment_id, categories[1] AS cluster FROM shipment_classifications WHERE categories[1] IS NOT NULL), {_UNIT}, {_CENTROIDS},
flat AS (SELECT l.cluster, unnest(u.v) AS x, unnest(range(384)) AS pos FROM labelled l JOIN unit u USING (shipment_id)),
mean AS (SELECT cluster, list(s ORDER BY pos) AS v FROM (SELECT cluster, pos, sum(x) AS s FROM flat GROUP BY ALL) GROUP BY cluster),
sim AS (SELECT m.cluster, c.name, round(list_dot_product(m.v, c.v) / sqrt(list_dot_product(m.v, m.v)), 4) AS s FROM mean m CROSS JOIN cent c),
best AS (SELECT cluster, arg_min(name, (-s, name)) AS nearest, round(max(s), 3) AS similarity FROM sim GROUP BY cluster)
SELECT cluster, nearest, similarity, similarity > 0.80 AS is_variant FROM best""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
