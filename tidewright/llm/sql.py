"""SQL counterparts of the pN_ queries that SQL can express."""

_SPACE = r"\s\p{Z}\x0B\x{85}\x{1C}-\x{1F}"
_WORD = r"\p{L}\p{N}_"


def _canonical(c: str) -> str:
    return rf"regexp_replace(lower(upper({c})), '[\p{{P}}{_SPACE}]+', '', 'g')"


_KEYED = rf"""
keyed AS (
  SELECT id, split, source, least(a, b) AS x, greatest(a, b) AS y
  FROM (SELECT id, split, source, {_canonical("cargo_text")} AS a, {_canonical("commodity_text")} AS b FROM shipment_labels
        WHERE regexp_matches(cargo_text, '[^{_SPACE}]') AND regexp_matches(commodity_text, '[^{_SPACE}]')))
"""

_DEMAND = rf"""
have AS (
  SELECT coalesce(lower(trim(split, E' \t\r\n')), 'train') AS split, lower(trim(category_name, E' \t\r\n')) AS category, count(*) AS available
  FROM shipment_labels GROUP BY ALL),
size AS (SELECT split, CAST(sum(available) AS BIGINT) // 5 AS sample_size FROM have GROUP BY ALL),
demand AS (
  SELECT t.split, t.category_name, coalesce(s.sample_size, 0) AS sample_size, coalesce(h.available, 0) AS available,
         greatest(CAST(ceil(t.target_share * CAST(coalesce(s.sample_size, 0) AS DECIMAL(12, 0))) AS BIGINT), coalesce(t.min_rows, 0)) AS asked
  FROM sample_targets t LEFT JOIN size s ON s.split = lower(trim(t.split))
  LEFT JOIN have h ON h.split = lower(trim(t.split)) AND h.category = lower(trim(t.category_name)))
"""

_OVERLAPS = rf"""
{_KEYED},
sided AS (
  SELECT id, coalesce(lower(trim(k.split, E' \t\r\n')), 'train') AS split, k.source, x, y, e.n, e.elements
  FROM keyed k JOIN (
    SELECT id, sum(c)::BIGINT AS n, list(w || '#' || j) AS elements
    FROM (SELECT id, w, c, unnest(range(c)) AS j FROM (
      SELECT id, w, count(*) AS c FROM (
        SELECT id, unnest(regexp_extract_all(lower(upper(cargo_text || ' ' || commodity_text)), '[\p{{L}}\p{{N}}]+')) AS w FROM shipment_labels) GROUP BY ALL))
    GROUP BY id) e USING (id)),
sizes AS (SELECT id, count(*) AS n FROM (SELECT id, unnest(elements) FROM sided) GROUP BY id),
element AS (SELECT s.id, s.split, z.n, unnest(s.elements) AS w FROM sided s JOIN sizes z USING (id)),
pair AS (
  SELECT e.id AS e, t.id AS t FROM element e JOIN element t ON e.w = t.w AND e.split IN ('validation', 'test') AND t.split = 'train'
  GROUP BY e.id, t.id, e.n, t.n HAVING 4 * count(*) >= 3 * greatest(e.n, t.n)
  UNION
  SELECT e.id, t.id FROM sided e JOIN sided t ON e.x = t.x AND e.y = t.y AND e.split IN ('validation', 'test') AND t.split = 'train')
"""

_COSINES = """
usable AS (
  SELECT shipment_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM shipment_classifications
  WHERE len(embedding) = 384 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
unit AS (SELECT shipment_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM usable),
cosines AS (
  SELECT a.shipment_id, b.shipment_id AS neighbour_id, round(list_dot_product(a.v, b.v), 6) AS similarity
  FROM unit a JOIN unit b ON a.shipment_id <> b.shipment_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY similarity DESC, neighbour_id) AS r FROM cosines)
"""

SQL = {
    "p1_found": f"WITH {_COSINES} SELECT shipment_id, neighbour_id FROM ranked WHERE r <= 10 AND similarity >= 0.8",
    "p4_found": f"WITH {_OVERLAPS} SELECT least(e, t) AS id_a, greatest(e, t) AS id_b FROM pair",
    "p3_found": f"""
WITH {_KEYED}
SELECT rep_id, id FROM (SELECT id, min(id) OVER (PARTITION BY x, y) AS rep_id FROM keyed) WHERE id <> rep_id
""",
    "p3_records": f"WITH {_KEYED} SELECT min(id) AS rep_id, count(*) AS copies FROM keyed GROUP BY x, y",
    "p5_found": f"WITH {_DEMAND} SELECT DISTINCT split, category_name FROM demand WHERE available < asked",
    "p5_report": f"""
WITH {_DEMAND}
SELECT split, category_name, sample_size, available, asked, least(asked, available) AS drawn, greatest(asked - available, 0) AS shortfall, CAST(0 AS BIGINT) AS residual
FROM demand
""",
    "p6_found": rf"""
SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[{_WORD}]+|[^{_WORD}{_SPACE}]+')) > 1024
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
