"""The mix in SQL, for the same tables."""

from codewarden.llm.mixing import MOST, QUALITY, SEED

MIXED = f"""
WITH marks AS (
  SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id
),
found AS (
  SELECT d.doc_id, d.source,
    len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(d.doc_id::VARCHAR || ':{SEED}'), 1, 13))::BIGINT::DOUBLE + 0.5)
      / 4503599627370496.0)
      / CASE m.quality WHEN 1 THEN {QUALITY[1]}::DOUBLE WHEN 0 THEN {QUALITY[0]}::DOUBLE
             ELSE {QUALITY[None]}::DOUBLE END AS key
  FROM documents d LEFT JOIN marks m ON m.doc_id = d.doc_id
),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM found GROUP BY source),
caps AS (
  SELECT *, {MOST} * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
      WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sizes
),
levels AS (
  SELECT *,
    (SELECT sum(source_size) FROM sizes) - coalesce(sum(cap) OVER (
      ORDER BY cap / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
  FROM caps
),
level AS (
  SELECT rest::DOUBLE AS rest, heavy::DOUBLE AS heavy FROM levels
  WHERE cap * heavy > rest * weight ORDER BY heavy DESC LIMIT 1
),
goals AS (
  SELECT l.source, l.source_size,
    CASE WHEN l.cap * l.heavy <= l.rest * l.weight THEN l.cap::DOUBLE
         ELSE v.rest * l.weight / v.heavy END AS target
  FROM levels l LEFT JOIN level v ON true
),
placed AS (
  SELECT f.*, g.source_size, g.target,
    coalesce(floor(g.target / nullif(g.source_size, 0)), 0)::BIGINT AS epochs,
    sum(f.size) OVER (PARTITION BY f.source ORDER BY f.key, f.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - f.size / 2.0 AS middle
  FROM found f JOIN goals g ON g.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (size * (epochs + CASE WHEN middle <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT
    AS taken
FROM placed
"""
