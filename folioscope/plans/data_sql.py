"""SQL of the core training-data queries, written against the tables alone."""

from __future__ import annotations


def _entries(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'OBJECT' THEN [{x}] WHEN 'VARCHAR' THEN [{x}] ELSE []::JSON[] END"


_TREE = f"""
raw AS (SELECT record_id, CAST(main_body AS JSON) AS j FROM manuscripts WHERE main_body IS NOT NULL),
once AS (SELECT record_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CAST(j ->> '$' AS JSON) ELSE j END AS j FROM raw),
body AS (SELECT record_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CAST(j ->> '$' AS JSON) ELSE j END AS j FROM once),
tree(record_id, relation, parent_path, node_path, v) AS (
  SELECT record_id, 'section', 'root', 's' || i, v FROM (
    SELECT record_id, unnest({_entries("j")}) AS v, generate_subscripts({_entries("j")}, 1) - 1 AS i FROM body) WHERE json_type(v) <> 'NULL'
  UNION ALL
  SELECT record_id, relation, node_path, node_path || '.' || step || i, v FROM (
    SELECT record_id, k.relation AS relation, node_path, k.step AS step, unnest({_entries("x")}) AS v, generate_subscripts({_entries("x")}, 1) - 1 AS i FROM (
      SELECT record_id, node_path, k, k.x AS x FROM (
        SELECT record_id, node_path, unnest([{{'relation': 'section', 'step': 's', 'x': v -> '$.subsections'}}, {{'relation': 'paragraph', 'step': 'p', 'x': v -> '$.paragraphs'}}]) AS k
        FROM tree WHERE relation = 'section' AND json_type(v) = 'OBJECT'))) WHERE json_type(v) <> 'NULL'),
front AS (SELECT record_id, 'a' || i AS node_path, v FROM (SELECT record_id, unnest(abstract) AS v, generate_subscripts(abstract, 1) - 1 AS i FROM manuscripts) WHERE v IS NOT NULL),
texts AS (SELECT record_id, node_path AS parent_path, node_path || '.p' || i AS node_path, v FROM (
  SELECT record_id, node_path, unnest(v.paragraphs) AS v, generate_subscripts(v.paragraphs, 1) - 1 AS i FROM front) WHERE v IS NOT NULL)
"""

P1_FOUND = f"""
WITH RECURSIVE {_TREE}
SELECT 'manuscript' AS record_kind, record_id, parent_path, node_path FROM tree
UNION ALL SELECT 'manuscript', record_id, 'root', node_path FROM front
UNION ALL SELECT 'manuscript', record_id, parent_path, node_path FROM texts
UNION ALL SELECT DISTINCT 'report', report_id, 'root', unnest(map_keys(preservation_checks)) FROM verification_reports
"""

P1_CHECKS = """
SELECT report_id, e.key AS check_name, max(e.value) AS result
FROM (SELECT report_id, unnest(map_entries(preservation_checks)) AS e FROM verification_reports) GROUP BY ALL
"""


def _key(x: str) -> str:
    return f"nullif(lower(regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '')"


_REFS = f"""
refs AS (
  SELECT DISTINCT ref_table, row_key, ref_field, target, {_key("v")} AS ref_value, t FROM (
    SELECT 'citations' AS ref_table, citation_id AS row_key, 'reference_ids' AS ref_field, 'b' AS target, unnest(reference_ids) AS v, recorded_at AS t FROM citations
    UNION ALL SELECT 'profile_rules', rule_key, 'source_id', 's', (p).source_id, t FROM (SELECT rule_key, unnest(provenance) AS p, recorded_at AS t FROM profile_rules)
    UNION ALL SELECT 'profile_rules', rule_key, 'evidence_id', 'e', (p).evidence_id, t FROM (SELECT rule_key, unnest(provenance) AS p, recorded_at AS t FROM profile_rules)
    UNION ALL SELECT 'verification_reports', report_id, 'profile_id', 'p', profile_id, verified_at FROM verification_reports
    UNION ALL SELECT 'profiles', profile_key, 'profile_id', 'p', (p).profile_id, t FROM (SELECT profile_key, unnest(parents) AS p, received_at AS t FROM profiles)
  ) WHERE {_key("v")} IS NOT NULL),
known AS (
  SELECT 'b' AS target, {_key("reference_id")} AS k, received_at, deleted_at FROM bib_references
  UNION ALL SELECT 's', {_key("source_id")}, received_at, deleted_at FROM source_records
  UNION ALL SELECT 'e', {_key("evidence_id")}, received_at, deleted_at FROM evidence_records
  UNION ALL SELECT 'p', {_key("profile_id")}, received_at, deleted_at FROM profiles),
judged AS (
  SELECT ref_table, row_key, ref_field, ref_value, t, count(k) AS n, count(*) FILTER (received_at <= t) AS n_there,
         count(*) FILTER (received_at <= t AND (deleted_at IS NULL OR deleted_at > t)) AS n_valid
  FROM refs LEFT JOIN known ON known.target = refs.target AND known.k = refs.ref_value GROUP BY ALL),
found AS (
  SELECT DISTINCT ref_table, row_key, ref_field, ref_value, strftime(t, '%Y-%m') AS period,
         CASE WHEN n = 0 THEN 'missing' WHEN n_there = 0 THEN 'late' ELSE 'deleted' END AS state
  FROM judged WHERE n = 0 OR n_valid = 0)
"""
P2_FOUND = f"WITH {_REFS} SELECT * FROM found"
P2_REPORT = f"""
WITH {_REFS} SELECT ref_table, ref_field, period, state, count(*) AS n_references, count(DISTINCT row_key) AS n_rows, count(DISTINCT ref_value) AS n_keys FROM found GROUP BY ALL
"""

P3_FOUND = """
WITH rows AS (SELECT feed_id, file_seq, CAST(payload AS JSON) AS j FROM profile_feed WHERE json_valid(payload)),
objects AS (SELECT * FROM rows WHERE json_type(j) = 'OBJECT'),
entries AS (
  SELECT feed_id, file_seq, j ->> '$.rule_id' AS rule, f AS field, json_extract(j, '$."' || f || '"') AS v
  FROM (SELECT *, unnest(json_keys(j)) AS f FROM objects)),
seen AS (
  SELECT feed_id, file_seq, rule, field, CAST(v AS VARCHAR) AS value,
    CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS type
  FROM entries),
files AS (SELECT feed_id, file_seq, lag(file_seq) OVER (PARTITION BY feed_id ORDER BY file_seq) AS prev FROM (SELECT DISTINCT feed_id, file_seq FROM seen)),
fields AS (SELECT feed_id, file_seq, field, list_sort(list(DISTINCT type) FILTER (type IS NOT NULL)) AS types FROM seen GROUP BY ALL),
old AS (SELECT f.feed_id, f.file_seq, field, types FROM files f JOIN fields x ON x.feed_id = f.feed_id AND x.file_seq = f.prev),
new AS (SELECT f.feed_id, f.file_seq, field, types FROM files f JOIN fields x ON x.feed_id = f.feed_id AND x.file_seq = f.file_seq WHERE f.prev IS NOT NULL),
gone AS (SELECT feed_id, file_seq, field FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.feed_id = old.feed_id AND new.file_seq = old.file_seq AND new.field = old.field)),
come AS (SELECT feed_id, file_seq, field FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE new.feed_id = old.feed_id AND new.file_seq = old.file_seq AND new.field = old.field)),
pairs AS (
  SELECT g.feed_id, g.file_seq, g.field AS a, c.field AS b
  FROM gone g JOIN come c ON c.feed_id = g.feed_id AND c.file_seq = g.file_seq JOIN files f ON f.feed_id = g.feed_id AND f.file_seq = g.file_seq
  JOIN seen x ON x.feed_id = g.feed_id AND x.file_seq = f.prev AND x.field = g.field AND x.type IS NOT NULL
  JOIN seen y ON y.feed_id = g.feed_id AND y.file_seq = g.file_seq AND y.field = c.field AND y.type IS NOT NULL AND y.rule = x.rule
  GROUP BY ALL HAVING bool_and(x.value = y.value))
SELECT feed_id, file_seq, 'renamed' AS change, a AS old_field, b AS new_field FROM pairs
UNION ALL SELECT feed_id, file_seq, 'removed', field, '' FROM gone WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.feed_id = gone.feed_id AND p.file_seq = gone.file_seq AND p.a = gone.field)
UNION ALL SELECT feed_id, file_seq, 'added', '', field FROM come WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.feed_id = come.feed_id AND p.file_seq = come.file_seq AND p.b = come.field)
UNION ALL SELECT old.feed_id, old.file_seq, 'retyped', old.field, old.field FROM old JOIN new ON new.feed_id = old.feed_id AND new.file_seq = old.file_seq AND new.field = old.field WHERE old.types IS DISTINCT FROM new.types
"""

_IN = "CASE WHEN parent_path = 'root' THEN 'manuscript' ELSE 'section' END"
_LAST = "CAST(regexp_extract(node_path, '(\\d+)$', 1) AS INT)"
P1_SECTIONS = f"""
WITH RECURSIVE {_TREE}
SELECT record_id, node_path, {_IN} AS parent_relation, parent_path, {_LAST} AS ordinal, v ->> '$.object_id' AS object_id, v ->> '$.title' AS title, try_cast(v ->> '$.level' AS INT) AS level FROM tree WHERE relation = 'section'
UNION ALL SELECT record_id, node_path, 'manuscript', 'root', {_LAST}, v.object_id, v.title, v.level FROM front
"""
P1_PARAGRAPHS = f"""
WITH RECURSIVE {_TREE}
SELECT record_id, node_path, 'section' AS parent_relation, parent_path, {_LAST} AS ordinal, v ->> '$.object_id' AS object_id, CASE json_type(v) WHEN 'VARCHAR' THEN v ->> '$' ELSE v ->> '$.text' END AS text FROM tree WHERE relation = 'paragraph'
UNION ALL SELECT record_id, node_path, 'section', parent_path, {_LAST}, v.object_id, v.text FROM texts
"""
P1_LOCATORS = f"""
WITH RECURSIVE {_TREE},
held AS (SELECT record_id, relation, node_path, v -> '$.source_locator' AS x FROM tree WHERE json_type(v) = 'OBJECT'),
locs AS (SELECT record_id, relation, node_path, unnest({_entries("x")}) AS v, generate_subscripts({_entries("x")}, 1) - 1 AS i FROM held)
SELECT record_id, node_path || '.l' || i AS node_path, relation AS parent_relation, node_path AS parent_path, CAST(i AS INT) AS ordinal, v ->> '$.format' AS format, v ->> '$.status' AS status, v ->> '$.part' AS part,
  try_cast(v ->> '$.index' AS INT) AS index, v ->> '$.source_file' AS source_file, try_cast(v ->> '$.line_start' AS INT) AS line_start, try_cast(v ->> '$.line_end' AS INT) AS line_end FROM locs WHERE json_type(v) <> 'NULL'
UNION ALL SELECT record_id, node_path || '.l0', 'paragraph', node_path, 0, v.source_locator.format, v.source_locator.status, v.source_locator.part, v.source_locator."index", NULL, NULL, NULL FROM texts WHERE v.source_locator IS NOT NULL
"""

SQL = {"p1_sections": P1_SECTIONS, "p1_paragraphs": P1_PARAGRAPHS, "p1_locators": P1_LOCATORS, "p1_found": P1_FOUND, "p1_checks": P1_CHECKS, "p2_found": P2_FOUND, "p2_report": P2_REPORT, "p3_found": P3_FOUND}
