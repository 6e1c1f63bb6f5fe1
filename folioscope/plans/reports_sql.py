"""SQL of the queries of reports and deliveries, written against the tables alone."""

from __future__ import annotations

from folioscope.operators.structure import FRONT_WORDS
from folioscope.plans.audit_sql import _AUDIT, _LAYERS, _NUMBER, _OUTLINE, _PARAS, _PLACE, _RESOLVED, _STALE, _TEXTS
from folioscope.plans.data_sql import _key

_STATEMENTS = "CASE WHEN statements IS NULL THEN NULL ELSE 'sha256:' || sha256('{' || coalesce(array_to_string(list_transform(list_sort(map_entries(statements)), lambda e: CAST(to_json(e.key) AS VARCHAR) || ':' || coalesce(CAST(to_json(replace(replace(nfc_normalize(e.value), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS VARCHAR), 'null')), ','), '') || '}') END"
_ENDS = "again AS (SELECT a.record_id AS original, a.record_id AS a, b.record_id AS b FROM manuscripts a JOIN manuscripts b ON b.record_id = a.record_id + 1)"
_SAVED = f"""
{_TEXTS}, {_ENDS},
cats AS (
  SELECT record_id, CASE part WHEN 0 THEN 'title' WHEN 1 THEN 'abstract' ELSE 'body' END AS category, sha256(CAST(to_json(list(text ORDER BY place)) AS VARCHAR)) AS digest FROM filled WHERE part < 3 GROUP BY ALL
  UNION ALL SELECT record_id, 'numbers', sha256(CAST(to_json(flatten(list(v ORDER BY place))) AS VARCHAR)) FROM (SELECT record_id, place, regexp_extract_all(text, '{_NUMBER}', 1) AS v FROM filled WHERE part = 2) WHERE len(v) > 0 GROUP BY ALL
  UNION ALL SELECT record_id, 'statements', {_STATEMENTS} FROM manuscripts WHERE statements IS NOT NULL),
saved AS (
  SELECT coalesce(o.original, n.original) AS original, coalesce(o.category, n.category) AS category, CASE WHEN o.digest = n.digest THEN 'PASS' ELSE 'FAIL' END AS result
  FROM (SELECT original, category, digest FROM again JOIN cats ON record_id = a) o FULL JOIN (SELECT original, category, digest FROM again JOIN cats ON record_id = b) n ON n.original = o.original AND n.category = o.category),
regions AS (
  SELECT record_id, 'title' AS region, title AS value FROM manuscripts
  UNION ALL SELECT record_id, 'abstract', CAST(to_json(flatten(list_transform(abstract, lambda s: coalesce(list_transform(s.paragraphs, lambda p: p.text), [])))) AS VARCHAR) FROM manuscripts
  UNION ALL SELECT record_id, 'statement:' || e.key, e.value FROM (SELECT record_id, unnest(map_entries(statements)) AS e FROM manuscripts)),
observed AS (
  SELECT DISTINCT coalesce(o.original, n.original) AS original, coalesce(o.region, n.region) AS change
  FROM (SELECT original, region, value FROM again JOIN regions ON record_id = a) o FULL JOIN (SELECT original, region, value FROM again JOIN regions ON record_id = b) n ON n.original = o.original AND n.region = o.region
  WHERE o.value IS DISTINCT FROM n.value)
"""


def _found(last: bool) -> str:
    order = "DESC" if last else "ASC"
    return f"""SELECT manuscript_id, f.check_name AS check_name, max(f.status) AS status FROM (
  SELECT manuscript_id, unnest(findings) AS f FROM (SELECT * FROM verification_reports WHERE verified_at IS NOT NULL AND findings IS NOT NULL AND manuscript_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY manuscript_id ORDER BY verified_at {order}, report_id {order}) = 1)) WHERE f.check_name IS NOT NULL GROUP BY ALL"""


SQL = {
    "preservation_results": f"WITH RECURSIVE {_SAVED} SELECT * FROM saved",
    "observed_changes": f"WITH RECURSIVE {_SAVED} SELECT * FROM observed",
    "unexpected_changes": f"WITH RECURSIVE {_SAVED} SELECT original, change FROM observed WHERE change <> 'abstract' UNION SELECT original, category FROM saved WHERE result = 'FAIL' AND category <> 'abstract'",
    "report_diff": f"""
WITH o AS ({_found(False)}), n AS ({_found(True)})
SELECT * FROM (SELECT coalesce(o.manuscript_id, n.manuscript_id) AS manuscript_id, coalesce(o.check_name, n.check_name) AS check_name, CASE WHEN o.manuscript_id IS NULL THEN 'NEW' WHEN n.manuscript_id IS NULL THEN 'RESOLVED' WHEN o.status IS DISTINCT FROM n.status THEN 'CHANGED' END AS change
  FROM o FULL JOIN n ON n.manuscript_id = o.manuscript_id AND n.check_name = o.check_name) WHERE change IS NOT NULL""",
    "finding_order": f"""
WITH RECURSIVE {_AUDIT}
SELECT report_id, 'finding:' || substr(sha256(CAST(to_json([rule_id, CAST(report_id AS VARCHAR), finding_status]) AS VARCHAR)), 1, 24) AS finding_id, row_number() OVER (PARTITION BY report_id ORDER BY rule_id) AS place,
  row_number() OVER (PARTITION BY report_id ORDER BY CASE finding_status WHEN 'EVALUATION_ERROR' THEN 0 WHEN 'BLOCKED' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'UNKNOWN' THEN 3 ELSE 20 END, rule_id) AS turn
FROM audit WHERE finding_status NOT IN ('PASS', 'NOT_APPLICABLE')""",
    "audit_json": f"""
WITH RECURSIVE {_AUDIT}, j AS (SELECT report_id, CAST(to_json(list({{'a_rule': rule_id, 'b_status': finding_status}} ORDER BY rule_id, finding_status)) AS VARCHAR) AS findings FROM audit GROUP BY ALL)
SELECT report_id, findings, 'sha256:' || sha256(findings) AS report_hash FROM j""",
    "statement_hashes": f"SELECT record_id, {_STATEMENTS} AS statements_hash FROM manuscripts WHERE statements IS NOT NULL",
    "conflict_report": f"""
WITH RECURSIVE {_RESOLVED} SELECT root, CASE WHEN bool_or(resolution = 'CONFLICT') THEN 'CONFLICTED' ELSE 'CLEAR' END AS status, count(*) FILTER (resolution = 'CONFLICT') AS n_conflicts, min(rule_id) FILTER (resolution = 'CONFLICT') AS first_rule FROM resolved GROUP BY ALL""",
    "same_identity": """
SELECT manuscript_id, sha256(CAST(to_json([coalesce(array_to_string(authors, '|'), ''), coalesce(title, ''), coalesce(source_title, ''), coalesce(pub_year, ''), coalesce(volume, ''), coalesce(issue, ''), coalesce(pages_or_article_number, ''), coalesce(doi, '')]) AS VARCHAR)) AS identity,
  count(DISTINCT ref_key) AS n, min(ref_key) AS first_member, max(ref_key) AS last_member FROM bib_references GROUP BY ALL HAVING count(DISTINCT ref_key) > 1""",
    "paragraph_roles": f"""
WITH RECURSIVE {_PARAS}, {_OUTLINE[_OUTLINE.index("outline AS") :]}
SELECT p.record_id, p.node_path, CASE WHEN regexp_matches(coalesce(text, ''), '(?i)^\\s*fig(?:ure)?\\.?\\s*\\d') THEN 'figure_caption' WHEN regexp_matches(coalesce(text, ''), '(?i)^\\s*table\\.?\\s*\\d') THEN 'table_caption' ELSE coalesce(section, 'body') END AS role
FROM paras p LEFT JOIN labelled l ON l.record_id = p.record_id AND p.node_path LIKE 's' || l.seq || '.%'""",
    "front_paragraphs": f"""
WITH RECURSIVE {_PARAS}
SELECT record_id, place, node_path, trim(regexp_replace(lower(substr(text, 1, 40)), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', ' ', 'g')) AS begins FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY {_PLACE}) AS place FROM paras WHERE text IS NOT NULL) WHERE place <= 4""",
    "line_signals": f"""
WITH lines AS (SELECT 'document' AS source, doc_id AS row_key, string_split(text, chr(10))[1] AS line FROM documents UNION ALL SELECT DISTINCT 'outline', entry_id, title FROM outline_entries),
p AS (SELECT *, len(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}]+')) AS w, '(?s)^[\\s\\x0B]*([1-9]\\d*)(?:\\.([1-9]\\d*))?[.)]?[\\s\\x0B]+([^\\n\\r]+?)[\\s\\x0B]*$' AS n FROM lines WHERE line IS NOT NULL),
q AS (SELECT *, regexp_extract(line, n, 3) AS rest, try_cast(regexp_extract(line, n, 1) AS INT) AS major, try_cast(regexp_extract(line, n, 2) AS INT) AS minor FROM p),
g AS (SELECT *, rest <> '' AND len(regexp_extract_all(rest, '[\\p{{L}}\\p{{N}}]+')) BETWEEN 1 AND 20 AND length(line) <= 200 AND right(rest, 1) NOT IN ('.', ';') AS good FROM q)
SELECT source, row_key, w BETWEEN 3 AND 40 AND length(line) <= 300 AND right(line, 1) NOT IN ('.', ':', ';') AS plausible_title, contains(line, '@') OR regexp_matches(lower(line), '(?:^|[^\\p{{L}}\\p{{N}}_])(?:{FRONT_WORDS})(?:[^\\p{{L}}\\p{{N}}_]|$)') AS front_matter,
  CASE WHEN good THEN major END AS major, CASE WHEN good THEN minor END AS minor, CASE WHEN good THEN CASE WHEN minor IS NULL THEN 1 ELSE 2 END END AS level FROM g""",
    "format_targets": f"""
WITH {_LAYERS}, late AS (SELECT layer, bool_or(coalesce({_STALE}, false)) AS late FROM layer_rows GROUP BY ALL),
r AS (SELECT *, {_key("profile_id")} AS layer FROM profile_rules WHERE list_contains(submission_stages, 'REVISION')),
x AS (SELECT layer, rule_id, arg_max({{'v': rule_value, 's': status, 'p': coalesce(len(provenance), 0) > 0}}, (coalesce(profile_version, ''), recorded_at, rule_key)) AS x, count(DISTINCT coalesce(rule_value, 'null')) AS n, bool_or(coalesce(override_of = rule_id AND coalesce(override_reason, '') <> '', false)) AS declared FROM r WHERE layer IS NOT NULL GROUP BY ALL)
SELECT x.layer, rule_id, x.v AS value, CASE WHEN n > 1 AND NOT declared THEN 'CONFLICTED' WHEN coalesce(late, false) THEN 'STALE' WHEN x.s = 'VERIFIED' AND NOT x.p THEN 'UNKNOWN' ELSE x.s END AS status FROM x LEFT JOIN late ON late.layer = x.layer""",
}
