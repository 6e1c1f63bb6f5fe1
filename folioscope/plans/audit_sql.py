"""SQL of the audit queries, written against the tables alone."""

from __future__ import annotations

from folioscope.operators.structure import SECTION_ALIASES
from folioscope.plans.data_sql import _TREE, _key

_WORD = "[\\p{L}\\p{N}]+(?:[-\\x{2019}''][\\p{L}\\p{N}]+)*"
AS_OF = "TIMESTAMP '2024-01-01 00:00:00'"


def _words(x: str) -> str:
    return f"len(regexp_extract_all(nfc_normalize({x}), '{_WORD}'))"


_PARAS = f"""
{_TREE},
paras AS (SELECT record_id, node_path, CASE json_type(v) WHEN 'VARCHAR' THEN v ->> '$' ELSE v ->> '$.text' END AS text FROM tree WHERE relation = 'paragraph')
"""
_NAMED = "CASE " + " ".join(f"WHEN h = '{a}' THEN '{n}'" for n, aliases in SECTION_ALIASES.items() for a in aliases) + " END"
_HEADING = "trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}\\p{M}_]+', ' ', 'g'))"
_OUTLINE = f"""
{_TREE},
outline AS (SELECT record_id, CAST(substr(node_path, 2) AS INT) AS seq, v ->> '$.title' AS title FROM tree WHERE parent_path = 'root'),
labelled AS (SELECT record_id, seq, title, {_NAMED} AS section FROM (SELECT *, {_HEADING} AS h FROM outline))
"""
_RULES = f"""
unique_rules AS (
  SELECT layer, profile_version, rule_id, r.* FROM (
    SELECT {_key("profile_id")} AS layer, profile_version, rule_id,
      arg_max({{'rule_key': rule_key, 'target': target, 'operator': operator, 'rule_value': rule_value, 'unit': unit, 'severity': severity, 'machine_checkable': machine_checkable, 'status': status,
        'applicability_mode': applicability_mode, 'critical_for_readiness': critical_for_readiness, 'evaluation_scope': evaluation_scope}}, (recorded_at, rule_key)) AS r
    FROM profile_rules GROUP BY ALL) WHERE layer IS NOT NULL)
"""
_AUDIT = f"""
{_PARAS},
latest AS (SELECT * FROM manuscripts QUALIFY row_number() OVER (PARTITION BY manuscript_id ORDER BY received_at DESC, record_id DESC) = 1),
front_size AS (SELECT front.record_id, sum(coalesce({_words("t.v.text")}, 0)) AS w, sum(coalesce(length(t.v.text), 0)) + greatest(count(t.v.text) - 1, 0) AS c FROM front LEFT JOIN texts t ON t.record_id = front.record_id AND t.parent_path = front.node_path GROUP BY ALL),
body_size AS (SELECT t.record_id AS record_id, sum(coalesce({_words("p.text")}, 0)) AS w, sum(coalesce(length(p.text), 0)) + greatest(count(p.text) - 1, 0) AS c FROM tree t LEFT JOIN paras p ON p.record_id = t.record_id AND p.node_path = t.node_path GROUP BY ALL),
sizes AS (SELECT record_id, 'abstract' AS target, w, c FROM front_size UNION ALL SELECT record_id, 'main_text', w, c FROM body_size UNION ALL SELECT record_id, 'title', {_words("title")}, length(title) FROM manuscripts WHERE trim(title) <> ''),
refs AS (SELECT manuscript_id, count(DISTINCT reference_id) AS n FROM bib_references WHERE deleted_at IS NULL GROUP BY ALL),
facts AS (
  SELECT manuscript_id, target, 'words' AS unit, 'num' AS kind, CAST(w AS DOUBLE) AS num, NULL AS str FROM latest JOIN sizes USING (record_id)
  UNION ALL SELECT manuscript_id, target, 'characters', 'num', CAST(c AS DOUBLE), NULL FROM latest JOIN sizes USING (record_id)
  UNION ALL SELECT manuscript_id, 'title', 'text', 'str', NULL, title FROM latest WHERE trim(title) <> ''
  UNION ALL SELECT manuscript_id, 'article_type', 'any', CASE WHEN article_type IS NULL THEN 'none' ELSE 'str' END, NULL, article_type FROM latest
  UNION ALL SELECT manuscript_id, 'references', 'any', 'num', n, NULL FROM refs
  UNION ALL SELECT manuscript_id, unnest(['figures_and_tables', 'figure_files', 'supplementary_information', 'section_order']), 'any', unnest(['num', 'bool', 'bool', 'list']), unnest([0, 1, 0, NULL]), NULL FROM latest
  UNION ALL SELECT manuscript_id, 'statements.' || e.key, 'any', CASE WHEN e.value IS NULL THEN 'none' ELSE 'str' END, NULL, e.value FROM (SELECT manuscript_id, unnest(map_entries(statements)) AS e FROM latest)),
{_RULES},
reports AS (SELECT DISTINCT report_id, manuscript_id, {_key("profile_id")} AS layer, profile_version FROM verification_reports),
audit AS (
  SELECT report_id, rule_id, layer, operator, status, machine_checkable, critical_for_readiness, CASE
    WHEN target = 'cover_letter' THEN 'NOT_APPLICABLE' WHEN status IN ('UNKNOWN', 'PARTIAL', 'STALE', 'CONFLICTED') THEN 'UNKNOWN'
    WHEN status = 'NOT_APPLICABLE' OR applicability_mode = 'NOT_APPLICABLE' THEN 'NOT_APPLICABLE' WHEN applicability_mode IN ('UNKNOWN', 'CONDITIONAL') THEN 'UNKNOWN'
    WHEN NOT coalesce(machine_checkable, false) THEN 'UNKNOWN' WHEN coalesce(evaluation_scope, '') NOT IN ('TITLE_TEXT', 'ABSTRACT_TEXT') THEN 'EVALUATION_ERROR'
    WHEN operator = 'PRECEDES' THEN 'EVALUATION_ERROR' WHEN f.target IS NULL THEN 'EVALUATION_ERROR'
    WHEN ok IS NULL THEN 'EVALUATION_ERROR' WHEN ok THEN 'PASS' WHEN severity = 'BLOCKING' THEN 'BLOCKED' ELSE 'WARNING' END AS finding_status
  FROM (
    SELECT a.*, f.target, CASE operator
      WHEN 'LTE' THEN CASE WHEN num IS NOT NULL AND try_cast(rule_value AS DOUBLE) IS NOT NULL THEN num <= try_cast(rule_value AS DOUBLE) END
      WHEN 'EXISTS' THEN CASE kind WHEN 'none' THEN false WHEN 'str' THEN str <> '' ELSE true END
      WHEN 'IN' THEN CASE WHEN json_valid(rule_value) AND json_type(rule_value) = 'ARRAY' AND str IS NOT NULL THEN list_contains(CAST(CAST(rule_value AS JSON) AS VARCHAR[]), str) END END AS ok
    FROM (SELECT r.report_id, r.manuscript_id, r.layer, u.rule_id, u.target AS rule_target, u.* EXCLUDE (layer, rule_id, target) FROM reports r JOIN unique_rules u ON u.layer = r.layer AND u.profile_version = r.profile_version) a
    LEFT JOIN facts f ON f.manuscript_id = a.manuscript_id AND f.target = a.rule_target AND f.unit = CASE WHEN a.rule_target IN ('title', 'abstract', 'main_text') THEN CASE WHEN a.unit IN ('words', 'characters') THEN a.unit ELSE 'text' END ELSE 'any' END) x(report_id, manuscript_id, layer, rule_id, rule_target, profile_version, rule_key, operator, rule_value, unit, severity, machine_checkable, status, applicability_mode, critical_for_readiness, evaluation_scope, target, ok))
"""
_AUDIT = _AUDIT.replace("WHEN target = 'cover_letter'", "WHEN rule_target = 'cover_letter'").replace("WHEN f.target IS NULL THEN", "WHEN target IS NULL THEN")


def _count(x: str) -> str:
    return f"count(*) FILTER ({x})"


_STATES = ", ".join(f"{_count(f"finding_status = '{s}'")} AS n_{s.lower()}" for s in ("PASS", "WARNING", "BLOCKED", "UNKNOWN", "NOT_APPLICABLE", "EVALUATION_ERROR"))
_RANK = "CASE finding_status WHEN 'EVALUATION_ERROR' THEN 4 WHEN 'BLOCKED' THEN 3 WHEN 'UNKNOWN' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END"
_LAYERS = f"""
layer_rows AS (
  SELECT layer, version, p.* FROM (
    SELECT {_key("profile_id")} AS layer, profile_version AS version,
      arg_max({{'profile_kind': profile_kind, 'precedence': precedence, 'status': status, 'last_verified_at': last_verified_at, 'freshness_window_days': freshness_window_days}}, (received_at, profile_key)) AS p
    FROM profiles GROUP BY ALL) WHERE layer IS NOT NULL)
"""
_ANCESTORS = f"""
links AS (SELECT DISTINCT child, parent FROM (SELECT {_key("profile_id")} AS child, {_key("p.profile_id")} AS parent FROM (SELECT profile_id, unnest(parents) AS p FROM profiles)) WHERE child IS NOT NULL AND parent IS NOT NULL),
walk(root, node, level, path) AS (
  SELECT x, x, 0, [x] FROM (SELECT child AS x FROM links UNION SELECT parent FROM links)
  UNION ALL SELECT root, parent, level + 1, list_append(path, parent) FROM walk JOIN links ON child = node WHERE NOT list_contains(path, parent)),
up AS (SELECT root, node, min(level) AS level FROM walk GROUP BY ALL)
"""
_RESOLVED = f"""
{_ANCESTORS}, {_LAYERS},
cands AS (
  SELECT DISTINCT up.root, r.layer, p.precedence, r.version, r.rule_id, r.rule_version, r.value, r.override_of, r.override_reason
  FROM up JOIN (SELECT layer, max(precedence) AS precedence FROM layer_rows GROUP BY ALL) p ON p.layer = up.node
  JOIN (SELECT {_key("profile_id")} AS layer, profile_version AS version, rule_id, rule_version, coalesce(rule_value, 'null') AS value, override_of, override_reason FROM profile_rules) r ON r.layer = up.node),
marked AS (SELECT *, max(precedence) OVER (PARTITION BY root, rule_id) AS high FROM cands),
best AS (SELECT *, count(*) OVER w AS n, min(value) OVER w AS lo, max(value) OVER w AS hi FROM marked WHERE precedence = high WINDOW w AS (PARTITION BY root, rule_id)),
first AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY root, rule_id ORDER BY coalesce(layer, ''), coalesce(version, ''), coalesce(rule_version, ''), value, precedence, override_of NULLS FIRST, override_reason NULLS FIRST) = 1),
low AS (SELECT root, rule_id, value AS lower_value FROM marked WHERE precedence < high QUALIFY row_number() OVER (PARTITION BY root, rule_id ORDER BY precedence DESC, layer DESC, coalesce(version, '') DESC, coalesce(rule_version, '') DESC, value DESC) = 1),
resolved AS (
  SELECT root, rule_id, layer, version, value, CASE WHEN n > 1 AND lo <> hi THEN 'CONFLICT' WHEN n > 1 THEN 'DUPLICATE' WHEN lower_value IS NULL THEN 'SELECTED' WHEN lower_value = value THEN 'REDUNDANT_OVERRIDE'
    WHEN override_of = rule_id AND coalesce(override_reason, '') <> '' THEN 'VALID_OVERRIDE' ELSE 'CONFLICT' END AS resolution
  FROM first LEFT JOIN low USING (root, rule_id))
"""
_STALE = f"{AS_OF} > last_verified_at + to_days(CAST(freshness_window_days AS INT))"
_BEST = lambda t, key, cols: f"SELECT {key}, x.* FROM (SELECT {key}, arg_max({{{', '.join(f"'{c}': {c}" for c in cols)}}}, (received_at, {', '.join(f"coalesce({c}, '')" for c in cols)})) AS x FROM {t} WHERE {key} IS NOT NULL GROUP BY ALL)"
_PROV = f"""
s AS ({_BEST("source_records", "source_id", ["source_type", "verification_status"])}),
e AS ({_BEST("evidence_records", "evidence_id", ["source_id", "evidence_text", "evidence_hash"])}),
refs AS (SELECT rule_key, status, confidence, p.source_id AS sid, p.evidence_id AS eid FROM (SELECT rule_key, status, confidence, unnest(provenance) AS p FROM profile_rules) WHERE p IS NOT NULL),
j AS (SELECT refs.*, s.source_id IS NOT NULL AS has_s, e.evidence_id IS NOT NULL AS has_e, s.source_type, s.verification_status, e.source_id AS owner, coalesce(e.evidence_hash, '') = 'sha256:' || sha256(e.evidence_text) AS hash_ok
  FROM refs LEFT JOIN s ON s.source_id = refs.sid LEFT JOIN e ON e.evidence_id = refs.eid)
"""
_LOW_LIMITS = """
limits AS (SELECT evidence_id, e.rule_id, e.m AS value, e.unit FROM (
  SELECT evidence_id, unnest([
    {'rule_id': 'main_text.max_words', 'unit': 'words', 'm': regexp_extract(t, 'main text(?: ideally)?\\s+(\\d[\\d,]*)\\s+words', 1)}, {'rule_id': 'main_text.max_words', 'unit': 'words', 'm': regexp_extract(t, 'main text (?:may not exceed|should ideally stay below)\\s+(\\d[\\d,]*)\\s+words', 1)},
    {'rule_id': 'abstract.max_words', 'unit': 'words', 'm': regexp_extract(t, 'abstract\\s+(\\d[\\d,]*)\\s+words', 1)}, {'rule_id': 'abstract.max_words', 'unit': 'words', 'm': regexp_extract(t, 'abstracts are confined to\\s+(\\d[\\d,]*)\\s+words', 1)},
    {'rule_id': 'title.max_words', 'unit': 'words', 'm': regexp_extract(t, 'title\\s+(\\d[\\d,]*)\\s+words', 1)}, {'rule_id': 'display_items.max_count', 'unit': 'items', 'm': regexp_extract(t, 'display items(?: up to)?\\s+(\\d[\\d,]*)', 1)},
    {'rule_id': 'extended_data.max_count', 'unit': 'items', 'm': regexp_extract(t, 'up to\\s+(\\d+)\\s+extended data', 1)}]) AS e
  FROM (SELECT DISTINCT evidence_id, lower(evidence_text) AS t FROM evidence_records)) WHERE e.m <> '')
"""

_NUMBER = "(?:^|[^\\p{L}\\p{N}_.])((?:p[\\s\\x0B]*[<=>][\\s\\x0B]*)?[+-]?(?:\\p{Nd}+(?:\\.\\p{Nd}+)?|\\.\\p{Nd}+)(?:[eE][+-]?\\p{Nd}+)?%?)"


def _normal(x: str) -> str:
    return f"trim(regexp_replace(replace(nfc_normalize({x}), '\\%', '%'), '[\\s\\x0B\\p{{Z}}\\x1c-\\x1f\\x{{85}}]+', ' ', 'g'))"


def _fold(x: str) -> str:
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


_PLACE = "list_transform(string_split(node_path, '.'), lambda x: {'l': x[1], 'i': CAST(x[2:] AS BIGINT)})"
_TEXTS = f"""
{_PARAS},
all_texts AS (SELECT record_id, part, place, {_normal("text")} AS text FROM (
  SELECT record_id, 0 AS part, [{{'l': 't', 'i': 0::BIGINT}}] AS place, title AS text FROM manuscripts
  UNION ALL SELECT record_id, 1, {_PLACE}, v.title FROM front
  UNION ALL SELECT record_id, 1, {_PLACE}, v.text FROM texts
  UNION ALL SELECT record_id, 2, {_PLACE}, v ->> '$.title' FROM tree WHERE relation = 'section' AND json_type(v) = 'OBJECT'
  UNION ALL SELECT record_id, 2, {_PLACE}, text FROM paras
  UNION ALL SELECT m.record_id, 3, [{{'l': 'r', 'i': b.ref_key}}], b.raw_text FROM bib_references b JOIN manuscripts m USING (manuscript_id) WHERE b.deleted_at IS NULL)),
filled AS (SELECT * FROM all_texts WHERE text <> '')
"""
_LIMIT_PATTERNS = [
    ("title.max_words", "LTE", "words", "title\\s+(\\d[\\d,]*)\\s+words"), ("abstract.max_words", "LTE", "words", "abstract\\s+(\\d[\\d,]*)\\s+words"),
    ("main_text.max_words", "LTE", "words", "main text(?: ideally)?\\s+(\\d[\\d,]*)\\s+words"), ("display_items.max_count", "LTE", "items", "display items(?: up to)?\\s+(\\d[\\d,]*)"),
    ("extended_data.max_count", "LTE", "items", "up to\\s+(\\d+)\\s+extended data"), ("main_text.max_words", "LTE", "words", "main text (?:may not exceed|should ideally stay below)\\s+(\\d[\\d,]*)\\s+words"),
    ("abstract.max_words", "LTE", "words", "abstracts are confined to\\s+(\\d[\\d,]*)\\s+words"),
]
_FLAGS = [
    ("identity.article_type", "EQ", "Article", "contains(t, 'article limits')"), ("cover_letter.required", "EXISTS", "true", "contains(t, 'include') AND contains(t, 'cover letter')"),
    ("supplement.allowed", "EXISTS", "OPTIONAL", "regexp_matches(t, 'supplementary information optional|optional supplementary information')"),
    *[(rule, "EXISTS", "true", f"contains(t, '{token}') AND regexp_matches(t, 'requires|must include')") for rule, token in (
        ("statements.competing_interests.required", "competing-interest"), ("statements.data_availability.required", "data-availability statement"), ("statements.author_contributions.required", "author-contribution statement"),
    )],
]


def _candidates(source: str, keys: str, text: str) -> str:
    """Each rule that a segment states, as (keys, rule_id, operator, value, unit)."""
    limits = [f"{{'rule_id': '{r}', 'op': '{o}', 'm': nullif(replace(regexp_extract(t, '{p}', 1), ',', ''), ''), 'unit': '{u}'}}" for r, o, u, p in _LIMIT_PATTERNS]
    flags = [f"{{'rule_id': '{r}', 'op': '{o}', 'm': CASE WHEN {c} THEN '{v}' END, 'unit': NULL}}" for r, o, v, c in _FLAGS]
    return f"SELECT DISTINCT {keys}, e.rule_id AS rule_id, e.op AS operator, e.m AS value, e.unit AS unit FROM (SELECT {keys}, unnest([{', '.join(limits + flags)}]) AS e FROM (SELECT {keys}, lower({text}) AS t FROM {source})) WHERE e.m IS NOT NULL"


_SEGMENTS = r"""
pieces AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '[\s\x0B\p{Z}\x1c-\x1f\x{85}]+', ' ', 'g')), '([.!?])[\s\x0B]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM documents WHERE doc_kind = 'guideline' AND text IS NOT NULL),
cut AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS seq, trim(unnest(p)) AS segment FROM pieces),
segs AS (SELECT doc_id, seq, segment, substr(sha256(segment), 1, 24) AS segment_hash FROM cut WHERE length(segment) >= 12)
"""
_GUIDE = f"""
{_SEGMENTS},
stated AS ({_candidates("segs", "doc_id, seq, segment_hash", "segment")}),
found AS (SELECT doc_id, segment_hash, rule_id, operator, value, unit, min(seq) AS seq FROM stated GROUP BY ALL),
clash AS (SELECT rule_id, count(DISTINCT value) AS n_values, count(DISTINCT (doc_id, seq, value)) AS n_candidates, min(value) AS lowest, max(value) AS highest FROM found GROUP BY ALL HAVING count(DISTINCT value) > 1)
"""
_RANKED = "list_position(['introduction', 'results', 'discussion', 'methods'], section)"
_MARKERS = r"""
marks AS (SELECT DISTINCT manuscript_id, citation_id, raw_text FROM citations),
i AS (SELECT *, string_split(regexp_replace(translate(raw_text, '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789'), '[\[\] \t]', '', 'g'), ',') AS items FROM marks),
r AS (SELECT *, list_transform(items, lambda x: CASE WHEN regexp_full_match(x, '\d{1,9}([–-]\d{1,9})?') THEN {'a': try_cast(regexp_extract(x, '^(\d+)', 1) AS INT), 'b': coalesce(try_cast(regexp_extract(x, '[–-](\d+)$', 1) AS INT), try_cast(regexp_extract(x, '^(\d+)', 1) AS INT))} END) AS ends FROM i),
n AS (SELECT *, CASE WHEN len(list_filter(ends, lambda e: coalesce(e.a >= 1 AND e.b >= e.a AND e.b - e.a <= 1000, false))) = len(ends) THEN flatten(list_transform(ends, lambda e: range(e.a, e.b + 1))) END AS v FROM r),
expanded AS (SELECT manuscript_id, citation_id, raw_text, CASE WHEN len(v) = len(list_distinct(v)) THEN list_sort(v) END AS numbers FROM n)
"""
_SCIENCE = {
    "percentage": "\\b\\d+(?:\\.\\d+)?\\s?%", "p_value": "\\bp\\s*[<=>]\\s*\\.?\\d+(?:\\.\\d+)?(?:e-?\\d+)?", "citation": "\\[(?:\\d+(?:\\s*[-,]\\s*\\d+)*)\\]",
    "figure_reference": "\\b(?:Fig(?:ure)?\\.?)\\s*[A-Z]?\\d+[A-Za-z]?\\b", "numeric": "(?:^|[^\\w.+-])([-+]?\\d+(?:\\.\\d+)?)(?:[^\\w.]|$)",
}


def _changed(name: str) -> str:
    group = ", 1" if name == "numeric" else ""
    a, b = (f"list_distinct(regexp_extract_all({x}, '{_SCIENCE[name]}'{group}))" for x in "ab")
    return f"list_sort(list_concat(list_transform(list_filter({a}, lambda x: NOT list_contains({b}, x)), lambda x: 'removed:' || x), list_transform(list_filter({b}, lambda x: NOT list_contains({a}, x)), lambda x: 'added:' || x)))"


def _sentence(x: str) -> str:
    return f"'n = ' || CAST(l_quantity AS INT) || ', ' || CAST(round({x} * 100) AS INT) || '% (p < 0.0' || l_linenumber || '), Figure ' || l_linenumber || ' [' || l_partkey || ']'"


_KIND_TOKENS = (
    ("cover", "COVER_LETTER"), ("title_page", "TITLE_PAGE"), ("figure", "FIGURE"), ("fig", "FIGURE"), ("table", "TABLE"), ("supp", "SUPPLEMENTARY_INFORMATION"), ("checklist", "REPORTING_CHECKLIST"),
    ("graphical", "GRAPHICAL_ABSTRACT"), ("highlight", "HIGHLIGHTS"), ("ethics", "ETHICS_DOCUMENT"), ("consent", "CONSENT_DOCUMENT"),
)
_KIND = "CASE " + " ".join(f"WHEN contains(stem, '{t}') THEN '{k}'" for t, k in _KIND_TOKENS) + " ELSE 'OTHER_REQUIRED_FILE' END"

SQL = {
    "audit_findings": f"WITH RECURSIVE {_AUDIT} SELECT report_id, rule_id, finding_status FROM audit",
    "audit_summary": f"WITH RECURSIVE {_AUDIT} SELECT report_id, {_STATES} FROM audit GROUP BY ALL",
    "audit_coverage": f"""WITH RECURSIVE {_AUDIT} SELECT layer, count(*) AS n_rules, {_count("status = 'VERIFIED'")} AS n_verified, {_count("status IN ('UNKNOWN', 'PARTIAL', 'STALE', 'CONFLICTED')")} AS n_uncertain,
      {_count("machine_checkable")} AS n_checkable, {_count("finding_status IN ('PASS', 'WARNING', 'BLOCKED')")} AS n_evaluated, {_count("finding_status = 'UNKNOWN'")} AS n_manual,
      {_count("operator = 'PRECEDES' AND finding_status = 'EVALUATION_ERROR'")} AS n_unsupported FROM audit GROUP BY ALL""",
    "audit_rollup": f"WITH RECURSIVE {_AUDIT} SELECT report_id, max({_RANK}) AS worst, bool_or(critical_for_readiness AND {_RANK} >= 2) AS critical_open FROM audit GROUP BY ALL",
    "operator_matrix": """
WITH r AS (SELECT p_size AS n, p_brand AS b FROM part), t AS (
  SELECT unnest([{'op': 'EQ', 'kind': 'num', 'ok': n = 15}, {'op': 'NE', 'kind': 'num', 'ok': n <> 15}, {'op': 'LT', 'kind': 'num', 'ok': n < 15}, {'op': 'LTE', 'kind': 'num', 'ok': n <= 15}, {'op': 'GT', 'kind': 'num', 'ok': n > 15},
    {'op': 'GTE', 'kind': 'num', 'ok': n >= 15}, {'op': 'EXISTS', 'kind': 'num', 'ok': true}, {'op': 'NOT_EXISTS', 'kind': 'num', 'ok': false}, {'op': 'IN', 'kind': 'str', 'ok': b IN ('Brand#11', 'Brand#23')},
    {'op': 'NOT_IN', 'kind': 'str', 'ok': b NOT IN ('Brand#11', 'Brand#23')}, {'op': 'COUNT_EQ', 'kind': 'str', 'ok': length(b) = 8}, {'op': 'COUNT_LTE', 'kind': 'str', 'ok': length(b) <= 7}, {'op': 'COUNT_GTE', 'kind': 'str', 'ok': length(b) >= 8},
    {'op': 'MATCH_REGEX', 'kind': 'str', 'ok': regexp_matches(b, '#1[0-9]$')}, {'op': 'NOT_MATCH_REGEX', 'kind': 'str', 'ok': NOT regexp_matches(b, '#1[0-9]$')}, {'op': 'CONTAINS', 'kind': 'str', 'ok': contains(b, '#2')},
    {'op': 'NOT_CONTAINS', 'kind': 'str', 'ok': NOT contains(b, '#2')}, {'op': 'LT', 'kind': 'str', 'ok': CAST(NULL AS BOOLEAN)}]) AS x FROM r)
SELECT x.op AS op, x.kind AS kind, count(*) FILTER (x.ok) AS n_true, count(*) FILTER (NOT x.ok) AS n_false, count(*) FILTER (x.ok IS NULL) AS n_error FROM t GROUP BY ALL""",
    "text_measures": f"SELECT doc_id, {_words('text')} AS n_words, length(text) AS n_chars FROM documents",
    "content_groups": r"""
SELECT 'sha256:' || sha256(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g')) AS fingerprint, count(*) AS n, min(doc_id) AS first_doc
FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "heading_sections": f"SELECT section, count(*) AS n FROM (SELECT {_NAMED} AS section FROM (SELECT {_HEADING} AS h FROM (SELECT DISTINCT entry_id, title FROM outline_entries))) GROUP BY ALL",
    "citation_missing_reference": f"SELECT c.* FROM (SELECT DISTINCT manuscript_id, {_key("r")} AS reference_id FROM (SELECT manuscript_id, unnest(reference_ids) AS r FROM citations)) c ANTI JOIN (SELECT DISTINCT manuscript_id, {_key("reference_id")} AS reference_id FROM bib_references) r USING (manuscript_id, reference_id) WHERE reference_id IS NOT NULL AND manuscript_id IS NOT NULL",
    "uncited_reference": f"SELECT r.* FROM (SELECT DISTINCT manuscript_id, {_key("reference_id")} AS reference_id FROM bib_references) r ANTI JOIN (SELECT DISTINCT manuscript_id, {_key("r")} AS reference_id FROM (SELECT manuscript_id, unnest(reference_ids) AS r FROM citations)) c USING (manuscript_id, reference_id) WHERE reference_id IS NOT NULL AND manuscript_id IS NOT NULL",
    "duplicate_reference": f"""
SELECT manuscript_id, repeated, count(DISTINCT ref_key) AS n, min(ref_key) AS first_member, max(ref_key) AS last_member
FROM (SELECT manuscript_id, ref_key, trim(regexp_replace({_fold("raw_text")}, '[\\s\\x0B\\p{{Z}}]+', ' ', 'g')) AS repeated FROM bib_references) WHERE repeated <> '' GROUP BY ALL HAVING count(DISTINCT ref_key) > 1""",
    "duplicate_doi": f"""
SELECT manuscript_id, repeated, count(DISTINCT ref_key) AS n, min(ref_key) AS first_member, max(ref_key) AS last_member
FROM (SELECT manuscript_id, ref_key, regexp_replace({_fold("doi")}, '^https://doi\\.org/', '') AS repeated FROM bib_references) WHERE repeated <> '' GROUP BY ALL HAVING count(DISTINCT ref_key) > 1""",
    "incomplete_records": """
SELECT 'reference' AS record, x.part AS part, sum(x.n)::BIGINT AS n_missing FROM (SELECT unnest([{'part': 'title', 'n': (trim(coalesce(title, '')) = '')::INT}, {'part': 'doi', 'n': (trim(coalesce(doi, '')) = '')::INT},
  {'part': 'source_title', 'n': (trim(coalesce(source_title, '')) = '')::INT}, {'part': 'pub_year', 'n': (trim(coalesce(pub_year, '')) = '')::INT}]) AS x FROM bib_references) GROUP BY ALL
UNION ALL SELECT 'evidence', x.part, sum(x.n)::BIGINT FROM (SELECT unnest([{'part': 'locator', 'n': (trim(coalesce(locator, '')) = '')::INT}, {'part': 'evidence_hash', 'n': (trim(coalesce(evidence_hash, '')) = '')::INT}]) AS x FROM evidence_records) GROUP BY ALL""",
    "layer_ancestors": f"WITH RECURSIVE {_ANCESTORS} SELECT root, node, level FROM up",
    "resolve_layers": f"WITH RECURSIVE {_RESOLVED} SELECT *, resolution <> 'CONFLICT' AS effective FROM resolved",
    "resolution_classes": f"WITH RECURSIVE {_RESOLVED} SELECT resolution, resolution <> 'CONFLICT' AS effective, count(*) AS n FROM resolved GROUP BY ALL",
    "resolved_status": f"""
WITH RECURSIVE {_RESOLVED},
used AS (SELECT r.root, x.status FROM resolved r JOIN (SELECT DISTINCT {_key("profile_id")} AS layer, profile_version AS version, rule_id, status FROM profile_rules) x USING (layer, version, rule_id) WHERE r.resolution <> 'CONFLICT'),
late AS (SELECT DISTINCT root FROM up JOIN layer_rows ON layer = node WHERE {_STALE}),
states AS (SELECT root, bool_or(status = 'STALE') AS any_stale, bool_and(status IN ('VERIFIED', 'NOT_APPLICABLE')) AS all_good, bool_or(status IN ('UNKNOWN', 'PARTIAL')) AS any_open FROM used GROUP BY ALL)
SELECT c.root, CASE WHEN conflicted THEN 'CONFLICTED' WHEN late.root IS NOT NULL OR coalesce(any_stale, false) THEN 'STALE' WHEN coalesce(all_good, true) THEN 'VERIFIED' WHEN any_open THEN 'PARTIAL' ELSE 'UNKNOWN' END AS resolved_status
FROM (SELECT root, bool_or(resolution = 'CONFLICT') AS conflicted FROM resolved GROUP BY ALL) c LEFT JOIN states ON states.root = c.root LEFT JOIN late ON late.root = c.root""",
    "provenance_issues": f"""
WITH {_PROV}
SELECT DISTINCT rule_key, 'MISSING_PROVENANCE' AS issue, '' AS subject FROM profile_rules WHERE status = 'VERIFIED' AND coalesce(len(provenance), 0) = 0
UNION SELECT rule_key, 'UNKNOWN_SOURCE', coalesce(sid, '') FROM j WHERE NOT has_s
UNION SELECT rule_key, 'UNKNOWN_EVIDENCE', coalesce(eid, '') FROM j WHERE has_s AND NOT has_e
UNION SELECT rule_key, 'EVIDENCE_SOURCE_MISMATCH', coalesce(eid, '') FROM j WHERE has_s AND has_e AND owner IS DISTINCT FROM sid
UNION SELECT rule_key, 'EVIDENCE_HASH_MISMATCH', coalesce(eid, '') FROM j WHERE has_s AND has_e AND NOT hash_ok
UNION SELECT rule_key, 'NON_OFFICIAL_VERIFIED_SOURCE', coalesce(source_type, '') FROM j WHERE has_s AND has_e AND status = 'VERIFIED' AND coalesce(source_type, '') NOT IN ('POLICY', 'WEB_PAGE', 'PDF')
UNION SELECT rule_key, 'UNVERIFIED_SOURCE', coalesce(sid, '') FROM j WHERE has_s AND has_e AND status = 'VERIFIED' AND verification_status IS DISTINCT FROM 'VERIFIED'
UNION SELECT rule_key, 'INVALID_VERIFIED_CONFIDENCE', coalesce(confidence, '') FROM j WHERE has_s AND has_e AND status = 'VERIFIED' AND coalesce(confidence, '') NOT IN ('HIGH', 'MEDIUM')""",
    "layer_issues": f"""
WITH {_LAYERS}, rules AS (SELECT DISTINCT rule_key, {_key("profile_id")} AS layer, profile_version AS version, rule_id, coalesce(rule_value, 'null') AS value, status FROM profile_rules)
SELECT layer, version, 'INVALID_PRECEDENCE' AS issue FROM layer_rows WHERE precedence IS DISTINCT FROM CASE profile_kind WHEN 'PUBLISHER' THEN 100 WHEN 'JOURNAL' THEN 200 WHEN 'ARTICLE_TYPE' THEN 300 END
UNION SELECT layer, version, 'STALE_PROFILE' FROM layer_rows WHERE {_STALE}
UNION SELECT layer, version, CASE WHEN min(value) = max(value) THEN 'DUPLICATE_RULE' ELSE 'EQUAL_LEVEL_CONFLICT' END FROM rules GROUP BY layer, version, rule_id HAVING count(*) > 1
UNION SELECT layer, version, 'INFLATED_PROFILE_STATUS' FROM layer_rows WHERE status = 'VERIFIED' AND (layer, version) IN (SELECT (layer, version) FROM rules WHERE layer IS NOT NULL AND status IS DISTINCT FROM 'VERIFIED')""",
    "fingerprint_digest": f"WITH RECURSIVE {_TEXTS} SELECT record_id, count(*) AS n, 'sha256:' || sha256(CAST(to_json(list(text ORDER BY part, place)) AS VARCHAR)) AS digest FROM filled GROUP BY ALL",
    "multiset_preservation": "SELECT l_suppkey, l_partkey, count(*) FILTER (l_returnflag = 'R') AS n_before, count(*) FILTER (l_returnflag = 'A') AS n_after FROM lineitem GROUP BY ALL HAVING count(*) FILTER (l_returnflag = 'R') <> count(*) FILTER (l_returnflag = 'A')",
    "compliance_delta": f"""
WITH c AS (SELECT manuscript_id, e.key AS rule_id, upper(trim(e.value)) AS status, verified_at, report_id FROM (SELECT *, unnest(map_entries(compliance_checks)) AS e FROM verification_reports WHERE verified_at IS NOT NULL) WHERE e.value IS NOT NULL),
o AS (SELECT * FROM c WHERE verified_at < {AS_OF} QUALIFY row_number() OVER (PARTITION BY manuscript_id, rule_id ORDER BY verified_at DESC, report_id DESC, status DESC) = 1),
n AS (SELECT * FROM c WHERE verified_at >= {AS_OF} QUALIFY row_number() OVER (PARTITION BY manuscript_id, rule_id ORDER BY verified_at DESC, report_id DESC, status DESC) = 1),
r(s, k) AS (VALUES ('PASS', 0), ('NOT_APPLICABLE', 0), ('WARNING', 1), ('UNKNOWN', 2), ('BLOCKED', 3), ('EVALUATION_ERROR', 3), ('FAIL', 3))
SELECT coalesce(o.manuscript_id, n.manuscript_id) AS manuscript_id, coalesce(o.rule_id, n.rule_id) AS rule_id, o.status AS old_status, n.status AS new_status,
  CASE WHEN o.status IS NULL THEN 'NEW' WHEN n.status IS NULL THEN 'RESOLVED' WHEN n.status = 'PASS' AND o.status NOT IN ('PASS', 'NOT_APPLICABLE') THEN 'RESOLVED' WHEN o.status = n.status THEN 'UNCHANGED' WHEN rn.k > ro.k THEN 'WORSENED' ELSE 'IMPROVED' END AS change,
  coalesce(n.status IN ('FAIL', 'BLOCKED', 'EVALUATION_ERROR') AND NOT coalesce(o.status IN ('FAIL', 'BLOCKED', 'EVALUATION_ERROR'), false), false) AS new_blocker
FROM o FULL JOIN n ON o.manuscript_id = n.manuscript_id AND o.rule_id = n.rule_id LEFT JOIN r ro ON ro.s = o.status LEFT JOIN r rn ON rn.s = n.status""",
    "plan_log_reconcile": """
WITH l AS (SELECT o_custkey, o_orderkey, count(l_orderkey) AS l FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY ALL)
SELECT o_custkey, CASE WHEN bool_and(l > 0) AND count(*) = sum(l) THEN 'PASS' ELSE 'FAIL' END AS all_accounted_for, CASE WHEN max(l) <= 1 THEN 'PASS' ELSE 'FAIL' END AS no_duplicates, 'PASS' AS no_unknown FROM l GROUP BY ALL""",
    "verification_rollup": """
WITH r AS (SELECT DISTINCT report_id, verification_status, len(list_filter(map_values(preservation_checks), lambda v: upper(trim(v)) = 'FAIL')) > 0 AS t, len(list_filter(map_values(compliance_checks), lambda v: upper(trim(v)) = 'FAIL')) > 0 AS c FROM verification_reports)
SELECT verification_status, CASE WHEN coalesce(t, false) THEN 'TAMPER_DETECTED' WHEN coalesce(c, false) THEN 'VERIFICATION_FAILED' ELSE 'VERIFIED_CANDIDATE' END AS derived_status, count(*) AS n FROM r GROUP BY ALL""",
    "section_order_check": f"""
WITH RECURSIVE {_OUTLINE}, f AS (SELECT record_id, list_position(['introduction', 'results', 'discussion', 'methods'], section) AS r, min(seq) AS s FROM labelled WHERE section IN ('introduction', 'results', 'discussion', 'methods') GROUP BY ALL)
SELECT record_id, count(*) AS n_labels, list(s ORDER BY r) = list(s ORDER BY s) AS in_order FROM f GROUP BY ALL""",
    "block_intervals": f"""
WITH RECURSIVE {_OUTLINE}, z AS (SELECT record_id, min(seq) AS lo, max(seq) + 1 AS hi FROM labelled GROUP BY ALL),
marks AS (SELECT record_id, section AS label, seq AS start, 1 AS k FROM labelled WHERE section IS NOT NULL UNION ALL SELECT record_id, 'front_matter', lo, 0 FROM z),
ended AS (SELECT record_id, label, start, coalesce(lead(start) OVER (PARTITION BY record_id ORDER BY start, k), hi) AS "end" FROM marks JOIN z USING (record_id))
SELECT * FROM ended WHERE "end" > start""",
    "stable_ids": f"""
WITH RECURSIVE {_PARAS}, b AS (SELECT record_id, node_path, 'tb_' || substr(sha256(coalesce(text, '')), 1, 16) AS base FROM paras),
n AS (SELECT *, row_number() OVER (PARTITION BY record_id, base ORDER BY node_path) AS k FROM b)
SELECT record_id, node_path, CASE WHEN k = 1 THEN base ELSE base || '.' || k END AS stable_id FROM n""",
    "section_pairs": f"""
WITH RECURSIVE {_OUTLINE}, a AS (SELECT record_id, title AS named, row_number() OVER (PARTITION BY record_id ORDER BY seq) AS k FROM labelled WHERE section IS NOT NULL),
b AS (SELECT record_id, title AS free, row_number() OVER (PARTITION BY record_id ORDER BY seq) AS k FROM labelled WHERE section IS NULL)
SELECT record_id, k, named, free FROM a JOIN b USING (record_id, k)""",
    "extracted_rules": _candidates("evidence_records", "evidence_id", "evidence_text"),
    "extraction_f1": f"""
WITH {_LOW_LIMITS}, t AS (SELECT DISTINCT evidence_id FROM evidence_records WHERE contains(lower(evidence_text), 'words')), p AS (SELECT DISTINCT evidence_id FROM limits WHERE unit = 'words'),
c AS (SELECT (SELECT count(*) FROM t) AS n_true, (SELECT count(*) FROM p) AS n_proposed, (SELECT count(*) FROM t JOIN p USING (evidence_id)) AS n_hit)
SELECT n_true, n_proposed, n_hit, round(n_hit / n_proposed, 6) AS precision, round(n_hit / n_true, 6) AS recall, round(2 * (n_hit / n_proposed) * (n_hit / n_true) / (n_hit / n_proposed + n_hit / n_true), 6) AS f1 FROM c""",
    "requirement_gaps": """
WITH o AS (SELECT DISTINCT owner FROM source_records WHERE owner IS NOT NULL), k(kind) AS (VALUES ('POLICY'), ('PDF'), ('WEB_PAGE'), ('FAQ'), ('DATASET'))
SELECT o.owner, k.kind, 10 AS least, count(s.source_id) AS n FROM o CROSS JOIN k LEFT JOIN source_records s ON s.owner = o.owner AND s.source_type = k.kind GROUP BY ALL HAVING count(s.source_id) < 10""",
    "manifest_check": """
WITH d AS (SELECT source_id, evidence_id AS path, count(*) AS n, min(evidence_hash) AS want FROM evidence_records WHERE source_id IS NOT NULL AND evidence_hash IS NOT NULL GROUP BY ALL),
a AS (SELECT source_id, evidence_id AS path, min('sha256:' || sha256(evidence_text)) AS have FROM evidence_records WHERE source_id IS NOT NULL GROUP BY ALL)
SELECT source_id, path, CASE WHEN n IS NULL THEN 'UNDECLARED' WHEN n > 1 THEN 'DECLARED_TWICE' ELSE 'CHANGED' END AS problem FROM d FULL JOIN a USING (source_id, path) WHERE n IS NULL OR n > 1 OR want IS DISTINCT FROM have""",
    "coverage_ratio": f"""
WITH {_RULES}, x AS (SELECT layer, coalesce(critical_for_readiness, false) AS c, status = 'VERIFIED' AND machine_checkable AS r FROM unique_rules)
SELECT layer, round(100 * avg(r::INT), 2) AS overall, coalesce(round(100 * avg(CASE WHEN c THEN r::INT END), 2), 0) AS critical, count(*) FILTER (c AND NOT r) AS n_blockers FROM x GROUP BY ALL""",
    "session_transitions": """
WITH t AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_state FROM events)
SELECT event_type, previous_state, (coalesce(previous_state, '') || '>' || event_type) IN ('>signup', '>view', 'signup>view', 'signup>click', 'view>view', 'view>click', 'view>purchase', 'view>error', 'click>view', 'click>purchase', 'click>error', 'purchase>view', 'error>view', 'error>signup') AS valid_transition, count(*) AS n FROM t GROUP BY ALL""",
    "block_membership": f"""
WITH RECURSIVE {_OUTLINE}, z AS (SELECT record_id, min(seq) AS lo, max(seq) + 1 AS hi FROM labelled GROUP BY ALL),
marks AS (SELECT record_id, section AS label, seq AS start, 1 AS k FROM labelled WHERE section IS NOT NULL UNION ALL SELECT record_id, 'front_matter', lo, 0 FROM z),
ended AS (SELECT record_id, label, start, coalesce(lead(start) OVER (PARTITION BY record_id ORDER BY start, k), hi) AS finish FROM marks JOIN z USING (record_id))
SELECT l.record_id, l.seq, e.label FROM labelled l JOIN ended e ON e.record_id = l.record_id AND l.seq >= e.start AND l.seq < e.finish""",
    "citation_expand": f"WITH {_MARKERS} SELECT DISTINCT citation_id, numbers FROM expanded",
    "numbers_fingerprint": f"""
WITH RECURSIVE {_TEXTS}, nums AS (SELECT record_id, part, place, regexp_extract_all(text, '{_NUMBER}', 1) AS v FROM filled)
SELECT record_id, sum(len(v))::BIGINT AS n, 'sha256:' || sha256(CAST(to_json(flatten(list(list_transform(v, lambda x: replace(x, ' ', '')) ORDER BY part, place))) AS VARCHAR)) AS digest FROM nums WHERE len(v) > 0 GROUP BY ALL""",
    "number_tokens": f"""
SELECT doc_id, len(regexp_extract_all(t, '{_NUMBER}', 1)) AS n_numbers, len(regexp_extract_all(t, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:fig(?:ure)?|table)\\s*[A-Za-z0-9.-]+')) AS n_figures, list_sort(regexp_extract_all(t, '\\[\\d+(?:\\s*[-,]\\s*\\d+)*\\]')) AS citations
FROM (SELECT doc_id, {_normal("text")} AS t FROM documents)""",
    "layer_shapes": f"""
WITH RECURSIVE {_ANCESTORS}, loops AS (SELECT DISTINCT l.child AS root FROM links l JOIN up ON up.root = l.parent AND up.node = l.child)
SELECT root, count(*) - 1 AS n_ancestors, max(level) AS depth, root IN (SELECT root FROM loops) AS cyclic FROM up GROUP BY ALL""",
    "scientific_diff": f"""
WITH t AS (SELECT l_orderkey, l_linenumber, {_sentence("l_discount")} AS a, {_sentence("l_tax")} AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, {", ".join(f"{_changed(n)} AS {n}" for n in _SCIENCE)}, CASE WHEN a = b THEN 'SAFE' ELSE 'REVIEW_REQUIRED' END AS diff_status FROM t""",
    "section_reorder": f"""
WITH RECURSIVE {_OUTLINE}, k AS (SELECT record_id, seq, section, row_number() OVER (PARTITION BY record_id ORDER BY seq) AS slot, row_number() OVER (PARTITION BY record_id ORDER BY {_RANKED}, seq) AS place FROM labelled WHERE {_RANKED} > 0)
SELECT a.record_id, a.seq, a.section, b.seq AS new_seq FROM k a JOIN k b ON b.record_id = a.record_id AND b.slot = a.place
UNION ALL SELECT record_id, seq, section, seq FROM labelled WHERE coalesce({_RANKED}, 0) = 0""",
    "section_neighbours": f"""
WITH RECURSIVE {_OUTLINE}
SELECT a.record_id, a.title AS named, min(b.title) AS free FROM labelled a JOIN labelled b ON b.record_id = a.record_id AND b.section IS NULL AND abs(a.seq - b.seq) = 1 WHERE a.section IS NOT NULL GROUP BY a.record_id, a.seq, a.title HAVING count(*) = 1""",
    "numbered_headings": """
WITH RECURSIVE e AS (SELECT DISTINCT entry_id, manuscript_id, seq, title FROM outline_entries WHERE manuscript_id IS NOT NULL),
h AS (SELECT manuscript_id, row_number() OVER (PARTITION BY manuscript_id ORDER BY seq, entry_id, title) AS k, try_cast(regexp_extract(title, '^[\\s\\x0B]*(\\d+)(?:\\.(\\d+))?[.)]?[\\s\\x0B]+[^\\s\\x0B]', 1) AS INT) AS a, try_cast(regexp_extract(title, '^[\\s\\x0B]*(\\d+)(?:\\.(\\d+))?[.)]?[\\s\\x0B]+[^\\s\\x0B]', 2) AS INT) AS b FROM e),
walk(manuscript_id, k, top, sub, n) AS (
  SELECT manuscript_id, 0::BIGINT, 0, 0, 0 FROM (SELECT DISTINCT manuscript_id FROM h)
  UNION ALL SELECT h.manuscript_id, h.k, CASE WHEN b IS NULL AND a = top + 1 THEN a ELSE top END, CASE WHEN b IS NULL AND a = top + 1 THEN 0 WHEN a = top AND b = sub + 1 THEN b ELSE sub END, n + CASE WHEN (b IS NULL AND a = top + 1) OR (a = top AND b = sub + 1) THEN 1 ELSE 0 END
  FROM walk JOIN h ON h.manuscript_id = walk.manuscript_id AND h.k = walk.k + 1)
SELECT manuscript_id, CAST(max(k) AS INT) AS n_headings, max(n) AS n_accepted FROM walk GROUP BY ALL""",
    "citation_linkage": f"""
WITH {_MARKERS}, s AS (SELECT manuscript_id, CAST(ref_key % 100 AS INT) AS number, count(*) AS n FROM bib_references GROUP BY ALL),
each AS (SELECT DISTINCT manuscript_id, citation_id, number FROM (SELECT manuscript_id, citation_id, unnest(CASE WHEN len(numbers) > 0 THEN numbers ELSE [NULL] END) AS number FROM expanded))
SELECT e.manuscript_id, e.citation_id, count(e.number) AS n_numbers, count(s.n) AS n_linked, CASE WHEN count(e.number) > 0 AND count(s.n) = count(e.number) AND max(s.n) = 1 THEN 'HIGH' ELSE 'LOW' END AS confidence
FROM each e LEFT JOIN s ON s.manuscript_id = e.manuscript_id AND s.number = e.number GROUP BY ALL""",
    "evidence_segments": f"WITH {_SEGMENTS} SELECT * FROM segs",
    "candidate_conflicts": f"WITH {_GUIDE} SELECT * FROM clash",
    "review_queue": f"""
WITH {_GUIDE}
SELECT f.doc_id, f.seq, f.rule_id, f.value, CASE WHEN s.segment IS NULL THEN 'UNSUPPORTED' WHEN f.rule_id IN (SELECT rule_id FROM clash) THEN 'CONFLICTED' WHEN regexp_full_match(f.value, '\\d+') AND NOT contains(replace(s.segment, ',', ''), f.value) THEN 'UNSUPPORTED' ELSE 'SUPPORTED' END AS review
FROM found f LEFT JOIN segs s USING (doc_id, seq)""",
    "curated_diff": f"""
WITH p AS (SELECT rule_id, min({{'n': CAST(value AS INT), 'o': operator, 'm': CASE rule_id WHEN 'extended_data.max_count' THEN 'CONDITIONAL' ELSE 'ALWAYS' END}}) AS x FROM ({_candidates("evidence_records", "evidence_id", "evidence_text")}) WHERE operator = 'LTE' GROUP BY ALL),
c AS (SELECT rule_id, min({{'n': try_cast(rule_value AS INT), 'o': operator, 'm': applicability_mode}}) AS x FROM profile_rules WHERE status = 'VERIFIED' AND operator = 'LTE' GROUP BY ALL)
SELECT coalesce(p.rule_id, c.rule_id) AS rule_id, CASE WHEN c.rule_id IS NULL THEN 'NEW_SUPPORTED_CANDIDATE' WHEN p.rule_id IS NULL THEN 'MISSING_EXISTING_RULE' WHEN p.x.n IS DISTINCT FROM c.x.n OR p.x.o IS DISTINCT FROM c.x.o THEN 'VALUE_CONFLICT'
  WHEN p.x.m IS DISTINCT FROM c.x.m THEN 'APPLICABILITY_CONFLICT' ELSE 'MATCH_EXISTING' END AS comparison FROM p FULL JOIN c ON p.rule_id = c.rule_id""",
    "file_kinds": f"""
WITH names AS (SELECT source_path AS name FROM source_records UNION ALL SELECT title FROM outline_entries),
parts AS (SELECT name, translate(lower(regexp_replace(name, '\\.[^./]*$', '')), '- ', '__') AS stem, list_filter(string_split(name, '/'), lambda p: p NOT IN ('', '.')) AS p FROM names WHERE name IS NOT NULL)
SELECT {_KIND} AS kind, NOT starts_with(name, '/') AND len(p) > 0 AND len(list_filter(p, lambda x: NOT regexp_full_match(x, '[A-Za-z0-9][A-Za-z0-9._ -]*'))) = 0 AS safe, count(*) AS n FROM parts GROUP BY ALL""",
    "visible_text": r"""
WITH pages AS (SELECT doc_id, '<html><script>var x = 1;</script><nav>menu</nav><p>' || text || '</p><div style=''display: none''>no</div><p>Q&amp;A</p></html>' AS p FROM documents WHERE text IS NOT NULL),
bare AS (SELECT doc_id, regexp_replace(regexp_replace(p, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>|<nav[^>]*>.*?</nav>|<aside[^>]*>.*?</aside>', ' ', 'g'), '(?is)<[^>]*(?:hidden|display\s*:\s*none)[^>]*>.*?</[^>]+>', ' ', 'g') AS p FROM pages)
SELECT doc_id, trim(regexp_replace(replace(regexp_replace(p, '<[^>]+>', chr(10), 'g'), '&amp;', '&'), '[\s\x0B\p{Z}\x1c-\x1f\x{85}]+', ' ', 'g')) AS visible FROM bare""",
    "reference_roundtrip": r"""
WITH raw AS (SELECT ref_key, ref_key || '. ' || array_to_string(list_transform(authors, lambda a: regexp_replace(a, '^(.*) (\S)$', '\1, \2.')), '; ') || ' ' || trim(regexp_replace(title, '[\s\x0B\p{Z}]+', ' ', 'g')) || '. ' || source_title || ' ' || volume || '(' || issue || '), ' || pages_or_article_number || ' (' || pub_year || ').' AS raw FROM bib_references),
body AS (SELECT ref_key, raw, regexp_extract(raw, '^\s*\d+\s*[.)]\s+(.+)$', 1) AS b, '^([^,;.&]+, (?:[A-Z]\.(?:[- ]?[A-Z]\.)*)(?:(?:; |, | & )[^,;.&]+, (?:[A-Z]\.(?:[- ]?[A-Z]\.)*))*)\.? ([^.]+)\. (.+?) (\d+)(?:\((\d+)\))?, ([\p{L}\p{N}_–-]+) \((\d{4})\)\.$' AS layout FROM raw WHERE raw IS NOT NULL),
part AS (SELECT ref_key, raw, regexp_matches(b, layout) AS fits, nullif(regexp_extract(b, layout, 1), '') AS a, nullif(regexp_extract(b, layout, 2), '') AS t, nullif(regexp_extract(b, layout, 3), '') AS s, nullif(regexp_extract(b, layout, 4), '') AS v, nullif(regexp_extract(b, layout, 5), '') AS i, nullif(regexp_extract(b, layout, 6), '') AS p, nullif(regexp_extract(b, layout, 7), '') AS y FROM body)
SELECT ref_key, CASE WHEN fits AND ref_key > 0 THEN 'HIGH' WHEN fits THEN 'MEDIUM' ELSE 'LOW' END AS parse_confidence, v AS volume, y AS year, CASE WHEN a IS NULL THEN NULL ELSE len(string_split(a, '; ')) END AS n_authors,
  CASE WHEN fits AND ref_key > 0 THEN ref_key || '. ' || a || ' ' || t || '. ' || s || ' ' || v || coalesce('(' || i || ')', '') || ', ' || p || ' (' || y || ').' = raw END AS same FROM part""",
}
