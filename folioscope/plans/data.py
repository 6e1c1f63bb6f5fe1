"""Queries of the core training-data problems: nested records, orphan references, schema drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import drift, nested, orphans
from folioscope.sources.tables import table

#: The manuscript's elements, as TESTDATA describes them.
MANUSCRIPT = nested.Graph(
    {
        "manuscript": (), "section": ("object_id", "title", "level"), "paragraph": ("object_id", "text"),
        "source_locator": ("format", "status", "part", "index", "source_file", "line_start", "line_end"),
    },
    [
        nested.Edge("manuscript", "main_body", "section", True, "s"), nested.Edge("manuscript", "abstract", "section", True, "a"),
        nested.Edge("section", "subsections", "section", True, "s"), nested.Edge("section", "paragraphs", "paragraph", True, "p"),
        nested.Edge("section", "source_locator", "source_locator", False, "l"), nested.Edge("paragraph", "source_locator", "source_locator", False, "l"),
    ],
)
BODY, ABSTRACT = MANUSCRIPT.edges[0], MANUSCRIPT.edges[1]


def manuscript_nodes(spark: SparkSession, folder: str, elements: tuple[str, ...] = (), with_attrs: bool = True) -> DataFrame:
    """The nodes of all manuscripts' bodies and abstracts."""
    m = table(spark, folder, "manuscripts", "record_id", "main_body", "abstract")
    body = nested.shred_json(m, "record_id", "main_body", MANUSCRIPT, BODY, elements, with_attrs)
    front = nested.shred_arrays(m, "record_id", "abstract", MANUSCRIPT, ABSTRACT, with_attrs)
    return body.unionByName(front.where(F.col("relation").isin(*elements)) if elements else front)


def check_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return nested.shred_map(table(spark, folder, "verification_reports", "report_id", "preservation_checks"), "report_id", "preservation_checks", "preservation_check", "report")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every section, paragraph and preservation check with its parent's path."""
    nodes = manuscript_nodes(spark, folder, ("section", "paragraph"), with_attrs=False).withColumn("record_kind", F.lit("manuscript"))
    return nodes.unionByName(check_nodes(spark, folder).withColumn("record_kind", F.lit("report"))).select("record_kind", "record_id", "parent_path", "node_path")


def p1_relation(element: str, bare: str | None = None, **types: str):
    """A query for the flat table of one element of the manuscripts."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return nested.relation_table(manuscript_nodes(spark, folder, (element,)), MANUSCRIPT.relations()[element], bare, **types)

    return query


def p1_checks(spark: SparkSession, folder: str) -> DataFrame:
    return check_nodes(spark, folder).select(F.col("record_id").alias("report_id"), F.col("node_path").alias("check_name"), F.col("attrs")["value"].alias("result"))


def reference_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Parents and references of the four linked tables."""
    col = F.col

    def parents(name: str, key: str) -> DataFrame:
        return orphans.parent_entries(table(spark, folder, name, key, "received_at", "deleted_at"), name, col(key), col("received_at"), col("deleted_at"))

    cites = table(spark, folder, "citations", "citation_id", "reference_ids", "recorded_at").withColumn("v", F.explode("reference_ids"))
    rules = table(spark, folder, "profile_rules", "rule_key", "provenance", "recorded_at").withColumn("v", F.explode("provenance"))
    reports = table(spark, folder, "verification_reports", "report_id", "profile_id", "verified_at")
    profiles = table(spark, folder, "profiles", "profile_key", "parents", "received_at").withColumn("v", F.explode("parents"))
    refs = (
        orphans.references(cites, "citations", col("citation_id"), "reference_ids", "bib_references", col("v"), col("recorded_at"))
        .unionByName(orphans.references(rules, "profile_rules", col("rule_key"), "source_id", "source_records", col("v.source_id"), col("recorded_at")))
        .unionByName(orphans.references(rules, "profile_rules", col("rule_key"), "evidence_id", "evidence_records", col("v.evidence_id"), col("recorded_at")))
        .unionByName(orphans.references(reports, "verification_reports", col("report_id"), "profile_id", "profiles", col("profile_id"), col("verified_at")))
        .unionByName(orphans.references(profiles, "profiles", col("profile_key"), "profile_id", "profiles", col("v.profile_id"), col("received_at")))
    )
    known = parents("bib_references", "reference_id").unionByName(parents("source_records", "source_id"))
    return known.unionByName(parents("evidence_records", "evidence_id")).unionByName(parents("profiles", "profile_id")), refs


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """References that find no valid record."""
    return orphans.orphans(*reference_rows(spark, folder))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(p2_found(spark, folder))


#: The schema every file is read with; all else is rescued, and then promoted where approved.
FEED_TARGET = {"profile_id": "string", "rule_id": "string"}
FEED_APPROVED = {
    "schema_version": "string", "applicability_mode": "string", "submission_stages": "array<string>", "severity": "string", "unit": "string", "limit_value": "bigint", "owner": "string",
    "evaluation_scope": "string", "confidence": "string", "machine_checkable": "boolean", "freshness_window_days": "bigint", "verified_on": "date", "tags": "array<string>", "override_of": "string", "reviewer_note": "string",
}


def feed_changes(spark: SparkSession, folder: str) -> DataFrame:
    feed = table(spark, folder, "profile_feed", "feed_id", "file_seq", "payload")

    def seen(rows: DataFrame) -> DataFrame:
        keyed = drift.ingest(rows, FEED_TARGET).where("damaged is null").withColumn("rule", F.col("rule_id"))
        return drift.observed(keyed, FEED_TARGET, "feed_id", "file_seq", "rule")

    return drift.changes(seen(feed), only=lambda files: seen(feed.join(files, ["feed_id", "file_seq"], "left_semi")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every change of a field between successive files of a feed."""
    return feed_changes(spark, folder)


def p3_table(spark: SparkSession, folder: str) -> DataFrame:
    """All payloads in one typed table, values under former and later names included."""
    aliases = drift.rename_aliases(feed_changes(spark, folder), list(FEED_APPROVED))
    rows = drift.ingest(table(spark, folder, "profile_feed"), FEED_TARGET)
    return drift.promote(rows, FEED_APPROVED, aliases)


QUERIES = {
    "p1_found": p1_found,
    "p1_sections": p1_relation("section", level="int"),
    "p1_paragraphs": p1_relation("paragraph", "text"),
    "p1_locators": p1_relation("source_locator", index="int", line_start="int", line_end="int"),
    "p1_checks": p1_checks,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p3_table": p3_table,
}
