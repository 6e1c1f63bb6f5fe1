"""Queries of reports, deliveries and their changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text as T
from folioscope.operators import canonical, changes, layers, structure, verify
from folioscope.operators.orphans import clean_key
from folioscope.plans import audit as A
from folioscope.sources.tables import table

#: What a candidate may change, and the category that such a change accounts for.
ALLOWED, COVERS = ("abstract",), {"abstract": "abstract"}
#: Order in which kinds of problems are dealt with; others come last.
PRIORITY = {"EVALUATION_ERROR": 0, "BLOCKED": 1, "WARNING": 2, "UNKNOWN": 3}


def pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(original, record_id) of each record and of the one after it, which stands for its changed candidate:
    records that were delivered again are the same in these tables."""
    m = table(spark, folder, "manuscripts", "record_id")
    both = m.select(F.col("record_id").alias("original"), (F.col("record_id") + 1).alias("record_id")).join(m, "record_id")
    return both.select("original", F.col("original").alias("record_id")), both.select("original", "record_id")


def categories(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, category, digest) of a record's title, abstract, body, numbers and statements."""
    texts = A.manuscript_texts(spark, folder).where("part < 3")
    kind = F.when(F.col("part") == 0, "title").when(F.col("part") == 1, "abstract").otherwise("body")
    own = verify.fingerprint(texts.withColumn("category", kind), ["record_id", "category"], ["place"], F.col("text"))
    body = texts.where("part = 2").select("record_id", "place", F.posexplode(T.tokens(F.col("text"), T.NUMBER)).alias("k", "v"))
    numbers = verify.fingerprint(body.withColumn("category", F.lit("numbers")), ["record_id", "category"], ["place", "k"], F.col("v"))
    statements = table(spark, folder, "manuscripts", "record_id", "statements").select("record_id", F.lit("statements").alias("category"), canonical.logical_hash(F.to_json("statements")).alias("digest")).where("digest is not null")
    return own.select("record_id", "category", "digest").unionByName(numbers.select("record_id", "category", "digest")).unionByName(statements)


def preservation_results(spark: SparkSession, folder: str) -> DataFrame:
    """Each category of a record against that of its candidate."""
    old, new = pairs(spark, folder)
    c = categories(spark, folder)
    return changes.preservation(old.join(c, "record_id"), new.join(c, "record_id"), "original")


def regions(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, region, value): a record's title, abstract paragraphs and statements."""
    m = table(spark, folder, "manuscripts", "record_id", "title", "abstract", "statements")
    paragraphs = F.flatten(F.transform("abstract", lambda s: F.transform(F.coalesce(s["paragraphs"], F.expr("array()")), lambda p: p["text"])))
    return (
        m.select("record_id", F.lit("title").alias("region"), F.col("title").alias("value"))
        .unionByName(m.select("record_id", F.lit("abstract").alias("region"), F.to_json(paragraphs).alias("value")))
        .unionByName(m.select("record_id", F.explode("statements").alias("k", "value")).select("record_id", F.concat(F.lit("statement:"), F.col("k")).alias("region"), "value"))
    )


def observed_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Regions of a record that its candidate changed."""
    old, new = pairs(spark, folder)
    r = regions(spark, folder)
    return changes.observed(old.join(r, "record_id"), new.join(r, "record_id"), "original", "region", "value")


def unexpected_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Changes that aren't allowed, and categories that changed without an allowed cause."""
    return changes.unexpected(observed_changes(spark, folder), preservation_results(spark, folder).where("result = 'FAIL'"), ALLOWED, COVERS, "original")


def report_findings(spark: SparkSession, folder: str, last: bool) -> DataFrame:
    r = table(spark, folder, "verification_reports", "manuscript_id", "report_id", "verified_at", "findings").where("verified_at is not null and findings is not null")
    one = changes.first_of(r, "manuscript_id", ["verified_at", "report_id"], last)
    each = one.select("manuscript_id", F.explode("findings").alias("f")).where("f is not null")
    return each.groupBy("manuscript_id", F.col("f.check_name").alias("check_name")).agg(F.max("f.status").alias("status")).where("check_name is not null")


def report_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the last report of a manuscript against those of its first."""
    return changes.compared_findings(report_findings(spark, folder, False), report_findings(spark, folder, True), ["manuscript_id", "check_name"])


def finding_order(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of a report with their ids, in order of rule, and in order of what is dealt with first."""
    f = A.audit(spark, folder).where("finding_status not in ('PASS', 'NOT_APPLICABLE')").select("report_id", "rule_id", "finding_status")
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("finding_status")], F.lit(20))
    own = Window.partitionBy("report_id")
    return f.select("report_id", canonical.content_id("finding", F.col("rule_id"), F.col("report_id"), F.col("finding_status")).alias("finding_id"), F.row_number().over(own.orderBy("rule_id")).alias("place"), F.row_number().over(own.orderBy(rank, "rule_id")).alias("turn"))


def audit_json(spark: SparkSession, folder: str) -> DataFrame:
    """Each report's findings as one JSON text with sorted keys, and its hash."""
    f = A.audit(spark, folder).groupBy("report_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("rule_id").alias("a_rule"), F.col("finding_status").alias("b_status"))))).alias("findings"))
    return f.select("report_id", "findings", F.concat(F.lit("sha256:"), F.sha2("findings", 256)).alias("report_hash"))


def statement_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of statements that don't depend on the order of their keys."""
    m = table(spark, folder, "manuscripts", "record_id", "statements").where("statements is not null")
    return m.select("record_id", canonical.logical_hash(F.to_json("statements")).alias("statements_hash"))


def conflict_report(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the layers of each root conflict, with the rules that do."""
    r = layers.resolve(A.layer_candidates(spark, folder))
    bad = F.when(~F.col("effective"), F.col("rule_id"))
    return r.groupBy("root").agg(F.when(F.count(bad) > 0, "CONFLICTED").otherwise("CLEAR").alias("status"), F.count(bad).alias("n_conflicts"), F.min(bad).alias("first_rule"))


def same_identity(spark: SparkSession, folder: str) -> DataFrame:
    """References of a manuscript whose parts are all equal, however they were written."""
    b = table(spark, folder, "bib_references", "manuscript_id", "ref_key", "authors", "title", "source_title", "pub_year", "volume", "issue", "pages_or_article_number", "doi")
    parts = F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in (F.array_join("authors", "|"), *map(F.col, ("title", "source_title", "pub_year", "volume", "issue", "pages_or_article_number", "doi")))]))
    return verify.repeated(b, ["manuscript_id"], F.sha2(parts, 256), "ref_key").withColumnRenamed("repeated", "identity")


def paragraph_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of bodies by the role that their section or their beginning gives them."""
    top = A.labelled(spark, folder).select("record_id", F.concat(F.lit("s"), F.col("seq").cast("string")).alias("top"), "section")
    p = A.paragraphs(spark, folder).withColumn("top", F.substring_index("node_path", ".", 1))
    return p.join(top, ["record_id", "top"], "left").select("record_id", "node_path", changes.role(F.col("section"), F.coalesce("text", F.lit(""))).alias("role"))


def front_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The first four paragraphs of each body."""
    p = A.paragraphs(spark, folder).where("text is not null")
    place = F.row_number().over(Window.partitionBy("record_id").orderBy(A._preorder(F.col("node_path"))))
    return p.withColumn("place", place).where("place <= 4").select("record_id", "place", "node_path", structure.normal_heading(F.lower(F.substring("text", 1, 40))).alias("begins"))


def line_signals(spark: SparkSession, folder: str) -> DataFrame:
    """What the first line of a document and each heading as typed look like: title, front matter, numbered heading."""
    lines = table(spark, folder, "documents", "doc_id", "text").select(F.lit("document").alias("source"), F.col("doc_id").alias("row_key"), F.element_at(F.split("text", "\n"), 1).alias("line"))
    lines = lines.unionByName(table(spark, folder, "outline_entries", "entry_id", "title").distinct().select(F.lit("outline"), F.col("entry_id"), F.col("title")).toDF("source", "row_key", "line")).where("line is not null")
    parts = structure.numbered_parts(F.col("line"))
    return lines.select("source", "row_key", structure.plausible_title(F.col("line")).alias("plausible_title"), structure.front_matter(F.col("line")).alias("front_matter"), parts["major"].alias("major"), parts["minor"].alias("minor"), parts["level"].alias("level"))


def format_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The value that each layer's rules set at one stage: the last version's, conflicting if versions differ in value
    without a declared override, stale if the layer is, unknown if it is verified without provenance."""
    r = table(spark, folder, "profile_rules").withColumn("layer", clean_key(F.col("profile_id"))).where("layer is not null and array_contains(submission_stages, 'REVISION')")
    late = A.layer_rows(spark, folder).groupBy("layer").agg(F.bool_or(F.coalesce(layers.stale(F.col("last_verified_at"), F.col("freshness_window_days"), F.lit(A.AS_OF).cast("timestamp")), F.lit(False))).alias("late"))
    picked = r.groupBy("layer", "rule_id").agg(
        F.max_by(F.struct("rule_value", "status", (F.size(F.coalesce("provenance", F.expr("array()"))) > 0).alias("sourced")), F.struct("profile_version", "recorded_at", "rule_key")).alias("x"), F.countDistinct(F.coalesce("rule_value", F.lit("null"))).alias("n_values"),
        F.bool_or(F.coalesce((F.col("override_of") == F.col("rule_id")) & (F.coalesce("override_reason", F.lit("")) != ""), F.lit(False))).alias("declared"),
    )
    status = (
        F.when((F.col("n_values") > 1) & ~F.col("declared"), "CONFLICTED").when(F.coalesce("late", F.lit(False)), "STALE").when((F.col("x.status") == "VERIFIED") & ~F.col("x.sourced"), "UNKNOWN").otherwise(F.col("x.status"))
    )
    return picked.join(late, "layer", "left").select("layer", "rule_id", F.col("x.rule_value").alias("value"), status.alias("status"))


QUERIES = {
    f.__name__: f
    for f in (
        preservation_results, observed_changes, unexpected_changes, report_diff, finding_order, audit_json, statement_hashes, conflict_report, same_identity, paragraph_roles, front_paragraphs, line_signals, format_targets,
    )
}
