"""Queries of rule audits, integrity, verification, structure and guideline texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import bibliography as B
from folioscope.operators import guidelines as G
from folioscope.operators import layers, packaging, rules, structure, verify
from folioscope.operators.orphans import clean_key
from folioscope.plans.data import manuscript_nodes
from folioscope.sources.tables import table

#: Scopes that rules can be evaluated in.
SCOPES = (
    "METADATA_ARTICLE_TYPE", "TITLE_TEXT", "ABSTRACT_TEXT", "MAIN_BODY_EXCLUDING_ABSTRACT_METHODS_REFERENCES_FIGURE_LEGENDS_TABLES_SUPPLEMENT", "FIGURE_AND_TABLE_OBJECTS",
    "METADATA_COVER_LETTER_PRESENT", "STATEMENT_AUTHOR_CONTRIBUTIONS", "STATEMENT_COMPETING_INTERESTS", "STATEMENT_DATA_AVAILABILITY",
)
OFFICIAL_TYPES = ("POLICY", "WEB_PAGE", "PDF")
AS_OF = "2024-01-01 00:00:00"
SECTION_ORDER = ["introduction", "results", "discussion", "methods"]
#: Which kind of event may follow which in a session.
FLOW = {"": ("signup", "view"), "signup": ("view", "click"), "view": ("view", "click", "purchase", "error"), "click": ("view", "purchase", "error"), "purchase": ("view",), "error": ("view", "signup")}


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    nodes = manuscript_nodes(spark, folder, ("paragraph",)).where("not startswith(node_path, 'a')")
    return nodes.select("record_id", "node_path", F.coalesce(F.col("attrs")["text"], F.col("attrs")["_text"]).alias("text"))


def _preorder(path: Column) -> Column:
    """A node's path as numbers, so that sorting by it is preorder: a section, its paragraphs, its subsections."""
    return F.transform(F.split(path, r"\."), lambda x: F.struct(F.substring(x, 1, 1).alias("l"), F.substring(x, 2, 18).cast("long").alias("i")))


def manuscript_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, part, place, text): all texts of a record in order: title, abstract and body with their
    headings, references; normalised, blank ones left out."""
    m = table(spark, folder, "manuscripts", "record_id", "manuscript_id", "title")
    one = lambda letter, i: F.array(F.struct(F.lit(letter).alias("l"), i.cast("long").alias("i")))
    nodes = manuscript_nodes(spark, folder, ("section", "paragraph"))
    own = F.when(F.col("relation") == "section", F.col("attrs")["title"]).otherwise(F.coalesce(F.col("attrs")["text"], F.col("attrs")["_text"]))
    part = F.when(F.startswith("node_path", F.lit("a")), 1).otherwise(2)
    refs = table(spark, folder, "bib_references", "manuscript_id", "ref_key", "raw_text", "deleted_at").where("deleted_at is null")
    rows = (
        m.select("record_id", F.lit(0).alias("part"), one("t", F.lit(0)).alias("place"), F.col("title").alias("text"))
        .unionByName(nodes.select("record_id", part.alias("part"), _preorder(F.col("node_path")).alias("place"), own.alias("text")))
        .unionByName(m.join(refs, "manuscript_id").select("record_id", F.lit(3).alias("part"), one("r", F.col("ref_key")).alias("place"), F.col("raw_text").alias("text")))
    )
    return rows.withColumn("text", T.normalized(F.col("text"))).where("text != ''")


def outline(spark: SparkSession, folder: str) -> DataFrame:
    """Top sections of each manuscript's body, in order: bounded by one record."""
    nodes = manuscript_nodes(spark, folder, ("section",)).where("parent_path = 'root' and not startswith(node_path, 'a')")
    return nodes.select("record_id", F.col("ordinal").alias("seq"), F.col("attrs")["title"].alias("title"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return outline(spark, folder).withColumn("section", structure.section_name(T.compat_folded(F.col("title"))))


def latest_manuscripts(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "manuscripts", "manuscript_id", "record_id", "received_at", "title", "article_type", "abstract", "statements")
    best = m.groupBy("manuscript_id").agg(F.max(F.struct("received_at", "record_id")).alias("k")).select(F.col("k.record_id").alias("record_id"))
    return m.join(best, "record_id", "left_semi")


#: Targets that are measured in the rule's unit.
TEXTS = ("title", "abstract", "main_text")


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """(manuscript_id, target, fact_unit, cur_kind, cur_num, cur_str, cur_list): what is measured of each
    manuscript.  Texts are measured in words and characters; a missing title, abstract or body is no
    fact.  No table here holds figures, tables or supplements, so their lists are empty."""
    m = latest_manuscripts(spark, folder)
    nodes = manuscript_nodes(spark, folder, ("section", "paragraph"))
    text = F.when(F.col("relation") == "paragraph", F.coalesce(F.col("attrs")["text"], F.col("attrs")["_text"]))
    nodes = nodes.select("record_id", F.when(F.startswith("node_path", F.lit("a")), "abstract").otherwise("main_text").alias("target"), text.alias("text"))
    # The text is the paragraphs, one to a line.
    sized = nodes.groupBy("record_id", "target").agg(
        F.sum(F.coalesce(T.measure(F.col("text"), F.lit("words")), F.lit(0))).alias("words"), (F.sum(F.coalesce(F.length("text"), F.lit(0))) + F.greatest(F.count("text") - 1, F.lit(0))).alias("characters")
    )
    sized = m.select("manuscript_id", "record_id").join(sized, "record_id").select("manuscript_id", "target", "words", "characters")
    titles = m.where(F.trim("title") != "").select("manuscript_id", F.lit("title").alias("target"), T.measure(F.col("title"), F.lit("words")).alias("words"), F.length("title").alias("characters"), "title")
    refs = table(spark, folder, "bib_references", "manuscript_id", "reference_id", "deleted_at").where("deleted_at is null").groupBy("manuscript_id").agg(F.countDistinct("reference_id").alias("n"))
    named = labelled(spark, folder).where("section is not null").groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "section"))), lambda x: F.initcap(F.replace(x["section"], F.lit("_"), F.lit(" ")))).alias("names"))
    order = m.select("manuscript_id", "record_id").join(named, "record_id", "left").select("manuscript_id", F.coalesce("names", F.expr("cast(array() as array<string>)")).alias("names"))
    units = lambda df: df.select("manuscript_id", "target", F.explode(F.create_map(F.lit("words"), F.col("words").cast("double"), F.lit("characters"), F.col("characters").cast("double"))).alias("fact_unit", "v"))

    def fact(df: DataFrame, target: Column, unit: Column, kind: str, value: Column) -> DataFrame:
        as_num, as_str, as_list = (value if k == kind or (k, kind) == ("num", "bool") else F.lit(None) for k in ("num", "str", "list"))
        return df.select(
            "manuscript_id", target.alias("target"), unit.alias("fact_unit"), F.when(value.isNull(), "none").otherwise(kind).alias("cur_kind"), as_num.cast("double").alias("cur_num"), as_str.cast("string").alias("cur_str"),
            as_list.cast("array<string>").alias("cur_list"),
        )

    any_unit, statements = F.lit("any"), m.select("manuscript_id", F.explode("statements").alias("k", "v"))
    parts = [
        fact(units(sized), F.col("target"), F.col("fact_unit"), "num", F.col("v")), fact(units(titles), F.col("target"), F.col("fact_unit"), "num", F.col("v")), fact(titles, F.lit("title"), F.lit("text"), "str", F.col("title")),
        fact(m, F.lit("article_type"), any_unit, "str", F.col("article_type")), fact(refs, F.lit("references"), any_unit, "num", F.col("n")), fact(order, F.lit("section_order"), any_unit, "list", F.col("names")),
        fact(m, F.lit("figures_and_tables"), any_unit, "num", F.lit(0)), fact(m, F.lit("figure_files"), any_unit, "bool", F.lit(1)), fact(m, F.lit("supplementary_information"), any_unit, "bool", F.lit(0)),
        fact(statements, F.concat(F.lit("statements."), F.col("k")), any_unit, "str", F.col("v")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unique_rules(spark: SparkSession, folder: str) -> DataFrame:
    """One rule per layer, version and rule_id: the one recorded last."""
    r = table(spark, folder, "profile_rules").withColumn("layer", clean_key(F.col("profile_id"))).where("layer is not null")
    return r.groupBy("layer", "profile_version", "rule_id").agg(F.max_by(F.struct("rule_key", "target", "operator", "rule_value", "unit", "severity", "machine_checkable", "status", "applicability_mode", "critical_for_readiness", "evaluation_scope"), F.struct("recorded_at", "rule_key")).alias("r")).select("layer", "profile_version", "rule_id", "r.*")


def audit(spark: SparkSession, folder: str) -> DataFrame:
    reports = table(spark, folder, "verification_reports", "report_id", "manuscript_id", "profile_id", "profile_version").distinct().withColumn("layer", clean_key(F.col("profile_id"))).drop("profile_id")
    asked = F.when(F.col("target").isin(*TEXTS), F.when(F.col("unit").isin("words", "characters"), F.col("unit")).otherwise("text")).otherwise("any")
    return rules.findings(reports.join(unique_rules(spark, folder).withColumn("fact_unit", asked), ["layer", "profile_version"]), facts(spark, folder), "manuscript_id", SCOPES, ("fact_unit",))


def audit_findings(spark: SparkSession, folder: str) -> DataFrame:
    return audit(spark, folder).select("report_id", "rule_id", "finding_status")


def audit_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rules.summary(audit(spark, folder), "report_id")


def audit_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return rules.coverage(audit(spark, folder), "layer")


def audit_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return rules.rollup(audit(spark, folder), "report_id")


def operator_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """All 17 predicates of each part's type and brand, against a constant each."""
    p = table(spark, folder, "part", "p_partkey", "p_size", "p_brand", "p_type")
    cases = [("EQ", "15"), ("NE", "15"), ("LT", "15"), ("LTE", "15"), ("GT", "15"), ("GTE", "15"), ("EXISTS", "1"), ("NOT_EXISTS", "1")]
    texts = [("IN", '["Brand#11","Brand#23"]'), ("NOT_IN", '["Brand#11","Brand#23"]'), ("COUNT_EQ", "8"), ("COUNT_LTE", "7"), ("COUNT_GTE", "8"), ("MATCH_REGEX", '"#1[0-9]$"'), ("NOT_MATCH_REGEX", '"#1[0-9]$"'), ("CONTAINS", '"#2"'), ("NOT_CONTAINS", '"#2"'), ("LT", "15")]
    rows = p.select("p_partkey", "p_size", "p_brand", F.explode(F.array(*[F.struct(F.lit(o).alias("op"), F.lit(v).alias("v"), F.lit(k).alias("k")) for k, cs in (("num", cases), ("str", texts)) for o, v in cs])).alias("c"))
    typed = rows.select(
        "p_partkey", F.col("c.op").alias("op"), F.col("c.k").alias("cur_kind"), F.when(F.col("c.k") == "num", F.col("p_size").cast("double")).alias("cur_num"), F.when(F.col("c.k") == "str", F.col("p_brand")).alias("cur_str"),
        F.lit(None).cast("array<string>").alias("cur_list"), *rules.typed_value(F.col("c.v"), "exp"),
    )
    return typed.select("op", F.col("cur_kind").alias("kind"), rules.evaluate(F.col("op")).alias("ok")).groupBy("op", "kind").agg(F.count_if("ok").alias("n_true"), F.count_if(~F.col("ok")).alias("n_false"), F.count_if(F.col("ok").isNull()).alias("n_error"))


def text_measures(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents", "doc_id", "text")
    return d.select("doc_id", T.word_count(T.nfc(F.col("text"))).alias("n_words"), F.length("text").alias("n_chars"))


def content_groups(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents", "doc_id", "text").where("text is not null")
    return d.groupBy(T.content_fingerprint(F.col("text")).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def number_tokens(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents", "doc_id", "text").select("doc_id", T.normalized(F.col("text")).alias("text"))
    return d.select("doc_id", F.size(T.tokens(F.col("text"), T.NUMBER)).alias("n_numbers"), F.size(T.tokens(F.col("text"), T.FIGURE_OR_TABLE)).alias("n_figures"), T.multiset(T.tokens(F.col("text"), r"\[\d+(?:\s*[-,]\s*\d+)*\]")).alias("citations"))


def heading_sections(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "outline_entries", "entry_id", "title").distinct()
    return e.select(structure.section_name(T.compat_folded(F.col("title"))).alias("section")).groupBy("section").agg(F.count("*").alias("n"))


def cited(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "citations", "manuscript_id", "reference_ids")
    return c.select("manuscript_id", F.explode("reference_ids").alias("r")).select("manuscript_id", clean_key(F.col("r")).alias("reference_id"))


def known_references(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "bib_references", "manuscript_id", "reference_id").select("manuscript_id", clean_key(F.col("reference_id")).alias("reference_id"))


def citation_missing_reference(spark: SparkSession, folder: str) -> DataFrame:
    """References that a manuscript cites and its own bibliography hasn't."""
    return verify.missing(cited(spark, folder), known_references(spark, folder), ["manuscript_id", "reference_id"])


def uncited_reference(spark: SparkSession, folder: str) -> DataFrame:
    return verify.missing(known_references(spark, folder), cited(spark, folder), ["manuscript_id", "reference_id"])


def duplicate_reference(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "bib_references", "manuscript_id", "ref_key", "raw_text")
    return verify.repeated(b, ["manuscript_id"], T.squeezed(T.folded(F.col("raw_text"))), "ref_key")


def duplicate_doi(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "bib_references", "manuscript_id", "ref_key", "doi")
    return verify.repeated(b, ["manuscript_id"], F.regexp_replace(T.folded(F.col("doi")), "^https://doi\\.org/", ""), "ref_key")


def incomplete_records(spark: SparkSession, folder: str) -> DataFrame:
    """Required parts that references and evidence lack, counted."""
    b = table(spark, folder, "bib_references", "title", "doi", "source_title", "pub_year")
    e = table(spark, folder, "evidence_records", "locator", "evidence_hash")
    blank = lambda c: F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    count = lambda df, name: df.agg(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[blank(c) for c in df.columns])).alias("m")).select(F.lit(name).alias("record"), F.explode("m").alias("part", "n_missing"))
    return count(b, "reference").unionByName(count(e, "evidence"))


def profile_links(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "profiles", "profile_id", "parents")
    return p.select("profile_id", F.explode_outer("parents").alias("p")).select(clean_key(F.col("profile_id")).alias("child"), clean_key(F.col("p.profile_id")).alias("parent"))


def layer_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    return layers.ancestors(profile_links(spark, folder))


def layer_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """How many layers each one descends from, how far, and whether from itself."""
    links = profile_links(spark, folder)
    loops = layers.cycles(links).select(F.col("node").alias("root"), F.lit(True).alias("cyclic"))
    sizes = layers.ancestors(links).groupBy("root").agg((F.count("*") - 1).alias("n_ancestors"), F.max("level").alias("depth"))
    return sizes.join(loops, "root", "left").select("root", "n_ancestors", "depth", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def layer_rows(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "profiles").withColumn("layer", clean_key(F.col("profile_id"))).where("layer is not null")
    return p.groupBy("layer", F.col("profile_version").alias("version")).agg(F.max_by(F.struct("profile_kind", "precedence", "status", "last_verified_at", "freshness_window_days"), F.struct("received_at", "profile_key")).alias("p")).select("layer", "version", "p.*")


def layer_candidates(spark: SparkSession, folder: str) -> DataFrame:
    up = layer_ancestors(spark, folder)
    rank = layer_rows(spark, folder).groupBy("layer").agg(F.max("precedence").alias("precedence"))
    r = table(spark, folder, "profile_rules").withColumn("layer", clean_key(F.col("profile_id"))).where("layer is not null")
    r = r.select("layer", F.col("profile_version").alias("version"), "rule_id", "rule_version", F.col("rule_value").alias("value"), "override_of", "override_reason").distinct()
    return up.select("root", F.col("node").alias("layer")).join(rank, "layer").join(r, "layer")


def resolve_layers(spark: SparkSession, folder: str) -> DataFrame:
    return layers.resolve(layer_candidates(spark, folder))


def resolution_classes(spark: SparkSession, folder: str) -> DataFrame:
    return resolve_layers(spark, folder).groupBy("resolution", "effective").agg(F.count("*").alias("n"))


def resolved_status(spark: SparkSession, folder: str) -> DataFrame:
    resolved = resolve_layers(spark, folder)
    state = table(spark, folder, "profile_rules", "profile_id", "profile_version", "rule_id", "status").select(clean_key(F.col("profile_id")).alias("layer"), F.col("profile_version").alias("version"), "rule_id", "status").distinct()
    used = resolved.where("effective").join(state, ["layer", "version", "rule_id"]).select("root", "status")
    late = layer_rows(spark, folder).where(layers.stale(F.col("last_verified_at"), F.col("freshness_window_days"), F.lit(AS_OF).cast("timestamp"))).select("layer").distinct()
    roots = layer_ancestors(spark, folder).join(late, F.col("node") == F.col("layer")).select("root")
    return layers.resolved_status(resolved, used, roots)


def provenance_issues(spark: SparkSession, folder: str) -> DataFrame:
    pick = lambda df, key, *cols: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("received_at", *cols)).alias("x")).select(key, "x.*")
    s = pick(table(spark, folder, "source_records", "source_id", "source_type", "verification_status", "received_at"), "source_id", "source_type", "verification_status")
    e = pick(table(spark, folder, "evidence_records", "evidence_id", "source_id", "evidence_text", "evidence_hash", "received_at"), "evidence_id", "source_id", "evidence_text", "evidence_hash")
    return layers.provenance_issues(table(spark, folder, "profile_rules", "rule_key", "status", "confidence", "provenance"), s, e, OFFICIAL_TYPES)


def layer_issues(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "profile_rules", "rule_key", "profile_id", "profile_version", "rule_id", "rule_value", "status").distinct()
    r = r.select(clean_key(F.col("profile_id")).alias("layer"), F.col("profile_version").alias("version"), "rule_id", F.col("rule_value").alias("value"), "status")
    return layers.layer_issues(layer_rows(spark, folder), r, AS_OF)


def fingerprint_digest(spark: SparkSession, folder: str) -> DataFrame:
    return verify.fingerprint(manuscript_texts(spark, folder), ["record_id"], ["part", "place"], F.col("text"))


def numbers_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    p = manuscript_texts(spark, folder).select("record_id", "part", "place", F.posexplode(T.tokens(F.col("text"), T.NUMBER)).alias("k", "v"))
    return verify.fingerprint(p, ["record_id"], ["part", "place", "k"], F.replace("v", F.lit(" "), F.lit("")))


def scientific_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences made of each order line, before and after its discount is replaced by its tax."""
    line = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")
    whole = lambda c: F.col(c).cast("int").cast("string")
    sentence = lambda c: F.concat(F.lit("n = "), whole("l_quantity"), F.lit(", "), F.round(F.col(c) * 100).cast("int").cast("string"), F.lit("% (p < 0.0"), F.col("l_linenumber").cast("string"), F.lit("), Figure "), F.col("l_linenumber").cast("string"), F.lit(" ["), F.col("l_partkey").cast("string"), F.lit("]"))
    out = verify.scientific_diff(line, sentence("l_discount"), sentence("l_tax"), "l_orderkey", "l_linenumber")
    return out.select("l_orderkey", "l_linenumber", "percentage", "p_value", "citation", "figure_reference", "numeric", "diff_status")


def multiset_preservation(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem", "l_suppkey", "l_partkey", "l_returnflag")
    return verify.multiset_difference(line.where("l_returnflag = 'R'"), line.where("l_returnflag = 'A'"), ["l_suppkey"], "l_partkey")


def compliance_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Compliance checks of each manuscript in its reports up to a date, against those after it."""
    r = table(spark, folder, "verification_reports", "report_id", "manuscript_id", "verified_at", "compliance_checks").where("verified_at is not null")
    checks = r.select("manuscript_id", "verified_at", "report_id", F.explode("compliance_checks").alias("rule_id", "s")).select("manuscript_id", "rule_id", F.struct("verified_at", "report_id").alias("at"), F.upper(F.trim("s")).alias("status"), F.lit("BLOCKING").alias("severity")).where("status is not null")
    early = F.col("at.verified_at") < F.lit(AS_OF).cast("timestamp")
    return verify.delta(checks.where(early), checks.where(~early), ["manuscript_id", "rule_id"], "at")


def plan_log_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders", "o_orderkey", "o_custkey")
    logged = table(spark, folder, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey")
    return verify.reconcile(o, logged, "o_custkey", "o_orderkey")


def verification_rollup(spark: SparkSession, folder: str) -> DataFrame:
    r = verify.verification_rollup(table(spark, folder, "verification_reports", "report_id", "verification_status", "preservation_checks", "compliance_checks").dropDuplicates(["report_id"]), ["preservation_checks"], ["compliance_checks"])
    return r.groupBy("verification_status", "derived_status").agg(F.count("*").alias("n"))


def block_intervals(spark: SparkSession, folder: str) -> DataFrame:
    df = labelled(spark, folder)
    return structure.blocks(df, "record_id", "seq", F.col("section"))


def block_membership(spark: SparkSession, folder: str) -> DataFrame:
    df = labelled(spark, folder)
    return structure.members(df.select("record_id", "seq"), structure.blocks(df, "record_id", "seq", F.col("section")), "record_id", "seq").select("record_id", "seq", "label")


def section_order_check(spark: SparkSession, folder: str) -> DataFrame:
    return structure.in_order(labelled(spark, folder), "record_id", "seq", "section", SECTION_ORDER)


def section_reorder(spark: SparkSession, folder: str) -> DataFrame:
    return structure.reordered(labelled(spark, folder), "record_id", "seq", "section", SECTION_ORDER).select("record_id", "seq", "section", "new_seq")


def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    p = paragraphs(spark, folder)
    return structure.stable_ids(p, "record_id", "tb", F.col("text"), "node_path").select("record_id", "node_path", "stable_id")


def section_pairs(spark: SparkSession, folder: str) -> DataFrame:
    df = labelled(spark, folder)
    return structure.paired(df.where("section is not null").withColumnRenamed("title", "named"), df.where("section is null").withColumnRenamed("title", "free"), "record_id", "seq", "named", "free")


def section_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    df = labelled(spark, folder)
    return structure.neighbours(df.where("section is not null").withColumnRenamed("title", "named"), df.where("section is null").withColumnRenamed("title", "free"), "record_id", "seq", "named", "free")


def numbered_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Headings as typed in each manuscript's outline, and those whose numbers follow in sequence."""
    df = table(spark, folder, "outline_entries", "entry_id", "manuscript_id", "seq", "title").where("manuscript_id is not null").distinct()
    lists = df.groupBy("manuscript_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "entry_id", "title"))), lambda x: x["title"]).alias("h"))
    return lists.select("manuscript_id", F.size("h").alias("n_headings"), F.size(structure.numbered(F.col("h"))).alias("n_accepted"))


def citation_expand(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "citations", "citation_id", "raw_text").distinct()
    v = B.expand_marker(F.col("raw_text"))
    return c.select("citation_id", F.array_sort(v).alias("numbers"))


def citation_linkage(spark: SparkSession, folder: str) -> DataFrame:
    """Markers against the numbers of their manuscript's references, numbered by key."""
    refs = table(spark, folder, "bib_references", "manuscript_id", "ref_key").select("manuscript_id", F.pmod("ref_key", F.lit(100)).cast("int").alias("number"))
    return B.linkage(table(spark, folder, "citations", "manuscript_id", "citation_id", "raw_text"), refs, "manuscript_id", "citation_id", "raw_text", "number")


def reference_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """References written in the numbered layout from their fields, parsed and rendered again."""
    b = table(spark, folder, "bib_references", "ref_key", "authors", "title", "source_title", "volume", "issue", "pages_or_article_number", "pub_year")
    raw = B.from_fields(F.col("ref_key"), F.col("authors"), T.squeezed(F.col("title")), F.col("source_title"), F.col("volume"), F.col("issue"), F.col("pages_or_article_number"), F.col("pub_year"), F.lit(None).cast("string"))
    parsed = b.select("ref_key", raw.alias("raw")).where("raw is not null").select("ref_key", "raw", B.parse(F.col("raw")).alias("r"))
    return parsed.select("ref_key", F.col("r.parse_confidence").alias("parse_confidence"), F.col("r.volume").alias("volume"), F.col("r.year").alias("year"), F.size("r.authors").alias("n_authors"), (B.render(F.col("r")) == F.col("raw")).alias("same"))


def visible_text(spark: SparkSession, folder: str) -> DataFrame:
    """The text of pages made around each document that has text."""
    d = table(spark, folder, "documents", "doc_id", "text").where("text is not null")
    page = F.concat(F.lit("<html><script>var x = 1;</script><nav>menu</nav><p>"), F.col("text"), F.lit("</p><div style='display: none'>no</div><p>Q&amp;A</p></html>"))
    return d.select("doc_id", T.visible_text(page).alias("visible"))


def guideline_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text", "source", "doc_kind").where("doc_kind = 'guideline' and text is not null")


def evidence_segments(spark: SparkSession, folder: str) -> DataFrame:
    d = guideline_texts(spark, folder)
    return G.segments(d, "doc_id", T.squeezed(F.col("text")))


def extracted_rules(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "evidence_records", "evidence_id", "evidence_text").distinct()
    return G.candidates(e, "evidence_id", "evidence_text").select("evidence_id", "rule_id", "operator", "value", "unit")


def document_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that the segments of each guideline document state; a segment that is repeated in a document
    counts once, where it first stands."""
    found = G.candidates(evidence_segments(spark, folder), ["doc_id", "seq", "segment_hash"], "segment")
    return found.groupBy(*[c for c in found.columns if c != "seq"]).agg(F.min("seq").alias("seq"))


def candidate_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return G.conflicts(document_rules(spark, folder), [], ["doc_id", "seq"])


def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Each candidate (a rule as a segment states it) with its review, against its own segment."""
    found = document_rules(spark, folder)
    clashing = G.conflicts(found, [], ["doc_id", "seq"])
    return G.review(found, evidence_segments(spark, folder), clashing, ["doc_id", "seq"], "segment", []).select("doc_id", "seq", "rule_id", "value", "review")


def curated_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Limits that evidence states, per rule, against the limits of the curated rules."""
    low = lambda df: df.groupBy("rule_id").agg(F.min(F.struct(F.col("value").cast("int").alias("n"), "operator", "mode")).alias("x")).select("rule_id", F.col("x.n").cast("string").alias("value"), "x.operator", "x.mode")
    e = table(spark, folder, "evidence_records", "evidence_id", "evidence_text").distinct()
    curated = table(spark, folder, "profile_rules", "rule_id", "rule_value", "operator", "applicability_mode", "status").where("status = 'VERIFIED' and operator = 'LTE'").select("rule_id", F.col("rule_value").alias("value"), "operator", F.col("applicability_mode").alias("mode"))
    return verify.compared(low(G.candidates(e, "evidence_id", "evidence_text").where("operator = 'LTE'")), low(curated), ["rule_id"])


def extraction_f1(spark: SparkSession, folder: str) -> DataFrame:
    """Limits found in evidence against the numbers that stand in it."""
    e = table(spark, folder, "evidence_records", "evidence_id", "evidence_text").distinct()
    truth = e.where("contains(lower(evidence_text), 'words')").select("evidence_id")
    found = G.candidates(e, "evidence_id", "evidence_text").where("unit = 'words'").select("evidence_id")
    out = verify.retrieval_agreement(truth, found, ["evidence_id"])
    return out.select("n_true", "n_proposed", "n_hit", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def file_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of sources and, as names of files, headings as typed: kind and whether they are safe."""
    s = table(spark, folder, "source_records", "source_path").select(F.col("source_path").alias("name"))
    rows = s.unionByName(table(spark, folder, "outline_entries", "title").select(F.col("title").alias("name"))).where("name is not null")
    return rows.select(packaging.file_kind(F.col("name")).alias("kind"), packaging.safe_path(F.col("name")).alias("safe")).groupBy("kind", "safe").agg(F.count("*").alias("n"))


def requirement_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of sources of which an owner has fewer than ten records."""
    s = table(spark, folder, "source_records", "source_id", "owner", "source_type").where("owner is not null").select(F.col("owner"), F.col("source_type").alias("kind"))
    kinds = s.select("owner").distinct().select("owner", F.explode(F.array(*[F.lit(k) for k in ("POLICY", "PDF", "WEB_PAGE", "FAQ", "DATASET")])).alias("kind"), F.lit(10).alias("least"))
    return packaging.gaps(s, kinds, "owner")


def manifest_check(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence as declared with its hash, against the hash of its text."""
    e = table(spark, folder, "evidence_records", "source_id", "evidence_id", "evidence_hash", "evidence_text").where("source_id is not null")
    declared = e.where("evidence_hash is not null").select("source_id", F.col("evidence_id").alias("path"), F.col("evidence_hash").alias("hash"))
    actual = e.select("source_id", F.col("evidence_id").alias("path"), F.concat(F.lit("sha256:"), F.sha2("evidence_text", 256)).alias("hash"))
    return packaging.manifest_check(declared, actual, "source_id")


def coverage_ratio(spark: SparkSession, folder: str) -> DataFrame:
    r = unique_rules(spark, folder)
    return packaging.covered(r, "layer", F.coalesce("critical_for_readiness", F.lit(False)), (F.col("status") == "VERIFIED") & F.col("machine_checkable"))


def session_transitions(spark: SparkSession, folder: str) -> DataFrame:
    out = verify.transitions(table(spark, folder, "events", "event_id", "ts", "user_id", "event_type"), "user_id", ["ts", "event_id"], "event_type", FLOW)
    return out.groupBy("event_type", "previous_state", "valid_transition").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        audit_findings, audit_summary, audit_coverage, audit_rollup, operator_matrix, text_measures, content_groups, number_tokens, heading_sections, citation_missing_reference, uncited_reference, duplicate_reference,
        duplicate_doi, incomplete_records, layer_ancestors, layer_shapes, resolve_layers, resolution_classes, resolved_status, provenance_issues, layer_issues, fingerprint_digest, numbers_fingerprint, scientific_diff, multiset_preservation,
        compliance_delta, plan_log_reconcile, verification_rollup, block_intervals, block_membership, section_order_check, section_reorder, stable_ids, section_pairs, section_neighbours, numbered_headings, citation_expand,
        citation_linkage, reference_roundtrip, visible_text, evidence_segments, extracted_rules, candidate_conflicts, review_queue, curated_diff, extraction_f1, file_kinds, requirement_gaps, manifest_check, coverage_ratio,
        session_transitions,
    )
}
