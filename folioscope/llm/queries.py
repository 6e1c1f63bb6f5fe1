"""Queries of the problems on training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import copies, encoding, headings, languages, leaks, lookalikes
from folioscope.sources.tables import table


def keyed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(text_kind, key, text) of evidence and of the paragraphs of abstracts."""
    evidence = table(spark, folder, "evidence_records").select(F.lit("evidence").alias("text_kind"), F.col("evidence_id").alias("key"), F.col("evidence_text").alias("text"))
    sections = table(spark, folder, "manuscripts", "abstract").select(F.explode("abstract").alias("s"))
    blocks = sections.select(F.explode("s.paragraphs").alias("p")).select(F.lit("text_block").alias("text_kind"), F.col("p.object_id").alias("key"), F.col("p.text").alias("text"))
    return evidence.unionByName(blocks).where("text is not null")


def text_classes(spark: SparkSession, folder: str) -> DataFrame:
    formed, _ = lookalikes.forms(keyed_texts(spark, folder), "text")
    return lookalikes.look_alike_classes(formed, "text_kind", "key", "text", "form")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of keys whose texts look the same but differ in characters."""
    return lookalikes.look_alike_pairs(text_classes(spark, folder)).withColumnRenamed("kind", "text_kind")


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every key with its class of texts that look the same, and the class's size."""
    rows = text_classes(spark, folder)
    return rows.select(F.col("kind").alias("text_kind"), "key", *[F.lower(F.hex(c)).alias(c) for c in ("text_id", "class_id")], "n_texts", "n_keys")


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in its one form."""
    formed, _ = lookalikes.forms(keyed_texts(spark, folder), "text")
    return formed.select("text_kind", "key", "text", "form").distinct()


def reference_classes(spark: SparkSession, folder: str) -> DataFrame:
    refs = table(spark, folder, "bib_references", "ref_key", "raw_text", "title", "doi")
    return copies.collapse(refs, "ref_key", copies.record_key(F.col("raw_text"), [F.col("title")], [F.col("doi")]))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every copy of a reference with the first of its class."""
    return reference_classes(spark, folder).where("id != first_id").select(F.col("first_id").alias("first_key"), F.col("id").alias("copy_key"))


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record with its number of copies."""
    return reference_classes(spark, folder).where("id = first_id").select(F.col("id").alias("ref_key"), "n_copies")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encoding.encode(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p7_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' texts, decoded from their ids; empty for null."""
    return encoding.decode(p7_ids(spark, folder), "doc_id", "ids").withColumnRenamed("id", "doc_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The heading each outline entry means, or -1."""
    entries, listed = table(spark, folder, "outline_entries", "entry_id", "title"), table(spark, folder, "heading_list")
    return headings.map_values(entries, "entry_id", "title", listed, "heading_id", "heading", "aliases").select(F.col("id").alias("entry_id"), F.col("name_id").alias("heading_id")).distinct()


def p6_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that mean no heading, with the number of their entries."""
    entries, listed = table(spark, folder, "outline_entries", "entry_id", "title"), table(spark, folder, "heading_list")
    mapped = headings.map_values(entries, "entry_id", "title", listed, "heading_id", "heading", "aliases")
    return mapped.where("name_id = -1").groupBy(F.col("value").alias("title")).agg(F.count("*").alias("n_entries"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the evaluation items that leaked into them."""
    return leaks.leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"), "doc_id", "text", "item_id", "text")


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every evaluation item with the number of documents it leaked into."""
    found = p8_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    items = table(spark, folder, "eval_items", "item_id", "suite")
    return items.join(found, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def p9_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document and of each line of a mixed one, with a confidence."""
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    model = languages.fit(docs, "doc_id", "text", "lang")
    return languages.identify(docs, model, "doc_id", "text", "lang").select("doc_id", "part_no", "lang", F.round("confidence", 4).alias("confidence"), "label")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a missing or wrong label, and the lines of mixed documents."""
    judged = p9_languages(spark, folder)
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return judged.where((F.col("part_no") > 0) | wrong).select("doc_id", "part_no", "lang")


QUERIES = {
    "p4_found": p4_found,
    "p4_forms": p4_forms,
    "p4_classes": p4_classes,
    "p5_found": p5_found,
    "p5_records": p5_records,
    "p6_found": p6_found,
    "p6_unmatched": p6_unmatched,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p9_found": p9_found,
    "p9_languages": p9_languages,
}
