"""Reference texts parsed and rendered, citation markers expanded and linked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The one reference layout that is read without loss, and identifiers.
_AUTHOR = r"[^,;.&]+, (?:[A-Z]\.(?:[- ]?[A-Z]\.)*)"
_LAYOUT = rf"^({_AUTHOR}(?:(?:; |, | & ){_AUTHOR})*)\.? ([^.]+)\. (.+?) (\d+)(?:\((\d+)\))?, ([\p{{L}}\p{{N}}_–-]+) \((\d{{4}})\)\.(?: (?:https?://doi\.org/|doi:\s*)(10\.\d{{4,9}}/\S+))?$"
_DOI = r"(?i)(?:https?://doi\.org/|doi:\s*)(10\.\d{4,9}/\S+)"
_NUMBERED = r"^\s*(\d+)\s*[.)]\s+(.+)$"
_PMID, _ARXIV = r"PMID:\s*(\d+)", r"arXiv:\s*(\d{4}\.\d{4,5}(?:v\d+)?)"
_SUPERSCRIPTS = ("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
MARKER = r"\[\d+(?:\s*[,;–-]\s*\d+)*\]"


def parse(raw: Column) -> Column:
    """A struct of a reference's parts and parse_confidence; parts that aren't found are null.

    HIGH: numbered, in the one lossless layout and without other identifiers; MEDIUM: in the
    layout; LOW: kept as it is.  Null for null.
    """
    number = F.regexp_extract(raw, _NUMBERED, 1).try_cast("int")
    body = F.when(number.isNotNull(), F.regexp_extract(raw, _NUMBERED, 2)).otherwise(raw)
    part = lambda i: F.nullif(F.regexp_extract(body, _LAYOUT, i), F.lit(""))
    pmid, arxiv = F.nullif(F.regexp_extract(body, _PMID, 1), F.lit("")), F.nullif(F.regexp_extract(body, _ARXIV, 1), F.lit(""))
    fits = body.rlike(_LAYOUT)
    confidence = F.when(fits & (F.coalesce(number, F.lit(0)) > 0) & pmid.isNull() & arxiv.isNull(), "HIGH").when(fits, "MEDIUM").otherwise("LOW")
    return F.when(raw.isNotNull(), F.struct(
        number.alias("number"), F.transform(F.regexp_extract_all(part(1), F.lit(_AUTHOR), F.lit(0)), lambda a: F.trim(a)).alias("authors"), part(2).alias("title"), part(3).alias("source_title"), part(4).alias("volume"),
        part(5).alias("issue"), part(6).alias("pages"), part(7).alias("year"), F.nullif(F.regexp_extract(body, _DOI, 1), F.lit("")).alias("doi"), pmid.alias("pmid"), arxiv.alias("arxiv"), confidence.alias("parse_confidence"),
    ))


def render(ref: Column) -> Column:
    """A parsed reference of HIGH confidence in the numbered layout, null for others."""
    issue = F.coalesce(F.concat(F.lit("("), ref["issue"], F.lit(")")), F.lit(""))
    doi = F.coalesce(F.concat(F.lit(" https://doi.org/"), ref["doi"]), F.lit(""))
    text = F.concat(ref["number"].cast("string"), F.lit(". "), F.array_join(ref["authors"], "; "), F.lit(" "), ref["title"], F.lit(". "), ref["source_title"], F.lit(" "), ref["volume"], issue, F.lit(", "), ref["pages"], F.lit(" ("), ref["year"], F.lit(")."), doi)
    return F.when(ref["parse_confidence"] == "HIGH", text)


def from_fields(number: Column, authors: Column, title: Column, source: Column, volume: Column, issue: Column, pages: Column, year: Column, doi: Column) -> Column:
    """A reference text in the numbered layout from bibliographic fields; authors are `Name I`."""
    names = F.array_join(F.transform(authors, lambda a: F.regexp_replace(a, r"^(.*) (\S)$", "$1, $2.")), "; ")
    tail = F.coalesce(F.concat(F.lit(" https://doi.org/"), doi), F.lit(""))
    return F.concat(number.cast("string"), F.lit(". "), names, F.lit(" "), title, F.lit(". "), source, F.lit(" "), volume, F.lit("("), issue, F.lit("), "), pages, F.lit(" ("), year, F.lit(")."), tail)


def expand_marker(marker: Column) -> Column:
    """The numbers of a marker such as [1,3-5] or a superscript; null if it is malformed.

    Malformed: no number, a range that falls or spans over 1,000, a number below 1 or named twice.
    Only commas part the items; a marker with semicolons is malformed.
    """
    plain = F.translate(F.translate(marker, _SUPERSCRIPTS[0], _SUPERSCRIPTS[1]), "[] \t", "")
    items = F.split(plain, ",")
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  names a value, so that it is computed once
    bounds = lambda i: once(F.split(i, "[–-]"), lambda p: F.struct(F.when(F.size(p) <= 2, F.get(p, F.lit(0)).try_cast("int")).alias("a"), F.get(p, F.size(p) - 1).try_cast("int").alias("b")))
    good = lambda ends: F.forall(ends, lambda e: F.coalesce((e["a"] >= 1) & (e["b"] >= e["a"]) & (e["b"] - e["a"] <= 1000), F.lit(False)))
    numbers = once(F.transform(items, bounds), lambda ends: F.when(good(ends), F.flatten(F.transform(ends, lambda e: F.sequence(e["a"], e["b"])))))
    return once(numbers, lambda v: F.when(F.size(v) == F.size(F.array_distinct(v)), v))


def linkage(markers: DataFrame, references: DataFrame, doc: str, marker_id: str, marker: str, number: str) -> DataFrame:
    """(doc, marker_id, n_numbers, n_linked, confidence) of each marker, against its document's numbers.

    HIGH: well formed, and every number is one reference's alone.  Repeated markers count once.
    """
    single = references.groupBy(doc, number).agg(F.count("*").alias("_n")).where(F.col(number).isNotNull())
    rows = markers.select(doc, marker_id, expand_marker(F.col(marker)).alias("_v")).distinct()
    each = rows.select(doc, marker_id, F.explode_outer("_v").alias(number)).join(single, [doc, number], "left")
    counted = each.groupBy(doc, marker_id).agg(F.count(number).alias("n_numbers"), F.count("_n").alias("n_linked"), F.coalesce(F.max("_n"), F.lit(0)).alias("_most"))
    high = (F.col("n_numbers") > 0) & (F.col("n_linked") == F.col("n_numbers")) & (F.col("_most") == 1)
    return counted.select(doc, marker_id, "n_numbers", "n_linked", F.when(high, "HIGH").otherwise("LOW").alias("confidence"))
