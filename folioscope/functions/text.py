"""Text measures, tokens and fingerprints as column expressions.

Only Unicode normalisation, case folding and entity decoding leave the JVM: Spark has no built-in for
them.  They are Arrow UDFs over whole batches.  Null gives null everywhere.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of words, numbers and scientific tokens.  (?U) makes their classes and boundaries Unicode's.
WORD = r"[\p{L}\p{N}]+(?:[-\x{2019}'][\p{L}\p{N}]+)*"
NUMBER = r"(?U)(?<![\p{L}\p{N}_.])(?:p\s*[<=>]\s*)?[+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?%?"
FIGURE_OR_TABLE = r"(?U)(?i)\b(?:fig(?:ure)?|table)\s*[A-Za-z0-9.-]+"
SCIENTIFIC = {
    "percentage": r"(?U)\b\d+(?:\.\d+)?\s?%",
    "p_value": r"(?U)\bp\s*[<=>]\s*\.?\d+(?:\.\d+)?(?:e-?\d+)?",
    "confidence_interval": r"(?U)\b(?:95%\s*)?CI\s*[:=]?\s*[\[(]?[-+]?\d+(?:\.\d+)?\s*[,–-]\s*[-+]?\d+(?:\.\d+)?",
    "date": r"(?U)\b(?:19|20)\d{2}(?:[-/]\d{1,2}(?:[-/]\d{1,2})?)?\b",
    "accession": r"(?U)\b(?:GSE|SRR|ERR|DRR|PRJNA|NCT)\d+\b",
    "doi": r"(?U)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+",
    "url": r"(?U)(?i)https?://[^\s)>]+",
    "citation": r"(?U)(?:\[(?:\d+(?:\s*[-,]\s*\d+)*)\]|\([A-Z][A-Za-z-]+(?:\s+et\s+al\.)?,?\s+(?:19|20)\d{2}\))",
    "figure_reference": r"(?U)\b(?:Fig(?:ure)?\.?)\s*[A-Z]?\d+[A-Za-z]?\b",
    "table_reference": r"(?U)\bTable\s+[A-Z]?\d+[A-Za-z]?\b",
    "equation": r"(?U)(?:[=±×÷]|\b(?:alpha|beta|gamma|delta|theta|lambda)\b)",
    "reference_identifier": r"(?U)\b(?:PMID|ISBN|arXiv)\s*[:#]?\s*[\w./-]+",
    "gene_protein": r"(?U)\b[A-Z][A-Z0-9-]{2,9}\b",
    "numeric": r"(?U)(?<![\w.])[-+]?\d+(?:\.\d+)?(?:e[-+]?\d+)?(?![\w.])",
}


#: What a text must contain, one of them, for a category's pattern to match at all: told by a plain search.
HINTS = {
    "percentage": ("%",), "confidence_interval": ("CI",), "accession": ("GSE", "SRR", "ERR", "DRR", "PRJNA", "NCT"), "doi": ("10.",), "url": ("://",), "citation": ("[", "("), "figure_reference": ("Fig",), "table_reference": ("Table",),
    "reference_identifier": ("PMID", "ISBN", "arXiv"), "p_value": ("p",),
}


def _series(function):
    """An Arrow UDF that applies a function of one text to each of a batch."""

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(function, na_action="ignore")

    return apply


def nfc(c: Column) -> Column:
    """Canonical composition."""
    return _series(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t))(c)


def folded(c: Column) -> Column:
    """Full case folding; ASCII texts stay in the JVM."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), _series(str.casefold)(c)).otherwise(F.lower(c))


def normalized(c: Column) -> Column:
    """Composed, without LaTeX's escape of the percent sign, white space squeezed."""
    return squeezed(F.replace(nfc(c), F.lit("\\%"), F.lit("%")))


def compat_folded(c: Column) -> Column:
    """Compatibility composition and full case folding."""
    return _series(lambda t: unicodedata.normalize("NFKC", t).casefold())(c)


def unescaped(c: Column) -> Column:
    """Character entities decoded; texts without an ampersand stay in the JVM."""
    return F.when(F.contains(c, F.lit("&")), _series(html.unescape)(c)).otherwise(c)


def word_count(c: Column) -> Column:
    """Words: runs of letters and digits, joined by single hyphens or apostrophes; of NFC text."""
    return F.regexp_count(c, F.lit(WORD))


def measure(c: Column, unit: Column) -> Column:
    """Words (of the composed text) or characters of a text by unit, null for other units."""
    return F.when(unit == "words", word_count(nfc(c))).when(unit == "characters", F.length(c))


def squeezed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}\x1c-\x1f\x85]+", " "))


def tokens(c: Column, pattern: str) -> Column:
    """All matches of a pattern, in order; the empty array if there are none."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def science_tokens(c: Column, category: str) -> Column:
    """All matches of a scientific category, in order; texts without a hint of it aren't searched."""
    found = tokens(c, SCIENTIFIC[category])
    hints = HINTS.get(category)
    if hints is None:
        return found
    seen = F.contains(c, F.lit(hints[0]))
    for h in hints[1:]:
        seen = seen | F.contains(c, F.lit(h))
    return F.when(seen, found).otherwise(F.when(c.isNotNull(), F.expr("cast(array() as array<string>)")))


def changed_tokens(a: Column, b: Column) -> Column:
    """removed:x and added:x of the distinct tokens in which two arrays of tokens differ, sorted."""
    gone = F.transform(F.array_except(a, b), lambda x: F.concat(F.lit("removed:"), x))
    come = F.transform(F.array_except(b, a), lambda x: F.concat(F.lit("added:"), x))
    return F.when(a == b, F.expr("cast(array() as array<string>)")).otherwise(F.array_sort(F.concat(gone, come)))


def multiset(array: Column) -> Column:
    """An array as a multiset: sorted, so that equal multisets are equal arrays."""
    return F.array_sort(array)


def digest(values: Column) -> Column:
    """sha256 of the compact JSON text of an array of strings, in its order."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(values), 256))


def content_fingerprint(c: Column) -> Column:
    """sha256 of a text with plain line ends, single blanks and no outer white space."""
    lines = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.concat(F.lit("sha256:"), F.sha2(F.regexp_replace(lines, r"^\s+|\s+$", ""), 256))


def visible_text(c: Column) -> Column:
    """The text a page shows: without scripts, navigation, hidden blocks and tags, entities decoded."""
    # Patterns of the elements that are not read, of hidden blocks and of tags.
    bare = F.regexp_replace(c, r"(?is)<(script|style|noscript|nav|aside)[^>]*>.*?</\1>", " ")
    bare = F.regexp_replace(bare, r"(?is)<[^>]*(?:hidden|display\s*:\s*none)[^>]*>.*?</[^>]+>", " ")
    return squeezed(unescaped(F.regexp_replace(bare, "<[^>]+>", "\n")))
