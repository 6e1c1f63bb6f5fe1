"""SQL of the queries on training text that SQL can express."""

from __future__ import annotations


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(replace(lower({x}), 'ß', 'ss'), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '')"


_CLASSES = f"""
keyed AS (
  SELECT ref_key, list_sort({_words("raw_text")}) AS a, {_words("title")} AS b,
    {_words("regexp_replace(lower(trim(doi)), '^(doi[: ]*)?(https?://)?((dx|www)\\.)?(doi\\.org/)?', '')")} AS c
  FROM bib_references),
classed AS (SELECT ref_key, min(ref_key) OVER same AS first_key, count(*) OVER same AS n_copies FROM keyed WINDOW same AS (PARTITION BY a, b, c))
"""

SQL = {
    "p5_found": f"WITH {_CLASSES} SELECT first_key, ref_key AS copy_key FROM classed WHERE ref_key <> first_key",
    "p5_records": f"WITH {_CLASSES} SELECT ref_key, n_copies FROM classed WHERE ref_key = first_key",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
