"""What changed between two deliveries of a document, and whether it was allowed to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preservation(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, category, result): PASS or FAIL of each category that a document has in either delivery.

    Both: key, category, digest, one row for each.  A category that only one side has fails.
    """
    a, b = before.select(key, "category", F.col("digest").alias("_a")), after.select(key, "category", F.col("digest").alias("_b"))
    return a.join(b, [key, "category"], "full").select(key, "category", F.when(F.col("_a") == F.col("_b"), "PASS").otherwise("FAIL").alias("result"))


def observed(before: DataFrame, after: DataFrame, key: str, region: str, value: str) -> DataFrame:
    """(key, change): regions whose values differ.  Both: key, region, value; a missing region is a null value."""
    a, b = before.select(key, region, F.col(value).alias("_a")), after.select(key, region, F.col(value).alias("_b"))
    return a.join(b, [key, region], "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key, F.col(region).alias("change")).distinct()


def unexpected(seen: DataFrame, failed: DataFrame, allowed: tuple[str, ...], covers: dict[str, str], key: str) -> DataFrame:
    """(key, change): observed changes that aren't allowed, and failed categories that no allowed change covers.

    covers: the category that an allowed change of a region accounts for.
    """
    masked = [c for r, c in covers.items() if r in allowed]
    own = seen.where(~F.col("change").isin(*allowed)) if allowed else seen
    bad = failed.where(~F.col("category").isin(*masked)) if masked else failed
    return own.select(key, "change").unionByName(bad.select(key, F.col("category").alias("change"))).distinct()


def compared_findings(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): findings that are NEW, RESOLVED, or CHANGED in status; both: keys and status, one row each."""
    a, b = old.select(*keys, F.col("status").alias("_a"), F.lit(True).alias("_x")), new.select(*keys, F.col("status").alias("_b"), F.lit(True).alias("_y"))
    change = F.when(F.col("_x").isNull(), "NEW").when(F.col("_y").isNull(), "RESOLVED").when(~F.col("_a").eqNullSafe(F.col("_b")), "CHANGED")
    return a.join(b, keys, "full").select(*keys, change.alias("change")).where("change is not null")


def first_of(df: DataFrame, key: str, order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key, by an aggregate, so that a hot key is combined before it is shuffled."""
    cols = [c for c in df.columns if c != key]
    at = F.struct(*order)
    pick = F.max_by if last else F.min_by
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(pick(F.struct(*cols), at).alias("_r")).select(key, "_r.*")


def role(section: Column, text: Column) -> Column:
    """A paragraph's role: caption by its beginning, else the section it stands in, else body."""
    # Fixed value: how captions begin.
    caption = F.regexp_extract(text, r"(?i)^\s*(fig(?:ure)?|table)\.?\s*\d", 1)
    return F.when(F.startswith(F.lower(caption), F.lit("fig")), "figure_caption").when(F.lower(caption) == "table", "table_caption").otherwise(F.coalesce(section, F.lit("body")))
