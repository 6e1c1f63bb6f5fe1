"""Copies hidden by formatting, collapsed with hot keys handled apart.

The canonical key of a record is hashed to 256 bits.  Partial counts per key are summed to find the
hot keys exactly; there are at most rows / threshold of them, eight for each partition of a shuffle, so
their list is bounded and broadcast.
Rows of hot keys are spread over salts and reduced in two levels, all others in one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.session import cut, partitions

#: Words are what stands between white space and punctuation; symbols are punctuation here.
SEPARATORS = r"[^\p{L}\p{M}\p{N}]+"
#: Ways a DOI is introduced: a label, or a link to a resolver.
DOI_LEAD = r"^(?:urn:|info:)?(?:doi\s*[:=]?\s*)?(?:https?:/*)?(?:[\w.-]*\bdoi\b[\w.-]*/+)?"
#: A key is hot if it holds more rows than this, or more than its share of a task.
HOT_ROWS = 10_000
SALTS = 64


def folded(c: Column) -> Column:
    """Without regard to case: ß equals ss, and sigma has one form."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def words(c: Column) -> Column:
    """Folded words in order; the empty array if there are none, null for null."""
    return F.filter(F.split(folded(c), SEPARATORS), lambda w: w != "")


def canonical_doi(c: Column) -> Column:
    """A DOI without label or resolver, as words."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"^[\s\p{Z}\p{P}]+", ""), DOI_LEAD, "")
    return F.array_join(words(bare), " ")


def record_key(text: Column, ordered: list[Column], dois: list[Column]) -> Column:
    """256-bit key: words of text in any order, the other texts in order; null only equals null."""
    parts = [F.array_join(F.array_sort(words(text)), " "), *[F.array_join(words(c), " ") for c in ordered], *[canonical_doi(c) for c in dois]]
    # \x02 marks null and \x01 ends a part; neither occurs in a word.
    return F.unhex(F.sha2(F.concat_ws("\x01", *[F.coalesce(p, F.lit("\x02")) for p in parts]), 256))


def collapse(df: DataFrame, id_col: str, key: Column, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """(id, first_id, n_copies) for every row: the smallest id of its class and the class's size.

    Rows with a null id are left out.  Repeated ids count each time, but come out once.  Classes of
    any size are handled: one above hot_rows (or its share of a task, if that is more) is hot.
    Extra columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    rows = cut(df.select(F.col(id_col).cast("long").alias("_id"), key.alias("_key")).where("_id is not null").groupBy("_id", "_key").agg(F.count("*").alias("_n")))
    total = rows.count()
    limit = max(hot_rows, total // (8 * partitions(spark)))
    # At most 8 * partitions keys have that many rows each: what is broadcast doesn't grow with the data.
    hot = F.broadcast(cut(rows.groupBy("_key").agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit).select("_key")))
    cold = rows.join(hot, "_key", "left_anti")
    same = Window.partitionBy("_key")
    plain = cold.select("_id", F.min("_id").over(same).alias("_first"), F.sum("_n").over(same).alias("_copies"))
    warm = rows.join(hot, "_key", "left_semi")
    salted = warm.groupBy("_key", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt")).agg(F.min("_id").alias("_first"), F.sum("_n").alias("_copies"))
    heads = salted.groupBy("_key").agg(F.min("_first").alias("_first"), F.sum("_copies").alias("_copies"))
    both = plain.unionByName(warm.join(F.broadcast(heads), "_key").select("_id", "_first", "_copies"))
    return both.select(F.col("_id").alias("id"), F.col("_first").alias("first_id"), F.col("_copies").alias("n_copies"))
