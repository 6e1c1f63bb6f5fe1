"""Rules read from guideline texts: segments, candidates, conflicts, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shortest segment that is kept; authority from which a source isn't official.
SHORTEST, OFFICIAL = 12, 5
# One pattern per limit: rule, target, unit, pattern on lower-case text.
LIMITS = (
    ("title.max_words", "title", "words", r"title\s+(\d[\d,]*)\s+words"),
    ("abstract.max_words", "abstract", "words", r"abstract\s+(\d[\d,]*)\s+words"),
    ("main_text.max_words", "main_text", "words", r"main text(?: ideally)?\s+(\d[\d,]*)\s+words"),
    ("display_items.max_count", "figures_and_tables", "items", r"display items(?: up to)?\s+(\d[\d,]*)"),
    ("extended_data.max_count", "extended_data", "items", r"up to\s+(\d+)\s+extended data"),
)
# Further limits as the guideline texts here word them.
WORDED = (
    ("main_text.max_words", "main_text", "words", r"main text (?:may not exceed|should ideally stay below)\s+(\d[\d,]*)\s+words"),
    ("abstract.max_words", "abstract", "words", r"abstracts are confined to\s+(\d[\d,]*)\s+words"),
)
ARTICLE, COVER, SUPPLEMENT, ASKS = "article limits", ("include", "cover letter"), "supplementary information optional|optional supplementary information", "requires|must include"
STATEMENTS = (
    ("statements.competing_interests.required", "competing_interests", "competing-interest"),
    ("statements.data_availability.required", "data_availability", "data-availability statement"),
    ("statements.author_contributions.required", "author_contributions", "author-contribution statement"),
)


def segments(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, seq, segment, segment_hash): sentences of a text; short ones go, their numbers stay free.

    Sentences end at . ! or ? before white space and a capital.  Null and blank texts give none.
    """
    rows = df.select(key, F.posexplode(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")).alias("seq", "segment")).withColumn("segment", F.trim("segment"))
    return rows.where(F.length("segment") >= SHORTEST).withColumn("segment_hash", F.substring(F.sha2("segment", 256), 1, 24))


def candidates(df: DataFrame, key: str | list[str], text: str, authority: Column | None = None, limits: tuple = LIMITS + WORDED) -> DataFrame:
    """(key, rule_id, target, operator, value, unit, mode): rules a segment states, at most one of a pattern.

    A text of several sentences is to be cut by segments() first, else its later statements are
    lost.  Sources above the official authority give none.  All patterns are tried in one pass.
    """
    keys = [key] if isinstance(key, str) else key
    low = F.lower(F.col(text))

    def rule(when: Column, rule_id: str, target: str, op: str, value: Column, unit: str | None, mode: str = "ALWAYS") -> Column:
        return F.when(when, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(target).alias("target"), F.lit(op).alias("operator"), value.alias("value"), F.lit(unit).cast("string").alias("unit"), F.lit(mode).alias("mode")))

    found = [rule(F.contains(low, F.lit(ARTICLE)), "identity.article_type", "article_type", "EQ", F.lit("Article"), None)]
    for rule_id, target, unit, pattern in limits:
        value = F.regexp_replace(F.regexp_extract(low, pattern, 1), ",", "")
        found.append(rule(value != "", rule_id, target, "LTE", value, unit, "CONDITIONAL" if target == "extended_data" else "ALWAYS"))
    found.append(rule(F.contains(low, F.lit(COVER[0])) & F.contains(low, F.lit(COVER[1])), "cover_letter.required", "cover_letter", "EXISTS", F.lit("true"), None))
    found.append(rule(low.rlike(SUPPLEMENT), "supplement.allowed", "supplementary_information", "EXISTS", F.lit("OPTIONAL"), None))
    for rule_id, target, token in STATEMENTS:
        found.append(rule(F.contains(low, F.lit(token)) & low.rlike(ASKS), rule_id, target, "EXISTS", F.lit("true"), None))
    rows = df if authority is None else df.where(authority <= OFFICIAL)
    return rows.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("r")).select(*keys, "r.*").distinct()


def conflicts(found: DataFrame, group: list[str], member: list[str]) -> DataFrame:
    """(group, rule_id, n_values, n_candidates, lowest, highest) of rules with differing values.

    member: what tells the segments apart; each value of one is a candidate.
    """
    return (
        found.groupBy(*group, "rule_id").agg(F.countDistinct("value").alias("n_values"), F.countDistinct(*member, "value").alias("n_candidates"), F.min("value").alias("lowest"), F.max("value").alias("highest")).where("n_values > 1")
    )


def review(found: DataFrame, evidence: DataFrame, clashing: DataFrame, key: list[str], text: str, group: list[str]) -> DataFrame:
    """found with `review`: UNSUPPORTED without evidence, CONFLICTED, UNSUPPORTED if a number isn't in
    the evidence (thousands separators apart), else SUPPORTED.  evidence: one row per key."""
    e = evidence.select(*key, F.regexp_replace(F.col(text), ",", "").alias("_text"))
    c = clashing.select(*group, "rule_id").distinct().withColumn("_clash", F.lit(True))
    j = found.join(e, key, "left").join(c, [*group, "rule_id"], "left")
    number = F.col("value").rlike(r"^\d+$") & ~F.contains("_text", F.col("value"))
    state = F.when(F.col("_text").isNull(), "UNSUPPORTED").when(F.col("_clash"), "CONFLICTED").when(number, "UNSUPPORTED").otherwise("SUPPORTED")
    return j.withColumn("review", state).drop("_text", "_clash")


def official(url: Column, relationship: Column, hosts: tuple[str, ...], relationships: tuple[str, ...]) -> Column:
    """Whether a source is official: https, no user in the address, exactly a listed host, a listed relationship."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("USERINFO")).isNull() & host.isin(*hosts) & relationship.isin(*relationships), F.lit(False))


def retrieval_status(code: Column, mime: Column, content: Column, is_official: Column) -> Column:
    """NOT_FOUND, BLOCKED, PARTIAL_RETRIEVAL or RETRIEVED; first match wins."""
    good = F.lower(F.coalesce(mime, F.lit(""))).rlike("^(text/html|text/plain|application/xhtml)")
    return F.when(~is_official, "BLOCKED").when(code == 404, "NOT_FOUND").when(code.isNull() | (code != 200) | ~good, "BLOCKED").when(F.trim(F.coalesce(content, F.lit(""))) == "", "PARTIAL_RETRIEVAL").otherwise("RETRIEVED")
