"""Integrity of linked records, fingerprints, differences and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text as T
from folioscope.session import spread


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of left that right hasn't; null keys are none."""
    known = right.select(*keys).distinct()
    return left.select(*keys).where(" and ".join(f"{k} is not null" for k in keys)).distinct().join(known, keys, "left_anti")


def repeated(df: DataFrame, keys: list[str], key: Column, member: str) -> DataFrame:
    """(keys, repeated, n, first_member, last_member) of each value that several distinct members share.

    Counted and bounded, never gathered, so that a value half the rows share is no hot group.
    """
    rows = df.select(*keys, key.alias("repeated"), F.col(member).alias("_m")).where("repeated is not null and repeated != '' and _m is not null").distinct()
    return rows.groupBy(*keys, "repeated").agg(F.count("*").alias("n"), F.min("_m").alias("first_member"), F.max("_m").alias("last_member")).where("n > 1")


def fingerprint(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """(keys, n, digest): sha256 of the ordered list of a document's values; nulls are left out.

    One document's values are gathered, as its digest needs their order; a document is bounded.
    """
    rows = df.select(*keys, F.struct(*order, value.alias("_v")).alias("_s")).where("_s._v is not null")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("_s")).alias("_all")).select(*keys, "n", T.digest(F.transform("_all", lambda s: s["_v"])).alias("digest"))


def scientific_diff(df: DataFrame, before: Column, after: Column, *keys: str) -> DataFrame:
    """Per row and token category the changed tokens, and whether any changed; null texts are empty.

    Patterns are matched only where the texts differ at all.
    """
    rows = spread(df).select(*keys, F.coalesce(before, F.lit("")).alias("_a"), F.coalesce(after, F.lit("")).alias("_b"))
    # Tokens are columns of their own first, so that no pattern is matched twice.
    differ = F.col("_a") != F.col("_b")
    none = F.expr("cast(array() as array<string>)")
    found = rows.select(*keys, *[F.when(differ, T.science_tokens(F.col(f"_{side}"), n)).otherwise(none).alias(f"{side}_{n}") for n in T.SCIENTIFIC for side in "ab"])
    changed = found.select(*keys, *[T.changed_tokens(F.col(f"a_{n}"), F.col(f"b_{n}")).alias(n) for n in T.SCIENTIFIC])
    safe = F.lit(True)
    for n in T.SCIENTIFIC:
        safe = safe & (F.size(n) == 0)
    return changed.withColumn("diff_status", F.when(safe, "SAFE").otherwise("REVIEW_REQUIRED"))


def multiset_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n_before, n_after) of the values whose numbers differ; nulls equal each other."""
    rows = a.select(*keys, value, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*keys, value, F.lit(0).alias("x"), F.lit(1).alias("y")))
    return rows.groupBy(*keys, value).agg(F.sum("x").alias("n_before"), F.sum("y").alias("n_after")).where("n_before != n_after")


RANK = {"PASS": 0, "NOT_APPLICABLE": 0, "WARNING": 1, "UNKNOWN": 2, "BLOCKED": 3, "EVALUATION_ERROR": 3, "FAIL": 3}
BLOCKERS = ("FAIL", "BLOCKED", "EVALUATION_ERROR")


def delta(old: DataFrame, new: DataFrame, keys: list[str], position: str) -> DataFrame:
    """NEW, RESOLVED, UNCHANGED, WORSENED or IMPROVED per key, of the last finding on either side.

    Both: keys, status, severity and a position that orders several findings of one key.
    """
    last = lambda df, p: df.groupBy(*keys).agg(F.max_by(F.struct("status", "severity"), F.struct(position, "status")).alias(p))
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    j = last(old, "o").join(last(new, "n"), keys, "full")
    o, n = F.col("o.status"), F.col("n.status")
    kind = (
        F.when(o.isNull(), "NEW").when(n.isNull(), "RESOLVED").when((n == "PASS") & ~o.isin("PASS", "NOT_APPLICABLE"), "RESOLVED").when(o == n, "UNCHANGED")
        .when(rank[n] > rank[o], "WORSENED").otherwise("IMPROVED")
    )
    blocker = F.coalesce((F.col("n.severity") == "BLOCKING") & n.isin(*BLOCKERS) & ~F.coalesce(o.isin(*BLOCKERS), F.lit(False)), F.lit(False))
    return j.select(*keys, o.alias("old_status"), n.alias("new_status"), kind.alias("change"), blocker.alias("new_blocker"))


def compared(proposed: DataFrame, curated: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate rules against curated ones by key; both one row per key: value, operator, mode."""
    p = proposed.select(*keys, F.struct("value", "operator", "mode").alias("p"))
    c = curated.select(*keys, F.struct("value", "operator", "mode").alias("c"))
    same = lambda f: F.col(f"p.{f}").eqNullSafe(F.col(f"c.{f}"))
    kind = (
        F.when(F.col("c").isNull(), "NEW_SUPPORTED_CANDIDATE").when(F.col("p").isNull(), "MISSING_EXISTING_RULE").when(~same("value") | ~same("operator"), "VALUE_CONFLICT")
        .when(~same("mode"), "APPLICABILITY_CONFLICT").otherwise("MATCH_EXISTING")
    )
    return p.join(c, keys, "full").select(*keys, kind.alias("comparison"))


def reconcile(planned: DataFrame, logged: DataFrame, group: str, member: str) -> DataFrame:
    """Set checks of planned against logged members per group: all accounted for, none twice, none unknown.

    Both: group, member.  One pass over both; null members are ignored.
    """
    rows = planned.select(group, member, F.lit(1).alias("p"), F.lit(0).alias("l")).unionByName(logged.select(group, member, F.lit(0).alias("p"), F.lit(1).alias("l"))).where(F.col(member).isNotNull())
    each = rows.groupBy(group, member).agg(F.sum("p").alias("p"), F.sum("l").alias("l"))
    passed = lambda c: F.when(c, "PASS").otherwise("FAIL")
    return each.groupBy(group).agg(
        passed(F.bool_and((F.col("p") > 0) == (F.col("l") > 0)) & (F.sum("p") == F.sum("l"))).alias("all_accounted_for"), passed(F.max("l") <= 1).alias("no_duplicates"),
        passed(~F.bool_or((F.col("p") == 0) & (F.col("l") > 0))).alias("no_unknown"),
    )


def failed(checks: Column) -> Column:
    """Whether any entry of a map of check results says FAIL, in any case; false for null maps."""
    return F.coalesce(F.exists(F.map_values(checks), lambda v: F.upper(F.trim(v)) == "FAIL"), F.lit(False))


def verification_rollup(df: DataFrame, tamper: list[str], other: list[str]) -> DataFrame:
    """df with `derived_status`: TAMPER_DETECTED, VERIFICATION_FAILED or VERIFIED_CANDIDATE."""
    any_of = lambda cols: F.array_contains(F.array(*[failed(F.col(c)) for c in cols]), True)
    return df.withColumn("derived_status", F.when(any_of(tamper), "TAMPER_DETECTED").when(any_of(other), "VERIFICATION_FAILED").otherwise("VERIFIED_CANDIDATE"))


def retrieval_agreement(truth: DataFrame, proposed: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of a set of proposals, one row; null where nothing was proposed or true."""
    rows = truth.select(*keys).distinct().withColumns({"t": F.lit(1), "p": F.lit(0)}).unionByName(proposed.select(*keys).distinct().withColumns({"t": F.lit(0), "p": F.lit(1)}))
    each = rows.groupBy(*keys).agg(F.max("t").alias("t"), F.max("p").alias("p")).agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_proposed"), F.sum(F.col("t") * F.col("p")).alias("n_hit"))
    precision, recall = F.try_divide("n_hit", "n_proposed"), F.try_divide("n_hit", "n_true")
    return each.select("n_true", "n_proposed", "n_hit", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"))


def transitions(df: DataFrame, session: str, order: list[str], state: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """df with `previous_state` and `valid_transition`; the first state of a session must be a start.

    allowed: successors of each state, "" for what may come first.
    """
    table = F.create_map(*[F.lit(x) for a, bs in allowed.items() for b in bs for x in (f"{a}>{b}", True)])
    before = F.lag(state).over(Window.partitionBy(session).orderBy(*order))
    rows = df.withColumn("previous_state", before)
    return rows.withColumn("valid_transition", F.coalesce(table[F.concat_ws(">", F.coalesce("previous_state", F.lit("")), F.col(state))], F.lit(False)))
