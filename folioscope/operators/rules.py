"""Declarative rules evaluated over measured facts.

Facts and rules meet in one equi-join on (subject, target).  The policy gate is computed on the rule
side before that join, so a rule that isn't evaluated costs no measuring.  Predicates are one CASE
over typed columns; a type mismatch is a state of its own and never reaches a cast that could fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operator names, scopes that can be evaluated, and uncertain rule states.
OPERATORS = (
    "EQ", "NE", "LT", "LTE", "GT", "GTE", "EXISTS", "NOT_EXISTS", "IN", "NOT_IN", "COUNT_EQ", "COUNT_LTE", "COUNT_GTE",
    "MATCH_REGEX", "NOT_MATCH_REGEX", "CONTAINS", "NOT_CONTAINS",
)
UNCERTAIN = ("UNKNOWN", "PARTIAL", "STALE", "CONFLICTED")


def typed_value(text: Column, prefix: str) -> list[Column]:
    """A rule's JSON value as columns <prefix>_kind, _num, _str, _list; kind is null for no JSON.

    Booleans count as numbers too (true is 1), as in comparisons of the rule language.
    """
    v = F.try_parse_json(text)
    name = F.schema_of_variant(v)
    kind = F.when(name.startswith("ARRAY"), "list").when(name == "BOOLEAN", "bool").when(name == "STRING", "str").when(name == "VOID", "none").when(name.startswith("OBJECT"), "dict").when(name.isNotNull(), "num")
    number = F.when(kind == "bool", F.try_variant_get(v, "$", "boolean").cast("double")).when(kind == "num", F.try_variant_get(v, "$", "double"))
    return [
        kind.alias(f"{prefix}_kind"), number.alias(f"{prefix}_num"), F.when(kind == "str", F.try_variant_get(v, "$", "string")).alias(f"{prefix}_str"),
        F.when(kind == "list", F.try_variant_get(v, "$", "array<string>")).alias(f"{prefix}_list"),
    ]


def evaluate(op: Column, cur: str = "cur", exp: str = "exp") -> Column:
    """true, false, or null for a type mismatch or an unknown operator.

    Columns <cur>_kind, _num, _str, _list and the same of exp; kinds: num, bool, str, list, none.
    """
    c = {k: F.col(f"{cur}_{k}") for k in ("kind", "num", "str", "list")}
    e = {k: F.col(f"{exp}_{k}") for k in ("kind", "num", "str", "list")}
    numeric = ("num", "bool")
    both_num, both_str, both_list = c["kind"].isin(*numeric) & e["kind"].isin(*numeric), (c["kind"] == "str") & (e["kind"] == "str"), (c["kind"] == "list") & (e["kind"] == "list")
    equal = F.when(both_num, c["num"] == e["num"]).when(both_str, c["str"] == e["str"]).when(both_list, c["list"] == e["list"]).otherwise((c["kind"] == "none") & (e["kind"] == "none"))

    def order(test) -> Column:
        return F.when(both_num, test(c["num"], e["num"])).when(both_str, test(c["str"], e["str"]))

    there = F.when(c["kind"] == "none", False).when(c["kind"] == "str", c["str"] != "").when(c["kind"] == "list", F.size(c["list"]) > 0).otherwise(True)
    text = F.when(c["kind"] == "str", c["str"]).when(c["kind"] == "num", c["num"].cast("string"))
    within = F.when(e["kind"] == "list", F.array_contains(e["list"], text)).when(both_str, F.contains(e["str"], c["str"]))
    holds = F.when(c["kind"] == "list", F.array_contains(c["list"], F.coalesce(e["str"], e["num"].cast("string")))).when(both_str, F.contains(c["str"], e["str"]))
    size = F.when(c["kind"] == "list", F.size(c["list"])).when(c["kind"] == "str", F.length(c["str"]))
    found = F.when(e["kind"] == "str", F.rlike(F.coalesce(text, F.lit("")), F.concat(F.lit("(?U)"), e["str"])))
    count = F.when(e["kind"].isin(*numeric), e["num"])
    return (
        F.when(op == "EQ", equal).when(op == "NE", ~equal)
        .when(op == "LT", order(lambda a, b: a < b)).when(op == "LTE", order(lambda a, b: a <= b))
        .when(op == "GT", order(lambda a, b: a > b)).when(op == "GTE", order(lambda a, b: a >= b))
        .when(op == "EXISTS", there).when(op == "NOT_EXISTS", ~there)
        .when(op == "IN", within).when(op == "NOT_IN", ~within)
        .when(op == "COUNT_EQ", size == count).when(op == "COUNT_LTE", size <= count).when(op == "COUNT_GTE", size >= count)
        .when(op == "MATCH_REGEX", found).when(op == "NOT_MATCH_REGEX", ~found)
        .when(op == "CONTAINS", holds).when(op == "NOT_CONTAINS", ~holds)
    )


def gate(scopes: tuple[str, ...]) -> Column:
    """The state a rule has before any evaluation, null if it is to be evaluated; first match wins."""
    mode, status = F.col("applicability_mode"), F.col("status")
    return (
        F.when(F.col("target") == "cover_letter", "NOT_APPLICABLE").when(status.isin(*UNCERTAIN), "UNKNOWN")
        .when((status == "NOT_APPLICABLE") | (mode == "NOT_APPLICABLE"), "NOT_APPLICABLE")
        .when(mode.isin("UNKNOWN", "CONDITIONAL"), "UNKNOWN").when(~F.coalesce(F.col("machine_checkable"), F.lit(False)), "UNKNOWN")
        .when(~F.coalesce(F.col("evaluation_scope"), F.lit("")).isin(*scopes), "EVALUATION_ERROR")
        .when(~F.coalesce(F.col("operator"), F.lit("")).isin(*OPERATORS), "EVALUATION_ERROR")
    )


def findings(rules: DataFrame, facts: DataFrame, subject: str, scopes: tuple[str, ...], also: tuple[str, ...] = ()) -> DataFrame:
    """One row per rule of a subject: its finding status.

    rules: subject, target, operator, rule_value, severity, status, applicability_mode,
    machine_checkable, evaluation_scope and any more; facts: subject, target, cur_kind, cur_num,
    cur_str, cur_list; also: more columns that rule and fact must agree in, as the unit.  A rule without its fact, or whose types don't fit, is an EVALUATION_ERROR.
    """
    gated = rules.withColumn("_gate", gate(scopes))
    settled = gated.where("_gate is not null").withColumn("finding_status", F.col("_gate"))
    open_rules = gated.where("_gate is null").select("*", *typed_value(F.col("rule_value"), "exp"))
    passed = evaluate(F.col("operator"))
    status = F.when(F.col("cur_kind").isNull() | passed.isNull(), "EVALUATION_ERROR").when(passed, "PASS").when(F.col("severity") == "BLOCKING", "BLOCKED").otherwise("WARNING")
    judged = open_rules.join(facts, [subject, "target", *also], "left").withColumn("finding_status", status)
    return settled.drop("_gate").unionByName(judged.select(*settled.drop("_gate").columns))


STATUSES = ("PASS", "WARNING", "BLOCKED", "UNKNOWN", "NOT_APPLICABLE", "EVALUATION_ERROR")


def summary(found: DataFrame, *keys: str) -> DataFrame:
    """Findings of each state per key, zero-filled, in one pass without a pivot."""
    return found.groupBy(*keys).agg(*[F.count_if(F.col("finding_status") == s).alias(f"n_{s.lower()}") for s in STATUSES])


def coverage(found: DataFrame, *keys: str) -> DataFrame:
    """How many rules of each key are verified, uncertain, checkable and evaluated."""
    return found.groupBy(*keys).agg(
        F.count("*").alias("n_rules"), F.count_if(F.col("status") == "VERIFIED").alias("n_verified"), F.count_if(F.col("status").isin(*UNCERTAIN)).alias("n_uncertain"),
        F.count_if(F.col("machine_checkable")).alias("n_checkable"), F.count_if(F.col("finding_status").isin("PASS", "WARNING", "BLOCKED")).alias("n_evaluated"),
        F.count_if(F.col("finding_status") == "UNKNOWN").alias("n_manual"), F.count_if(~F.col("operator").isin(*OPERATORS) & (F.col("finding_status") == "EVALUATION_ERROR")).alias("n_unsupported"),
    )


def rollup(found: DataFrame, *keys: str) -> DataFrame:
    """The worst finding of each key: by rank error, blocked, unknown, warning, pass."""
    rank = F.when(F.col("finding_status") == "EVALUATION_ERROR", 4).when(F.col("finding_status") == "BLOCKED", 3).when(F.col("finding_status") == "UNKNOWN", 2).when(F.col("finding_status") == "WARNING", 1).otherwise(0)
    return found.groupBy(*keys).agg(F.max(rank).alias("worst"), F.bool_or(F.col("critical_for_readiness") & (rank >= 2)).alias("critical_open"))
