"""Layered rule sets: ancestors, resolution by precedence, provenance and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut

#: What a layer's precedence must be.
PRECEDENCE = {"PUBLISHER": 100, "JOURNAL": 200, "ARTICLE_TYPE": 300}


def ancestors(links: DataFrame) -> DataFrame:
    """(root, node, level): every node with itself (level 0) and all it descends from.

    links: child, parent.  A pair of root and node that was reached before is not followed again, so
    cycles end; shorter paths win.  Null ends of links are ignored.  Parents are followed without
    limit: one equi-join a level, kept by cut(), until a level has no new pair.
    """
    links = cut(links.select("child", "parent").where("child is not null and parent is not null").distinct())
    level = cut(links.select(F.col("child").alias("root"), F.col("child").alias("node")).unionByName(links.select(F.col("parent").alias("root"), F.col("parent").alias("node"))).distinct())
    out, n = level.withColumn("level", F.lit(0)), 0
    while not level.isEmpty():
        n += 1
        reached = level.join(links, F.col("node") == F.col("child")).select("root", F.col("parent").alias("node")).distinct()
        level = cut(reached.join(out.select("root", "node"), ["root", "node"], "left_anti"))
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return out


def cycles(links: DataFrame) -> DataFrame:
    """(node): nodes that descend from themselves.  links: child, parent, nulls ignored."""
    own = links.select("child", "parent").where("child is not null and parent is not null").distinct()
    back = ancestors(own).select(F.col("root").alias("parent"), F.col("node").alias("child"))
    return own.join(back, ["child", "parent"], "left_semi").select(F.col("child").alias("node")).distinct()


def resolve(candidates: DataFrame) -> DataFrame:
    """Per (root, rule_id): the winning candidate, its class, and whether it takes effect.

    candidates: root, rule_id, layer, version, rule_version, precedence, value, override_of,
    override_reason.  CONFLICT: several of the highest precedence with different values, or one
    that differs from the nearest lower one without declaring it; DUPLICATE: several with one
    value; SELECTED: no lower one; REDUNDANT_OVERRIDE: lower one with the same value;
    VALID_OVERRIDE: declared, with a reason.  Null values count as one value.  Repeated candidates
    count once.  Only aggregates, so a hot rule is combined before it is shuffled.
    """
    c = candidates.distinct().withColumn("value", F.coalesce("value", F.lit("null")))
    order = F.struct(F.coalesce("layer", F.lit("")).alias("layer"), F.coalesce("version", F.lit("")).alias("version"), F.coalesce("rule_version", F.lit("")).alias("rule_version"))
    top = c.groupBy("root", "rule_id").agg(F.max("precedence").alias("high"))
    marked = c.join(top, ["root", "rule_id"])
    best = marked.where("precedence = high").groupBy("root", "rule_id").agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min(F.struct(order.alias("o"), "value", "precedence", "override_of", "override_reason")).alias("s")
    )
    low = marked.where("precedence < high").groupBy("root", "rule_id").agg(F.max(F.struct("precedence", order.alias("o"), "value")).alias("l"))
    declared = (F.col("s.override_of") == F.col("rule_id")) & (F.coalesce("s.override_reason", F.lit("")) != "")
    kind = (
        F.when((F.col("n") > 1) & (F.col("lo") != F.col("hi")), "CONFLICT").when(F.col("n") > 1, "DUPLICATE").when(F.col("l").isNull(), "SELECTED")
        .when(F.col("l.value") == F.col("s.value"), "REDUNDANT_OVERRIDE").when(declared, "VALID_OVERRIDE").otherwise("CONFLICT")
    )
    return best.join(low, ["root", "rule_id"], "left").select(
        "root", "rule_id", F.col("s.o.layer").alias("layer"), F.col("s.o.version").alias("version"), F.col("s.value").alias("value"), kind.alias("resolution"), (kind != "CONFLICT").alias("effective")
    )


def stale(verified: Column, window_days: Column, as_of: Column) -> Column:
    """Whether a layer's freshness window is over; null without a date or a window."""
    return as_of > verified + F.make_dt_interval(days=window_days)


def resolved_status(resolved: DataFrame, rule_status: DataFrame, stale_roots: DataFrame) -> DataFrame:
    """(root, status): CONFLICTED, STALE, VERIFIED, PARTIAL or UNKNOWN, in this order.

    rule_status: root, status of the effective rules; a root without any is VERIFIED.
    """
    conflict = resolved.groupBy("root").agg(F.bool_or(~F.col("effective")).alias("conflicted"))
    states = rule_status.groupBy("root").agg(F.bool_or(F.col("status") == "STALE").alias("any_stale"), F.bool_and(F.col("status").isin("VERIFIED", "NOT_APPLICABLE")).alias("all_good"), F.bool_or(F.col("status").isin("UNKNOWN", "PARTIAL")).alias("any_open"))
    late = stale_roots.select("root").distinct().withColumn("late", F.lit(True))
    df = conflict.join(states, "root", "left").join(late, "root", "left")
    status = F.when(F.col("conflicted"), "CONFLICTED").when(F.coalesce("late", "any_stale", F.lit(False)), "STALE").when(F.coalesce("all_good", F.lit(True)), "VERIFIED").when(F.col("any_open"), "PARTIAL").otherwise("UNKNOWN")
    return df.select("root", status.alias("resolved_status"))


def provenance_issues(rules: DataFrame, sources: DataFrame, evidence: DataFrame, official: tuple[str, ...]) -> DataFrame:
    """(rule_key, issue, subject): what is wrong with the provenance of rules.

    rules: rule_key, status, confidence, provenance; sources: source_id, source_type,
    verification_status; evidence: evidence_id, source_id, evidence_text, evidence_hash; both one
    row per id.  A missing source hides further checks of that reference, and so does missing
    evidence.  Null references are ignored; repeated rows count once.
    """
    base = rules.select("rule_key", "status", "confidence", "provenance")
    bare = base.where((F.col("status") == "VERIFIED") & (F.coalesce(F.size("provenance"), F.lit(0)) <= 0)).select("rule_key", F.lit("MISSING_PROVENANCE").alias("issue"), F.lit("").alias("subject"))
    refs = base.select("rule_key", "status", "confidence", F.explode("provenance").alias("p")).where("p is not null").select("rule_key", "status", "confidence", F.col("p.source_id").alias("sid"), F.col("p.evidence_id").alias("eid"))
    s = sources.select(F.col("source_id").alias("sid"), "source_type", "verification_status", F.lit(True).alias("has_source"))
    e = evidence.select(F.col("evidence_id").alias("eid"), F.col("source_id").alias("owner"), (F.coalesce("evidence_hash", F.lit("")) == F.concat(F.lit("sha256:"), F.sha2("evidence_text", 256))).alias("hash_ok"), F.lit(True).alias("has_evidence"))
    j = refs.join(s, "sid", "left").join(e, "eid", "left")
    verified = F.col("status") == "VERIFIED"
    both = F.col("has_source").isNotNull() & F.col("has_evidence").isNotNull()

    def issue(code: str, when: Column, subject: Column) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("issue"), F.coalesce(subject, F.lit("")).alias("subject")))

    found = F.array_compact(F.array(
        issue("UNKNOWN_SOURCE", F.col("has_source").isNull(), F.col("sid")), issue("UNKNOWN_EVIDENCE", F.col("has_source").isNotNull() & F.col("has_evidence").isNull(), F.col("eid")),
        issue("EVIDENCE_SOURCE_MISMATCH", both & ~F.col("owner").eqNullSafe(F.col("sid")), F.col("eid")), issue("EVIDENCE_HASH_MISMATCH", both & ~F.col("hash_ok"), F.col("eid")),
        issue("NON_OFFICIAL_VERIFIED_SOURCE", both & verified & ~F.coalesce(F.col("source_type"), F.lit("")).isin(*official), F.col("source_type")),
        issue("UNVERIFIED_SOURCE", both & verified & ~F.col("verification_status").eqNullSafe("VERIFIED"), F.col("sid")),
        issue("INVALID_VERIFIED_CONFIDENCE", both & verified & ~F.coalesce(F.col("confidence"), F.lit("")).isin("HIGH", "MEDIUM"), F.col("confidence")),
    ))
    return bare.unionByName(j.select("rule_key", F.explode(found).alias("x")).select("rule_key", "x.issue", "x.subject")).distinct()


def layer_issues(profiles: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """(layer, version, issue): wrong precedence, duplicate or conflicting rules, staleness and a
    status that its rules don't bear out.  profiles: one row per layer and version."""
    expected = F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv])
    p = profiles.select("layer", "version", "profile_kind", "precedence", "status", stale(F.col("last_verified_at"), F.col("freshness_window_days"), F.lit(as_of).cast("timestamp")).alias("late"))
    own = p.select("layer", "version", F.explode(F.array_compact(F.array(
        F.when(~F.col("precedence").eqNullSafe(expected[F.col("profile_kind")]), F.lit("INVALID_PRECEDENCE")), F.when(F.col("late"), F.lit("STALE_PROFILE")),
    ))).alias("issue"))
    twice = rules.groupBy("layer", "version", "rule_id").agg(F.count("*").alias("n"), F.min(F.coalesce("value", F.lit("null"))).alias("lo"), F.max(F.coalesce("value", F.lit("null"))).alias("hi")).where("n > 1")
    repeats = twice.select("layer", "version", F.when(F.col("lo") == F.col("hi"), "DUPLICATE_RULE").otherwise("EQUAL_LEVEL_CONFLICT").alias("issue"))
    inflated = p.where("status = 'VERIFIED'").join(rules.where(~F.col("status").eqNullSafe("VERIFIED")).select("layer", "version").distinct(), ["layer", "version"], "left_semi").select("layer", "version", F.lit("INFLATED_PROFILE_STATUS").alias("issue"))
    return own.unionByName(repeats).unionByName(inflated).distinct()
