"""Files of a package: kinds, required numbers, and what was declared against what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a file name's first matching part says of its kind.
KINDS = (
    ("cover", "COVER_LETTER"), ("title_page", "TITLE_PAGE"), ("figure", "FIGURE"), ("fig", "FIGURE"), ("table", "TABLE"), ("supp", "SUPPLEMENTARY_INFORMATION"),
    ("checklist", "REPORTING_CHECKLIST"), ("graphical", "GRAPHICAL_ABSTRACT"), ("highlight", "HIGHLIGHTS"), ("ethics", "ETHICS_DOCUMENT"), ("consent", "CONSENT_DOCUMENT"),
)


def file_kind(name: Column) -> Column:
    """The kind of a file, from its name without extension, in any case, - and space as _."""
    stem = F.translate(F.lower(F.regexp_replace(name, r"\.[^./]*$", "")), "- ", "__")
    out: Column | None = None
    for token, kind in KINDS:
        out = F.when(F.contains(stem, F.lit(token)), kind) if out is None else out.when(F.contains(stem, F.lit(token)), kind)
    return out.otherwise("OTHER_REQUIRED_FILE")


def safe_path(path: Column) -> Column:
    """Whether a relative path stays inside its root: not absolute, no part .., only plain signs in each part.

    Empty and . parts don't count, but something must be left.
    """
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    # Fixed value: what a part may be.
    plain = F.forall(parts, lambda p: p.rlike(r"^[A-Za-z0-9][A-Za-z0-9._ -]*\z"))
    return F.coalesce(~F.startswith(path, F.lit("/")) & (F.size(parts) > 0) & plain, F.lit(False))


def gaps(files: DataFrame, required: DataFrame, group: str) -> DataFrame:
    """(group, kind, least, n): required kinds of which a package has too few files.

    files: group, kind; required: group, kind, least.
    """
    have = files.groupBy(group, "kind").agg(F.count("*").alias("n"))
    return required.join(have, [group, "kind"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < least")


def manifest_check(declared: DataFrame, actual: DataFrame, group: str) -> DataFrame:
    """(group, path, problem): UNDECLARED, MISSING, CHANGED or DECLARED_TWICE.

    Both: group, path, hash.
    """
    d = declared.groupBy(group, "path").agg(F.count("*").alias("n"), F.min("hash").alias("want"))
    a = actual.groupBy(group, "path").agg(F.min("hash").alias("have"))
    j = d.join(a.withColumn("there", F.lit(True)), [group, "path"], "full")
    problem = F.when(F.col("n").isNull(), "UNDECLARED").when(F.col("there").isNull(), "MISSING").when(F.col("n") > 1, "DECLARED_TWICE").when(~F.col("want").eqNullSafe(F.col("have")), "CHANGED")
    return j.select(group, "path", problem.alias("problem")).where("problem is not null")


def covered(df: DataFrame, group: str, critical: Column, resolved: Column) -> DataFrame:
    """Shares in percent of resolved entries per group, of all and of the critical ones; 0 if there are none."""
    share = lambda c: F.coalesce(F.round(100 * F.avg(F.when(c, resolved.cast("double"))), 2), F.lit(0.0))
    return df.groupBy(group).agg(share(F.lit(True)).alias("overall"), share(critical).alias("critical"), F.count_if(critical & ~resolved).alias("n_blockers"))
