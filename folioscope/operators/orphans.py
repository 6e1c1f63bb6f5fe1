"""References to records that do not exist, by range-partitioned binary search.

Parents are reduced to one entry per (key, time of receipt) and cut into ranges, a fixed number for
each partition of a shuffle; the boundaries come from a sample of a fixed number of entries per range,
so what the driver holds depends on the cluster, not on the data.  Ranges differ a little in size, but
every entry is kept.  Entries and references find their range by vectorised binary search over the
boundaries, each reference once.  Then each range meets its references in one sorted stream: first
the parents, held as sorted arrays, then the references, batch by batch, probed by vectorised binary
search.  A key that has more entries than a range is spread over several ranges; each gets what the
earlier ones know of the key.  A range that draws many references, by a sample of them of fixed size,
is probed in several tasks, each with a copy of its arrays.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.session import cut, partitions

#: Ranges for each partition of a shuffle.
RANGES = 4
#: Sampled entries per boundary, and sampled references per range.
OVERSAMPLE, PROBES = 16, 64
#: Bytes a reference is taken for, when the size of their tables is turned into a share to sample.
REF_BYTES = 64
FAR = 2**63 - 1
EARLY = -(2**63)
#: Stands for a null row_key while integers must not be null.
NO_ROW = -(2**63)
_OUT = "ref_table string, row_key long, ref_field string, ref_value string, period string, state string"


def clean_key(c: Column) -> Column:
    """A key without surrounding white space, in lower case; null if nothing is left."""
    bare = F.lower(F.regexp_replace(c, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", ""))
    return F.when(bare != "", bare)


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def parent_entries(df: DataFrame, target: str, key: Column, received: Column, deleted: Column) -> DataFrame:
    """(k, a, b): a table's keys with time of receipt and of deletion in microseconds.

    A null receipt counts as the earliest time, a null deletion as never.
    """
    return df.select(
        F.concat(F.lit(f"{target}\x01"), clean_key(key)).alias("k"), F.coalesce(micros(received), F.lit(EARLY)).alias("a"), F.coalesce(micros(deleted), F.lit(FAR)).alias("b")
    ).where("k is not null")


def references(df: DataFrame, ref_table: str, row_key: Column, ref_field: str, target: str, value: Column, at: Column) -> DataFrame:
    """References of a table to `target`; null and blank values are none."""
    ref = clean_key(value)
    return df.select(
        F.lit(ref_table).alias("ref_table"), row_key.cast("long").alias("row_key"), F.lit(ref_field).alias("ref_field"), ref.alias("ref_value"),
        F.date_format(at.cast("timestamp"), "yyyy-MM").alias("period"), micros(at).alias("t"), F.concat(F.lit(f"{target}\x01"), ref).alias("k"),
    ).where("k is not null")


class Bounds:
    """Where each range but the first begins: sorted (key, time) pairs, searched in batches."""

    def __init__(self, pairs: list[tuple[str, int]]) -> None:
        self.keys = np.array([k for k, _ in pairs], object)
        self.times = np.array([a for _, a in pairs], np.int64)

    def ranges(self, k: np.ndarray, a: np.ndarray) -> np.ndarray:
        """How many bounds are at or before each (k, a)."""
        if not len(self.keys):
            return np.zeros(len(k), np.int32)
        lo = np.searchsorted(self.keys, k, side="left")
        hi = np.searchsorted(self.keys, k, side="right")
        for i in np.flatnonzero(lo != hi):  # the key begins a range, or several
            lo[i] += np.searchsorted(self.times[lo[i] : hi[i]], a[i], side="right")
        return lo.astype(np.int32)


def _placed(df: DataFrame, bounds: Bounds) -> DataFrame:
    """df with `rng`, the range of its k and a."""
    sent = df.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("k").to_numpy(zero_copy_only=False)
            found = pa.array(sent.value.ranges(k, batch.column("a").to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([found, *batch.columns], names=["rng", *batch.schema.names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"rng int, {kinds}")


def _sampled(df: DataFrame, of: list[str], share: float) -> list[tuple[str, int]]:
    """(k, a) of about this share of the rows, chosen by a hash."""
    limit = max(1, int(min(1.0, share) * (1 << 30)))
    return [(r.k, r.a) for r in df.where(F.pmod(F.xxhash64(*of), F.lit(1 << 30)) < F.lit(limit)).select("k", "a").collect()]


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted stream of ranges, parents before references, to the references that fail."""
    names = [x.split()[0] for x in _OUT.split(", ")]
    here: tuple | None = None
    held: list[pd.DataFrame] = []
    index: tuple | None = None

    def build() -> tuple:
        entries = pd.concat(held) if held else pd.DataFrame({"k": [], "a": [], "b": []}).astype({"a": "int64", "b": "int64"})
        k, a = entries["k"].to_numpy(object), entries["a"].to_numpy("int64")
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        starts = np.flatnonzero(first)
        which = np.cumsum(first) - 1
        times = np.unique(a)
        upto = entries["b"].groupby(which).cummax().to_numpy("int64") if len(k) else a
        return k[starts], starts, times, which * (len(times) + 1) + np.searchsorted(times, a) + 1, upto

    for batch in batches:
        df = batch.to_pandas()
        cuts = np.flatnonzero((df["rng"].to_numpy()[1:] != df["rng"].to_numpy()[:-1]) | (df["salt"].to_numpy()[1:] != df["salt"].to_numpy()[:-1]) | (df["kind"].to_numpy()[1:] != df["kind"].to_numpy()[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(df)], strict=True):
            part = df.iloc[lo:hi]
            if not len(part):
                continue
            if (at := (part["rng"].iat[0], part["salt"].iat[0])) != here:
                here, held, index = at, [], None
            if part["kind"].iat[0] == 0:
                held.append(part[["k", "a", "b"]])
                continue
            if index is None:
                index, held = build(), []
            keys, starts, times, ranks, upto = index
            k, t = part["k"].to_numpy(object), part["a"].to_numpy("int64")
            if len(keys):
                at_key = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                known = keys[at_key] == k
                pos = np.searchsorted(ranks, at_key * (len(times) + 1) + np.searchsorted(times, t, side="right"), side="right") - 1
                before = pos >= starts[at_key]
                gone = upto[np.maximum(pos, 0)] <= t
                state = np.where(~known, "missing", np.where(~before, "late", np.where(gone, "deleted", "")))
            else:
                state = np.full(len(k), "missing")
            state = np.where(part["dated"].to_numpy(bool) | (state == "missing"), state, "")
            fails = part[state != ""].assign(state=state[state != ""])
            yield pa.RecordBatch.from_pandas(fails[names], schema=_SCHEMA, preserve_index=False)


_SCHEMA = pa.schema([("ref_table", pa.string()), ("row_key", pa.int64()), ("ref_field", pa.string()), ("ref_value", pa.string()), ("period", pa.string()), ("state", pa.string())])


def orphans(parents: DataFrame, refs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per distinct reference that finds no valid parent, with its state.

    parents as from parent_entries, refs as from references; several targets can share one call.
    state: missing (no parent has the key), late (all were received after t) or deleted (each one
    received by t had been deleted by t).  Of a reference without time only `missing` can be told;
    its period is null.  Empty parents make every reference missing; repeated rows count once; extra
    columns are ignored.  ranges: RANGES for each partition of a shuffle if not given.
    """
    spark = parents.sparkSession
    entries = cut(parents.groupBy("k", "a").agg(F.max("b").alias("b")))
    n = entries.count()
    ranges = max(1, min(n, ranges or RANGES * partitions(spark)))
    pairs: list[tuple[str, int]] = []
    if ranges > 1:
        sample = sorted(_sampled(entries, ["k", "a"], OVERSAMPLE * ranges / n))
        pairs = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    bounds = Bounds(pairs)
    placed = _placed(entries, bounds)
    if pairs:
        # What a range must know of the key it begins in the middle of, and of the entry that follows it.
        heads = spark.createDataFrame([(i + 1, k, a) for i, (k, a) in enumerate(pairs)], "head int, k string, head_a long")
        known = placed.join(F.broadcast(heads.select("k").distinct()), "k", "left_semi").groupBy("rng", "k").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        earlier = Window.partitionBy("k").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
        carried = known.select("rng", "k", F.min("a").over(earlier).alias("a"), F.max("b").over(earlier).alias("b")).where("a is not null")
        following = heads.select((F.col("head") - 1).alias("rng"), "k", F.col("head_a").alias("a"), F.lit(EARLY).alias("b"))
        placed = placed.unionByName(carried).unionByName(following)
    probes = refs.select("k", F.coalesce("t", F.lit(FAR - 1)).alias("a"), F.col("t").isNotNull().alias("dated"), F.coalesce("row_key", F.lit(NO_ROW)).alias("row_key"), "ref_table", "ref_field", "ref_value", "period")
    # Only shares matter here, so the size of the input, known without a job, says how many to draw.
    size = int(str(refs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    drawn = _sampled(probes, ["row_key", "ref_value", "ref_field"], PROBES * ranges * REF_BYTES / max(1, size))
    loads = Counter(bounds.ranges(np.array([k for k, _ in drawn], object), np.array([a for _, a in drawn], np.int64)).tolist()) if drawn else Counter()
    tasks = {r: math.ceil(2 * partitions(spark) * c / len(drawn)) for r, c in loads.items()}
    copies = F.coalesce(F.from_json(F.lit(json.dumps({str(r): c for r, c in tasks.items() if c > 1})), "map<string,int>")[F.col("rng").cast("string")], F.lit(1))
    # Integers are never null here: a batch that mixes both sides would turn them into floats.
    left = placed.withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).withColumns({"kind": F.lit(0), "row_key": F.lit(0).cast("long"), "dated": F.lit(False), "order_k": F.col("k")})
    right = _placed(probes, bounds).withColumn("salt", F.pmod(F.xxhash64("row_key", "ref_value"), copies).cast("int")).withColumns({"kind": F.lit(1), "b": F.lit(0).cast("long")})
    # References need no order: they are searched, not merged.
    order = ["rng", "salt", "kind", "order_k", F.when(F.col("kind") == 0, F.col("a"))]
    stream = left.unionByName(right, allowMissingColumns=True).repartition(partitions(spark), "rng", "salt").sortWithinPartitions(*order).drop("order_k")
    return stream.mapInArrow(_probe, _OUT).withColumn("row_key", F.nullif("row_key", F.lit(NO_ROW))).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Failing references per table, field and period; a null period counts as its own."""
    return found.groupBy("ref_table", "ref_field", "period", "state").agg(F.count("*").alias("n_references"), F.countDistinct("row_key").alias("n_rows"), F.countDistinct("ref_value").alias("n_keys"))
