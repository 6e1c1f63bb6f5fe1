"""Schemas that drift between files, by rescue-column ingestion.

`ingest` reads JSON payloads into a target schema.  A field that the schema doesn't know, or whose
value has another type, isn't lost: its JSON text goes into the `rescued` map.  `promote` gives
approved fields a typed column and replays the rescued values into it.  `changes` compares the files
of a feed by what was ingested, typed and rescued, and reports each change.

Payloads are parsed once, in Arrow batches: as column expressions the parse would be copied into
every filter and field that asks for it.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from folioscope.operators.nested import flat_parse
from folioscope.session import cut, spread

#: A bit for each JSON type, so that a set of types is a number.
TYPE_BITS = {"string": 1, "number": 2, "boolean": 4, "array": 8, "object": 16}
#: Up to this many events of fields their list is broadcast; beyond that it is joined.
BROADCAST_EVENTS = 500_000


def _refuse(word: str) -> None:
    raise ValueError(word)


def _loads(text: str) -> object:
    """The value of a JSON text of any depth; ValueError if it isn't JSON."""
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return flat_parse(text)


def _plain(text: str) -> str:
    """A text that can be stored: half surrogate pairs become question marks."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _json(value: object) -> str:
    """Compact JSON text of a value."""
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return text if text.isascii() or _plain(text) == text else json.dumps(value, separators=(",", ":"))


def _whole(bits: int) -> Callable:
    def read(x: object) -> int | None:
        if isinstance(x, bool) or not isinstance(x, (int, float)) or x != x or abs(x) == float("inf") or x != int(x):
            return None
        return int(x) if -(1 << bits - 1) <= x < 1 << bits - 1 else None

    return read


def _iso(parse: Callable) -> Callable:
    def read(x: object) -> object:
        try:
            return parse(x.strip()) if isinstance(x, str) else None
        except ValueError:
            return None

    return read


def _moment(text: str) -> dt.datetime:
    t = dt.datetime.fromisoformat(text)
    return t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)


#: How a JSON value is read as a SQL type; None if it is of another JSON type or doesn't fit.
READERS: dict[str, Callable] = {
    "string": lambda x: _plain(x) if isinstance(x, str) else None,
    "bigint": _whole(64), "int": _whole(32),
    "double": lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < 1e308 else None,
    "boolean": lambda x: x if isinstance(x, bool) else None,
    "array<string>": lambda x: [y if y is None else _plain(y) if isinstance(y, str) else _json(y) for y in x] if isinstance(x, list) else None,
    "date": _iso(dt.date.fromisoformat), "timestamp": _iso(_moment),
}


def _known(fields: dict[str, str]) -> dict[str, Callable]:
    if unknown := set(fields.values()) - set(READERS):
        raise ValueError(f"no JSON type is read as {sorted(unknown)}")
    return {k: READERS[t] for k, t in fields.items()}


def _schema(own: list[T.StructField], fields: dict[str, str], *more: tuple[str, str]) -> T.StructType:
    extra = [T.StructField(k, T._parse_datatype_string(t)) for k, t in (*fields.items(), *more)]
    return T.StructType([*own, *extra])


def ingest(feed: DataFrame, target: dict[str, str], payload: str = "payload") -> DataFrame:
    """feed without its payload, with a column per target field and the map `rescued`.

    A field of the target whose value is of another type, and every other field, goes to `rescued`
    as JSON text (JSON null included, so that its presence is kept).  `damaged` is the payload where
    it isn't a JSON object, else null; such a row has null fields and an empty `rescued`, and so has
    a null payload, with a null `damaged`.  Of repeated keys of an object the last counts.  Names of
    the target that clash with the feed's own columns are refused.  Narrow, one parse per payload.
    """
    if clash := set(target) & set(feed.columns):
        raise ValueError(f"columns of the feed: {sorted(clash)}")
    readers = _known(target)
    own = [f for f in feed.schema.fields if f.name != payload]
    schema = _schema(own, target, ("rescued", "map<string,string>"), ("damaged", "string"))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            typed: dict[str, list] = {k: [None] * batch.num_rows for k in readers}
            rescued: list[list] = []
            damaged: list[str | None] = []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                rest: list[tuple[str, str]] = []
                broken = None
                if text is not None:
                    try:
                        record = _loads(text)
                        if isinstance(record, dict):
                            for k, v in record.items():
                                if v is None or k not in readers or (x := readers[k](v)) is None:
                                    rest.append((_plain(k), _json(v)))
                                else:
                                    typed[k][i] = x
                        else:
                            broken = text
                    except (ValueError, RecursionError):
                        rest, broken = [], text
                        for column in typed.values():
                            column[i] = None
                rescued.append(rest)
                damaged.append(broken)
            made = [*typed.values(), rescued, damaged]
            arrays = [pa.array(c, f.type) for c, f in zip(made, list(arrow)[len(own) :], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=schema.names)

    return spread(feed.select(*[f.name for f in own], payload)).mapInArrow(run, schema)


def promote(ingested: DataFrame, approved: dict[str, str], aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Approved fields as typed columns, filled from `rescued`; what now has a column leaves the map.

    aliases: other names a field came under, in order of preference after its own.  Values that
    can't be cast stay rescued.  A column that exists already is filled where it is null.  Narrow;
    each rescued value that any name asks for is parsed once, however many names there are.
    """
    readers = _known(approved)
    names = {k: (k, *(aliases or {}).get(k, ())) for k in approved}
    own = [f for f in ingested.schema.fields if f.name != "rescued" and f.name not in approved]
    held = [k for k in approved if k in ingested.columns]
    schema = _schema(own, approved, ("rescued", "map<string,string>"))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: batch.column(k).to_pylist() if k in held else [None] * batch.num_rows for k in approved}
            rest: list[list] = []
            for i, pairs in enumerate(batch.column("rescued").to_pylist()):
                left = dict(pairs or ())
                if left:
                    for k, column in out.items():
                        if column[i] is None:
                            for name in names[k]:
                                if name in left and (x := readers[k](_loads(left[name]))) is not None:
                                    column[i] = x
                                    del left[name]
                                    break
                rest.append(list(left.items()))
            arrays = [pa.array(c, f.type) for c, f in zip([*out.values(), rest], list(arrow)[len(own) :], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in own], *arrays], names=schema.names)

    return ingested.select(*[f.name for f in own], *held, "rescued").mapInArrow(run, schema)


def observed(ingested: DataFrame, target: dict[str, str], *keys: str) -> DataFrame:
    """One row per field that a payload had, typed or rescued: keys, field, type, value.

    type is a bit of TYPE_BITS, 0 for null, read off the JSON text, which isn't parsed again; value
    is that text, with numbers written alike however they were spelt.
    """
    bare = lambda c: F.expr(f"substring(to_json(array(`{c}`)), 2, length(to_json(array(`{c}`))) - 2)")
    typed = [F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("key"), bare(k).alias("value"))) for k in target]
    each = F.concat(F.array_compact(F.array(*typed)), F.map_entries("rescued")) if typed else F.map_entries("rescued")
    rows = ingested.select(*keys, F.explode(each).alias("_e")).select(*keys, F.col("_e.key").alias("field"), F.col("_e.value").alias("_v"))
    first, bit = F.substring("_v", 1, 1), TYPE_BITS
    kind = F.when(first == '"', bit["string"]).when(first == "{", bit["object"]).when(first == "[", bit["array"]).when(first.isin("t", "f"), bit["boolean"]).when(first == "n", 0).otherwise(bit["number"])
    return rows.withColumn("type", kind).select(*keys, "field", "type", F.when(F.col("type") == bit["number"], F.col("_v").cast("double").cast("string")).otherwise(F.col("_v")).alias("value"))


def changes(seen: DataFrame, feed: str = "feed_id", seq: str = "file_seq", rule: str = "rule", only: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """feed, seq, change, old_field, new_field: each file against the preceding one of its feed.

    seen: rows of `observed`, keyed by feed, seq and rule.  A file without a readable payload is no
    file.  renamed: a field ends, another begins, and for every rule with non-null values in both
    they are equal, for one rule at least; a rule given several times in a file must have one value.
    A field that ends or begins otherwise is removed or added.  retyped: a field is in both files
    with differing sets of types (of none, if all its values are null).  Rows with a null feed or
    seq are ignored; so are null rules where values are compared.  One feed or file may hold most
    rows: first each file's fields are reduced to one row each, with the set of types as a number,
    and only values of fields that end or begin where others do the opposite are compared, as hashes.
    only: gives the rows of `seen` of the files (feed, seq) in a table, where they can be had for less.
    """
    seen = seen.where(F.col(feed).isNotNull() & F.col(seq).isNotNull())
    fields = cut(seen.groupBy(feed, seq, "field").agg(F.bit_or("type").alias("_mask")))
    # Files of a feed in order; each field's files in order beside them.
    file_order = Window.partitionBy(feed).orderBy(seq)
    files = fields.select(feed, seq).distinct().withColumns({"_k": F.row_number().over(file_order), "_next": F.lead(seq).over(file_order)})
    own = Window.partitionBy(feed, "field").orderBy(seq)
    line = fields.join(files, [feed, seq]).withColumns({"_before": F.lag("_k").over(own), "_old_mask": F.lag("_mask").over(own), "_after": F.lead("_k").over(own)})
    stays = F.col("_before") == F.col("_k") - 1
    began = (F.col("_k") > 1) & ~F.coalesce(stays, F.lit(False))
    ended = F.col("_next").isNotNull() & ~F.coalesce(F.col("_after") == F.col("_k") + 1, F.lit(False))
    event = lambda at, kind: F.struct(at.alias("_new"), F.lit(kind).alias("_kind"))
    found = F.array_compact(F.array(
        F.when(began, event(F.col(seq), "begin")), F.when(ended, event(F.col("_next"), "end")), F.when(stays & (F.col("_mask") != F.col("_old_mask")), event(F.col(seq), "retyped")),
    ))
    events = cut(line.select(feed, seq, "field", F.explode(found).alias("_e")).select(feed, seq, "field", "_e.*"))
    moved = events.where("_kind != 'retyped'")
    both = moved.groupBy(feed, "_new").agg(F.countDistinct("_kind").alias("_n")).where("_n = 2").select(feed, "_new")
    moved = moved.join(both, [feed, "_new"], "left_semi")
    small = events.count() <= BROADCAST_EVENTS
    asked = F.broadcast(moved) if small else moved
    files = moved.select(feed, seq).distinct()
    seen = only(F.broadcast(files) if small else files) if only else seen
    # One hash per field, rule and side; a rule with several values in a file has none that could be equal.
    value = F.xxhash64("type", "value")
    held = seen.where((F.col("type") > 0) & F.col(rule).isNotNull()).join(asked, [feed, seq, "field"])
    sides = held.groupBy(feed, "_new", rule, "_kind", "field").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    # A rule's fields that end or begin in one file: few, as a record has few fields.
    beside = sides.groupBy(feed, "_new", rule).agg(*[F.collect_list(F.when(F.col("_kind") == k, F.struct("field", "_lo", "_hi"))).alias(f"_{k}s") for k in ("end", "begin")])
    same = lambda a, b: (a["_lo"] == a["_hi"]) & (b["_lo"] == b["_hi"]) & (a["_lo"] == b["_lo"])
    pairs = F.flatten(F.transform("_ends", lambda a: F.transform(F.col("_begins"), lambda b: F.struct(a["field"].alias("_a"), b["field"].alias("_b"), same(a, b).alias("_same")))))
    compared = beside.where("size(_ends) > 0 and size(_begins) > 0").select(feed, "_new", F.explode(pairs).alias("_p")).select(feed, "_new", "_p.*")
    renamed = cut(compared.groupBy(feed, "_new", "_a", "_b").agg(F.bool_and("_same").alias("_same")).where("_same"))
    named = renamed.select(feed, "_new", F.explode(F.array(F.struct(F.lit("end").alias("_kind"), F.col("_a").alias("field")), F.struct(F.lit("begin").alias("_kind"), F.col("_b").alias("field")))).alias("_x")).select(feed, "_new", "_x.*").distinct()
    rest = events.join(named, [feed, "_new", "_kind", "field"], "left_anti")
    change = F.when(F.col("_kind") == "end", "removed").when(F.col("_kind") == "begin", "added").otherwise("retyped")
    single = rest.select(feed, F.col("_new").alias(seq), change.alias("change"), F.when(F.col("_kind") == "begin", "").otherwise(F.col("field")).alias("old_field"), F.when(F.col("_kind") == "end", "").otherwise(F.col("field")).alias("new_field"))
    return renamed.select(feed, F.col("_new").alias(seq), F.lit("renamed").alias("change"), F.col("_a").alias("old_field"), F.col("_b").alias("new_field")).unionByName(single)


def rename_aliases(changed: DataFrame, targets: list[str]) -> dict[str, tuple[str, ...]]:
    """Other names of each target field, from the renames found, followed in both directions.

    The distinct pairs of names are collected: they are bounded by the vocabulary of field names,
    not by the number of feeds.  A name reached from two targets is given to neither.
    """
    links: dict[str, set[str]] = {}
    for r in changed.where("change = 'renamed'").select("old_field", "new_field").distinct().collect():
        links.setdefault(r.old_field, set()).add(r.new_field)
        links.setdefault(r.new_field, set()).add(r.old_field)
    reach: dict[str, list[str]] = {}
    for t in targets:
        todo, seen = [t], {t}
        while todo:
            for x in sorted(links.get(todo.pop(), ())):
                if x not in seen and x not in targets:
                    seen.add(x)
                    todo.append(x)
        reach[t] = sorted(seen - {t})
    owners: dict[str, int] = {}
    for names in reach.values():
        for x in names:
            owners[x] = owners.get(x, 0) + 1
    return {t: tuple(x for x in names if owners[x] == 1) for t, names in reach.items()}
