"""Deeply nested records to related flat tables, by shared inlining.

A document type is given as a graph of elements.  `relations` decides, as shared inlining does,
which elements become tables: the roots, the repeated ones, those that several elements share and
those that can contain themselves.  Every other element is inlined into its nearest ancestor that
has a table.  `shred_json` and `shred_arrays` walk records along that graph and populate the tables;
each row has the path of its node, unique in its record, and the path of its parent's row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.session import spread


@dataclass(frozen=True)
class Edge:
    """parent.name holds `child`, once or (many) as a list; steps along it are written as `step`."""

    parent: str
    name: str
    child: str
    many: bool
    step: str


@dataclass(frozen=True)
class Relation:
    """A table made for an element: its own and inlined columns, and the elements it can hang on."""

    element: str
    columns: tuple[str, ...]
    parents: tuple[str, ...]


@dataclass
class Graph:
    """Elements with their plain fields, and the edges between them."""

    fields: dict[str, tuple[str, ...]]
    edges: list[Edge] = field(default_factory=list)

    def out(self, element: str) -> list[Edge]:
        return [e for e in self.edges if e.parent == element]

    def recursive(self, element: str) -> bool:
        """Whether an element can contain itself."""
        seen: set[str] = set()
        todo = [e.child for e in self.out(element)]
        while todo:
            x = todo.pop()
            if x == element:
                return True
            if x not in seen:
                seen.add(x)
                todo += [e.child for e in self.out(x)]
        return False

    def tables(self) -> set[str]:
        """Elements with a table: roots, repeated, shared and recursive ones."""
        into: dict[str, list[Edge]] = {e: [] for e in self.fields}
        for e in self.edges:
            into[e.child].append(e)
        return {x for x, es in into.items() if not es or any(e.many for e in es) or len({(e.parent, e.name) for e in es}) > 1 or self.recursive(x)}

    def relations(self) -> dict[str, Relation]:
        """The table of each element that has one, singletons below it inlined as a_b columns.

        a_more keeps, as JSON, what a record has beyond the one entry that could be inlined.
        """
        own = self.tables()

        def columns(element: str, prefix: str) -> list[str]:
            below = [c for e in self.out(element) if e.child not in own for c in (*columns(e.child, f"{prefix}{e.name}_"), f"{prefix}{e.name}_more")]
            return [prefix + f for f in self.fields[element]] + below

        def holders(element: str) -> set[str]:
            return {h for e in self.edges if e.child == element for h in ([e.parent] if e.parent in own else holders(e.parent))}

        return {x: Relation(x, tuple(columns(x, "")), tuple(sorted(holders(x)))) for x in own}


def graph_of(schema: T.StructType, name: str = "record") -> Graph:
    """The graph of a typed schema.  Structs with equal field names are one, shared element."""
    graph, known = Graph({}), {}

    def visit(struct: T.StructType, label: str) -> str:
        key = tuple(sorted(struct.names))
        if key in known:
            return known[key]
        known[key] = label
        graph.fields[label] = ()
        plain = []
        for f in struct.fields:
            kind, many = f.dataType, False
            while isinstance(kind, T.ArrayType):
                kind, many = kind.elementType, True
            if isinstance(kind, T.StructType):
                graph.edges.append(Edge(label, f.name, visit(kind, f.name), many, f.name))
            elif isinstance(kind, T.MapType):
                graph.fields.setdefault(f"{f.name}_entry", ("key", "value"))
                graph.edges.append(Edge(label, f.name, f"{f.name}_entry", True, f.name))
            elif many:
                graph.fields.setdefault(f"{f.name}_item", ("value",))
                graph.edges.append(Edge(label, f.name, f"{f.name}_item", True, f.name))
            else:
                plain.append(f.name)
        graph.fields[label] = tuple(plain)
        return label

    visit(schema, name)
    return graph


NODE = T.StructType([
    T.StructField("record_id", T.LongType()), T.StructField("relation", T.StringType()), T.StructField("parent_relation", T.StringType()),
    T.StructField("parent_path", T.StringType()), T.StructField("node_path", T.StringType()), T.StructField("ordinal", T.IntegerType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])
_ARROW = pa.schema([
    ("record_id", pa.int64()), ("relation", pa.string()), ("parent_relation", pa.string()), ("parent_path", pa.string()),
    ("node_path", pa.string()), ("ordinal", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string())),
])
_TOKEN = re.compile(r'\s*(?:([\[\]{},:])|("(?:[^"\\]|\\.)*")|([^\s\[\]{},:"]+))', re.S)


def flat_parse(text: str) -> object:
    """JSON of any depth without recursion; ValueError if it isn't JSON."""
    stack: list = []
    top: list = []
    here: list | dict = top
    key: str | None = None
    wants = True  # a value (True), or a comma or an end
    at = 0
    body = text.rstrip()

    def put(value: object) -> None:
        nonlocal key, wants
        if isinstance(here, dict):
            if key is None:
                raise ValueError("key expected")
            here[key], key = value, None
        else:
            here.append(value)
        wants = False

    while at < len(body):
        m = _TOKEN.match(body, at)
        if not m:
            raise ValueError("no token")
        at = m.end()
        mark, string, word = m.groups()
        if mark in ("[", "{"):
            if not wants or (isinstance(here, dict) and key is None):
                raise ValueError("misplaced start")
            fresh: list | dict = [] if mark == "[" else {}
            put(fresh)
            stack.append(here)
            here, wants = fresh, True
        elif mark in ("]", "}"):
            if here is top or isinstance(here, dict) != (mark == "}") or key is not None or (wants and len(here)):
                raise ValueError("misplaced end")
            here, wants = stack.pop(), False
        elif mark == ",":
            if wants or here is top:
                raise ValueError("misplaced comma")
            wants = True
        elif mark == ":":
            raise ValueError("misplaced colon")
        elif string is not None and isinstance(here, dict) and key is None:
            if not wants or not (colon := re.compile(r"\s*:").match(body, at)):
                raise ValueError("colon expected")
            key, at = json.loads(string, strict=False), colon.end()
        else:
            if not wants:
                raise ValueError("comma expected")
            put(json.loads(string or word, strict=False))
    if stack or len(top) != 1:
        raise ValueError("unfinished")
    return top[0]


def loads(text: str) -> object:
    """The value of a JSON text of any depth; ValueError if it isn't JSON."""
    try:
        return json.loads(text, strict=False)
    except RecursionError:
        return flat_parse(text)


def parse_any(text: str | None) -> object:
    """The value of a JSON text, decoded again while it is itself a JSON string; None if damaged."""
    if text is None:
        return None
    value: object = text
    depth = 0
    while True:  # each decoding shortens the text
        try:
            value = loads(value)
        except ValueError:
            return value if depth else None
        if not isinstance(value, str):
            return value
        depth += 1


def _entries(value: object) -> list:
    """What stands at an edge, as a list: a single object or string is a list of one.

    A list where one value is due keeps all its entries, each a row of its own.
    """
    if isinstance(value, list):
        return value
    return [value] if isinstance(value, (dict, str)) else []


def walk(graph: Graph, own: set[str], edge: Edge, value: object, with_attrs: bool) -> Iterator[tuple]:
    """Rows of the nodes at `edge` and below, parents before children, without recursion."""
    todo = [(edge, value, "root", edge.parent)]
    while todo:
        e, v, parent, parent_table = todo.pop()
        for i, x in enumerate(_entries(v)):
            if x is None:
                continue
            path = f"{e.step}{i}" if parent == "root" else f"{parent}.{e.step}{i}"
            attrs = None
            if with_attrs:
                attrs = [("_text", x)] if isinstance(x, str) else []
            below = [(e.child, x, "")]
            while below:
                element, obj, prefix = below.pop()
                if prefix and not isinstance(obj, dict):  # an inlined element has room for one object; all else stays as JSON
                    each = obj if isinstance(obj, list) else [obj]
                    first = next((o for o in each if isinstance(o, dict)), None)
                    if with_attrs and (more := [o for o in each if o is not first and o is not None]):
                        attrs.append((f"{prefix}more", json.dumps(more, ensure_ascii=False, separators=(",", ":"))))
                    obj = first
                if not isinstance(obj, dict):
                    continue
                if with_attrs:
                    for f in graph.fields[element]:
                        if (a := obj.get(f)) is not None:
                            attrs.append((prefix + f, a if isinstance(a, str) else json.dumps(a, ensure_ascii=False, separators=(",", ":"))))
                for f in graph.out(element):
                    if f.child in own:
                        if obj.get(f.name) is not None:
                            todo.append((f, obj[f.name], path, e.child))
                    else:
                        below.append((f.child, obj.get(f.name), f"{prefix}{f.name}_"))
            yield e.child, parent_table, parent, path, i, attrs


def shred_json(df: DataFrame, id_col: str, json_col: str, graph: Graph, edge: Edge, elements: tuple[str, ...] = (), with_attrs: bool = True) -> DataFrame:
    """Rows of all tables below `edge`, from a JSON text column; columns as in NODE.

    A narrow, streaming pass: records aren't shuffled (but to use all cores, if the input has fewer
    partitions) and their depth is not limited.  Null,
    blank or damaged JSON gives no rows; text that was JSON-encoded several times is decoded as
    often.  A single object or string in place of a list is a list of one, and a list in place of a
    single object gives each of its entries; null entries keep their position but give no row; other
    values in place of a list give none.  Of repeated keys of an
    object the last counts.  A repeated id gives its rows again.  Other columns are ignored.
    elements: only these tables (all if empty); with_attrs: whether attrs is filled.
    """
    own = graph.tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _ARROW]
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in walk(graph, own, edge, parse_any(text.as_py()), with_attrs):
                    if elements and row[0] not in elements:
                        continue
                    for column, x in zip(out, (rid, *row), strict=True):
                        column.append(x)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ARROW, strict=True)], schema=_ARROW)
                    out = [[] for _ in _ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ARROW, strict=True)], schema=_ARROW)

    return spread(df.select(F.col(id_col).cast("long").alias("record_id"), F.col(json_col).alias("body"))).mapInArrow(run, NODE)


def _node(record: Column, relation: str, parent_relation: str, parent: Column, path: Column, ordinal: Column, attrs: dict[str, Column]) -> list[Column]:
    pairs = [x for k, v in attrs.items() for x in (F.lit(k), v.cast("string"))]
    full = F.create_map(*pairs) if pairs else F.lit(None)
    return [
        record.cast("long").alias("record_id"), F.lit(relation).alias("relation"), F.lit(parent_relation).alias("parent_relation"), parent.alias("parent_path"),
        path.alias("node_path"), ordinal.cast("int").alias("ordinal"), full.cast("map<string,string>").alias("attrs"),
    ]


def shred_arrays(df: DataFrame, id_col: str, array_col: str, graph: Graph, edge: Edge, with_attrs: bool = True) -> DataFrame:
    """Rows of all tables below a typed array column, by posexplode alone; columns as in NODE.

    The schema is finite, so the walk along it is unrolled here.  Null records, lists and entries
    give no rows, but null entries keep their position.  Struct fields that the graph doesn't name
    are ignored.
    """
    own = graph.tables()
    level = df.select(F.col(id_col).alias("_id"), F.posexplode(array_col).alias("_i", "_x")).where("_x is not null")
    level = level.select("_id", F.lit("root").alias("_parent"), F.concat(F.lit(edge.step), F.col("_i")).alias("_path"), "_i", "_x")
    parts: list[DataFrame] = []

    def visit(rows: DataFrame, element: str, parent_table: str) -> None:
        attrs: dict[str, Column] = {}
        below: list[tuple[Edge, str]] = []

        def inline(el: str, at: str, prefix: str, struct: T.StructType) -> None:
            for f in graph.fields[el]:
                if f in struct.names:
                    attrs[prefix + f] = F.col(f"{at}.{f}")
            for e in graph.out(el):
                if e.name in struct.names:
                    if e.child in own:
                        below.append((e, f"{at}.{e.name}"))
                    else:
                        inline(e.child, f"{at}.{e.name}", f"{prefix}{e.name}_", struct[e.name].dataType)

        inline(element, "_x", "", rows.schema["_x"].dataType)
        parts.append(rows.select(_node(F.col("_id"), element, parent_table, F.col("_parent"), F.col("_path"), F.col("_i"), attrs if with_attrs else {})))
        for e, at in below:
            many = isinstance(rows.select(at).schema[0].dataType, T.ArrayType)
            each = F.posexplode(at) if many else F.posexplode(F.array(at))
            next_rows = rows.select("_id", F.col("_path").alias("_parent"), each.alias("_i", "_x")).where("_x is not null")
            visit(next_rows.select("_id", "_parent", F.concat("_parent", F.lit(f".{e.step}"), F.col("_i")).alias("_path"), "_i", "_x"), e.child, element)

    visit(level, edge.child, edge.parent)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shred_map(df: DataFrame, id_col: str, map_col: str, relation: str, parent_relation: str) -> DataFrame:
    """One row per entry of a map column, its name as node_path; columns as in NODE.

    Entries count whatever their value; null and empty maps give no rows; exact repeats of a record
    give each entry once, the largest value winning if they differ.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.explode(map_col).alias("_k", "_v")).groupBy("_id", "_k").agg(F.max("_v").alias("_v"))
    return rows.select(_node(F.col("_id"), relation, parent_relation, F.lit("root"), F.col("_k"), F.lit(None), {"name": F.col("_k"), "value": F.col("_v")}))


def relation_table(nodes: DataFrame, relation: Relation, bare: str | None = None, **types: str) -> DataFrame:
    """One table of the shredded nodes: keys, its parent's key and its columns, cast as given.

    bare: the column that the text of a node which is a mere string goes to.
    """
    value = lambda c: F.coalesce(F.col("attrs")[c], F.col("attrs")["_text"]) if c == bare else F.col("attrs")[c]
    columns = [value(c).try_cast(types.get(c, "string")).alias(c) for c in relation.columns]
    return nodes.where(F.col("relation") == relation.element).select("record_id", "node_path", "parent_relation", "parent_path", "ordinal", *columns)
