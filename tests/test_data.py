"""Nested records, orphan references and schema drift on small fixtures."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from folioscope.operators import drift, nested, orphans
from folioscope.plans.data import BODY, MANUSCRIPT


def paths(spark, bodies):
    df = spark.createDataFrame([(i, b, "x") for i, b in enumerate(bodies)], "record_id long, main_body string, node_path string")
    return sorted((r.record_id, r.parent_path, r.node_path) for r in nested.shred_json(df, "record_id", "main_body", MANUSCRIPT, BODY, ("section", "paragraph")).collect())


def test_relations_follow_shared_inlining():
    rel = MANUSCRIPT.relations()
    assert set(rel) == {"manuscript", "section", "paragraph", "source_locator"}  # the locator is shared
    assert rel["section"].parents == ("manuscript", "section")
    graph = nested.Graph({"a": ("x",), "b": ("y",), "c": ("z",)}, [nested.Edge("a", "b", "b", False, "b"), nested.Edge("b", "c", "c", True, "c")])
    assert graph.relations()["a"].columns == ("x", "b_y", "b_more") and graph.relations()["c"].parents == ("a",)


def test_shapes_of_lists(spark):
    bodies = [
        None, "", "not json", "null", "[]", "{}", '"text"', json.dumps(json.dumps([{"paragraphs": ["a", None, {"text": "b"}]}])), '[null, {"subsections": {"paragraphs": "one"}}]', '[{"subsections": 5, "paragraphs": [[1], 7]}]',
    ]
    assert paths(spark, bodies) == [
        (5, "root", "s0"), (6, "root", "s0"), (7, "root", "s0"), (7, "s0", "s0.p0"), (7, "s0", "s0.p2"), (8, "root", "s1"), (8, "s1", "s1.s0"), (8, "s1.s0", "s1.s0.p0"), (9, "root", "s0"), (9, "s0", "s0.p0"), (9, "s0", "s0.p1"),
    ]


def test_lists_in_place_of_single_objects_lose_nothing(spark):
    body = json.dumps([{"source_locator": [{"part": "a"}, None, {"part": "b"}]}])
    rows = nested.shred_json(spark.createDataFrame([(1, body)], "i long, b string"), "i", "b", MANUSCRIPT, BODY).where("relation = 'source_locator'").collect()
    assert {(r.node_path, r.attrs["part"]) for r in rows} == {("s0.l0", "a"), ("s0.l2", "b")}
    graph = nested.Graph({"a": ("x",), "b": ("y",)}, [nested.Edge("r", "as", "a", True, "a"), nested.Edge("a", "b", "b", False, "b")])
    (row,) = nested.walk(graph, {"a"}, graph.edges[0], {"x": 1, "b": [{"y": 2}, {"y": 3}, "z"]}, True)
    assert dict(row[-1]) == {"x": "1", "b_y": "2", "b_more": '[{"y":3},"z"]'}
    text = "[]"
    for _ in range(20):
        text = json.dumps(text)
    assert nested.parse_any(text) == []


def test_any_depth(spark):
    deep = "[" + '{"subsections":[' * 5000 + "]}" * 5000 + "]"
    assert len(paths(spark, [deep])) == 5000


def test_maps_and_empty_tables(spark):
    df = spark.createDataFrame([(1, {"a": "PASS", "b": None}), (1, {"a": "PASS", "b": None}), (2, {}), (3, None)], "report_id long, m map<string,string>")
    rows = nested.shred_map(df, "report_id", "m", "check", "report").collect()
    assert sorted((r.record_id, r.node_path) for r in rows) == [(1, "a"), (1, "b")]
    assert nested.shred_map(df.limit(0), "report_id", "m", "check", "report").count() == 0


def brute(parents, refs):
    out = set()
    for row, key, t in refs:
        own = [(r, d) for k, r, d in parents if k == key]
        there = [(r, d) for r, d in own if r is None or (t is not None and r <= t)]
        if not own:
            out.add((row, key, "missing"))
        elif t is None:
            continue
        elif not there:
            out.add((row, key, "late"))
        elif all(d is not None and d <= t for _, d in there):
            out.add((row, key, "deleted"))
    return out


@pytest.mark.parametrize("ranges", [1, 40, 100_000, None])
def test_orphans_match_brute_force(spark, ranges):
    from pyspark.sql import functions as F

    day = lambda n: None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    parents = [(f"k{i % 7}", i, i + 1 if i % 3 else None) for i in range(60)] + [("hot", i, i + 1) for i in range(0, 200, 2)] + [("gone", 5, 6), ("gone", 9, 10), ("old", None, None), (" ", 1, None), (None, 1, None)]
    refs = [(i, k, t) for i, (k, t) in enumerate([("hot", n) for n in range(-2, 210, 3)] + [(f"k{n % 9}", n) for n in range(-3, 70, 2)] + [("gone", n) for n in (4, 5, 7, 9, 12)] + [("old", 3), ("none", None), ("hot", None), ("gone", None)])]
    p = orphans.parent_entries(spark.createDataFrame([(k, day(a), day(b)) for k, a, b in parents], "id string, r timestamp, d timestamp"), "t", F.col("id"), F.col("r"), F.col("d"))
    r = orphans.references(spark.createDataFrame([(i, f"  {k.upper()} ", day(t)) for i, k, t in refs], "row long, v string, at timestamp"), "x", F.col("row"), "f", "t", F.col("v"), F.col("at"))
    got = {(x.row_key, x.ref_value, x.state) for x in orphans.orphans(p, r.unionByName(r), ranges).collect()}
    assert got == brute([(k, a, b) for k, a, b in parents if k and k.strip()], refs)
    assert orphans.orphans(p.limit(0), r, ranges).where("state = 'missing'").count() == len(refs)
    assert orphans.orphans(p, r.limit(0), ranges).count() == 0


FEED = [
    ("f", 1, {"profile_id": "p", "rule_id": "a", "size": 1, "gone": "x"}), ("f", 1, {"profile_id": "p", "rule_id": "b", "size": 2, "gone": None}),
    ("f", 3, {"profile_id": "p", "rule_id": "a", "limit": 1, "fresh": True}), ("f", 3, {"profile_id": "p", "rule_id": "b", "limit": 2.0}),
    ("f", 4, {"profile_id": "p", "rule_id": "a", "limit": "1", "fresh": True}), ("g", 1, {"profile_id": "p", "rule_id": "a"}),
]


def feed(spark):
    rows = [(f, s, json.dumps(p)) for f, s, p in FEED] + [("f", 2, '{"cut'), ("f", 3, None), ("f", 4, "[1]"), (None, 1, "{}")]
    return spark.createDataFrame(rows, "feed_id string, file_seq int, payload string")


def test_drift_changes(spark):
    target = {"profile_id": "string", "rule_id": "string"}
    rows = drift.ingest(feed(spark), target)
    assert rows.where("damaged is not null").count() == 2
    seen = drift.observed(rows.where("damaged is null").withColumn("rule", rows["rule_id"]), target, "feed_id", "file_seq", "rule")
    got = {tuple(r) for r in drift.changes(seen).collect()}
    assert got == {("f", 3, "renamed", "size", "limit"), ("f", 3, "removed", "gone", ""), ("f", 3, "added", "", "fresh"), ("f", 4, "retyped", "limit", "limit")}
    assert drift.changes(seen.limit(0)).count() == 0
    joined, drift.BROADCAST_EVENTS = drift.BROADCAST_EVENTS, 0
    assert {tuple(r) for r in drift.changes(seen).collect()} == got
    drift.BROADCAST_EVENTS = joined


def test_rescued_values_are_promoted(spark):
    rows = drift.promote(drift.ingest(feed(spark), {"rule_id": "string"}), {"limit": "bigint"}, {"limit": ("size",)})
    got = {(r.feed_id, r.file_seq, r.rule_id): (r.limit, dict(r.rescued)) for r in rows.where("rule_id is not null").collect()}
    assert got["f", 1, "a"] == (1, {"profile_id": '"p"', "gone": '"x"'}) and got["f", 4, "a"] == (None, {"profile_id": '"p"', "limit": '"1"', "fresh": "true"})
    with pytest.raises(ValueError):
        drift.ingest(feed(spark), {"feed_id": "string"})
