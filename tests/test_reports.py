"""Canonical forms, orders and changes on small fixtures."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from folioscope.operators import canonical as C
from folioscope.operators import changes as X
from folioscope.operators import structure as S


def test_canonical_json_and_ids(spark):
    a, b = '{"b": "re\\u0301sume\\u0301\\r\\nx", "a": [1, 2.5, null]}', '{"a":[1,2.5,null],"b":"résumé\\nx"}'
    rows = spark.createDataFrame([(a,), (b,), ('{"a": NaN}',), ("no",), (None,)], "t string").select(C.canonical_json(F.col("t")).alias("c"), C.logical_hash(F.col("t")).alias("h")).collect()
    assert rows[0] == rows[1] and rows[0].c == '{"a":[1,2.5,null],"b":"résumé\\nx"}' and rows[0].h == "sha256:" + hashlib.sha256(rows[0].c.encode()).hexdigest()
    assert [r.h for r in rows[2:]] == [None, None, None]
    df = spark.createDataFrame([("r", 1, None, "now")], "a string, b int, c string, at string")
    row = df.select(C.content_id("finding", F.col("a"), F.col("b"), F.col("c")).alias("i"), C.without(F.struct("a", "b", "at"), ["at"]).alias("w")).first()
    assert row.i == "finding:" + hashlib.sha256(b'["r","1",""]').hexdigest()[:24] and row.w == '{"a":"r","b":1}'


def test_topological_order():
    assert C.topological_order({"c": ["a"], "b": [], "a": ["b"], "d": ["b"]}) == ["b", "a", "c", "d"]
    for bad in ({"a": ["x"]}, {"a": ["b"], "b": ["a"]}):
        with pytest.raises(ValueError):
            C.topological_order(bad)


def test_changes(spark):
    cats = "k int, category string, digest string"
    a, b = spark.createDataFrame([(1, "title", "x"), (1, "body", "y"), (2, "body", None)], cats), spark.createDataFrame([(1, "title", "x"), (1, "abstract", "z"), (2, "body", None)], cats)
    kept = X.preservation(a, b, "k")
    assert {tuple(r) for r in kept.collect()} == {(1, "title", "PASS"), (1, "body", "FAIL"), (1, "abstract", "FAIL"), (2, "body", "FAIL")}
    regions = "k int, region string, v string"
    o, n = spark.createDataFrame([(1, "abstract", "a"), (1, "statement:x", None), (1, "title", "t")], regions), spark.createDataFrame([(1, "abstract", "b"), (1, "statement:x", None), (1, "title", "u")], regions)
    seen = X.observed(o, n, "k", "region", "v")
    assert {tuple(r) for r in seen.collect()} == {(1, "abstract"), (1, "title")}
    bad = X.unexpected(seen, kept.where("result = 'FAIL' and k = 1"), ("abstract",), {"abstract": "abstract"}, "k")
    assert {tuple(r) for r in bad.collect()} == {(1, "title"), (1, "body")}
    f = "k int, c string, status string"
    d = X.compared_findings(spark.createDataFrame([(1, "a", "PASS"), (1, "b", None), (1, "c", "PASS")], f), spark.createDataFrame([(1, "a", "FAIL"), (1, "b", None), (1, "d", None)], f), ["k", "c"])
    assert {tuple(r) for r in d.collect()} == {(1, "a", "CHANGED"), (1, "c", "RESOLVED"), (1, "d", "NEW")}
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 0, "z")], "k int, at int, v string")
    assert [X.first_of(rows, "k", ["at"], last).first().v for last in (False, True)] == ["a", "b"] and X.first_of(rows.limit(0), "k", ["at"]).count() == 0
    t = spark.createDataFrame([("methods", "Figure 2. A"), (None, "table 1"), (None, ""), ("results", "Tables")], "s string, t string")
    assert [r.r for r in t.select(X.role(F.col("s"), F.col("t")).alias("r")).collect()] == ["figure_caption", "table_caption", "body", "results"]


def test_lines_without_style(spark):
    lines = ["Effects of snow on rye", "Snow.", "Institute of Rye", "2.1 Soil water", "3) Many words here.", "mayonnaise tests of oil", "a@b.org", None, ""]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    got = df.select(S.plausible_title(F.col("t")).alias("p"), S.front_matter(F.col("t")).alias("f"), S.numbered_parts(F.col("t")).alias("n")).collect()
    assert [r.p for r in got] == [True, False, True, True, False, True, True, None, False] and [r.f for r in got] == [False, False, True, False, False, False, True, None, False]
    assert [r.n and (r.n.major, r.n.minor, r.n.level) for r in got] == [None, None, None, (2, 1, 2), None, None, None, None, None]
    body = "We measured the snow of nine winters in forty different fields."
    t = spark.createDataFrame([("Abstract" + body,), ("Abstract:  " + body,), ("Abstract\u00a0" + body,), ("Abstracts " + body,), ("Abstract We saw.",), (None,)], "t string")
    assert [r.b for r in t.select(S.flattened_abstract(F.col("t")).alias("b")).collect()] == [body, body, body, None, None, None]
    h = spark.createDataFrame([("2. Results", "results"), ("2.1 Methods", "methods"), ("Snow", None)], "t string, s string")
    assert [r.l for r in h.select(S.plain_heading(F.col("t"), F.col("s")).alias("l")).collect()] == [1, 2, None]
