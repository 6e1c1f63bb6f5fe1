"""The rule engine's operators on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import bibliography as B
from folioscope.operators import guidelines as G
from folioscope.operators import layers, packaging, rules, structure, verify
from folioscope.streaming.sessions import session_states

TRUTH = [
    ("EQ", "num", 1.0, None, None, "1", True), ("EQ", "bool", 1.0, None, None, "1", True), ("NE", "str", None, "a", None, '"b"', True), ("LT", "num", 1.0, None, None, "2", True), ("LTE", "num", 2.0, None, None, "2", True), ("GT", "str", None, "b", None, '"a"', True),
    ("GTE", "num", 1.0, None, None, "2", False), ("EXISTS", "bool", 0.0, None, None, "1", True), ("EXISTS", "str", None, "", None, "1", False), ("EXISTS", "str", None, " ", None, "1", True), ("NOT_EXISTS", "none", None, None, None, "1", True),
    ("IN", "str", None, "a", None, '["a","b"]', True), ("IN", "str", None, "b", None, '"abc"', True), ("NOT_IN", "str", None, "z", None, '["a"]', True), ("COUNT_EQ", "list", None, None, ["a", "b"], "2", True), ("COUNT_LTE", "str", None, "abc", None, "2", False),
    ("COUNT_GTE", "num", 5.0, None, None, "2", None), ("MATCH_REGEX", "str", None, "Fig. 1", None, '"\\\\d$"', True), ("NOT_MATCH_REGEX", "str", None, "x", None, '"\\\\d"', True), ("CONTAINS", "list", None, None, ["a"], '"a"', True), ("NOT_CONTAINS", "str", None, "abc", None, '"z"', True),
    ("LT", "str", None, "a", None, "1", None), ("PRECEDES", "num", 1.0, None, None, "1", None),
]


def test_operator_truth_table(spark):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(TRUTH)], "i int, op string, cur_kind string, cur_num double, cur_str string, cur_list array<string>, v string, want boolean")
    rows = df.select("i", "op", "cur_kind", "cur_num", "cur_str", "cur_list", "want", *rules.typed_value(F.col("v"), "exp")).withColumn("got", rules.evaluate(F.col("op"))).collect()
    assert [(r.op, r.got) for r in rows if r.got != r.want] == []


def test_gate_order(spark):
    cols = "target string, status string, applicability_mode string, machine_checkable boolean, evaluation_scope string, operator string"
    rows = [("cover_letter", "STALE", "ALWAYS", True, "S", "EQ"), ("x", "STALE", "NOT_APPLICABLE", True, "S", "EQ"), ("x", "VERIFIED", "NOT_APPLICABLE", True, "S", "EQ"), ("x", "VERIFIED", "CONDITIONAL", True, "S", "EQ"), ("x", "VERIFIED", "ALWAYS", None, "S", "EQ"), ("x", "VERIFIED", "ALWAYS", True, None, "EQ"), ("x", "VERIFIED", "ALWAYS", True, "S", "CUSTOM"), ("x", "VERIFIED", "ALWAYS", True, "S", "EQ")]
    got = [r.g for r in spark.createDataFrame(rows, cols).select(rules.gate(("S",)).alias("g")).collect()]
    assert got == ["NOT_APPLICABLE", "UNKNOWN", "NOT_APPLICABLE", "UNKNOWN", "UNKNOWN", "EVALUATION_ERROR", "EVALUATION_ERROR", None]


def test_resolution_classes(spark):
    c = [("a", 100, "5", None, None), ("a", 200, "6", "a", "why"), ("b", 100, "5", None, None), ("b", 200, "5", None, None), ("c", 100, "5", None, None), ("c", 200, "6", "c", ""), ("d", 200, "15", None, None), ("d", 200, "15.0", None, None), ("e", 200, "1", None, None), ("f", 300, None, None, None)]
    rows = [("r", rid, f"l{p}", f"v{i}", "1", p, v, o, why) for i, (rid, p, v, o, why) in enumerate(c)]
    df = spark.createDataFrame(rows + rows[:1], "root string, rule_id string, layer string, version string, rule_version string, precedence int, value string, override_of string, override_reason string")
    got = {r.rule_id: r.resolution for r in layers.resolve(df).collect()}
    assert got == {"a": "VALID_OVERRIDE", "b": "REDUNDANT_OVERRIDE", "c": "CONFLICT", "d": "CONFLICT", "e": "SELECTED", "f": "SELECTED"}
    links = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x"), ("q", None)], "child string, parent string")
    assert {(r.root, r.node, r.level) for r in layers.ancestors(links).where("root = 'x'").collect()} == {("x", "x", 0), ("x", "y", 1), ("x", "z", 2)}


def test_ancestors_of_deep_chains(spark):
    links = [(f"n{i}", f"n{i + 1}") for i in range(7)] + [("n7", "n6"), ("n0", "n3"), ("n0", "n0"), (None, "n0")]
    got = {(r.node, r.level) for r in layers.ancestors(spark.createDataFrame(links, "child string, parent string")).where("root = 'n0'").collect()}
    assert got == {("n0", 0), ("n1", 1), ("n2", 2), ("n3", 1), ("n4", 2), ("n5", 3), ("n6", 4), ("n7", 5)}
    chain = [(f"m{i:02}", f"m{i + 1:02}") for i in range(20)] + [("m03", "m03"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c3", "d")]
    df = spark.createDataFrame(chain, "child string, parent string")
    assert layers.ancestors(df).where("root = 'm00'").count() == 21
    assert {r.node for r in layers.cycles(df).collect()} == {"m03", "c1", "c2", "c3"}
    assert layers.ancestors(spark.createDataFrame([("x", None)], "child string, parent string")).count() == 0


def test_tokens_and_digest(spark):
    a = "We saw 5 % of n = 12 (p < 0.05), Figure 2 [3,4], doi 10.1000/ABC"
    df = spark.createDataFrame([(1, a, a.replace("12", "13")), (2, a, a), (3, None, "")], "id int, a string, b string")
    rows = {r.id: r for r in verify.scientific_diff(df, F.col("a"), F.col("b"), "id").collect()}
    assert rows[1].numeric == ["added:13", "removed:12"] and rows[1].diff_status == "REVIEW_REQUIRED" and rows[2].diff_status == rows[3].diff_status == "SAFE"
    w = spark.createDataFrame([("naïve co-author's Größe ½",), ("été",), (None,)], "t string").select(T.word_count(T.nfc(F.col("t"))).alias("n")).collect()
    assert [r.n for r in w] == [4, 1, None]
    odd = spark.createDataFrame([("é5 and 7", "p\u00a0< 0.05", "٥٦ x")], "a string, b string, c string")
    got = odd.select(T.tokens(F.col("a"), T.SCIENTIFIC["numeric"]).alias("n"), F.size(T.tokens(F.col("b"), T.SCIENTIFIC["p_value"])).alias("p"), T.tokens(F.col("c"), T.NUMBER).alias("d")).first()
    assert (got.n, got.p, got.d) == (["7"], 1, ["٥٦"])
    assert spark.createDataFrame([("re\u0301sume\u0301 nai\u0308ve", "Straße", "5\\%  of")], "a string, b string, c string").select(T.measure(F.col("a"), F.lit("words")).alias("w"), T.measure(F.col("a"), F.lit("characters")).alias("n"), T.folded(F.col("b")).alias("f"), T.normalized(F.col("c")).alias("c")).first() == (2, 15, "strasse", "5% of")
    page = spark.createDataFrame([("<p>A&amp;B</p><script>x</script><div hidden>no</div>\n<b>c</b>",)], "t string").select(T.visible_text(F.col("t")).alias("v")).first().v
    assert page == "A&B c"


def test_hints_lose_no_token(spark):
    texts = ["5 % of 12", "p = 0.03 and 95% CI 1.2-3.4", "in 2021-03 GSE123 NCT04", "10.1000/ABC at HTTPS://x.org/a", "[1, 2] (Doe et al., 2020)", "Fig. 2 Figure 3a Table 4 A = B", "PMID: 77 arXiv:2101.1 BRCA1 alpha", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, pattern in T.SCIENTIFIC.items():
        rows = df.select(T.tokens(F.col("t"), pattern).alias("a"), T.science_tokens(F.col("t"), name).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows] and any(r.a for r in rows), name


def test_multisets_see_dropped_copies(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (1, None)], "k int, v string"), spark.createDataFrame([(1, "x"), (1, None)], "k int, v string")
    assert [tuple(r) for r in verify.multiset_difference(a, b, ["k"], "v").collect()] == [(1, "x", 2, 1)]
    assert [tuple(r) for r in verify.reconcile(a.select("k", "v"), b.select("k", "v"), "k", "v").collect()] == [(1, "FAIL", "PASS", "PASS")]


def test_structure(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, "methods"), (1, 2, None), (1, 3, "results"), (1, 4, "introduction"), (2, 0, None)], "doc int, seq int, label string")
    found = structure.blocks(df, "doc", "seq", F.col("label"))
    assert sorted((r.doc, r.start, r.end, r.label) for r in found.collect()) == [(1, 0, 1, "front_matter"), (1, 1, 3, "methods"), (1, 3, 4, "results"), (1, 4, 5, "introduction"), (2, 0, 1, "front_matter")]
    assert structure.members(df.select("doc", "seq"), found, "doc", "seq").count() == 6
    wanted = ["introduction", "results", "methods"]
    assert [(r.doc, r.in_order) for r in structure.in_order(df, "doc", "seq", "label", wanted).collect()] == [(1, False)]
    moved = {(r.seq, r.new_seq) for r in structure.reordered(df, "doc", "seq", "label", wanted).where("doc = 1").collect()}
    assert moved == {(0, 0), (4, 1), (2, 2), (3, 3), (1, 4)}
    h = spark.createDataFrame([(["1 A", "1.1 B", "1.3 C", "3 D", "2. E", "2.1 F", "x"],)], "h array<string>").select(structure.numbered(F.col("h")).alias("n")).first().n
    assert [(x.i, x.major, x.minor) for x in h] == [(0, 1, None), (1, 1, 1), (4, 2, None), (5, 2, 1)]
    ids = structure.stable_ids(spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, None, 2)], "d int, t string, s int"), "d", "tb", F.col("t"), "s").orderBy("s").collect()
    assert ids[1].stable_id == ids[0].stable_id + ".2" and len(ids[2].stable_id) == 19


def test_references(spark):
    raw = "7. Doe, J.; Roe, A. B. Some title. Journal of X 12(3), 45–67 (2001). https://doi.org/10.1234/ab"
    r = spark.createDataFrame([(raw,), ("free text 2001",), (None,)], "t string").select(B.parse(F.col("t")).alias("r")).collect()
    assert (r[0].r.number, r[0].r.authors, r[0].r.pages, r[0].r.parse_confidence) == (7, ["Doe, J.", "Roe, A. B."], "45–67", "HIGH") and r[1].r.parse_confidence == "LOW" and r[2].r is None
    assert spark.createDataFrame([(raw,)], "t string").select(B.render(B.parse(F.col("t"))).alias("x")).first().x == raw
    m = spark.createDataFrame([("[1,3-5]",), ("[1;2]",), ("[3-1]",), ("[2;2]",), ("¹³",), ("[a]",), ("[1-5000]",), ("",), (None,)], "m string").select(B.expand_marker(F.col("m")).alias("v")).collect()
    assert [x.v for x in m] == [[1, 3, 4, 5], None, None, None, [13], None, None, None, None]


def test_guidelines(spark):
    df = spark.createDataFrame([(1, "Article limits: abstract 1,200 words. Please include a cover letter. It requires a data-availability statement now."), (2, None)], "k int, t string")
    assert {(r.rule_id, r.value) for r in G.candidates(df, "k", "t").collect()} == {("identity.article_type", "Article"), ("abstract.max_words", "1200"), ("cover_letter.required", "true"), ("statements.data_availability.required", "true")}
    seg = G.segments(spark.createDataFrame([(1, "Too short. This sentence is long enough. ok")], "k int, t string"), "k", F.col("t")).collect()
    assert [(s.seq, s.segment) for s in seg] == [(1, "This sentence is long enough. ok")]
    u = spark.createDataFrame([("https://www.a.org/x", "OWN"), ("http://a.org", "OWN"), ("https://me@a.org/", "OWN"), ("https://ba.org", "OWN"), (None, "OWN")], "u string, r string")
    assert [x.o for x in u.select(G.official(F.col("u"), F.col("r"), ("a.org", "www.a.org"), ("OWN",)).alias("o")).collect()] == [True, False, False, False, False]


def test_every_segment_of_a_document_states_its_limits(spark, tmp_path):
    from folioscope.plans import audit

    a = "Main text may not exceed 3,000 words unless agreed. Please write clearly. Main text may not exceed 4500 words in reviews. Main text may not exceed 4500 words in reviews."
    docs = [(1, a, "s", "guideline"), (2, "Main text may not exceed 900 words at all.", "t", "guideline"), (3, a, "s", "article"), (4, None, "s", "guideline")]
    spark.createDataFrame(docs, "doc_id long, text string, source string, doc_kind string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in audit.candidate_conflicts(spark, str(tmp_path)).collect()] == [("main_text.max_words", 3, 3, "3000", "900")]
    rows = {(r.doc_id, r.seq, r.value, r.review) for r in audit.review_queue(spark, str(tmp_path)).collect()}
    assert rows == {(1, 0, "3000", "CONFLICTED"), (1, 2, "4500", "CONFLICTED"), (2, 0, "900", "CONFLICTED")}


def test_pages_of_every_kind_of_document(spark, tmp_path):
    from folioscope.plans import audit

    docs = [(1, "One.", "s", "guideline"), (2, "Two.", "s", "article"), (3, "Three.", "s", None), (4, None, "s", "article")]
    spark.createDataFrame(docs, "doc_id long, text string, source string, doc_kind string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in audit.visible_text(spark, str(tmp_path)).collect()} == {(1, "One. Q&A"), (2, "Two. Q&A"), (3, "Three. Q&A")}


def test_packaging(spark):
    f = spark.createDataFrame([("a/Fig-1.png",), ("../x",), ("/abs",), ("notes.txt",), ("a(b).docx",), ("_x.docx",), ("./a//b c.txt",), (".",), (None,)], "p string").select(packaging.file_kind(F.col("p")).alias("k"), packaging.safe_path(F.col("p")).alias("s")).collect()
    assert [x.s for x in f] == [True, False, False, True, False, False, True, False, False] and f[0].k == "FIGURE" and f[3].k == "OTHER_REQUIRED_FILE"


def test_session_stream(spark, tmp_path):
    def deliver(n: int, rows: list[tuple[str, str, str]]) -> None:
        spark.createDataFrame(rows, "s string, at string, state string").selectExpr("s", "cast(at as timestamp) at", "state").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))

    deliver(1, [("a", "2024-01-01 00:00:00", "start"), ("a", "2024-01-01 00:01:00", "stop"), ("a", "2024-01-01 00:02:00", "stop"), ("b", "2024-01-01 00:00:00", "stop")])
    stream = spark.readStream.schema("s string, at timestamp, state string").parquet(str(tmp_path / "in" / "*"))
    q = session_states(stream, "s", "at", "state", {"": ("start",), "start": ("stop",), "stop": ("start",)}).writeStream.outputMode("update").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    assert {tuple(r) for r in spark.sql("select s, n_events, n_invalid, state from seen").collect()} == {("a", 3, 1, "stop"), ("b", 1, 1, "stop")}
    deliver(2, [("c", "2024-01-02 00:00:00", "start")])  # a and b are over
    q.processAllAvailable()
    deliver(3, [("a", "2024-01-02 00:01:00", "start")])
    q.processAllAvailable()
    q.stop()
    assert ("a", 1, 0, "start") in {tuple(r) for r in spark.sql("select s, n_events, n_invalid, state from seen").collect()}


@pytest.mark.parametrize("name", ["audit_summary", "section_reorder", "reference_roundtrip", "review_queue", "visible_text"])
def test_registered_queries_run(spark, folder, name):
    import __spark_entry__ as driver

    assert driver.queries()[name](spark, folder).count() > 0
