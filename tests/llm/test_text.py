"""Look-alike forms, hidden copies, heading mapping, leaks and languages on small fixtures."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import copies, headings, languages, leaks, lookalikes

TABLE = lookalikes.representatives(lookalikes.classes(), {})
REWRITE = lookalikes.Rewriter(TABLE)
SAME = [("office", "oﬃce"), ("office", "oﬀice"), ("naïve", "naïve"), ("naïve", "nа​ïve"), ("a b", "a b"), ("a-b", "a‑b"), ("Ohm Ω", "Ohm Ω"), ("coöp", "cоӧp"), ("Ａｂ１", "Ab1"), ("5 µm", "5 μm"), ("x...", "x…"), ("cut", "c­ut"), (";", ";")]
OTHER = [("naïve", "naive"), ("a", "A"), ("m²", "m2"), ("½", "1/2"), ("①", "1"), ("a b", "a  b"), ("0", "O"), ("l", "1"), ("é", "è")]


def test_forms():
    assert all(REWRITE(a) == REWRITE(b) for a, b in SAME), [(a, b) for a, b in SAME if REWRITE(a) != REWRITE(b)]
    assert all(REWRITE(a) != REWRITE(b) for a, b in OTHER)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("afḯоеｆﬁﬃ  ‍-‐é½ß")), max_size=12))
def test_forms_are_stable(text):
    assert REWRITE(REWRITE(text)) == REWRITE(text)


def test_pairs_of_look_alikes(spark):
    rows = [("k", "a", "fine"), ("k", "a", "fine"), ("k", "b", "ﬁne"), ("k", "c", "fine"), ("k", "d", "f​ine"), ("j", "e", "fine"), ("k", "f", None), ("k", None, "ﬁne"), ("k", "g", "")]
    df, table = lookalikes.forms(spark.createDataFrame(rows, "kind string, key string, text string"), "text")
    got = {tuple(r) for r in lookalikes.look_alike_pairs(lookalikes.look_alike_classes(df, "kind", "key", "text", "form")).collect()}
    texts = {(k, x): t for k, x, t in rows if x and t is not None}
    form = lookalikes.Rewriter(table)
    want = {(k, a, b) for (k, a), (j, b) in itertools.permutations(texts, 2) if k == j and a < b and texts[k, a] != texts[j, b] and form(texts[k, a]) == form(texts[j, b])}
    assert got == want and len(want) == 5
    sizes = {(r.kind, r.key): (r.n_texts, r.n_keys) for r in lookalikes.look_alike_classes(df, "kind", "key", "text", "form").collect()}
    assert sizes["k", "a"] == (3, 4) and sizes["j", "e"] == sizes["k", "g"] == (1, 1) and len(sizes) == 6


def test_a_form_of_many_copies_gives_only_its_pairs(spark):
    df = spark.range(100_000).select(F.lit("k").alias("kind"), F.concat(F.lit("a"), F.col("id")).alias("key"), F.lit("fine").alias("text"), F.lit("fine").alias("form"))
    odd = spark.createDataFrame([("k", "b", "ﬁne", "fine")], "kind string, key string, text string, form string")
    classed = lookalikes.look_alike_classes(df.unionByName(odd), "kind", "key", "text", "form")
    assert classed.select("n_texts", "n_keys").distinct().collect() == [(2, 100_001)]
    assert lookalikes.look_alike_pairs(classed).count() == 100_000


def test_copies_in_both_paths(spark):
    base = ("Doe J (2001) Big Straße: a test. Journal 5(2).", "Big Straße: a test", "10.1/AB")
    rows = [(i, *base) for i in range(40)] + [(40, "JOURNAL 5/2, 2001. DOE J: BIG STRASSE - A TEST", "big strasse; a  test", "https://doi.org/10.1/ab"), (41, base[0], None, base[2]), (42, base[0], "Straße Big: a test", base[2]), (43, "", "", ""), (44, None, None, None), (45, None, None, None), (None, *base), (46, base[0], base[1], "doi: 10.1/ab.")]
    df = spark.createDataFrame(rows, "id long, raw string, title string, doi string")
    key = copies.record_key(F.col("raw"), [F.col("title")], [F.col("doi")])
    for hot in (3, 10_000):
        got = {r.id: (r.first_id, r.n_copies) for r in copies.collapse(df, "id", key, hot_rows=hot).collect()}
        assert got == {**{i: (0, 42) for i in [*range(41), 46]}, 41: (41, 1), 42: (42, 1), 43: (43, 1), 44: (44, 2), 45: (44, 2)}
    assert copies.collapse(df.limit(0), "id", key).count() == 0


def test_headings(spark):
    names = spark.createDataFrame([(1, "Results", ["Findings", None]), (2, "Data availability", None), (3, "Materials and methods", ["Methods"]), (4, None, None)], "heading_id long, heading string, aliases array<string>")
    typed = {"RESULTS": 1, "3.2 Reslts:": 1, "availability of data": 2, "Data avail.": 2, "Mat. & Meth.": 3, "Materialsa nd methods": 3, "II. finidngs": 1, "Resulting peat maps": -1, "Basalt": -1, "the": -1, "12": -1, "x" * 5000: -1}
    rows = [(i, t) for i, t in enumerate(typed)] + [(0, "RESULTS"), (90, None), (91, "  ")]
    got = {r.id: r.name_id for r in headings.map_values(spark.createDataFrame(rows, "id long, t string"), "id", "t", names, "heading_id", "heading", "aliases").collect()}
    assert got == dict(enumerate(typed.values()))
    parted = {r.id: r.name_id for r in headings.map_values(spark.createDataFrame(rows, "id long, t string"), "id", "t", names, "heading_id", "heading", "aliases", block_names=2).collect()}
    assert parted == got
    assert headings.map_values(spark.createDataFrame(rows, "id long, t string"), "id", "t", names.limit(0), "heading_id", "heading").where("name_id != -1").count() == 0


def test_mentions_among_other_words():
    m = headings.Matcher([(1, "Summary"), (2, "Reporting summary"), (3, "Competing interests"), (4, "Ethical statement"), (5, "Results")], frozenset(["statement"]))
    assert {t: m(t) for t in ("Rep. summary", "Reproting summary", "Competing interests statement", "Ethical statement", "Statement", "Results of snow", "Results gathered over nine long winters of snowmelt")} == {
        "Rep. summary": 2, "Reproting summary": 2, "Competing interests statement": 3, "Ethical statement": 4, "Statement": -1, "Results of snow": 5, "Results gathered over nine long winters of snowmelt": -1,
    }


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcd", max_size=9), st.text(alphabet="abcd", max_size=9))
def test_distance_equals_a_plain_table(a, b):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            options = [] if i and j else [i + j]
            if i and j:
                options = [d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1])]
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    options.append(d[i - 2, j - 2] + 1)
            d[i, j] = min(options)
    assert headings.distance(a, b) == d[len(a), len(b)]


def test_light_words_are_learnt(spark):
    rows = [("Results overview",)] * 5 + [("Methods overview",)] * 3 + [("Snow in winter",)] * 40 + [("Results of snow",)] * 4 + [(None,)]
    names = [(1, "Results"), (2, "Methods")]
    assert headings.light_words(spark.createDataFrame(rows, "t string"), "t", names) == {"overview"}


ITEM = "the rusted auger was dried over lime while a stack of index cards was returned unopened by the bell founder at night"


def test_leaks_match_brute_force(spark):
    rng = random.Random(5)
    words, filler = ITEM.split(), "ab cd ef gh ij kl mn op".split()
    docs: list[str | None] = [None, "", "short", ITEM.upper(), "<b>" + ITEM.replace(" ", "</b> ​"), ITEM.replace("returned", "retur\nned").replace("index", "in-\ndex")]
    for n in range(60):
        w = words[rng.randrange(8) : rng.randrange(12, 23)] if n % 2 else [x for x in words if rng.random() > 0.1]
        w = [rng.choice(filler) if rng.random() < 0.06 else x for x in w]
        docs.append(" ".join([*rng.choices(filler, k=rng.randrange(9)), *w, *rng.choices(filler, k=rng.randrange(9))]))
    items = [(1, ITEM), (2, "six words only in this one"), (3, None), (4, ""), (5, "tiny item"), (1, ITEM)]
    d = spark.createDataFrame(list(enumerate(docs)) + [(3, docs[3])], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for k, t in enumerate(docs):
        w, _ = leaks.words_of(t)
        for rid, item in {x: y for x, y in items if y}.items():
            iw, _ = leaks.words_of(item)
            if w and (leaks.has_run(w, iw) or leaks.errors(iw, w) <= len(iw) // 7):
                want.add((k, rid))
    for chars in (leaks.BLOCK_CHARS, 40):
        assert {tuple(r) for r in leaks.leaks(d, i, "doc_id", "text", "item_id", "text", block_chars=chars).collect()} == want
    assert 3 < len(want) < 60 and {(3, 1), (4, 1), (5, 1)} <= want
    assert leaks.leaks(d.limit(0), i, "doc_id", "text", "item_id", "text").count() == 0
    assert leaks.leaks(d, i.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_a_shingle_of_every_document_is_no_candidate():
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()
    held = leaks.Items([(1, " ".join(words)), (2, "one two three alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")])
    texts = [leaks.words_of(f"one two three common {n}") for n in range(50)] + [leaks.words_of("x " + " ".join(words) + " y")]
    text, shingle, _ = held.find(texts)
    held.order(np.bincount(shingle, minlength=held.count))
    common = held.shingles[0][0]
    assert common == held.shingles[1][0] and held.prefix_of[common] == [] and held.leaked(texts) == [(50, 1)]


def test_texts_are_taken_in_bounded_stretches():
    sizes = [None, 5, leaks.AT_ONCE_CHARS + 1, 0, leaks.AT_ONCE_CHARS, 1] + [1] * 2500
    parts = list(leaks._slices([None if n is None else "x" * n for n in sizes]))
    assert [i for a, b in parts for i in range(a, b)] == list(range(len(sizes))) and list(leaks._slices([])) == []
    assert all(b - a <= leaks.AT_ONCE and (b - a == 1 or sum(n or 0 for n in sizes[a:b]) <= leaks.AT_ONCE_CHARS) for a, b in parts)


def test_automaton_knows_exactly_the_substrings():
    text = "abracadabra"
    moves = languages.suffix_automaton([ord(c) for c in text])
    inside = {text[a:b] for a in range(len(text)) for b in range(a + 1, len(text) + 1)}
    for n in range(1, 5):
        for w in map("".join, itertools.product("abcdr", repeat=n)):
            state: int | None = 0
            for c in w:
                state = moves[state].get(ord(c)) if state is not None else None
            assert (state is not None) == (w in inside)


def test_costs_equal_a_plain_parse():
    model = languages.Model.fit({"x": [" the cat sat on the mat "], "y": [" le chat est sur le tapis "]})
    for line in (" the mat ", " zzz ", " chat sat ", " le the ") + (" the cat " * 60,):
        for k, source in enumerate((" the cat sat on the mat ", " le chat est sur le tapis ")):
            n = 0
            for a in range(0, len(line), languages.PIECE):
                piece, at = line[a : a + languages.PIECE], 0
                while at < len(piece):
                    end = at + 1
                    while end < len(piece) and piece[at : end + 1] in source:
                        end += 1
                    n, at = n + 1, end
            assert model.costs([line], probe=languages.PIECE)[0, k] == pytest.approx(n * model.bits[k])
            assert model.costs([line], probe=5, margin=1e9)[0, k] == pytest.approx(n * model.bits[k])


def test_lines_are_read_to_their_end_in_every_language():
    x, y = "the cat sat on the mat and saw the dog run home to the old red barn by the sea ", "le chat est sur le tapis et voit courir un chien vers la vieille grange rouge au bord de mer "
    model = languages.Model.fit({"x": [f" {x}"], "y": [f" {y}"]})
    line = x + y + y[:-1]  # x leads by far at first
    assert len(line) > languages.PIECE and model.costs([f" {x}"])[0, 1] > 64 + model.costs([f" {x}"])[0, 0]
    assert [r[:2] for r in languages.parts_of(model, [line])[0]] == [(0, "y")]
    assert np.array_equal(model.costs([line]), model.costs([line], probe=languages.PIECE, margin=1e9))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcde", min_size=1, max_size=60), min_size=1, max_size=4), st.text("abcdef", min_size=1, max_size=90))
def test_packed_moves_are_those_of_the_automata(samples, line):
    model = languages.Model.fit({str(k): [x] for k, x in enumerate(samples)})
    for k, x in enumerate(samples):
        n = at = 0
        while at < len(line):
            end = at + 1
            while end < len(line) and line[at : end + 1] in x:
                end += 1
            n, at = n + 1, end
        assert model.costs([line])[0, k] == pytest.approx(n * model.bits[k])


def test_samples_are_of_whole_texts(spark):
    def lines(seed: int, letters: str, n: int) -> list[str]:
        draw = random.Random(seed)
        return [" ".join("".join(draw.choices(letters, k=5)) for _ in range(8)) for _ in range(n)]

    short, long = lines(1, "abcdefghij", 150), lines(2, "klmnopqrst", 2000)
    one_line = " ".join(lines(3, "uvwxyzäöüß", 150))
    docs = spark.createDataFrame([(1, "\n".join(short), "en"), (2, "\n".join(long), "de"), (3, one_line, "fr")], "doc_id long, text string, lang string")
    model = languages.fit(docs, "doc_id", "text", "lang")
    known = {k: (lambda part, k=k: np.isclose(model.costs([f" {x} " for x in part])[:, model.names.index(k)], model.bits[model.names.index(k)])) for k in model.names}
    assert len("\n".join(short)) > 4000 and known["en"](short).all()  # all of it fits
    assert all(0.1 < known["de"](long[a : a + 500]).mean() < 0.5 for a in range(0, 2000, 500))  # a sample of each part
    words = one_line.split()
    assert np.mean([model.costs([w])[0, model.names.index("fr")] <= 2 * model.bits[model.names.index("fr")] for w in words[-200:]]) > 0.99


def test_language_accuracy_on_held_out_documents(spark, folder):
    docs = spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet")
    train, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = languages.fit(train, "doc_id", "text", "lang")
    rows = languages.identify(rest, model, "doc_id", "text", "lang").where("part_no = 0 and label is not null").collect()
    assert sum(r.lang == r.label for r in rows) / len(rows) > 0.8  # some labels are wrong
    odd = spark.createDataFrame([(1, None, "en"), (2, " \n ", "en"), (3, "12 34\n--", "en"), (3, "12 34\n--", "en")], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.part_no, r.lang) for r in languages.identify(odd, model, "doc_id", "text", "lang").collect()) == [(3, 0, "und")] * 2
    assert languages.named("EN_us") == "en" and languages.named(" Français ") == "fr" and languages.named("und") is None
