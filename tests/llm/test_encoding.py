"""Chunked encoding equals plain encoding, and decoding gives the text back."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import encoding as E

TEXTS = [None, "", " ", "a", "don't we're " * 40, "x" * 900, " " * 700 + "end", "tab\tand\n\nlines \r\n" * 50, "日本語テキスト。" * 120, "<|endoftext|> is text " * 30, "1234567890" * 80, "été   naïve " * 60, "👩‍👩‍👧 " * 80]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'slle re\n\t 12é-日 ")), max_size=400))
def test_stitching_equals_plain_encoding(text):
    assert E.encode_text(text, chunk=48, overlap=20) == E.encoder(E.VOCABULARY).encode_ordinary(text)


def test_dataframe_equals_plain_encoding_and_round_trips(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(3, TEXTS[4], "again"), (4, TEXTS[4], "again"), (None, TEXTS[5], "no id")]
    df = spark.createDataFrame(rows, "id long, text string, ids string")
    got = E.encode(df, "id", "text", chunk=120, overlap=40).collect()
    enc = E.encoder(E.VOCABULARY)
    want = sorted(((i is None, i or 0, enc.encode_ordinary(t) if t else []) for i, t, _ in rows), key=str)
    assert sorted(((r.id is None, r.id or 0, list(r.ids)) for r in got), key=str) == want
    back = {r.id: r.text for r in E.decode(E.encode(df.where("id is not null").dropDuplicates(["id"]), "id", "text", chunk=120, overlap=40), "id", "ids").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS) if i not in (3, 4))


def test_agrees_with_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for x in TEXTS:
        if x:
            assert E.encode_text(x) == t.encode(x, add_special_tokens=False).ids


def test_empty_table_and_bad_sizes(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert E.encode(empty, "id", "text").count() == 0
    with pytest.raises(ValueError):
        E.encode(empty, "id", "text", chunk=40, overlap=30)
