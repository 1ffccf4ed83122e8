import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import encoding as en

pytestmark = pytest.mark.skipif(not os.path.exists(en.TOKENIZERS), reason="no vocabulary files")
ODD = ["", None, "Hello  world\n\n ok", "it's we'll ''s 'S", "naïvé Ünïcode ½ ² Ⅷ", "漢字かな交じり文", "🔌⚡ ​﻿\xa0　x", "<|endoftext|> a<|endoftext|>", "\t\r\n \x07 \x1c end  ", "a" * 3000, "1234567 12.5€ —…", " " * 50, "مرحبا بالعالم", "x   y\x85z", "the the the", "new \U00010570\U0001E030 letters, \U0001FAE8 \uffff"]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{en.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_encode_equals_the_whole_text_tokenizer(spark):
    t = reference()
    docs = spark.createDataFrame([(i, x, "clash", 1) for i, x in enumerate(ODD)] + [(None, "null key", "c", 1), (0, "same key", "c", 1)], "doc_id long, text string, word string, pos int")
    got = [(r.doc_id, list(r.ids)) for r in en.encode(docs).collect()]
    want = [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in [*enumerate(ODD), (None, "null key"), (0, "same key")]]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_random_texts(spark):
    t, texts = reference(), []

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=st.characters(min_codepoint=1, max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn")), max_size=40))
    def collect(x):
        texts.append(x)

    collect()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in en.encode(docs).collect()}
    bad = [x for i, x in enumerate(texts) if got[i] != t.encode(x, add_special_tokens=False).ids]
    assert not bad, bad[:3]


def test_round_trip_and_counts(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    back = {r.doc_id: r.text for r in en.decode(en.encode(docs), en.piece_table(spark)).collect()}
    assert all(back[i] == (x or "") for i, x in enumerate(ODD))
    t = reference()
    assert {r.doc_id: r.n_tokens for r in en.token_counts(docs).collect()} == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(ODD)}
    assert en.encode(docs.limit(0)).count() == 0


def test_every_word_beyond_the_head(spark, monkeypatch):
    monkeypatch.setattr(en, "HEAD_CHARS", 0)
    docs, t = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string"), reference()
    assert {r.doc_id: list(r.ids) for r in en.encode(docs).collect()} == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(ODD)}


def test_rare_words_go_by_key(spark, monkeypatch):
    monkeypatch.setattr(en, "HEAD", 2)
    docs = spark.createDataFrame([(1, "the the the the one two three"), (2, "the the the")], "doc_id long, text string")
    t = reference()
    assert {r.doc_id: list(r.ids) for r in en.encode(docs).collect()} == {1: t.encode("the the the the one two three").ids, 2: t.encode("the the the").ids}
