import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.bpe import BYTE_BPE_50K, TOKENIZERS, Bpe, count_tokens, decode_corpus, encode_corpus

pytestmark = pytest.mark.skipif(not os.path.exists(BYTE_BPE_50K), reason="no vocabulary files here")
TEXTS = ["", " ", "a", "The base rate, 7.5%!", "판정 대기 중이다.\r\n\r\n확률 14%", "<|endoftext|> x", "it's I'll they'd", "  two  blanks ", "x" * 3000, "한" * 500, "👩‍💻 é ​﻿", "\n" * 70 + "a", "\t　é" * 40]


@pytest.fixture(scope="module")
def bpe():
    with open(BYTE_BPE_50K, "rb") as file:
        return Bpe(file.read())


@pytest.fixture(scope="module")
def peer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_like_the_public_library(bpe, peer):
    for text in TEXTS:
        assert bpe.encode(text) == peer(text), text[:20]
        assert bpe.decode(bpe.encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(bpe, peer, text):
    assert bpe.encode(text) == peer(text)
    assert bpe.decode(bpe.encode(text)) == text


def test_ties_merge_leftmost_first():
    ranks = [b"a", b"b", b"aa", b"aaa", b"ab"]
    tiny = Bpe(b"\n".join(base64.b64encode(w) + b" " + str(i).encode() for i, w in enumerate(ranks)))
    assert tiny.merge(b"aaaaa") == [2, 3]  # aa aa a, then aa aaa
    assert tiny.merge(b"aab") == [2, 1]
    assert tiny.merge(b"a") == [0]


def test_corpus_keeps_every_row(spark):
    data = [(1, "one", "x"), (2, None, "x"), (3, "", "x"), (1, "one", "x"), (None, "two three", "x"), (5, "긴 글 " * 5000, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    coded = encode_corpus(df)
    got = sorted(((r["doc_id"], len(r["ids"])) for r in coded.collect()), key=str)
    assert [k for k, _ in got] == [1, 1, 2, 3, 5, None] and dict(got)[2] == 0 == dict(got)[3]
    texts = {r["doc_id"]: r["text"] for r in decode_corpus(coded).collect()}
    assert texts == {1: "one", 2: "", 3: "", None: "two three", 5: "긴 글 " * 5000}
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(df).collect()}[2] == 0
    assert encode_corpus(df.limit(0)).collect() == []
