"""Encoding by the tree, and in place, against the library itself."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialstats.llm import bpe, registered

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = [
    "a", "b", "ab", "the", "s", "'", "'s", "'re", "'l", "l", " ", "  ", "\n", "\t", "\x1c", "\xa0", "1", "23", "²", "!", "!!", "...", "-", "é", "é", "́",
    "̣̇", "İ", "Σ", "ß", "ſ", "漢", "字", "ᄀ", "ᅡ", "ᆨ", "ह", "ि", "₂", "🙂", "👍🏽", "<|", "<|endoftext|>", "<|startoftext|>", "endoftext|>", "<|endo", "A", "Z",
]
texts = st.lists(st.sampled_from(PIECES), max_size=60).map("".join) | st.text(max_size=60)


@pytest.fixture(scope="module")
def coder():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Coder(file.read())


def library(coder, text):
    found = coder.library.encode(text, add_special_tokens=False)
    return found.ids, coder.library.decode(found.ids, skip_special_tokens=False)


def tree(coder, text, leaf, window):
    ends = bpe.leaves(text, leaf)
    assert [a for a, _ in ends] + [len(text)] == [0] + [b for _, b in ends]
    pieces = [np.array(coder.ids(text[a:b]), np.int32) for a, b in ends]
    return bpe.concatenated(coder, text, pieces, ends, window).tolist()


@settings(max_examples=400, deadline=None)
@given(text=texts, leaf=st.integers(1, 20), window=st.integers(1, 20))
def test_tree_and_in_place(coder, text, leaf, window):
    ids, decoded = library(coder, text)
    assert tree(coder, text, leaf, window) == ids
    assert coder.ids(text) == ids
    assert coder.decoded(ids) == decoded
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)]
    assert coder.digests(text) == (len(ids), *sha)


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "eé", "!-", "!'s", "01", "漢字", "á", "th in ", "₂ab", "́"])
def test_unsplit_runs(coder, alphabet):
    """Words of thousands of letters, which no blank cuts, at every size of leaf and window."""
    rng = random.Random(alphabet)
    for n, leaf, window in ((700, 40, 1), (3000, 200, 16), (3000, 500, 64)):
        text = "".join(rng.choices(alphabet, k=n))
        assert tree(coder, text, leaf, window) == library(coder, text)[0]


def test_plain_texts_are_told_apart(coder):
    assert coder._plain.fullmatch("It's 3 o'clock, Ñandú: \x1c ß!\n")
    for odd in ("é", "İ", "\xa0", "²", "漢", "\x85"):
        assert not coder._plain.fullmatch(odd)


def test_store_of_words_is_bounded(coder, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 3)
    text = "one two three four five six one two"
    assert coder.ids(text) == library(coder, text)[0]
    assert len(coder._seen) <= 3


def test_another_vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        other = bpe.Coder(file.read())
    rng = random.Random(5)
    for _ in range(30):
        text = "".join(rng.choices(PIECES, k=80))
        ids, decoded = library(other, text)
        assert tree(other, text, 16, 8) == ids == other.ids(text)
        assert other.decoded(ids) == decoded


def test_rows(spark, coder):
    long = "x" * 900 + " " + "Ab1, " * 400
    rows = [(1, "It's  a test"), (2, None), (3, ""), (None, " \n"), (5, long), (5, long), (6, "<|endoftext|> é"), (1, "It's  a test")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id bigint, text string, ids string, digest string, _text string")
    got = bpe.decoded(bpe.encoded(docs, PATH, leaf=100), PATH).collect()
    assert sorted(got[0].asDict()) == ["_text", "decoded", "digest", "doc_id", "ids", "text"]
    want = [(i, t, *library(coder, t or "")) for i, t in rows]
    assert sorted(map(str, [(r.doc_id, r.text, r.ids, r.decoded) for r in got])) == sorted(map(str, want))
    digests = bpe.round_trip(docs, PATH, leaf=100).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, len(ids), sha(" ".join(map(str, ids))), sha(d)) for i, _, ids, d in want]
    assert sorted(map(str, map(tuple, digests))) == sorted(map(str, want))
    assert bpe.encoded(docs.limit(0), PATH).count() == 0 == bpe.round_trip(docs.limit(0), PATH).count()
    nulls = spark.createDataFrame([(None,)], "ids array<int>")
    assert bpe.decoded(nulls, PATH).first().decoded == ""


def test_query(spark, tiny, coder):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in registered.QUERIES["op12_bpe"](spark, tiny).collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids, decoded = library(coder, r.text or "")
        assert got[r.doc_id] == (r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    # At the leaf of the query some texts are long.
    assert spark.read.parquet(f"{tiny}/documents.parquet").filter(F.char_length("text") > bpe.LEAF).count() > 0
