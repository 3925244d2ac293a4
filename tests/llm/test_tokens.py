"""Corpus encoding against the tokenizer's own library, and the round trip."""

import os

import pytest

from wordloom.llm import tokens
from wordloom.llm.tokens import VOCABULARY, decode_corpus, encode_corpus, encoder, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")

SCHEMA = "doc_id bigint, text string, block int, word string, ids string, key int, codes string, place int"
TEXTS = [
    (1, "Don't stop,  we'll see 42 times!\r\n\tok"), (2, None), (3, ""), (4, "   "), (5, "日本語のテキスト 🚀🚀 naïve é"), (6, "<|endoftext|> x"),
    (7, "a" * 3000), (8, "word " * 5000), (8, "twice"), (None, "no key"), (9, "​ 　x\x00y"), (10, "नमस्ते ٣ ½ ²"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, "z", 3) for r in rows], SCHEMA)


def encoded(spark, rows):
    return sorted(((r.doc_id, list(r.ids)) for r in encode_corpus(table(spark, rows), "doc_id", "text").collect()), key=repr)


def library(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return sorted(((k, t.encode(x or "", add_special_tokens=False).ids) for k, x in rows), key=repr)


def test_encode(spark):
    assert encoded(spark, TEXTS) == library(TEXTS)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 20)
    assert encoded(spark, TEXTS) == library(TEXTS)


def test_empty(spark):
    assert encoded(spark, []) == []
    assert encoded(spark, [(1, None), (2, "")]) == [(1, []), (2, [])]


def test_round_trip(spark):
    rows = [r for r in TEXTS if r[0] is not None and r[1] != "twice"]
    ids = encode_corpus(table(spark, rows), "doc_id", "text")
    assert {r.doc_id: r.text for r in decode_corpus(ids, "doc_id").collect()} == {k: t or "" for k, t in rows}


def test_unknown_id(spark):
    with pytest.raises(Exception, match="no token"):
        decode_corpus(spark.createDataFrame([(1, [999_999])], "k int, ids array<int>"), "k").collect()


def test_every_character(spark):
    """Each code point in a word, a run and alone: the pattern splits as the library does."""
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0xA000, 0x11000, 7) if not 0xD800 <= c < 0xE000]
    rows = [(k, "".join(f"a{c}b {c}{c} 1{c}\n" for c in chars[at : at + 200])) for k, at in enumerate(range(0, len(chars), 200))]
    assert encoded(spark, rows) == library(rows)


def test_words_stand_alone():
    """A pre-token encoded by itself is the same pre-token."""
    import regex

    find = regex.compile(tokens.PATTERN).findall
    for _, text in TEXTS:
        assert all(find(w) == [w] for w in find(text or ""))


def test_counts(spark):
    counts = {r.doc_id: r.tokens for r in token_counts(table(spark, TEXTS[:7]), ["doc_id"], "text").collect()}
    assert counts == {k: len(encoder().encode_ordinary(t or "")) for k, t in TEXTS[:7]}
