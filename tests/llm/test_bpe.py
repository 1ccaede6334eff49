"""The transducer against the tokenizers library."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm.bpe import Decoder, Encoder, Vocabulary, default_path, runs

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def parts():
    v = Vocabulary(open(default_path(), "rb").read())
    return v, tokenizers.Tokenizer.from_file(default_path())


def ids_of(encoder, text):
    return [i for part in encoder.encode(text) for i in part]


def agree(parts, text, **sizes):
    v, known = parts
    mine = ids_of(Encoder(v, **sizes), text)
    assert mine == known.encode(text, add_special_tokens=False).ids
    d = Decoder(v)
    assert "".join([*map(d.feed, runs([mine], 3)), d.end()]) == known.decode(mine, skip_special_tokens=False)


def test_lookahead_is_bounded(parts):
    assert 0 < parts[0].lookahead < 2000


@pytest.mark.parametrize("text", ["", " ", "a", "It's we'll  do\n\n x ", "<|endoftext|>a<|endoftext|>", "a" * 5000, "ab" * 3000, "é漢字" * 900, " \t\x1c\x1d\x85  x", "x" + " " * 3000 + "y", "=" * 4000, "'r" * 50])
def test_fixed(parts, text):
    agree(parts, text)
    agree(parts, text, window=16, buffer=130)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinorst 'Thé\n\t.,<|>0漢"), st.characters(exclude_categories=["Cs"])), max_size=400))
def test_random(parts, text):
    agree(parts, text, window=16)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aeinorsthTcdl", min_size=600, max_size=1500))
def test_long_words_stream(parts, text):
    agree(parts, text, buffer=130)


def test_every_character(parts):
    for lo in range(0, 0x30000, 0x400):
        text = "a".join(chr(c) + " " + chr(c) for c in range(lo, lo + 0x400) if not 0xD800 <= c < 0xE000)
        agree(parts, text)


def test_invalid_bytes_decode_like_the_library(parts):
    v, known = parts
    ids = [v.byte_ids[b] for b in bytes([0xE6, 0xBC, 0x41, 0xF0, 0x9F, 0x80, 0xFF, 0xC3])]
    d = Decoder(v)
    assert "".join([*(d.feed([i]) for i in ids), d.end()]) == known.decode(ids, skip_special_tokens=False)


def test_spark_rows(spark):
    from strandlake.llm.bpe import tokenize

    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "the cat", 7), (None, "the cat", 8)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in tokenize(docs, keep_ids=True).collect()}
    assert got[1].n_tokens == 0 and got[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].ids == got[None].ids and got[3].decoded_sha256 == hashlib.sha256(b"the cat").hexdigest()
    assert tokenize(docs.limit(0)).count() == 0
