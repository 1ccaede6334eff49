"""Suffix arrays against sorting, and removal against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import suffix


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80))
def test_suffix_array(values):
    t = np.array([*values, 0])
    assert suffix.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_suffix_array_large_alphabet_and_runs():
    rng = np.random.default_rng(1)
    for t in (rng.integers(1, 900, 4000), np.tile(rng.integers(1, 60, 70), 40), np.full(500, 3), np.repeat(rng.integers(1, 9, 60), 9)):
        t = np.append(t, 0)
        assert suffix.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_permuted_lcp():
    rng = np.random.default_rng(2)
    t = np.append(np.tile(rng.integers(1, 5, 37), 9), 0)
    sa = suffix.suffix_array(t)
    phi, lcp = suffix.permuted_lcp(t, sa, 50)
    for i in range(len(t)):
        j, n = phi[i], 0
        while j >= 0 and n < 50 and max(i, j) + n < len(t) and t[i + n] == t[j + n]:
            n += 1
        assert lcp[i] == n


def brute(rows, size):
    seen, out = set(), set()
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            w = raw[i : i + size]
            if w in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone, strict=False))
        out.add((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    make = lambda n: "".join(r.choice("abcdefgh éß\n") for _ in range(n))
    passages = [make(r.choice([90, 110, 140, 300])) for _ in range(6)]
    common = make(60)
    rows = []
    for i in range(90):
        parts = [r.choice([make(r.choice([0, 5, 60, 200])), r.choice(passages), common + make(9), r.choice(passages)[r.randrange(40) :], "ab" * r.choice([10, 80]), "x" * r.choice([3, 260])]) for _ in range(r.choice([1, 2, 5]))]
        rows.append((i * 2, "".join(parts)))
    return rows + [(900, None), (901, ""), (902, rows[3][1]), (903, rows[3][1]), (904, "x" * 3000)]


@pytest.mark.parametrize("seed,size,spread", [(1, 100, 2048), (2, 40, 2048), (3, 40, 3)])
def test_against_all_windows(spark, seed, size, spread):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ranges int").repartition(5)
    got = {tuple(r) for r in suffix.remove_repeats(docs, size, spread=spread, shard_bytes=3000).collect()}
    assert got == brute(rows, size)


def test_edges(spark):
    t = "".join(map(str, range(200)))
    docs = spark.createDataFrame([(None, t, 1), (5, t, 2), (5, t, 3), (6, t, 4)], "doc_id long, text string, n_removed int")
    got = sorted(((r.doc_id, r.n_removed, len(r.text)) for r in suffix.remove_repeats(docs, keep_text=True).collect()), key=str)
    assert got == sorted([(None, 0, len(t)), (5, 0, len(t)), (5, 0, len(t)), (6, len(t), 0)], key=str)
    assert suffix.remove_repeats(docs.limit(0)).count() == 0
