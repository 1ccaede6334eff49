"""The join against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandlake.llm import ngram_join


def brute(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=260):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = "this very common line stands in nearly every document of the table".split()
    make = lambda k: [r.choice(vocabulary) for _ in range(k)]
    bases = [make(r.choice([3, 5, 6, 8, 9, 12, 16, 40, 90, 200])) for _ in range(25)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.35:
            w = list(bases[0] if kind < 0.2 and len(bases[0]) > 3 else r.choice(bases))
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        elif kind < 0.7:
            w = list(r.choice(bases)) + make(r.choice([0, 1, 2, 20]))
        else:
            w = make(r.choice([1, 4, 5, 7, 12, 60]))
        if r.random() < 0.5:
            w += line
        rows.append((i * 3 + 1, r.choice([" ", "\n", "  "]).join(w)))
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "A b C d e"), (5004, "a B c D E"), (5005, "one"), (5006, "ONE")]


@pytest.mark.parametrize("seed,length", [(1, 48), (2, 4), (3, 2)])
def test_against_all_pairs(spark, monkeypatch, seed, length):
    monkeypatch.setattr(ngram_join, "LIST", length)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, id int").repartition(5)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_components(docs).collect()}
    assert got == brute(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.join_components(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (None, 0, None)], key=str)
    assert ngram_join.join_components(docs.limit(0)).count() == 0


def test_boundary_follows_cost():
    assert ngram_join.choose_boundary({8: 100}, 1000.0) >= 8
    assert ngram_join.choose_boundary({12: 100}, 0.1) < 12


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_blocks_miss_no_pair(spark, monkeypatch, block):
    """All pairs of a list between components, of which at least one is heavy, whatever the blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_H", block)
    monkeypatch.setattr(ngram_join, "BLOCK_M", block)
    rng = random.Random(3)
    sketch, members = bytes(ngram_join.SKETCH // 8), []
    for t in range(6):
        members += [(t, 100 * t + i, 50, sketch, rng.random() < (0, 0.3, 0.6, 1)[t % 4], rng.choice((7, 7, 7, 8, 9)[: t + 1])) for i in range(12)]
    schema = "t long, id long, n int, sketch binary, heavy boolean, component long"
    got = ngram_join._cross(spark.createDataFrame(members, schema), ngram_join.PERCENT, "all")
    want = {(x[1], y[1]) for x in members for y in members if x[0] == y[0] and x[1] < y[1] and x[5] != y[5] and (x[4] or y[4])}
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_failed_picks_hide_no_link(spark, monkeypatch):
    """b, the only leader, is the least and by sketch the closest partner of a and c, but links to neither; a and c are a link."""
    monkeypatch.setattr(ngram_join, "LIST", 2)
    monkeypatch.setattr(ngram_join, "LEADERS", 1)
    r = random.Random(96)
    make = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    base = make(404)
    a, b, c = list(base), base + make(6), list(base)
    for k in range(11):
        at = 10 + 35 * k
        b[at] = make(1)[0]
        (a if k < 6 else c)[at] = make(1)[0]
    least = spark.range(1, 50).orderBy(F.xxhash64("id", F.lit(0))).first().id
    rows = [(least, " ".join(b)), (least + 50, " ".join(a)), (least + 51, " ".join(c))]
    hashes = {x.id: x.h for x in spark.createDataFrame(rows, "id long, text string").select("id", F.xxhash64("id", F.lit(0)).alias("h")).collect()}
    assert min(hashes, key=hashes.get) == least
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert {x[2] for x in want} == {least, least + 50} and got == want
