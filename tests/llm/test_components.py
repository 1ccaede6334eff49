"""Connected components against union-find."""

import numpy as np
import pytest

from strandlake.llm import components as c
from strandlake.llm._spark import Scratch


def brute(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for pair in pairs if pair[0] != pair[1] for x in pair}


def cases():
    rng = np.random.default_rng(5)
    path = rng.permutation(400).tolist()
    yield [(a, b) for a, b in zip(path, path[1:])]
    yield [(7, i) for i in range(300)] + [(7, 7), (5, 5)]
    yield [tuple(map(int, rng.integers(0, 500, 2))) for _ in range(300)] * 2
    yield [(-3, 9), (9, -8), (2**62, 9)]
    yield []


@pytest.mark.parametrize("pairs", [*cases()])
@pytest.mark.parametrize("chunk", [1 << 20, 1])
def test_components(spark, monkeypatch, pairs, chunk):
    monkeypatch.setattr(c, "CHUNK", chunk)
    links = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    got = c.components(links, Scratch(spark, "test"), "g").collect()
    assert len({r.node for r in got}) == len(got)
    assert {r.node: r.component for r in got} == brute(pairs)


def test_known_components_take_new_links(spark):
    scratch = Scratch(spark, "test")
    groups = c.components(spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long"), scratch, "one")
    more = spark.createDataFrame([(4, 2), (9, 6)], "a long, b long")
    got = c.components(groups.selectExpr("node AS a", "component AS b").unionByName(more), scratch, "two").collect()
    assert {r.node: r.component for r in got} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 9: 5}
