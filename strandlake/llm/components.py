"""Connected components of a link table: local spanning stars, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm._spark import Scratch

#: Links that a task draws together at a time.
CHUNK = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links u - v: each node but the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, up = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        if not (differ := x != y).any():
            break
        np.minimum.at(up, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while not np.array_equal(up, nxt := up[up]):
            up = nxt
    below = up != np.arange(len(nodes))
    return nodes[below], nodes[up[below]]


def local_stars(edges: DataFrame) -> DataFrame:
    """Links u > v with the same components and at most as many: those a task reads, chunk by chunk, as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*map(np.concatenate, zip(*held, strict=True)))], names=["u", "v"])
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*map(np.concatenate, zip(*held, strict=True)))], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _settled(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then the links are stars around the least nodes."""
    ends = edges.select(F.col("u").alias("x"), F.col("v").alias("to"), F.lit(False).alias("met")).unionByName(edges.select(F.col("v").alias("x"), F.lit(None).cast("long").alias("to"), F.lit(True).alias("met")))
    nodes = ends.groupBy("x").agg(F.min("to").alias("least"), F.max("to").alias("most"), F.max("met").alias("met"))
    return not nodes.agg(F.max((F.col("least") < F.col("most")) | (F.col("met") & F.col("least").isNotNull()))).first()[0]


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and component (the least node reachable) of every node with a link to another.

    links: columns a and b, longs without nulls.  First each task draws the links it reads together into stars; then a
    step moves every link of a node to the least of its neighbours.  The links shrink to stars around the least nodes
    in a number of rounds that grows with the logarithm of the largest component.  A hot node is an aggregate and one
    side of a join, never a gathered group.  To add links to known components, pass those as links too.
    """
    raw = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-links-0")
    i = 0
    while True:
        edges = scratch.write(local_stars(raw), f"{name}-{i}")
        scratch.drop(f"{name}-links-{i}")
        if i:
            scratch.drop(f"{name}-{i - 1}")
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(down, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        i += 1
        raw = scratch.write(small, f"{name}-links-{i}")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    return scratch.write(found, name)
