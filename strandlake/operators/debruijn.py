"""De Bruijn graphs as two tables: nodes (kmer, coverage, first_seen) and edges (src, dst, first_seen)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from strandlake.functions.sequence import canonical, normalise
from strandlake.functions.windows import LETTERS, pieces, points, ranks, window_codes
from strandlake.operators.kmers import check_k
from strandlake.session import shared_dir


def _count(k: int, letters: int):
    """Batches of id and sequence, in order of id, to mer, n, id and pos: how often and where first a piece has each k-mer
    together with the letter after it; the last k-mer of a row stands alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, known = batch.column(0), batch.column(0).to_pylist()
            same = np.cumsum([False] + [a != b for a, b in pairwise(known)])  # rows of one id
            for rows, begins, parts in pieces(batch.column(1).to_pylist(), k, letters):
                text = "".join(parts)
                sizes = np.array([len(x) for x in parts])
                of = np.repeat(np.arange(len(parts)), sizes)
                at = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                left = np.repeat(sizes, sizes) - at
                x, base = ranks(points(text))
                codes, bound = window_codes(x, base, k)
                if bound * base >= 1 << 62:
                    codes, bound = ranks(codes)
                after = np.where(left > k, np.append(x[k:], np.zeros(k, dtype=np.int64)), 0)[: len(codes)]
                place = np.flatnonzero((left >= k) & (at < letters))
                codes = codes[place] * base + after[place]
                group = same[rows]
                if (group[1:] == group[:-1]).any():  # the least position of an id may be in a later row
                    pos = at + np.array(begins)[of]
                    order = np.lexsort((pos[place], group[of[place]]))
                    place, codes = place[order], codes[order]
                _, first, n = np.unique(codes, return_index=True, return_counts=True)
                first = place[first]
                part = of[first]
                size = np.minimum(left[first], k + 1)
                mers = [text[i : i + m] for i, m in zip(first.tolist(), size.tolist(), strict=True)]
                pos = (at[first] + np.array(begins)[part]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(mers, batch.column(1).type), pa.array(n.astype(np.int64)), ids.take(pa.array(np.array(rows)[part])), pa.array(pos)], names=["mer", "n", "id", "pos"])

    return run


def build(df: DataFrame, k: int, seq: str = "sequence", id_: str = "id", canonical_: bool = False, min_coverage: int = 1) -> tuple[DataFrame, DataFrame]:
    """first_seen is (row id, position) of the first occurrence.

    The sequences are read once: k-mers with the letter after them are counted and written down (checkpoint()), and both
    tables come from them.
    """
    check_k(k, 2)
    shared_dir(df.sparkSession)
    rows = df.select(F.col(id_).alias("id"), normalise(F.col(seq)).alias("sequence")).where(F.length("sequence") >= k).sortWithinPartitions("id")
    id_type = rows.schema["id"].dataType
    counted = rows.mapInArrow(_count(k, LETTERS), StructType([StructField("mer", StringType()), StructField("n", LongType()), StructField("id", id_type), StructField("pos", IntegerType())]))
    mers = counted.groupBy("mer").agg(F.sum("n").alias("n"), F.min(F.struct("id", "pos")).alias("first_seen")).checkpoint()
    end = lambda i: canonical(F.substr("mer", F.lit(i), F.lit(k))) if canonical_ else F.substr("mer", F.lit(i), F.lit(k))
    nodes = mers.groupBy(end(1).alias("kmer")).agg(F.sum("n").alias("coverage"), F.min("first_seen").alias("first_seen"))
    edges = mers.where(F.length("mer") > k).select(end(1).alias("src"), end(2).alias("dst"), "first_seen")
    # Otherwise a k-mer and the next are as many edges as (k + 1)-mers.
    edges = edges.groupBy("src", "dst").agg(F.min("first_seen").alias("first_seen")) if canonical_ else edges
    return (nodes, edges) if min_coverage <= 1 else prune(nodes, edges, min_coverage)


def _between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    alive = nodes.select("kmer")
    return edges.join(alive, edges.src == alive.kmer, "left_semi").join(alive, edges.dst == alive.kmer, "left_semi")


def prune(nodes: DataFrame, edges: DataFrame, min_coverage: int) -> tuple[DataFrame, DataFrame]:
    """Without nodes of lower coverage and their edges."""
    kept = nodes.where(F.col("coverage") >= min_coverage)
    return kept, _between(edges, kept)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("kmer")).agg(F.count(F.lit(1)).alias("out"))
    into = edges.groupBy(F.col("dst").alias("kmer")).agg(F.count(F.lit(1)).alias("in"))
    return nodes.join(out, "kmer", "left").join(into, "kmer", "left").fillna(0, ["out", "in"])


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).agg(
        F.count(F.lit(1)).alias("node_count"), F.coalesce(F.sum("out"), F.lit(0)).alias("edge_count"),
        F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("avg_coverage"), F.coalesce(F.max("coverage"), F.lit(0)).alias("max_coverage"),
        F.count(F.when(F.col("out") > 1, 1)).alias("branching_nodes"), F.count(F.when(F.col("out") == 0, 1)).alias("dead_ends"),
    )


def contigs(nodes: DataFrame, edges: DataFrame, k: int, min_length: int | None = None, max_rounds: int = 64) -> DataFrame:
    """Sequences of unbranched paths (contig, first_seen), at least k + 1 long unless stated.

    A path starts at a node with one successor whose own predecessor, if it is the only one, branches; it goes on while
    there is one successor with one predecessor.  The paths come from pointer jumping: every node of a chain holds its
    furthest known head and distance, both of which double each round; checkpoint() cuts the lineage.
    """
    shared_dir(nodes.sparkSession)
    d = degrees(nodes, edges)
    single = d.where("out = 1").select(F.col("kmer").alias("src"))
    entered = d.where("`in` = 1").select(F.col("kmer").alias("dst"))
    links = edges.select("src", "dst").join(single, "src").join(entered, "dst").where("src <> dst")
    heads = d.where("out = 1").select("kmer", "first_seen").join(links.select(F.col("dst").alias("kmer")), "kmer", "left_anti")
    # Every node that a link enters knows who stands before it; jumping turns that into its chain's head.
    state = links.select(F.col("dst").alias("kmer"), F.col("src").alias("head"), F.lit(1).cast("long").alias("dist")).checkpoint()
    for _ in range(max_rounds):
        back = state.select(F.col("kmer").alias("head"), F.col("head").alias("head2"), F.col("dist").alias("dist2"))
        state = state.join(back, "head", "left").select("kmer", F.coalesce("head2", "head").alias("head"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.col("head2").isNotNull().alias("moved")).checkpoint()
        moving = state.where("moved").join(heads.select(F.col("kmer").alias("head")), "head", "left_semi")
        if moving.isEmpty():
            break
        state = state.drop("moved")
    chain = state.select("head", "dist", F.right("kmer", F.lit(1)).alias("c")).join(heads.withColumnRenamed("kmer", "head"), "head", "right")
    path = chain.groupBy("head", "first_seen").agg(F.array_sort(F.collect_list(F.struct("dist", "c"))).alias("cs"))
    out = path.select(F.concat("head", F.array_join(F.transform(F.filter("cs", lambda x: x["dist"].isNotNull()), lambda x: x["c"]), "")).alias("contig"), "first_seen")
    return out.where(F.length("contig") >= (k + 1 if min_length is None else min_length))


def remove_tips(nodes: DataFrame, edges: DataFrame, max_length: int) -> tuple[DataFrame, DataFrame]:
    """Without the dead ends whose unbranched way back is of max_length steps at most.

    A step goes to the first inserted predecessor, while that has at most one successor; only the dead end itself goes.
    """
    d = degrees(nodes, edges)
    before = edges.groupBy(F.col("dst").alias("at")).agg(F.min_by("src", F.struct("first_seen", "src")).alias("prev"))
    before = before.join(d.select(F.col("kmer").alias("prev"), F.col("out").alias("prev_out")), "prev")
    state = d.where("out = 0").select(F.col("kmer").alias("tip"), F.col("kmer").alias("at"), F.lit(0).alias("steps"), F.lit(True).alias("open"))
    for _ in range(max_length + 1):
        go = F.col("open") & F.coalesce(F.col("prev_out") <= 1, F.lit(False))
        state = state.join(before, "at", "left").select("tip", F.when(go, F.col("prev")).otherwise(F.col("at")).alias("at"), (F.col("steps") + go.cast("int")).alias("steps"), go.alias("open"))
    gone = state.where(F.col("steps") <= max_length).select(F.col("tip").alias("kmer"))
    kept = nodes.join(gone, "kmer", "left_anti")
    return kept, _between(edges, kept)
