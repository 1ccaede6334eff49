"""Size-aware heavy-light join of documents on word shingles (Jaccard similarity).

Sets of equal content are one class first.  Small sets enumerate the subsets of the size that a link
needs, so that a common key is a link; the boundary of "small" is where enumerating costs less than scanning.
Larger sets scan inverted lists of their prefix (enough of a set's shingles in a fixed order that two linked sets
share one).  A list too long to pair up all its members is heavy: its shingle goes last in the order, and a
set replaces it by its next light one.  Only sets that run out of light shingles (mostly members of large groups
of near copies) are still looked up in heavy lists, after the groups have been drawn together by links to a few
leaders and between their members; what then remains between different groups is compared in blocks.  No list, pair or set is left out.

Pairs are thinned by exact bounds only (sizes, places of the shared shingles, and the parity sketch, whose
differing bits never outnumber the differing shingles), then verified on the whole sets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm._spark import Scratch, table
from strandlake.llm._text import blocks, buffers, list_column, shingles, splitmix, stream, words
from strandlake.llm.components import components

#: Links need this many hundredths of Jaccard similarity.
PERCENT = 75
K = 5
#: A longer list is heavy.
LIST = 48
#: Sets up to this size may count as small; the cost decides.
MOST_SMALL = 12
#: Bits of the parity sketch.
SKETCH = 1024
#: Leaders that a heavy list is linked to before what remains is compared in blocks.
LEADERS = 3
#: Rows of either side of a block: some 200 bytes each, so that a task holds 13 MB, and a list is copied to few blocks.
BLOCK_H, BLOCK_M = 32768, 32768
#: Ids up to this number are broadcast to pick texts; more are joined by shuffle.
BROADCAST_IDS = 250_000
_U = np.uint64
_MIX = stream(21, 8)


def need(a: int, b: int, percent: int = PERCENT) -> int:
    """Common shingles that sets of these sizes need for a link."""
    return -(-percent * (a + b) // (100 + percent))


def needed(a: Column, b: Column, percent: int = PERCENT) -> Column:
    return F.ceil((a + b) * percent / F.lit(100.0 + percent) - 1e-9)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def extended_size(n: int, percent: int = PERCENT) -> int:
    """Shingles kept of a set: all of a short one, else the prefix and half of it again."""
    p = prefix_size(n, percent)
    return n if n <= 64 else p + max(8, p // 2)


def parity_sketch(tokens: np.ndarray, bits: int = SKETCH) -> bytes:
    at = (splitmix(tokens ^ _MIX[0]) >> _U(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def sets(docs: DataFrame, percent: int = PERCENT, k: int = K) -> DataFrame:
    """doc_id, n, set hash (k1, k2), prefix size, first shingles in order of hash, and sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            n, k1, k2, p, kept, sizes, sketch = [], [], [], [], [], [], []
            for i, j in blocks(offsets):
                w, rows, _ = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                s, bounds = shingles(w, rows, j - i, k)
                for r in range(j - i):
                    own = np.unique(s[bounds[r] : bounds[r + 1]])
                    size = len(own)
                    n.append(size)
                    k1.append(int(splitmix(own ^ _MIX[1]).sum(dtype=_U).view(np.int64)))
                    k2.append(int(splitmix(own ^ _MIX[2]).sum(dtype=_U).view(np.int64)))
                    p.append(prefix_size(size, percent))
                    kept.append(own[: extended_size(size, percent)])
                    sizes.append(len(kept[-1]))
                    sketch.append(parity_sketch(own))
            values = np.concatenate(kept) if kept else np.zeros(0, _U)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(p, pa.int32()), list_column(values, sizes), pa.array(sketch, pa.binary())],
                names=["doc_id", "n", "k1", "k2", "p", "kept", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n int, k1 long, k2 long, p int, kept array<long>, sketch binary")


def whole_sets(docs: DataFrame, ids: DataFrame, k: int = K) -> DataFrame:
    """id and all shingles (little-endian, sorted) of the documents named in ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            out = []
            for i, j in blocks(offsets):
                w, rows, _ = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                s, bounds = shingles(w, rows, j - i, k)
                out += [np.unique(s[bounds[r] : bounds[r + 1]]).tobytes() for r in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "tokens"])

    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(ids, "id", "left_semi")
    return texts.mapInArrow(run, "id long, tokens binary").dropDuplicates(["id"])


def subset_keys(n: int, boundary: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(partner size, subset size) for which a set of size n enumerates its subsets."""
    return [(m, need(n, m, percent)) for m in range(1, boundary + 1) if need(n, m, percent) <= min(n, m)]


def choose_boundary(histogram: dict[int, int], list_length: float, percent: int = PERCENT, most: int = MOST_SMALL) -> int:
    """The size up to which enumerating subsets costs least: a key costs 1, a scanned list its mean length."""

    def cost(x: int) -> float:
        keys = sum(c * sum(math.comb(n, s) for _, s in subset_keys(n, x, percent)) for n, c in histogram.items() if n <= x)
        return keys + sum(c * prefix_size(n, percent) * (1 + list_length) for n, c in histogram.items() if n > x)

    return min(range(most + 1), key=cost)


def small_links(reps: DataFrame, boundary: int, percent: int = PERCENT) -> DataFrame:
    """Links a, b between small sets: for each common subset key, a star to the least id of the partner size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            ids, side, h1, h2 = [], [], [], []
            for doc, kept in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(kept)
                t = np.array(kept, dtype=np.int64).view(_U)
                a, b = splitmix(t ^ _MIX[3]), splitmix(t ^ _MIX[4])
                for m, size in subset_keys(n, boundary, percent):
                    pick = chosen.setdefault((n, size), np.array(list(itertools.combinations(range(n), size))))
                    tag = np.array([min(n, m) * 64 + max(n, m)], dtype=_U) * _MIX[5]
                    x, y = splitmix(a[pick].sum(axis=1, dtype=_U) + tag), splitmix(b[pick].sum(axis=1, dtype=_U) + tag)
                    ids.append(np.full(len(pick), doc))
                    side.append(np.full(len(pick), 0 if n == m else 1 if n < m else 2, dtype=np.int8))
                    h1.append(x.view(np.int64))
                    h2.append(y.view(np.int64))
            cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([pa.array(cat(h1, np.int64)), pa.array(cat(h2, np.int64)), pa.array(cat(side, np.int8)), pa.array(cat(ids, np.int64))], names=["h1", "h2", "side", "id"])

    keys = reps.where((F.col("n") >= 1) & (F.col("n") <= boundary)).select("id", "kept").mapInArrow(run, "h1 long, h2 long, side byte, id long")
    least = keys.groupBy("h1", "h2").agg(*[F.min(F.when(F.col("side") == i, F.col("id"))).alias(f"m{i}") for i in range(3)], F.count(F.lit(1)).alias("c")).where("c > 1")
    other = F.when(F.col("side") == 0, F.col("m0")).when(F.col("side") == 1, F.col("m2")).otherwise(F.col("m1"))
    return keys.join(least, ["h1", "h2"]).select(F.col("id").alias("a"), other.alias("b")).where("b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sketch_filter(pairs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs a, b whose sketches leave a link possible, with their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=_U).reshape(len(na), -1) for i in (4, 5))
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) if len(na) else np.zeros(0, np.int64)
            common = -(-percent * (na.astype(np.int64) + nb) // (100 + percent))
            keep = pa.array(differ <= na + nb - 2 * common)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(4)], names=["a", "b", "na", "nb"])

    s = reps.select("id", "n", "sketch")
    left = pairs.join(s.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    both = left.join(s.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    return both.where(sizes_allow(F.col("na"), F.col("nb"), percent)).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, na int, nb int")


def sizes_allow(a: Column, b: Column, percent: int = PERCENT) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def verify(pairs: DataFrame, tokens: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs that are links, by the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), dtype=_U), np.frombuffer(y.as_buffer(), dtype=_U)
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                common = int((t[np.minimum(at, len(t) - 1)] == s).sum()) if len(t) else 0
                keep.append(100 * common >= percent * (len(s) + len(t) - common) and common > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    left = pairs.select("a", "b").join(tokens.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a")
    return left.join(tokens.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def _cross(members: DataFrame, percent: int, pick: str) -> DataFrame:
    """Pairs of a heavy list, one of them out of light shingles, of different components, that size and sketch allow;
    pick is "all" or, for one pair of each such set only, "hub" (the partner of least id) or "closest" (by sketch).

    members: t, id, n, sketch, heavy, component.  Of each list, the heavy of its largest component (part 0) meet the light
    of the others, as they are one component among themselves, and the heavy of the others (part 1) meet all.  Each
    side is dealt into blocks; a task sees one block of each.
    """
    own = members.groupBy("t", "component").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("heavy").cast("long")).alias("h"))
    size = own.groupBy("t").agg(F.max(F.struct("c", "component", "h")).alias("top"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("c"), F.sum("h").alias("h")).where("k > 1 AND h > 0")
    h0, h1, m1 = F.col("top.h"), F.col("h") - F.col("top.h"), F.col("c")
    m0 = F.col("c") - F.col("top.c") - h1
    many = lambda rows, block: F.ceil(rows / block).cast("int")
    size = size.select("t", F.col("top.component").alias("main"), *[F.when((h > 0) & (m > 0), F.struct(many(h, BLOCK_H).alias("bh"), many(m, BLOCK_M).alias("bm"))).alias(f"part{i}") for i, (h, m) in enumerate(((h0, m0), (h1, m1)))])
    open_ = members.join(size.where("part0 IS NOT NULL OR part1 IS NOT NULL"), "t").withColumn("rest", F.col("component") != F.col("main"))
    blocks_of = F.when(F.col("part") == 0, F.col("part0")).otherwise(F.col("part1"))
    h = open_.where("heavy").withColumn("part", F.col("rest").cast("int")).withColumn("b", blocks_of).where("b IS NOT NULL")
    h = h.withColumn("h", F.pmod(F.xxhash64("id"), F.col("b.bh")).cast("int")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("b.bm") - 1)))
    m = open_.withColumn("part", F.explode(F.when(F.col("rest") & ~F.col("heavy"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))).withColumn("b", blocks_of).where("b IS NOT NULL")
    m = m.withColumn("m", F.pmod(F.xxhash64("id", F.lit(1)), F.col("b.bm")).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.col("b.bh") - 1)))
    columns = ["t", "part", "h", "m", "id", "n", "sketch", "component"]

    def run(_key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        if len(left) and len(right):
            rid, rn, rc = (right[f"m_{c}"].to_numpy() for c in ("id", "n", "component"))
            rs = np.frombuffer(b"".join(right["m_sketch"]), dtype=_U).reshape(len(right), -1)
            for i, n, c, s in zip(left["id"], left["n"], left["component"], left["sketch"], strict=True):
                at = np.flatnonzero((rc != c) & (np.minimum(rn, n) * 100 >= np.maximum(rn, n) * percent))
                common = -(-percent * (rn[at] + n) // (100 + percent))
                differ = np.bitwise_count(rs[at] ^ np.frombuffer(s, dtype=_U)).sum(axis=1, dtype=np.int64)
                keep = differ <= rn[at] + n - 2 * common
                at, differ = at[keep], differ[keep]
                if pick != "all" and len(at) > 1:
                    at = at[np.lexsort((rid[at], differ if pick == "closest" else rid[at]))[:1]]
                out_a.append(np.minimum(rid[at], i))
                out_b.append(np.maximum(rid[at], i))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pd.DataFrame({"a": cat(out_a), "b": cat(out_b)})

    return h.select(columns).groupBy("t", "part", "h", "m").cogroup(m.select(*[F.col(c).alias(f"m_{c}") for c in columns]).groupBy("m_t", "m_part", "m_h", "m_m")).applyInPandas(run, "a long, b long").distinct()


def join_components(docs: DataFrame, percent: int = PERCENT, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id and links-bearing class of each row (columns n_shingles, class_id, component_id).

    Null and empty texts, and texts of white space, have no shingle, no link, and themselves as component.  Rows of
    equal sets are a class, named by its least doc_id.  A row without doc_id gets its class's component, but, as it
    can't be named in a link, joins nothing; alone, its component is null.  Rows that share a doc_id are one document as
    links go.  An empty table gives no rows; extra columns are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    rows = scratch.write(sets(docs, percent, k), "sets")
    classes = scratch.write(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("id")), "classes")
    ids = scratch.write(rows.select("doc_id", "n", "k1", "k2"), "rows")
    mark = rows.where("n > 0").join(classes, (rows.k1 == classes.k1) & (rows.k2 == classes.k2) & (rows.n == classes.n) & (rows.doc_id == classes.id))
    reps = scratch.write(mark.select(rows.k1, rows.k2, "id", rows.n, "p", "kept", "sketch").dropDuplicates(["k1", "k2", "n"]).drop("k1", "k2"), "reps")
    scratch.drop("sets")

    counts = scratch.write(reps.select(F.explode("kept").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("len")).where("len > 1"), "lists")
    shared = reps.select("id", "n", "p", F.size("kept").alias("size"), F.posexplode("kept").alias("i", "t")).join(counts, "t")
    own = Window.partitionBy("id")
    long = F.col("len") > LIST
    shared = shared.withColumn("long", long).withColumn("heavy", F.col("size") - F.sum(F.col("long").cast("int")).over(own) < F.col("p")).withColumn("place", F.col("i") - F.coalesce(F.sum(F.col("long").cast("int")).over(own.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    postings = scratch.write(shared.where("(long AND i < p) OR (NOT long AND (heavy OR place < p))").select("t", "id", "n", "place", "long", "heavy"), "postings")

    # What later steps need of a set: its size and sketch, and of a small one its shingles.
    brief = scratch.write(reps.select("id", "n", "sketch", F.when(F.col("n") <= MOST_SMALL, F.col("kept")).alias("kept")), "brief")
    scratch.drop("reps")
    reps = brief

    histogram = {r.n: r["count"] for r in reps.where(F.col("n") <= MOST_SMALL).groupBy("n").count().collect()}
    mean = counts.where(F.col("len") <= LIST).agg(F.sum(F.col("len") * F.col("len")) / F.sum("len")).first()[0] or 1.0
    boundary = choose_boundary(histogram, mean, percent)

    light = postings.where("NOT long").select("t", "id", "n", "place")
    x, y = (light.select("t", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "place")]) for s in "xy")
    met = x.join(y, "t").where(F.col("id_x") < F.col("id_y")).where(sizes_allow(F.col("n_x"), F.col("n_y"), percent)).where(F.greatest("n_x", "n_y") > boundary)
    met = met.groupBy(F.col("id_x").alias("a"), F.col("id_y").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.max("place_x").alias("ix"), F.max("place_y").alias("iy"), F.first("n_x").alias("n_x"), F.first("n_y").alias("n_y"))
    met = met.where(F.col("c") + F.least(F.col("n_x") - F.col("ix") - 1, F.col("n_y") - F.col("iy") - 1) >= needed(F.col("n_x"), F.col("n_y"), percent))
    candidates = scratch.write(sketch_filter(met.select("a", "b"), reps, percent), "light")

    lists = postings.where("long")
    lists = scratch.write(lists.join(lists.where("heavy").select("t").distinct(), "t", "left_semi").select("t", "id", "heavy"), "heavy")
    lead = lists.where("heavy").groupBy("t").agg(F.array_distinct(F.array(*[F.min_by("id", F.xxhash64("id", F.lit(r))) for r in range(LEADERS)])).alias("leads"))
    led = lists.join(lead, "t").select("id", F.explode("leads").alias("lead")).where("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
    starred = scratch.write(sketch_filter(led, reps, percent), "stars")

    first = candidates.select("a", "b").unionByName(starred.select("a", "b")).distinct()
    tokens = scratch.write(whole_sets(docs, scratch.write(_ends(first), "ends"), k), "whole")
    links = scratch.write(verify(first, tokens, percent).unionByName(small_links(reps, boundary, percent)), "links")
    groups = components(links, scratch, "groups")

    # What is left between different groups: first a pair for each set, which draws the groups together, then all.
    scratch.drop("whole")
    for step in ("hub", "closest", "all"):
        named = lists.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        found = scratch.write(_cross(named.join(reps.select("id", "n", "sketch"), "id"), percent, step), f"found-{step}")
        if found.isEmpty():
            break
        # Picks that were all compared before say nothing of the other pairs: the next step looks on.
        left = scratch.write(found.join(first, ["a", "b"], "left_anti"), step)
        scratch.drop(f"found-{step}")
        if left.isEmpty():
            continue
        first = first.unionByName(left)
        tokens = scratch.write(whole_sets(docs, scratch.write(_ends(left), f"ends-{step}"), k), f"whole-{step}")
        more = scratch.write(verify(left, tokens, percent), f"more-{step}")
        scratch.drop(f"whole-{step}")
        if not more.isEmpty():
            groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), scratch, f"groups-{step}")
    joined = scratch.write(classes.join(groups, classes.id == groups.node, "left").select("k1", "k2", "n", "id", F.coalesce("component", "id").alias("component_id")), "result")
    scratch.drop("brief", "postings")
    out = ids.join(joined, ["k1", "k2", "n"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, class and component of every document."""
    return join_components(table(spark, sf_dir, "documents"))
