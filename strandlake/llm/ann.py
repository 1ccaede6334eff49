"""Approximate nearest neighbours by cross-polytope hashing.

A vector, scaled to length one, goes through three rounds of random signs and a fast Hadamard transform
(a pseudo-rotation); its hash is the nearest signed axis.  Each table concatenates `k` such hashes.  A query probes
its best buckets in every table (multiprobe); the distinct candidates of all tables are then reranked by their exact
distance in double precision.

How many hashes and probes are needed depends on how near the neighbours are, so both are measured: a bounded sample of
rows is searched exhaustively (one pass over the table), and of the settings that find `target` of the sample's true
neighbours that of least expected work is taken.  Equal vectors are one entry of the index, with their least ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm._spark import Scratch, table

TABLES = 40
#: Share of the sample's true neighbours that the chosen number of probes must find.
TARGET = 0.96
#: Rows that are searched exhaustively to choose hashes and probes, and rows that the work is estimated on.
SAMPLE_QUERIES, SAMPLE_ROWS = 128, 4096
#: Numbers that the sample's rows may have together: the driver holds them.
SAMPLE_NUMBERS = 1 << 20
#: Hashes a table may have, and for each number the best axes of a hash that probes combine (None: all).
AXES = {1: None, 2: 64, 3: 24}
#: Work of a probed bucket, in candidates.
PROBE_WORK = 0.1
#: Vectors of a block that candidates are reranked in, and entries of a bucket's block.
BLOCK = 2048
#: Blocks whose candidates of one query are made distinct together: at most so many blocks' entries in one list.
HOMES = 4096
#: Queries that meet a block at a time.
QUERY_BLOCK = 4096
TOP = 10


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    x = x.copy()
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        a, b = y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]
        y[:, :, 0], y[:, :, 1] = a, b
        h *= 2
    return x / math.sqrt(d)


def rotations(x: np.ndarray, tables: int, k: int, seed: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Table and, for each of its k hashes, how near the rows are to each signed axis.  Rows are padded with zeros to a
    power of two."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    # The largest part goes first, so that very large and very small numbers neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    signs = rng.integers(0, 2, (tables, k, 3, d)) * 2.0 - 1
    for t in range(tables):
        near = []
        for j in range(k):
            y = x
            for r in range(3):
                y = hadamard(y * signs[t, j, r])
            near.append(np.concatenate([y, -y], axis=1))
        yield t, near


def buckets(x: np.ndarray, tables: int, k: int, seed: int) -> np.ndarray:
    """Bucket of each row in each table: rows x tables."""
    out = np.zeros((len(x), tables), dtype=np.int64)
    for t, near in rotations(x, tables, k, seed):
        for s in near:
            out[:, t] = out[:, t] * s.shape[1] + s.argmax(axis=1)
    return out


def ranked_buckets(near: list[np.ndarray], axes: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and scores of the combinations of each hash's best axes, unordered: rows x combinations."""
    n = len(near[0])
    code, score = np.zeros((n, 1), dtype=np.int64), np.zeros((n, 1))
    for s in near:
        m = min(axes or s.shape[1], s.shape[1])
        best = np.argsort(-s, axis=1, kind="stable")[:, :m]
        score = (score[:, :, None] + np.take_along_axis(s, best, 1)[:, None, :]).reshape(n, -1)
        code = (code[:, :, None] * s.shape[1] + best[:, None, :]).reshape(n, -1)
    return code, score


def probes(x: np.ndarray, tables: int, k: int, seed: int, n_probes: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each table, the buckets of best score that each row probes: rows x probes."""
    for t, near in rotations(x, tables, k, seed):
        code, score = ranked_buckets(near, AXES[k])
        if n_probes < code.shape[1]:
            code = np.take_along_axis(code, np.argpartition(-score, n_probes - 1, axis=1)[:, :n_probes], 1)
        yield t, code


def slices(b: pa.RecordBatch, size: int = 64) -> Iterator[pa.RecordBatch]:
    """Few queries at a time, as each has all combinations of its best axes."""
    for i in range(0, b.num_rows, size):
        yield b.slice(i, size)


@dataclass
class Setting:
    hashes: int
    probes: int
    #: Of the sample's true neighbours, and expected candidates a query (repeats between tables counted).
    recall: float
    candidates: float


def measure(queries: np.ndarray, owner: np.ndarray, neighbours: np.ndarray, rows: np.ndarray, n: int, k: int, tables: int, seed: int, target: float) -> Setting:
    """The least probes with k hashes that find `target` of the neighbours, or all there are if that takes more
    (neighbours[i] is one of queries[owner[i]])."""
    if not len(neighbours):
        return Setting(k, 1, 1.0, float(n))
    first = np.full(len(neighbours), np.iinfo(np.int64).max)
    # A table at a time, twice, so that the scores of all tables are never held together.
    for (_, near), (_, theirs) in zip(rotations(queries, tables, k, seed), rotations(neighbours, tables, k, seed), strict=True):
        ordered = np.sort(-ranked_buckets(near, AXES[k])[1], axis=1)
        value, inside = np.zeros(len(neighbours)), np.ones(len(neighbours), dtype=bool)
        for s, y in zip(near, theirs, strict=True):
            v = s[owner, y.argmax(axis=1)]
            inside &= v >= -np.sort(-s, axis=1)[owner, min(AXES[k] or s.shape[1], s.shape[1]) - 1]
            value += v
        rank = np.array([np.searchsorted(ordered[q], -v - 1e-12) for q, v in zip(owner, value, strict=True)])
        first[inside] = np.minimum(first[inside], rank[inside])
    p = int(min(np.sort(first)[max(0, math.ceil(target * len(first)) - 1)], ordered.shape[1] - 1)) + 1
    share = 0.0
    for (_, near), (_, every) in zip(rotations(queries, tables, k, seed), rotations(rows, tables, k, seed), strict=True):
        least = -np.partition(-ranked_buckets(near, AXES[k])[1], p - 1, axis=1)[:, p - 1 : p]
        reached = sum(s[:, z.argmax(axis=1)] for s, z in zip(near, every, strict=True))
        share += float((reached >= least - 1e-12).mean())
    return Setting(k, p, float((first < p).mean()), share * n)


def usable(vector: Column) -> Column:
    """Not null, with a component, every component a finite number, and not zero throughout."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda c: c != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def least_hashes(entries: DataFrame, n: int, rows: int, seed: int) -> DataFrame:
    """Some twice as many of the n entries as rows, among them the rows of least hash: so tasks don't send rows each."""
    if n <= 2 * rows:
        return entries
    return entries.where(F.xxhash64("entry", F.lit(seed)) < -(1 << 63) + (rows << 65) // n)


def choose(entries: DataFrame, n: int, dims: int, tables: int, seed: int, target: float, top: int, hashes: int | None = None) -> Setting:
    """Hashes and probes for the n entries (entry, v) of dims numbers, measured on a bounded sample of them."""
    most = max(SAMPLE_QUERIES, min(SAMPLE_ROWS, SAMPLE_NUMBERS // dims))
    picked = least_hashes(entries.select("entry", "v"), n, most, seed).orderBy(F.xxhash64("entry", F.lit(seed)), "entry").limit(most).toArrow()
    rows = _matrix(picked.column("v").combine_chunks())
    ids, queries = picked.column("entry").to_numpy()[:SAMPLE_QUERIES], rows[:SAMPLE_QUERIES]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros((0, queries.shape[1])))] * len(queries)
        for b in batches:
            x, own = _matrix(b.column(1)), b.column(0).to_numpy()
            for i in range(len(queries) if len(x) else 0):
                d, other = distances(x, queries[i]), own != ids[i]
                d = np.concatenate([best[i][0], d[other]])
                v = np.concatenate([best[i][1], x[other]])
                near = np.argsort(d, kind="stable")[:top]
                best[i] = (d[near], v[near])
        owner = np.repeat(np.arange(len(queries)), [len(d) for d, _ in best])
        yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate([d for d, _ in best])), pa.array([row for _, v in best for row in v.tolist()], pa.list_(pa.float64()))], names=["q", "d", "v"])

    found = entries.select("entry", "v").mapInArrow(scan, "q long, d double, v array<double>")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d"))).where(F.col("r") <= top).toArrow()
    owner, neighbours = found.column("q").to_numpy(), _matrix(found.column("v").combine_chunks())
    settings = [measure(queries, owner, neighbours, rows, n, k, tables, seed, target) for k in ([hashes] if hashes else AXES)]
    return min(settings, key=lambda s: (s.recall < target, s.candidates + PROBE_WORK * tables * s.probes))


def bucket_lists(indexed: DataFrame, block: int) -> DataFrame:
    """t, bucket, part and entries of each bucket of the index (entry, t, bucket), a large one in several parts."""
    # The driver gets the large buckets at most, a few for each block of the index: all of them may be as many as its rows.
    large = indexed.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("entry"), F.coalesce("parts", F.lit(1))).cast("int")
    return indexed.join(large, ["t", "bucket"], "left").groupBy("t", "bucket", part.alias("part")).agg(F.collect_list("entry").alias("entries"))


def probed_lists(probed: DataFrame, listed: DataFrame) -> DataFrame:
    """query and entries of each list that a probe (query, t, bucket) meets."""
    # Spark takes the probes to be as large as the queries that they are made of, and would send all to the driver.
    return probed.hint("merge").join(listed, ["t", "bucket"]).select("query", "entries")


def search(vectors: DataFrame, queries: Column, top: int = TOP, tables: int = TABLES, target: float = TARGET, block: int = BLOCK, seed: int = 29, hashes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of each query's nearest rows found.

    vectors: vec_id and embedding.  Rows that aren't `usable`, lack a vec_id, or have another length than most usable
    rows (of equally common lengths, the least counts) take no part; extra columns are left out.  Rows of one vec_id
    count once, that of the smallest vector.  Ties go to the smaller vec_id.  A query that finds fewer than `top` rows in
    its buckets is searched against all rows, in blocks, so it lacks neighbours only if the table does.  An empty table
    gives no rows.  hashes fixes the hashes of a table instead of choosing them.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    usual = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dims").first()
    rows = scratch.write(rows.where(F.size("v") == (usual.dims if usual else 0)).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    # Of equal vectors only the least ids can be among the nearest: one more than asked for, as a query may be among them.
    same = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= top + 1)
    entries = scratch.write(members.groupBy("v").agg(F.min("vec_id").alias("entry"), F.array_sort(F.collect_list("vec_id")).alias("ids")).select("entry", "v", "ids"), "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    setting = choose(entries, n, usual.dims, tables, seed, target, top, hashes)
    asked = rows.where(queries).join(entries.select("v", "entry"), "v").select(F.col("vec_id").alias("query_id"), "entry")
    asked = scratch.write(asked, "asked")
    wanted = entries.join(asked.select("entry").distinct(), "entry", "left_semi").select(F.col("entry").alias("query"), F.col("v").alias("qv"))
    wanted = scratch.write(wanted, "wanted")
    k, n_probes = setting.hashes, setting.probes

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            code = buckets(x, tables, k, seed) if len(x) else np.zeros((0, tables), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(x))), pa.array(code.ravel())], names=["entry", "t", "bucket"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            x = _matrix(b.column(1))
            for t, code in probes(x, tables, k, seed, n_probes) if len(x) else ():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), code.shape[1])), pa.array(np.full(code.size, t, dtype=np.int32)), pa.array(code.ravel())], names=["query", "t", "bucket"])

    indexed = scratch.write(entries.select("entry", "v").mapInArrow(index, "entry long, t int, bucket long"), "index")
    # A bucket is a list of its entries, a large one several; a probe gets whole lists.
    listed = bucket_lists(indexed, block)
    probed = wanted.mapInArrow(probe, "query long, t int, bucket long")
    homes = max(1, -(-n // block))
    # The distinct candidates of a query and a share of all blocks of vectors, however often probes met them, ...
    shares = max(1, -(-homes // HOMES))
    of_share = lambda x, i: F.pmod(F.xxhash64(x, F.lit(1)), F.lit(shares)) == i
    met = probed_lists(probed, listed)
    if shares > 1:
        met = met.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("entries", F.filter("entries", lambda x: of_share(x, F.col("share")))).where(F.size("entries") > 0)
    else:
        met = met.withColumn("share", F.lit(0))
    once = met.groupBy("query", "share").agg(F.array_distinct(F.flatten(F.collect_list("entries"))).alias("entries"))
    # ... listed by the block that they stand in.
    home = F.pmod(F.xxhash64("entry"), F.lit(homes)).cast("int")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in slices(whole)):
            found = b.column(1)
            owner = np.repeat(b.column(0).to_numpy(), found.value_lengths().to_numpy())
            values, at = found.flatten().to_numpy(), b.column(2).flatten().to_numpy()
            order = np.lexsort((values, at, owner))
            owner, values, at = owner[order], values[order], at[order]
            first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1]))) if len(owner) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array(owner[first]), pa.array(at[first].astype(np.int32)), lists], names=["query", "home", "entries"])

    at_home = F.transform("entries", lambda x: F.pmod(F.xxhash64(x), F.lit(homes)).cast("int"))
    lists = scratch.write(once.select("query", "entries", at_home.alias("homes")).mapInArrow(deal, "query long, home int, entries array<long>"), "lists")
    scratch.drop("index")
    placed_rows = entries.select("entry", "v", "ids", home.alias("home"))
    best = scratch.write(_nearest(placed_rows, lists.join(wanted, "query"), top), "best")
    reached = best.groupBy("query").agg(F.sum(F.size("ids")).alias("n"))
    short = scratch.write(wanted.join(reached.where(F.col("n") > top), "query", "left_anti"), "short")
    if not short.isEmpty():
        every = F.sequence(F.lit(0), F.lit(homes - 1))
        again = _nearest(placed_rows, short.withColumn("entries", F.lit(None).cast("array<long>")).withColumn("home", F.explode(every)), top)
        best = scratch.write(best.join(short.select("query"), "query", "left_anti").unionByName(again), "whole")
    out = asked.join(best.select(F.col("query").alias("entry"), "score", F.explode("ids").alias("vec_id")), "entry").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return out.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _nearest(rows: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """query, entry, ids and score of the nearest top + 1 entries of each query (query, qv, home, entries), of those that
    it lists of each block, or of all if it lists none."""
    parts = queries.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
    left = rows.join(parts, "home").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = queries.join(parts, "home").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int")).drop("parts")

    def pick(_key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("entry")
            own, x = left["entry"].to_numpy(), np.stack(left["v"].to_numpy())
            for query, q, listed in zip(right["query"], right["qv"], right["entries"], strict=True):
                at = np.arange(len(own)) if listed is None else np.searchsorted(own, np.sort(listed))
                d = distances(x[at], q)
                if len(d) > top + 1:
                    near = np.flatnonzero(d <= np.partition(d, top)[top])
                    at, d = at[near], d[near]
                first = np.lexsort((own[at], d))[: top + 1]
                out.append((np.full(len(first), query), at[first], d[first]))
        if not out:
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "entry": pd.Series(dtype="int64"), "ids": pd.Series(dtype="object"), "score": pd.Series(dtype="float64")})
        query, at, d = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"query": query, "entry": own[at], "ids": left["ids"].to_numpy()[at], "score": d})

    found = left.groupBy("home", "part").cogroup(right.groupBy("home", "part")).applyInPandas(pick, "query long, entry long, ids array<long>, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "entry"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top + 1).drop("rank")


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found of every embedding whose vec_id is divisible by 100."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
