"""Minimizers: the least k-mer of every run of w neighbours, by spelling or by hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from strandlake.functions.sequence import bind, canonical, normalise, pin
from strandlake.functions.windows import LETTERS, least_of_runs, pieces, points, ranks, window_codes
from strandlake.operators.kmers import check_k, windows


def string_hash(c: Column) -> Column:
    """Absolute value of the 32-bit string hash with multiplier 31."""
    wrapped = lambda x: ((x + 2147483648).bitwiseAND(F.lit(4294967295))) - 2147483648
    return F.abs(F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("long"), lambda h, x: wrapped(h * 31 + F.ascii(x))))


#: Windows that are looked at together; a long sequence is dealt into pieces of so many.
PIECE = 2048


def _pieces(s: Column, k: int, w: int) -> Column:
    """Where each piece begins, and its letters.  All but the first begin a window early, to know where the run before ends."""
    span = k + w - 1
    begin = lambda j: F.greatest(j - 1, F.lit(0))
    cut = lambda t: F.transform(F.sequence(F.lit(0), F.length(t) - span, F.lit(PIECE)), lambda j: F.struct(begin(j).alias("at"), F.substr(t, begin(j) + 1, j + PIECE + span - 1 - begin(j)).alias("t")))
    return bind(s, lambda t: F.when(F.length(t) >= span, cut(t)))


def _places(values: Column, w: int) -> Column:
    """Places of the least values of all runs of w; values are (value, place)."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(values) - w), lambda i: F.array_min(F.slice(values, i + 1, F.lit(w)))["i"]))


def _least_by(df: DataFrame, k: int, w: int, seq: str, canonical_: bool, keep: tuple[str, ...], value: Callable[[Column], Column]) -> DataFrame:
    """keep, pos, kmer and value by any expression, which only Spark can compute."""
    pieces = df.select(*keep, F.explode(_pieces(normalise(F.col(seq)), k, w)).alias("_p")).select(*keep, "_p.*")
    ks = windows(F.col("t"), k)
    rows = pin(pieces, "_k", F.transform(ks, canonical) if canonical_ else ks)
    rows = pin(rows, "_v", F.transform("_k", lambda x, i: F.struct(value(x).alias("v"), i.alias("i"))))
    places = _places(F.col("_v"), w)
    # Places never decrease along a sequence, so the distinct ones are the collapsed runs; the first belongs to the piece before.
    rows = rows.select(*keep, "at", "_k", "_v", F.explode(F.when(F.col("at") > 0, bind(places, lambda x: F.slice(x, 2, 1 << 30))).otherwise(places)).alias("_i"))
    return rows.select(*keep, (F.col("at") + F.col("_i")).alias("pos"), F.get("_k", "_i").alias("kmer"), F.get("_v", "_i")["v"].alias("value"))


_DNA, _RNA = str.maketrans("ATGC", "TACG"), str.maketrans("AUGC", "UACG")


def _kmers(text: str, k: int, canonical_: bool, hashed: bool) -> tuple[str, np.ndarray, np.ndarray, int]:
    """A text with all k-mers, where in it the k-mer of each window stands, and its value, by hash or spelling, and their bound."""
    m = len(text) - k + 1
    at = np.arange(m)
    if canonical_:  # both strands, the reverse one as DNA and as RNA
        n = len(text)
        before = np.append(0, np.cumsum(points(text) == ord("U")))
        back = n + (before[k:] > before[:-k]) * n + m - 1 - at
        text = text + text.translate(_DNA)[::-1] + text.translate(_RNA)[::-1]
    x = points(text)
    if canonical_ or not hashed:
        codes, bound = window_codes(*ranks(x), k)
        at = np.where(codes[back] < codes[at], back, at) if canonical_ else at
        if not hashed:
            return text, at, codes[at], bound
    h = np.zeros(len(x) - k + 1, dtype=np.uint32)
    for i in range(k):
        h = h * np.uint32(31) + x[i : i + len(h)]
    return text, at, np.abs(h.view(np.int32).astype(np.int64))[at], (1 << 31) + 1


def _found(texts: list[str | None], k: int, w: int, canonical_: bool, hashed: bool, letters: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], np.ndarray]]:
    """Rows, positions, k-mers and values of the minimizers, a piece at a time."""
    span, last = k + w - 1, (-1, -1)
    for rows, begins, parts in pieces(texts, span, letters):
        sizes = np.array([len(x) for x in parts])
        of = np.repeat(np.arange(len(parts)), sizes)
        at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole = (at + span <= sizes[of]) & (at < letters)
        text, source, values, bound = _kmers("".join(parts), k, canonical_, hashed)
        # Places never decrease along a sequence, so the distinct ones are the collapsed runs.
        place = least_of_runs(values, bound, w)
        place = place[whole[: len(place)]]
        place = place[np.append(True, place[1:] != place[:-1])]
        row, pos = np.array(rows)[of[place]], np.array(begins)[of[place]] + at[place]
        if (row[0], pos[0]) == last:  # the first may be that of the piece before
            row, pos, place = row[1:], pos[1:], place[1:]
        if len(place):
            last = row[-1], pos[-1]
            yield row, pos, [text[i : i + k] for i in source[place].tolist()], values[place]


def _least(df: DataFrame, k: int, w: int, seq: str, canonical_: bool, keep: tuple[str, ...], hash_: Callable[[Column], Column] | None) -> DataFrame:
    """keep, pos, kmer and value (null by spelling): computed within the row, whatever the other rows are."""
    check_k(k)
    check_k(w)
    if hash_ not in (None, string_hash):
        return _least_by(df, k, w, seq, canonical_, keep, hash_)
    rows, hashed, letters = df.select(*keep, normalise(F.col(seq)).alias("_s")), hash_ is string_hash, LETTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, texts = batch.columns[:-1], batch.columns[-1]
            for row, pos, kmers, values in _found(texts.to_pylist(), k, w, canonical_, hashed, letters):
                row = pa.array(row)
                value = pa.array(values) if hashed else pa.nulls(len(row), pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(row) for c in kept), pa.array(pos.astype(np.int32)), pa.array(kmers, texts.type), value], names=[*batch.schema.names[:-1], "pos", "kmer", "value"])

    return rows.mapInArrow(run, StructType(rows.schema.fields[:-1]).add("pos", IntegerType()).add("kmer", StringType()).add("value", LongType()))


def minimizers(df: DataFrame, k: int, w: int, seq: str = "sequence", canonical_: bool = False, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """keep, kmer and pos of the minimizers of each row."""
    return _least(df, k, w, seq, canonical_, keep, None).select(*keep, "kmer", "pos")


def hash_minimizers(df: DataFrame, k: int, w: int, seq: str = "sequence", canonical_: bool = False, keep: tuple[str, ...] = ("id",), hash_: Callable[[Column], Column] = string_hash) -> DataFrame:
    """keep, hash, pos and kmer; any built-in function from column to number serves as hash."""
    return _least(df, k, w, seq, canonical_, keep, hash_).select(*keep, F.col("value").alias("hash"), "pos", "kmer")


def minimizer_array(s: Column, k: int, w: int) -> Column:
    """The minimizers of a sequence in order, as an array; empty where there is no window."""
    check_k(k)
    check_k(w)
    letters = LETTERS

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        sizes, kmers = np.zeros(len(texts), dtype=np.int64), [pa.array([], pa.string())]
        for row, _, found, _ in _found(texts.to_pylist(), k, w, False, False, letters):
            sizes += np.bincount(row, minlength=len(sizes))
            kmers.append(pa.array(found, pa.string()))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.concat_arrays(kmers))

    return run(normalise(s))


def density(df: DataFrame, k: int, w: int, seq: str = "sequence", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Minimizers per k-mer of each row; null where there is no k-mer."""
    kmers = F.length(normalise(F.col(seq))) - (k - 1)
    return df.select(*keep, F.when(kmers > 0, F.size(minimizer_array(F.col(seq), k, w)) / kmers).alias("density"))


def jaccard_pairs(df: DataFrame, pairs: DataFrame, k: int, w: int, seq: str = "sequence") -> DataFrame:
    """id1, id2 and the similarity of their minimizer sets, for the given pairs; 0 where both are empty."""
    sets = df.select("id", F.array_distinct(minimizer_array(F.col(seq), k, w)).alias("s"))
    x, y = (sets.select(F.col("id").alias(f"id{i}"), F.col("s").alias(f"s{i}")) for i in (1, 2))
    none = F.array().cast("array<string>")
    joined = pairs.join(x, "id1", "left").join(y, "id2", "left").withColumn("s1", F.coalesce("s1", none)).withColumn("s2", F.coalesce("s2", none))
    union = F.size(F.array_union("s1", "s2"))
    return joined.select("id1", "id2", F.when(union > 0, F.size(F.array_intersect("s1", "s2")) / union).otherwise(0.0).alias("jaccard"))
