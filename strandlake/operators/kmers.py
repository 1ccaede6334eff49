"""K-mers, syncmers and super-k-mers as rows; counts, spectra and similarities as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequence import bind, canonical, normalise, pin, strict

PRIME = 2147483647


def check_k(k: int, least: int = 1) -> None:
    if not isinstance(k, int) or isinstance(k, bool) or k < least:
        raise ValueError(f"k must be an integer of at least {least}")


#: Windows are cut from blocks of this many, as reaching into a long string takes time in proportion to the place.
BLOCK = 256


def windows(s: Column, k: int) -> Column:
    """All substrings of length k, in order; none where k is longer than the string."""
    empty = F.array().cast("array<string>")
    cut = lambda b: F.transform(F.sequence(F.lit(1), F.length(b) - (k - 1)), lambda i: F.substr(b, i, F.lit(k)))
    blocks = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (k - 1), F.lit(BLOCK)), lambda j: F.substr(t, j, F.lit(BLOCK + k - 1)))
    return bind(s, lambda t: F.when(F.length(t) >= k, F.flatten(F.transform(blocks(t), cut))).otherwise(empty))


def kmer_rows(df: DataFrame, k: int, seq: str = "sequence", canonical_: bool = False, strict_: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, pos and kmer of every window, of the trimmed, upper-case sequence."""
    check_k(k)
    s = normalise(F.col(seq))
    s = strict(s) if strict_ else s
    out = df.select(*keep, F.posexplode(windows(s, k)).alias("pos", "kmer"))
    return out.withColumn("kmer", canonical(F.col("kmer"))) if canonical_ else out


def count_kmers(df: DataFrame, k: int, seq: str = "sequence", canonical_: bool = False) -> DataFrame:
    return kmer_rows(df, k, seq, canonical_).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def spectrum(df: DataFrame, k: int, seq: str = "sequence", canonical_: bool = False) -> DataFrame:
    """How many k-mers there are of each multiplicity."""
    return count_kmers(df, k, seq, canonical_).groupBy(F.col("n").alias("multiplicity")).agg(F.count(F.lit(1)).alias("kmers"))


def unique_kmers(df: DataFrame, k: int, seq: str = "sequence", canonical_: bool = False) -> DataFrame:
    return count_kmers(df, k, seq, canonical_).where("n = 1").select("kmer")


def jaccard(a: Column, b: Column, k: int, canonical_: bool = False) -> Column:
    """Similarity of two sequences' k-mer sets; 0 where both are empty."""
    check_k(k)
    sets = [windows(normalise(c), k) for c in (a, b)]
    x, y = (F.array_distinct(F.transform(s, canonical)) if canonical_ else F.array_distinct(s) for s in sets)
    both = lambda p: F.size(F.array_union(p["x"], p["y"]))
    return bind(F.struct(x.alias("x"), y.alias("y")), lambda p: F.when(both(p) > 0, F.size(F.array_intersect(p["x"], p["y"])) / both(p)).otherwise(0.0))


def base_code(c: Column) -> Column:
    """A 0, C 1, G 2, T and U 3, all else 0."""
    return F.when(c == "C", 1).when(c == "G", 2).when(c.isin("T", "U"), 3).otherwise(0).cast("long")


def polynomial_hash(kmer: Column) -> Column:
    return F.aggregate(F.filter(F.split(kmer, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: (h * 4 + base_code(c)) % PRIME)


def rolling_hashes(df: DataFrame, k: int, seq: str = "sequence", canonical_: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each k-mer of a row with its hash; a canonical k-mer has the hash of its last forward occurrence."""
    rows = kmer_rows(df, k, seq, False, keep=keep)
    key = canonical(F.col("kmer")) if canonical_ else F.col("kmer")
    last = rows.groupBy(*keep, key.alias("key")).agg(F.max_by("kmer", "pos").alias("forward"))
    return last.select(*keep, F.col("key").alias("kmer"), polynomial_hash(F.col("forward")).alias("hash"))


def super_kmers(df: DataFrame, k: int, seq: str = "sequence", canonical_: bool = False, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Maximal runs of k-mers of which each begins as the one before ends, joined; part numbers them within the row.

    A run begins with its first k-mer as read and goes on with the last letters of the (canonical) ones after it.
    """
    check_k(k)
    rows = pin(df.select(*keep, normalise(F.col(seq)).alias("_s")), "_k", windows(F.col("_s"), k))
    rows = pin(rows, "_c", F.transform("_k", canonical)) if canonical_ else rows.withColumn("_c", F.col("_k"))
    apart = lambda i: F.substr(F.get("_c", i - 1), F.lit(2), F.lit(k - 1)) != F.substr(F.get("_c", i), F.lit(1), F.lit(k - 1))
    heads = F.filter(F.sequence(F.lit(0), F.size("_c") - 1), lambda i: (i == 0) | apart(i))
    rows = pin(rows.where(F.size("_k") > 0), "_h", heads)
    tail = lambda h, p: F.slice("_c", h + 2, F.coalesce(F.get("_h", p + 1), F.size("_c")) - h - 1)
    joined = F.transform("_h", lambda h, p: F.concat(F.get("_k", h), F.array_join(F.transform(tail(h, p), lambda x: F.right(x, F.lit(1))), "")))
    return rows.select(*keep, F.posexplode(joined).alias("part", "super_kmer")).withColumn("part", F.col("part").cast("long"))


def syncmers(df: DataFrame, k: int, s: int, seq: str = "sequence", canonical_: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Closed syncmers: k-mers whose least s-mer stands first or last."""
    check_k(k)
    if not 1 <= s < k:
        raise ValueError("s must be at least 1 and less than k")
    rows = kmer_rows(df, k, seq, canonical_, keep=keep)
    return rows.where(bind(windows(F.col("kmer"), s), lambda p: (F.element_at(p, 1) == F.array_min(p)) | (F.element_at(p, -1) == F.array_min(p))))
