"""Sequence statistics in one aggregate; order statistics and N50 from the histogram of lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import quality as Q
from strandlake.functions.sequence import count_of


def length_filter(df: DataFrame, least: int = 0, most: int | None = None, seq: str = "sequence") -> DataFrame:
    n = F.length(seq)
    return df.where(n >= least if most is None else n.between(least, most))


def quality_filter(df: DataFrame, mean: float, encoding: int = 33, quality: str = "quality") -> DataFrame:
    """Rows of at least that mean quality; rows without a quality pass."""
    return df.where(F.coalesce(Q.mean(F.col(quality), encoding) >= mean, F.lit(True)))


def length_histogram(df: DataFrame, seq: str = "sequence") -> DataFrame:
    return df.groupBy(F.length(seq).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def from_histogram(hist: DataFrame) -> DataFrame:
    """median_length, n50 and l50 from (length, n).

    The median is the order statistic of rank max(1, floor(count / 2)); n50 is the length at which the longest
    sequences reach half the bases, l50 how many of them that takes.  All are 0 of nothing.  The windows see a row
    for each distinct length only.
    """
    up = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    h = hist.select("length", "n", F.sum("n").over(up).alias("rank"), F.sum("n").over(down).alias("top"), F.sum(F.col("n") * F.col("length")).over(down).alias("bases"), F.sum("n").over(everything).alias("count"), F.sum(F.col("n") * F.col("length")).over(everything).alias("total"))
    mid = F.greatest(F.lit(1), F.floor(F.col("count") / 2))
    half = F.col("total") / 2
    reached = F.col("bases") >= half
    l50 = F.col("top") - F.col("n") + F.greatest(F.lit(1), F.ceil((half - (F.col("bases") - F.col("length") * F.col("n"))) / F.col("length")))
    return h.agg(
        F.coalesce(F.min(F.when(F.col("rank") >= mid, F.col("length"))), F.lit(0)).cast("long").alias("median_length"),
        F.coalesce(F.max(F.when(reached & (F.col("total") > 0), F.col("length"))), F.lit(0)).cast("long").alias("n50"),
        F.coalesce(F.min(F.when(reached & (F.col("length") > 0), l50)), F.lit(0)).cast("long").alias("l50"),
    )


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def sequence_stats(df: DataFrame, seq: str = "sequence", quality: str | None = None, encoding: int = 33) -> DataFrame:
    """One row of statistics.  Quality figures are per base over rows with a quality, null without any."""
    s = F.upper(F.col(seq))
    n = F.length(s)
    aggs = [
        F.count(F.lit(1)).alias("total_sequences"), F.coalesce(F.sum(n), F.lit(0)).alias("total_bases"),
        *[F.coalesce(F.sum(count_of(s, x)), F.lit(0)).alias(k) for k, x in (("_gc", "GC"), ("_at", "ATU"), ("_n", "N"), ("ambiguous_bases", "RYKMSWBDHV"))],
        F.coalesce(F.min(n), F.lit(0)).alias("min_length"), F.coalesce(F.max(n), F.lit(0)).alias("max_length"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_length"), F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias("std_dev_length"),
    ]
    if quality:
        q = F.col(quality)
        scores = Q.decode(q, encoding)
        aggs += [F.sum(F.length(q)).alias("_q"), F.sum(Q.total(q, encoding)).alias("_sum"), F.min(F.array_min(scores)).alias("min_quality"), F.greatest(F.lit(0), F.max(F.array_max(scores))).alias("max_quality"), F.sum(Q.at_least(q, 20, encoding)).alias("_q20"), F.sum(Q.at_least(q, 30, encoding)).alias("_q30")]
    one = df.agg(*aggs)
    bases = F.col("total_bases")
    out = one.withColumns({"gc_content": _percent(F.col("_gc"), bases), "at_content": _percent(F.col("_at"), bases), "n_content": _percent(F.col("_n"), bases)})
    if quality:
        some = F.col("_q") > 0
        out = out.withColumns({"mean_quality": F.when(some, F.col("_sum") / F.col("_q")), "q20_percent": F.when(some, F.col("_q20") * 100.0 / F.col("_q")), "q30_percent": F.when(some, F.col("_q30") * 100.0 / F.col("_q")), "max_quality": F.when(some, F.col("max_quality"))})
    return out.drop("_gc", "_at", "_n", "_q", "_sum", "_q20", "_q30").crossJoin(F.broadcast(from_histogram(length_histogram(df, seq))))  # one row by one row
