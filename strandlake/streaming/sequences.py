"""Structured streaming over sequence files: records, translations and running statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.translation import translate, translate_six_frames
from strandlake.session import ship
from strandlake.sources.fasta import stream_fasta


def stream_translations(spark: SparkSession, path: str, all_frames: bool = False, **options) -> DataFrame:
    """id, description and protein (of six frames: frame and protein) of each record of the FASTA files in a folder."""
    records = stream_fasta(ship(spark), path)
    s = F.col("sequence")
    if all_frames:
        return records.select("id", "description", F.posexplode(translate_six_frames(s, **options)).alias("frame", "protein"))
    return records.select("id", "description", translate(s, **options).alias("protein"))


def stream_totals(spark: SparkSession, path: str) -> DataFrame:
    """Running number of records and bases; write it in complete mode."""
    return stream_fasta(ship(spark), path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sequence")).alias("bases"))
