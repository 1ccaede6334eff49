"""FASTA and FASTQ: readers over Spark's text source, parsers of text columns, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import trim, wrap


def _record(chunk: Column, missing: Column) -> Column:
    """Struct (id, description, sequence) of a chunk without its `>`; the header is split at its first space only."""
    lines = F.split(chunk, "\n")
    header = trim(F.element_at(lines, 1))
    at = F.locate(" ", header)
    body = F.array_join(F.transform(F.slice(lines, 2, 1 << 30), trim), "")
    return F.struct(F.when(at > 0, F.substr(header, F.lit(1), at - 1)).otherwise(header).alias("id"), F.when(at > 0, F.substr(header, at + 1)).otherwise(missing).alias("description"), body.alias("sequence"))


def parse_fasta_text(df: DataFrame, text: str = "value", keep: tuple[str, ...] = (), empty_description: bool = False) -> DataFrame:
    """keep, pos, id, description and sequence of each record of a text column.

    Lines before the first header and records without an id are left out; blank lines and white space around lines don't count.
    """
    missing = F.lit("") if empty_description else F.lit(None).cast("string")
    chunks = F.slice(F.split(F.concat(F.lit("\n"), F.col(text)), r"\n\s*>"), 2, 1 << 30)
    return df.select(*keep, F.posexplode(chunks).alias("pos", "_c")).select(*keep, "pos", _record(F.col("_c"), missing).alias("r")).select(*keep, "pos", "r.*").where("id <> ''")


def read_fasta(spark: SparkSession, path: str, empty_description: bool = False) -> DataFrame:
    """id, description and sequence; splittable, and decompressed by suffix.

    A split ends at a newline before `>`, so large files are read in parallel.  A file must begin with a record (or white
    space); text before it would be taken for one.
    """
    missing = F.lit("") if empty_description else F.lit(None).cast("string")
    chunks = spark.read.option("lineSep", "\n>").text(path)
    inner = chunks.select(F.explode(F.split(F.regexp_replace("value", r"^\s*>", ""), r"\n\s*>")).alias("c"))
    return inner.select(_record(F.col("c"), missing).alias("r")).select("r.*").where("id <> ''")


def stream_fasta(spark: SparkSession, path: str) -> DataFrame:
    """As read_fasta, for files that arrive in a folder."""
    chunks = spark.readStream.option("lineSep", "\n>").text(path)
    inner = chunks.select(F.explode(F.split(F.regexp_replace("value", r"^\s*>", ""), r"\n\s*>")).alias("c"))
    return inner.select(_record(F.col("c"), F.lit(None).cast("string")).alias("r")).select("r.*").where("id <> ''")


def format_fasta(id_: Column, description: Column, sequence: Column, width: int = 80) -> Column:
    head = F.concat(F.lit(">"), id_, F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(" "), description)).otherwise(""))
    return F.when(F.length(sequence) > 0, F.concat(head, F.lit("\n"), wrap(sequence, width))).otherwise(head)


def write_fasta(df: DataFrame, path: str, width: int = 80, gzip: bool = False) -> None:
    out = df.select(format_fasta(F.col("id"), F.col("description"), F.col("sequence"), width).alias("value")).write.mode("overwrite")
    (out.option("compression", "gzip") if gzip else out).text(path)


def _fastq(groups: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """Records from rows of (keys, rec, at, line)."""
    four = groups.groupBy(*keys, "rec").agg(*[F.max(F.when(F.col("at") == i, F.col("line"))).alias(f"l{i}") for i in range(4)])
    whole = four.where("l3 IS NOT NULL")
    bad = F.when(~F.col("l0").startswith("@"), "header does not begin with @").when(~F.col("l2").startswith("+"), "separator does not begin with +").when((F.length("l1") > 0) & (F.length("l1") != F.length("l3")), "sequence and quality differ in length")
    at = F.locate(" ", F.col("l0"))
    out = whole.select(*keys, "rec", F.when(at > 0, F.substr("l0", F.lit(2), at - 2)).otherwise(F.substr("l0", F.lit(2))).alias("id"), F.when(at > 0, F.substr("l0", at + 1)).alias("description"), F.col("l1").alias("sequence"), F.col("l3").alias("quality"), bad.alias("_corrupt_record"))
    if mode == "PERMISSIVE":
        return out
    if mode == "DROPMALFORMED":
        return out.where("_corrupt_record IS NULL").drop("_corrupt_record")
    return out.withColumn("id", F.when(F.col("_corrupt_record").isNull(), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("invalid FASTQ: "), F.col("_corrupt_record"))))).drop("_corrupt_record")


def read_fastq(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """id, description, sequence and quality.  mode: FAILFAST, PERMISSIVE (_corrupt_record) or DROPMALFORMED.

    Lines are numbered within their split, and the splits of a file by the counts of those before, as a quality may begin
    with `@` like a header.  An unfinished last record is left out.
    """
    lines = spark.read.text(path).select(trim(F.col("value")).alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))
    own = lines.withColumn("i", F.row_number().over(Window.partitionBy("file", "block").orderBy("mid")) - 1)
    sizes = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = own.join(before, ["file", "block"]).withColumn("no", F.col("i") + F.col("before"))
    groups = placed.select("file", F.floor(F.col("no") / 4).alias("rec"), (F.col("no") % 4).alias("at"), "line")
    return _fastq(groups, ["file"], mode).drop("file", "rec")


def parse_fastq_text(df: DataFrame, text: str = "value", keep: tuple[str, ...] = ("id",), mode: str = "FAILFAST") -> DataFrame:
    """Records of a text column.  Blank lines are passed over, but count in the cycle of four."""
    rows = df.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.posexplode(F.split(text, "\n")).alias("no", "line")).withColumn("line", trim(F.col("line"))).where("line <> ''")
    return _fastq(rows.select(*[f"k_{c}" for c in keep], F.floor(F.col("no") / 4).alias("rec"), (F.col("no") % 4).alias("at"), "line"), [f"k_{c}" for c in keep], mode)


def format_fastq(id_: Column, description: Column, sequence: Column, quality: Column) -> Column:
    head = F.concat(F.lit("@"), id_, F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(" "), description)).otherwise(""))
    return F.concat_ws("\n", head, sequence, F.lit("+"), quality)


def write_fastq(df: DataFrame, path: str, gzip: bool = False) -> None:
    out = df.select(format_fastq(F.col("id"), F.col("description"), F.col("sequence"), F.col("quality")).alias("value")).write.mode("overwrite")
    (out.option("compression", "gzip") if gzip else out).text(path)
