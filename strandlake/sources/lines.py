"""Line formats: BED, GFF3/GTF, VCF and SAM.  A parser is one projection over lines, a formatter one expression; lines that
don't parse are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.cigar import FLAGS, decode_flags, encode_flags
from strandlake.functions.sequence import bind, parse_float, parse_int, pin, trim, uri_decode, uri_encode

REST = 1 << 30


def _fields(lines: DataFrame, value: str, comment: str = "#", least: int = 1) -> tuple[DataFrame, list[Column]]:
    """Lines that aren't blank or comments and have the least number of fields, split once, and the first twelve fields."""
    df = pin(lines, "_f", F.split(trim(F.col(value)), "\t"))
    first = F.get("_f", F.lit(0))
    return df.where((first != "") & ~first.startswith(comment) & (F.size("_f") >= least)), [F.get("_f", F.lit(i)) for i in range(12)]


def _map(entries: Column) -> Column:
    """A map of (k, v) pairs; of equal keys the first place and the last value count."""
    value = lambda e, k: F.element_at(F.filter(e, lambda x: x["k"] == k), -1)["v"]
    once = lambda e, ks: bind(F.array_distinct(ks), lambda u: F.when(F.size(u) == F.size(ks), F.map_from_entries(e)).otherwise(F.map_from_arrays(u, F.transform(u, lambda k: value(e, k)))))
    return bind(entries, lambda e: bind(F.transform(e, lambda x: x["k"]), lambda ks: once(e, ks)))


def parse_bed(lines: DataFrame, value: str = "value") -> DataFrame:
    """BED3 to BED12.  Blank lines and those beginning with `#`, `track` or `browser` aren't records; coordinates must be
    integers with 0 <= start < end, a strand one of + - ."""
    df, f = _fields(lines, value, least=3)
    df = df.where(~f[0].startswith("track") & ~f[0].startswith("browser"))
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: parse_int(x).cast("int"))
    df = pin(df, "_c", F.array(parse_int(f[1]), parse_int(f[2]))).where(f[5].isNull() | f[5].isin("+", "-", "."))
    start, end = F.get("_c", F.lit(0)), F.get("_c", F.lit(1))
    df = df.where((start >= 0) & (start < end))
    return df.select("*", f[0].alias("chrom"), start.alias("chrom_start"), end.alias("chrom_end"), f[3].alias("name"), parse_float(f[4]).alias("score"), f[5].alias("strand"), parse_int(f[6]).alias("thick_start"), parse_int(f[7]).alias("thick_end"), f[8].alias("item_rgb"), parse_int(f[9]).cast("int").alias("block_count"), numbers(f[10]).alias("block_sizes"), numbers(f[11]).alias("block_starts")).drop("_f", "_c", value)


BED_OPTIONAL = ("name", "score", "strand", "thick_start", "thick_end", "item_rgb", "block_count", "block_sizes", "block_starts")


def number_text(c: Column) -> Column:
    """A double as people write it: whole numbers without a point."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def format_bed(columns: tuple[str, ...] = BED_OPTIONAL) -> Column:
    """The line of a record; it ends before the first optional column that is null."""
    out = F.concat_ws("\t", "chrom", F.col("chrom_start").cast("string"), F.col("chrom_end").cast("string"))
    present = F.lit(True)
    for c in columns:
        present = present & F.col(c).isNotNull()
        text = number_text(F.col(c)) if c == "score" else F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",") if c in ("block_sizes", "block_starts") else F.col(c).cast("string")
        out = F.concat(out, F.when(present, F.concat(F.lit("\t"), text)).otherwise(""))
    return out


def parse_gff(lines: DataFrame, version: str = "gff3", value: str = "value") -> DataFrame:
    """Nine tab-separated fields, attributes as a map to arrays.  A malformed escape drops the line; the last of equal keys counts."""
    df, f = _fields(lines, value, least=9)
    df = df.where((F.size("_f") == 9) & f[6].isin("+", "-", ".", "?"))
    if version == "gff3":
        split = lambda x: bind(F.locate("=", x), lambda at: F.struct(trim(F.when(at > 0, F.substr(x, F.lit(1), at - 1)).otherwise(x)).alias("k"), F.when(at > 0, F.transform(F.split(F.substr(x, at + 1), ","), uri_decode)).otherwise(F.array(F.lit(""))).alias("v")))
        pairs = F.transform(F.filter(F.split(f[8], ";"), lambda x: trim(x) != ""), split)
    else:
        # A value in quotes is one piece of text, so keys and values come from one pattern each.
        keys, values = (F.regexp_extract_all(f[8], F.lit(x), 1) for x in (r"(\w+)\s+\"[^\"]+\"", r"\w+\s+\"([^\"]+)\""))
        pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), F.array(v).alias("v")))
    df = pin(df, "_p", pairs)
    df = df.where(~F.exists("_p", lambda p: F.exists(p["v"], lambda v: v.isNull())))
    return df.select("*", f[0].alias("seqid"), f[1].alias("source"), f[2].alias("type"), parse_int(f[3]).alias("start"), parse_int(f[4]).alias("end"), F.when(f[5] != ".", parse_float(f[5])).alias("score"), f[6].alias("strand"), F.when(f[7] != ".", parse_int(f[7]).cast("int")).alias("phase"), _map(F.col("_p")).alias("attributes")).drop("_f", "_p", value)


GFF_HEADER = {"gff3": "##gff-version 3", "gtf": "#gtf-version 2.2"}


def format_gff(version: str = "gff3") -> Column:
    entries = F.map_entries("attributes")
    if version == "gff3":
        text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], uri_encode), ","))), ";")
    else:
        text = F.concat(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(' "'), F.element_at(e["value"], 1), F.lit('"'))), "; "), F.lit(";"))
    dot = lambda c: F.coalesce(c, F.lit("."))
    return F.concat_ws("\t", "seqid", "source", "type", F.col("start").cast("string"), F.col("end").cast("string"), dot(number_text(F.col("score"))), "strand", dot(F.col("phase").cast("string")), text)


def parse_vcf(lines: DataFrame, value: str = "value", samples: int | None = None) -> DataFrame:
    """Records of eight fields or more.  info maps a key to struct(s, d, b): text, number, or flag; of `k=a=b` and of lists
    the first part counts as number.  sample values that are missing are `.`; of equal keys the last counts."""
    df, f = _fields(lines, value, least=8)
    text, number, flag = (F.lit(None).cast(t) for t in ("string", "double", "boolean"))
    entry = lambda p: F.struct(F.get(p, F.lit(0)).alias("k"), F.when(F.size(p) > 1, F.struct(F.get(p, F.lit(1)).alias("s"), parse_float(F.get(p, F.lit(1))).alias("d"), flag.alias("b"))).otherwise(F.struct(text.alias("s"), number.alias("d"), F.lit(True).alias("b"))).alias("v"))
    info = F.transform(F.transform(F.filter(F.split(f[7], ";"), lambda x: ~x.isin("", ".")), lambda x: F.split(x, "=")), entry)
    df = pin(df, "_k", F.when(F.size("_f") > 9, F.split(f[8], ":")))
    given = lambda x: F.coalesce(F.when(x != "", x), F.lit("."))
    one = lambda s: bind(F.split(s, ":"), lambda p: _map(F.transform("_k", lambda k, i: F.struct(k.alias("k"), given(F.get(p, i)).alias("v")))))
    return df.select("*", f[0].alias("chrom"), parse_int(f[1]).alias("pos"), f[2].alias("id"), f[3].alias("ref"), F.split(f[4], ",").alias("alt"), F.when(f[5] != ".", parse_float(f[5])).alias("qual"), f[6].alias("filter"), _map(info).alias("info"), F.col("_k").alias("format"), F.when(F.size("_f") > 9, F.transform(F.slice("_f", 10, REST), one)).alias("samples")).drop("_f", "_k", value)


def format_vcf() -> Column:
    info = F.array_join(F.transform(F.map_entries("info"), lambda e: F.when(e["value"]["b"], e["key"]).otherwise(F.concat(e["key"], F.lit("="), F.coalesce(number_text(e["value"]["d"]), e["value"]["s"])))), ";")
    head = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", F.array_join("alt", ","), F.coalesce(number_text(F.col("qual")), F.lit(".")), "filter", F.when(info == "", ".").otherwise(info))
    tail = F.concat(F.lit("\t"), F.array_join("format", ":"), F.lit("\t"), F.array_join(F.transform("samples", lambda s: F.array_join(F.transform(F.col("format"), lambda k: F.coalesce(s[k], F.lit("."))), ":")), "\t"))
    return F.when(F.col("format").isNotNull() & F.col("samples").isNotNull(), F.concat(head, tail)).otherwise(head)


def parse_vcf_header(lines: DataFrame, value: str = "value") -> DataFrame:
    """kind (fileformat, contig, info, filter, format, samples, other), and a map of the fields, of each `#` line."""
    v = trim(F.col(value))
    df = pin(lines, "v", v).where(F.col("v").startswith("#"))
    kind = F.when(F.col("v").startswith("#CHROM"), "samples").otherwise(F.lower(F.regexp_extract("v", r"^##(\w+)", 1)))
    inner = F.regexp_extract_all(F.regexp_extract("v", r"<(.*)>$", 1), F.lit(r'(\w+=(?:"[^"]*"|[^,]*))'), 1)
    fields = F.transform(inner, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(F.substr(x, F.locate("=", x) + 1), '^"|"$', "").alias("v")))
    return df.select(F.when(kind.isin("samples", "fileformat", "contig", "info", "filter", "format"), kind).otherwise("other").alias("kind"), _map(fields).alias("fields"), F.when(kind == "samples", F.slice(F.split("v", "\t"), 10, REST)).otherwise(F.array(F.regexp_extract("v", r"^##[^=]*=(.*)$", 1))).alias("values"))


def format_vcf_header(fileformat: str, contigs: list[dict], info: list[dict], filters: list[dict], formats: list[dict], samples: list[str], other: tuple[str, ...] = ()) -> list[str]:
    """Header lines: fileformat, other, contig, INFO, FILTER, FORMAT, then the columns."""
    one = lambda kind, d: f"##{kind}=<" + ",".join(f'{k}="{v}"' if k == "Description" else f"{k}={v}" for k, v in d.items()) + ">"
    lines = [f"##fileformat={fileformat}", *other]
    for kind, items in (("contig", contigs), ("INFO", info), ("FILTER", filters), ("FORMAT", formats)):
        lines += [one(kind, d) for d in items]
    return [*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])])]


def parse_sam(lines: DataFrame, value: str = "value") -> DataFrame:
    """Records of eleven fields or more; tags map a key to struct(type, i, f, z).  A value ends at its first colon; of equal
    keys the last counts."""
    df, f = _fields(lines, value, "@", 11)
    kind = lambda p: F.get(p, F.lit(1))
    tag = lambda p: F.struct(F.get(p, F.lit(0)).alias("k"), F.struct(kind(p).alias("type"), F.when(kind(p) == "i", parse_int(F.get(p, F.lit(2)))).alias("i"), F.when(kind(p) == "f", parse_float(F.get(p, F.lit(2)))).alias("f"), F.when(~kind(p).isin("i", "f"), F.get(p, F.lit(2))).alias("z")).alias("v"))
    tags = F.transform(F.filter(F.transform(F.slice("_f", 12, REST), lambda x: F.split(x, ":")), lambda p: F.size(p) >= 3), tag)
    df = pin(df, "_n", parse_int(f[1]))
    return df.select("*", f[0].alias("qname"), F.col("_n").cast("int").alias("flag"), decode_flags(F.col("_n")).alias("flags"), f[2].alias("rname"), parse_int(f[3]).alias("pos"), parse_int(f[4]).cast("int").alias("mapq"), f[5].alias("cigar"), f[6].alias("rnext"), parse_int(f[7]).alias("pnext"), parse_int(f[8]).alias("tlen"), f[9].alias("seq"), f[10].alias("qual"), _map(tags).alias("tags")).drop("_f", "_n", value)


def format_sam() -> Column:
    """The line of a record; whole numbers are written as `i`, others as `f`, text as `Z`."""
    whole = lambda v: (v["f"] == F.floor(v["f"]))
    text = lambda v: F.when(v["i"].isNotNull(), F.concat(F.lit("i:"), v["i"].cast("string"))).when(v["f"].isNotNull(), F.concat(F.when(whole(v), "i:").otherwise("f:"), number_text(v["f"]))).otherwise(F.concat(F.lit("Z:"), v["z"]))
    tags = F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat(F.lit("\t"), e["key"], F.lit(":"), text(e["value"]))), "")
    return F.concat(F.concat_ws("\t", "qname", encode_flags(F.col("flags")).cast("string"), "rname", F.col("pos").cast("string"), F.col("mapq").cast("string"), "cigar", "rnext", F.col("pnext").cast("string"), F.col("tlen").cast("string"), "seq", "qual"), tags)


def parse_sam_header(lines: DataFrame, value: str = "value") -> DataFrame:
    """kind (HD, SQ, RG, PG, CO) and fields of each `@` line; sequences of length 0 are left out, values end at their first
    colon, and of equal keys the last counts."""
    df = pin(lines, "_f", F.split(trim(F.col(value)), "\t"))
    head = F.get("_f", F.lit(0))
    split = F.transform(F.filter(F.slice("_f", 2, REST), lambda x: F.locate(":", x) > 0), lambda x: F.split(x, ":"))
    pairs = F.transform(split, lambda p: F.struct(F.get(p, F.lit(0)).alias("k"), F.get(p, F.lit(1)).alias("v")))
    out = df.where(head.startswith("@")).select(F.substr(head, F.lit(2)).alias("kind"), F.when(head != "@CO", _map(pairs)).alias("fields"), F.when(head == "@CO", F.array_join(F.slice("_f", 2, REST), "\t")).alias("comment"))
    return out.where("kind <> 'SQ' OR coalesce(try_cast(fields['LN'] AS bigint), 0) > 0")


def format_sam_header() -> Column:
    """The header line of (kind, fields, comment), as parse_sam_header gives them."""
    fields = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(F.lit("\t"), e["key"], F.lit(":"), e["value"])), "")
    return F.when(F.col("kind") == "CO", F.concat(F.lit("@CO\t"), "comment")).otherwise(F.concat(F.lit("@"), "kind", F.coalesce(fields, F.lit(""))))


def bed_header(track: str | None = None, description: str | None = None) -> list[str]:
    """The track line of a BED file, if it has a name."""
    return [f'track name="{track}"' + (f' description="{description}"' if description else "")] if track else []


def with_header(spark: SparkSession, header: list[str] | DataFrame, body: DataFrame) -> DataFrame:
    """The value lines of a whole file: the header (lines, or a column `value`), which is the first partition, then the body."""
    head = header if isinstance(header, DataFrame) else spark.createDataFrame([(x,) for x in header], "value string")
    return head.select("value").coalesce(1).union(body.select("value"))


def write_lines(spark: SparkSession, header: list[str] | DataFrame, body: DataFrame, path: str, gzip: bool = False) -> None:
    """A folder of text files of which the first by name is the header; in order of name, they are one file."""
    out = with_header(spark, header, body).write.mode("overwrite")
    (out.option("compression", "gzip") if gzip else out).text(path)


def overlaps(left: DataFrame, right: DataFrame, bin_size: int = 1 << 14) -> DataFrame:
    """Pairs of overlapping intervals (id, chrom, chrom_start, chrom_end on each side), by an equi-join on bins.

    A pair is reported in the first bin that both touch, so that none is reported twice.
    """
    bins = lambda df: df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("chrom_start") / bin_size), F.floor((F.col("chrom_end") - 1) / bin_size))))
    x = bins(left.select("id", "chrom", "chrom_start", "chrom_end")).withColumnsRenamed({"id": "id1", "chrom_start": "s1", "chrom_end": "e1"})
    y = bins(right.select("id", "chrom", "chrom_start", "chrom_end")).withColumnsRenamed({"id": "id2", "chrom_start": "s2", "chrom_end": "e2"})
    met = x.join(y, ["chrom", "bin"]).where("s1 < e2 AND s2 < e1").where(F.col("bin") == F.floor(F.greatest("s1", "s2") / bin_size))
    return met.select("id1", "id2", "chrom", F.greatest("s1", "s2").alias("overlap_start"), F.least("e1", "e2").alias("overlap_end"))


__all__ = [n for n in dir() if n.startswith(("parse_", "format_")) or n in ("overlaps", "bed_header", "write_lines", "with_header", "GFF_HEADER", "FLAGS")]
