"""CIGAR strings and SAM flags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.sequence import bind

#: Fixed: flag names in order of their bits.
FLAGS = ("paired", "proper_pair", "unmapped", "mate_unmapped", "reverse", "mate_reverse", "first", "second", "secondary", "qc_fail", "duplicate", "supplementary")

#: Fixed: counters that each operation adds its length to.
COUNTERS = {
    "matches": "M=", "mismatches": "X", "insertions": "I", "deletions": "D", "soft_clips": "S", "hard_clips": "H",
    "aligned_length": "M=XID", "reference_length": "M=XDN", "query_length": "M=XIS",
}


def decode_flags(flag: Column) -> Column:
    return F.struct(*[(flag.bitwiseAND(F.lit(1 << i)) != 0).alias(n) for i, n in enumerate(FLAGS)])


def encode_flags(flags: Column) -> Column:
    """The number of a struct of flags; null is unset."""
    return sum((F.when(F.coalesce(flags[n], F.lit(False)), 1 << i).otherwise(0) for i, n in enumerate(FLAGS)), F.lit(0))


def valid(cigar: Column) -> Column:
    return cigar.rlike(r"^(\*|(\d+[MIDNSHP=X])+)$")


def parse(cigar: Column) -> Column:
    """Array of (length, op); `*` has none.  What isn't an operation is skipped; without any, it is an error."""
    lengths, letters = (F.regexp_extract_all(cigar, F.lit(x), 1) for x in (r"(\d+)[MIDNSHP=X]", r"\d+([MIDNSHP=X])"))
    ops = F.zip_with(lengths, letters, lambda n, op: F.struct(n.cast("int").alias("length"), op.alias("op")))
    return bind(ops, lambda x: F.when((F.size(x) > 0) | (cigar == "*"), x).otherwise(F.raise_error(F.concat(F.lit("invalid CIGAR: "), cigar))))


def format_ops(ops: Column) -> Column:
    bad = F.exists(ops, lambda o: (o["length"] <= 0) | o["op"].isNull())
    text = F.array_join(F.transform(ops, lambda o: F.concat(o["length"].cast("string"), o["op"])), "")
    return F.when(bad, F.raise_error(F.lit("invalid CIGAR operation"))).when(F.size(ops) == 0, "*").otherwise(text)


def stats(ops: Column) -> Column:
    """Struct of the nine counters, in one pass."""
    add = lambda a, o: F.struct(*[(a[k] + F.when(o["op"].isin(*v), o["length"]).otherwise(0)).alias(k) for k, v in COUNTERS.items()])
    return F.aggregate(ops, F.struct(*[F.lit(0).alias(k) for k in COUNTERS]), add)


def aligned(cigar: Column, query: Column) -> Column:
    """Struct (query, reference) of the alignment: deleted bases are N in the reference, skipped ones spaces, soft-clipped
    ones lower case, padding `*`.  An error where the operations don't use up the query."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("q"), F.lit("").alias("r"))

    def step(a: Column, o: Column) -> Column:
        n, op = o["length"], o["op"]
        piece = F.substr(query, a["at"] + 1, n)
        q = F.when(op.isin("M", "=", "X", "I"), piece).when(op == "S", F.lower(piece)).when(op == "D", F.repeat(F.lit("-"), n)).when(op == "N", F.repeat(F.lit(" "), n)).when(op == "P", F.repeat(F.lit("*"), n)).otherwise("")
        r = F.when(op.isin("M", "=", "X"), piece).when(op.isin("I", "S"), F.repeat(F.lit("-"), n)).when(op == "D", F.repeat(F.lit("N"), n)).when(op == "N", F.repeat(F.lit(" "), n)).when(op == "P", F.repeat(F.lit("*"), n)).otherwise("")
        used = F.when(op.isin("M", "=", "X", "I", "S"), n).otherwise(0)
        return F.struct((a["at"] + used).alias("at"), F.concat(a["q"], q).alias("q"), F.concat(a["r"], r).alias("r"))

    done = F.aggregate(parse(cigar), zero, step)
    return F.when(done["at"] == F.length(query), F.struct(done["q"].alias("query"), done["r"].alias("reference"))).otherwise(F.raise_error(F.lit("CIGAR and query differ in length")))
