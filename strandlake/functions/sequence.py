"""Column expressions on sequences: all are built-in functions and stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: white space that trimming removes.
WHITE = " \t\n\v\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once: in a lambda's body, an outer expression would be computed for every element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def pin(df: DataFrame, name: str, c: Column) -> DataFrame:
    """df with a column that is computed once: the optimizer moves no copies of it into what uses it."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def trim(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.btrim(c, F.lit(WHITE))


def normalise(c: Column) -> Column:
    return F.upper(trim(c))


def parse_int(c: Column) -> Column:
    """The integer that a string begins with, or null."""
    return F.coalesce(c.try_cast("bigint"), F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("bigint"))


def parse_float(c: Column) -> Column:
    """The decimal number that a string begins with, or null."""
    return F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def uri_decode(c: Column) -> Column:
    """Percent-decoding that leaves `+` alone; null where an escape is malformed."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def uri_encode(c: Column) -> Column:
    """Percent-encoding that keeps letters, digits and -_.!~*'()."""
    out = F.url_encode(c)
    for escaped, kept in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(escaped), F.lit(kept))
    return out


def dna_to_rna(c: Column) -> Column:
    return F.translate(c, "Tt", "Uu")


def rna_to_dna(c: Column) -> Column:
    return F.translate(c, "Uu", "Tt")


def complement(c: Column) -> Column:
    """Complement with case kept; RNA where there is a U, in which T then stays. Other letters stay."""
    return F.when(c.rlike("[Uu]"), F.translate(c, "AUGCaugc", "UACGuacg")).otherwise(F.translate(c, "ATGCatgc", "TACGtacg"))


def reverse_complement(c: Column) -> Column:
    return F.reverse(complement(c))


def dna_reverse_complement(c: Column) -> Column:
    """As DNA whatever the letters: a U is complemented to A."""
    return F.reverse(F.translate(c, "ATGCUatgcu", "TACGAtacga"))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def is_nucleotides(c: Column) -> Column:
    return c.rlike("^[ACGTUNacgtun]*$")


def strict(c: Column) -> Column:
    """The sequence; an error where it has a letter other than ACGTUN."""
    return F.when(is_nucleotides(c), c).otherwise(F.raise_error(F.concat(F.lit("invalid nucleotide in sequence: "), F.substring(c, 1, 60))))


def count_of(c: Column, letters: str) -> Column:
    """Characters of c that are among the letters."""
    return F.length(c) - F.length(F.translate(c, letters, ""))


def wrap(c: Column, width: int) -> Column:
    """Lines of the given width."""
    return F.regexp_replace(F.regexp_replace(c, f"(.{{{width}}})", "$1\n"), "\n$", "")
