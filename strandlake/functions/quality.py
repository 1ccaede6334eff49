"""Column expressions on FASTQ quality strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHRED33, PHRED64 = 33, 64


def letters(q: Column) -> Column:
    """The characters of a quality string; none of an empty one."""
    return F.filter(F.split(q, ""), lambda c: c != "")


def decode(q: Column, encoding: int = PHRED33) -> Column:
    return F.transform(letters(q), lambda c: F.ascii(c) - encoding)


def encode(scores: Column, encoding: int = PHRED33) -> Column:
    return F.array_join(F.transform(scores, lambda x: F.char(x + encoding)), "")


def convert(q: Column, source: int, target: int) -> Column:
    """Shifted between encodings without clamping; one translation of the printable characters."""
    if source == target:
        return q
    shift = target - source
    known = [i for i in range(1, 127) if 0 < i + shift < 256]
    return F.translate(q, "".join(map(chr, known)), "".join(chr(i + shift) for i in known))


def total(q: Column, encoding: int = PHRED33) -> Column:
    return F.aggregate(letters(q), F.lit(0).cast("long"), lambda a, c: a + F.ascii(c)) - F.length(q) * encoding


def mean(q: Column, encoding: int = PHRED33) -> Column:
    """Mean score; null of a null or empty string."""
    return F.when(F.length(q) > 0, total(q, encoding) / F.length(q))


def at_least(q: Column, score: int, encoding: int = PHRED33) -> Column:
    """Bases with that score or a higher one."""
    return F.size(F.filter(letters(q), lambda c: F.ascii(c) >= score + encoding))
