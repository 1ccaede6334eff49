"""Codon translation as Arrow kernels: a look-up in an array of all codons, whole batches at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequence import dna_reverse_complement, normalise, reverse_complement
from strandlake.functions.tables import codon_table

_CODE = np.full(256, 5, dtype=np.int64)
for _i, _c in enumerate("ACGTU"):
    _CODE[ord(_c)] = _i


def _lut(table: int | str) -> np.ndarray:
    """Amino acid byte of each codon over A, C, G, T, U and other; X where the code has none."""
    lut = np.full(216, ord("X"), dtype=np.uint8)
    for codon, amino in codon_table(table).items():
        a, b, c = (_CODE[ord(x)] for x in codon)
        lut[a * 36 + b * 6 + c] = ord(amino)
    return lut


def translator(table: int | str = "standard", stop: str = "*", break_on_stop: bool = True) -> Callable[[Column, Column], Column]:
    """A function of a normalised sequence column and a 0-based offset column.

    Codons that the code lacks give X. A stop codon gives the stop symbol and, with break_on_stop, ends the protein.
    """
    lut = _lut(table)

    @F.arrow_udf("string")
    def run(seq: pa.Array, offset: pa.Array) -> pa.Array:
        out = []
        for s, o in zip(seq.to_pylist(), offset.to_pylist(), strict=True):
            if s is None or o is None:
                out.append(None)
                continue
            # Characters, not bytes, so that foreign letters keep codons in frame.
            raw = np.frombuffer(s.encode("latin-1", "replace"), dtype=np.uint8)[o:]
            n = len(raw) // 3
            code = _CODE[raw[: 3 * n]].reshape(n, 3)
            text = lut[code[:, 0] * 36 + code[:, 1] * 6 + code[:, 2]].tobytes().decode("latin-1")
            if break_on_stop and (at := text.find("*")) >= 0:
                text = text[: at + 1]
            out.append(text.replace("*", stop) if stop != "*" else text)
        return pa.array(out, pa.string())

    return run


def translate(c: Column, **options) -> Column:
    """Frame 0 of the trimmed, upper-case sequence."""
    return translator(**options)(normalise(c), F.lit(0))


def translate_frames(c: Column, **options) -> Column:
    """The three forward frames, as an array."""
    run, s = translator(**options), normalise(c)
    return F.array(*[run(s, F.lit(i)) for i in range(3)])


def translate_six_frames(c: Column, **options) -> Column:
    """Three forward frames, then three of the reverse complement (as RNA where there is a U)."""
    run, s = translator(**options), normalise(c)
    r = reverse_complement(s)
    return F.array(*[run(s, F.lit(i)) for i in range(3)], *[run(r, F.lit(i)) for i in range(3)])


def translation_rows(df: DataFrame, seq: str = "sequence", all_frames: bool = False, include_reverse: bool = False, **options) -> DataFrame:
    """A row per frame with protein, frame (0-2 forward, 3-5 reverse), is_reverse and source_length.

    The reverse strand is always read as DNA here.
    """
    run, s = translator(**options), normalise(F.col(seq))
    frames = range(3) if all_frames else range(1)
    parts = [F.struct(run(s, F.lit(i)).alias("protein"), F.lit(i).alias("frame"), F.lit(False).alias("is_reverse")) for i in frames]
    if include_reverse:
        parts += [F.struct(run(dna_reverse_complement(s), F.lit(i)).alias("protein"), F.lit(i + 3).alias("frame"), F.lit(True).alias("is_reverse")) for i in frames]
    return df.withColumn("_t", F.explode(F.array(*parts))).select("*", "_t.*", F.length(s).alias("source_length")).drop("_t")


def translate_chunked(df: DataFrame, seq: str = "sequence", chunk: int = 30_000, **options) -> DataFrame:
    """Frame 0 of each slice of `chunk` bases and two more; a row per slice, in frame if chunk is a multiple of 3."""
    s = normalise(F.col(seq))
    cut = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(0), F.length(t) - 1, F.lit(chunk)), lambda i: F.substr(t, i + 1, F.lit(chunk + 2))))
    pieces = F.get(F.transform(F.array(s), cut), F.lit(0))
    return df.select("*", F.posexplode(pieces).alias("chunk", "_s")).withColumn("protein", translator(**options)(F.col("_s"), F.lit(0))).drop("_s")
