"""Open reading frames: the stops of a frame part it into islands, and an island's first start codon opens its frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

from strandlake.functions.sequence import normalise, rna_to_dna, strict
from strandlake.functions.tables import codon_table
from strandlake.functions.translation import translator
from strandlake.functions.windows import LETTERS

_BASE = np.full(256, 4, dtype=np.uint8)
_BASE[np.frombuffer(b"ACGT", dtype=np.uint8)] = range(4)
_COMPLEMENT = str.maketrans("ATGC", "TACG")


def _codons(text: str, frame: int) -> np.ndarray:
    """The codons of a frame, a byte each: 25 * first + 5 * second + third letter."""
    n = (len(text) - frame) // 3
    c = _BASE[np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)[frame : frame + 3 * n]].reshape(n, 3)
    return c[:, 0] * np.uint8(25) + c[:, 1] * np.uint8(5) + c[:, 2]


def _marks(codons: list[str]) -> np.ndarray:
    """Of the 125 codons over A, C, G, T and other, which are listed; a codon with another letter is none."""
    out = np.zeros(125, dtype=bool)
    out[_codons("".join(codons), 0)] = True
    return out


def frame_islands(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start codon, last codon, and whether that is a stop, of each island of a frame's codons that has a start."""
    n = len(codes)
    end = np.flatnonzero(stops[codes])
    begin = np.append(0, end + 1)
    end = np.append(end, n - 1)
    start = np.flatnonzero(starts[codes])
    at = np.searchsorted(start, begin)
    first = np.append(start, n)[at]
    has = first <= end
    return first[has], end[has], (np.arange(len(end)) < len(end) - 1)[has]


def _kernel(starts: list[str], stops: list[str], all_frames: bool, partial: bool, min_length: int, letters: int):
    """Batches of id and DNA to the columns of find_orfs, of rows with about so many letters at a time."""
    is_start, is_stop = _marks(starts), _marks(stops)

    def of(s: str) -> Iterator[tuple[str, int, int, int, str, int, bool]]:
        n = len(s)
        for forward in (True, False)[: 1 + all_frames]:
            t = s if forward else s.translate(_COMPLEMENT)[::-1]
            for f in range(3 if all_frames else 1):
                if n - f < 3:
                    continue
                a, z, whole = frame_islands(_codons(t, f), is_start, is_stop)
                keep = ((z - a + 1) * 3 >= min_length) & (whole | partial)
                first, last = f + 3 * a[keep], f + 3 * z[keep] + 3
                for b, e, w in zip(first.tolist(), last.tolist(), whole[keep].tolist(), strict=True):
                    yield t[b:e], b if forward else n - e, e if forward else n - b, f if forward else -1 - f, "+" if forward else "-", e - b, w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            types = [texts.type, *[pa.int32()] * 3, texts.type, pa.int32(), pa.bool_()]
            rows, found, size = [], [], 0
            for row in range(len(texts)):
                s = texts[row].as_py() or ""
                size += len(s)
                for orf in of(s):
                    rows.append(row)
                    found.append(orf)
                    size += orf[5]
                    if size >= letters:
                        yield _batch(ids, rows, found, types)
                        rows, found, size = [], [], 0
            if rows:
                yield _batch(ids, rows, found, types)

    return run


def _batch(ids: pa.Array, rows: list[int], found: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True))], names=["id", "orf", "start", "end", "frame", "strand", "length", "has_stop"])


def find_orfs(df: DataFrame, seq: str = "sequence", id_: str = "id", min_length: int = 75, include_partial: bool = False, all_frames: bool = True, translate: bool = False, table: int | str = "standard", start_codons: tuple[str, ...] = ("ATG", "AUG"), stop: str = "*") -> DataFrame:
    """id, orf (the sequence), start, end, frame, strand, length, has_stop and, if asked for, protein.

    Lengths are in bases and count the stop codon; `end` is exclusive and on the forward strand, frames of the reverse
    strand are -1, -2, -3.  all_frames=False reads the first forward frame only.  Each row is read by itself: ids may
    repeat or be null; a null sequence has no frame.
    """
    starts = sorted({c.upper().replace("U", "T") for c in start_codons})
    stops = sorted(c for c, a in codon_table(table).items() if a == "*" and "U" not in c)
    if set(starts) & set(stops):
        raise ValueError("a start codon is also a stop codon")
    base = df.select(F.col(id_).alias("id"), rna_to_dna(strict(normalise(F.col(seq)))).alias("s"))
    columns = StructType([base.schema["id"]]).add("orf", StringType()).add("start", IntegerType()).add("end", IntegerType()).add("frame", IntegerType()).add("strand", StringType()).add("length", IntegerType()).add("has_stop", BooleanType())
    out = base.mapInArrow(_kernel(starts, stops, all_frames, include_partial, min_length, LETTERS), columns)
    return out.withColumn("protein", translator(table, stop)(F.col("orf"), F.lit(0))) if translate else out
