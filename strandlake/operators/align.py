"""Pairwise alignment as Arrow kernels.

One dynamic-programming kernel serves five aligners: it fills the anti-diagonals of a whole batch of pairs at once, so
every step is a numpy operation on (pairs x diagonal), and keeps a byte of direction per cell.  Pairs are batched by
size.  The linear-space aligner works by score rows, which need one running maximum each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.tables import Matrix, get_matrix, get_score
from strandlake.session import ship

NONE, DIAGONAL, UP, LEFT = 0, 1, 2, 3
RESULT = "aligned_seq1 string, aligned_seq2 string, score double, start_pos1 int, start_pos2 int, end_pos1 int, end_pos2 int, identity int, identity_percent double, alignment_length int"
#: Direction bytes held at a time.
CELLS = 1 << 25
LOW = -1e18


def score_table(matrix: str | Matrix) -> np.ndarray:
    """256 x 256 scores, whatever the case; 0 for what the matrix lacks."""
    out = np.zeros((256, 256))
    for (a, b), v in (get_matrix(matrix) if isinstance(matrix, str) else matrix).items():
        for x in (a.upper(), a.lower()):
            for y in (b.upper(), b.lower()):
                out[ord(x), ord(y)] = v
    return out


def _codes(seqs: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(seqs), width), dtype=np.uint8)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = np.frombuffer(s.encode("latin-1", "replace"), dtype=np.uint8)
    return out


def fill(mode: str, s1: list[str], s2: list[str], table: np.ndarray, gap_open: float, gap_extend: float, band: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and directions, pairs x (m + 1) x (n + 1).  mode: global, local, semi, overlap or banded.

    With a band, the last axis holds only the 2 * band + 1 columns about the diagonal, between two that stay low: cell
    (i, j) is at j - i + band + 1, so that memory grows with the length times the band.
    """
    b, m, n = len(s1), max(map(len, s1)), max(map(len, s2))
    x, y = _codes(s1, m), _codes(s2, n)
    at = (lambda i, j: j) if band is None else lambda i, j: j - i + band + 1
    H = np.full((b, m + 1, _width(n, band)), LOW)
    D = np.zeros(H.shape, dtype=np.int8)
    E, G = np.full((b, m + 1), LOW), np.full((b, m + 1), LOW)  # gaps going down and right, by row, of the last diagonal
    ramp = lambda k: gap_open + (np.arange(1, k + 1) - 1) * gap_extend
    i, j = np.arange(1, (m if band is None else min(m, band)) + 1), np.arange(1, (n if band is None else min(n, band)) + 1)
    H[:, 0, at(0, 0)] = 0
    H[:, 0, at(0, j)] = ramp(len(j)) if mode in ("global", "banded") else 0
    H[:, i, at(i, 0)] = ramp(len(i)) if mode in ("global", "banded", "overlap") else 0
    if mode in ("global", "banded"):
        D[:, 0, at(0, j)] = LEFT
    if mode in ("global", "banded", "overlap"):
        D[:, i, at(i, 0)] = UP
    single = mode in ("global", "local")
    for d in range(2, m + n + 1):
        first, last = max(1, d - n), min(m, d - 1)
        if band is not None:
            first, last = max(first, (d - band + 1) // 2), min(last, (d + band) // 2)
        i = np.arange(first, last + 1)
        if not len(i):
            continue
        j = d - i
        diagonal = H[:, i - 1, at(i - 1, j - 1)] + table[x[:, i - 1], y[:, j - 1]]
        if single:
            up = H[:, i - 1, at(i - 1, j)] + np.where(D[:, i - 1, at(i - 1, j)] == UP, gap_extend, gap_open)
            left = H[:, i, at(i, j - 1)] + np.where(D[:, i, at(i, j - 1)] == LEFT, gap_extend, gap_open)
        else:
            up = np.maximum(H[:, i - 1, at(i - 1, j)] + gap_open, E[:, i - 1] + gap_extend)
            left = np.maximum(H[:, i, at(i, j - 1)] + gap_open, G[:, i] + gap_extend)
            near = slice(first - 1, last + 2)  # a diagonal's rows are its neighbour's, one more or less at either end
            E[:, near], G[:, near] = LOW, LOW
            E[:, i], G[:, i] = up, left
        best = np.maximum(np.maximum(diagonal, up), left)
        way = np.where(diagonal == best, DIAGONAL, np.where(up == best, UP, LEFT))
        if mode == "local":
            way = np.where(best > 0, way, NONE)
            best = np.maximum(best, 0)
        H[:, i, at(i, j)], D[:, i, at(i, j)] = best, way
    return H, D


def _width(n: int, band: int | None) -> int:
    """Columns that fill keeps of a row."""
    return n + 1 if band is None else 2 * band + 3


def _end(mode: str, h: np.ndarray, m: int, n: int) -> tuple[int, int]:
    if mode == "local":
        return divmod(int(np.argmax(h)), n + 1)
    if mode == "overlap":
        return int(np.argmax(h[:, n])), n
    if mode == "semi":
        j, i = int(np.argmax(h[m])), int(np.argmax(h[:, n]))
        return (i, n) if h[i, n] > h[m, j] else (m, j)
    return m, n


def _trace(mode: str, a: str, b: str, h: np.ndarray, d: np.ndarray, min_score: float, normalise: bool, band: int | None = None) -> tuple:
    m, n = len(a), len(b)
    ei, ej = i, j = _end(mode, h, m, n)
    shift = 0 if band is None else band + 1
    score = float(h[i, j if band is None else j - i + shift])
    if mode == "local" and score < min_score:
        return ("", "", 0.0, 0, 0, 0, 0, 0, 0.0, 0)
    tail = (a[i:] + "-" * (n - j), "-" * (m - i) + b[j:]) if mode in ("semi", "overlap") else ("", "")
    way = []
    while (i > 0 and j > 0 and h[i, j] > 0) if mode == "local" else (i > 0 or j > 0):
        step = d[i, j if band is None else j - i + shift]
        if step == DIAGONAL and i and j:
            i, j = i - 1, j - 1
            way.append((a[i], b[j]))
        elif step == UP and i:
            i -= 1
            way.append((a[i], "-"))
        elif step == LEFT and j:
            j -= 1
            way.append(("-", b[j]))
        else:
            break
    si, sj = (i, j) if mode == "local" else (0, 0)
    if mode in ("semi", "overlap"):
        way += [(c, "-") for c in reversed(a[:i])] + [("-", c) for c in reversed(b[:j])]
    way.reverse()
    return _result("".join(p for p, _ in way) + tail[0], "".join(q for _, q in way) + tail[1], score, si, sj, ei, ej, normalise)


def _result(a: str, b: str, score: float, si: int, sj: int, ei: int, ej: int, per_column: bool) -> tuple:
    same = sum(p == q != "-" for p, q in zip(a, b, strict=True))
    return (a, b, score / len(a) if per_column and a else score, si, sj, ei, ej, same, 100.0 * same / len(a) if a else 0.0, len(a))


def align_batch(mode: str, s1: list[str], s2: list[str], matrix: str | Matrix = "BLOSUM62", gap_open: float = -10, gap_extend: float = -1, bandwidth: int = 10, min_score: float = 0, normalise: bool | None = None) -> list[tuple]:
    """Results of all pairs.  For global and local, normalise (default) trims and upper-cases; for semi, overlap and
    banded (default off), it divides the score by the alignment's length."""
    table = score_table(matrix)
    if mode in ("global", "local"):
        if gap_open > 0 or gap_extend > 0:
            raise ValueError("gap penalties must not be positive")
        clean = normalise is None or normalise
        s1, s2 = ([x.strip().upper() if clean else x for x in s] for s in (s1, s2))
        per_column = False
    else:
        per_column = bool(normalise)
    if any(not x.strip() or not y.strip() for x, y in zip(s1, s2, strict=True)):
        raise ValueError("sequences must not be empty")
    if mode == "banded":
        if bandwidth < 0 or any(abs(len(x) - len(y)) > bandwidth for x, y in zip(s1, s2, strict=True)):
            raise ValueError("sequences differ in length by more than the bandwidth")
    out: list[tuple] = [()] * len(s1)
    band = bandwidth if mode == "banded" else None
    order = sorted(range(len(s1)), key=lambda i: (len(s1[i]), len(s2[i])))
    at = 0
    while at < len(order):
        take = [order[at]]
        while at + len(take) < len(order):
            nxt = [*take, order[at + len(take)]]
            if len(nxt) * (max(len(s1[i]) for i in nxt[-1:]) + 1) * _width(max(len(s2[i]) for i in nxt), band) * 9 > CELLS or len(nxt) > 512:
                break
            take = nxt
        at += len(take)
        H, D = fill(mode, [s1[i] for i in take], [s2[i] for i in take], table, gap_open, gap_extend, band)
        for r, i in enumerate(take):
            m, n = len(s1[i]), len(s2[i])
            columns = _width(n, band)
            out[i] = _trace(mode, s1[i], s2[i], H[r, : m + 1, :columns], D[r, : m + 1, :columns], min_score, per_column, band)
    return out


def _row(a: np.ndarray, b: np.ndarray, table: np.ndarray, gap: float) -> np.ndarray:
    """Last row of linear-gap scores of a against b."""
    j = np.arange(len(b) + 1)
    row = j * gap
    for i, c in enumerate(a):
        best = np.maximum(np.append((i + 1) * gap, row[:-1] + table[c, b]), row + gap)
        best[0] = (i + 1) * gap
        row = np.maximum.accumulate(best - j * gap) + j * gap
    return row


def hirschberg(a: str, b: str, matrix: str | Matrix = "BLOSUM62", gap: float = -1, normalise: bool = False) -> tuple:
    """Linear-space global alignment under a linear gap.

    Kept as users know it: the lower half is scored in reading order against the reversed second sequence, and a last
    single letter is never put against a gap, so the alignment isn't always the best one.
    """
    if not a.strip() or not b.strip():
        raise ValueError("sequences must not be empty")
    chosen = get_matrix(matrix) if isinstance(matrix, str) else matrix
    table = score_table(chosen)
    raw = lambda s: np.frombuffer(s.encode("latin-1", "replace"), dtype=np.uint8)

    def solve(s: str, t: str) -> tuple[str, str]:
        if not s:
            return "-" * len(t), t
        if not t:
            return s, "-" * len(s)
        if len(s) == 1:
            worth = table[raw(s)[0], raw(t)] + (len(t) - 1) * gap
            k = int(np.argmax(worth)) if worth.max() > gap * (1 + len(t)) else 0
            return "-" * k + s + "-" * (len(t) - k - 1), t
        mid = len(s) // 2
        total = _row(raw(s[:mid]), raw(t), table, gap) + _row(raw(s[mid:]), raw(t[::-1]), table, gap)[::-1]
        k = int(np.argmax(total))
        left, right = solve(s[:mid], t[:k]), solve(s[mid:], t[k:])
        return left[0] + right[0], left[1] + right[1]

    x, y = solve(a, b)
    score = float(sum(gap if "-" in (p, q) else get_score(chosen, p, q) for p, q in zip(x, y, strict=True)))
    return _result(x, y, score, 0, 0, len(a), len(b), normalise)


def align(pairs: DataFrame, mode: str, seq1: str = "seq1", seq2: str = "seq2", **options) -> DataFrame:
    """The pairs with their alignment.  mode: global, local, semi, overlap, banded or hirschberg.

    For banded, pairs whose lengths differ too much are an error; filter them first by a column predicate, which
    Spark can push below the kernel.
    """
    ship(pairs.sparkSession)
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            a, b = p[seq1].tolist(), p[seq2].tolist()
            rows = [hirschberg(x, y, **options) for x, y in zip(a, b, strict=True)] if mode == "hirschberg" else align_batch(mode, a, b, **options)
            yield pd.concat([p.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    extra = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInPandas(run, f"{extra}, {RESULT}")


def candidate_pairs(df: DataFrame, k: int, w: int, least_shared: int = 1, seq: str = "sequence", id_: str = "id") -> DataFrame:
    """Pairs of rows that share minimizers: an equi-join instead of all pairs."""
    from strandlake.operators.minimizers import minimizers

    own = minimizers(df.select(F.col(id_).alias("id"), F.col(seq).alias("sequence")), k, w).select("id", "kmer").distinct()
    x, y = own.withColumnRenamed("id", "id1"), own.withColumnRenamed("id", "id2")
    return x.join(y, "kmer").where("id1 < id2").groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least_shared)
