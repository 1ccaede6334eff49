"""Windows of texts as numbers, for Arrow batches: pieces of a bounded size, codes that sort as the windows do."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Letters that are looked at together: a batch is dealt into pieces of about so many, whatever its rows are.
LETTERS = 1 << 20


def pieces(texts: list[str | None], span: int, letters: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Rows, where they are cut and the parts, together of about so many letters.

    A part begins `letters` after the one before it and goes on for all windows of `span` letters that begin within it,
    and a letter more where there is one.  Texts without a window are left out.
    """
    rows, begins, parts, total = [], [], [], 0
    for row, text in enumerate(texts):
        for begin in range(0, len(text or "") - span + 1, letters):
            part = text[begin : begin + letters + span]
            rows.append(row)
            begins.append(begin)
            parts.append(part)
            total += len(part)
            if total >= letters:
                yield rows, begins, parts
                rows, begins, parts, total = [], [], [], 0
    if rows:
        yield rows, begins, parts


def points(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def ranks(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Values as places among the distinct ones from 1, and how many there are with 0."""
    if values.dtype == np.uint32:  # code points
        there = np.flatnonzero(np.bincount(values))
        table = np.zeros(int(there[-1]) + 1 if len(there) else 1, dtype=np.int64)
        table[there] = np.arange(1, len(there) + 1)
        return table[values], len(there) + 1
    distinct, place = np.unique(values, return_inverse=True)
    return place.astype(np.int64) + 1, len(distinct) + 1


def window_codes(letters: np.ndarray, base: int, k: int) -> tuple[np.ndarray, int]:
    """A number for each window of k letters, and their bound; they sort as the windows do.  Letters are from 0 to base - 1."""
    n = max(len(letters) - k + 1, 0)
    codes, bound = letters[:n].astype(np.int64), base
    for i in range(1, k):
        if bound * base >= 1 << 62:
            codes, bound = ranks(codes)
        codes = codes * base + letters[i : i + n]
        bound *= base
    return codes, bound


def least_of_runs(values: np.ndarray, bound: int, w: int) -> np.ndarray:
    """Where the least value of each run of w stands, the first of equal ones; values are from 0 to bound - 1."""
    n = len(values)
    if bound * max(n, 1) >= 1 << 62:
        values, bound = ranks(values)
    least, width = values * n + np.arange(n), 1
    while width < w:
        step = min(width, w - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least % n
