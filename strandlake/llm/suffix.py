"""Removal of repeated passages with suffix arrays made by induced sorting.

A window is a string of `size` bytes of one document; it is removed where an equal one starts earlier.  Every window
is assigned to one anchor, the leftmost of its k-grams of least hash, so equal windows have equal anchors at
equal places.  A segment is the run of windows of one anchor.  Anchors that occur once need nothing.  Where all
segments of an anchor are equal, the first keeps its windows.  Where an anchor has several contexts, each distinct
segment is taken once; shards of them get a suffix array by induced sorting, and runs of neighbours whose
common prefix (computed in text order, the permuted LCP) covers a window are equal windows.  An anchor
with very many contexts is spread over several shards, whose distinct windows then meet in one more aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm._spark import Scratch, table
from strandlake.llm._text import BYTE, blocks, buffers, splitmix, stream

SIZE = 100
#: Bytes of segments that a shard holds on average.
SHARD_BYTES = 1 << 20
#: Contexts of an anchor beyond which it is spread over shards.
SPREAD = 2048
#: Largest alphabet whose induction goes bucket by bucket; above it the reduced string is sorted by rank doubling.
ALPHABET = 512
_U = np.uint64
_C = stream(31, 64)


# Suffix arrays


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next (S); the last one is."""
    n = len(t)
    step = np.sign(np.diff(t))
    turns = np.flatnonzero(step)
    out = np.ones(n, dtype=bool)
    at = np.searchsorted(turns, np.arange(n - 1))
    last = at == len(turns)
    out[:-1] = np.where(last, False, step[turns[np.minimum(at, len(turns) - 1)]] > 0) if len(turns) else False
    return out


def _append(sa: np.ndarray, front: np.ndarray, items: np.ndarray, letters: np.ndarray, way: int) -> None:
    """Puts items, in order, at the fronts of their letters' buckets, which move by `way`."""
    order = np.argsort(letters, kind="stable")
    letters, items = letters[order], items[order]
    first = np.flatnonzero(np.append(True, letters[1:] != letters[:-1]))
    count = np.diff(np.append(first, len(letters)))
    within = np.arange(len(letters)) - np.repeat(first, count)
    sa[front[letters] + way * within] = items
    front[letters[first]] += way * count


def _induce(t: np.ndarray, small: np.ndarray, start: np.ndarray, stop: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the order of the leftmost-smaller suffixes, `lms`.

    Buckets are scanned in order; what a bucket induces goes to the fronts of others all at once, and what it
    induces into itself makes its next wave.
    """
    n, k = len(t), len(start)
    sa = np.full(n, -1, dtype=np.int64)
    letters = t[lms]
    order = np.argsort(letters, kind="stable")
    by_letter, bounds = lms[order], np.searchsorted(letters[order], np.arange(k + 1))
    head = start.copy()
    for c in range(k):
        at = start[c]
        while at < head[c]:
            wave = sa[at : head[c]]
            at = head[c]
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            if len(before):
                _append(sa, head, before, t[before], 1)
        wave = by_letter[bounds[c] : bounds[c + 1]]
        before = wave[wave > 0] - 1
        if len(before):
            _append(sa, head, before, t[before], 1)
    tail = stop - 1
    for c in range(k - 1, -1, -1):
        # The S part of the bucket, from its end; then its L part.
        at = stop[c] - 1
        while at > tail[c]:
            wave = sa[tail[c] + 1 : at + 1][::-1]
            at = tail[c]
            before = wave[wave > 0] - 1
            before = before[small[before]]
            if len(before):
                _append(sa, tail, before, t[before], -1)
        wave = sa[start[c] : head[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[small[before]]
        if len(before):
            _append(sa, tail, before, t[before], -1)
    sa[0] = n - 1
    return sa


def _doubling(t: np.ndarray) -> np.ndarray:
    """Suffix array by doubling the sorted prefix; few rounds, as repeats within a shard are short."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        sa = np.argsort(key, kind="stable")
        ordered = key[sa]
        new = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        rank = np.empty(n, dtype=np.int64)
        rank[sa] = new
        if new[-1] == n - 1:
            return sa
        step *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of integers >= 0 whose last is 0 and the only 0."""
    t = t.astype(np.int64)
    n, k = len(t), int(t.max()) + 1
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    small = _types(t)
    counts = np.bincount(t, minlength=k)
    stop = np.cumsum(counts)
    start = stop - counts
    first = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(first) < 2:
        return _induce(t, small, start, stop, first)
    sa = _induce(t, small, start, stop, first)
    is_first = np.zeros(n, dtype=bool)
    is_first[first] = True
    order = sa[is_first[sa]]
    # Names: neighbours in this order are equal if they are equally long and agree up to and with the next one.
    size = np.zeros(n, dtype=np.int64)
    size[first] = np.diff(np.append(first, n)) + 1
    size[n - 1] = 1
    same = size[order[1:]] == size[order[:-1]]
    alive, offset = np.flatnonzero(same), 0
    while len(alive):
        a, b = order[alive] + offset, order[alive + 1] + offset
        inside = offset < size[order[alive]]
        alive, a, b = alive[inside], a[inside], b[inside]
        ok = t[a] == t[b]
        same[alive[~ok]] = False
        alive = alive[ok]
        offset += 1
    name = np.empty(n, dtype=np.int64)
    name[order] = np.cumsum(np.append(0, ~same))
    reduced = name[first]
    distinct = int(reduced.max()) + 1
    if distinct == len(first):
        lms = order
    else:
        inner = suffix_array(reduced) if distinct <= ALPHABET else _doubling(reduced)
        lms = first[inner]
    return _induce(t, small, start, stop, lms)


def permuted_lcp(text: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the text, the place before it in the suffix array (-1: none) and their common prefix, up to `most`.

    Eight bytes at a time, on all places that still agree.
    """
    n = len(text)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate([text.astype(_U), np.zeros(16 + most, _U)])
    eight = padded[: n + most].copy()
    for j in range(1, 8):
        eight = (eight << _U(8)) | padded[j : j + n + most]
    out = np.zeros(n, dtype=np.int64)
    alive = np.flatnonzero(phi >= 0)
    for at in range(0, most, 8):
        x = eight[alive + at] ^ eight[phi[alive] + at]
        stop = x != 0
        ended = alive[stop]
        lead = np.zeros(len(ended), dtype=np.int64)
        v = x[stop]
        for j in range(8):
            lead += (lead == j) & ((v >> _U(56 - 8 * j)) & _U(255) == 0)
        out[ended] = at + lead
        alive = alive[~stop]
    out[alive] = most
    return phi, np.minimum(out, most)


def equal_windows(segments: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, segment and place of every window of the segments; equal windows share a group."""
    lengths = np.array([len(s) for s in segments])
    text = np.frombuffer(b"\0".join(segments) + b"\0", dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    # Letters are ranked without gaps; separators are 1, bytes from 2, and one 0 ends the text.
    parted = text.astype(np.int64) + 2
    parted[begin + lengths] = 1
    letters = np.unique(parted)
    rank = np.zeros(int(letters[-1]) + 1, dtype=np.int64)
    rank[letters] = np.arange(1, len(letters) + 1)
    t = np.append(rank[parted], 0)
    sa = suffix_array(t)[1:]
    _, lcp = permuted_lcp(t[:-1].astype(np.uint16), sa, size) if len(letters) < 255 else permuted_lcp_wide(t[:-1], sa, size)
    segment = np.repeat(np.arange(len(segments)), lengths + 1)
    place = np.arange(len(text)) - begin[segment]
    whole = place + size <= lengths[segment]
    ordered = sa[whole[sa]]
    # Places between two equal windows in the suffix array are equal windows too, so neighbours decide.
    group = np.cumsum(np.where(lcp[ordered] >= size, 0, 1)) - 1
    return group, segment[ordered], place[ordered]


def permuted_lcp_wide(t: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """As permuted_lcp, for letters beyond a byte: two bytes a letter."""
    pairs = np.stack([t >> 8, t & 255], axis=1).astype(np.uint8).ravel()
    wide = np.stack([2 * sa, 2 * sa + 1], axis=1).ravel()
    n = len(t)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    both = np.full(2 * n, -1, dtype=np.int64)
    both[::2] = np.where(phi >= 0, 2 * phi, -1)
    del wide
    padded = np.concatenate([pairs.astype(_U), np.zeros(16 + 2 * most, _U)])
    out = np.zeros(n, dtype=np.int64)
    alive = np.flatnonzero(phi >= 0)
    for at in range(most):
        same = (padded[2 * alive + 2 * at] == padded[2 * phi[alive] + 2 * at]) & (padded[2 * alive + 2 * at + 1] == padded[2 * phi[alive] + 2 * at + 1])
        out[alive[~same]] = at
        alive = alive[same]
    out[alive] = most
    return phi, out


# Anchors


def gram_size(size: int) -> int:
    k = 1
    while k * 3 <= size:
        k *= 2
    return min(k, 32)


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    h = BYTE[data]
    m = 1
    while m < k:
        left = h[:-m] * _C[m.bit_length()]
        left ^= left >> _U(32)
        h = left + h[m:]
        m *= 2
    return splitmix(h)


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    m, width = h, 1
    while width * 2 <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(h) - w + 1], m[w - width : w - width + len(h) - w + 1]) if width < w else m


def anchors(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, segment hash, row, first and last window start, and anchor, of every segment of the rows."""
    none = (np.zeros(0, _U), np.zeros(0, _U), *(np.zeros(0, np.int64) for _ in range(4)))
    lengths = np.diff(offsets)
    long = lengths >= size
    if not long.any():
        return none
    k = gram_size(size)
    w = size - k + 1
    h = _gram_hashes(data, k)
    least = _sliding_min(h, w)
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - size + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    value = least[starts]
    new = np.append(True, (np.diff(starts) != 1) | (value[1:] != value[:-1]))
    first = np.flatnonzero(new)
    lo, hi = starts[first], starts[np.append(first[1:], len(starts)) - 1]
    at = lo + np.argmax(h[lo[:, None] + np.arange(w)] == least[lo][:, None], axis=1)
    tied = np.flatnonzero(hi > at)
    if len(tied):
        more = [[], [], []]
        for i in tied:
            found = lo[i] + np.flatnonzero(h[lo[i] : hi[i] + w] == least[lo[i]])
            begin = np.append(lo[i], found[:-1] + 1)
            ok = begin <= hi[i]
            more[0].append(begin[ok])
            more[1].append(np.minimum(found[ok], hi[i]))
            more[2].append(found[ok])
        rest = np.ones(len(lo), dtype=bool)
        rest[tied] = False
        lo, hi, at = (np.concatenate([x[rest], *m]) for x, m in zip((lo, hi, at), more, strict=True))

    def window(p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), dtype=_U)
        for j, o in enumerate([*range(0, size - k, k), size - k]):
            out = splitmix((out ^ h[p + o]) * _C[8 + j % 48])
        return out

    segment = splitmix(window(lo) * _C[60] + window(hi) * _C[61] + (hi - lo).astype(_U) * _C[62] + (at - lo).astype(_U) * _C[63])
    return h[at], segment, np.searchsorted(offsets, lo, side="right") - 1, lo, hi, at


# Spark


def _anchor_rows(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in blocks(offsets):
                o = offsets[i : j + 1] - offsets[i]
                a, s, row, lo, hi, _ = anchors(data[offsets[i] : offsets[j]], o, size)
                order = np.lexsort((lo, s, a, row))
                a, s, row, lo, hi = a[order], s[order], row[order], lo[order], hi[order]
                # A segment that stands earlier in its own document is settled here: its windows go.
                again = np.append(False, (row[1:] == row[:-1]) & (a[1:] == a[:-1]) & (s[1:] == s[:-1]))[: len(row)]
                r, x, y = row[again], lo[again], hi[again]
                by_place = np.argsort(x, kind="stable")
                r, x, y = r[by_place], x[by_place], y[by_place]
                edge = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (x[1:] != y[:-1] + 1))) if len(r) else np.zeros(0, np.int64)
                last = np.append(edge[1:], len(r))[: len(edge)] - 1
                a, s = np.append(a[~again], np.zeros(len(edge), _U)), np.append(s[~again], np.zeros(len(edge), _U))
                row, lo, hi = np.append(row[~again], r[edge]), np.append(lo[~again], x[edge]), np.append(hi[~again], y[last])
                settled = np.append(np.zeros(len(row) - len(edge), dtype=bool), np.ones(len(edge), dtype=bool))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), pa.array(ids[i:j][row].astype(np.int64)), pa.array((lo - o[row]).astype(np.int32)), pa.array((hi - o[row]).astype(np.int32)), pa.array(settled)], names=["a", "s", "doc_id", "lo", "hi", "settled"])

    texts = docs.where("doc_id IS NOT NULL AND octet_length(text) >= " + str(size)).select("doc_id", "text")
    return texts.mapInArrow(run, "a long, s long, doc_id long, lo int, hi int, settled boolean")


def _segments(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """a, s, doc_id, lo and bytes of the wanted segments (a, s, doc_id, lo, hi)."""
    listed = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("a", "s", "lo", "hi")).alias("segments"))  # of one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, segments in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows += [(x["a"], x["s"], doc, x["lo"], text[x["lo"] : x["hi"] + size]) for x in segments]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["a", "s", "doc_id", "lo", "bytes"])

    return docs.select("doc_id", "text").dropna().join(listed, "doc_id").mapInArrow(run, "a long, s long, doc_id long, lo int, bytes binary")


def _digests(segments: list[bytes], segment: np.ndarray, place: np.ndarray, size: int) -> list[bytes]:
    return [hashlib.blake2b(segments[i][p : p + size], digest_size=16).digest() for i, p in zip(segment, place, strict=True)]


def _resolve(shards: DataFrame, size: int) -> DataFrame:
    """Window starts that repeat an earlier one of their shard (digest null), and for spread anchors the first of each
    distinct window with its digest."""

    def run(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        segments = rows["bytes"].tolist()
        group, segment, place = equal_windows(segments, size)
        doc, start = rows["doc_id"].to_numpy()[segment], rows["lo"].to_numpy()[segment].astype(np.int64) + place
        spread = rows["spread"].to_numpy()[segment]
        order = np.lexsort((start, doc, group))
        first = np.append(True, group[order][1:] != group[order][:-1])
        gone = order[~first]
        # The same start of a document may stand in a shard once only, so all but the first of a group go.
        lead = order[first][spread[order[first]]]
        gone = gone[np.lexsort((start[gone], doc[gone]))]
        d, s = doc[gone], start[gone]
        edge = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1))) if len(d) else np.zeros(0, np.int64)
        last = np.append(edge[1:], len(d))[: len(edge)] - 1
        out = pd.DataFrame({"doc_id": d[edge], "lo": s[edge], "hi": s[last], "digest": None})
        return pd.concat([out, pd.DataFrame({"doc_id": doc[lead], "lo": start[lead], "hi": start[lead], "digest": _digests(segments, segment[lead], place[lead], size)})]) if len(lead) else out

    return shards.groupBy("shard", "salt").applyInPandas(run, "doc_id long, lo int, hi int, digest binary")


def repeated_starts(docs: DataFrame, size: int = SIZE, scratch: Scratch | None = None, shard_bytes: int = SHARD_BYTES, spread: int = SPREAD) -> DataFrame:
    """doc_id and inclusive ranges lo..hi of the window starts that an equal window precedes."""
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.write(_anchor_rows(docs, size), "anchors")
    within = scratch.write(rows.where("settled").select("doc_id", "lo", "hi"), "within")
    every = rows.where("NOT settled").drop("settled")
    often = every.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a")
    shared = scratch.write(every.join(often, "a"), "shared")
    scratch.drop("anchors")
    of_anchor = shared.groupBy("a").agg((F.min("s") != F.max("s")).alias("many"), F.min(F.struct("doc_id", "lo")).alias("first"))
    marked = shared.join(of_anchor, "a")
    later = F.struct("doc_id", "lo") > F.col("first")
    alike = marked.where(~F.col("many") & later).select("doc_id", "lo", "hi")
    mixed = scratch.write(marked.where("many").drop("many", "first"), "mixed")
    of_segment = mixed.groupBy("a", "s").agg(F.min(F.struct("doc_id", "lo", "hi")).alias("first"))
    again = mixed.join(of_segment, ["a", "s"]).where(F.struct("doc_id", "lo") > F.struct("first.doc_id", "first.lo")).select("doc_id", "lo", "hi")
    wanted = of_segment.select("a", "s", "first.*")
    segments = scratch.write(_segments(docs, wanted, size), "segments")
    total = segments.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    hot = segments.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > spread).select("a", F.ceil(F.col("c") / spread).cast("int").alias("salts"))
    dealt = segments.join(hot, "a", "left").withColumn("spread", F.col("salts").isNotNull())
    dealt = dealt.withColumn("shard", F.when(F.col("spread"), F.col("a")).otherwise(F.pmod(F.xxhash64("a"), F.lit(shards)))).withColumn("salt", F.when(F.col("spread"), F.pmod(F.xxhash64("s"), F.col("salts"))).otherwise(-1).cast("int"))
    found = scratch.write(_resolve(dealt.select("shard", "salt", "doc_id", "lo", "bytes", "spread"), size), "found")
    leads = found.where("digest IS NOT NULL")
    least = leads.groupBy("digest").agg(F.min(F.struct("doc_id", "lo")).alias("first"))
    across = leads.join(least, "digest").where(F.struct("doc_id", "lo") > F.col("first")).select("doc_id", "lo", "hi")
    return within.unionByName(alike).unionByName(again).unionByName(found.where("digest IS NULL").select("doc_id", "lo", "hi")).unionByName(across)


def remove_repeats(docs: DataFrame, size: int = SIZE, keep_text: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row; with keep_text also the other columns and the
    text that is left (bytes of a character cut in two are left out).

    Null text is empty; shorter texts than a window lose nothing.  doc_id names a document: rows that share one are taken
    to share its text, and aren't repeats of each other.  A row without doc_id can't be ordered: it loses nothing and
    nothing is lost to it.  An empty table gives no rows; columns named like the added ones are replaced.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    starts = repeated_starts(docs, size, scratch, **options)
    ranges = scratch.write(starts.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges")  # of one document
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    own = [c for c in docs.columns if c not in (*added, "ranges")] if keep_text else ["doc_id", "text"]
    at, kept_at = own.index("text"), [i for i, c in enumerate(own) if keep_text or c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, texts = [], []
            bounds = batch.column(len(own))
            for i, value in enumerate(batch.column(at).cast(pa.large_binary()).to_pylist()):
                raw = value or b""
                removed, spans, kept = 0, 0, raw
                if bounds[i].is_valid:
                    r = bounds[i].values
                    cover = np.zeros(len(raw) + 1, dtype=np.int32)
                    np.add.at(cover, np.minimum(r.field("lo").to_numpy(), len(raw)), 1)
                    np.add.at(cover, np.minimum(r.field("hi").to_numpy() + size, len(raw)), -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                out.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
                texts.append(None if value is None else kept.decode("utf-8", "ignore") if removed else value.decode())
            columns = [pa.array(texts, pa.string()) if j == at else batch.column(j) for j in kept_at]
            new = list(zip(*out, strict=True)) if out else [[]] * 4
            columns += [pa.array(c, k) for c, k in zip(new, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[own[j] for j in kept_at] + added)

    kept = docs.select(*own).drop(*([] if keep_text else ["text"]))
    schema = kept.withColumns({"n_bytes": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept_sha256": F.lit("")}).schema
    return docs.select(*own).join(ranges, "doc_id", "left").select(*own, "ranges").mapInArrow(run, schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses as repeats of 100 bytes that start earlier, and a digest of what it keeps."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
