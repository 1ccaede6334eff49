"""BPE encoding and decoding as streaming transducers.

Encoding reads a text through a window, cuts it into pre-tokens, and merges each pre-token's bytes in order of
rank.  From the merge list alone follows a sufficient lookahead: bytes further to the right cannot change a token.
So a token is emitted once that many bytes after it are known, and no more than the window and a buffer is kept,
however long a text or a pre-token is.  Decoding is a state machine from token bytes to text whose state is the
unfinished character.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm._spark import table

#: Fixed: how the byte-level pre-tokenizer splits text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text that are split at a time, and bytes of a pre-token that are merged at a time.
WINDOW, BUFFER = 1 << 15, 512
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 1 << 18


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the
    rest in order from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Token ids, token bytes, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        raw = lambda s: bytes(back[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {i: raw(s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))
        self.byte_ids = [vocab[c] for c in byte_alphabet()]
        self.lookahead = sufficient_lookahead(self.rank, {i: len(b) for i, b in self.bytes_of.items()})


def sufficient_lookahead(rank: dict[tuple[int, int], tuple[int, int]], length: dict[int, int]) -> int | None:
    """Bytes after a token's end that can bear on it at most; None if the list gives no bound.

    reach[t] bounds how far beyond its end the making of t may depend on.  t = x + y is made where y is made and
    is not taken by a merge (y, z) of lower rank first, for which z must be made; where x is made; and where x is
    not taken by a merge (w, x) of lower rank.  The bound is a fixed point over the list in order of rank.
    """
    reach = dict.fromkeys(length, 0)
    ordered = sorted((r, x, y, t) for (x, y), (r, t) in rank.items())
    for _ in range(8):
        changed = False
        right: dict[int, int] = {}  # of x: the furthest that a merge (x, z) seen so far looks
        left: dict[int, int] = {}  # of x: the furthest that a w of a merge (w, x) seen so far looks
        for _, x, y, t in ordered:
            far = max(reach[y], right.get(y, 0), reach[x] - length[y], left.get(x, 0) - length[x] - length[y], 0)
            if far > reach[t]:
                reach[t], changed = far, True
            right[x] = max(right.get(x, 0), length[y] + reach[y])
            left[y] = max(left.get(y, 0), reach[x])
        if not changed:
            return max([0, *reach.values(), *right.values(), *left.values()])
    return None


class Encoder:
    """Text to ids.  `remember` bounds the pre-tokens kept; it changes speed only."""

    def __init__(self, vocabulary: Vocabulary, window: int = WINDOW, buffer: int = BUFFER, remember: int = REMEMBERED):
        self.v, self.window, self.buffer, self.remember = vocabulary, window, buffer, remember
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")").split if vocabulary.special else lambda s: [s]
        encoder = self

        class Known(dict):
            def __missing__(self, piece: str) -> tuple[int, ...]:
                ids = tuple(encoder.stream(piece.encode()))
                if len(piece) <= 64:
                    if len(self) >= encoder.remember:
                        self.clear()
                    self[piece] = ids
                return ids

        self.known = Known()

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens, a window at a time.  What follows a window can change its last two pre-tokens (a longer
        word, a space kept for the next word, a contraction), so these are read again with the next window."""
        at, size = 0, self.window
        while at < len(text):
            found = self.split(text[at : at + size])
            if at + size >= len(text):
                yield found
                return
            if len(found) <= 2:
                size *= 2
                continue
            at += sum(map(len, found[:-2]))
            size = self.window
            yield found[:-2]

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, in lists."""
        for i, part in enumerate(self.cut(text)):
            if i % 2:
                yield [self.v.special[part]]
            else:
                for found in self.pieces(part):
                    yield list(chain.from_iterable(map(self.known.__getitem__, found)))

    def stream(self, data: bytes) -> Iterator[int]:
        """The tokens of a pre-token, each as soon as it is stable."""
        ahead = self.v.lookahead
        if ahead is None or len(data) <= self.buffer + ahead:
            yield from self.merge(data)
            return
        at = 0
        while len(data) - at > self.buffer + ahead:
            end = at + self.buffer + ahead
            stable, before = end - ahead, at
            for t in self.merge(data[at:end]):
                n = len(self.v.bytes_of[t])
                if at + n > stable:
                    break
                yield t
                at += n
            if at == before:  # no token is longer than a buffer
                raise ValueError("buffer shorter than a token")
        yield from self.merge(data[at:])

    def merge(self, data: bytes) -> list[int]:
        """The tokens of a byte string: the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.v.byte_ids[b] for b in data]
        rank = self.v.rank
        if len(ids) < 2:
            return ids
        if len(ids) <= 24:
            while True:
                best, at, made = 1 << 60, -1, -1
                for i in range(len(ids) - 1):
                    m = rank.get((ids[i], ids[i + 1]))
                    if m is not None and m[0] < best:
                        best, at, made = m[0], i, m[1]
                if at < 0:
                    return ids
                ids[at : at + 2] = [made]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := rank.get((ids[i], ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (m := rank.get((ids[before[i]], ids[i]))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], ids[i]))
        return [t for t in ids if t >= 0]


class Decoder:
    """Ids to text, a run of ids at a time; the state is the bytes of an unfinished character."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of.__getitem__
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of, ids)))

    def end(self) -> str:
        """The rest; an unfinished character becomes the replacement character."""
        text = self.machine.decode(b"", True)
        self.machine.reset()
        return text


def runs(ids: Iterable[list[int]], size: int = 8192) -> Iterator[list[int]]:
    flat = chain.from_iterable(ids)
    while part := list(islice(flat, size)):
        yield part


@functools.lru_cache(1)
def _loaded(source: bytes) -> tuple[Vocabulary, Encoder, dict[int, str]]:
    v = Vocabulary(source)
    return v, Encoder(v), {i: str(i) for i in v.bytes_of}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def tokenize(docs: DataFrame, path: str | None = None, keep_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, number of tokens, digests of the ids and of the decoded text, and with keep_ids the ids, of each row.

    Null text is empty: no tokens, and digests of nothing.  Special tokens within a text are those tokens.
    Repeated rows and null keys give a row each; an empty table gives no rows; extra columns are left out.
    """
    with open(path or default_path(), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, encoder, name = _loaded(shared.value)
        for batch in batches:
            counts, hashes, back, kept = [], [], [], []
            for value in batch.column(1):
                n, digest, decoded, machine = 0, hashlib.sha256(), hashlib.sha256(), Decoder(v)
                own = []
                for ids in runs(encoder.encode(value.as_py() or "")):
                    digest.update((("," if n else "") + ",".join(map(name.__getitem__, ids))).encode())
                    decoded.update(machine.feed(ids).encode())
                    n += len(ids)
                    if keep_ids:
                        own += ids
                decoded.update(machine.end().encode())
                counts.append(n)
                hashes.append(digest.hexdigest())
                back.append(decoded.hexdigest())
                kept.append(own)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, names=["k", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, {DIGEST}" + ", ids array<int>" * keep_ids
    return docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(run, schema).withColumnRenamed("k", key)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text encoded and decoded."""
    return tokenize(table(spark, sf_dir, "documents"))
