"""Quality classification: hashed word n-gram logistic regression, trained with the follow-the-regularised-
leader (FTRL-proximal) rule and scored as sparse dot products.

Words are runs of letters or digits, or runs of one other character, lower-cased.  The n-grams are single words,
pairs of neighbours, and backed-off pairs and triples in which a word is replaced by its form (letters, digits or
the very mark) and a repeat of the word before by a repeat sign; these carry over to texts of unseen words.
The features of a text are its hashed n-grams weighted by frequency and scaled to length one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm._spark import table, tune
from strandlake.llm._text import BYTE, LOWER, blocks, buffers, places, splitmix, stream
from strandlake.llm.langid import bounded, held_out

BITS = 18
#: Labelled rows that a model is fitted on, at most; chosen by a hash of the key.
SAMPLE_ROWS = 8_000
#: A score at or above it is quality 1.
THRESHOLD = 0.7
_U = np.uint64
_FORM = np.zeros(256, dtype=np.uint8)  # 0: white space, 1: letters, 2: digits, else the very mark
_FORM[[i for i in range(33, 127)]] = [i for i in range(33, 127)]
_FORM[[i for i in range(128) if chr(i).isalpha()] + list(range(128, 256))] = 1
_FORM[[i for i in range(128) if chr(i).isdigit()]] = 2
_MIX = stream(11, 16)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, form, byte length and row of each token."""
    n = len(data)
    form = _FORM[data]
    start = np.ones(n, dtype=bool)
    start[1:] = form[1:] != form[:-1]
    start[offsets[:-1][offsets[:-1] < n]] = True
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, n))
    place = np.arange(n) - np.repeat(at, size)
    h = splitmix(np.add.reduceat(BYTE[LOWER[data]] * places(int(size.max()))[place], at))
    rows = np.searchsorted(offsets, at, side="right") - 1
    keep = form[at] > 0
    return h[keep], form[at][keep], size[keep], rows[keep]


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, their weights, and bounds by row: a sparse row of unit length per text."""
    n_rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(n_rows + 1, np.int64)
    h, form, size, row = _tokens(data, offsets)
    shape = form.astype(_U) * _MIX[0] + np.minimum(size, 4).astype(_U) * (form > 2) * _MIX[1]
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    same[2:] |= (h[2:] == h[:-2]) & (row[2:] == row[:-2])
    shape = np.where(same, shape + _MIX[2], shape)
    out, owner = [h, shape + _MIX[3]], [row, row]
    for values, seed, k in ((h, 4, 2), (shape, 5, 2), (shape, 6, 3), (shape, 7, 5)):
        if len(values) < k:
            continue
        mixed = np.full(len(values) - k + 1, _MIX[seed], dtype=_U)
        for i in range(k):
            mixed = (mixed ^ values[i : len(values) - k + 1 + i]) * _MIX[8 + i]
            mixed ^= mixed >> _U(29)
        ok = row[: len(mixed)] == row[k - 1 :]
        out.append(mixed[ok])
        owner.append(row[: len(mixed)][ok])
    bucket = (splitmix(np.concatenate(out)) >> _U(64 - bits)).astype(np.int64)
    key = np.concatenate(owner).astype(np.int64) << bits | bucket
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    rows = key >> bits
    weight = np.sqrt(count.astype(float))
    norm = np.sqrt(np.bincount(rows, weights=weight * weight, minlength=n_rows))
    return key & ((1 << bits) - 1), weight / norm[rows], np.searchsorted(rows, np.arange(n_rows + 1))


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ids, x, bounds = features(data, offsets)
        n = len(offsets) - 1
        rows = np.repeat(np.arange(n), np.diff(bounds))
        z = np.bincount(rows, weights=self.weight[ids] * x, minlength=n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(texts: list[str], labels: list[int], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 3) -> Model:
    """FTRL-proximal with per-coordinate rates, one text at a time.  Without rows, every score is one half."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows = []
    for r in (t.encode() for t in texts):
        ids, x, _ = features(np.frombuffer(r, dtype=np.uint8), np.array([0, len(r)]))
        rows.append((np.append(ids, size).astype(np.int32), np.append(x, 1.0).astype(np.float32)))

    def weights(ids: np.ndarray | slice) -> np.ndarray:
        zi = z[ids]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[ids])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, x = rows[i]
            w = weights(ids)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[i]) * x
            old = n[ids]
            new = old + g * g
            z[ids] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[ids] = new
    w = weights(slice(None))
    return Model(w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on the `rows` labelled rows of least key hash that aren't held out; their texts are read whole.

    Rows that share a key are one, that of the least text.  The sample is bounded in bytes too.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    pool = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    once = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(pool), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return fit_sample(bounded(once, F.xxhash64("doc_id")))


def fit_sample(sample: DataFrame) -> Model:
    """Fits on the bounded sample (doc_id, text, quality) in one task: the driver gets the model only, not the texts and
    their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if any(b.num_rows for b in parts):
            rows = pa.Table.from_batches(parts).to_pandas().sort_values(["doc_id", "text"])
            m = fit(rows["text"].tolist(), rows["quality"].tolist())
            yield pa.RecordBatch.from_arrays([pa.array([m.weight.tobytes()]), pa.array([m.bias])], names=["weight", "bias"])

    found = sample.select("doc_id", "text", "quality").coalesce(1).mapInArrow(run, "weight binary, bias double").first()
    return Model(np.frombuffer(found.weight), found.bias) if found else fit([], [])


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """Adds the score to every row, whatever its other columns.

    Null and empty texts get the score of no features at all, the bias; repeated rows get equal scores; an
    empty table gives no rows.  A column named like the added one is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(column)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            parts = [m.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, docs.withColumn(column, F.lit(0.0)).schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, by a model of the labelled rows that aren't held out."""
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    # The digest needs the key and the score; the texts aren't sent back from the workers.
    return score_keys(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def score_keys(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, as `score` gives them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            parts = [m.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
