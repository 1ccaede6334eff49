"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the bag of its letter n-grams within words (with word ends), each hashed into a bucket with an
embedding; their average goes through a linear layer and a softmax.  Both layers are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows.  A temperature fitted on
a held-aside part of the sample calibrates the probabilities; a prediction below the rejection threshold
found there is marked as not accepted.  For scoring, embeddings and layer collapse into one small table,
so that a whole text costs one gather per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm._spark import table, tune
from strandlake.llm._text import BLOCK, BYTE, LOWER, SPACE, blocks, buffers, splitmix

BUCKETS = 1 << 15
#: Labelled rows that a model is fitted on, at most; chosen by a hash of the key.
SAMPLE_ROWS = 6000
#: Bytes of their texts together, and of one text, at most; what a model is fitted on has to fit the driver.
SAMPLE_BYTES, LONGEST = 1 << 27, 1 << 18
ORDERS = (2, 3, 4)
_U = np.uint64
#: Letters stay; all else (but bytes of non-ASCII characters) separates words.
_FOLD = LOWER.copy()
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32
_EDGE = SPACE[_FOLD]


def ngrams(data: np.ndarray, offsets: np.ndarray, n_buckets: int = BUCKETS, until: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of each row and their bounds by row; with until, of those that start before that byte.
    n-grams of white space only don't count."""
    n = len(data)
    folded = _FOLD[data]
    edge = _EDGE[data]
    code = BYTE[folded]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out, owners = [], []
    value = code.copy()
    for k in range(2, max(ORDERS) + 1):
        if n < k:
            break
        value = value[: n - k + 1] * _U(0x9E3779B97F4A7C15) + code[k - 1 :]
        inner = edge[1 : n - k + 2].copy()
        for j in range(2, k - 1):
            inner |= edge[j : n - k + 1 + j]
        bad = edge[: n - k + 1] & edge[k - 1 :] if k == 2 else inner
        ok = ~bad & (row[: n - k + 1] == row[k - 1 :])
        if until is not None:
            ok[until:] = False
        if k in ORDERS:
            out.append((splitmix(value[ok]) >> _U(64 - int(n_buckets - 1).bit_length())).astype(np.int32))
            owners.append(row[: n - k + 1][ok])
    if not out:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    bucket, owner = np.concatenate(out), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    return bucket[order], np.concatenate([[0], np.cumsum(counts)])


@dataclass
class Model:
    labels: list[str]
    #: Temperature-scaled logits of each bucket: buckets x labels.
    table: np.ndarray
    bias: np.ndarray
    reject_below: float

    def scores(self, data: np.ndarray, offsets: np.ndarray, piece: int = BLOCK) -> np.ndarray:
        """Probabilities of the labels for each row.  A text longer than a piece, which `blocks` leaves alone, is summed
        piece by piece, so that memory doesn't grow with it."""
        if len(offsets) == 2 and len(data) > piece:
            total, n = np.zeros((1, len(self.labels))), 0
            for at in range(0, len(data), piece):
                part = data[at : at + piece + max(ORDERS) - 1]
                bucket, _ = ngrams(part, np.array([0, len(part)]), len(self.table), piece)
                total += self.table[bucket].sum(axis=0, dtype=np.float64)
                n += len(bucket)
            return softmax(total / max(n, 1) + self.bias)
        bucket, bounds = ngrams(data, offsets, len(self.table))
        total = np.zeros((len(offsets) - 1, len(self.labels)))
        n = np.diff(bounds)
        some = np.flatnonzero(n)
        if len(some):
            total[some] = np.add.reduceat(self.table[bucket], bounds[:-1][some], axis=0, dtype=np.float64) / n[some, None]
        return softmax(total + self.bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], width: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 5, target: float = 0.99) -> Model:
    """Trains on nine tenths of the rows and calibrates on the rest.

    The rejection threshold is the least probability at and above which the calibration rows are right in
    a share of at least `target`.  With no rows at all the model knows the label `und` only.
    """
    names = sorted(set(labels))
    if not names:
        return Model(["und"], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0)
    y = np.array([names.index(x) for x in labels])
    bags = []
    for t in texts:
        raw = np.frombuffer(t.encode(), dtype=np.uint8)
        b, _ = ngrams(raw, np.array([0, len(raw)]))
        bags.append(np.unique(b, return_counts=True))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 10], order[len(y) // 10 :]
    E = rng.uniform(-1, 1, (BUCKETS, width)) / width
    W, b = np.zeros((width, len(names))), np.zeros(len(names))
    steps, done = max(1, epochs * len(train)), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            ids, counts = bags[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            share = (counts / counts.sum())[:, None]
            x = (E[ids] * share).sum(axis=0)
            z = x @ W + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = W @ p
            W -= lr * np.outer(x, p)
            b -= lr * 0.01 * p
            E[ids] -= lr * share * back * min(len(ids), 64)
    table_ = E @ W
    z = np.array([(table_[ids] * (c / max(1, c.sum()))[:, None]).sum(axis=0) + b for ids, c in (bags[i] for i in held)]).reshape(-1, len(names))
    grid = np.geomspace(0.25, 16, 40)
    loss = [-np.log(np.clip(softmax(z * t)[np.arange(len(held)), y[held]], 1e-9, 1)).mean() if len(held) else -t for t in grid]
    scale = float(grid[int(np.argmin(loss))]) if len(held) else 1.0
    p = softmax(z * scale) if len(held) else np.zeros((0, len(names)))
    best, right = p.max(axis=1, initial=0), p.argmax(axis=1) == y[held] if len(held) else np.zeros(0, bool)
    down = np.argsort(-best, kind="stable")
    good = np.flatnonzero(np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= target) if len(down) else []
    return Model(names, (table_ * scale).astype(np.float32), b * scale, float(best[down[good[-1]]]) if len(good) else 1.0)


def held_out(key: Column) -> Column:
    """crc32 of the key as text, modulo 4, is 2; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded(sample: DataFrame, by: Column, most: int = SAMPLE_BYTES, longest: int = LONGEST) -> DataFrame:
    """Rows of a sample (at most some thousand) in order of `by` for as long as their texts are `most` bytes together;
    single texts above `longest` bytes are passed over."""
    sized = sample.withColumn("_n", F.octet_length("text")).where(F.col("_n") <= longest)
    return sized.withColumn("_n", F.sum("_n").over(Window.orderBy(by, "doc_id"))).where(F.col("_n") <= most).drop("_n")


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on the `rows` documents of least key hash among those with a text, a label, and a key that isn't held out.

    Rows that share a key are one, that of the least label and text.  The sample is bounded in bytes too.
    """
    pool = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    keys = pool.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    once = pool.join(F.broadcast(keys), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x")).select("doc_id", "x.*")
    sample = bounded(once, F.xxhash64("doc_id")).toPandas().sort_values(["doc_id", "lang", "text"])
    return fit(sample["text"].tolist(), sample["lang"].tolist())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of every row.

    Null texts and texts without a letter of any script get `und`, score 0 and no acceptance.  Long texts are
    read whole; repeated rows get equal values; ties go to the label that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.labels, dtype=object)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            parts = [m.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets)]
            p = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[p.argmax(axis=1)], pa.string()), pa.array(p.max(axis=1, initial=0)), batch.column(2)], names=["doc_id", "lang_pred", "score", "letters"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")).mapInArrow(score, f"doc_id {kind}, lang_pred string, score double, letters boolean")
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), F.least(F.col("score"), F.lit(1.0))).otherwise(0.0).alias("score"),
        (F.col("letters") & (F.col("score") >= model.reject_below)).alias("accepted"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of the rows that aren't held out."""
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, train(docs))
