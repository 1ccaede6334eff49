"""The stages of the corpus pipeline."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from test_ngram_join import brute as join_brute

import corpus_pipeline
from strandlake.llm import mixing, quality
from strandlake.llm.bpe import default_path

tokenizers = pytest.importorskip("tokenizers")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("value", [0.31, 0.5, 0.69, 0.71])
def test_quality_stage_rejects_what_the_classifier_rejects(spark, monkeypatch, value):
    """With a model that gives every text the same score: all stay or all go, as op6 decides; null texts go."""
    model = quality.Model(np.zeros(1 << quality.BITS), math.log(value / (1 - value)))
    monkeypatch.setattr(corpus_pipeline, "train", lambda docs, labels: model)
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: None)
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, None, "en", "s", 0), (None, "", None, None, 0)], COLUMNS)
    got = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, "").collect()}
    assert got == ({1, None} if value >= quality.THRESHOLD else set())


# Plain versions of the stages: lists of (doc_id, text, lang, source, n_chars) in, the same out


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=str)


def plain_near_duplicates(rows):
    component = {i: c for i, _, c in join_brute({r[0]: r[1] for r in rows if r[0] is not None}.items())}
    out = {r[0]: r for r in rows if r[0] is not None and component[r[0]] == r[0]}
    return sorted([*out.values(), *{r[1]: r for r in rows if r[0] is None}.values()], key=str)


def plain_passages(rows, size=100):
    seen, out = set(), []
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (r[1] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            if raw[i : i + size] in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(raw[i : i + size])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
        if not any(gone) or kept.strip(" "):
            out.append((r[0], r[1] if not any(gone) else kept, *r[2:4], None if r[1] is None else len(kept)))
    return sorted(out + [(*r[:4], None if r[1] is None else len(r[1])) for r in rows if r[0] is None], key=str)


def plain_mixing(rows):
    def topic(text):
        hits = {t: sum((text or "").count(w) for w in terms) for t, terms in mixing.TOPICS.items()}
        return max(hits, key=hits.get) if max(hits.values()) else mixing.REST

    cell = lambda r: (r[3] or mixing.NONE, r[2] or mixing.NONE, topic(r[1]))
    words = lambda r: len((r[1] or "").split())
    tokens = Counter()
    for r in rows:
        tokens[cell(r)] += words(r)
    total, goal = sum(tokens.values()), {c: float(n) for c, n in tokens.items()}
    for _ in range(mixing.ROUNDS):
        for i, power in enumerate((0.5, 0.5, 0.75)):
            own, now = Counter(), Counter()
            for c, n in tokens.items():
                own[c[i]] += n
                now[c[i]] += goal[c]
            soft = {g: n**power if n else 0.0 for g, n in own.items()}
            goal = {c: v * total * soft[c[i]] / sum(soft.values()) / now[c[i]] if v else 0.0 for c, v in goal.items()}
    weight = {c: goal[c] / n if n else 0.0 for c, n in tokens.items()}
    low, high = 0.0, 1e9
    for _ in range(200):
        scale = (low + high) / 2
        spent = sum(min(1.0, scale * weight[c]) * n for c, n in tokens.items())
        low, high = (scale, high) if spent < corpus_pipeline.BUDGET * total else (low, scale)
    p = {c: min(1.0, low * weight[c]) if n else corpus_pipeline.BUDGET for c, n in tokens.items()}
    draw = lambda key: int(hashlib.md5(f"{'null' if key is None else key}:17".encode()).hexdigest()[:8], 16) / 2**32
    return sorted((r for r in rows if draw(r[0]) < p[cell(r)]), key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    words = [f"w{i}" for i in range(300)] + ["@", "a | b", "Licensed"]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = make(60)
    out = []
    for i in range(150):
        text = r.choice([make(r.choice([3, 20, 80])), make(10) + " " + passage + " " + make(12), out[-1][1] if out else "x"])
        if r.random() < 0.2 and out and out[-1][1]:
            text = out[-1][1].replace("w7", "w8", 1)
        out.append((i * 2, text, r.choice(["en", "de", None]), r.choice("abc"), len(text)))
    out += [(700, None, "en", "a", 0), (701, "", None, None, 0), (None, make(30), "en", "b", 9), (None, passage, "de", "b", 9), (None, passage, "de", "b", 9), out[5], out[5]]
    return out


def test_near_duplicate_stage(spark, rows):
    got = rows_of(corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, COLUMNS), ""))
    assert got == plain_near_duplicates(rows) and len(got) < len(rows) - 10


def test_passage_stage(spark, rows):
    once = plain_near_duplicates(rows)
    got = rows_of(corpus_pipeline.passage_stage(spark, spark.createDataFrame(once, COLUMNS), ""))
    assert got == plain_passages(once) and sum(r[4] or 0 for r in got) < sum(len(r[1] or "") for r in once)


def test_mixing_stage(spark, rows):
    got = rows_of(corpus_pipeline.mixing_stage(spark, spark.createDataFrame(rows, COLUMNS), ""))
    assert got == plain_mixing(rows) and 0 < len(got) < len(rows)


def test_token_stage(spark, rows):
    known = tokenizers.Tokenizer.from_file(default_path())
    got = corpus_pipeline.token_stage(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(((r[0], known.encode(r[1] or "", add_special_tokens=False).ids) for r in rows), key=str)


def test_whole_run(spark, rows, tmp_path, monkeypatch):
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], int("w1" in (r[1] or "")), 0) for r in rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    model = corpus_pipeline.train(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    score = lambda t: model.scores(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]))[0]
    good = [r for r in rows if r[1] is not None and score(r[1]) >= quality.THRESHOLD]
    want = plain_mixing(plain_passages(plain_near_duplicates(good)))
    known = tokenizers.Tokenizer.from_file(default_path())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 0 < len(want) < len(good) < len(rows)
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(((r[0], known.encode(r[1], add_special_tokens=False).ids) for r in want), key=str)
