"""Edge cases and brute-force checks of the other operators."""

import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import ann, langid, media, mixing, quality, sharding, warc
from strandlake.llm._spark import Scratch

ROWS = [(1, "the cat sat on the mat", "en", "a"), (2, "the cat sat on the mat", "en", "a"), (3, None, None, None), (4, "", "de", "b"), (None, "der hund 123", "de", "b"), (5, "!!! 77", "de", "b"), (6, "x" * 5000, "en", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2) for r in ROWS], "doc_id long, text string, lang string, source string, size int, weight int")


def test_sharding(docs):
    got = sharding.shard(docs, 3, grain=1).collect()
    assert len(got) == len(ROWS) and all(r.size == len((r.text or "").encode()) + 1 for r in got)
    for k in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    more = docs.sparkSession.createDataFrame([(i, f"text {i // 2}") for i in range(200)], "doc_id long, text string")
    shard_of = {r.doc_id: r.shard for r in sharding.shard(more, 3).collect()}
    assert all(shard_of[i] == shard_of[i + 1] for i in range(0, 200, 2))
    assert sharding.shard(docs.limit(0), 3).count() == 0


@pytest.mark.parametrize("n", [60, 200, 3000])
def test_sharding_splits_only_what_outweighs_a_shard(spark, n):
    """Groups of 1 to n / 20 rows stay together; one of a third of the rows, all without a key, is spread evenly."""
    rows = [(i, f"group {i % (n // 3)} " + "x" * (i % 7)) for i in range(n)] + [(None, "hot " * 9)] * (n // 2) + [(10**6 + i, "warm text") for i in range(n // 20)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    where, load = {}, [0] * 16
    for r in got:
        where.setdefault(r.text, set()).add(r.shard)
        load[r.shard] += r.size
    assert len(got) == len(rows) and all(len(s) == 1 for t, s in where.items() if not t.startswith("hot"))
    assert max(load) - min(load) <= (0.2 if n < 3000 else 0.02) * sum(load)
    for k in range(16):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def plain_pack(weights, shards, slack):
    """The rule, item by item and shard by shard."""
    total = [sum(w[d] for w in weights) for d in range(3)]
    share = [[w[d] / total[d] * shards if total[d] else 0.0 for d in range(3)] for w in weights]
    left, out = [[1.0] * 3 for _ in range(shards)], [0] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: (-max(share[i]), i)):
        fits = [s for s in range(shards) if all(left[s][d] + slack >= share[i][d] for d in range(3))]
        dot = lambda s: sum(left[s][d] * share[i][d] for d in range(3))
        worst = lambda s: min(left[s][d] - share[i][d] for d in range(3) if share[i][d] > 0)
        out[i] = max(fits, key=lambda s: (round(dot(s), 12), -s)) if fits else max(range(shards), key=lambda s: (round(worst(s), 12), -s))
        left[out[i]] = [left[out[i]][d] - share[i][d] for d in range(3)]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_packing_follows_the_rule(seed):
    w = np.random.default_rng(seed).exponential(1, (200, 3))
    assert sharding.pack(w, 7).tolist() == plain_pack(w.tolist(), 7, 0.002)


def test_packing_balances_every_dimension():
    w = np.random.default_rng(1).exponential(1, (3000, 3))
    used = np.array([w[sharding.pack(w, 8) == i].sum(axis=0) for i in range(8)])
    assert (used.max(axis=0) / used.mean(axis=0) < 1.02).all()


@pytest.mark.parametrize("n", [0, 1, 161, 162, 163, 345, 1536, 1537, 5000])
def test_stream_round_trip(n):
    raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    got = media.demux(media.mux(raw))
    assert got.payload == raw and got.discontinuities == 0 and len(got.random_access) == -(-n // media.UNIT)


def test_stream_damage():
    stored = media.mux(b"a" * 4000)
    lost = stored[: 188 * 4] + stored[188 * 5 :]
    with pytest.raises(media.StreamError):
        media.demux(lost)
    with pytest.raises(media.StreamError):
        media.demux(stored[:-1])


def test_stream_with_a_packet_sent_twice():
    raw = bytes(range(256)) * 20
    stored = media.mux(raw)
    i = next(i for i in range(3, len(stored) // 188) if not stored[188 * i + 1] & 0x40)
    got = media.demux(stored[: 188 * (i + 1)] + stored[188 * i : 188 * (i + 1)] + stored[188 * (i + 1) :])
    assert got.payload == raw and got.discontinuities == 0


def plain_demux(stored):
    """Payload, time stamps and access points, packet by packet."""
    packets = [stored[i : i + 188] for i in range(0, len(stored), 188)]
    assert all(p[0] == 0x47 for p in packets)
    pid = lambda p: (p[1] & 31) << 8 | p[2]
    body = lambda p: p[5 + p[4] :] if p[3] & 0x20 else p[4:]
    section = lambda p: body(p)[1 + body(p)[0] :]
    pat = section(next(p for p in packets if pid(p) == 0))
    pmt_pid = (pat[10] & 31) << 8 | pat[11]
    pmt = section(next(p for p in packets if pid(p) == pmt_pid))
    at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
    es, units, counter = (pmt[at + 1] & 31) << 8 | pmt[at + 2], [], None
    for i, p in enumerate(packets):
        if pid(p) != es or not p[3] & 0x10:
            continue
        assert counter is None or p[3] & 15 == (counter + 1) % 16
        counter = p[3] & 15
        if p[1] & 0x40:
            h = body(p)
            pts = (h[9] >> 1 & 7) << 30 | h[10] << 22 | h[11] >> 1 << 15 | h[12] << 7 | h[13] >> 1
            units.append([bytearray(h[9 + h[8] :]), pts, i if p[3] & 0x20 and p[4] and p[5] & 0x40 else None])
        else:
            units[-1][0] += body(p)
    return b"".join(bytes(u[0]) for u in units), [u[1] for u in units], [(u[1], u[2]) for u in units if u[2] is not None]


@pytest.mark.parametrize("n", [192, 1536, 4800, 100032])
def test_stream_against_a_plain_parser(n):
    stored = media.mux(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes())
    got = media.demux(stored)
    assert plain_demux(stored) == (got.payload, got.pts, got.random_access)


def test_media_rows(docs):
    got = {r.doc_id: r for r in media.media_rows(docs).collect()}
    assert got[3].payload_sha256 == got[4].payload_sha256 == hashlib.sha256(b" " * 192).hexdigest()
    assert got[1].media_sha256 == got[2].media_sha256 and got[6].n_bytes == 5000


def test_media_index(docs):
    for r in media.media_rows(docs, keep_media=True, keep_index=True).collect():
        packets = np.frombuffer(r.media, dtype=np.uint8).reshape(-1, media.PACKET)
        starts = [i for i, p in enumerate(packets) if (int(p[1]) & 31) << 8 | int(p[2]) == media.MEDIA_PID and int(p[1]) & 0x40]
        assert r.pts == [i * media.TICKS for i in range(-(-r.payload_bytes // media.UNIT))]
        assert [tuple(x) for x in r.random_access] == list(zip(r.pts, starts, strict=True))


def test_language(docs):
    model = langid.fit(["the cat and the dog"] * 30 + ["der hund und die katze"] * 30, ["en"] * 30 + ["de"] * 30)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert got[1].lang_pred == "en" and got[None].lang_pred == "de" and 0 <= got[1].score <= 1
    assert {got[i].lang_pred for i in (3, 4, 5)} == {"und"}
    assert langid.fit([], []).labels == ["und"]


@pytest.mark.parametrize("piece", [1, 2, 3, 4, 7, 64, 1000])
def test_language_of_long_texts_in_pieces(piece):
    text = np.frombuffer(("the cat  and\nthe dog, d\u00fcrfen ja " * 20 + "x" * 90).encode(), dtype=np.uint8)
    bounds = np.array([0, len(text)])
    whole, _ = langid.ngrams(text, bounds)
    parts = [langid.ngrams(p, np.array([0, len(p)]), until=piece)[0] for p in (text[i : i + piece + 3] for i in range(0, len(text), piece))]
    assert sorted(np.concatenate(parts)) == sorted(whole)
    model = langid.fit(["the cat and the dog"] * 30 + ["der hund und die katze"] * 30, ["en"] * 30 + ["de"] * 30)
    assert np.allclose(model.scores(text, bounds, piece), model.scores(text, bounds), rtol=1e-9)


def test_quality(docs):
    model = quality.fit(["good plain words here"] * 40 + ["### $$$ ### $$$"] * 40, [1] * 40 + [0] * 40)
    got = {r.doc_id: r.score for r in quality.score(docs, model, "weight").select("doc_id", F.col("weight").alias("score")).collect()}
    assert got[1] == got[2] > 0.7 and got[3] == got[4] and all(0 <= v <= 1 for v in got.values())
    assert quality.score_keys(docs.limit(0), model).count() == 0


def test_training_rows_are_one_per_key_and_bounded(spark):
    rows = [(i, ("the cat " if i % 2 else "der hund ") * 3, "en" if i % 2 else "de") for i in range(40)] + [(1, "the cat and the dog", "en")] * 50 + [(3, "x" * 300_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.bounded(docs, F.col("doc_id"), most=200, longest=40).collect()
    assert sum(len(r.text) for r in got) <= 200 and all(len(r.text) <= 40 for r in got)
    seen = []
    langid_fit = langid.fit
    langid.fit = lambda texts, labels: seen.extend(zip(texts, labels, strict=True)) or langid_fit(texts, labels)
    try:
        langid.train(docs)
    finally:
        langid.fit = langid_fit
    assert sum(t.startswith("the") for t, _ in seen) <= 20 and all(len(t) < 300_000 for t, _ in seen)


def plain_ftrl(rows, labels, order, size, alpha, beta, l1, l2):
    """The update rule, coordinate by coordinate."""
    z, n = [0.0] * size, [0.0] * size
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for r in order:
        w = {i: weight(i) for i, _ in rows[r]}
        p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in rows[r])))
        for i, x in rows[r]:
            g = (p - labels[r]) * x
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
            n[i] += g * g
    return [weight(i) for i in range(size)]


def test_quality_training_follows_the_rule():
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["red", "blue", "##", "12", "tree"], 12)) for _ in range(30)]
    labels = [int("tree" in t[:20]) for t in texts]
    model = quality.fit(texts, labels, epochs=2)
    size, rows = 1 << quality.BITS, []
    for t in texts:
        ids, x, _ = quality.features(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t)]))
        rows.append([*zip(ids.tolist(), x.astype(np.float32).tolist(), strict=True), (size, 1.0)])
    draw = np.random.default_rng(3)
    order = [i for _ in range(2) for i in draw.permutation(len(rows))]
    want = plain_ftrl(rows, labels, order, size + 1, 0.5, 1.0, 0.02, 0.1)
    assert model.bias == pytest.approx(want[-1], abs=1e-4) and model.weight == pytest.approx(np.array(want[:-1]), abs=1e-4)


@pytest.mark.parametrize("n", [600])
def test_language_held_out_accuracy(n):
    """Two made-up languages of different syllables: right on held-out texts of unseen words, and rejecting a third."""
    rng = np.random.default_rng(6)
    syllables = {"aa": ["ba", "na", "lo", "ti", "ra"], "bb": ["sch", "ei", "ung", "ver", "ent"]}
    text = lambda s: " ".join("".join(rng.choice(s, rng.integers(2, 5))) for _ in range(rng.integers(2, 30)))
    made = [(text(syllables[k]), k) for k in syllables for _ in range(n)]
    rng.shuffle(made)
    train, test = made[: n], made[n:]
    model = langid.fit([t for t, _ in train], [k for _, k in train])
    p = np.concatenate([model.scores(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t)])) for t, _ in test])
    right = np.array([model.labels[i] == k for i, (_, k) in zip(p.argmax(axis=1), test, strict=True)])
    assert right.mean() >= 0.99 and right[p.max(axis=1) >= model.reject_below].mean() >= 0.99


def test_warc(spark):
    big = "<p>" + "é" * 100
    rows = [(9, "u9", big), (2, "u\n2", big), (5, None, big), (7, "u7", "small"), (8, "u8", "small"), (1, "u1", None), (1, "u1", None)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, type string")
    scratch = Scratch(spark, "t")
    index = warc.write(pages, scratch)
    got = sorted(tuple(r) for r in warc.resolve(warc.read(index, scratch), scratch).select("page_id", "payload_bytes", "record_type", "refers_to", "payload_digest").collect())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = sorted((i, len((h or "").encode()), "revisit" if i in (5, 9) else "response", 2 if i in (5, 9) else None, sha(h)) for i, _, h in rows)
    assert [(a, b, c, d or 0, e) for a, b, c, d, e in got] == [(a, b, c, d or 0, e) for a, b, c, d, e in want]
    some = warc.read(index.where("page_id = 7"), scratch).collect()
    assert [bytes(r.payload) for r in some] == [b"small"]


def nearest(ids, x, query, top=10):
    d = np.sqrt(((x - x[ids.index(query)]) ** 2).sum(axis=1))
    return [(ids[i], d[i]) for i in np.lexsort((ids, d)) if ids[i] != query][:top]


@pytest.mark.parametrize("hashes", [None, 2, 3])
def test_neighbours(spark, hashes):
    """With the shipped tables and target: recall against all rows, scores, and rows that take no part."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    odd = [(9000, None), (9100, [0.0] * 24), (9200, [float("nan")] * 24), (9300, [1.0] * 23), (9400, [None] * 24), (None, [1.0] * 24), (9500, [])]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(i, v, 2) for i, v in odd] + [(1600, x[0].tolist(), 1), (1600, x[0].tolist(), 3)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"), F.col("vec_id") % 100 == 0, hashes=hashes).collect()
    ids, every = [*range(1500), 1600], np.vstack([x, x[:1]])
    queries, hits = {*range(0, 1500, 100), 1600}, 0
    assert {r.query_id for r in got} == queries and len(got) == 10 * len(queries)
    for q in queries:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        assert all(r.score == pytest.approx(np.linalg.norm(every[ids.index(q)] - every[ids.index(r.vec_id)])) for r in mine)
        hits += len({i for i, _ in nearest(ids, every, q)} & {r.vec_id for r in mine})
    assert hits >= 0.9 * len(got)


def test_neighbours_of_equal_vectors(spark):
    """A third of the rows are one vector: ties go to the least ids, and none of the group is left out."""
    x = np.random.default_rng(4).normal(size=(120, 8))
    rows = [(i, x[0].tolist() if i % 3 == 0 else x[i].tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 10 == 0, target=1.0, hashes=1).collect()
    every = np.array([v for _, v in rows])
    for q in range(0, 120, 10):
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for i, _ in nearest(list(range(120)), every, q)]
    few = ann.search(df.where("vec_id IN (1, 2, 4)"), F.col("vec_id") == 1).collect()
    assert [(r.vec_id, r.rank) for r in sorted(few, key=lambda r: r.rank)] == [(i, k + 1) for k, (i, _) in enumerate(nearest([1, 2, 4], every[[1, 2, 4]], 1))]
    assert ann.search(df.limit(0), F.col("vec_id") == 1).count() == 0


def test_quality_is_fitted_in_a_task(spark, monkeypatch):
    """Neither the sample nor its features come to the driver; the model is that of a fit in place."""
    rows = [(i, "good plain words here" if i % 3 else "### $$$ ### $$$", int(i % 3 > 0)) for i in range(60)]
    sample = spark.createDataFrame(rows[::-1], "doc_id long, text string, quality int").repartition(5)
    got, want = quality.fit_sample(sample), quality.fit([r[1] for r in rows], [r[2] for r in rows])
    assert np.array_equal(got.weight, want.weight) and got.bias == want.bias
    none = quality.fit_sample(sample.limit(0))
    assert not none.weight.any() and none.bias == 0

    def fit(texts, labels):
        return quality.Model(np.zeros(1), float(os.getpid()))

    monkeypatch.setattr(quality, "fit", fit)
    docs = sample.select("doc_id", "text")
    assert quality.train(docs, sample.select("doc_id", "quality")).bias != float(os.getpid())


def test_neighbours_leave_the_driver_little(spark):
    """The sample comes from few rows of each task, probes aren't broadcast, and of buckets only the large ones may be."""
    entries = spark.range(20_000).select(F.col("id").alias("entry"), F.array(F.lit(1.0)).alias("v"))
    by_hash = (F.xxhash64("entry", F.lit(29)), "entry")
    some = ann.least_hashes(entries, 20_000, 100, 29)
    assert 100 <= some.count() < 300
    assert some.orderBy(*by_hash).limit(100).collect() == entries.orderBy(*by_hash).limit(100).collect()
    assert ann.least_hashes(entries.limit(200), 200, 100, 29).count() == 200

    indexed = spark.createDataFrame([(i, 0, i if i < 5 else 7) for i in range(100)], "entry long, t int, bucket long")
    listed = ann.bucket_lists(indexed, 16)
    got = listed.collect()
    assert sorted((r.bucket, e) for r in got for e in r.entries) == sorted((r.bucket, r.entry) for r in indexed.collect())
    assert sum(r.bucket == 7 for r in got) == 6 and [r.part for r in got if r.bucket < 5] == [0] * 5

    def probe(batches):
        for b in batches:
            yield from [b] * 100

    probed = spark.createDataFrame([(1, 0, 7)], "query long, t int, bucket long").mapInArrow(probe, "query long, t int, bucket long")
    met = ann.probed_lists(probed, listed)
    assert met.count() == 600
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [t" in plan and "BroadcastHashJoin [t" not in plan.split("SortMergeJoin [t")[0]


def test_mixing(docs):
    got = {r.doc_id: r for r in mixing.mix(docs, 0.5).collect()}
    assert got[1].probability == got[2].probability and got[3].tokens == 0 and got[3].probability == 0.5
    spent = sum(r.tokens * r.probability for r in mixing.mix(docs, 0.5).collect())
    assert spent == pytest.approx(0.5 * sum(r.tokens for r in got.values()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_topics(spark):
    texts = ["a @ b @ | x", "a | b | c @", "Licensed, licensed!!", "", None, "plain", "x | y @ z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.topic for r in df.select("i", mixing.topic_of(F.col("text")).alias("topic")).orderBy("i").collect()]
    assert got == ["contact", "tabular", "licensing", "prose", "prose", "prose", "contact"]


@pytest.mark.parametrize("seed", [1, 2])
def test_raking_meets_every_marginal(spark, seed):
    """Against a plain loop, and against the targets: what is left of error after the rounds is below the tolerance."""
    rng = np.random.default_rng(seed)
    keys = [(s, g, t) for s in "abcd" for g in "xyz" for t in "pq"]
    tokens = rng.integers(1, 5000, len(keys))
    cells = spark.createDataFrame([(*k, int(n)) for k, n in zip(keys, tokens, strict=True)], "source string, lang string, topic string, tokens long")
    power = {"source": 0.5, "lang": 0.0, "topic": 0.75}
    raked = mixing.rake(cells, power, scratch=Scratch(spark, "t"))
    assert mixing.marginal_error(raked) < mixing.TOLERANCE
    goal = tokens.astype(float)
    for _ in range(mixing.ROUNDS):
        for i, key in enumerate(mixing.KEYS):
            share = {g: sum(int(n) for k, n in zip(keys, tokens, strict=True) if k[i] == g) ** power[key] for g in {k[i] for k in keys}}
            now = {g: sum(v for k, v in zip(keys, goal, strict=True) if k[i] == g) for g in share}
            goal = np.array([v * tokens.sum() * share[k[i]] / sum(share.values()) / now[k[i]] for k, v in zip(keys, goal, strict=True)])
    got = {(r.source, r.lang, r.topic): r.goal for r in raked.collect()}
    assert [got[k] for k in keys] == pytest.approx(goal.tolist(), rel=1e-9)


def test_mixing_to_given_targets(spark):
    rows = [(i, "an " * (1 + i % 5), "en de".split()[i % 2], "aab"[i % 3]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, 0.5, targets={"source": {"a": 1, "b": 3}, "lang": {"en": 2, "de": 3}}).collect()
    share = lambda key, group: sum(r.weight * r.tokens for r in got if r[key] == group) / sum(r.tokens for r in got)
    assert share("source", "b") == pytest.approx(0.75) and share("lang", "en") == pytest.approx(0.4)
    only = {r.doc_id: r.probability for r in mixing.mix(docs, 0.9, targets={"source": {"a": 1}}).collect()}
    assert all(only[i] == (0 if source == "b" else 1) for i, _, _, source in rows)
    with pytest.raises(ValueError):
        mixing.mix(docs, targets={"source": {"a": 0}})


def test_mixing_tells_unmet_targets(spark):
    docs = spark.createDataFrame([(1, "an", "en", "a"), (2, "an", "de", "b")], "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="misses its target by 0.25"):
        mixing.mix(docs, targets={"source": {"a": 1, "b": 1}, "lang": {"en": 1, "de": 3}})
