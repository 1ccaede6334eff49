"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed into cells of (source, language, topic); the cells are raked in turn to each
of the three marginals for a number of rounds, and what then remains of error is tested; the ratio of raked to observed tokens is a document's weight,
and a scale found exactly from the cells turns weights into inclusion probabilities that spend the token
budget.  Everything is DataFrame windows and aggregates: the documents are aggregated once before any
exchange, and the rounds work on cells alone.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm._spark import Scratch, table

KEYS = ("source", "lang", "topic")
#: Rounds of raking over the three marginals; a round after convergence changes nothing.
ROUNDS = 12
#: Share of all tokens by which a marginal may miss its target after the rounds without a warning.
TOLERANCE = 1e-6
#: Topics and the terms that tell them (the tables have no topic column): notices, contacts, credentials, tables, appeals.
TOPICS = {"licensing": ("Licens", "licens"), "contact": ("@",), "credentials": (" = ",), "tabular": (" | ",), "appeal": ("!!",)}
#: Topic of a text without any of the terms.
REST = "prose"
NONE = "(none)"


def tokens_of(text: Column) -> Column:
    """White-space separated words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column, topics: Mapping[str, tuple[str, ...]] | None = None) -> Column:
    """The topic whose terms occur most often in the whole text, ties to the first listed; the rest's if there are none."""
    body = F.coalesce(text, F.lit(""))
    hits = {t: sum(((F.length(body) - F.length(F.replace(body, F.lit(w), F.lit("")))) / len(w) for w in terms), F.lit(0)).cast("long") for t, terms in (topics or TOPICS).items()}
    best = F.greatest(*hits.values(), F.lit(0))
    out = F.when(best == 0, F.lit(REST))
    for t, n in hits.items():
        out = out.when(n == best, F.lit(t))
    return out


def softened(total: Column, power: float) -> Column:
    return F.pow(total.cast("double"), F.lit(power))


def given(key: str, weights: Mapping[str | None, float]) -> Column:
    """The weight given for a group, 0 if there is none."""
    if not weights or min(weights.values()) < 0 or not 0 < sum(weights.values()) < float("inf"):
        raise ValueError(f"target weights of {key} must be 0 or more, and one at least above")
    out = F.when(F.lit(False), F.lit(0.0))
    for group, w in weights.items():
        out = out.when(F.col(key) == (NONE if group is None else group), F.lit(float(w)))
    return out.otherwise(0.0)


def marginal_error(raked: DataFrame) -> float:
    """The most by which a group's raked tokens miss its target, as a share of all tokens; 0 without tokens."""
    gaps = raked.where("grand > 0").select("grand", *[(F.abs(F.sum("goal").over(Window.partitionBy(k)) - F.col(f"target_{k}")) / F.col("grand")).alias(f"gap_{k}") for k in KEYS])
    return gaps.agg(F.max(F.greatest(*[f"gap_{k}" for k in KEYS]))).first()[0] or 0.0


def rake(cells: DataFrame, power: Mapping[str, float], rounds: int = ROUNDS, scratch: Scratch | None = None, every: int = 6, targets: Mapping[str, Mapping[str | None, float]] | None = None) -> DataFrame:
    """Adds `goal`, the raked tokens of each cell, to cells of (source, lang, topic, tokens).

    The target marginal of a key is its token share raised to power[key] and normalised (1 keeps the
    share, 0 makes the groups equal), or, for a key in targets, the weight given for each of its groups, normalised over
    those that occur (None names the null group; a group without a weight gets none).  Cells without tokens keep the goal 0.
    """
    everywhere = Window.partitionBy()
    grand = F.sum("tokens").over(everywhere).cast("double")
    out = cells.withColumn("goal", F.col("tokens").cast("double")).withColumn("grand", grand)
    for k in KEYS:
        share = F.sum("tokens").over(Window.partitionBy(k))
        out = out.withColumn(f"soft_{k}", given(k, targets[k]) if targets and k in targets else softened(share, power[k])).withColumn(f"n_{k}", F.row_number().over(Window.partitionBy(k).orderBy(*KEYS)))
        out = out.withColumn(f"target_{k}", F.col("grand") * F.col(f"soft_{k}") / F.sum(F.when(F.col(f"n_{k}") == 1, F.col(f"soft_{k}"))).over(everywhere)).drop(f"soft_{k}", f"n_{k}")
    for i in range(rounds):
        for k in KEYS:
            now = F.sum("goal").over(Window.partitionBy(k))
            out = out.withColumn("goal", F.when(F.col("goal") > 0, F.col("goal") * F.col(f"target_{k}") / now).otherwise(0.0))
        if scratch and (i + 1) % every == 0 and i + 1 < rounds:
            out = scratch.write(out, f"round{i}")
    return out


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """Adds `p`, each cell's inclusion probability min(1, scale * goal / tokens), with sum(p * tokens) = budget * tokens.

    The scale is exact: with the cells sorted by weight from the top, the first j are certain, and j is
    the least for which the scale that spends the rest of the budget keeps the next one at 1 or less.  If the cells
    with a goal hold less than the budget, all of them are certain.
    """
    weight = F.when(F.col("tokens") > 0, F.col("goal") / F.col("tokens")).otherwise(0.0)
    down = Window.partitionBy().orderBy(F.col("weight").desc(), *KEYS)
    upto = down.rowsBetween(Window.unboundedPreceding, -1)
    rest = down.rowsBetween(0, Window.unboundedFollowing)
    out = cells.withColumn("weight", weight)
    out = out.withColumn("certain", F.coalesce(F.sum("tokens").over(upto), F.lit(0)).cast("double")).withColumn("free", F.sum("goal").over(rest))
    scale = F.when(F.col("free") > 0, (F.lit(budget) * F.col("grand") - F.col("certain")) / F.col("free"))
    out = out.withColumn("scale", scale)
    good = F.when((F.col("scale") > 0) & (F.col("scale") * F.col("weight") <= 1 + 1e-12), F.col("scale"))
    chosen = F.max(good).over(Window.partitionBy())
    return out.withColumn("p", F.when(F.col("tokens") == 0, F.lit(float(budget))).when(chosen.isNull() & (F.col("weight") > 0), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce(chosen, F.lit(0.0)) * F.col("weight"))))


def uniform(key: Column, seed: int) -> Column:
    """A uniform number in [0, 1) that depends on the key and the seed only."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, budget: float = 0.5, power: Mapping[str, float] | None = None, seed: int = 17, topic: Column | None = None, rounds: int = ROUNDS, targets: Mapping[str, Mapping[str | None, float]] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The columns (all, unless stated), topic, tokens, weight, probability and sampled of every document.

    topic: a column, in place of the topic that the terms in TOPICS tell.
    targets: explicit weights by key and group, in place of the key's power.  A warning tells if the marginals still
    miss their targets after the rounds, as they must if cells that they need don't occur.

    Null source, lang or topic form a group of their own.  Null and empty texts have no tokens: weight 0,
    probability `budget`.  Repeated rows get equal values.  An empty table gives no rows.  Input columns
    named like the added ones are replaced.
    """
    spark = docs.sparkSession
    power = power or {"source": 0.5, "lang": 0.5, "topic": 0.75}
    if unknown := set(targets or ()) - set(KEYS):
        raise ValueError(f"no such keys: {sorted(unknown)}")
    scratch = Scratch(spark, "mixing")
    added = ("topic", "tokens", "weight", "probability", "sampled", "k_source", "k_lang", "k_topic")
    own = [c for c in (docs.columns if columns is None else columns) if c not in added]
    keyed = docs.select(
        *own,
        F.coalesce(topic if topic is not None else topic_of(F.col("text")), F.lit(NONE)).alias("topic"),
        tokens_of(F.col("text")).alias("tokens"),
        F.coalesce(F.col("source"), F.lit(NONE)).alias("k_source"),
        F.coalesce(F.col("lang"), F.lit(NONE)).alias("k_lang"),
    )
    if "text" not in own:
        # Without the texts the rows are small: they are read once, for the cells and for the sample.
        keyed = scratch.write(keyed, "keyed")
    cells = keyed.groupBy(F.col("k_source").alias("source"), F.col("k_lang").alias("lang"), "topic").agg(F.sum("tokens").alias("tokens"))
    raked = scratch.write(rake(scratch.write(cells, "cells"), power, rounds, scratch, targets=targets), "raked")
    if (error := marginal_error(raked)) > TOLERANCE:
        warnings.warn(f"after {rounds} rounds a marginal misses its target by {error:.2g} of all tokens", stacklevel=2)
    cells = calibrate(raked, budget)
    cells = scratch.write(cells.select(F.col("source").alias("k_source"), F.col("lang").alias("k_lang"), F.col("topic").alias("k_topic"), "weight", "p"), "calibrated")
    out = keyed.withColumn("k_topic", F.col("topic")).join(cells, ["k_source", "k_lang", "k_topic"])
    return out.select(*own, "topic", "tokens", "weight", F.col("p").alias("probability"), (uniform(F.col("doc_id"), seed) < F.col("p")).alias("sampled"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, probability and sampling decision of every document; doubles rounded to 6 places."""
    out = mix(table(spark, sf_dir, "documents"), columns=["doc_id", "source", "lang"])
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")


def op10_sql(budget: float = 0.5, power: Mapping[str, float] | None = None, seed: int = 17, rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL, with the rounds written out."""
    power = power or {"source": 0.5, "lang": 0.5, "topic": 0.75}
    n = {t: "(" + " + ".join(f"(length(body) - length(replace(body, '{w}', ''))) // {len(w)}" for w in terms) + ")" for t, terms in TOPICS.items()}
    best = f"greatest({', '.join(n.values())}, 0)"
    topic = f"CASE WHEN {best} = 0 THEN '{REST}' " + " ".join(f"WHEN {e} = {best} THEN '{t}'" for t, e in n.items()) + " END"
    parts = [
        f"""d AS (SELECT doc_id, source, lang, {topic} AS topic, tokens, coalesce(source, '{NONE}') AS ks, coalesce(lang, '{NONE}') AS kl
  FROM (SELECT *, coalesce(text, '') AS body, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents))""",
        "r AS (SELECT ks AS source, kl AS lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL)",
    ]
    for k in KEYS:
        parts.append(f"t_{k} AS (SELECT {k}, pow(CAST(sum(tokens) AS DOUBLE), {power[k]}) AS soft FROM r GROUP BY {k})")
    joined = " ".join(f"JOIN (SELECT {k}, (SELECT CAST(sum(tokens) AS DOUBLE) FROM r) * soft / (SELECT sum(soft) FROM t_{k}) AS target_{k} FROM t_{k}) USING ({k})" for k in KEYS)
    parts.append(f"g0 AS (SELECT *, CAST(tokens AS DOUBLE) AS goal, (SELECT CAST(sum(tokens) AS DOUBLE) FROM r) AS grand FROM r {joined})")
    last = "g0"
    for i in range(rounds * len(KEYS)):
        k = KEYS[i % len(KEYS)]
        parts.append(f"g{i + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN goal > 0 THEN goal * target_{k} / sum(goal) OVER (PARTITION BY {k}) ELSE 0.0 END AS goal) FROM {last})")
        last = f"g{i + 1}"
    order = "ORDER BY weight DESC, source, lang, topic"
    parts += [
        f"w AS (SELECT *, CASE WHEN tokens > 0 THEN goal / tokens ELSE 0.0 END AS weight FROM {last})",
        f"c AS (SELECT *, coalesce(sum(tokens) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS certain, sum(goal) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w)",
        f"s AS (SELECT *, CASE WHEN free > 0 THEN ({budget} * grand - certain) / free END AS scale FROM c)",
        f"p AS (SELECT *, CASE WHEN tokens = 0 THEN {budget} ELSE least(1.0, coalesce((SELECT max(scale) FROM s WHERE scale > 0 AND scale * weight <= 1 + 1e-12), 0.0) * weight) END AS p FROM s)",
    ]
    u = f"CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{seed}'), 1, 8)) AS BIGINT) / 4294967296.0"
    return f"WITH {', '.join(parts)} SELECT doc_id, d.source, d.lang, d.topic, d.tokens, round(p.weight, 6) AS weight, round(p.p, 6) AS probability, {u} < p.p AS sampled FROM d JOIN p ON p.source = d.ks AND p.lang = d.kl AND p.topic = d.topic"
