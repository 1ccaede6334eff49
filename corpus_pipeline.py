"""The corpus pipeline: quality, near duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm._spark import Scratch, table, tune
from strandlake.llm.bpe import tokenize
from strandlake.llm.mixing import mix
from strandlake.llm.ngram_join import join_components
from strandlake.llm.quality import THRESHOLD, score, train
from strandlake.llm.suffix import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The stage rejects a document below this score: the classifier's own decision.
REJECT_BELOW = THRESHOLD
#: Share of the tokens that mixing keeps.
BUDGET = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this table's labels, doesn't reject; null texts go."""
    docs = docs.where(F.col("text").isNotNull())
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select(*COLUMNS), model, "_score").where(F.col("_score") >= REJECT_BELOW).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of exact and near duplicates (one row of it, if rows repeat).

    Rows without a doc_id can't be named in a link: one of each text stays.
    """
    groups = join_components(docs)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    known = docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)
    return known.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS).dropDuplicates(["text"]))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones hold; those with nothing left go."""
    out = remove_repeats(docs.select(*COLUMNS), keep_text=True)
    out = out.where((F.col("n_removed") == 0) | (F.trim(F.col("text")) != ""))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities that meets the source, language and topic marginals."""
    return mix(docs.select(*COLUMNS), BUDGET).where("sampled").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document, with digests of the ids and of the decoded text."""
    return tokenize(docs, keep_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("passages", passage_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Not expressible in SQL; tests/llm/test_pipeline.py holds the stages and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: every stage works on the written result of the one before."""
    scratch = Scratch(tune(spark), "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = scratch.write(out, name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
