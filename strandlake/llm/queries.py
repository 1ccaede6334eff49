"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.ann import op5_cross_polytope
from strandlake.llm.bpe import op8_bpe
from strandlake.llm.langid import op3_language_id
from strandlake.llm.media import op2_transport_stream
from strandlake.llm.mixing import op10_mixing, op10_sql
from strandlake.llm.ngram_join import op7_ngram_join
from strandlake.llm.quality import op6_quality
from strandlake.llm.sharding import op1_shard_packing
from strandlake.llm.suffix import op9_suffix_dedup
from strandlake.llm.warc import OP4_SQL, op4_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_shard_packing, op2_transport_stream, op3_language_id, op4_warc, op5_cross_polytope, op6_quality, op7_ngram_join, op8_bpe, op9_suffix_dedup, op10_mixing)
}

ORACLE_SQL: dict[str, str] = {"op4_warc": OP4_SQL, "op10_mixing": op10_sql()}
