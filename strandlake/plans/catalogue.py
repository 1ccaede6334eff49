"""Every query of the library over the driver's tables, with the SQL that gives the same rows.

Sequences are derived from the documents: the letters of a text that are bases, of the whole text of every document.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import cigar as C
from strandlake.functions import quality as Q
from strandlake.functions import sequence as S
from strandlake.functions import translation as TR
from strandlake.functions.tables import CODES, codon_table
from strandlake.operators import align as AL
from strandlake.operators import debruijn as G
from strandlake.operators import kmers as K
from strandlake.operators import minimizers as M
from strandlake.operators import stats as ST
from strandlake.operators.orfs import find_orfs
from strandlake.session import shared_dir, ship, spread
from strandlake.sources import fasta as FA
from strandlake.sources import lines as L
from strandlake.sources import trees as TREE
from strandlake.streaming import sequences as STREAM

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


def dna(spark: SparkSession, d: str, letters: str = "ACGT") -> DataFrame:
    docs = spread(read(spark, d, "documents").select("doc_id", "source", "text"))
    return docs.select(F.col("doc_id").alias("id"), "source", F.regexp_replace(F.upper("text"), f"[^{letters}]", "").alias("sequence"))


def reads(spark: SparkSession, d: str) -> DataFrame:
    """FASTQ-like: a quality for every base, from its letter."""
    return dna(spark, d).withColumn("quality", F.translate("sequence", "ACGT", QUAL))


#: Quality letters of A, C, G, T: 33 + 7 * code modulo 41.
QUAL = "".join(chr(33 + ord(c) * 7 % 41) for c in "ACGT")


def pairs(df: DataFrame) -> DataFrame:
    """Each row with the next of its source."""
    order = Window.partitionBy("source").orderBy("id")
    return df.select(F.col("id").alias("id1"), F.lead("id").over(order).alias("id2"), F.col("sequence").alias("seq1"), F.lead("sequence").over(order).alias("seq2")).where("id2 IS NOT NULL")


D = "d AS (SELECT doc_id AS id, source, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM documents)"
COMP = "reverse(translate({0}, 'ACGT', 'TGCA'))"
RC = COMP.format("s")


def kmers_sql(k: int, canonical: bool = False, extra: str = "") -> str:
    kmer = f"substr(s, CAST(i AS INT) + 1, {k})"
    kmer = f"least({kmer}, {COMP.format(kmer)})" if canonical else kmer
    return f"{D}, k AS (SELECT id, CAST(i AS INT) AS pos, {kmer} AS kmer{extra} FROM d, unnest(range(0, greatest(length(s) - {k - 1}, 0))) t(i))"


# Scalars


@query(f"WITH {D} SELECT id, replace(s, 'T', 'U') AS rna, {RC} AS rc, translate(s, 'ACGT', 'TGCA') AS comp, reverse(translate(replace(s, 'T', 'U'), 'ACGU', 'UGCA')) AS rna_rc, least(s, {RC}) AS canonical FROM d")
def complements(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("sequence")
    rna = S.dna_to_rna(s)
    return dna(spark, d).select("id", rna.alias("rna"), S.reverse_complement(s).alias("rc"), S.complement(s).alias("comp"), F.when(rna.contains("U"), S.reverse_complement(rna)).otherwise(F.reverse(F.translate(rna, "ACGU", "UGCA"))).alias("rna_rc"), S.canonical(s).alias("canonical"))


@query(f"WITH {D} SELECT id, s AS back FROM d")
def rna_to_dna(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("id", S.rna_to_dna(S.dna_to_rna(F.col("sequence"))).alias("back"))


# K-mers


@query(f"WITH {kmers_sql(12)} SELECT * FROM k")
def kmers(spark: SparkSession, d: str) -> DataFrame:
    return K.kmer_rows(dna(spark, d), 12, keep=("id",))


@query(f"WITH {kmers_sql(5)} SELECT kmer, count(*) AS n FROM k GROUP BY kmer")
def kmer_count(spark: SparkSession, d: str) -> DataFrame:
    return K.count_kmers(dna(spark, d), 5)


@query(f"WITH {kmers_sql(5, True)} SELECT kmer, count(*) AS n FROM k GROUP BY kmer")
def kmer_count_canonical(spark: SparkSession, d: str) -> DataFrame:
    return K.count_kmers(dna(spark, d), 5, canonical_=True)


@query(f"WITH {kmers_sql(9)} SELECT n AS multiplicity, count(*) AS kmers FROM (SELECT count(*) AS n FROM k GROUP BY kmer) GROUP BY n")
def kmer_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return K.spectrum(dna(spark, d), 9)


@query(f"WITH {kmers_sql(9)} SELECT kmer FROM k GROUP BY kmer HAVING count(*) = 1")
def unique_kmers(spark: SparkSession, d: str) -> DataFrame:
    return K.unique_kmers(dna(spark, d), 9)


_POWERS = " + ".join(f"(strpos('ACGT', kmer[{i + 1}]) - 1) * {4 ** (5 - i)}" for i in range(6))


@query(f"WITH {kmers_sql(6)} SELECT DISTINCT id, kmer, CAST(({_POWERS}) % 2147483647 AS BIGINT) AS hash FROM k")
def kmer_rolling_hash(spark: SparkSession, d: str) -> DataFrame:
    return K.rolling_hashes(dna(spark, d), 6, keep=("id",))


@query(f"""WITH {kmers_sql(4, True, ", substr(s, CAST(i AS INT) + 1, 4) AS fwd")}, j AS (SELECT *, CASE WHEN substr(lag(kmer) OVER w, 2, 3) = substr(kmer, 1, 3) THEN 0 ELSE 1 END AS brk FROM k WINDOW w AS (PARTITION BY id ORDER BY pos)),
g AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY id ORDER BY pos) - 1 AS BIGINT) AS part FROM j)
SELECT id, part, min_by(fwd, pos) || coalesce(string_agg(CASE WHEN brk = 0 THEN right(kmer, 1) END, '' ORDER BY pos), '') AS super_kmer FROM g GROUP BY id, part""")
def super_kmers(spark: SparkSession, d: str) -> DataFrame:
    return K.super_kmers(dna(spark, d), 4, canonical_=True)


@query(f"WITH {kmers_sql(7)} SELECT id, pos, kmer FROM k WHERE least(substr(kmer, 1, 4), substr(kmer, 2, 4), substr(kmer, 3, 4), substr(kmer, 4, 4)) IN (substr(kmer, 1, 4), substr(kmer, 4, 4))")
def syncmers(spark: SparkSession, d: str) -> DataFrame:
    return K.syncmers(dna(spark, d), 7, 4, keep=("id",))


_PAIRS = "p AS (SELECT id1, id2 FROM (SELECT id AS id1, lead(id) OVER (PARTITION BY source ORDER BY id) AS id2 FROM d) WHERE id2 IS NOT NULL)"
_JACCARD = "SELECT id1, id2, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END, 6) AS jaccard FROM (SELECT id1, id2, coalesce(x.ks, []) AS a, coalesce(y.ks, []) AS b FROM p LEFT JOIN z AS x ON x.id = id1 LEFT JOIN z AS y ON y.id = id2)"


@query(f"WITH {kmers_sql(5)}, {_PAIRS}, z AS (SELECT id, list(DISTINCT kmer) AS ks FROM k GROUP BY id) {_JACCARD}")
def kmer_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return pairs(dna(spark, d)).select("id1", "id2", F.round(K.jaccard(F.col("seq1"), F.col("seq2"), 5), 6).alias("jaccard"))


def _min_sql(value: str) -> str:
    return f"m AS (SELECT DISTINCT id, b FROM (SELECT id, min({value}) OVER w AS b, count(*) OVER w AS c FROM k WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) WHERE c = 10)"


@query(f"WITH {kmers_sql(5)}, {_min_sql("{'kmer': kmer, 'pos': pos}")} SELECT id, b.kmer AS kmer, b.pos AS pos FROM m")
def minimizers(spark: SparkSession, d: str) -> DataFrame:
    return M.minimizers(dna(spark, d), 5, 10)


_HASH = "CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS BIGINT)"
_RAW = "(" + " + ".join(f"ascii(kmer[{i + 1}]) * {31 ** (4 - i)}" for i in range(5)) + ") % 4294967296"
_HASHED = kmers_sql(5).replace(", k AS (", ", k0 AS (") + f", k AS (SELECT id, pos, kmer, {_HASH} AS hash FROM (SELECT *, {_RAW} AS h FROM k0))"


@query(f"WITH {_HASHED}, {_min_sql("{'hash': hash, 'pos': pos, 'kmer': kmer}")} SELECT id, b.hash AS hash, b.pos AS pos, b.kmer AS kmer FROM m")
def hash_minimizers(spark: SparkSession, d: str) -> DataFrame:
    return M.hash_minimizers(dna(spark, d), 5, 10)


@query(f"WITH {kmers_sql(5)}, {_min_sql("{'kmer': kmer, 'pos': pos}")} SELECT d.id, round(CASE WHEN length(s) >= 5 THEN coalesce(n, 0) / (length(s) - 4) END, 6) AS density FROM d LEFT JOIN (SELECT id, count(*) AS n FROM m GROUP BY id) USING (id)")
def minimizer_density(spark: SparkSession, d: str) -> DataFrame:
    return M.density(dna(spark, d), 5, 10).withColumn("density", F.round("density", 6))


@query(f"WITH {kmers_sql(5)}, {_min_sql("{'kmer': kmer, 'pos': pos}")}, {_PAIRS}, z AS (SELECT id, list(DISTINCT b.kmer) AS ks FROM m GROUP BY id) {_JACCARD}")
def minimizer_jaccard(spark: SparkSession, d: str) -> DataFrame:
    x = dna(spark, d)
    return M.jaccard_pairs(x, pairs(x).select("id1", "id2"), 5, 10).withColumn("jaccard", F.round("jaccard", 6))


# Graphs

_NODES = "n AS (SELECT kmer, count(*) AS coverage FROM k GROUP BY kmer)"
_EDGES = "e AS (SELECT src, dst, min(seen) AS seen FROM (SELECT kmer AS src, lead(kmer) OVER (PARTITION BY id ORDER BY pos) AS dst, {'a': id, 'b': pos} AS seen FROM k) WHERE dst IS NOT NULL GROUP BY src, dst)"
_DEG = "g AS (SELECT n.*, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM n LEFT JOIN (SELECT src AS kmer, count(*) AS o FROM e GROUP BY src) USING (kmer) LEFT JOIN (SELECT dst AS kmer, count(*) AS i FROM e GROUP BY dst) USING (kmer))"
_STATS = "SELECT count(*) AS node_count, CAST(sum(o) AS BIGINT) AS edge_count, round(avg(coverage), 6) AS avg_coverage, max(coverage) AS max_coverage, count(*) FILTER (o > 1) AS branching_nodes, count(*) FILTER (o = 0) AS dead_ends FROM g"


@query(f"WITH {kmers_sql(7)}, {_NODES} SELECT * FROM n")
def debruijn_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.build(dna(spark, d), 7)[0].drop("first_seen")


@query(f"WITH {kmers_sql(7)}, {_EDGES} SELECT src, dst FROM e")
def debruijn_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.build(dna(spark, d), 7)[1].drop("first_seen")


@query(f"WITH {kmers_sql(7)}, {_NODES}, {_EDGES}, {_DEG} {_STATS}")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_stats(*G.build(dna(spark, d), 7)).withColumn("avg_coverage", F.round("avg_coverage", 6))


_PRUNED = _NODES.replace("GROUP BY kmer", "GROUP BY kmer HAVING count(*) >= 4") + ", " + _EDGES.replace("e AS (", "e0 AS (") + ", e AS (SELECT * FROM e0 WHERE src IN (SELECT kmer FROM n) AND dst IN (SELECT kmer FROM n))"


@query(f"WITH {kmers_sql(9)}, {_PRUNED}, {_DEG} {_STATS}")
def graph_pruned_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_stats(*G.build(dna(spark, d), 9, min_coverage=4)).withColumn("avg_coverage", F.round("avg_coverage", 6))


_TIPS = "b AS (SELECT dst AS cur, arg_min(src, {'s': seen, 'k': src}) AS prev FROM e GROUP BY dst), w0 AS (SELECT kmer AS tip, kmer AS cur, 0 AS steps, true AS go FROM g WHERE o = 0)" + "".join(
    f", w{i + 1} AS (SELECT tip, CASE WHEN ok THEN prev ELSE cur END AS cur, steps + CAST(ok AS INT) AS steps, ok AS go FROM (SELECT w.*, prev, go AND coalesce(p.o <= 1, false) AS ok FROM w{i} AS w LEFT JOIN b USING (cur) LEFT JOIN g AS p ON p.kmer = prev))" for i in range(4)
)


#: Each part is read more than once: written out once, the SQL ends.
_ONCE = re.sub(r"\b(k|n|e0|e|g|b|w\d) AS \(", r"\1 AS MATERIALIZED (", f"{kmers_sql(9)}, {_PRUNED}, {_DEG}, {_TIPS}")


@query(f"WITH {_ONCE} SELECT kmer, coverage FROM n WHERE kmer NOT IN (SELECT tip FROM w4 WHERE steps <= 3)")
def graph_without_tips(spark: SparkSession, d: str) -> DataFrame:
    return G.remove_tips(*G.build(dna(spark, d), 9, min_coverage=4), 3)[0].drop("first_seen")


@query(
    f"WITH RECURSIVE {kmers_sql(9)}, {_PRUNED}, {_DEG}, l AS (SELECT src, dst FROM e JOIN g AS a ON a.kmer = src AND a.o = 1 JOIN g AS b ON b.kmer = dst AND b.i = 1 WHERE src <> dst), "
    "c AS (SELECT kmer AS head, kmer AS cur, kmer AS contig FROM g WHERE o = 1 AND kmer NOT IN (SELECT dst FROM l) UNION ALL SELECT head, dst, contig || right(dst, 1) FROM c JOIN l ON src = cur) "
    "SELECT arg_max(contig, length(contig)) AS contig FROM c GROUP BY head HAVING max(length(contig)) >= 10"
)
def contigs(spark: SparkSession, d: str) -> DataFrame:
    return G.contigs(*G.build(dna(spark, d), 9, min_coverage=4), 9).drop("first_seen")


# Translation


def _codes_sql(tables: list[int]) -> str:
    rows = ", ".join(f"({t}, '{c}', '{a}')" for t in tables for c, a in codon_table(t).items() if "U" not in c)
    return f"aa(tbl, c, a) AS (VALUES {rows})"


def _translate_sql(frames: str, broken: bool = True, source: str = "d") -> str:
    """Proteins of strands and frames, one row each: id, frame, protein."""
    body = "coalesce(string_agg(CASE WHEN i IS NOT NULL THEN coalesce(a, 'X') END, '' ORDER BY i), '')"
    cut = f"regexp_extract({body}, '^[^*]*[*]?')" if broken else body
    return f"f AS (SELECT id, frame, t FROM ({frames})), q AS (SELECT f.id, f.frame, i, substr(t, CAST(i AS INT) * 3 + 1 + frame % 3, 3) AS c FROM f, unnest(range(0, (length(t) - frame % 3) // 3)) u(i)), r AS (SELECT f.id, f.frame, tbl, {cut} AS protein FROM f CROSS JOIN (SELECT DISTINCT tbl FROM aa) LEFT JOIN (SELECT q.*, tbl AS tb, a FROM q CROSS JOIN (SELECT DISTINCT tbl FROM aa) LEFT JOIN aa USING (tbl, c)) z ON z.id = f.id AND z.frame = f.frame AND z.tb = tbl GROUP BY ALL)"


_FWD = " UNION ALL ".join(f"SELECT id, {i} AS frame, s AS t FROM d" for i in range(3))
_SIX = _FWD + "".join(f" UNION ALL SELECT id, {i + 3} AS frame, {RC} AS t FROM d" for i in range(3))


@query(f"WITH {D}, {_codes_sql([1])}, {_translate_sql('SELECT id, 0 AS frame, s AS t FROM d')} SELECT id, protein FROM r")
def translate(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("id", TR.translate(F.col("sequence")).alias("protein"))


@query(f"WITH {D}, {_codes_sql([1])}, {_translate_sql(_FWD)} SELECT id, frame, protein FROM r")
def translate_frames(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("id", F.posexplode(TR.translate_frames(F.col("sequence"))).alias("frame", "protein"))


@query(f"WITH {D}, {_codes_sql([1])}, {_translate_sql(_SIX)} SELECT id, frame, protein FROM r")
def six_frames(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("id", F.posexplode(TR.translate_six_frames(F.col("sequence"))).alias("frame", "protein"))


@query(f"WITH {D}, {_codes_sql([1])}, {_translate_sql(_SIX, False)} SELECT id, frame, frame > 2 AS is_reverse, length(s) AS source_length, protein FROM r JOIN d USING (id)")
def translation_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = TR.translation_rows(dna(spark, d), all_frames=True, include_reverse=True, break_on_stop=False)
    return rows.select("id", "frame", "is_reverse", F.col("source_length").cast("long").alias("source_length"), "protein")


_ALL = [n for n, *_ in CODES]


@query(f"WITH {D}, {_codes_sql(_ALL)}, {_translate_sql('SELECT id, 0 AS frame, s AS t FROM d', False)} SELECT id, tbl AS code, md5(protein) AS digest FROM r")
def translate_codes(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("sequence")
    made = F.array(*[F.struct(F.lit(n).alias("code"), F.md5(TR.translate(s, table=n, break_on_stop=False).cast("binary")).alias("digest")) for n in _ALL])
    return dna(spark, d).select("id", F.explode(made).alias("x")).select("id", "x.*")


@query(f"WITH {D}, {_codes_sql([1])}, ch AS (SELECT id * 100000 + j // 300 AS id, substr(s, CAST(j AS INT) + 1, 302) AS t FROM d, unnest(range(0, length(s), 300)) u(j)), {_translate_sql('SELECT id, 0 AS frame, t FROM ch', False)} SELECT id // 100000 AS id, CAST(id % 100000 AS INT) AS chunk, protein FROM r")
def translate_chunked(spark: SparkSession, d: str) -> DataFrame:
    return TR.translate_chunked(dna(spark, d), chunk=300, break_on_stop=False).select("id", "chunk", "protein")


def _orf_sql(partial: bool, least: int = 30) -> str:
    frames = " UNION ALL ".join(f"SELECT id, {i} AS f, '{st}' AS strand, {t} AS t FROM d" for st, t in (("+", "s"), ("-", RC)) for i in range(3))
    z = "coalesce(z, last)" if partial else "z"
    return (
        f"WITH {D}, f AS ({frames}), c AS (SELECT id, f, strand, length(t) AS n, i, substr(t, CAST(i AS INT) * 3 + 1 + f, 3) AS c FROM f, unnest(range(0, (length(t) - f) // 3)) u(i)), "
        "g AS (SELECT *, coalesce(sum(CAST(c IN ('TAA', 'TAG', 'TGA') AS INT)) OVER (PARTITION BY id, strand, f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS isl FROM c), "
        "h AS (SELECT id, strand, f, isl, min(i) FILTER (c = 'ATG') AS a, max(i) FILTER (c IN ('TAA', 'TAG', 'TGA')) AS z, max(i) AS last, any_value(n) AS n FROM g GROUP BY ALL), "
        f"o AS (SELECT *, CAST(({z} - a + 1) * 3 AS INT) AS length, CAST(f + a * 3 AS INT) AS b FROM h WHERE a IS NOT NULL {'' if partial else 'AND z IS NOT NULL'}) "
        f"SELECT id, CAST(CASE strand WHEN '+' THEN b ELSE n - b - length END AS INT) AS start, CAST(CASE strand WHEN '+' THEN b + length ELSE n - b END AS INT) AS end_, CAST(CASE strand WHEN '+' THEN f ELSE -1 - f END AS INT) AS frame, strand, length, z IS NOT NULL AS has_stop FROM o WHERE length >= {least}"
    )


@query(_orf_sql(False))
def orfs(spark: SparkSession, d: str) -> DataFrame:
    return find_orfs(dna(spark, d), min_length=30).drop("orf").withColumnRenamed("end", "end_")


@query(_orf_sql(True))
def orfs_partial(spark: SparkSession, d: str) -> DataFrame:
    return find_orfs(dna(spark, d), min_length=30, include_partial=True).drop("orf").withColumnRenamed("end", "end_")


_CODONS = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in codon_table(1).items() if "U" not in c) + "}"


@query(
    f"WITH x AS ({_orf_sql(False)}), {D}, y AS (SELECT x.*, substr(CASE strand WHEN '+' THEN s ELSE {RC} END, CAST(CASE strand WHEN '+' THEN start ELSE length(s) - end_ END AS INT) + 1, length) AS orf FROM x JOIN d USING (id)) "
    f"SELECT *, array_to_string([{_CODONS}[substr(orf, CAST(i AS INT) * 3 + 1, 3)] FOR i IN range(0, length // 3)], '') AS protein FROM y"
)
def orf_proteins(spark: SparkSession, d: str) -> DataFrame:
    return find_orfs(dna(spark, d), min_length=30, translate=True).withColumnRenamed("end", "end_")


# Statistics and quality

_HIST = "h AS (SELECT length(s) AS length, count(*) AS n FROM d GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY length) AS up, sum(n) OVER (ORDER BY length DESC) AS top, sum(n * length) OVER (ORDER BY length DESC) AS bases, sum(n) OVER () AS cnt, sum(n * length) OVER () AS tot FROM h)"
_N50 = "CAST(min(length) FILTER (up >= greatest(1, cnt // 2)) AS BIGINT) AS median_length, CAST(max(length) FILTER (bases >= tot / 2) AS BIGINT) AS n50, CAST(min(top - n + greatest(1, ceil((tot / 2 - (bases - length * n)) / length))) FILTER (bases >= tot / 2 AND length > 0) AS BIGINT) AS l50"
_COUNT = "CAST(sum(length(s) - length(translate(s, '{0}', ''))) AS BIGINT)"


@query(f"WITH {D.replace('[^ACGT]', '[^ACGTNRY]')}, {_HIST} SELECT * FROM (SELECT count(*) AS total_sequences, CAST(sum(length(s)) AS BIGINT) AS total_bases, {_COUNT.format('RY')} AS ambiguous_bases, CAST(min(length(s)) AS INT) AS min_length, CAST(max(length(s)) AS INT) AS max_length, round(avg(length(s)), 6) AS mean_length, round(stddev_pop(length(s)), 6) AS std_dev_length, round({_COUNT.format('GC')} * 100.0 / sum(length(s)), 6) AS gc_content, round({_COUNT.format('AT')} * 100.0 / sum(length(s)), 6) AS at_content, round({_COUNT.format('N')} * 100.0 / sum(length(s)), 6) AS n_content FROM d), (SELECT {_N50} FROM c)")
def seq_stats(spark: SparkSession, d: str) -> DataFrame:
    out = ST.sequence_stats(dna(spark, d, "ACGTNRY"))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


@query(f"WITH {D} SELECT CAST(length(s) AS INT) AS length, count(*) AS n FROM d GROUP BY 1")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ST.length_histogram(dna(spark, d))


@query(f"WITH {D}, {_HIST} SELECT {_N50} FROM c")
def n50_l50(spark: SparkSession, d: str) -> DataFrame:
    return ST.from_histogram(ST.length_histogram(dna(spark, d)))


@query(f"WITH {D} SELECT id FROM d WHERE length(s) BETWEEN 100 AND 1000")
def length_filter(spark: SparkSession, d: str) -> DataFrame:
    return ST.length_filter(dna(spark, d), 100, 1000).select("id")


_SCORES = {c: ord(QUAL["ACGT".index(c)]) - 33 for c in "ACGT"}
_SUM = " + ".join(f"(length(s) - length(replace(s, '{c}', ''))) * {v}" for c, v in _SCORES.items())


@query(f"WITH {D} SELECT id FROM d WHERE length(s) = 0 OR ({_SUM}) / length(s) >= 10")
def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    return ST.quality_filter(reads(spark, d), 10).select("id")


@query(f"WITH {D} SELECT id, translate(s, 'ACGT', '{''.join(chr(ord(c) + 31) for c in QUAL)}') AS q64, translate(s, 'ACGT', '{QUAL.replace(chr(39), chr(39) * 2)}') AS back, array_to_string([strpos('ACGT', x) - 1 FOR x IN string_split(s, '') IF x <> ''], ',') AS codes FROM d")
def phred(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("quality")
    q64 = Q.convert(q, 33, 64)
    codes = F.array_join(F.transform(Q.decode(q), lambda x: F.array_position(F.array(*[F.lit(_SCORES[c]) for c in "ACGT"]), x).cast("int") - 1), ",")
    return reads(spark, d).select("id", q64.alias("q64"), Q.encode(Q.decode(q64, 64)).alias("back"), codes.alias("codes"))


@query(f"WITH {D} SELECT CAST(sum(length(s)) AS BIGINT) AS total_bases, round(sum({_SUM}) / sum(length(s)), 6) AS mean_quality, {min(_SCORES.values())} AS min_quality, {max(_SCORES.values())} AS max_quality, round({_COUNT.format(''.join(c for c, v in _SCORES.items() if v >= 20))} * 100.0 / sum(length(s)), 6) AS q20_percent, round({_COUNT.format(''.join(c for c, v in _SCORES.items() if v >= 30) or 'x')} * 100.0 / sum(length(s)), 6) AS q30_percent FROM d")
def fastq_stats(spark: SparkSession, d: str) -> DataFrame:
    out = ST.sequence_stats(reads(spark, d), quality="quality")
    return out.select("total_bases", *[F.round(c, 6).alias(c) for c in ("mean_quality",)], "min_quality", "max_quality", *[F.round(c, 6).alias(c) for c in ("q20_percent", "q30_percent")])


# Files


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {D} SELECT 'doc' || id || ' ' || source AS head, s AS sequence FROM d".replace("'doc' || id || ' ' || source AS head", "'doc' || id AS id, source AS description"))
def fasta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "fasta")
    FA.write_fasta(dna(spark, d).select(F.concat(F.lit("doc"), "id").alias("id"), F.col("source").alias("description"), "sequence"), path, gzip=True)
    return FA.read_fasta(spark, path)


@query(f"WITH {D} SELECT 'doc' || id AS id, CAST(NULL AS VARCHAR) AS description, s AS sequence, translate(s, 'ACGT', '{QUAL.replace(chr(39), chr(39) * 2)}') AS quality FROM d")
def fastq_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "fastq")
    FA.write_fastq(reads(spark, d).select(F.concat(F.lit("doc"), "id").alias("id"), F.lit(None).cast("string").alias("description"), "sequence", "quality"), path)
    return FA.read_fastq(spark, path)


@query(f"WITH {D} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(s)) AS BIGINT) AS bases FROM d WHERE length(s) > 0")
def streaming_stats(spark: SparkSession, d: str) -> DataFrame:
    """Running counts of a stream of FASTA files, read to its end."""
    path, out, name = _folder(spark, "stream"), _folder(spark, "stream-state"), f"stream_{tempfile.mktemp(prefix='', dir='').replace('/', '')}"
    FA.write_fasta(dna(spark, d).where("sequence <> ''").select(F.concat(F.lit("doc"), "id").alias("id"), F.col("source").alias("description"), "sequence"), path)
    q = STREAM.stream_totals(spark, path).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _lines(df: DataFrame, *parts) -> DataFrame:
    return spread(df.select(F.concat_ws("\t", *parts).alias("value")))


def _int(c: str):
    return F.col(c).cast("bigint").cast("string")


def bed_lines(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    return _lines(li, F.concat(F.lit("chr"), _int("l_suppkey")), _int("l_partkey"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).cast("string"), F.concat(F.lit("o"), _int("l_orderkey")), (F.col("l_linenumber") * 100).cast("string"), F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise("."))


_BED = "SELECT 'chr' || l_suppkey AS chrom, l_partkey AS chrom_start, l_partkey + CAST(l_quantity AS BIGINT) AS chrom_end, 'o' || l_orderkey AS name, CAST(l_linenumber * 100 AS DOUBLE) AS score, CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '.' END AS strand FROM lineitem"


@query(_BED)
def bed_parse(spark: SparkSession, d: str) -> DataFrame:
    return L.parse_bed(bed_lines(spark, d)).select("chrom", "chrom_start", "chrom_end", "name", "score", "strand")


@query(f"SELECT concat_ws(chr(9), chrom, chrom_start, chrom_end, name, CAST(score AS BIGINT), strand) AS line FROM ({_BED})")
def bed_format(spark: SparkSession, d: str) -> DataFrame:
    return L.parse_bed(bed_lines(spark, d)).select(L.format_bed().alias("line"))


@query("SELECT 'o' || o_orderkey AS id, CAST(o_orderkey AS BIGINT) AS start, o_orderkey + 10 AS end_, o_orderpriority AS note FROM orders")
def gff_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    lines = _lines(o, F.lit("chr1"), F.lit("src"), F.lit("gene"), _int("o_orderkey"), (F.col("o_orderkey") + 10).cast("string"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID=o"), _int("o_orderkey"), F.lit(";Note="), S.uri_encode(F.col("o_orderpriority"))))
    again = L.parse_gff(L.parse_gff(lines).select(L.format_gff().alias("value")))
    return again.select(F.col("attributes")["ID"][0].alias("id"), "start", F.col("end").alias("end_"), F.col("attributes")["Note"][0].alias("note"))


@query("SELECT 'o' || o_orderkey AS gene_id, o_orderstatus AS status, CAST(o_orderkey AS BIGINT) AS start FROM orders")
def gtf_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    lines = _lines(o, F.lit("chr1"), F.lit("src"), F.lit("exon"), _int("o_orderkey"), (F.col("o_orderkey") + 10).cast("string"), F.lit("."), F.lit("+"), F.lit("0"), F.concat(F.lit('gene_id "o'), _int("o_orderkey"), F.lit('"; status "'), "o_orderstatus", F.lit('";')))
    again = L.parse_gff(L.parse_gff(lines, "gtf").select(L.format_gff("gtf").alias("value")), "gtf")
    return again.select(F.col("attributes")["gene_id"][0].alias("gene_id"), F.col("attributes")["status"][0].alias("status"), "start")


@query("SELECT CAST(o_orderkey AS BIGINT) AS pos, 'rs' || o_custkey AS id, CAST(o_custkey AS DOUBLE) AS dp, 0.5 AS af, true AS db, '0|1' AS gt, '.' AS gq FROM orders".replace("0.5 AS af", "CAST(0.5 AS DOUBLE) AS af"))
def vcf_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    lines = _lines(o, F.lit("20"), _int("o_orderkey"), F.concat(F.lit("rs"), _int("o_custkey")), F.lit("G"), F.lit("A,T"), F.lit("29"), F.lit("PASS"), F.concat(F.lit("DP="), _int("o_custkey"), F.lit(";AF=0.5,0.1;DB")), F.lit("GT:GQ"), F.lit("0|1"), F.lit("1|1:48"))
    v = L.parse_vcf(L.parse_vcf(lines).select(L.format_vcf().alias("value")))
    return v.select("pos", "id", F.col("info")["DP"]["d"].alias("dp"), F.col("info")["AF"]["d"].alias("af"), F.col("info")["DB"]["b"].alias("db"), F.col("samples")[0]["GT"].alias("gt"), F.col("samples")[0]["GQ"].alias("gq"))


@query("SELECT CAST(l_orderkey & 4095 AS INT) AS flag, (l_orderkey & 1) <> 0 AS paired, (l_orderkey & 2048) <> 0 AS supplementary, CAST(l_partkey AS BIGINT) AS pos, CAST(l_quantity AS INT) || 'M2I' AS cigar, CAST(l_linenumber AS BIGINT) AS nm, 'g' || l_suppkey AS rg FROM lineitem")
def sam_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    lines = _lines(li, F.concat(F.lit("r"), _int("l_orderkey")), F.col("l_orderkey").bitwiseAND(F.lit(4095)).cast("string"), F.lit("chr1"), _int("l_partkey"), F.lit("60"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M2I")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGT"), F.lit("IIII"), F.concat(F.lit("NM:i:"), F.col("l_linenumber").cast("string")), F.concat(F.lit("RG:Z:g"), _int("l_suppkey")))
    s = L.parse_sam(L.parse_sam(lines).select(L.format_sam().alias("value")))
    return s.select("flag", "flags.paired", "flags.supplementary", "pos", "cigar", F.col("tags")["NM"]["i"].alias("nm"), F.col("tags")["RG"]["z"].alias("rg"))


@query("SELECT l_orderkey, l_linenumber, q AS matches, 2 AS insertions, 3 AS deletions, 4 AS soft_clips, q + 5 AS aligned_length, q + 3 AS reference_length, q + 6 AS query_length, 4 AS ops, true AS ok, q || 'M2I3D4S' AS cigar FROM (SELECT *, CAST(l_quantity AS INT) AS q FROM lineitem)")
def cigar_stats(spark: SparkSession, d: str) -> DataFrame:
    c = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M2I3D4S"))
    x = S.pin(spread(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.alias("c"))), "o", C.parse(F.col("c")))
    x = S.pin(x, "s", C.stats(F.col("o")))
    return x.select("l_orderkey", "l_linenumber", *[f"s.{k}" for k in ("matches", "insertions", "deletions", "soft_clips", "aligned_length", "reference_length", "query_length")], F.size("o").alias("ops"), C.valid(F.col("c")).alias("ok"), C.format_ops(F.col("o")).alias("cigar"))


@query("SELECT l_orderkey, l_linenumber, repeat('A', q) || 'CC' || '---' || 'gggg' AS query, repeat('A', q) || '--' || 'NNN' || '----' AS reference FROM (SELECT *, CAST(l_quantity AS INT) AS q FROM lineitem)")
def cigar_aligned(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    c, s = F.concat(q.cast("string"), F.lit("M2I3D4S")), F.concat(F.repeat(F.lit("A"), q), F.lit("CCGGGG"))
    return spread(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")).select("l_orderkey", "l_linenumber", C.aligned(c, s).alias("x")).select("l_orderkey", "l_linenumber", "x.query", "x.reference")


@query("SELECT CAST(l_orderkey & 4095 AS BIGINT) AS flag, (l_orderkey & 4) <> 0 AS unmapped, (l_orderkey & 256) <> 0 AS secondary FROM lineitem")
def sam_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = C.decode_flags(F.col("l_orderkey").bitwiseAND(F.lit(4095)))
    return read(spark, d, "lineitem").select(flags.alias("f")).select(C.encode_flags(F.col("f")).cast("bigint").alias("flag"), "f.unmapped", "f.secondary")


@query("WITH o AS (SELECT o_orderkey AS id, 'c' || (o_custkey % 97) AS chrom, o_custkey AS a, o_custkey + 40 AS z FROM orders), s AS (SELECT s_suppkey AS id, 'c' || (s_suppkey % 97) AS chrom, s_suppkey AS a, s_suppkey + 25 AS z FROM supplier) SELECT o.id AS id1, s.id AS id2, o.chrom, greatest(o.a, s.a) AS overlap_start, least(o.z, s.z) AS overlap_end FROM o JOIN s ON o.chrom = s.chrom AND o.a < s.z AND s.a < o.z")
def interval_overlaps(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), (F.col("o_custkey") % 97).cast("string")).alias("chrom"), F.col("o_custkey").alias("chrom_start"), (F.col("o_custkey") + 40).alias("chrom_end"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("c"), (F.col("s_suppkey") % 97).cast("string")).alias("chrom"), F.col("s_suppkey").alias("chrom_start"), (F.col("s_suppkey") + 25).alias("chrom_end"))
    return L.overlaps(o, s, 64)


# Trees and flat files


@query("SELECT r_regionkey AS tree_id, count(*) AS leaf_count, 1 AS max_depth, round(sum(n_nationkey + 0.5), 6) AS total_length, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1".replace("round(sum(n_nationkey + 0.5), 6)", "round(sum(CAST(n_nationkey AS DOUBLE) + 0.5), 6)"))
def newick_stats(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    lines = n.select(F.col("n_regionkey").alias("tree_id"), F.concat(F.lit("("), F.array_join(F.transform("ns", lambda x: F.concat(x["n_name"], F.lit(":"), (x["n_nationkey"] + 0.5).cast("string"))), ","), F.lit(")root;")).alias("value"))
    nodes = TREE.parse_newick(lines)
    again = TREE.parse_newick(TREE.format_newick(nodes))
    s = TREE.tree_stats(again)
    return s.select("tree_id", "leaf_count", "max_depth", F.round("total_length", 6).alias("total_length"), F.array_join("leaf_names", ",").alias("names"))


@query(f"WITH {D} SELECT 'D' || id AS locus, 'text of ' || source AS definition, s AS sequence FROM d")
def genbank_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    x = dna(spark, d)
    text = TREE.fasta_to_genbank(F.concat(F.lit("D"), "id"), F.concat(F.lit("text of "), "source"), F.col("sequence"), "20200101")
    return x.select(TREE.parse_genbank(text).alias("r")).select("r.locus", "r.definition", "r.sequence")


@query("SELECT 'N' || n_nationkey AS id, n_name AS description, 'ACGTACGT' AS sequence, 'ACC' || n_nationkey AS accession FROM nation")
def embl_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("ID   N"), F.col("n_nationkey").cast("string"), F.lit("; SV 1; linear; DNA; STD; UNC; 8 BP.\nAC   ACC"), F.col("n_nationkey").cast("string"), F.lit(";\nDE   "), "n_name", F.lit('\nFT   gene            1..8\nFT                   /gene="g"\nSQ   Sequence 8 BP;\n     acgtacgt                 8\n//'))
    return read(spark, d, "nation").select(TREE.parse_embl(text).alias("r")).select("r.id", "r.description", "r.sequence", "r.accession")


@query("SELECT 'ACC' || n_nationkey AS id, n_name AS description, 'ACGTACGT' AS sequence FROM nation UNION ALL SELECT 'g' || n_nationkey, n_name || ' part', 'CGTA' FROM nation")
def genbank_features(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("LOCUS       N"), key, F.lit(" 8 bp DNA\nDEFINITION  "), "n_name", F.lit("\nACCESSION   ACC"), key, F.lit('\nFEATURES             Location/Qualifiers\n     CDS             2..5\n                     /gene="g'), key, F.lit('"\n                     /product="'), "n_name", F.lit(' part"\nORIGIN\n        1 acgtacgt\n//'))
    records = read(spark, d, "nation").select(TREE.parse_genbank(text).alias("r")).select("r.*")
    return TREE.genbank_to_fasta(records, include_features=True)


# Rows that share an id: each is read by itself


def _seven(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).withColumn("id", F.when(F.col("id") % 7 > 0, F.col("id") % 7))


@query(f"WITH {kmers_sql(5)}, {_min_sql("{'kmer': kmer, 'pos': pos}")} SELECT nullif(id % 7, 0) AS id, b.kmer AS kmer, b.pos AS pos FROM m")
def minimizers_repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return M.minimizers(_seven(spark, d), 5, 10)


@query(f"WITH {_HASHED}, {_min_sql("{'hash': hash, 'pos': pos, 'kmer': kmer}")} SELECT nullif(id % 7, 0) AS id, b.hash AS hash, b.pos AS pos, b.kmer AS kmer FROM m")
def hash_minimizers_repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return M.hash_minimizers(_seven(spark, d), 5, 10)


@query(ORACLE_SQL["super_kmers"].replace("SELECT id, part", "SELECT nullif(id % 7, 0) AS id, part"))
def super_kmers_repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return K.super_kmers(_seven(spark, d), 4, canonical_=True)


@query(ORACLE_SQL["debruijn_edges"])
def debruijn_edges_repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return G.build(_seven(spark, d), 7)[1].drop("first_seen")


@query(ORACLE_SQL["orfs"].replace("SELECT id, CAST(CASE", "SELECT nullif(id % 7, 0) AS id, CAST(CASE"))
def orfs_repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return find_orfs(_seven(spark, d), min_length=30).drop("orf").withColumnRenamed("end", "end_")


# Keys that repeat, headers, texts of whole files


@query("SELECT 'r' || l_orderkey AS qname, CAST(l_suppkey AS BIGINT) AS nm, 'z' || l_linenumber AS rg, 2 AS tags FROM lineitem")
def sam_duplicate_tags(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda k, c: F.concat(F.lit(k), F.col(c).cast("bigint").cast("string"))
    li = _lines(read(spark, d, "lineitem"), tag("r", "l_orderkey"), F.lit("0\tchr1\t7\t60\t4M\t*\t0\t0\tACGT\tIIII"), tag("NM:i:", "l_partkey"), tag("RG:Z:a", "l_suppkey"), tag("NM:i:", "l_suppkey"), tag("RG:Z:z", "l_linenumber"))
    return L.parse_sam(li).select("qname", F.col("tags")["NM"]["i"].alias("nm"), F.col("tags")["RG"]["z"].alias("rg"), F.size("tags").alias("tags"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS pos, CAST(o_custkey AS DOUBLE) AS dp, '1|1' AS gt, 2 AS keys, 'DP=' || o_custkey || ';DB' AS info FROM orders")
def vcf_duplicate_info(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(read(spark, d, "orders"), F.lit("20"), _int("o_orderkey"), F.lit(".\tG\tA\t.\tPASS"), F.concat(F.lit("DP=1;DB;DP="), _int("o_custkey")), F.lit("GT:GT\t0|1:1|1"))
    v = L.parse_vcf(lines)
    text = F.array_join(F.transform(F.map_entries("info"), lambda e: F.when(e["value"]["b"], e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]["s"]))), ";")
    return v.select("pos", F.col("info")["DP"]["d"].alias("dp"), F.col("samples")[0]["GT"].alias("gt"), F.size("info").alias("keys"), text.alias("info"))


@query("SELECT 'SQ' AS kind, 'chr' || s_suppkey AS sn, CAST(s_suppkey * 10 AS VARCHAR) AS ln, CAST(NULL AS VARCHAR) AS comment FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT 'CO', NULL, NULL, 'of ' || s_name || chr(9) || 'x' FROM supplier UNION ALL SELECT 'HD', NULL, NULL, NULL")
def sam_header(spark: SparkSession, d: str) -> DataFrame:
    """A whole SAM file, written with its header and read back: the header's lines."""
    s = read(spark, d, "supplier")
    key = _int("s_suppkey")
    head = L.with_header(spark, ["@HD\tVN:1.6\tSO:unsorted\tSO:coordinate", "@SQ\tSN:none\tLN:0"], s.select(F.explode(F.array(F.concat(F.lit("@SQ\tSN:chr"), key, F.lit("\tLN:5\tLN:"), key, F.lit("0")), F.concat(F.lit("@CO\tof "), "s_name", F.lit("\tx")))).alias("value")))
    body = s.select(F.concat(F.lit("r"), key, F.lit("\t0\tchr1\t7\t60\t4M\t*\t0\t0\tACGT\tIIII")).alias("value"))
    path = _folder(spark, "sam")
    L.write_lines(spark, L.parse_sam_header(head).select(L.format_sam_header().alias("value")), body, path)
    back = L.parse_sam_header(spark.read.text(path))
    return back.select("kind", F.col("fields")["SN"].alias("sn"), F.col("fields")["LN"].alias("ln"), "comment")


@query("SELECT 'contig' AS kind, 'c' || s_suppkey AS id, CAST(s_suppkey AS VARCHAR) AS length, 0 AS samples FROM supplier UNION ALL SELECT 'info', 'DP', NULL, 0 UNION ALL SELECT 'fileformat', NULL, NULL, 0 UNION ALL SELECT 'samples', NULL, NULL, 2")
def vcf_header(spark: SparkSession, d: str) -> DataFrame:
    """A whole VCF file, written with its header and read back: the header's lines."""
    s = read(spark, d, "supplier")
    head = L.format_vcf_header("VCFv4.2", [], [{"ID": "DP", "Number": "1", "Type": "Integer", "Description": "Depth, total"}], [], [], ["a", "b"])
    contigs = s.select(F.concat(F.lit("##contig=<ID=x,ID=c"), _int("s_suppkey"), F.lit(",length="), _int("s_suppkey"), F.lit(">")).alias("value"))
    path = _folder(spark, "vcf")
    L.write_lines(spark, head, contigs.unionByName(s.select(F.concat(F.lit("20\t"), _int("s_suppkey"), F.lit("\t.\tA\tC\t.\t.\tDB\tGT\t0|1\t1|1")).alias("value"))), path)
    h = L.parse_vcf_header(spark.read.text(path))
    return h.select("kind", F.col("fields")["ID"].alias("id"), F.col("fields")["length"].alias("length"), F.when(F.col("kind") == "samples", F.size("values")).otherwise(0).alias("samples"))


@query("SELECT c_custkey AS id, CAST(pos AS INT) AS pos, 'a' || pos AS rec, CASE pos WHEN 0 THEN 'of ' || c_custkey END AS description, 'ACGT' || repeat('G', c_custkey % 5) AS sequence FROM customer, unnest(range(0, 2)) t(pos)")
def fasta_text(spark: SparkSession, d: str) -> DataFrame:
    """Two records in a text column of every customer."""
    g = F.repeat(F.lit("G"), (F.col("c_custkey") % 5).cast("int"))
    text = F.concat(F.lit("junk\n>a0 of "), F.col("c_custkey").cast("string"), F.lit("\n ACGT \n\n"), g, F.lit("\n>\nAA\n>a1\nACGT"), g)
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.alias("value"))
    found = FA.parse_fasta_text(rows.withColumnRenamed("id", "key"), keep=("key",))
    return found.select(F.col("key").alias("id"), F.when(F.col("id") == "a0", 0).otherwise(1).alias("pos"), F.col("id").alias("rec"), "description", "sequence")


@query("SELECT c_custkey AS k_id, 'q' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'even' END AS description, 'ACG' AS sequence, '@+I' AS quality FROM customer")
def fastq_text(spark: SparkSession, d: str) -> DataFrame:
    """A record, a blank line and an unfinished record in a text column of every customer."""
    text = F.concat(F.lit("@q"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, " even").otherwise(""), F.lit("\nACG\n+\n@+I\n@cut\nA"))
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.alias("value"))
    return FA.parse_fastq_text(rows).select("k_id", "id", "description", "sequence", "quality")


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'ACC' || n_nationkey ELSE 'N' || n_nationkey END AS id, n_name || ' more' AS description, 'ACGTACGT' AS sequence FROM nation")
def embl_to_fasta(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    accession = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("AC   ACC"), key, F.lit(";\n"))).otherwise("")
    text = F.concat(F.lit("ID   N"), key, F.lit("; SV 1; linear; DNA; STD; UNC; 8 BP.\n"), accession, F.lit("DE   "), "n_name", F.lit("\nDE   more\nSQ   Sequence 8 BP;\n     acgtacgt                 8\n//"))
    return TREE.embl_to_fasta(read(spark, d, "nation").select(TREE.parse_embl(text).alias("r")).select("r.*"))


@query("SELECT n_nationkey AS id, n_nationkey % 3 = 0 AS ok FROM nation")
def newick_valid(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("n_name")
    text = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("(("), name, F.lit(":1,B)x:0.5,C);"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("(("), name, F.lit(",B);"))).otherwise(F.concat(F.lit("("), name, F.lit(":z,B);")))
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), TREE.is_newick(text).alias("ok"))


@query(f"WITH {D} SELECT id, regexp_full_match(s, '[ACGT]*') AS ok, CAST(length(s) AS INT) AS bases FROM d")
def strict_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Strict mode lets every sequence of bases through."""
    s = S.strict(F.col("sequence"))
    return dna(spark, d).select("id", S.is_nucleotides(F.col("sequence")).alias("ok"), F.length(s).alias("bases"))


@query(f"WITH {D}, {_codes_sql([1])}, {_translate_sql('SELECT id, 0 AS frame, s AS t FROM d')} SELECT 'doc' || id AS id, protein FROM r WHERE protein <> '' OR id IN (SELECT id FROM d WHERE s <> '')")
def streaming_translate(spark: SparkSession, d: str) -> DataFrame:
    """Translations of a stream of FASTA files, read to its end."""
    path, state, out = _folder(spark, "stream"), _folder(spark, "stream-state"), _folder(spark, "stream-out")
    FA.write_fasta(dna(spark, d).where("sequence <> ''").select(F.concat(F.lit("doc"), "id").alias("id"), F.col("source").alias("description"), "sequence"), path)
    q = STREAM.stream_translations(spark, path).writeStream.outputMode("append").format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.parquet(out).select("id", "protein")


# Alignment: every nation's name against its region's


def _names(spark: SparkSession, d: str) -> DataFrame:
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("seq1"), F.col("r_name").alias("seq2"))


def _self_score() -> str:
    from strandlake.functions.tables import AMINO, get_matrix

    m = get_matrix("BLOSUM62")
    return " + ".join(f"(length(n_name) - length(replace(upper(n_name), '{c}', ''))) * {m[c, c]}" for c in AMINO)


@query(f"SELECT n_nationkey AS id, CAST({_self_score()} AS DOUBLE) AS score, length(n_name) AS alignment_length, n_name AS aligned FROM nation".replace("length(n_name) AS alignment_length", "CAST(length(n_name) AS INT) AS alignment_length"))
def align_self(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("seq1"), F.col("n_name").alias("seq2"))
    return AL.align(x, "global", normalise=False).select("id", "score", "alignment_length", F.col("aligned_seq1").alias("aligned"))


def _worth_sql() -> str:
    """BLOSUM62 of the letters x and y."""
    from strandlake.functions.tables import get_matrix

    table = get_matrix("BLOSUM62")
    letters = sorted({a for a, _ in table})
    return f"CASE WHEN strpos('{''.join(letters)}', x) * strpos('{''.join(letters)}', y) > 0 THEN [{', '.join(str(table[a, b]) for a in letters for b in letters)}][(strpos('{''.join(letters)}', x) - 1) * {len(letters)} + strpos('{''.join(letters)}', y)] ELSE 0 END"


def _align_sql(mode: str, gap_open: int = -10, gap_extend: int = -1, bandwidth: int | None = None) -> str:
    """A cell a step, in reading order, of every pair; then a step of the way back at a time.

    Lists hold the cells so far: the score, the way (0 none, 1 both, 2 first, 3 second) and the best gaps that end there.
    """
    worth = _worth_sql()
    low, clean, single = "CAST(-1e18 AS DOUBLE)", mode in ("global", "local"), mode in ("global", "local")
    ramp = lambda k, open_: f"{gap_open} + ({k} - 1) * {gap_extend}" if open_ else "0"
    top, side = mode in ("global", "banded"), mode in ("global", "banded", "overlap")
    inside = f"abs(i - j) <= {bandwidth}" if bandwidth is not None else "true"
    up = f"uh + CASE uw WHEN '2' THEN {gap_extend} ELSE {gap_open} END" if single else f"greatest(uh + {gap_open}, ue + {gap_extend})"
    left = f"lh + CASE lw WHEN '3' THEN {gap_extend} ELSE {gap_open} END" if single else f"greatest(lh + {gap_open}, lg + {gap_extend})"
    best = "greatest(dg, up, lft)"
    way = f"CASE WHEN dg = {best} THEN '1' WHEN up = {best} THEN '2' ELSE '3' END"
    if mode == "local":
        way, best = f"CASE WHEN {best} > 0 THEN {way} ELSE '0' END", f"greatest({best}, 0)"
    free = "i * j > 0"
    most = "list_position(h, list_max(h)) - 1"
    by_row, by_column = "list_position(h[CAST(m * (n + 1) + 1 AS INT):], list_max(h[CAST(m * (n + 1) + 1 AS INT):])) - 1", "list_position(c, list_max(c)) - 1"
    end = {
        "local": (f"({most}) // (n + 1)", f"({most}) % (n + 1)"),
        "overlap": (by_column, "n"),
        "semi": (f"CASE WHEN list_max(c) > list_max(h[CAST(m * (n + 1) + 1 AS INT):]) THEN {by_column} ELSE m END", f"CASE WHEN list_max(c) > list_max(h[CAST(m * (n + 1) + 1 AS INT):]) THEN n ELSE {by_row} END"),
    }.get(mode, ("m", "n"))
    go = "h[CAST(i * (n + 1) + j + 1 AS INT)] > 0" if mode == "local" else "true"
    loose = mode in ("semi", "overlap")
    one, two = ("repeat('-', bj) || substr(a, 1, bi) || x || substr(a, ei + 1) || repeat('-', n - ej)", "substr(b, 1, bj) || repeat('-', bi) || y || repeat('-', m - ei) || substr(b, ej + 1)") if loose else ("x", "y")
    name = (lambda c: f"upper(trim({c}))") if clean else (lambda c: c)
    return f"""WITH RECURSIVE p AS (SELECT *, CAST(length(a) AS INT) AS m, CAST(length(b) AS INT) AS n FROM (SELECT n_nationkey AS id, n_name AS seq1, r_name AS seq2, {name('n_name')} AS a, {name('r_name')} AS b FROM nation JOIN region ON n_regionkey = r_regionkey{f' WHERE abs(length(n_name) - length(r_name)) <= {bandwidth}' if bandwidth is not None else ''})),
f AS (SELECT id, 0 AS k, [CAST(0 AS DOUBLE)] AS h, '0' AS w, [{low}] AS e, [{low}] AS g FROM p UNION ALL
SELECT id, k + 1, list_append(h, CAST(CASE WHEN NOT {inside} THEN {low} WHEN {free} THEN {best} WHEN i = 0 THEN {ramp('j', top)} ELSE {ramp('i', side)} END AS DOUBLE)),
w || CASE WHEN {free} THEN CASE WHEN {inside} THEN {way} ELSE '0' END WHEN i = 0 THEN '{'3' if top else '0'}' ELSE '{'2' if side else '0'}' END,
list_append(e, CASE WHEN {free} AND {inside} THEN CAST(up AS DOUBLE) ELSE {low} END), list_append(g, CASE WHEN {free} AND {inside} THEN CAST(lft AS DOUBLE) ELSE {low} END)
FROM (SELECT *, dh + {worth} AS dg, {up} AS up, {left} AS lft FROM (SELECT f.*, m, n, (k + 1) // (n + 1) AS i, (k + 1) % (n + 1) AS j, h[k - n] AS dh, h[k + 1 - n] AS uh, h[k + 1] AS lh, substr(w, k + 1 - n, 1) AS uw, substr(w, k + 1, 1) AS lw, e[k + 1 - n] AS ue, g[k + 1] AS lg,
upper(substr(a, (k + 1) // (n + 1), 1)) AS x, upper(substr(b, (k + 1) % (n + 1), 1)) AS y FROM f JOIN p USING (id) WHERE k + 1 < (m + 1) * (n + 1)))),
z AS (SELECT id, h, w, CAST({end[0]} AS INT) AS ei, CAST({end[1]} AS INT) AS ej FROM (SELECT f.*, m, n, [h[CAST(v * (n + 1) + n + 1 AS INT)] FOR v IN range(0, m + 1)] AS c FROM f JOIN p USING (id) WHERE k + 1 = (m + 1) * (n + 1))),
t AS (SELECT id, 0 AS step, ei AS i, ej AS j, '' AS x, '' AS y FROM z UNION ALL
SELECT id, step + 1, CAST(i - CAST(v <> '3' AS INT) AS INT), CAST(j - CAST(v <> '2' AS INT) AS INT), CASE v WHEN '3' THEN '-' ELSE substr(a, i, 1) END || x, CASE v WHEN '2' THEN '-' ELSE substr(b, j, 1) END || y
FROM (SELECT t.*, a, b, substr(w, i * (n + 1) + j + 1, 1) AS v, {go} AS go FROM t JOIN p USING (id) JOIN z USING (id)) WHERE go AND (v = '1' AND i * j > 0 OR v = '2' AND i > 0 OR v = '3' AND j > 0)),
r AS (SELECT id, max(step) AS steps, arg_max(i, step) AS bi, arg_max(j, step) AS bj, arg_max(x, step) AS x, arg_max(y, step) AS y FROM t GROUP BY id),
o AS (SELECT id, seq1, seq2, {one} AS aligned_seq1, {two} AS aligned_seq2, h[CAST(ei * (n + 1) + ej + 1 AS INT)] AS score, bi, bj, ei, ej FROM p JOIN z USING (id) JOIN r USING (id)),
s AS (SELECT *, CAST(len([v FOR v IN range(1, length(aligned_seq1) + 1) IF aligned_seq1[v] = aligned_seq2[v] AND aligned_seq1[v] <> '-']) AS INT) AS identity, CAST(length(aligned_seq1) AS INT) AS alignment_length FROM o)
SELECT id, seq1, seq2, aligned_seq1, aligned_seq2, score, {'bi' if mode == 'local' else 'CAST(0 AS INT)'} AS start_pos1, {'bj' if mode == 'local' else 'CAST(0 AS INT)'} AS start_pos2, ei AS end_pos1, ej AS end_pos2, identity, CASE WHEN alignment_length > 0 THEN CAST(100 AS DOUBLE) * identity / alignment_length ELSE 0 END AS identity_percent, alignment_length FROM s"""


def _align(mode: str, **options):
    def run(spark: SparkSession, d: str) -> DataFrame:
        x = _names(spark, d)
        if mode == "banded":
            x = x.where(F.abs(F.length("seq1") - F.length("seq2")) <= options["bandwidth"])
        return AL.align(x, mode, **options)

    run.__name__ = f"align_{mode}"
    return run


for _mode, _options in (("global", {}), ("local", {}), ("semi", {}), ("overlap", {}), ("banded", {"bandwidth": 10})):
    query(_align_sql(_mode, **_options))(_align(_mode, **_options))


def _halving_sql(gap: int = -1, levels: int = 5) -> str:
    """The first sequence is halved until single letters remain; a level is a table of the parts so far, in order.

    Of each part, the rows of scores of its halves (side 0 in order, side 1 against the reversed second sequence) are
    filled a cell a step, and the second sequence is cut where their sum is first greatest.
    """
    worth = _worth_sql()
    parts = "s0 AS (SELECT n_nationkey AS id, '' AS place, n_name AS s, r_name AS t FROM nation JOIN region ON n_regionkey = r_regionkey)"
    for v in range(levels):
        parts += f""",
u{v} AS (SELECT id, place, side, CAST(length(x) AS INT) AS m, CAST(length(y) AS INT) AS n, x AS u, y AS v FROM (SELECT id, place, 0 AS side, substr(s, 1, length(s) // 2) AS x, t AS y FROM s{v} WHERE length(s) > 1 AND t <> '' UNION ALL SELECT id, place, 1, substr(s, length(s) // 2 + 1), reverse(t) FROM s{v} WHERE length(s) > 1 AND t <> '')),
f{v} AS (SELECT id, place, side, 0 AS k, [0] AS h FROM u{v} UNION ALL SELECT id, place, side, k + 1, list_append(h, CAST(CASE WHEN i * j = 0 THEN (i + j) * {gap} ELSE greatest(h[k - n] + {worth}, h[k + 1 - n] + {gap}, h[k + 1] + {gap}) END AS INT))
FROM (SELECT f.id, f.place, f.side, k, h, n, (k + 1) // (n + 1) AS i, (k + 1) % (n + 1) AS j, upper(substr(u, (k + 1) // (n + 1), 1)) AS x, upper(substr(v, (k + 1) % (n + 1), 1)) AS y FROM f{v} AS f JOIN u{v} AS u ON f.id = u.id AND f.place = u.place AND f.side = u.side WHERE k + 1 < (m + 1) * (n + 1))),
r{v} AS (SELECT f.id, f.place, f.side, n, h[CAST(m * (n + 1) + 1 AS INT):] AS h FROM f{v} AS f JOIN u{v} AS u ON f.id = u.id AND f.place = u.place AND f.side = u.side WHERE k + 1 = (m + 1) * (n + 1)),
c{v} AS (SELECT id, place, list_position(q, list_max(q)) - 1 AS cut FROM (SELECT a.id, a.place, [a.h[CAST(j + 1 AS INT)] + b.h[CAST(a.n + 1 - j AS INT)] FOR j IN range(0, a.n + 1)] AS q FROM r{v} AS a JOIN r{v} AS b ON a.id = b.id AND a.place = b.place WHERE a.side = 0 AND b.side = 1)),
s{v + 1} AS (SELECT s.* FROM s{v} AS s ANTI JOIN c{v} USING (id, place) UNION ALL SELECT id, place || '0', substr(s, 1, length(s) // 2), substr(t, 1, cut) FROM s{v} JOIN c{v} USING (id, place) UNION ALL SELECT id, place || '1', substr(s, length(s) // 2 + 1), substr(t, cut + 1) FROM s{v} JOIN c{v} USING (id, place))"""
    return f"""WITH RECURSIVE {parts},
w AS (SELECT *, [{worth} FOR y IN string_split(upper(t), '')] AS q FROM (SELECT *, upper(s) AS x FROM s{levels})),
l AS (SELECT *, CASE WHEN list_max(q) + (length(t) - 1) * {gap} > (length(t) + 1) * {gap} THEN list_position(q, list_max(q)) - 1 ELSE 0 END AS c FROM w),
e AS (SELECT id, string_agg(CASE WHEN t = '' THEN s ELSE repeat('-', c) || s || repeat('-', length(t) - c - 1) END, '' ORDER BY place) AS aligned_seq1, string_agg(CASE WHEN t = '' THEN repeat('-', length(s)) ELSE t END, '' ORDER BY place) AS aligned_seq2 FROM l GROUP BY id),
z AS (SELECT id, CAST(sum(CASE WHEN x = '-' OR y = '-' THEN {gap} ELSE {worth} END) AS DOUBLE) AS score, CAST(count(*) FILTER (x = y AND x <> '-') AS INT) AS identity, CAST(count(*) AS INT) AS alignment_length FROM (SELECT id, upper(aligned_seq1[CAST(i AS INT)]) AS x, upper(aligned_seq2[CAST(i AS INT)]) AS y FROM e, unnest(range(1, length(aligned_seq1) + 1)) AS r(i)) GROUP BY id)
SELECT id, s AS seq1, t AS seq2, aligned_seq1, aligned_seq2, score, CAST(0 AS INT) AS start_pos1, CAST(0 AS INT) AS start_pos2, CAST(length(s) AS INT) AS end_pos1, CAST(length(t) AS INT) AS end_pos2, identity, CAST(100 AS DOUBLE) * identity / alignment_length AS identity_percent, alignment_length FROM s0 JOIN e USING (id) JOIN z USING (id)"""


query(_halving_sql())(_align("hirschberg"))
