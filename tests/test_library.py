"""Facts about small inputs, laws, and the catalogue against DuckDB."""

import glob
import os
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.functions import cigar as C
from strandlake.functions import quality as Q
from strandlake.functions import sequence as S
from strandlake.functions import tables as T
from strandlake.functions import translation as TR
from strandlake.operators import align as AL
from strandlake.operators import debruijn as G
from strandlake.operators import kmers as K
from strandlake.operators import minimizers as M
from strandlake.operators import orfs as ORFS
from strandlake.operators import stats as ST
from strandlake.operators.orfs import find_orfs
from strandlake.sources import fasta as FA
from strandlake.sources import lines as L
from strandlake.sources import trees as TREE

SF = "/root/testdata/sf0.001"


def frame(spark, *seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "id int, sequence string")


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_sequences(spark):
    r = random.Random(1)
    seqs = ["".join(r.choice("ACGTNacgt") for _ in range(r.randrange(40))) for _ in range(50)]
    c = F.col("sequence")
    for row in frame(spark, *seqs).select("sequence", S.reverse_complement(S.reverse_complement(c)).alias("twice"), S.rna_to_dna(S.dna_to_rna(c)).alias("back")).collect():
        assert row.sequence == row.twice == row.back
    assert one(spark, S.complement(F.col("a")), a="AUGCNt") == "UACGNt"
    assert one(spark, S.trim(F.col("a")), a="\t A\n") == "A"
    assert one(spark, S.parse_int(F.col("a")), a="12abc") == 12
    assert one(spark, S.uri_decode(F.col("a")), a="a+b%20c") == "a+b c"
    assert one(spark, S.uri_encode(F.col("a")), a="a b!(~)") == "a%20b!(~)"


def test_qualities(spark):
    assert one(spark, Q.decode(F.col("q")), q="I#") == [40, 2]
    assert one(spark, Q.convert(Q.convert(F.col("q"), 33, 64), 64, 33), q="I#5") == "I#5"


def test_kmers(spark):
    rows = lambda s, k, **o: [r.kmer for r in K.kmer_rows(frame(spark, s), k, **o).orderBy("pos").collect()]
    assert rows("ATCG", 2) == ["AT", "TC", "CG"]
    assert rows("ATCG", 2, canonical_=True) == ["AT", "GA", "CG"]
    assert rows("ATNNCG", 3) == ["ATN", "TNN", "NNC", "NCG"]
    assert rows("AT", 3) == []
    long = "".join(random.Random(2).choice("ACGT") for _ in range(1500))
    assert rows(long, 7) == [long[i : i + 7] for i in range(len(long) - 6)]
    with pytest.raises(ValueError):
        K.kmer_rows(frame(spark, "A"), 0)


def test_minimizers(spark):
    got = sorted((r.pos, r.kmer) for r in M.minimizers(frame(spark, "AAAAAAAAAA"), 2, 3).collect())
    assert [k for _, k in got] == ["AA"] * len(got) and got[0][0] == 0
    assert M.minimizers(frame(spark, "ACG"), 2, 9).count() == 0


def spelling_hash(x):
    h = 0
    for c in x:
        h = (h * 31 + ord(c) + (1 << 31)) % (1 << 32) - (1 << 31)
    return abs(h)


@pytest.mark.parametrize("canonical", [False, True])
def test_minimizers_of_pieces(spark, monkeypatch, canonical):
    """A sequence that is cut has the minimizers of the whole, and none is computed by an expression for each k-mer."""
    r = random.Random(9)
    rows = [(r.choice([None, 1, 2]), "".join(r.choice("ACGTU" if i % 2 else "ACGTN\u00c9\U0001f600") for _ in range(r.randrange(60)))) for i in range(30)] + [(3, None), (3, "A" * 40)]
    df = spark.createDataFrame(rows, "id int, sequence string").coalesce(1)
    least = lambda x: min(x, x.translate(str.maketrans("AUGC", "UACG") if "U" in x else str.maketrans("ATGC", "TACG"))[::-1]) if canonical else x
    for k, w in ((5, 10), (3, 1), (34, 2)):
        for hash_, of, column in ((spelling_hash, M.hash_minimizers, "hash"), (str, M.minimizers, "kmer")):
            want = []
            for id_, s in rows:
                kmers = [least(s[i : i + k]) for i in range(len(s or "") - k + 1)]
                found = {min((hash_(x), i, x) for i, x in enumerate(kmers[j : j + w], j)) for j in range(len(kmers) - w + 1)}
                want += [(id_ or 0, *x) for x in found]
            for size in (1, 7, 1 << 20):
                monkeypatch.setattr(M, "LETTERS", size, raising=False)
                got = of(df, k, w, canonical_=canonical)
                assert sorted((x.id or 0, x[column], x.pos, x.kmer) for x in got.collect()) == sorted(want)
                assert "array_min" not in got._jdf.queryExecution().toString()


def test_minimizer_arrays(spark, monkeypatch):
    monkeypatch.setattr(M, "LETTERS", 3, raising=False)
    df = frame(spark, "ATCGATCGATCG", None, "", "AAAAAAAAAA", "ATC").coalesce(1)
    got = df.select("id", M.minimizer_array(F.col("sequence"), 3, 4).alias("a"))
    want = {i: [x.kmer for x in M.minimizers(df.where(F.col("id") == i), 3, 4).orderBy("pos").collect()] for i in range(5)}
    assert {x.id: x.a for x in got.collect()} == want and len(want[3]) == 5 and want[1] == want[2] == want[4] == []
    assert "array_min" not in got._jdf.queryExecution().toString()
    custom = M.hash_minimizers(df, 3, 4, hash_=lambda c: -F.length(c))
    assert sorted((x.id, x.pos) for x in custom.collect()) == [(i, j) for i, n in ((0, 7), (3, 5)) for j in range(n)]


def contigs_of(reads, k, least):
    """An independent model: walk from every start node."""
    out, into, nodes = {}, {}, {}
    for s in reads:
        ks = [s[i : i + k] for i in range(len(s) - k + 1)]
        for x in ks:
            nodes[x] = nodes.get(x, 0) + 1
        for a, b in zip(ks, ks[1:]):
            out.setdefault(a, set()).add(b)
            into.setdefault(b, set()).add(a)
    found = []
    for n in nodes:
        if len(out.get(n, ())) != 1:
            continue
        before = into.get(n, set())
        if len(before) == 1 and len(out[next(iter(before))]) == 1 and next(iter(before)) != n:
            continue
        if len(before) == 1 and next(iter(before)) == n:
            continue
        path, at, seen = n, n, {n}
        while len(out.get(at, ())) == 1:
            nxt = next(iter(out[at]))
            if nxt in seen or len(into[nxt]) > 1:
                break
            path, at = path + nxt[-1], nxt
            seen.add(at)
        if len(path) >= least:
            found.append(path)
    return sorted(found)


def test_contigs(spark):
    r = random.Random(4)
    genome = "".join(r.choice("ACGT") for _ in range(160))
    reads = [genome[i : i + 30] for i in range(0, 130, 9)] + ["".join(r.choice("ACGT") for _ in range(20)) for _ in range(4)]
    nodes, edges = G.build(frame(spark, *reads), 7)
    assert sorted(x.contig for x in G.contigs(nodes, edges, 7).collect()) == contigs_of(reads, 7, 8)


def counted(df):
    """df with a count of the rows that were read from it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_contigs_read_sequences_once(spark):
    df, seen = counted(frame(spark, "ACGTTGCATGTCGC", "TTGCATGTCGCAAA", "GGGATCCA").coalesce(1))
    assert G.contigs(*G.build(df, 5, min_coverage=2), 5).count() == 1
    assert seen.value == 3


def test_tips_read_sequences_once(spark):
    df, seen = counted(frame(spark, "ACGTTGCATGTCGC", "ACGTTGCATGTCGC", "TTGCATA").coalesce(1))
    kept = G.remove_tips(*G.build(df, 5), 3)[0]
    assert sorted(x.kmer for x in kept.collect()) == ["ACGTT", "ATGTC", "CATGT", "CGTTG", "GCATG", "GTCGC", "GTTGC", "TGCAT", "TGTCG", "TTGCA"]
    assert seen.value == 3


@pytest.mark.parametrize("min_coverage", [1, 4])
def test_graph_stats_read_sequences_once(spark, min_coverage):
    df, seen = counted(frame(spark, *["ACGTTGCATGTCGC"] * 4, "TTGCATA").coalesce(1))
    got = G.graph_stats(*G.build(df, 5, min_coverage=min_coverage)).first()
    assert (got.node_count, got.edge_count, got.dead_ends) == ((11, 10, 2) if min_coverage == 1 else (10, 9, 1))
    assert seen.value == 5


def test_graph_of_pieces(spark, monkeypatch):
    """A sequence that is cut has the k-mers and edges of the whole; of rows that share an id the least position counts."""
    r = random.Random(8)
    rows = [(r.choice([None, 1, 2]), "".join(r.choice("ACGT") for _ in range(r.randrange(60)))) for _ in range(40)]
    for k in (2, 5, 35):
        nodes, edges = {}, {}
        for id_, s in rows:
            for i in range(len(s) - k + 1):
                at = (id_ or 0, i)
                n, first = nodes.get(s[i : i + k], (0, at))
                nodes[s[i : i + k]] = n + 1, min(first, at)
                if i + k < len(s):
                    step = s[i : i + k], s[i + 1 : i + k + 1]
                    edges[step] = min(edges.get(step, at), at)
        for size in (1, 7, 1 << 20):
            monkeypatch.setattr(G, "LETTERS", size, raising=False)
            got, steps = G.build(spark.createDataFrame(rows, "id int, sequence string").coalesce(1), k)
            assert {x.kmer: (x.coverage, (x.first_seen.id or 0, x.first_seen.pos)) for x in got.collect()} == nodes
            assert {(x.src, x.dst): (x.first_seen.id or 0, x.first_seen.pos) for x in steps.collect()} == edges


def test_codes(spark):
    assert len(T.CODES) == 27
    assert T.codon_table("no such") == T.codon_table(1)
    assert T.codon_table(22)["TCA"] == "*" and T.codon_table(22)["UCA"] == "S"
    for s in ("ATGGCC", "AUGGCC", " atggcc "):
        assert one(spark, TR.translate(F.col("s")), s=s) == "MA"
    assert one(spark, TR.translate(F.col("s"), break_on_stop=False, stop="#"), s="ATGTAAGCNAT") == "M#X"


def test_orfs(spark):
    got = find_orfs(frame(spark, "ATGGCCAAATAA"), min_length=9, translate=True).collect()
    assert [(r.start, r.end, r.frame, r.strand, r.protein) for r in got] == [(0, 12, 0, "+", "MAK*")]
    got = find_orfs(frame(spark, "ATGGCCTAAATGAAATAG"), min_length=9).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(0, 9), (9, 18)]


def test_orfs_come_in_pieces():
    """What a worker holds is bounded by letters, not by the rows of a batch, and takes few bytes a letter."""
    sequence = ("ATGGCCAAA" * 20 + "TAA") * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([sequence] * 400)], names=["id", "s"])
    out, most = 0, 0
    run = ORFS._kernel(["ATG"], ["TAA", "TAG", "TGA"], True, False, 30, 10000)
    tracemalloc.start()
    for b in run(iter([batch])):
        out, most = out + b.num_rows, max(most, b.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out == 400 * 20 and most < 100 and peak < 1 << 20


def test_stats(spark):
    df = spark.createDataFrame([("ACGTACGT", "########"), ("GGCC", "IIII"), ("AATTNNRR", "55555555")], "sequence string, quality string")
    s = ST.sequence_stats(df, quality="quality").first()
    assert (s.total_sequences, s.total_bases, s.gc_content, s.at_content, s.n_content, s.ambiguous_bases) == (3, 20, 40, 40, 10, 2)
    assert (s.median_length, s.n50, s.l50, s.min_quality, s.max_quality) == (4, 8, 2, 2, 40)
    empty = ST.sequence_stats(df.limit(0)).first()
    assert (empty.total_sequences, empty.n50, empty.median_length) == (0, 0, 0)


def test_cigar(spark):
    assert one(spark, F.size(C.parse(F.col("c"))), c="8M2I4M1D3M") == 5
    assert one(spark, C.format_ops(C.parse(F.col("c"))), c="5M2I3D1N4S2H1P3=2X") == "5M2I3D1N4S2H1P3=2X"
    assert one(spark, C.valid(F.col("c")), c="10M5Q") is False
    f = one(spark, C.decode_flags(F.col("n")), n=163)
    assert [k for k in C.FLAGS if f[k]] == ["paired", "proper_pair", "mate_reverse", "second"]


def test_alignment():
    assert AL.align_batch("global", ["ACCGT"], ["ACG"], "DNA_SIMPLE", -2, -0.5)[0][:3] == ("ACCGT", "A-CG-", 11)
    assert AL.align_batch("local", ["TGTTACGG"], ["GGTTGACTA"], "DNA_SIMPLE", -3, -1)[0][:3] == ("GTT-AC", "GTTGAC", 22)
    a, b = AL.align_batch("overlap", ["GGGGACGTAC", "ACGTACTTTT"], ["ACGTACTTTT", "GGGGACGTAC"], "DNA_SIMPLE")
    assert (a[2], b[2]) == (4, 30)
    assert AL.hirschberg("A" * 1000, "A" * 1000, "DNA_SIMPLE")[2] == 5000
    assert sum(T.get_matrix("BLOSUM62")[c, c] for c in T.AMINO) == 116
    with pytest.raises(ValueError):
        AL.align_batch("banded", ["ACGTACGT"], ["A"], "DNA_SIMPLE", bandwidth=2)
    with pytest.raises(ValueError):
        T.get_matrix("nope")


def _banded(a, b, table, gap_open, gap_extend, band):
    """The best score inside the band, a cell at a time."""
    low = -1e18
    h, e, g = {(0, 0): 0.0}, {}, {}
    for k in range(1, band + 1):
        h[0, k] = h[k, 0] = gap_open + (k - 1) * gap_extend
    for i in range(1, len(a) + 1):
        for j in range(max(1, i - band), min(len(b), i + band) + 1):
            e[i, j] = max(h.get((i - 1, j), low) + gap_open, e.get((i - 1, j), low) + gap_extend)
            g[i, j] = max(h.get((i, j - 1), low) + gap_open, g.get((i, j - 1), low) + gap_extend)
            h[i, j] = max(h.get((i - 1, j - 1), low) + table[ord(a[i - 1]), ord(b[j - 1])], e[i, j], g[i, j])
    return h[len(a), len(b)]


def test_banded_alignment():
    r = random.Random(11)
    table = AL.score_table("DNA_SIMPLE")
    for band in (0, 1, 3, 40):
        xs = ["".join(r.choice("ACGT") for _ in range(r.randrange(4, 30))) for _ in range(30)]
        ys = ["".join(r.choice("ACGT") for _ in range(len(x) + r.randrange(-min(band, 3), min(band, 3) + 1))) for x in xs]
        for x, y, res in zip(xs, ys, AL.align_batch("banded", xs, ys, "DNA_SIMPLE", -3, -1, bandwidth=band), strict=True):
            assert res[2] == _banded(x, y, table, -3, -1, band)
            assert res[0].replace("-", "") == x and res[1].replace("-", "") == y
    long = AL.fill("banded", ["A" * 3000], ["A" * 3000], table, -3, -1, 10)
    assert sum(x.nbytes for x in long) < 3001 * 9 * 24


def test_alignment_laws():
    r = random.Random(5)
    make = lambda: "".join(r.choice("ACGT") for _ in range(r.randrange(1, 25)))
    xs, ys = [make() for _ in range(60)], [make() for _ in range(60)]
    for x, y, res in zip(xs, ys, AL.align_batch("global", xs, ys, "DNA_SIMPLE", -3, -1), strict=True):
        assert res[0].replace("-", "") == x and res[1].replace("-", "") == y
        score, gap = 0.0, ""
        for p, q in zip(res[0], res[1], strict=True):
            side = "1" if p == "-" else "2" if q == "-" else ""
            score += (-1 if side == gap else -3) if side else T.get_score(T.get_matrix("DNA_SIMPLE"), p, q)
            gap = side
        assert score == res[2]
        assert AL.align_batch("global", [x], [y], "DNA_SIMPLE", -3, -1)[0] == res
    for mode in ("semi", "overlap"):
        for x, y, res in zip(xs, ys, AL.align_batch(mode, xs, ys, "DNA_SIMPLE", -3, -1), strict=True):
            assert res[0].replace("-", "") == x and res[1].replace("-", "") == y


def test_fasta(spark, tmp_path):
    text = "junk\n>seq1 some words\nACGT\n ACGT \n\n>seq2\nTG>CA\n>\nAAA\n"
    df = spark.createDataFrame([(text,)], "value string")
    got = [(r.id, r.description, r.sequence) for r in FA.parse_fasta_text(df).orderBy("pos").collect()]
    assert got == [("seq1", "some words", "ACGTACGT"), ("seq2", None, "TG>CA")]
    (tmp_path / "a.fa").write_text(text[5:])
    assert sorted((r.id, r.sequence) for r in FA.read_fasta(spark, str(tmp_path / "a.fa")).collect()) == [("seq1", "ACGTACGT"), ("seq2", "TG>CA")]


def test_fastq(spark, tmp_path):
    p = tmp_path / "a.fq"
    p.write_text("@seq1 x\nACGT\n+\n@III\n@seq2\nTGCA\n+\nHHHH\n@cut\nA\n")
    got = sorted((r.id, r.description, r.sequence, r.quality) for r in FA.read_fastq(spark, str(p)).collect())
    assert got == [("seq1", "x", "ACGT", "@III"), ("seq2", None, "TGCA", "HHHH")]
    p.write_text("@seq1\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="differ in length"):
        FA.read_fastq(spark, str(p)).collect()
    assert FA.read_fastq(spark, str(p), "DROPMALFORMED").count() == 0


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_line_formats(spark):
    bed = lines(spark, "track x", "chr1\t1000\t5000\tgene1\t1000\t+\t1200\t4900\t0\t3\t300,400,200\t0,1500,3800", "chr1\t5\t5", "chr1\tx\t9", "chr2\t1\t2")
    got = L.parse_bed(bed).orderBy("chrom").collect()
    assert len(got) == 2 and got[0].block_sizes == [300, 400, 200] and got[1].name is None
    gff = lines(spark, "##gff-version 3", "chr1\tHAVANA\tgene\t1\t100\t.\t+\t.\tID=gene1;Name=A,B;Note=Test%20gene;ID=gene2", "chr1\tx\tgene\t1\t2\t.\t+\t.\tNote=%zz")
    got = L.parse_gff(gff).collect()
    assert len(got) == 1 and got[0].attributes == {"ID": ["gene2"], "Name": ["A", "B"], "Note": ["Test gene"]} and got[0].score is None
    sam = lines(spark, "@HD\tVN:1.6", "r\t163\tchr1\t7\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:1\tXX:Z:a:b")
    got = L.parse_sam(sam).first()
    assert got.tags["XX"].z == "a" and got.tags["NM"].i == 1 and got.flags.mate_reverse
    assert [r.kind for r in L.parse_sam_header(sam).collect()] == ["HD"]


def test_trees(spark):
    df = spark.createDataFrame([(1, "((A:0.1,B:0.2):0.3,C:0.4);")], "tree_id int, value string")
    nodes = TREE.parse_newick(df)
    s = TREE.tree_stats(nodes).first()
    assert (s.leaf_count, s.max_depth, s.leaf_names) == (3, 2, ["A", "B", "C"])
    assert TREE.format_newick(nodes, precision=1).first().value == "((A:0.1,B:0.2):0.3,C:0.4);"
    assert not TREE.valid_newick("((A,B);") and not TREE.valid_newick("(A,B)")


def test_genbank():
    text = 'LOCUS       SEQ1   12 bp DNA\nDEFINITION  A test\n            sequence\nACCESSION   AC1\nSOURCE      s\n  ORGANISM  Test organism\n            Bacteria.\nFEATURES             Location/Qualifiers\n     CDS             2..7\n                     /gene="abc"\nORIGIN\n        1 acgtacgtac gt\n//\n'
    r = TREE.genbank_record(text)
    assert (r["locus"], r["definition"], r["organism"], r["sequence"]) == ("SEQ1", "A test sequence", "Test organism Bacteria.", "ACGTACGTACGT")
    assert r["features"] == [{"type": "CDS", "location": "2..7", "qualifiers": [{"key": "gene", "value": "abc"}]}]
    with pytest.raises(ValueError):
        TREE.genbank_record("nothing")


def test_flat_files_to_fasta(spark):
    genbank = 'LOCUS       SEQ1   12 bp DNA\nDEFINITION  A test\nACCESSION   AC1\nFEATURES             Location/Qualifiers\n     CDS             complement(2..7)\n                     /gene="abc"\n                     /product="thing"\n     source          1..12\nORIGIN\n        1 acgtacgtac gt\n//\n'
    embl = "ID   X1; SV 1; linear; DNA; STD; UNC; 8 BP.\nDE   First\nDE   second\nSQ   Sequence 8 BP;\n     acgtacgt                 8\n//"
    df = spark.createDataFrame([(genbank, embl)], "g string, e string").select(TREE.parse_genbank(F.col("g")).alias("g"), TREE.parse_embl(F.col("e")).alias("e"))
    rows = [tuple(r) for r in TREE.genbank_to_fasta(df.select("g.*"), include_features=True).collect()]
    assert sorted(rows) == [("AC1", "A test", "ACGTACGTACGT"), ("abc", "thing", "CGTACG")]
    assert tuple(TREE.embl_to_fasta(df.select("e.*")).first()) == ("X1", "First second", "ACGTACGT")


def test_vcf_header(spark):
    text = L.format_vcf_header("VCFv4.2", [{"ID": "20", "length": "62435964"}], [{"ID": "DP", "Number": "1", "Type": "Integer", "Description": "Depth, total"}], [], [], ["a", "b"])
    rows = {r.kind: r for r in L.parse_vcf_header(lines(spark, *text, "20\t1\t.\tA\tC\t.\t.\t.")).collect()}
    assert set(rows) == {"fileformat", "contig", "info", "samples"}
    assert rows["contig"].fields["length"] == "62435964" and rows["info"].fields["Description"] == "Depth, total"
    assert rows["samples"]["values"] == ["a", "b"] and rows["fileformat"]["values"] == ["VCFv4.2"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["complements", "kmer_count", "minimizers", "graph_stats", "six_frames", "orfs", "seq_stats", "fastq_roundtrip", "gff_roundtrip", "cigar_aligned", "newick_stats", "genbank_features", "align_global", "align_local", "align_semi", "align_overlap", "align_banded", "align_hirschberg"])
def test_catalogue(spark, name):
    import duckdb

    from strandlake.plans.catalogue import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    mine, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    rows = lambda df: sorted(tuple(str(v) if not isinstance(v, float) else f"{v:.6f}" for v in r) for r in df[sorted(df.columns)].astype({c: float for c in df if df[c].dtype.kind in "iuf"}).itertuples(index=False))
    assert sorted(mine.columns) == sorted(theirs.columns) and rows(mine) == rows(theirs)
