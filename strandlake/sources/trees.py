"""Formats that need a state machine: Newick trees as adjacency rows, GenBank and EMBL records as nested rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandlake.session import ship

# Newick


def newick_nodes(text: str) -> list[tuple[int, int | None, int, int, str | None, float | None, bool]]:
    """(node_id, parent_id, child_idx, depth, name, length, is_leaf) in preorder; ValueError on bad syntax.

    What follows the root is passed over; the text must end with `;`.
    """
    s = text.strip()
    if not s.endswith(";"):
        raise ValueError("a tree must end with ;")
    nodes: list[list] = []
    stack: list[int] = []
    children: list[int] = []

    def add() -> int:
        parent = stack[-1] if stack else None
        idx = 0
        if parent is not None:
            idx = children[parent]
            children[parent] += 1
        nodes.append([len(nodes), parent, idx, len(stack), None, None, True])
        children.append(0)
        return len(nodes) - 1

    def label(node: int, at: int) -> int:
        m = re.compile(r"([^(),:;]*)(?::([^(),:;]*))?").match(s, at)
        nodes[node][4] = m[1].strip() or None
        if m[2] is not None:
            number = re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", m[2])
            if not number:
                raise ValueError("bad branch length")
            nodes[node][5] = float(number[0])
        return m.end()

    at, node = 0, add()
    while True:
        while at < len(s) and s[at].isspace():
            at += 1
        if s[at] == "(":
            nodes[node][6] = False
            stack.append(node)
            at += 1
            node = add()
            continue
        at = label(node, at)
        while stack and s[at] == ")":
            node = stack.pop()
            at = label(node, at + 1)
        if not stack:
            return [tuple(n) for n in nodes]
        if s[at] != ",":
            raise ValueError("unbalanced parentheses")
        at += 1
        node = add()


def valid_newick(text: str) -> bool:
    try:
        newick_nodes(text)
        return text.count("(") == text.count(")")
    except (ValueError, IndexError):
        return False


def is_newick(text: Column) -> Column:
    """Whether a string column's tree is well formed; null stays null."""

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else valid_newick(t) for t in texts.to_pylist()], pa.bool_())

    return run(text)


TREE = "node_id int, parent_id int, child_idx int, depth int, name string, length double, is_leaf boolean"


def parse_newick(df: DataFrame, text: str = "value", tree_id: str = "tree_id", mode: str = "FAILFAST") -> DataFrame:
    """Adjacency rows of each tree.  mode DROPMALFORMED leaves bad trees out."""
    ship(df.sparkSession)
    names = [c.split()[0] for c in TREE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["t"], b["v"], strict=True):
                try:
                    rows += [(i, *n) for n in newick_nodes(t)]
                except (ValueError, IndexError) as e:
                    if mode == "FAILFAST":
                        raise ValueError(f"invalid Newick: {e}") from e
            out = pd.DataFrame(rows, columns=["t", *names])
            yield out.astype({"parent_id": "Int32"})

    kind = df.schema[tree_id].dataType.simpleString()
    return df.select(F.col(tree_id).alias("t"), F.col(text).alias("v")).mapInPandas(run, f"t {kind}, {TREE}").withColumnRenamed("t", tree_id)


def tree_stats(nodes: DataFrame, tree_id: str = "tree_id") -> DataFrame:
    """leaf_count, max_depth, total_length, has_lengths and leaf_names (in order, named ones) of each tree."""
    return nodes.groupBy(tree_id).agg(
        F.sum(F.col("is_leaf").cast("long")).alias("leaf_count"), F.max("depth").alias("max_depth"), F.sum(F.coalesce("length", F.lit(0.0))).alias("total_length"), F.max(F.col("length").isNotNull()).alias("has_lengths"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("is_leaf") & F.col("name").isNotNull(), F.struct("node_id", "name")))), lambda x: x["name"]).alias("leaf_names"),
    )


def format_newick(nodes: DataFrame, tree_id: str = "tree_id", include_lengths: bool = True, precision: int = 6) -> DataFrame:
    """tree_id and value: children first, then name and length.  A tree is one group."""
    ship(nodes.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        below: dict[int, list[int]] = {}
        rows = {int(r.node_id): r for r in g.itertuples()}
        for r in sorted(rows.values(), key=lambda r: r.child_idx):
            if not pd.isna(r.parent_id):
                below.setdefault(int(r.parent_id), []).append(int(r.node_id))
        done: dict[int, str] = {}
        for i in sorted(rows, reverse=True):  # preorder ids: children come after their parent
            r = rows[i]
            text = "(" + ",".join(done[c] for c in below[i]) + ")" if i in below else ""
            text += r.name if isinstance(r.name, str) else ""
            done[i] = text + (f":{r.length:.{precision}f}" if include_lengths and not pd.isna(r.length) else "")
        return pd.DataFrame({tree_id: [g[tree_id].iloc[0]], "value": [done[0] + ";"]})

    kind = nodes.schema[tree_id].dataType.simpleString()
    return nodes.groupBy(tree_id).applyInPandas(run, f"{tree_id} {kind}, value string")


# Flat files

_FEATURES = "features array<struct<type:string,location:string,qualifiers:array<struct<key:string,value:string>>>>"
GENBANK = f"struct<locus:string,definition:string,accession:string,version:string,keywords:string,source:string,organism:string,references:array<string>,{_FEATURES.replace(' ', ':', 1)},sequence:string>"
EMBL = f"struct<id:string,accession:string,version:string,description:string,keywords:string,organism:string,references:array<string>,{_FEATURES.replace(' ', ':', 1)},sequence:string>"


def _feature_table(lines: list[str]) -> list[dict]:
    """Features of lines whose key stands in column 6 and whose text begins in column 22."""
    out: list[dict] = []
    for line in lines:
        if len(line) > 5 and not line[5].isspace() and line[:5].strip() in ("", "FT"):
            kind, _, location = line[5:].strip().partition(" ")
            out.append({"type": kind, "location": location.strip(), "qualifiers": []})
        elif not out:
            continue
        elif "/" in line:
            key, _, value = line[line.index("/") + 1 :].strip().partition("=")
            if len(value) > 1 and value[0] == value[-1] == '"':
                value = value[1:-1]
            out[-1]["qualifiers"].append({"key": key, "value": value})
        elif line[5:21].strip() == "":
            text = line[21:].strip()
            if out[-1]["qualifiers"]:
                out[-1]["qualifiers"][-1]["value"] += " " + text
            else:
                out[-1]["location"] += text
    return out


def genbank_record(text: str) -> dict | None:
    """The first record of a text (up to `//`); ValueError without a LOCUS line."""
    out: dict = {"locus": None, "definition": "", "accession": "", "version": "", "keywords": "", "source": "", "organism": "", "references": [], "features": [], "sequence": ""}
    section, table, bases = "", [], []
    single = {"ACCESSION": "accession", "VERSION": "version", "KEYWORDS": "keywords", "SOURCE": "source"}
    for line in text.split("\n"):
        if line.startswith("//"):
            break
        word = line[:12].strip()
        if section == "ORIGIN" and not re.match("[A-Z]", line):
            bases += re.findall("[a-z]+", line)
        elif line.startswith("LOCUS"):
            out["locus"], section = (line[12:].split() or [""])[0], "LOCUS"
        elif line.startswith(("DEFINITION", "  ORGANISM")):
            section = word
            out[word.lower()] = line[12:].strip()
        elif word in single and re.match("[A-Z]", line):
            section = word
            out[single[word]] = line[12:].strip()
        elif line.startswith("REFERENCE"):
            section = word
            out["references"].append(line.strip())
        elif line.startswith(("FEATURES", "ORIGIN")):
            section = word.split()[0]
        elif section == "FEATURES":
            table.append(line)
        elif section in ("DEFINITION", "ORGANISM") and line.startswith(" " * 11):
            out[section.lower()] += " " + line.strip()
        elif section == "REFERENCE" and line.startswith(" "):
            out["references"][-1] += "\n" + line.strip()
        elif re.match("[A-Z]", line):
            section = ""
    if out["locus"] is None:
        raise ValueError("no LOCUS line")
    out["features"], out["sequence"] = _feature_table(table), "".join(bases).upper()
    return out


def embl_record(text: str) -> dict:
    """The record of a text; ValueError without an ID line."""
    out: dict = {"id": None, "accession": "", "version": "", "description": "", "keywords": "", "organism": "", "references": [], "features": [], "sequence": ""}
    table, bases, last = [], [], ""
    for line in text.split("\n"):
        key, rest = line[:2], line[5:].strip()
        if key == "ID":
            parts = [p.strip() for p in rest.split(";")]
            out["id"] = parts[0].split()[0] if parts[0] else ""
            if len(parts) > 1 and parts[1].startswith("SV"):
                out["version"] = f"{out['id']}.{parts[1][2:].strip()}"
        elif key == "AC" and not out["accession"]:
            out["accession"] = rest.split(";")[0].strip()
        elif key == "SV":
            out["version"] = rest
        elif key in ("DE", "KW"):
            name = {"DE": "description", "KW": "keywords"}[key]
            out[name] = f"{out[name]} {rest}".strip()
        elif key == "OS":
            out["organism"] = rest
        elif re.match("R[NPXATLCG]", key):
            if key == "RN" or not out["references"] or not last.startswith("R"):
                out["references"].append(rest)
            else:
                out["references"][-1] += "\n" + rest
        elif key == "FT":
            table.append(line)
        elif key == "  " and last in ("SQ", "  "):
            bases += re.findall("[A-Za-z]+", line)
        if key.strip() or key == "  ":
            last = key
    if out["id"] is None:
        raise ValueError("no ID line")
    out["features"], out["sequence"] = _feature_table(table), "".join(bases).upper()
    return out


def _parser(function, kind: str, text: Column) -> Column:
    spark_type = T._parse_datatype_string(kind)
    arrow_type = to_arrow_type(spark_type)

    @F.arrow_udf(spark_type)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else function(t) for t in texts.to_pylist()], arrow_type)

    return run(text)


def parse_genbank(text: Column) -> Column:
    return _parser(genbank_record, GENBANK, text)


def parse_embl(text: Column) -> Column:
    return _parser(embl_record, EMBL, text)


def read_flat(spark: SparkSession, path: str, kind: str = "genbank") -> DataFrame:
    """A row per record of files in which `//` ends a record; large files are split between records."""
    ship(spark)
    parse = parse_genbank if kind == "genbank" else parse_embl
    rows = spark.read.option("lineSep", "\n//").text(path).select(F.regexp_replace("value", r"^\s*\n", "").alias("v")).where("trim(v) <> ''")
    return rows.select(parse(F.col("v")).alias("r")).select("r.*")


def genbank_to_fasta(records: DataFrame, include_features: bool = False) -> DataFrame:
    """id, description and sequence; with features, a row for each CDS and gene too, by the first `a..b` of its location."""
    main = records.select(F.when(F.col("accession") != "", F.col("accession")).otherwise(F.col("locus")).alias("id"), F.col("definition").alias("description"), "sequence")
    if not include_features:
        return main
    f = records.select("sequence", F.explode("features").alias("f")).where(F.col("f.type").isin("CDS", "gene"))
    value = lambda key: F.get(F.transform(F.filter("f.qualifiers", lambda q: q["key"] == key), lambda q: q["value"]), F.lit(0))
    a, b = (F.regexp_extract("f.location", r"(\d+)\.\.(\d+)", i).try_cast("int") for i in (1, 2))
    parts = f.where(a.isNotNull()).select(F.coalesce(value("gene"), value("locus_tag"), F.col("f.type")).alias("id"), F.coalesce(value("product"), F.col("f.location")).alias("description"), F.substr("sequence", a, b - a + 1).alias("sequence"))
    return main.unionByName(parts)


def embl_to_fasta(records: DataFrame) -> DataFrame:
    return records.select(F.when(F.col("accession") != "", F.col("accession")).otherwise(F.col("id")).alias("id"), "description", "sequence")


def fasta_to_genbank(id_: Column, description: Column, sequence: Column, date: str, organism: str = "Unknown", molecule: str = "DNA", topology: str = "linear") -> Column:
    """A GenBank flat file of the sequence, its date given; lower-case, 60 bases a line in groups of ten."""
    pad = lambda c, n: F.when(F.length(c) >= n, c).otherwise(F.rpad(c, n, " "))
    s = F.lower(sequence)
    lines = F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s), F.lit(60)), lambda i: F.concat(F.lpad(i.cast("string"), 9, " "), F.lit(" "), F.trim(F.regexp_replace(F.substr(s, i, F.lit(60)), "(.{10})", "$1 ")))))
    head = F.concat(F.lit("LOCUS       "), pad(id_, 16), F.lit(" "), F.lpad(F.length(s).cast("string"), 11, " "), F.lit(" bp    "), F.lit(molecule.ljust(6)), F.lit("  "), F.lit(topology.ljust(8)), F.lit(f" {date}"))
    return F.concat_ws("\n", head, F.concat(F.lit("DEFINITION  "), F.coalesce(description, F.lit(""))), F.concat(F.lit("ACCESSION   "), id_), F.lit(f"SOURCE      {organism}"), F.lit(f"  ORGANISM  {organism}"), F.lit("ORIGIN"), F.coalesce(F.array_join(lines, "\n"), F.lit("")), F.lit("//"))

