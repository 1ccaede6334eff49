"""Sharding by vector bin packing.

Rows are weighed by bytes, tokens and rows at once.  Rows of equal text form a group; the groups are
hashed into a fixed number of cells, so that what the driver packs is bounded whatever the table's
size.  In a cell that outweighs its part of the table in any dimension, each heavy group becomes an item of its own and
the other groups are dealt into finer cells; of groups only those that outweigh a whole shard are split, by row.
The items are placed heaviest first, each into the shard
where the dot product of its weights with the residual capacity is highest among those it still fits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm._spark import Scratch, table

#: Cells that groups are hashed into; bounds the driver's work and the broadcast map.
CELLS = 1 << 14
#: A cell or group of more than 1 / (shards * GRAIN) of the table, in a dimension, is heavy; there are 3 * shards * GRAIN at most.
GRAIN = 16
#: Parts that rows of a heavy group are dealt into, to number or split them, and that a heavy cell's other groups are dealt into.
PARTS = 64

DIMENSIONS = ("bytes", "tokens", "rows")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pack(weights: np.ndarray, shards: int, slack: float = 0.002) -> np.ndarray:
    """Shard of each item.  weights: items x dimensions.

    Ties go to the lower shard and, in order of placing, to the lower item; an item that fits nowhere
    goes where the overrun of its worst dimension is least.
    """
    total = weights.sum(axis=0)
    share = np.divide(weights, total, out=np.zeros_like(weights, dtype=float), where=total > 0) * shards
    order = np.argsort(-share.max(axis=1, initial=0), kind="stable")
    used = np.zeros((shards, weights.shape[1]))
    out = np.zeros(len(weights), dtype=np.int64)
    for i in order:
        w = share[i]
        left = 1 - used
        fits = (left + slack >= w).all(axis=1)
        if fits.any():
            best = int(np.argmax(np.where(fits, left @ w, -np.inf)))
        else:
            best = int(np.argmax((left - w)[:, w > 0].min(axis=1))) if (w > 0).any() else int(np.argmax(left[:, -1]))
        used[best] += w
        out[i] = best
    return out


def shard(docs: DataFrame, shards: int = 16, cells: int = CELLS, grain: int = GRAIN, key: str = "doc_id", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The columns (all, unless stated), size, text_crc32, law ('bytes'), shard, slot and grown_shard (null) of every row.

    Null text weighs one byte, no token and one row.  Rows of equal text share a shard, but for groups that outweigh a
    shard in a dimension (more than 1 / shards of the table), which are split by row, whatever their keys.  Null keys and
    repeated rows are ordinary rows; which of two identical rows takes the lower slot doesn't show.  An empty
    table gives no rows.  Columns named like the added ones are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    body = F.col(text).cast("string")
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    own = [c for c in (docs.columns if columns is None else columns) if c not in added]
    # Written once, so that every later step sees the same draw.
    rows = scratch.write(
        docs.select(
            F.struct(*own).alias("own"),
            F.col(key).alias("key"),
            (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("bytes"),
            n_tokens(body).alias("tokens"),
            F.lit(1).cast("long").alias("rows"),
            F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("crc"),
            F.xxhash64(body).alias("g"),
            F.floor(F.rand(11) * PARTS).cast("int").alias("part"),
        ).withColumn("cell", F.pmod("g", F.lit(cells)).cast("int")),
        "rows",
    )
    sums = [F.sum(c).alias(c) for c in DIMENSIONS]
    names = list(DIMENSIONS)
    coarse = rows.groupBy("cell").agg(*sums).toPandas().sort_values("cell", ignore_index=True)
    total = coarse[names].sum()
    limit = total / (shards * grain)
    hot = coarse[(coarse[names] > limit).any(axis=1) & (coarse["rows"] > 1)]
    items = coarse.drop(hot.index).assign(sub=0)
    items["item"] = [f"{c}" for c in items["cell"]]
    placed = rows.withColumn("sub", F.lit(0))
    if len(hot):
        in_hot = F.broadcast(spark.createDataFrame([(int(c), True) for c in hot["cell"]], "cell int, hot boolean"))
        marked = rows.join(in_hot, "cell", "left")
        over = F.greatest(*[(F.col(c) > float(limit[c])).cast("int") for c in names]) == 1
        heavy = marked.where("hot").groupBy("cell", "g").agg(*sums).where(over).toPandas().sort_values(["cell", "g"], ignore_index=True)
        heavy["split"] = (heavy[names] > total / shards).any(axis=1)
        own_item = F.broadcast(spark.createDataFrame([(int(g), i) for i, g in enumerate(heavy["g"])], "g long, heavy int"))
        # Parts of heavy group i are numbered from PARTS * (i + 1); lower numbers are the cell's other groups.
        other = F.when(F.col("hot"), F.pmod(F.xxhash64("g", F.lit(3)), F.lit(PARTS)).cast("int")).otherwise(0)
        placed = marked.join(own_item, "g", "left").withColumn("sub", F.when(F.col("heavy").isNotNull(), PARTS * (F.col("heavy") + 1) + F.col("part")).otherwise(other)).drop("hot", "heavy")
        fine = placed.join(in_hot, "cell", "left_semi").groupBy("cell", "sub").agg(*sums).toPandas()
        of = fine["sub"] // PARTS - 1
        whole = (of >= 0) & ~np.append(heavy["split"].to_numpy(dtype=bool), True)[of]
        fine["item"] = np.where(whole, "g" + of.astype(str), fine["cell"].astype(str) + "/" + fine["sub"].astype(str))
        items = pd.concat([items, fine], ignore_index=True)
    items = items.sort_values(["cell", "sub"], ignore_index=True)
    units = items.groupby("item", sort=True)[names].sum()
    items["shard"] = items["item"].map(dict(zip(units.index, pack(units.to_numpy(dtype=float), shards), strict=True)))
    items["base"] = items.groupby("shard")["rows"].cumsum() - items["rows"]
    plan = F.broadcast(spark.createDataFrame([tuple(map(int, r)) for r in items[["cell", "sub", "shard", "base"]].itertuples(index=False)], "cell int, sub int, shard int, base long"))
    within = Window.partitionBy("cell", "sub").orderBy("key")
    return (
        placed.join(plan, ["cell", "sub"])
        .withColumn("slot", F.col("base") + F.row_number().over(within) - 1)
        .select("own.*", F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    )


def op1_shard_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law `bytes`."""
    return shard(table(spark, sf_dir, "documents"), columns=["doc_id"])
