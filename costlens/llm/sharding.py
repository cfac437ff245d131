"""Sharding by vector bin packing: bytes, tokens and rows balanced together.

Equal texts are a group and go to one shard, unless the group is more than
1/``PARTS`` of a shard in bytes, tokens or rows, so that no balance would be
possible; such a group is dealt into pieces by serial numbers of the rows first, so rows
of one id and text are dealt as well.  A group is a vector of bytes, tokens and rows; packing takes vectors by falling size and puts
each where its dot product with the residual capacity is highest.

It runs on two levels, so no task sees all groups.  Hash blocks of small groups are
packed independently into fine bins.  The bins of all blocks and the groups
above 1/``FINE`` of a shard, a table bounded by ``MAX_BINS`` and by ``FINE`` times
the shards, are then packed into the shards by the same rule.

The law that holds is ``bytes``: shard sizes are near equal.  Slots number the
rows of a shard without gaps, block by block; rows come to blocks by serial number.
Serial numbers follow the written table of rows, so a task that runs again finds the same.

Edge cases: a null text counts as empty, of size 1; rows with the same id and
text are numbered in any order; any number of rows may share an id, a null id or a text; an empty table gives no rows; very long texts are
one group like any other; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, WORD_SPACE, shared, ship

#: A group above this fraction of a shard is dealt into pieces.
PARTS = 4
PIECES = 64

#: A group above this fraction of a shard is placed by itself, not in a block's bin.
FINE = 256

#: Groups of a block, blocks at most, and bins of all blocks: at least, and at most (16 a block).
BLOCK_GROUPS = 20_000
MAX_BLOCKS = 4096
MIN_BINS = 8192
MAX_BINS = MIN_BINS + 16 * MAX_BLOCKS

#: Blocks of rows of a shard that are numbered independently.
SLOT_BLOCKS = 256

DIMENSIONS = ("bytes", "tokens", "rows")


def pack(vectors: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each vector (components as shares of the total), taken by falling size; ties keep their order."""
    residual = np.full((bins, vectors.shape[1]), 1.0 / bins)
    out = np.empty(len(vectors), dtype=np.int32)
    for i in np.argsort(-vectors.max(axis=1), kind="stable"):
        best = int((residual @ vectors[i]).argmax())
        residual[best] -= vectors[i]
        out[i] = best
    return out


def shares(frame: pd.DataFrame) -> np.ndarray:
    """Vectors of a table of groups or bins."""
    vectors = frame[[f"n_{d}" for d in DIMENSIONS]].to_numpy(dtype=float)
    return vectors / np.maximum(vectors.sum(axis=0), 1)


def table(spark: SparkSession, frame: pd.DataFrame, kind: str) -> DataFrame:
    """A small table of whole numbers as a DataFrame."""
    return spark.createDataFrame(list(zip(*(frame[c].tolist() for c in frame))), kind)


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` per row, and ``tokens``."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(WORD_SPACE))
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, WORD_GAP))).cast("long")
    rows = shared(docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"),
                              F.crc32(text).alias("text_crc32"), words.alias("tokens"), F.xxhash64(text).alias("hash")))
    rows = rows.withColumn("serial", F.monotonically_increasing_id())  # stable: the rows are written
    own = ["hash", "text_crc32", "size"]  # equal texts agree in these, different ones do not
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = rows.groupBy(*own).agg(*sums)
    total = groups.agg(*(F.sum(d).alias(d) for d in DIMENSIONS), F.count("*").alias("groups")).first()

    def above(part: int, prefix: str = "") -> Column:
        flags = [F.col(prefix + d) > (total[d] or 0) / (shards * part) for d in DIMENSIONS]
        return (flags[0] | flags[1] | flags[2]) & (F.col(f"{prefix}rows") > (1 if part == PARTS else 0))

    # at most shards * PARTS groups for each dimension
    large = [r["hash"] for r in groups.where(above(PARTS)).select("hash").collect()]
    is_large = F.col("hash").isin(large) if large else F.lit(False)
    rows = rows.withColumn("piece", F.when(is_large, F.pmod(F.xxhash64("serial"), F.lit(PIECES))).otherwise(F.lit(-1)).cast("int"))
    key = [*own, "piece"]
    blocks = min(MAX_BLOCKS, (total["groups"] or 0) // BLOCK_GROUPS + 1)
    bins = max(16, MIN_BINS // blocks)
    items = shared(rows.groupBy(*key).agg(*(s.alias(f"n_{d}") for s, d in zip(sums, DIMENSIONS)))
                   .withColumn("block", F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")))
    is_big = above(FINE, "n_")

    def pack_block(groups_: pd.DataFrame) -> pd.DataFrame:
        groups_ = groups_.sort_values(key)
        return groups_.assign(bin=pack(shares(groups_), bins))

    kind = "hash long, text_crc32 long, size long, piece int, n_bytes long, n_tokens long, n_rows long, block int, bin int"
    packed = shared(items.where(~is_big).groupBy("block").applyInPandas(pack_block, kind))
    totals = packed.groupBy("block", "bin").agg(*(F.sum(f"n_{d}").alias(f"n_{d}") for d in DIMENSIONS)).toPandas()
    # at most shards * FINE groups for each dimension
    big = items.where(is_big).drop("block").toPandas().sort_values(key)
    totals = totals.sort_values(["block", "bin"])
    weights = pd.concat([big, totals])[[f"n_{d}" for d in DIMENSIONS]]
    place = pack(shares(weights), shards) if len(weights) else np.empty(0, dtype=np.int32)
    alone = table(spark, big[key].assign(shard=place[: len(big)]),
                  "hash long, text_crc32 long, size long, piece int, shard int")
    placed = table(spark, totals[["block", "bin"]].assign(shard=place[len(big) :]), "block int, bin int, shard int")
    where = packed.join(F.broadcast(placed), ["block", "bin"]).select(*key, "shard").unionByName(alone)
    sharded = rows.join(where, key).withColumn("part", F.pmod(F.xxhash64("serial", "hash"), F.lit(SLOT_BLOCKS)).cast("int"))
    sizes = sharded.groupBy("shard", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("serial"))
    numbered = sharded.withColumn("place", place).join(F.broadcast(first), ["shard", "part"])  # shards * SLOT_BLOCKS rows
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                           (F.col("first") + F.col("place") - 1).cast("long").alias("slot"),
                           F.lit(None).cast("int").alias("grown_shard"), "tokens")
