"""SimHash near-duplicates: fingerprints, pigeonring candidates, connected groups.

A text's fingerprint has a bit for which more than half of the hashes of its
word shingles have that bit.  Two fingerprints are linked at ``max_bits`` or
fewer different bits.

Candidates are found by the pigeonring principle.  The 64 bits are cut into
``segments`` consecutive segments, seen as a ring.  If two fingerprints differ
in at most ``max_bits`` bits, some segment starts a chain of which every prefix
of ``l`` segments holds at most ``l * max_bits / segments`` of the differences.
So each fingerprint is filed under each segment (and, if a single segment may
differ by one bit, under the one-bit variants of it); fingerprints filed together
are compared chain by chain, and only pairs whose chain stays within the budget
get the full Hamming check.

Equal fingerprints are one row from the start, so groups of exact copies cost
nothing.  A bucket of many fingerprints is cut into blocks and every pair of
blocks is a group of its own, so no task holds more than two blocks; a group
gives a spanning forest of its links and not all pairs.  Components come from
alternating large-star and small-star steps over those edges, each written to
the shared checkpoint folder.

With ``segments`` above ``max_bits`` a bucket is one exact segment value and the
comparisons grow as the square of the distinct fingerprints over 2**(64/segments);
for billions of distinct fingerprints, ``segments=3`` files longer segments with
their one-bit variants instead.  Both are exact.

Edge cases: null, empty and blank texts have fingerprint zero, which is linked
like any other; fewer words than a shingle make one shingle of all words;
repeated rows share a group; a null ``doc_id`` never names a group unless all
ids of the group are null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import shared, ship

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42

#: Fingerprints of a bucket that are compared in one group at most (two blocks).
BLOCK = 2048

#: Hashes whose bits are counted in one step.
STEP = 1 << 16

#: A fingerprint with more than this share of all rows gets its rows dealt out by salt; so there are at most 1/share.
HEAVY_SHARE = 0.001
SALTS = 64


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """The 64-bit fingerprint of one text (unsigned)."""
    tokens = (text or "").encode("utf-8").lower().split()  # bytes: lower() and split() know ASCII only
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles: Iterator[bytes] = iter([b" ".join(tokens)])
        n = 1
    else:
        n = len(tokens) - words + 1
        shingles = map(b" ".join, zip(*(tokens[i : i + n] for i in range(words))))
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, n, STEP):
        part = np.fromiter(map(xxh64_intdigest, (s for s, _ in zip(shingles, range(min(STEP, n - start)))), repeat(seed)),
                           dtype="<u8", count=min(STEP, n - start))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Fingerprint of a text column as a (signed) long."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py(), words) for t in texts), dtype=np.uint64, count=len(texts))
        return pa.array(found.view(np.int64))

    return simhash(text)


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


# -- candidates ----------------------------------------------------------------


def ring(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    cuts = [round(i * 64 / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _masks(start: int, segments: int) -> list[np.uint64]:
    """Masks of the chains of 1, 2, ... segments from a start."""
    parts = [((1 << w) - 1) << low for low, w in ring(segments)]
    out, mask = [], 0
    for step in range(segments):
        mask |= parts[(start + step) % segments]
        out.append(np.uint64(mask))
    return out


def chain_links(a: np.ndarray, b: np.ndarray, masks: list[np.uint64], max_bits: int) -> np.ndarray:
    """Indexes of the pairs whose chain keeps its budget up to the whole ring, which is the Hamming check."""
    at = np.arange(len(a))
    diff = a ^ b
    for length, mask in enumerate(masks, 1):
        fits = np.bitwise_count(diff & mask) <= length * max_bits // len(masks)
        at, diff = at[fits], diff[fits]
        if not at.size:
            break
    return at


def forest(group: np.ndarray, start: int, segments: int, max_bits: int) -> list[tuple[int, int]]:
    """Edges that connect what the links of one group connect: at most one per member.

    Every member is compared with those that are not reached yet.
    """
    masks = _masks(start, segments)
    waiting = np.ones(len(group), dtype=bool)
    edges: list[tuple[int, int]] = []
    for seed in range(len(group)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        front = [seed]
        while front:
            x = front.pop()
            rest = np.flatnonzero(waiting)
            if not rest.size:
                return edges
            found = rest[chain_links(np.full(rest.size, group[x]), group[rest], masks, max_bits)]
            waiting[found] = False
            edges += [(int(group[x]), int(group[y])) for y in found]
            front += found.tolist()
    return edges


def _small_groups(fps: np.ndarray, gid: np.ndarray, starts: np.ndarray, segments: int, max_bits: int) -> list[tuple[int, int]]:
    """Forest edges of many small groups at once; rows are sorted by group."""
    links = []
    for start in np.unique(starts):
        of = np.flatnonzero(starts == start)
        fp, g = fps[of], gid[of]
        masks = _masks(int(start), segments)
        shift = 1
        while shift < len(fp):
            a = np.flatnonzero(g[:-shift] == g[shift:])
            if not a.size:
                break
            hit = a[chain_links(fp[a], fp[a + shift], masks, max_bits)]
            links.append((fp[hit], fp[hit + shift]))
            shift += 1
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[up]
        return x

    edges = []
    for a, b in links:
        for x, y in zip(a.tolist(), b.tolist()):
            rx, ry = find(x), find(y)
            if rx != ry:
                parent[rx] = ry
                edges.append((x, y))
    return edges


def candidate_edges(fps: DataFrame, segments: int = 5, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges ``u``, ``v`` (longs) that connect all linked fingerprints; ``fps`` has one ``fp`` per row, distinct."""
    near = max_bits // segments
    if near > 1:
        raise ValueError("a segment may differ by one bit at most: take more segments")
    filed = []
    for start, (low, width) in enumerate(ring(segments)):
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        keys = F.array(part, *(part.bitwiseXOR(F.lit(1 << bit)) for bit in range(width if near else 0)))
        filed.append(fps.select("fp", F.lit(start).alias("start"), F.explode(keys).alias("key")))
    filed = reduce(DataFrame.unionByName, filed)
    # at most segments * 2**width keys exist, and only those of large buckets are kept
    large = (filed.groupBy("start", "key").agg(F.count("*").alias("members")).where(F.col("members") > block)
             .select("start", "key", F.ceil(F.col("members") / block).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cut = (filed.join(large, ["start", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
           .withColumn("own", own)
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("fp", "start", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    group = ["start", "key", "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            new = (batch[group].diff().fillna(1) != 0).any(axis=1).to_numpy()
            last = int(np.flatnonzero(new)[-1]) if len(batch) else 0
            rest = batch.iloc[last:]  # it may go on in the next batch
            yield edges_of(batch.iloc[:last], new[:last])
        if rest is not None and len(rest):
            yield edges_of(rest, np.arange(len(rest)) == 0)

    def edges_of(rows: pd.DataFrame, new: np.ndarray) -> pd.DataFrame:
        fps_, starts = rows["fp"].to_numpy().view(np.uint64), rows["start"].to_numpy()
        gid = np.cumsum(new)
        sizes = np.bincount(gid) if len(gid) else np.zeros(1, dtype=int)
        edges = []
        for g in np.flatnonzero(sizes > 200):
            a, b = np.searchsorted(gid, [g, g + 1])
            edges += forest(np.unique(fps_[a:b]), int(starts[a]), segments, max_bits)
        small = sizes[gid] <= 200 if len(gid) else np.zeros(0, dtype=bool)
        edges += _small_groups(fps_[small], gid[small], starts[small], segments, max_bits)
        out = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"u": out[:, 0], "v": out[:, 1]})

    ship(fps.sparkSession)
    return cut.repartition(*group).sortWithinPartitions(*group).mapInPandas(compare, "u long, v long").distinct()


# -- components ----------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of the component) for every node of the edges ``u``, ``v``."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    current = shared(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        hooked = large.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        current = shared(least.select("u", F.col("low").alias("v")).unionByName(hooked).where("u <> v").distinct())
        after = state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def grouped(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, segments: int = 5,
            keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keys`` of every row with ``fp``, ``root`` (one fingerprint of the group) and ``component_id``."""
    spark = docs.sparkSession
    ship(spark)
    marked = shared(docs.select(*keys, fingerprint_column(F.col("text"), shingle_words).alias("fp")))
    fps = shared(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    groups = components(candidate_edges(fps.select("fp"), segments, max_bits))
    rooted = fps.join(groups, fps["fp"] == groups["node"], "left").select(
        "fp", "copies", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    total = fps.agg(F.sum("copies")).first()[0] or 0
    heavy = F.col("copies") > int(total * HEAVY_SHARE) + 1
    hot = [r["fp"] for r in fps.where(heavy).select("fp").collect()]  # at most 1 / HEAVY_SHARE of them
    salted = rooted.join(named, "root").select("fp", "root", "component_id", F.explode(
        F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    is_hot = F.col("fp").isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    return (marked.withColumn("salt", salt).join(salted, ["fp", "salt"]).select(*keys, "fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    segments: int = 5) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable) per row."""
    return grouped(docs.select("doc_id", "text"), shingle_words, max_bits, segments).select(
        "doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                segments: int = 5) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row of the smallest ``doc_id``.

    Among rows of the same id the smallest hash of all columns decides; identical rows
    are one.  Rows without an id only stay if their group has no other.
    """
    own = docs.withColumn("_row_hash", F.xxhash64(*docs.columns))
    rows = grouped(own.select("doc_id", "text", "_row_hash"), shingle_words, max_bits, segments, ("doc_id", "_row_hash"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row_hash")).alias("first")
    kept = rows.groupBy("root").agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first._row_hash").alias("_hash"))
    kept = kept.groupBy("_id", "_hash").agg(F.count("*").alias("_groups"))
    same = own["doc_id"].eqNullSafe(kept["_id"]) & (own["_row_hash"] == kept["_hash"])
    return own.join(kept, same).dropDuplicates(["doc_id", "_row_hash"]).select(*docs.columns)
