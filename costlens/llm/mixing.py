"""Mixing sources to target weights by Poisson replication.

Every source gets a repetition rate that brings its bytes to its share of the
mix.  A document is repeated as often as a Poisson variable of that mean says;
the variable is the inverse of the Poisson distribution at a number that a hash
of the seed and the document's id gives, so the same document always gets the
same count.  Copies are then put in a random global order by a hash of id and copy.

Sources that the targets don't name share the rest of the weight in proportion to
their size, so the table of rates has one row per named source and one more,
whatever the number of sources; no join on the source is needed and a hot source
stays where its rows are.

Edge cases: a null source belongs to the rest; a null or empty text counts no
bytes and is repeated at its source's rate; a named source without rows leaves
its share to nobody; a source whose texts are all empty has rate 1; rows with the
same id get the same count (without an id, the text decides); extra columns are
kept, and ``copy`` and ``shuffle_key`` replace columns of that name.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = "mix-1"

#: Name of the group of all sources that the targets don't name.
REST = "*"


def poisson_thresholds(rate: float) -> tuple[int, list[float]]:
    """(first, values): values[i] is the probability of at most first + i; a number u means the count of values <= u."""
    if rate <= 0:
        return 0, []
    spread = 12 * math.sqrt(rate) + 40
    first = max(0, math.floor(rate - spread))
    values, total = [], 0.0
    for k in range(first, math.ceil(rate + spread)):
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        values.append(total)
        if total >= 1.0:
            break
    return first, values


def hashed_long(*parts: Column | str) -> Column:
    """52 bits of a hash of the parts joined by ``|``."""
    joined = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long")


def group_of(source: Column, targets: Mapping[str, float]) -> Column:
    return F.when(source.isin(list(targets)), source).otherwise(F.lit(REST)) if targets else F.lit(REST)


def rates(docs: DataFrame, targets: Mapping[str, float], epochs: float = 1.0) -> dict[str, float]:
    """Mean repetitions of each group: its share of ``epochs`` times all bytes, over its own bytes."""
    if sum(targets.values()) > 1 + 1e-9 or any(w < 0 for w in targets.values()):
        raise ValueError("weights are shares that sum up to 1 at most")
    weights = {**targets, REST: max(0.0, 1.0 - sum(targets.values()))}
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes")
    sizes = {r["g"]: r["bytes"] for r in docs.groupBy(group_of(F.col("source"), targets).alias("g")).agg(size).collect()}
    total = sum(sizes.values())
    return {g: weights[g] * epochs * total / b if b else 1.0 for g, b in sizes.items()}


def repetitions(docs: DataFrame, rate: Mapping[str, float], targets: Mapping[str, float], seed: str = SEED) -> Column:
    """Number of copies of a row."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    u = hashed_long(seed, key) / F.lit(float(1 << 52))
    group = group_of(F.col("source"), targets)
    count = F.lit(0)
    for g, r in rate.items():
        first, values = poisson_thresholds(r)
        drawn = F.lit(first)
        if values:
            drawn = drawn + F.size(F.filter(F.array(*map(F.lit, values)), lambda x: x <= u))
        count = F.when(group == g, drawn).otherwise(count)
    return count


def mix(docs: DataFrame, targets: Mapping[str, float], epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """``docs`` repeated to the target weights, in random order, with ``copy`` (from 0) and ``shuffle_key``."""
    rows = docs.drop("copy", "shuffle_key")
    copies = repetitions(rows, rates(rows, targets, epochs), targets, seed)
    repeated = (rows.withColumn("_copies", copies).where("_copies > 0")
                .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    return (repeated.withColumn("shuffle_key", hashed_long(seed, "order", key, F.col("copy").cast("string")))
            .orderBy("shuffle_key", "doc_id", "copy"))
