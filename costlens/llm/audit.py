"""Audit of how filters interact: what each one removes in every order of application.

A document fails some of the filters; a set of failed filters is a mask.  For a
row of masks, with 0 where a filter fails and infinity where it does not, and the
matrix of positions (the inverse of every order: at which step is a filter
applied?), the min-plus product

    removal[mask, order] = min over filters (mask[filter] + position[filter, order])

is the step at which an order removes the documents of that mask.  Scattering the
documents by it, weighted by their number and by labels, gives what every step
keeps, removes and finds already removed, and the sum over all orders is the
filter's Shapley value times the number of orders.

Documents are counted per part and mask before any of this, so the product runs over
at most 2**filters rows a part, whatever the number of documents; parts are spread over
tasks.  *Equal to the text of a smaller id* needs the smallest id of every text:
rows shrink to a digest of the text first and are counted per digest and id, the
smallest id is a map-side combined minimum, and it comes back by a join on digest *and*
id, so neither a text with very many copies nor an id with very many rows meets in a task.

Edge cases: a null text counts as empty; a null source is the part ``''``; a row
without an id never fails the duplicate filter, makes no other row fail it, and has no
label; rows of equal id and text are no duplicates of each other; if an id has
several labels, 1 counts; labels of unknown ids are ignored; other columns are never
read; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations
from string import ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, ship, text_or_empty

#: What a step reports, in columns of ``bigint``.
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

#: The filter that looks at other documents.
DUPLICATE = "E"


def row_filters() -> dict[str, Column]:
    """Conditions under which a text fails, from the text alone."""
    text = text_or_empty()
    words = F.array_remove(F.split(text, WORD_GAP), "")
    n_words, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, ascii_uppercase, ""))
    return {"A": n_words < 200, "B": 100 * distinct < 50 * n_words, "C": 100 * capitals > 2 * F.length(text),
            "D": text.rlike(r"[#$%&*|]")}


def failures(docs: DataFrame, filters: Mapping[str, Column], duplicate: str | None = DUPLICATE) -> DataFrame:
    """``doc_id``, ``part``, ``mask`` and number ``n`` of rows with them.

    Bit ``i`` of the mask is set if the i-th of the filters (then ``duplicate``) fails.
    """
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(filters.values())), F.lit(0))
    own = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                      mask.alias("mask"), F.sha2(text_or_empty(), 256).alias("digest"))
    if duplicate is None:
        return own.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    counted = own.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    first = (own.groupBy(F.col("digest").alias("_digest")).agg(F.min("doc_id").alias("_first"))
             .withColumn("_is_first", F.lit(True)))
    same = (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("_first"))
    later = F.col("doc_id").isNotNull() & F.col("_is_first").isNull()
    return (counted.join(first, same, "left")
            .select("doc_id", "part", (F.col("mask") + F.when(later, F.lit(1 << len(filters))).otherwise(F.lit(0))).alias("mask"), "n")
            .groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")))


def weighted_masks(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part: the masks with their rows ``n``, those labelled ``good`` and those labelled ``toxic``."""
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"),
                                         F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    marked = failed.join(marks, "doc_id", "left")
    per_mask = marked.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    # at most 2 ** filters entries
    return per_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))


class Orders:
    """All orders of some filters and the removal steps they give."""

    def __init__(self, letters: str):
        self.size = len(letters)
        self.orders = np.array(list(permutations(range(self.size))))
        self.names = ["".join(letters[i] for i in order) for order in self.orders]
        #: position[filter, order]: the step (from 0) at which an order applies a filter
        self.position = np.argsort(self.orders, axis=1).T

    def removal(self, masks: np.ndarray) -> np.ndarray:
        """Min-plus product of masks and positions; the number of filters where nothing removes."""
        fails = (masks[:, None] >> np.arange(self.size)) & 1
        cost = np.where(fails == 1, 0, self.size)  # infinity: no position reaches the number of filters
        return np.minimum((cost[:, :, None] + self.position[None]).min(axis=1), self.size)

    def report(self, masks: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """The measures, each ``[order, step]``; ``weights`` has rows n, good and toxic, a column per mask."""
        step, m = self.removal(masks), self.size
        count = len(self.orders)

        def scatter(weight: np.ndarray) -> np.ndarray:
            out = np.zeros((count, m + 1), dtype=np.int64)
            np.add.at(out, (np.broadcast_to(np.arange(count), step.shape), step), weight[:, None])
            return out

        removed, good, toxic = (scatter(w) for w in weights)
        n = weights[0]
        fails = (masks[:, None] >> np.arange(m)) & 1
        failing = n @ fails  # per filter
        taken = removed[:, :m]
        by_filter = np.zeros(m, dtype=np.int64)
        np.add.at(by_filter, self.orders, taken)
        only = np.array([n[masks == 1 << i].sum() for i in range(m)], dtype=np.int64)
        return {"kept": n.sum() - np.cumsum(taken, axis=1), "removed": taken, "redundant": failing[self.orders] - taken,
                "unique_fails": only[self.orders], "good_lost": good[:, :m], "toxic_lost": toxic[:, :m],
                "shapley": by_filter[self.orders]}


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None,
          duplicate: str | None = DUPLICATE) -> DataFrame:
    """One row per part, order of the filters (``filter_order``) and ``step`` (from 1) with :data:`MEASURES`."""
    ship(docs.sparkSession)
    filters = row_filters() if filters is None else filters
    letters = "".join(filters) + (duplicate or "")
    masks = weighted_masks(failures(docs, filters, duplicate), labels)

    def reports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        orders = Orders(letters)
        for batch in batches:
            for part, entries in zip(batch["part"], batch["masks"]):
                table = np.array([[e["mask"], e["n"], e["good"], e["toxic"]] for e in entries], dtype=np.int64).T
                measures = orders.report(table[0], table[1:])
                yield pd.DataFrame({"part": part, "filter_order": np.repeat(orders.names, orders.size),
                                    "step": np.tile(np.arange(1, orders.size + 1, dtype=np.int32), len(orders.names)),
                                    **{name: measures[name].ravel() for name in MEASURES}})

    return masks.mapInPandas(reports, "part string, filter_order string, step int, " + ", ".join(f"{m} bigint" for m in MEASURES))
