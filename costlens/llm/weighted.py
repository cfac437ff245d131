"""Document fingerprints by consistent weighted sampling.

A text is the set of its words, weighted by their counts.  For each of
``SAMPLES`` draws every word gets two gamma(2, 1) variables and a uniform one, all
functions of hashes of word and draw.  The word's weight is rounded down to a step of
a random geometric grid, and the word of the smallest value wins the draw; the
sample is the word with its step.  Two texts agree in a draw with a probability
that equals their generalised Jaccard similarity (sum of minima over sum of
maxima of the weights), so the share of equal samples estimates it.

Everything is built from Spark expressions.  Texts move once: they are dealt
into slices of consecutive ids, in which the next document is found by a window;
a slice also gets the first row of the following slice.  Word counts and samples of a
slice need no further exchange.

Edge cases: a null text counts as empty; texts without a word have one empty
term, so they are alike; equal texts have equal fingerprints; rows with the
same id follow each other by text hash; rows without an id come last; after the
last row comes the first, so a single row is its own next; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, WORD_SPACE, column_quantiles, slice_index

SAMPLES = 32

#: Rows of a slice of ids, and slices at most.
SLICE_ROWS = 500
MAX_SLICES = 4096

LOWEST = -(1 << 63)
ID_BITS = 30
HALF = 0xFFFFFFFF


def _uniforms(term: Column, draw: int, part: int) -> tuple[Column, Column]:
    """Two numbers between 0 and 1 from one hash."""
    h = F.xxhash64(term, F.lit(draw), F.lit(part))
    unit = float(1 << 32)
    return ((F.shiftrightunsigned(h, 32) + 0.5) / unit, (h.bitwiseAND(F.lit(HALF)) + 0.5) / unit)


def sample(term: Column, log_weight: Column, draw: int) -> Column:
    """A long whose minimum over the terms of a text is the text's sample of a draw.

    High bits: the value to minimise, in steps of 2**-24.  Low bits: term and grid step.
    """
    u1, u2 = _uniforms(term, draw, 0)
    u3, u4 = _uniforms(term, draw, 1)
    beta, _ = _uniforms(term, draw, 2)
    r = -F.log(u1 * u2)
    step = F.floor(log_weight / r + beta)
    value = F.log(-F.log(u3 * u4)) - r * (step - beta + 1)
    high = ((value + 128) * float(1 << 24)).cast("long")
    low = F.xxhash64(term, step).bitwiseAND(F.lit((1 << ID_BITS) - 1))
    return F.shiftleft(high, ID_BITS).bitwiseOR(low)


def term_counts(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``term`` (hash of a word) and its ``weight`` for each ``text`` of the rows named by ``keys``."""
    words = F.explode(F.split(F.btrim("text", F.lit(WORD_SPACE)), WORD_GAP))
    return (texts.select(*keys, words.alias("word")).select(*keys, F.xxhash64("word").alias("term"))
            .groupBy(*keys, "term").agg(F.count("*").alias("weight")))


def fingerprints(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``samples`` (array of longs) of each row's ``text``; a row is named by its keys."""
    logs = term_counts(texts, keys).select(*keys, "term", F.log("weight").alias("log_weight"))
    mins = [F.min(sample(F.col("term"), F.col("log_weight"), k)).alias(f"s{k}") for k in range(samples)]
    ids = [F.col(f"s{k}").bitwiseAND(F.lit((1 << ID_BITS) - 1)) for k in range(samples)]
    return logs.groupBy(*keys).agg(*mins).select(*keys, F.array(*ids).alias("samples"))


def as_text(samples: Column, n: int = SAMPLES) -> Column:
    """Eight hex digits per sample."""
    return F.lower(F.concat(*(F.lpad(F.hex(samples[k]), 8, "0") for k in range(n))))


def likeness(a: Column, b: Column, n: int = SAMPLES) -> Column:
    """Share of equal samples: the estimate of the generalised Jaccard similarity."""
    return reduce(add, ((a[k] == b[k]).cast("int") for k in range(n))) / float(n)


def with_next(docs: DataFrame) -> DataFrame:
    """``slice``, ``place``, ``ghost``, ``doc_id``, ``text``, ``next_text``: rows by falling id with the next row's text.

    A ghost stands for the first row of the following slice; it only serves as the next of the row before.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"))
    rows = keyed.count()
    cuts = column_quantiles(keyed.select("key"), "key", max(1, min(MAX_SLICES, rows // SLICE_ROWS)))
    own = slice_index(F.col("key"), cuts)
    # the last id of a slice is the next of the slice above; the highest id is the next of the lowest slice
    places = F.array(F.struct(own.alias("slice"), F.lit(False).alias("ghost")))
    also = F.struct(F.when(F.col("key") == F.lit(cuts[-1] if cuts else 0), 0).otherwise(own + 1).alias("slice"),
                    F.lit(True).alias("ghost"))
    is_last = F.col("key").isin(cuts)
    dealt = (keyed.withColumn("at", F.explode(F.when(is_last, F.concat(places, F.array(also))).otherwise(places)))
             .select("at.slice", "at.ghost", "doc_id", "key", "text"))
    dealt = dealt.repartition(max(8, len(cuts) // 2), "slice")
    order = Window.partitionBy("slice").orderBy("ghost", F.desc("key"), F.desc(F.xxhash64("text")))
    return dealt.select("slice", F.row_number().over(order).alias("place"), "ghost", "doc_id", "text",
                        F.lead("text").over(order).alias("next_text"))


def neighbours(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last half of its code points replaced by as many
    of the next document (descending id).
    """
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", F.coalesce(edited, F.col("text")))
    info = rows.where(~F.col("ghost")).select("slice", "place", "doc_id", n.cast("long").alias("n_chars"),
                                              F.sha2("edited", 256).alias("edited_sha256"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")),
                              F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"))))
    # doc_id comes along so that both uses of the slices read the same columns of one exchange
    texts = rows.select("slice", "place", "doc_id", sides.alias("of")).select("slice", "place", "doc_id", "of.side", "of.text")
    found = fingerprints(texts, ["slice", "place", "doc_id", "side"], samples)
    both = found.groupBy("slice", "place").agg(F.max(F.when(F.col("side") == 0, F.col("samples"))).alias("own"),
                                               F.max(F.when(F.col("side") == 1, F.col("samples"))).alias("other"))
    both = both.withColumn("next", F.lead("own").over(Window.partitionBy("slice").orderBy("place")))
    own, other, after = F.col("own"), F.col("other"), F.coalesce(F.col("next"), F.col("own"))
    return info.join(both, ["slice", "place"]).select(
        "doc_id", "n_chars", "edited_sha256", as_text(own, samples).alias("fingerprint"),
        as_text(other, samples).alias("edited_fingerprint"), likeness(own, other, samples).alias("near_edited"),
        likeness(own, after, samples).alias("near_next"))
