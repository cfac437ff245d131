"""Quality rules: a threshold table compiled into one Spark projection.

A rule is a row of :data:`RULES`: the name of a ratio, its least and its greatest
allowed value.  The ratios come from counts of words, symbols, stop words and
lines of a text; the table becomes one column that lists the rules a text breaks.
Counts and rules are built-in expressions; no user function runs.

Words in repeated windows are counted inside the row: the hashes of all
five-word windows are compared, and only texts with a repeated hash sort them to
find the words that the repeated windows cover.

Edge cases: a null or blank text has no words, fails the base rule and breaks no
other; ratios over nothing are null and break no rule; texts are read whole;
repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, WORD_SPACE

WINDOW = 5

#: Common short words of the languages served.
STOP_WORDS = (
    "the of and to in a is that it for was on with as be by at are this from or an "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine "
    "de la le et les des en un du une que est pour qui dans par sur au avec "
    "el los y del se las por con no su para es al lo como").split()

#: Threshold table: ratio, least and greatest allowed value (None: no bound).
RULES = (
    ("mean_word_chars", 1.5, 20.0),
    ("symbols_per_word", None, 0.3),
    ("stop_word_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.5),
    ("mean_line_words", 2.0, None),  # lists of single words
)

#: Words from which on the share of stop words is looked at.
STOP_WORDS_FROM = 30

SYMBOLS = "[#*$%&|<>]"


def counts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of words, word characters, symbols, stop words, lines and repeats of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(WORD_SPACE))
    none = F.array().cast("array<string>")
    split = docs.select(
        "doc_id", text.alias("text"),
        F.when(trimmed == "", none).otherwise(F.split(trimmed, WORD_GAP)).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("words")
    windows = F.when(n < WINDOW, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))),
                    lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    measured = split.select(
        "doc_id", n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        windows.alias("windows"))
    numbered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    none = F.array().cast("array<struct<hash: bigint, at: int>>")
    measured = measured.withColumn("ordered", F.when(repeats, numbered).otherwise(none)).drop("windows")
    again = F.filter("ordered", lambda x, i: (x["hash"] == F.get("ordered", i - 1)["hash"])
                     | F.coalesce(x["hash"] == F.get("ordered", i + 1)["hash"], F.lit(False)))
    measured = measured.withColumn("starts", F.sort_array(F.transform(again, lambda x: x["at"]))).drop("ordered")
    # a repeated window covers its words up to where the next one starts
    covered = F.transform("starts", lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - at, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0), lambda a, b: a + b).cast("long")
    return measured.withColumn("n_repeat_words", total).drop("starts")


def ratios() -> dict[str, Column]:
    """The ratios that rules may name, from the columns of :func:`counts`; null where there is nothing to divide by."""

    def over(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b))

    return {
        "mean_word_chars": over("word_chars", "n_words"),
        "symbols_per_word": over("n_symbols", "n_words"),
        # too few words say nothing of how often the common ones come
        "stop_word_ratio": F.when(F.col("n_words") >= STOP_WORDS_FROM, F.col("n_stop_words") / F.col("n_words")),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "mean_line_words": over("n_words", "n_lines"),
    }


def broken_rules(rules=RULES) -> Column:
    """The table as one column: names of the broken rules, comma-joined."""
    ratio = ratios()
    broken = []
    for name, least, greatest in rules:
        bounds = ([ratio[name] < least] if least is not None else []) + ([ratio[name] > greatest] if greatest is not None else [])
        broken.append(F.when(reduce(Column.__or__, bounds), F.lit(name)))
    return F.concat_ws(",", *broken)


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """Counts, ``base_failed``, ``broken`` rules and the verdict ``kept`` per row of ``docs``."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = counts(docs).withColumn("base_failed", base).withColumn("broken", broken_rules(rules))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & (F.col("broken") == "")).alias("kept"),
                         "n_lines", "n_stop_words", "broken")
