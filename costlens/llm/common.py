"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_SPACE = " \t\n\x0b\x0c\r"

#: Java regular expression of one or more separators.
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Columns of the ``documents`` table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this library: Spark's file server hands them its zip, once per application."""
    sc = spark.sparkContext
    package = Path(__file__).resolve().parent.parent
    if any(Path(f).name == f"{package.name}.zip" for f in sc.listFiles):
        return
    zipped = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="ship-")) / package.name), "zip",
                                 root_dir=package.parent, base_dir=package.name)
    sc.addPyFile(zipped)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table of a data folder; any file system Spark can read."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def column_quantiles(df: DataFrame, column: str, pieces: int) -> list[int]:
    """Ascending values of a whole-number column that cut it into about equal ``pieces``.

    The values occur in the column and the last one is its maximum.  The
    driver gets at most ``pieces`` numbers, whatever the size of ``df``.
    """
    shares = [i / pieces for i in range(1, pieces)] + [1.0]
    row = df.agg(F.percentile_approx(column, shares, pieces * 100).alias("q"), F.max(column).alias("top")).first()
    if row is None or row["top"] is None:
        return []
    return sorted({int(v) for v in row["q"]} | {int(row["top"])})


def slice_index(value: Column, cuts: Sequence[int]) -> Column:
    """Index of the first cut that is not below ``value`` (``len(cuts)`` above all): a balanced CASE tree."""
    if not cuts:
        return F.lit(0)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))
