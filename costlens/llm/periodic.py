"""Periodic runs of words, found by seed and extend on diagonals.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart
are identical) and length at least ``max(LEAST_WORDS, LEAST_PERIODS * q)`` that
no neighbouring word extends.  On diagonal ``q`` (word ``i`` against word ``i + q``)
it is an agreement of at least ``(LEAST_PERIODS - 1) * q`` words, five at least.

* Seeds.  For lags of ``[2**j, 2**(j+1))`` the k-grams of the agreement that is
  guaranteed there, ``k = 3 * 2**j`` (5 for lag 1), are indexed exactly: a k-gram
  gets its number from the numbers of two shorter ones.  Pairs of an
  occurrence and the next one of the same k-gram are the seeds.  Next ones suffice:
  ``k`` is not below the lag, so inside a run a nearer occurrence would give
  the run a smaller period.  That makes at most one seed per word and length.
* Extension.  A seed is extended both ways along its diagonal, in numpy blocks
  that double.  A table per lag holds how far that diagonal is covered, and
  seeds inside are not extended again.
* If no k-gram of a length occurs twice, no longer one does and the search ends.
  A first look at a whole Arrow batch finds the documents in which five words
  occur twice at all; a hash decides there, and a clash only costs a look.

Every document is handled by itself in one task, in time ``n log n`` of its words,
without a shuffle.

Edge cases: a null or empty text has no words and no run; a run over the whole text
counts; repeated rows give repeated results; ties for the greatest exponent go to the
smallest start, then the smallest period; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Words and periods of the shortest run.
LEAST_WORDS, LEAST_PERIODS = 6, 4

#: Characters of text handled at a time.
GROUP_CHARS = 4_000_000

words_of = re.compile(r"[^\x20\x09-\x0D]+").findall


class Run(NamedTuple):
    start: int
    length: int
    period: int


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many first places of two equally long arrays are equal, in blocks that double."""
    n, at, block = len(a), 0, 16
    while at < n:
        differ = np.flatnonzero(a[at : at + block] != b[at : at + block])
        if differ.size:
            return at + int(differ[0])
        at, block = at + block, 2 * block
    return n


def _numbers(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same number for the same pair, different numbers for different pairs."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def _grams(one: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(first lag, beyond last lag, numbers of the k-grams)``, lags doubling; ends with the words."""
    two = _numbers(one[:-1], one[1:])
    three = _numbers(two[:-1], one[2:])
    yield 1, 2, _numbers(three[:-2], two[3:])  # five words
    gram, k, lag = three, 3, 1
    while 2 * k <= len(one):
        gram = _numbers(gram[: len(gram) - k], gram[k:])
        k, lag = 2 * k, 2 * lag
        yield lag, 2 * lag, gram


def find_runs(words: np.ndarray) -> list[Run]:
    """All runs of a sequence of whole numbers, by start, then period."""
    n, found = len(words), []
    if n < LEAST_WORDS:
        return found
    for low, high, gram in _grams(words):
        order = np.argsort(gram, kind="stable")
        same = gram[order[1:]] == gram[order[:-1]]
        if not same.any():
            break
        place = order[:-1][same]
        lag = order[1:][same] - place
        near = (lag >= low) & (lag < high)
        place, lag = place[near], lag[near]
        by_lag = np.lexsort((place, lag))
        place, lag = place[by_lag], lag[by_lag]
        at, covered = 0, {}
        while at < len(place):
            i, q = int(place[at]), int(lag[at])
            if i < covered.get(q, 0):  # on to the first seed of this lag that is not covered, or to the next lag
                of_lag = np.searchsorted(lag, q, side="right")
                at += int(np.searchsorted(place[at:of_lag], covered[q]))
                continue
            first = i - _agree(words[:i][::-1], words[q : i + q][::-1])
            last = i + _agree(words[i : n - q], words[i + q :])
            covered[q] = last
            length = last + q - first
            if length >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.append(Run(first, length, q))
            at += 1
    return sorted(found, key=lambda r: (r.start, r.period))


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest exact length / period; ties: smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run.length * best.period > best.length * run.period:
            best = run
    return best


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for run in runs:
        keep[run.start + run.period : run.start + run.length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def repeat_tail(words: list[str], doc_id) -> list[str]:
    """The words with the tail of every tenth document (by a hash of its id) made periodic."""
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    unit = words[start : start + period]
    return words[:start] + (unit * ((n - start) // period + 1))[: n - start]


def _may_repeat(numbers: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Per document of a batch: can five words in a row occur twice?  Never wrong about a *no*."""
    out = np.zeros(docs, dtype=bool)
    if len(numbers) < 5:
        return out
    mixed = numbers.astype(np.uint64) + np.uint64(1)
    size = len(numbers) - 4
    gram = doc[:size].astype(np.uint64)
    for k in range(5):
        gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + mixed[k : k + size]
    inside = doc[:size] == doc[4:]
    gram, owner = gram[inside], doc[:size][inside]
    order = np.argsort(gram)
    same = gram[order[1:]] == gram[order[:-1]]
    out[owner[order[1:][same]]] = True
    return out


def runs_of_texts(docs: list[list[str]]) -> list[list[Run]]:
    """The runs of each of many documents, given as words."""
    index: dict[str, int] = {}
    numbers = [np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words)) for words in docs]
    flat = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(docs)), [len(x) for x in numbers])
    look = _may_repeat(flat, owner, len(docs))
    return [find_runs(x) if look[i] else [] for i, x in enumerate(numbers)]


#: Columns of :func:`periodic_runs`: Spark and Arrow type.
COLUMNS = {"n_runs": ("bigint", pa.int64()), "start": ("bigint", pa.int64()), "length": ("bigint", pa.int64()),
           "period": ("bigint", pa.int64()), "exponent_milli": ("bigint", pa.int64()),
           "runs_sha256": ("string", pa.string()), "collapsed_sha256": ("string", pa.string()),
           "runs": ("array<struct<start:bigint,length:bigint,period:bigint>>",
                    pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
           "collapsed": ("string", pa.string())}

DIGESTS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def _row(words: list[str], runs: list[Run], outputs: tuple[str, ...]) -> tuple:
    top = strongest(runs)
    text = " ".join(collapsed(words, runs))
    values = {"n_runs": len(runs), "collapsed": text, "runs": [r._asdict() for r in runs] if "runs" in outputs else None,
              "start": top and top.start, "length": top and top.length, "period": top and top.period,
              "exponent_milli": top and 1000 * top.length // top.period,
              "runs_sha256": sha256("".join(f"{r.start},{r.length},{r.period}\n" for r in runs).encode()).hexdigest(),
              "collapsed_sha256": sha256(text.encode()).hexdigest()}
    return tuple(values[name] for name in outputs)


def periodic_runs(docs: DataFrame, outputs: tuple[str, ...] = ("runs", "collapsed"),
                  change: Callable[[list[str], object], list[str]] | None = None) -> DataFrame:
    """``doc_id`` and the ``outputs`` (names of :data:`COLUMNS`) of every row of ``docs``.

    ``runs`` are all runs (word number, length, period), ``collapsed`` the text without
    their repetitions, single spaces between words.  ``change`` may edit the words of a
    document first, given its id.
    """
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {id_type}", *(f"{name} {COLUMNS[name][0]}" for name in outputs)])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                end, size, docs_words = start, 0, []
                while end < batch.num_rows and size < GROUP_CHARS:
                    text = batch.column(1)[end].as_py() or ""
                    words = words_of(text)
                    docs_words.append(change(words, batch.column(0)[end].as_py()) if change else words)
                    size += len(text)
                    end += 1
                rows = [_row(w, r, outputs) for w, r in zip(docs_words, runs_of_texts(docs_words))]
                columns = [pa.array(c, COLUMNS[name][1]) for c, name in zip(zip(*rows), outputs)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), *columns], ["doc_id", *outputs])
                start = end

    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(found, schema)
