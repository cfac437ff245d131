"""Language identification by words first, character n-grams for words not known.

Training counts, for every language, the words of its labelled documents and
the character n-grams of those words (word ends marked), as Spark aggregates.
A known word scores its smoothed log frequency in each language.  An unseen word
backs off: its n-grams of the longest length are looked up, and if none of them
is known, those one character shorter, down to single characters; the mean log
frequency of the known ones is the word's score.  A word of which nothing is
known scores nothing.  A document's language has the highest mean over its words.

The score is the share of the language in the odds, times the evidence: the mean over
the words of how much of them is known (a known word 1, an unseen one the length
of its longest known n-grams over the longest it could have had), squared, so that
letters in random order, of which only short n-grams are known, score low in any language.

The model is fitted on a bounded sample of the labelled documents
(about ``docs_per_lang`` different texts of each language, chosen by a hash of id and text)
and keeps at most ``max_words`` words and ``max_grams`` n-grams of each language, so the
broadcast model has a size bound of its own; predictions read every document whole.
A task remembers the scores of words, in two generations, and forgets them when it ends.

Edge cases: a null, empty or letterless text is ``und`` with score 0; without any
labelled document every text is ``und``; a document of letters of which no
n-gram is known gets the language with most sampled documents and score 0;
ties go to the first language in alphabetical order; repeated rows get equal
results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

UNDETERMINED = "und"

#: Letters of any script, in a row (signs such as superscript digits also count here, and score nothing).
WORDS = re.compile(r"[^\W\d_]+").findall

#: Words of each of the two generations of a task's memory.
CACHE_WORDS = 60_000

#: Words that count towards the confidence at most: a long text is not surer than this many words make it.
SURE_WORDS = 20


@dataclass
class LanguageModel:
    """Log frequencies of words and n-grams per language (columns in the order of ``langs``)."""

    langs: list[str]
    longest: int
    words: dict[str, int] = field(default_factory=dict)
    word_scores: np.ndarray | None = None
    grams: dict[str, int] = field(default_factory=dict)
    gram_scores: np.ndarray | None = None
    usual: int = 0

    def unseen(self, word: str) -> tuple[np.ndarray, float]:
        """Scores and evidence of a word that is not known, from its longest known n-grams."""
        marked = f"<{word}>"
        most = min(self.longest, len(marked))
        for n in range(most, 0, -1):
            source = marked if n > 1 else word
            hits = [self.grams[g] for i in range(len(source) - n + 1) if (g := source[i : i + n]) in self.grams]
            if hits:
                known = len(hits) / (len(source) - n + 1)
                return np.add.reduce(self.gram_scores[hits], axis=0) / len(hits), (n - 1 + known) / most
        return np.zeros(len(self.langs)), 0.0

    def score(self, word: str) -> tuple[np.ndarray, float]:
        row = self.words.get(word)
        return self.unseen(word) if row is None else (self.word_scores[row], 1.0)


class Predictor:
    """A model with a bounded memory of the scores (and, in the last column, evidence) of words."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.rows: dict[str, int] = {}
        self.memory = self._table()
        self.old: dict[str, int] = {}
        self.old_memory = self.memory

    def _table(self) -> np.ndarray:
        return np.zeros((CACHE_WORDS, len(self.model.langs) + 1))

    def _remember(self, words: set[str]) -> None:
        new = words.difference(self.rows)
        if len(self.rows) + len(new) > CACHE_WORDS:
            self.old, self.old_memory = self.rows, self.memory
            self.rows, self.memory = {}, self._table()
            new = words
        for word in new:
            at = len(self.rows)
            before = self.old.get(word)
            if before is None:
                self.memory[at, :-1], self.memory[at, -1] = self.model.score(word)
            else:
                self.memory[at] = self.old_memory[before]
            self.rows[word] = at

    def total(self, words: list[str]) -> np.ndarray:
        """Sum of the scores and evidence of any number of words."""
        total = np.zeros(self.memory.shape[1])
        for start in range(0, len(words), CACHE_WORDS):
            part = words[start : start + CACHE_WORDS]
            self._remember(set(part))
            total += self.memory[np.fromiter(map(self.rows.__getitem__, part), dtype=np.int64, count=len(part))].sum(axis=0)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        words = WORDS(text.lower())
        total = self.total(words)
        total, evidence = total[:-1], total[-1] / max(1, len(words))
        if not total.any():
            return self.model.langs[self.model.usual], 0.0
        best = int(total.argmax())
        odds = (total - total[best]) * (min(len(words), SURE_WORDS) / len(words))
        return self.model.langs[best], float(min(1.0, evidence**2 / np.exp(odds).sum()))


def sample_by_language(docs: DataFrame, docs_per_lang: int) -> DataFrame:
    """About ``docs_per_lang`` different texts of each language at most, chosen by a hash of id and text.

    Languages with fewer documents keep them all.  Columns ``lang``, ``text``.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # one row per language, which is the number of the model's classes
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rare = [x for x, n in counts.items() if n <= docs_per_lang]
    keep = F.col("lang").isin(rare) if rare else F.lit(False)
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id"), F.col("text")), F.lit(1 << 30))
    for lang, n in counts.items():
        if n > docs_per_lang:
            keep = keep | ((F.col("lang") == lang) & (draw < int(docs_per_lang / n * (1 << 30))))
    # repeated rows share their draw; one of them is enough
    return labelled.where(keep).select("lang", "text").distinct()


def train(docs: DataFrame, docs_per_lang: int = 1500, max_words: int = 20_000, max_grams: int = 20_000,
          longest: int = 5, smooth: float = 0.5) -> LanguageModel:
    """Fit on labelled documents (columns ``doc_id``, ``text``, ``lang``)."""
    sample = sample_by_language(docs, docs_per_lang)
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("token")
    words = sample.select("lang", word).groupBy("lang", "token").agg(F.count("*").alias("n")).cache()
    marked = F.concat(F.lit("<"), F.col("token"), F.lit(">"))
    grams = None
    for n in range(1, longest + 1):
        source = marked if n > 1 else F.col("token")
        starts = F.sequence(F.lit(1), F.length(source) - n + 1)
        fits = words.where(F.length(source) >= n).select("lang", "n", source.alias("s"), F.explode(starts).alias("i"))
        part = fits.select("lang", F.lit(n).alias("size"), F.substr("s", F.col("i"), F.lit(n)).alias("token"), "n")
        grams = part if grams is None else grams.unionByName(part)
    grams = grams.groupBy("lang", "size", "token").agg(F.sum("n").alias("n"))

    def frequent(counts: DataFrame, limit: int) -> list:
        """The most frequent tokens of each language and size, with the count of all of that size."""
        of = Window.partitionBy("lang", "size")
        return (counts.withColumn("all", F.sum("n").over(of))
                .withColumn("place", F.row_number().over(of.orderBy(F.desc("n"), "token")))
                .where(F.col("place") <= limit).select("lang", "size", "token", "n", "all").collect())

    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    column = {x: i for i, x in enumerate(langs)}

    def table(rows: list) -> tuple[dict[str, int], np.ndarray]:
        index: dict[str, int] = {}
        for r in rows:
            index.setdefault(r["token"], len(index))
        size = np.zeros(len(index), dtype=np.int64)
        counts, totals = np.zeros((len(index), len(langs))), np.ones((longest + 1, len(langs)))
        for r in rows:
            at = index[r["token"]]
            size[at] = r["size"]
            counts[at, column[r["lang"]]] = r["n"]
            totals[r["size"], column[r["lang"]]] = r["all"]
        kinds = np.maximum(1, np.bincount(size, minlength=longest + 1))
        return index, np.log((counts + smooth) / (totals + smooth * kinds[:, None])[size])

    model = LanguageModel(langs, longest)
    model.words, model.word_scores = table(frequent(words.withColumn("size", F.lit(0)), max_words))
    model.grams, model.gram_scores = table(frequent(grams, max_grams // longest))
    sizes = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    model.usual = max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i)) if langs else 0
    words.unpersist()
    return model


def predict(text: Column, shared_model) -> Column:
    """Struct ``lang_pred``, ``score`` of a text column; ``shared_model`` is a broadcast :class:`LanguageModel`."""

    @F.arrow_udf("lang_pred string, score double")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predictor = Predictor(shared_model.value)
        for texts in batches:
            found = [predictor.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()),
                                              pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"])

    # marked so that a filter on the result does not evaluate it a second time
    return language.asNondeterministic()(text)


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with ``lang_pred`` and ``score``."""
    ship(docs.sparkSession)
    shared_model = docs.sparkSession.sparkContext.broadcast(model)
    wanted = docs.select(*keep, predict(F.col("text"), shared_model).alias("_found"))
    return wanted.select(*keep, "_found.lang_pred", "_found.score")
