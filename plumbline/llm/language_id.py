"""Language identification: known words first, character n-grams for the others.

Words seen in training carry a log frequency for each language. A word that was not seen is
scored by the longest of its character n-grams that were: five letters, then four, and so on
down to single letters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import carried, column, cut, sliced, text_of

RUN = re.compile(r"[^\W\d_]+")
UNDECIDED = "und"
LONGEST = 5
#: How often an entry is taken to occur, of the words of the largest language, where it was not seen.
UNSEEN = 0.1
CACHED_WORDS = 100_000
ROWS_AT_ONCE = 500


@dataclass
class LanguageModel:
    """Log frequencies of words and of n-grams by length, a row for each entry, a column for each language."""

    langs: list[str] = field(default_factory=list)
    words: dict[str, int] = field(default_factory=dict)
    word_rows: np.ndarray | None = None
    grams: dict[str, int] = field(default_factory=dict)
    gram_rows: np.ndarray | None = None

    def backed_off(self, word: str) -> np.ndarray:
        """Scores of a word that was not seen: the mean of its longest known n-grams; zeros if not even its letters are known."""
        for n in range(LONGEST, 0, -1):
            known = [self.grams[g] for g in grams_of(word, n) if g in self.grams]
            if known:
                return np.add.reduce(self.gram_rows[known], axis=0) / len(known)
        return np.zeros(len(self.langs))


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case. Numbers, number signs such as a half among them, end a run."""
    runs = RUN.findall(text.lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [w for run in runs for w in "".join(c if c.isalpha() else " " for c in run).split()]


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word; from two letters on its ends are marked."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counted(batches, of):
    for batch in sliced(batches, ROWS_AT_ONCE):
        found: Counter = Counter()
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            of(found, *row)
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())],
            names=["lang", "item", "n"],
        )


def _count_words(batches):
    def of(found, lang, text):
        for word, n in Counter(words_of(text)).items():
            found[lang, word] += n

    return _counted(batches, of)


def _count_grams(batches):
    def of(found, lang, word, times):
        for n in range(1, LONGEST + 1):
            for gram in grams_of(word, n):
                found[lang, gram] += times

    return _counted(batches, of)


def log_frequencies(counts: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """ln(count / total + UNSEEN / largest total): totals are by language (column) among the entries of one group.

    What is added is the same for every language, so that one with few words is not favoured
    for all that it was never seen with.
    """
    out = np.empty(counts.shape)
    for g in np.unique(groups):
        own = groups == g
        totals = counts[own].sum(axis=0)
        out[own] = np.log(counts[own] / np.maximum(totals, 1) + UNSEEN / max(totals.max(), 1))
    return out


def _table(counts: DataFrame, langs: list[str], group_of) -> tuple[dict[str, int], np.ndarray]:
    """Entries and their log frequencies. As many rows come as the sampled documents have entries."""
    rows = counts.toArrow().to_pandas()
    codes, items = pd.factorize(rows["item"])
    table = np.zeros((len(items), len(langs)))
    table[codes, pd.Index(langs).get_indexer(rows["lang"])] = rows["n"]
    return {x: i for i, x in enumerate(items)}, log_frequencies(table, np.fromiter(map(group_of, items), dtype=int, count=len(items)))


def sampled_by_language(labelled: DataFrame, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows (lang, key, ...) of each language, all of one that has fewer; a hash of the key decides."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("_pl_n"))
    steps = 1 << 30
    chance = F.least(F.lit(1.0), F.lit(float(bound)) / F.col("_pl_n"))
    return labelled.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(steps)) < chance * steps).drop("_pl_n")


def fit_language_model(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = 1500, seed: int = 11) -> LanguageModel:
    """Counts words and n-grams of the labelled rows of ``docs``; rows with a null lang are left out.

    ``sample_docs`` bounds, in expectation, how many rows of each language are read for
    training; a language with fewer is read whole. All words and n-grams of those rows are kept.
    An input without labelled rows gives a model without languages.
    """
    labelled = docs.where(column(lang).isNotNull()).select(column(lang).cast("string").alias("lang"), text_of(text).alias("text"), column(key).alias("key"))
    chosen = sampled_by_language(labelled, sample_docs, seed).select("lang", "text")
    summed = lambda df: df.groupBy("lang", "item").agg(F.sum("n").alias("n"))
    words = cut(summed(chosen.mapInArrow(_count_words, "lang string, item string, n long")))
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    if not langs:
        return LanguageModel()
    known, word_rows = _table(words, langs, lambda x: 0)
    parts, gram_rows = _table(summed(words.mapInArrow(_count_grams, "lang string, item string, n long")), langs, len)
    return LanguageModel(langs, known, word_rows, parts, gram_rows)


class Predictor:
    """Scores texts. Vectors of words seen before stand in one table that grows up to a bound."""

    def __init__(self, model: LanguageModel):
        self.model, self.at, self.table = model, {}, np.empty((1024, len(model.langs)))

    def _learn(self, words: set[str]) -> None:
        need = len(self.at) + len(words)
        if need > len(self.table):
            grown = np.empty((max(need, 2 * len(self.table)), len(self.model.langs)))
            grown[: len(self.at)] = self.table[: len(self.at)]
            self.table = grown
        start, names = len(self.at), list(words)
        self.at.update(zip(names, range(start, need), strict=True))
        place = np.fromiter((self.model.words.get(w, -1) for w in names), dtype=np.intp, count=len(names))
        rows = self.table[start:need]
        rows[place >= 0] = self.model.word_rows[place[place >= 0]]
        for k in np.flatnonzero(place < 0).tolist():
            rows[k] = self.model.backed_off(names[k])

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        split = [words_of(t) for t in texts]
        every = set(chain.from_iterable(split))
        fresh = every.difference(self.at)
        # When the table is full it is begun anew, with all words of these texts.
        if len(self.at) + len(fresh) > CACHED_WORDS:
            self.at, fresh = {}, every
        langs, labels, scores = self.model.langs, [], []
        if langs:
            self._learn(fresh)
        for words in split:
            if not words or not langs:
                labels.append(UNDECIDED)
                scores.append(0.0)
                continue
            sums = self.table[np.fromiter(map(self.at.__getitem__, words), dtype=np.intp, count=len(words))].sum(axis=0)
            best = int(sums.argmax())
            labels.append(langs[best])
            scores.append(1.0 / math.fsum(np.exp(np.maximum(sums - sums[best], -700.0))))
        return labels, scores


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds lang_pred and score to the columns named in ``keep``.

    A null text, an empty one and one without letters give ``und`` and 0. Equal scores go to
    the language first in the alphabet. Rows that repeat are scored alike; an empty table
    gives an empty one. Columns not named in ``keep`` are not returned; one in it that is
    named lang_pred or score is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = carried(docs, keep, ("lang_pred", "score"))
    width = len(kept.inner)
    inner = docs.select(*kept.inner, text_of(text).alias("_pl_text"))

    def score(batches):
        predict = Predictor(sent.value)
        for batch in sliced(batches, ROWS_AT_ONCE):
            labels, scores = predict(batch.column(width).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:width], "lang_pred", "score"])

    return kept.named(inner.mapInArrow(score, ", ".join([*kept.schema, "lang_pred string", "score double"])))
