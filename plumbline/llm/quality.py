"""Document quality by pairwise ranking.

Scores are learned from preference pairs, one text labelled good and one labelled bad, by the
Bradley-Terry model: the chance that the good one wins is the logistic function of the
difference of their scores, and a score is linear in features of the text. The cut is a
quantile of the training scores.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import carried, column, sampled, sliced, text_of

#: A score at or over this counts as good.
CUT_SCORE = 0.3
#: So many words are as good as none for the share of the most frequent word.
SHORT = 10
SYMBOLS = "!#$%&*+/<=>?@^_|~"


def _class_table() -> np.ndarray:
    """For each byte the numbers of its classes, as rows of a table to multiply counts with."""
    groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", ".", ",;:", "\"'()[]{}-", *SYMBOLS]
    table = np.zeros((256, len(groups) + 1))
    for k, chars in enumerate(groups):
        table[list(chars.encode()), k] = 1
    table[128:, -1] = 1
    return table


CLASSES = _class_table()
#: Features of a text: the byte classes and nine more.
WIDTH = CLASSES.shape[1] + 9


def features(text: str) -> np.ndarray:
    """Shares of character classes, and how words and lines repeat; for an empty text all are zero."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    words, lines = text.split(), text.split("\n")
    n = len(words)
    if not n:
        return np.zeros(WIDTH)
    shares = np.bincount(raw, minlength=256) @ CLASSES / max(1, len(raw))
    counts = Counter(words)
    upper = sum(map(str.isupper, words)) / n
    ends = sum(x.rstrip()[-1:] in (".", "?", "!", "…") for x in lines) / len(lines)
    return np.r_[
        np.sqrt(shares),
        upper,
        sum(map(eq, words, words[1:])) / n,
        # Drawn towards 0 in short texts, in which any word is a large share.
        max(0.0, (max(counts.values()) - 1) / (n + SHORT)),
        1 - len(counts) / n,
        min(len(raw) / n / 10, 3.0),
        math.log1p(n) / 10,
        1 - len(set(lines)) / len(lines),
        ends,
        sum(not w.isalnum() and not w[:-1].isalnum() for w in words) / n,
    ]


@dataclass
class QualityModel:
    """A linear score over standardised features, its cut, and the scale that maps it to 0..1."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float = 0.0
    scale: float = 1.0

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.centre) / self.spread, -6, 6) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        """1 / (1 + e^-z), where the cut is at CUT_SCORE."""
        z = (self.raw(rows) - self.cut) / self.scale + math.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_pairs(rows: np.ndarray, labels: np.ndarray, pairs: int = 40_000, steps: int = 400, ridge: float = 1e-3, seed: int = 5) -> QualityModel:
    """Gradient descent on the logistic loss of feature differences of random (good, bad) pairs.

    The cut is the quantile of the training scores at the share of bad labels. Without rows of
    both labels all texts score alike, at 0.5.
    """
    width = WIDTH
    if not len(rows) or labels.min() == labels.max():
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(width), math.log(CUT_SCORE / (1 - CUT_SCORE)))
    model = QualityModel(rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-3), np.zeros(width))
    scaled = np.clip((rows - model.centre) / model.spread, -6, 6)
    draw = np.random.default_rng(seed)
    better = draw.choice(np.flatnonzero(labels == 1), pairs)
    worse = draw.choice(np.flatnonzero(labels == 0), pairs)
    gaps = scaled[better] - scaled[worse]
    for _ in range(steps):
        lost = 1 / (1 + np.exp(np.clip(gaps @ model.weights, -60, 60)))
        model.weights += 0.5 * ((lost @ gaps) / pairs - ridge * model.weights) / max(1.0, width / 10)
    raw = model.raw(rows)
    model.cut = float(np.quantile(raw, (labels == 0).mean()))
    model.scale = max(float(raw.std()) / 2, 1e-6)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample_rows: int = 6000, seed: int = 3) -> QualityModel:
    """Learns from the rows of ``labels`` (doc_id, label) and their texts in ``docs``.

    ``sample_rows`` bounds the labelled rows used. They are chosen by a hash of the id before
    their texts are looked up, so the join needs no shuffle of the texts. An id labelled more
    than once counts as bad if any label is 0; null labels are left out.
    """
    known = labels.where(column(label).isNotNull() & column(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(label).alias("_pl_label"))
    chosen = sampled(known, F.col(doc_id), sample_rows, seed).withColumnRenamed(doc_id, "_pl_id")
    rows = docs.select(column(doc_id).alias("_pl_doc"), text_of(text).alias("_pl_text")).join(F.broadcast(chosen), F.col("_pl_doc") == F.col("_pl_id")).select("_pl_doc", "_pl_label", "_pl_text")

    def run(batches):
        for batch in sliced(batches):
            found = [features(t).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=["id", "label", "x"])

    each = rows.mapInArrow(run, "id string, label long, x array<double>")
    means = F.array(*(F.avg(F.col("x")[k]) for k in range(WIDTH)))
    # Sorted, so that the draw of pairs does not depend on the order in which tasks end.
    got = sorted((r.id, r.label, r.x) for r in each.groupBy("id").agg(F.min("label").alias("label"), means.alias("x")).collect())
    return fit_pairs(np.array([x for _, _, x in got]), np.array([y for _, y, _ in got]))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds score (0 to 1, higher is better) and predicted (1 from CUT_SCORE on) to the columns in ``keep``.

    Null text counts as empty, which is scored like any text. Equal texts score alike; rows
    that repeat are each returned; an empty table gives an empty one. Columns not named in
    ``keep`` are not returned; one in it that is named score or predicted is replaced.
    """
    kept = carried(docs, keep, ("score", "predicted"))
    width = len(kept.inner)
    inner = docs.select(*kept.inner, text_of(text).alias("_pl_text"))

    def run(batches):
        for batch in sliced(batches):
            scores = model.score(np.array([features(t) for t in batch.column(width).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(scores), pa.array((scores >= CUT_SCORE).astype(np.int32))], names=[*batch.schema.names[:width], "score", "predicted"])

    return kept.named(inner.mapInArrow(run, ", ".join([*kept.schema, "score double, predicted int"])))


def only_good(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns."""
    columns = docs.columns
    again = docs.select(*(column(c).alias(f"_pl_c{i}") for i, c in enumerate(columns)), column(text))
    scored = score_quality(again, model, text, tuple(f"_pl_c{i}" for i in range(len(columns))))
    return scored.where("predicted = 1").select(*(F.col(f"_pl_c{i}").alias(c) for i, c in enumerate(columns)))
