"""Vectors as product codes: whole-number k-means by parts, nearest entries by annular norm pruning.

An entry can be nearer than the best one known only if its norm differs from the row's by no more
than that distance. Entries are sorted by norm; the interval that the best distance allows is found
by binary search and only this annulus is evaluated, exactly and with both its ends.

Each round is one pass over the rows: a task adds up its parts by entry, so what is shuffled has a
row for each task and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import column, cut, joined, sliced
from plumbline.llm.vectors import finite_vector, longest, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that Python code works on at once, and of these the ones, alike in norm, whose annuli are evaluated together.
ROWS_AT_ONCE, TILE = 8192, 64
#: Entries around a row's norm that give the first best distance.
FIRST = 16
#: Sums of products below this are exact in double precision.
EXACT = 2**52


def widest(width: int) -> int:
    """The largest component for which the error of a whole vector fits a long."""
    return isqrt(2**62 // max(width, 1)) // 2


def whole(vectors: np.ndarray) -> np.ndarray:
    """Components times SCALE, rounded down; beyond ``widest`` they stay at it."""
    most = widest(vectors.shape[1])
    return np.clip(np.floor(vectors * SCALE), -most, most).astype(np.int64)


def _distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows with all entries."""
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * rows.shape[1] < EXACT else np.int64
    x, c = rows.astype(kind), entries.astype(kind)
    if kind is np.float64:
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    out = np.empty((len(x), len(c)), dtype=np.int64)
    for k, e in enumerate(c):
        out[:, k] = ((x - e) ** 2).sum(axis=1)
    return out


@dataclass
class Codebook:
    """Entries of one part in order of their norm, with the index each had."""

    norms: np.ndarray
    entries: np.ndarray
    index: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Codebook:
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(norms, kind="stable")
        return cls(norms[order], entries[order], order)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each row's nearest entry, ties to the lower, and the squared distance.

        Rows go in order of their norms, TILE at a time. Entries about those norms give each row
        a first distance, which bounds the annulus; what of it was not seen is evaluated then.
        """
        norms = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(norms, kind="stable")
        index, error = np.empty(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
        for a in range(0, len(order), TILE):
            at = order[a : a + TILE]
            x, r = rows[at], norms[at]
            middle = int(np.searchsorted(self.norms, r[len(r) // 2]))
            low = max(0, min(middle - FIRST // 2, len(self.norms) - FIRST))
            high = min(len(self.norms), low + FIRST)
            seen = _distances(x, self.entries[low:high])
            best = np.sqrt(seen.min(axis=1).astype(np.float64))
            # Norms and roots are rounded: what is added is more than their errors, so the ends are in.
            reach = best + 1e-9 * (1 + best + r)
            first = int(np.searchsorted(self.norms, (r - reach).min(), side="left"))
            last = int(np.searchsorted(self.norms, (r + reach).max(), side="right"))
            first, last = min(first, low), max(last, high)
            every = np.concatenate([_distances(x, self.entries[first:low]), seen, _distances(x, self.entries[high:last])], axis=1) if (first, last) != (low, high) else seen
            least = every.min(axis=1)
            index[at] = np.where(every == least[:, None], self.index[first:last], len(self.index)).min(axis=1)
            error[at] = least.astype(np.int64)
        return index, error


def _assigned(vectors: np.ndarray, books: list[Codebook]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: the rows' parts, their entries and squared distances."""
    for part, book in zip(np.split(vectors, PARTS, axis=1), books, strict=True):
        yield part, *book.nearest(part)


# --- as Spark jobs ------------------------------------------------------------------------


def first_codebooks(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Entries of each part from the rows with the ENTRIES smallest ids, in their order."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").toArrow()
    return np.split(whole(matrix(first["v"], width)), PARTS, axis=1)


def _sums(rows: DataFrame, codebooks: list[np.ndarray], width: int) -> DataFrame:
    """(part, entry, count, total, place): sums of the parts nearest to each entry, one place of the part a row."""
    books, size = [Codebook.of(c) for c in codebooks], width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, len(codebooks[0]), size), dtype=np.int64)
        count = np.zeros((PARTS, len(codebooks[0])), dtype=np.int64)
        for batch in sliced(batches, ROWS_AT_ONCE):
            if batch.num_rows:
                for k, (part, index, _) in enumerate(_assigned(whole(matrix(batch["v"], width)), books)):
                    np.add.at(total[k], index, part)
                    count[k] += np.bincount(index, minlength=len(codebooks[0]))
        part, entry = np.nonzero(count)
        place = np.tile(np.arange(size), len(part))
        columns = [np.repeat(part, size), np.repeat(entry, size), place, np.repeat(count[part, entry], size), total[part, entry].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "count", "total"])

    partial = rows.select("v").mapInArrow(run, "part long, entry long, place long, count long, total long")
    # Decimals, as the sum of a table's sums may not fit a long.
    return partial.groupBy("part", "entry", "place").agg(F.sum("count").alias("count"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))


def next_codebooks(rows: DataFrame, codebooks: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Entries moved to the mean of their parts, rounded down; those without parts stay. At most PARTS x ENTRIES x width / PARTS numbers come back."""
    out = [c.copy() for c in codebooks]
    for r in _sums(rows, codebooks, width).collect():
        out[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["count"]
    return out


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def encoded(rows: DataFrame, codebooks: list[np.ndarray], width: int) -> DataFrame:
    """(vec_id, label, code, error) of every row."""
    books = [Codebook.of(c) for c in codebooks]
    kind = dict(rows.dtypes)["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS_AT_ONCE):
            code, error = [""] * batch.num_rows, np.zeros(batch.num_rows, dtype=np.int64)
            for _, index, far in _assigned(whole(matrix(batch["v"], width)), books) if batch.num_rows else ():
                code = [c + f"{i:02x}" for c, i in zip(code, index.tolist(), strict=True)]
                error += far
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compress(df: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row with a vector of finite components.

    Rows whose vector is null or holds null or non-finite components are left out. Shorter vectors
    go on with zeros up to the longest, and all up to a multiple of four components. Components too
    large for errors to fit a long stay at the largest that does (``widest``: 2^27 for 64 components,
    which are 131,072 before scaling). Repeated ids are rows of their own; null ids come last where
    the smallest are asked, equal ones in order of their vectors. Null labels are one label. Fewer
    than 256 rows give as many entries, no rows none. ``label_error`` is null where it does not fit
    a long. Columns beside ``vec_id``, ``embedding`` and ``label`` are not read.
    """
    valid = df.where(finite_vector("embedding"))
    rows = valid.select(column("vec_id").cast("long").alias("vec_id"), column("label").alias("label"), column("embedding").alias("v"))
    width = -(-max(longest(rows, "v"), 1) // PARTS) * PARTS
    codebooks = first_codebooks(rows, width)
    for _ in range(rounds):
        codebooks = next_codebooks(rows, codebooks, width)
    coded = cut(encoded(rows, codebooks, width).withColumns({"none": F.col("label").isNull(), "text": F.coalesce(F.col("label").cast("string"), F.lit(""))}))
    sums = coded.groupBy("none", "text").agg(F.expr("try_sum(error)").alias("label_error"))
    out = joined(coded, sums, ["none", "text"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
