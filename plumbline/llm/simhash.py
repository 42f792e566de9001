"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints within the radius share at least one group of whole bit blocks, so all pairs to
compare stand together in some bucket. Within buckets 64 fingerprints are compared at once:
their bits are stored as vertical planes, distances are counted by carry-save adders over the
planes, and words of the planes in which every fingerprint is already too far are abandoned.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_PAIRS, column, cut, joined, shuffle_parts, sliced, text_of
from plumbline.llm.components import connected_components

BITS = 64
#: Buckets over this size are compared by pairs of chunks, so that no task holds one whole.
CHUNK = 4096
#: The fingerprints a bucket may hold on average before blocks are chosen that split finer.
MEAN_BUCKET = 2048
SHINGLES_AT_ONCE, GATHERED, WORDS_AT_ONCE = 100_000, 40_000, 1 << 16


def shingle_hashes(text: str, size: int) -> list[int]:
    words = text.encode().lower().split()  # for bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return []
    whole = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(whole, 42)]
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    return [xxhash.xxh64_intdigest(whole[a:b], 42) for a, b in zip(starts, ends[size - 1 :], strict=False)]


def fingerprint_of_hashes(found: np.ndarray) -> np.uint64:
    """The bits set in over half of the hashes; 0 without any."""
    ones = np.zeros(BITS, dtype=np.int64)
    for a in range(0, len(found), SHINGLES_AT_ONCE):
        part = found[a : a + SHINGLES_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(found), bitorder="little").view("<u8")[0]


def fingerprints(texts: list[str], size: int = 4) -> np.ndarray:
    """The fingerprint of each text's shingles, repeats included; 0 without words."""
    return np.array([fingerprint_of_hashes(np.array(shingle_hashes(t, size), dtype="<u8")) for t in texts], dtype=np.uint64)


def _beyond(counts: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is over the radius; ``counts`` are its binary digits from the lowest."""
    more, same = np.zeros_like(over), ~np.zeros_like(over)
    for k in reversed(range(len(counts))):
        if radius >> k & 1:
            same = same & counts[k]
        else:
            more |= same & counts[k]
            same = same & ~counts[k]
    return over | more


def near_lanes(planes: np.ndarray, valid: np.ndarray, query: np.ndarray, at: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a query fingerprint and a word of the planes: the pairs with near lanes, and those lanes' bits.

    Two planes are added at a time by a carry-save adder; carries run up through as many counters
    as the radius has binary digits, and what runs out of the last is over it.
    """
    left = np.arange(len(query))
    counts = [np.zeros(len(query), dtype=np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(len(query), dtype=np.uint64)
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(0, BITS, 2):
        q, w = query[left], at[left]
        x, y = (planes[k][w] ^ np.where(q >> np.uint64(k) & np.uint64(1), every, np.uint64(0)) for k in (b, b + 1))
        u = counts[0] ^ x
        carry = counts[0] & x | u & y
        counts[0] = u ^ y
        for k in range(1, len(counts)):
            counts[k], carry = counts[k] ^ carry, counts[k] & carry
        over |= carry
        if b % 8 == 6:
            alive = (~_beyond(counts, over, radius) & valid[w]) != 0
            left, over, counts = left[alive], over[alive], [c[alive] for c in counts]
            if not len(left):
                break
    return left, ~_beyond(counts, over, radius) & valid[at[left]]


def bit_planes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of fingerprints stored vertically, 64 to a word, and the lanes that are in use; for one group."""
    bit = np.uint64(1) << (np.arange(len(values)) % 64).astype(np.uint64)
    heads = np.arange(0, len(values), 64)
    return np.stack([np.bitwise_or.reduceat(np.where(values >> np.uint64(b) & np.uint64(1), bit, np.uint64(0)), heads) for b in range(BITS)]), np.bitwise_or.reduceat(bit, heads)


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a and b; each set is labelled by its smallest member."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label[:] = jumped


def linked_in_groups(values: np.ndarray, group_starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (lower, upper) that tie all values linked within their groups; a spanning forest, not all pairs."""
    n = len(values)
    sizes = np.diff(np.append(group_starts, n))
    place = np.arange(n) - np.repeat(group_starts, sizes)
    words_of = -(-sizes // 64)
    first_word = np.cumsum(words_of) - words_of
    word = np.repeat(first_word, sizes) + place // 64
    lane = (place % 64).astype(np.uint64)
    heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    bit = np.uint64(1) << lane
    planes = np.stack([np.bitwise_or.reduceat(np.where(values >> np.uint64(b) & np.uint64(1), bit, np.uint64(0)), heads) for b in range(BITS)])
    valid = np.bitwise_or.reduceat(bit, heads)
    label = np.arange(n)
    # Each value meets the words of its group from its own on: every pair once.
    last_word = np.repeat(first_word + words_of, sizes)
    todo = last_word - word
    upto = np.cumsum(todo)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + WORDS_AT_ONCE, side="right")))
        rows = np.repeat(np.arange(start, end), todo[start:end])
        offset = np.arange(len(rows)) - np.repeat(np.cumsum(todo[start:end]) - todo[start:end], todo[start:end])
        at = word[rows] + offset
        hit, lanes = near_lanes(planes, valid, values[rows], at, radius)
        if len(hit):
            bits = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            pair, which = np.nonzero(bits)
            a, b = rows[hit[pair]], heads[at[hit[pair]]] + which
            later = b > a
            _unite(label, a[later], b[later])
        start = end
    tied = np.flatnonzero(label != np.arange(n))
    return values[label[tied]], values[tied]


def _compare(batches, radius: int):
    """Rows come sorted by (bucket, chunk pair); groups are compared once complete."""
    kept: list[tuple[np.ndarray, ...]] = []

    def columns(parts):
        return [np.concatenate(c) for c in zip(*parts, strict=True)]

    def flush(last: bool):
        nonlocal kept
        band, key, i, j, fp = columns(kept)
        change = (band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        starts = np.flatnonzero(np.r_[True, change])
        end = len(fp) if last else int(starts[-1])
        kept = [] if end == len(fp) else [tuple(c[end:] for c in (band, key, i, j, fp))]
        starts = starts[starts < end]
        if not end:
            return
        sizes = np.diff(np.append(starts, end))
        paired = np.repeat(sizes > 1, sizes)
        if not paired.any():
            return
        sizes = sizes[sizes > 1]
        low, high = linked_in_groups(fp[:end][paired].view(np.uint64), np.cumsum(sizes) - sizes, radius)
        if len(low):
            yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(high.view(np.int64))], names=["u", "v"])

    for batch in batches:
        if batch.num_rows:
            kept.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            if sum(len(p[0]) for p in kept) >= GATHERED:
                yield from flush(False)
    if kept:
        yield from flush(True)


def block_masks(n: int, radius: int) -> list[int]:
    """Bit masks of which at least one leaves two fingerprints within the radius equal.

    With radius + s blocks, s whole blocks agree: one mask for each choice of s. More blocks
    make finer buckets and more masks; the number follows the count of fingerprints.
    """
    for s in range(1, 5):
        blocks = radius + s
        bounds = [round(BITS * k / blocks) for k in range(blocks + 1)]
        if s == 4 or n <= MEAN_BUCKET << (BITS * s // blocks):
            parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:], strict=False)]
            return [sum(x) for x in combinations(parts, s)]
    raise AssertionError


def near_edges(nodes: DataFrame, radius: int = 4, fp: str = "fp") -> DataFrame:
    """Edges (u, v) between distinct fingerprints that tie all of those within the radius."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [signed(m) for m in block_masks(nodes.count(), radius)]
    bands = nodes.select(F.col(fp).alias("fp"), F.posexplode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("band", "mask")).select("band", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    big = bands.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("band", "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    parts = shuffle_parts(nodes.sparkSession)
    rows = joined(bands, big, ["band", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    rows = rows.select("band", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    rows = rows.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    order = ["band", "key", "i", "j"]
    dealt = rows.repartition(parts, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(lambda b: _compare(b, radius), "u long, v long")


def _fingerprint_rows(batches, shingle: int):
    for batch in sliced(batches):
        fp = fingerprints(batch.column(2).to_pylist(), shingle).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["id", "th", "fp"])


def least_of_components(nodes: DataFrame, tied: DataFrame) -> DataFrame:
    """fp and component_id, the smallest id of its component, of every node (fp, least)."""
    members = tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())
    reach = cut(members.join(nodes, members["node"] == nodes["fp"]).select("node", "root", "least"))
    of_root = reach.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = joined(reach, of_root, ["root"], most=BROADCAST_PAIRS).select(F.col("node").alias("fp"), "component_id")
    return nodes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest id reachable) and text_hash of every row.

    Null text counts as empty: fingerprint zero, linked like any other. Texts of fewer words
    than a shingle are one shingle. Rows that repeat stand in one component; null ids are
    never the smallest unless there is no other. An empty table gives an empty one; other
    columns are not read.
    """
    inner = docs.select(column(doc_id).alias("id"), F.xxhash64(text_of(text)).alias("th"), text_of(text).alias("text"))
    rows = cut(inner.mapInArrow(lambda b: _fingerprint_rows(b, shingle), f"id {dict(inner.dtypes)['id']}, th long, fp long"))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    tied = connected_components(near_edges(nodes, radius))
    names = least_of_components(nodes, tied)
    return joined(rows, names, ["fp"], most=BROADCAST_PAIRS).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("th").alias("text_hash"))


def without_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component with the columns of ``docs``: that of the smallest id, of equal ids one."""
    return one_of_each(docs, near_duplicates(docs, text, doc_id, shingle, radius), text, doc_id)


def one_of_each(docs: DataFrame, found: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows of ``docs`` that stand for the components of ``found`` (doc_id, component_id, text_hash)."""
    stays = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("text_hash").alias("th"))).alias("b")).select("b.*")
    # A null id is held apart by a column of its own; the join is by plain equality.
    keys = {"_pl_n": F.col("n"), "_pl_id": F.coalesce(F.col("id").cast("string"), F.lit("")), "_pl_th": F.col("th")}
    stays = stays.select(*(c.alias(k) for k, c in keys.items()))
    tagged = docs.withColumns({"_pl_n": column(doc_id).isNull(), "_pl_id": F.coalesce(column(doc_id).cast("string"), F.lit("")), "_pl_th": F.xxhash64(text_of(text))})
    rows = tagged.join(stays, list(keys), "left_semi")
    one = rows.groupBy(*keys).agg(F.first(F.struct(*map(column, docs.columns))).alias("_pl_row"))
    return one.select(*(F.col("_pl_row")[c].alias(c) for c in docs.columns))
