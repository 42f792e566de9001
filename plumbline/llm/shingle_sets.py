"""Near copies of at least a given similarity: SimHash fingerprints compared in bit planes, links checked on shingle sets.

Texts whose shingle sets have a Jaccard similarity of 0.8 differ in about 10 of 64 fingerprint bits
(a share of acos(2s / (1 + s)) / pi), too many for blocks of equal bits to find: MinHash bands propose
which texts meet. Two sets of similarity s share one of BANDS bands of ROWS values with probability
1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8, and more above. Of those that meet, all whose
fingerprints are farther apart than RADIUS are abandoned; whole shingle sets decide on the rest.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_PAIRS, column, cut, joined, shuffle_parts, sliced, text_of
from plumbline.llm.components import connected_components
from plumbline.llm.simhash import BITS, bit_planes, fingerprint_of_hashes, least_of_components, near_lanes, one_of_each, shingle_hashes

BANDS, ROWS = 20, 5
#: Fingerprints farther apart than this are not compared further. At similarity 0.8 the distance is 9.7 on average with a deviation of 2.9.
RADIUS = 26
#: Shingles that a task may hold of one group; beyond them it is compared by pairs of chunks.
HELD = 4_000_000
#: Members of a group that are compared in one task; larger groups are compared by pairs of chunks.
CHUNK = 512
#: Bytes of small groups that are gathered and compared at once.
HELD_BYTES = 8_000_000
SHINGLES_AT_ONCE, EDGES_AT_ONCE = 4096, 10_000
#: One odd multiplier and one mask for each value of a signature.
_DRAWN = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
MULTIPLIERS, MASKS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def shingle_set(text: str, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(np.array(shingle_hashes(text, size), dtype="<u8"))


def band_keys(values: np.ndarray) -> np.ndarray:
    """One key for each band; without values none."""
    if not len(values):
        return np.empty(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(values), SHINGLES_AT_ONCE):
        mixed = (values[a : a + SHINGLES_AT_ONCE] ^ MASKS[:, None]) * MULTIPLIERS[:, None]
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * MULTIPLIERS[::-1, None]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], dtype="<u8").view(np.int64)


def links(sets: list[np.ndarray], similarity: float, near_of: Callable[[int, np.ndarray], list[int]]) -> list[tuple[int, int]]:
    """Pairs of places that tie all sets of at least that Jaccard similarity; a spanning forest.

    ``near_of`` gives the places near a place among those whose bits are set in words of 64. A
    set that is already tied is not compared with the others of its tree again.
    """
    n = len(sets)
    waiting = np.full(-(-n // 64), np.iinfo(np.uint64).max, dtype=np.uint64)
    if n % 64:
        waiting[-1] = (1 << n % 64) - 1

    def take(place: int) -> None:
        waiting[place // 64] &= np.uint64(~(1 << place % 64) & (1 << 64) - 1)

    out = []
    for first in range(n):
        if not int(waiting[first // 64]) >> first % 64 & 1:
            continue
        take(first)
        todo = [first]
        while todo and waiting.any():
            x = todo.pop()
            for y in near_of(x, waiting):
                shared = _shared(sets[x], sets[y])
                if shared >= similarity * (len(sets[x]) + len(sets[y]) - shared) - 1e-9:
                    take(y)
                    out.append((x, y))
                    todo.append(y)
    return out


def _places(words: np.ndarray, lanes: np.ndarray) -> list[int]:
    word, lane = np.nonzero(np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return (words[word] * 64 + lane).tolist()


def near_in_planes(prints: np.ndarray) -> Callable[[int, np.ndarray], list[int]]:
    """Places near a place of one group of any size, compared when asked for."""
    planes, _ = bit_planes(prints)
    every = np.arange(planes.shape[1])

    def near_of(x: int, waiting: np.ndarray) -> list[int]:
        return _places(*near_lanes(planes, waiting, np.full(len(every), prints[x]), every, RADIUS))

    return near_of


def near_in_words(groups: list[np.ndarray]) -> list[Callable[[int, np.ndarray], list[int]]]:
    """The same for groups of at most 64, a word of the planes for each, all compared at once."""
    sizes = np.array([len(g) for g in groups])
    word = np.repeat(np.arange(len(groups)), sizes)
    values = np.concatenate(groups)
    bit = np.uint64(1) << np.concatenate([np.arange(n) for n in sizes]).astype(np.uint64)
    heads = np.cumsum(sizes) - sizes
    planes = np.stack([np.bitwise_or.reduceat(np.where(values >> np.uint64(b) & np.uint64(1), bit, np.uint64(0)), heads) for b in range(BITS)])
    hit, lanes = near_lanes(planes, np.bitwise_or.reduceat(bit, heads), values, word, RADIUS)
    masks = np.zeros(len(values), dtype=np.uint64)
    masks[hit] = lanes
    only = np.zeros(1, dtype=np.int64)
    return [lambda x, waiting, own=masks[a : a + n]: _places(only, own[x : x + 1] & waiting) for a, n in zip(heads.tolist(), sizes.tolist(), strict=True)]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two ascending sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _key_rows(batches, shingle: int):
    for batch in sliced(batches):
        texts = batch.column(3).to_pylist()
        sets = [shingle_set(t, shingle) for t in texts]
        own = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], dtype="<u8").view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(own), pa.array([fingerprint_of(s) for s in sets], pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))],
            names=["id", "th", "pick", "node", "fp", "size", "keys"],
        )


def fingerprint_of(values: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingle hashes, as a signed number."""
    return int(fingerprint_of_hashes(values).view(np.int64))


def _set_rows(batches, shingle: int):
    for batch in sliced(batches):
        sets = [shingle_set(t, shingle).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "hashes"])


def _compare(batches, similarity: float):
    """Rows (key, i, j, node, fp, hashes) come sorted by the first three; groups are compared once complete, many small ones at once."""
    group, nodes, prints, sets = None, [], [], []
    small: list[tuple[list[int], np.ndarray, list[np.ndarray]]] = []
    found: list[tuple[int, int]] = []
    held = 0

    def compared(own: list[int], own_sets: list[np.ndarray], near_of) -> None:
        found.extend((own[a], own[b]) for a, b in links(own_sets, similarity, near_of))

    def flush() -> None:
        nonlocal nodes, prints, sets
        values = np.array(prints, dtype=np.int64).view(np.uint64)
        if len(nodes) > 64:
            compared(nodes, sets, near_in_planes(values))
        elif len(nodes) > 1:
            small.append((nodes, values, sets))
        nodes, prints, sets = [], [], []

    def flush_small() -> None:
        nonlocal held
        if small:
            for (own, _, own_sets), near_of in zip(small, near_in_words([v for _, v, _ in small]), strict=True):
                compared(own, own_sets, near_of)
            small.clear()
        held = 0

    def batch_of() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in range(2)], names=["u", "v"])
        found.clear()
        return out

    for batch in sliced(batches):
        for key, i, j, node, fp, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, i, j) != group:
                flush()
                group = (key, i, j)
                if held > HELD_BYTES:
                    flush_small()
                if len(found) > EDGES_AT_ONCE:
                    yield batch_of()
            nodes.append(node)
            prints.append(fp)
            sets.append(np.frombuffer(raw, dtype="<u8"))
            held += len(raw) + 200
    flush()
    flush_small()
    yield batch_of()


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id (smallest id reachable) and text_hash of every row.

    Rows are linked where their sets of word shingles have at least that Jaccard similarity.
    Texts of fewer words than a shingle are one shingle; those without words are linked. Null
    text counts as empty, and null ids are never the smallest unless there is no other. An
    empty table gives an empty one; other columns are not read.
    """
    parts = shuffle_parts(docs.sparkSession)
    inner = docs.select(column(doc_id).alias("id"), F.xxhash64(text_of(text)).alias("th"), text_of(text).alias("text"))
    # One row stands for all copies when the text is read again; ``pick`` names it.
    inner = inner.select("id", "th", F.xxhash64("th", "id").alias("pick"), "text")
    rows = cut(inner.mapInArrow(lambda b: _key_rows(b, shingle), f"id {dict(inner.dtypes)['id']}, th long, pick long, node long, fp long, size long, keys array<long>"))
    nodes = cut(rows.groupBy("node").agg(F.min("id").alias("least"), F.min("pick").alias("pick"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    bands = nodes.select(F.explode("keys").alias("key"), "node")
    # What shares a band, at one or more removes, meets in one place: copies share many bands and would meet as often.
    firsts = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1").drop("n")
    near = connected_components(joined(bands, firsts, ["key"], most=BROADCAST_PAIRS).select(F.col("node").alias("u"), F.col("first").alias("v")).distinct())
    members = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    met = cut(members.join(nodes.select("node", "pick", "fp", "size"), "node").withColumnRenamed("root", "key"))
    sizes = met.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("size") / HELD)).cast("int").alias("chunks"))
    put = joined(met, sizes, ["key"], most=BROADCAST_PAIRS).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    put = put.select("key", "node", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    order = ["key", "i", "j"]
    put = put.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "fp")
    asked = met.select("pick", "node")
    if met.count() <= BROADCAST_PAIRS:
        asked = F.broadcast(asked)
    sets = inner.select("pick", "text").join(asked, "pick").select("node", "text").mapInArrow(lambda b: _set_rows(b, shingle), "node long, hashes binary").dropDuplicates(["node"])
    put = put.join(sets, "node").select(*order, "node", "fp", "hashes")
    dealt = put.repartition(parts, *order).sortWithinPartitions(*order)
    tied = connected_components(dealt.mapInArrow(lambda b: _compare(b, similarity), "u long, v long"))
    names = least_of_components(nodes.select(F.col("node").alias("fp"), "least"), tied).withColumnRenamed("fp", "node")
    return joined(rows.select("id", "th", "node"), names, ["node"], most=BROADCAST_PAIRS).select(F.col("id").alias("doc_id"), "component_id", F.col("th").alias("text_hash"))


def without_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component with the columns of ``docs``: that of the smallest id, of equal ids one."""
    return one_of_each(docs, near_copies(docs, text, doc_id, shingle, similarity), text, doc_id)
