"""Nearest vectors by cosine through a hierarchical k-means tree.

A tree of centroids is fitted on a bounded sample. Every different vector goes down it to one
leaf. A query walks the tree best bin first: a priority queue holds the nodes seen so far by the
distance of their centroids, and leaves are visited in the order in which they leave the queue.
How many leaves is learned: for some queries the true neighbours are found by comparison with all
vectors, and visits are widened until the leaves visited hold the asked share of them.

Leaves next to each other in the tree form a shard. Vectors and queries meet by shard in a
shuffle, in blocks of bounded size on both sides; a query goes once to each shard it visits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import column, cut, joined, sampled, sliced
from plumbline.llm.vectors import finite_vector, matrix

#: Children of a node, rounds of k-means, and rows of the table that a leaf should hold.
BRANCHES, ROUNDS, LEAF_ROWS = 16, 8, 256
#: Numbers in the sample that the tree is fitted on (rows times components), and sampled rows under which a node is not split.
SAMPLE_VALUES, LEAST_SAMPLED = 4_000_000, 2 * BRANCHES
#: Queries whose true neighbours are looked up, and the share of these that the visited leaves must hold.
CALIBRATION_QUERIES, RECALL = 256, 0.95
#: Vectors and queries of a shard that meet in one task at most, in expectation.
BLOCK = 4096
#: Vectors and queries, and pairs of both, that Python code works on at once.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 512, 1 << 16
#: Scores this near to the last one that counts are computed again, each by itself. Below any cosine.
NEAR, NOT_VISITED = 1e-9, -3.0


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    scaled = _near_one(vectors)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points * points).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(axis=1)


def k_means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centres that have points, and the centre of each point."""
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        label = _squared(points, centres).argmin(axis=1)
        used, label = np.unique(label, return_inverse=True)
        sums = np.zeros((len(used), points.shape[1]))
        np.add.at(sums, label, points)
        centres = sums / np.bincount(label)[:, None]
    return centres, _squared(points, centres).argmin(axis=1)


@dataclass
class Tree:
    """Nodes in the order they were made; a node's children stand together. ``rows`` is known once vectors are placed."""

    centres: np.ndarray
    first: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    rows: dict[int, int] = field(default_factory=dict)

    def leaves_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point, going to the nearest child from the root on."""
        out = np.zeros(len(points), dtype=np.int64)
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, members = stack.pop()
            if not self.count[node]:
                out[members] = node
                continue
            children = slice(self.first[node], self.first[node] + self.count[node])
            child = _squared(points[members], self.centres[children]).argmin(axis=1)
            order = np.argsort(child, kind="stable")
            edges = np.flatnonzero(np.diff(child[order])) + 1
            stack += [(self.first[node] + int(child[part[0]]), members[part]) for part in np.split(order, edges) if len(part)]
        return out

    def visits(self, point: np.ndarray) -> Iterator[int]:
        """Leaves that hold vectors, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.count[node]:
                children = slice(self.first[node], self.first[node] + self.count[node])
                apart = self.centres[children] - point
                for k, d in enumerate((apart * apart).sum(axis=1).tolist()):
                    heapq.heappush(queue, (d, self.first[node] + k))
            elif node in self.rows:
                yield node

    def visited(self, point: np.ndarray, leaves: int, vectors: int) -> list[int]:
        """The first ``leaves`` leaves, and as many more as hold ``vectors`` vectors together."""
        out, held = [], 0
        for leaf in self.visits(point):
            if len(out) >= leaves and held >= vectors:
                break
            out.append(leaf)
            held += self.rows[leaf]
        return out

    def shards(self, most: int) -> dict[int, int]:
        """The shard of each leaf with vectors: its highest node under which there are up to ``most``, or the leaf itself."""
        under = [0] * len(self.first)
        for node in reversed(range(len(self.first))):  # children come after their parent
            under[node] = sum(under[self.first[node] : self.first[node] + self.count[node]]) if self.count[node] else self.rows.get(node, 0)
        out, stack = {}, [(0, None)]
        while stack:
            node, shard = stack.pop()
            shard = node if shard is None and (under[node] <= most or not self.count[node]) else shard
            if self.count[node]:
                stack += [(self.first[node] + k, shard) for k in range(self.count[node])]
            elif node in self.rows:
                out[node] = shard
        return out


def fit_tree(points: np.ndarray, width: int, table_rows: int, seed: int = 0, leaf_rows: int = LEAF_ROWS) -> Tree:
    """A tree whose leaves stand for ``leaf_rows`` of ``table_rows`` rows each, as far as the sampled points tell them apart."""
    tree = Tree(np.zeros((1, width)), [0], [0])
    centres, todo = [tree.centres], [(0, np.arange(len(points)))]
    rng = np.random.default_rng(seed)
    nodes = 1
    while todo:
        node, members = todo.pop()
        if len(members) < LEAST_SAMPLED or len(members) * table_rows <= leaf_rows * len(points):
            continue
        found, label = k_means(points[members], BRANCHES, rng)
        if len(found) < 2:
            continue
        tree.first[node], tree.count[node] = nodes, len(found)
        centres.append(found)
        tree.first += [0] * len(found)
        tree.count += [0] * len(found)
        todo += [(nodes + k, members[label == k]) for k in range(len(found))]
        nodes += len(found)
    tree.centres = np.concatenate(centres)
    return tree


def _near_one(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component is about one; digits stay as they are."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows with rows; each pair's value does not depend on the pairs beside it."""
    a, b = _near_one(a), _near_one(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def best_pairs(queries: np.ndarray, vectors: np.ndarray, least_id: np.ndarray, k: int, visited: np.ndarray | None = None, leaf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, cosine) of the ``k`` nearest vectors of each query, ties to the smaller id; sorted.

    Products of matrices choose, with all that come near the last place; these are computed again one by one.
    ``visited`` tells for each query which leaves it visits, ``leaf`` the leaf of each vector; without them every vector counts.
    """
    unit = _unit(vectors)
    at, near = [], []
    for a in range(0, len(queries), ROWS_AT_ONCE):
        score = _unit(queries[a : a + ROWS_AT_ONCE]) @ unit.T
        if visited is not None:
            score[~visited[a : a + ROWS_AT_ONCE][:, leaf]] = NOT_VISITED
        least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), NOT_VISITED)
        q, v = np.nonzero((score >= least[:, None] - NEAR) & (score > NOT_VISITED))
        at.append(q + a)
        near.append(v)
    q, v = np.concatenate(at), np.concatenate(near)
    exact = np.concatenate([cosines(queries[q[a : a + PAIRS_AT_ONCE]], vectors[v[a : a + PAIRS_AT_ONCE]]) for a in range(0, len(q), PAIRS_AT_ONCE)] or [np.zeros(0)])
    order = np.lexsort((least_id[v], -exact, q))
    q, v, exact = q[order], v[order], exact[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], v[place < k], exact[place < k]


# --- as Spark jobs ------------------------------------------------------------------------

LAST_ID = np.iinfo(np.int64).max
FOUND = "qa long, qb long, vec_id long, score double, va long, vb long"


def _keyed(df: DataFrame) -> DataFrame:
    """(vec_id, v, a, b) of the rows that take part; (a, b) is a 128-bit digest of the vector."""
    v = column("embedding")
    valid = df.where(finite_vector("embedding")).where(F.exists(v, lambda x: x != 0))
    return valid.select(column("vec_id").cast("long").alias("vec_id"), v.alias("v")).select("*", F.xxhash64(F.lit(1), "v").alias("a"), F.xxhash64(F.lit(2), "v").alias("b"))


def _classes(rows: DataFrame, ids: int) -> DataFrame:
    """A row for each different vector with its ``ids`` smallest ids, null last.

    Ranks leave what is beyond before the shuffle, so a vector with very many rows is nowhere held whole.
    """
    order = Window.partitionBy("a", "b").orderBy(F.asc_nulls_last("vec_id"))
    few = rows.withColumn("_r", F.dense_rank().over(order)).where(F.col("_r") <= ids)
    each = few.groupBy("a", "b").agg(F.first("v").alias("v"), F.sort_array(F.collect_set(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id"))).alias("_ids"))
    return each.select("a", "b", "v", F.transform("_ids", lambda x: x["vec_id"]).alias("ids"))


def _placed(classes: DataFrame, tree: Tree, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BLOCK):
            leaf = tree.leaves_of(_unit(matrix(batch["v"], width))) if batch.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    kind = dict(classes.dtypes)
    return classes.mapInArrow(run, ", ".join(f"{c} {kind[c]}" for c in classes.columns) + ", leaf long")


def _ids_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of vectors laid end to end, with the last number for null, the vector of each, and each vector's first."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().fill_null(LAST_ID).to_numpy(zero_copy_only=False)
    return flat, np.cumsum(size) - size, size


def _visited(queries: pa.Table, held: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which of the leaves at hand each query visits, and the leaf of each vector by its place among them."""
    leaves, leaf = np.unique(held["leaf"].to_numpy(), return_inverse=True)
    lists = queries["leaves"].combine_chunks()
    went = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    place = np.minimum(np.searchsorted(leaves, went), len(leaves) - 1)
    here = leaves[place] == went
    out = np.zeros((len(lists), len(leaves)), dtype=bool)
    out[row[here], place[here]] = True
    return out, leaf


def _nearest(queries: pa.Table, held: pa.Table, width: int, k: int, visits: bool) -> pa.Table:
    """The ``k`` nearest rows of ``held`` for each query, of all leaves or of those it visits: (qa, qb, vec_id, score, va, vb)."""
    if not queries.num_rows or not held.num_rows:
        return pa.table({c: pa.array([], kind) for c, kind in zip(("qa", "qb", "vec_id", "score", "va", "vb"), (pa.int64(),) * 3 + (pa.float64(),) + (pa.int64(),) * 2, strict=True)})
    flat, start, size = _ids_of(held["ids"].combine_chunks())
    q, v, score = best_pairs(matrix(queries["v"], width), matrix(held["v"], width), flat[start], k, *(_visited(queries, held) if visits else ()))
    # A vector stands for up to k rows; of all rows of a query's vectors the first k stay.
    row = np.repeat(np.arange(len(q)), size[v])
    ids = flat[np.repeat(start[v], size[v]) + np.arange(len(row)) - np.repeat(np.cumsum(size[v]) - size[v], size[v])]
    order = np.lexsort((ids, -score[row], q[row]))
    row, ids = row[order], ids[order]
    keep = np.arange(len(row)) - np.searchsorted(q[row], q[row]) < k
    row, ids = row[keep], ids[keep]
    columns = [queries[c].take(pa.array(q[row])) for c in ("a", "b")] + [pa.array(ids, mask=ids == LAST_ID), pa.array(score[row])] + [held[c].take(pa.array(v[row])) for c in ("a", "b")]
    return pa.table(dict(zip(("qa", "qb", "vec_id", "score", "va", "vb"), columns, strict=True)))


def calibrated_visits(placed: DataFrame, asked: DataFrame, tree: Tree, width: int, k: int, recall: float = RECALL) -> int:
    """Leaves to visit so that some of the queries find ``recall`` of their true ``k`` nearest, by comparison with all vectors.

    The queries are a bounded sample, broadcast; a batch of vectors gives at most ``k`` rows for each.
    """
    some = sampled(asked, F.struct("a", "b"), CALIBRATION_QUERIES, seed=12).select("a", "b", "v").toArrow()
    if not some.num_rows:
        return 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BLOCK):
            yield from _nearest(some, pa.Table.from_batches([batch]), width, k, visits=False).to_batches()

    found = placed.select("a", "b", "v", "ids").mapInArrow(run, FOUND)
    best = _top(found, k).where("not (qa = va and qb = vb)").select("qa", "qb", "va", "vb").distinct()
    truth = best.join(placed.select(F.col("a").alias("va"), F.col("b").alias("vb"), "leaf"), ["va", "vb"]).groupBy("qa", "qb").agg(F.collect_list("leaf").alias("leaves")).collect()
    points = dict(zip(zip(some["a"].to_pylist(), some["b"].to_pylist(), strict=True), _unit(matrix(some["v"], width)), strict=True))
    needed = []
    for row in truth:
        order = {leaf: n for n, leaf in enumerate(tree.visits(points[row["qa"], row["qb"]]), 1)}
        needed += [order[leaf] for leaf in row["leaves"]]
    return int(np.quantile(needed, recall, method="higher")) if needed else 1


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qa", "qb").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "va", "vb")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)


def _visits(asked: DataFrame, tree: Tree, shards: dict[int, int], width: int, leaves: int, k: int) -> DataFrame:
    """(a, b, v, shard, leaves): a row for each query and shard it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS_AT_ONCE):
            rows, went = [], []
            for row, point in enumerate(_unit(matrix(batch["v"], width)) if batch.num_rows else ()):
                parts: dict[int, list[int]] = {}
                for leaf in tree.visited(point, leaves, k):
                    parts.setdefault(shards[leaf], []).append(leaf)
                rows += [row] * len(parts)
                went += parts.items()
            own = [batch[c].take(pa.array(rows, pa.int64())) for c in ("a", "b", "v")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([s for s, _ in went], pa.int64()), pa.array([x for _, x in went], pa.list_(pa.int64()))], ["a", "b", "v", "shard", "leaves"])

    kind = dict(asked.dtypes)["v"]
    return asked.select("a", "b", "v").mapInArrow(run, f"a long, b long, v {kind}, shard long, leaves array<long>")


def _parts(n: int) -> int:
    return max(1, -(-n // BLOCK))


def nearest_by_shard(placed: DataFrame, visits: DataFrame, tree: Tree, shards: dict[int, int], width: int, k: int) -> DataFrame:
    """(qa, qb, vec_id, score, va, vb): for each query and block of a visited shard the ``k`` nearest rows.

    Both sides of a shard are cut into blocks by their digests, and each block of one meets each
    of the other, so a task holds a block of each however many vectors or queries a shard has.
    What is broadcast has a row for each leaf of the tree, whose size the fit bounds.
    """
    asked = {r["shard"]: r["n"] for r in visits.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    rows: dict[int, int] = {}
    for leaf, shard in shards.items():
        rows[shard] = rows.get(shard, 0) + tree.rows[leaf]
    session = placed.sparkSession
    table = session.createDataFrame([(leaf, s, _parts(rows[s]), _parts(asked.get(s, 0))) for leaf, s in shards.items()], "leaf long, shard long, vblocks int, qblocks int")
    block = lambda n: F.pmod("b", F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = placed.join(F.broadcast(table), "leaf").select("a", "b", "v", "ids", "leaf", "shard", block("vblocks").alias("vblock"), every("qblocks").alias("qblock"))
    come = visits.join(F.broadcast(table.drop("leaf").distinct()), "shard").select("a", "b", "v", "leaves", "shard", block("qblocks").alias("qblock"), every("vblocks").alias("vblock"))
    keys = ["shard", "vblock", "qblock"]
    return come.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(lambda q, v: _nearest(q, v, width, k, visits=True), FOUND)


def nearest_vectors(df: DataFrame, every: int, k: int, recall: float = RECALL, leaf_rows: int = LEAF_ROWS, seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows nearest by cosine to each row whose vec_id is divisible by ``every``.

    Vectors that are null, zero or hold null or non-finite components take no part, as query or
    as candidate; a shorter vector goes on with zeros. Rows with one vec_id and one vector are one
    row; rows that share a vec_id only are different rows, and each query leaves out itself alone.
    A null vec_id is a candidate, last in ties, and no query. Equal vectors are one entry of the
    index with their k + 1 smallest ids, which is all that any query can return of them; a query's
    vector is looked up once however many rows have it. Fewer than ``k`` candidates give all of
    them, an empty table gives no rows. Columns beside ``vec_id`` and ``embedding`` are not read.
    """
    rows = _keyed(df)
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = about["n"], about["width"] or 0
    some = sampled(rows, F.struct("a", "b"), SAMPLE_VALUES // max(width, 1), seed).dropDuplicates(["a", "b"]).select("a", "b", "v").toArrow().sort_by([("a", "ascending"), ("b", "ascending")])
    points = _unit(matrix(some["v"], width)) if some.num_rows else np.zeros((0, width))
    tree = fit_tree(points, width, n, seed, leaf_rows)
    placed = cut(_placed(_classes(rows, k + 1), tree, width))
    tree.rows = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    own = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = cut(own.dropDuplicates(["a", "b"]).select("a", "b", "v"))
    leaves = calibrated_visits(placed, asked, tree, width, k + 1, recall)
    shards = tree.shards(BLOCK)
    visits = cut(_visits(asked, tree, shards, width, leaves, k + 1))
    best = _top(nearest_by_shard(placed, visits, tree, shards, width, k + 1), k + 1)
    lists = best.groupBy("qa", "qb").agg(F.sort_array(F.collect_list(F.struct("_r", "vec_id", "score", "va", "vb"))).alias("found")).withColumnsRenamed({"qa": "a", "qb": "b"})
    queries = cut(own.select("vec_id", "a", "b").distinct())
    with_lists = joined(queries, lists, ["a", "b"]).select(F.col("vec_id").alias("query_id"), "a", "b", "found")
    others = with_lists.select("query_id", F.expr(f"slice(filter(found, x -> not (x.vec_id <=> query_id and x.va = a and x.vb = b)), 1, {int(k)})").alias("found"))
    out = others.select("query_id", F.posexplode("found").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
