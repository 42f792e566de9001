"""Nearest vectors and product codes, against comparison with all rows and plain whole-number arithmetic."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries, vector_codes, vector_tree
from plumbline.llm.vectors import matrix

from ..compare import assert_same, database
from ..conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, label int"
BAD = [None, [], [0.0] * 8, [float("nan")] * 8, [1.0] * 7 + [float("inf")], [1.0] * 7 + [None]]


def table(spark, rows):
    """With columns whose names clash with those that the operators use."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({"v": F.lit("mine"), "a": F.lit(1), "code": F.lit("x"), "leaf": F.lit(0), "score": F.lit(0.0), "n": F.lit(0)})


def vectors(n, seed=0, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, width)) * 3
    return [(k, [float(x) for x in (centres[k % 10] + rng.normal(size=width)).astype(np.float32)], k % 3) for k in range(n)]


def edge_rows():
    out = vectors(230)
    same = out[0][1]
    out += [(1000 + k, same, 1) for k in range(40)] + [(2000 + k, [2 * x for x in same], None) for k in range(3)]  # copies, and a multiple
    out += [out[50], out[50], (None, out[7][1], 2), (None, None, None), (100, out[3][1], 0)]  # repeated rows, null ids, an id with another vector
    out += [(50 * (100 + k), b, None) for k, b in enumerate(BAD)] + [(9000, [1e30] * 8, 0), (9050, [1e-30, *[0.0] * 6, -1e-30], 0), (9100, [1.0, 2.0, 3.0], 1)]
    return out


def good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def brute(rows, every, k):
    """{(id, vector): list of (score, id)} over distinct rows; a row leaves out itself."""
    width = max(len(v) for _, v, _ in rows if good(v))
    pad = lambda v: tuple(np.float64(np.float32(x)) for x in v) + (0.0,) * (width - len(v))
    all_ = sorted({(i, pad(v)) for i, v, _ in rows if good(v) and any(v)}, key=str)
    m = np.array([v for _, v in all_])
    m = m / np.abs(m).max(axis=1, keepdims=True)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for at, (i, v) in enumerate(all_):
        if i is not None and i % every == 0:
            s = m @ m[at]
            out[i, v] = [(s[j], all_[j][0]) for j in sorted((j for j in range(len(all_)) if j != at), key=lambda j: (-round(s[j], 9), all_[j][0] is None, all_[j][0] or 0))][:k]
    return out


@pytest.mark.parametrize("leaf_rows", [8, 10**6])
def test_edge_rows_search(spark, leaf_rows):
    rows = edge_rows()
    out = vector_tree.nearest_vectors(table(spark, rows), 50, 5, recall=1.0, leaf_rows=leaf_rows)
    assert [(c, t) for c, t in out.dtypes] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = out.toPandas()
    want = brute(rows, 50, 5)
    assert sorted(got["query_id"]) == sorted(i for (i, _), v in want.items() for _ in v)
    hits = total = 0
    for (i, _), near in want.items():
        mine = got[got["query_id"] == i]
        if sum(j == i for j, _ in want) > 1:
            continue
        mine = mine.sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        hits += len({None if np.isnan(x) else int(x) for x in mine["vec_id"]} & {x for _, x in near})
        total += len(near)
        assert np.all(np.diff(mine["score"]) <= 1e-15)
    assert hits / total == 1.0
    # A copy's neighbours are the other copies with the smallest ids.
    assert got[got["query_id"] == 1000].sort_values("rank")["vec_id"].tolist()[:5] in ([0, 1001, 1002, 1003, 1004], [0, 2000, 2001, 2002, 1001])


def test_few_rows_and_none(spark):
    assert vector_tree.nearest_vectors(table(spark, []), 50, 5).collect() == []
    assert vector_tree.nearest_vectors(table(spark, [(50, [1.0, 0.0], 0)]), 50, 5).collect() == []
    three = [(50, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [1.0, 1.0], 0)]
    got = vector_tree.nearest_vectors(table(spark, three), 50, 5).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got)] == [(50, 1, 1), (50, 2, 2)] and got[0].score == pytest.approx(0.5**0.5)


def test_recall_on_a_whole_table(spark):
    got = queries.op12_vector_tree(spark, SMALL).toPandas()
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = brute(rows, 50, 5)
    assert len(got) == 5 * len(want)
    hits = 0
    for (i, _), near in want.items():
        mine = got[got["query_id"] == i].sort_values("rank")
        hits += len(set(mine["vec_id"]) & {x for _, x in near})
    assert hits / len(got) >= 0.9


def test_many_leaves_small_blocks_and_recall(spark, monkeypatch):
    """Every shard is cut into blocks on both sides; visits are widened to the asked recall."""
    monkeypatch.setattr(vector_tree, "BLOCK", 32)
    monkeypatch.setattr(vector_tree, "CALIBRATION_QUERIES", 40)
    rows = vectors(1500, seed=3)
    for recall, least in ((0.5, 0.4), (0.98, 0.93)):
        got = vector_tree.nearest_vectors(table(spark, rows), 5, 5, recall=recall, leaf_rows=20).toPandas()
        want = brute(rows, 5, 5)
        share = np.mean([len(set(got[got["query_id"] == i]["vec_id"]) & {x for _, x in near}) / 5 for (i, _), near in want.items()])
        assert share >= least and len(got) == 5 * len(want)


def test_the_tree_walks_best_bins_first():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(3000, 6))
    tree = vector_tree.fit_tree(points, 6, 3000, leaf_rows=40)
    leaf = tree.leaves_of(points)
    tree.rows = dict(zip(*(x.tolist() for x in np.unique(leaf, return_counts=True)), strict=True))
    order = list(tree.visits(points[5]))
    assert sorted(order) == sorted(tree.rows) and order[0] == leaf[5] or leaf[5] in order[:20]
    assert len(tree.visited(points[5], 3, 1)) == 3 and sum(tree.rows[x] for x in tree.visited(points[5], 1, 500)) >= 500
    shards = tree.shards(400)
    sizes = {}
    for x, s in shards.items():
        sizes[s] = sizes.get(s, 0) + tree.rows[x]
    assert set(shards) == set(tree.rows) and max(sizes.values()) <= 400 and len(sizes) < len(shards)


# --- codes --------------------------------------------------------------------------------


def plain_codes(rows, rounds=4):
    """Whole numbers without bounds, every distance."""
    kept = [(i, v, label) for i, v, label in rows if good(v)]
    width = -(-max([len(v) for _, v, _ in kept] + [1]) // 4) * 4
    most = vector_codes.widest(width)
    whole = [[max(-most, min(most, int(np.floor(np.float64(np.float32(x)) * 1024)))) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    size = width // 4
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [float(np.float32(x)) for x in kept[k][1]]))[:256]
    books = [[whole[k][p * size : (p + 1) * size] for k in first] for p in range(4)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(w[p * size : (p + 1) * size], e, strict=True)), j) for j, e in enumerate(books[p])) for p in range(4)] for w in whole]

    for _ in range(rounds):
        at = assign()
        for p in range(4):
            for j in range(len(books[p])):
                mine = [w[p * size : (p + 1) * size] for w, a in zip(whole, at, strict=True) if a[p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    at = assign()
    error = [sum(a[p][0] for p in range(4)) for a in at]
    by_label = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{a[p][1]:02x}" for p in range(4)), e, by_label[label], digest) for (i, _, label), a, e in zip(kept, at, error, strict=True)), key=str)


def codes(df):
    return sorted((tuple(r) for r in vector_codes.compress(df).collect()), key=str)


def test_edge_rows_codes(spark):
    rows = [r for r in edge_rows() if r[0] != 9000]
    assert codes(table(spark, rows)) == plain_codes(rows)
    assert len({r[3] for r in plain_codes(rows)}) == 4


def test_huge_components_stay_at_the_widest(spark):
    rows = [*vectors(20), (9000, [1e30] * 8, 0), (9001, [-3e38] + [1.0] * 7, 7)]
    got = codes(table(spark, rows))
    assert [r[:3] for r in got] == [r[:3] for r in plain_codes(rows)] and all(r[2] >= 0 for r in got)


def test_more_than_256_rows_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 8) / 1024], k % 2) for k in range(400)]  # few different parts: ties and entries that are never used
    assert codes(table(spark, rows)) == plain_codes(rows)


def test_no_rows_of_codes(spark):
    assert codes(table(spark, [])) == [] == codes(table(spark, [(1, None, 0), (2, [float("nan")], 1)]))


def test_whole_table_of_codes_as_sql(spark):
    assert_same(queries.op13_vector_codes(spark, SMALL).toPandas(), database(SMALL).execute(queries.ORACLE_SQL["op13_vector_codes"]).df())


@pytest.mark.parametrize(("scale", "n"), [(5, 256), (5000, 256), (2**26, 256), (3, 1), (40, 17)])
def test_annuli_hold_the_nearest_entry(scale, n):
    rng = np.random.default_rng(n)
    entries, rows = rng.integers(-scale, scale + 1, (n, 5)), rng.integers(-scale, scale + 1, (700, 5))
    index, error = vector_codes.Codebook.of(entries).nearest(rows)
    exact = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    assert np.array_equal(error, exact.min(axis=1)) and np.array_equal(index, exact.argmin(axis=1))


def test_annuli_leave_entries_out(monkeypatch):
    seen = []
    plain = vector_codes._distances
    monkeypatch.setattr(vector_codes, "_distances", lambda x, e: (seen.append(len(x) * len(e)), plain(x, e))[1])
    rng = np.random.default_rng(0)
    rows = (rng.normal(size=(2000, 4)) * rng.uniform(10, 5000, (2000, 1))).astype(np.int64)
    vector_codes.Codebook.of(rows[:256]).nearest(rows)
    assert sum(seen) < 0.8 * 256 * len(rows)


def test_matrix_pads_short_vectors():
    import pyarrow as pa

    lists = pa.array([[1.0], [2.0, 3.0], []], pa.list_(pa.float32()))
    assert matrix(lists, 2).tolist() == [[1, 0], [2, 3], [0, 0]] and matrix(lists.slice(1, 1), 2).tolist() == [[2, 3]]
