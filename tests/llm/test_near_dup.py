"""SimHash fingerprints, the bit-sliced comparison and components, against plain comparison of all pairs."""

import numpy as np
import pytest

from plumbline.llm import components as components_module
from plumbline.llm import queries, simhash
from plumbline.llm.components import connected_components

from ..conftest import SMALL
from .cases import components, fingerprint, frame, rows


def test_edge_rows(spark):
    got = simhash.near_duplicates(frame(spark)).collect()
    prints = [fingerprint(r[1]) for r in rows()]
    want = components([r[0] for r in rows()], prints)
    assert sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in got) == sorted((str(r[0]), f"{p:016x}", str(c)) for r, p, c in zip(rows(), prints, want, strict=True))


def test_whole_table(spark):
    got = queries.op7_simhash(spark, SMALL).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    prints = [fingerprint(t) for t in docs["text"]]
    assert list(got["fingerprint"]) == [f"{p:016x}" for p in prints]
    assert list(got["component_id"]) == components(docs["doc_id"].tolist(), prints)


def test_one_row_of_each_component_stays(spark):
    docs = frame(spark)
    out = simhash.without_near_duplicates(docs)
    want = components([r[0] for r in rows()], [fingerprint(r[1]) for r in rows()])
    assert out.columns == docs.columns and out.count() == len(set(want))
    assert {x.doc_id for x in out.collect()} == set(want)
    assert simhash.without_near_duplicates(frame(spark, [])).count() == simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_lanes_equal_counted_bits(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = np.concatenate([base, *(base ^ (np.uint64(1) << np.uint64(k)) ^ (np.uint64(1) << np.uint64(3 * k + 1)) for k in range(1, 6))])
    values = np.unique(values)
    low, high = simhash.linked_in_groups(values, np.array([0]), radius)
    ids = list(range(len(values)))
    want = components(ids, [int(v) for v in values], radius)
    label = {int(v): k for k, v in enumerate(values)}
    for a, b in zip(low, high, strict=True):
        assert want[label[int(a)]] == want[label[int(b)]]
    assert len(high) == len(values) - len(set(want))


@pytest.mark.parametrize("n", [10, 10**5, 10**7, 10**9, 10**12])
def test_masks_miss_no_pair(n):
    masks = simhash.block_masks(n, 4)
    rng = np.random.default_rng(1)
    for _ in range(300):
        bits = rng.choice(64, 4, replace=False)
        flip = sum(1 << int(b) for b in bits)
        assert any(not flip & m for m in masks)


def test_big_buckets_are_cut_into_pairs_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = np.random.default_rng(2)
    # One dense group: all share their upper bits, and a chain of single bits ties some of them.
    values = sorted({int(v) for v in rng.integers(0, 2**20, 150)} | {1 << k for k in range(18)})
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.near_edges(nodes)).collect()}
    want = components(values, values)
    assert [roots.get(v, v) for v in values] == want


def test_hubs_are_joined_by_broadcast_beyond_the_bound(spark, monkeypatch):
    for module in (simhash, components_module):
        monkeypatch.setattr(module, "BROADCAST_PAIRS", 2)
    docs = frame(spark, [(k, f"text {k if k % 3 else 0} of some words that are not many", "en", "a", 1) for k in range(90)])
    got = simhash.near_duplicates(docs).collect()
    want = components([x.doc_id for x in docs.collect()], [fingerprint(x.text) for x in docs.collect()])
    assert sorted((x.doc_id, x.component_id) for x in got) == sorted(zip([x.doc_id for x in docs.collect()], want, strict=True))
    test_components_of_chains_and_stars(spark)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5000, 5000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(1, 201)) and all(got[1000 + k] == 1000 for k in range(1, 50)) and 5000 not in got
