"""The near stage of the pipeline against all pairs of shingle sets."""

import corpus_pipeline
import numpy as np

from plumbline.llm import components, shingle_sets, simhash

from .cases import frame


def near_texts(changes: int, copies: int = 6, words: int = 300, seed: int = 3) -> list[str]:
    """Random texts; each base comes with copies in which so many single words are others."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(20):
        base = [f"w{k}" for k in rng.integers(0, 5000, words)]
        for _ in range(copies):
            text = list(base)
            for k in rng.choice(words, changes, replace=False):
                text[k] = f"x{rng.integers(0, 10**9)}"
            out.append(" ".join(text))
    return out


def least_ids(texts: list[str], similarity: float = 0.8) -> list[int]:
    sets = [set(shingle_sets.shingle_set(t, 5).tolist()) for t in texts]
    least = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= similarity * len(a | b):
                x, y = sorted((least[i], least[j]))
                least = [x if k == y else k for k in least]
    return least


def test_near_stage_leaves_one_of_each_component(spark):
    # Three changed words on each side: similarity around 0.82, eight bits or so between the fingerprints.
    texts = near_texts(3) + near_texts(20, seed=4)
    want = least_ids(texts)
    assert 20 < len(set(want)) < 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns and {x.doc_id for x in out.collect()} == set(want)


def test_radius_loses_no_link_between_similar_sets():
    rng = np.random.default_rng(9)
    farthest = 0
    for n in (4, 5, 9, 10, 20, 50, 300, 2000):
        for _ in range(300):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            # The largest change that leaves a Jaccard similarity of 0.8.
            k = int(n / 9) if n >= 9 else 0
            b = np.concatenate([a[k:], rng.integers(0, 2**63, k if n >= 9 else 1, dtype=np.uint64)])
            assert n - k >= 0.8 * len(np.union1d(a, b)) - 1e-9
            farthest = max(farthest, int(simhash.fingerprint_of_hashes(a) ^ simhash.fingerprint_of_hashes(b)).bit_count())
    assert farthest <= shingle_sets.RADIUS - 2


def test_links_equal_all_pairs():
    texts = near_texts(3) + near_texts(12, copies=4, seed=5) + near_texts(250, copies=2, seed=6)
    sets = [shingle_sets.shingle_set(t, 5) for t in texts]
    prints = np.array([simhash.fingerprint_of_hashes(s) for s in sets])
    few = 50
    small = shingle_sets.near_in_words([prints[:few], prints[few:90]])
    for sets_, near_of, texts_ in ((sets, shingle_sets.near_in_planes(prints), texts), (sets[:few], shingle_sets.near_in_planes(prints[:few]), texts[:few]), (sets[:few], small[0], texts[:few]), (sets[few:90], small[1], texts[few:90])):
        least = list(range(len(sets_)))
        for a, b in shingle_sets.links(sets_, 0.8, near_of):
            x, y = sorted((least[a], least[b]))
            least = [x if k == y else k for k in least]
        assert least == least_ids(texts_)


def test_large_groups_are_cut_into_pairs_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(shingle_sets, "CHUNK", 2)
    monkeypatch.setattr(shingle_sets, "HELD", 500)
    texts = near_texts(2)
    got = shingle_sets.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [x.component_id for x in sorted(got, key=lambda x: x.doc_id)] == least_ids(texts)


def test_texts_are_read_again_by_a_shuffle_if_there_are_many(spark, monkeypatch):
    for module in (shingle_sets, components, simhash):
        monkeypatch.setattr(module, "BROADCAST_PAIRS", 3)
    texts = near_texts(2) + ["one text of many copies that are all the same"] * 60
    got = shingle_sets.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [x.component_id for x in sorted(got, key=lambda x: x.doc_id)] == least_ids(texts)


def test_odd_rows(spark):
    rows = [(1, None), (2, " \n"), (3, "two words"), (4, "Two  WORDS"), (5, "two word"), (None, "two words"), (7, "w " * 30_000)]
    got = shingle_sets.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.component_id) for x in got) == [(0, 3), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (7, 7)]
    assert shingle_sets.without_near_copies(frame(spark, [])).count() == 0
