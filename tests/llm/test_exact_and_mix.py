"""Exact deduplication and mixing: SQL, edge rows and a second batch."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, mixing, queries

from ..compare import assert_same, database
from ..conftest import SMALL
from .cases import SPACE, frame, rows, sha


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL).toPandas(), database(SMALL).execute(queries.ORACLE_SQL[name]).df())


def test_decisions_on_edge_rows(spark):
    got = exact_dedup.decide(frame(spark)).collect()
    groups = {}
    for i, text, *_ in rows():
        groups.setdefault(SPACE.sub("", text or ""), []).append((-len(text or ""), i is None, i))
    best = {sha(k): (min(v, key=lambda x: (x[0], x[1], x[2] or 0)), len(v)) for k, v in groups.items()}
    assert len(got) == len(rows())
    for x in got:
        (_, _, keep), size = best[x.text_sha256]
        assert (x.keep_id, x.group_size) == (keep, size)
    assert {x.doc_id for x in got if x.kept and x.keep_id == 2} == {2}
    assert {x.doc_id for x in got if x.text_sha256 == sha("")} == {3, 4, 5, None} and [x.doc_id for x in got if x.kept and x.text_sha256 == sha("")] == [5]


def test_one_row_stays_with_its_columns(spark):
    docs = frame(spark)
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len({SPACE.sub("", r[1] or "") for r in rows()})
    assert out.where("doc_id = 2").count() == 1 and out.where("doc_id is null").count() == 1
    assert out.where("score <> 'mine' or kept <> 7").count() == 0


def test_index_persists_and_appends(spark):
    index = exact_dedup.DigestIndex(spark)
    first, second = frame(spark, rows()[:4]), frame(spark, [(50, "Hello world, this is the first text of all.", None, None, 1), (51, "new", None, None, 1), (52, "n e w", None, None, 1)])
    assert exact_dedup.decide(first, index).where("kept").count() == 3  # the row that repeats is kept twice
    got = {x.doc_id: (x.keep_id, x.kept) for x in exact_dedup.decide(second, index).collect()}
    assert got == {50: (2, False), 51: (52, False), 52: (52, True)}
    assert index.files().count() == 3
    assert "Bucketed: true" in index.table()._jdf.queryExecution().toString() or spark.sql(f"DESCRIBE EXTENDED {index.name}").where("col_name = 'Bucket Columns'").first().data_type == "[`digest`]"


def test_index_is_opened_again(spark):
    made = exact_dedup.DigestIndex(spark, buckets=4)
    exact_dedup.decide(frame(spark, [(1, "one text", None, None, 1)]), made).count()
    spark.sql(f"DROP TABLE {made.name}")  # as a later session does not know it; its files stay
    again = exact_dedup.DigestIndex(spark, buckets=4, path=made.path)
    got = {x.doc_id: (x.keep_id, x.kept) for x in exact_dedup.decide(frame(spark, [(2, "onetext", None, None, 1), (3, "other", None, None, 1)]), again).collect()}
    assert got == {2: (1, False), 3: (3, True)} and again.table().count() == 2
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path=made.path)


def test_batches_equal_one_run_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    whole = {x.doc_id: x for x in queries.op3_exact_dedup(spark, SMALL).collect()}
    index = exact_dedup.DigestIndex(spark)
    part = F.pmod(F.xxhash64(exact_dedup.digest_of("text")), F.lit(3))
    for k in range(3):  # equal texts come in one batch, so each keeps its group
        for x in exact_dedup.decide(docs.where(part == k), index).collect():
            assert x == whole[x.doc_id]
    again = exact_dedup.decide(docs, index).collect()
    assert len(again) == len(whole) and not any(x.kept for x in again)
    assert all((x.keep_id, x.group_size) == (whole[x.doc_id].keep_id, whole[x.doc_id].group_size) for x in again)
    assert index.table().count() == len({x.text_sha256 for x in whole.values()})
    index.drop()
    assert not spark.catalog.tableExists(index.name)


def above_the_index(spark, index, docs, monkeypatch):
    """The plan's lines between the index and the merge join, from a batch run against it."""
    plans = []
    real = exact_dedup.cut

    def kept_plan(df):
        plans.append(df._jdf.queryExecution().executedPlan())
        return real(df)

    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "cut", kept_plan)
        exact_dedup.decide(docs, index)
    text = plans[-1].toString().split("== Initial Plan ==")[0]
    assert text.count("SortMergeJoin") == 1 and text.count(index.name) == 1 and "Bucketed: true" in text
    depth = lambda line: len(line) - len(line.lstrip(" :|+-"))
    lines = re.sub(r"\*\(\d+\) ", "", text).split("\n")
    at = next(k for k, line in enumerate(lines) if index.name in line)
    above, d = [], depth(lines[at])
    for other in reversed(lines[:at]):
        if depth(other) < d:
            above.append(other)
            d = depth(other)
    return above[: next(j for j, x in enumerate(above) if "SortMergeJoin" in x)]


def test_the_index_is_not_shuffled_and_once_compacted_not_sorted(spark, monkeypatch):
    index = exact_dedup.DigestIndex(spark)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for k in range(2):
        exact_dedup.decide(docs.where(f"doc_id % 4 = {k}"), index)
    sizes = index.table().count()
    above = above_the_index(spark, index, docs.where("doc_id % 4 = 2"), monkeypatch)
    assert any("Sort" in x for x in above) and not any("Exchange" in x or "Shuffle" in x for x in above)
    assert index.table().count() > sizes
    before = index.table().toPandas().sort_values("digest", ignore_index=True)
    index.compact()
    assert len(index.table().inputFiles()) == index.buckets
    assert index.table().toPandas().sort_values("digest", ignore_index=True).equals(before)
    above = above_the_index(spark, index, docs, monkeypatch)
    assert not any("Sort" in x or "Exchange" in x or "Shuffle" in x for x in above)
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"


@pytest.mark.parametrize("landed", [0.0, 0.4, 1.0])
def test_a_batch_that_is_run_again_gets_the_same_answers(spark, landed):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    earlier, later = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")
    want, index = exact_dedup.DigestIndex(spark), exact_dedup.DigestIndex(spark)
    for used in (want, index):
        exact_dedup.decide(earlier, used, batch="monday")
    answers = sorted(map(tuple, exact_dedup.decide(later, want, batch="tuesday").collect()))
    assert any(x[3] for x in answers) and want.table().count() > index.table().count()
    # A run that failed after a part of its digests, or all, had been written.
    index._append(want.table().where("batch = 'tuesday'").where(F.pmod(F.xxhash64("digest"), F.lit(1000)) < int(1000 * landed)))
    for _ in range(2):
        assert sorted(map(tuple, exact_dedup.decide(later, index, batch="tuesday").collect())) == answers
    assert index.table().count() == want.table().count() == index.table().select("digest").distinct().count()
    assert not any(x.kept for x in exact_dedup.decide(later, index, batch="wednesday").collect())


def test_an_unfinished_compaction_is_not_opened(spark):
    index = exact_dedup.DigestIndex(spark, buckets=2, most_files=2)
    for k in range(5):
        exact_dedup.decide(frame(spark, [(k * 100 + j, f"text {k} {j}", None, None, 1) for j in range(20)]), index)
    assert index.generation >= 1 and index.files().count() == index.table().count() == 100
    index.table().limit(3).write.parquet(index._folder(index.generation + 1))
    exact_dedup.remove(spark, f"{index._folder(index.generation + 1)}/_SUCCESS")
    again = exact_dedup.DigestIndex(spark, buckets=2, path=index.path)
    assert again.generation == index.generation and again.table().count() == 100
    again.compact()
    assert again.table().count() == 100 and exact_dedup.DigestIndex(spark, buckets=2, path=index.path).generation == again.generation
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, buckets=2, path=f"{index.path}/none")


def test_a_third_of_all_rows_of_one_text(spark):
    some = [(k, "" if k % 3 else f"text {k // 2}", "en", "a", 1) for k in range(900)]
    got = exact_dedup.decide(frame(spark, some)).collect()
    assert len(got) == 900 and sum(x.kept for x in got) == len({t for _, t, *_ in some})
    assert {(x.keep_id, x.group_size) for x in got if x.doc_id % 3} == {(1, 600)}


def test_no_table_or_file_is_left(spark):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.decide(frame(spark)).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.decide(none).count() == exact_dedup.deduplicated(none).count() == mixing.mixed(none).count() == 0


def copies(u, rate):
    """The Poisson quantile, by summing."""
    k, log_p, c = 0, -rate, math.exp(-rate)
    while c <= u and k < rate + 12 * math.sqrt(rate) + 20:
        k += 1
        log_p += math.log(rate / k)
        c += math.exp(log_p)
    return k


def test_mixing_counts_by_hand(spark):
    docs = frame(spark)
    masses, n = {}, {}
    for _, text, _, source, _ in rows():
        masses[source] = masses.get(source, 0) + len(text or "")
        n[source] = n.get(source, 0) + 1
    total, shares = sum(masses.values()), {s: math.sqrt(k) for s, k in n.items()}
    rate = {s: total * shares[s] / sum(shares.values()) / m if m else 1.0 for s, m in masses.items()}
    want = {}
    for i, _, _, source, _ in rows():
        u = int(hashlib.md5(f"mix-1|{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        want[i, source] = want.get((i, source), 0) + copies(u, rate[source])
    out = mixing.mixed(docs)
    got = {(x.doc_id, x.source): x["count"] for x in out.groupBy("doc_id", "source").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert out.columns == [*(c for c in docs.columns if c != "copy_no"), "copy_no", "mix_key"]
    assert out.where("copy_no < 1").count() == 0


def test_weights_reach_their_share(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"), F.lit("0123456789").alias("text"))
    got = {r.source: r.n for r in mixing.mixed(docs, weights={"x": 3, "y": 1}, epochs=2.0).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert got["x"] == pytest.approx(9000, rel=0.05) and got["y"] == pytest.approx(3000, rel=0.05)
    assert mixing.mixed(docs, weights={"x": 1}).where("source = 'y'").count() == 0


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "a text", "x"), (2, "other", None)], "`doc.id` long, `the.text` string, `from.where` string")
    out = mixing.mixed(docs, source="from.where", text="the.text", doc_id="doc.id", epochs=3.0)
    plain = mixing.mixed(docs.toDF("doc_id", "text", "source"), epochs=3.0)
    assert out.columns == [*docs.columns, "copy_no", "mix_key"] and sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, map(tuple, plain.collect())))


def test_native_plans(spark):
    for name in ("op3_exact_dedup", "op4_mix_sources"):
        plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
        assert "Python" not in plan and "MapInArrow" not in plan
