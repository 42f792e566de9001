"""Shares of terms by source: against SQL on whole tables, and a plain reading of the contract on edge rows."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import divergence, queries

from ..compare import assert_same, database
from ..conftest import SMALL
from .cases import A_TO_Z, frame, rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, least, most):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in docs:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(A_TO_Z))
        groups[lang].add(source)
        counts[lang, source].update(found)
        seen[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(kept))  # noqa: B023, E731
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, last in (("pair", pairs, None), ("term", terms, most)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:last]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ordered, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("least", "most"), [(1, 50), (2, 3), (1000, 50)])
def test_edge_rows(spark, least, most):
    out = divergence.audit(frame(spark), least, most)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(out.dtypes)["rank"] == "int" and dict(out.dtypes)["value"] == "bigint"
    assert got(out) == plain(rows(), least, most)


def test_whole_table_as_sql_and_plain(spark):
    out = queries.op11_source_divergence(spark, SMALL)
    assert_same(out.toPandas(), database(SMALL).execute(queries.ORACLE_SQL["op11_source_divergence"]).df())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    assert got(out) == plain([tuple(r) for r in docs], 30, 50)


def test_no_rows(spark):
    assert got(divergence.audit(frame(spark, []))) == []


def test_a_language_without_kept_terms_has_its_pairs(spark):
    docs = frame(spark, [(k, "12 34" if k % 2 else None, "xx", s, 0) for k in range(4) for s in ("a", "b", None)])
    assert got(divergence.audit(docs)) == sorted(("xx", s, "pair", o, 0, k) for s, os in (("", "ab"), ("a", ["", "b"]), ("b", ["", "a"])) for k, o in enumerate(os, 1))


def test_shares_are_whole_numbers_beyond_a_long(spark):
    huge = spark.range(1).select(divergence.share(F.lit(10**15), F.lit(3 * 10**15), F.lit(7)).alias("p")).first()["p"]
    assert huge == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 35)


def test_a_hot_source_is_counted_before_it_is_shuffled(spark):
    """Partial counts stand below the first exchange, and ranks leave terms before theirs."""
    plan = divergence.term_counts(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2 and "cartesian" not in plan.lower() and "NestedLoop" not in plan
    dense = divergence.dense_shares(divergence.term_counts(frame(spark)))
    assert "WindowGroupLimit" in divergence.telling_terms(dense)._jdf.queryExecution().executedPlan().toString()
