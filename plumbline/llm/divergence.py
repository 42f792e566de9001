"""How far each source of a language is from the others and from the language as a whole, by its terms.

All of it is relational: terms are exploded and counted by language and source, groups are crossed
with the vocabulary of their language so that zeros are there too, pairs of groups are a join by
language and term, and ranks are windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, text_of

#: Runs of letters: A-Z, a-z and every character beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that a kept term is in, at least; what is added to every count; the unit of shares.
LEAST_DOCS, SMOOTH, UNIT = 30, 5, 1_000_000_000
#: Ranks of terms that are returned.
TOP_TERMS = 50
#: Into how many parts a language's vocabulary is cut where it meets the language's groups.
PARTS = 64
#: Stands for "no term" in rows about a whole group; a term is never empty.
NO_TERM = ""


def _count(rows: Column | str) -> Column:
    return F.coalesce(F.sum(rows), F.lit(0).cast("long"))


def term_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n) of the terms that ``least`` documents of the language have, and a row without term for each (lang, source).

    Every document gives its terms once for each occurrence, once for each different term and the
    empty term once; all three are counted by one aggregation, which combines before it shuffles.
    The windows then hold a row for each source of a term.
    """
    found = F.regexp_extract_all(F.translate(text_of("text"), UPPER, LOWER), F.lit(TERM), 0)
    each = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), found.alias("found"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    ways = [(one, zero, F.col("found")), (zero, one, F.array_distinct("found")), (zero, zero, F.array(F.lit(NO_TERM)))]
    way = F.explode(F.array(*(F.struct(n.alias("n"), d.alias("docs"), t.alias("terms")) for n, d, t in ways)))
    rows = each.select("lang", "source", way.alias("w")).select("lang", "source", "w.n", "w.docs", F.explode("w.terms").alias("term"))
    counted = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    held = counted.select("lang", "source", "term", "n", F.sum("n").over(whole).alias("lang_n"), F.sum("docs").over(whole).alias("_docs"))
    return held.where((F.col("_docs") >= least) | (F.col("term") == NO_TERM)).drop("_docs")


def share(count: Column | str, total: Column | str, size: Column | str) -> Column:
    """1 + floor(UNIT (count + SMOOTH) / (total + SMOOTH size)), in whole numbers; decimals, as the product may not fit a long."""
    count, total, size = (F.col(c) if isinstance(c, str) else c for c in (count, total, size))
    above = (count + SMOOTH).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, (total + SMOOTH * size).cast("decimal(20,0)"))


def dense_shares(held: DataFrame) -> DataFrame:
    """(lang, source, term, n, p, q) of every group and kept term of its language, zeros too, and a row without term for each group.

    A language's groups and vocabulary meet in PARTS parts, so no language is in one task.
    """
    kept = held.where(F.col("term") != NO_TERM)
    vocabulary = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("size"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = held.where(F.col("term") == NO_TERM).select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "size", "lang_total")))
    parted = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    crossed = parted.join(vocabulary.withColumn("_part", F.pmod(F.hash("term"), F.lit(PARTS))), ["lang", "_part"])
    full = crossed.join(kept.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    shares = full.select("lang", "source", "term", "n", share("n", "total", "size").alias("p"), share("lang_n", "lang_total", "size").alias("q"))
    nothing = F.lit(0).cast("long")
    return shares.unionByName(groups.select("lang", "source", F.lit(NO_TERM).alias("term"), nothing.alias("n"), nothing.alias("p"), nothing.alias("q")))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))


def pair_distances(dense: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language, the farthest first.

    Each pair is joined once, at every term, and counts for both its sources; the row without a
    term keeps pairs of a language without vocabulary.
    """
    a, b = (dense.select("lang", "term", F.col("source").alias(s), F.col("p").alias(p)) for s, p in (("a", "pa"), ("b", "pb")))
    apart = a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(F.abs(F.col("pa") - F.col("pb"))).alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return _ranked(apart.select("lang", "value", both.alias("s")).select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value"))


def telling_terms(dense: DataFrame, most: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): terms that a source uses more than its language does, up to ``most``; what is beyond leaves before the shuffle."""
    more = dense.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(more).where(F.col("rank") <= most)


def audit(docs: DataFrame, least: int = LEAST_DOCS, most: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every source of every language.

    Part ``pair`` holds the sum of differences of shares to each other source, part ``term`` the
    terms with a larger share than in the whole language. Null text, language or source is the
    empty string; empty texts count as documents without terms; a text is read whole; repeated
    rows count as often as they occur; ties go by the item's UTF-8 bytes. A language without kept
    terms has its pairs with value 0, a table without rows no rows. Other columns are not read.
    """
    dense = cut(dense_shares(cut(term_counts(docs, least))))
    return pair_distances(dense).unionByName(telling_terms(dense, most))
