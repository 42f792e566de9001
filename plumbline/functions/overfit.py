"""Probability of backtest overfitting by combinatorially symmetric cross-validation.

Everything is relational: the series are reduced to sums per block once; a split is a bit mask
with half of its bits set; a split's Sharpe ratios come from sums over subsets of two halves of the blocks.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.inference import FLOOR
from plumbline.operators.crosssection import mean_rank


def check_geometry(days: int, blocks: int) -> int:
    """Rows per block; ValueError for a number of blocks that is odd, under 4, or leaves under 5 rows each."""
    if blocks % 2 or blocks < 4:
        raise ValueError("the number of blocks must be even and at least 4")
    size = days // blocks
    if size < 5:
        raise ValueError(f"{days} days cannot be cut into {blocks} usable blocks")
    return size


def block_sums(series: DataFrame, size: int, blocks: int) -> DataFrame:
    """(variant, block, s1, s2) of (variant, ordinal, ret); rows past the last whole block are left out."""
    cut = series.where(F.col("ordinal") < size * blocks).withColumn("block", F.floor(F.col("ordinal") / size).cast("int"))
    return cut.groupBy("variant", "block").agg(F.sum("ret").alias("s1"), F.sum(F.col("ret") * F.col("ret")).alias("s2"))


def half_sums(sums: DataFrame, first: int, blocks: int) -> DataFrame:
    """(variant, mask, s1, s2): sums over every subset of the ``blocks`` blocks from ``first`` on; bit k of the mask is block first + k.

    A block's row goes to the half of the subsets that hold it; the empty subset has a row of zeros.
    """
    own = sums.where((F.col("block") >= first) & (F.col("block") < first + blocks)).withColumn("_bit", F.pow(F.lit(2), F.col("block") - first).cast("int"))
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << blocks) - 1)), lambda m: (m.bitwiseAND(F.col("_bit")) != 0) | ((m == 0) & (F.col("_bit") == 1)))
    each = own.select("variant", F.explode(masks).alias("mask"), "s1", "s2")
    zero = lambda c: F.when(F.col("mask") == 0, F.lit(0.0)).otherwise(F.col(c))
    return each.groupBy("variant", "mask").agg(F.sum(zero("s1")).alias("s1"), F.sum(zero("s2")).alias("s2"))


def split_sharpes(sums: DataFrame, size: int, blocks: int) -> DataFrame:
    """(split, variant, fit, test): the ratio of every variant on both halves of every split.

    A split is a subset of the lower half of the blocks and one of the upper half that together
    have half of the bits. The sums of all subsets of each half are made once, 2^(blocks / 2) rows
    a variant, and joined by variant and number of bits, so each split and variant is one joined
    row; what is not fitted is the whole less what is.
    """
    low, high = blocks // 2, blocks - blocks // 2
    lower = half_sums(sums, 0, low).select("variant", F.col("mask").alias("_a"), F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.bit_count("mask").alias("_bits"))
    upper = half_sums(sums, low, high).select("variant", F.col("mask").alias("_b"), F.col("s1").alias("b1"), F.col("s2").alias("b2"), (F.lit(blocks // 2) - F.bit_count("mask")).alias("_bits"))
    whole = sums.groupBy("variant").agg(F.sum("s1").alias("w1"), F.sum("s2").alias("w2"))
    rows = lower.join(upper, ["variant", "_bits"]).join(whole, "variant")
    n = float(size * (blocks // 2))

    def sharpe(first: Column, second: Column) -> Column:
        m = first / n
        return m / F.sqrt(F.greatest(second / n - m * m, F.lit(FLOOR)))

    s1, s2 = F.col("a1") + F.col("b1"), F.col("a2") + F.col("b2")
    split = F.col("_a").cast("long") + F.col("_b").cast("long") * (1 << low)
    return rows.select(split.alias("split"), "variant", sharpe(s1, s2).alias("fit"), sharpe(F.col("w1") - s1, F.col("w2") - s2).alias("test"))


def split_logits(series: DataFrame, days: int, blocks: int = 16) -> DataFrame:
    """(split, best, rank, logit): the best variant on the fitted half and its rank (ties share) on the other."""
    size = check_geometry(days, blocks)
    each = split_sharpes(block_sums(series, size, blocks), size, blocks)
    w = Window.partitionBy("split")
    ranked = each.withColumns({"rank": mean_rank("test", w), "n": F.count("*").over(w)})
    best = ranked.groupBy("split").agg(F.min_by(F.struct("variant", "rank", "n"), F.struct(-F.col("fit"), F.col("variant"))).alias("b")).select("split", "b.*")
    share = F.col("rank") / (F.col("n") + 1)
    return best.select("split", F.col("variant").alias("best"), "rank", F.ln(share / (1 - share)).alias("logit"))


def overfitting_probability(series: DataFrame, days: int, blocks: int = 16) -> DataFrame:
    """One row: pbo (share of splits whose best variant ranks in the lower half), and medians over all splits."""
    logits = split_logits(series, days, blocks)
    return logits.agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count("*").alias("n_combinations"), F.median("logit").alias("median_logit"), F.median("rank").alias("median_rank"), F.lit(blocks).alias("n_splits"))


def combinations(blocks: int) -> int:
    return comb(blocks, blocks // 2)
