"""Mixing sources to target weights by Poisson replication.

Each source has a mean number of repetitions per document. A document's number of copies is
the Poisson quantile of a uniform number made from a hash of its id, so it is the same in
every run and on every executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import column, cut, shuffle_parts, text_of

#: 52 bits of a digest make the uniform number.
DIGITS, SCALE = 13, float(1 << 52)
BROADCAST_ROWS = 2000


def repetition_rates(docs: DataFrame, source: str = "source", text: str = "text", temperature: float = 0.5, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, rate): the mean copies of a document that bring each source to its share.

    A source's mass is its code points. Its share is ``weights[source]`` (others get none) or,
    without weights, its number of documents to the power ``temperature``, over the sum of
    all. The mass of the result is ``epochs`` times that of the input. Null is a source too;
    a source without any text gets ``epochs``.
    """
    per = docs.groupBy(column(source).alias("source")).agg(F.sum(F.length(text_of(text)).cast("long")).alias("mass"), F.count("*").alias("n"))
    if weights is None:
        share = F.sqrt(F.col("n").cast("double")) if temperature == 0.5 else F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        share = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))))[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    per = per.withColumn("share", share)
    total = per.agg(F.sum("mass").alias("all_mass"), F.sum("share").alias("all_share"))
    rate = F.lit(float(epochs)) * F.col("all_mass") * F.col("share") / F.col("all_share") / F.col("mass")
    return per.join(F.broadcast(total)).select("source", F.when((F.col("mass") > 0) & (F.col("all_share") > 0), rate).otherwise(float(epochs)).alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """(source, cdf): the distribution function at 0, 1, 2, ... as an array, up to where it is 1."""
    k = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int"))).alias("k"))
    # ln P(k) is a running sum of ln(rate / i); a rate of 0 gives no copies.
    own = W.partitionBy("source").orderBy("k")
    p = k.withColumn("p", F.when(F.col("rate") > 0, F.exp(-F.col("rate") + F.sum(F.when((F.col("k") > 0) & (F.col("rate") > 0), F.ln(F.col("rate") / F.col("k"))).otherwise(F.lit(0.0))).over(own))).otherwise(F.when(F.col("k") == 0, F.lit(1.0)).otherwise(F.lit(0.0))))
    return p.withColumn("c", F.sum("p").over(own)).groupBy("source").agg(F.array_sort(F.collect_list("c")).alias("cdf"))


def mixed(
    docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", temperature: float = 0.5, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = "mix-1"
) -> DataFrame:
    """The columns of ``docs`` with copy_no (from 1) and mix_key, replicated and shuffled.

    Rows are dealt out and ordered by ``mix_key``, a hash of id and copy number. A null id
    hashes as empty text. Rows that repeat get as many copies each. A column of the input
    named copy_no or mix_key is replaced. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    steps = cut(poisson_steps(repetition_rates(docs, source, text, temperature, weights, epochs)).select(F.col("source").alias("_pl_source"), F.col("cdf").alias("_pl_cdf")))
    if steps.count() <= BROADCAST_ROWS:
        steps = F.broadcast(steps)
    columns = [c for c in docs.columns if c not in ("copy_no", "mix_key")]
    key = F.coalesce(column(doc_id).cast("string"), F.lit(""))
    hashed = F.md5(F.encode(F.concat(F.lit(f"{seed}|"), key), "UTF-8"))
    rows = docs.select(*(column(c) for c in columns), key.alias("_pl_key"), (F.conv(F.substring(hashed, 1, DIGITS), 16, 10).cast("double") / SCALE).alias("_pl_u"))
    joined = rows.join(steps, column(source).eqNullSafe(F.col("_pl_source")))
    copies = joined.withColumn("_pl_n", F.size(F.filter("_pl_cdf", lambda c: c <= F.col("_pl_u")))).where("_pl_n > 0")
    out = copies.select(*(column(c) for c in columns), "_pl_key", F.explode(F.sequence(F.lit(1), F.col("_pl_n"))).alias("copy_no"))
    out = out.withColumn("mix_key", F.md5(F.encode(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col("_pl_key"), F.col("copy_no").cast("string")), "UTF-8"))).drop("_pl_key")
    return out.repartition(shuffle_parts(spark), "mix_key").sortWithinPartitions("mix_key")
