"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from plumbline.lineage import settled as cut
from plumbline.lineage import shared_root

#: Rows that Python code works on at once, so that a batch of long texts is not held as Python objects whole.
ROWS_AT_ONCE = 200
#: Rows that are broadcast once they are counted: of any width, and of two numbers.
BROADCAST_ROWS, BROADCAST_PAIRS = 100_000, 500_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def column(name: str) -> Column:
    """The column of exactly that name, dots and backticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate files, in whatever file system it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def frequent_keys(rows: DataFrame, keys: list[str]) -> list[Row]:
    """The keys that hold more rows than half of an even partition: at most two for each shuffle partition.

    Counted before they are shuffled. ``rows`` is read twice and should be checkpointed or cheap.
    """
    least = rows.count() / (2 * shuffle_parts(rows.sparkSession))
    return rows.groupBy(*keys).agg(F.count("*").alias("_pl_n")).where(F.col("_pl_n") > least).select(*keys).collect()


def joined(rows: DataFrame, names: DataFrame, keys: list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with the one row of ``names`` for their key, without gathering a frequent key in one task.

    ``names`` is run once and counted. Up to ``most`` rows it is broadcast. Beyond that frequent
    keys are joined where their rows stand, by a broadcast of their rows of ``names`` (at most
    two for each shuffle partition), and the others by a shuffle. ``rows`` is read more than
    once and should be checkpointed or cheap.
    """
    names = cut(names)
    if names.count() <= most:
        return rows.join(F.broadcast(names), keys, how)
    hot = frequent_keys(rows, keys)
    if not hot:
        return rows.join(names, keys, how)
    few = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(*keys).schema))
    many = rows.join(few, keys, "left_semi").join(F.broadcast(names.join(few, keys, "left_semi")), keys, how)
    return many.unionByName(rows.join(few, keys, "left_anti").join(names, keys, how))


def text_of(name: str = "text") -> Column:
    """The text column as a string; null counts as empty."""
    return F.coalesce(column(name).cast("string"), F.lit(""))


@dataclass(frozen=True)
class Carried:
    """Columns that go through Python code untouched, under names that cannot clash."""

    inner: list[Column]
    schema: list[str]
    names: list[str]

    def named(self, out: DataFrame) -> DataFrame:
        """``out`` with the columns under their own names again."""
        own = [column(f"_pl_k{k}").alias(name) for k, name in enumerate(self.names)]
        return out.select(*own, *(column(c) for c in out.columns[len(own) :]))


def carried(df: DataFrame, keep: Iterable[str], added: Iterable[str]) -> Carried:
    """The columns ``keep`` of ``df``; one that has the name of an added column gives way to it."""
    taken = set(added)
    names = [c for c in keep if c not in taken]
    inner = [column(c).alias(f"_pl_k{k}") for k, c in enumerate(names)]
    return Carried(inner, [f"{c} {kind}" for c, kind in df.select(*inner).dtypes], names)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def bucket_of(doc_id: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as empty text."""
    return (F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % n).cast("int")


def sampled(df: DataFrame, key: Column, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows chosen by a hash of ``key``; all rows if there are fewer.

    The hash decides for each row on its own, so no order or limit is needed and a rerun
    picks the same rows. The bound holds in expectation.
    """
    n = df.count()
    if n <= bound:
        return df
    steps = 1 << 30
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(steps)) < int(steps * bound / n))
