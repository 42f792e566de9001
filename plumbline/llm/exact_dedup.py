"""Exact deduplication against a persistent digest index.

The index is a table with one row per digest, bucketed and sorted by it. A new batch is
reduced to its digests and meets the index in one sort-merge join: those without a partner
there (the anti-join) are appended, the others are held. The index is read in its buckets and
never shuffled or copied; once it is compacted it is not sorted either.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import column, cut, joined, remove, shared_path, shuffle_parts, text_of

#: The six characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
INDEX_COLUMNS = "digest binary, keep_id {id}, keep_chars int, group_size long, batch string"
#: Files of a bucket from which on they are written into one.
MOST_FILES = 8


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the planner for the jobs run inside; what was set before comes back."""
    names = {k: "spark.sql." + k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def digest_of(text: str = "text") -> Column:
    """SHA-256 of the text without white space, as lower-case hex."""
    return F.sha2(F.encode(F.translate(text_of(text), SPACES, ""), "UTF-8"), 256)


class DigestIndex:
    """A bucketed table of digests; ``decide`` appends what is new to it.

    Without ``path`` a new one is made in the shared folder. With it the index whose files stand
    there is opened, in this session or a later one; ``buckets`` and ``id_type`` must be those it
    was made with. The files stand in a folder of their generation, the last complete one counts.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, id_type: str = "bigint", path: str | None = None, most_files: int = MOST_FILES):
        if path and not buckets:
            raise ValueError("an index is opened with the number of buckets it was made with")
        self.spark, self.id_type, self.most_files = spark, id_type, most_files
        self.buckets = buckets or shuffle_parts(spark)
        self.name, self.path = f"plumbline_digests_{uuid.uuid4().hex}", path or shared_path(spark, "digests")
        self.generation = self._last_complete() if path else 0
        if path:
            columns = INDEX_COLUMNS.format(id=id_type)
            spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._folder(self.generation)}'")
        else:
            self._append(spark.createDataFrame([], INDEX_COLUMNS.format(id=id_type)), "overwrite")

    def _folder(self, generation: int) -> str:
        return f"{self.path}/generation-{generation:06d}"

    def _last_complete(self) -> int:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [x.getPath() for x in files.globStatus(path(f"{self.path}/generation-*")) or []]
        complete = [int(x.getName().rpartition("-")[2]) for x in found if files.exists(path(x, "_SUCCESS"))]
        if not complete:
            raise ValueError(f"no complete index in {self.path}")
        return max(complete)

    def _append(self, rows: DataFrame, mode: str = "append") -> None:
        rows.write.mode(mode).format("parquet").option("path", self._folder(self.generation)).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def files(self) -> DataFrame:
        """The same rows from the files alone, for readers that do not know the table."""
        return self.spark.read.schema(INDEX_COLUMNS.format(id=self.id_type)).parquet(self._folder(self.generation))

    def decide(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """(digest, keep_id, keep_chars, group_size, held) for each digest of (digest binary, id, chars); new ones are appended.

        Of one digest the row with the most code points stays, then the smallest id; a null id
        loses against any other. A digest held from an earlier batch keeps its row. The index
        is read once, where it lies, by a merge join with the batch's digests alone.

        ``batch`` names the batch. Run again under its name, as after a failure at any point,
        it gets the same answers: digests that it brought itself are not held, and only those
        not yet there are appended. Without a name a batch is a new one each time.
        """
        batch = batch or uuid.uuid4().hex
        best = digests.groupBy("digest").agg(F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("n"), F.col("id").alias("id"))).alias("b"), F.count("*").alias("group_size"))
        rows = best.select("digest", F.struct(F.col("b.id").alias("keep_id"), (-F.col("b.c")).alias("keep_chars"), "group_size").alias("own"))
        if self.buckets != shuffle_parts(self.spark):
            rows = rows.repartition(self.buckets, "digest")
        # Where a bucket is one file the order it was written in counts.
        with _settings(self.spark, legacy__bucketedTableScan__outputOrdering="true"):
            index = self.table().select("digest", F.struct("keep_id", "keep_chars", "group_size").alias("there"), F.col("batch").alias("of"), F.lit(True).alias("known"))
            met = rows.join(index.hint("merge"), "digest", "left").withColumn("held", F.col("known").isNotNull() & ~F.col("of").eqNullSafe(F.lit(batch)))
            found = cut(met.select("digest", F.when(F.col("held"), F.col("there")).otherwise(F.col("own")).alias("row"), "held", F.col("known").isNull().alias("new")))
        self._append(found.where("new").select("digest", "row.*", F.lit(batch).alias("batch")).repartition(self.buckets, "digest"))
        self.spark.catalog.refreshTable(self.name)
        if len(self.table().inputFiles()) > self.most_files * self.buckets:
            self.compact()
        return found.select("digest", "row.*", "held")

    def compact(self) -> None:
        """Writes each bucket into one sorted file, as a new generation; the old one goes once that is complete.

        A bucket is read and written by one task, without a shuffle. Broken off, it leaves the index as it was.
        """
        old, folder = self.name, self._folder(self.generation)
        self.name, self.generation = f"plumbline_digests_{uuid.uuid4().hex}", self.generation + 1
        try:
            with _settings(self.spark, sources__bucketing__autoBucketedScan__enabled="false"):
                self._append(self.spark.table(old), "overwrite")
        except Exception:
            self.name, self.generation = old, self.generation - 1
            raise
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")
        remove(self.spark, folder)

    def drop(self) -> None:
        """Removes the index and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def decide(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", doc_id: str = "doc_id", batch: str | None = None, batches: int = 1) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row; the batch enters the index.

    Null text counts as empty and all empty texts are equal. Among equal texts the longest
    original stays, then the smallest id. Rows that repeat the winning id are all marked kept
    (``deduplicated`` leaves one of them). Against a filled index a digest held before is not
    kept, and group_size is the size of the batch that brought it. The same rows under the same
    ``batch`` name get the same answers again. With ``batches`` the digests enter in so many
    parts, dealt by digest, which changes no answer. An empty table gives an empty one; other
    columns are not read. Without ``index`` one is made for these rows and removed.
    """
    rows = cut(docs.select(column(doc_id).alias("id"), F.length(text_of(text)).alias("chars"), F.unhex(digest_of(text)).alias("digest")))
    used = index or DigestIndex(docs.sparkSession, id_type=dict(rows.dtypes)["id"])
    batch = batch or uuid.uuid4().hex
    part = F.pmod(F.xxhash64("digest", F.lit("batch")), F.lit(batches))
    parts = [used.decide(rows if batches == 1 else rows.where(part == k), batch) for k in range(batches)]
    found = reduce(DataFrame.unionByName, parts)
    if index is None:
        used.drop()
    wins = ~F.col("held") & F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    # Equal texts may be a third of all rows: the empty ones, say.
    return joined(rows, found, ["digest"]).select(F.col("id").alias("doc_id"), "keep_id", "group_size", wins.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", doc_id: str = "doc_id", batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; one row of each group of equal texts."""
    named = lambda c: {"_pl_null": column(c).isNull(), "_pl_id": F.coalesce(column(c).cast("string"), F.lit(""))}
    keys = ["_pl_digest", "_pl_id", "_pl_null"]
    wanted = decide(docs, index, text, doc_id, batch).where("kept").withColumns(named("doc_id")).select(F.col("text_sha256").alias("_pl_digest"), *keys[1:]).distinct()
    tagged = docs.withColumns({"_pl_digest": digest_of(text), "_pl_chars": -F.length(text_of(text)), **named(doc_id)})
    rows = tagged.join(wanted, keys, "left_semi")
    longest = rows.groupBy(*keys).agg(F.min_by(F.struct(*map(column, docs.columns)), F.col("_pl_chars")).alias("_pl_row"))
    return longest.select(*(F.col("_pl_row")[c].alias(c) for c in docs.columns))
