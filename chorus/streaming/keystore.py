"""Logs of micro-batches that are merged as they grow, and a key index on top of one.

A log has one folder per micro-batch. Before a batch starts, all batches before it are
merged into one folder once there are enough of them; a line in the table of marks makes
the merged folder count. A reader takes the newest merged folder and the batches after
it, so what is read does not grow with the number of batches. A batch that is repeated
after a failure overwrites its folder and never sees what its first attempt wrote,
because only batches before the current one are merged or read.

The key index keeps digests in folders by a hash: a batch reads the buckets its own keys
fall into and no others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

MERGE_EVERY = 8
BUCKETS = 256


class BatchLog:
    """Rows by micro-batch below ``path``, merged by ``combine`` (equal rows stay by default)."""

    def __init__(self, spark, path: str, columns: T.StructType | str,
                 combine: Callable[[DataFrame], DataFrame] = lambda df: df,
                 partition: str | None = None, merge_every: int = MERGE_EVERY):
        self.spark, self.path, self.combine = spark, path, combine
        self.columns = columns if isinstance(columns, T.StructType) else T.StructType.fromDDL(columns)
        self.partition, self.merge_every = partition, merge_every
        spark.createDataFrame([], "upto bigint").write.mode("ignore").parquet(f"{path}/marks")
        dated = T.StructType([*self.columns, T.StructField("batch", T.LongType())])
        spark.createDataFrame([], dated).write.mode("ignore").partitionBy(
            "batch", *([partition] if partition else [])).parquet(f"{path}/recent")

    def merged_upto(self, before: int | None = None) -> int:
        """The last batch of the newest merged folder; -1 where there is none."""
        marks = self.spark.read.schema("upto bigint").parquet(f"{self.path}/marks")
        if before is not None:
            marks = marks.filter(F.col("upto") < before)
        return marks.agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]

    def _read(self, folder: str, base: str) -> DataFrame:
        return (self.spark.read.schema(self.columns).option("basePath", base).parquet(folder)
                .select(*self.columns.names))

    def read(self, before: int | None = None, where: Column | None = None) -> DataFrame:
        """All rows, or those of the batches before one, that satisfy ``where``."""
        upto = self.merged_upto(before)
        recent = self.spark.read.schema(T.StructType([*self.columns, T.StructField("batch", T.LongType())])
                                        ).parquet(f"{self.path}/recent").filter(F.col("batch") > upto)
        if before is not None:
            recent = recent.filter(F.col("batch") < before)
        rows = recent.drop("batch")
        if upto >= 0:
            folder = f"{self.path}/merged/upto={upto}"
            rows = rows.unionByName(self._read(folder, folder))
        return rows if where is None else rows.filter(where)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        self._save(rows, f"{self.path}/recent/batch={batch_id}")

    def _save(self, rows: DataFrame, folder: str) -> None:
        writer = rows.select(*self.columns.names).write.mode("overwrite")
        (writer.partitionBy(self.partition) if self.partition else writer).parquet(folder)

    def merge(self, batch_id: int) -> bool:
        """Merge the batches before ``batch_id`` if there are enough of them."""
        upto = self.merged_upto(batch_id)
        if batch_id - 1 - upto < self.merge_every:
            return False
        rows = self.combine(self.read(before=batch_id))
        if self.partition:
            rows = rows.repartition(F.col(self.partition))
        self._save(rows, f"{self.path}/merged/upto={batch_id - 1}")
        self.spark.createDataFrame([(batch_id - 1,)], "upto bigint").write.mode("append").parquet(
            f"{self.path}/marks")
        return True


class KeyIndex:
    """The digests a table holds, by bucket."""

    def __init__(self, spark, path: str, buckets: int = BUCKETS, merge_every: int = MERGE_EVERY):
        self.buckets = buckets
        self.log = BatchLog(spark, path, "digest string, bucket int", partition="bucket",
                            merge_every=merge_every)

    def bucket(self, digest: Column) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(self.buckets)).cast("int")

    def known(self, digests: DataFrame, batch_id: int) -> DataFrame:
        """Digests stored before this batch, from the buckets of the given ``digest`` column."""
        touched = digests.select(self.bucket(F.col("digest")).alias("bucket")).distinct().collect()
        found = self.log.read(before=batch_id, where=F.col("bucket").isin([r[0] for r in touched]))
        return found.select("digest")

    def add(self, digests: DataFrame, batch_id: int) -> None:
        self.log.write(digests.select("digest", self.bucket(F.col("digest")).alias("bucket"))
                       .repartition("bucket"), batch_id)


def latest_of(keys: Sequence[str], values: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Keep the newest values of each key; rows carry ``version``."""
    def combine(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values, "version"), "version").alias("_v")
                                       ).select(*keys, "_v.*")

    return combine
