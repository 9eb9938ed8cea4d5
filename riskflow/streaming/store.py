"""Batch-committed tables below one folder on shared storage.

Every micro-batch writes its own directories, replacing what an earlier attempt left there, and
commits last. A rerun batch therefore replaces itself, and a batch without a commit does not
count. The commit record carries what the next batch needs, so no directory is ever listed to
start a batch.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


@dataclass
class Progress:
    """State after a batch: newest event second so far, where rows at hand and totals lie, and files that the
    batch replaced. Those go once the next batch is committed: until then this one may be run again."""

    high_water: int | None = None
    hours: dict[str, list[list[int]]] = field(default_factory=dict)
    totals: dict[str, dict] = field(default_factory=dict)
    garbage: list[str] = field(default_factory=list)


class BatchStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/batch={batch}"

    def write(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        """Writes the batch's rows and returns them as read from the files."""
        df.write.mode("overwrite").parquet(self.path(table, batch))
        return self.spark.read.schema(df.schema).parquet(self.path(table, batch))

    def batches(self, table: str, batches: list[int], schema: StructType) -> DataFrame:
        """Rows of the given batches; none gives an empty frame."""
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.path(table, b) for b in batches])

    def files(self, paths: list[str], schema: StructType) -> DataFrame:
        """Rows below the given paths of the store; none gives an empty frame."""
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def remove(self, paths: list[str]) -> None:
        """Deletes folders of the store, wherever it lies; missing ones are passed over."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for p in paths:
            path = hadoop(f"{self.root}/{p}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def progress_before(self, batch: int) -> Progress:
        if batch == 0:
            return Progress()
        return Progress(**json.loads(self.spark.read.text(self.path("commits", batch - 1)).first().value))

    def commit(self, batch: int, progress: Progress) -> None:
        """The batch counts from here on. Files that the batch before it replaced are removed."""
        before = self.progress_before(batch).garbage
        row = self.spark.createDataFrame([(json.dumps(asdict(progress)),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(self.path("commits", batch))
        self.remove(before)

    def committed(self, table: str) -> DataFrame:
        """All committed rows of a table, with their batch number."""
        done = self.last_committed()
        return self.spark.read.parquet(f"{self.root}/{table}").filter(F.col("batch") <= done)

    def last_committed(self) -> int:
        """Number of the last committed batch."""
        return self.spark.read.text(f"{self.root}/commits").agg(F.max("batch")).first()[0]

    def count_of(self, table: str) -> int:
        """Number of folders that a table has, which are numbered from 0; a missing table has none."""
        try:
            return self.spark.read.parquet(f"{self.root}/{table}").agg(F.max("batch")).first()[0] + 1
        except AnalysisException:
            return 0

    def committed_of(self, table: str, upto: int, schema: StructType, with_batch: bool = False) -> DataFrame:
        """Rows of the folders 0 .. upto - 1 of a table."""
        if not upto:
            rows = self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
        else:
            rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*[self.path(table, b) for b in range(upto)])
        return rows if with_batch else rows.drop("batch")
