"""What a stream keeps between batches: totals a key, and the rows that new rows can still look back to.

Both are files that a batch writes anew where it touches them. Totals lie in buckets by a hash of the key; a batch reads
and rewrites the buckets of its own keys. There are twice as many buckets whenever they hold more than BUCKET_ROWS
keys each on average, so the bytes a key costs stay the same however many keys were ever seen. Rows lie by
event hour; parts of an hour are merged MERGE at a time, level by level, so their number follows the logarithm of
the batches in that hour. Hours behind the horizon, and files that were replaced, are removed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskflow import schemas as S
from riskflow.streaming.store import BatchStore

BUCKET_ROWS = 50_000
MERGE = 8


@dataclass
class Buckets:
    """Where the totals are: 2^depth buckets; bucket -> [batch that wrote it, keys in it]."""

    depth: int = 0
    parts: dict[str, list[int]] = field(default_factory=dict)


class KeyedTotals:
    def __init__(self, store: BatchStore, name: str, key: str, schema: T.StructType, largest: tuple[str, ...] = ()):
        """largest: columns of which the greatest value is kept; all others are added up."""
        self.store, self.name, self.key, self.schema, self.largest = store, name, key, schema, largest

    def _bucket(self, depth: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(1 << depth)).alias("bucket")

    def path(self, depth: int, batch: int, bucket: int | str) -> str:
        return f"{self.name}_{depth}/batch={batch}/bucket={bucket}"

    def paths(self, at: Buckets, buckets: list[int] | None = None) -> list[str]:
        wanted = at.parts if buckets is None else [str(b) for b in buckets if str(b) in at.parts]
        return [self.path(at.depth, at.parts[b][0], b) for b in wanted]

    def _touched(self, at: Buckets, rows: DataFrame) -> list[int]:
        if not at.depth:
            return [0]
        return [r["bucket"] for r in rows.select(self._bucket(at.depth)).distinct().collect()]  # no more than there are buckets

    def lookup(self, at: Buckets, keys: DataFrame) -> DataFrame:
        """Totals of the given keys, a row a key that has any; only their buckets are read."""
        found = self.store.files(self.paths(at, self._touched(at, keys)), self.schema)
        return found.join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _write(self, rows: DataFrame, depth: int, batch: int) -> dict[str, list[int]]:
        out = rows.withColumn("bucket", self._bucket(depth)).repartition("bucket")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.store.root}/{self.name}_{depth}/batch={batch}")
        written = self.store.spark.read.schema(f"{self.schema.simpleString()[7:-1].replace(':', ' ')}, bucket long").parquet(
            f"{self.store.root}/{self.name}_{depth}/batch={batch}")
        return {str(r["bucket"]): [batch, r["count"]] for r in written.groupBy("bucket").count().collect()}

    def merge(self, at: Buckets, delta: DataFrame, batch: int) -> tuple[Buckets, list[str]]:
        """(where the totals are after adding delta, files that are no longer needed)."""
        touched = self._touched(at, delta)
        if not touched:
            return at, []
        gone = self.paths(at, touched)
        aggs = [(F.max(c) if c in self.largest else F.sum(c)).cast(self.schema[c].dataType).alias(c) for c in self.schema.names if c != self.key]
        new = self.store.files(gone, self.schema).unionByName(delta.select(*self.schema.names)).groupBy(self.key).agg(*aggs).select(*self.schema.names)
        after = Buckets(at.depth, {**at.parts, **self._write(new, at.depth, batch)})
        keys, depth = sum(n for _, n in after.parts.values()), after.depth
        while keys > BUCKET_ROWS << depth:
            depth += 1
        if depth > after.depth:
            gone += [p for p in self.paths(after) if p not in gone]
            after = Buckets(depth, self._write(self.store.files(self.paths(after), self.schema), depth, batch))
        return after, gone


class RecentRows:
    """Rows by event hour. hours: hour -> [[batch, level], ...]."""

    def __init__(self, store: BatchStore, schema: T.StructType):
        self.store, self.schema = store, schema

    @staticmethod
    def path(hour: int | str, batch: int, level: int) -> str:
        return f"recent_{level}/batch={batch}/hour={hour}"

    def paths(self, hours: dict[str, list[list[int]]]) -> list[str]:
        return [self.path(h, b, level) for h, parts in hours.items() for b, level in parts]

    def read(self, hours: dict[str, list[list[int]]], horizon: int | None) -> DataFrame:
        """Rows from the horizon on; hours before it are not read."""
        if horizon is None:
            return self.store.files([], self.schema)
        kept = {h: parts for h, parts in hours.items() if int(h) >= horizon // S.ONE_HOUR}
        return self.store.files(self.paths(kept), self.schema).filter(F.col("sec") >= horizon)

    def _write(self, rows: DataFrame, level: int, batch: int) -> list[int]:
        path = f"{self.store.root}/recent_{level}/batch={batch}"
        hour = F.expr(f"sec div {S.ONE_HOUR}")
        rows.withColumn("hour", hour).sortWithinPartitions("hour", "sec").write.mode("overwrite").partitionBy("hour").parquet(path)
        return [r["hour"] for r in rows.select(hour.alias("hour")).distinct().collect()]  # hours between horizon and newest row

    def add(self, hours: dict[str, list[list[int]]], rows: DataFrame, horizon: int | None, batch: int) -> tuple[dict[str, list[list[int]]], list[str]]:
        """(hours after the batch, files that are no longer needed). rows: the batch's rows that can still be looked back to."""
        if horizon is None:
            return hours, []
        gone = self.paths({h: p for h, p in hours.items() if int(h) < horizon // S.ONE_HOUR})
        after = {h: [list(x) for x in p] for h, p in hours.items() if int(h) >= horizon // S.ONE_HOUR}
        for h in self._write(rows, 0, batch):
            after.setdefault(str(h), []).append([batch, 0])
        level = 0
        while True:
            full = {h: [p for p in parts if p[1] == level] for h, parts in after.items()}
            full = {h: parts for h, parts in full.items() if len(parts) >= MERGE}
            if not full:
                return after, gone
            self._write(self.store.files(self.paths(full), self.schema), level + 1, batch)
            gone += self.paths(full)
            for h in full:
                after[h] = [p for p in after[h] if p[1] != level] + [[batch, level + 1]]
            level += 1
