"""Running aggregates over ordered groups of any size.

A window partitioned by a key puts the key's rows into one task. Here the groups are measured
first. Where all are small the plain window is used: one shuffle. Otherwise the rows of the large
groups are written, dealt to ranges of (key, order) and written with the number of their range, so each
window task sees one range, and totals of key and range (map-side combined) carry the prefix from
range to range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from riskflow.session import shared_dir

MAX_GROUP_ROWS = 2_000_000
# Bounds of what the driver takes and the tasks get broadcast: large groups, and ranges of their rows. Beyond them
# the groups and ranges grow with the table.
MAX_LARGE_GROUPS = 100_000
MAX_RANGES = 100_000


@dataclass(frozen=True)
class Agg:
    """A running aggregate: kind is 'sum' or 'max', over a column expression."""

    kind: str
    value: Column

    def column(self) -> Column:
        return F.sum(self.value) if self.kind == "sum" else F.max(self.value)


def large_groups(df: DataFrame, keys: list[str], max_rows: int = MAX_GROUP_ROWS) -> DataFrame | None:
    """Keys holding more than max_rows rows, or None if there are none.

    Comes back with the group's size `_n` and its rows a chunk, `_chunk_rows`. At most
    MAX_LARGE_GROUPS groups are given: the limit rises to total / MAX_LARGE_GROUPS where that is
    more, and no more than that many groups can exceed it.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total, largest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    if largest is None or largest <= max_rows:
        return None
    limit = max(max_rows, total // MAX_LARGE_GROUPS)
    rows = sizes.filter(F.col("_n") > limit).withColumn("_chunk_rows", F.lit(limit)).collect()
    if not rows:
        return None
    schema = T.StructType([*sizes.schema.fields, T.StructField("_chunk_rows", T.LongType())])
    return df.sparkSession.createDataFrame(rows, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what follows reads it as often as it likes."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _in_ranges(rows: DataFrame, keys: list[str], order: list[str], large: DataFrame) -> DataFrame:
    """The rows with `_chunk`, which increases with the order inside a group; about `_chunk_rows` rows each.

    Written before, as range bounds are found by a pass of its own, and after, as another run would find others.
    """
    total, each = large.agg(F.sum("_n"), F.max("_chunk_rows")).first()
    ranges = int(max(1, min(MAX_RANGES, -(-total // each))))
    dealt = written(rows, "large-groups").repartitionByRange(ranges, *keys, *order)
    return written(dealt.withColumn("_chunk", F.spark_partition_id()), "ranges")


def _merge(kind: str, local: Column, before: Column) -> Column:
    if kind == "max":
        return F.greatest(local, before)
    return F.when(local.isNull(), before).when(before.isNull(), local).otherwise(local + before)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    aggs: dict[str, Agg],
    *,
    large: DataFrame | None | str = "measure",
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Adds, per row, each aggregate over the rows of its group strictly before it.

    `order` must be unique within a group. `large` is "measure" (one counting job), None (groups
    are known to be small) or the frame of large groups from `large_groups`. Nulls mean no row
    came before.
    """
    if isinstance(large, str):
        large = large_groups(df, keys, max_rows)
    before = (Window.unboundedPreceding, -1)
    if large is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before)
        return df.select("*", *[a.column().over(w).alias(n) for n, a in aggs.items()])

    marked = df.join(F.broadcast(large.select(*keys, F.lit(True).alias("_split"))), keys, "left")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before)
    small = marked.filter("_split IS NULL").select(*df.columns, *[a.column().over(w).alias(n) for n, a in aggs.items()])
    chunked = _in_ranges(marked.filter("_split").select(*df.columns), keys, order, large)
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*before)
    # A row per key and range: no more than there are ranges and large groups.
    carried = (
        chunked.groupBy(*keys, "_chunk")
        .agg(*[a.column().alias(f"_t_{n}") for n, a in aggs.items()])
        .select(
            *keys, "_chunk",
            *[Agg(a.kind, F.col(f"_t_{n}")).column().over(over_chunks).alias(f"_b_{n}") for n, a in aggs.items()],
        )
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(*before)
    # Stated, since rows already hashed by the keys alone would satisfy the window as they are.
    local = chunked.repartition(*keys, "_chunk").select(
        "*", *[a.column().over(within).alias(f"_l_{n}") for n, a in aggs.items()])
    return small.unionByName(local.join(F.broadcast(carried), [*keys, "_chunk"], "left").select(
        *df.columns,
        *[_merge(a.kind, F.col(f"_l_{n}"), F.col(f"_b_{n}")).alias(n) for n, a in aggs.items()],
    ))
