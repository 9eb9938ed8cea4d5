"""Isotonic calibration of scores of any number.

Equal scores become one weighted point, map-side first. The points are dealt to ranges of scores, and each range is
pooled on its own: neighbours that fall are merged until the means rise. Pooling pooled blocks gives what pooling their
points would, so the ranges are merged FAN_IN neighbours at a time, and distinct scores never meet in one place, only
blocks of rising means do. What reaches the driver is the two ends of each final block, which the model holds anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F

from riskflow.operators.ordered import written

RANGE_POINTS = 500_000
FAN_IN = 16
BLOCK_SCHEMA = "part int, low double, high double, total double, weight double"


class _Pool:
    """Blocks in order of scores; a block with no larger mean than the one before it is merged with it."""

    def __init__(self):
        self.blocks: list[tuple[float, float, float, float]] = []

    def add(self, low: float, high: float, total: float, weight: float) -> None:
        while self.blocks and self.blocks[-1][2] * weight >= total * self.blocks[-1][3]:
            first, _, t, w = self.blocks.pop()
            low, total, weight = first, total + t, weight + w
        self.blocks.append((low, high, total, weight))

    def frame(self, part: int) -> pd.DataFrame:
        out = pd.DataFrame(self.blocks, columns=["low", "high", "total", "weight"], dtype="float64")
        out.insert(0, "part", pd.Series(part, index=out.index, dtype="int32"))
        return out


def _pooled_points(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pool, part = _Pool(), 0
    for frame in frames:
        part = int(frame["part"].iloc[0]) if len(frame) else part
        for row in frame[["low", "high", "total", "weight"]].itertuples(index=False, name=None):
            pool.add(*row)
    yield pool.frame(part)


def _pooled_neighbours(frame: pd.DataFrame) -> pd.DataFrame:
    pool = _Pool()
    for row in frame.sort_values("low")[["low", "high", "total", "weight"]].itertuples(index=False, name=None):
        pool.add(*row)
    return pool.frame(int(frame["part"].iloc[0]) // FAN_IN)


def pooled_blocks(scores: DataFrame, score: str, label: str, range_points: int = RANGE_POINTS) -> DataFrame:
    """(low, high, total, weight) of each block of the isotonic fit: scores from low to high have total / weight.

    Rows without a score, or with NaN, or without a label take no part; an empty table has no blocks. Labels may be
    booleans or numbers. Equal means of neighbouring blocks are one block.
    """
    at = F.col(score).cast("double")
    taken = scores.filter(at.isNotNull() & ~F.isnan(at) & F.col(label).isNotNull())
    points = written(taken.groupBy(at.alias("low")).agg(
        F.sum(F.col(label).cast("double")).alias("total"), F.count("*").cast("double").alias("weight")), "points")
    ranges = max(1, -(-points.count() // range_points))
    # Each range is a task of its own, in order of scores; its number is fixed with its rows.
    dealt = points.repartitionByRange(ranges, "low").withColumn("part", F.spark_partition_id())
    blocks = dealt.select("part", "low", F.col("low").alias("high"), "total", "weight").sortWithinPartitions("low").mapInPandas(
        _pooled_points, BLOCK_SCHEMA)
    while ranges > 1:
        blocks = blocks.groupBy(F.expr(f"part div {FAN_IN}")).applyInPandas(_pooled_neighbours, BLOCK_SCHEMA)
        ranges = -(-ranges // FAN_IN)
    return blocks.drop("part")


def fit_isotonic(
    scores: DataFrame, label: str = "is_fraud", score: str = "raw_probability", to: str = "fraud_probability",
    range_points: int = RANGE_POINTS,
) -> IsotonicRegressionModel:
    """The isotonic map from score to observed rate, linear between blocks. The model is made from the ends of the
    blocks alone, which already rise, so its own fit has nothing left to pool."""
    mean = F.col("total") / F.col("weight")
    end = lambda at: F.struct(F.col(at).alias(score), mean.alias("label"), (F.col("weight") / 2).alias("weight"))
    ends = F.when(F.col("low") < F.col("high"), F.array(end("low"), end("high"))).otherwise(F.array(end("low")))
    points = pooled_blocks(scores, score, label, range_points).select(F.explode(ends).alias("e")).select("e.*")
    return IsotonicRegression(featuresCol=score, labelCol="label", weightCol="weight", predictionCol=to).fit(points)
