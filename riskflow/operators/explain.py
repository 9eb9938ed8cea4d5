"""Ranking of per-row feature contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def top_contributions(contributions: Column, k: int = 5) -> Column:
    """The k entries largest in absolute contribution; equal ones keep feature order.

    Works inside the row: no shuffle.
    """
    ranked = F.array_sort(
        F.transform(contributions, lambda x, i: F.struct((-F.abs(x.contribution)).alias("_by"), i.alias("_i"), x.alias("x"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: r.x)


def as_contributions(names: list[str], values: list[Column], contributions: list[Column]) -> Column:
    """array<feature_name, feature_value, contribution, direction> from parallel columns."""
    return F.array(*[
        F.struct(
            F.lit(n).alias("feature_name"), v.cast("double").alias("feature_value"), c.cast("double").alias("contribution"),
            F.when(c >= 0, "INCREASED_FRAUD_RISK").otherwise("DECREASED_FRAUD_RISK").alias("direction"),
        )
        for n, v, c in zip(names, values, contributions)
    ])


def long_contributions(df: DataFrame, k: int = 5) -> DataFrame:
    """One row per transaction and rank."""
    return df.select(
        "transaction_id", F.posexplode(top_contributions(F.col("contributions"), k)).alias("_i", "_c")
    ).select("transaction_id", (F.col("_i") + 1).alias("rank"), "_c.*")
