"""Windowed monitoring aggregates over the scored stream.

Rows are first added up per minute with map-side combine; sliding windows then work on the minute
totals, so a row is never copied into its overlapping windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskflow import schemas as S

MIN_RATE = 0.0001


def per_minute(df: DataFrame, ts: str, keys: list[str] | None = None, **aggs: Column) -> DataFrame:
    """minute (its start) and keys with the given aggregates."""
    grouped = df.groupBy(F.date_trunc("minute", F.col(ts)).alias("minute"), *(keys or []))
    return grouped.agg(*[a.alias(n) for n, a in aggs.items()])


def rate(df: DataFrame, ts: str, keys: list[str] | None = None) -> DataFrame:
    """Events per minute, by optional labels."""
    return per_minute(df, ts, keys, events=F.count("*"))


def _sliding(minutes: DataFrame, length: int, keys: list[str], **sums: Column) -> DataFrame:
    """Windows of `length` minutes, one starting each minute, from minute totals."""
    starts = F.explode(F.expr(f"transform(sequence(0, {length - 1}), i -> minute - make_dt_interval(0, 0, i))"))
    return minutes.withColumn("window_start", starts).groupBy("window_start", *keys).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()])


def share(df: DataFrame, ts: str, condition: Column, length: int = 5) -> DataFrame:
    """Rate of matching events over the rate of all, the latter floored, per sliding window."""
    minutes = per_minute(df, ts, matching=F.count_if(condition), n=F.count("*"))
    seconds = float(length * 60)
    return _sliding(minutes, length, [], matching=F.col("matching"), events=F.col("n")).withColumn(
        "share", (F.col("matching") / seconds) / F.greatest(F.col("events") / seconds, F.lit(MIN_RATE)))


def mean_over(df: DataFrame, ts: str, value: str, length: int = 5) -> DataFrame:
    """Mean value per sliding window, with the same floor on the denominator."""
    minutes = per_minute(df, ts, total=F.sum(value), n=F.count(value))
    seconds = float(length * 60)
    return _sliding(minutes, length, [], total=F.col("total"), events=F.col("n")).select(
        "window_start", "events",
        ((F.col("total") / seconds) / F.greatest(F.col("events") / seconds, F.lit(MIN_RATE))).alias("mean"))


def sliding_rate(df: DataFrame, ts: str, keys: list[str], length: int = 5) -> DataFrame:
    """Events per second per sliding window and label."""
    minutes = rate(df, ts, keys)
    return _sliding(minutes, length, keys, events=F.col("events")).withColumn(
        "per_second", F.col("events") / float(length * 60))


def bucket_index(value: Column, bounds: list[float]) -> Column:
    """Position of the first upper bound the value does not exceed; len(bounds) beyond the last."""
    out = F.when(value <= bounds[0], 0)
    for i, le in enumerate(bounds[1:], start=1):
        out = out.when(value <= le, i)
    return F.when(value.isNotNull(), out.otherwise(len(bounds)))


def histogram(df: DataFrame, ts: str, value: str, bounds: list[float] = S.PROBABILITY_BOUNDS) -> DataFrame:
    """Cumulative count per minute and upper bound, every bound listed."""
    names = [f"_b{i}" for i in range(len(bounds))]
    counts = per_minute(df, ts, **{n: F.count_if(F.col(value) <= le) for n, le in zip(names, bounds)})
    long = counts.unpivot(["minute"], names, "_b", "events")
    le = F.element_at(F.array(*[F.lit(float(b)) for b in bounds]), F.substring("_b", 3, 9).cast("int") + 1)
    return long.select("minute", le.alias("le"), "events")


def histogram_quantile(df: DataFrame, ts: str, value: str, quantiles: list[float],
                       bounds: list[float] = S.DURATION_BOUNDS, length: int = 5) -> DataFrame:
    """Quantiles per sliding window by linear interpolation inside cumulative buckets.

    The lowest bucket starts at 0; a rank beyond the last bound gives the last bound.
    """
    minutes = per_minute(
        df.withColumn("_bucket", bucket_index(F.col(value), bounds)).filter("_bucket IS NOT NULL"),
        ts, ["_bucket"], n=F.count("*"))
    counts = _sliding(minutes, length, ["_bucket"], n=F.col("n"))
    w = Window.partitionBy("window_start").orderBy("_bucket")
    cumulative = counts.select(
        "window_start", "_bucket", "n",
        F.sum("n").over(w).alias("_upto"), F.sum("n").over(Window.partitionBy("window_start")).alias("_total"))
    uppers = F.array(*[F.lit(float(b)) for b in bounds])
    lowers = F.array(*[F.lit(float(b)) for b in [0.0, *bounds[:-1]]])
    upper, lower = F.try_element_at(uppers, F.col("_bucket") + 1), F.try_element_at(lowers, F.col("_bucket") + 1)
    picks = []
    for q in quantiles:
        rank = F.lit(float(q)) * F.col("_total")
        here = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("n") < rank)
        inside = lower + (upper - lower) * ((rank - (F.col("_upto") - F.col("n"))) / F.col("n"))
        picked = F.when(here, F.when(F.col("_bucket") >= len(bounds), F.lit(float(bounds[-1]))).otherwise(inside))
        picks.append(F.max(picked).alias(f"p{round(q * 100)}"))
    return cumulative.groupBy("window_start").agg(F.max("_total").alias("events"), *picks)


def split_by(df: DataFrame, *keys: str) -> DataFrame:
    """Count per label combination over everything."""
    return df.groupBy(*keys).agg(F.count("*").alias("events"))


def funnel(ingested: DataFrame, scored: DataFrame, alerted: DataFrame, ts: str) -> DataFrame:
    """Per minute: how many entered, were scored and were alerted. One aggregation of the tagged union."""
    stages = {"ingested": ingested, "scored": scored, "alerted": alerted}
    tagged = None
    for name, frame in stages.items():
        part = frame.select(F.col(ts).alias("_ts"), F.lit(name).alias("_stage"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return per_minute(tagged, "_ts", **{n: F.count_if(F.col("_stage") == n) for n in stages})


def dead_letters_total(letters: DataFrame, tasks: DataFrame) -> DataFrame:
    """All dead letters: rejected records plus tasks given up."""
    both = letters.select(F.lit(1).alias("x")).unionByName(
        tasks.filter(F.col("status") == "DEAD_LETTER").select(F.lit(1).alias("x")))
    return both.agg(F.coalesce(F.sum("x"), F.lit(0)).cast("long").alias("dead_letters"))
