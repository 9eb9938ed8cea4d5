"""The corpus pipeline: toxic documents go, poor ones go, one of each near-duplicate group stays, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskflow.llm import jaccard, packing, quality, toxicity
from riskflow.llm.common import read, remove, scratch
from riskflow.session import shared_dir

#: A document whose probability of good quality is below this goes.
LEAST_QUALITY = 0.5

#: Two classifiers fitted on the labels and posteriors over hash values: no SQL says the same.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold of their language; every column stays."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, tuple(docs.columns))
    return scored.filter(F.col("score") < model.threshold(F.col("lang"))).select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives at least LEAST_QUALITY; every column stays."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, tuple(docs.columns)).filter(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_poor),
    ("ngram_jaccard", drop_near_duplicates),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents. A stage's working tables go when its result is written, and that when the next
    one's is; the input and the working tables of the last stage stay, as its rows are read from them."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if last:
            remove(spark, [last])
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
