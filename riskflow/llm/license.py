"""License scans by diagonal voting, in DataFrame operations alone.

Every pair of neighbouring words of a text is hashed and joined with the places of the templates' pairs. A
match votes for its diagonal: its place in the text less its place in the template. Diagonals of a
template within its slack of each other are one span (words were put in or left out). A span is verified: its pairs,
compared by their words, count as far as they stand in the template's order, the longest run of places that
rise in both; its share is that of the template's pairs.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskflow.llm.common import WORD_PATTERN

#: Diagonals of one span lie at most so far apart, or a word for SLACK_WORDS words of a longer template; base phrases
#: must stand as they are.
SLACK, SLACK_WORDS = 3, 16
#: Share of a template's pairs that makes a label.
LEAST_SHARE = 0.7
#: Templates with at most so many words in all are sent to every task; more are joined by hash.
SENT_WORDS = 1_000_000
# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Public notices and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "this work is licensed under the gnu general public license version": "gpl",
    "released under the mit license": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
_NONE = "\u0000"


def templates(spark: SparkSession, base: dict[str, str], notices: dict[str, str] | DataFrame) -> DataFrame:
    """h, own (the pair), template, tpos, size (pairs of the template), label, base, step: a row for each pair of each
    template, and one without label that marks every text's last word. A template has two words at least; shorter
    ones, which have no pair, are an error, or passed over where they come from a table.
    """
    rows = [(label, phrase, True) for phrase, label in base.items()]
    if isinstance(notices, dict):
        rows += [(label, phrase, False) for phrase, label in notices.items()]
    for _, phrase, _ in rows:
        if len(re.findall(WORD_PATTERN, phrase.lower())) < 2:
            raise ValueError(f"a template has two words at least: {phrase!r}")
    texts = spark.createDataFrame(rows, "label string, text string, base boolean")
    if isinstance(notices, DataFrame):
        texts = texts.unionByName(notices.select("label", "text", F.lit(False).alias("base")).filter("label IS NOT NULL AND text IS NOT NULL").distinct())
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    words = texts.select("label", "base", F.xxhash64("label", "text", "base").alias("template"), F.regexp_extract_all(lowered, F.lit(WORD_PATTERN), F.lit(0)).alias("w"))
    slack = F.when(F.col("base"), 0).otherwise(F.greatest(F.lit(SLACK), F.size("w") / SLACK_WORDS).cast("int"))
    # Diagonals times step: those of a span lie within REACH.
    known = words.filter(F.size("w") > 1).withColumn("step", F.floor(F.lit(REACH) / F.greatest(slack, F.lit(0.5))).cast("long"))
    known = known.withColumn("step", F.when(F.col("base"), F.lit(REACH + 1)).otherwise(F.col("step")))
    pairs = F.zip_with("w", F.slice(F.col("w"), 2, F.size("w") - 1), lambda a, b: F.coalesce(F.concat(a, F.lit(" "), b), F.lit(_NONE)))
    known = known.select("template", "label", "base", "step", (F.size("w") - 1).alias("size"), F.posexplode(pairs).alias("tpos", "own")).filter(F.col("own") != _NONE)
    mark = spark.createDataFrame([(-1, None, False, 1, 1, 0, _NONE)], "template long, label string, base boolean, step long, size int, tpos int, own string")
    return known.unionByName(mark).withColumn("h", F.xxhash64("own"))


#: Span width in steps.
REACH = 1 << 20


def _longest_rising(hits: Column) -> Column:
    """Length of the longest run of hits that rises in place and template place: the least last place of a run of each
    length, hit by hit in order of place."""
    ordered = F.transform(F.array_sort(F.transform(hits, lambda x: F.struct(x.place.alias("place"), (-x.tpos).alias("down")))), lambda x: -x.down)
    none = F.array().cast("array<int>")

    def step(ends: Column, tpos: Column) -> Column:
        at = F.size(F.filter(ends, lambda e: e < tpos))
        return F.concat(F.slice(ends, 1, at), F.array(tpos), F.slice(ends, at + 2, F.greatest(F.size(ends) - at - 1, F.lit(0))))

    return F.when(F.size(hits) == 1, 1).otherwise(F.size(F.aggregate(ordered, none, step)))


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] | DataFrame = NOTICES, sent_words: int = SENT_WORDS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row a row of docs.

    notices: text -> label, or a table with label and text; texts of any length. score is the largest share of a
    template that a span holds in the template's order. A null or empty text has no words, no places, empty
    labels and score 0. Rows that repeat are scanned each for itself; null ids stay.
    """
    known = templates(docs.sparkSession, base, notices)
    if known.limit(sent_words + 1).count() <= sent_words:
        known = F.broadcast(known)
    words = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"),
        F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(WORD_PATTERN), F.lit(0)).alias("words"))
    pairs = F.zip_with("words", F.slice(F.col("words"), 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.coalesce(F.concat(a, F.lit(" "), b), F.lit(_NONE)))
    grams = words.select("doc_id", "uid", F.posexplode_outer(pairs).alias("pos", "gram"))
    grams = grams.select("doc_id", "uid", F.coalesce(F.col("pos") + 1, F.lit(0)).alias("place"), F.coalesce("gram", F.lit(_NONE)).alias("gram"))
    hits = grams.withColumn("h", F.xxhash64("gram")).join(known, "h").filter("gram = own")
    about = ["uid", "doc_id", "template", "size", "label", "base", "step"]
    at = hits.select(*about, (F.col("place") - 1 - F.col("tpos")).cast("long").alias("diagonal"), "tpos").repartition("uid")
    votes = at.groupBy(*about, "diagonal").agg(F.collect_set("tpos").alias("held"))  # no more than the template has pairs
    near = Window.partitionBy("uid", "template").orderBy(F.col("diagonal") * F.col("step")).rangeBetween(0, REACH)
    hit = lambda d: F.transform(d.held, lambda t: F.struct((d.diagonal + t).alias("place"), t.alias("tpos")))
    spans = votes.withColumn("near", F.collect_list(F.struct("diagonal", "held")).over(near))
    spans = spans.withColumn("share", F.when(F.col("label").isNull(), 0.0).otherwise(_longest_rising(F.flatten(F.transform("near", hit))) / F.col("size")))
    place = F.col("base") & (F.col("share") == 1.0)
    named = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  as many as there are labels at most
    return spans.groupBy("uid", "doc_id").agg(
        F.max(F.when(F.col("template") == -1, F.col("diagonal") + 1)).cast("long").alias("n_words"),
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("diagonal"))).cast("long").alias("last_word"),
        named(F.when(place, F.col("label"))).alias("base_labels"),
        named(F.when(place | ~F.col("base") & (F.col("share") >= LEAST_SHARE), F.col("label"))).alias("labels"),
        F.max("share").alias("score"),
    ).drop("uid")
