"""URL filters by a sort-merge range join, in DataFrame operations alone.

A rule (host, path) is the interval of all keys that begin with its reversed host labels, a zero byte and its path.
A page has one such key for each label depth that rules have. Rules and keys are sorted together; a
sweep meets a rule's start, its end, and the keys between. Intervals are nested or apart, so the stack of
active rules is known by its top, and below each rule lies the next longer one that holds it:
after a start the top is that rule, after an end the rule beneath. The page's rule is the longest top of its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskflow.llm.common import materialize

DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null and for no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit(".\u0000"), path).cast("binary")


def _events(rules: DataFrame) -> DataFrame:
    """key, place, top: two rows for each distinct rule; top is what is active after it."""
    slash = F.instr("rule", "/")
    parts = rules.select("rule", "verdict").filter(slash > 0).groupBy("rule").agg(F.min("verdict").alias("verdict"))
    host = F.translate(F.expr("left(rule, instr(rule, '/') - 1)"), _UPPER, _LOWER)
    keyed = parts.select("rule", "verdict", host.alias("host"), F.expr("substring(rule, instr(rule, '/'))").alias("path"))
    keyed = keyed.withColumn("start", _key(_labels(F.col("host")), F.col("path")))
    # The rule beneath is the longest other rule of the host whose path this one's path begins with.
    above = keyed.select("host", F.col("path").alias("own"), F.explode(F.sequence(F.lit(1), F.length("path"))).alias("n"))
    above = above.filter(F.col("n") < F.length("own")).select("host", "own", F.expr("left(own, n)").alias("path"))
    top = F.struct(F.length("rule").alias("size"), "rule", "verdict")
    beneath = above.join(keyed, ["host", "path"]).groupBy("host", F.col("own").alias("path")).agg(F.max(top).alias("beneath"))
    both = keyed.join(beneath, ["host", "path"], "left")
    none = F.struct(F.lit(0).alias("size"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    begin = both.select(F.col("start").alias("key"), F.lit(1).alias("place"), F.length("start").alias("length"), top.alias("top"))
    # 0xFF is in no UTF-8 text: start and 0xFF is above every key that begins with start.
    end = both.select(F.concat("start", F.lit(b"\xff")).alias("key"), F.lit(0).alias("place"), (-F.length("start")).alias("length"), F.coalesce("beneath", none).alias("top"))
    return begin.union(end)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url), by rules(rule, verdict).

    A rule is host/path; it fits its host and all subdomains of it where the url's path starts with the rule's path.
    The longest rule that fits wins, the default verdict stands where none does. Of a rule with two
    verdicts the smaller counts; rules without a slash and null rules are no rules. Rows of pages stay
    as they are, repeated or with null ids; null urls have empty host and path.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    events = materialize(_events(rules), "url-rules")
    depths = sorted(r[0] for r in events.filter("place = 1").select(
        (F.size(F.split(F.substring_index(F.col("key").cast("string"), "\u0000", 1), r"\.", -1)) - 1).alias("d")).distinct().collect())  # label depths: 127 at most
    levels = F.array(*[F.lit(d) for d in depths]) if depths else F.expr("array(1)")
    labels = _labels(F.col("host"))
    rows = urls.withColumn("uid", F.monotonically_increasing_id()).withColumn(
        "depth", F.explode(F.filter(levels, lambda d: (d <= F.size(labels)) | (d == levels[0]))))
    keys = rows.select(
        _key(F.slice(labels, 1, F.col("depth")), F.col("path")).alias("key"), F.lit(2).alias("place"), F.lit(0).alias("length"),
        F.lit(None).cast(events.schema["top"].dataType).alias("top"), "uid", "page_id", "host", "path")
    marks = events.select("key", "place", "length", "top", *[F.lit(None).cast(keys.schema[c].dataType).alias(c) for c in ("uid", "page_id", "host", "path")])
    # Equal keys are split by the row's number, so a common host fills as many ranges as it needs.
    order = ["key", "place", "length", "uid"]
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = materialize(
        keys.union(marks).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "url-sweep")
    # What is open when a range begins: the last event of the ranges before it. One row a range.
    last = sorted_rows.groupBy("part").agg(F.max_by("top", F.when(F.col("top").isNotNull(), F.struct("key", "place", "length"))).alias("last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("part", F.last("last", True).over(before).alias("open"))
    sweep = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = sorted_rows.withColumn("seen", F.last("top", True).over(sweep)).filter("uid IS NOT NULL")
    topped = swept.join(F.broadcast(carried), "part", "left").withColumn("best", F.coalesce("seen", "open"))
    best = topped.groupBy("uid").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("best").alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
