"""Improbable-feature digests: rare byte windows, picked by entropy, in chained Bloom filters.

Every window of 16 bytes has an entropy. Its rank is the smaller the farther that entropy is from what
texts usually have; windows of next to no variety are no features, unless a text has no others. Among each 64
neighbouring windows the rarest (leftmost of equals) gets a vote, and windows with 16 votes (or the most that any window
of the text got, if fewer) are inserted into Bloom filters
of 2,048 bits, 5 bits a feature, a new filter after 160 features. Two digests are alike by the bits their filters
share, less those that chance lets them share, over the most they could share.

Short texts have further chains of every shorter window. Two texts are compared by the finest chains that both
have, so their windows are always of one width and hash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskflow.llm.common import MOST_RANGES, cut_points, mix, range_of

WIDTH = 16
RUN = 64
VOTES = 16
#: Texts under SHORT bytes have few windows to pick from: in a second chain every window of 8 bytes is a feature, under
#: TINY bytes in a third one every window of 4.
SHORT, TINY = 256, 32
USUAL_ENTROPY, LEAST_ENTROPY = 820, 300  # of 1,000
BITS, HASHES, PER_FILTER = 2048, 5, 160
#: Shared bits up to this part of the way from chance to all count as chance.
CHANCE = 0.1
#: Bytes of text that a task gets.
PART_BYTES = 16 << 20
_CHUNK = 1 << 16
_GAP = RUN + WIDTH

_k = np.arange(1, WIDTH + 1)
_ENTROPY_STEP = np.zeros(WIDTH + 1, np.uint32)
_ENTROPY_STEP[1:] = np.round(1000 * (_k * np.log2(_k) - np.where(_k > 1, (_k - 1) * np.log2(np.maximum(1, _k - 1)), 0)))


def entropies(flat: np.ndarray) -> np.ndarray:
    """Entropy of every window of WIDTH bytes, 0 to 1,000.

    The sum of c log c over the byte counts c of a window is summed over its bytes in turn: the c-th byte
    of a value adds what c log c grows by.
    """
    n = len(flat) - WIDTH + 1
    out = np.empty(max(0, n), np.int32)
    most = 1000 * WIDTH * np.log2(WIDTH)
    for a in range(0, n, _CHUNK):
        m = min(_CHUNK, n - a)
        part = flat[a:a + m + WIDTH - 1]
        equal = [None, *[(part[:-d] == part[d:]).view(np.uint8) for d in range(1, WIDTH)]]
        total = np.zeros(m, np.uint32)
        for o in range(1, WIDTH):
            place = np.ones(m, np.uint8)
            for d in range(1, o + 1):
                place += equal[d][o - d:o - d + m]
            total += _ENTROPY_STEP[place]
        out[a:a + m] = 1000 - np.round(1000 * total / most).astype(np.int32)
    return out


def features(texts: list[bytes]) -> list[list[np.ndarray]]:
    """For every text the hashes of its windows, in order, each once: a list of them a chain, from the picked windows
    of WIDTH bytes to the finest. A text without bytes has no chain."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + _GAP)[:-1]])
    flat = np.frombuffer(b"".join([t + bytes(_GAP) for t in texts]), np.uint8)
    long_ones = np.flatnonzero(lengths >= WIDTH)
    count = np.zeros(len(texts), np.int64)
    count[long_ones] = lengths[long_ones] - WIDTH + 1
    inside = np.zeros(len(flat) + 1, np.int32)
    np.add.at(inside, starts[long_ones], 1)
    np.add.at(inside, starts[long_ones] + count[long_ones], -1)
    inside = np.cumsum(inside[:-1]) > 0
    out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] if n else [] for n in lengths]
    if len(long_ones):
        entropy = entropies(flat)
        rank = 1000 - np.abs(entropy - USUAL_ENTROPY)
        within = inside[:len(entropy)]
        live = within & (entropy >= LEAST_ENTROPY)
        owned = np.searchsorted(starts, np.arange(len(entropy)), "right") - 1
        varied = np.bincount(owned[live], minlength=len(texts)) > 0
        live |= within & ~varied[owned]
        key = np.where(live, rank, 4000).astype(np.int64) << 40 | np.arange(len(rank))
        low, width = key, 1
        while width < RUN:
            pad = np.full(width, np.iinfo(np.int64).max)
            low = np.minimum(low, np.concatenate([low[width:], pad]))
            width *= 2
        best = low[inside[:len(low)]]
        best = best[best >> 40 < 4000] & ((1 << 40) - 1)
        votes = np.bincount(best, minlength=len(flat))
        need = np.minimum(VOTES, np.maximum(1, count // 4))
        at = np.flatnonzero(votes)
        owner = np.searchsorted(starts, at, "right") - 1
        most = np.zeros(len(texts), np.int64)
        np.maximum.at(most, owner, votes[at])
        picked = votes[at] >= np.minimum(need, most)[owner]
        at, owner = at[picked], owner[picked]
        words = flat[at[:, None] + np.arange(WIDTH)].copy().view("<u8")
        hashes = mix(words[:, 0] ^ mix(words[:, 1] + np.uint64(0x9E3779B97F4A7C15)))
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i in long_ones:
            out[i] = [_each_once(hashes[cuts[i]:cuts[i + 1]])]
    for i in np.flatnonzero((lengths < SHORT) & (lengths > 0)):
        own = texts[i]
        for w in (8,) if lengths[i] >= TINY else (8, min(4, len(own))):
            values = [int.from_bytes(own[p:p + w], "little") ^ (w << 56) for p in range(len(own) - w + 1)]
            out[i].append(_each_once(mix(np.array(values, np.uint64))))
    return out


def _each_once(x: np.ndarray) -> np.ndarray:
    return x[np.sort(np.unique(x, return_index=True)[1])]


def digest(chains: list[np.ndarray]) -> list[np.ndarray]:
    """The chained filters [filters, bytes] of each chain of a text's features."""
    return [_filters(hashes) for hashes in chains]


def _filters(hashes: np.ndarray) -> np.ndarray:
    n = -(-len(hashes) // PER_FILTER)
    bits = np.zeros((n, BITS), np.uint8)
    which = np.arange(len(hashes)) // PER_FILTER
    for k in range(HASHES):
        bits[which, (hashes >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = 1
    return np.packbits(bits, axis=1)


def likeness(one: list[np.ndarray], two: list[np.ndarray]) -> float:
    """0 to 1: each filter of the shorter chain against its best match in the other, weighed by its bits, in the
    finest chains that both digests have.

    Two digests without features are alike (1), one without and one with are not (0).
    """
    if not one or not two:
        return float(len(one) == len(two))
    finest = min(len(one), len(two)) - 1
    a, b = one[finest], two[finest]
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    words_a, words_b = a.view(np.uint64), b.view(np.uint64)
    own, other = np.bitwise_count(words_a).sum(axis=1).astype(float), np.bitwise_count(words_b).sum(axis=1).astype(float)
    total = 0.0
    for x, n in zip(words_a, own):
        best = 0.0
        for p in range(0, len(words_b), 4096):
            shared = np.bitwise_count(words_b[p:p + 4096] & x).sum(axis=1)
            most, chance = np.minimum(n, other[p:p + 4096]), n * other[p:p + 4096] / BITS
            floor = chance + CHANCE * (most - chance)
            best = max(best, float(np.max((shared - floor) / np.maximum(most - floor, 1e-9))))
        total += n * min(1.0, max(0.0, best))
    return total / own.sum()


def text_form(chains: list[np.ndarray]) -> str:
    """`filters:base64` of each chain, with `;` between them; `0:` for a text without bytes."""
    return ";".join(f"{len(filters)}:" + base64.b64encode(filters.tobytes()).decode() for filters in chains) or "0:"


def from_text(form: str) -> list[np.ndarray]:
    parts = [chain.partition(":") for chain in form.split(";")] if form != "0:" else []
    return [np.frombuffer(base64.b64decode(data), np.uint8).reshape(int(n), BITS // 8) for n, _, data in parts]


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and the fingerprint of every whole text; a null text counts as empty. Equal texts, equal fingerprints."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", fingerprint string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(len(keep)).to_pylist()]
            forms = [text_form(digest(h)) for group in _groups(texts) for h in features(group)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(forms, pa.string())], [*keep, "fingerprint"])

    return docs.select(*keep, F.col("text").alias("_whole_text")).mapInArrow(run, schema)


def _groups(texts: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the following text, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part and order; the last of a part is only there for the row before it."""
    waiting: list[tuple] = []  # (part, doc_id, text, borrowed)
    size = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[2] for r in rows]
        own = [(i, rows[i]) for i in range(len(rows) - 1) if not rows[i][3]]
        changed = [edited(texts[i], texts[i + 1]) for i, _ in own]
        as_bytes = [t.encode("utf-8", "surrogatepass") for t in texts + changed]
        made = [digest(h) for group in _groups(as_bytes) for h in features(group)]
        plain, other = made[:len(texts)], made[len(texts):]
        columns = list(zip(*[
            (r[1], len(texts[i]), hashlib.sha256(as_bytes[len(texts) + n]).hexdigest(), text_form(plain[i]), text_form(other[n]),
             likeness(plain[i], other[n]), likeness(plain[i], plain[i + 1])) for n, (i, r) in enumerate(own)])) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

    for batch in batches:
        for part, doc_id, text, borrowed in zip(*(batch.column(k).to_pylist() for k in range(4))):
            # Several borrowed rows of one id: the first of them is the next document.
            if borrowed and waiting and waiting[-1][3] and waiting[-1][0] == part:
                continue
            waiting.append((part, doc_id, text, borrowed))
            size += len(text)
            if size >= 1 << 20 and len(waiting) > 1:
                yield flush(waiting)
                waiting, size = waiting[-1:], len(waiting[-1][2])
    yield flush(waiting)


def compared(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Every document beside its edited text and the next document: the columns of SCHEMA, one row a row.

    Documents follow each other by doc_id, then text; a null doc_id comes last, and the first follows the
    last. A lone document follows itself. A null text counts as empty, with an empty fingerprint. The ids
    are cut into ranges of about part_bytes of text, MOST_RANGES at most; the first row of a range is also sent to the range before.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    weight = F.octet_length("text")
    total = rows.agg(F.sum(weight)).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small tables too are dealt to all tasks
    cuts = cut_points(rows, "doc_id", min(MOST_RANGES, max(least, -(-total // part_bytes))), weight + 64)
    ranged = rows.withColumn("part", F.coalesce(range_of(F.col("doc_id"), cuts), F.lit(len(cuts) + 1)).cast("int"))
    firsts = {r["part"]: r["low"] for r in ranged.groupBy("part").agg(F.min("doc_id").alias("low")).collect()}  # a row a range
    order = sorted(firsts)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    lends = docs.sparkSession.createDataFrame([(firsts[p], before[p]) for p in order if firsts[p] is not None], "low long, lend int")
    ranged = ranged.join(F.broadcast(lends), F.col("doc_id") == F.col("low"), "left").drop("low")  # a row a range: MOST_RANGES at most
    nulls = [p for p in order if firsts[p] is None]
    lends_null = F.col("doc_id").isNull() & F.lit(bool(nulls))
    target = F.when(lends_null, F.lit(before[nulls[0]] if nulls else None).cast("int")).otherwise(F.col("lend"))
    own = F.struct("part", F.lit(False).alias("borrowed"))
    lent = F.struct(target.alias("part"), F.lit(True).alias("borrowed"))
    dealt = ranged.withColumn("to", F.explode(F.when(target.isNull(), F.array(own)).otherwise(F.array(own, lent))))
    return (
        dealt.select(F.col("to.part").alias("part"), "doc_id", "text", F.col("to.borrowed").alias("borrowed"))
        .repartitionById(len(cuts) + 2, "part").sortWithinPartitions("part", "borrowed", F.col("doc_id").asc_nulls_last(), "text")
        .mapInArrow(_pairs, SCHEMA)
    )
