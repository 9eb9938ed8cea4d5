"""Bounded-space online packing: each partition keeps a few open windows and places pieces best-fit.

When a piece fits none, the fullest window is filled up with a cut of the piece (or emitted as it is
where its gap is at most MAX_PAD), so no window waits for long. What stays open at the end of a
partition is merged with the leftovers of others, again in bounded groups.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from riskflow.llm.bpe import SPLIT, byte_letters, vocabulary
from riskflow.llm.common import materialize

WINDOW = 2048
OPEN = 16
MAX_PAD = 8
END = 1
#: Leftover windows that one merging task takes together.
GROUP = 128

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"


class FastIds:
    """The ids of the tokenizers library as numpy arrays.

    The merges run in tiktoken, whose ranks are the ids of the same vocabulary. Where the two libraries
    class a code point of a text differently, or the file isn't of that form, tokenizers encodes it.
    """

    def __init__(self, content: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        data, letters = json.loads(content), byte_letters()
        vocab = data["model"]["vocab"]
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in data["model"]["merges"]]
        self.plain = merged == sorted(merged) and all(i < merged[0] for t, i in vocab.items() if len(t) == 1)
        self.library = Tokenizer.from_buffer(content)
        added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
        # A pair of bytes merges here exactly if the split keeps them together.
        pairs = [bytes([a, b]) for a in b"a1! " for b in range(256)]
        probe = {bytes([b]): b for b in range(256)} | {p: 256 + i for i, p in enumerate(pairs)}
        self.probe = tiktoken.Encoding("probe", pat_str=SPLIT, mergeable_ranks=probe, special_tokens={})
        self.same: dict[str, bool] = {}

    def agrees(self, char: str) -> bool:
        if char not in self.same:
            joined = lambda p: self.probe.encode_ordinary(p + char)[0] >= 256
            alone = lambda p: len(self.library.pre_tokenizer.pre_tokenize_str(p + char)) == 1
            self.same[char] = all(joined(p) == alone(p) for p in "a1! ")
        return self.same[char]

    def __call__(self, text: str) -> np.ndarray:
        if self.plain and (text.isascii() or all(map(self.agrees, set(text)))):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_fast: dict[int, FastIds] = {}


class _Space:
    """The open windows of one partition; `emit` gets (pieces of a finished window, fill)."""

    def __init__(self, window: int, open_windows: int, max_pad: int):
        self.window, self.most, self.max_pad = window, open_windows, max_pad
        self.open: list[list] = []  # [fill, pieces]

    def place(self, piece: tuple, size: int, split) -> Iterator[list]:
        """Finished windows. split(piece, n) cuts off n ids."""
        while size:
            if size >= self.window:
                head, piece = split(piece, self.window)
                size -= self.window
                yield [self.window, [head]]
                continue
            best = None
            for w in self.open:
                if w[0] + size <= self.window and (best is None or w[0] > best[0]):
                    best = w
            if best is not None:
                best[0] += size
                best[1].append(piece)
                if best[0] == self.window:
                    self.open.remove(best)
                    yield best
                return
            if len(self.open) < self.most:
                self.open.append([size, [piece]])
                return
            fullest = max(self.open, key=lambda w: w[0])
            gap = self.window - fullest[0]
            self.open.remove(fullest)
            if gap > self.max_pad:
                head, piece = split(piece, gap)
                size -= gap
                fullest[0] = self.window
                fullest[1].append(head)
            yield fullest


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, open_windows: int = OPEN, max_pad: int = MAX_PAD) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its tokens and the end id, so an empty or null text is one id. Each id lies in one
    piece, each piece in one sequence of at most `window` ids. Rows that repeat are packed as often as
    they come; a null doc_id stays null. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # the vocabulary file: fixed size

    def split(piece, n):
        doc, start, ids, total = piece
        return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(sent.value)
        if key not in _fast:
            _fast[key] = FastIds(sent.value)
        tokens, space, done = _fast[key], _Space(window, open_windows, max_pad), 0
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def write(made, still_open=False):
            nonlocal done
            at = 0
            for doc, start, ids, total in made[1]:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + done, at, still_open))
                at += len(ids)
            done += 1

        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for i in range(len(names)):
                ids = np.append(tokens(texts[i].as_py() or ""), np.uint32(END))
                for made in space.place((names[i].as_py(), 0, ids, len(ids)), len(ids), split):
                    write(made)
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows.clear()
        for made in space.open:
            write(made, True)
        yield _batch(rows)

    pieces = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES), "pieces")
    return _merged(pieces, window).drop("open")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.bool_()]
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)


def _merged(pieces: DataFrame, window: int) -> DataFrame:
    """Puts leftover windows together, best-fit, in groups of about GROUP windows; pieces aren't cut again."""
    left = pieces.filter("open").groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    groups = max(1, left.count() // GROUP)
    kind = "sequence_id long, into long, shift long"

    def merge(_, frame):
        frame = frame.sort_values(["fill", "sequence_id"], ascending=[False, True])
        bins: list[list[int]] = []  # [fill, id]
        out = []
        for name, fill in zip(frame.sequence_id.tolist(), frame.fill.tolist()):
            best = max((b for b in bins if b[0] + fill <= window), key=lambda b: b[0], default=None)
            if best is None:
                bins.append(best := [0, name])
            out.append((name, best[1], best[0]))
            best[0] += fill
        import pandas as pd

        return pd.DataFrame(out, columns=["sequence_id", "into", "shift"])

    moved = left.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("part")).applyInPandas(merge, kind)
    joined = pieces.filter("open").join(moved, "sequence_id")
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pieces.filter("NOT open").unionByName(
        joined.withColumn("offset", F.col("offset") + F.col("shift")).withColumn("sequence_id", F.col("into")).select(*names))
