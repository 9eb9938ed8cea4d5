"""Byte-level BPE: a priority queue of merge ranks over a doubly linked symbol list; decoding by vocabulary strings.

The vocabulary is a file of the tokenizers library, read on the driver and sent to the tasks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: How many distinct pieces a task remembers, and how long a remembered piece may be; beyond that it starts anew.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64
#: Split of a text before the merges, as the byte-level vocabularies define it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself where printable, else the next letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes one text at a time; equal to the tokenizers library on the same file."""

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        data, letters = json.loads(content), byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        ids = data["model"]["vocab"]
        self.strings = {i: as_bytes(t) for t, i in ids.items()}
        self.first = {letters[t]: i for t, i in ids.items() if len(t) == 1}
        self.ranks: dict[int, int] = {}  # by the two ids, as one number
        self.made: list[int] = []
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[a] << 24 | ids[b]] = rank
            self.made.append(ids[a + b])
        added = sorted(data.get("added_tokens", []), key=lambda t: -len(t["content"]))
        self.added = {t["content"]: t["id"] for t in added}
        self.strings |= {t["id"]: t["content"].encode() for t in added}
        self.marks = regex.compile("(" + "|".join(regex.escape(t["content"]) for t in added) + ")") if added else None
        self.split = regex.compile(SPLIT).findall
        # The library classifies code points by its own Unicode version. Where that differs, it splits.
        self.library = Tokenizer.from_buffer(content).pre_tokenizer
        self.same: dict[str, bool] = {}
        # Texts of usual characters alone are split by the same rule with their classes spelt out, which is faster.
        kinds: dict[int, list[str]] = {0: [], 1: [], 2: [], 3: []}
        for char in filter(self.agrees, map(chr, range(0x250))):
            kinds[next((k for k, p in enumerate("a1!") if len(self.split(p + char)) == 1), 3)].append(re.escape(char))
        letter, digit, other, space = ("".join(kinds[k]) for k in range(4))
        self.unusual = re.compile(f"[^{letter}{digit}{other}{space}]").findall
        self.usual_split = re.compile(
            f" ?[{letter}]+| ?[{digit}]+|'(?:s|t|re|ve|m|ll|d)| ?[{other}]+|[{space}]+(?![{letter}{digit}{other}])|[{space}]+").findall
        self.memory: dict[str, tuple[list[int], str]] = {}

    def agrees(self, char: str) -> bool:
        if char not in self.same:
            probes = [p + char for p in ("a", "1", "!")]
            self.same[char] = all(len(self.library.pre_tokenize_str(p)) == len(self.split(p)) for p in probes)
        return self.same[char]

    def pieces(self, text: str) -> list[str]:
        unusual = set(self.unusual(text))
        if not unusual:
            return self.usual_split(text)
        if all(map(self.agrees, unusual)):
            return self.split(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def merged(self, piece: bytes) -> list[int]:
        """Merges the neighbours of lowest rank first, leftmost among equals, until no pair has a rank."""
        symbol = [self.first[b] for b in piece]
        n = len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank_of, made, pop, push = self.ranks.get, self.made, heapq.heappop, heapq.heappush
        # An entry is the rank and, in the low bits, the place of the left symbol.
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(symbol[i] << 24 | symbol[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            # Stale: one of the two was merged away since, or merged into something longer.
            if symbol[i] < 0 or j < 0 or rank_of(symbol[i] << 24 | symbol[j]) != entry >> 32:
                continue
            left = symbol[i] = made[entry >> 32]
            symbol[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of(left << 24 | symbol[k])) is not None:
                    push(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(symbol[h] << 24 | left)) is not None:
                push(queue, r << 32 | h)
        return [s for s in symbol if s >= 0]

    def look(self, piece: str) -> tuple[list[int], str]:
        """(ids, the ids in decimal joined by commas) of one piece."""
        ids = self.merged(piece.encode("utf-8", "surrogatepass"))
        found = (ids, ",".join(map(str, ids)))
        if len(piece) <= REMEMBERED_CHARS:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[piece] = found
        return found

    def parts(self, text: str) -> list[tuple[list[int], str]]:
        out: list[tuple[list[int], str]] = []
        known = self.memory.get
        for k, run in enumerate(self.marks.split(text) if self.marks and self.marks.search(text) else [text]):
            if k % 2:
                out.append(([self.added[run]], str(self.added[run])))
            else:
                out += [known(p) or self.look(p) for p in self.pieces(run)]
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable([ids for ids, _ in self.parts(text)]))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def codec(content: bytes) -> Codec:
    """One codec for each vocabulary and worker."""
    key = hash(content)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(content)
    return _codecs[key]


def _over(df: DataFrame, content: bytes, schema: str, column: str, work) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(content)  # the vocabulary file: fixed size
    rest = [c for c in df.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value)
        for batch in batches:
            values = batch.column(len(rest))
            made = zip(*(work(c, values[i].as_py()) for i in range(len(values)))) if len(values) else [[]] * len(new)
            arrays = [pa.array(list(v), t) for v, (_, t) in zip(made, new)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], *arrays], [*rest, *[n for n, _ in new]])

    kinds = {"long": pa.int64(), "string": pa.string(), "ids": pa.list_(pa.int32())}
    new = [(part.split()[0], kinds[part.split()[1]]) for part in schema.split(", ")]
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name != column)
    made_schema = ", ".join(f"{n} {'array<int>' if pa.types.is_list(t) else {'int64': 'long'}.get(str(t), str(t))}" for n, t in new)
    return df.select(*[F.col(f"`{c}`") for c in rest], column).mapInArrow(run, kept + made_schema)


def encode(df: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """The other columns and `ids`, the tokens of every whole text; null counts as empty and has no ids."""
    return _over(df, vocabulary(path), "ids ids", column, lambda c, t: (c.encode(t or ""),))


def decode(df: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """The other columns and `text`, the vocabulary strings of the ids joined; null counts as no ids."""
    return _over(df, vocabulary(path), "text string", column, lambda c, ids: (c.decode(ids or []),))


def digest(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: the text encoded, its ids decoded again.

    A null or empty text has no token and the digests of the empty string.
    """

    def work(c: Codec, text: str | None):
        parts = c.parts(text or "")
        ids = list(chain.from_iterable([x for x, _ in parts]))
        listed = ",".join([s for _, s in parts])
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _over(rows, vocabulary(path), "n_tokens long, ids_sha256 string, decoded_sha256 string", "text", work)
