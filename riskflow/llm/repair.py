"""Repair of conversation structure at least cost.

Every row of a conversation becomes a letter for its role and fault, the conversation a signature. What the rest
of a conversation costs depends on its suffix and on the state of the role grammar alone, so signatures are read
from the end through an automaton of suffixes: two suffixes are one node if their costs-to-go differ by the same
amount in every state, for then their best edits are the same. Such a node, with the best edit of each
state, is made once and used by all conversations of a task; there are a few dozen however many signatures come.

Rows are sorted by conversation and time twice, first as narrow rows (signature, counts, edits), then with their
texts behind a row that carries the edits. Both times a task walks through its rows and holds, of a conversation,
a letter a row at most. A long conversation stays in one task in both, as its digest is made in order.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SPACE = " \t\n\x0b\x0c\r"
#: A (role, text) of one conversation is dealt to so many parts at least, and to one for so many rows of the table.
LEAST_SALTS, SALT_ROWS = 8, 1_000_000
NULL_TURN = -(1 << 63)

# The grammar (s?(ua)+)? and the costs of edits.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
KEPT = {(START, "s"): AFTER_SYSTEM, (START, "u"): AFTER_USER, (AFTER_SYSTEM, "u"): AFTER_USER,
        (AFTER_USER, "a"): AFTER_ASSISTANT, (AFTER_ASSISTANT, "u"): AFTER_USER}
#: The state and role after an inserted or re-roled row.
MADE = {START: (AFTER_USER, "user"), AFTER_SYSTEM: (AFTER_USER, "user"),
        AFTER_USER: (AFTER_ASSISTANT, "assistant"), AFTER_ASSISTANT: (AFTER_USER, "user")}
ACCEPTED = (START, AFTER_ASSISTANT)
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Letters: the role's initial, in capitals if truncated; x for any other role; - for a row that must go.
MUST_GO = "-"


class SuffixAutomaton:
    """Cost-to-go and best edit of every (suffix node, grammar state); nodes are made when first met.

    A node is the tuple of costs of its states, less the least of them. Edits of one state have different letters, so
    the least letter among the cheapest is the start of the least of the cheapest audits.
    """

    def __init__(self) -> None:
        self.costs: list[tuple[int, ...]] = []
        self.edits: list[tuple[str, ...]] = []
        self._number: dict[tuple[int, ...], int] = {}
        #: (node, letter) -> (arrow, node before the letter, what all costs rise by); an arrow numbers `edits`.
        self._arrows: dict[tuple[int, str], tuple[int, int, int]] = {}
        self.end, _, self.end_arrow = self._make([{"": 0} if s in ACCEPTED else {} for s in MADE])

    def _make(self, options: list[dict[str, int]]) -> tuple[int, int, int]:
        """(node, what was taken off its costs, arrow) of the cheapest of the options and of inserts before them."""
        best = [min(o.values(), default=10**9) for o in options]
        for _ in MADE:  # an insert leads to another state of the same node
            best = [min(b, INSERT + best[MADE[s][0]]) for s, b in enumerate(best)]
        letters = tuple(
            min([e for e, c in o.items() if c == best[s]] + (["I"] if INSERT + best[MADE[s][0]] == best[s] else []))
            for s, o in enumerate(options))
        low = min(best)
        costs = tuple(b - low for b in best)
        if costs not in self._number:
            self._number[costs] = len(self.costs)
            self.costs.append(costs)
        self.edits.append(letters)
        return self._number[costs], low, len(self.edits) - 1

    def before(self, node: int, letter: str) -> tuple[int, int, int]:
        """(arrow, node of letter + suffix, rise in cost), for the node of the suffix."""
        found = self._arrows.get((node, letter))
        if found is None:
            after, options = self.costs[node], []
            extra = TRUNCATED if letter.isupper() else 0
            for s in MADE:
                ways = {"D": DELETE + after[s]}
                if letter != MUST_GO:
                    ways["R"] = REROLE + extra + after[MADE[s][0]]
                    if (s, letter.lower()) in KEPT:
                        ways["K"] = extra + after[KEPT[s, letter.lower()]]
                options.append(ways)
            new, low, arrow = self._make(options)
            found = self._arrows[node, letter] = (arrow, new, low)
        return found

    def audit(self, signature: str) -> tuple[int, str]:
        """(least cost, the ASCII-least of the cheapest audits) of a signature."""
        node, cost, arrows = self.end, 0, array("H", [self.end_arrow])
        for letter in reversed(signature):
            arrow, node, rise = self.before(node, letter)
            cost += rise
            arrows.append(arrow)
        cost += self.costs[node][START]
        state, out, at = START, [], 0
        while True:
            edit = self.edits[arrows[len(signature) - at]][state]
            if not edit:
                return cost, "".join(out)
            out.append(edit)
            if edit in "KDR":
                letter = signature[at]
                at += 1
                if edit == "K":
                    state = KEPT[state, letter.lower()]
                elif edit == "R":
                    state = MADE[state][0]
            else:
                state = MADE[state][0]


def damage(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after damage, conv_id of every row), by crc32 of conv_id:turn mod 20: 0 drops the row, 1 empties its text,
    2 takes its `.`, `!` and `?` away, 3 repeats it, 4 makes its role user. A null role, text, or part of the key is a space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        part("role").alias("role"), part("text").alias("text"), how.alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("how") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    left = rows.filter("how <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy"))
    return left.drop("_copy"), rows.select("conv_id")


def _keyed(rows: DataFrame) -> DataFrame:
    """no_id, cid: the conversation without nulls; at: the turn, null first; key: digest of role and text."""
    part = lambda c: F.coalesce(F.col(c), F.lit(" "))
    role, text = part("role"), part("text")
    return rows.select(
        F.col("conv_id").isNull().alias("no_id"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("cid"),
        F.coalesce(F.col("turn").cast("long"), F.lit(NULL_TURN)).alias("at"), role.alias("role"), text.alias("text"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("key"))


def _repeats(rows: DataFrame) -> DataFrame:
    """rows (one a conversation, turn and key, with its number n) plus `repeat`: the key was there at an earlier turn.

    First turns are found by part of a key and then over its parts, and go back to keys with several turns only.
    """
    total = rows.count()
    salts = max(LEAST_SALTS, -(-total // SALT_ROWS))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("at", "key"), F.lit(salts)).cast("int"))
    first = (
        salted.groupBy("no_id", "cid", "key", "salt").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("turns"))
        .groupBy("no_id", "cid", "key").agg(F.min("low").alias("low"), F.sum("turns").alias("turns"), F.collect_set("salt").alias("salts"))
        .filter("turns > 1").select("no_id", "cid", "key", "low", F.explode("salts").alias("salt"))
    )
    joined = salted.join(first, ["no_id", "cid", "key", "salt"], "left")
    return joined.withColumn("repeat", F.coalesce(F.col("at") > F.col("low"), F.lit(False)))


AUDITS = ("no_id boolean, cid long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, n_rows long")
_KINDS = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def audits(rows: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """A row a conversation: gaps, faults by kind, illegal pairs of roles, the least cost of a repair and its audit.

    rows: conv_id, turn, role, text; other columns are passed over. also: further conv_ids that come back, with
    zeros where they have no rows. A null role or text counts as a space; a null conv_id is a conversation of its
    own (no_id). Rows stand by turn, nulls first; rows of one turn by role and digest, so equal rows are neighbours.
    The first fault of a row counts: blank (white space only), duplicate (role and text stood earlier), truncated
    (the last character that is no white space is not one of .!?). An empty table gives an empty result.
    """
    keyed = _keyed(rows)
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    narrow = keyed.select(
        "no_id", "cid", "at", "key", initial.alias("initial"), (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), F.substring("role", 1, 64).alias("role"))
    folded = narrow.groupBy("no_id", "cid", "at", "key").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("initial", "blank", "cut", "role")])
    columns = ["no_id", "cid", "at", "n", "initial", "blank", "cut", "repeat"]
    marked = _repeats(folded).select(*columns, "role", "key")
    if also is not None:
        ids = also.select(F.col("conv_id").isNull().alias("no_id"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("cid")).distinct()
        marked = marked.unionByName(ids.withColumn("n", F.lit(0).cast("long")), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, conversation, done = SuffixAutomaton(), None, []
        letters: list[str] = []
        low = high = last_turn = None
        turns = blank = duplicate = truncated = illegal = 0
        before: str | None = None

        def close() -> None:
            if conversation is None:
                return
            signature = "".join(letters)
            cost, audit = automaton.audit(signature)
            gaps = min(high - low + 1 - turns, (1 << 63) - 1) if turns else 0
            done.append((*conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, len(signature)))

        for batch in batches:
            for no_id, cid, at, n, initial, is_blank, is_cut, repeat in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if (no_id, cid) != conversation:
                    close()
                    conversation, letters, before = (no_id, cid), [], None
                    low = high = last_turn = None
                    turns = blank = duplicate = truncated = illegal = 0
                if not n:
                    continue
                if at != NULL_TURN:
                    low, high = at if low is None else low, at
                    turns += at != last_turn
                    last_turn = at
                illegal += (before is not None and before + initial not in LEGAL) + (n - 1) * (2 * initial not in LEGAL)
                before = initial
                if is_blank:
                    blank += n
                    letters.append(MUST_GO * n)
                    continue
                duplicate += n - (not repeat)
                if not repeat:
                    truncated += is_cut
                    letter = initial if initial in "sua" and initial else "x"
                    letters.append(letter.upper() if is_cut else letter)
                letters.append(MUST_GO * (n - (not repeat)))
            if len(done) >= 1000:
                yield _batch(done, AUDITS)
                done.clear()
        close()
        yield _batch(done, AUDITS)

    dealt = marked.repartition("no_id", "cid").sortWithinPartitions("no_id", "cid", "at", "role", "key").select(*columns)
    return dealt.mapInArrow(run, AUDITS)


TURNS = "no_id boolean, cid long, position long, edit string, role string, text string"
DIGESTS = AUDITS + ", repaired_sha256 string"


def repair(rows: DataFrame, found: DataFrame, digest: bool = False) -> DataFrame:
    """The repaired conversations: a row (position from 0, edit, role, text) a turn, deleted rows left out; or, with
    `digest`, the rows of `found` with the sha256 of their turns as role:text joined by newlines.

    rows: as given to audits; found: what it returned for them.
    """
    mark = found.select("no_id", "cid", F.lit(False).alias("is_row"), F.struct(*found.columns).alias("head"))
    body = _keyed(rows).withColumn("is_row", F.lit(True)).withColumn("order_role", F.substring("role", 1, 64))
    columns = ["no_id", "cid", "is_row", "role", "text", "head"]
    dealt = body.unionByName(mark, allowMissingColumns=True).repartition("no_id", "cid").sortWithinPartitions(
        "no_id", "cid", "is_row", "at", "order_role", "key").select(*columns)
    schema = DIGESTS if digest else TURNS
    names = [f.split()[0] for f in AUDITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, audit, at, state, position = None, "", 0, START, 0
        sha, done, size = hashlib.sha256(), [], 0

        def turn(edit: str, role: str, text: str) -> None:
            nonlocal position, size
            if digest:
                sha.update(("\n" if position else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            else:
                done.append((head["no_id"], head["cid"], position, edit, role, text))
                size += len(text)
            position += 1

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state, role = MADE[state]
                turn("I", role, "")
                at += 1

        def close() -> None:
            if head is not None:
                inserts()
                if digest:
                    done.append((*(head[n] for n in names), sha.hexdigest()))

        for batch in batches:
            is_row = batch.column(2).to_pylist()
            roles, texts, heads = batch.column(3).to_pylist(), batch.column(4), batch.column(5)
            for k, there in enumerate(is_row):
                if not there:
                    close()
                    head = heads[k].as_py()
                    audit, at, state, position, sha = head["audit"], 0, START, 0, hashlib.sha256()
                    continue
                inserts()
                edit = audit[at]
                at += 1
                if edit == "K":
                    state = KEPT[state, roles[k][0]]
                    turn("K", roles[k], texts[k].as_py())
                elif edit == "R":
                    state, role = MADE[state]
                    turn("R", role, texts[k].as_py())
                if size > 1 << 22:
                    yield _batch(done, schema)
                    done.clear()
                    size = 0
            if len(done) >= 1000:
                yield _batch(done, schema)
                done.clear()
                size = 0
        close()
        yield _batch(done, schema)

    return dealt.mapInArrow(run, schema)


def conv_id() -> Column:
    """The conversation's id as it was given."""
    return F.when(~F.col("no_id"), F.col("cid")).alias("conv_id")
