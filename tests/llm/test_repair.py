"""Conversation repair against search over all edits, and a plain reading of whole tables."""

import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from riskflow.llm import queries, repair

ROWS = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def cheapest(initials, gone, cut):
    """(cost, audit) by shortest paths over (rows taken, roles so far as a state), all edits in letter order."""
    steps = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {(len(initials), s): (0, "") for s in ("", "a")}
    for i in range(len(initials), -1, -1):
        for _ in range(6):
            for s, allowed in steps.items():
                made = "a" if s == "u" else "u"
                options = [best.get((i, s))]
                if (i, made) in best:
                    c, t = best[i, made]
                    options.append((c + 3, "I" + t))
                if i < len(initials):
                    for edit, to, price, ok in (("D", s, 4, True), ("K", initials[i], 3 * cut[i], not gone[i] and initials[i] in allowed and initials[i] != ""),
                                                ("R", made, 3 + 3 * cut[i], not gone[i])):
                        if ok and (i + 1, to) in best:
                            c, t = best[i + 1, to]
                            options.append((c + price, edit + t))
                options = [o for o in options if o]
                if options:
                    best[i, s] = min(options)
    return best[0, ""]


def plain(rows, ids):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)} of damaged rows."""
    out = {}
    for c in ids:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (-(1 << 70) if r[1] is None else r[1], r[2], hashlib.sha256(
            f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in own if r[1] is not None}
        initials = [r[2][:1] for r in own]
        cost, audit = cheapest(initials, [f in "bd" and f != "" for f in faults], [f == "t" for f in faults])
        lines, i, state = [], 0, ""
        for e in audit:
            made = "a" if state == "u" else "u"
            if e == "I":
                state = made
                lines.append({"u": "user", "a": "assistant"}[made] + ":")
                continue
            row, i = own[i], i + 1
            if e == "K":
                state = row[2][0]
                lines.append(f"{row[2]}:{row[3]}")
            elif e == "R":
                state = made
                lines.append({"u": "user", "a": "assistant"}[made] + ":" + row[3])
        assert GRAMMAR.match("".join(x[0] for x in lines))
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(c, t, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def test_automaton_equals_search_over_all_edits():
    automaton = repair.SuffixAutomaton()
    letters = "suaxSUAX-"
    for n in range(6):
        for word in itertools.product(letters, repeat=n):
            if n > 4 and zlib.crc32("".join(word).encode()) % 7:
                continue
            want = cheapest([w.lower() for w in word], [w == "-" for w in word], [w.isupper() for w in word])
            assert automaton.audit("".join(word)) == want, word
    assert len(automaton.costs) < 100
    assert automaton.audit("ua" * 200_000) == (0, "K" * 400_000)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_a_plain_reading_of_the_whole_table(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, path).collect()}
    assert got == plain(damaged(rows), {r[0] for r in rows})


def test_nulls_repeats_odd_roles_long_texts_and_extra_columns(spark):
    rows = [(1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 3, None, None), (1, 9, "assistant", "x" * 3_000_000 + "!"), (None, 1, "tool", "a"),
            (None, None, None, "b."), (2, 5, "", "c."), (2, 5, "", "c."), (2, 6, "system", " \t\n"), (3, -(1 << 62), "user", "q?"), (3, 1 << 62, "assistant", "a"),
            *[(4, t, "user", "same") for t in range(60)], *[(4, 60, "assistant", "é.")] * 30, (5, 1, "sua", "k ")]
    df = spark.createDataFrame(rows, ROWS).withColumns({"audit": F.lit("x"), "key": F.lit(1), "n": F.lit(2), "at": F.lit(3)}).repartition(4)
    other = spark.createDataFrame([(c,) for c in (1, 7)], "conv_id long")
    found = repair.audits(df, other)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(df, found, digest=True).select(
        repair.conv_id(), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got == plain(filled, {r[0] for r in rows} | {7})
    assert got[7] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    turns = repair.repair(df, found).filter("cid = 4 AND NOT no_id").orderBy("position").collect()
    assert [(t.edit, t.role, t.text) for t in turns] == [("K", "user", "same"), ("K", "assistant", "é.")]


def test_empty_table(spark):
    none = spark.createDataFrame([], ROWS)
    found = repair.audits(*repair.damage(none))
    assert found.count() == 0 and repair.repair(none, found, digest=True).count() == 0 and repair.repair(none, found).count() == 0
