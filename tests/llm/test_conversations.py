import hashlib
import re
import sys
import zlib
from functools import lru_cache

import pytest

from lotlens.llm import conversations, queries

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
sys.setrecursionlimit(100_000)
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """Every conversation's rows after damage, in order of turn."""
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        held += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(h, key=lambda r: (r[0] is not None, r[0] or 0)) for c, h in out.items()}


def brute(rows):
    """One conversation's result: all edit sequences, by plain recursion over the grammar's words."""
    turns = [r[0] for r in rows if r[0] is not None]
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    def fits(initials):  # may it become a word of the grammar?
        return any(GRAMMAR.fullmatch(initials + more) for more in ("", "a", "ua"))

    def short(initials):  # what decides how it may go on
        return "" if not initials else "s" if initials == "s" else initials[-1]

    @lru_cache(None)
    def best(i, state, inserted):
        word = {"": "", "s": "s", "u": "u", "a": "ua"}[state]
        found = []
        if i == len(rows) and GRAMMAR.fullmatch(word):
            found.append((0, "", ()))
        if inserted < 4:
            for role in ("user", "assistant"):
                if fits(word + role[0]):
                    cost, audit, out = best(i, short(word + role[0]), inserted + 1)
                    found.append((cost + 2, "I" + audit, ((role, ""), *out)))
        if i < len(rows):
            cost, audit, out = best(i + 1, state, 0)
            found.append((cost + 3, "D" + audit, out))
            _, role, text = rows[i]
            if faults[i] not in ("b", "d"):
                for edit, new, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if new[:1] in ("s", "u", "a") and fits(word + new[:1]):
                        cost, audit, out = best(i + 1, short(word + new[:1]), 0)
                        found.append((cost + price + (faults[i] == "t"), edit + audit, ((new, text), *out)))
        return min(found, default=(10**9, "~", ()))

    cost, audit, out = best(0, "", 0)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    said = "\n".join(f"{r}:{t}" for r, t in out).encode()
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(said).hexdigest())


def same(found, rows):
    got = {r[0]: tuple(r)[1:] for r in found}
    assert len(got) == len(found)
    want = {c: brute(h) for c, h in damaged(rows).items()}
    assert got == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.op11_conversations(spark, path).select(COLUMNS).collect(), rows)


@pytest.mark.parametrize("segment_rows", [1, 3, 2048])
def test_edges_and_long_conversations(spark, segment_rows):
    long = [(7, t, "user" if t % 3 else "assistant", f"text {t % 40}" + "." * (t % 2)) for t in range(200)]
    rows = [
        (1, None, None, None, 0), (1, None, "user", "Hello.", 0), (2, 5, "tool", "x.", 0), (2, 9, "", "y!", 0), (None, 1, "system", "Be kind.", 0),
        (None, 2, "user", "Why?", 0), (3, 1, "assistant", "", 0), (4, 1, "system", "a.", 0), (4, 2, "system", "b.", 0), (4, 3, "assistant", "c", 0),
        (5, 1, "user", "z" * 300_000, 0), (5, 2, "assistant", "end.", 0), (6, None, "user", "same.", 0), (6, None, "user", "same.", 0),
        *((*r, 0) for r in long),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk int").repartition(5)
    found = conversations.repair(conversations.damage(table), segment_rows).select(COLUMNS).collect()
    same(found, [r[:4] for r in rows])


def test_hot_conversation_is_cut(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t} words." if t % 5 else "same words.") for t in range(600)] + [(c, 0, "user", "a.") for c in range(2, 40)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    same(conversations.repair(conversations.damage(table), 64).select(COLUMNS).collect(), rows)
    largest = conversations._segments(conversations.damage(table), 64).selectExpr("max(size(turns)) AS n").first().n
    assert largest <= 64


def test_repaired_turns(spark):
    path = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{path}/conversations.parquet")
    fixed = {}
    for r in conversations.repaired_turns(conversations.damage(table)).orderBy("conv_id", "part", "chunk", "at").collect():
        fixed.setdefault(r.conv_id, []).append((r.role, r.text))
    for r in queries.op11_conversations(spark, path).collect():
        turns = fixed.get(r.conv_id, [])
        assert GRAMMAR.fullmatch("".join(role[0] for role, _ in turns))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest() == r.repaired_sha256


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damage(table)).collect() == []
