"""Conversation structure repair: cost-to-go over turns and grammar states, then a forward walk.

A repaired conversation's role initials follow ``(s?(ua)+)?``.  States of that grammar: 0 nothing yet,
1 after the system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3 may end.

Conversations are cut into segments of bounded size.  A segment's effect on the cost-to-go is a 4 x 4
matrix over (min, +), and its walk maps an entry state to an exit state, so a conversation of any length is
solved by composing segments; most conversations are one segment and are solved where they stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

SEGMENT_ROWS = 2048
SEGMENT_CHARS = 1 << 20
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
_WHITE = " \t\n\x0b\x0c\r"
_FAR = 1 << 40
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_WANTED = (2, 2, 3, 2)  # the state after the one role that may be added in each state
_ADDED = ("user", "user", "assistant", "user")
_END = (0, 2 * INSERT, INSERT, 0)  # cost-to-go after the last turn
_LEGAL = {"su", "ua", "au"}
_SEGMENT = "conv_id {id}, part int, chunk int, open boolean, turns array<long>, roles array<string>, texts array<string>"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` after one fault per row, chosen by crc32(``conv_id:turn``) % 20, nulls as one space.

    0 drops the row (``live`` is then false), 1 empties the text, 2 removes its ``.!?``, 3 repeats the row, 4 sets
    the role user.  Columns: conv_id, turn, role, text, live.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(F.col("_fault") == 1, F.lit("")).when(F.col("_fault") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    return (
        conversations.select("conv_id", "turn", said("role").alias("_role"), said("text").alias("_text"), fault.alias("_fault"))
        .withColumn("_copy", F.explode(F.expr("if(_fault = 3, array(0, 1), array(0))")))
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_fault") == 4, F.lit("user")).otherwise(F.col("_role")).alias("role"),
            text.alias("text"),
            (F.col("_fault") != 0).alias("live"),
        )
    )


def _segments(rows: DataFrame, segment_rows: int) -> DataFrame:
    """Bounded runs of turns, in order of (part, chunk); ``open`` where others of the same conversation may exist.

    Rows are dealt by ranges of (conv_id, turn, ...), so a large conversation lies in many tasks.  Only the
    first and last conversation of a task can go on in another one.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    live = F.col("live") if "live" in rows.columns else F.lit(True)
    order = ["conv_id", "turn", "role", "_hash", "_row"]
    dealt = (
        rows.select(
            "conv_id",
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit(" ")).alias("role"),
            F.coalesce("text", F.lit(" ")).alias("text"),
            live.alias("live"),
        )
        .withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, first = TaskContext.get().partitionId(), 0, True
        conv, held, size, cut = None, None, 0, False
        done: list[tuple] = []

        def flush(open_: bool) -> None:
            nonlocal chunk, held, size
            turns, roles, texts = held
            done.append((conv, part, chunk, open_, turns, roles, texts))
            chunk, held, size = chunk + 1, ([], [], []), 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*done), schema)], schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                texts = pa.list_(pa.string())
                schema = pa.schema(
                    [("conv_id", batch.schema.field("conv_id").type), ("part", pa.int32()), ("chunk", pa.int32()),
                     ("open", pa.bool_()), ("turns", pa.list_(pa.int64())), ("roles", texts), ("texts", texts)]
                )
            for c, turn, role, text, alive in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "live"))):
                if held is None:
                    conv, held = c, ([], [], [])
                elif c != conv:
                    flush(first or cut)
                    conv, first, cut = c, False, False
                elif len(held[0]) >= segment_rows or size > SEGMENT_CHARS:
                    flush(True)
                    cut = True
                if alive:
                    for column, value in zip(held, (turn, role, text)):
                        column.append(value)
                    size += len(text)
            if len(done) >= 64:
                yield packed()
                done = []
        if held is not None:
            flush(True)
        if done:
            yield packed()

    return dealt.drop("_hash", "_row").mapInArrow(pack, _SEGMENT.format(id=kind))


def _stripped(text: str) -> str:
    return text.strip(_WHITE)


def _kinds(roles: list[str], texts: list[str], firsts: set[int]) -> tuple[list[tuple], dict[str, int]]:
    """(initial, must go, added cost) of each turn, and the counts of faults; ``firsts``: positions not seen earlier."""
    kinds, counts = [], dict.fromkeys(_COUNTS, 0)
    before = None
    for at, (role, text) in enumerate(zip(roles, texts)):
        body, initial = _stripped(text), role[:1]
        if not body:
            counts["blank"] += 1
            kinds.append((initial, True, 0))
        elif at not in firsts:
            counts["duplicate"] += 1
            kinds.append((initial, True, 0))
        elif body[-1] not in ".!?":
            counts["truncated"] += 1
            kinds.append((initial, False, TRUNCATED))
        else:
            kinds.append((initial, False, 0))
        if before is not None and before + initial not in _LEGAL:
            counts["illegal"] += 1
        before = initial
    return kinds, counts


def _first_seen(roles: list[str], texts: list[str]) -> set[int]:
    seen: dict[tuple[str, str], int] = {}
    for at, key in enumerate(zip(roles, texts)):
        seen.setdefault(key, at)
    return set(seen.values())


def _togo_before(kind: tuple, after: tuple) -> tuple:
    """Cost-to-go before a turn, in each state, from that after it."""
    initial, must, more = kind
    best = [DELETE + c for c in after]
    if not must:
        for state in range(4):
            kept = _STEP.get((state, initial))
            if kept is not None:
                best[state] = min(best[state], more + after[kept])
            best[state] = min(best[state], REROLE + more + after[_WANTED[state]])
    two, three = min(best[2], INSERT + best[3]), min(best[3], INSERT + best[2])
    return (min(best[0], INSERT + two), min(best[1], INSERT + two), two, three)


def _togo(kinds: list[tuple], end: tuple) -> list[tuple]:
    togo = [end]
    for kind in reversed(kinds):
        togo.append(_togo_before(kind, togo[-1]))
    return togo[::-1]


def _walk(kinds: list[tuple], togo: list[tuple], state: int, last: bool) -> tuple[str, list[tuple[int, str]], int]:
    """Edits' initials, (turn or -1, role given or '') of each turn that the repair has, and the state reached.

    Of the transitions that keep to the cost-to-go the ASCII-least edit is taken: D, I, K, R.
    """
    edits, turns, at = [], [], 0
    while at < len(kinds) or last and togo[at][state] > 0:
        cost = togo[at][state]
        initial, must, more = kinds[at] if at < len(kinds) else ("", True, 0)
        if at < len(kinds) and DELETE + togo[at + 1][state] == cost:
            edits.append("D")
            at += 1
        elif INSERT + togo[at][_WANTED[state]] == cost:
            edits.append("I")
            turns.append((-1, _ADDED[state]))
            state = _WANTED[state]
        elif (kept := _STEP.get((state, initial))) is not None and not must and more + togo[at + 1][kept] == cost:
            edits.append("K")
            turns.append((at, ""))
            state, at = kept, at + 1
        else:
            edits.append("R")
            turns.append((at, _ADDED[state]))
            state, at = _WANTED[state], at + 1
    return "".join(edits), turns, state


def _matrix(kinds: list[tuple]) -> list[int]:
    """Least cost from each state before the turns to each state right after them, row by row."""
    ends = [_togo(kinds, tuple(0 if t == s else _FAR for t in range(4)))[0] for s in range(4)]
    return [min(ends[t][s], _FAR) for s in range(4) for t in range(4)]


def _turns_of(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


_RESULT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE = "conv_id {id}, part int, chunk int, audit string, roles array<string>, texts array<string>"
_TOTALS = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _rebuilt(edits_turns: list[tuple[int, str]], roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    return (
        [given or roles[at] for at, given in edits_turns],
        ["" if at < 0 else texts[at] for at, _ in edits_turns],
    )


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _schema(conv: pa.DataType, **more: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", conv), *more.items()])


_LONGS = {c: pa.int64() for c in ("gaps", *_COUNTS, "cost")}
_TEXTS = pa.list_(pa.string())


def _solve_whole(segments: DataFrame, kind: str) -> DataFrame:
    """Totals and pieces of the conversations that are one segment: one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv = batch.schema.field("conv_id").type
            schema = _schema(conv, part=pa.int32(), chunk=pa.int32(), audit=pa.string(), roles=_TEXTS, texts=_TEXTS, **_LONGS)
            out = []
            for row in batch.to_pylist():
                kinds, counts = _kinds(row["roles"], row["texts"], _first_seen(row["roles"], row["texts"]))
                togo = _togo(kinds, _END)
                audit, turns, _ = _walk(kinds, togo, 0, True)
                low, high, different = _turns_of(row["turns"])
                gaps = high - low + 1 - different if different else 0
                roles, texts = _rebuilt(turns, row["roles"], row["texts"])
                out.append((row["conv_id"], row["part"], row["chunk"], audit, roles, texts, gaps, *counts.values(), togo[0][0]))
            yield _columns(out, schema)

    return segments.mapInArrow(run, f"{_PIECE.format(id=kind)}, {_TOTALS.format(id=kind).split(', ', 1)[1]}")


def _firsts(segments: DataFrame) -> DataFrame:
    """(part, chunk, firsts): positions of the turns whose role and text no earlier turn of the conversation has."""
    turn = segments.select("conv_id", "part", "chunk", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "turn"))
    place = F.struct("part", "chunk", "at")
    first = turn.groupBy("conv_id", F.col("turn.roles").alias("role"), F.sha2("turn.texts", 256).alias("text")).agg(F.min(place).alias("first"))
    return first.groupBy("first.part", "first.chunk").agg(F.collect_list("first.at").alias("firsts"))


def _solve_open(segments: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(totals, pieces) of conversations that may have several segments."""
    known = materialise(segments.join(_firsts(segments), ["part", "chunk"], "left"), "conversation-open")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = _schema(
                batch.schema.field("conv_id").type, part=pa.int32(), chunk=pa.int32(), matrix=pa.list_(pa.int64()), first=pa.string(), last=pa.string(),
                low=pa.int64(), high=pa.int64(), different=pa.int64(), **{c: pa.int64() for c in _COUNTS},
            )
            out = []
            for row in batch.to_pylist():
                kinds, counts = _kinds(row["roles"], row["texts"], set(row["firsts"] or ()))
                ends = (kinds[0][0], kinds[-1][0]) if kinds else (None, None)
                out.append((row["conv_id"], row["part"], row["chunk"], _matrix(kinds), *ends, *_turns_of(row["turns"]), *counts.values()))
            yield _columns(out, schema)

    sums = known.select("conv_id", "part", "chunk", "turns", "roles", "texts", "firsts").mapInArrow(
        summarise,
        f"conv_id {kind}, part int, chunk int, matrix array<long>, first string, last string, low long, high long, different long, "
        + ", ".join(f"{c} long" for c in _COUNTS),
    )

    def backward(table: pa.Table) -> pa.Table:
        """Cost-to-go after each segment; the totals stand in the first one."""
        rows = table.sort_by([("part", "ascending"), ("chunk", "ascending")]).to_pylist()
        after = _END
        ends = []
        for row in reversed(rows):
            ends.append(after)
            after = tuple(min(row["matrix"][4 * s + t] + after[t] for t in range(4)) for s in range(4))
        totals = dict.fromkeys(_COUNTS, 0)
        initial = low = high = None
        different = 0
        for row in rows:
            for c in _COUNTS:
                totals[c] += row[c]
            if row["first"] is not None:
                totals["illegal"] += initial is not None and initial + row["first"] not in _LEGAL
                initial = row["last"]
            if row["low"] is not None:
                low = row["low"] if low is None else low
                different += row["different"] - (high == row["low"])
                high = row["high"]
        whole = (high - low + 1 - different if different else 0, *totals.values(), after[0])
        schema = _schema(table.schema.field("conv_id").type, part=pa.int32(), chunk=pa.int32(), after=pa.list_(pa.int64()), head=pa.bool_(), **_LONGS)
        out = [(r["conv_id"], r["part"], r["chunk"], list(e), k == 0, *whole) for k, (r, e) in enumerate(zip(rows, reversed(ends)))]
        return pa.Table.from_batches([_columns(out, schema)])

    ended = sums.groupBy("conv_id").applyInArrow(backward, f"conv_id {kind}, part int, chunk int, after array<long>, head boolean, {_TOTALS.format(id=kind).split(', ', 1)[1]}")
    ended = materialise(ended, "conversation-ends")
    timed = materialise(known.join(ended.select("part", "chunk", "after"), ["part", "chunk"]), "conversation-timed")

    def solved(row: dict) -> tuple[list[tuple], list[tuple]]:
        kinds, _ = _kinds(row["roles"], row["texts"], set(row["firsts"] or ()))
        return kinds, _togo(kinds, tuple(row["after"]))

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = _schema(batch.schema.field("conv_id").type, part=pa.int32(), chunk=pa.int32(), exits=pa.list_(pa.int32()))
            out = []
            for row in batch.to_pylist():
                kinds, togo = solved(row)
                out.append((row["conv_id"], row["part"], row["chunk"], [_walk(kinds, togo, s, False)[2] for s in range(4)]))
            yield _columns(out, schema)

    def forward(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("part", "ascending"), ("chunk", "ascending")]).to_pylist()
        state, out = 0, []
        for k, row in enumerate(rows):
            out.append((row["conv_id"], row["part"], row["chunk"], state, k + 1 == len(rows)))
            state = row["exits"][state]
        schema = _schema(table.schema.field("conv_id").type, part=pa.int32(), chunk=pa.int32(), entry=pa.int32(), last=pa.bool_())
        return pa.Table.from_batches([_columns(out, schema)])

    fields = ["conv_id", "part", "chunk", "roles", "texts", "firsts", "after"]
    mapped = timed.select(fields).mapInArrow(exits, f"conv_id {kind}, part int, chunk int, exits array<int>")
    entries = mapped.groupBy("conv_id").applyInArrow(forward, f"conv_id {kind}, part int, chunk int, entry int, last boolean")
    entered = timed.select(fields).join(entries.select("part", "chunk", "entry", "last"), ["part", "chunk"])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = _schema(batch.schema.field("conv_id").type, part=pa.int32(), chunk=pa.int32(), audit=pa.string(), roles=_TEXTS, texts=_TEXTS)
            out = []
            for row in batch.to_pylist():
                audit, turns, _ = _walk(*solved(row), row["entry"], row["last"])
                out.append((row["conv_id"], row["part"], row["chunk"], audit, *_rebuilt(turns, row["roles"], row["texts"])))
            yield _columns(out, schema)

    pieces = entered.select("conv_id", "part", "chunk", "roles", "texts", "firsts", "after", "entry", "last").mapInArrow(rebuild, _PIECE.format(id=kind))
    return ended.filter("head").drop("head", "after", "part", "chunk"), pieces


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """audit and repaired_sha256 of each conversation from its pieces in order, as a stream."""
    conv, digest, audit, begun = None, None, [], False
    out: list[tuple] = []
    schema = None
    for batch in batches:
        schema = _schema(batch.schema.field("conv_id").type, audit=pa.string(), repaired_sha256=pa.string())
        for row in batch.to_pylist():
            if digest is None or row["conv_id"] != conv:
                if digest is not None:
                    out.append((conv, "".join(audit), digest.hexdigest()))
                conv, digest, audit, begun = row["conv_id"], hashlib.sha256(), [], False
            audit.append(row["audit"])
            if row["roles"]:
                said = "\n".join([f"{r}:{t}" for r, t in zip(row["roles"], row["texts"])])
                digest.update(("\n" * begun + said).encode("utf-8", "surrogatepass"))
                begun = True
        if len(out) >= 500:
            yield _columns(out, schema)
            out = []
    if digest is not None:
        out.append((conv, "".join(audit), digest.hexdigest()))
    if out:
        yield _columns(out, schema)


def _solved(rows: DataFrame, segment_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    segments = materialise(_segments(rows, segment_rows), "conversation-segments")
    whole = _solve_whole(segments.filter("not open").select("conv_id", "part", "chunk", "turns", "roles", "texts"), kind)
    totals, pieces = _solve_open(segments.filter("open").drop("open"), kind)
    return whole, totals, pieces, kind


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per conversation the faults, the least cost of a repair, its edits and a digest of the repaired turns.

    ``rows``: conv_id, turn, role, text and, if there, ``live`` (false: the row only names its conversation).  Turns go by
    ``turn`` (nulls first), turns of one number by role and a hash of the text.  Null roles and texts are one
    space, a null conv_id is a conversation like others.  Repeated rows are duplicates; an empty table gives no
    rows; other columns are ignored.  Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    No task gathers a conversation's turns but as a stream of packed segments for the digest, which is
    sequential by its nature; one task scans a conversation's segments (a row for ``segment_rows`` turns).
    """
    whole, totals, pieces, kind = _solved(rows, segment_rows)

    def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = list(_digest(iter([batch.select(["conv_id", "audit", "roles", "texts"])])))
            shas = pa.concat_arrays([t.column("repaired_sha256") for t in told]) if told else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "gaps", *_COUNTS, "cost", "audit")), shas],
                names=["conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256"],
            )

    result = _RESULT.format(id=kind)
    done = whole.select("conv_id", "gaps", *_COUNTS, "cost", "audit", "roles", "texts").mapInArrow(digest_rows, result)
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").select("conv_id", "audit", "roles", "texts")
    told = ordered.mapInArrow(_digest, f"conv_id {kind}, audit string, repaired_sha256 string")
    same = F.col("t.conv_id").eqNullSafe(F.col("d.conv_id"))
    rest = totals.alias("t").join(told.alias("d"), same).select("t.*", "d.audit", "d.repaired_sha256")
    return done.unionByName(rest.select(done.columns))


def repaired_turns(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The turns after ``repair``: conv_id, part, chunk, at (their order in the conversation), role, text."""
    whole, _, pieces, _ = _solved(rows, segment_rows)
    both = whole.select(pieces.columns).unionByName(pieces)
    return both.select("conv_id", "part", "chunk", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "turn")).select(
        "conv_id", "part", "chunk", "at", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text")
    )
