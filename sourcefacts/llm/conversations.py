"""Repair of damaged conversations at least cost.

A conversation is legal when its role initials read ``(s?(ua)+)?``. Rows are
kept, given another role, deleted, or empty ones are put in. A backward pass
gives the cost to go from every row and state of the grammar; a forward walk
takes, of the edits that keep to it, the one with the least letter.

Conversations are put in one order by a range sort, so a very long one lies
over many partitions, and are cut into pieces. A piece is a 4 by 4 table of
least costs from state to state, and such tables combine like matrices; so
costs to go are passed from piece to piece and every piece is then walked on
its own, from each state that it may be entered in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

#: Costs of the edits, the damage by remainder, and what ends a sentence.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
DAMAGE_PARTS, DROPS, EMPTIES, STRIPS, REPEATS, USERS = 20, 0, 1, 2, 3, 4
SENTENCE_END, WORD_CHARACTER, SPACES = "[.!?]", r"[^\x20\x09-\x0D]", " \t\n\x0b\x0c\r"

#: States of the grammar: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 0
#: Where a role's initial (s, u, a by number) leads from each state.
NEXT = ({SYSTEM: SYSTEM, USER: USER}, {USER: USER}, {ASSISTANT: ASSISTANT}, {USER: USER})
#: What a row becomes that is put in or given another role.
FILLS = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL_PAIRS = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
NEVER = 1 << 60
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: Rows in a piece, as a power of two.
PIECE_BITS = 14


def damage(conversations: DataFrame) -> DataFrame:
    """Rows after damage: some dropped, emptied, without ends of sentences, repeated or said by the user.

    Which one is decided by the checksum of ``conv_id:turn``. A null in role,
    text or that key counts as one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    part = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % DAMAGE_PARTS
    text = F.when(part == EMPTIES, "").when(part == STRIPS, F.regexp_replace(space("text"), SENTENCE_END, "")).otherwise(space("text"))
    role = F.when(part == USERS, "user").otherwise(space("role"))
    times = F.when(part == DROPS, 0).when(part == REPEATS, 2).otherwise(1)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), times.alias("_times"))
    return rows.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_copy")


def _in_order(rows: DataFrame) -> DataFrame:
    """The rows with ``at``, their place in one order of all, written.

    Equal rows may be many; a number of no other meaning spreads them.
    """
    salted = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    order = ["conv_id", "turn", "role", "text", "_salt"]
    initial = F.substring("role", 1, 1)
    letter = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    fault = F.when(~F.col("text").rlike(WORD_CHARACTER), BLANK).when(~end.rlike(SENTENCE_END), CUT).otherwise(SOUND)
    told = salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt").withColumn("at", F.monotonically_increasing_id())
    keys = [F.xxhash64("role", "text").alias("_h"), F.xxhash64(F.lit(1), "text", "role").alias("_g")]
    return materialize(told.select("*", letter.cast("int").alias("_letter"), fault.cast("int").alias("_fault"), *keys), "ordered")


def _piece() -> Column:
    return F.shiftright("at", PIECE_BITS)


def _pieces(ordered: DataFrame) -> DataFrame:
    """Written pieces: ``conv_id, piece, first_at, letters, faults``.

    A row is a duplicate when role and text, told apart by 128 bits of
    hashes, stand earlier in the conversation; blank comes before that.
    """
    light = ordered.select("conv_id", "at", "_letter", "_fault", "_h", "_g")
    again = light.groupBy("conv_id", "_h", "_g").agg(F.min("at").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    named = again.select(F.col("conv_id").alias("_conv"), F.col("_h").alias("_h2"), F.col("_g").alias("_g2"), "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_h") == F.col("_h2")) & (F.col("_g") == F.col("_g2"))
    fault = F.when((F.col("_fault") != BLANK) & (F.col("at") > F.col("_first")), DUPLICATE).otherwise(F.col("_fault"))
    rows = light.join(named, same, "left").select("conv_id", _piece().alias("piece"), "at", "_letter", fault.alias("_fault"))
    held = rows.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(F.struct("at", "_letter", "_fault"))).alias("_rows"))
    return materialize(held.select(
        "conv_id", "piece", F.col("_rows")[0]["at"].alias("first_at"), F.col("_rows")["_letter"].alias("letters"), F.col("_rows")["_fault"].alias("faults"),
    ), "pieces")


def _with_inserts(cost: list[int]) -> list[int]:
    """Costs to go when rows may be put in first; one or two of them are enough."""
    once = [min(c, INSERT + cost[FILLS[s]]) for s, c in enumerate(cost)]
    return [min(c, INSERT + once[FILLS[s]]) for s, c in enumerate(cost)]


@lru_cache(maxsize=None)
def _moves(letter: int, fault: int) -> list[list[tuple[str, int, int]]]:
    """By state: edit, cost and next state of a row, in the order of the letters; a row put in is not among them."""
    out = []
    for s in range(4):
        moves = [("D", DELETE, s)]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            if letter in NEXT[s]:
                moves.append(("K", more, NEXT[s][letter]))
            moves.append(("R", REROLE + more, FILLS[s]))
        out.append(moves)
    return out


def _before(cost: list[int], letter: int, fault: int) -> list[int]:
    """Costs to go before a row, from those after it."""
    return _with_inserts([min(c + cost[t] for _, c, t in moves) for moves in _moves(letter, fault)])


def costs_to_go(letters: list[int], faults: list[int], after: list[int]) -> list[list[int]]:
    """Costs to go before each row of a piece and after its last one."""
    out = [after]
    for letter, fault in zip(reversed(letters), reversed(faults), strict=True):
        out.append(_before(out[-1], letter, fault))
    return out[::-1]


#: Costs to go at the end of a conversation.
AT_END = _with_inserts([0, NEVER, NEVER, 0])


def walk(letters: list[int], faults: list[int], costs: list[list[int]], state: int, last: bool) -> tuple[str, int]:
    """The edits of a piece from ``state``, ASCII-least of the cheapest, and the state after it.

    Rows that are put in stand before the row that they precede; at the end of
    a piece they are left to the next one, unless it is the last.
    """
    edits = []

    def put_in(i: int) -> bool:
        nonlocal state
        if costs[i][state] == INSERT + costs[i][FILLS[state]]:
            edits.append("I")
            state = FILLS[state]
            return True
        return False

    for i, (letter, fault) in enumerate(zip(letters, faults, strict=True)):
        while True:
            tight = [(e, t) for e, c, t in _moves(letter, fault)[state] if c + costs[i + 1][t] == costs[i][state]]
            if (not tight or tight[0][0] > "I") and put_in(i):
                continue
            edits.append(tight[0][0])
            state = tight[0][1]
            break
    while last and put_in(len(letters)):
        pass
    return "".join(edits), state


def _long(*names: str) -> str:
    return ", ".join(f"{n} long" for n in names)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


TABLE = "conv_id long, piece long, costs array<long>"


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least costs of a piece from every state before it to every state after it."""
    for batch in batches:
        rows = []
        for conv, piece, letters, faults in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "letters", "faults")), strict=True):
            columns = [costs_to_go(letters, faults, [0 if s == t else NEVER for s in range(4)])[0] for t in range(4)]
            rows.append((conv, piece, [columns[t][s] for s in range(4) for t in range(4)]))
        yield _batch(rows, TABLE)


ENDS = "conv_id long, piece long, after array<long>, is_first boolean, is_last boolean"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs to go after each piece, of tables sorted from the last piece of a conversation to its first."""
    conv, after, held = None, AT_END, None
    for batch in batches:
        rows = []
        for name, piece, costs in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "costs")), strict=True):
            is_last = held is None or name != conv
            if held is not None:
                rows.append((*held[:3], is_last, held[3]))
            conv, after = name, AT_END if is_last else after
            held = (name, piece, after, is_last)
            after = [min(costs[4 * s + t] + after[t] for t in range(4)) for s in range(4)]
        yield _batch(rows, ENDS)
    if held is not None:
        yield _batch([(*held[:3], True, held[3])], ENDS)


WALKED = "conv_id long, at long, walks array<string>, exits array<long>, costs array<long>, counts array<long>"


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A piece walked from each state that it may be entered in, and what it counts.

    Counts: blank, duplicate, truncated, illegal pairs inside, first and last letter.
    """
    names = ("conv_id", "first_at", "letters", "faults", "after", "is_first", "is_last")
    for batch in batches:
        rows = []
        for conv, at, letters, faults, after, is_first, is_last in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            costs = costs_to_go(letters, faults, after)
            walks, exits = [], []
            for state in range(4):
                if (is_first and state != START) or costs[0][state] >= NEVER:
                    walked, state = "", state
                else:
                    walked, state = walk(letters, faults, costs, state, is_last)
                walks.append(walked)
                exits.append(state)
            illegal = sum(pair not in LEGAL_PAIRS for pair in zip(letters, letters[1:], strict=False))
            rows.append((conv, at, walks, exits, costs[0], [faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, letters[0], letters[-1]]))
        yield _batch(rows, WALKED)


REPAIRED = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Repair:
    """One conversation, read row by row; only its edits and the state of its digest are kept."""

    def __init__(self, conv: int | None):
        self.conv, self.state, self.cost, self.last = conv, START, None, None
        self.counts, self.audit = [0] * 4, []
        self.digest, self.lines = hashlib.sha256(), 0
        self.edits, self.place, self.now = "", 0, START

    def say(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def piece(self, walks: list[str], exits: list[int], costs: list[int], counts: list[int]) -> None:
        self.put_in()
        self.cost = costs[START] if self.cost is None else self.cost
        self.counts = [a + b for a, b in zip(self.counts, counts[:4], strict=True)]
        if self.last is not None and (self.last, counts[4]) not in LEGAL_PAIRS:
            self.counts[3] += 1
        self.last = counts[5]
        self.edits, self.place, self.now = walks[self.state], 0, self.state
        self.audit.append(self.edits)
        self.state = exits[self.state]

    def put_in(self) -> None:
        while self.place < len(self.edits) and self.edits[self.place] == "I":
            self.now = FILLS[self.now]
            self.say(ROLES[self.now], "")
            self.place += 1

    def row(self, role: str, text: str, letter: int) -> None:
        self.put_in()
        edit = self.edits[self.place]
        self.place += 1
        if edit == "K":
            self.now = NEXT[self.now][letter]
            self.say(role, text)
        elif edit == "R":
            self.now = FILLS[self.now]
            self.say(ROLES[self.now], text)

    def done(self) -> tuple:
        self.put_in()
        return (self.conv, *self.counts, self.cost, "".join(self.audit), self.digest.hexdigest())


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, place and kind; a piece's walks come before its rows."""
    held = None
    names = ("conv_id", "walks", "exits", "costs", "counts", "role", "text", "_letter")
    for batch in batches:
        out = []
        for conv, walks, exits, costs, counts, role, text, letter in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if held is None or conv != held.conv:
                if held is not None:
                    out.append(held.done())
                held = _Repair(conv)
            if walks is not None:
                held.piece(walks, exits, costs, counts)
            else:
                held.row(role, text, letter)
        yield _batch(out, REPAIRED)
    if held is not None:
        yield _batch([held.done()], REPAIRED)


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``conv_id, turn, role, text``: faults, least cost, edits and digest of the repaired text.

    Rows are taken by turn, nulls first, then by role and text. ``audit`` has
    a letter an edit: K keep, R other role, D delete, I put in. Rows without
    ``conv_id`` are one conversation. Equal rows are duplicates of the first.
    Role and text must not be null (``damage`` sees to that). An empty table
    gives no rows. A digest reads its conversation in one task, row by row;
    all else about a conversation is worked out piece by piece.
    """
    ordered = _in_order(rows)
    pieces = _pieces(ordered)
    tables = pieces.mapInArrow(_tables, TABLE)
    ends = tables.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece")).mapInArrow(_ends, ENDS)
    told = ends.select(F.col("conv_id").alias("_conv"), F.col("piece").alias("_piece"), "after", "is_first", "is_last")
    walked = pieces.join(told, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("piece") == F.col("_piece"))).mapInArrow(_walks, WALKED)
    said = ordered.select("conv_id", "at", F.lit(1).alias("_kind"), "role", "text", "_letter")
    stream = walked.withColumn("_kind", F.lit(0)).unionByName(said, allowMissingColumns=True)
    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "at", "_kind").mapInArrow(_repair, REPAIRED)


def repair_report(conversations: DataFrame) -> DataFrame:
    """What damage and repair do to every conversation.

    Columns: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256``. A conversation of which no row is left has
    zeros, no edits and the digest of nothing. Further columns are not looked at.
    """
    rows = damage(conversations)
    turns = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    gaps = rows.groupBy("conv_id").agg(turns.alias("gaps"))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = gaps.join(repair(rows).withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("conv_id")
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    none = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return joined.fillna(none).select("conv_id", *none)
