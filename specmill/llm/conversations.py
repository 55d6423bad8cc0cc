"""Conversations with repaired structure: cheapest edits by divide and conquer on cost vectors of four states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut
from .records import written

# The costs of edits, and what a kept or re-roled turn without an end costs.
KEEP, REROLE, DELETE, INSERT, OPEN = 0, 1, 2, 5, 5
COSTS = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
NAMES = {"K": "Keep", "R": "Rerole", "D": "Delete", "I": "Insert"}
ROLES = {"u": "user", "a": "assistant"}
FAR = 1 << 50
#: States: nothing yet, after a system turn, after a user's turn, after an assistant's. A conversation may end in the first and the last.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
END = ((0, ""), (10, "II"), (5, "I"), (0, ""))
ROWS_PER_PART, MOST_PARTS = 200_000, 50_000
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
BLANKS = " \t\n\x0b\x0c\r"


def _steps(code: str) -> tuple:
    """What one turn can cost: for each state before and after it the least (cost, word), or None. Insertions come before the turn.

    ``code`` is "D" for a turn that must go, else its role's initial, and "!" after it if it has no end.
    """
    out = [[None] * 4 for _ in range(4)]
    for start in range(4):
        states, at = [start], start
        for _ in range(2):  # more insertions than two come back to a state already had
            at = NEXT[at].get("u", NEXT[at].get("a"))
            states.append(at)
        for k, state in enumerate(states):
            ends = [(DELETE, "D", state)]
            if code != "D":
                extra = OPEN * code.endswith("!")
                if code[0] in NEXT[state]:
                    ends.append((KEEP + extra, "K", NEXT[state][code[0]]))
                ends.append((REROLE + extra, "R", NEXT[state].get("u", NEXT[state].get("a"))))
            for cost, letter, end in ends:
                found = (INSERT * k + cost, "I" * k + letter)
                if out[start][end] is None or found < out[start][end]:
                    out[start][end] = found
    return tuple(tuple(r) for r in out)


class Table:
    """Steps of turns, and forward and backward cost vectors over them.

    A forward vector has, per state, the least cost from one state over the turns so far, and the place of the audit-least such edits
    among those of all states. Audits that lead to different states never begin with each other, as each ends with a
    turn's edit, so these places decide between longer ones. Vectors are kept relative to their least cost: few distinct ones
    occur, so each step is a look-up.
    """

    def __init__(self):
        self.steps, self.ahead, self.back = {}, {}, {}

    def step(self, code: str) -> tuple:
        if code not in self.steps:
            self.steps[code] = _steps(code)
        return self.steps[code]

    def forward(self, codes: list[str], state: int) -> tuple[list[int], list[int]]:
        costs, places = tuple(0 if s == state else FAR for s in range(4)), (0, 1, 2, 3)
        total = 0
        for code in codes:
            key = costs, places, code
            if key not in self.ahead:
                rows, found = self.step(code), []
                for end in range(4):
                    ways = [(costs[s] + rows[s][end][0], places[s], rows[s][end][1]) for s in range(4) if costs[s] < FAR and rows[s][end]]
                    found.append(min(ways, default=(FAR, 4, "")))
                low = min(f[0] for f in found)
                order = sorted(range(4), key=lambda e: found[e][1:])
                self.ahead[key] = tuple(f[0] - low if f[0] < FAR else FAR for f in found), tuple(order.index(e) for e in range(4)), low
            costs, places, low = self.ahead[key]
            total += low
        return [c + total if c < FAR else FAR for c in costs], list(places)

    def backward(self, codes: list[str], ends: tuple[int, ...]) -> list[int]:
        """Per state the least cost from it over the turns, with the given costs of the states at the end."""
        low = min(ends)
        costs, total = tuple(c - low if c < FAR else FAR for c in ends), low
        for code in reversed(codes):
            key = costs, code
            if key not in self.back:
                rows = self.step(code)
                found = [min((rows[s][e][0] + costs[e] for e in range(4) if rows[s][e] and costs[e] < FAR), default=FAR) for s in range(4)]
                low = min(found)
                self.back[key] = tuple(c - low if c < FAR else FAR for c in found), low
            costs, low = self.back[key]
            total += low
        return [c + total if c < FAR else FAR for c in costs]

    def edits(self, codes: list[str], state: int, end: int | None) -> list[str]:
        """The audit-least of the cheapest edits, a word per turn, from ``state`` to ``end`` (None: the conversation's end).

        Hirschberg's way: vectors from both sides meet in the middle, the state with the least sum, of equals the one whose first
        half is audit-least, is the crossing, and the halves go on by themselves. Besides the answer it takes room for the halves that
        wait. The last word has what is inserted at the conversation's end.
        """
        tail = ""
        if end is None:
            costs, places = self.forward(codes, state)
            end = min(range(4), key=lambda e: (costs[e] + END[e][0], places[e]))
            tail = END[end][1]
        out, todo = [], [(0, len(codes), state, end)]
        while todo:
            lo, hi, s, e = todo.pop()
            if hi - lo == 1:
                out.append(self.step(codes[lo])[s][e][1])
            elif hi > lo:
                mid = (lo + hi) // 2
                costs, places = self.forward(codes[lo:mid], s)
                rest = self.backward(codes[mid:hi], tuple(0 if x == e else FAR for x in range(4)))
                cross = min(range(4), key=lambda x: (costs[x] + rest[x], places[x]))
                todo += [(mid, hi, cross, e), (lo, mid, s, cross)]
        if out:
            out[-1] += tail
        return out


def crossings(parts: list[tuple[list[list[int]], list[list[int]]]]) -> list[tuple[int, int | None]]:
    """(state before, state after) of each part of one conversation, from the forward vectors of all four states of each.

    The parts' costs add up as the halves' do, and ties go the same way, so the parts can be solved by themselves. The last
    one's end is left open.
    """
    costs, places, came = [0, FAR, FAR, FAR], [0, 1, 2, 3], []
    for part_costs, part_places in parts:
        found = [min((costs[s] + part_costs[s][e], places[s], part_places[s][e], s) if part_costs[s][e] < FAR and costs[s] < FAR else (FAR, 4, 4, s) for s in range(4)) for e in range(4)]
        order = sorted(range(4), key=lambda e: found[e][1:3])
        came.append([f[3] for f in found])
        costs, places = [f[0] for f in found], [order.index(e) for e in range(4)]
    end = min(range(4), key=lambda e: (costs[e] + END[e][0], places[e]))
    out: list[tuple[int, int | None]] = []
    for back in reversed(came):
        out.append((back[end], end))
        end = back[end]
    out.reverse()
    return out[:-1] + [(out[-1][0], None)]


def _code(fault: str | None, role: str) -> str:
    return "D" if fault in (BLANK, DUPLICATE) else (role[:1] if role[:1] in ("s", "u", "a") else "x") + "!" * (fault == TRUNCATED)


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    text_, role_ = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (text, role))
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), role_.alias("role"), text_.alias("text"))
    return rows.withColumn("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _same(a: DataFrame, b: DataFrame) -> Column:
    """Rows of ``a`` and ``b`` (its columns end in _) are the same turn."""
    return F.col("conv_id").eqNullSafe(F.col("conv_id_")) & F.col("turn").eqNullSafe(F.col("turn_")) & (F.col("role") == F.col("role_")) & (F.col("key") == F.col("key_"))


def _marked(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{c}_") for c in rows.columns))


def _faults(rows: DataFrame) -> DataFrame:
    """Distinct turns with the number of their copies and the fault of the first one; texts are left behind."""
    solid = F.rtrim("text", F.lit(BLANKS))
    told = rows.select("conv_id", "turn", "role", "key", (solid == "").alias("is_blank"), (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("is_open"))
    each = written(told.groupBy("conv_id", "turn", "role", "key").agg(F.count("*").alias("copies"), F.first("is_blank").alias("is_blank"), F.first("is_open").alias("is_open")), "turns")
    first = each.groupBy("conv_id", "role", "key").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn"))["turn"].alias("turn"))
    fault = F.when(F.col("is_blank"), BLANK).when(F.col("key_").isNull(), DUPLICATE).when(F.col("is_open"), TRUNCATED)
    marked = _marked(first)
    return each.join(marked, _same(each, marked), "left").select("conv_id", "turn", "role", "key", "copies", fault.alias("fault"))


def repair_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The cheapest edits that give each conversation's roles the form ``(system? (user assistant)+)?``.

    The catalogue has no stored conversations, so this takes any table of turns, such as the messages of extraction requests. Turns
    are taken by ``turn`` (a whole number, nulls first), those with the same one by role and a hash of the text. A turn is blank
    (nothing but blanks), a duplicate (role and text of an earlier turn of the conversation) or truncated (not ended by ``.``, ``!``
    or ``?``); its first such fault counts. Edits: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty turn) 5;
    blank and duplicate turns must be deleted, and a truncated one that stays costs 5 more. Roles are told by their first
    letter. Of equally cheap edits those whose initials come first in ASCII order are taken.

    One row per edit: conv_id, place (rising within a conversation), edit, times, cost, turn, fault, illegal, role, text. ``times`` is
    1, or how many further copies of the turn before are deleted; ``cost`` and ``illegal`` (how often a turn's and the one before's
    initials are none of su, ua, au) are for all of them. ``role`` and ``text`` are as repaired; a deleted turn has its old role and a null
    text, an inserted one an empty text and no turn or fault.

    A null role or text is read as one space; rows without conv_id are one conversation; a repeated row is a duplicate. Other columns
    are ignored, whatever their names. An empty table gives no rows.

    The turns without their texts are range-sorted by conversation and order, so that a long conversation lies in many parts. Each
    part is solved by itself; of conversations that go over a part's end, the vectors of four states of each part are put together
    first (at most two per part, and parts are at most 50,000). Texts are joined to the turns that stay.
    """
    rows = _turns(conversations, conv_id, turn, role, text)
    faults = written(_faults(rows), "faults")
    parts = min(MOST_PARTS, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), faults.count() // ROWS_PER_PART))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "key"]
    # A reliable checkpoint keeps its partitions, so both passes see the same parts.
    ranged = cut(faults.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    id_field = T.StructField("conv_id", faults.schema["conv_id"].dataType)
    summary = T.StructType([id_field]).add("part", "integer").add("k", "integer").add("costs", T.ArrayType(T.LongType())).add("places", T.ArrayType(T.LongType())).add("last", "string")
    seen = sorted(ranged.mapInArrow(_summaries(to_arrow_schema(summary)), summary).collect(), key=lambda r: (r.part, r.k))
    known = {}
    for chain in _chains(seen):
        before = None
        for r, (start, end) in zip(chain, crossings([([r.costs[4 * i:4 * i + 4] for i in range(4)], [r.places[4 * i:4 * i + 4] for i in range(4)]) for r in chain])):
            known[r.part, r.k] = start, end, before
            before = r.last

    edit = T.StructType([id_field]).add("place", "long").add("edit", "string").add("times", "long").add("cost", "long").add("turn", "long").add(
        "fault", "string").add("illegal", "long").add("role", "string").add("key", "binary").add("new_role", "string")
    edits = written(ranged.mapInArrow(_solved(known, to_arrow_schema(edit)), edit), "edits")
    texts = _marked(rows.dropDuplicates(["conv_id", "turn", "role", "key"]))
    columns = ["conv_id", "place", "edit", "times", "cost", "turn", "fault", "illegal", F.col("new_role").alias("role")]
    stays = F.col("edit").isin("Keep", "Rerole")
    return edits.where(stays).join(texts, _same(edits, texts)).select(*columns, F.col("text_").alias("text")).unionByName(
        edits.where(~stays).select(*columns, F.when(F.col("edit") == "Insert", F.lit("")).alias("text")))


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """(conv_id, its turns in this part), each turn as (turn, role, key, copies, fault)."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for conv, found in groupby(rows, key=lambda r: r[0]):
        yield conv, [r[1:] for r in found]


def _summaries(schema: pa.Schema):
    """Forward vectors of a part's first and last conversation, which may go on in the parts beside it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, held = Table(), TaskContext.get().partitionId(), []
        for found in _by_conversation(batches):
            held = [*held[:1], found]
        out = []
        for k, (conv, found) in enumerate(held):
            vectors = [table.forward([_code(fault, role) for _, role, _, _, fault in found], s) for s in range(4)]
            out.append((conv, part, k, [x for v in vectors for x in v[0]], [x for v in vectors for x in v[1]], found[-1][1][:1]))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    return run


def _chains(summaries: list) -> Iterator[list]:
    """Runs of summaries of one conversation in several parts."""
    for _, found in groupby(summaries, key=lambda r: r.conv_id):
        chain = list(found)
        if len(chain) > 1:
            yield chain


def _solved(known: dict[tuple[int, int], tuple[int, int | None, str | None]], schema: pa.Schema):
    """The edits of a part's conversations; ``known`` has (state before, state after, initial before) of those that go over its ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, k = Table(), TaskContext.get().partitionId(), 0
        rows = _by_conversation(batches)
        now, out, place = next(rows, None), [], part << 36
        while now is not None:
            following = next(rows, None)
            state, end, before = known.get((part, min(k, 1)), (0, None, None)) if k == 0 or following is None else (0, None, None)
            conv, turns = now
            for (turn, role, key, copies, fault), word in zip(turns, table.edits([_code(f, r) for _, r, _, _, f in turns], state, end)):
                seen = False
                for letter in word:
                    # A turn's copies go right after it, before what is inserted at the conversation's end.
                    if letter == "I" and seen and copies > 1:
                        out.append((conv, place, "Delete", copies - 1, DELETE * (copies - 1), turn, BLANK if fault == BLANK else DUPLICATE, copies - 1, role, None, role))
                        place, copies = place + 1, 1
                    own = letter != "I"
                    new, cost = role, COSTS[letter]
                    if letter == "K":
                        state = NEXT[state][role[0]]
                    elif letter in "IR":
                        initial = "u" if "u" in NEXT[state] else "a"
                        new, state = ROLES[initial], NEXT[state][initial]
                    if letter in "KR" and fault == TRUNCATED:
                        cost += OPEN
                    wrong = int(own and before is not None and before + role[:1] not in ("su", "ua", "au"))
                    out.append((conv, place, NAMES[letter], 1, cost, turn if own else None, fault if own else None, wrong, role, key if letter in "KR" else None, new))
                    place, seen = place + 1, seen or own
                if copies > 1:
                    out.append((conv, place, "Delete", copies - 1, DELETE * (copies - 1), turn, BLANK if fault == BLANK else DUPLICATE, copies - 1, role, None, role))
                    place += 1
                before = role[:1]
            if len(out) > 5_000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
                out = []
            now, k = following, k + 1
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    return run


def summarize_repairs(repaired: DataFrame, conversations: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """One row per conversation of ``conversations``, also of one without any edit, from the rows of ``repair_conversations``.

    Columns: conv_id, gaps (turns missing between the least and the greatest one), blank, duplicate, truncated, illegal, cost, audit
    (initials of the edits in order) and repaired_sha256 (of the repaired ``role:text`` lines). A conversation's repaired text is hashed
    from its beginning to its end, so it is read as a stream by one task, which keeps one initial per edit and no texts.
    """
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    id_field = T.StructField("conv_id", repaired.schema["conv_id"].dataType)
    schema = T.StructType([id_field])
    for n in names:
        schema = schema.add(n, "long")
    schema = schema.add("audit", "string").add("repaired_sha256", "string")
    target = to_arrow_schema(schema)
    ids = conversations.select(F.col(conv_id).alias("conv_id")).distinct()
    rows = repaired.select("conv_id", "place", "edit", "times", "cost", "turn", "fault", "illegal", "role", "text").unionByName(ids.withColumn("place", F.lit(-1).cast("long")), allowMissingColumns=True)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), []
        for conv, found in groupby(rows, key=lambda r: r[0]):
            total, audit, digest, kept, turns = dict.fromkeys(names, 0), [], hashlib.sha256(), 0, [None, None, 0]
            for _, _, edit, times, cost, turn, fault, illegal, role, text in found:
                if edit is None:
                    continue
                audit.append(edit[0] * times)
                total["cost"] += cost
                total["illegal"] += illegal
                if fault:
                    total[fault] += times
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                if edit != "Delete":
                    digest.update(("\n" * (kept > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    kept += 1
            if turns[2]:
                total["gaps"] = turns[1] - turns[0] + 1 - turns[2]
            out.append({"conv_id": conv, **total, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()})
            if len(out) >= 1_000:
                yield pa.RecordBatch.from_pylist(out, target)
                out = []
        yield pa.RecordBatch.from_pylist(out, target)

    return ordered.mapInArrow(run, schema)
