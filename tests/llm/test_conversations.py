"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import zlib

import pytest

from specmill.llm import conversations, q_conversations

COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
BLANKS = " \t\n\x0b\x0c\r"


def brute(turns: list[tuple]) -> tuple:
    """Counts, cheapest audit and hash of one conversation's ordered (turn, role, text), by uniform-cost search over (cost, audit)."""
    faults, seen = [], set()
    for _, role, text in turns:
        solid = text.rstrip(BLANKS)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        body = roles[1:] if roles[:1] == "s" else roles
        if i == len(turns) and (roles == "" or body and len(body) % 2 == 0):
            break
        state = (i, roles[-1:], )
        if state in done:
            continue
        done.add(state)
        wanted = "a" if roles[-1:] == "u" else "u"
        new = {"u": "user", "a": "assistant"}[wanted]
        heapq.heappush(heap, (cost + 5, audit + "I", i, roles + wanted, (*lines, f"{new}:")))
        if i < len(turns):
            _, role, text = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, roles + wanted, (*lines, f"{new}:{text}")))
                if role[:1] == wanted or role[:1] == "s" and not roles:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + role[:1], (*lines, f"{role}:{text}")))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def in_order(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def damage(conv, turn, role, text) -> list[tuple]:
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def expected(rows) -> dict:
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).extend(damage(conv, turn, role, text))
    return {conv: brute(in_order(turns)) for conv, turns in by.items()}


@pytest.mark.parametrize("seed", range(6))
def test_table(seed):
    """Edits of whole conversations, and of ones put together from parts, are the cheapest and audit-least."""
    random.seed(seed)
    table = conversations.Table()
    for _ in range(150):
        turns = [(i, random.choice(["system", "user", "assistant", "tool"]), random.choice(["", f"open {i}", f"done {i}.", f"done {i}!", "same."])) for i in range(random.randint(0, 12))]
        _, blank, duplicate, truncated, _, cost, audit, _ = brute(turns)
        seen, codes = set(), []
        for _, role, text in turns:
            fault = "blank" if not text else "duplicate" if (role, text) in seen else "truncated" if text[-1] not in ".!" else None
            seen.add((role, text))
            codes.append(conversations._code(fault, role))
        assert "".join(table.edits(codes, 0, None)) == audit
        if len(codes) > 2:
            cuts = sorted(random.sample(range(1, len(codes)), min(3, len(codes) - 1)))
            parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
            vectors = [tuple(zip(*(table.forward(p, s) for s in range(4)))) for p in parts]
            ends = conversations.crossings([(list(c), list(o)) for c, o in vectors])
            assert "".join(w for p, (s, e) in zip(parts, ends) for w in table.edits(p, s, e)) == audit


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in q_conversations.op12_conversation_repair(spark, sf).collect()}
    assert got == want


def test_awkward_turns(spark, tmp_path):
    """Nulls everywhere, ties, repeated rows, odd roles, clashing columns, a conversation that lies in many parts, long texts."""
    random.seed(3)
    rows = [(1, None, "user", "a."), (1, None, None, None), (1, 3, "user", "a."), (1, 3, "user", "a."), (1, 3, "assistant", "b?"), (None, 1, "user", "x."), (None, None, "assistant", "y."),
            (2, None, None, None), (3, 5, "", "z."), (3, 5, "System", "z!"), (3, 9, "system", " \t"), (5, 1, "ürole", "漢."), (6, 0, "user", "long " * 50_000 + "."), (6, 1, "assistant", "end. \n ")]
    rows += [(4, i // 2, random.choice(["system", "user", "assistant", "tool", None]), random.choice(["again.", f"{i} open", f"{i} done.", None, "", "?"])) for i in range(600)]
    path = str(tmp_path / "in")
    extra = [f"'x' AS {c}" for c in ("place", "edit", "key", "fault", "times", "conv_id_", "c", "cost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).selectExpr("*", *extra)
    df.write.parquet(path + "/conversations.parquet")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in q_conversations.op12_conversation_repair(spark, path).collect()}
    assert got == expected(rows)
    again = conversations.summarize_repairs(conversations.repair_conversations(df), df)
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in again.collect()} == {c: brute(in_order(t)) for c, t in by.items()}


def test_text_ids_and_no_rows(spark):
    df = spark.createDataFrame([("run-1", 1, "user", "Read the sheet."), ("run-1", 3, "user", "And the capacity?"), ("run-1", 4, "assistant", "500 kg")], "conv_id string, turn long, role string, text string")
    got = conversations.repair_conversations(df).orderBy("place").collect()
    assert [(r["edit"], r["role"], r["text"], r["cost"], r["fault"]) for r in got] == [
        ("Keep", "user", "Read the sheet.", 0, None), ("Rerole", "assistant", "And the capacity?", 1, None), ("Delete", "assistant", None, 2, "truncated")]
    assert conversations.repair_conversations(df.limit(0)).collect() == []
    assert conversations.summarize_repairs(conversations.repair_conversations(df.limit(0)), df.limit(0)).collect() == []
    one = conversations.summarize_repairs(conversations.repair_conversations(df.limit(0)), df).collect()
    assert [tuple(r) for r in one] == [("run-1", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
