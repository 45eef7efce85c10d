"""Repair of conversations against all edits of short ones, and over pieces of any size."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pitgrid.llm import conversations

EMPTY = hashlib.sha256().hexdigest()


def faults(turns):
    out, seen = [], set()
    for role, text in turns:
        solid = re.sub(r"[ \t-\r]", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(turns):
    """The least (cost, audit) over all edits with up to two inserts in each gap."""
    told, best = faults(turns), None
    for edits in itertools.product("DKR", repeat=len(turns)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, told)):
            continue
        base = sum({"D": 3, "K": 0, "R": 2}[e] + (e != "D" and f == "truncated") for e, f in zip(edits, told))
        for inserts in itertools.product(range(3), repeat=len(turns) + 1):
            cost = base + 2 * sum(inserts)
            if best and cost > best[0]:
                continue
            audit = "".join("I" * k + e for k, e in zip(inserts, [*edits, ""]))
            # every role of an insert or a reroled turn
            slots = ["ua" if c in "IR" else turns[sum(x != "I" for x in audit[:i])][0][:1] for i, c in enumerate(audit) if c != "D"]
            if not any(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in itertools.product(*slots)):
                continue
            best = min(best or (cost, audit), (cost, audit))
    return best


def plain(rows):
    """The report of one conversation's rows (turn, role, text) in order, by whole passes."""
    turns = [(r, t) for _, r, t in rows]
    told = faults(turns)
    piece = conversations.piece_of([r for r, _ in turns], [t for _, t in turns])
    cost, _, audit = conversations.ended(conversations.cheapest(piece, conversations.START)) if turns else (0, 0, "")
    known = [t for t, *_ in rows if t is not None]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in conversations.repaired(piece, conversations.START, audit)) if turns else ""
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(told.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_programme_equals_all_edits():
    rng = random.Random(4)
    for _ in range(400):
        turns = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(["Hi.", "Yes", "", " \t", f"{rng.random()}!", "ok?"])) for _ in range(rng.randint(1, 4))]
        piece = conversations.piece_of([r for r, _ in turns], [t for _, t in turns])
        cost, _, audit = conversations.ended(conversations.cheapest(piece, conversations.START))
        assert (cost, audit) == brute(turns), turns
        left = conversations.repaired(piece, conversations.START, audit)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in left))


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    return out


def conversation_rows(seed, long):
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            if rng.random() < 0.9:
                rows.append((conv, turn * rng.choice([1, 1, 2]), rng.choice(["system", "user", "assistant", None, ""] if rng.random() < 0.3 else ["user", "assistant"]), rng.choice([None, "", "Same.", "Other", f"Text {rng.random()}!", "é? "])))
    rows += [(77, t, rng.choice(["user", "assistant", "user", "x"]), rng.choice(["Same.", "One more", f"T {rng.random()}.", " "])) for t in range(long)]
    return [*rows, *rows[:5], (None, 1, "user", "Hello."), (None, None, "assistant", "Hello."), (5, None, None, None), (90, None, "user", "a?"), (90, None, "assistant", "b!")]


@pytest.mark.parametrize(("rows_a_piece", "long"), [(4096, 300), (7, 300), (1, 40)])
def test_report_over_pieces(spark, monkeypatch, rows_a_piece, long):
    rows = conversation_rows(rows_a_piece, long)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, PART int, cost string").repartition(5)
    make = conversations._pieces

    def small(batches, schema):
        conversations.PIECE_ROWS = rows_a_piece
        return make(batches, schema)

    monkeypatch.setattr(conversations, "_pieces", small)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in conversations.audit_damaged(df).collect()}
    assert got == {conv: plain(own) for conv, own in damaged(rows).items()}
    assert any(v[-1] == EMPTY for v in got.values())


def test_defined_cases(spark):
    none = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert conversations.audit_damaged(none).collect() == []
    same = spark.createDataFrame([("c", 3, "user", "Hello there.")] * 900 + [("c", 4, "assistant", "x. " * 500_000)], none.schema).repartition(4)
    row = conversations.report(same).first()
    assert (row.duplicate, row.cost, row.gaps, row.illegal, row.audit) == (899, 3 * 899, 0, 899, "K" + "D" * 899 + "K")
    whole, pieced = conversations.repair(same)
    turns = whole.unionByName(pieced).orderBy("part", "no").select(F.explode("turns").alias("t")).select("t.role", F.length("t.text").alias("n")).collect()
    assert [(r.role, r.n) for r in turns] == [("user", 12), ("assistant", 1_500_000)]
