"""Repair of a conversation's structure by the cheapest edits: an optional system turn, then pairs of a user's and an assistant's turn.

A retained-subsequence programme chooses the turns that stay, kept or with another role. What lies between two retained turns is deleted, at a price that prefix
sums of deletions give; the least price so far of every state (the role of the last retained turn) is kept as a running minimum, so that a turn looks at four
states and not at all turns before it. The roles on both sides of a gap determine how many turns are inserted there. Of equally cheap edits the audit that is
least as an ASCII string counts.

Conversations are cut into pieces of bounded size. A piece's prices from each state to each state, and the order of its audits, are all that the choice over
several pieces needs, so that no task holds a whole conversation, however long it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pitgrid.llm.workspace import cut, small_batches

#: Bounds of a piece; a single longer turn is a piece of its own.
PIECE_ROWS, PIECE_BYTES = 4096, 1 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
DELETE, REROLE, INSERT, CUT_SHORT = 3, 2, 2, 1
#: Turns that have to be inserted between a state and the next retained turn's role; after the last one the END.
END = 4
GAPS = {
    (START, SYSTEM): 0, (START, USER): 0, (START, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, USER): 1, (USER, ASSISTANT): 0, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1,
    (START, END): 0, (SYSTEM, END): 2, (USER, END): 1, (ASSISTANT, END): 0,
}
_SOLID = re.compile(r"[^ \t-\r]")
_LAST = re.compile(r"[^ \t-\r](?=[ \t-\r]*\Z)")
LEGAL = {"su", "ua", "au"}


class Piece(NamedTuple):
    roles: list[str]
    texts: list[str]
    blank: list[bool]
    duplicate: list[bool]
    truncated: list[bool]


def piece_of(roles: list[str], texts: list[str], seen_before: Iterable[int] = ()) -> Piece:
    """The turns with their first fault; seen_before: the turns that equal one of an earlier piece."""
    blank = [not _SOLID.search(t) for t in texts]
    seen, earlier = set(), set(seen_before)
    duplicate = []
    for k, turn in enumerate(zip(roles, texts, strict=True)):
        duplicate.append(not blank[k] and (turn in seen or k in earlier))
        seen.add(turn)
    truncated = [not b and not d and _LAST.search(t)[0] not in ".!?" for t, b, d in zip(texts, blank, duplicate, strict=True)]
    return Piece(roles, texts, blank, duplicate, truncated)


def cheapest(piece: Piece, entry: int) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) of the piece's edits from a state before it to each state after it."""
    n = len(piece.roles)
    # for each state: the price of its best way so far without the deletions up to there, that way's audit, and the turns that it covers
    least: dict[int, tuple[int, str, int]] = {entry: (0, "", 0)}
    deleted = 0
    for i, (role, blank, duplicate, cut_short) in enumerate(zip(piece.roles, piece.blank, piece.duplicate, piece.truncated, strict=True)):
        new: dict[int, tuple[int, str]] = {}
        if not blank and not duplicate:
            own = STATES.get(role[:1])
            for state in (SYSTEM, USER, ASSISTANT):
                if state == SYSTEM != own:
                    continue
                price = (0 if state == own else REROLE) + CUT_SHORT * cut_short
                ways = [(c + deleted + price + INSERT * GAPS[r, state], r) for r, (c, _, _) in least.items() if (r, state) in GAPS]
                if not ways:
                    continue
                cost = min(ways)[0]
                edit = "K" if state == own else "R"
                new[state] = cost, min(least[r][1] + "D" * (i - least[r][2]) + "I" * GAPS[r, state] + edit for c, r in ways if c == cost)
        deleted += DELETE
        for state, (cost, audit) in new.items():
            price, at = cost - deleted, least.get(state)
            if at is None or price < at[0] or (price == at[0] and audit < at[1] + "D" * (i + 1 - at[2])):
                least[state] = price, audit, i + 1
    return {state: (price + deleted, audit + "D" * (n - at)) for state, (price, audit, at) in least.items()}


def ended(ways: dict[int, tuple[int, str]]) -> tuple[int, int, str]:
    """(cost, state, audit) of the best way when nothing follows, the last inserts included."""
    cost, audit, state = min((cost + INSERT * GAPS[state, END], audit + "I" * GAPS[state, END], state) for state, (cost, audit) in ways.items())
    return cost, state, audit


def repaired(piece: Piece, entry: int, audit: str) -> list[tuple[str, str]]:
    """The turns that the audit leaves, (role, text); inserted ones have no text."""
    state, at, out = entry, 0, []
    for edit in audit:
        if edit == "I":
            state = ASSISTANT if state == USER else USER
            out.append((NAMES[state], ""))
            continue
        if edit == "K":
            state = STATES[piece.roles[at][:1]]
            out.append((piece.roles[at], piece.texts[at]))
        elif edit == "R":
            state = ASSISTANT if state == USER else USER
            out.append((NAMES[state], piece.texts[at]))
        at += 1
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults that the CRC-32 of "conv_id:turn" modulo 20 decides; null roles and texts are one space.

    0 drops the row, 1 empties its text, 2 takes full stops, exclamation and question marks out of it, 3 repeats the row, 4 makes its role user.
    """
    key = "concat(coalesce(cast(conv_id as string), ' '), ':', coalesce(cast(turn as string), ' '))"
    out = rows.selectExpr("conv_id", "turn", "coalesce(cast(role as string), ' ') as role", "coalesce(cast(text as string), ' ') as text", f"crc32(cast({key} as binary)) % 20 as _fault")
    return out.where("_fault <> 0").selectExpr(
        "conv_id", "turn", "if(_fault = 4, 'user', role) as role", "case _fault when 1 then '' when 2 then translate(text, '.!?', '') else text end as text", "explode(sequence(1, if(_fault = 3, 2, 1))) as _copy"
    ).drop("_copy")


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in order -> pieces; inner: neither the task's first nor its last conversation, and of one piece, so certainly whole."""
    held: list[tuple] = []
    size = number = parts = 0
    conv, first = None, True
    out: list[dict] = []
    weight = 0

    def flush(inner: bool) -> None:
        nonlocal held, size, number, parts, weight
        if held:
            turns, roles, texts = zip(*held, strict=True)
            out.append({"conv_id": conv, "no": number, "inner": inner and not parts, "turns": turns, "roles": roles, "texts": texts})
            held, number, parts, weight = [], number + 1, parts + 1, weight + size
            size = 0

    for batch in batches:
        for at, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            if (held or parts) and at != conv:
                flush(not first)
                first, parts = False, 0
            conv = at
            if held and (len(held) >= PIECE_ROWS or size + len(text) > PIECE_BYTES):
                flush(False)
            held.append((turn, role, text))
            size += len(text)
            if weight >= 4 * PIECE_BYTES or len(out) >= 400:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, weight = [], 0
    flush(False)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different turn of a piece, by the digest of its role and text, and where it is first; blank ones need none."""
    for batch in batches:
        out: dict[str, list] = {"conv_id": [], "part": [], "no": [], "digest": [], "at": []}
        for k in range(batch.num_rows):
            roles, texts = (batch.column(c)[k].as_py() for c in ("roles", "texts"))
            piece, seen = piece_of(roles, texts), {}
            for at, (role, text) in enumerate(zip(roles, texts, strict=True)):
                if not piece.blank[at]:
                    seen.setdefault(hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), at)
            for digest, at in seen.items():
                for c, v in (("conv_id", batch.column("conv_id")[k].as_py()), ("part", batch.column("part")[k].as_py()), ("no", batch.column("no")[k].as_py()), ("digest", digest), ("at", at)):
                    out[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["conv_id"], batch.schema.field("conv_id").type), pa.array(out["part"], pa.int32()), pa.array(out["no"], pa.int32()), pa.array(out["digest"], pa.binary()), pa.array(out["at"], pa.int32())], names=list(out))


def _prices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece the cost from every state to every state (-1: no way), and the rank of that way's audit among those from the same state."""
    for batch in batches:
        costs, ranks = [], []
        for k in range(batch.num_rows):
            piece = piece_of(*(batch.column(c)[k].as_py() for c in ("roles", "texts")), batch.column("earlier")[k].as_py() or ())
            cost, rank = [-1] * 16, [-1] * 16
            for entry in range(4):
                ways = cheapest(piece, entry)
                order = sorted(ways, key=lambda s: ways[s][1])
                for state, (c, _) in ways.items():
                    cost[4 * entry + state], rank[4 * entry + state] = c, order.index(state)
            costs.append(cost)
            ranks.append(rank)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "no")), pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32()))], names=["conv_id", "part", "no", "costs", "ranks"])


def _chosen(table: pa.Table) -> pa.Table:
    """One conversation's pieces in order: the states before and after each on the cheapest way through all, and which piece is the last."""
    table = table.sort_by([("part", "ascending"), ("no", "ascending")])
    best: dict[int, tuple[int, int]] = {START: (0, 0)}  # state -> cost, rank of its audit so far
    back: list[dict[int, int]] = []
    for costs, ranks in zip(table.column("costs").to_pylist(), table.column("ranks").to_pylist(), strict=True):
        ways: dict[int, tuple[int, int, int, int]] = {}
        for r, (cost, rank) in best.items():
            for t in range(4):
                if costs[4 * r + t] >= 0:
                    # audits so far differ and none begins another, so their order decides before what the piece adds
                    way = cost + costs[4 * r + t], rank, ranks[4 * r + t], r
                    ways[t] = min(ways.get(t, way), way)
        back.append({t: r for t, (_, _, _, r) in ways.items()})
        order = sorted(ways, key=lambda t: ways[t][1:3])
        best = {t: (ways[t][0], order.index(t)) for t in ways}
    state = min(best, key=lambda s: (best[s][0] + INSERT * GAPS[s, END], best[s][1]))
    entries, exits = [], []
    for step in reversed(back):
        exits.append(state)
        state = step[state]
        entries.append(state)
    n = table.num_rows
    return pa.table({"part": table.column("part"), "no": table.column("no"), "entry": pa.array(entries[::-1], pa.int32()), "exit": pa.array(exits[::-1], pa.int32()), "last": pa.array([k == n - 1 for k in range(n)])})


def _repair(batches: Iterator[pa.RecordBatch], schema: pa.Schema, whole: bool) -> Iterator[pa.RecordBatch]:
    """Pieces -> their repaired turns, faults and audits; whole: each is a conversation, else the states around it are given."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            piece = piece_of(row["roles"], row["texts"], row.get("earlier") or ())
            if whole:
                entry = START
                cost, _, audit = ended(cheapest(piece, entry))
            else:
                entry = row["entry"]
                cost, audit = cheapest(piece, entry)[row["exit"]]
                if row["last"]:
                    cost, audit = cost + INSERT * GAPS[row["exit"], END], audit + "I" * GAPS[row["exit"], END]
            initials = [r[:1] for r in piece.roles]
            known = [t for t in row["turns"] if t is not None]
            out.append(
                {"conv_id": row["conv_id"], "part": row["part"], "no": row["no"], "audit": audit, "cost": cost, "blank": sum(piece.blank), "duplicate": sum(piece.duplicate), "truncated": sum(piece.truncated)}
                | {"illegal": sum(a + b not in LEGAL or not a or not b for a, b in zip(initials[:-1], initials[1:], strict=True)), "first_initial": initials[0], "last_initial": initials[-1]}
                | {"first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "n_turns": len(set(known)), "turns": [{"role": r, "text": t} for r, t in repaired(piece, entry, audit)]}
            )
        yield pa.RecordBatch.from_pylist(out, schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole, pieced): the repaired conversations, and those of several pieces (or near the edge of a task), as pieces in the order of (part, no).

    rows(conv_id, turn, role, text); other columns are ignored, nulls of role and text are one space. A conversation's rows go by turn, nulls first, rows of one turn
    by role and then by the MD5 of their text; a null conv_id is a conversation like any other. Both tables hold for each piece conv_id, part, no, audit, cost,
    its counts of faults, illegal pairs inside it, its first and last role initials and turns, and turns: the repaired (role, text). No rows give no rows.
    """
    small_batches(rows.sparkSession)
    rows = rows.selectExpr("conv_id", "cast(turn as long) as turn", "coalesce(cast(role as string), ' ') as role", "coalesce(cast(text as string), ' ') as text")
    conv = rows.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {conv}, no int, inner boolean, turns array<bigint>, roles array<string>, texts array<string>"
    # equal rows may go to several tasks: a number of their own is last in the order
    keyed = rows.withColumns({"_m": F.md5("text"), "_salt": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange("conv_id", "turn", "role", "_m", "_salt").sortWithinPartitions("conv_id", "turn", "role", "_m", "_salt").select("conv_id", "turn", "role", "text")
    schema = _arrow(ddl)
    pieces = cut(dealt.mapInArrow(lambda b: _pieces(b, schema), ddl).withColumn("part", F.spark_partition_id()), "pieces")
    done = f"conv_id {conv}, part int, no int, audit string, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, first_turn bigint, last_turn bigint, n_turns bigint, turns array<struct<role:string,text:string>>"
    full = _arrow(done)
    whole = pieces.where("inner").mapInArrow(lambda b: _repair(b, full, True), done)
    edges = pieces.where("not inner")
    keys = edges.mapInArrow(_keys, f"conv_id {conv}, part int, no int, digest binary, at int")
    # a turn occurs once in a piece's keys, so a group has as many rows as the conversation has pieces
    again = keys.withColumn("_n", F.row_number().over(W.partitionBy("conv_id", "digest").orderBy("part", "no"))).where("_n > 1").groupBy("part", "no").agg(F.collect_list("at").alias("earlier"))
    edges = cut(edges.join(again, ["part", "no"], "left"), "edges")
    prices = edges.mapInArrow(_prices, f"conv_id {conv}, part int, no int, costs array<bigint>, ranks array<int>")
    chosen = prices.groupBy("conv_id").applyInArrow(_chosen, "part int, no int, entry int, exit int, last boolean")
    return whole, edges.join(chosen, ["part", "no"]).mapInArrow(lambda b: _repair(b, full, False), done)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _reports(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Repaired pieces, a conversation's one after the other -> one row a conversation. Texts go through the digest piece by piece."""
    row, digest, before, some, audit = None, hashlib.sha256(), None, False, []

    def ready() -> dict:
        gaps = row["last"] - row["first"] + 1 - row["n"] if row["first"] is not None else 0
        return {c: row[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")} | {"gaps": gaps, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    for batch in batches:
        out = []
        for piece in batch.to_pylist():
            if row is None or piece["conv_id"] != row["conv_id"]:
                if row is not None:
                    out.append(ready())
                row = {"conv_id": piece["conv_id"], "first": None, "last": None, "n": 0} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
                digest, before, some, audit = hashlib.sha256(), None, False, []
            for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                row[c] += piece[c]
            if before is not None:
                row["illegal"] += not before or not piece["first_initial"] or before + piece["first_initial"] not in LEGAL
            before = piece["last_initial"]
            if piece["first_turn"] is not None:
                row["n"] += piece["n_turns"] - (row["last"] == piece["first_turn"])
                row["first"] = piece["first_turn"] if row["first"] is None else row["first"]
                row["last"] = piece["last_turn"]
            audit.append(piece["audit"])
            for turn in piece["turns"]:
                digest.update((("\n" if some else "") + turn["role"] + ":" + turn["text"]).encode())
                some = True
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if row is not None:
        yield pa.RecordBatch.from_pylist([ready()], schema)


def report(rows: DataFrame) -> DataFrame:
    """One row a conversation of rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps: turn numbers that are missing between the least and the greatest, nulls aside. A turn's first fault counts: blank, duplicate (its role and text came
    earlier), truncated. illegal: neighbours whose roles' initials are none of su, ua, au. The digest is that of the repaired "role:text" lines, which go through
    it in order: a conversation of several pieces is read by one task, a piece at a time.
    """
    whole, pieced = repair(rows)
    conv = rows.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {conv}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    schema = _arrow(ddl)
    ordered = pieced.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    return whole.mapInArrow(lambda b: _reports(b, schema), ddl).unionByName(ordered.mapInArrow(lambda b: _reports(b, schema), ddl))


def audit_damaged(conversations: DataFrame) -> DataFrame:
    """report() of the damaged conversations; one that lost all its rows has zeros, an empty audit and the digest of nothing."""
    found = report(damaged(conversations))
    ids = conversations.select("conv_id").distinct()
    both = ids.join(found.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    empty = hashlib.sha256().hexdigest()
    return both.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
