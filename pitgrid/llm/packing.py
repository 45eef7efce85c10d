"""Harmonic packing of token ids into fixed-length sequences.

A piece of length n belongs to the reciprocal-capacity class k with capacity/(k+1) < n <= capacity/k, whose bins take exactly
k pieces; pieces of at most capacity/``classes`` ids share the last class. Cutting is free, so a document is cut where the rooms that its
pieces leave in their classes' bins are least. Each worker fills the bins of each class on its own; only the bins that are open at its
end, at most one a class, are joined with those of a few other workers.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.tokens import encoded
from pitgrid.llm.workspace import cut, small_batches

FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bin_class", "worker")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bin_class int, worker int"
#: What a further piece counts, in ids of room.
PIECE_COST = 3.0


def class_of(n: int, capacity: int, classes: int) -> int:
    return min(classes, capacity // n)


@functools.cache
def first_pieces(capacity: int, classes: int) -> list[int]:
    """For each number of ids below the capacity, the length of its first piece in the cut that leaves least room.

    The room of a piece is its share of its class's bin, capacity / k, less its length; only a document's last piece is not the longest of its class.
    """
    longest = sorted({capacity // k for k in range(1, classes + 1)})
    cost, first = np.zeros(capacity), [0] * capacity
    for n in range(1, capacity):
        best, first[n] = capacity / class_of(n, capacity, classes) - n + PIECE_COST, n
        for m in longest:
            if m >= n:
                break
            if (c := capacity / class_of(m, capacity, classes) - m + PIECE_COST + cost[n - m]) < best:
                best, first[n] = c, m
        cost[n] = best
    return first


def cuts(n: int, capacity: int, classes: int) -> list[int]:
    """Lengths of the pieces of n ids: whole sequences first."""
    whole, rest = divmod(n, capacity)
    out, first = [capacity] * whole, first_pieces(capacity, classes)
    while rest:
        out.append(first[rest])
        rest -= first[rest]
    return out


def _pack(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int, classes: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    worker = TaskContext.get().partitionId()
    made = 0
    open_: dict[int, list[list]] = {}
    rows: list[list] = []

    def batch(rows: list[list]) -> pa.RecordBatch:
        names = [*FIELDS, *["ids"] * keep_ids]
        kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.binary()] * keep_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for docs, all_ids in encoded(batches, path, end):
        for doc_id, ids in zip(docs, all_ids, strict=True):
            n, at = len(ids) // 4, 0
            for length in cuts(n, capacity, classes):
                own, k = ids[4 * at : 4 * (at + length)], class_of(length, capacity, classes)
                bin_ = open_.setdefault(k, [])
                bin_.append([doc_id, at, length, zlib.crc32(own), n, None, None, k, worker, *[own] * keep_ids])
                at += length
                if len(bin_) == k:
                    offset = 0
                    for piece in bin_:
                        piece[5:7] = worker << 32 | made, offset
                        offset += piece[2]
                    made += 1
                    rows += open_.pop(k)
        if len(rows) > 4000:
            yield batch(rows)
            rows = []
    rows += [p for bin_ in open_.values() for p in bin_]
    if rows:
        yield batch(rows)


def _join_open(key: tuple, table: pa.Table, capacity: int) -> pa.Table:
    """Open bins of a group of workers, longest pieces first: what a sequence leaves is less than the piece that comes next."""
    table = table.sort_by([("length", "descending"), ("worker", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    sequence, offset, out_s, out_o = 0, 0, [], []
    for length in table.column("length").to_pylist():
        if offset + length > capacity:
            sequence, offset = sequence + 1, 0
        out_s.append(1 << 62 | key[0].as_py() << 24 | sequence)
        out_o.append(offset)
        offset += length
    for name, values in (("sequence_id", out_s), ("offset", out_o)):
        table = table.set_column(table.schema.get_field_index(name), name, pa.array(values, pa.int64()))
    return table


def pack(documents: DataFrame, path: str, end: int = 1, capacity: int = 2048, classes: int = 64, workers_joined: int = 32, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bin_class[, ids].

    documents(doc_id, text); other columns are ignored. Null and empty texts hold the end id alone; repeated rows are packed each; an
    empty table gives no rows. Bins of a class k take k pieces, so what they leave is what their pieces are shorter than capacity / k.
    No text or id is shuffled, only the pieces of open bins: fewer than 1 + 2 + ... + ``classes`` for a worker, joined for ``workers_joined`` workers
    (about 64,000 pieces at most as a rule, 6 MB).
    """
    if not 1 <= classes <= capacity:
        raise ValueError("classes must be from 1 to the capacity")
    small_batches(documents.sparkSession)
    schema = SCHEMA + ", ids binary" * keep_ids
    pieces = cut(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _pack(b, path, end, capacity, classes, keep_ids), schema), "pieces")
    rest = pieces.where("sequence_id is null").groupBy((F.col("worker") / workers_joined).cast("int").alias("team")).applyInArrow(lambda key, table: _join_open(key, table, capacity), schema)
    return pieces.where("sequence_id is not null").unionByName(rest).drop("worker")
