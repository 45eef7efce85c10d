"""Near duplicates by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidate edges.

Documents with equal shingle sets are one class. In each bucket every class is linked to one hub only: first to the smallest class, then,
in buckets that still hold several components, to the class that meets most others over all its buckets (the original of many
copies that are less like each other). What these stars, confirmed on full sets, join needs no further comparison. In buckets that
even then hold several components, sketches of members of different components are compared in bounded blocks, each pair in the first
bucket that it shares, and pairs that may reach the threshold are confirmed as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.blocks import in_blocks
from pitgrid.llm.components import components, extended
from pitgrid.llm.words import SOLID, mix, words_of
from pitgrid.llm.workspace import cut, drop, gathered, small_batches, utf8

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7)
#: For each bin, its own order of trying the others: an empty bin copies the first full one.
_PROBES = np.argsort(np.random.default_rng(20240229).random((BINS, BINS)), axis=1)
_SPREAD = mix(np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_TIMES = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
#: Bits of the parity sketch, and how many standard deviations more than expected at the threshold may differ.
BITS, DEVIATIONS = 2048, 5.0


def shingle_sets(data: np.ndarray, ends: np.ndarray, size: int = 4) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its ``size``-word shingles; all words as one if it has fewer."""
    words = words_of(data, ends, SOLID)
    bounds = np.searchsorted(words.doc, np.arange(len(ends)))
    key = words.key
    if len(key) >= size:
        rolled = sum(key[k : len(key) - size + 1 + k] * _TIMES[k % 4] + np.uint64(k) for k in range(size))
        rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            few = np.uint64(b - a)
            for k in key[a:b]:
                few = mix(np.array([few ^ k]) * _TIMES[0])[0]
            out.append(np.array([few], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """One value a bin from one hash of each shingle: the least in the bin, or that of the first full bin in its own order."""
    at = np.searchsorted(shingles, _EDGES)
    full = np.append(at[1:], len(shingles)) > at
    out = shingles[np.minimum(at, len(shingles) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _PROBES[empty]
        out[empty] = out[order[np.arange(len(empty)), full[order].argmax(1)]]
    return out


def parity(shingles: np.ndarray) -> np.ndarray:
    """For each bit whether an odd number of shingles falls on it: two sets' sketches differ where their difference falls on."""
    return np.packbits((np.bincount((shingles >> np.uint64(20) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8))


def may_be_alike(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Rows of sketches a and b whose sets of n_a and n_b shingles can reach the threshold: by their sizes, and by how many bits differ."""
    differ = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    d = (n_a + n_b) * (100 - percent) / (100 + percent)
    once, twice = (1 - 2 / BITS) ** d, (1 - 4 / BITS) ** d
    spread = np.sqrt(np.maximum(0, BITS / 4 * (1 - twice) + BITS**2 / 4 * (twice - once**2)))
    sized = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sized & (differ <= BITS / 2 * (1 - once) + DEVIATIONS * spread + 1)


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for shard in gathered(batches):
        sets = shingle_sets(*utf8(shard.column("text")), size)
        n = np.array([len(s) for s in sets], np.int64)
        some = n > 0
        h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
        bands = sketches = [None] * len(sets)
        if some.any():
            all_ = np.concatenate(sets)
            begin = (np.cumsum(n) - n)[some]
            h1[some] = np.add.reduceat(mix(all_ ^ _TIMES[1]), begin)
            h2[some] = np.add.reduceat(mix(all_ ^ _TIMES[2]), begin)
            table = np.stack([signature(s) for s in sets if len(s)])
            keys = mix((table * _SPREAD).reshape(-1, BANDS, ROWS).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            small = np.stack([parity(s) for s in sets if len(s)])
            where = iter(range(len(table)))
            bands, sketches = zip(*[(keys[i], small[i].tobytes()) if (i := next(where) if k else -1) >= 0 else (None, None) for k in some.tolist()], strict=True)
        yield pa.RecordBatch.from_pydict(
            {"doc_id": shard.column("doc_id"), "n_shingles": n, "h1": h1.view(np.int64), "h2": h2.view(np.int64), "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.binary())}
        )


def _cross(key: tuple, table: pa.Table, percent: int) -> pa.Table:
    """Pairs of a block whose sketches leave the threshold possible and that are in different components."""
    ids, comps, side, sizes = (table.column(c).to_numpy() for c in ("id", "component", "side", "n_shingles"))
    sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    bands = np.stack(table.column("bands").to_numpy())
    spot = int((bands[0] == key[0].as_py()).argmax())
    left, right = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
    for i in left.tolist():
        to = right[(comps[right] != comps[i]) & ((side[i] == 0) | (right > i))]
        if len(to):
            to = to[may_be_alike(sketches[to], sketches[i], sizes[to], sizes[i], percent)]
            to = to[(bands[to] == bands[i]).argmax(1) == spot]
            out_a.append(np.full(len(to), ids[i]))
            out_b.append(ids[to])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _confirm(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    last: tuple[int | None, np.ndarray | None] = (None, None)
    for batch in gathered(batches, "text_b"):
        ids_a, ids_b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        texts = batch.column("text_a")
        own = shingle_sets(*utf8(batch.column("text_b")), size)
        keep = []
        for k, a in enumerate(ids_a):
            if last[0] != a:
                last = a, shingle_sets(*utf8(texts.slice(k, 1)), size)[0]
            x, y = last[1], own[k]
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, k in zip(ids_a, keep, strict=True) if k], pa.int64()), "b": pa.array([b for b, k in zip(ids_b, keep, strict=True) if k], pa.int64())})


def confirmed(edges: DataFrame, documents: DataFrame, size: int, percent: int, few: int = 400_000) -> DataFrame:
    """The candidate pairs (a, b) whose full sets are similar enough. Only texts of ids in pairs are moved: where they are
    at most ``few``, a broadcast of them selects the texts before the shuffle, else a shuffled semi-join does."""
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    ends = F.broadcast(ends) if ends.count() <= few else ends
    texts = documents.select(F.col("doc_id").alias("id"), "text").where("id is not null").join(ends, "id", "left_semi")
    pairs = edges.join(texts.selectExpr("id as b", "text as text_b"), "b").join(texts.selectExpr("id as a", "text as text_a"), "a")
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(lambda x: _confirm(x, size, percent), "a long, b long")


def near_duplicates(documents: DataFrame, size: int = 4, percent: int = 80, block: int = 2000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    documents(doc_id, text); other columns are ignored. Links join documents with 100 * |both| >= percent * |either|.
    Null and empty texts and texts without words have no shingles and link with nothing. Rows with equal sets are one class, which goes by its
    smallest doc_id; classes with the same smallest doc_id count as one document for links. Each row is returned with the component of its class,
    so rows of one doc_id and unlike texts can have different ones. A row with a null doc_id links with nothing, has a null component and is kept.
    An empty table gives no rows.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plain = cut(docs.mapInArrow(lambda b: _sketch(b, size), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch binary"), "sketches")
    # what is joined back to skewed rows is a table: then both sides are shuffled, and adaptive execution can split large groups
    classes = cut(plain.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "reps")
    rows = plain.join(classes, ["h1", "h2"], "left").selectExpr(
        "doc_id", "n_shingles", "if(n_shingles > 0 and doc_id is not null, rep, doc_id) as rep", "if(doc_id = rep, bands, null) as bands", "if(doc_id = rep, sketch, null) as sketch"
    )
    rows = cut(rows, "classes")
    drop(plain, classes)
    first = rows.where("bands is not null")
    buckets = first.select(F.col("rep").alias("id"), F.explode("bands").alias("bucket"))
    hubs = cut(buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub <> top").select("bucket", "hub"), "hubs")
    members = cut(buckets.join(hubs, "bucket"), "members")
    drop(hubs)
    sketches = first.select(F.col("rep").alias("id"), "bands", "sketch", "n_shingles")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that full sets confirm, as a table."""
        pairs = cut(pairs, name)
        out = cut(confirmed(pairs, docs, size, percent), "links")
        drop(pairs)
        return out

    def star(edges: DataFrame) -> DataFrame:
        """Confirmed links among edges (hub, id) whose sketches leave the threshold possible."""
        pairs = edges.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
        return linked(_agree(pairs, sketches, percent), "stars")

    def unsettled(inside: DataFrame, found: DataFrame) -> DataFrame:
        """Of the members (id, bucket) those in buckets with several components, with their component and the bucket's number of members."""
        placed = cut(inside.join(found, "id", "left").selectExpr("id", "bucket", "coalesce(component, id) as component"), "placed")
        sizes = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high").select("bucket", "n")
        sizes = cut(sizes, "mixed")
        out = cut(placed.join(sizes, "bucket"), "unsettled")
        drop(placed, sizes)
        return out

    links = star(members.where("id <> hub"))
    found = components(links)
    still = unsettled(members.select("id", "bucket"), found)
    drop(members, links)
    company = cut(still.groupBy("id").agg(F.sum("n").alias("company")), "company")
    central = still.join(company, "id").groupBy("bucket").agg(F.max(F.struct("company", (-F.col("id")).alias("minus"), "component")).alias("hub"))
    central = cut(central.selectExpr("bucket", "-hub.minus as hub", "hub.component as hub_component"), "central")
    links = star(still.join(central, "bucket").where("component <> hub_component"))
    before, found = found, extended(found, links)
    # components only grow: a bucket of one component stays so
    earlier, still = still, unsettled(still.select("id", "bucket"), found)
    drop(before, links, company, central, earlier)
    more = in_blocks(still.join(sketches, "id"), ["bucket"], "n", "id", block).applyInArrow(lambda key, table: _cross(key, table, percent), "a long, b long")
    links = linked(more, "cross")
    before, found = found, extended(found, links)
    drop(before, links, still)
    out = rows.select("doc_id", "n_shingles", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    return out.selectExpr("doc_id", "n_shingles", "coalesce(component, rep) as component_id").withColumn("kept", F.expr("doc_id is null or doc_id = component_id"))


def _agreeing(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            keep = may_be_alike(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _agree(edges: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches leave the threshold possible."""
    pairs = edges.join(sketches.selectExpr("id as b", "sketch as sketch_b", "n_shingles as n_b"), "b").join(sketches.selectExpr("id as a", "sketch as sketch_a", "n_shingles as n_a"), "a")
    return pairs.mapInArrow(lambda x: _agreeing(x, percent), "a long, b long").distinct()
