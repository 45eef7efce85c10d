"""Passages that documents share, by seeds that are extended both ways: each stays in the document with the smallest id.

Seeds are winnowed anchors: of the grams in any ``least`` consecutive words the one with the least hash, so documents that share so many words share the seed at
the same place in them. Documents are joined on their seeds. From a seed a match is extended to the left and to the right for as long as the alignments of ``least``
words around it hold, all documents of a seed at once: those whose whole extension is the same are one class, of which only the smallest id takes part further;
classes that agree on a part of their extensions meet on that part. No pair of documents is written out. Neighbouring extensions join to maximal repeats.
Equality is judged by two independent 64-bit hashes, of the seed and of the extended words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.words import SOLID, Words, mix, powers, words_of
from pitgrid.llm.workspace import cut, drop, fresh, gathered, quoted, small_batches, utf8

_SEED = "struct<at:int,n:int,anchor:bigint,whole:bigint>"


def least_places(values: np.ndarray, span: int) -> np.ndarray:
    """For each i the leftmost place of the least of values[i : i + span], by doubling."""
    n = len(values) - span + 1
    at, reach = np.arange(len(values)), 1
    while reach < span:
        step = min(reach, span - reach)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        reach += step
    return at[:n]


def run_hashes(keys: np.ndarray) -> np.ndarray:
    """c with (c[j] - c[i]) * inverse power i as the hash of the words i to j."""
    out = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(keys * powers(len(keys) + 1)[0][: len(keys)], out=out[1:])
    return out


def between(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[begin]) * powers(len(sums))[1][begin])


def seeds(words: Words, n_docs: int, least: int, gram: int) -> list[list[dict]]:
    """For each document its seeds: the first alignment that has it, how many follow one another, and the hashes of the seed and of all words that they cover."""
    out: list[list[dict]] = [[] for _ in range(n_docs)]
    n = len(words.key)
    if n < least:
        return out
    sums = run_hashes(words.key)
    grams = between(sums, np.arange(n - gram + 1), np.arange(gram, n + 1))
    begin = np.flatnonzero(words.doc[: n - least + 1] == words.doc[least - 1 :])
    if not len(begin):
        return out
    place = least_places(grams, least - gram + 1)[begin]
    edge = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (words.doc[begin[1:]] != words.doc[begin[:-1]])))
    lo, count, place = begin[edge], np.diff(np.append(edge, len(begin))), place[edge]
    whole = between(sums, lo, lo + count - 1 + least) ^ mix(((place - lo).astype(np.uint64) << np.uint64(32)) + count.astype(np.uint64))
    first = np.searchsorted(words.doc, np.arange(n_docs))
    for doc, at, k, a, w in zip(words.doc[lo].tolist(), (lo - first[words.doc[lo]]).tolist(), count.tolist(), grams[place].view(np.int64).tolist(), whole.view(np.int64).tolist(), strict=True):
        out[doc].append({"at": at, "n": k, "anchor": a, "whole": w})
    return out


def texts_of(data: np.ndarray, words: Words, kept: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """Each document's kept words, one space between them."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.start[kept]] += 1
    inside[words.end[kept]] -= 1
    inside = np.cumsum(inside[:-1]).astype(bool)
    docs = words.doc[kept]
    # before every kept word that is not its document's first there is white space
    spaces = words.start[kept][1:][docs[1:] == docs[:-1]] - 1
    data = data.copy()
    data[spaces] = 32
    inside[spaces] = True
    upto = np.append(0, np.cumsum(inside))[ends]
    left = data[inside].tobytes()
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        yield left[a:b]


def _seeded(batches: Iterator[pa.RecordBatch], least: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Each row with its words and the digest of them all; rows that a task has seen before have no seeds."""
    seen = set()
    for shard in gathered(batches):
        data, ends = utf8(shard.column("text"))
        words = words_of(data, ends, SOLID, lower=False)
        found = seeds(words, len(ends) - 1, least, gram)
        for k, row in enumerate(zip(shard.column("doc_id").to_pylist(), shard.column("check").to_pylist(), strict=True)):
            if row[0] is None or row in seen:
                found[k] = []
            seen.add(row)
        digests = [hashlib.sha256(t).hexdigest() for t in texts_of(data, words, np.ones(len(words.key), bool), ends)]
        n_words = np.bincount(words.doc, minlength=len(ends) - 1)
        yield pa.RecordBatch.from_arrays(
            [shard.column("doc_id"), shard.column("check"), pa.array(n_words, pa.int64()), pa.array(digests), pa.array(found, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("whole", pa.int64())])))],
            names=["doc_id", "check", "n_words", "sha256", "seeds"],
        )


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that the task has not seen before."""
    seen = set()
    for batch in batches:
        fresh = []
        for row in zip(batch.column("doc_id").to_pylist(), batch.column("check").to_pylist(), strict=True):
            fresh.append(row not in seen)
            seen.add(row)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _extended(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """For each asked class of a document the hashes of its seed's extensions: alignment by alignment, from the leftmost on."""
    for batch in batches:
        for k in range(batch.num_rows):
            words = words_of(*utf8(batch.column("text").slice(k, 1)), SOLID, lower=False)
            sums = run_hashes(words.key)
            asked = batch.column("asked")[k].as_py()
            begin = np.concatenate([np.arange(s["at"], s["at"] + s["n"]) for s in asked])
            keys = between(sums, begin, begin + least).view(np.int64)
            sizes = [s["n"] for s in asked]
            offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            columns = [pa.array([s[c] for s in asked], pa.int64()) for c in ("anchor", "whole")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([batch.column("doc_id")[k].as_py()] * len(asked), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(keys))], names=["anchor", "whole", "first", "keys"])


def _kept(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows with matches -> the removed runs of words, and what is left."""
    for batch in batches:
        spans, left = [], []
        for k in range(batch.num_rows):
            data, ends = utf8(batch.column("text").slice(k, 1))
            words = words_of(data, ends, SOLID, lower=False)
            gone = np.zeros(len(words.key) + 1, np.int64)
            for m in batch.column("matches")[k].as_py():
                begin = m["at"] + np.flatnonzero([m["mask"] >> o & 1 for o in range(m["n"])])
                np.add.at(gone, begin, 1)
                np.add.at(gone, begin + least, -1)
            gone = np.cumsum(gone[:-1]) > 0
            turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans.append([{"begin": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)])
            left.append(next(texts_of(data, words, ~gone, ends)).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("check"), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(left, pa.string())], names=["doc_id", "check", "spans", "left"])


def repeats_of_earlier(documents: DataFrame, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """(rows, removed) for the runs of ``least`` or more words that also start in a document with a smaller id; least is 5 or more.

    rows, a table, has for each row of documents(doc_id, text): doc_id, check (a hash of its text), n_words and sha256 (of its words, one space between them).
    removed, a table, has for each (doc_id, check) that loses words: spans, the maximal runs of words removed, and left, the words that stay.
    Words are maximal runs without ASCII white space, unchanged. Other columns are ignored. Null and empty texts have no words; a row without a
    doc_id is compared with none; rows of one doc_id are not compared with each other. No rows give no rows.
    """
    if least < 5:
        raise ValueError("a repeat has five words or more")
    small_batches(documents.sparkSession)
    # alignments of one seed are bits of a long
    gram = max(2 * least // 5, least - 62, 1)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("check", F.xxhash64("text"))
    rows = cut(docs.mapInArrow(lambda b: _seeded(b, least, gram), f"doc_id long, check long, n_words long, sha256 string, seeds array<{_SEED}>"), "seeded")
    found = rows.select("doc_id", "check", F.explode("seeds").alias("s")).select("doc_id", "check", "s.*")
    # tables on both sides of a join: adaptive execution can then split what hangs on one key
    shared = cut(found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"), "shared")
    joined = cut(found.join(shared, "anchor"), "joined")
    classes = joined.groupBy("anchor", "whole").agg(F.min(F.struct("doc_id", "check", "at", "n")).alias("r"), F.max("doc_id").alias("last"))
    classes = cut(classes.select("anchor", "whole", "r.*", "last").withColumnRenamed("doc_id", "first"), "classes")
    several = cut(classes.groupBy("anchor").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b").select("anchor"), "several")
    asked = classes.join(several, "anchor").groupBy(F.col("first").alias("doc_id"), "check").agg(F.collect_list(F.struct("at", "n", "anchor", "whole")).alias("asked"))
    asked = cut(asked, "asked")
    once = lambda: docs.where("doc_id is not null and text is not null").mapInArrow(_once, "doc_id long, text string, check long")
    extended = once().join(asked, ["doc_id", "check"]).mapInArrow(lambda b: _extended(b, least), "anchor long, whole long, first long, keys array<bigint>")
    extended = cut(extended, "extended")
    alignments = extended.select("anchor", "whole", "first", F.posexplode("keys").alias("o", "key"))
    meeting = cut(alignments.groupBy("anchor", "key").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b").select("anchor", "key", "a"), "meeting")
    agreed = alignments.join(meeting, ["anchor", "key"]).where("first > a").groupBy("anchor", "whole").agg(F.expr("bit_or(shiftleft(1L, o))").alias("mask"))
    agreed = cut(agreed, "agreed")
    # a class's smallest document loses what it shares with other classes, the others lose everything that the class covers
    settled = cut(classes.where("last > first").join(agreed, ["anchor", "whole"], "left").unionByName(classes.where("last = first").join(agreed, ["anchor", "whole"])).select("anchor", "whole", "first", "mask"), "settled")
    matches = joined.join(settled, ["anchor", "whole"]).select("doc_id", "check", "at", "n", F.expr("if(doc_id > first, -1L, mask)").alias("mask")).where("mask is not null")
    matches = cut(matches.groupBy("doc_id", "check").agg(F.collect_set(F.struct("at", "n", "mask")).alias("matches")), "matches")
    removed = once().join(matches, ["doc_id", "check"]).mapInArrow(lambda b: _kept(b, least), "doc_id long, check long, spans array<struct<begin:bigint,end:bigint>>, left string")
    removed = cut(removed.dropDuplicates(["doc_id", "check"]), "removed")
    drop(shared, joined, classes, several, asked, extended, meeting, agreed, settled, matches)
    return rows.drop("seeds"), removed


def overlap_report(documents: DataFrame, least: int = 50) -> DataFrame:
    """One row a row of documents: doc_id, n_words, n_removed, kept_sha256 (of the words that stay, one space between them)."""
    rows, removed = repeats_of_earlier(documents, least)
    gone = removed.select("doc_id", "check", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.begin)").alias("n_removed"), F.sha2("left", 256).alias("_left"))
    out = rows.join(gone, ["doc_id", "check"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("_left", "sha256").alias("kept_sha256"))


def without_overlaps(documents: DataFrame, least: int = 50) -> DataFrame:
    """documents without the repeats; a text that loses none is unchanged, of others the words that stay are joined by single spaces."""
    doc, check, left, own = fresh(documents.columns, "doc", "check", "left", "own")
    removed = repeats_of_earlier(documents, least)[1].selectExpr(f"doc_id as {doc}", f"check as {check}", f"left as {left}")
    keys = documents.withColumn(own, F.xxhash64("text"))
    out = keys.join(removed, (F.col("doc_id").cast("long") == F.col(doc)) & (F.col(own) == F.col(check)), "left")
    return out.select(*[F.coalesce(left, "text").alias("text") if c == "text" else F.col(quoted(c)) for c in documents.columns])
