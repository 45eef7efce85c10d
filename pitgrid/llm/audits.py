"""What each of five filters removes in every order that they can be applied in.

Equal texts are found by an RDD that is routed by fingerprint: a task folds its own copies first, so that a text leaves it at most once (more often where it holds
much text), and the task of a fingerprint keeps a chain of the texts that collide there, whole, each with its least id. Ids that are not least are emitted where
that is known. From then on a document is five bits; counts of the 32 masks are merged by key, and all orders are read off them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.workspace import cut

FILTERS = "ABCDE"
FEW_WORDS, REPEATED, CAPITALS, MARKUP, COPY = (1 << k for k in range(5))
#: Text that a task holds in chains before it sends them on; and that a fingerprint's task is dealt.
HELD_BYTES, DEALT_BYTES = 32 << 20, 48 << 20
_CAPITALS, _MARKS = bytes(range(65, 91)), b"#$%&*|"


def own_mask(text: str) -> int:
    """The filters that a text fails by itself: A under 100 words, B under 80 % of them distinct, C over 10 % of its characters A to Z, D one of #$%&*|."""
    raw = text.encode()
    words = raw.split()
    mask = FEW_WORDS if len(words) < 100 else 0
    if 100 * len(set(words)) < 80 * len(words):
        mask |= REPEATED
    if 100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 10 * len(text):
        mask |= CAPITALS
    return mask | (MARKUP if len(raw.translate(None, _MARKS)) < len(raw) else 0)


class Chains:
    """Fingerprint -> texts that have it, each with its mask, its least id and how many rows of each part have that id."""

    def __init__(self) -> None:
        self.of: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, text: str, mask: int | None, at: int, parts: dict[str, int]) -> Iterator[tuple]:
        """Takes rows of one id; yields (id, part, mask, n) of those that now have an equal text under a smaller id."""
        chain = self.of.setdefault(key, [])
        for link in chain:
            if link[0] == text:
                break
        else:
            self.bytes += len(text) + 200
            chain.append([text, own_mask(text) if mask is None else mask, at, dict(parts)])
            return
        if at > link[2]:
            yield from ((at, part, link[1] | COPY, n) for part, n in parts.items())
        elif at == link[2]:
            for part, n in parts.items():
                link[3][part] = link[3].get(part, 0) + n
        else:
            yield from ((link[2], part, link[1] | COPY, n) for part, n in link[3].items())
            link[2:] = at, dict(parts)


def _folded(rows: Iterable) -> Iterator[tuple]:
    """Rows of a task -> (fingerprint, one of its texts with its least id here), and ids that are not least, under any key."""
    chains = Chains()
    for at, text, part in rows:
        if at is None:
            yield 0, (None, part, own_mask(text), 1)
            continue
        key = xxhash.xxh64_intdigest(text)
        for out in chains.add(key, text, None, at, {part: 1}):
            yield out[0] & 0xFFFFFFFF, out
        if chains.bytes > HELD_BYTES:
            yield from ((k, tuple(link)) for k, chain in chains.of.items() for link in chain)
            chains = Chains()
    yield from ((k, tuple(link)) for k, chain in chains.of.items() for link in chain)


def _least(routed: Iterable) -> Iterator[tuple]:
    """All texts of a task's fingerprints -> (id, part, mask, n)."""
    chains = Chains()
    for key, row in routed:
        if isinstance(row[3], dict):
            yield from chains.add(key, *row)
        else:
            yield row
    for chain in chains.of.values():
        for _, mask, at, parts in chain:
            yield from ((at, part, mask, n) for part, n in parts.items())


def masks(documents: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n), a table: n rows of documents with this id and lang fail the filters of mask (bits 0 to 4 for A to E).

    documents(doc_id, text, lang): null texts are empty, null langs the empty part, other columns are ignored. E fails where a smaller doc_id has the same text; rows
    without a doc_id neither fail it nor make others fail. A document of n equal rows may be in several rows of the result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(docs.rdd.getNumPartitions(), -(-size // DEALT_BYTES), 1)
    out = docs.rdd.map(tuple).mapPartitions(_folded).partitionBy(tasks, lambda key: key).mapPartitions(_least)
    return cut(documents.sparkSession.createDataFrame(out, "doc_id long, part string, mask int, n long", verifySchema=False), "masks")


def repeated_ids(documents: DataFrame) -> DataFrame:
    """doc_id of every document with a text that a smaller id has too."""
    return masks(documents).where(f"mask & {COPY} <> 0").select("doc_id").distinct()


def _start(row: tuple) -> np.ndarray:
    return _add(np.zeros((3, 32), np.int64), row)


def _add(counts: np.ndarray, row: tuple) -> np.ndarray:
    mask, n, good, toxic = row
    counts[:, mask] += (n, n * good, n * toxic)
    return counts


def _orders(item: tuple[str, np.ndarray]) -> Iterator[tuple]:
    """The counts of a part -> a row for each order and step."""
    part, (all_, good, toxic) = item
    mask = np.arange(32)
    popular = np.array([120 // max(1, m.bit_count()) for m in range(32)])
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            fails, earlier = mask & bit != 0, mask & before != 0
            here = fails & ~earlier
            yield (part, "".join(order), step, *(int(x) for x in (all_[~fails & ~earlier].sum(), all_[here].sum(), all_[fails & earlier].sum(), all_[bit], good[here].sum(), toxic[here].sum(), (all_ * popular)[fails].sum())))
            before |= bit


def interactions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    labels(doc_id, quality, toxic): a document is good (toxic) if a label row of its doc_id has quality (toxic) 1; other columns are ignored. An empty
    table of documents has no parts and gives no rows.
    """
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic"))
    told = masks(documents).join(known, "doc_id", "left").selectExpr("part", "mask", "n", "coalesce(good, 0) as good", "coalesce(toxic, 0) as toxic")
    counts = told.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(_start, _add, np.add)
    ddl = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return documents.sparkSession.createDataFrame(counts.flatMap(_orders), ddl, verifySchema=False)
