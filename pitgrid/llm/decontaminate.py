"""Benchmark decontamination with an FM-index per training shard.

A shard is a few MB of whole documents inside one task. Words that no benchmark item has can lie in no occurrence, so they
become one separator symbol, and stretches between separators that are shorter than the shortest window are left out of the
index; everything else is indexed. Windows are searched backwards through ranks of a wavelet matrix, all at once, and
their occurrences are found from sampled suffix positions. No document is shuffled.
"""

from __future__ import annotations

import re
import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.words import ALNUM, words_of
from pitgrid.llm.workspace import cut, gathered, small_batches, utf8

#: A word of the contamination rule, in text whose A-Z are in lower case, and that change of case.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPANS = "array<struct<first:int,after:int>>"


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling; the last symbol must be the smallest and occur once."""
    n, step = len(seq), 1
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        step *= 2
    return order


class WaveletMatrix:
    """Rank and access of a sequence of symbols below 2^bits, in packed bits with a count for every 64."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.planes, self.zeros = bits, [], []
        n = len(seq)
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level & 1).astype(np.uint8)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            packed[: (n + 7) // 8] = np.packbits(bit, bitorder="little")
            plane = packed.view("<u8")
            before = np.zeros(len(plane), np.int32)
            np.cumsum(np.bitwise_count(plane[:-1]), out=before[1:])
            self.planes.append((plane, before))
            self.zeros.append(int(n - bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    @staticmethod
    def _ones(plane: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        bits, before = plane
        block, shift = at >> 6, (at & 63).astype(np.uint64)
        return before[block] + np.bitwise_count(bits[block] & ((np.uint64(1) << shift) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position ``at``."""
        low = np.zeros_like(at)
        for plane, zeros, level in zip(self.planes, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            one = (symbol >> level & 1).astype(bool)
            low1, at1 = self._ones(plane, low), self._ones(plane, at)
            low = np.where(one, zeros + low1, low - low1)
            at = np.where(one, zeros + at1, at - at1)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bits, _ = plane
            one = (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._ones(plane, at)
            out, at = out << 1 | one, np.where(one == 1, zeros + ones, at - ones)
        return out


class FMIndex:
    """Symbols from 1 on; 0 ends the text. ``sample``: every how many text positions a suffix position is stored."""

    def __init__(self, seq: np.ndarray, sample: int = 8):
        seq = np.append(seq, 0).astype(np.int64)
        order = suffix_array(seq)
        last = seq[order - 1]
        self.n, top = len(seq), int(seq.max())
        self.tree = WaveletMatrix(last, max(1, top.bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=top + 1))))
        self.top = top
        marked = order % sample == 0
        self.marked, self.before, self.stored = marked, np.cumsum(marked) - marked, order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of equally long patterns, one a row of the matrix."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for column in patterns.T[::-1]:
            known = column <= self.top
            symbol = np.where(known, column, 0)
            low = self.first[symbol] + self.tree.rank(symbol, low)
            high = np.where(known, self.first[symbol] + self.tree.rank(symbol, high), low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, walk, steps, live = np.empty(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(live):
            done = self.marked[walk]
            out[live[done]] = self.stored[self.before[walk[done]]] + steps
            live, walk = live[~done], walk[~done]
            symbol = self.tree.access(walk)
            walk = self.first[symbol] + self.tree.rank(symbol, walk)
            steps += 1
        return out


class Windows:
    """A block of benchmark windows: the block's vocabulary, the windows by length, and each one's items."""

    def __init__(self, items: list[tuple[object, str]], width: int):
        coded: dict[tuple[int, ...], set[int]] = defaultdict(set)
        ids: dict[str, int] = {}
        texts = pa.array([text for _, text in items], pa.string())
        found = words_of(*utf8(texts), ALNUM)
        self.vocabulary, codes = np.unique(found.key, return_inverse=True)
        bounds = np.searchsorted(found.doc, np.arange(len(items) + 1))
        for k, (item, _) in enumerate(items):
            words = (codes[bounds[k] : bounds[k + 1]] + 2).tolist()
            number = ids.setdefault("" if item is None else str(item), len(ids))
            for at in range(max(1, len(words) - width + 1) if words else 0):
                coded[tuple(words[at : at + width])].add(number)
        self.ids = list(ids)
        self.by_length: list[tuple[np.ndarray, list[list[int]]]] = []
        for length in sorted({len(w) for w in coded}):
            rows = [(w, sorted(s)) for w, s in coded.items() if len(w) == length]
            self.by_length.append((np.array([w for w, _ in rows], np.int64), [s for _, s in rows]))
        self.shortest = min((len(w) for w in coded), default=0)


def find(windows: Windows, words, n_docs: int) -> tuple[list[list[dict]], list[list[str]]]:
    """For each document of a shard: the merged word spans of all occurrences, and the items found."""
    spans: list[list[dict]] = [[] for _ in range(n_docs)]
    items: list[list[str]] = [[] for _ in range(n_docs)]
    if not windows.shortest or not len(words.key):
        return spans, items
    slot = np.minimum(np.searchsorted(windows.vocabulary, words.key), len(windows.vocabulary) - 1)
    known = windows.vocabulary[slot] == words.key
    symbol = np.where(known, slot + 2, 1)
    # stretches of known words of one document, at least as long as the shortest window
    brk = np.ones(len(known) + 1, bool)
    brk[1:-1] = (known[1:] != known[:-1]) | (words.doc[1:] != words.doc[:-1])
    edge = np.flatnonzero(brk)
    begin, size = edge[:-1], np.diff(edge)
    keep = known[begin] & (size >= windows.shortest)
    begin, size = begin[keep], size[keep]
    if not len(begin):
        return spans, items
    # the stretches one after the other, each followed by a separator
    room = size + 1
    origin = np.repeat(begin - np.concatenate(([0], np.cumsum(room)[:-1])), room) + np.arange(room.sum())
    text = symbol[np.minimum(origin, len(symbol) - 1)]
    text[np.cumsum(room) - 1] = 1
    index = FMIndex(text)
    hit = np.zeros(len(known) + 1, np.int32)
    pairs: list[np.ndarray] = []
    for patterns, owners in windows.by_length:
        low, high = index.search(patterns)
        counts = high - low
        some = np.flatnonzero(counts)
        if not len(some):
            continue
        n = counts[some]
        rows = np.repeat(low[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        word = origin[index.locate(rows)]
        np.add.at(hit, word, 1)
        np.add.at(hit, word + patterns.shape[1], -1)
        which, docs = np.repeat(some, n), words.doc[word]
        once = np.unique(docs * len(patterns) + which)
        for doc, pattern in zip((once // len(patterns)).tolist(), (once % len(patterns)).tolist(), strict=True):
            items[doc].extend(owners[pattern])
    covered = np.cumsum(hit[:-1]) > 0
    brk[1:-1] = (covered[1:] != covered[:-1]) | (words.doc[1:] != words.doc[:-1])
    edge = np.flatnonzero(brk)
    first_word = np.searchsorted(words.doc, np.arange(n_docs))
    for a, b in zip(edge[:-1][covered[edge[:-1]]].tolist(), edge[1:][covered[edge[:-1]]].tolist(), strict=True):
        doc = words.doc[a]
        base = int(first_word[doc])
        spans[doc].append({"first": a - base, "after": b - base})
    return spans, [sorted({windows.ids[i] for i in own}) for own in items]


def scan(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
    windows = block.value
    for shard in gathered(batches):
        data, ends = utf8(shard.column("text"))
        words = words_of(data, ends, ALNUM)
        spans, items = find(windows, words, shard.num_rows)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": shard.column("doc_id"),
                "check": shard.column("check"),
                "n_words": pa.array(np.bincount(words.doc, minlength=shard.num_rows).astype(np.int64)),
                "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))),
                "items": pa.array(items, pa.list_(pa.string())),
            }
        )


def blocks_of(benchmark: DataFrame, width: int, block_words: int) -> Iterator[tuple[Windows, bool]]:
    """(windows, whether more follow), each block built when it is asked for; at least one, which can be empty.

    An item of more than ``block_words`` words comes in parts that share width - 1 words, under its one id: the same windows.
    """
    held, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        parts = [row.text]
        if len(row.text) > 2 * block_words and len(words := _WORD.findall(row.text.translate(_LOWER))) > block_words + width:
            parts = [" ".join(words[at : at + block_words + width - 1]) for at in range(0, len(words) - width + 1, block_words)]
        for part in parts:
            if size >= block_words:
                yield Windows(held, width), True
                held, size = [], 0
            held.append((row.item_id, part))
            size += len(part) // 2 + 1
    yield Windows(held, width), False


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, block_words: int = 400_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (word positions), items, check (a hash of the text).

    documents(doc_id, text), benchmark(item_id, text); other columns are ignored. A window is ``width`` consecutive words of an
    item, or all words of a shorter one. A document is contaminated if n_hit > 0 and share * n_hit >= n_words.
    Null and empty texts have no words and are clean; an item without words has no window; an item with a null id counts as one
    with the id ''; items that share an id are one; repeated document rows each get their row. An empty benchmark marks nothing.

    The windows go to the executors in blocks of at most ``block_words`` possible words each, so what is broadcast is bounded: each block's
    hits are written out and its broadcast dropped before the next block is read. Hits are merged for each (doc_id, text) and joined back to all rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("check"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    passes: list[DataFrame] = []
    for windows, more in blocks_of(benchmark, width, block_words):
        block = spark.sparkContext.broadcast(windows)
        out = docs.mapInArrow(lambda batches, block=block: scan(batches, block), f"doc_id {kind}, check long, n_words long, spans {SPANS}, items array<string>")
        if more or passes:
            # the first pass counts every row's words; of the others only hits are needed
            passes.append(cut(out if not passes else out.where("size(spans) > 0"), "passes"))
            block.destroy()
        del windows
    if passes:
        hits = passes[0].where("size(spans) > 0")
        for more in passes[1:]:
            hits = hits.unionByName(more)
        merged = hits.distinct().groupBy(F.col("doc_id").alias("_id"), F.col("check").alias("_check")).agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("_items"))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("check").eqNullSafe(F.col("_check"))
        out = passes[0].select("doc_id", "check", "n_words").join(cut(merged, "merged-hits"), same, "left")
        out = out.select("doc_id", "check", "n_words", F.coalesce("_spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"), F.coalesce("_items", F.expr("cast(array() as array<string>)")).alias("items"))
    n_hit = F.expr("aggregate(array_sort(spans), (0L, 0L), (s, x) -> (greatest(s.col1, cast(x.after as long)), s.col2 + greatest(0L, cast(x.after as long) - greatest(s.col1, cast(x.first as long)))), s -> s.col2)")
    return (
        out.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))
        .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items", "check")
    )
