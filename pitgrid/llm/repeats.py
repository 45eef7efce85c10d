"""Exact repeats of at least a given length, by common-prefix interval trees over enhanced suffix arrays.

A text is a sequence of symbols: its bytes, or its words. Each window of ``least`` symbols is handed to the class of its minimiser: the gram
with the smallest hash among the grams inside it. Equal windows have equal minimisers, so they meet; neighbouring windows with one minimiser
stay one segment of text, and a segment that occurs at several places is repeated as a whole. The other segments of a class, cut at the minimiser,
are suffixes in order: a stack scan of their common prefixes gives the tree of intervals, and in each interval the common left extensions of
all members, not just neighbours, give the maximal repeats.

A class of very many different segments never meets in one task: it is divided by longer context. Two segments that share ``least`` symbols
around their gram share at least half of what the gram lacks on its left or on its right, so they meet again in the class of the gram
extended to the left or in that of the gram extended to the right. What lies too far off for such a class is trimmed, which makes segments
equal again, and a gram of ``least`` symbols is all that its class can share, so this ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.llm.words import SOLID, mix, powers, prefix_hashes, words_of
from pitgrid.llm.workspace import SHARD_BYTES, cut, ddl, drop, fresh, gathered, quoted, small_batches, utf8

CHUNK = 1 << 19
#: Bytes of keys that may be broadcast; a key is three 64-bit values.
KEY_BYTES, KEY_SIZE = 8 << 20, 24
_PLACE = np.uint64((1 << 24) - 1)


class Unit(NamedTuple):
    """What a repeat is measured in: symbols of ``width`` bytes, windows of ``least`` symbols, minimisers of ``gram``."""

    least: int
    gram: int
    width: int

    def symbols(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, ends = utf8(column)
        if self.width == 1:
            return data, ends
        words = words_of(data, ends, SOLID, lower=False)
        return words.key, np.searchsorted(words.doc, np.arange(len(column) + 1))

    def raw(self, symbols: np.ndarray) -> bytes:
        return symbols.tobytes() if self.width == 1 else symbols.astype(">u8").tobytes()

    @property
    def least_bytes(self) -> int:
        return self.least if self.width == 1 else 2 * self.least - 1


def of_bytes(least: int, gram: int = 100) -> Unit:
    return Unit(least, min(gram, least), 1)


def of_words(least: int, gram: int = 16) -> Unit:
    return Unit(least, min(gram, least), 8)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, from running minima of blocks in both directions."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    table = padded.reshape(-1, width)
    forth = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], forth[width - 1 : n])


def segments(data: np.ndarray, ends: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """(class, content hash, document, start, size, minimiser's distance from the start) of all runs of windows with one minimiser."""
    least, gram = unit.least, unit.gram
    out: list[tuple[np.ndarray, ...]] = []
    stop = np.repeat(ends[1:], np.diff(ends)) if len(data) else np.zeros(0, np.int64)
    for at in range(0, max(0, len(data) - least + 1), CHUNK):
        part = data[at : at + CHUNK + least - 1]
        windows = len(part) - least + 1
        sums, (_, inverse) = prefix_hashes(part), powers(len(part))
        grams = mix((sums[gram:] - sums[: len(part) - gram + 1]) * inverse[: len(part) - gram + 1])
        order = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        at_ = (sliding_min(order, least - gram + 1) & _PLACE).astype(np.int64)
        start = np.arange(at, at + windows)
        valid = start + least <= stop[at : at + windows]
        # runs never reach over documents: with a minimiser in common their windows overlap, and those between documents are not valid
        new, end = valid.copy(), valid.copy()
        new[1:] &= (at_[1:] != at_[:-1]) | ~valid[:-1]
        end[:-1] &= (at_[1:] != at_[:-1]) | ~valid[1:]
        first, last = np.flatnonzero(new), np.flatnonzero(end)
        pick = at_[first]
        doc = np.searchsorted(ends, start[first], side="right") - 1
        content = mix((sums[last + least] - sums[first]) * inverse[first])
        out.append((mix(grams[pick] ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64), content.view(np.int64), doc, start[first] - ends[doc], last - first + least, pick - first))
    if not out:
        return (np.zeros(0, np.int64),) * 6
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    for shard in gathered(batches):
        cls, content, doc, start, size, off = segments(*unit.symbols(shard.column("text")), unit)
        own = pa.array(doc)
        yield pa.RecordBatch.from_pydict({"cls": cls, "h": content, "size": size.astype(np.int32), "off": off.astype(np.int32), "t": shard.column("t").take(own), "u": shard.column("u").take(own), "start": start})


def _pieces(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """The symbols of each wanted segment of each text, in batches of about SHARD_BYTES: a segment has under 2 * least symbols."""
    step = max(1, SHARD_BYTES // (2 * unit.least * unit.width))
    for batch in batches:
        for k in range(batch.num_rows):
            t, u = (batch.column(c)[k].as_py() for c in ("t", "u"))
            symbols, _ = unit.symbols(batch.column("text").slice(k, 1))
            wanted = batch.column("wanted").slice(k, 1).flatten()
            for at in range(0, len(wanted), step):
                part = wanted.slice(at, step)
                start, size = (part.field(c).to_pylist() for c in ("start", "size"))
                own = {c: part.field(c) for c in ("cls", "start", "off", "several", "crowded")}
                yield pa.RecordBatch.from_pydict(own | {"t": pa.array([t] * len(part), pa.int64()), "u": pa.array([u] * len(part), pa.int64()), "raw": pa.array([unit.raw(symbols[b : b + n]) for b, n in zip(start, size, strict=True)], pa.binary())})


def shared(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    if n > 16 and a[:16] != b[:16]:
        n = 16
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax())


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every interval of an enhanced suffix array; common[i]: the prefix that suffixes i and i + 1 share."""
    stack = [(0, 0)]
    for i, c in enumerate([*common, 0]):
        begin = i
        while stack[-1][0] > c:
            length, begin = stack.pop()
            yield length, begin, i
        if c > stack[-1][0]:
            stack.append((c, begin))


def contexts(rights: list[bytes], lefts: list[bytes], least: int, width: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(right length, members in order of their left contexts, left lengths that neighbours share, each member's child interval) of the intervals that hold a repeat.

    rights: from the common gram on; lefts: before it, its symbols in reverse; lengths are in symbols. Left contexts are sorted once for all intervals: what any two
    share is the least of what the neighbours between them share.
    """
    order, by_left = (sorted(range(len(x)), key=x.__getitem__) for x in (rights, lefts))
    common, near = ([shared(x[a], x[b]) // width for a, b in zip(o[:-1], o[1:], strict=True)] for x, o in ((rights, order), (lefts, by_left)))
    members, between, splits = np.array(by_left, np.int64), np.array([*near, 0], np.int64), np.array(common, np.int64)
    rank = np.empty(len(order), np.int64)
    rank[members] = np.arange(len(order))
    rank = rank[order]
    widest = max(near, default=0)
    for length, begin, end in intervals(common):
        if length + widest < least:
            continue
        inner = np.argsort(rank[begin : end + 1])
        own = rank[begin : end + 1][inner]
        gaps = np.minimum.reduceat(between, own)[:-1]
        if (gaps + length >= least).any():
            yield length, members[own], gaps, np.concatenate(([0], np.cumsum(splits[begin:end] == length)))[inner]


def maximal_repeats(rights: list[bytes], lefts: list[bytes], least: int, width: int = 1) -> Iterator[tuple[int, int, list[int]]]:
    """(left length, right length, all members) of every repeat with left + right >= least that is as long as its members allow.

    The members of an interval of left contexts share no more symbols on the left; those that come from one child interval alone share more on the right, so they
    are met again there and not given out here. Neither side of a group can be extended without losing a member.
    """
    for length, members, gaps, child in contexts(rights, lefts, least, width):
        need = max(0, least - length)
        for left, first, last in intervals(np.maximum(gaps - need + 1, 0).tolist()):
            if (child[first : last + 1] != child[first]).any():
                yield left - 1 + need, length, members[first : last + 1].tolist()


def reaches(rights: list[bytes], lefts: list[bytes], least: int, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """How far each member's maximal repeats reach to the left and to the right; zeros: it has none.

    All of a member's repeats hold its common gram, so their union is one span: deeply nested groups cost no memory here.
    """
    left, right = np.zeros((2, len(rights)), np.int64)
    for length, members, gaps, _ in contexts(rights, lefts, least, width):
        gaps = np.where(gaps + length >= least, gaps, -1)
        most = np.maximum(np.append(gaps, -1), np.append(-1, gaps))
        members, most = members[most >= 0], most[most >= 0]
        left[members] = np.maximum(left[members], most)
        right[members] = np.maximum(right[members], length)
    return left, right


def reversed_symbols(raw: bytes, width: int) -> bytes:
    return raw[::-1] if width == 1 else np.frombuffer(raw, ">u8")[::-1].tobytes()


class Segment(NamedTuple):
    """One content of a class, where it stands first. several: it stands elsewhere too."""

    t: int
    u: int
    start: int
    off: int
    several: bool
    raw: bytes

    def sides(self, width: int) -> tuple[bytes, bytes]:
        return self.raw[width * self.off :], reversed_symbols(self.raw[: width * self.off], width)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Segment]]]:
    """Rows come class by class; a class is held in memory."""
    held: list[Segment] = []
    last = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("cls", *Segment._fields)]
        for cls, *row in zip(*columns, strict=True):
            if cls != last and held:
                yield last, held
                held = []
            last = cls
            held.append(Segment(*row))
    if held:
        yield last, held


def _in_batches(rows: Iterator[tuple], names: list[str], most: int = 5000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], names=names)


def _class_spans(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """What the repeats of a class cover of each segment that stands at one place only."""

    def spans() -> Iterator[tuple[int, int, int, int]]:
        for _, held in _classes(batches):
            if len(held) > 1:
                rights, lefts = zip(*(s.sides(unit.width) for s in held), strict=True)
                for s, left, right in zip(held, *(x.tolist() for x in reaches(rights, lefts, unit.least, unit.width)), strict=True):
                    if left + right and not s.several:
                        yield s.t, s.u, s.start + s.off - left, s.start + s.off + right

    return _in_batches(spans(), ["t", "u", "b", "e"])


def _class_groups(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """(class, number, size, off, t, u, start, b, e): the maximal repeats of a class with all members; b and e count from the segment's start.

    A segment that stands at several places is a repeat by itself, unless others hold all of it: then that group has it as a member.
    """

    def groups() -> Iterator[tuple[int, ...]]:
        for cls, held in _classes(batches):
            rights, lefts = zip(*(s.sides(unit.width) for s in held), strict=True)
            sizes, n = [len(s.raw) // unit.width for s in held], 0
            alone = {k: (s.off, size - s.off) for k, (s, size) in enumerate(zip(held, sizes, strict=True)) if s.several}
            for left, right, members in maximal_repeats(rights, lefts, unit.least, unit.width):
                for k in members:
                    if alone.get(k) == (left, right):
                        del alone[k]
                    s = held[k]
                    yield cls, n, sizes[k], s.off, s.t, s.u, s.start, s.off - left, s.off + right
                n += 1
            for n, k in enumerate(alone, n):
                s = held[k]
                yield cls, n, sizes[k], s.off, s.t, s.u, s.start, 0, sizes[k]

    return _in_batches(groups(), ["cls", "n", "size", "off", "t", "u", "start", "b", "e"])


def _divided(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """Each segment in the classes of its gram extended to the left and to the right, trimmed to what such a class can share."""
    width, least = unit.width, unit.least
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("cls", "h", "size", "off", "t", "u", "start", "p_cls", "p_size", "p_off", "p_start", "known", "raw", "left", "right")}
        names = ("cls", "t", "u", "start", "off", "several", "raw", "left", "right")
        for cls, t, u, start, off, several, raw, left, right in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            lack, size = least - left - right, len(raw) // width
            more = -(-lack // 2)
            for side, l, r in (("L", left + more, right), ("R", left, right + lack - more + 1)):
                if lack < 1 or l > off or r > size - off:
                    continue
                spare = max(0, least - l - r)
                begin, end = max(0, off - l - spare), min(size, off + r + spare)
                if end - begin < least:
                    continue
                gram, own = raw[width * (off - l) : width * (off + r)], raw[width * begin : width * end]
                digest = hashlib.blake2b(gram, digest_size=8, key=b"%d%s" % (cls, side.encode())).digest()
                content = hashlib.blake2b(own, digest_size=8).digest()
                row = (int.from_bytes(digest, "little", signed=True), int.from_bytes(content, "little", signed=True), end - begin, off - begin, t, u, start + begin, cls, size, off, start, several, own, l, r)
                for values, value in zip(out.values(), row, strict=True):
                    values.append(value)
        yield pa.RecordBatch.from_pydict({c: pa.array(v, _TYPES.get(c, pa.int64())) for c, v in out.items()})


_TYPES = {"size": pa.int32(), "off": pa.int32(), "p_size": pa.int32(), "p_off": pa.int32(), "known": pa.bool_(), "raw": pa.binary(), "left": pa.int32(), "right": pa.int32()}
_DIVIDED = "cls long, h long, size int, off int, t long, u long, start long, p_cls long, p_size int, p_off int, p_start long, known boolean, raw binary, left int, right int"
CONTENT, PLACE = ["cls", "h", "size", "off"], ["t", "u", "start"]


def _settled(rows: DataFrame, limit: int, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans of the segments that occur at several places, one place of each content of the classes left to compare, those classes).

    Contents are told apart by class, size, place of the gram and a hash. ``every``: also the classes all of whose contents are settled. What is joined back to skewed rows is a table, so that both sides of the
    join are shuffled and a crowded key can be split.
    """
    place = F.struct(*PLACE)
    contents = rows.groupBy(*CONTENT).agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("known").alias("known"))
    contents = cut(contents.selectExpr(*CONTENT, "low.t as t", "low.u as u", "low.start as start", "known or low <> high as several"), "contents")
    mixed = cut(contents.groupBy("cls").agg(F.count("*").alias("n"), F.min("several").alias("all")).where("n > 1 or all" if every else "n > 1 and not all").select("cls", (F.col("n") > limit).alias("crowded")), "mixed")
    several = cut(contents.where("several").select(*CONTENT), "several")
    spans = rows.where("not known").join(several, CONTENT).selectExpr("t", "u", "start as b", "start + size as e").distinct()
    return spans, contents.join(mixed, "cls"), mixed


def runs(spans: DataFrame, stretch: int = 4096) -> DataFrame:
    """(t, u, b, e) -> the same symbols in few rows: spans that begin in one stretch of a text are merged where they meet.

    A text's spans are never gathered as they are: there can be one for each of its bytes, here at most one for each ``least`` symbols remain.
    """
    own = Window.partitionBy("t", "u", "_at").orderBy("b", "e")
    spans = spans.withColumn("_at", F.expr(f"b div {stretch}"))
    fresh_ = spans.withColumn("_new", F.coalesce(F.col("b") > F.max("e").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    return fresh_.withColumn("_run", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0))).groupBy("t", "u", "_at", "_run").agg(F.min("b").alias("b"), F.max("e").alias("e")).drop("_at", "_run")


def identity(text: str = "text") -> tuple[Column, Column]:
    """Two hashes of a text and its length, in two longs; null is an empty text."""
    own = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(own), F.crc32(own.cast("binary")) * (1 << 31) + F.octet_length(own)


def keyed(documents: DataFrame) -> DataFrame:
    return documents.withColumns(dict(zip("tu", identity(), strict=True)))


def _anchored(documents: DataFrame, unit: Unit) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with ``least`` symbols, their segments, their texts: one row and the number of rows of each)."""
    small_batches(documents.sparkSession)
    docs = keyed(documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "text")).where(f"octet_length(text) >= {unit.least_bytes}")
    anchors = cut(docs.select("text", "t", "u").mapInArrow(lambda b: _anchors(b, unit), "cls long, h long, size int, off int, t long, u long, start long").withColumn("known", F.lit(False)), "anchors")
    return docs, anchors, cut(docs.groupBy("t", "u").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "texts")


def _fetched(docs: DataFrame, texts: DataFrame, left: DataFrame, unit: Unit) -> DataFrame:
    """The contents left to compare with their symbols, one place of each."""
    wanted = left.groupBy("t", "u").agg(F.collect_list(F.struct("cls", "start", "size", "off", "several", "crowded")).alias("wanted")).join(texts.select("t", "u", "rep"), ["t", "u"])
    wanted = cut(wanted, "wanted")
    chosen = chosen_texts(docs, wanted.select("t", "u", F.col("rep").alias("doc_id")))
    pieces = chosen.join(wanted.withColumnRenamed("rep", "doc_id"), ["t", "u", "doc_id"]).select("text", "t", "u", "wanted")
    shape = "cls long, start long, off int, several boolean, crowded boolean, t long, u long, raw binary"
    return cut(pieces.mapInArrow(lambda b: _pieces(b, unit), shape), "pieces").withColumns({"left": F.lit(0), "right": F.lit(unit.gram)})


def _split(pieces: DataFrame, unit: Unit) -> DataFrame:
    return cut(pieces.where("crowded").mapInArrow(lambda b: _divided(b, unit), _DIVIDED), "divided")


def _rejoined(rows: DataFrame, left: DataFrame) -> DataFrame:
    return cut(rows.join(left.select(*CONTENT, *PLACE, "several", "crowded"), [*CONTENT, *PLACE]), "divided-pieces")


def repeat_spans(documents: DataFrame, unit: Unit, class_limit: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(texts with repeats: t, u, rep, spans array<struct<b, e>> unmerged, in symbols; texts that several rows share: t, u, copies).

    Spans are symbols covered by a string of ``least`` symbols that starts elsewhere in the texts too. Of equal texts one stands for all;
    texts that several rows share and that have ``least`` symbols are repeated as a whole, whatever their spans say.
    ``class_limit``: the most different segments that a task compares at once; the result does not depend on it.
    """
    docs, anchors, texts = _anchored(documents, unit)
    whole, left, mixed = _settled(anchors, class_limit)
    whole = cut(whole, "whole-segments")
    drop(anchors)
    pieces = _fetched(docs, texts, left, unit)
    found = [whole, _compared(pieces, unit)]
    while not mixed.where("crowded").isEmpty():
        rows = _split(pieces, unit)
        more, left, mixed = _settled(rows, class_limit)
        pieces = _rejoined(rows, left)
        found += [cut(more, "whole-segments"), _compared(pieces, unit)]
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    spans = cut(runs(spans).groupBy("t", "u").agg(F.collect_list(F.struct("b", "e")).alias("spans")).join(texts.select("t", "u", "rep"), ["t", "u"]), "spans")
    return spans, texts.where("copies > 1").select("t", "u", "copies")


GROUP, MEMBER = ["level", "g_cls", "n"], ["cls", "size", "off", "t", "u", "start"]


def repeat_groups(documents: DataFrame, least: int = 400, gram: int = 100, class_limit: int = 2000) -> DataFrame:
    """Maximal repeats with all their places, one row for each place: passage (SHA-256 of its bytes), n_bytes, n_places, doc_id, start (in bytes).

    documents(doc_id, text); other columns are ignored, null texts are empty. For each string of ``least`` bytes that starts at several places there is one passage
    that holds it at all of them and nowhere else: strings around one gram are extended as far as all members of their group agree, and groups with the same
    places that overlap or touch are joined. A passage's places are all places of its bytes; n_places counts them. The bytes themselves are read at every place, so
    no hash of a segment decides what is equal. Each row of repeated rows, null ids included, is a place of its own. The result is as large as its definition
    says: a place is given once for each passage that holds it. ``class_limit`` as in repeat_spans. An empty table gives no rows.
    """
    unit = of_bytes(least, gram)
    docs, anchors, texts = _anchored(documents, unit)
    _, left, mixed = _settled(anchors, class_limit, every=True)
    pieces = _fetched(docs, texts, left, unit)
    levels, places = [(anchors, left)], _grouped(pieces, [(anchors, left)], unit)
    while not mixed.where("crowded").isEmpty():
        rows = _split(pieces, unit)
        _, left, mixed = _settled(rows, class_limit, every=True)
        pieces = _rejoined(rows, left)
        levels.append((rows, left))
        places = places.unionByName(_grouped(pieces, levels, unit))
    found = _joined_groups(cut(places.distinct(), "places"))
    # a text that several rows share is a passage by itself where some string of it stands in no other text and once in it
    covered = runs(found.selectExpr("t", "u", "b", f"b + n_bytes - {least - 1} as e"), stretch=1 << 40).groupBy("t", "u").agg(F.sum(F.col("e") - F.col("b")).alias("covered"))
    whole = texts.where("copies > 1").selectExpr("t", "u", f"u & {(1 << 31) - 1} as n_bytes").join(covered, ["t", "u"], "left")
    whole = whole.where(f"coalesce(covered, 0) < n_bytes - {least - 1}").selectExpr("t", "u", "0L as b", "n_bytes")
    found = cut(found.unionByName(whole), "groups")
    keys = found.select("t", "u").distinct().join(texts, ["t", "u"])
    read = chosen_texts(docs, keys.selectExpr("t", "u", "rep as doc_id")).dropDuplicates(["t", "u"]).select("t", "u", "text")
    bytes_ = "substring(cast(text as binary), cast(b + 1 as int), cast(n_bytes as int))"
    found = cut(found.join(read, ["t", "u"]).selectExpr(f"sha2({bytes_}, 256) as passage", "n_bytes", "t", "u", "b as start").distinct(), "passages")
    counts = found.join(texts, ["t", "u"]).groupBy("passage").agg(F.sum("copies").alias("n_places"))
    rows = keyed(documents.select("doc_id", "text")).where(f"octet_length(text) >= {least}").select("t", "u", "doc_id")
    return found.join(counts, "passage").join(rows, ["t", "u"]).select("passage", "n_bytes", "n_places", "doc_id", "start")


def _grouped(pieces: DataFrame, levels: list[tuple[DataFrame, DataFrame]], unit: Unit) -> DataFrame:
    """(group, t, u, b, e) of all places of the groups in the classes of the last level.

    A member stands at all places of its content, and these, in a divided class, at all places of the contents that they are parts of.
    """
    usual = pieces.where("not crowded").select("cls", *Segment._fields).repartition("cls").sortWithinPartitions("cls")
    shape = "cls long, n long, size long, off long, t long, u long, start long, b long, e long"
    at = cut(usual.mapInArrow(lambda b: _class_groups(b, unit), shape), "class-groups").withColumns({"level": F.lit(len(levels)), "g_cls": F.col("cls")})
    for level in range(len(levels) - 1, -1, -1):
        rows, left = levels[level]
        own = left.select(*CONTENT, *PLACE)
        up = ["p_cls", "p_size", "p_off", "p_start"] if level else ["0L as p_cls", "0 as p_size", "0 as p_off", "0L as p_start"]
        of = rows.selectExpr(*CONTENT, "t as p_t", "u as p_u", "start as p_at", *up).distinct().join(own, CONTENT).drop("h")
        at = at.join(of, MEMBER).selectExpr(*GROUP, "p_cls as cls", "p_size as size", "p_off as off", "p_t as t", "p_u as u", "p_start as start", "b + p_at - p_start as b", "e + p_at - p_start as e")
    return at.select(*GROUP, "t", "u", "b", "e")


def _joined_groups(places: DataFrame) -> DataFrame:
    """(t, u, b, n_bytes): groups with the same places but for a shift, that overlap or touch, are one.

    Such groups are told by where they stand relative to their first place: the number of places and two sums of hashes of them. The caller reads the bytes.
    """
    first = places.groupBy(*GROUP).agg(F.min(F.struct("t", "u", "b")).alias("first"))
    shape = [F.bit_xor(F.xxhash64(F.lit(seed), "t", "u", F.col("b") - F.col("first.b"))).alias(name) for seed, name in ((1, "x"), (2, "y"))]
    groups = places.join(first, GROUP).groupBy(*GROUP, "first").agg(F.count("*").alias("c"), *shape, F.max(F.col("e") - F.col("b")).alias("n_bytes"))
    groups = groups.selectExpr(*GROUP, "first.t as t", "first.u as u", "first.b as b", "first.b + n_bytes as e", "c", "x", "y")
    family = ["t", "u", "c", "x", "y"]
    own = Window.partitionBy(*family).orderBy("b", "e", *GROUP)
    groups = groups.withColumn("new", F.coalesce(F.col("b") > F.max("e").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    groups = groups.withColumn("run", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    joined = groups.groupBy(*family, "run").agg(F.min(F.struct("b", *GROUP)).alias("low"), (F.max("e") - F.min("b")).alias("n_bytes"))
    return cut(places.join(joined.selectExpr("low.*", "n_bytes").drop("b"), GROUP).select("t", "u", "b", "n_bytes").distinct(), "joined-groups")


def _compared(pieces: DataFrame, unit: Unit) -> DataFrame:
    usual = pieces.where("not crowded").select("cls", "t", "u", "start", "off", "several", "raw")
    return usual.repartition("cls").sortWithinPartitions("cls").mapInArrow(lambda b: _class_spans(b, unit), "t long, u long, b long, e long")


def chosen_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs(t, u, doc_id, ...) that are in keys: by a broadcast of at most KEY_BYTES of keys, else by a shuffle."""
    return docs.join(F.broadcast(keys) if KEY_SIZE * keys.count() <= KEY_BYTES else keys, ["t", "u", "doc_id"], "left_semi")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted((s["b"], s["e"]) for s in spans):
        if out and b <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((b, e))
    return out


def left_over(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in spans)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(b for b, _ in spans), len(text)], strict=True))


def word_edges(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of bytes, from the first word's start to the last one's end."""
    words = words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), SOLID, lower=False)
    return [(int(words.start[b]), int(words.end[e - 1])) for b, e in spans]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            spans = merged(spans)
            rows.append((sum(e - b for b, e in spans), len(spans), hashlib.sha256(left_over((text or "").encode("utf-8", "surrogatepass"), spans)).hexdigest()))
        removed, n, sha = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_pydict({"t": batch.column("t"), "u": batch.column("u"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(n, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def repeat_report(documents: DataFrame, least: int = 400, gram: int = 100, over: int | None = None, **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256[, n_passages, has_passage].

    documents(doc_id, text); other columns are ignored. Null texts are empty; nothing is removed from texts shorter than ``least`` bytes. Every
    occurrence of a repeat goes, the first too. Repeated rows, null ids included, are copies of each other. An empty table gives no rows.
    With ``over``, the maximal runs of words in passages of more than so many whole words that occur elsewhere too are counted as well, however few their
    bytes; they change nothing else. A text that several rows share is one such passage if it is long enough.
    """
    spans, copied = repeat_spans(documents, of_bytes(least, gram), **options)
    docs = keyed(documents.select("doc_id", "text"))
    own = docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    keys = spans.withColumnRenamed("rep", "doc_id")
    some = chosen_texts(own, keys.select("t", "u", "doc_id")).join(keys, ["t", "u", "doc_id"]).select("t", "u", "text", "spans")
    cuts = some.mapInArrow(_digests, "t long, u long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["t", "u"])
    verdicts = cuts.join(copied, ["t", "u"], "full")
    if over is not None:
        passages, again = repeat_spans(documents, of_words(over + 1), **options)
        counted = passages.select("t", "u", _number_of_runs("spans").alias("passages")).join(again.selectExpr("t", "u", "copies as again"), ["t", "u"], "full")
        verdicts = verdicts.join(counted, ["t", "u"], "full")
    verdicts = cut(verdicts, "verdicts")
    base = docs.selectExpr("doc_id", "cast(coalesce(octet_length(text), 0) as long) as n_bytes", "sha2(coalesce(text, ''), 256) as sha", "t", "u", *["text"] * (over is not None))
    whole = f"(copies > 1 and n_bytes >= {least})"
    out = base.join(verdicts, ["t", "u"], "left").selectExpr(
        "doc_id",
        "n_bytes",
        f"if({whole}, n_bytes, coalesce(n_removed, 0L)) as n_removed",
        f"if({whole}, 1L, coalesce(n_spans, 0L)) as n_spans",
        f"if({whole}, sha2('', 256), coalesce(kept_sha256, sha)) as kept_sha256",
        *([f"if(again > 1 and {_more_words(over)}, 1L, coalesce(passages, 0L)) as n_passages"] if over is not None else []),
    )
    return out.withColumn("has_passage", F.col("n_passages") > 0) if over is not None else out


def _number_of_runs(spans: str) -> Column:
    step = "if(x.b > s.at, struct(x.e as at, s.n + 1 as n), struct(greatest(s.at, x.e) as at, s.n as n))"
    return F.expr(f"aggregate(array_sort({spans}), struct(-1L as at, 0L as n), (s, x) -> {step}, s -> s.n)")


def _more_words(over: int, text: str = "text") -> str:
    return rf"size(filter(split({text}, '[ \\t-\\r]+'), x -> x <> '')) > {over}"


def _rewrite(batches: Iterator[pa.RecordBatch], unit: Unit, spans_name: str, whole_name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for k, (spans, whole) in enumerate(zip(batch.column(spans_name).to_pylist(), batch.column(whole_name).to_pylist(), strict=True)):
            if whole:
                texts[k] = ""
            elif spans:
                raw, spans = texts[k].encode("utf-8", "surrogatepass"), merged(spans)
                texts[k] = left_over(raw, spans if unit.width == 1 else word_edges(raw, spans)).decode("utf-8", "ignore")
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string())).drop_columns([spans_name, whole_name])


def _without(documents: DataFrame, unit: Unit, long_enough: str, options: dict) -> DataFrame:
    spans, copied = repeat_spans(documents, unit, **options)
    t, u, own, copies, whole = fresh(documents.columns, "t", "u", "spans", "copies", "whole")
    marks = cut(spans.select("t", "u", "spans").join(copied, ["t", "u"], "full").selectExpr(f"t as {t}", f"u as {u}", f"spans as {own}", f"copies as {copies}"), "marks")
    docs = documents.withColumns(dict(zip((t, u), identity(), strict=True))).join(marks, [t, u], "left")
    docs = docs.select(*[F.col(quoted(c)) for c in documents.columns], own, F.expr(f"if({copies} > 1, {long_enough}, false)").alias(whole))
    return docs.mapInArrow(lambda b: _rewrite(b, unit, own, whole), ddl(documents))


def without_repeats(documents: DataFrame, least: int = 400, gram: int = 100, **options) -> DataFrame:
    """documents with their repeats cut out of the text; characters that a cut splits go too; other columns, null texts and the rows stay."""
    return _without(documents, of_bytes(least, gram), f"octet_length(text) >= {least}", options)


def without_passages(documents: DataFrame, over: int = 50, gram: int = 16, **options) -> DataFrame:
    """documents without the passages of more than ``over`` words that occur elsewhere in them too; other columns, null texts and the rows stay.

    A word is a run of bytes other than ASCII white space. A passage is a run of whole words; the white space between them is not compared. Exactly the
    words in runs of more than ``over`` that occur elsewhere too go, every occurrence, however few their bytes, with what stands between words that
    go. Texts that several rows share and that have more than ``over`` words are repeated as a whole. An empty table gives no rows.
    """
    return _without(documents, of_words(over + 1, gram), _more_words(over), options)
