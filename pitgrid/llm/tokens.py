"""Token ids of texts, and seekable zstandard files that hold them."""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.workspace import cut, drop, gathered, new_path, remove, small_batches, utf8

#: Pretokens whose ids a worker remembers, in each of two generations.
REMEMBERED = 350_000
#: Text that is encoded at once.
CODED_BYTES = 2 << 20
LETTER, NUMBER, OTHER, BLANK, UNSURE = range(5)
#: The contractions that the vocabulary's pattern takes after an apostrophe.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
_encoders: dict[str, "Encoder"] = {}


def kinds_of_characters() -> np.ndarray:
    """What each code point is to the pattern. UNSURE: white space beyond ASCII, and what is not assigned or has changed since Unicode 3.2."""
    kinds = np.full(0x110000, UNSURE, np.uint8)
    for c in range(0x30000):
        now, then = unicodedata.category(chr(c))[0], unicodedata.ucd_3_2_0.category(chr(c))[0]
        if now == then and now != "Z":
            kinds[c] = {"L": LETTER, "N": NUMBER}.get(now, OTHER)
    kinds[[9, 10, 11, 12, 13, 32]] = BLANK
    kinds[[*range(0x1C, 0x20), 0x85]] = UNSURE
    return kinds


def pretokens(points: np.ndarray, kinds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First characters of the pretokens of documents with the given ends, by their characters' code points and kinds.

    A pretoken is a contraction, a run of letters, of digits or of other characters with one space before it, or white space: of a
    run before something else, its last character goes with what follows if it is a space and is a pretoken alone if not.
    """
    n = len(points)
    fresh = np.zeros(n + 1, bool)
    fresh[ends[:-1]] = True
    fresh[n] = True
    start = fresh[:-1].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    blank = kinds == BLANK
    last = blank[:-1] & ~blank[1:] & ~fresh[1:-1]
    start[:-1] |= last
    start[np.flatnonzero(last & (points[:-1] == 32)) + 1] = False
    at = np.flatnonzero((points == 39) & start)
    if len(at):
        room = ends[np.searchsorted(ends, at, side="right")] - at
        first, second = (np.where(room > k, points[np.minimum(at + k, n - 1)], 0) for k in (1, 2))
        short = np.isin(first, [ord(c) for c in ONE_LETTER])
        long = np.logical_or.reduce([(first == ord(a)) & (second == ord(b)) for a, b in TWO_LETTERS])
        hit = short | long
        start[at[hit] + 1] = False
        after = at[hit] + np.where(short[hit], 2, 3)
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of whole texts by a tokenizer of the tokenizers library, as ``encode(text, add_special_tokens=False)`` gives them.

    For a byte-level BPE with the usual pattern, texts are cut into pretokens over whole buffers; each distinct pretoken goes through the
    library, many in one call, and its ids are remembered, up to a bound. Texts that hold a special token's string or a character whose kind
    is not sure, and all texts of other tokenizers, go through the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plan = json.loads(self.tokenizer.to_str())
        before, model = plan["pre_tokenizer"] or {}, plan["model"]
        self.usual = (
            before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True) and not plan["normalizer"]
            and model["type"] == "BPE" and not model["dropout"] and not model["continuing_subword_prefix"] and not model["end_of_word_suffix"]
        )
        self.special = [x["content"] for x in plan["added_tokens"]]
        if self.usual:
            vocabulary = self.tokenizer.get_vocab()
            self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
            self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
            self.line_end = vocabulary["\u010a"]
            self.kinds = kinds_of_characters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; a null text has none."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not self.usual:
            return self._whole([t or "" for t in column.to_pylist()])
        data, ends = utf8(column)
        if not len(data):
            return [b""] * len(column)
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
        place = None
        if len(points) < len(data):
            place = np.flatnonzero((data & 0xC0) != 0x80)
            ends = np.searchsorted(place, ends)
        kinds = self.kinds[points]
        odd = set((np.searchsorted(ends, np.flatnonzero(kinds == UNSURE), side="right") - 1).tolist())
        for token in self.special:
            odd |= set(np.flatnonzero(pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)).tolist())
        if odd:
            plain = column.to_pylist()
            found = self.encode(["" if i in odd else t for i, t in enumerate(plain)])
            for i, ids in zip(sorted(odd), self._whole([plain[i] for i in sorted(odd)]), strict=True):
                found[i] = ids
            return found
        begin = pretokens(points, kinds, ends[np.append(True, np.diff(ends) > 0)])
        offsets = np.append(begin if place is None else place[begin], len(data)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        own, which = self._ids(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        # each pretoken's ids one after the other, then those of all pretokens in the order of the texts
        ids, sizes = np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) // 4
        n = sizes[which]
        after = np.concatenate(([0], np.cumsum(n)))
        ids = ids[np.repeat((np.cumsum(sizes) - sizes)[which] - after[:-1], n) + np.arange(after[-1])]
        edges = after[np.searchsorted(begin, ends)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _ids(self, distinct: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        own = list(map(self.known.get, distinct))
        missing = [i for i, x in enumerate(own) if x is None]
        if self.older:
            for i in missing:
                own[i] = self.older.get(distinct[i])
            self.known.update((distinct[i], own[i]) for i in missing if own[i] is not None)
            missing = [i for i in missing if own[i] is None]
        groups: tuple[list[str], list[str], list[str]] = ([], [], [])
        for i in missing:
            w = distinct[i]
            groups[0 if w[0] == " " and not w.isspace() else 2 if w.isspace() else 1].append(w)
        for words, ids in zip(groups, (self._joined(groups[0], ""), self._joined(groups[1], "\n"), self._whole(groups[2])), strict=True):
            self.known.update(zip(words, ids, strict=True))
        for i in missing:
            own[i] = self.known[distinct[i]]
        return own

    def _joined(self, words: list[str], between: str) -> list[bytes]:
        """Ids of pretokens, many in one text. Those that begin with a space are told apart by it, the others by line ends between them."""
        out: list[bytes] = []
        groups = [words[i : i + 400] for i in range(0, len(words), 400)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            if between:
                edge = np.flatnonzero(ids == self.line_end)
                begin, end = np.append(0, edge + 1), np.append(edge, len(ids))
            else:
                begin = np.flatnonzero(self.opens[ids])
                end = np.append(begin[1:], len(ids))
            if len(begin) != len(group):
                raise ValueError("the tokenizer splits these pretokens otherwise")
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip((4 * begin).tolist(), (4 * end).tolist(), strict=True)]
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[list, list[bytes]]]:
    """(doc ids, ids of each text with the end id) for a few documents at a time; null is an empty text."""
    use, tail = encoder(path), struct.pack("<I", end)
    for few in gathered(batches, limit=CODED_BYTES):
        yield few.column("doc_id").to_pylist(), [ids + tail for ids in use.encode(few.column("text"))]
    use.older = {}


# The file: zstandard frames with content checksums, a skippable frame with each frame's first document and number of
# documents, then the seek table of the zstandard seekable format (sizes and the low half of the content's XXH64).
SEEK_MAGIC, SKIPPABLE, INDEX_SKIPPABLE = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
NULL_ID = -(1 << 63)
FRAME_IDS = 1 << 18


def checksum(body: bytes) -> int:
    return xxhash.xxh64_intdigest(body) & 0xFFFFFFFF


class SeekableWriter:
    """Documents in, frames of about FRAME_IDS ids out. Narrow: two bytes an id."""

    def __init__(self, out, narrow: bool):
        self.out, self.narrow, self.zstd = out, narrow, zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int]] = []
        self.ids, self.docs, self.lengths, self.held = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids) // 4)
        self.ids.append(ids)
        self.held += len(ids) // 4
        if self.held >= FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        ids = np.frombuffer(b"".join(self.ids), "<u4")
        body = struct.pack("<IB", len(self.docs), 2 if self.narrow else 4) + np.array(self.docs, "<i8").tobytes() + np.array(self.lengths, "<u4").tobytes() + ids.astype("<u2" if self.narrow else "<u4").tobytes()
        frame = self.zstd.compress(body)
        self.out.write(frame)
        self.frames.append((len(frame), len(body), checksum(body)))
        self.index.append((self.docs[0], len(self.docs)))
        self.ids, self.docs, self.lengths, self.held = [], [], [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<qI", *x) for x in self.index)
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", INDEX_SKIPPABLE, len(index)) + index + struct.pack("<II", SKIPPABLE, len(table)) + table)


class SeekableReader:
    """Reads the tables at the end of a file, then only the frames that are asked for. in_: a seekable file."""

    def __init__(self, in_, size: int):
        self.file = in_
        in_.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", in_.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end")
        in_.seek(size - 9 - 12 * count - 8 - 12 * count)
        index = in_.read(12 * count)
        in_.read(8)
        table = in_.read(12 * count)
        self.frames = [struct.unpack_from("<III", table, 12 * i) for i in range(count)]
        self.index = [struct.unpack_from("<qI", index, 12 * i) for i in range(count)]
        self.begins = np.concatenate(([0], np.cumsum([f[0] for f in self.frames]))).astype(int).tolist()
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> list[tuple[int | None, np.ndarray]]:
        size, plain, check = self.frames[k]
        self.file.seek(self.begins[k])
        body = self.zstd.decompress(self.file.read(size), max_output_size=plain)
        if checksum(body) != check:
            raise ValueError(f"frame {k} does not match its checksum")
        n, width = struct.unpack_from("<IB", body)
        docs = np.frombuffer(body, "<i8", n, 5)
        lengths = np.frombuffer(body, "<u4", n, 5 + 8 * n)
        ids = np.frombuffer(body, f"<u{width}", -1, 5 + 12 * n)
        return [(None if d == NULL_ID else d, x) for d, x in zip(docs.tolist(), np.split(ids, np.cumsum(lengths)[:-1]), strict=True)]

    def document(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document with this id, from the frames that can hold it."""
        firsts = [d for d, _ in self.index]
        low = max(0, int(np.searchsorted(firsts, doc_id, "left")) - 1)
        high = int(np.searchsorted(firsts, doc_id, "right"))
        return [ids for k in range(low, high) for d, ids in self.frame(k) if d == doc_id]


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end: int) -> Iterator[pa.RecordBatch]:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    part = TaskContext.get().partitionId()
    final, draft = f"{root}/part-{part:06d}.ids.zst", f"{root}/.draft-{part:06d}-{uuid.uuid4().hex}"
    fs.create_dir(root, recursive=True)
    n_docs = n_ids = 0
    with fs.open_output_stream(draft) as out:
        writer = SeekableWriter(out, encoder(path).tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16)
        for docs, ids in encoded(batches, path, end):
            for doc_id, own in zip(docs, ids, strict=True):
                writer.add(doc_id, own)
                n_docs, n_ids = n_docs + 1, n_ids + len(own) // 4
        writer.close()
    if n_docs:
        if fs.get_file_info(final).type != pyarrow.fs.FileType.NotFound:
            fs.delete_file(final)  # of a task that was repeated: the same bytes, and not every store moves onto a file
        fs.move(draft, final)
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [final.rpartition("/")[2]], "n_docs": [n_docs], "n_ids": [n_ids]})
    else:
        fs.delete_file(draft)


def write_token_files(documents: DataFrame, folder: str, path: str, end: int, file_bytes: int = 32 << 20) -> DataFrame:
    """Writes the ids of all documents into folder, ascending by doc_id over the files; returns the list of files (part, file, n_docs, n_ids).

    Null ids come first, null texts are empty; rows with equal ids are ordered by a hash of their text. Every document ends with ``end``.
    Texts are moved once, by ranges of doc_id, so many that a file holds about ``file_bytes`` of text; each task encodes its range and writes
    one file through a draft that it renames. An empty table gives no files.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // file_bytes), min(spark.sparkContext.defaultParallelism, -(-total // (1 << 20))))
    ranged = docs.repartitionByRange(int(n), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return cut(ranged.mapInArrow(lambda b: _write(b, folder, path, end), "part long, file string, n_docs long, n_ids long"), "token-files")


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    for batch in batches:
        for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
            info = fs.get_file_info(f"{root}/{file}")
            with fs.open_input_file(info.path) as f:
                reader, at = SeekableReader(f, info.size), base
                for k in range(len(reader.frames)):
                    docs = reader.frame(k)
                    sizes = np.array([len(ids) for _, ids in docs], np.int64)
                    begins = at + np.cumsum(sizes) - sizes
                    at += int(sizes.sum())
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([d for d, _ in docs], pa.int64()),
                            "start": begins,
                            "n_tokens": sizes,
                            "ids_crc32": pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in docs], pa.int64()),
                            "file": [file] * len(docs),
                            "frame": pa.array([k] * len(docs), pa.int32()),
                        }
                    )


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file, frame."""
    listed = files.selectExpr("part", "file", "n_ids", "sum(n_ids) over (order by part) - n_ids as base")
    n = max(1, files.count())
    return listed.repartition(n, "part").select("file", "base").mapInArrow(lambda b: _read(b, folder), "doc_id long, start long, n_tokens long, ids_crc32 long, file string, frame int")


def token_table(documents: DataFrame, path: str, end: int = 2) -> DataFrame:
    """The documents of token files that are written, read back and deleted again; see write_token_files and read_token_files."""
    spark = documents.sparkSession
    folder = new_path(spark, "tokens")
    files = write_token_files(documents, folder, path, end)
    out = cut(read_token_files(files, folder), "token-table")
    drop(files)
    remove(spark, folder)
    return out
