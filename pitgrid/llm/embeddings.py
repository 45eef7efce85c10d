"""Near duplicates of vectors by randomised-rotation binary codes with stored correction factors.

A vector's code is the signs of its randomly rotated direction; its correction factor is the inner product of the direction with
the code's unit vector. Code times query over the factor estimates the cosine without bias, and the part of the direction outside its
code bounds the error. Queries are rotated directions in eight bits a component, with the exact length of what the rounding leaves out. All these are
computed once for each vector and stored; only they are moved. Vectors meet in buckets of code bits of several rotations. In a bucket, pairs
whose confidence interval lies below the threshold are dropped; of the rest, those whose rounded directions prove a cosine on one side of the threshold are decided there, and
the others, which lie close to the threshold, are computed exactly from the vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.blocks import in_blocks
from pitgrid.llm.components import components
from pitgrid.llm.words import mix
from pitgrid.llm.workspace import cut, small_batches

#: Standard errors that the confidence interval spans on each side.
WIDTH = 4.0


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def directions(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rotated directions, their signs, and the correction factors."""
    rotated = x @ rotation(x.shape[1], seed).T
    signs = np.where(rotated >= 0, 1, -1).astype(np.int8)
    return rotated, signs, np.abs(rotated).sum(1) / math.sqrt(x.shape[1])


def estimate(signs: np.ndarray, factor: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the cosines of coded vectors (rows) and rotated queries (columns), and the error's bound for each row."""
    dim = signs.shape[1]
    raw = signs.astype(np.float32) @ query.astype(np.float32).T
    guess = raw / (math.sqrt(dim) * factor[:, None]).astype(np.float32)
    spread = np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, dim - 1))
    return guess, WIDTH * spread + 1e-5


def rounded(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components in eight bits, their unit, and the length of the rounding error."""
    unit = np.abs(rotated).max(1) / 127
    small = np.rint(rotated / unit[:, None]).astype(np.int8)
    return small, unit.astype(np.float32), np.linalg.norm(rotated - small * unit.astype(np.float32)[:, None].astype(float), axis=1) * (1 + 1e-6) + 1e-9


def bucket_plan(n: int, threshold: float, recall: float, crowd: int = 1024) -> tuple[int, int]:
    """Bits of a bucket's key, so that about ``crowd`` of n scattered vectors share it, and tables, so that a pair at the threshold meets with the given probability."""
    same = 1 - math.acos(threshold) / math.pi
    bits = max(4, min(40, math.ceil(math.log2(max(1, n) / crowd + 1))))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same**bits)))


def code_width(bits: int) -> str:
    """The narrowest unsigned integers that hold a table's bits whole."""
    return next(f"<u{w}" for w in (1, 2, 4, 8) if 8 * w >= bits)


CODED = "id long, n long, dim int, code binary, factor float, small binary, unit float, error float, tables binary, keys array<long>"


def _codes(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """What is stored of each vector, and the keys of its buckets. ``tables``: its bits in every table."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            x = directions([np.asarray(v, "<f8").tobytes() for v in part.column("v").to_numpy(zero_copy_only=False)], dim)
            rng = np.random.default_rng([seed, 1, dim])
            own = np.empty((len(x), tables), np.uint64)
            for t in range(tables):
                planes = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :bits] if bits <= dim else rng.standard_normal((dim, bits))
                own[:, t] = ((x @ planes) >= 0).astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
            keys = mix(own * np.uint64(4096) + np.arange(tables, dtype=np.uint64) + (np.uint64(dim) << np.uint64(52))).view(np.int64)
            rotated, signs, factor = encode(x, seed)
            small, unit, error = rounded(rotated)
            packed = np.packbits(signs > 0, axis=1)
            binary = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_pydict(
                {
                    "id": part.column("id"), "n": part.column("n"), "dim": part.column("dim"), "code": binary(packed), "factor": factor.astype(np.float32), "small": binary(small),
                    "unit": unit, "error": np.nextafter(error.astype(np.float32), np.float32(2)), "tables": binary(own.astype(code_width(bits))), "keys": pa.array(list(keys), pa.list_(pa.int64())),
                }
            )


def _compare(table: pa.Table, threshold: float, width: str) -> pa.Table:
    """Links inside one block pair: for each vector the copies it is linked to, and the smallest id that its links reach here; and the pairs left to compute.

    A pair counts only in the first bucket that it shares.
    """
    ids, copies, side, spot, factor, unit, error = (table.column(c).to_numpy() for c in ("id", "n", "side", "spot", "factor", "unit", "error"))
    dim, n = int(table.column("dim")[0].as_py()), len(ids)
    stack = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(n, -1)
    signs = (np.unpackbits(stack("code", np.uint8), axis=1, count=dim).astype(np.int8) * 2 - 1).astype(np.float32)
    near, own = stack("small", np.int8).astype(np.float32) * unit[:, None], stack("tables", width)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    same = len(left) == len(right) and bool((left == right).all())
    links, root = np.zeros(n, np.int64), ids.copy()
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    open_: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        guess, bound = estimate(signs[rows], factor[rows], near[right])
        a, b = np.nonzero(guess >= threshold - bound[:, None] - error[right][None, :])
        a, b = rows[a], right[b]
        if same:
            a, b = a[a < b], b[a < b]
        for cut_ in range(0, len(a), 200_000):
            p, q = a[cut_ : cut_ + 200_000], b[cut_ : cut_ + 200_000]
            first = (own[p] == own[q]).argmax(1) == spot[p]
            about = np.einsum("ij,ij->i", near[p], near[q]).astype(float)
            slack = error[p].astype(float) + (1 + error[p].astype(float)) * error[q] + 1e-5
            sure = about - slack >= threshold
            doubt = first & ~sure & (about + slack >= threshold)
            open_.append((p[doubt], q[doubt]))
            p, q, first = p[sure], q[sure], first[sure]
            pairs.append((p, q))
            np.add.at(links, p[first], copies[q[first]])
            np.add.at(links, q[first], copies[p[first]])
    p, q = (np.concatenate([x[k] for x in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    while len(p):
        before = root.copy()
        low = np.minimum(root[p], root[q])
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
        if (before == root).all():
            break
    some = (links > 0) | (root != ids)
    p, q = (np.concatenate([x[k] for x in open_]) if open_ else np.zeros(0, np.int64) for k in (0, 1))
    return pa.table(
        {
            "id": np.concatenate((ids[some], ids[p])),
            "links": np.concatenate((links[some], np.zeros(len(p), np.int64))),
            "root": np.concatenate((root[some], ids[p])),
            "other": pa.array([*[None] * int(some.sum()), *ids[q].tolist()], pa.int64()),
        }
    )


def _stream(batches: Iterator[pa.RecordBatch], threshold: float, width: str) -> Iterator[pa.RecordBatch]:
    """Compares each run of rows of one bucket and block pair; a run is bounded by the block size."""
    held: list[pa.RecordBatch] = []
    last = None

    def done() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        if table.num_rows > 1:
            yield from _compare(table, threshold, width).to_batches()

    for batch in batches:
        marks = np.stack([batch.column(c).to_numpy() for c in ("bucket", "_low", "_high")], 1)
        edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if last is not None and tuple(marks[a]) != last:
                yield from done()
                held = []
            last = tuple(marks[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield from done()


def near_vectors(embeddings: DataFrame, threshold: float = 0.9, recall: float = 0.995, seed: int = 5, block: int = 2000) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    embeddings(vec_id, embedding); other columns are ignored. Links join vectors with cosine >= threshold, checked in double precision;
    a pair at the threshold is found with probability ``recall``, closer ones almost surely. Equal vectors are compared as one with a count.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of other lengths with each
    other. Equal vectors are one class, which goes by its smallest vec_id; classes with the same smallest vec_id count as one for links, and a row has the
    component of its class, so rows of one vec_id and unlike vectors can have different ones. A null vec_id links with nothing, has a null component and is kept.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.expr("vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    rows = rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), F.expr("transform(v, x -> x + 0.0D)")))
    keyed = rows.withColumns({"h1": F.expr("if(v is null, null, xxhash64(v))"), "h2": F.expr("if(v is null, null, xxhash64(7, v))")})
    classes = cut(keyed.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vectors")
    bits, tables = bucket_plan(classes.count(), threshold, recall)
    # a table of what is stored; it is read again for each use
    coded = cut(classes.select("id", "n", F.size("v").alias("dim"), "v").mapInArrow(lambda b: _codes(b, bits, tables, seed), CODED), "codes")
    spread = coded.select(*[c for c in coded.columns if c != "keys"], F.posexplode("keys").alias("spot", "bucket"))
    blocks = in_blocks(spread.join(classes_crowds(coded), "bucket"), ["bucket"], "crowd", "id", block)
    found = cut(blocks_frame(blocks).mapInArrow(lambda b: _stream(b, threshold, code_width(bits)), "id long, links long, root long, other long"), "vector-links")
    exact = cut(_exactly(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")), classes, threshold), "exact-links")
    sure = found.where("other is null")
    ends = exact.select(F.explode(F.expr("array(struct(a as id, n_b as links), struct(b as id, n_a as links))")).alias("e")).select("e.*")
    counts = sure.select("id", "links").unionByName(ends).groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(sure.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(exact.select("a", "b")))
    # copies of a vector: the class's smallest id stands for it
    whole = classes.select("v", "id", "n").join(counts, "id", "left").join(joined, "id", "left").selectExpr("xxhash64(v) as h1", "xxhash64(7, v) as h2", "coalesce(component, id) as component_id", "coalesce(links, 0L) + n - 1 as n_links")
    return (
        keyed.join(whole, ["h1", "h2"], "left")
        .selectExpr("vec_id", "coalesce(n_links, 0L) as n_links", "coalesce(component_id, vec_id) as component_id")
        .withColumn("kept", F.expr("vec_id is null or vec_id = component_id"))
    )


def classes_crowds(coded: DataFrame) -> DataFrame:
    """Buckets of several vectors and their sizes, as a table: joined back, both sides are shuffled and skew can be split."""
    return cut(coded.select(F.explode("keys").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1"), "crowds")


def blocks_frame(grouped) -> DataFrame:
    """The grouped rows, each group's together in one partition."""
    frame = grouped._df
    return frame.repartition("bucket", "_low", "_high").sortWithinPartitions("bucket", "_low", "_high")


def _exactly(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b) those whose cosine, in double precision, reaches the threshold: a, b, n_a, n_b."""
    # scaled first, so that no square overflows
    unit = "transform(v, x -> x / array_max(transform(v, y -> abs(y))))"
    own = vectors.selectExpr("id", "n", f"{unit} as w")
    both = pairs.join(own.selectExpr("id as a", "n as n_a", "w as w_a"), "a").join(own.selectExpr("id as b", "n as n_b", "w as w_b"), "b")
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> p * q), 0D, (s, z) -> s + z)"
    return both.where(f"{dot('w_a', 'w_b')} / (sqrt({dot('w_a', 'w_a')}) * sqrt({dot('w_b', 'w_b')})) >= {threshold!r}D").select("a", "b", "n_a", "n_b")
