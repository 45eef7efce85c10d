"""Two-pass external shuffle of documents into shards.

First pass: seeded hashes scatter the rows into buckets that fit in memory, each inside one shard. Second pass: each
bucket is put into a fixed order, shuffled by Fisher-Yates under its own seed, and written to its shard's files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.workspace import cut, ddl, fresh, new_path, remove, small_batches

SIZE = "cast(coalesce(octet_length(text), 0) + 16 as long)"


def shard_of(doc_id: Column, n_shards: int, seed: int) -> Column:
    """Highest random weight: a shard that is added takes rows only into itself."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), s, doc_id).alias("w"), s.alias("s"))))["s"]


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    order, draws = np.arange(n), np.random.default_rng(seed)
    picks = (draws.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    out = order.tolist()
    for i in range(n - 1, 0, -1):
        j = picks[i]
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def _shuffle(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Rows come bucket by bucket, each bucket in a fixed order; a bucket is held in memory."""
    held: list[pa.RecordBatch] = []
    last = None

    def done() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        table = table.take(pa.array(fisher_yates(table.num_rows, [seed, *last])))
        table = table.append_column("_place", pa.array(np.arange(table.num_rows)))
        yield from table.to_batches(max_chunksize=400)

    for batch in batches:
        if not batch.num_rows:
            continue
        shard, bucket = batch.column("_shard").to_numpy(), batch.column("_bucket").to_numpy()
        edges = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (bucket[1:] != bucket[:-1])) + 1).tolist(), len(shard)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = int(shard[a]), int(bucket[a])
            if last is not None and own != last:
                yield from done()
                held = []
            last = own
            held.append(batch.slice(a, b - a))
    if held:
        yield from done()


def write_shards(documents: DataFrame, folder: str, n_shards: int = 40, bucket_bytes: int = 8 << 20, seed: int = 20) -> DataFrame:
    """Writes documents(doc_id, text, ...) with all their columns as Parquet, a folder ``_shard=k`` for each shard; returns what it wrote.

    Law ``key``: a row's shard depends on doc_id and the number of shards alone; nulls and repeated ids go to their id's shard, and equal texts under
    different ids to those ids' shards. Rows that are equal in doc_id and text share a bucket, as nothing but chance could tell them apart.
    The columns _bucket and _place give the order in the shard. Null texts count as empty; an empty table writes nothing. Columns of the input that
    have one of the names _shard, _bucket, _place, _hash, in whatever case, are written with more underscores before them.
    """
    spark = documents.sparkSession
    small_batches(spark)
    own = {"_shard", "_bucket", "_place", "_hash"}
    names = [c for c in documents.columns if c.lower() not in own]
    for name in documents.columns:
        if name.lower() in own:
            other = fresh([*names, *own], name)[0]
            documents, names = documents.withColumnRenamed(name, other), [*names, other]
    total = documents.agg(F.sum(F.expr(SIZE))).first()[0] or 0
    buckets = max(1, -(-total // (n_shards * bucket_bytes)))
    rows = documents.withColumn("_shard", shard_of(F.col("doc_id"), n_shards, seed)).withColumn("_hash", F.xxhash64(F.lit(seed + 1), "doc_id", "text"))
    rows = rows.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int"))
    # about two buckets to a task, however many bytes there are
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // (2 * bucket_bytes)))
    rows = rows.repartition(int(tasks), "_shard", "_bucket").sortWithinPartitions("_shard", "_bucket", "_hash", "doc_id")
    shuffled = rows.mapInArrow(lambda b: _shuffle(b, seed), ddl(rows) + ", _place long")
    shuffled.drop("_hash").sortWithinPartitions("_shard", "_bucket", "_place").write.partitionBy("_shard").option("compression", "zstd").parquet(folder)
    return spark.read.schema(shuffled.drop("_hash").schema).parquet(folder)


def shard_table(documents: DataFrame, n_shards: int = 40, bucket_bytes: int = 8 << 20, seed: int = 20) -> DataFrame:
    """What the written shards hold: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard), grown_shard (with one more shard)."""
    spark = documents.sparkSession
    folder = new_path(spark, "shards")
    kept = write_shards(documents.select("doc_id", "text"), folder, n_shards, bucket_bytes, seed)
    rows = cut(kept.selectExpr("doc_id", f"{SIZE} as size", "crc32(cast(coalesce(text, '') as binary)) as text_crc32", "_shard as shard", "_bucket", "_place"), "slots")
    remove(spark, folder)
    before = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("n")).selectExpr("shard", "_bucket", "sum(n) over (partition by shard order by _bucket) - n as base")
    grown = shard_of(F.col("doc_id"), n_shards + 1, seed)
    return rows.join(before, ["shard", "_bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("_place")).cast("long").alias("slot"), grown.alias("grown_shard"))
