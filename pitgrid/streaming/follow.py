"""An extension: tables that are kept up with streams. The questions themselves are asked of tables, which these are.

Both queries can stop and start again from their checkpoint, and give what a batch job over all rows gives: what they write depends on the rows of a micro-batch and
its number only, so a batch that is run again replaces its own result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from pitgrid.operators.asof import KEY, ORDER

#: Parts of the table of latest states: a micro-batch rewrites those that its incidents are in.
PARTS = 16


def latest_states(revisions: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps path as the table of every incident's last revision in the order of (record_start, id).

    The stream's state is one row an incident, its last revision so far, so a late row never replaces a later one. Undated revisions count as the earliest. trigger: of the
    writer, like availableNow=True.
    """
    rest = [c for c in revisions.columns if c != KEY]
    last = revisions.groupBy(KEY).agg(F.max_by(F.struct(*rest), F.expr(ORDER)).alias("_row")).select(KEY, "_row.*")

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("part", F.pmod(F.xxhash64(KEY), F.lit(PARTS)).cast("int")).persist()
        try:
            parts = [r[0] for r in new.select("part").distinct().collect()]
            if not parts:
                return
            held = stored(spark, path, batch, parts)
            rows = new.unionByName(held.join(new.select(KEY), KEY, "left_anti")) if held is not None else new
            # written beside the table first: its own files are among what is read
            rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}-batch")
            spark.read.schema(rows.schema).parquet(f"{path.rstrip('/')}-batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        finally:
            new.unpersist()

    return last.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**trigger).start()


def stored(spark, path: str, like: DataFrame, parts: list[int]) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(StructType([*like.schema.fields, StructField("part", IntegerType())])).parquet(path).where(F.col("part").isin(parts))


def seasons(rows: DataFrame, path: str, checkpoint: str, keys: list[str], at: str = "rep_date", late: str = "30 days", **trigger) -> StreamingQuery:
    """Adds rows to a table partitioned by season and micro-batch; rows with equal keys are taken once, as long as they come within ``late`` of each other.

    Rows without an instant go. Read the table with its season and batch columns; a batch that is run again overwrites its own partitions.
    """
    fresh = rows.where(F.col(at).isNotNull()).withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(keys).drop("_at")

    def put(batch: DataFrame, number: int) -> None:
        dated = batch.withColumns({"season": F.year(at), "batch": F.lit(number)})
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season", "batch").parquet(path)

    return fresh.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**trigger).start()
