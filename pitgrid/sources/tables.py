"""Curated tables: overwrite, replacement of seasons, sidecars."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgrid.functions import clean


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def replace(df: DataFrame, path: str, by: str | None = None) -> None:
    """Writes df beside path, then puts it in path's place: df may read path, and a failed write leaves path as it was. Between the two renames readers find no table."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    fresh, aside = f"{path.rstrip('/')}-new-{mark}", f"{path.rstrip('/')}-old-{mark}"
    writer = df.write
    (writer.partitionBy(by) if by else writer).parquet(fresh)
    (old, fs), (new, _), (kept, _) = _path(spark, path), _path(spark, fresh), _path(spark, aside)
    had = fs.exists(old)
    if had and not fs.rename(old, kept):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(kept, old)
        raise OSError(f"cannot put {fresh} in place")
    if had:
        fs.delete(kept, True)


def replace_seasons(fresh: DataFrame, path: str, years: list[int] | None = None, at: str = "rep_date") -> list[str]:
    """Puts fresh in place of its years in a table partitioned by season; returns the columns that went because one side lacks them.

    years: those to be refreshed, by default the ones that fresh has. Only columns that both sides have are kept, so that a column means the
    same in all seasons. Detections of what does not burn go, where there is a fuel. Where the table keeps its columns and fresh has rows in all the years, only those seasons' files are written; else all are.
    """
    spark = fresh.sparkSession
    fresh = clean.burnable(fresh) if "fuel" in fresh.columns else fresh
    fresh = fresh.withColumn("season", F.year(at))
    seen = [r.season for r in fresh.select("season").distinct().collect()]
    years = seen if years is None else years
    if not exists(spark, path):
        replace(fresh, path, "season")
        return []
    stored = spark.read.parquet(path)
    if at not in stored.columns:
        raise ValueError(f"the table has no {at} to tell seasons apart by")
    common = [c for c in stored.columns if c in fresh.columns]
    dropped = sorted(set(stored.columns) ^ set(fresh.columns))
    if len(common) == len(stored.columns) and set(seen) == set(years):
        fresh.select(common).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)
    else:
        kept = stored.where(~F.coalesce(F.col("season").isin(*years), F.lit(False)))
        kept = clean.burnable(kept) if "fuel" in kept.columns else kept
        replace(kept.select(common).unionByName(fresh.select(common)), path, "season")
    return dropped


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small sidecar, in whatever store the path names."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value, indent=1, sort_keys=True, default=str).encode()))
    out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)
