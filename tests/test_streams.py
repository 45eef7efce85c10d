"""Streams that stop, start again and get late and repeated rows, against batch answers; archives that several tasks read."""

import random
import zipfile

from pyspark.sql import functions as F

from pitgrid.plans.views import view
from pitgrid.sources import feeds
from pitgrid.streaming import follow


def test_latest_states_after_restarts_and_late_rows(spark, tmp_path):
    rows = view(spark, "/root/testdata/sf0.001", "revisions")
    parts = [rows.where(f"id % 3 = {k}") for k in (2, 0, 1)]
    landed, out, mark = (f"file://{tmp_path}/{n}" for n in ("landed", "states", "checkpoint"))
    last = rows.groupBy("national_fire_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "national_fire_id"]), F.struct("record_start", "id")).alias("r")).select("national_fire_id", "r.*")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        for k, part in enumerate([*parts, parts[0]]):  # later parts hold earlier revisions, the last one repeats
            part.coalesce(1).write.mode("append").parquet(landed)
            stream = spark.readStream.schema(rows.schema).parquet(landed)
            follow.latest_states(stream, out, mark, availableNow=True).awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = spark.read.parquet(out).drop("part").select(*last.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, last.collect()), key=str)


def test_seasons_take_repeated_rows_once(spark, tmp_path):
    rows = spark.sql("select id as hid, timestamp_ntz'2023-12-20 00:00:00' + make_dt_interval(cast(id as int) % 30) as rep_date, id * 2.0D as fwi from range(300)").unionByName(spark.sql("select 999L as hid, cast(null as timestamp_ntz) as rep_date, 1.0D as fwi"))
    landed, out, mark = (f"file://{tmp_path}/{n}" for n in ("landed", "seasons", "checkpoint"))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        for part in (rows.where("hid < 200 or hid = 999"), rows.where("hid >= 150")):
            part.coalesce(1).write.mode("append").parquet(landed)
            follow.seasons(spark.readStream.schema(rows.schema).parquet(landed), out, mark, ["hid"], late="60 days", availableNow=True).awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = spark.read.parquet(out)
    assert sorted((r.hid, r.season) for r in got.collect()) == sorted((r.hid, r.rep_date.year) for r in rows.where("rep_date is not null").collect())


def test_members_of_one_archive_are_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(4)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for year in (2023, 2024):
            for k in range(6):
                z.writestr(zipfile.ZipInfo(f"{year}/part{k}.csv"), "Lat , fwi\n" + "".join(f"{year}.{k},{i}\n" for i in range(500)), zipfile.ZIP_DEFLATED if k else zipfile.ZIP_STORED)
        z.writestr("2024/readme.txt", "no table")
    path = f"file://{tmp_path}/a.zip"
    found = feeds.members(spark, path, "^2024/")
    assert sorted(r.member for r in found.select("member").collect()) == [f"2024/part{k}.csv" for k in range(6)]
    rows = feeds.zipped(spark, path, ["lat", "fwi", "ros"], "^2024/")
    assert rows.count() == 3000 and rows.where("ros is not null or lat not like '2024%'").count() == 0 and rows.agg(F.sum(F.col("fwi").cast("int"))).first()[0] == 6 * sum(range(500))
    assert rows.select(F.spark_partition_id().alias("p"), "lat").distinct().groupBy("p").count().count() > 1
    assert feeds.zipped(spark, path, ["lat"]).count() == 6000
    broken = bytearray((tmp_path / "a.zip").read_bytes())
    at = broken.find(b"2023.0,7")
    broken[at : at + 4] = b"2099"
    (tmp_path / "b.zip").write_bytes(broken)
    import pytest

    with pytest.raises(Exception, match="CRC-32"):
        feeds.zipped(spark, f"file://{tmp_path}/b.zip", ["lat"], "2023/part0").collect()
