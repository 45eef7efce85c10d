"""Sums of detections around incidents against all pairs, in bins of any size."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pitgrid.operators import spatial

START = dt.datetime(2024, 7, 1)


def tables(spark, n=2500, seed=4):
    rng = random.Random(seed)
    when = lambda a, b: START + dt.timedelta(microseconds=rng.randint(int(a * 3.6e9), int(b * 3.6e9)))
    some = lambda x: None if rng.random() < 0.2 else x
    rows = []
    for i in range(n):
        lat, lon = [(55.05, -110.0), (55.06, -110.02), (55.3, -110.5), (rng.uniform(54, 56), rng.uniform(-112, -108))][i % 4]
        rows.append((lat, lon, when(-300, 400) if i % 5 else START, some(rng.choice([-1e9, -0.5, 0.1234567, 3e9]) + i), some(rng.uniform(-5, 5)), some(float("nan")) if i % 400 == 0 else 1.0, rng.choice(["C2", "d1", "M3", "O1a", None, "x"])))
    # measured never
    rows += [(50.0, -100.0, START, None, None, None, "S1"), (50.0, -100.0, START, None, None, None, "C3")]
    rows += [(None, 1.0, START, 1.0, 1.0, 1.0, "C2"), (55.05, -110.0, None, 1.0, 1.0, 1.0, "C2"), (float("nan"), -110.0, START, 1.0, 1.0, 1.0, "C2")]
    fires = [(f"f{i}", when(-200, 300), rng.uniform(54.5, 55.5), rng.uniform(-111, -109)) for i in range(60)]
    fires += [("edge", START, 55.05, -110.0), ("after", START + dt.timedelta(hours=24), 55.05, -110.0), ("bare", START, 50.0, -100.0), ("far", START, 10.0, 10.0), ("none", None, 55.0, -110.0), ("nowhere", START, None, 1.0)]
    p = spark.createDataFrame(rows, "lat double, lon double, rep_date timestamp_ntz, hfi double, ros double, fwi double, fuel string").repartition(3)
    return spark.createDataFrame(fires, "national_fire_id string, t0 timestamp_ntz, lat double, lon double"), p.withColumn("fwi", F.when(~F.isnan("fwi"), F.col("fwi")))


def plain(fires, points, radius, after):
    """Every incident with every detection."""
    p = points.select(*[F.col(c).alias(f"p_{c}") for c in points.columns])
    near = fires.crossJoin(p).where(f"p_rep_date between t0 - interval 24 hours and t0 + interval {after * 60:.0f} minutes and abs(p_lat - lat) <= {radius} / 111.32D and abs(p_lon - lon) <= {radius} / (111.32D * greatest(cos(radians(lat)), 0.01D))")
    near = near.withColumn("d", spatial.haversine_km("lat", "lon", "p_lat", "p_lon")).where(F.col("d") <= radius).withColumn("g", spatial.fuel_group("p_fuel"))
    have = [m for m in spatial.MEASURES if m in points.columns]
    aggs = [F.count("*").alias("hs_count"), F.round(F.min("d"), 6).alias("hs_dist_min_km"), F.countDistinct(F.to_date("p_rep_date")).alias("hs_active_days")]
    total = lambda m: F.sum(F.col(f"p_{m}").cast("decimal(18,6)")).cast("double")
    for m in have:
        aggs += [F.max(f"p_{m}").alias(f"hs_{m}_max"), (total(m) / F.expr(f"nullif(count(p_{m}), 0)")).alias(f"hs_{m}_mean")]
    aggs += [total("hfi").alias("hs_hfi_sum")] + [F.min("p_rep_date").alias("first")]
    out = near.groupBy("national_fire_id", "t0").agg(*aggs).join(spatial.dominant(near, "national_fire_id", "g").withColumnRenamed("g", "hs_fuel_group"), "national_fire_id")
    return out.withColumn("hs_detection_lead_hours", F.expr("timestampdiff(HOUR, date_trunc('HOUR', first), date_trunc('HOUR', t0))")).drop("first", "t0")


@pytest.mark.parametrize(("radius", "after"), [(20, 24), (60, 100.5), (20, 24 * 70)])
def test_sums_equal_all_pairs_in_bins_of_any_size(spark, monkeypatch, radius, after):
    fires, points = tables(spark)
    want = plain(fires, points, radius, after)
    told = sorted(map(str, want.collect()))
    monkeypatch.setattr(spatial, "PAIRS", 50)
    for most in (1 << 40, 300, 40):
        got = spatial.hotspot_features(fires, points, radius, after, most).withColumn("hs_dist_min_km", F.round("hs_dist_min_km", 6))
        assert sorted(got.columns) == sorted(want.columns) and dict(got.dtypes) == dict(want.dtypes)
        assert sorted(map(str, got.select(*want.columns).collect())) == told
    assert {"edge", "after", "bare"} <= {r[0] for r in want.select("national_fire_id").collect()} and len(told) > 30


def test_neither_copies_of_incidents_nor_rows_sent_grow_with_the_detections(spark):
    """60 incidents in a place with 50,000 detections a day: they went to a bin for each 4,000 detections, and by so many days."""
    fires = tables(spark)[0].where("national_fire_id like 'f%' and t0 is not null and lat > 50")
    points = spark.range(150_000).selectExpr("54.8D + id % 1009 / 2522D as lat", "-110.4D + id % 997 / 1246D as lon", "timestamp_ntz'2024-06-30 00:00:00' + make_dt_interval(0, 0, 0, id * 1.7) as rep_date", "0 as fuel", "1D as hfi")
    high = max(1.0, spatial.TILE * 50 / spatial.KM_PER_DEGREE)
    wide, narrow = (spatial.placed(fires, points, 50, 24, 24, most, bin_)[0].count() for most, bin_ in ((spatial.HELD, (high, 2 * high, spatial.TILE_DAYS)), (spatial.MOST, spatial.BIN)))
    n = fires.count()
    assert wide <= 12 * n and narrow > 40 * wide
    # one row for each copy at most, whatever the pairs are
    sums = spatial.summed(fires, points, 50, 24, 24, ["hfi"])
    assert sums.count() <= wide and sums.agg(F.sum("_n")).first()[0] > 100 * wide
