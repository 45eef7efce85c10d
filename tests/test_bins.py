"""Detections around incidents with dense bins that are split, against all pairs."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from pitgrid.operators import spatial


def test_split_bins_give_the_same_pairs_in_bounded_groups(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 7, 1)
    hot = [(55.05 + rng.random() * 0.01, -110.03 + rng.random() * 0.02, start + dt.timedelta(hours=rng.random() * 23)) for _ in range(3000)]
    rest = [(rng.uniform(54, 56), rng.uniform(-112, -108), start + dt.timedelta(hours=rng.uniform(-60, 90))) for _ in range(1500)]
    points = [(i, *x) for i, x in enumerate([*hot, *rest, (55.2, -110.0, start), (55.0, -110.4, start)])] + [(-1, None, 1.0, start)]
    fires = [(f"f{i}", start + dt.timedelta(hours=rng.randint(-30, 40)), rng.uniform(54.5, 55.5), rng.uniform(-111, -109)) for i in range(25)] + [("in", start, 55.055, -110.02), ("none", None, 55.0, -110.0)]
    p = spark.createDataFrame(points, "hid long, lat double, lon double, rep_date timestamp_ntz").repartition(4)
    f = spark.createDataFrame(fires, "national_fire_id string, t0 timestamp_ntz, lat double, lon double")
    pairs = lambda most: sorted((r[0], r[1], round(r[2], 9)) for r in spatial.within(f, p, 20, most=most).select("national_fire_id", "p_hid", "dist_km").collect())
    whole = pairs(1 << 40)
    assert pairs(100) == whole and pairs(7) == whole and len(whole) > 5000
    every = f.where("t0 is not null").select("national_fire_id", F.col("lat").alias("a"), F.col("lon").alias("b"), "t0").crossJoin(p)
    every = every.where("rep_date between t0 - interval 24 hours and t0 + interval 24 hours").withColumn("d", spatial.haversine_km("a", "b", "lat", "lon")).where("d <= 20")
    assert sorted((r[0], r[1], round(r[2], 9)) for r in every.select("national_fire_id", "hid", "d").collect()) == whole
    north, east = (side / (1 << spatial.LEVELS) for side in spatial.BIN[:2])
    fine = p.where("lat is not null").withColumns({"_py": F.floor(F.col("lat") / north), "_px": F.floor(F.col("lon") / east), "_bt": F.unix_date(F.to_date("rep_date"))})
    split = spatial.dense_bins(fine, 100)
    own = fine.withColumns({"_l": F.lit(0), "_y": F.shiftright("_py", spatial.LEVELS), "_x": F.shiftright("_px", spatial.LEVELS)})
    for level in range(spatial.LEVELS):
        own = spatial.divided(own, split, level, ("_py", "_py"), ("_px", "_px"))
    sizes = Counter((r._bt, r._l, r._y, r._x) for r in own.collect())
    smallest = Counter((r._bt, r._py, r._px) for r in fine.collect()).most_common(1)[0][1]
    assert sum(sizes.values()) == len(points) - 1 and max(sizes.values()) <= max(100, smallest) < 1000
