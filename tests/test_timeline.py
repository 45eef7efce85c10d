"""Intervals of revisions against the states that are looked up one instant at a time."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pitgrid.operators import asof


def test_timeline_equals_states_at_every_instant(spark):
    rng = random.Random(9)
    start = dt.datetime(2024, 5, 1, 12)
    rows = []
    for k in range(400):
        fire = "hot" if k % 2 else f"f{rng.randint(0, 25)}"
        at = rng.choice([None, start + dt.timedelta(hours=rng.choice([0, 24, 72, rng.randint(0, 5000)]))])
        rows.append((fire, k, at, rng.choice([None, round(rng.random() * 200, 1)]), rng.choice([None, "OC", "UC"]), rng.choice([None, 50.0 + rng.random()]), -110.0, rng.choice([None, "AB", "BC"]), "R", 2024))
    rows += [("never", 1000, None, 1.0, "OC", 1.0, 1.0, "AB", "R", 2024), ("once", 1001, start, None, None, None, None, None, None, None)]
    r = spark.createDataFrame(rows, "national_fire_id string, id long, record_start timestamp_ntz, fire_size double, stage_of_control_status string, latitude double, longitude double, agency_code string, region_code string, fire_year int").repartition(6)
    known = asof.timeline(r).cache()
    seen = asof.first_seen(r)
    assert known.groupBy("national_fire_id", "id").count().where("count > 1").count() == 0 and known.where("national_fire_id = 'never'").count() == 0
    found = asof.at_instants(known, {f"h{h}": float(h) for h in (0, 24, 72, 3000)})
    assert sorted(map(tuple, found.select(*seen.columns).collect()), key=str) == sorted(map(tuple, seen.collect()), key=str)
    for h in (0, 24, 72, 3000):
        counts = asof.revisions_before(r, seen, h).drop("national_fire_id")
        want = asof.state_asof(r, seen, h).select("national_fire_id", "fire_size", "stage_of_control_status").join(asof.revisions_before(r, seen, h), "national_fire_id")
        got = found.where(f"h{h} is not null").select("national_fire_id", *[F.col(f"h{h}.{c}") for c in ("fire_size", "stage_of_control_status", "n_by", "size_first", "size_max", "n_status")])
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and len(counts.columns) == 4
    now = known.where("valid_from is not null and valid_to is null")
    assert now.count() == seen.count()
    known.unpersist()
