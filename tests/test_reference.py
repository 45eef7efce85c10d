"""Semantics of the point-in-time and spatial operators, and their queries against SQL."""

import datetime as dt
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pitgrid.functions import clean, grid
from pitgrid.operators import asof, panel, spatial
from pitgrid.plans import catalogue, metrics, serving

T0 = dt.datetime(2025, 6, 1, 12)
H = lambda h: T0 + dt.timedelta(hours=h)
SF = "/root/testdata/sf0.001"


@pytest.fixture
def revisions(spark):
    rows = [("F1", 1, 0.5, "UC", H(0)), ("F1", 2, 40.0, "OC", H(20)), ("F1", 3, 900.0, "OC", H(60))]
    return spark.createDataFrame([(*r, 55.0, -115.0, "AB", "SWF", 2025) for r in rows], "national_fire_id string, id long, fire_size double, stage_of_control_status string, record_start timestamp_ntz, latitude double, longitude double, agency_code string, region_code string, fire_year int")


def test_asof(spark, revisions):
    seen = asof.first_seen(revisions)
    assert seen.first().t0 == T0
    assert asof.state_asof(revisions, seen, 24).first().fire_size == 40.0
    assert asof.label_at(revisions, seen, 72).first().size_at_horizon == 900.0
    r = asof.revisions_before(revisions, seen, 24).first()
    assert (r.n_revisions_by_decision, r.size_first, r.n_status_by_decision) == (2, 0.5, 2)
    assert asof.observable(seen, revisions, 72, H(40)).count() == 0 and asof.observable(seen, revisions, 72, H(100)).count() == 1
    assert asof.state_asof(revisions, seen, -1).count() == 0


def test_preparedness(spark):
    day = lambda d, h=20: dt.datetime(2025, 6, d, h)
    reports = spark.createDataFrame([("AB", dt.date(2025, 6, d), day(d), float(d - 12)) for d in (13, 14, 15)], "agency_code string, sitrep_date date, published_at timestamp_ntz, national_preparedness_level double")
    asked = spark.createDataFrame([("F1", "AB", day(16, 6)), ("F2", "AB", day(15, 12)), ("F3", "BC", day(16, 6))], "national_fire_id string, agency_code string, decision_at timestamp_ntz")
    for block in (1, 30):
        got = {r.national_fire_id: r for r in asof.preparedness(asked, reports).collect()}
        assert (got["F1"].ciffc_national_pl, got["F1"].ciffc_sitrep_lag_hours, got["F2"].ciffc_national_pl, got["F3"].ciffc_national_pl) == (3.0, 10.0, 2.0, None)
    joined = asof.asof_backward(asked, reports, "agency_code", "decision_at", "published_at", "sitrep_date", block_days=1)
    assert {r.national_fire_id: r.national_preparedness_level for r in joined.collect()} == {"F1": 3.0, "F2": 2.0, "F3": None}


def test_quarantine(spark):
    rows = [("a", 2023, dt.datetime(2011, 1, 1)), ("b", 2024, dt.datetime(2023, 12, 29)), ("c", 2024, dt.datetime(2025, 3, 3)), ("d", 2023, dt.datetime(2026, 1, 1)), ("e", None, T0), ("f", 2023, None)]
    df = spark.createDataFrame(rows, "national_fire_id string, fire_year int, record_start timestamp_ntz")
    kept, rejected = clean.quarantine(df)
    assert {r[0] for r in kept.collect()} == set("bcef") and {r[0] for r in rejected.collect()} == set("ad")
    assert clean.quarantine(df.drop("fire_year"))[0].count() == 6


def test_hotspots_do_not_depend_on_order(spark):
    rng = random.Random(1)
    fires = spark.createDataFrame([("F1", T0, 55.0, -115.0), ("F2", T0, 52.0, -106.0)], "national_fire_id string, t0 timestamp_ntz, lat double, lon double")
    rows = [(55 + rng.uniform(-0.2, 0.2), -115 + rng.uniform(-0.3, 0.3), H(rng.uniform(-30, 30)), rng.random() * 50, rng.random() * 900, "C2" if i % 2 else "D1") for i in range(400)]
    hot = spark.createDataFrame(rows, "lat double, lon double, rep_date timestamp_ntz, fwi double, hfi double, fuel string")
    outs = [spatial.hotspot_features(fires, hot.repartition(n)).collect() for n in (1, 7, 40)]
    assert outs[0] == outs[1] == outs[2] and len(outs[0]) == 1

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 6371.0 * 2 * math.asin(math.sqrt(h))

    assert outs[0][0].hs_count == sum(km(55, -115, r[0], r[1]) <= 10 and H(-24) <= r[2] <= H(24) for r in rows)
    tie = spark.createDataFrame([("F1", "b"), ("F1", "a"), ("F1", None)], "k string, c string")
    assert spatial.dominant(tie, "k", "c").first().c == "a"


def test_grid(spark):
    places = spark.createDataFrame([(51.0, -114.0), (60.0, -96.0), (43.7, -79.4), (64.0, -139.0)], "lat double, lon double")
    x, y = grid.project()
    lat, lon = grid.unproject()
    for r in places.select("lat", "lon", x.alias("x"), y.alias("y")).select("*", lat.alias("a"), lon.alias("b")).collect():
        assert abs(r.a - r.lat) < 1e-9 and abs(r.b - r.lon) < 1e-9
    rng = random.Random(3)
    sites = [(f"s{i:02d}", rng.uniform(48, 60), rng.uniform(-125, -100)) for i in range(40)]
    cells = grid.with_cells(spark.createDataFrame([(rng.uniform(48, 60), rng.uniform(-125, -100)) for _ in range(20)], "lat double, lon double"))
    near = grid.nearest(cells, spark.createDataFrame(sites, "aes string, lat double, lon double"), 5).collect()
    assert len(near) == 5 * cells.select("cell_x", "cell_y").distinct().count()
    square = spark.createDataFrame([("SQ", 0, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])], "code string, ring long, points array<struct<lon:double,lat:double>>")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 1.0), (3, 1.0, -0.001)], "k int, lat double, lon double")
    assert [r.k for r in grid.place(pts, grid.polygon_edges(square), "k").collect()] == [1]


def test_windows_never_read_the_day(spark):
    day = dt.date(2024, 7, 15)
    daily = spark.createDataFrame([(1, 1, day - dt.timedelta(d), n) for d, n in ((0, 9), (1, 1), (7, 2), (8, 4))] + [(2, 1, day - dt.timedelta(3), 5)], "cell_x int, cell_y int, d date, n long")
    r = panel.trailing(spark.createDataFrame([(1, 1, day)], "cell_x int, cell_y int, day date"), daily, "ig", (1, 7, 30), (7,), 365).first()
    assert (r.ig_n_1d, r.ig_n_7d, r.ig_n_30d, r.ig_days_since, r.ig_ring_n_7d) == (1, 3, 7, 1, 5)


def test_panel(spark):
    area = spark.createDataFrame([(x, 0, "AB") for x in range(50)], "cell_x int, cell_y int, agency_code string")
    days = panel.season_days(spark, [2024]).limit(10)
    events = days.limit(3).select(F.lit(3).alias("cell_x"), F.lit(0).alias("cell_y"), "day", F.lit(2).cast("long").alias("n_ignitions"), F.lit("AB").alias("agency_code"))
    out = panel.sample_panel(area, events, days, 0.5, 3)
    rows = out.collect()
    assert len({(r.cell_x, r.cell_y, r.day) for r in rows}) == len(rows) and sum(r.ignition for r in rows) == 3
    assert sorted(map(tuple, rows)) == sorted(map(tuple, panel.sample_panel(area.repartition(5), events, days, 0.5, 3).collect()))
    assert panel.season_days(spark, [2024]).count() == 214


def test_metrics(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), float(b), float(c)) for a, b, c in zip(rng.random(400) < 0.2, rng.integers(0, 30, 400) / 30, rng.random(400) + 0.1, strict=True)]
    df = spark.createDataFrame(rows, "y int, p double, w double")
    ap, tp, total, pos = 0.0, 0.0, 0.0, sum(w for y, _, w in rows if y)
    for s in sorted({p for _, p, _ in rows}, reverse=True):
        gain = sum(w for y, p, w in rows if p == s and y)
        tp, total = tp + gain, total + sum(w for _, p, w in rows if p == s)
        ap += gain / pos * tp / total
    assert abs(metrics.average_precision(df, w="w").first()[0] - ap) < 1e-12
    flat = spark.createDataFrame([(int(i < 2), 0.5) for i in range(10)], "y int, p double")
    assert metrics.average_precision(flat).first()[0] == pytest.approx(0.2)
    assert metrics.average_precision(flat.where("y = 0")).first()[0] == 0.0
    same = metrics.paired_bootstrap(df.selectExpr("*", "p as p_base", "monotonically_increasing_id() as k"), "k", draws=20).first()
    assert list(same.delta) == [0.0, 0.0]
    p = spark.createDataFrame([(0.001 / (0.001 + 0.999 * 0.02),)], "p double")
    assert p.select(metrics.correct_prior("p", 0.02)).first()[0] == pytest.approx(0.001, rel=1e-9)


def test_serving(spark):
    risk = spark.createDataFrame([("a", "AB", 0.5), ("b", "BC", 0.9), ("c", "AB", 0.1)], "national_fire_id string, agency_code string, risk double")
    assert [r.national_fire_id for r in serving.fires(risk, min_risk=0.2, agency="ab").collect()] == ["a"]
    one = serving.fires(risk, limit=1).collect()
    assert (len(one), one[0].n_matching, one[0].national_fire_id) == (1, 3, "b")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{SF}/{t}')")

    def plain(v):
        if isinstance(v, float):
            return round(v, 8) if v == v else None
        return v if not isinstance(v, dt.datetime) or v.tzinfo is None else v.replace(tzinfo=None)

    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(catalogue.ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    want = sorted((tuple(str(plain(r[i])) for i in at) for r in found.fetchall()))
    assert sorted(tuple(str(plain(r[c])) for c in cols) for r in df.collect()) == want
