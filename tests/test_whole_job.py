"""Operators do the whole job: against brute force, beyond former caps and cuts."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from pitgrid.functions import grid
from pitgrid.plans import catalogue


def plane(lat, lon):
    p, q, s, c = math.radians(lat), math.radians(lon + 96), math.sin(math.radians(60)), math.cos(math.radians(60))
    k = math.sqrt(2 / max(1 + s * math.sin(p) + c * math.cos(p) * math.cos(q), 1e-12))
    return 6371.0072 * k * math.cos(p) * math.sin(q), 6371.0072 * k * (c * math.sin(p) - s * math.cos(p) * math.cos(q))


@pytest.mark.parametrize(("n", "k", "max_km"), [(50_001, 5, None), (300, 12, None), (300, 12, 300.0), (3, 12, None), (0, 5, None)])
def test_nearest_equals_brute_force(spark, n, k, max_km):
    rng = random.Random(n)
    # most stations in a corner, a few far away, some at one place
    sites = [(f"s{i:05d}", *((48 + rng.random(), -125 + rng.random()) if i % 50 else (rng.uniform(-40, 75), rng.uniform(-180, 180)))) for i in range(n)]
    sites += [(f"t{i}", *sites[0][1:]) for i in range(3) if n]
    cells = [(-200, -110), (-190, -100), (0, 0), (3, 400), (-500, -900), (-201, -111)]
    got = grid.nearest(spark.createDataFrame(cells, "cell_x int, cell_y int"), spark.createDataFrame([*sites, ("none", None, 1.0)], "aes string, lat double, lon double"), k, max_km).collect()
    at = [(a, *plane(lat, lon)) for a, lat, lon in sites]
    want = {}
    for x, y in cells:
        near = sorted((math.hypot(sx - (x + 0.5) * 10, sy - (y + 0.5) * 10), a) for a, sx, sy in at)
        near = [(d, a) for d, a in near if max_km is None or d <= max_km][:k]
        want |= {(x, y, i): (a, round(d, 6)) for i, (d, a) in enumerate(near)}
    assert {(r.cell_x, r.cell_y, r["rank"]): (r.aes, round(r.dist_km, 6)) for r in got} == want and len(got) == len(want)


def test_panels_hold_all_cells_and_days(spark, tmp_path):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 3, 5)
    events = [(i, start + dt.timedelta(hours=rng.randint(0, 150)), rng.randint(0, 9), rng.choice(["view", "click", "error"]), float(rng.randint(1, 90)), "") for i in [*range(40), *range(1000, 1040)]]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, f"n{i}", 1, 0.0) for i in range(1, 60)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    cell = lambda lat, lon: tuple(math.floor(v / 10) for v in plane(lat, lon))
    spots = [(*cell(48 + (i * 7919 % 1000) / 100, -125 + (i * 104729 % 2000) / 100), t.date()) for i, t, *_ in events]
    days = [min(x[2] for x in spots) + dt.timedelta(n) for n in range((max(x[2] for x in spots) - min(x[2] for x in spots)).days + 1)]
    cells = {x[:2] for x in spots}
    keys = {(*c, day) for c in cells for day in days}
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()

    def before(places, key, n, ring):
        return sum((max(abs(x - key[0]), abs(y - key[1])) == 1 if ring else (x, y) == key[:2]) and 1 <= (key[2] - day).days <= n for x, y, day in places)

    rows = run("trailing_cell_windows")
    assert {(r.cell_x, r.cell_y, r.day): (r.hs_n_1d, r.hs_n_3d, r.hs_n_7d, r.hs_ring_n_7d) for r in rows} == {k: (*(before(spots, k, n, False) for n in (1, 3, 7)), before(spots, k, 7, True)) for k in keys} and len(rows) == len(keys)
    fires = {}
    for i, t, user, *_ in sorted(events, key=lambda e: (e[1], e[0])):
        fires.setdefault((user, (t - dt.datetime(1970, 1, 1)).days // 6), (*cell(48 + user * 37 % 1200 / 100, -125 + user * 53 % 3000 / 100), t.date()))
    rows = run("trailing_ignitions")
    assert {(r.cell_x, r.cell_y, r.day): (r.ig_n_7d, r.ig_ring_n_7d) for r in rows} == {k: (before(fires.values(), k, 7, False), before(fires.values(), k, 7, True)) for k in keys} and len(rows) == len(keys)
    sites = {str(i): plane(48 + (i * 71 % 1000) / 100, -125 + (i * 131 % 2000) / 100) for i in range(1, 60)}
    near = {c: sorted((math.hypot(x - (c[0] + 0.5) * 10, y - (c[1] + 0.5) * 10), a) for a, (x, y) in sites.items()) for c in cells}
    assert {(r.cell_x, r.cell_y, r["rank"]): r.aes for r in run("knn_stations")} == {(*c, i): a for c in cells for i, (_, a) in enumerate(near[c][:5])}
    want = {}
    for x, y, day in keys:
        own = [(1 / max(d, 1) ** 2, (int(a) * 13 + ((day - dt.date(2024, 1, 1)).days - 1) * 7) % 60 - 20) for d, a in near[x, y][:12] if d <= 300]
        if own:
            want[x, y, day] = (len(own), pytest.approx(sum(w * v for w, v in own) / sum(w for w, _ in own), abs=2e-6))
    assert {(r.cell_x, r.cell_y, r.day): (r.wx_n_stations, r.wx_temp) for r in run("idw_interpolation")} == want


def test_polygons_equal_brute_force(spark):
    rng = np.random.default_rng(3)

    def star(n, lon, lat, r, rough=0.0):
        angle = np.sort(rng.random(n)) * 2 * np.pi
        far = r * (0.8 + 0.15 * np.sin(5 * angle) + 0.04 * np.sin(60 * angle) + rough * rng.random(n))
        return [(float(lon + d * np.cos(t)), float(lat + d * np.sin(t))) for t, d in zip(angle, far)]

    wide, holes = star(100_000, -100, 55, 14, 1e-5), [(-60.0, 40.0), (-40.0, 40.0), (-40.0, 60.0), (-50.0, 60.0), (-50.0, 50.0), (-60.0, 50.0), (-60.0, 40.0)]
    rings = [("A", 0, wide), ("B", 1, star(300, -95, 55, 10, 0.3)), ("C", 2, holes), ("D", 3, star(40, 179, -10, 3)), ("E", 4, [(0.0, 0.0), (1.0, 1.0)])]
    points = [(float(x), float(y)) for x, y in np.stack([rng.uniform(-120, -30, 4000), rng.uniform(35, 72, 4000)], 1)]
    points += [wide[i] for i in range(0, 100_000, 997)] + [(x + dx, y) for x, y in holes for dx in (-1e-9, 0.0, 1e-9)] + [(-96.0, 48.0), (-100.0, 64.0), (-55.0, 50.0), (-50.0, 55.0), (180.0, -10.0)]
    edges = grid.polygon_edges(spark.createDataFrame(rings, "code string, ring long, points array<struct<lon:double,lat:double>>"))
    df = spark.createDataFrame([(i, lat, lon) for i, (lon, lat) in enumerate(points)] + [(-1, None, 3.0)], "i long, lat double, lon double")
    want, lon, lat = {}, np.array([p[0] for p in points]), np.array([p[1] for p in points])
    for code, _, ring in rings[:4]:
        odd = np.zeros(len(points), bool)
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if y0 != y1:
                odd ^= ((y0 > lat) != (y1 > lat)) & (lon < (x1 - x0) * (lat - y0) / (y1 - y0) + x0)
        for i in np.flatnonzero(odd).tolist():
            want.setdefault(i, code)
    cells = grid.cover(edges).cache()
    assert cells.selectExpr("max(size(near))").first()[0] <= 16 and cells.where("size(near) = 0").count() > 100
    for few in (1 << 40, 0):
        got = {r.i: r.code for r in grid.place(df, edges, "i", few_bytes=few).collect()}
        assert got == want and set(want.values()) == {"A", "B", "C", "D"}
    assert grid.place(df, edges.limit(0), "i").count() == 0
    cells.unpersist()


def test_trailing_windows_over_small_batches(spark):
    from pitgrid.operators import panel

    rng = random.Random(11)
    start = dt.date(2024, 3, 1)
    day = lambda n: start + dt.timedelta(days=n)
    daily = {(rng.randint(0, 3), rng.randint(0, 2), day(rng.randint(0, 80))): (rng.randint(1, 9), rng.choice([None, float("nan"), round(rng.uniform(-5, 5), 2)])) for _ in range(150)}
    daily |= {(7, 7, day(n)): (1, float(n % 13)) for n in range(80)}
    keys = sorted({(rng.randint(-1, 4), rng.randint(-1, 3), day(rng.randint(0, 90))) for _ in range(250)} | {(7, 7, day(n)) for n in range(0, 95, 2)} | {(8, 6, day(40))})
    rows = spark.createDataFrame([(*k, n, m) for k, (n, m) in daily.items()] + [(1, 1, None, 5, 1.0)], "cell_x int, cell_y int, d date, n long, m double").repartition(3)
    asked = spark.createDataFrame([*keys, keys[0], (None, 1, start)], "cell_x int, cell_y int, day date").repartition(3)

    def window(key, n, ring):
        own = [(c, v) for c, v in daily.items() if (max(abs(c[0] - key[0]), abs(c[1] - key[1])) == 1 if ring else c[:2] == key[:2]) and 1 <= (key[2] - c[2]).days <= n]
        values = [m for _, (_, m) in own if m is not None]
        top = None if not values else "nan" if any(math.isnan(v) for v in values) else max(values)
        return sum(k for _, (k, _) in own), top

    want = {}
    for key in keys:
        since = [(key[2] - c[2]).days for c in daily if c[:2] == key[:2] and 1 <= (key[2] - c[2]).days <= 30]
        want[key] = (*(x for n in (1, 10) for x in window(key, n, False)), *(x for n in (2, 7) for x in window(key, n, True)), min(since, default=None))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (before, "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = panel.trailing(asked, rows, "t", (1, 10), (2, 7), 30, ("m",)).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
        assert {(r.cell_x, r.cell_y, r.day): tuple(map(plain, (r.t_n_1d, r.t_m_max_1d, r.t_n_10d, r.t_m_max_10d, r.t_ring_n_2d, r.t_ring_m_max_2d, r.t_ring_n_7d, r.t_ring_m_max_7d, r.t_days_since))) for r in got} == want and len(got) == len(keys)
