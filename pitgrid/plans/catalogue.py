"""Queries over the driver's tables and the SQL that they are checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitgrid.functions import clean, grid
from pitgrid.operators import asof, panel, spatial
from pitgrid.plans import metrics, models, resampling, serving
from pitgrid.plans import tables as plans
from pitgrid.plans.views import sql, view
from pitgrid.sources import feeds, shared, tables
from pitgrid.sources.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({sql(n)})" for n in names)


R, H, O, S, E = (_with(n) for n in ("revisions", "hotspots", "obs", "sitreps", "scored"))
_FIRST = "f AS (SELECT national_fire_id, min(record_start) AS t0, arg_min(latitude, (record_start, id)) FILTER (latitude IS NOT NULL) AS lat, arg_min(longitude, (record_start, id)) FILTER (longitude IS NOT NULL) AS lon, arg_min(agency_code, (record_start, id)) FILTER (agency_code IS NOT NULL) AS agency_code, arg_min(region_code, (record_start, id)) FILTER (region_code IS NOT NULL) AS region_code, arg_min(fire_year, (record_start, id)) FILTER (fire_year IS NOT NULL) AS fire_year, count(*) AS n_revisions FROM revisions GROUP BY 1 HAVING min(record_start) IS NOT NULL)"
_LAEA = "sqrt(2 / greatest(1 + sin(radians(60)) * sin(radians({lat})) + cos(radians(60)) * cos(radians({lat})) * cos(radians({lon} + 96)), 1e-12))"
_CX = "cast(floor(6371.0072 * " + _LAEA + " * cos(radians({lat})) * sin(radians({lon} + 96)) / 10) as int)"
_CY = "cast(floor(6371.0072 * " + _LAEA + " * (cos(radians(60)) * sin(radians({lat})) - sin(radians(60)) * cos(radians({lat})) * cos(radians({lon} + 96))) / 10) as int)"


def _cell(lat: str = "lat", lon: str = "lon") -> str:
    return f"{_CX.format(lat=lat, lon=lon)} AS cell_x, {_CY.format(lat=lat, lon=lon)} AS cell_y"


def _revisions(spark, d):
    r = view(spark, d, "revisions")
    return r, asof.first_seen(r)


@query(f"{R}, {_FIRST} SELECT * FROM f")
def first_seen(spark, d):
    return _revisions(spark, d)[1]


_STATE = "s AS (SELECT r.* FROM revisions r JOIN f USING (national_fire_id) WHERE r.record_start <= f.t0 + INTERVAL {h} HOUR QUALIFY row_number() OVER (PARTITION BY r.national_fire_id ORDER BY r.record_start DESC, r.id DESC) = 1)"


@query(f"{R}, {_FIRST}, {_STATE.format(h=24)} SELECT * FROM s")
def state_asof_24h(spark, d):
    return asof.state_asof(*_revisions(spark, d), 24)


@query(f"{R}, {_FIRST} SELECT r.national_fire_id, count(*) AS n_revisions_by_decision, arg_min(fire_size, (record_start, id)) FILTER (fire_size IS NOT NULL) AS size_first, max(fire_size) AS size_max_by_decision, count(DISTINCT stage_of_control_status) + max(CASE WHEN stage_of_control_status IS NULL THEN 1 ELSE 0 END) AS n_status_by_decision FROM revisions r JOIN f USING (national_fire_id) WHERE record_start <= t0 + INTERVAL 24 HOUR GROUP BY 1")
def revisions_before(spark, d):
    return asof.revisions_before(*_revisions(spark, d), 24)


@query(f"{R}, {_FIRST}, {_STATE.format(h=72)} SELECT national_fire_id, fire_size AS size_at_horizon, stage_of_control_status AS status_at_horizon FROM s")
def label_at_72h(spark, d):
    return asof.label_at(*_revisions(spark, d), 72)


@query(f"{R}, {_FIRST} SELECT f.* FROM f WHERE t0 + INTERVAL 72 HOUR <= (SELECT max(record_start) FROM revisions)")
def observable(spark, d):
    r, seen = _revisions(spark, d)
    return asof.observable(seen, r, 72)


@query(f"{R} SELECT national_fire_id, id, record_start IS NULL OR fire_year IS NULL OR cast(record_start AS date) BETWEEN make_date(fire_year - 1, 1, 1) AND make_date(fire_year + 1, 12, 31) AS kept FROM revisions")
def quarantine_split(spark, d):
    kept, rejected = clean.quarantine(view(spark, d, "revisions"))
    part = lambda x, flag: x.select("national_fire_id", "id", F.lit(flag).alias("kept"))
    return part(kept, True).unionByName(part(rejected, False))


@query(f"{R} SELECT fire_year, count(*) AS n_rows, count(DISTINCT national_fire_id) AS n_fires, min(record_start) AS first_record, max(record_start) AS last_record, round(count(*) / count(DISTINCT national_fire_id), 2) AS rows_per_fire FROM revisions GROUP BY 1")
def bitemporal_depth(spark, d):
    return clean.bitemporal_depth(view(spark, d, "revisions"))


@query(f"""{_with('revisions', 'sitreps')}, {_FIRST}, q AS (SELECT national_fire_id, agency_code, t0 + INTERVAL 24 HOUR AS decision_at FROM f)
    SELECT q.national_fire_id, q.agency_code, q.decision_at, s.national_preparedness_level AS ciffc_national_pl, s.agency_preparedness AS ciffc_agency_pl, date_diff('microsecond', s.published_at, q.decision_at) // 60000000 / 60.0e0 AS ciffc_sitrep_lag_hours
    FROM q ASOF LEFT JOIN sitreps s ON q.agency_code = s.agency_code AND q.decision_at >= s.published_at""")
def asof_join_backward(spark, d):
    _, seen = _revisions(spark, d)
    return asof.preparedness(seen.select("national_fire_id", "agency_code", asof.hours_after("t0", 24).alias("decision_at")), view(spark, d, "sitreps"))


_NEAR = """m AS (SELECT f.national_fire_id, f.t0, h.*, 6371.0 * 2 * asin(sqrt(power(sin(radians(h.lat - f.lat) / 2), 2) + cos(radians(f.lat)) * cos(radians(h.lat)) * power(sin(radians(h.lon - f.lon) / 2), 2))) AS dist_km
    FROM f JOIN hotspots h ON h.rep_date BETWEEN f.t0 - INTERVAL 24 HOUR AND f.t0 + INTERVAL 24 HOUR AND h.lat BETWEEN f.lat - 50 / 111.32 AND f.lat + 50 / 111.32
    AND h.lon BETWEEN f.lon - 50 / (111.32 * greatest(cos(radians(f.lat)), 0.01)) AND f.lon + 50 / (111.32 * greatest(cos(radians(f.lat)), 0.01))),
    n AS (SELECT *, CASE upper(fuel)[1] WHEN 'C' THEN 'conifer' WHEN 'D' THEN 'deciduous' WHEN 'M' THEN 'mixed' WHEN 'S' THEN 'slash' WHEN 'O' THEN 'open' ELSE 'other' END AS g FROM m WHERE dist_km <= 50),
    g AS (SELECT national_fire_id, g AS hs_fuel_group FROM n GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY national_fire_id ORDER BY count(*) DESC, g) = 1)"""
_MEAN = "CAST(sum(CAST({m} AS DECIMAL(18,6))) AS DOUBLE) / nullif(count({m}), 0) AS hs_{m}_mean"


@query(f"""{_with('revisions', 'hotspots')}, {_FIRST}, {_NEAR} SELECT n.national_fire_id, count(*) AS hs_count, {', '.join(f'max({m}) AS hs_{m}_max, {_MEAN.format(m=m)}' for m in ('fwi', 'hfi', 'ros'))},
    CAST(sum(CAST(hfi AS DECIMAL(18,6))) AS DOUBLE) AS hs_hfi_sum, round(min(dist_km), 6) AS hs_dist_min_km, count(DISTINCT CAST(rep_date AS date)) AS hs_active_days, date_diff('hour', min(rep_date), n.t0) AS hs_detection_lead_hours, any_value(hs_fuel_group) AS hs_fuel_group
    FROM n JOIN g USING (national_fire_id) GROUP BY n.national_fire_id, n.t0""")
def radius_join_aggs(spark, d):
    _, seen = _revisions(spark, d)
    out = spatial.hotspot_features(seen, view(spark, d, "hotspots"), radius_km=50)
    return out.withColumn("hs_dist_min_km", F.round("hs_dist_min_km", 6))


@query(f"{H} SELECT cast(rep_date AS date) AS day, CASE upper(fuel)[1] WHEN 'C' THEN 'conifer' WHEN 'D' THEN 'deciduous' WHEN 'M' THEN 'mixed' WHEN 'S' THEN 'slash' WHEN 'O' THEN 'open' ELSE 'other' END AS fuel_group FROM hotspots GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY day ORDER BY count(*) DESC, fuel_group) = 1")
def dominant_category(spark, d):
    h = view(spark, d, "hotspots").select(F.to_date("rep_date").alias("day"), spatial.fuel_group("fuel").alias("fuel_group"))
    return spatial.dominant(h, "day", "fuel_group")


@query(f"{H} SELECT hid, {_cell()} FROM hotspots")
def laea_cells(spark, d):
    return grid.with_cells(view(spark, d, "hotspots")).select("hid", "cell_x", "cell_y")


@query(f"{H} SELECT hid, round(lat, 6) AS lat, round(lon, 6) AS lon FROM hotspots")
def laea_round_trip(spark, d):
    x, y = grid.project()
    lat, lon = grid.unproject()
    return view(spark, d, "hotspots").select("hid", x.alias("x"), y.alias("y")).select("hid", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


_DAILY = f"daily AS (SELECT cell_x, cell_y, cast(rep_date AS date) AS d, count(*) AS n, max(fwi) AS fwi, max(hfi) AS hfi, max(ros) AS ros FROM (SELECT *, {_cell()} FROM hotspots) GROUP BY 1, 2, 3)"
_RING = "ring AS (SELECT k.cell_x, k.cell_y, k.day, k.cell_x + ox AS rx, k.cell_y + oy AS ry FROM keys k, (SELECT unnest([-1, 0, 1]) AS ox), (SELECT unnest([-1, 0, 1]) AS oy) WHERE ox <> 0 OR oy <> 0)"


@query(f"{H}, {_DAILY} SELECT * FROM daily")
def cell_counts(spark, d):
    return panel.cell_days(view(spark, d, "hotspots"))


def _trailing_ctes(prefix: str, windows, ring_windows, censor: int, measures, source: str, ring_measures=None) -> str:
    """a_<prefix> and b_<prefix>: windows in the cell and around it, over keys and ring."""
    part = lambda ring, ws, ms: ", ".join([f"cast(coalesce(sum(n) FILTER (d >= day - {w}), 0) AS BIGINT) AS {prefix}_{ring}n_{w}d" for w in ws] + [f"max({m}) FILTER (d >= day - {w}) AS {prefix}_{ring}{m}_max_{w}d" for w in ws for m in ms])
    return f"""a_{prefix} AS (SELECT k.cell_x, k.cell_y, k.day, {part('', windows, measures)}, min(date_diff('day', d, day)) FILTER (d >= day - {censor}) AS {prefix}_days_since FROM keys k LEFT JOIN {source} s ON s.cell_x = k.cell_x AND s.cell_y = k.cell_y AND d < day AND d >= day - {max(*windows, censor)} GROUP BY 1, 2, 3),
    b_{prefix} AS (SELECT k.cell_x, k.cell_y, k.day, {part('ring_', ring_windows, measures if ring_measures is None else ring_measures)} FROM ring k LEFT JOIN {source} s ON s.cell_x = k.rx AND s.cell_y = k.ry AND d < day AND d >= day - {max(ring_windows)} GROUP BY 1, 2, 3)"""


def _sql_trailing(prefix: str, *arguments) -> str:
    return f"{_trailing_ctes(prefix, *arguments)} SELECT * FROM a_{prefix} JOIN b_{prefix} USING (cell_x, cell_y, day)"


_KEYS = f"keys AS (SELECT cell_x, cell_y, day FROM (SELECT DISTINCT {_cell()} FROM hotspots), (SELECT unnest(generate_series(min(rep_date)::date, max(rep_date)::date, INTERVAL 1 DAY))::date AS day FROM hotspots))"


def _keys(spark, d):
    """Every cell with a detection on every day from the table's first to its last."""
    hotspots = view(spark, d, "hotspots")
    days = hotspots.agg(F.min("rep_date").alias("a"), F.max("rep_date").alias("b")).select(F.explode(F.expr("sequence(to_date(a), to_date(b))")).alias("day"))
    return models.area_days(grid.with_cells(hotspots).select("cell_x", "cell_y").distinct(), days)


@query(f"{H}, {_DAILY}, {_KEYS}, {_RING}, {_sql_trailing('hs', (1, 3, 7), (7,), 60, ('fwi', 'hfi', 'ros'), 'daily')}")
def trailing_cell_windows(spark, d):
    return panel.trailing(_keys(spark, d), panel.cell_days(view(spark, d, "hotspots")), "hs", (1, 3, 7), (7,), 60, ("fwi", "hfi", "ros"))


_EVENTS = f"ev AS (SELECT cell_x, cell_y, cast(t0 AS date) AS day, count(*) AS n_ignitions, min(agency_code) AS agency_code FROM (SELECT *, {_cell()} FROM f) GROUP BY 1, 2, 3)"


@query(f"{_with('revisions', 'hotspots')}, {_FIRST}, {_EVENTS}, evd AS (SELECT cell_x, cell_y, day AS d, n_ignitions AS n FROM ev), {_KEYS}, {_RING}, {_sql_trailing('ig', (7, 30, 365), (7, 365), 365, (), 'evd')}")
def trailing_ignitions(spark, d):
    daily = panel.ignition_events(view(spark, d, "revisions")).select("cell_x", "cell_y", F.col("day").alias("d"), F.col("n_ignitions").alias("n"))
    return panel.trailing(_keys(spark, d), daily, "ig", (7, 30, 365), (7, 365), 365)


@query(f"{R}, {_FIRST}, {_EVENTS} SELECT * FROM ev")
def ignition_events(spark, d):
    return panel.ignition_events(view(spark, d, "revisions"))


_AGENCY = "vote AS (SELECT cell_x, cell_y, agency_code FROM ev WHERE agency_code IS NOT NULL AND agency_code <> 'PC' GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY sum(n_ignitions) DESC, agency_code) = 1)"


@query(f"{R}, {_FIRST}, {_EVENTS}, {_AGENCY} SELECT * FROM vote")
def cell_agency_vote(spark, d):
    return panel.agency_vote(panel.ignition_events(view(spark, d, "revisions")))


_POLY = [("WE", 0, [(-126.0, 47.0), (-115.0, 47.0), (-113.5, 59.0), (-126.0, 59.0)]), ("MI", 1, [(-115.0, 47.0), (-107.0, 49.0), (-113.5, 59.0)]), ("XX", 2, [(-109.0, 47.0), (-104.0, 47.0), (-104.0, 59.0), (-109.0, 55.0)])]


def _edges(spark):
    rings = spark.createDataFrame(_POLY, "code string, ring long, points array<struct<lon:double,lat:double>>")
    return grid.polygon_edges(rings)


_EDGE_SQL = "edges(code, ring, a_lon, a_lat, b_lon, b_lat) AS (VALUES " + ", ".join(f"('{c}', {r}, {a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for c, r, p in _POLY for a, b in zip(p, p[1:] + p[:1], strict=True)) + ")"


@query(f"{H}, {_EDGE_SQL}, i AS (SELECT hid, code, ring FROM hotspots JOIN edges ON (a_lat > lat) <> (b_lat > lat) AND lon < (b_lon - a_lon) * (lat - a_lat) / (b_lat - a_lat) + a_lon GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1) SELECT hid, arg_min(code, ring) AS code FROM i GROUP BY hid")
def point_in_polygon(spark, d):
    return grid.place(view(spark, d, "hotspots"), _edges(spark), "hid")


_SITES = f"sites AS (SELECT DISTINCT aes, 6371.0072 * {_LAEA.format(lat='lat', lon='lon')} * cos(radians(lat)) * sin(radians(lon + 96)) AS x, 6371.0072 * {_LAEA.format(lat='lat', lon='lon')} * (cos(radians(60)) * sin(radians(lat)) - sin(radians(60)) * cos(radians(lat)) * cos(radians(lon + 96))) AS y FROM obs)"
_KNN = "nb AS (SELECT * FROM (SELECT cell_x, cell_y, aes, sqrt(power(x - (cell_x + 0.5) * 10, 2) + power(y - (cell_y + 0.5) * 10, 2)) AS dist_km FROM (SELECT DISTINCT cell_x, cell_y FROM keys), sites) {w} QUALIFY row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY dist_km, aes) <= {k})"


@query(f"{_with('hotspots', 'obs')}, {_KEYS}, {_SITES}, {_KNN.format(k=5, w='')} SELECT cell_x, cell_y, aes, row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY dist_km, aes) - 1 AS rank, round(dist_km, 6) AS dist_km FROM nb")
def knn_stations(spark, d):
    near = grid.nearest(_keys(spark, d), view(spark, d, "obs").select("aes", "lat", "lon").distinct(), 5)
    return near.withColumn("dist_km", F.round("dist_km", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(f"{_with('hotspots', 'obs')}, {_KEYS}, {_SITES}, {_KNN.format(k=12, w='WHERE dist_km <= 300')}, j AS (SELECT k.*, dist_km, power(1 / greatest(dist_km, 1), 2) AS w, temp, rh, fwi FROM keys k JOIN nb USING (cell_x, cell_y) JOIN obs o ON o.aes = nb.aes AND o.obs_date = k.day - 1) SELECT cell_x, cell_y, day, {', '.join(f'round(sum({m} * w) / sum(w) FILTER ({m} IS NOT NULL), 6) AS wx_{m}' for m in ('temp', 'rh', 'fwi'))}, count(*) AS wx_n_stations, round(min(dist_km), 6) AS wx_dist_km FROM j GROUP BY 1, 2, 3")
def idw_interpolation(spark, d):
    obs, keys = view(spark, d, "obs"), _keys(spark, d)
    out = panel.station_weather(keys, grid.nearest(keys, obs.select("aes", "lat", "lon").distinct(), 12, 300.0), obs, ("temp", "rh", "fwi"))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("wx_") and c != "wx_n_stations"})


_AREA = f"area AS (SELECT DISTINCT c.cell_x, c.cell_y, v.agency_code FROM (SELECT cell_x, cell_y FROM ev UNION SELECT {_cell()} FROM hotspots) c JOIN vote v USING (cell_x, cell_y))"


@query(f"{_with('revisions', 'hotspots')}, {_FIRST}, {_EVENTS}, {_AGENCY}, {_AREA} SELECT * FROM area")
def study_area(spark, d):
    return panel.study_area(panel.ignition_events(view(spark, d, "revisions")), view(spark, d, "hotspots"), [2024])


@query(f"""{_with('revisions', 'hotspots')}, {_FIRST}, {_EVENTS}, {_AGENCY}, {_AREA}, days AS (SELECT unnest(generate_series(date '2024-01-01', date '2024-01-30', INTERVAL 1 DAY))::date AS day),
    pos AS (SELECT ev.cell_x, ev.cell_y, day, n_ignitions FROM ev JOIN area a ON a.cell_x = ev.cell_x AND a.cell_y = ev.cell_y JOIN days USING (day)),
    neg AS (SELECT a.cell_x, a.cell_y, day FROM area a, days QUALIFY row_number() OVER (PARTITION BY day ORDER BY md5('7|' || a.cell_x || '|' || a.cell_y || '|' || day), a.cell_x, a.cell_y) <= (SELECT round_even(0.2 * count(*), 0) FROM area))
    SELECT p.*, a.agency_code FROM (SELECT cell_x, cell_y, day, n_ignitions, 1::TINYINT AS ignition FROM pos UNION ALL SELECT cell_x, cell_y, day, 0, 0::TINYINT FROM neg ANTI JOIN pos USING (cell_x, cell_y, day)) p JOIN area a USING (cell_x, cell_y)""")
def negative_sample(spark, d):
    events = panel.ignition_events(view(spark, d, "revisions"))
    area = panel.study_area(events, view(spark, d, "hotspots"), [2024])
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-30')) as day")
    return panel.sample_panel(area, events, days, 0.2, 7)


_PR = "c AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM (SELECT p, sum(CASE WHEN y = 1 THEN {w} ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE {w} END)::DOUBLE AS neg FROM scored GROUP BY p))"


@query(f"{E}, {_PR.format(w=1)} SELECT round(p, 9) AS p, pos, neg, tp, fp FROM c")
def pr_curve(spark, d):
    return metrics.pr_curve(metrics.score_groups(view(spark, d, "scored"))).withColumn("p", F.round("p", 9))


@query(f"{E}, {_PR.format(w='w')} SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 9) AS average_precision FROM c")
def weighted_ap(spark, d):
    return metrics.average_precision(view(spark, d, "scored"), w="w").select(F.round("average_precision", 9).alias("average_precision"))


@query(f"{E}, {_PR.format(w=1)} SELECT round(sum(neg * (tp - pos + pos / 2)) / (sum(pos) * sum(neg)), 9) AS roc_auc FROM c")
def roc_auc(spark, d):
    return metrics.roc_auc(view(spark, d, "scored")).select(F.round("roc_auc", 9).alias("roc_auc"))


@query(f"{E} SELECT round(sum(w * power(y - p, 2)) / sum(w), 9) AS brier, round(sum(w * y) / sum(w), 9) AS prevalence FROM scored")
def brier(spark, d):
    return metrics.brier(view(spark, d, "scored"), w="w").select(F.round("brier", 9).alias("brier"), F.round("prevalence", 9).alias("prevalence"))


@query(f"{E}, e AS (SELECT list_distinct(quantile_cont(p, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS e FROM scored), b AS (SELECT greatest(1, len(list_filter(e, lambda x: x < p))) AS bucket, y, p FROM scored, e) SELECT cast(bucket AS INT) AS bucket, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS mean_outcome FROM b GROUP BY 1")
def reliability(spark, d):
    out = metrics.reliability(view(spark, d, "scored"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_score", "mean_outcome")})


@query(f"{E} SELECT doc_id, round(p / (1 - p) * 0.05 / (1 + p / (1 - p) * 0.05), 9) AS corrected FROM (SELECT doc_id, greatest(1e-12, least(1 - 1e-12, p)) AS p FROM scored)")
def prior_correction(spark, d):
    return view(spark, d, "scored").select("doc_id", F.round(metrics.correct_prior("p", 0.05), 9).alias("corrected"))


_TIMES = lambda x, k: f"(({x})::UHUGEINT * {k} % 18446744073709551616)::UBIGINT"


def _sql_bootstrap(draws: int, w: str) -> str:
    """Picks are split between halves of the places by binomial counts: the number of chances below a hashed uniform number."""
    a, b, c, d = resampling.TIMES
    (s, m), (t, n) = resampling.MIX
    return f"""r AS (SELECT y, p, p_base, {w} AS w, row_number() OVER (ORDER BY p DESC, doc_id::VARCHAR) - 1 AS place FROM scored), e AS (SELECT count(*) AS n FROM r),
    k AS (WITH RECURSIVE t(draw, lo, hi, n) AS (SELECT draw, 0::BIGINT, e.n, e.n FROM e, (SELECT unnest(range(0, {draws})) AS draw)
        UNION ALL SELECT draw, CASE side WHEN 0 THEN lo ELSE mid END, CASE side WHEN 0 THEN mid ELSE hi END, CASE side WHEN 0 THEN l ELSE n - l END FROM (
            SELECT draw, lo, hi, n, mid, list_reduce(list_transform(range(0, n + 1), lambda j: {{'p': exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(pr) + (n - j) * ln(1 - pr)), 'c': 0.0e0, 'k': 0::BIGINT}}), lambda x, j: {{'p': 0.0e0, 'c': x.c + j.p, 'k': x.k + (x.c + j.p < u)::BIGINT}}, {{'p': 0.0e0, 'c': 0.0e0, 'k': 0::BIGINT}}).k AS l, unnest([0, 1]) AS side
            FROM (SELECT draw, lo, hi, n, (lo + hi) // 2 AS mid, (mid - lo) / (hi - lo)::DOUBLE AS pr, xor(xor({_TIMES('draw + 1', a)}, {_TIMES(17, d)}), xor({_TIMES('lo + 1', b)}, {_TIMES('hi', c)})) AS h1,
                {_TIMES(f'xor(h1, h1 >> {s})', m)} AS h2, {_TIMES(f'xor(h2, h2 >> {t})', n)} AS h3, (xor(h3, h3 >> 31) >> 11) / 9007199254740992.0e0 AS u FROM t WHERE hi - lo > 1)))
        SELECT draw, lo AS place, n AS k FROM t WHERE hi - lo = 1),
    n AS (SELECT draw, y, p, p_base, w * k AS n FROM k JOIN r USING (place)),
    g AS (SELECT draw, o, p, sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS pos, sum(n) AS n FROM (SELECT draw, 'm' AS o, y, p, n FROM n UNION ALL SELECT draw, 'b', y, p_base, n FROM n) WHERE n > 0 GROUP BY 1, 2, 3),
    c AS (SELECT *, sum(pos) OVER d AS tp, sum(n) OVER d AS seen FROM g WINDOW d AS (PARTITION BY draw, o ORDER BY p DESC)),
    a AS (SELECT draw, o, sum(pos * tp / seen) / nullif(sum(pos), 0) AS ap FROM c GROUP BY 1, 2),
    x AS (SELECT draw, max(ap) FILTER (o = 'm') AS m, max(ap) FILTER (o = 'b') AS b FROM a GROUP BY 1 HAVING max(ap) FILTER (o = 'm') IS NOT NULL)
    SELECT {', '.join(f'round(quantile_cont({e}, {q}), 9) AS {n}_{k}' for n, e in (('model', 'm'), ('base', 'b'), ('delta', 'm - b')) for k, q in (('low', 0.05), ('high', 0.95)))}, round(avg((m > b)::INT), 9) AS p_better, count(*) AS draws FROM x"""


def _bounds(out: DataFrame) -> DataFrame:
    """Arrays of two percentiles as columns."""
    return out.select(*[F.round(F.col(n)[k], 9).alias(f"{n}_{end}") for n in ("model", "base", "delta") for k, end in enumerate(("low", "high"))], F.round("p_better", 9).alias("p_better"), "draws")


@query(f"{E}, {_sql_bootstrap(1000, '1.0e0')}")
def paired_bootstrap(spark, d):
    return _bounds(metrics.paired_bootstrap(view(spark, d, "scored"), "doc_id"))


@query(f"{E}, {_sql_bootstrap(1000, 'w')}")
def paired_bootstrap_weighted(spark, d):
    return _bounds(metrics.paired_bootstrap(view(spark, d, "scored"), "doc_id", w="w"))


@query(f"{E}, {_PR.format(w='w')} SELECT round(sum(neg * (tp - pos + pos / 2)) / (sum(pos) * sum(neg)), 9) AS roc_auc FROM c")
def roc_auc_weighted(spark, d):
    return metrics.roc_auc(view(spark, d, "scored"), w="w").select(F.round("roc_auc", 9).alias("roc_auc"))


@query(f"{E}, e AS (SELECT list_distinct(quantile_cont(p, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS e FROM scored), b AS (SELECT greatest(1, len(list_filter(e, lambda x: x < p))) AS bucket, y, p, w FROM scored, e) SELECT cast(bucket AS INT) AS bucket, count(*) AS n, round(sum(w * p) / sum(w), 6) AS mean_score, round(sum(w * y) / sum(w), 6) AS mean_outcome FROM b GROUP BY 1")
def reliability_weighted(spark, d):
    out = metrics.reliability(view(spark, d, "scored"), w="w")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_score", "mean_outcome")})


@query(f"""{E}, g AS (SELECT p, count(*) AS n, sum(y) AS k FROM scored GROUP BY p), c AS (SELECT *, sum(n) OVER (ORDER BY p) AS upto FROM g), t AS (SELECT greatest(30, sum(n) // 8) AS target, sum(n) AS total FROM g),
    e AS (WITH RECURSIVE e(i, since, upto) AS (SELECT 0, 0::HUGEINT, min(c.upto)::HUGEINT FROM c, t WHERE c.upto >= least(target, total)
        UNION ALL SELECT i + 1, since, upto FROM (SELECT e.i, e.upto AS since, min(c.upto)::HUGEINT AS upto FROM e, t, c WHERE e.upto < total AND c.upto >= least(total, e.upto + target) GROUP BY e.i, e.upto)) SELECT * FROM e),
    m AS (SELECT CASE WHEN i > 0 AND upto = total AND upto - since < target // 3 THEN i - 1 ELSE i END AS bucket, since, upto FROM e, t)
    SELECT bucket::INT AS bucket, cast(sum(n) AS BIGINT) AS n, round(sum(n * p) / sum(n), 9) AS mean_score, round(sum(k) / sum(n), 9) AS mean_outcome FROM c JOIN m ON c.upto > m.since AND c.upto <= m.upto GROUP BY 1""")
def reliability_points(spark, d):
    out = metrics.reliability_points(view(spark, d, "scored"))
    return out.withColumns({c: F.round(c, 9) for c in ("mean_score", "mean_outcome")})


@query(f"{E} SELECT doc_id, p AS risk, (SELECT count(*) FROM scored WHERE p >= 0.2) AS n_matching FROM scored WHERE p >= 0.2 ORDER BY p DESC, doc_id LIMIT 25")
def topk_risk(spark, d):
    return serving.top(view(spark, d, "scored").select("doc_id", F.col("p").alias("risk")), "risk >= 0.2", "risk", ["doc_id"], 25)


@query(f"{O} SELECT cast(year(obs_date) AS INT) AS year, count(*) AS n_rows, count(DISTINCT obs_date) AS n_days, count(DISTINCT aes) AS n_stations, min(obs_date) AS first_day, max(obs_date) AS last_day, round(count(rh) / count(*), 9) AS share_known, round(avg(rh), 9) AS mean FROM obs GROUP BY 1")
def coverage_by_year(spark, d):
    out = clean.coverage(view(spark, d, "obs"), "rh")
    return out.withColumns({c: F.round(c, 9) for c in ("share_known", "mean")})


@query(f"""{_with('revisions', 'hotspots')}, {_FIRST}, {_STATE.format(h=24)}, z AS (SELECT r.national_fire_id, r.fire_size AS size_at_horizon FROM revisions r JOIN f USING (national_fire_id) WHERE r.record_start <= f.t0 + INTERVAL 72 HOUR QUALIFY row_number() OVER (PARTITION BY r.national_fire_id ORDER BY r.record_start DESC, r.id DESC) = 1)
    SELECT f.national_fire_id, month(t0) AS month, dayofyear(t0) AS doy, hour(t0) AS t0_hour, coalesce(s.fire_size, 0) AS size_at_decision, round(ln(1 + coalesce(s.fire_size, 0)), 9) AS log_size_at_decision, CASE WHEN size_at_horizon >= 100 THEN 1 ELSE 0 END::TINYINT AS escalated
    FROM f JOIN s USING (national_fire_id) JOIN z USING (national_fire_id) WHERE t0 + INTERVAL 72 HOUR <= (SELECT max(record_start) FROM revisions) AND size_at_horizon IS NOT NULL AND coalesce(s.fire_size, 0) < 100""")
def escalation_labels(spark, d):
    out = plans.escalation(view(spark, d, "revisions"), view(spark, d, "hotspots"))
    return out.select("national_fire_id", "month", "doy", "t0_hour", F.coalesce("size_at_decision", F.lit(0.0)).alias("size_at_decision"), F.round("log_size_at_decision", 9).alias("log_size_at_decision"), "escalated")


_HS = ("fwi", "hfi", "ros")
_NEAR10 = _NEAR.replace("50 / ", "10 / ").replace("dist_km <= 50", "dist_km <= 10")
_ESC = f"""{_FIRST}, {_STATE.format(h=24)}, z AS (SELECT r.national_fire_id, r.fire_size AS size_at_horizon, r.stage_of_control_status AS status_at_horizon FROM revisions r JOIN f USING (national_fire_id) WHERE r.record_start <= f.t0 + INTERVAL 72 HOUR QUALIFY row_number() OVER (PARTITION BY r.national_fire_id ORDER BY r.record_start DESC, r.id DESC) = 1),
    v AS (SELECT r.national_fire_id, count(*) AS n_revisions_by_decision, arg_min(fire_size, (record_start, id)) FILTER (fire_size IS NOT NULL) AS size_first, max(fire_size) AS size_max_so_far, count(DISTINCT stage_of_control_status) + max(CASE WHEN stage_of_control_status IS NULL THEN 1 ELSE 0 END) AS n_distinct_status FROM revisions r JOIN f USING (national_fire_id) WHERE record_start <= t0 + INTERVAL 24 HOUR GROUP BY 1),
    {_NEAR10},
    hs AS (SELECT n.national_fire_id, count(*) AS hs_count, {', '.join(f'max({m}) AS hs_{m}_max, {_MEAN.format(m=m)}' for m in _HS)}, CAST(sum(CAST(hfi AS DECIMAL(18,6))) AS DOUBLE) AS hs_hfi_sum, min(dist_km) AS hs_dist_min_km,
        count(DISTINCT CAST(rep_date AS date)) AS hs_active_days, date_diff('hour', min(rep_date), n.t0) AS hs_detection_lead_hours, any_value(hs_fuel_group) AS hs_fuel_group FROM n JOIN g USING (national_fire_id) GROUP BY n.national_fire_id, n.t0),
    q AS (SELECT national_fire_id, agency_code, t0 + INTERVAL 24 HOUR AS decision_at FROM f),
    c AS (SELECT q.national_fire_id, q.decision_at, s.national_preparedness_level AS ciffc_national_pl, s.agency_preparedness AS ciffc_agency_pl, date_diff('microsecond', s.published_at, q.decision_at) // 60000000 / 60.0e0 AS ciffc_sitrep_lag_hours FROM q ASOF LEFT JOIN sitreps s ON q.agency_code = s.agency_code AND q.decision_at >= s.published_at),
    esc AS (SELECT f.*, s.fire_size AS size_at_decision, s.stage_of_control_status AS status_at_decision, v.* EXCLUDE (national_fire_id), coalesce(hs.hs_count, 0) AS hs_count, coalesce(hs.hs_active_days, 0) AS hs_active_days, hs.* EXCLUDE (national_fire_id, hs_count, hs_active_days),
        cast(month(t0) AS INT) AS month, cast(dayofyear(t0) AS INT) AS doy, cast(hour(t0) AS INT) AS t0_hour, c.* EXCLUDE (national_fire_id), coalesce(s.fire_size, 0) - coalesce(v.size_first, 0) AS size_growth_to_decision, ln(1 + coalesce(s.fire_size, 0)) AS log_size_at_decision,
        z.size_at_horizon, z.status_at_horizon, CASE WHEN size_at_horizon >= 100 THEN 1 ELSE 0 END::TINYINT AS escalated, CASE WHEN coalesce(status_at_horizon, '') = 'OC' THEN 1 ELSE 0 END::TINYINT AS still_out_of_control
        FROM f JOIN s USING (national_fire_id) JOIN z USING (national_fire_id) JOIN c USING (national_fire_id) LEFT JOIN v USING (national_fire_id) LEFT JOIN hs USING (national_fire_id)
        WHERE t0 + INTERVAL 72 HOUR <= (SELECT max(record_start) FROM revisions) AND size_at_horizon IS NOT NULL AND coalesce(s.fire_size, 0) < 100)"""
_ALL3 = _with("revisions", "hotspots", "sitreps")
_ROUNDED = ("hs_dist_min_km", "log_size_at_decision")


def _escalation(spark, d):
    return plans.escalation(view(spark, d, "revisions"), view(spark, d, "hotspots"), view(spark, d, "sitreps"))


@query(f"{_ALL3}, {_ESC} SELECT * EXCLUDE ({', '.join(_ROUNDED)}), {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)} FROM esc")
def escalation_table(spark, d):
    return _escalation(spark, d).withColumns({c: F.round(c, 6) for c in _ROUNDED})


_LEVELS = ("agency_code", "region_code", "status_at_decision", "hs_fuel_group")
_NUMBERS = tuple(c for c in models.ESCALATION.numeric if c not in ("hs_sfc_mean", "hs_tfc_max", "hs_tfc_mean") and (not c.startswith("ciffc_") or c in ("ciffc_national_pl", "ciffc_agency_pl")))


@query(f"{_ALL3}, {_ESC}, {', '.join(f'l_{c} AS (SELECT list_sort(list(DISTINCT {c})) AS v FROM esc WHERE {c} IS NOT NULL)' for c in _LEVELS)} SELECT national_fire_id, {', '.join(f'round(cast(coalesce({c}, -1e9) AS DOUBLE), 6) AS x_{c}' for c in _NUMBERS)}, {', '.join(f'cast(coalesce(list_position((SELECT v FROM l_{c}), {c}), 0) AS DOUBLE) AS x_{c}' for c in _LEVELS)} FROM esc")
def escalation_matrix(spark, d):
    """The features of every labelled incident as numbers, levels numbered in their order."""
    table = written(_escalation(spark, d), "labelled")
    columns = models.features(table, models.ESCALATION)
    out = models.matrix(table, columns, models.levels_of(table, models.ESCALATION, columns))
    return out.select("national_fire_id", *[F.round(f"x_{c}", 6).alias(f"x_{c}") for c in columns])


@query(f"{_ALL3}, {_ESC} SELECT agency_code, count(*) AS n, cast(sum(escalated) AS BIGINT) AS positives FROM esc GROUP BY 1")
def fold_counts(spark, d):
    return models.fold_counts(_escalation(spark, d), models.ESCALATION)


_SEASON = "cast(2022 + least(2, (dayofyear(t0) - 1) {div} 9) as int)"


@query(f"{_ALL3}, {_ESC}, y AS (SELECT {_SEASON.format(div='//')} AS fire_year, escalated FROM esc) SELECT CASE WHEN fire_year < (SELECT max(fire_year) FROM y) THEN 'train' ELSE 'test' END AS part, fire_year, count(*) AS n, cast(sum(escalated) AS BIGINT) AS positives FROM y GROUP BY 1, 2")
def season_backtest_counts(spark, d):
    table = _escalation(spark, d).withColumn("fire_year", F.expr(_SEASON.format(div="div")))
    train, test, *_ = models.season_split(table)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "fire_year").agg(F.count("*").alias("n"), F.sum(F.col("escalated").cast("long")).alias("positives"))


@query()
def escalation_backtest(spark, d):
    """The held-out season's incidents with their risks: trees, isotonic calibration, size as the baseline."""
    table = written(_escalation(spark, d).withColumn("fire_year", F.expr(_SEASON.format(div="div"))), "labelled")
    train, test, *_ = models.season_split(table)
    return models.scored_split(train, test, models.ESCALATION)[0]


_X, _Y = "((cell_x + 0.5) * 10)", "((cell_y + 0.5) * 10)"
_RHO = f"sqrt({_X} * {_X} + {_Y} * {_Y})"
_ARC = f"(2 * asin(least(1, {_RHO} / (2 * 6371.0072))))"
_LAT = f"degrees(asin(greatest(-1, least(1, cos({_ARC}) * sin(radians(60)) + {_Y} * sin({_ARC}) * cos(radians(60)) / {_RHO}))))"
_LON = f"(-96 + degrees(atan2({_X} * sin({_ARC}), {_RHO} * cos(radians(60)) * cos({_ARC}) - {_Y} * sin(radians(60)) * sin({_ARC}))))"
_ALL_WEATHER = tuple(clean.LIMITS)
_IGNITION = f"""{_with('revisions', 'hotspots', 'weather', 'reports')}, {_FIRST}, {_EVENTS}, {_AGENCY}, {_AREA}, last AS (SELECT min(obs_date) AS a, max(obs_date) AS b FROM weather),
    days AS (SELECT unnest(generate_series(date '2024-01-01', date '2024-02-10', INTERVAL 1 DAY))::date AS day), on_record AS (SELECT day FROM days, last WHERE day > a AND day <= b + 1),
    pos AS (SELECT ev.cell_x, ev.cell_y, day, n_ignitions FROM ev JOIN area a ON a.cell_x = ev.cell_x AND a.cell_y = ev.cell_y JOIN on_record USING (day)),
    neg AS (SELECT a.cell_x, a.cell_y, day FROM area a, on_record QUALIFY row_number() OVER (PARTITION BY day ORDER BY md5('17|' || a.cell_x || '|' || a.cell_y || '|' || day), a.cell_x, a.cell_y) <= (SELECT round_even(0.2 * count(*), 0) FROM area)),
    panel AS (SELECT p.*, a.agency_code FROM (SELECT cell_x, cell_y, day, n_ignitions, 1 AS ignition FROM pos UNION ALL SELECT cell_x, cell_y, day, 0, 0 FROM neg ANTI JOIN pos USING (cell_x, cell_y, day)) p JOIN area a USING (cell_x, cell_y)),
    keys AS (SELECT DISTINCT cell_x, cell_y, day FROM panel), {_RING}, {_DAILY}, evd AS (SELECT cell_x, cell_y, day AS d, n_ignitions AS n FROM ev),
    {_trailing_ctes('hs', (1, 3, 7), (1, 3, 7), 60, ('fwi', 'hfi', 'ros'), 'daily', ('hfi',))}, {_trailing_ctes('ig', (7, 30, 365), (7, 365), 365, (), 'evd')},
    {_SITES.replace('FROM obs', 'FROM weather')}, {_KNN.format(k=12, w='WHERE dist_km <= 300')}, j AS (SELECT k.*, dist_km, power(1 / greatest(dist_km, 1), 2) AS w, {', '.join(_ALL_WEATHER)} FROM keys k JOIN nb USING (cell_x, cell_y) JOIN weather o ON o.aes = nb.aes AND o.obs_date = k.day - 1),
    wx AS (SELECT cell_x, cell_y, day, {', '.join(f'sum({m} * w) / sum(w) FILTER ({m} IS NOT NULL) AS wx_{m}' for m in _ALL_WEATHER)}, count(*) AS wx_n_stations, min(dist_km) AS wx_dist_km FROM j GROUP BY 1, 2, 3),
    centre AS (SELECT cell_x, cell_y, {_LAT} AS lat, {_LON} AS lon FROM (SELECT DISTINCT cell_x, cell_y FROM keys)),
    reported AS (SELECT p.cell_x, p.cell_y, p.day, {', '.join(f's.{source} AS {name}' for source, name in asof.SITREP.items())} FROM panel p ASOF LEFT JOIN reports s ON p.agency_code = s.agency_code AND p.day::TIMESTAMP >= s.published_at),
    ign AS (SELECT panel.*, a_hs.* EXCLUDE (cell_x, cell_y, day), b_hs.* EXCLUDE (cell_x, cell_y, day), a_ig.* EXCLUDE (cell_x, cell_y, day), b_ig.* EXCLUDE (cell_x, cell_y, day), wx.* EXCLUDE (cell_x, cell_y, day, wx_n_stations), coalesce(wx_n_stations, 0) AS wx_n_stations, lat, lon, dayofyear(day) AS doy, month(day) AS month,
        reported.* EXCLUDE (cell_x, cell_y, day) FROM panel JOIN a_hs USING (cell_x, cell_y, day) JOIN b_hs USING (cell_x, cell_y, day) JOIN a_ig USING (cell_x, cell_y, day) JOIN b_ig USING (cell_x, cell_y, day) LEFT JOIN wx USING (cell_x, cell_y, day) JOIN centre USING (cell_x, cell_y) JOIN reported USING (cell_x, cell_y, day))"""


@query(f"{_IGNITION}, v AS (SELECT list_sort(list(DISTINCT agency_code)) AS v FROM ign) SELECT cell_x, cell_y, day, cast(ignition AS TINYINT) AS ignition, {', '.join(f'round(cast(coalesce({c}, -1e9) AS DOUBLE), 6) AS x_{c}' for c in models.IGNITION.numeric)}, cast(list_position((SELECT v FROM v), agency_code) AS DOUBLE) AS x_agency_code FROM ign")
def ignition_matrix(spark, d):
    """The panel of cells and days with all 51 numbers of the contract, and the agency."""
    r, h, o, s = (view(spark, d, n) for n in ("revisions", "hotspots", "weather", "reports"))
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-02-10')) as day")
    table = written(plans.ignition(r, h, o, days, [2024], rate=0.2, sitreps=s), "panel")
    columns = models.features(table, models.IGNITION)
    out = models.matrix(table, columns, models.levels_of(table, models.IGNITION, columns))
    return out.select("cell_x", "cell_y", "day", "ignition", *[F.round(f"x_{c}", 6).alias(f"x_{c}") for c in columns])


@query()
def ignition_scores(spark, d):
    """Every cell of the study area on the day after the last observation, by a model of the contract's whole matrix."""
    r, h, o, t = (view(spark, d, n) for n in ("revisions", "hotspots", "weather", "reports"))
    days = spark.sql("select explode(sequence(date'2024-01-02', date'2024-01-30')) as day")
    panel_ = written(plans.ignition(r, h, o, days, [2024], rate=0.2, sitreps=t), "panel")
    return models.score_ignition(models.fit(panel_, models.IGNITION, rate=0.2), r, h, o, sitreps=t)


@query(f"""{_with('sitreps')} SELECT cast(year(sitrep_date) AS INT) AS year, count(DISTINCT sitrep_date) AS n_days, count(*) AS n_rows, round(avg(national_preparedness_level), 2) AS mean_national_pl,
    max(national_preparedness_level) AS max_national_pl, round(avg(agency_preparedness), 2) AS mean_agency_pl FROM sitreps GROUP BY 1""")
def preparedness_coverage(spark, d):
    return feeds.report_coverage(view(spark, d, "sitreps"))


@query(f"""{O} SELECT aes, max(temp) AS wx_temp_max, round(avg(temp), 9) AS wx_temp_mean, min(rh) AS wx_rh_min, round(avg(rh), 9) AS wx_rh_mean, max(fwi) AS wx_wind_max, round(avg(fwi), 9) AS wx_wind_mean,
    cast(NULL AS DOUBLE) AS wx_gust_max, cast(NULL AS DOUBLE) AS wx_precip_sum, cast(NULL AS DOUBLE) AS wx_vpd_max, cast(count(*) FILTER (rh < 30 AND fwi > 15) AS DOUBLE) AS wx_crossover_hours FROM obs GROUP BY aes""")
def weather_summary(spark, d):
    rows = view(spark, d, "obs").selectExpr("aes", "temp as temperature_2m", "rh as relative_humidity_2m", "fwi as wind_speed_10m")
    out = feeds.weather_summary(rows, ["aes"])
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.endswith("_mean")})


@query(f"{H} SELECT hid, CASE WHEN temp BETWEEN -60 AND 50 THEN temp END AS temp, CASE WHEN rh BETWEEN 0 AND 100 THEN rh END AS rh, CASE WHEN fwi BETWEEN 0 AND 200 THEN fwi END AS fwi FROM (SELECT hid, CAST(hid % 200 - 100 AS DOUBLE) AS temp, CAST(hid % 150 AS DOUBLE) AS rh, CAST(hid % 400 AS DOUBLE) AS fwi FROM hotspots)")
def physical_limits(spark, d):
    raw = view(spark, d, "hotspots").selectExpr("hid", "cast(hid % 200 - 100 as double) as temp", "cast(hid % 150 as double) as rh", "cast(hid % 400 as double) as fwi")
    return clean.in_limits(raw)


_FUELS = "CASE hid % 9 WHEN 0 THEN 'Water' WHEN 1 THEN 'vegetated non-fuel' WHEN 2 THEN 'Non-Fuel' WHEN 3 THEN 'URBAN' WHEN 4 THEN 'unknown' WHEN 5 THEN 'nonfuel' WHEN 6 THEN NULL ELSE fuel END"


@query(f"{H} SELECT hid, fuel FROM (SELECT hid, {_FUELS} AS fuel FROM hotspots) WHERE fuel IS NULL OR lower(fuel) NOT IN ('water', 'urban', 'unknown', 'non-fuel', 'vegetated non-fuel')")
def burnable_fuel(spark, d):
    return clean.burnable(view(spark, d, "hotspots").selectExpr("hid", f"{_FUELS} as fuel"))


@query(f"{R} SELECT id, CASE stage_of_control_status WHEN 'OC' THEN 'out of control' WHEN 'BH' THEN 'being held' WHEN 'UC' THEN 'under control' WHEN 'EX' THEN 'out' WHEN 'UNK' THEN 'unknown' ELSE stage_of_control_status END AS status FROM revisions")
def status_labels(spark, d):
    return view(spark, d, "revisions").select("id", serving.status_label("stage_of_control_status").alias("status"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) IN (1995, 1996) AND month(o_orderdate) BETWEEN 4 AND 10")
def season_rows(spark, d):
    return clean.in_season(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate", [1995, 1996]).select("o_orderkey", "o_orderdate")


_PAIRED = "SELECT cast(cast(aes AS INT) % 20 AS VARCHAR) AS aes, obs_date, temp, rh, fwi, lat, lon FROM obs"


@query(f"{O}, o AS ({_PAIRED}) SELECT aes, obs_date, round(avg(temp), 9) AS temp, round(avg(rh), 9) AS rh, round(avg(fwi), 9) AS fwi, arg_min(lat, (lat, lon)) AS lat, arg_min(lon, (lat, lon)) AS lon FROM o GROUP BY 1, 2")
def station_day_means(spark, d):
    rows = view(spark, d, "obs").withColumn("aes", (F.col("aes").cast("int") % 20).cast("string"))
    out = clean.station_days(rows, ["temp", "rh", "fwi"])
    return out.withColumns({c: F.round(c, 9) for c in ("temp", "rh", "fwi")})


@query(f"{H} SELECT hid, CASE WHEN hfi - 300 >= 0 THEN hfi - 300 END AS hfi, CASE WHEN ros - 10 >= 0 THEN ros - 10 END AS ros FROM hotspots")
def sentinels(spark, d):
    return clean.without_sentinels(view(spark, d, "hotspots").selectExpr("hid", "hfi - 300 as hfi", "ros - 10 as ros"), ["hfi", "ros"])


@query(f"{H} SELECT hid, CASE WHEN hid % 7 <> 0 THEN date_trunc('second', rep_date) END AS rep_date FROM hotspots")
def feed_timestamps(spark, d):
    text = "case when hid % 7 = 0 then 'not a date' when hid % 2 = 0 then date_format(rep_date, \"yyyy-MM-dd'T'HH:mm:ss\") else date_format(rep_date, 'yyyy-MM-dd HH:mm:ss') end as rep_date"
    return view(spark, d, "hotspots").selectExpr("hid", text).withColumn("rep_date", clean.timestamp("rep_date"))


_IDS = "CASE id % 4 WHEN 0 THEN concat('2024_', agency_code, '_', national_fire_id) WHEN 1 THEN national_fire_id WHEN 2 THEN concat('x', national_fire_id, '_7') ELSE NULL END"


@query(f"{R} SELECT id, CASE WHEN length(f) - length(replace(f, '_', '')) >= 2 THEN array_to_string(string_split(f, '_')[3:], '_') ELSE coalesce(f, '') END AS short FROM (SELECT id, {_IDS} AS f FROM revisions)")
def short_ids(spark, d):
    return view(spark, d, "revisions").selectExpr("id", f"{_IDS} as f").select("id", clean.short_id("f").alias("short"))


@query(f"{R}, {_FIRST} SELECT national_fire_id, date_diff('microsecond', t0, TIMESTAMP '2024-03-01 12:34:56') // 3600000000 AS age_hours FROM f")
def incident_age_hours(spark, d):
    return _revisions(spark, d)[1].select("national_fire_id", clean.age_hours("t0", "2024-03-01 12:34:56").alias("age_hours"))


@query(f"{R}, {_FIRST} SELECT f.*, r.fire_size AS size_now, r.stage_of_control_status AS status_now FROM f JOIN revisions r USING (national_fire_id) QUALIFY row_number() OVER (PARTITION BY f.national_fire_id ORDER BY r.record_start DESC, r.id DESC) = 1".replace("f.*", "f.national_fire_id, f.t0"))
def latest_state(spark, d):
    r, seen = _revisions(spark, d)
    return models.with_latest(seen.select("national_fire_id", "t0"), r)


@query(f"{R} SELECT id, coalesce(fire_size, 0) AS size, 0.0e0 AS nothing FROM revisions")
def baseline_vector(spark, d):
    r = view(spark, d, "revisions")
    return r.select("id", clean.zero_if_missing(r, "fire_size").alias("size"), clean.zero_if_missing(r, "no_such_column").alias("nothing"))


_STATIONS = "SELECT DISTINCT aes, lat, lon, CASE cast(aes AS INT) % 3 WHEN 0 THEN 'AB' WHEN 1 THEN 'BC' ELSE NULL END AS prov FROM obs WHERE cast(aes AS INT) % 7 <> 0"


@query(f"{O}, st AS ({_STATIONS}) SELECT o.aes, o.obs_date, o.temp, st.lat, st.lon FROM obs o JOIN st USING (aes)")
def observations_with_stations(spark, d):
    obs = view(spark, d, "obs")
    return clean.with_stations(obs.select("aes", "obs_date", "temp"), spark.sql(_STATIONS.replace("FROM obs", "FROM {obs}"), obs=obs))


@query(f"{O}, st AS ({_STATIONS}) SELECT o.aes, o.obs_date, st.prov FROM obs o LEFT JOIN st USING (aes)")
def observations_with_provinces(spark, d):
    obs = view(spark, d, "obs")
    return clean.with_provinces(obs.select("aes", "obs_date"), spark.sql(_STATIONS.replace("FROM obs", "FROM {obs}"), obs=obs))


_CENTRES = f"centres AS (SELECT cell_x, cell_y, {_LAT} AS lat, {_LON} AS lon FROM (SELECT DISTINCT {_cell()} FROM hotspots))"


@query(f"{H}, {_CENTRES} SELECT cell_x, cell_y, round(lat, 6) AS lat, round(lon, 6) AS lon FROM centres")
def cell_centres(spark, d):
    out = grid.with_centres(grid.with_cells(view(spark, d, "hotspots")).select("cell_x", "cell_y").distinct())
    return out.withColumns({c: F.round(c, 6) for c in ("lat", "lon")})


_INSIDE = "i AS (SELECT cell_x, cell_y, code, ring FROM centres JOIN edges ON (a_lat > lat) <> (b_lat > lat) AND lon < (b_lon - a_lon) * (lat - a_lat) / (b_lat - a_lat) + a_lon GROUP BY 1, 2, 3, 4 HAVING count(*) % 2 = 1), poly AS (SELECT cell_x, cell_y, arg_min(code, ring) AS code FROM i GROUP BY 1, 2)"


@query(f"{_with('revisions', 'hotspots')}, {_FIRST}, {_EVENTS}, {_AGENCY}, {_CENTRES}, {_EDGE_SQL}, {_INSIDE} SELECT cell_x, cell_y, coalesce(vote.agency_code, code) AS agency_code FROM centres LEFT JOIN vote USING (cell_x, cell_y) LEFT JOIN poly USING (cell_x, cell_y)")
def agency_or_polygon(spark, d):
    cells = grid.with_cells(view(spark, d, "hotspots")).select("cell_x", "cell_y").distinct()
    return panel.cell_agency(cells, panel.ignition_events(view(spark, d, "revisions")), _edges(spark))


_DAYS = "days AS (SELECT unnest(generate_series(date '2024-01-05', date '2024-01-20', INTERVAL 1 DAY))::date AS day)"


@query(f"{_with('revisions', 'hotspots')}, {_FIRST}, {_EVENTS}, {_AGENCY}, {_AREA}, {_DAYS}, reach AS (SELECT ev.* FROM ev SEMI JOIN days USING (day)) SELECT cast(sum(n_ignitions) AS BIGINT) AS n_reachable, cast(sum(n_ignitions) FILTER ((cell_x, cell_y) IN (SELECT (cell_x, cell_y) FROM area)) AS BIGINT) AS n_inside, round(n_inside / n_reachable, 9) AS coverage FROM reach")
def area_coverage(spark, d):
    events = panel.ignition_events(view(spark, d, "revisions"))
    days = spark.sql("select explode(sequence(date'2024-01-05', date'2024-01-20')) as day")
    return panel.area_coverage(panel.study_area(events, view(spark, d, "hotspots"), [2024]), events, days).withColumn("coverage", F.round("coverage", 9))


@query(f"{_with('revisions', 'hotspots', 'obs')}, {_FIRST}, {_EVENTS}, {_AGENCY}, {_AREA} SELECT cell_x, cell_y, agency_code, day FROM area, (SELECT unnest([max(obs_date), max(obs_date) + 1])::date AS day FROM obs)")
def area_on_scoreable_days(spark, d):
    area = panel.study_area(panel.ignition_events(view(spark, d, "revisions")), view(spark, d, "hotspots"), [2024])
    return models.area_days(area, panel.scoreable_days(view(spark, d, "obs"), days=2))


@query("SELECT day FROM (SELECT unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY))::date AS day FROM (SELECT DISTINCT cast(year(o_orderdate) AS INT) AS y FROM orders)) WHERE month(day) BETWEEN 4 AND 10")
def season_days(spark, d):
    """Season days of all years that have orders."""
    years = spark.read.parquet(f"{d}/orders.parquet").select(F.year("o_orderdate")).where("o_orderdate is not null").distinct().collect()
    return panel.season_days(spark, [r[0] for r in years])


@query(f"{_with('scored')} SELECT count(*) AS n, count(*) FILTER (p >= 0.1) AS n_over_10, count(*) FILTER (p >= 0.25) AS n_over_25, count(*) FILTER (y = 1) AS n_out_of_control FROM scored")
def readouts(spark, d):
    return serving.readouts(view(spark, d, "scored").selectExpr("p as risk", "if(y = 1, 'OC', 'EX') as status_now"))


@query(f"{E}, q AS (SELECT list_sort(list(p)) AS s, count(*) AS n FROM scored) SELECT doc_id, round(p, 9) AS risk, cast((p < s[1 + cast(floor(0.995 * (n - 1) + 0.5) AS INT)])::INT + (p < s[1 + cast(floor(0.98 * (n - 1) + 0.5) AS INT)])::INT AS INT) AS band FROM scored, q QUALIFY row_number() OVER (ORDER BY p DESC, doc_id) <= greatest(1, n * 8 // 100)")
def top_share(spark, d):
    out = serving.top_share(view(spark, d, "scored").select("doc_id", F.col("p").alias("risk")), ties=("doc_id",), day=None)
    return out.withColumn("risk", F.round("risk", 9))


@query("SELECT o_orderkey, o_totalprice, o_orderdate, cast(year(o_orderdate) AS INT) AS season FROM orders WHERE year(o_orderdate) < 1997 AND (year(o_orderdate) <> 1996 OR o_orderkey % 2 = 0)")
def season_replacement(spark, d):
    """A table of seasons, one of which is replaced, twice: the second time changes nothing."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderdate")
    path = f"{shared.folder(spark)}/seasons-{uuid.uuid4().hex}"
    tables.replace_seasons(orders.where("year(o_orderdate) < 1997"), path, at="o_orderdate")
    for _ in range(2):
        tables.replace_seasons(orders.where("year(o_orderdate) = 1996 and o_orderkey % 2 = 0"), path, at="o_orderdate")
    return spark.read.parquet(path)


@query("SELECT o_orderkey, o_orderdate, cast(year(o_orderdate) AS INT) AS season FROM orders WHERE year(o_orderdate) < 1997 AND (year(o_orderdate) <> 1995 OR o_orderkey % 3 = 0)")
def season_narrowing(spark, d):
    """A season replaced by rows with other columns: only the common ones stay, in all seasons."""
    orders = spark.read.parquet(f"{d}/orders.parquet").where("year(o_orderdate) < 1997")
    path = f"{shared.folder(spark)}/narrowed-{uuid.uuid4().hex}"
    tables.replace_seasons(orders.select("o_orderkey", "o_orderdate", "o_orderpriority"), path, at="o_orderdate")
    tables.replace_seasons(orders.where("year(o_orderdate) = 1995 and o_orderkey % 3 = 0").select("o_orderkey", "o_orderdate", "o_totalprice"), path, at="o_orderdate")
    return spark.read.parquet(path)


@query(f"{_with('hotspots', 'obs')}, days AS (SELECT DISTINCT cast(rep_date AS date) + 12 AS day FROM hotspots) SELECT day::date AS day FROM days WHERE day > (SELECT min(obs_date) FROM obs) AND day <= (SELECT max(obs_date) + 1 FROM obs)")
def days_on_record(spark, d):
    days = view(spark, d, "hotspots").select(F.expr("date_add(to_date(rep_date), 12)").alias("day")).distinct()
    return panel.days_on_record(days, view(spark, d, "obs"))


@query(f"{R} SELECT id, national_fire_id FROM revisions")
def dropped_columns(spark, d):
    rows = view(spark, d, "revisions").selectExpr("id", "national_fire_id", "'p' as geometry", "1 as FID")
    return clean.without(rows, "geometry", "FID", "no_such_column")


_LIST = "SELECT concat('  ', aes, ' ') AS aes, CASE WHEN cast(aes AS INT) % 5 = 0 THEN 'n/a' ELSE concat(' ', cast(cast(floor(lat) AS INT) AS {s})) END AS lat, concat(cast(cast(floor(lon) AS INT) AS {s}), '  ') AS lon, CASE WHEN cast(aes AS INT) % 2 = 0 THEN ' AB ' ELSE 'BC' END AS prov FROM {obs}"


@query(f"{O}, raw AS ({_LIST.format(s='VARCHAR', obs='obs')}) SELECT trim(aes) AS aes, min(try_cast(trim(lat) AS DOUBLE)) AS lat, min(try_cast(trim(lon) AS DOUBLE)) AS lon, min(trim(prov)) AS prov FROM raw WHERE try_cast(trim(lat) AS DOUBLE) IS NOT NULL GROUP BY 1")
def station_list(spark, d):
    """Padded text columns as a list of stations; one without a number for a latitude goes."""
    return feeds.stations(spark.sql(_LIST.format(s="STRING", obs="{obs}"), obs=view(spark, d, "obs")))


@query(f"{R} SELECT id, CASE WHEN id % 5 <> 4 THEN date_trunc('second', record_start) END AS at FROM revisions")
def utc_instants(spark, d):
    """Texts with a zone, with an offset or without, as instants in UTC; what is none is null."""
    fmt = "yyyy-MM-dd'T'HH:mm:ss"
    text = f"""case id % 5 when 0 then concat(date_format(record_start, "{fmt}"), 'Z') when 1 then concat(date_format(record_start + interval 5 hours 30 minutes, "{fmt}"), '+05:30')
        when 2 then date_format(record_start, "{fmt}") when 3 then concat(date_format(record_start - interval 7 hours, "{fmt}"), '-0700') else 'soon' end as text"""
    return view(spark, d, "revisions").selectExpr("id", text).select("id", feeds.utc("text").alias("at"))


@query(f"{E} SELECT doc_id, CASE WHEN y = 1 THEN 1.0e0 ELSE 1 / 0.02e0 END AS weight FROM scored")
def sample_weights(spark, d):
    return view(spark, d, "scored").select("doc_id", metrics.sample_weight("y", 0.02).alias("weight"))


@query(f"{R} SELECT concat('{{\"id\":', id, ',\"day\":\"', strftime(record_start, '%Y-%m-%d'), '\",\"at\":\"', strftime(date_trunc('second', record_start), '%Y-%m-%dT%H:%M:%S'), '\",\"status\":', CASE WHEN stage_of_control_status IS NULL THEN 'null' ELSE concat('\"', stage_of_control_status, '\"') END, ',\"size\":null}}') AS json FROM revisions WHERE record_start IS NOT NULL")
def json_rows(spark, d):
    """Rows as JSON texts: dates in ISO form, nulls kept, no number is not a number."""
    rows = view(spark, d, "revisions").where("record_start is not null").selectExpr("id", "to_date(record_start) as day", "record_start as at", "stage_of_control_status as status", "double('NaN') as size")
    return clean.json_rows(rows)


_RISKS = "risks AS (SELECT national_fire_id, agency_code, n_revisions, ((n_revisions * 37 + dayofyear(t0) * 11) % 101) / 101.0e0 AS risk FROM f)"


def _risks(spark, d):
    return _revisions(spark, d)[1].selectExpr("national_fire_id", "agency_code", "n_revisions", "((n_revisions * 37 + dayofyear(t0) * 11) % 101) / 101.0D as risk")


@query(f"{R}, {_FIRST}, {_RISKS}, m AS (SELECT * FROM risks WHERE agency_code = 'AB' AND risk >= 0.2) SELECT *, (SELECT count(*) FROM m) AS n_matching FROM m ORDER BY risk DESC, national_fire_id LIMIT 40")
def served_fires(spark, d):
    """The riskiest incidents of an agency, and how many match."""
    return serving.fires(_risks(spark, d), limit=40, min_risk=0.2, agency="ab")


@query(f"{R}, {_FIRST}, {_RISKS} SELECT * FROM risks WHERE national_fire_id = (SELECT max(national_fire_id) FROM risks)")
def served_fire(spark, d):
    """One incident, looked up by its id."""
    risks = _risks(spark, d)
    return serving.fire(risks, risks.agg(F.max("national_fire_id")).first()[0])


@query(f"{R}, {_FIRST}, {_RISKS}, o AS (SELECT *, row_number() OVER (ORDER BY risk DESC, national_fire_id) AS place FROM risks) SELECT * FROM o")
def incidents_by_risk(spark, d):
    """All incidents by falling risk, with their places in that order."""
    ordered = serving.by_risk(_risks(spark, d), "national_fire_id").withColumn("_i", F.monotonically_increasing_id())
    table = written(ordered, "by-risk")
    sizes = table.groupBy(F.shiftright("_i", 33).alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("start", before).select("part", "start")
    placed = table.withColumn("part", F.shiftright("_i", 33)).join(F.broadcast(starts), "part")
    return placed.withColumn("place", F.col("start") + F.col("_i").bitwiseAND((1 << 33) - 1) + 1).drop("part", "start", "_i")


_DAY_RISK = "((abs(cell_x) * 31 + abs(cell_y) * 17 + dayofyear(day)) % 997) / 997.0{e} AS risk"


@query(f"{H}, {_CENTRES}, r AS (SELECT cell_x, cell_y, day, round(lat, 6) AS lat, round(lon, 6) AS lon, {_DAY_RISK.format(e='e0')} FROM centres JOIN (SELECT DISTINCT {_cell()}, cast(rep_date AS date) AS day FROM hotspots) USING (cell_x, cell_y)), m AS (SELECT * FROM r WHERE day = (SELECT max(day) FROM r) AND lon BETWEEN -122 AND -108 AND lat BETWEEN 48 AND 57 AND risk >= 0.1) SELECT *, (SELECT count(*) FROM m) AS n_matching FROM m ORDER BY risk DESC, cell_x, cell_y LIMIT 500")
def served_cells(spark, d):
    """The newest day's riskiest cells in a box."""
    cells = grid.with_centres(grid.with_cells(view(spark, d, "hotspots")).select("cell_x", "cell_y", F.to_date("rep_date").alias("day")).distinct())
    cells = cells.withColumns({c: F.round(c, 6) for c in ("lat", "lon")})
    return serving.ignition(cells.selectExpr("*", _DAY_RISK.format(e="D")), limit=500, min_risk=0.1, bbox=(-122, 48, -108, 57))
