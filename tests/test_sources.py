"""Feeds and curated tables on small landed files."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from pitgrid.functions import clean, grid
from pitgrid.sources import feeds, tables


def test_detections_plain_and_zipped(spark, tmp_path):
    text = " lat ,LON,rep_date,fwi,odd\n55.0,-115.0,2024-06-01T12:00:00.5,x,1\n56,-116,2024-06-02 00:00:00,3.5,2\n"
    (tmp_path / "a.csv").write_text(text)
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("one.csv", text)
        z.writestr("two.csv", "lat,lon,rep_date\n57,-117,bad\n")
    plain = feeds.detections(feeds.delimited(spark, str(tmp_path / "a.csv")))
    assert plain.columns == ["lat", "lon", "fwi", "rep_date"]
    rows = plain.orderBy("lat").collect()
    assert rows[0].fwi is None and rows[1].fwi == 3.5 and rows[0].rep_date == dt.datetime(2024, 6, 1, 12, 0, 0, 500000)
    packed = feeds.detections(feeds.zipped(spark, str(tmp_path / "s.zip"), ["lat", "lon", "rep_date", "fwi"]))
    assert [(r.lat, r.fwi, r.rep_date is None) for r in packed.orderBy("lat").collect()] == [(55.0, None, False), (56.0, 3.5, False), (57.0, None, True)]


def test_stations(spark, tmp_path):
    (tmp_path / "d.csv").write_text("AES,REPDATE,TEMP,RH\n A1 ,20240601, 20.5 ,120\nAES,REPDATE,TEMP,RH\n")
    rows = feeds.station_days(feeds.delimited(spark, str(tmp_path / "d.csv"))).collect()
    assert [(r.aes, r.obs_date, r.temp, r.rh) for r in rows] == [("A1", dt.date(2024, 6, 1), 20.5, None)]
    raw = spark.createDataFrame([("A", "2", "3", "AB"), (" A", "1", "3", "AB"), ("B", "x", "3", None)], "aes string, lat string, lon string, prov string")
    assert [tuple(r) for r in feeds.stations(raw).collect()] == [("A", 1.0, 3.0, "AB")]
    with pytest.raises(ValueError):
        feeds.station_days(raw)


def test_reports(spark):
    index = {"2025": {"6": {"1": {"data": {"field_date": "2025-06-01T00:00", "field_preparedness_level": 3}}, "2": {"data": {}}, "3": None}}}
    assert [tuple(r) for r in feeds.report_index(spark.createDataFrame([(json.dumps(index),)], "value string")).collect()] == [(dt.date(2025, 6, 1), 3.0)]
    day = {"field_date": "2025-06-01", "system_edit_timestamp": "2025-06-01T20:00:00Z", "field_preparedness_level": "4", "agencies_sitereps": {"ab": {"sitrep": {"system_edit_timestamp": "2025-06-01T15:00:00-06:00", "field_preparedness": "2"}}, "bc": {"sitrep": {"field_prep_hazard": ""}}, "on": None}}
    late = day | {"system_edit_timestamp": None, "agencies_sitereps": {"AB": {"sitrep": {"system_edit_timestamp": "2025-06-01T23:00:00Z", "field_preparedness": 5}}, "SK": {"sitrep": {}}}}
    rows = feeds.agency_reports(spark.createDataFrame([(json.dumps(day),), (json.dumps(late),), ("junk",), (None,)], "value string"))
    got = {(r.agency_code, r.published_at): (r.agency_preparedness, r.prep_hazard, r.national_preparedness_level) for r in rows.collect()}
    at = lambda h: dt.datetime(2025, 6, 1, h)
    assert got == {("AB", at(21)): (2.0, None, 4.0), ("BC", at(20)): (None, None, 4.0), ("ON", at(20)): (None, None, 4.0), ("AB", at(23)): (5.0, None, 4.0)}
    kept = feeds.report_history(rows)
    assert {r.agency_code: r.agency_preparedness for r in kept.collect()} == {"AB": 5.0, "BC": None, "ON": None}
    assert tuple(feeds.report_coverage(kept).first()) == (2025, 1, 3, 4.0, 4.0, 5.0)


def test_pages(spark):
    html = """<body><p>National Preparedness Level: 4</p><p>For: June 1, 2025</p><table><tr><th>Agency</th><th>APL</th></tr><tr><td>Alberta</td><td>3</td></tr><tr><td>Total</td><td>9</td></tr></table>
    <table><tr><th>Agency</th><th>Human</th><th>Natural</th></tr><tr><td>Quebec</td><td>1,200</td><td>-</td></tr></table><table><tr><td>alone</td></tr></table></body>"""
    parsed = feeds.pages(spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string"))
    rows = {r.id: r for r in parsed.collect()}
    assert (rows[1].preparedness_level, rows[1].sitrep_date, len(rows[1].tables)) == (4, dt.date(2025, 6, 1), 2) and rows[2].preparedness_level is None
    assert [tuple(r) for r in feeds.agency_levels(parsed, ["id"]).collect()] == [(1, "AB", 3.0)]
    assert [tuple(r) for r in feeds.new_fires(parsed, ["id"]).collect()] == [(1, "QC", None, 1200.0, None)]


def test_area_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text("latitude,acq_date,acq_time\n1,2024-06-01,930\n2,2024-06-01,x\n")
    assert [r.acq_datetime for r in feeds.area_detections(spark, str(tmp_path / "f.csv")).orderBy("latitude").collect()] == [dt.datetime(2024, 6, 1, 9, 30), None]
    (tmp_path / "bad.csv").write_text("Invalid MAP_KEY.\n")
    with pytest.raises(ValueError):
        feeds.area_detections(spark, str(tmp_path / "bad.csv"))
    assert feeds.spans(dt.date(2024, 1, 1), dt.date(2024, 1, 7)) == [(dt.date(2024, 1, 1), 5), (dt.date(2024, 1, 6), 2)]


def test_hourly(spark):
    text = json.dumps({"latitude": 55.0, "longitude": -115.0, "hourly": {"time": ["2024-06-01T00:00", "2024-06-01T01:00"], "temperature_2m": [10, None], "relative_humidity_2m": [20, 40], "wind_speed_10m": [16, 30]}})
    rows = feeds.hourly(spark.createDataFrame([(text,), ("{}",)], "value string"))
    assert rows.count() == 2
    fires = spark.createDataFrame([("F1", 55.01, -114.98, dt.datetime(2024, 6, 1, 5))], "national_fire_id string, lat double, lon double, t0 timestamp_ntz")
    r = feeds.fire_weather(fires, rows).first()
    assert (r.wx_temp_mean, r.wx_rh_min, r.wx_wind_max, r.wx_gust_max, r.wx_crossover_hours) == (10.0, 20.0, 30.0, None, 1.0)


def test_outlines(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps([{"p": "AA", "r": [[[0, 0], [2, 0], [2, 2], [0, 2]], [[0, 0], [1, 1]]]}, {"p": "BB", "r": [[[1, 1], [3, 1], [3, 3], [1, 3]]]}]))
    edges = grid.polygon_edges(feeds.outlines(spark, str(tmp_path / "o.json")))
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 2.5, 2.5), (4, 9.0, 9.0)], "id int, lat double, lon double")
    assert {r.id: r.code for r in grid.place(points, edges, "id").collect()} == {1: "AA", 2: "AA", 3: "BB"}


def test_season_replacement(spark, tmp_path):
    path = str(tmp_path / "hot")
    rows = lambda year, n, **more: spark.range(n).select(F.expr(f"timestamp_ntz'{year}-06-01 00:00:00'").alias("rep_date"), F.lit(1.0).alias("fwi"), *[F.lit(v).alias(k) for k, v in more.items()])
    count = lambda: {r.season: r["count"] for r in spark.read.parquet(path).groupBy("season").count().collect()}
    tables.replace_seasons(rows(2024, 3, estarea=1.0).union(rows(2025, 2, estarea=1.0)), path)
    for _ in range(2):
        assert tables.replace_seasons(rows(2025, 5, estarea=2.0), path) == [] and count() == {2024: 3, 2025: 5}
    assert tables.replace_seasons(rows(2025, 4), path) == ["estarea"] and count() == {2024: 3, 2025: 4}
    assert "estarea" not in spark.read.parquet(path).columns
    tables.replace_seasons(rows(2026, 1), path, [2024, 2026])
    assert count() == {2025: 4, 2026: 1}
    tables.write_json(spark, {"n": 1}, f"{path}.json")
    assert tables.read_json(spark, f"{path}.json") == {"n": 1}


def test_archive_reads_the_season_only(spark, tmp_path):
    head = "aes,rep_date,lat,lon,elev,temp,rh,ws,precip,ffmc,dmc,dc,isi,bui,fwi,dsr,extra"
    line = lambda day, temp, fwi, lat="50": f"A1,{day} 12:00:00,{lat},-110,7,{temp},40,1,0,80,1,1,1,1,{fwi},1,x"
    rows = [line("2024-07-01", 10, 250), line("2024-07-01", 20, 100), line("2024-12-01", 10, 1), line("2023-07-01", 10, 1), line("2024-07-02", 10, 1, ""), line("junk", 1, 1)]
    (tmp_path / "a.csv").write_text("\n".join([head, *rows]))
    got = feeds.archive(spark, f"file://{tmp_path}/a.csv", [2024]).collect()
    assert [(str(r.obs_date), r.temp, r.fwi, r.lat) for r in got] == [("2024-07-01", 15.0, 100.0, 50.0)]
    assert feeds.archive(spark, f"file://{tmp_path}/a.csv", [2024], season_only=False).count() == 2
    (tmp_path / "b.csv").write_text("aes,rep_date\nA1,2024-07-01")
    with pytest.raises(ValueError, match="lacks"):
        feeds.archive(spark, f"file://{tmp_path}/b.csv", [2024])


def test_small_functions(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 1.5, "x")], "k int, v double, geometry string").withColumn("at", F.expr("timestamp_ntz'2024-01-02 03:04:05'"))
    assert clean.without(df, "geometry", "FID").columns == ["k", "v", "at"]
    assert [r.json for r in clean.json_rows(clean.without(df, "geometry")).orderBy("json").collect()] == ['{"k":1,"v":null,"at":"2024-01-02T03:04:05"}', '{"k":2,"v":1.5,"at":"2024-01-02T03:04:05"}']
    hot = spark.createDataFrame([("Water", 1), (None, 2), ("Vegetated Non-Fuel", 3), ("C2", 4)], "fuel string, k int")
    assert {r.k for r in clean.burnable(hot).collect()} == {2, 4}
