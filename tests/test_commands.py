"""The commands, one after the other over one folder."""

import json

import pytest
from pyspark.sql import functions as F

from pitgrid.__main__ import main
from pitgrid.plans.views import view


def test_from_landed_files_to_scores(spark, tmp_path, capsys):
    d, root = "/root/testdata/sf0.001", f"file://{tmp_path}"
    fires = view(spark, d, "revisions").withColumn("national_fire_id", F.expr("concat('2024_', agency_code, '_', national_fire_id)")).withColumn("geometry", F.lit("x")).withColumn("fire_year", F.lit(2024))
    fires.write.parquet(f"{root}/raw/fires")
    view(spark, d, "hotspots").selectExpr("lat", "lon", "date_format(rep_date, 'yyyy-MM-dd HH:mm:ss') as rep_date", "fwi", "hfi", "ros", "if(hid % 5 = 0, 'Water', fuel) as fuel").write.csv(f"{root}/raw/hotspots", header=True)
    view(spark, d, "obs").write.parquet(f"{root}/station_fwi")
    run = lambda *a: main([*a, "--data", root], spark)
    with pytest.raises(SystemExit, match="is missing"):
        run("build")
    run("ingest-fires", "--years", "2024")
    run("ingest-hotspots")
    assert spark.read.parquet(f"{root}/hotspots").where("fuel = 'Water'").count() == 0 and "geometry" not in spark.read.parquet(f"{root}/reported_fires").columns
    with pytest.raises(SystemExit, match="land the files"):
        run("ingest-ciffc")
    days, index = tmp_path / "raw/ciffc/days", tmp_path / "raw/ciffc/index"
    days.mkdir(parents=True)
    index.mkdir()
    agency = lambda n, at: {"sitrep": {"system_edit_timestamp": at, "field_preparedness": str(n)}}
    for k, (day, level) in enumerate((("2024-01-04", "3"), ("2024-01-05", None), ("2024-01-06", "5"))):
        report = {"field_date": day, "system_edit_timestamp": f"{day}T20:00:00Z", "field_preparedness_level": level, "agencies_sitereps": {"ab": agency(k, None), "BC": agency(4, f"{day}T18:00:00-02:00")}}
        (days / f"{day}.json").write_text(json.dumps(report))
    known = lambda day, level: {"data": {"field_date": day, "field_preparedness_level": level}}
    (index / "all.json").write_text(json.dumps({"2024": {"01": {"04": known("2024-01-04", "3"), "05": known("2024-01-05", "2")}}}))
    run("ingest-ciffc", "--years", "2024")
    reports = spark.read.parquet(f"{root}/ciffc_sitreps")
    assert sorted((str(r.sitrep_date), r.agency_code, str(r.published_at), r.national_preparedness_level) for r in reports.collect()) == [(d, a, f"{d} 20:00:00", n) for d, n in (("2024-01-04", 3.0), ("2024-01-05", 2.0)) for a in ("AB", "BC")]
    html = tmp_path / "raw/ciffc_pages"
    html.mkdir()
    (html / "a.html").write_text("<p>For: June 5, 2024</p><p>National Preparedness Level: 4</p><table><tr><th>Agency</th><th>Natural</th><th>Human</th></tr><tr><td>Alberta</td><td>2</td><td>1</td></tr><tr><td>Total</td><td>2</td><td>1</td></tr></table><table><tr><th>Agency</th><th>APL</th></tr><tr><td>Alberta</td><td>3</td></tr></table>")
    run("scrape-ciffc")
    assert [(str(r.sitrep_date), r.preparedness_level) for r in spark.read.parquet(f"{root}/ciffc_pages").collect()] == [("2024-06-05", 4)]
    assert [(r.agency_code, r.natural, r.human) for r in spark.read.parquet(f"{root}/ciffc_new_fires").collect()] == [("AB", 2.0, 1.0)] and spark.read.parquet(f"{root}/ciffc_agency_levels").first().agency_preparedness == 3.0
    run("diagnose")
    run("build")
    assert spark.read.parquet(f"{root}/modelling_table").where("ciffc_national_pl is not null").count() > 0
    table = spark.read.parquet(f"{root}/modelling_table").withColumn("fire_year", F.expr("cast(2022 + pmod(xxhash64(national_fire_id), 2) as int)")).withColumn("escalated", F.expr("if(size_at_decision > 40, 1, 0)"))
    table.unionByName(table.withColumn("national_fire_id", F.concat("national_fire_id", F.lit("b")))).write.parquet(f"{root}/bigger")
    spark.read.parquet(f"{root}/bigger").write.mode("overwrite").parquet(f"{root}/modelling_table")
    run("backtest", "--trees", "3", "--bootstrap", "8")
    assert json.loads((tmp_path / "models/escalation_backtest.json").read_text())["result"]["test_years"] == [2023]
    run("fit-final", "--trees", "3")
    run("predict", "--window-days", "40")
    risk = spark.read.parquet(f"{root}/current_risk")
    assert risk.count() > 0 and {"risk", "age_hours", "status_now"} <= set(risk.columns)
    run("dashboard")
    run("meta")
    assert '"built": true' in capsys.readouterr().out
