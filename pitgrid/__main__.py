"""Commands over a folder of tables: python -m pitgrid COMMAND --data FOLDER [options].

The folder holds landed files under ``raw`` and tables as Parquet: reported_fires, quarantined, hotspots, station_fwi, ciffc_sitreps, modelling_table, ignition_table,
current_risk, ignition_risk; models are in ``models``. It may be in any store that Spark reaches.
"""

from __future__ import annotations

import argparse
import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgrid.functions import clean
from pitgrid.operators import panel
from pitgrid.plans import metrics, models, serving
from pitgrid.plans import tables as plans
from pitgrid.sources import feeds
from pitgrid.sources import tables as store
from pitgrid.sources.shared import written

SITREPS = "ciffc_sitreps"


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def has(self, name: str) -> bool:
        return store.exists(self.spark, self.path(name))

    def read(self, name: str) -> DataFrame:
        if not self.has(name):
            raise SystemExit(f"{self.path(name)} is missing: run the command that builds it first")
        return self.spark.read.parquet(self.path(name))

    def maybe(self, name: str) -> DataFrame | None:
        return self.read(name) if self.has(name) else None

    def reports(self) -> DataFrame | None:
        if not self.has(SITREPS):
            print(f"without {SITREPS}: the ciffc_* features are left out (ingest-ciffc builds it)")
        return self.maybe(SITREPS)

    def texts(self, name: str) -> DataFrame:
        """value: each landed file's text."""
        if not self.has(name):
            raise SystemExit(f"{self.path(name)} is missing: land the files there first")
        return self.spark.read.text(self.path(name), wholetext=True)

    def write(self, df: DataFrame, name: str) -> None:
        store.replace(df, self.path(name))


def contract_of(command: str) -> tuple[models.Contract, str, str]:
    ignition = command.endswith("-ignition")
    return (models.IGNITION, "ignition_table", "ignition") if ignition else (models.ESCALATION, "modelling_table", "escalation")


def ingest_fires(at: Folder, a) -> None:
    """Landed revisions -> kept and quarantined rows."""
    rows = clean.without(at.spark.read.parquet(at.path("raw/fires")), "geometry", "FID")
    rows = clean.without_sentinels(rows, [c for c in ("fire_size", "percent_contained") if c in rows.columns])
    rows = rows.where(F.col("fire_year").isin(a.years) | F.col("fire_year").isNull()) if a.years else rows
    kept, rejected = clean.quarantine(rows)
    at.write(kept, "reported_fires")
    at.write(rejected, "quarantined")


def ingest_hotspots(at: Folder, a) -> None:
    rows = feeds.detections(feeds.delimited(at.spark, at.path("raw/hotspots")))
    rows = rows.where(F.year("rep_date").isin(a.years)) if a.years else rows
    if not a.merge and at.has("hotspots"):
        store.remove(at.spark, at.path("hotspots"))
    if dropped := store.replace_seasons(rows, at.path("hotspots"), a.years or None):
        print(f"columns that one side lacks went: {dropped}")


def ingest_fwi(at: Folder, a) -> None:
    if a.daily:
        rows = feeds.station_days(feeds.delimited(at.spark, at.path("raw/fwi_daily")))
        rows = clean.station_days(clean.with_stations(rows, feeds.stations(feeds.delimited(at.spark, at.path("raw/stations")))), [c for c in clean.LIMITS if c in rows.columns])
        store.replace_seasons(rows, at.path("station_fwi"), at="obs_date")
    else:
        store.replace_seasons(feeds.archive(at.spark, at.path("raw/fwi_archive"), a.years), at.path("station_fwi"), a.years, at="obs_date")


def ingest_reports(at: Folder, a) -> None:
    """Landed daily reports (raw/ciffc/days, one JSON text a file) -> one row a date and agency; dates that a landed index (raw/ciffc/index) lacks go."""
    rows = feeds.agency_reports(at.texts("raw/ciffc/days"))
    rows = rows.where(F.year("sitrep_date").isin(a.years)) if a.years else rows
    if at.has("raw/ciffc/index"):
        known = feeds.report_index(at.texts("raw/ciffc/index")).withColumnRenamed("national_preparedness_level", "_level")
        rows = rows.join(known, "sitrep_date").withColumn("national_preparedness_level", F.coalesce("national_preparedness_level", "_level")).drop("_level")
    at.write(feeds.report_history(rows), SITREPS)
    feeds.report_coverage(at.read(SITREPS)).orderBy("year").show()


def read_pages(at: Folder, a) -> None:
    """Landed rendered reports (raw/ciffc_pages, one HTML page a file) -> what each says: level and date, new fires and preparedness of each agency."""
    parsed = written(feeds.pages(at.texts("raw/ciffc_pages").select(F.col("value").alias("html"), F.input_file_name().alias("page"))).drop("html"), "pages")
    at.write(parsed.select("page", "sitrep_date", "preparedness_level"), "ciffc_pages")
    at.write(feeds.new_fires(parsed, ["page", "sitrep_date"]), "ciffc_new_fires")
    at.write(feeds.agency_levels(parsed, ["page", "sitrep_date"]), "ciffc_agency_levels")
    at.read("ciffc_pages").orderBy("sitrep_date", "page").show(a.top, False)
    print(f"{at.read('ciffc_new_fires').count()} agency rows, {at.read('ciffc_agency_levels').count()} APL rows")


def diagnose(at: Folder, a) -> None:
    clean.bitemporal_depth(at.read("reported_fires")).withColumn("thin", F.col("rows_per_fire") < 1.5).orderBy("fire_year").show()


def build(at: Folder, a) -> None:
    at.write(plans.escalation(at.read("reported_fires"), at.read("hotspots"), at.reports()), "modelling_table")


def build_ignition(at: Folder, a) -> None:
    fires, hotspots, observations = at.read("reported_fires"), at.read("hotspots"), at.read("station_fwi")
    days = panel.season_days(at.spark, a.years)
    at.write(plans.ignition(fires, hotspots, observations, days, a.area_years or a.years, a.neg_rate, sitreps=at.reports()), "ignition_table")
    events = panel.ignition_events(fires)
    covered = panel.area_coverage(panel.study_area(events, hotspots, a.area_years or a.years), events, days).first().asDict()
    store.write_json(at.spark, {"years": a.years, "area_years": a.area_years or a.years, "neg_rate": a.neg_rate, "study_area_coverage": covered, "built_at": now()}, at.path("ignition_table_meta.json"))


def now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def told(at: Folder, result, name: str) -> None:
    store.write_json(at.spark, {"result": result, "at": now()}, at.path(f"models/{name}.json"))
    print(json.dumps(result, indent=1, default=str))


def rate_of(at: Folder, contract: models.Contract) -> float | None:
    return store.read_json(at.spark, at.path("ignition_table_meta.json"))["neg_rate"] if contract.sampled else None


def backtest(at: Folder, a) -> None:
    contract, table, name = contract_of(a.command)
    options = {"rate": rate_of(at, contract), "draws": a.bootstrap, "trees": a.trees}
    if a.holdout_agency:
        agencies = None if a.holdout_agency == "ALL" else [a.holdout_agency]
        result, _ = models.agency_backtest(at.read(table), contract, agencies, a.test_years, a.min_positives, a.drop_geography, **options)
        told(at, result, f"{name}_spatial_backtest{'_season' if a.test_years else ''}{'_nogeo' if a.drop_geography else ''}")
    else:
        groups = [g for g, on in (("network", a.drop_network), ("ciffc", a.drop_ciffc)) if on]
        result, _ = models.backtest(at.read(table), contract, a.test_years, drop=tuple(c for g in groups for c in contract.groups.get(g, ())), **options)
        told(at, result, f"{name}_backtest")


def ablate(at: Folder, a) -> None:
    contract, table, name = contract_of(a.command)
    told(at, models.ablation(at.read(table), contract, models.feature_sets(contract), a.test_years, rate_of(at, contract), a.bootstrap, trees=a.trees), f"{name}_ablation")


def compare_geography(at: Folder, a) -> None:
    contract, table, name = contract_of(a.command)
    told(at, models.compare_geography(at.read(table), contract, a.bootstrap, test_years=a.test_years, least_positives=a.min_positives, trees=a.trees), f"{name}_geography")


def fit_final(at: Folder, a) -> None:
    contract, table, name = contract_of(a.command)
    models.save(models.fit_final(at.read(table), contract, rate_of(at, contract), trees=a.trees), at.spark, at.path(f"models/{name}_final"), trained_at=now())


def predict(at: Folder, a) -> None:
    model = models.load(at.spark, at.path("models/escalation_final"))
    at.write(models.score_escalation(model, at.read("reported_fires"), at.read("hotspots"), at.maybe(SITREPS), a.window_days, a.as_of), "current_risk")
    at.read("current_risk").withColumns({"fire": clean.short_id("national_fire_id"), "status": serving.status_label("status_now")}).orderBy(F.desc("risk"), "national_fire_id").show(a.top)


def predict_ignition(at: Folder, a) -> None:
    model = models.load(at.spark, at.path("models/ignition_final"))
    at.write(models.score_ignition(model, at.read("reported_fires"), at.read("hotspots"), at.read("station_fwi"), a.day, a.days, at.maybe(SITREPS)), "ignition_risk")
    serving.by_risk(at.read("ignition_risk"), "cell_x", "cell_y", day="day").show(a.top)


def report(at: Folder, a) -> None:
    """Points of the curves of the held-out season, as tables."""
    contract, table, name = contract_of(a.command)
    _, scored = models.backtest(at.read(table), contract, a.test_years, rate_of(at, contract), 0, trees=a.trees)
    at.write(metrics.reliability_points(scored).orderBy("bucket"), f"report/{name}_reliability")
    at.write(metrics.pr_curve(metrics.score_groups(scored, w="w")), f"report/{name}_pr_curve")


def dashboard(at: Folder, a) -> None:
    serving.readouts(at.read("current_risk")).show()
    if (cells := at.maybe("ignition_risk")) is not None:
        at.write(serving.top_share(cells), "report/ignition_top")


def meta(at: Folder, a) -> None:
    names = ("reported_fires", "hotspots", "station_fwi", SITREPS, "modelling_table", "ignition_table", "current_risk", "ignition_risk")
    print(json.dumps({"artefacts": serving.artefacts(at.spark, {n: at.path(n) for n in names}), "models": serving.models(at.spark, {n: at.path(f"models/{n}_final/model.json") for n in ("escalation", "ignition")})}, indent=1))


COMMANDS = {
    "ingest-fires": ingest_fires, "ingest-hotspots": ingest_hotspots, "ingest-fwi": ingest_fwi, "ingest-ciffc": ingest_reports, "scrape-ciffc": read_pages, "diagnose": diagnose, "build": build, "build-ignition": build_ignition, "backtest": backtest,
    "backtest-ignition": backtest, "ablate": ablate, "ablate-ignition": ablate, "compare-geography": compare_geography, "fit-final": fit_final, "fit-final-ignition": fit_final,
    "predict": predict, "predict-ignition": predict_ignition, "report": report, "dashboard": dashboard, "meta": meta,
}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="pitgrid", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--data", required=True)
    for name in ("years", "area-years", "test-years"):
        p.add_argument(f"--{name}", type=int, nargs="+")
    for name, default in (("neg-rate", 0.03),):
        p.add_argument(f"--{name}", type=float, default=default)
    for name, default in (("bootstrap", 1000), ("min-positives", 10), ("trees", None), ("window-days", 14), ("top", 20), ("days", 1)):
        p.add_argument(f"--{name}", type=int, default=default)
    for name in ("holdout-agency", "as-of", "day"):
        p.add_argument(f"--{name}")
    for name in ("merge", "daily", "drop-geography", "drop-network", "drop-ciffc"):
        p.add_argument(f"--{name}", action="store_true")
    a = p.parse_args(arguments)
    COMMANDS[a.command](Folder(spark or SparkSession.builder.getOrCreate(), a.data), a)


if __name__ == "__main__":
    main()
