"""The two modelling tables: escalation of incidents, ignition of cell-days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.functions import clean, grid
from pitgrid.operators import asof, panel, spatial
from pitgrid.sources.shared import removed, written

ESCALATED_HA, DECISION_H, HORIZON_H, RADIUS_KM = 100.0, 24, 72, 10.0


def escalation_features(known: DataFrame, hotspots: DataFrame, sitreps: DataFrame | None = None, decision_hours: float = DECISION_H) -> DataFrame:
    """One row an incident of asof.at_instants() with a state at its ``decision``; only what was visible then is read. Counts are 0 without rows, measures null."""
    state = {f.name for f in known.schema["decision"].dataType.fields}
    offsets = [c for c in known.columns if c not in ("decision", "horizon", "size_now", "status_now")]
    names = {"fire_size": "size_at_decision", "stage_of_control_status": "status_at_decision", "n_by": "n_revisions_by_decision", "size_first": "size_first", "size_max": "size_max_so_far", "n_status": "n_distinct_status"}
    taken = [F.col(f"decision.{c}").alias(names.get(c, c)) for c in (*names, "response_type", "national_fire_cause") if c in state]
    out = known.where("decision is not null").select(*offsets, *taken)
    out = out.join(spatial.hotspot_features(out, hotspots, RADIUS_KM, decision_hours), "national_fire_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("hs_count", "hs_active_days")})
    out = out.withColumns(
        {
            "month": F.month("t0"), "doy": F.dayofyear("t0"), "t0_hour": F.hour("t0"), "decision_at": asof.hours_after("t0", decision_hours),
            "size_growth_to_decision": F.expr("coalesce(size_at_decision, 0) - coalesce(size_first, 0)"), "log_size_at_decision": F.expr("log1p(coalesce(size_at_decision, 0))"),
        }
    )
    return asof.preparedness(out, sitreps) if sitreps is not None else out


def escalation(revisions: DataFrame, hotspots: DataFrame, sitreps: DataFrame | None = None, cutoff=None) -> DataFrame:
    """Features and labels of incidents whose horizon is on record and that were not yet escalated at the decision. The revisions are read once, into a timeline."""
    known = written(asof.timeline(revisions), "timeline")
    end = F.lit(cutoff if cutoff is not None else known.agg(F.max("valid_from")).first()[0]).cast("timestamp_ntz")
    at = written(asof.at_instants(known, {"decision": DECISION_H, "horizon": HORIZON_H}).where(asof.hours_after("t0", HORIZON_H) <= end), "instants")
    removed(known)
    label = at.where("horizon is not null").select("national_fire_id", F.col("horizon.fire_size").alias("size_at_horizon"), F.col("horizon.stage_of_control_status").alias("status_at_horizon"))
    out = escalation_features(at, hotspots, sitreps).join(label, "national_fire_id")
    out = out.where(f"size_at_horizon is not null and coalesce(size_at_decision, 0) < {ESCALATED_HA}")
    return out.withColumns({"escalated": (F.col("size_at_horizon") >= ESCALATED_HA).cast("tinyint"), "still_out_of_control": (F.coalesce("status_at_horizon", F.lit("")) == "OC").cast("tinyint")})


def ignition_features(cells: DataFrame, events: DataFrame, hotspots: DataFrame, observations: DataFrame, sitreps: DataFrame | None = None, measures: tuple[str, ...] | None = None) -> DataFrame:
    """cells(cell_x, cell_y, day, agency_code, ...) with everything known before the day. measures: by default all that the observations have."""
    key = [*panel.CELL, "day"]
    measures = measures if measures is not None else tuple(m for m in clean.LIMITS if m in observations.columns)
    daily = events.select(*panel.CELL, F.col("day").alias("d"), F.col("n_ignitions").alias("n"))
    near = grid.nearest(cells, observations.select("aes", "lat", "lon").groupBy("aes").agg(F.min_by("lat", F.struct("lat", "lon")).alias("lat"), F.min_by("lon", F.struct("lat", "lon")).alias("lon")), 12, 300.0)
    out = cells.join(panel.trailing(cells, panel.cell_days(hotspots), "hs", (1, 3, 7), (1, 3, 7), 60, ("fwi", "hfi", "ros"), ("hfi",)), key)
    out = out.join(panel.trailing(cells, daily, "ig", (7, 30, 365), (7, 365), 365), key)
    out = out.join(panel.station_weather(cells, near, observations, measures), key, "left")
    out = out.withColumn("wx_n_stations", F.coalesce("wx_n_stations", F.lit(0).cast("long")))
    out = grid.with_centres(out).withColumns({"doy": F.dayofyear("day"), "month": F.month("day"), "fire_year": F.year("day"), "decision_at": F.col("day").cast("timestamp_ntz")})
    if sitreps is None:
        return out
    # agencies and days are few: each pair is looked up once
    told = asof.preparedness(out.select(F.col("agency_code").alias("_agency"), F.col("decision_at").alias("_at")).distinct().selectExpr("_agency as agency_code", "_at as decision_at"), sitreps)
    told = told.withColumnsRenamed({"agency_code": "_agency", "decision_at": "_at"})
    return out.join(told, F.col("agency_code").eqNullSafe(F.col("_agency")) & (F.col("decision_at") == F.col("_at"))).drop("_agency", "_at")


def ignition(fires: DataFrame, hotspots: DataFrame, observations: DataFrame, days: DataFrame, years: list[int], rate: float = 0.03, seed: int = 17, sitreps: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """The case-control panel with features; days are cut to those whose day before can be in the stations' record."""
    events = panel.ignition_events(fires)
    area = panel.study_area(events, hotspots, years, edges)
    return ignition_features(panel.sample_panel(area, events, panel.days_on_record(days, observations), rate, seed), events, hotspots, observations, sitreps)
