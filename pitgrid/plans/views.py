"""The data model's tables, derived from the driver's by arithmetic that any SQL engine repeats. Each view has a Spark and an SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DAY = {"spark": "datediff(to_date(ts), date'1970-01-01')", "duck": "date_diff('day', date '1970-01-01', cast(ts as date))"}
DIV = {"spark": "div", "duck": "//"}

_REVISIONS = """select concat(cast(user_id as {s}), '_', cast({day} {div} 6 as {s})) as national_fire_id, event_id as id, ts as record_start, case when event_id % 11 = 0 then null else value end as fire_size,
    case event_type when 'view' then 'UC' when 'click' then 'OC' when 'error' then 'BH' when 'signup' then null else 'EX' end as stage_of_control_status,
    48 + (user_id * 37 % 1200) / 100.0e0 as latitude, -125 + (user_id * 53 % 3000) / 100.0e0 as longitude,
    case user_id % 5 when 0 then 'AB' when 1 then 'BC' when 2 then 'ON' when 3 then 'SK' else 'PC' end as agency_code,
    case user_id % 3 when 0 then 'N' when 1 then 'S' else null end as region_code, cast(case when event_id % 97 = 0 then 2020 when event_id % 89 = 0 then null else 2024 end as int) as fire_year
    from events"""
_HOTSPOTS = """select event_id as hid, 48 + (event_id * 7919 % 1000) / 100.0e0 as lat, -125 + (event_id * 104729 % 2000) / 100.0e0 as lon, ts as rep_date, case when event_id % 7 = 0 then null else value end as fwi,
    value * 10 as hfi, value / 3 as ros, case event_id % 6 when 0 then 'C2' when 1 then 'D1' when 2 then 'm3' when 3 then 'O1a' when 4 then 'S1' else null end as fuel from events"""
_OBS = """select cast(s_suppkey as {s}) as aes, 48 + (s_suppkey * 71 % 1000) / 100.0e0 as lat, -125 + (s_suppkey * 131 % 2000) / 100.0e0 as lon, {addday} as obs_date,
    cast((s_suppkey * 13 + k * 7) % 60 - 20 as double) as temp, case when (s_suppkey + k) % 9 = 0 then null else cast((s_suppkey * 17 + k * 3) % 101 as double) end as rh, cast((s_suppkey * 5 + k * 11) % 40 as double) as fwi
    from supplier, {ks}"""
_SITREPS = """select case user_id % 5 when 0 then 'AB' when 1 then 'BC' when 2 then 'ON' when 3 then 'SK' else 'PC' end as agency_code, cast(ts as date) as sitrep_date, ts as published_at,
    value as national_preparedness_level, cast(event_id as double) as agency_preparedness from events where event_type = 'signup'"""
_WEATHER = _OBS.replace(" as fwi\n", """ as fwi, cast((s_suppkey * 3 + k) % 50 as double) as ws, case when (s_suppkey + k) % 4 = 0 then cast((s_suppkey + k * 5) % 30 as double) else 0.0e0 end as precip, cast((s_suppkey * 19 + k) % 101 as double) as ffmc,
    cast((s_suppkey * 7 + k * 2) % 90 as double) as dmc, cast((s_suppkey * 23 + k * 4) % 700 as double) as dc, cast((s_suppkey * 11 + k) % 25 as double) as isi, case when (s_suppkey * k) % 13 = 1 then null else cast((s_suppkey * 29 + k) % 120 as double) end as bui, cast((s_suppkey + k) % 35 as double) as dsr
""")
_REPORTS = _SITREPS.replace("as agency_preparedness from", "as agency_preparedness, " + ", ".join(f"cast(event_id % {n} as double) as {c}" for n, c in ((3, "prep_hazard"), (5, "prep_current_load"), (7, "prep_expected_load"), (11, "prep_resource_levels"), (13, "prep_resource_availability"), (17, "occurrence_pred_lightning"), (19, "occurrence_pred_human"))) + " from")
_SCORED = "select l.doc_id, l.quality as y, least(d.n_chars, 5000) / 5000.0e0 as p, (d.n_chars % 97) / 97.0e0 as p_base, case when l.quality = 1 then 1.0e0 else 20.0e0 end as w from labels l join documents d on l.doc_id = d.doc_id"

TEXTS = {"revisions": _REVISIONS, "hotspots": _HOTSPOTS, "obs": _OBS, "sitreps": _SITREPS, "weather": _WEATHER, "reports": _REPORTS, "scored": _SCORED}


def sql(name: str, engine: str = "duck") -> str:
    spark = engine == "spark"
    return TEXTS[name].format(
        s="string" if spark else "varchar",
        day=DAY[engine],
        div=DIV[engine],
        addday="date_add(date'2024-01-01', cast(k as int))" if spark else "cast(date '2024-01-01' + cast(k as int) as date)",
        ks="(select explode(sequence(0, 29)) as k)" if spark else "(select unnest(range(0, 30)) as k)",
    )


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "supplier", "labels", "documents") if t in TEXTS[name]}
    text = sql(name, "spark")
    for t in tables:
        text = text.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return spark.sql(text, **tables)
