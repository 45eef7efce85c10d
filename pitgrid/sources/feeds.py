"""Landed feed files as DataFrames: delimited files, archives, JSON reports, rendered pages, hourly weather, outlines.

Files are fetched by other means into a folder that Spark reads; nothing here opens a connection.
"""

from __future__ import annotations

import csv
import functools
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import date, timedelta
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgrid.functions import clean

# The columns, fields and names that the feeds use.
DETECTION_NUMBERS = ("lat", "lon", "fwi", "ros", "sfc", "tfc", "hfi", "estarea")
DETECTION_TEXTS = ("rep_date", "source", "sensor", "fuel")
AGENCY_FIELDS = {
    "field_preparedness": "agency_preparedness",
    "field_prep_hazard": "prep_hazard",
    "field_prep_current_load": "prep_current_load",
    "field_prep_expected_load": "prep_expected_load",
    "field_prep_resource_levels": "prep_resource_levels",
    "field_prep_resource_availability": "prep_resource_availability",
    "field_occurrence_prediction_lightning": "occurrence_pred_lightning",
    "field_occurrence_prediction_human": "occurrence_pred_human",
}
AGENCIES = {
    "British Columbia": "BC", "Yukon": "YT", "Alberta": "AB", "Northwest Territories": "NT", "Saskatchewan": "SK", "Manitoba": "MB", "Ontario": "ON", "Quebec": "QC",
    "Newfoundland and Labrador": "NL", "New Brunswick": "NB", "Nova Scotia": "NS", "Prince Edward Island": "PE", "Parks Canada": "PC",
}
HOURLY = ("temperature_2m", "relative_humidity_2m", "wind_speed_10m", "wind_gusts_10m", "precipitation", "vapour_pressure_deficit")


def delimited(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All columns as text; header names are trimmed and lower-cased. The files share one header."""
    raw = spark.read.csv(paths, header=True, mode="PERMISSIVE")
    return raw.toDF(*[c.strip().lower() for c in raw.columns])


def detections(raw: DataFrame) -> DataFrame:
    """Text columns of a detection file -> the known ones, typed; a bad number or instant is null, other columns go."""
    known = [c for c in (*DETECTION_NUMBERS, *DETECTION_TEXTS) if c in raw.columns]
    typed = {c: clean.number(c) for c in known if c in DETECTION_NUMBERS}
    if "rep_date" in known:
        typed["rep_date"] = clean.timestamp(F.trim("rep_date"))
    return raw.select(known).withColumns(typed)


def _members(batches: Iterator[pa.RecordBatch], wanted: str) -> Iterator[pa.RecordBatch]:
    """Archives -> their .csv members whose names match, still compressed: what is not asked for is neither unpacked nor passed on."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            raw = content.as_buffer()
            with zipfile.ZipFile(pa.BufferReader(raw)) as archive:
                for m in sorted(archive.infolist(), key=lambda m: m.filename):
                    if m.filename.lower().endswith(".csv") and re.search(wanted, m.filename):
                        head = raw[m.header_offset : m.header_offset + 30].to_pybytes()
                        begin = m.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
                        yield pa.RecordBatch.from_pydict({"path": [path], "member": [m.filename], "kind": pa.array([m.compress_type], pa.int32()), "packed": [raw[begin : begin + m.compress_size].to_pybytes()], "crc": pa.array([m.CRC], pa.int64())})


class _Inflated(io.RawIOBase):
    """The bytes of a member, unpacked as they are read."""

    def __init__(self, packed: pa.Buffer, kind: int):
        self.source, self.unpack, self.left, self.crc = pa.BufferReader(packed), zlib.decompressobj(-15) if kind == zipfile.ZIP_DEFLATED else None, b"", 0

    def readable(self) -> bool:
        return True

    def readinto(self, room) -> int:
        while not self.left:
            piece = self.source.read(1 << 16)
            self.left = self.unpack.decompress(piece) if self.unpack and piece else piece
            if not piece:
                self.left = self.unpack.flush() if self.unpack else b""
                break
        out, self.left = self.left[: len(room)], self.left[len(room) :]
        room[: len(out)] = out
        self.crc = zlib.crc32(out, self.crc)
        return len(out)


def _unpacked(batches: Iterator[pa.RecordBatch], columns: list[str], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, pa.string()) for c in columns])
    for batch in batches:
        for k in range(batch.num_rows):
            member, kind, crc = (batch.column(c)[k].as_py() for c in ("member", "kind", "crc"))
            if kind not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ValueError(f"{member} is packed by method {kind}, which is not read")
            source = _Inflated(batch.column("packed")[k].as_buffer(), kind)
            with io.TextIOWrapper(io.BufferedReader(source, 1 << 16), "utf-8", "replace", newline="") as lines:
                reader = csv.reader(lines)
                at = {h.strip().lower(): i for i, h in enumerate(next(reader, []))}
                held: list[list[str | None]] = []
                for row in reader:
                    held.append([row[at[c]] or None if c in at and at[c] < len(row) else None for c in columns])
                    if len(held) == rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=schema)
                if source.crc != crc:
                    raise ValueError(f"{member} is damaged: its bytes have another CRC-32")


def members(spark: SparkSession, paths: str | list[str], wanted: str = "") -> DataFrame:
    """path, member, kind, packed, crc: the .csv members of zip files whose names match the pattern. An archive, of 2 GB at most, is read by one task, which unpacks nothing."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(lambda b: _members(b, wanted), "path string, member string, kind int, packed binary, crc long")


def zipped(spark: SparkSession, paths: str | list[str], columns: list[str], wanted: str = "") -> DataFrame:
    """The named columns, as text, of the .csv members of zip files whose names match ``wanted``; a column that a member lacks is null. Members are unpacked and parsed by different tasks."""
    # a number of tasks is named, else small packed members would be put together
    dealt = members(spark, paths, wanted).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "member")
    return dealt.mapInArrow(lambda b: _unpacked(b, columns), ", ".join(f"`{c}` string" for c in columns))


def station_days(raw: DataFrame) -> DataFrame:
    """Daily station files: ``repdate`` as YYYYMMDD. Repeated header lines have no such date and go; measures outside their limits are null."""
    measures = [c for c in clean.LIMITS if c in raw.columns]
    if not {"aes", "repdate"} <= set(raw.columns):
        raise ValueError("a daily station file has the columns aes and repdate")
    out = raw.select(F.trim("aes").alias("aes"), F.expr("cast(try_to_timestamp(trim(repdate), 'yyyyMMdd') as date)").alias("obs_date"), *[clean.number(c).alias(c) for c in measures])
    return clean.in_limits(out.where("obs_date is not null"))


def archive(spark: SparkSession, paths: str | list[str], years: list[int], season_only: bool = True) -> DataFrame:
    """Station observations of the years (and of the season's months only) from decadal files: one row a station and day, measures in their limits.

    Only the known columns are parsed, and the months asked for are tested on the text of the date, in the scan.
    """
    raw = delimited(spark, paths)
    wanted = ["aes", "rep_date", "lat", "lon", "elev", *clean.LIMITS]
    if lacking := [c for c in wanted if c not in raw.columns]:
        raise ValueError(f"the archive lacks {lacking}")
    months = clean.SEASON_MONTHS if season_only else range(1, 13)
    asked = functools.reduce(lambda a, b: a | b, [F.col("rep_date").startswith(f"{y}-{m:02d}") for y in years for m in months], F.lit(False))
    rows = raw.select(wanted).where(asked).withColumns({c: clean.number(c) for c in wanted[2:]} | {"aes": F.trim("aes"), "obs_date": F.to_date(clean.timestamp(F.trim("rep_date")))})
    rows = clean.in_limits(rows.where("obs_date is not null and lat is not null and lon is not null"))
    return clean.station_days(rows, list(clean.LIMITS), ("lat", "lon", "elev"))


def stations(raw: DataFrame) -> DataFrame:
    """aes, lat, lon, prov: one row a station, the first in (lat, lon, prov) order; those without coordinates go."""
    rows = raw.select(F.trim("aes").alias("aes"), clean.number("lat").alias("lat"), clean.number("lon").alias("lon"), (F.trim("prov") if "prov" in raw.columns else F.lit(None).cast("string")).alias("prov"))
    first = rows.where("aes <> '' and lat is not null and lon is not null").groupBy("aes").agg(F.min(F.struct("lat", "lon", "prov")).alias("_s"))
    return first.select("aes", "_s.*")


def utc(c: str) -> Column:
    """ISO text as an instant without zone, in UTC; text without a zone is taken to be UTC."""
    return F.expr(f"if({c} rlike '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$', cast(to_utc_timestamp(try_cast({c} as timestamp), current_timezone()) as timestamp_ntz), try_cast({c} as timestamp_ntz))")


def report_index(texts: DataFrame) -> DataFrame:
    """value: a JSON map year -> month -> day -> {data} -> (sitrep_date, national_preparedness_level), one row a date, the highest level."""
    shape = "map<string, map<string, map<string, struct<data: struct<field_date: string, field_preparedness_level: string>>>>>"
    days = texts.select(F.explode(F.from_json("value", shape)).alias("_y", "_m")).select(F.explode("_m").alias("_k", "_d")).select(F.explode("_d").alias("_n", "r")).select("r.data.*")
    out = days.selectExpr("try_cast(left(field_date, 10) as date) as sitrep_date", "try_cast(field_preparedness_level as double) as national_preparedness_level")
    return out.where("sitrep_date is not null").groupBy("sitrep_date").agg(F.max("national_preparedness_level").alias("national_preparedness_level"))


def agency_reports(texts: DataFrame) -> DataFrame:
    """value: one day's JSON report -> one row an agency; published when the agency says, else when the nation does; without either the row goes."""
    fields = ", ".join(f"{f}: string" for f in AGENCY_FIELDS)
    shape = f"field_date string, system_edit_timestamp string, field_preparedness_level string, agencies_sitereps map<string, struct<sitrep: struct<system_edit_timestamp: string, {fields}>>>"
    days = texts.select(F.from_json("value", shape).alias("r")).select("r.*")
    rows = days.select("field_date", "field_preparedness_level", F.col("system_edit_timestamp").alias("_nation"), F.explode("agencies_sitereps").alias("_code", "_a"))
    rows = rows.select("*", F.col("_a.sitrep.system_edit_timestamp").alias("_own")).select(
        F.expr("try_cast(left(field_date, 10) as date)").alias("sitrep_date"),
        F.upper("_code").alias("agency_code"),
        F.coalesce(utc("_own"), utc("_nation")).alias("published_at"),
        utc("_nation").alias("national_published_at"),
        F.expr("try_cast(field_preparedness_level as double)").alias("national_preparedness_level"),
        *[F.expr(f"try_cast(_a.sitrep.{source} as double)").alias(name) for source, name in AGENCY_FIELDS.items()],
    )
    return rows.where("sitrep_date is not null and published_at is not null")


def report_history(reports: DataFrame) -> DataFrame:
    """One row a date and agency: the one published last."""
    others = [c for c in reports.columns if c not in ("sitrep_date", "agency_code")]
    last = reports.groupBy("sitrep_date", "agency_code").agg(F.max(F.struct("published_at", *[c for c in others if c != "published_at"])).alias("_r"))
    return last.select("sitrep_date", "agency_code", *[F.col(f"_r.{c}").alias(c) for c in others])


def report_coverage(reports: DataFrame) -> DataFrame:
    level = "national_preparedness_level"
    return reports.groupBy(F.year("sitrep_date").alias("year")).agg(
        F.count_distinct("sitrep_date").alias("n_days"), F.count("*").alias("n_rows"), F.round(F.avg(level), 2).alias("mean_national_pl"),
        F.max(level).alias("max_national_pl"), F.round(F.avg("agency_preparedness"), 2).alias("mean_agency_pl"),
    )


class _Page(HTMLParser):
    """Text of a page, and its tables as rows of cells."""

    def __init__(self) -> None:
        super().__init__()
        self.text: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def end_cell(self) -> None:
        if self.cell is not None and self.open and self.open[-1]:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
        self.cell = None

    def handle_starttag(self, tag, attrs):
        if tag in ("table", "tr", "td", "th"):
            self.end_cell()
        if tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open and self.open[-1]:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("table", "tr", "td", "th"):
            self.end_cell()
        if tag == "table" and self.open:
            rows = [r for r in self.open.pop() if any(r)]
            if len(rows) > 1:
                self.tables.append(rows)

    def handle_data(self, data):
        self.text.append(data)
        if self.cell is not None:
            self.cell.append(data)


def _parsed(html: pd.Series) -> pd.DataFrame:
    out = []
    for source in html:
        page = _Page()
        page.feed(source or "")
        page.close()
        out.append(("\n".join(page.text), page.tables))
    return pd.DataFrame(out, columns=["text", "tables"])


def pages(rendered: DataFrame, html: str = "html") -> DataFrame:
    """Adds preparedness_level, sitrep_date and tables (rows of cells; tables of one row go) to rendered reports."""
    parse = F.pandas_udf(_parsed, "text string, tables array<array<array<string>>>")
    parsed = rendered.withColumn("_p", parse(F.col(html)))
    level = F.expr(r"try_cast(nullif(regexp_extract(_p.text, '(?i)National Preparedness Level:\\s*([1-5])', 1), '') as int)")
    day = F.expr(r"cast(try_to_timestamp(nullif(regexp_extract(_p.text, 'For:\\s*([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})', 1), ''), 'MMMM d, yyyy') as date)")
    return parsed.withColumns({"preparedness_level": level, "sitrep_date": day, "tables": F.col("_p.tables")}).drop("_p")


def _table_rows(parsed: DataFrame, keys: list[str], fits: str) -> DataFrame:
    """keys, header (lower case), row: of the first table whose header fits; the totals' row goes."""
    heads = F.expr(f"filter(transform(tables, t -> struct(transform(t[0], h -> lower(h)) as header, slice(t, 2, size(t) - 1) as body)), t -> {fits})")
    first = parsed.select(*keys, heads.alias("_t")).select(*keys, F.expr("get(_t, 0)").alias("_f"))
    return first.select(*keys, F.col("_f.header").alias("header"), F.explode("_f.body").alias("row")).where("lower(trim(row[0])) <> 'total'")


def _cell(at: str) -> str:
    return f"try_cast(replace(trim(get(row, cast({at} as int))), ',', '') as double)"


def _agency() -> Column:
    names = F.create_map(*[F.lit(x) for pair in AGENCIES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.trim(F.expr("row[0]"))), F.trim(F.expr("row[0]"))).alias("agency_code")


def new_fires(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, agency_code, natural, human, total) of the first table that has natural and human among its headers."""
    rows = _table_rows(parsed, keys, "array_contains(t.header, 'natural') and array_contains(t.header, 'human')")
    return rows.select(*keys, _agency(), *[F.expr(_cell(f"array_position(header, '{c}') - 1")).alias(c) if c != "total" else F.expr(f"if(array_contains(header, 'total'), {_cell("array_position(header, 'total') - 1")}, null)").alias(c) for c in ("natural", "human", "total")])


def agency_levels(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, agency_code, agency_preparedness) of the first table headed Agency, APL."""
    rows = _table_rows(parsed, keys, "slice(t.header, 1, 2) = array('agency', 'apl')").where("size(row) >= 2")
    return rows.select(*keys, _agency(), F.expr(_cell("1")).alias("agency_preparedness"))


def area_detections(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Area files with acq_date and acq_time (hours and minutes, without leading zeros): adds acq_datetime. An error text in place of a header is refused."""
    raw = delimited(spark, paths)
    head = " ".join(raw.columns)
    if not raw.columns or "invalid" in head or "error" in head:
        raise ValueError(f"not an area file: {head[:200]!r}")
    return raw.withColumn("acq_datetime", F.expr("cast(try_to_timestamp(concat(trim(acq_date), ' ', lpad(trim(acq_time), 4, '0')), 'yyyy-MM-dd HHmm') as timestamp_ntz)"))


def spans(first: date, last: date, longest: int = 5) -> list[tuple[date, int]]:
    """(start, days) of consecutive requests that cover first to last, each of at most ``longest`` days."""
    return [(first + timedelta(n), min(longest, (last - first).days + 1 - n)) for n in range(0, (last - first).days + 1, longest)]


def hourly(texts: DataFrame) -> DataFrame:
    """value: JSON with arrays under ``hourly`` -> one row an hour, with grid_lat and grid_lon (the request's cell of a tenth of a degree)."""
    shape = "latitude double, longitude double, hourly struct<time: array<string>, " + ", ".join(f"{c}: array<double>" for c in HOURLY) + ">"
    rows = texts.select(F.from_json("value", shape).alias("r")).selectExpr("round(r.latitude, 1) as grid_lat", "round(r.longitude, 1) as grid_lon", "r.hourly.*")
    rows = rows.where("time is not null").withColumns({c: F.coalesce(c, F.expr("cast(array() as array<double>)")) for c in HOURLY})
    rows = rows.select("grid_lat", "grid_lon", F.explode(F.arrays_zip("time", *HOURLY)).alias("h")).select("grid_lat", "grid_lon", "h.*")
    return rows.withColumn("time", F.expr("cast(try_to_timestamp(time, \"yyyy-MM-dd'T'HH:mm\") as timestamp_ntz)"))


def weather_summary(rows: DataFrame, keys: list[str], prefix: str = "wx") -> DataFrame:
    """Per key: extremes, means and sums of the hourly measures that there are, and the hours with humidity under 30 and wind over 15."""
    wanted = [("temp_max", "max", HOURLY[0]), ("temp_mean", "avg", HOURLY[0]), ("rh_min", "min", HOURLY[1]), ("rh_mean", "avg", HOURLY[1]), ("wind_max", "max", HOURLY[2]), ("wind_mean", "avg", HOURLY[2]), ("gust_max", "max", HOURLY[3]), ("precip_sum", "sum", HOURLY[4]), ("vpd_max", "max", HOURLY[5])]
    aggs = [(F.expr(f"{how}({c})") if c in rows.columns else F.lit(None).cast("double")).alias(f"{prefix}_{name}") for name, how, c in wanted]
    if {HOURLY[1], HOURLY[2]} <= set(rows.columns):
        aggs.append(F.count_if((F.col(HOURLY[1]) < 30) & (F.col(HOURLY[2]) > 15)).cast("double").alias(f"{prefix}_crossover_hours"))
    return rows.groupBy(*keys).agg(*aggs)


def fire_weather(offsets: DataFrame, rows: DataFrame, decision_hours: float = 24) -> DataFrame:
    """Each incident's weather from the day of t0 to the day of its decision, from its cell of a tenth of a degree."""
    at = offsets.where("lat is not null and lon is not null").selectExpr("national_fire_id", "round(lat, 1) as grid_lat", "round(lon, 1) as grid_lon", "to_date(t0) as _from", f"to_date(t0 + make_dt_interval(0, 0, 0, {decision_hours} * 3600)) as _to")
    return weather_summary(at.join(rows, ["grid_lat", "grid_lon"]).where("to_date(time) between _from and _to"), ["national_fire_id"])


def outlines(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file [{p: code, r: [[[lon, lat], ...], ...]}] -> (code, ring, points) for ``grid.polygon_edges``; ring numbers keep the file's order."""
    raw = spark.read.schema("p string, r array<array<array<double>>>").json(path, multiLine=True).withColumn("_i", F.monotonically_increasing_id())
    rings = raw.select(F.col("p").alias("code"), "_i", F.posexplode("r").alias("_k", "_r"))
    return rings.select("code", (F.col("_i") * (1 << 20) + F.col("_k")).alias("ring"), F.expr("transform(_r, p -> struct(p[0] as lon, p[1] as lat))").alias("points")).where("size(points) >= 3")
