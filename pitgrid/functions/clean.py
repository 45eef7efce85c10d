"""Cleaning of feeds: timestamps, sentinels, limits, quarantine, non-fuel, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Inclusive physical limits of station measures.
LIMITS = {"temp": (-60, 50), "rh": (0, 100), "ws": (0, 200), "precip": (0, 500), "ffmc": (0, 101), "dmc": (0, 1000), "dc": (0, 2000), "isi": (0, 200), "bui": (0, 1000), "fwi": (0, 200), "dsr": (0, 1000)}
NON_FUEL = ("water", "urban", "unknown", "non-fuel", "vegetated non-fuel")
SEASON_MONTHS = tuple(range(4, 11))


def timestamp(c: str) -> Column:
    """``YYYY-MM-DDThh:mm:ss[.f]`` or with a space, as a timestamp without zone; anything else is null."""
    return F.try_to_timestamp(F.regexp_replace(c, "^([^T]*)T", "$1 ")).cast("timestamp_ntz")


def without_sentinels(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in columns})


def in_limits(df: DataFrame, limits: dict[str, tuple[float, float]] = LIMITS) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).between(*limits[c]), F.col(c)) for c in limits if c in df.columns})


def without(df: DataFrame, *columns: str) -> DataFrame:
    """df without those of the columns that it has."""
    return df.drop(*columns)


def in_season(df: DataFrame, at: str, years: list[int] | None = None, months: tuple[int, ...] = SEASON_MONTHS) -> DataFrame:
    """Rows of the years (None: all) and months. On a table that is partitioned by year the first test prunes partitions."""
    df = df.where(F.year(at).isin(*years)) if years is not None else df
    return df.where(F.month(at).isin(*months))


def zero_if_missing(df: DataFrame, column: str) -> Column:
    """A baseline score: null, NaN and an absent column count as 0."""
    return F.expr(f"coalesce(nanvl(cast(`{column}` as double), 0D), 0D)") if column in df.columns else F.lit(0.0)


def short_id(c: str) -> Column:
    """What follows the second underscore of an incident's id; the whole id if it has fewer, empty if it is null."""
    return F.expr(f"if(length({c}) - length(replace({c}, '_', '')) >= 2, substring({c}, length(substring_index({c}, '_', 2)) + 2), coalesce({c}, ''))")


def age_hours(since: str, as_of) -> Column:
    """Whole hours that have passed."""
    return F.timestamp_diff("HOUR", F.col(since), as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz"))


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text a row: dates in ISO form, NaN as null, null fields kept."""
    plain = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("json"))


def with_stations(observations: DataFrame, stations: DataFrame) -> DataFrame:
    """Daily observations with their station's place; those of unknown stations go."""
    return observations.join(stations.select("aes", "lat", "lon"), "aes")


def with_provinces(observations: DataFrame, stations: DataFrame) -> DataFrame:
    """Archive observations with their station's province, null where the station is unknown."""
    return observations.join(stations.select("aes", "prov"), "aes", "left")


def number(c: str) -> Column:
    return F.expr(f"try_cast(trim({c}) as double)")


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) by whether record_start lies within a year of fire_year; nulls are kept, and all rows where a column is missing."""
    if not {"record_start", "fire_year"} <= set(df.columns):
        return df, df.limit(0)
    fits = F.expr("record_start is null or fire_year is null or to_date(record_start) between make_date(cast(fire_year as int) - 1, 1, 1) and make_date(cast(fire_year as int) + 1, 12, 31)")
    return df.where(fits), df.where(~fits)


def burnable(df: DataFrame, fuel: str = "fuel") -> DataFrame:
    return df.where(F.col(fuel).isNull() | ~F.lower(fuel).isin(*NON_FUEL))


def bitemporal_depth(revisions: DataFrame) -> DataFrame:
    out = revisions.groupBy("fire_year").agg(F.count("*").alias("n_rows"), F.count_distinct("national_fire_id").alias("n_fires"), F.min("record_start").alias("first_record"), F.max("record_start").alias("last_record"))
    return out.withColumn("rows_per_fire", F.round(F.col("n_rows") / F.col("n_fires"), 2))


def coverage(observations: DataFrame, measure: str = "fwi") -> DataFrame:
    share = F.expr(f"count({measure}) / count(*)")
    return observations.groupBy(F.year("obs_date").alias("year")).agg(F.count("*").alias("n_rows"), F.count_distinct("obs_date").alias("n_days"), F.count_distinct("aes").alias("n_stations"), F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"), share.alias("share_known"), F.avg(measure).alias("mean"))


def station_days(observations: DataFrame, measures: list[str], place: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """One row a station and day: means of the measures, the place of the first row in the order of its columns."""
    rows = observations.groupBy("aes", "obs_date").agg(*[F.avg(m).alias(m) for m in measures], F.min(F.struct(*place)).alias("_place"))
    return rows.select("aes", "obs_date", *measures, "_place.*")
