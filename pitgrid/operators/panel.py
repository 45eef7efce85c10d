"""Cell-day panels: events, study area, sampled negatives, trailing windows, weather by inverse distance."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.functions import grid
from pitgrid.operators.asof import first_seen
from pitgrid.sources.shared import written

CELL = ["cell_x", "cell_y"]
MONTHS = tuple(range(4, 11))


def season_days(spark: SparkSession, years: list[int], months: tuple[int, ...] = MONTHS) -> DataFrame:
    days = spark.createDataFrame([(y,) for y in years], "y int").select(F.explode(F.expr("sequence(make_date(y, 1, 1), make_date(y, 12, 31))")).alias("day"))
    return days.where(F.month("day").isin(*months)).distinct()


def ignition_events(fires: DataFrame) -> DataFrame:
    """(cell, day) with new incidents: how many, and the alphabetically first agency."""
    seen = grid.with_cells(first_seen(fires)).withColumn("day", F.to_date("t0"))
    return seen.groupBy(*CELL, "day").agg(F.count("*").alias("n_ignitions"), F.min("agency_code").alias("agency_code"))


def agency_vote(events: DataFrame, ignored: tuple[str, ...] = ("PC",)) -> DataFrame:
    """Each cell's agency with most reports, ties in the alphabet's order; federal park reports do not vote."""
    counts = events.where(F.col("agency_code").isNotNull() & ~F.col("agency_code").isin(*ignored)).groupBy(*CELL, "agency_code").agg(F.sum("n_ignitions").alias("_n"))
    return counts.groupBy(*CELL).agg(F.min_by("agency_code", F.struct((-F.col("_n")).alias("n"), "agency_code")).alias("agency_code"))


def cell_agency(cells: DataFrame, events: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """cells with the agency of their reports, else that of the polygon around their centre, else null."""
    out = cells.select(*CELL).distinct().join(agency_vote(events), CELL, "left")
    if edges is None:
        return out
    # as a table: else the centre's formula is written out once more for every use of it
    keyed = grid.with_centres(written(cells.select(*CELL).distinct(), "cells")).withColumn("_cell", F.struct(*CELL))
    at = grid.place(keyed, edges, "_cell").select("_cell.*", F.col("code").alias("_code"))
    return out.join(at, CELL, "left").select(*CELL, F.coalesce("agency_code", "_code").alias("agency_code"))


def study_area(events: DataFrame, hotspots: DataFrame, years: list[int], edges: DataFrame | None = None) -> DataFrame:
    """Cells with an incident or a detection in the years, that have an agency."""
    active = events.where(F.year("day").isin(*years)).select(*CELL).union(grid.with_cells(hotspots.where(F.year("rep_date").isin(*years))).select(*CELL)).distinct()
    return cell_agency(active, events, edges).where("agency_code is not null")


def sampled_negatives(area: DataFrame, days: DataFrame, rate: float, seed: int) -> DataFrame:
    """For every day the same number of cells, round-half-even(rate * cells), the first by a seeded hash.

    Days are few and go along as an array. Only hashes under a bound that a day's sample hardly ever reaches are ranked; days that it leaves short,
    if any, are ranked again over all their cells.
    """
    per_day = int(Decimal(str(rate * area.count())).quantize(Decimal(1), ROUND_HALF_EVEN))
    if per_day < 1:
        raise ValueError("the rate samples no cell")
    all_days = sorted({r.day for r in days.select("day").where("day is not null").distinct().collect()})

    def ranked(chosen: list, bound: str) -> DataFrame:
        drawn = area.select(*CELL, F.explode(F.array(*[F.lit(d) for d in chosen])).alias("day")).withColumn("_h", F.expr(f"md5(concat_ws('|', '{seed}', cell_x, cell_y, day))"))
        rank = F.row_number().over(W.partitionBy("day").orderBy("_h", *CELL))
        return drawn.where(F.col("_h") < bound).withColumn("_r", rank).where(F.col("_r") <= per_day).select(*CELL, "day")

    if not all_days:
        return area.select(*CELL, F.lit(None).cast("date").alias("day")).limit(0)
    share = min(1.0, (per_day + 6 * per_day**0.5 + 20) / max(1, area.count()))
    bound = "g" if share >= 1 else f"{int(share * (1 << 64)):016x}"
    out = written(ranked(all_days, bound), "negatives")
    full = {r.day for r in out.groupBy("day").count().where(F.col("count") == per_day).collect()}
    short = [d for d in all_days if d not in full] if share < 1 else []
    return out.where(~F.col("day").isin(*short)).unionByName(ranked(short, "g")) if short else out


def sample_panel(area: DataFrame, events: DataFrame, days: DataFrame, rate: float, seed: int) -> DataFrame:
    """All positive cell-days of the area, and sampled others: (cell, day, n_ignitions, ignition, agency_code)."""
    known = events.drop("agency_code").join(area.select(*CELL), CELL, "left_semi").join(days, "day", "left_semi").withColumn("ignition", F.lit(1).cast("tinyint"))
    drawn = sampled_negatives(area, days, rate, seed).join(known, [*CELL, "day"], "left_anti").withColumns({"n_ignitions": F.lit(0).cast("long"), "ignition": F.lit(0).cast("tinyint")})
    return known.unionByName(drawn).join(area.select(*CELL, "agency_code"), CELL, "left")


def area_coverage(area: DataFrame, events: DataFrame, days: DataFrame) -> DataFrame:
    """n_reachable ignitions on the days, n_inside the area, and the share."""
    reachable = events.join(days.select("day").distinct(), "day", "left_semi")
    inside = reachable.join(area.select(*CELL).distinct().withColumn("_in", F.lit(1)), CELL, "left")
    sums = inside.agg(F.coalesce(F.sum("n_ignitions"), F.lit(0)).alias("n_reachable"), F.coalesce(F.sum(F.when(F.col("_in") == 1, F.col("n_ignitions"))), F.lit(0)).alias("n_inside"))
    return sums.withColumn("coverage", F.col("n_inside") / F.greatest(F.col("n_reachable"), F.lit(1)))


def days_on_record(days: DataFrame, observations: DataFrame) -> DataFrame:
    """Of days(day) those whose day before can be in the stations' record: after its first day, and up to the one after its last."""
    ends = observations.agg(F.min("obs_date").alias("_a"), F.max("obs_date").alias("_b"))
    return days.crossJoin(F.broadcast(ends)).where("day > _a and day <= date_add(_b, 1)").select("day")


def scoreable_days(observations: DataFrame, day=None, days: int = 1) -> DataFrame:
    """The ``days`` days up to ``day`` (by default the one after the last observation) that can be scored, by date."""
    last = observations.agg(F.date_add(F.max("obs_date"), 1).alias("_last"))
    target = F.col("_last") if day is None else F.lit(day).cast("date")
    return last.select("_last", F.explode(F.sequence(F.date_sub(target, days - 1), target)).alias("day")).where("day <= _last").select("day")


def cell_days(hotspots: DataFrame, measures: tuple[str, ...] = ("fwi", "hfi", "ros")) -> DataFrame:
    return grid.with_cells(hotspots).withColumn("d", F.to_date("rep_date")).groupBy(*CELL, "d").agg(F.count("*").alias("n"), *[F.max(m).alias(m) for m in measures])


def trailing(
    panel: DataFrame, daily: DataFrame, prefix: str, windows: tuple[int, ...], ring_windows: tuple[int, ...], censor: int, measures: tuple[str, ...] = (), ring_measures: tuple[str, ...] | None = None
) -> DataFrame:
    """Counts and maxima of daily(cell, d, n, measures) over the days before each panel day, in its cell and in the eight around.

    A window of w days reads d with day - w <= d < day: the panel's day is never read. Counts without rows are 0, maxima null; days_since is null beyond
    ``censor`` days. ring_measures: those with maxima around the cell too (default: all). Rows without a cell or a day go.

    The daily rows, which are few, are scattered to their neighbours; each cell's days are then swept once in order, so the work grows with the panel
    rows and the daily rows and not with their pairs.
    """
    around = measures if ring_measures is None else ring_measures
    keys = panel.select(*CELL, "day").where("cell_x is not null and cell_y is not null and day is not null").distinct()
    own = daily.where("d is not null").select(*CELL, F.col("d").alias("day"), F.lit(0).alias("kind"), F.col("n").cast("long").alias("n"), *[F.col(m).cast("double").alias(f"m_{m}") for m in measures])
    near = grid.with_ring(own).select(F.col("ring_x").alias("cell_x"), F.col("ring_y").alias("cell_y"), "day", F.lit(1).alias("kind"), "n", *[f"m_{m}" for m in measures])
    asked = keys.select(*CELL, "day", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("n"), *[F.lit(None).cast("double").alias(f"m_{m}") for m in measures])
    rows = own.unionByName(near).unionByName(asked).withColumn("day", F.unix_date("day"))
    out = {c: "int" for c in (*CELL, "day")} | {f"{prefix}_n_{w}d": "long" for w in windows} | {f"{prefix}_{m}_max_{w}d": "double" for w in windows for m in measures} | {f"{prefix}_days_since": "int"}
    out |= {f"{prefix}_ring_n_{w}d": "long" for w in ring_windows} | {f"{prefix}_ring_{m}_max_{w}d": "double" for w in ring_windows for m in around}
    spans = [(0, f"{prefix}_", windows, measures), (1, f"{prefix}_ring_", ring_windows, around)]
    swept = rows.repartition(*CELL).sortWithinPartitions(*CELL, "day").mapInArrow(lambda b: _swept(b, list(out), prefix, spans, censor), ", ".join(f"{c} {t}" for c, t in out.items()))
    return swept.withColumn("day", F.date_from_unix_date("day"))


def _swept(batches: Iterator[pa.RecordBatch], columns: list[str], prefix: str, spans: list[tuple], censor: int) -> Iterator[pa.RecordBatch]:
    """Rows by cell and day -> the panel rows with their windows. Of the cell that a batch ends in, the days that a later batch can still read are carried over."""
    reach = max([censor, *(w for _, _, ws, _ in spans for w in ws)])
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        skip = held.num_rows if held is not None else 0
        column = {c: (table.column(c).fill_null(float("-inf")) if c.startswith("m_") else table.column(c)).to_numpy() for c in table.column_names}
        x, y, day, kind = (column[c].astype(np.int64) for c in (*CELL, "day", "kind"))
        cell = np.cumsum(np.append(0, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        # one number for cell and day: the rows are in its order
        at = cell * (1 << 40) + day
        asked = np.flatnonzero(kind == 2)
        asked = asked[asked >= skip]
        out = {"cell_x": x[asked].astype(np.int32), "cell_y": y[asked].astype(np.int32), "day": day[asked].astype(np.int32)}
        for k, name, windows, measures in spans:
            some = np.flatnonzero(kind == k)
            own, total = at[some], np.append(0, np.cumsum(column["n"][some]))
            before = np.searchsorted(own, at[asked])
            since = {w: np.searchsorted(own, at[asked] - w) for w in windows}
            out |= {f"{name}n_{w}d": total[before] - total[since[w]] for w in windows}
            for m in measures:
                tops = _tops(column[f"m_{m}"][some].astype(np.float64))
                out |= {f"{name}{m}_max_{w}d": pa.array(top := _top(tops, since[w], before), mask=np.isneginf(top)) for w in windows}
            if k == 0:
                last = at[asked] - own[np.maximum(before, 1) - 1] if len(own) else np.zeros(len(asked), np.int64)
                out[f"{prefix}_days_since"] = pa.array(last.astype(np.int32), mask=(before == 0) | (last > censor) | (len(own) == 0))
        yield pa.RecordBatch.from_pydict({c: out[c] for c in columns})
        held = table.filter(pa.array((cell == cell[-1]) & (kind < 2) & (day >= day[-1] - reach)))


def _tops(values: np.ndarray) -> list[np.ndarray]:
    """Maxima of 1, 2, 4, ... values from each place on; what is not a number is the greatest, as in SQL, nulls (-inf) are the least."""
    levels = [values]
    while len(levels[-1]) > 1 << (len(levels) - 1):
        step = 1 << (len(levels) - 1)
        levels.append(np.maximum(levels[-1][:-step], levels[-1][step:]))
    return levels


def _top(levels: list[np.ndarray], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The maxima from begin up to end, by the two levels that cover it; -inf where there is none."""
    out = np.full(len(begin), -np.inf)
    level = np.frexp(np.maximum(end - begin, 1))[1] - 1
    for k in np.unique(level[end > begin]).tolist():
        here = np.flatnonzero((level == k) & (end > begin))
        out[here] = np.maximum(levels[k][begin[here]], levels[k][end[here] - (1 << k)])
    return out


def station_weather(panel: DataFrame, neighbours: DataFrame, observations: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """Inverse-square-distance means of the day before; a null measure leaves out its own station only. wx_n_stations and wx_dist_km ignore nulls of measures."""
    weighted = neighbours.withColumn("_w", F.expr("power(1 / greatest(dist_km, 1D), 2)"))
    asked = panel.select(*CELL, "day").distinct().withColumn("obs_date", F.date_sub("day", 1))
    rows = asked.join(weighted, CELL).join(observations.select("aes", "obs_date", *measures), ["aes", "obs_date"])
    aggs = [F.expr(f"sum({m} * _w) / sum(_w) filter (where {m} is not null)").alias(f"wx_{m}") for m in measures]
    return rows.groupBy(*CELL, "day").agg(*aggs, F.count("*").alias("wx_n_stations"), F.min("dist_km").alias("wx_dist_km"))
