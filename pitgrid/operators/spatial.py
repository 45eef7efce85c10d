"""Detections around incidents: a binned spatio-temporal range join, and its order-independent aggregates without the pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgrid.operators.panel import _top, _tops
from pitgrid.sources.shared import written

RADIUS_KM, KM_PER_DEGREE = 6371.0, 111.32
MEASURES = ("fwi", "hfi", "ros", "sfc", "tfc")
#: Degrees and days of a bin; incidents are copied to the few bins that their window touches, detections stay single. A bin of more than MOST detections is split
#: into four, up to LEVELS times.
BIN, MOST, LEVELS = (0.2, 0.4, 1), 4000, 6
#: Sums over detections have wide bins instead, of which an incident's window touches few: so many radii high, one degree at least, and so many days long. A task holds
#: HELD detections and PAIRS pairs of incidents and places at once.
TILE, TILE_DAYS, HELD, PAIRS = 4, 4, 200_000, 1 << 19
PARTS = ["_bt", "_l", "_y", "_x", "_s"]
FUELS = ("conifer", "deciduous", "mixed", "open", "other", "slash")
#: Days in a word of the days that have detections.
WORD = 60


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    h = f"power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)"
    return F.expr(f"{RADIUS_KM}D * 2 * asin(sqrt({h}))")


def within(fires: DataFrame, points: DataFrame, radius_km: float, before_hours: float = 24, after_hours: float = 24, most: int = MOST) -> DataFrame:
    """Pairs (fire columns, point columns as p_*, dist_km) in the radius and time window, all bounds inclusive.

    fires(national_fire_id, t0, lat, lon), points(lat, lon, rep_date, ...); rows without a place or time match nothing. An equi-join on bins of latitude,
    longitude and day replaces the inequality join; bounding box, time and distance are then tested exactly. Bins follow the detections' counts: dense ones are
    split, day by day, and incidents look up the parts that their box touches.
    """
    f, own, _ = placed(fires, points, radius_km, before_hours, after_hours, most, BIN)
    near = f.join(own, ["_bt", "_l", "_y", "_x"]).where("p_rep_date between _from and _to and p_lat between lat - _dlat and lat + _dlat and p_lon between lon - _dlon and lon + _dlon")
    near = near.withColumn("dist_km", haversine_km("lat", "lon", "p_lat", "p_lon")).where(F.col("dist_km") <= radius_km)
    return near.drop("_bt", "_l", "_y", "_x", "_y0", "_y1", "_x0", "_x1", "_py", "_px", "_dlat", "_dlon", "_from", "_to")


def placed(fires: DataFrame, points: DataFrame, radius_km: float, before_hours: float, after_hours: float, most: int, bin_: tuple[float, float, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fires, copied to the bins that their window touches; points, as p_*, each in its bin; dense_bins of them). bin_: degrees and days."""
    north, east, days = bin_[0] / (1 << LEVELS), bin_[1] / (1 << LEVELS), bin_[2]
    f = fires.where("lat is not null and lon is not null and t0 is not null")
    f = f.withColumns({"_dlat": F.lit(radius_km / KM_PER_DEGREE), "_dlon": F.expr(f"{radius_km}D / ({KM_PER_DEGREE}D * greatest(cos(radians(lat)), 0.01D))")})
    f = f.withColumns({"_from": F.col("t0") - F.expr(f"make_dt_interval(0, 0, 0, {before_hours * 3600.0})"), "_to": F.col("t0") + F.expr(f"make_dt_interval(0, 0, 0, {after_hours * 3600.0})")})
    # the box in the smallest bins; a wider bin's number is theirs without the last bits
    f = f.withColumns({"_y0": F.floor((F.col("lat") - F.col("_dlat")) / north), "_y1": F.floor((F.col("lat") + F.col("_dlat")) / north), "_x0": F.floor((F.col("lon") - F.col("_dlon")) / east), "_x1": F.floor((F.col("lon") + F.col("_dlon")) / east)})
    for c, low, high in (("_y", "_y0", "_y1"), ("_x", "_x0", "_x1")):
        f = f.withColumn(c, F.explode(F.sequence(F.shiftright(low, LEVELS), F.shiftright(high, LEVELS))))
    f = f.withColumn("_bt", F.explode(F.sequence(*[F.floor(F.unix_date(F.to_date(c)) / days) for c in ("_from", "_to")]))).withColumn("_l", F.lit(0))
    p = points.select(*[F.col(c).alias(f"p_{c}") for c in points.columns]).where("p_lat is not null and p_lon is not null and p_rep_date is not null")
    p = p.withColumns({"_py": F.floor(F.col("p_lat") / north), "_px": F.floor(F.col("p_lon") / east), "_bt": F.floor(F.unix_date(F.to_date("p_rep_date")) / days)})
    split = dense_bins(p, most)
    own = p.withColumns({"_l": F.lit(0), "_y": F.shiftright("_py", LEVELS), "_x": F.shiftright("_px", LEVELS)})
    for level in range(max([r[0] for r in split.where(F.col("_l") < LEVELS).select("_l").distinct().collect()], default=-1) + 1):
        own, f = divided(own, split, level, ("_py", "_py"), ("_px", "_px")), divided(f, split, level, ("_y0", "_y1"), ("_x0", "_x1"))
    return f, own, split


def dense_bins(points: DataFrame, most: int) -> DataFrame:
    """(_bt, n, _l, _y, _x), a table: the bins of every level that hold more than ``most`` of points(_bt, _py, _px); they are n / most at most on each level."""
    fine = points.groupBy("_bt", "_py", "_px").agg(F.count("*").alias("n"))
    at = F.expr(f"transform(sequence(0, {LEVELS}), l -> struct(l as _l, shiftright(_py, {LEVELS} - l) as _y, shiftright(_px, {LEVELS} - l) as _x))")
    return written(fine.select("_bt", "n", F.explode(at).alias("_n")).groupBy("_bt", "_n").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("_bt", "n", "_n.*"), "dense")


def divided(rows: DataFrame, split: DataFrame, level: int, y: tuple[str, str], x: tuple[str, str]) -> DataFrame:
    """rows in bins (_bt, _l, _y, _x): those in a split bin of the level go to the parts of it that their numbers from y[0] to y[1] and x[0] to x[1] touch."""
    shift = LEVELS - level - 1
    part = lambda c, ends: F.sequence(F.greatest(F.col(c) * 2, F.shiftright(ends[0], shift)), F.least(F.col(c) * 2 + 1, F.shiftright(ends[1], shift)))
    here = split.where(F.col("_l") == level).drop("n").withColumn("_split", F.lit(True))
    out = rows.join(here, ["_bt", "_l", "_y", "_x"], "left").withColumn("_into", F.coalesce("_split", F.lit(False)))
    out = out.withColumn("_ny", F.explode(F.when(F.col("_into"), part("_y", y)).otherwise(F.array("_y")))).withColumn("_nx", F.explode(F.when(F.col("_into"), part("_x", x)).otherwise(F.array("_x"))))
    return out.withColumns({"_l": F.when(F.col("_into"), F.lit(level + 1)).otherwise(F.col("_l")), "_y": F.col("_ny"), "_x": F.col("_nx")}).drop("_split", "_into", "_ny", "_nx")


def fuel_group(c: str) -> Column:
    """Conifer, deciduous, mixed, slash, open by the code's first letter; anything else, null too, is other."""
    return F.expr(f"case substring(upper({c}), 1, 1) when 'C' then 'conifer' when 'D' then 'deciduous' when 'M' then 'mixed' when 'S' then 'slash' when 'O' then 'open' else 'other' end")


def dominant(rows: DataFrame, key: str, category: str) -> DataFrame:
    """Each key's most frequent category that is not null; of equals the first in the alphabet."""
    counts = rows.where(F.col(category).isNotNull()).groupBy(key, category).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(F.min_by(category, F.struct((-F.col("_n")).alias("n"), category)).alias(category))


def summed(fires: DataFrame, points: DataFrame, radius_km: float, before_hours: float, after_hours: float, measures: list[str], most: int = HELD) -> DataFrame:
    """within() added up, without its pairs: (national_fire_id, t0, _n, _near, _first, _day_*, _fuel_*, _max_*, _high_*, _low_*, _known_*), some rows for each incident.

    points(lat, lon, rep_date, fuel: place in FUELS, measures). A bin's detections are held by place and time, with running sums and maxima: an incident reads two
    ends for each place, whatever lies between them. The smallest bins that still hold more than ``most`` are dealt out by hash. Sums are of millionths, in two words
    of 32 bits; days with detections are bits, counted from the window's first day.
    """
    high = max(1.0, TILE * radius_km / KM_PER_DEGREE)
    real = lambda df: df.where("not isnan(lat) and not isnan(lon)")
    f, own, split = placed(real(fires), real(points), radius_km, before_hours, after_hours, most, (high, 2 * high, TILE_DAYS))
    full = split.where(F.col("_l") == LEVELS).select("_bt", "_l", "_y", "_x", F.ceil(F.col("n") / most).alias("_parts"))
    own, f = (df.join(F.broadcast(full), ["_bt", "_l", "_y", "_x"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1).cast("long"))) for df in (own, f))
    own = own.withColumn("_s", F.expr(f"pmod(xxhash64(p_lat, p_lon, p_rep_date, p_fuel, {', '.join(f'p_{m}' for m in [*measures, 'lat'])}), _parts)"))
    f = f.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    key = [F.col(c).cast("long").alias(c) for c in PARTS]
    held = {"id": F.lit(None).cast(fires.schema["national_fire_id"].dataType), "t0": F.lit(None).cast(fires.schema["t0"].dataType), "a": F.col("p_lat"), "b": F.col("p_lon"), "since": F.col("p_rep_date"), "upto": F.col("p_rep_date"), "day": F.unix_date(F.to_date("p_rep_date")), "fuel": F.col("p_fuel")}
    asked = {"id": F.col("national_fire_id"), "t0": F.col("t0"), "a": F.col("lat"), "b": F.col("lon"), "since": F.col("_from"), "upto": F.col("_to"), "day": F.unix_date(F.to_date("_from")), "fuel": F.lit(0)}
    held |= {"high": F.lit(0.0), "wide": F.lit(0.0)} | {f"m_{m}": F.col(f"p_{m}").cast("double") for m in measures} | {f"u_{m}": (F.col(f"p_{m}").cast("decimal(18,6)") * 1000000).cast("long") for m in measures}
    asked |= {"high": F.col("_dlat"), "wide": F.col("_dlon")} | {f"m_{m}": F.lit(None).cast("double") for m in measures} | {f"u_{m}": F.lit(None).cast("long") for m in measures}
    when = points.schema["rep_date"].dataType
    some = lambda df, kind, columns: df.select(*key, F.lit(kind).alias("kind"), *[(c.cast("double") if n in ("a", "b", "high", "wide") else c.cast(when) if n in ("since", "upto") else c.cast("int") if n in ("day", "fuel") else c).alias(n) for n, c in columns.items()])
    rows = some(own, 0, held).unionByName(some(f, 1, asked))
    words = int((before_hours + after_hours) // 24 + 2) // WORD + 1
    out = {"national_fire_id": fires.schema["national_fire_id"].dataType.simpleString(), "t0": fires.schema["t0"].dataType.simpleString(), "_n": "long", "_near": "double", "_first": when.simpleString()}
    out |= {f"_day_{k}": "long" for k in range(words)} | {f"_fuel_{g}": "long" for g in FUELS}
    for m in measures:
        out |= {f"_max_{m}": "double", f"_high_{m}": "long", f"_low_{m}": "long", f"_known_{m}": "long"}
    return rows.repartition(*PARTS).sortWithinPartitions(*PARTS, "kind", "a", "b", "since").mapInArrow(lambda b: _sums(b, measures, words, radius_km), ", ".join(f"{c} {t}" for c, t in out.items()))


def _sums(batches: Iterator[pa.RecordBatch], measures: list[str], words: int, radius_km: float) -> Iterator[pa.RecordBatch]:
    """Rows by bin, detections before incidents -> the incidents' sums. One bin's detections are held."""
    own, held, ready = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in (*PARTS, "kind")])
        ends = [*(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        begin = 0
        for end in ends:
            *here, kind = key[:, begin].tolist()
            part = batch.slice(begin, end - begin)
            begin = end
            if here != own:
                own, held, ready = here, [], None
            if kind == 0:
                held.append(part)
            elif held:
                ready = ready or Held(pa.Table.from_batches(held), measures)
                yield from ready.sums(part, words, radius_km)


class Held:
    """A bin's detections in the order of place and time, with running sums."""

    def __init__(self, table: pa.Table, measures: list[str]) -> None:
        column = lambda c: table.column(c).to_numpy()
        a, b = column("a"), column("b")
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        site = np.cumsum(new) - 1
        self.a, self.b = a[new], b[new]
        self.kind, self.times = table.column("since").type, table.column("since").cast(pa.int64()).to_numpy()
        self.base, self.first_day = int(self.times.min()), int(column("day").min())
        # one number for place and time, one for place and day: the rows are in their order
        self.at = site * (1 << 40) + (self.times - self.base)
        self.on = site * (1 << 20) + (column("day") - self.first_day)
        running = lambda x: np.append(0, np.cumsum(x, dtype=np.int64))
        fuel = column("fuel")
        self.fuels = [running(fuel == k) for k in range(len(FUELS))]
        self.measures = {}
        for m in measures:
            known = ~table.column(f"m_{m}").is_null().to_numpy()
            units = table.column(f"u_{m}").fill_null(0).to_numpy()
            tops = _tops(table.column(f"m_{m}").fill_null(float("-inf")).to_numpy())
            self.measures[m] = tops, running(units >> 32), running(units & 0xFFFFFFFF), running(known)

    def sums(self, fires: pa.RecordBatch, words: int, radius_km: float) -> Iterator[pa.RecordBatch]:
        """Those of the incidents that have detections here, in batches of a bounded number of pairs with places."""
        low, top = (fires.column("a").to_numpy() + sign * fires.column("high").to_numpy() for sign in (-1, 1))
        begin, end = np.searchsorted(self.a, low), np.searchsorted(self.a, top, "right")
        upto = np.cumsum(np.maximum(end - begin, 0))
        i = 0
        while i < len(upto):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS, "right")))
            if out := self.some(fires.slice(i, j - i), begin[i:j], end[i:j], words, radius_km):
                yield out
            i = j

    def some(self, fires: pa.RecordBatch, begin: np.ndarray, end: np.ndarray, words: int, radius_km: float) -> pa.RecordBatch | None:
        a, b, wide = (fires.column(c).to_numpy() for c in ("a", "b", "wide"))
        since, upto = (fires.column(c).cast(pa.int64()).to_numpy() - self.base for c in ("since", "upto"))
        n = np.maximum(end - begin, 0)
        fire = np.repeat(np.arange(len(n)), n)
        site = np.arange(len(fire)) - np.repeat(np.cumsum(n) - n, n) + begin[fire]
        inside = (self.b[site] >= (b - wide)[fire]) & (self.b[site] <= (b + wide)[fire])
        fire, site = fire[inside], site[inside]
        y, x = self.a[site], self.b[site]
        h = np.sin(np.radians(y - a[fire]) / 2) ** 2 + np.cos(np.radians(a[fire])) * np.cos(np.radians(y)) * np.sin(np.radians(x - b[fire]) / 2) ** 2
        dist = RADIUS_KM * 2 * np.arcsin(np.sqrt(h))
        last = (1 << 40) - 1
        left = np.searchsorted(self.at, site * (1 << 40) + np.clip(since, 0, last)[fire])
        right = np.searchsorted(self.at, site * (1 << 40) + np.clip(upto, -1, last)[fire], "right")
        near = np.flatnonzero((dist <= radius_km) & (right > left))
        if not len(near):
            return None
        fire, site, dist, left, right = (v[near] for v in (fire, site, dist, left, right))
        starts = np.flatnonzero(np.append(True, fire[1:] != fire[:-1]))
        some = fire[starts]
        total = lambda running: np.add.reduceat(running[right] - running[left], starts)
        out = {"national_fire_id": fires.column("id").take(pa.array(some)), "t0": fires.column("t0").take(pa.array(some)), "_n": np.add.reduceat(right - left, starts), "_near": np.minimum.reduceat(dist, starts)}
        out["_first"] = pa.array(np.minimum.reduceat(self.times[left], starts)).cast(self.kind)
        first = fires.column("day").to_numpy().astype(np.int64)[fire] - self.first_day
        bits = np.zeros((words, len(fire)), np.int64)
        for day in range(int((self.on[right - 1] - site * (1 << 20) - first).max()) + 1):
            on = site * (1 << 20) + first + day
            some_day = (first + day >= 0) & (np.maximum(np.searchsorted(self.on, on), left) < np.minimum(np.searchsorted(self.on, on, "right"), right))
            bits[day // WORD] |= some_day.astype(np.int64) << (day % WORD)
        out |= {f"_day_{k}": np.bitwise_or.reduceat(bits[k], starts) for k in range(words)}
        out |= {f"_fuel_{g}": total(running) for g, running in zip(FUELS, self.fuels, strict=True)}
        for m, (tops, high, low, known) in self.measures.items():
            count = total(known)
            out |= {f"_max_{m}": pa.array(np.maximum.reduceat(_top(tops, left, right), starts), mask=count == 0), f"_high_{m}": total(high), f"_low_{m}": total(low), f"_known_{m}": count}
        return pa.RecordBatch.from_pydict(out)


def hotspot_features(fires: DataFrame, hotspots: DataFrame, radius_km: float = 10.0, decision_hours: float = 24, most: int = HELD) -> DataFrame:
    """Counts, maxima, means, sums, nearest distance, active days, lead time and main fuel of each incident's detections. Incidents without any are left out.

    Detections are summed up bin by bin, so no pair leaves its task; sums are of decimals, the same whatever the order.
    """
    have = [m for m in MEASURES if m in hotspots.columns]
    fuels = "fuel" in hotspots.columns
    place = F.array_position(F.array(*[F.lit(g) for g in FUELS]), fuel_group("fuel") if fuels else F.lit("other")).cast("int") - 1
    near = summed(fires.select("national_fire_id", "t0", "lat", "lon"), hotspots.select("lat", "lon", "rep_date", place.alias("fuel"), *have), radius_km, 24, decision_hours, have, most)
    days = F.expr(" + ".join(f"bit_count(bit_or({c}))" for c in near.columns if c.startswith("_day_")))
    aggs = [F.sum("_n").alias("hs_count"), F.min("_near").alias("hs_dist_min_km"), days.cast("long").alias("hs_active_days"), F.min("_first").alias("_first")]
    millionths = lambda m: f"(cast(cast(sum(_high_{m}) as decimal(20,0)) * 4294967296 + sum(_low_{m}) as decimal(28,0)) * 0.000001BD)"
    total = lambda m: F.expr(f"case when sum(_known_{m}) > 0 then cast({millionths(m)} as double) end")
    for m in have:
        aggs += [F.max(f"_max_{m}").cast(hotspots.schema[m].dataType).alias(f"hs_{m}_max"), (total(m) / F.expr(f"nullif(sum(_known_{m}), 0)")).alias(f"hs_{m}_mean")]
    if "hfi" in have:
        aggs.append(total("hfi").alias("hs_hfi_sum"))
    if fuels:
        # of equals the first in the alphabet
        aggs.append(F.expr(f"array_min(array({', '.join(f'struct(-sum(_fuel_{g}) as n, {chr(39)}{g}{chr(39)} as g)' for g in FUELS)})).g").alias("hs_fuel_group"))
    # hours are counted by the boundaries between them
    lead = F.expr("timestampdiff(HOUR, date_trunc('HOUR', _first), date_trunc('HOUR', t0))")
    return near.groupBy("national_fire_id", "t0").agg(*aggs).withColumn("hs_detection_lead_hours", lead).drop("t0", "_first")
