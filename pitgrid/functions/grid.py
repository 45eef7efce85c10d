"""An equal-area grid (Lambert azimuthal, centre 60 N 96 W), cells, neighbours and polygons, in column expressions."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.sources.shared import written as cut

RADIUS, LAT0, LON0, CELL_KM = 6371.0072, 60.0, -96.0, 10.0
RING = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if (x, y) != (0, 0)]


def project(lat: str = "lat", lon: str = "lon") -> tuple[Column, Column]:
    p, q = f"radians({lat})", f"radians({lon} - ({LON0}D))"
    s, c = f"sin(radians({LAT0}D))", f"cos(radians({LAT0}D))"
    k = f"sqrt(2 / greatest(1 + {s} * sin({p}) + {c} * cos({p}) * cos({q}), 1e-12D))"
    return F.expr(f"{RADIUS}D * {k} * cos({p}) * sin({q})"), F.expr(f"{RADIUS}D * {k} * ({c} * sin({p}) - {s} * cos({p}) * cos({q}))")


def unproject(x: str = "x", y: str = "y") -> tuple[Column, Column]:
    rho = f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"
    c = f"(2 * asin(least(1D, {rho} / (2 * {RADIUS}D))))"
    s0, c0 = f"sin(radians({LAT0}D))", f"cos(radians({LAT0}D))"
    lat = f"if({rho} < 1e-12D, {LAT0}D, degrees(asin(greatest(-1D, least(1D, cos({c}) * {s0} + ({y}) * sin({c}) * {c0} / {rho})))))"
    lon = f"if({rho} < 1e-12D, {LON0}D, {LON0}D + degrees(atan2(({x}) * sin({c}), {rho} * {c0} * cos({c}) - ({y}) * {s0} * sin({c}))))"
    return F.expr(lat), F.expr(f"pmod({lon} + 180D, 360D) - 180D")


def with_cells(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds cell_x and cell_y; rows without coordinates go."""
    x, y = project(lat, lon)
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumns({"cell_x": F.floor(x / CELL_KM).cast("int"), "cell_y": F.floor(y / CELL_KM).cast("int")})


def with_centres(df: DataFrame) -> DataFrame:
    lat, lon = unproject(f"(cell_x + 0.5D) * {CELL_KM}D", f"(cell_y + 0.5D) * {CELL_KM}D")
    return df.withColumns({"lat": lat, "lon": lon})


def with_ring(df: DataFrame) -> DataFrame:
    """Each row for each of the eight cells around its own, in ring_x and ring_y."""
    offsets = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])
    return df.withColumn("_o", F.explode(offsets)).withColumns({"ring_x": F.col("cell_x") + F.col("_o.x"), "ring_y": F.col("cell_y") + F.col("_o.y")}).drop("_o")


def nearest(cells: DataFrame, stations: DataFrame, k: int = 12, max_km: float | None = None) -> DataFrame:
    """(cell_x, cell_y, aes, rank from 0, dist_km): each cell's k nearest stations on the projected plane, ties by station.

    Cells and stations meet by equi-joins of square bins: a cell searches its own bin and the eight around. What lies beyond is farther than one
    side of a bin, so k stations nearer than that are final; cells with fewer search again with bins of twice the side, up to max_km or the whole plane.
    """
    x, y = project()
    sites = cut(stations.where("lat is not null and lon is not null").select("aes", x.alias("_sx"), y.alias("_sy")), "stations")
    n, wide, high = sites.selectExpr("count(*)", "max(_sx) - min(_sx)", "max(_sy) - min(_sy)").first()
    side, span = CELL_KM, max(wide or 0.0, high or 0.0)
    while n and side * side * n < span * span * k:
        side *= 2
    pending = cells.select("cell_x", "cell_y").distinct().withColumns({"_cx": (F.col("cell_x") + 0.5) * CELL_KM, "_cy": (F.col("cell_y") + 0.5) * CELL_KM})
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i, j))))"))
    found: list[DataFrame] = []
    while True:
        last = not n or side > 4 * RADIUS + CELL_KM or (max_km is not None and side > max_km)
        bins = lambda a, b, side=side: {"_bx": F.expr(f"cast(floor({a} / {side}D) as int)"), "_by": F.expr(f"cast(floor({b} / {side}D) as int)")}
        asked = pending.withColumns(bins("_cx", "_cy")).withColumn("_o", around).withColumns({"_bx": F.expr("_bx + _o.i"), "_by": F.expr("_by + _o.j")})
        pairs = asked.join(sites.withColumns(bins("_sx", "_sy")), ["_bx", "_by"]).withColumn("dist_km", F.expr("sqrt((_sx - _cx) * (_sx - _cx) + (_sy - _cy) * (_sy - _cy))"))
        pairs = pairs.where(F.col("dist_km") <= max_km) if max_km is not None else pairs
        ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("cell_x", "cell_y").orderBy("dist_km", "aes")) - 1)
        ranked = ranked.where(F.col("rank") < k).select("cell_x", "cell_y", "aes", "rank", "dist_km")
        if last:
            found.append(ranked)
            break
        ranked = cut(ranked, "ranked")
        settled = cut(ranked.where(F.col("dist_km") < side - 1e-6).groupBy("cell_x", "cell_y").count().where(F.col("count") >= k).select("cell_x", "cell_y"), "settled")
        found.append(ranked.join(settled, ["cell_x", "cell_y"], "left_semi"))
        pending = cut(pending.join(settled, ["cell_x", "cell_y"], "left_anti"), "pending")
        if pending.isEmpty():
            break
        side *= 2
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def polygon_edges(rings: DataFrame) -> DataFrame:
    """rings(code, ring long, points array<struct<lon, lat>>) -> one row an edge; rings of under three points go."""
    r = rings.where("size(points) >= 3").withColumn("_e", F.explode(F.expr("arrays_zip(points, concat(slice(points, 2, size(points) - 1), slice(points, 1, 1)))")))
    return r.select("code", "ring", *[F.col(f"_e.{s}.{c}").alias(f"{n}_{c}") for s, n in (("points", "a"), ("1", "b")) for c in ("lon", "lat")])


#: Degrees of the widest cells of a cover, how many parts a side is split into, and the least cells.
COVER, PARTS, DEEPEST = 16.0, 4, 13
#: How often the cells of a ring may hold its edges on average.
COPIES = 16
#: Beyond this many degrees from a cell an edge is surely not in it.
CLEAR = 1e-9
_EDGES = "array<struct<a_lon:double,a_lat:double,b_lon:double,b_lat:double>>"


def cover(edges: DataFrame, most: int = 16) -> DataFrame:
    """A hierarchy of cells for each ring: (code, ring, level, cx, cy, base, steps, near), those wholly outside left out.

    A cell that more than ``most`` edges come near is split, the fullest first, until cells hold COPIES times the ring's edges (an outline whose edges are long and
    cross each other's cells reaches that, others end long before). So the cells of a ring differ in size: large ones inside it, small ones along its edges. In a cell the
    edges west of it never count for a point, those east of it count by their ends' latitudes alone: together they are ``base`` and a turn at each latitude
    of ``steps``. Only ``near`` edges are tested, with the same arithmetic as over all edges.
    """
    own = edges.select("code", "ring", "a_lon", "a_lat", "b_lon", "b_lat").where("a_lat <> b_lat")
    return own.groupBy("code", "ring").applyInArrow(lambda t: _covered(t, most), f"code string, ring long, level int, cx long, cy long, base int, steps array<double>, near {_EDGES}")


def _covered(table: pa.Table, most: int) -> pa.Table:
    a_lon, a_lat, b_lon, b_lat = edges = [table.column(c).to_numpy() for c in ("a_lon", "a_lat", "b_lon", "b_lat")]
    west, east, south, north = np.minimum(a_lon, b_lon), np.maximum(a_lon, b_lon), np.minimum(a_lat, b_lat), np.maximum(a_lat, b_lat)
    out: dict[str, list] = {c: [] for c in ("level", "cx", "cy", "base", "steps", "near")}

    def inside(level: int, cx: int, cy: int, some: np.ndarray, base: int, steps: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
        """What a wider cell's edges and turns are in this one."""
        side = COVER / PARTS**level
        x, y = cx * side, cy * side
        some = some[(north[some] > y) & (south[some] < y + side)]
        beyond = some[west[some] > x + side + CLEAR]
        turns = np.concatenate([steps, a_lat[beyond], b_lat[beyond]])
        base ^= int((turns >= y + side).sum()) & 1
        values, times = np.unique(turns[(turns > y) & (turns < y + side)], return_counts=True)
        return some[(west[some] <= x + side + CLEAR) & (east[some] >= x - CLEAR)], base, values[times % 2 == 1]

    ends = [int(np.floor(v / COVER)) for v in (west.min(), east.max(), south.min(), north.max())]
    every = np.arange(len(a_lon))
    open_ = []

    def push(level: int, cx: int, cy: int, some: np.ndarray, base: int, steps: np.ndarray) -> int:
        own = inside(level, cx, cy, some, base, steps)
        heapq.heappush(open_, (-len(own[0]), level, cx, cy, *own))
        return len(own[0])

    held = sum(push(0, cx, cy, every, 0, np.zeros(0)) for cx in range(ends[0], ends[1] + 1) for cy in range(ends[2], ends[3] + 1))
    while open_:
        # the cell with most edges first
        _, level, cx, cy, some, base, steps = heapq.heappop(open_)
        if len(some) > most and level < DEEPEST and held <= COPIES * len(every) + 4096:
            held -= len(some)
            held += sum(push(level + 1, cx * PARTS + k % PARTS, cy * PARTS + k // PARTS, some, base, steps) for k in range(PARTS * PARTS))
        elif len(some) or len(steps) or base:
            near = [dict(zip(("a_lon", "a_lat", "b_lon", "b_lat"), (float(c[i]) for c in edges), strict=True)) for i in some]
            for c, v in zip(out, (level, cx, cy, base, steps.tolist(), near), strict=True):
                out[c].append(v)
    n = len(out["level"])
    kinds = {"level": pa.int32(), "cx": pa.int64(), "cy": pa.int64(), "base": pa.int32(), "steps": pa.list_(pa.float64()), "near": pa.list_(pa.struct([(c, pa.float64()) for c in ("a_lon", "a_lat", "b_lon", "b_lat")]))}
    keys = {"code": pa.array([table.column("code")[0].as_py()] * n, pa.string()), "ring": pa.array([table.column("ring")[0].as_py()] * n, pa.int64())}
    return pa.table(keys | {c: pa.array(out[c], t) for c, t in kinds.items()})


def place(points: DataFrame, edges: DataFrame, key: str, few_bytes: int = 32 << 20) -> DataFrame:
    """(key, code): the polygon that each point lies in by the even-odd rule, edges half open in latitude; of several rings the first. Points outside are left out.

    Points meet the cells of the rings' cover by an equi-join, once for each size of cell that there is; a point tests the few edges near its cell only.
    The cells are broadcast if they have at most ``few_bytes``.
    """
    cells = cut(cover(edges), "cover")
    about = cells.groupBy("level").agg(F.sum(F.expr("60 + 8 * size(steps) + 40 * size(near)")).alias("bytes")).collect()
    found = points.select(key, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where("lat is not null and lon is not null")
    if not about:
        return found.select(key, F.lit(None).cast("string").alias("code")).limit(0)
    at = F.array(*[F.expr(f"struct({r['level']} as level, floor(lon / {COVER / PARTS ** r['level']!r}D) as cx, floor(lat / {COVER / PARTS ** r['level']!r}D) as cy)") for r in sorted(about)])
    found = found.select(key, "lat", "lon", F.explode(at).alias("_at")).select(key, "lat", "lon", "_at.*")
    met = found.join(F.broadcast(cells) if sum(r["bytes"] for r in about) <= few_bytes else cells, ["level", "cx", "cy"])
    crossed = "size(filter(near, e -> (e.a_lat > lat) <> (e.b_lat > lat) and lon < (e.b_lon - e.a_lon) * (lat - e.a_lat) / (e.b_lat - e.a_lat) + e.a_lon))"
    return met.where(f"(base + size(filter(steps, s -> s > lat)) + {crossed}) % 2 = 1").groupBy(key).agg(F.min_by("code", "ring").alias("code"))
