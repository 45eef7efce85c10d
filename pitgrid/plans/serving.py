"""Filters and readouts over scored artefacts."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.operators import ranks

from pitgrid.sources import tables

#: Stage-of-control codes.
STATUS = {"OC": "out of control", "BH": "being held", "UC": "under control", "EX": "out", "UNK": "unknown"}


def status_label(c: str):
    """The text of a status code; other codes stay as they are."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[F.col(c)], F.col(c))


def by_risk(risk: DataFrame, *ties: str, day: str | None = None) -> DataFrame:
    """All rows by falling risk, inside each day where one is named; ties by the named columns."""
    return risk.orderBy(*([day] if day else []), F.desc("risk"), *ties)


def artefacts(spark, paths: dict[str, str]) -> dict[str, dict]:
    """For each named path whether it has been built, when it was written and how many bytes it holds, in whatever store."""
    out = {}
    for name, path in paths.items():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            out[name] = {"built": False}
            continue
        at = datetime.datetime.fromtimestamp(fs.getFileStatus(where).getModificationTime() / 1000, datetime.UTC)
        out[name] = {"built": True, "written_at": at.strftime("%Y-%m-%dT%H:%M:%SZ"), "bytes": fs.getContentSummary(where).getLength()}
    return out


def models(spark, paths: dict[str, str]) -> dict[str, dict]:
    """What the sidecars of fitted models and backtests say: target, seasons, rows, held-out accuracy. A missing one leaves its part out."""
    out: dict[str, dict] = {}
    for name, path in paths.items():
        out[name] = tables.read_json(spark, path) if tables.exists(spark, path) else {}
    return out


def top(rows: DataFrame, condition, by: str, ties: list[str], limit: int) -> DataFrame:
    """The first ``limit`` matching rows by falling ``by``, ties by the named columns, with n_matching before the limit."""
    found = rows.where(condition)
    n = found.agg(F.count("*").alias("n_matching"))
    return found.orderBy(F.desc(by), *ties).limit(limit).crossJoin(F.broadcast(n))


def fires(risk: DataFrame, limit: int = 100, min_risk: float = 0.0, agency: str | None = None) -> DataFrame:
    if not 1 <= limit <= 1000 or not 0 <= min_risk <= 1:
        raise ValueError("limit is 1 to 1000, min_risk 0 to 1")
    wanted = F.lit(True) if agency is None else F.col("agency_code") == agency.upper()
    return top(risk, wanted & (F.lit(min_risk <= 0) | (F.col("risk") >= min_risk)), "risk", ["national_fire_id"], limit)


def fire(risk: DataFrame, national_fire_id: str) -> DataFrame:
    return risk.where(F.col("national_fire_id") == national_fire_id)


def ignition(risk: DataFrame, limit: int = 1000, min_risk: float = 0.0, bbox: tuple[float, float, float, float] | None = None, day=None) -> DataFrame:
    """Cells of a day (the newest by default) in an inclusive box (min_lon, min_lat, max_lon, max_lat)."""
    if not 1 <= limit <= 5000:
        raise ValueError("limit is 1 to 5000")
    if bbox and (len(bbox) != 4 or bbox[0] > bbox[2] or bbox[1] > bbox[3]):
        raise ValueError("bbox is min_lon, min_lat, max_lon, max_lat")
    if day is None:
        newest = risk.agg(F.max("day").alias("_newest"))
        risk = risk.crossJoin(F.broadcast(newest)).where("day = _newest").drop("_newest")
    else:
        risk = risk.where(F.col("day") == F.lit(day).cast("date"))
    if bbox:
        risk = risk.where(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))
    return top(risk, F.lit(min_risk <= 0) | (F.col("risk") >= min_risk), "risk", ["cell_x", "cell_y"], limit)


def readouts(risk: DataFrame, thresholds: tuple[float, ...] = (0.1, 0.25)) -> DataFrame:
    return risk.agg(F.count("*").alias("n"), *[F.count_if(F.col("risk") >= t).alias(f"n_over_{int(t * 100)}") for t in thresholds], F.count_if(F.col("status_now") == "OC").alias("n_out_of_control"))


def top_share(risk: DataFrame, share: float = 0.08, bands: tuple[float, ...] = (0.995, 0.98), ties: tuple[str, ...] = ("cell_x", "cell_y"), day: str | None = "day") -> DataFrame:
    """The top share of the newest day's rows, at least one, by falling risk; band: 0 from the first quantile of all its rows on, 1 from the second, else the last.

    Quantiles are the rows nearest to their place. Rows that equal the last one in risk and ties come along with it; the result is in no order.
    """
    if day:
        risk = risk.join(F.broadcast(risk.agg(F.max(day).alias(day))), day)
    n = risk.count()
    if not n:
        return risk.withColumn("band", F.lit(0))
    cuts = [ranks.nth(risk, [("risk", False)], int(q * (n - 1) + 0.5) + 1)[0] for q in bands]
    last = ranks.nth(risk, [("risk", True), *[(t, False) for t in ties]], max(1, int(n * share)))
    inside = F.lit(True)
    for c, value in reversed(list(zip(("risk", *ties), last, strict=True))):
        ahead = F.col(c) > F.lit(value) if c == "risk" else F.col(c) < F.lit(value)
        inside = ahead | ((F.col(c) == F.lit(value)) & inside)
    return risk.where(inside).withColumn("band", sum((F.col("risk") < F.lit(q)).cast("int") for q in cuts))
