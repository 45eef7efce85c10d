"""What was known at an instant: bitemporal states, counts and labels, and backward as-of joins.

Revisions are rows (national_fire_id, id, record_start, ...); record_start is when a row became visible. (record_start, id) orders them wherever an order matters, so
no result depends on how the input is laid out. Instants are visible up to and including the cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = "national_fire_id"
ORDER = "struct(record_start, id)"


def _first(name: str) -> Column:
    """The earliest value that is not null."""
    return F.min_by(name, F.when(F.col(name).isNotNull(), F.expr(ORDER))).alias({"latitude": "lat", "longitude": "lon"}.get(name, name))


def first_seen(revisions: DataFrame, carried: tuple[str, ...] = ("latitude", "longitude", "agency_code", "region_code", "fire_year")) -> DataFrame:
    """t0 of each incident, its first known attributes and how many revisions it has; incidents never recorded are left out."""
    return revisions.groupBy(KEY).agg(F.min("record_start").alias("t0"), *[_first(c) for c in carried], F.count("*").alias("n_revisions")).where("t0 is not null")


def hours_after(instant: str | Column, hours: float) -> Column:
    instant = F.col(instant) if isinstance(instant, str) else instant
    return instant + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))


def visible(revisions: DataFrame, offsets: DataFrame, hours: float) -> DataFrame:
    """Revisions that could be read ``hours`` after their incident's t0."""
    cutoff = offsets.select(KEY, hours_after("t0", hours).alias("_cutoff"))
    return revisions.join(cutoff, KEY).where("record_start <= _cutoff").drop("_cutoff")


def state_asof(revisions: DataFrame, offsets: DataFrame, hours: float) -> DataFrame:
    """The last visible revision of each incident, whole; incidents without one are left out."""
    rest = [c for c in revisions.columns if c != KEY]
    last = visible(revisions, offsets, hours).groupBy(KEY).agg(F.max_by(F.struct(*rest), F.expr(ORDER)).alias("_row"))
    return last.select(KEY, "_row.*")


def revisions_before(revisions: DataFrame, offsets: DataFrame, hours: float) -> DataFrame:
    """Counts over what was visible; a null status counts as one more status."""
    status = "stage_of_control_status"
    return visible(revisions, offsets, hours).groupBy(KEY).agg(
        F.count("*").alias("n_revisions_by_decision"),
        F.min_by("fire_size", F.when(F.col("fire_size").isNotNull(), F.expr(ORDER))).alias("size_first"),
        F.max("fire_size").alias("size_max_by_decision"),
        (F.count_distinct(status) + F.max(F.col(status).isNull().cast("long"))).alias("n_status_by_decision"),
    )


def label_at(revisions: DataFrame, offsets: DataFrame, hours: float) -> DataFrame:
    return state_asof(revisions, offsets, hours).select(KEY, F.col("fire_size").alias("size_at_horizon"), F.col("stage_of_control_status").alias("status_at_horizon"))


def observable(offsets: DataFrame, revisions: DataFrame, hours: float, cutoff=None) -> DataFrame:
    """Incidents whose horizon lies inside the record; the record ends at its last revision unless a cutoff is given."""
    if cutoff is not None:
        return offsets.where(hours_after("t0", hours) <= F.lit(cutoff).cast("timestamp_ntz"))
    end = revisions.agg(F.max("record_start").alias("_end"))
    return offsets.crossJoin(F.broadcast(end)).where(hours_after("t0", hours) <= F.col("_end")).drop("_end")


CARRIED = ("latitude", "longitude", "agency_code", "region_code", "fire_year")


def timeline(revisions: DataFrame, carried: tuple[str, ...] = CARRIED, block_days: int = 30) -> DataFrame:
    """Every revision with the interval in which it is the incident's state, valid_from up to valid_to (null: still), and what is known by then.

    Adds t0, n_rows (rows so far, undated ones first), the first known carried attributes so far, and over dated rows n_by, size_first, size_max and n_status (a null status is
    one more). Any instant's state is the one row whose interval holds it, so instants relative to t0 are a filter. Undated rows have no interval; of rows of one instant
    the last id's has one that is not empty. Rows are ordered inside blocks of days; a busy incident's blocks are separate tasks, joined by one small row a block.
    """
    dated = lambda c: F.when(F.col("record_start").isNotNull(), F.col(c))
    name = lambda c: {"latitude": "lat", "longitude": "lon"}.get(c, c)
    own = [c for c in carried if c in revisions.columns]
    status = F.when(F.col("record_start").isNotNull(), F.coalesce(F.concat(F.lit("="), F.col("stage_of_control_status").cast("string")), F.lit("")))
    rows = revisions.withColumns({"_block": F.coalesce(F.floor(F.unix_date(F.col("record_start").cast("date")) / block_days), F.lit(-(1 << 40))), "_status": status})
    inside = W.partitionBy(KEY, "_block").orderBy(F.col("record_start").asc_nulls_first(), "id")
    running = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    firsts = {name(c): F.first(c, ignorenulls=True) for c in own} | {"size_first": F.first(dated("fire_size"), ignorenulls=True)}
    sums = {"n_rows": F.count("*"), "n_by": F.count("record_start")}
    rest = {"size_max": F.max(dated("fire_size")), "_seen": F.collect_set("_status")}
    told = rows.withColumns({f"_r_{c}": x.over(running) for c, x in (firsts | sums | rest).items()} | {"_next": F.lead("record_start").over(inside)})
    # one row a block: what it adds, and what all blocks before it add up to
    ordered = lambda c, x: F.min_by(x, F.when(x.isNotNull(), F.expr(ORDER))).alias(c)
    values = {name(c): F.col(c) for c in own} | {"size_first": dated("fire_size")}
    blocks = rows.groupBy(KEY, "_block").agg(*[ordered(c, x) for c, x in values.items()], *[x.alias(c) for c, x in (sums | rest).items()], F.min("record_start").alias("_at"))
    ahead = W.partitionBy(KEY).orderBy("_block")
    before = ahead.rowsBetween(W.unboundedPreceding, -1)
    carry = {c: F.first(c, ignorenulls=True).over(before) for c in firsts} | {c: F.coalesce(F.sum(c).over(before), F.lit(0).cast("long")) for c in sums}
    carry |= {"size_max": F.max("size_max").over(before), "_seen": F.flatten(F.collect_list("_seen").over(before))}
    blocks = blocks.select(F.col(KEY).alias("_key"), F.col("_block").alias("_b"), *[x.alias(f"_b_{c}") for c, x in carry.items()], F.lead("_at").over(ahead).alias("_after"), F.min("_at").over(W.partitionBy(KEY)).alias("t0"))
    both = told.join(blocks, (F.col(KEY) == F.col("_key")) & (F.col("_block") == F.col("_b")))
    out = {c: F.coalesce(f"_b_{c}", f"_r_{c}") for c in firsts} | {c: F.col(f"_b_{c}") + F.col(f"_r_{c}") for c in sums}
    out |= {"size_max": F.greatest("_b_size_max", "_r_size_max"), "n_status": F.size(F.array_union("_b__seen", "_r__seen")).cast("long")}
    kept = [c for c in revisions.columns if c not in own]
    return both.where("t0 is not null").select(*kept, F.col("record_start").alias("valid_from"), F.coalesce("_next", "_after").alias("valid_to"), "t0", *[x.alias(c) for c, x in out.items()])


def at_instants(known: DataFrame, hours: dict[str, float]) -> DataFrame:
    """One row an incident of timeline(): t0, the carried attributes, n_revisions, size_now and status_now; and for each name its state so many hours after t0, null without one."""
    state = F.struct(*[c for c in ("fire_size", "stage_of_control_status", "response_type", "national_fire_cause") if c in known.columns], "n_by", "size_first", "size_max", "n_status")
    dated = F.col("valid_from").isNotNull()
    last = F.struct("t0", *[c for c in ("lat", "lon", "agency_code", "region_code", "fire_year") if c in known.columns], F.col("n_rows").alias("n_revisions"), F.col("fire_size").alias("size_now"), F.col("stage_of_control_status").alias("status_now"))
    at = lambda h: dated & (F.col("valid_from") <= hours_after("t0", h)) & (F.col("valid_to").isNull() | (F.col("valid_to") > hours_after("t0", h)))
    found = known.groupBy(KEY).agg(F.max(F.when(dated & F.col("valid_to").isNull(), last)).alias("_l"), *[F.max(F.when(at(h), state)).alias(n) for n, h in hours.items()])
    return found.select(KEY, "_l.*", *hours)


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, tie: str, block_days: int = 30) -> DataFrame:
    """Each left row with the columns of the latest right row of its key at or before its instant (nulls if none).

    Of right rows at one instant the greatest ``tie`` counts. Both sides are put in one window by key and block of days, and the latest row of
    earlier blocks is carried over from one small row a block: no inequality join, and no window over a busy key's whole history.
    """
    taken = [c for c in right.columns if c != key]
    block = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / block_days)
    row = F.struct(F.col(right_on).alias("_o1"), F.col(tie).alias("_o2"), *[F.col(c) for c in taken])
    dated = right.where(f"`{right_on}` is not null").select(key, block(right_on).alias("_block"), F.col(right_on).alias("_at"), F.lit(0).alias("_side"), row.alias("_row"))
    asked = left.select(F.struct(*left.columns).alias("_left"), F.col(key), block(left_on).alias("_block"), F.col(left_on).alias("_at"), F.lit(1).alias("_side"))
    both = asked.unionByName(dated, allowMissingColumns=True)
    inside = W.partitionBy(key, "_block").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = both.groupBy(key, "_block").agg(F.max("_row").alias("_last")).withColumn("_before", F.max("_last").over(ahead)).drop("_last")
    found = both.withColumn("_row", F.max("_row").over(inside)).where("_side = 1").join(carried, [key, "_block"], "left").withColumn("_row", F.coalesce("_row", "_before"))
    return found.select("_left.*", *[F.col(f"_row.{c}").alias(c) for c in taken])


#: Situation-report columns and the features that they become.
SITREP = {
    "national_preparedness_level": "ciffc_national_pl", "agency_preparedness": "ciffc_agency_pl", "prep_hazard": "ciffc_prep_hazard", "prep_current_load": "ciffc_prep_current_load",
    "prep_expected_load": "ciffc_prep_expected_load", "prep_resource_levels": "ciffc_prep_resource_levels", "prep_resource_availability": "ciffc_prep_resource_availability",
    "occurrence_pred_lightning": "ciffc_occurrence_pred_lightning", "occurrence_pred_human": "ciffc_occurrence_pred_human",
}


def preparedness(asked: DataFrame, sitreps: DataFrame, decided: str = "decision_at") -> DataFrame:
    """asked(agency_code, decision_at, ...) with the last published report of its agency, and its age in hours (whole minutes)."""
    have = [c for c in SITREP if c in sitreps.columns]
    reports = sitreps.select("agency_code", "published_at", "sitrep_date", *have)
    out = asof_backward(asked, reports, "agency_code", decided, "published_at", "sitrep_date")
    lag = F.expr(f"timestampdiff(MINUTE, published_at, `{decided}`) / 60.0D")
    return out.select(*asked.columns, *[F.col(c).alias(SITREP[c]) for c in have], lag.alias("ciffc_sitrep_lag_hours"))
