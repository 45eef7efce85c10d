"""Fitting, calibrating, backtesting and applying the two risk models: boosted trees grown leaf by leaf, isotonic calibration, correction of the sampled prior.

Features are named by contracts. Missing numbers and categories that training has not seen go where each split's missing values go. Fits are unweighted on the earlier
three quarters of the training rows and calibrated on the rest. Folds and sets of features are fitted side by side, in the same passes over one binned table.
"""

from __future__ import annotations

import logging
from typing import NamedTuple

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgrid.functions.clean import age_hours, zero_if_missing
from pitgrid.operators import asof, panel, ranks
from pitgrid.plans import boosting, metrics, tables
from pitgrid.plans.boosting import MISSING, Boosted, Plan
from pitgrid.sources import tables as store
from pitgrid.sources.shared import removed, written

log = logging.getLogger(__name__)
#: The share of the training rows, in time, that trees learn from; the rest calibrates them.
EARLY = 0.75


class Contract(NamedTuple):
    target: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    forbidden: frozenset[str]
    order: tuple[str, ...]  # a total order of the rows; the first column is the time
    baseline: str
    groups: dict[str, tuple[str, ...]]
    least_calibration: int  # positives without which there is no calibration
    least_final: int  # positives without which there is no final fit
    trees: int
    leaves: int
    leaf: int
    sampled: bool


#: The features of both models, what may never be one, and the groups that are left out of comparisons.
_CIFFC = (
    "ciffc_national_pl", "ciffc_agency_pl", "ciffc_prep_hazard", "ciffc_prep_current_load", "ciffc_prep_expected_load", "ciffc_prep_resource_levels",
    "ciffc_prep_resource_availability", "ciffc_occurrence_pred_lightning", "ciffc_occurrence_pred_human",
)
_FIRE_HOTSPOTS = (
    "hs_count", "hs_hfi_max", "hs_hfi_mean", "hs_fwi_max", "hs_fwi_mean", "hs_ros_max", "hs_ros_mean", "hs_sfc_mean", "hs_tfc_max", "hs_tfc_mean", "hs_dist_min_km",
    "hs_active_days", "hs_detection_lead_hours",
)
_WEATHER = tuple(f"wx_{m}" for m in ("temp", "rh", "ws", "precip", "ffmc", "dmc", "dc", "isi", "bui", "fwi", "dsr"))
_NETWORK = ("wx_n_stations", "wx_dist_km")
_CELL_HOTSPOTS = (
    *[f"hs_{m}_{w}d" for m in ("n", "fwi_max", "hfi_max", "ros_max") for w in (1, 3, 7)], *[f"hs_ring_{m}_{w}d" for m in ("n", "hfi_max") for w in (1, 3, 7)], "hs_days_since",
)
_HISTORY = ("ig_n_7d", "ig_n_30d", "ig_n_365d", "ig_ring_n_7d", "ig_ring_n_365d", "ig_days_since")

ESCALATION = Contract(
    target="escalated",
    numeric=("size_at_decision", "log_size_at_decision", "size_growth_to_decision", "size_first", "size_max_so_far", "n_revisions_by_decision", "n_distinct_status", *_FIRE_HOTSPOTS, "lat", "lon", "month", "doy", "t0_hour", *_CIFFC),
    categorical=("agency_code", "region_code", "status_at_decision", "response_type", "national_fire_cause", "hs_fuel_group"),
    forbidden=frozenset({"size_at_horizon", "status_at_horizon", "still_out_of_control", "escalated", "t0", "national_fire_id", "n_revisions", "fire_year"}),
    order=("t0", "national_fire_id"),
    baseline="size_at_decision",
    groups={"ciffc": _CIFFC, "ciffc_detail": _CIFFC[2:], "hotspots": (*_FIRE_HOTSPOTS, "hs_fuel_group"), "geography": ("lat", "lon", "agency_code", "region_code")},
    least_calibration=10,
    least_final=20,
    trees=400,
    leaves=31,
    leaf=30,
    sampled=False,
)
IGNITION = Contract(
    target="ignition",
    numeric=(*_WEATHER, *_NETWORK, *_CELL_HOTSPOTS, *_HISTORY, "lat", "lon", "doy", "month", *_CIFFC),
    categorical=("agency_code",),
    forbidden=frozenset({"ignition", "n_ignitions", "pid", "day", "fire_year", "cell_x", "cell_y"}),
    order=("day", "cell_x", "cell_y"),
    baseline="ig_n_365d",
    groups={"ciffc": _CIFFC, "network": _NETWORK, "weather": (*_WEATHER, *_NETWORK), "hotspots": _CELL_HOTSPOTS, "history": _HISTORY, "geography": ("lat", "lon", "agency_code")},
    least_calibration=25,
    least_final=100,
    trees=500,
    leaves=63,
    leaf=100,
    sampled=True,
)


class Fitted(NamedTuple):
    base: Boosted
    calibrator: IsotonicRegressionModel | None
    columns: list[str]
    levels: dict[str, list[str]]
    rate: float | None
    about: dict


def features(df: DataFrame, contract: Contract, drop: tuple[str, ...] = ()) -> list[str]:
    """The contract's columns that df has, in its order, less the dropped ones; that one of them is forbidden is an error."""
    wanted = [*contract.numeric, *contract.categorical]
    if told := sorted(contract.forbidden.intersection(wanted).difference(drop)):
        raise ValueError(f"outcome leakage: the contract for {contract.target} forbids {', '.join(told)}")
    present = set(df.columns).difference(drop)
    return [c for c in wanted if c in present]


def absent(df: DataFrame, contract: Contract) -> list[str]:
    """The contract's columns that df lacks."""
    return [c for c in (*contract.numeric, *contract.categorical) if c not in df.columns]


def levels_of(train: DataFrame, contract: Contract, columns: list[str]) -> dict[str, list[str]]:
    """The categories that training has, in order."""
    return {c: [r[0] for r in train.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).collect()] for c in contract.categorical if c in columns}


def matrix(df: DataFrame, columns: list[str], levels: dict[str, list[str]]) -> DataFrame:
    """The feature columns as doubles beside df's own, as x_<name>: categories are numbered from 1 in training's order; missing and unseen ones are 0, missing numbers MISSING."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"the model needs features that the table lacks: {lacking}")
    out = {}
    for c in columns:
        if c in levels:
            known = F.array(*[F.lit(v) for v in levels[c]]) if levels[c] else F.expr("cast(array() as array<string>)")
            out[f"x_{c}"] = F.coalesce(F.array_position(known, F.col(c)), F.lit(0)).cast("double")
        else:
            out[f"x_{c}"] = F.expr(f"coalesce(nanvl(cast(`{c}` as double), {MISSING}D), {MISSING}D)")
    return df.withColumns(out)


class Wanted(NamedTuple):
    """One of the models that are fitted together: the agency that it leaves out, and the features."""

    without: str | None = None
    drop: tuple[str, ...] = ()


def fits(train: DataFrame, contract: Contract, wanted: dict[str, Wanted], rate: float | None = None, trees: int | None = None, leaves: int | None = None, leaf: int | None = None, seed: int = 17) -> dict[str, Fitted]:
    """Models of train, in one go: trees on the earlier part of each one's rows, an isotonic map of their scores on the later one unless that has too few positives.

    Parts are told by place in the contract's order, to the row. trees, leaves and leaf (rows in a leaf) are the contract's by default. Bins and levels come from all
    of train; a level that a model's own rows lack counts as missing for it. What the contract names and train lacks is logged and listed in ``about``.
    """
    for w in wanted.values():
        features(train, contract, w.drop)
    columns, lacking = features(train, contract), absent(train, contract)
    if lacking:
        log.warning("%s: the table lacks %s", contract.target, ", ".join(lacking))
    levels = levels_of(train, contract, columns)
    agencies = sorted({w.without for w in wanted.values() if w.without is not None})
    agency = F.col("agency_code").cast("string") if "agency_code" in train.columns else F.lit(None).cast("string")
    fold = F.coalesce(F.array_position(F.array(*[F.lit(a) for a in agencies]), agency).cast("int") - 1, F.lit(-1)) if agencies else F.lit(-1)
    rows = matrix(train, columns, levels).select(*contract.order, F.col(contract.target).cast("int").alias("_y"), fold.alias("_fold"), agency.alias("_agency"), *[f"x_{c}" for c in columns])
    rows = rows.withColumn("_key", F.xxhash64(*contract.order, "_y", *[f"x_{c}" for c in columns]))
    table = ranks.ranked(rows.where("_y is not null"), [*[F.col(c) for c in contract.order], F.col("_key")], "train")
    cuts = ranks.edges(table, {name: (w.without, EARLY) for name, w in wanted.items()}, "_agency")
    own = {name: F.col("_fold") != agencies.index(w.without) if w.without is not None else F.lit(True) for name, w in wanted.items()}
    y = F.col("_y").cast("long")
    sums = [F.struct(F.sum(o.cast("long")), F.sum(F.when(o, y)), F.sum(F.when(o & (F.col("_pos") > cuts[name]), y))).alias(f"s{k}") for k, (name, o) in enumerate(own.items())]
    counts = {name: tuple(x or 0 for x in row) for name, row in zip(wanted, table.agg(*sums).first(), strict=True)}
    for name, (n, positives, _) in counts.items():
        if not 0 < positives < n:
            raise ValueError(f"one class only{f' for {name}' if name else ''}: {positives} positives of {n} rows")
    calibrated = {name: late >= contract.least_calibration for name, (_, _, late) in counts.items()}
    options = boosting.Options(trees=trees or contract.trees, leaves=leaves or contract.leaves, leaf=leaf or contract.leaf, seed=seed)
    bins = boosting.bins_of(table, columns, {c: len(v) for c, v in levels.items()}, options)
    plans = [
        Plan(agencies.index(w.without) if w.without is not None else None, cuts[name] if calibrated[name] else (1 << 63) - 1, [k for k, c in enumerate(columns) if c not in w.drop])
        for name, w in wanted.items()
    ]
    grown = boosting.grow(table, bins, plans, options)
    later = None
    if any(calibrated.values()):
        later = table.where(F.col("_pos") > min(cuts[n] for n, c in calibrated.items() if c)).select("_pos", "_fold", F.col("_y").cast("double").alias("_y"), boosting.probabilities(grown, columns).alias("_p"))
        later = written(later, "later")
    out = {}
    for k, (name, w) in enumerate(wanted.items()):
        calibrator = None
        if calibrated[name]:
            part = later.where(own[name] & (F.col("_pos") > cuts[name])).select("_y", F.col("_p")[k].alias("_raw"))
            calibrator = IsotonicRegression(featuresCol="_raw", labelCol="_y", predictionCol="_calibrated").fit(part)
        n, positives, _ = counts[name]
        about = {"target": contract.target, "n_train": n, "positives": positives, "calibrated": calibrated[name], "dropped": sorted(w.drop), "absent": lacking, "trees": options.trees, "leaves": options.leaves}
        used = [c for c in columns if c not in w.drop]
        out[name] = Fitted(boosting.narrowed(grown[k], plans[k].columns), calibrator, used, {c: v for c, v in levels.items() if c in used}, rate if contract.sampled else None, about)
    removed(table, *([later] if later is not None else []))
    return out


def fit(train: DataFrame, contract: Contract, drop: tuple[str, ...] = (), rate: float | None = None, **options) -> Fitted:
    return fits(train, contract, {"": Wanted(drop=drop)}, rate, **options)[""]


def score(df: DataFrame, model: Fitted, name: str = "risk") -> DataFrame:
    """df with its risk: the trees' score, calibrated, then with the prior corrected by the model's own sampling rate."""
    out = matrix(df, model.columns, model.levels).withColumn("_raw", boosting.probabilities([model.base], model.columns)[0])
    out = model.calibrator.transform(out) if model.calibrator is not None else out.withColumn("_calibrated", F.col("_raw"))
    risk = metrics.correct_prior("_calibrated", model.rate) if model.rate is not None else F.col("_calibrated")
    return out.withColumns({name: risk, f"{name}_raw": F.col("_raw")}).select(*df.columns, name, f"{name}_raw")


def top_features(model: Fitted, n: int = 15) -> list[tuple[str, int]]:
    """The features with most splits."""
    return sorted(boosting.splits(model.base).items(), key=lambda x: (-x[1], x[0]))[:n]


def save(model: Fitted, spark: SparkSession, path: str, **about) -> None:
    """The trees, the calibrator and a sidecar with bins, levels, columns, sampling rate and what is given about the fit."""
    boosting.save(model.base, spark, f"{path}/base")
    if model.calibrator is not None:
        model.calibrator.write().overwrite().save(f"{path}/calibrator")
    store.write_json(spark, {"base": model.base.base, "edges": model.base.bins.edges, "bins": model.base.bins.sizes, "columns": model.columns, "levels": model.levels, "neg_rate": model.rate, "calibrated": model.calibrator is not None, "about": model.about | about}, f"{path}/model.json")


def load(spark: SparkSession, path: str) -> Fitted:
    side = store.read_json(spark, f"{path}/model.json")
    calibrator = IsotonicRegressionModel.load(f"{path}/calibrator") if side["calibrated"] else None
    base = boosting.load(spark, f"{path}/base", boosting.Bins(side["columns"], side["edges"], side["bins"]), side["base"])
    return Fitted(base, calibrator, side["columns"], side["levels"], side["neg_rate"], side["about"])


def years_of(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.where("fire_year is not null").select("fire_year").distinct().collect())


def season_split(df: DataFrame, test_years: list[int] | None = None) -> tuple[DataFrame, DataFrame, list[int], list[int]]:
    """(train, test, their years): training strictly before the first test season; later seasons are in neither."""
    years = years_of(df)
    if len(years) < 2:
        raise ValueError(f"at least two seasons are needed to hold one out; there are {years}")
    test_years = sorted(test_years or years[-1:])
    before = [y for y in years if y < test_years[0]]
    if not before:
        raise ValueError(f"no season before {test_years[0]} to train on; there are {years}")
    return df.where(F.col("fire_year").isin(before)), df.where(F.col("fire_year").isin(test_years)), before, test_years


def scored_rows(test: DataFrame, model: Fitted, contract: Contract, rate: float | None) -> DataFrame:
    """The test rows' key, agency, y, p, p_raw, p_base and weight."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in contract.order]).alias("key")
    weight = metrics.sample_weight(contract.target, rate) if contract.sampled and rate else F.lit(1.0)
    return score(test, model, "p").select(key, F.col("agency_code").alias("agency_code"), F.col(contract.target).cast("int").alias("y"), "p", F.col("p_raw"), zero_if_missing(test, contract.baseline).alias("p_base"), weight.cast("double").alias("w"))


def scored_split(train: DataFrame, test: DataFrame, contract: Contract, drop: tuple[str, ...] = (), rate: float | None = None, **options) -> tuple[DataFrame, Fitted]:
    """(scored_rows of the test rows, as a table; the model)."""
    model = fit(train, contract, drop, rate, **options)
    return written(scored_rows(test, model, contract, rate), "scored"), model


def summary(scored: DataFrame, train_rate: float, draws: int) -> dict:
    """Accuracy of scored(key, y, p, p_base, w), weighted; intervals if draws are asked for."""
    one = lambda df: df.first()[0]
    n, positives, prevalence = scored.agg(F.count("*"), F.sum("y"), F.sum(F.col("w") * F.col("y")) / F.sum("w")).first()
    if not positives:
        raise ValueError("no positive rows to test on")
    model, base = (one(metrics.average_precision(scored, p=p, w="w")) for p in ("p", "p_base"))
    out = {
        "n_test": n, "n_positives": int(positives), "prevalence": prevalence, "pr_auc_model": model, "pr_auc_base": base, "lift_over_base": model / base if base else None,
        "roc_auc_model": one(metrics.roc_auc(scored, w="w")), "brier_model": metrics.brier(scored, w="w").first().brier,
        "brier_prevalence": metrics.brier(scored.withColumn("p", F.lit(train_rate)), w="w").first().brier,
        "reliability": [r.asDict() for r in metrics.reliability(scored, w="w").orderBy("bucket").collect()],
    }
    return out | ({"ci": metrics.paired_bootstrap(scored, "key", w="w", draws=draws).first().asDict()} if draws else {})


def backtest(df: DataFrame, contract: Contract, test_years: list[int] | None = None, rate: float | None = None, draws: int = 1000, drop: tuple[str, ...] = (), **options) -> tuple[dict, DataFrame]:
    """Season-blocked accuracy, and the scored test rows. rate: at which a sampled table's negatives were drawn."""
    train, test, before, held = season_split(df, test_years)
    scored, model = scored_split(train, test, contract, drop, rate, **options)
    share = model.about["positives"] / model.about["n_train"]
    if contract.sampled and rate:
        share = train.agg(F.sum(metrics.sample_weight(contract.target, rate) * F.col(contract.target)) / F.sum(metrics.sample_weight(contract.target, rate))).first()[0]
    result = {"train_years": before, "test_years": held, "n_train": model.about["n_train"], "positive_rate_train": share, "calibrated": model.about["calibrated"], "top_features": top_features(model)}
    return result | summary(scored, share, draws), scored


def fold_counts(pool: DataFrame, contract: Contract) -> DataFrame:
    """Rows and positives of each agency, most positives first."""
    return pool.groupBy("agency_code").agg(F.count("*").alias("n"), F.sum(F.col(contract.target).cast("long")).alias("positives")).orderBy(F.desc("positives"), "agency_code")


def agency_runs(
    df: DataFrame, contract: Contract, drops: dict[str, tuple[str, ...]], agencies: list[str] | None = None, test_years: list[int] | None = None, least_positives: int = 10, rate: float | None = None, draws: int = 1000, **options
) -> dict[str, tuple[dict, DataFrame]]:
    """Leave one agency out, for each set of dropped features: each fold trains without the agency and tests on it; with test_years it also trains on earlier seasons only.

    All folds of all sets are fitted together. Folds with under ``least_positives`` positives are skipped, with the reason. Returns for each set the folds, their
    pooled and mean accuracy, and the pooled scored rows.
    """
    years = years_of(df)
    before = [y for y in years if y < min(test_years)] if test_years else years
    if not before:
        raise ValueError(f"no season before {min(test_years)} to train on; there are {years}")
    train_pool, test_pool = df.where(F.col("fire_year").isin(before)), df.where(F.col("fire_year").isin(test_years or years))
    counts = {r.agency_code: r for r in fold_counts(test_pool, contract).collect()}
    asked = agencies if agencies is not None else [a for a, r in counts.items() if a is not None and r.positives >= least_positives]
    enough = [a for a in asked if a in counts and counts[a].positives >= least_positives]
    skipped = [{"agency": a, "reason": f"fewer than {least_positives} positives" if a in counts else "no test rows", "positives": counts[a].positives if a in counts else 0} for a in asked if a not in enough]
    if not enough:
        raise ValueError("no agency has enough positives")
    # rows of no agency train no fold
    train = train_pool.where("agency_code is not null")
    models = fits(train, contract, {f"{name}|{a}": Wanted(a, drop) for name, drop in drops.items() for a in enough}, rate, **options)
    out = {}
    for name, drop in drops.items():
        pooled = None
        for a in enough:
            own = scored_rows(test_pool.where(F.col("agency_code") == a), models[f"{name}|{a}"], contract, rate)
            pooled = own if pooled is None else pooled.unionByName(own)
        pooled, folds = written(pooled, "pooled"), []
        for a in enough:
            about = models[f"{name}|{a}"].about
            folds.append({"agency": a, "n_train": about["n_train"], "calibrated": about["calibrated"]} | summary(pooled.where(F.col("agency_code") == a), about["positives"] / about["n_train"], draws))
        mean = lambda k: sum(f[k] for f in folds) / len(folds)  # noqa: B023, E731
        lifts = sorted(f["lift_over_base"] for f in folds if f["lift_over_base"] is not None)
        macro = {
            "pr_auc_model": mean("pr_auc_model"), "pr_auc_base": mean("pr_auc_base"), "folds_beating_base": sum(f["pr_auc_model"] > f["pr_auc_base"] for f in folds), "n_folds": len(folds),
            "median_lift": (lifts[(len(lifts) - 1) // 2] + lifts[len(lifts) // 2]) / 2 if lifts else None,
        }
        mode = "region and season blocked" if test_years else "region blocked"
        result = {"mode": mode, "train_years": before, "folds": folds, "skipped": skipped, "dropped": sorted(drop), "macro": macro, "pooled": summary(pooled, folds[0]["prevalence"], draws)}
        out[name] = result, pooled
    return out


def agency_backtest(df: DataFrame, contract: Contract, agencies: list[str] | None = None, test_years: list[int] | None = None, least_positives: int = 10, drop_geography: bool = False, rate: float | None = None, draws: int = 1000, **options) -> tuple[dict, DataFrame]:
    """agency_runs with all features, or with all but geography."""
    drop = contract.groups["geography"] if drop_geography else ()
    return agency_runs(df, contract, {"run": drop}, agencies, test_years, least_positives, rate, draws, **options)["run"]


def _against(first: DataFrame, other: DataFrame) -> DataFrame:
    """The same rows under two models: p is the other's score, p_base the first's."""
    return other.select("key", "y", "w", "p").join(first.select("key", F.col("p").alias("p_base")), "key")


def ablation(df: DataFrame, contract: Contract, sets: dict[str, list[str]], test_years: list[int] | None = None, rate: float | None = None, draws: int = 1000, **options) -> list[dict]:
    """One refit for each set of left-out groups on one split, all together; each but the first is paired with the first on the same resamples."""
    train, test, *_ = season_split(df, test_years)
    if unknown := {g for groups in sets.values() for g in groups} - set(contract.groups):
        raise ValueError(f"no such feature group: {sorted(unknown)}")
    models = fits(train, contract, {name: Wanted(drop=tuple(sorted({c for g in groups for c in contract.groups[g]}))) for name, groups in sets.items()}, rate, **options)
    out, first = [], None
    for name, model in models.items():
        scored = written(scored_rows(test, model, contract, rate), "scored")
        row = {"set": name, "pr_auc": metrics.average_precision(scored, w="w").first()[0]}
        if first is not None and draws:
            row["against_first"] = metrics.paired_bootstrap(_against(first, scored), "key", w="w", draws=draws).first().asDict()
        first = scored if first is None else first
        out.append(row)
    return out


def feature_sets(contract: Contract) -> dict[str, list[str]]:
    """The sets that an ablation compares: all features, each group left out, and weather and geography left out together where the contract has both.

    Coordinates and dates stand in for much of the weather, so leaving out weather by itself understates what it tells.
    """
    both = {"no weather and no geography": ["weather", "geography"]} if {"weather", "geography"} <= set(contract.groups) else {}
    return {"full": []} | {f"no {g}": [g] for g in contract.groups} | both


def compare_geography(df: DataFrame, contract: Contract, draws: int = 1000, **options) -> dict:
    """Both leave-one-agency-out runs, with and without geography, paired on the rows that they share."""
    runs = agency_runs(df, contract, {"with": (), "without": contract.groups["geography"]}, draws=0, **options)
    pairs = _against(runs["without"][1], runs["with"][1])
    told = {name: run["pooled"]["pr_auc_model"] for name, (run, _) in runs.items()}
    return told | {"n": pairs.count(), "paired": metrics.paired_bootstrap(pairs, "key", w="w", draws=draws).first().asDict() if draws else None}


def fit_final(df: DataFrame, contract: Contract, rate: float | None = None, **options) -> Fitted:
    """On all labelled seasons; refused where positives are too few to mean anything."""
    positives = df.agg(F.sum(F.col(contract.target).cast("long"))).first()[0] or 0
    if positives < contract.least_final:
        raise ValueError(f"{positives} positives; {contract.least_final} are needed")
    model = fit(df, contract, rate=rate, **options)
    return model._replace(about=model.about | {"train_years": years_of(df)})


def score_escalation(model: Fitted, revisions: DataFrame, hotspots: DataFrame, sitreps: DataFrame | None = None, window_days: int = 14, as_of=None) -> DataFrame:
    """Incidents first seen in the last ``window_days`` whose decision instant has come, not yet escalated, by falling risk, with their latest state.

    as_of: by default the last revision's instant; nothing later is read.
    """
    as_of = as_of if as_of is not None else revisions.agg(F.max("record_start")).first()[0]
    now = F.lit(as_of).cast("timestamp_ntz")
    known = asof.at_instants(asof.timeline(revisions.where(F.col("record_start") <= now)), {"decision": tables.DECISION_H})
    known = written(known.where((F.col("t0") >= asof.hours_after(now, -24.0 * window_days)) & (asof.hours_after("t0", tables.DECISION_H) <= now)), "window")
    found = tables.escalation_features(known, hotspots, sitreps).where(f"coalesce(size_at_decision, 0) < {tables.ESCALATED_HA}")
    latest = score(found, model).join(known.select("national_fire_id", "size_now", "status_now"), "national_fire_id", "left")
    kept = [c for c in ("national_fire_id", "t0", "agency_code", "lat", "lon", "size_at_decision", "status_at_decision", "hs_count", "hs_hfi_max", "risk") if c in latest.columns]
    return latest.select(*kept, age_hours("t0", now).alias("age_hours"), "size_now", "status_now").orderBy(F.desc("risk"), "national_fire_id")


def with_latest(rows: DataFrame, revisions: DataFrame) -> DataFrame:
    """rows with the size and status of their incident's last revision."""
    last = revisions.groupBy("national_fire_id").agg(F.max_by(F.struct("fire_size", "stage_of_control_status"), F.struct("record_start", "id")).alias("_l"))
    return rows.join(last.select("national_fire_id", F.col("_l.fire_size").alias("size_now"), F.col("_l.stage_of_control_status").alias("status_now")), "national_fire_id", "left")


def area_days(area: DataFrame, days: DataFrame) -> DataFrame:
    """Every cell on every day; the days, few, go along with each cell."""
    return area.join(F.broadcast(days.select("day").distinct().agg(F.collect_set("day").alias("_days"))), how="cross").withColumn("day", F.explode("_days")).drop("_days")


def score_ignition(model: Fitted, fires: DataFrame, hotspots: DataFrame, observations: DataFrame, day=None, days: int = 1, sitreps: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Every cell of the area of all seasons on every day that can be scored, by day and falling risk."""
    wanted = panel.scoreable_days(observations, day, days)
    if wanted.isEmpty():
        raise ValueError("the stations' record ends before the days asked for")
    events = panel.ignition_events(fires)
    seasons = [r[0] for r in events.select(F.year("day")).where("day is not null").distinct().collect()]
    cells = area_days(panel.study_area(events, hotspots, seasons, edges), wanted)
    out = score(tables.ignition_features(cells, events, hotspots, observations, sitreps), model)
    kept = [c for c in ("cell_x", "cell_y", "day", "lat", "lon", "agency_code", "wx_fwi", "wx_dist_km", "hs_n_7d", "ig_n_365d", "risk") if c in out.columns]
    return out.select(*kept).orderBy("day", F.desc("risk"), "cell_x", "cell_y")
