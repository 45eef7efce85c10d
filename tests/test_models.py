"""Model contracts, fits, backtests and scoring on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pitgrid.plans import metrics, models, resampling, serving
from pitgrid.plans.views import view
from pitgrid.sources import tables

SMALL = {"trees": 5, "leaves": 8}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        agency, year = rng.choice(["AB", "BC", "ON", None]), rng.choice([2022, 2023, 2024])
        heat, size = rng.random() * 100, rng.choice([None, rng.random() * 50])
        p = 0.02 + 0.5 * (heat > 70) + (0.2 if agency == "AB" else 0)
        rows.append((f"F{i}", agency, rng.choice(["OC", "UC"]), size, heat if i % 9 else None, float("nan") if i % 7 == 0 else 50.0, year, int(rng.random() < p), 5, i * 3600))
    return spark.createDataFrame(rows, "national_fire_id string, agency_code string, status_at_decision string, size_at_decision double, hs_hfi_max double, lat double, fire_year int, escalated int, n_revisions long, s long").withColumn("t0", F.expr("make_timestamp_ntz(fire_year, 5, 1, 0, 0, 0) + make_dt_interval(0, 0, 0, s)")).drop("s")


def test_forbidden_features_and_missing_values(spark, table):
    c = models.ESCALATION
    assert models.features(table, c) == ["size_at_decision", "hs_hfi_max", "lat", "agency_code", "status_at_decision"]
    with pytest.raises(ValueError, match="leakage"):
        models.features(table, c._replace(numeric=("n_revisions",)))
    assert len(c.numeric) == 34 and len(c.categorical) == 6 and len(models.IGNITION.numeric) == 51
    columns = models.features(table, c, ("lat",))
    levels = models.levels_of(table.where("agency_code <> 'ON'"), c, columns)
    assert levels["agency_code"] == ["AB", "BC"]
    got = {(r.agency_code, r.x_agency_code) for r in models.matrix(table, columns, levels).collect()}
    assert got == {("AB", 1.0), ("BC", 2.0), ("ON", 0.0), (None, 0.0)}
    assert models.matrix(table, ["lat"], {}).where("isnan(lat)").select("x_lat").distinct().collect()[0][0] == models.MISSING
    with pytest.raises(ValueError, match="lacks"):
        models.matrix(table, ["nothing"], {})


def test_backtest_is_season_blocked_and_order_free(spark, table, tmp_path):
    result, scored = models.backtest(table, models.ESCALATION, draws=40, **SMALL)
    assert result["train_years"] == [2022, 2023] and result["test_years"] == [2024] and result["n_test"] == table.where("fire_year = 2024").count()
    assert result["pr_auc_model"] > result["pr_auc_base"] and result["calibrated"] and result["ci"]["draws"] == 40 and {x[0] for x in result["top_features"][:2]} & {"hs_hfi_max"}
    again, _ = models.backtest(table.orderBy(F.rand(5)), models.ESCALATION, draws=0, **SMALL)
    assert math.isclose(again["pr_auc_model"], result["pr_auc_model"], rel_tol=1e-9)
    early, _ = models.backtest(table, models.ESCALATION, test_years=[2023], draws=0, **SMALL)
    assert early["train_years"] == [2022] and early["n_test"] == table.where("fire_year = 2023").count()
    with pytest.raises(ValueError, match="two seasons"):
        models.backtest(table.where("fire_year = 2024"), models.ESCALATION, **SMALL)
    rows = models.ablation(table, models.ESCALATION, {"full": [], "no hotspots": ["hotspots"]}, draws=20, **SMALL)
    assert rows[1]["pr_auc"] < rows[0]["pr_auc"] and rows[1]["against_first"]["delta"][1] < 0


def test_agency_folds_and_saved_models(spark, table, tmp_path):
    result, pooled = models.agency_backtest(table, models.ESCALATION, agencies=["AB", "BC", "XX"], draws=0, **SMALL)
    assert [f["agency"] for f in result["folds"]] == ["AB", "BC"] and result["skipped"][0] == {"agency": "XX", "reason": "no test rows", "positives": 0}
    assert pooled.count() == table.where("agency_code in ('AB', 'BC')").count() and result["pooled"]["n_test"] == pooled.count()
    thin, _ = models.agency_backtest(table, models.ESCALATION, agencies=["AB", "ON"], least_positives=models.fold_counts(table, models.ESCALATION).where("agency_code = 'AB'").first().positives, draws=0, **SMALL)
    assert [x["agency"] for x in thin["skipped"]] == ["ON"]
    model = models.fit_final(table, models.ESCALATION, **SMALL)
    models.save(model, spark, f"file://{tmp_path}/m", trained_at="2024-01-01")
    back = models.load(spark, f"file://{tmp_path}/m")
    a, b = (models.score(table, m).agg(F.sum("risk")).first()[0] for m in (model, back))
    assert math.isclose(a, b) and back.levels == model.levels and back.about["train_years"] == [2022, 2023, 2024]
    with pytest.raises(ValueError, match="are needed"):
        models.fit_final(table.where("escalated = 0"), models.ESCALATION, **SMALL)
    assert serving.models(spark, {"escalation": f"file://{tmp_path}/m/model.json", "other": f"file://{tmp_path}/none.json"})["escalation"]["about"]["trained_at"] == "2024-01-01"
    told = serving.artefacts(spark, {"model": f"file://{tmp_path}/m", "none": f"file://{tmp_path}/none"})
    assert told["none"] == {"built": False} and told["model"]["built"] and told["model"]["bytes"] > 100


def test_escalation_scoring_end_to_end(spark):
    d = "/root/testdata/sf0.001"
    r, h, s = (view(spark, d, n) for n in ("revisions", "hotspots", "sitreps"))
    from pitgrid.plans import tables as plans

    train = plans.escalation(r, h, s).withColumn("fire_year", F.lit(2024))
    model = models.fit(train, models.ESCALATION, **SMALL)
    out = models.score_escalation(model, r, h, s, window_days=30).collect()
    assert out and all(0 <= x.risk <= 1 and x.age_hours >= 24 for x in out) and [x.risk for x in out] == sorted((x.risk for x in out), reverse=True)
    early = r.agg(F.expr("min(record_start) + interval 10 days")).first()[0]
    before = models.score_escalation(model, r, h, s, window_days=30, as_of=early)
    assert before.agg(F.max("t0")).first()[0] <= early and before.count() < len(out)


def test_ignition_scoring_corrects_the_prior(spark):
    d = "/root/testdata/sf0.001"
    r, h, o = (view(spark, d, n) for n in ("revisions", "hotspots", "obs"))
    from pitgrid.plans import tables as plans

    days = spark.sql("select explode(sequence(date'2024-01-05', date'2024-01-28')) as day")
    table = plans.ignition(r, h, o, days, [2024], rate=0.2).withColumn("fire_year", F.year("day"))
    model = models.fit(table, models.IGNITION, rate=0.2, **SMALL)
    assert model.rate == 0.2
    out = models.score_ignition(model, r, h, o, days=2)
    got = out.collect()
    assert {str(x.day) for x in got} == {"2024-01-30", "2024-01-31"} and len({(x.cell_x, x.cell_y, x.day) for x in got}) == len(got)
    plain = models.score_ignition(model._replace(rate=None), r, h, o, days=2).agg(F.avg("risk")).first()[0]
    assert out.agg(F.avg("risk")).first()[0] < plain
    with pytest.raises(ValueError, match="record ends"):
        models.score_ignition(model, r, h, o, day="2025-01-01")


def test_bootstrap_against_a_plain_resample(spark, monkeypatch):
    import numpy as np

    rng = random.Random(2)
    rows = [(f"k{i:03d}", int(rng.random() < 0.2), rng.choice([round(rng.random(), 1), 0.5, None]), round(rng.random(), 2), rng.choice([1.0, 20.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, y int, p double, p_base double, w double").repartition(7)
    # rows of the model's order, each picked as often as its count says: weights are indices
    order = sorted(rows, key=lambda r: (-(r[2] if r[2] is not None else -math.inf), r[0]))
    picks = resampling.counts(np.arange(400), 400, np.arange(41), 17)
    assert (picks.sum(0) == 400).all() and (picks >= 0).all() and (resampling.counts(np.array([7, 3, 399]), 400, np.arange(41), 17) == picks[[7, 3, 399]]).all()
    low = lambda v: -math.inf if v is None else v
    draws = []
    for d in range(41):
        picked = [order[i] for i in np.repeat(np.arange(400), picks[:, d].astype(int))]
        ap = []
        for col in (2, 3):
            tp = seen = gain = 0.0
            for s in sorted({low(r[col]) for r in picked}, reverse=True):
                own = [(r[4], r[1]) for r in picked if low(r[col]) == s]
                pos = sum(x for x, y in own if y)
                tp, seen = tp + pos, seen + sum(x for x, _ in own)
                gain += pos * tp / seen
            ap.append(gain / tp)
        draws.append(ap)
    x = np.array(draws)
    for few in (1 << 15, 9):
        make = resampling._ranges

        def small(batches, *rest, few=few, make=make):
            resampling.ROWS = few
            return make(batches, *rest)

        monkeypatch.setattr(resampling, "_ranges", small)
        got = metrics.paired_bootstrap(df, "k", w="w", draws=41).first()
        monkeypatch.undo()
        assert np.allclose(got.model, np.percentile(x[:, 0], [5, 95])) and np.allclose(got.base, np.percentile(x[:, 1], [5, 95])) and np.allclose(got.delta, np.percentile(x[:, 0] - x[:, 1], [5, 95])) and got.draws == 41
    same = metrics.paired_bootstrap(df.withColumn("p_base", F.col("p")), "k", draws=12).first()
    assert same.delta == [0.0, 0.0] and same.p_better == 0
    none = metrics.paired_bootstrap(df.where("y = 0"), "k", draws=5).first()
    assert (none.draws, none.model) == (0, None) and metrics.paired_bootstrap(df.limit(0), "k", draws=5).first().draws == 0


def test_counts_are_multinomial():
    import numpy as np

    n, draws = 50, 20_000
    picks = resampling.counts(np.arange(n), n, np.arange(draws), 3)
    # a row's count is binomial (n, 1 / n); two rows' counts have the covariance -1 / n
    for k in range(4):
        assert math.isclose((picks == k).mean(), math.comb(n, k) * (1 / n) ** k * (1 - 1 / n) ** (n - k), rel_tol=0.03)
    assert abs(np.cov(picks[0], picks[1])[0, 1] + 1 / n) < 0.03 and abs(np.cov(picks[3], picks[40])[0, 1] + 1 / n) < 0.03
    big = resampling.binomials(np.full((1, 400), 3e6), np.array([[0.25]]), (np.arange(400)[None, :] + 0.5) / 400)
    assert abs(big.mean() - 750_000) < 40 and math.isclose(big.std(), (3e6 * 0.25 * 0.75) ** 0.5, rel_tol=0.02)


def test_quantiles_and_points(spark):
    import numpy as np

    rng = random.Random(4)
    p = [0.0] * 120 + [round(rng.random(), 2) for _ in range(200)]
    rows = [(x, int(rng.random() < x)) for x in p]
    df = spark.createDataFrame(rows, "p double, y int").repartition(3)
    got = metrics.quantiles(df, "p", [0, 0.2, 0.4, 0.6, 0.8, 1]).first()[0]
    assert np.allclose(got, sorted(set(np.percentile(p, [0, 20, 40, 60, 80, 100]))))
    points = metrics.reliability_points(df).orderBy("bucket").collect()
    want, held = [], []
    for score in sorted(set(p)):  # whole groups of equal scores until a bucket is full
        held += [r for r in rows if r[0] == score]
        if len(held) >= max(30, len(p) // 8):
            want, held = [*want, held], []
    if held:
        want[-1:] = [want[-1] + held] if len(held) < max(30, len(p) // 8) // 3 else [want[-1], held]
    assert [(r.n, round(r.mean_score, 9), round(r.mean_outcome, 9)) for r in points] == [(len(b), round(sum(x for x, _ in b) / len(b), 9), round(sum(y for _, y in b) / len(b), 9)) for b in want]
    assert metrics.reliability_points(df.limit(0)).count() == 0
    assert points[0].n >= 120 and points[0].mean_score == 0 and sum(r.n for r in points) == len(p) and all(r.n >= 13 for r in points)
    assert math.isclose(sum(r.n * r.mean_outcome for r in points), sum(y for _, y in rows))
    assert tables.exists(spark, "/nowhere") is False


def test_nth_and_top_share_without_a_sort(spark, monkeypatch):
    from pitgrid.operators import ranks

    rng = random.Random(7)
    rows = [(rng.choice([0.5, 0.5, rng.random(), 1e-300 * rng.random()]), (1 << 62) + rng.randint(0, 9000), i) for i in range(6000)] + [(None, 1, 2)]
    df = spark.createDataFrame(rows, "risk double, big long, i int").repartition(5)
    monkeypatch.setattr(ranks, "FEW", 50)
    monkeypatch.setattr(ranks, "BUCKETS", 16)
    order = sorted(rows[:-1], key=lambda r: (-r[0], r[1], r[2]))
    for k in (1, 700, 2500, 5999, 6000):
        assert tuple(ranks.nth(df, [("risk", True), ("big", False), ("i", False)], k)) == order[k - 1]
    assert ranks.nth(df, [("risk", True)], 6001) == [None]
    got = serving.top_share(df.where("risk is not null"), ties=("big", "i"), day=None).collect()
    low = sorted(r[0] for r in rows[:-1])
    cuts = [low[int(q * 5999 + 0.5)] for q in (0.995, 0.98)]
    assert sorted(map(tuple, got), key=str) == sorted(((*r, sum(r[0] < c for c in cuts)) for r in order[:480]), key=str)


def test_bootstrap_deals_rows_by_work_and_looks_counts_up(spark, monkeypatch):
    import numpy as np

    cores, seen = spark.sparkContext.defaultParallelism, {}
    told = resampling.precisions
    monkeypatch.setattr(resampling, "precisions", lambda table, *a: seen.setdefault(len(seen), table.select("_pos").where("_pos & 8589934591 = 0").count()) and told(table, *a))
    monkeypatch.setattr(resampling, "LEAST", 150)
    df = spark.range(3000).selectExpr("id", "cast(id % 9 = 0 as int) as y", "id * 37 % 1009 / 1009 as p", "id * 31 % 97 / 97 as p_base")
    assert metrics.paired_bootstrap(df, "id", draws=2).first().draws == 2
    # 3,000 rows are few bytes: they were one range, and one task's
    assert set(seen.values()) == {min(cores, 20)}
    assert [resampling.ranges_of(n, 12) for n in (0, 1024, 5000, 200_000, 1_200_000, 1 << 40)] == [1, 7, 12, 12, 37, 2000]
    # each count is the first k whose running chance reaches u
    rng = np.random.default_rng(4)
    for n, p in ((rng.integers(0, 30, (50, 40)), 0.5), (rng.integers(0, 2_000_000, (3, 5)), 3 / 7), (np.full((2, 9), 1000), 0.01)):
        u = rng.random(n.shape)
        got = resampling.binomials(n.astype(float), np.full((len(n), 1), p), u)
        for k, size, v in zip(got.ravel(), n.ravel().tolist(), u.ravel().tolist(), strict=True):
            low = max(0, math.floor(size * p - 9 * math.sqrt(size * p * (1 - p)) - 10))
            chance = math.exp(math.lgamma(size + 1) - math.lgamma(low + 1) - math.lgamma(size - low + 1) + low * math.log(p) + (size - low) * math.log(1 - p))
            total = chance
            while total < v and low < size:
                chance *= (size - low) / (low + 1) * (p / (1 - p))
                low, total = low + 1, total + chance
            assert k == low
