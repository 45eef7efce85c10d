"""Boosted trees against a plain one-process fit, over any partitions, and side by side."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitgrid.operators import ranks
from pitgrid.plans import boosting, models
from pitgrid.plans.boosting import MISSING, Options, Plan

NAMES = ["a", "b", "c", "kind"]
OPTIONS = Options(trees=13, leaves=9, leaf=12, step=0.2, sample=100_000)
EVER = (1 << 63) - 1


def data(n=700):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        a, b, kind = rng.choice([MISSING, rng.random()]) if i % 3 == 0 else rng.random(), float(rng.randint(0, 400)), rng.randint(0, 6)
        p = 0.1 + 0.4 * (a > 0.6) + 0.3 * (kind in (1, 4)) + 0.15 * (b > 250) * (a == MISSING)
        rows.append((i, int(rng.random() < p), rng.randint(0, 3) if i % 11 else -1, hash((i, 5)) % (1 << 60), a, b, float(rng.randint(0, 2)), float(kind)))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(data(), "_pos long, _y int, _fold int, _key long, x_a double, x_b double, x_c double, x_kind double").repartition(5)


@pytest.fixture(scope="module")
def bins(frame):
    return boosting.bins_of(frame, NAMES, {"kind": 6}, OPTIONS)


def plain(rows, bins, plan, o):
    """Scores of all rows: every split of every leaf is tried on the rows themselves."""
    x = boosting.binned([np.array([r[4 + k] for r in rows]) for k in range(4)], bins)
    y, keys, pos, fold = (np.array([r[k] for r in rows]) for k in (1, 3, 0, 2))
    own = (pos <= plan.upto) & ((fold != plan.without) if plan.without is not None else True)
    scores = np.full(len(rows), math.log(y[own].sum() / (own.sum() - y[own].sum())))
    for t in range(o.trees):
        bag, columns = own & boosting.drawn(keys.astype(np.uint64), o.seed, t, o.rows), boosting.columns_of(plan, o, t)
        p = 1 / (1 + np.exp(-scores))
        g, h = np.rint((p - y) * 2**30) / 2**30, np.rint(p * (1 - p) * 2**30) / 2**30

        def best(leaf):
            found, rows_in = (0.0,), leaf & bag
            score = lambda m, more=0.0: g[m].sum() ** 2 / (h[m].sum() + o.l2 + more)
            for c in columns:
                v = x[:, c]
                nominal, gone = bins.edges[c] is None, v == 0
                order = [k for k in range(1, bins.sizes[c]) if not nominal or (rows_in & (v == k)).any()]
                if nominal:
                    order.sort(key=lambda k: g[rows_in & (v == k)].sum() / (h[rows_in & (v == k)].sum() + o.category_smooth))
                for cut in range(1, len(order) + 1):
                    head = np.isin(v, order[:cut])
                    for to_left in ((False, True) if (rows_in & gone).any() else (False,)):
                        left = head | (gone & to_left)
                        inside, rest = rows_in & left, rows_in & ~left
                        if min(inside.sum(), rest.sum()) < o.leaf or min(h[inside].sum(), h[rest].sum()) < o.least_hessian:
                            continue
                        more = o.category_l2 if nominal else 0.0
                        gain = score(inside, more) + score(rest, more) - score(rows_in)
                        if gain > found[0] + 1e-12:
                            default = to_left if (rows_in & gone).any() else inside.sum() > rest.sum()
                            side = head | (gone & default)
                            if nominal:
                                side |= np.isin(v, [k for k in range(1, bins.sizes[c]) if k not in order]) & default
                            found = gain, side
            return found

        leaves = [(np.ones(len(rows), bool), best(np.ones(len(rows), bool)))]
        while len(leaves) < o.leaves:
            k = max(range(len(leaves)), key=lambda k: leaves[k][1][0])
            leaf, split = leaves[k]
            if len(split) == 1:
                break
            parts = leaf & split[1], leaf & ~split[1]
            leaves[k : k + 1] = [(part, best(part)) for part in parts]
        for leaf, _ in leaves:
            scores[leaf] += -o.step * g[leaf & bag].sum() / (h[leaf & bag].sum() + o.l2)
    return 1 / (1 + np.exp(-scores))


def same(a, b):
    return a.base == b.base and len(a.trees) == len(b.trees) and all(np.array_equal(x, y) for s, t in zip(a.trees, b.trees, strict=True) for x, y in zip(s, t, strict=True))


def test_equals_a_plain_fit(frame, bins):
    rows = data()
    for plan in (Plan(None, EVER, [0, 1, 2, 3]), Plan(2, 499, [0, 1, 3])):
        model = boosting.grow(frame, bins, [plan], OPTIONS)[0]
        got = {r._pos: r.p for r in frame.select("_pos", boosting.probabilities([model], NAMES)[0].alias("p")).collect()}
        assert np.allclose([got[r[0]] for r in rows], plain(rows, bins, plan, OPTIONS), atol=1e-9)
        assert max(len(t.value) for t in model.trees) == 2 * OPTIONS.leaves - 1


def test_trees_depend_on_neither_partitions_nor_neighbours(frame, bins, monkeypatch):
    plans = [Plan(None, EVER, [0, 1, 2, 3]), *[Plan(k, 560, [0, 1, 2, 3]) for k in range(3)], Plan(None, 560, [1, 2])]
    alone = [boosting.grow(frame, bins, [p], OPTIONS)[0] for p in plans]
    assert all(same(a, b) for a, b in zip(alone, boosting.grow(frame, bins, plans, OPTIONS), strict=True))
    calls = []
    passes = boosting._pass
    monkeypatch.setattr(boosting, "_pass", lambda *a: calls.append(a[4]) or passes(*a))
    monkeypatch.setattr(boosting, "TASK_BYTES", 500)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 37)
    frame.sparkSession.conf.set("spark.sql.files.openCostInBytes", "64m")
    try:
        few = OPTIONS._replace(trees=11)
        together = boosting.grow(frame.orderBy(F.desc("x_b")).repartition(6), bins, plans, few)
    finally:
        frame.sparkSession.conf.unset("spark.sql.files.openCostInBytes")
    assert all(same(a._replace(trees=a.trees[:11]), b) for a, b in zip(alone, together, strict=True))
    # a pass serves all models: no more than the deepest tree of each round needs
    assert len(calls) > 11 and max(calls.count(k) for k in range(11)) <= OPTIONS.leaves


def test_passes_have_a_task_for_each_core_and_scores_of_all_trees_before(frame, bins, monkeypatch):
    states, passes = {}, boosting._pass

    def told(state, plans, trees, asked, number, *rest):
        assert not any(trees), "trees are applied once for a tree, not in each of its passes"
        states.setdefault(number, state)
        if number == 3 and number not in dealt:
            dealt[number] = state.map(lambda b: len(b[1])).glom().map(sum).collect()
        return passes(state, plans, trees, asked, number, *rest)

    dealt = {}
    monkeypatch.setattr(boosting, "_pass", told)
    monkeypatch.setattr(boosting, "TASK_BYTES", 2000)
    cores = frame.sparkSession.sparkContext.defaultParallelism
    model = boosting.grow(frame, bins, [Plan(None, EVER, [0, 1, 2, 3])], OPTIONS._replace(trees=12))[0]
    assert len(model.trees) == 12 and sum(dealt[3]) == 700
    # 2,800 values, 125 to a task at least: not the two tasks of up to 2,000 that they fill
    assert len(dealt[3]) == min(cores, 23) and min(dealt[3]) > 700 / len(dealt[3]) / 2
    assert len({id(s) for s in states.values()}) == 12
    assert [boosting.tasks_of(n, 12) for n in (0, 2000, 2001, 2600, 40_000)] == [1, 1, 12, 12, 20]


def test_bins_of_a_bounded_sample(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=5000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "_key long, x_v double")
    whole = boosting.bins_of(df, ["v"], {}, OPTIONS)
    counts = np.bincount(boosting.binned([x], whole)[:, 0])
    assert whole.sizes == [255] and counts[0] == 0 and counts[1:].max() <= 3 * 5000 / 254
    part = boosting.bins_of(df.repartition(9), ["v"], {}, OPTIONS._replace(sample=500))
    assert part == boosting.bins_of(df.orderBy("x_v"), ["v"], {}, OPTIONS._replace(sample=500)) and part.edges != whole.edges
    assert boosting.bins_of(df.limit(0), ["v"], {}, OPTIONS).sizes == [2]


def test_edges_by_place(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 40), rng.choice(["p", "q", None]), i) for i in range(5000)]
    table = ranks.ranked(spark.createDataFrame(rows, "day int, g string, i int").repartition(7), [F.col("day"), F.col("i")], "places")
    at = ranks.edges(table, {"all": (None, 0.75), "p": ("p", 0.75), "none": (None, 0.0), "whole": ("q", 1.0)}, "g")
    got = [(r.day, r.g, r.i) for r in table.orderBy("_pos").collect()]
    assert got == sorted(rows, key=lambda r: (r[0], r[2])) and at["none"] == -1
    pos = {r.i: r._pos for r in table.collect()}
    for name, without, share in (("all", "-", 0.75), ("p", "p", 0.75), ("whole", "q", 1.0)):
        own = [r for r in got if r[1] != without]
        assert at[name] == pos[own[int(share * len(own)) - 1][2]]


def test_unseen_levels_count_as_missing_and_absent_columns_are_told(spark, caplog):
    rows = [(f"F{i}", ["AB", "BC", None][i % 3], float(i % 50), 2024, int(i % 3 == 0 or i % 50 > 45)) for i in range(600)]
    df = spark.createDataFrame(rows, "national_fire_id string, agency_code string, size_at_decision double, fire_year int, escalated int").withColumn("t0", F.expr("timestamp_ntz'2024-05-01 00:00:00' + make_dt_interval(0, 0, cast(substring(national_fire_id, 2) as int) div 4)"))
    model = models.fit(df, models.ESCALATION, trees=8, leaves=4)
    assert "hs_count" in model.about["absent"] and "lacks" in caplog.text
    probe = spark.createDataFrame([("x", a, 3.0) for a in (None, "ZZ")], "national_fire_id string, agency_code string, size_at_decision double")
    a, b = (r.risk_raw for r in models.score(probe, model).orderBy(F.col("agency_code").isNull()).collect())
    assert a == b


def test_one_task_reads_a_leafs_rows_from_its_parent(frame, bins, monkeypatch):
    """Rows went from the root to their leaves in each pass; a tree of one task counts them once a level, and goes by whole trees for scores only."""
    rows, walked = data(), []
    x = boosting.binned([np.array([r[4 + k] for r in rows]) for k in range(4)], bins).T
    y, key, pos, fold = (np.array([r[k] for r in rows], t) for k, t in ((1, np.int8), (3, np.uint64), (0, np.int64), (2, np.int16)))
    plans = [Plan(None, EVER, [0, 1, 2, 3]), Plan(2, 499, [0, 1, 3])]
    cut = [(x[:, s], y[s], pos[s], key[s], fold[s], np.zeros((2, len(y[s])))) for s in (slice(0, 300), slice(300, 700))]
    parted = boosting.parted
    monkeypatch.setattr(boosting, "parted", lambda tree, *a: walked.append(len(tree.children)) or parted(tree, *a))
    starts = np.append(0, np.cumsum(bins.sizes))
    got = boosting._in_one_task(cut, plans, range(3), OPTIONS, bins, starts)
    assert len(walked) == 6 and [len(t.value) for own in got for t in own] == [2 * OPTIONS.leaves - 1] * 6
    # the passes' own sums
    none, whole = [[], []], tuple(np.concatenate(p, axis=-1) for p in zip(*cut, strict=True))
    for number in range(3):
        want = boosting._trees(plans, bins, starts, OPTIONS, number, lambda asked, k=number, w=whole: boosting._added(w, plans, none, asked, k, OPTIONS, starts))
        assert all(np.array_equal(a, b) for own, tree in zip(got, want, strict=True) for a, b in zip(own[number], tree, strict=True))
        whole = boosting._advanced(whole, [[t] for t in want])
