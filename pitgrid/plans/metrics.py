"""Weighted evaluation of scores, on groups of equal scores so that ties never depend on row order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitgrid.operators import ranks
from pitgrid.plans import resampling
from pitgrid.sources.shared import written


def score_groups(scored: DataFrame, y: str = "y", p: str = "p", w: str | None = None) -> DataFrame:
    """(p, pos, neg): weights of positives and negatives at each distinct score."""
    weight = F.col(w) if w else F.lit(1.0)
    return scored.groupBy(F.col(p).alias("p")).agg(F.sum(F.when(F.col(y) == 1, weight).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0.0).otherwise(weight)).alias("neg"))


def pr_curve(groups: DataFrame, parts: int = 256) -> DataFrame:
    """(p, pos, neg, tp, fp) from the highest score down, over rows of distinct scores.

    The scores are split into ``parts`` ranges that are summed apart; only the ranges' totals pass through one window.
    """
    shares = ", ".join(f"{i / parts}D" for i in range(1, parts))
    edges = groups.agg(F.expr(f"percentile_approx(p, array({shares}))").alias("_e"))
    placed = groups.crossJoin(F.broadcast(edges)).withColumn("_b", F.expr("if(p is null, -1, coalesce(size(filter(_e, e -> e < p)), 0))")).drop("_e")
    above = W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("_b").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    before = totals.select("_b", *[F.coalesce(F.sum(f"_{c}").over(above), F.lit(0.0)).alias(f"_before_{c}") for c in ("pos", "neg")])
    down = W.partitionBy("_b").orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return placed.join(F.broadcast(before), "_b").select("p", "pos", "neg", (F.col("_before_pos") + F.sum("pos").over(down)).alias("tp"), (F.col("_before_neg") + F.sum("neg").over(down)).alias("fp"))


def average_precision(scored: DataFrame, y: str = "y", p: str = "p", w: str | None = None) -> DataFrame:
    return pr_curve(score_groups(scored, y, p, w)).agg(F.coalesce(F.try_divide(F.sum(F.expr("try_divide(pos * tp, tp + fp)")), F.sum("pos")), F.lit(0.0)).alias("average_precision"))


def roc_auc(scored: DataFrame, y: str = "y", p: str = "p", w: str | None = None) -> DataFrame:
    """The weighted share of positive-negative pairs in the right order, ties half."""
    return pr_curve(score_groups(scored, y, p, w)).agg(F.try_divide(F.sum(F.expr("neg * (tp - pos + pos / 2)")), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def brier(scored: DataFrame, y: str = "y", p: str = "p", w: str | None = None) -> DataFrame:
    weight = F.col(w) if w else F.lit(1.0)
    return scored.agg((F.sum(weight * F.pow(F.col(y) - F.col(p), 2)) / F.sum(weight)).alias("brier"), (F.sum(weight * F.col(y)) / F.sum(weight)).alias("prevalence"))


def reliability(scored: DataFrame, y: str = "y", p: str = "p", w: str | None = None, bins: int = 5) -> DataFrame:
    """Quantile buckets (low, high], equal edges merged, empty buckets left out: rows, mean score, mean outcome."""
    weight = F.col(w) if w else F.lit(1.0)
    edges = quantiles(scored, p, [i / bins for i in range(bins + 1)])
    placed = scored.crossJoin(F.broadcast(edges)).withColumn("bucket", F.expr(f"greatest(1, size(filter(_e, e -> e < {p})))"))
    return placed.groupBy("bucket").agg(F.count("*").alias("n"), (F.sum(weight * F.col(p)) / F.sum(weight)).alias("mean_score"), (F.sum(weight * F.col(y)) / F.sum(weight)).alias("mean_outcome"))


def quantiles(scored: DataFrame, p: str, shares: list[float]) -> DataFrame:
    """One row: _e, the distinct linear quantiles. Ranks come from counts of equal scores, so no task sees all rows."""
    groups = pr_curve(scored.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("p")).agg(F.count("*").cast("double").alias("pos"), F.lit(0.0).alias("neg")))
    groups = written(groups.select("p", "pos", "tp"), "ranks")
    n = groups.agg(F.sum("pos")).first()[0] or 0
    at = [s * max(0.0, n - 1) for s in shares]
    asked = F.broadcast(scored.sparkSession.createDataFrame([(i, float(int(a) + k), a - int(a) if k else 1 - a + int(a)) for i, a in enumerate(at) for k in (0, 1)], "i int, rank double, part double"))
    # counted from the lowest score, a group holds the ranks from n - tp on
    found = asked.join(groups, F.expr(f"rank >= {n}D - tp and rank < {n}D - tp + pos"), "left")
    each = found.groupBy("i").agg(F.sum(F.when(F.col("part") > 0, F.col("part") * F.col("p"))).alias("q"))
    return each.agg(F.expr("array_distinct(transform(array_sort(collect_list(struct(i, q))), x -> x.q))").alias("_e"))


def reliability_points(scored: DataFrame, y: str = "y", p: str = "p", bins: int = 8) -> DataFrame:
    """Buckets of about equal counts that never split equal scores: bucket, n, mean_score, mean_outcome.

    A bucket takes max(30, rows / bins) rows and then what equals its last score; a last one of under a third of that joins the one before. Each bucket's end is
    looked for among the totals of ranges of scores, then inside one range. Rows without a score are left out.
    """
    groups = scored.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.count("*").alias("n"), F.sum(F.col(y)).cast("double").alias("k"))
    table = ranks.ranked(groups, [F.col("p")], "scores")
    ranges = [(r["at"], r["n"]) for r in table.groupBy(F.shiftright("_pos", ranks.LOW).alias("at")).agg(F.sum("n").alias("n")).orderBy("at").collect()]
    total = sum(n for _, n in ranges)
    target, ends, sizes, done = max(30, total // bins), [], [], 0
    while done < total:
        wanted, before = min(total, done + target), 0
        for at, n in ranges:
            if before + n >= wanted:
                break
            before += n
        inside = table.where(F.col("_pos").between(at << ranks.LOW, ((at + 1) << ranks.LOW) - 1)).withColumn("upto", F.sum("n").over(W.orderBy("_pos")) + before)
        end, upto = inside.where(F.col("upto") >= wanted).agg(F.min("p"), F.min("upto")).first()
        ends, sizes, done = [*ends, end], [*sizes, upto - done], upto
    if len(sizes) > 1 and sizes[-1] < target // 3:
        ends.pop(-2)
    bucket = F.lit(0)
    for end in ends[:-1]:
        bucket = bucket + (F.col("p") > F.lit(end)).cast("int")
    return table.groupBy(bucket.cast("int").alias("bucket")).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("mean_score"), (F.sum("k") / F.sum("n")).alias("mean_outcome"))


def correct_prior(p: str, rate: float):
    """Undoes sampling of negatives at ``rate`` in a probability."""
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(p)))
    odds = q / (1 - q) * rate
    return odds / (1 + odds)


def sample_weight(y: str, rate: float):
    return F.when(F.col(y) == 1, F.lit(1.0)).otherwise(F.lit(1.0 / rate))


def paired_bootstrap(scored: DataFrame, key: str, y: str = "y", model: str = "p", base: str = "p_base", w: str | None = None, draws: int = 1000, seed: int = 17) -> DataFrame:
    """5th and 95th percentiles of both average precisions and their paired difference over resamples of the rows.

    A resample picks as many rows as there are, with replacement: multinomial counts, the same for both scores, each times the row's weight. ``key`` orders rows
    of equal scores. Draws without positives are skipped; null scores are the least. Without rows all results are null.
    """
    m, b = resampling.paired(scored, key, y, model, base, w, draws, seed)
    edge = lambda x: [float(v) for v in np.percentile(x, [5, 95])] if len(x) else None
    ddl = "model array<double>, base array<double>, delta array<double>, p_better double, draws long"
    return scored.sparkSession.createDataFrame([(edge(m), edge(b), edge(m - b), float((m > b).mean()) if len(m) else None, len(m))], ddl)
