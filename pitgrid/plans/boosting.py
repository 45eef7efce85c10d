"""Gradient-boosted trees for a yes or no, grown leaf by leaf from histograms that are added up over partitions.

Features are binned once: numbers by quantiles of a bounded sample, categories one bin a level, bin 0 for what is missing. A pass over the binned blocks adds up counts,
gradients and Hessians of the asked leaves, for all models together; the driver keeps trees and histograms only. The best-first order asks for one
leaf after the other, but a leaf that it can still take is among the best of the present ones, as many as splits are left: those are asked for in one pass, so a
tree takes about as many passes as it is deep. Of two children the smaller is counted, the other is the parent less it. Where all blocks are one task's, each model
has a task that has all its sums and runs the same steps without a pass for each.

Sums are of integers (gradients in units of 2^-30), rows are drawn by hashes of their keys: trees do not depend on partitions or the order of rows, nor on the models
that are grown beside them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgrid.sources.shared import removed, written

MISSING = -1e9
UNIT = float(1 << 30)
MAX_BINS = 255
#: Rows in a block, bytes of bins that a task is dealt at most, and parts of that which are worth a task of their own where cores are free.
BLOCK_ROWS, TASK_BYTES, SMALL = 1 << 16, 16 << 20, 16
#: Passes ask for so many leaves of a model at once. Scores are held for one tree's passes, and stored for good when so many trees have come together.
WIDTH, KEPT = 16, 10
#: Sums of up to so many tasks and models are added up by the driver, more by a tree of tasks.
DIRECT = 24


class Options(NamedTuple):
    trees: int = 400
    leaves: int = 31
    leaf: int = 30  # rows in a leaf
    step: float = 0.05
    rows: float = 0.9  # share of rows that a tree sees
    columns: float = 0.8  # share of columns that a tree may split on
    l2: float = 1.0
    category_l2: float = 10.0  # besides l2, for splits of categories
    category_smooth: float = 10.0  # categories are put in order of gradient / (Hessian + this)
    least_hessian: float = 1e-3
    sample: int = 200_000  # rows whose values make the bins, those with the least hashes
    seed: int = 17


class Bins(NamedTuple):
    """Of every column: its edges (numbers) or None (categories, numbered from 1), and how many bins it has."""

    names: list[str]
    edges: list[list[float] | None]
    sizes: list[int]


class Plan(NamedTuple):
    """One model: the fold that it leaves out, the last place (_pos) that it learns from, and the columns that it may use."""

    without: int | None
    upto: int
    columns: list[int]


class Tree(NamedTuple):
    """Node 0 is the root. A leaf leads to itself. left: for each node the bins that go left."""

    feature: np.ndarray
    left: np.ndarray
    children: np.ndarray
    value: np.ndarray
    depth: int


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(keys: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    salt = mixed(np.array([seed * 1_000_003 + tree + 1], np.uint64))
    return np.ones(len(keys), bool) if share >= 1 else mixed(keys ^ salt) < np.uint64(int(share * (1 << 64)))


def columns_of(plan: Plan, options: Options, tree: int) -> np.ndarray:
    """The columns that a tree may use: a share of the plan's, by hashes."""
    own = np.array(plan.columns, np.int64)
    order = np.argsort(mixed(own.astype(np.uint64) ^ mixed(np.array([options.seed * 7_368_787 + tree], np.uint64))), kind="stable")
    return np.sort(own[order[: max(1, int(round(options.columns * len(own))))]])


def bins_of(rows: DataFrame, names: list[str], levels: dict[str, int], options: Options) -> Bins:
    """rows(_key, x_...): edges from at most about ``sample`` rows, those whose hashed _key is under a bound."""
    n = rows.count()
    numbers = [c for c in names if c not in levels]
    bound = F.lit(min((1 << 63) - 1, int(options.sample / max(1, n) * (1 << 63))))
    values = rows.where(F.expr("xxhash64(_key, 5) & 9223372036854775807") <= bound).select(*[f"x_{c}" for c in numbers]).toArrow() if numbers else None
    edges, sizes = [], []
    for c in names:
        if c in levels:
            edges.append(None)
            sizes.append(levels[c] + 1)
            continue
        v = np.sort(values.column(f"x_{c}").to_numpy())
        v = v[v != MISSING]
        distinct = np.unique(v)
        if len(distinct) < MAX_BINS:
            own = (distinct[:-1] + distinct[1:]) / 2
        else:
            own = np.unique(v[np.arange(1, MAX_BINS - 1) * len(v) // (MAX_BINS - 1)])
        edges.append(own.tolist())
        sizes.append(len(own) + 2)
    return Bins(names, edges, sizes)


def binned(columns: list[np.ndarray], bins: Bins) -> np.ndarray:
    """Values (MISSING or 0 for what is missing) -> their bins, a row each."""
    kind = np.uint8 if max(bins.sizes, default=0) <= 256 else np.uint16
    out = np.zeros((len(columns[0]) if columns else 0, len(columns)), kind)
    for k, (v, e, size) in enumerate(zip(columns, bins.edges, bins.sizes, strict=True)):
        out[:, k] = np.where(v < size, v, 0) if e is None else np.where(v == MISSING, 0, np.searchsorted(e, v) + 1)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], bins: Bins) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = binned([batch.column(f"x_{c}").to_numpy() for c in bins.names], bins)
            parts = rows.T, *(batch.column(c).to_numpy() for c in ("_y", "_pos", "_key", "_fold"))
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int32()), "wide": pa.array([rows.dtype.itemsize], pa.int32()), "task": pa.array([TaskContext.get().partitionId()], pa.int32()), **{f"b{k}": [np.ascontiguousarray(p).tobytes()] for k, p in enumerate(parts)}})


def _decoded(row) -> tuple:
    """(bins with a row for each column, y, pos, key, fold)."""
    kind = np.uint8 if row["wide"] == 1 else np.uint16
    rows, y, pos, key, fold = (np.frombuffer(row[f"b{k}"], t) for k, t in enumerate((kind, np.int8, np.int64, np.int64, np.int16)))
    return rows.reshape(-1, row["n"]), y, pos, key.view(np.uint64), fold


def parted(tree: Tree, columns: np.ndarray, some: np.ndarray, leaves: list[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, those of the rows ``some`` that come to it), for all leaves or the given ones: each node divides its own rows only."""
    wanted = None
    if leaves is not None:
        wanted = set(leaves)
        # children come after their parents
        for i in range(len(tree.children) - 1, -1, -1):
            if not wanted.isdisjoint(tree.children[i].tolist()):
                wanted.add(i)
    going = [(0, some)]
    while going:
        node, at = going.pop()
        if wanted is not None and node not in wanted:
            continue
        left, right = tree.children[node].tolist()
        if left == node:
            yield node, at
        elif len(at):
            side = tree.left[node][columns[tree.feature[node]][at]]
            going += [(left, at[side]), (right, at[~side])]


def _advanced(block: tuple, trees: list[list[Tree]]) -> tuple:
    *rest, scores = block
    scores, every = scores.copy(), np.arange(len(block[1]))
    for k, own in enumerate(trees):
        for tree in own:
            for node, at in parted(tree, block[0], every):
                scores[k, at] += tree.value[node]
    return *rest, scores


class Asked(NamedTuple):
    """What a pass adds up for one model: the leaves (nodes of its tree so far) and the columns."""

    tree: Tree
    leaves: list[int]
    columns: np.ndarray


def _added(block: tuple, plans: list[Plan], trees: list[list[Tree]], asked: list[Asked | None], number: int, options: Options, starts: np.ndarray) -> list[np.ndarray | None]:
    """Counts, gradients and Hessians (3, leaves, bins of all columns) of a block, for each model."""
    columns, y, pos, key, fold, _ = block
    scores = _advanced(block, trees)[-1]
    bag = drawn(key, options.seed, number, options.rows)
    out = []
    for k, ask in enumerate(asked):
        if ask is None:
            out.append(None)
            continue
        plan = plans[k]
        some = np.flatnonzero(bag & (pos <= plan.upto) & ((fold != plan.without) if plan.without is not None else True))
        number_of = {node: i for i, node in enumerate(ask.leaves)}
        parts = [(number_of[node], at) for node, at in parted(ask.tree, columns, some, ask.leaves)]
        sums = np.zeros((3, len(ask.leaves), int(starts[-1])), np.int64)
        if parts:
            # rows of one leaf lie together, so the sums that are added to do too
            rows = np.concatenate([at for _, at in parts])
            leaf = np.repeat([i for i, _ in parts], [len(at) for _, at in parts])
            p = 1 / (1 + np.exp(-scores[k, rows]))
            weights = None, np.rint((p - y[rows]) * UNIT), np.rint(p * (1 - p) * UNIT)
            for c in ask.columns.tolist():
                size = int(starts[c + 1] - starts[c])
                places = leaf * size + columns[c][rows]
                for into, w in zip(sums, weights, strict=True):
                    into[:, starts[c] : starts[c + 1]] = np.bincount(places, w, len(ask.leaves) * size).reshape(-1, size)
        out.append(sums)
    return out


def _sum(a: list, b: list) -> list:
    return [x if y is None else y if x is None else x + y for x, y in zip(a, b, strict=True)]


class Split(NamedTuple):
    gain: float
    feature: int
    left: np.ndarray  # the bins that go left
    sums: np.ndarray  # count, gradient, Hessian of what goes left


def best_split(sums: np.ndarray, whole: np.ndarray, columns: np.ndarray, bins: Bins, starts: np.ndarray, options: Options) -> Split | None:
    """The best split of a leaf with these sums (3, all bins). Of equal gains the first column, the lowest place, and missing values to the right count.

    Numbers are split between neighbouring bins, categories in the order of their gradients. Missing values go where the gain is greater; where a leaf has none,
    to the side with more rows, as do levels that the leaf lacks.
    """
    sizes = np.array([bins.sizes[c] for c in columns])
    width = int(sizes.max())
    inside = np.arange(1, width) < sizes[:, None]
    known = sums[:, np.where(inside, starts[columns][:, None] + np.arange(1, width), 0)] * inside
    nominal = np.flatnonzero([bins.edges[c] is None for c in columns])
    l2 = np.full(len(columns), options.l2)
    l2[nominal] += options.category_l2
    levels, order = known[:, nominal], np.zeros((len(nominal), width - 1), np.int64)
    if len(nominal):
        count, grad, hess = levels
        with np.errstate(invalid="ignore", divide="ignore"):
            ratio = np.where(count > 0, (grad / UNIT) / (hess / UNIT + options.category_smooth), np.inf)
        order = np.argsort(ratio, axis=1, kind="stable")
        known[:, nominal] = np.take_along_axis(levels, order[None], 2)
    run = np.cumsum(known, 2)
    lost = sums[:, starts[columns]]
    value = lambda a, b, more: (a / UNIT) ** 2 / (b / UNIT + more)
    whole_value = value(whole[1], whole[2], options.l2)
    found = []
    # missing to the right, missing to the left where there are any
    for to_left, some in ((0, np.arange(len(columns))), (1, np.flatnonzero(lost[0] > 0))):
        n, g, h = run[:, some] + lost[:, some, None] if to_left else run
        least = options.least_hessian * UNIT
        at = np.flatnonzero((n >= options.leaf) & (n <= whole[0] - options.leaf) & (h >= least) & (h <= whole[2] - least))
        if len(at):
            n, g, h, more = n.ravel()[at], g.ravel()[at], h.ravel()[at], l2[some[at // (width - 1)]]
            gain = value(g, h, more) + value(whole[1] - g, whole[2] - h, more) - whole_value
            k = int(gain.argmax())
            found.append((-float(gain[k]), int(some[at[k] // (width - 1)]), int(at[k] % (width - 1)), to_left, np.array([n[k], g[k], h[k]], np.int64)))
    if not found:
        return None
    loss, f, place, to_left, sides = min(found, key=lambda x: x[:4])
    if not -loss > 1e-12:
        return None
    left = np.zeros(int(max(bins.sizes)), bool)
    default = bool(to_left) if lost[0][f] > 0 else bool(sides[0] > whole[0] - sides[0])
    if f in nominal:
        own = int(np.flatnonzero(nominal == f)[0])
        left[order[own, : place + 1] + 1] = True
        left[1:width][levels[0, own] == 0] = default
    else:
        left[1 : place + 2] = True
    left[0] = default
    return Split(-loss, int(columns[f]), left, sides)


class Node:
    """A leaf, or a split one: its sums, its histogram until it is split, its best split and its children."""

    def __init__(self, whole: np.ndarray) -> None:
        self.whole = whole
        self.sums: np.ndarray | None = None
        self.split: Split | None = None
        self.children: tuple[int, int] | None = None


class Growing:
    """One tree of one model, best leaf first."""

    def __init__(self, options: Options, columns: np.ndarray, bins: Bins, starts: np.ndarray) -> None:
        self.options, self.columns, self.bins, self.starts = options, columns, bins, starts
        self.nodes: list[Node] = []
        self.waiting: list[tuple[int, int | None]] = []  # nodes that a pass counts, and their siblings, which are the parents less them
        self.chosen: list[int] = []

    def tree(self, taken: set[int] | None = None) -> Tree:
        """The tree of all splits so far, or of the taken ones, whose leaves then have values."""
        size, wide = len(self.nodes), int(max(self.bins.sizes))
        feature, left, children, value = np.zeros(size, np.int64), np.zeros((size, wide), bool), np.repeat(np.arange(size)[:, None], 2, 1), np.zeros(size)
        depth = np.zeros(size, np.int64)
        for i, node in enumerate(self.nodes):
            if node.children and (taken is None or i in taken):
                feature[i], left[i], children[i] = node.split.feature, node.split.left, node.children
                depth[list(node.children)] = depth[i] + 1
            else:
                value[i] = -self.options.step * (node.whole[1] / UNIT) / (node.whole[2] / UNIT + self.options.l2)
        if taken is None:
            return Tree(feature, left, children, value, int(depth.max(initial=0)))
        # only what the root leads to
        kept = [0]
        for i in kept:
            if children[i, 0] != i:
                kept += children[i].tolist()
        at = {i: k for k, i in enumerate(kept)}
        return Tree(feature[kept], left[kept], np.array([[at[c] for c in children[i].tolist()] for i in kept]), value[kept], int(depth[kept].max()))

    def asked(self) -> Asked | None:
        if not self.nodes:
            root = Tree(np.zeros(1, np.int64), np.zeros((1, max(self.bins.sizes)), bool), np.zeros((1, 2), np.int64), np.zeros(1), 0)
            return Asked(root, [0], self.columns)
        return Asked(self.tree(), [i for i, _ in self.waiting], self.columns) if self.waiting else None

    def take(self, sums: np.ndarray) -> None:
        """The histograms that were asked for; then the next leaves, best first."""
        if not self.nodes:
            c = self.columns[0]
            self.nodes.append(Node(sums[:, 0, self.starts[c] : self.starts[c + 1]].sum(1)))
            self.waiting = [(0, None)]
        for k, (i, sibling) in enumerate(self.waiting):
            self.nodes[i].sums = sums[:, k]
            if sibling is not None:
                self.nodes[sibling].sums = self.nodes[sibling].sums - sums[:, k]
            for j in (i, sibling):
                if j is not None:
                    node = self.nodes[j]
                    node.split = best_split(node.sums, node.whole, self.columns, self.bins, self.starts, self.options)
        self.waiting = []
        self.next()

    def next(self) -> None:
        self.chosen, front = [], [0]
        left = self.options.leaves - 1
        while left:
            front = [i for i in front if self.nodes[i].split]
            if not front:
                return
            front.sort(key=lambda i: (-self.nodes[i].split.gain, i))
            best = self.nodes[front[0]]
            if not best.children:
                if left > 1 and (asked := [i for i in front[: min(left, WIDTH)] if not self.nodes[i].children]):
                    for i in asked:
                        self.divide(i)
                    if self.waiting:
                        return
                    continue
                self.divide(front[0], last=True)
            self.chosen.append(front.pop(0))
            front += best.children
            left -= 1

    def divide(self, i: int, last: bool = False) -> None:
        """Makes the children of a leaf, and asks for the histograms of those that can be split again."""
        node = self.nodes[i]
        small = [node.split.sums, node.whole - node.split.sums]
        node.children = len(self.nodes), len(self.nodes) + 1
        self.nodes += [Node(s) for s in small]
        if not last:
            able = [j for j in node.children if self.nodes[j].whole[0] >= 2 * self.options.leaf]
            if len(able) == 2:
                able.sort(key=lambda j: (self.nodes[j].whole[0], j))
                self.nodes[able[1]].sums = node.sums
                self.waiting.append((able[0], able[1]))
            elif able:
                self.waiting.append((able[0], None))
        node.sums = None


class Boosted(NamedTuple):
    bins: Bins
    base: float
    trees: list[Tree]


def tasks_of(values: int, cores: int) -> int:
    """Tasks for so many binned values: one for what one task may have, else as many as there are cores or as keep each small."""
    return 1 if values <= TASK_BYTES else max(-(-values // TASK_BYTES), min(cores, -(-values * SMALL // TASK_BYTES)))


def prepared(rows: DataFrame, bins: Bins) -> tuple[DataFrame, int]:
    """rows(_y, _pos, _key, _fold, x_...) as a table of binned blocks, each with the task that it is dealt to, and how many these are."""
    spark = rows.sparkSession
    tasks = tasks_of(rows.count() * len(bins.names), spark.sparkContext.defaultParallelism)
    rows = rows.select(F.col("_y").cast("tinyint").alias("_y"), F.col("_pos").cast("long").alias("_pos"), F.col("_key").cast("long").alias("_key"), F.col("_fold").cast("smallint").alias("_fold"), *[f"x_{c}" for c in bins.names])
    rows = rows.repartition(tasks) if tasks > 1 else rows.coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK_ROWS))
    try:
        return written(rows.mapInArrow(lambda b: _blocks(b, bins), "n int, wide int, task int, " + ", ".join(f"b{k} binary" for k in range(5))), "blocks"), tasks
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def grow(rows: DataFrame, bins: Bins, plans: list[Plan], options: Options) -> list[Boosted]:
    """One model for each plan, all in the same passes."""
    table, tasks = prepared(rows, bins)
    # by the tasks that wrote them: readers may put several files into one task, or cut one where its rows do not part
    blocks = table.rdd.map(lambda r: (r["task"], r)).partitionBy(tasks, lambda k: k).values().map(_decoded)
    starts = np.append(0, np.cumsum(bins.sizes))

    def counted(block: tuple) -> list[tuple[int, int]]:
        _, y, pos, _, fold = block
        own = [(pos <= p.upto) & ((fold != p.without) if p.without is not None else True) for p in plans]
        return [(int(o.sum()), int(y[o].sum())) for o in own]

    counts = np.sum([np.array(x) for x in blocks.map(counted).collect()] or [np.zeros((len(plans), 2))], axis=0)
    base = []
    for n, positive in counts.tolist():
        if not 0 < positive < n:
            raise ValueError(f"one class only: {positive} positives of {n} rows")
        base.append(float(np.log(positive / (n - positive))))
    first = np.array(base)
    state = blocks.map(lambda b: (*b, np.repeat(first[:, None], len(b[1]), 1))).persist(StorageLevel.MEMORY_AND_DISK)
    done: list[list[Tree]] = [[] for _ in plans]
    alone = tasks == 1
    if alone and len(plans) > 1:
        # a task for each model: its own scores beside the blocks
        whole = state
        state = whole.flatMap(lambda b: [(k, (*b[:-1], b[-1][k : k + 1])) for k in range(len(plans))]).partitionBy(len(plans), lambda k: k).values().persist(StorageLevel.MEMORY_AND_DISK)
        state.count()
        whole.unpersist()
    older = state
    for begin in range(0, options.trees, KEPT):
        numbers = range(begin, min(begin + KEPT, options.trees))
        if alone:
            # a model's only task has all its sums, so it goes on from leaf to leaf and tree to tree by itself
            since = state.mapPartitionsWithIndex(lambda k, blocks, n=numbers: [_in_one_task(list(blocks), [plans[k]], n, options, bins, starts)[0]]).collect()
        else:
            since, current = [[] for _ in plans], state
            for number in numbers:
                new = _trees(plans, bins, starts, options, number, lambda asked, k=number, s=current: _pass(s, plans, [[] for _ in plans], asked, k, options, starts))
                since = [[*own, tree] for own, tree in zip(since, new, strict=True)]
                if current is not state:
                    current.unpersist()
                if number != numbers[-1]:
                    # a tree's passes read scores that hold all trees before it
                    current = _stored(state, since, False)
        if older is not state:
            older.unpersist()
        # what is stored depends on the blocks' table by as many narrow steps as scores were stored before
        older, state = state, _stored(state, since, alone)
        for own, new in zip(done, since, strict=True):
            own += new
    older.unpersist()
    state.unpersist()
    removed(table)
    return [Boosted(bins, b, own) for b, own in zip(base, done, strict=True)]


def _trees(plans: list[Plan], bins: Bins, starts: np.ndarray, options: Options, number: int, add: Callable[[list[Asked | None]], list]) -> list[Tree]:
    """The next tree of every model; add: the sums for what they ask for."""
    growing = [Growing(options, columns_of(p, options, number), bins, starts) for p in plans]
    while any(asked := [g.asked() for g in growing]):
        for g, sums in zip(growing, add(asked), strict=True):
            if sums is not None:
                g.take(sums)
    return [g.tree(set(g.chosen)) for g in growing]


def _in_one_task(blocks: list[tuple], plans: list[Plan], numbers: range, options: Options, bins: Bins, starts: np.ndarray) -> list[list[Tree]]:
    out: list[list[Tree]] = [[] for _ in plans]
    if not blocks:
        return out
    block = tuple(np.concatenate(parts, axis=-1) for parts in zip(*blocks, strict=True))
    for number in numbers:
        new = [_grown(block, k, plan, options, bins, starts, number) for k, plan in enumerate(plans)]
        block = _advanced(block, [[tree] for tree in new])
        for own, tree in zip(out, new, strict=True):
            own.append(tree)
    return out


def _grown(block: tuple, k: int, plan: Plan, options: Options, bins: Bins, starts: np.ndarray, number: int) -> Tree:
    """The next tree of model k, by a task that has all rows: gradients are worked out once for it, and rows stay with their leaves."""
    columns, y, pos, key, fold, scores = block
    some = np.flatnonzero(drawn(key, options.seed, number, options.rows) & (pos <= plan.upto) & ((fold != plan.without) if plan.without is not None else True))
    p = 1 / (1 + np.exp(-scores[k]))
    g, h = np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT)
    growing, at = Growing(options, columns_of(plan, options, number), bins, starts), {0: some}
    while leaves := [i for i, _ in growing.waiting] if growing.nodes else [0]:
        for i in [i for i in at if growing.nodes and growing.nodes[i].children]:
            rows, node = at.pop(i), growing.nodes[i]
            side = node.split.left[columns[node.split.feature][rows]]
            at[node.children[0]], at[node.children[1]] = rows[side], rows[~side]
        sums = np.zeros((3, len(leaves), int(starts[-1])), np.int64)
        for i, leaf in enumerate(leaves):
            rows = at[leaf]
            weights = None, g[rows], h[rows]
            for c in growing.columns.tolist():
                places = columns[c][rows].astype(np.int64)
                for into, w in zip(sums, weights, strict=True):
                    into[i, starts[c] : starts[c + 1]] = np.bincount(places, w, int(starts[c + 1] - starts[c]))
        growing.take(sums)
    return growing.tree(set(growing.chosen))


def _stored(state: RDD, trees: list[list[Tree]], alone: bool) -> RDD:
    """The blocks with the new trees' scores; alone: each partition is one model's."""
    return state.mapPartitionsWithIndex(lambda k, blocks: (_advanced(b, [trees[k]] if alone else trees) for b in blocks)).persist(StorageLevel.MEMORY_AND_DISK)


def _pass(state: RDD, plans: list[Plan], trees: list[list[Tree]], asked: list[Asked | None], number: int, options: Options, starts: np.ndarray) -> list[np.ndarray | None]:
    def part(blocks: Iterator[tuple]) -> Iterator[list]:
        held = None
        for block in blocks:
            own = _added(block, plans, trees, asked, number, options, starts)
            held = own if held is None else _sum(held, own)
        if held is not None:
            yield held

    sums = state.mapPartitions(part)
    return sums.reduce(_sum) if sums.getNumPartitions() * len(plans) <= DIRECT else sums.treeReduce(_sum)


def probabilities(models: list[Boosted], names: list[str]) -> Column:
    """array<double>: every model's probability, from the x_ columns."""

    @F.pandas_udf("array<double>")
    def scored(x: pd.DataFrame) -> pd.Series:
        out = np.zeros((len(x), len(models)))
        bins = models[0].bins
        columns = np.ascontiguousarray(binned([x[f"x_{c}"].to_numpy() for c in bins.names], bins).T)
        every = np.arange(len(x))
        for k, m in enumerate(models):
            total = np.full(len(x), m.base)
            for tree in m.trees:
                for node, at in parted(tree, columns, every):
                    total[at] += tree.value[node]
            out[:, k] = 1 / (1 + np.exp(-total))
        return pd.Series(list(out))

    return scored(F.struct(*[f"x_{c}" for c in names]))


def narrowed(model: Boosted, columns: list[int]) -> Boosted:
    """The model with only these columns, which hold all that its trees split on."""
    at = np.zeros(len(model.bins.names), np.int64)
    at[columns] = np.arange(len(columns))
    bins = Bins(*([part[c] for c in columns] for part in model.bins))
    return Boosted(bins, model.base, [t._replace(feature=at[t.feature]) for t in model.trees])


def splits(model: Boosted) -> dict[str, int]:
    """How many splits every column has."""
    out = np.zeros(len(model.bins.names), np.int64)
    for tree in model.trees:
        inner = tree.children[:, 0] != np.arange(len(tree.children))
        np.add.at(out, tree.feature[inner], 1)
    return dict(zip(model.bins.names, out.tolist(), strict=True))


def save(model: Boosted, spark: SparkSession, path: str) -> None:
    """The trees as a table of nodes."""
    rows = [
        (t, i, int(tree.feature[i]), np.packbits(tree.left[i]).tobytes(), int(tree.children[i, 0]), int(tree.children[i, 1]), float(tree.value[i]), tree.depth)
        for t, tree in enumerate(model.trees)
        for i in range(len(tree.value))
    ]
    spark.createDataFrame(rows, "tree int, node int, feature int, lefts binary, left int, right int, value double, depth int").coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")


def load(spark: SparkSession, path: str, bins: Bins, base: float) -> Boosted:
    by: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/trees").orderBy("tree", "node").collect():
        by.setdefault(r.tree, []).append(r)
    wide = max(bins.sizes)
    trees = [
        Tree(np.array([r.feature for r in own]), np.array([np.unpackbits(np.frombuffer(r.lefts, np.uint8))[:wide] for r in own]).astype(bool), np.array([[r.left, r.right] for r in own]), np.array([r.value for r in own]), own[0].depth)
        for _, own in sorted(by.items())
    ]
    return Boosted(bins, base, trees)
