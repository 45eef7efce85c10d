"""Paired bootstrap of average precision: multinomial counts of rows, without a row for each draw.

How often a row is drawn follows from its place in the order of the model's score alone: n draws over all places are split between the halves of the places, and so
on down, by binomial counts that come from hashes. A task works out the parts of that tree that its own rows hang on, once, in the model's order, where they are
neighbours; a row then carries its counts, a byte a draw, to its place in the other score's order. They add up to n in each draw.

Rows are put in ranges by score once for each score. A first pass gives each range's sums of every draw, one scan over the ranges what comes before each, a second pass
the precision at each distinct score. Equal scores may lie in several ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.operators import ranks
from pitgrid.sources.shared import removed, written

#: Fixed values of the hash: any engine with 64-bit products draws the same.
TIMES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
#: Rows and draws whose counts are worked out together.
ROWS, DRAWS = 1 << 15, 64
#: Rows that are worth a task of their own where cores are free, and ranges at most (the driver holds their sums).
LEAST, MOST = 1 << 10, 2000
#: A binomial count is looked for this many standard deviations around its mean.
DEVIATIONS = 9.0


def uniforms(seed: int, draws: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each node (lo, hi) and draw a number from 0 to 1 in steps of 2^-53."""
    part = lambda x, k: x.astype(np.uint64) * np.uint64(TIMES[k])
    x = (part(draws + 1, 0) ^ part(np.full(1, seed), 3))[None, :] ^ (part(lo + 1, 1) ^ part(hi, 2))[:, None]
    for shift, times in MIX:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def binomials(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How many k have a chance of under u of at most k successes in n: binomial counts, one for each uniform u. n: a row for each p (rows, 1).

    Nodes of one level have few p and few n: the running chances of each pair are worked out once, as a row of a table, and each u is looked up in its row.
    """
    out, shares = np.zeros(n.shape), p.ravel()
    for share in np.unique(shares).tolist():
        rows = np.flatnonzero(shares == share)
        rows = slice(None) if len(rows) == len(shares) else rows
        sizes, own = n[rows].astype(np.int64), u[rows]
        low = int(sizes.min(initial=0))
        wide = int(sizes.max(initial=0)) - low + 1
        if wide <= sizes.size and wide * _spread(low + wide, share) <= TABLE:
            out[rows] = _looked_up(np.arange(low, low + wide), share, sizes - low, own)
        else:
            # few and far apart: pairs by pairs
            known, which = np.unique(sizes, return_inverse=True)
            which = which.reshape(sizes.shape)
            for a in range(0, len(known), step := max(1, TABLE // _spread(int(known[-1]), share))):
                here = np.nonzero((which >= a) & (which < a + step))
                part = np.zeros(len(here[0])) + _looked_up(known[a : a + step], share, which[here] - a, own[here])
                if isinstance(rows, slice):
                    out[here] = part
                else:
                    out[rows[here[0]], here[1]] = part
    return out


#: Chances that a table of binomial counts holds.
TABLE = 1 << 21


def _spread(n: int, p: float) -> int:
    return int(2 * DEVIATIONS * math.sqrt(n * p * (1 - p)) + 24)


def _looked_up(known: np.ndarray, p: float, which: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The counts for u by n = known[which]."""
    n = known.astype(float)[:, None]
    least = np.maximum(0, np.floor(n * p - DEVIATIONS * np.sqrt(n * p * (1 - p)) - 10))
    k = least + np.arange(_spread(int(known.max()), p))
    odds = np.where(k < n, np.maximum(n - k, 0) / (k + 1) * (p / (1 - p)), 0.0)
    first = [math.exp(math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1) + b * math.log(p) + (a - b) * math.log(1 - p)) for a, b in zip(n[:, 0].tolist(), least[:, 0].tolist(), strict=True)]
    sums = np.cumsum(np.cumprod(np.concatenate([np.array(first)[:, None], odds[:, :-1]], 1), 1), 1)
    # where the sums end below u all n are taken
    sums[k >= n] = np.inf
    sums[:, -1] = np.inf
    base, flat, goal = which.ravel() * sums.shape[1], sums.ravel(), u.ravel()
    # rows one after the other in one rising line, then the neighbours by the sums themselves: the line has fewer digits
    line = (np.minimum(sums, 1.5) + 2.0 * np.arange(len(sums))[:, None]).ravel()
    at = np.searchsorted(line, goal + 2.0 * which.ravel())
    while len(off := np.flatnonzero(flat[at] < goal)):
        at[off] += 1
    while len(off := np.flatnonzero((at > base) & (flat[np.maximum(at, 1) - 1] >= goal))):
        at[off] -= 1
    return (least[:, 0][which.ravel()] + (at - base)).reshape(u.shape)


def counts(places: np.ndarray, n: int, draws: np.ndarray, seed: int) -> np.ndarray:
    """How often the rows at these places (of n) are drawn in n picks, for each draw: (places, draws)."""
    asked, back = np.unique(places, return_inverse=True)
    lo, hi, own = np.zeros(1, np.int64), np.full(1, n, np.int64), np.full((1, len(draws)), float(n))
    while (hi - lo > 1).any():
        wide = hi - lo > 1
        middle = (lo + hi) // 2
        left = np.zeros_like(own)
        left[wide] = binomials(own[wide], ((middle - lo) / (hi - lo))[wide, None], uniforms(seed, draws, lo[wide], hi[wide]))
        # nodes of one place stay as they are, others become their halves; only those above an asked place are followed
        lo, hi = np.concatenate([lo[~wide], lo[wide], middle[wide]]), np.concatenate([hi[~wide], middle[wide], hi[wide]])
        own = np.concatenate([own[~wide], left[wide], (own - left)[wide]])
        some = np.searchsorted(asked, lo) < np.searchsorted(asked, hi)
        order = np.argsort(lo[some], kind="stable")
        lo, hi, own = lo[some][order], hi[some][order], own[some][order]
    return own[back]


class _Range:
    """Sums over a range's rows for every draw, told apart by runs of equal scores: its first run, its last one, and all."""

    def __init__(self, at: int, draws: int) -> None:
        self.at, self.draws, self.runs = at, draws, 0
        self.first_p = self.last_p = None
        self.total, self.first, self.last = (np.zeros((2, draws)) for _ in range(3))
        self.gain = np.zeros(draws)

    def take(self, p: np.ndarray, y: np.ndarray, w: np.ndarray, k: np.ndarray, before: np.ndarray | None) -> None:
        """Rows in order and their counts; before: what all earlier ranges sum to, then the precisions at the ends of inner runs are added up."""
        edges = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        every = np.add.reduceat(k * w[:, None], edges, 0)
        hits = np.add.reduceat(k * (w * y)[:, None], edges, 0)
        scores = p[edges]
        if self.runs and scores[0] == self.last_p:
            hits[0] += self.last[0]
            every[0] += self.last[1]
            self.total -= self.last
            self.runs -= 1
        elif self.runs > 1 and before is not None:
            self.close(before)
        elif self.runs == 1 and before is None:
            self.first = self.last.copy()
        if not self.runs:
            self.first_p = scores[0]
        if not self.runs and len(scores) > 1:
            self.first = np.stack([hits[0], every[0]])
        ends_hits, ends_all = np.cumsum(hits, 0) + self.total[0], np.cumsum(every, 0) + self.total[1]
        if before is not None and len(scores) > 1:
            inner = slice(0 if self.runs else 1, -1)
            at = ends_all[inner] + before[1]
            self.gain += (hits[inner] * np.divide(ends_hits[inner] + before[0], at, out=np.zeros_like(at), where=at > 0)).sum(0)
        self.runs += len(scores)
        self.last_p, self.last = scores[-1], np.stack([hits[-1], every[-1]])
        self.total = np.stack([ends_hits[-1], ends_all[-1]])

    def close(self, before: np.ndarray) -> None:
        """The last run was an inner one after all."""
        at = self.total[1] + before[1]
        self.gain += self.last[0] * np.divide(self.total[0] + before[0], at, out=np.zeros_like(at), where=at > 0)


def _counted(batches: Iterator[pa.RecordBatch], n: int, draws: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows with _place -> the same with _k, the row's count in every draw: a byte each, four where a count of its batch needs them."""
    for batch in batches:
        place, out = batch.column("_place").to_numpy(), []
        for a in range(0, len(place), ROWS):
            k = np.concatenate([counts(place[a : a + ROWS], n, np.arange(d, min(draws, d + DRAWS)), seed).astype(np.uint32) for d in range(0, draws, DRAWS)], 1)
            out += [row.tobytes() for row in k.astype(np.uint8 if k.max(initial=0) < 256 else np.uint32)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "_k"])


def _matrix(rows: list[bytes], draws: int) -> np.ndarray:
    if len({len(r) for r in rows}) > 1:
        return np.concatenate([_matrix([r], draws) for r in rows])
    return np.frombuffer(b"".join(rows), np.uint8 if len(rows[0]) == draws else np.uint32).reshape(len(rows), draws).astype(float)


def _ranges(batches: Iterator[pa.RecordBatch], draws: int, before: dict[int, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Rows in order of their score, ranges one after the other -> each range's sums, or (before given) its precisions."""
    held: list[_Range] = []

    def told(r: _Range) -> pa.RecordBatch:
        if before is not None:
            return pa.RecordBatch.from_pydict({"at": [r.at], "gain": [r.gain.tolist()]})
        if r.runs == 1:
            r.first = r.last
        sums = np.concatenate([r.total, r.first, r.last])
        return pa.RecordBatch.from_pydict({"at": [r.at], "runs": pa.array([r.runs], pa.int64()), "first_p": [r.first_p], "last_p": [r.last_p], "sums": [sums.ravel().tolist()]})

    for batch in batches:
        pos, p, y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_pos", "_p", "_y", "_w"))
        part = pos >> ranks.LOW
        for begin in np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(pos) else []:
            end = begin + int((part[begin:] == part[begin]).sum())
            if held and held[0].at >> ranks.LOW != int(part[begin]):
                yield told(held.pop())
            if not held:
                held.append(_Range(int(pos[begin]), draws))
            for a in range(begin, end, ROWS):
                some = slice(a, min(end, a + ROWS))
                held[0].take(p[some], y[some].astype(float), w[some], _matrix(batch.column("_k").slice(a, some.stop - a).to_pylist(), draws), before[held[0].at] if before is not None else None)
    if held:
        yield told(held.pop())


def precisions(table: DataFrame, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """(positives, average precision times positives) of every draw, from a table in falling order of _p with _pos, _y, _w and _k."""
    rows = table.select("_pos", "_p", "_y", "_w", "_k")
    sums = rows.mapInArrow(lambda b: _ranges(b, draws, None), "at long, runs long, first_p double, last_p double, sums array<double>").orderBy("at").collect()
    total, gain, before, opened = np.zeros((2, draws)), np.zeros(draws), {}, None

    def closed(run: tuple[float, np.ndarray]) -> np.ndarray:
        return run[1] * np.divide(total[0], total[1], out=np.zeros(draws), where=total[1] > 0)

    for r in sums:
        own, first, last = np.array(r["sums"]).reshape(3, 2, draws)
        before[r["at"]] = total.copy()
        if opened is not None and opened[0] != r.first_p:
            gain += closed(opened)
            opened = None
        hits = first[0] + (opened[1] if opened is not None else 0)
        if r.runs == 1:
            opened = r.first_p, hits
        else:
            at = total + first
            gain += hits * np.divide(at[0], at[1], out=np.zeros(draws), where=at[1] > 0)
            opened = r.last_p, last[0]
        total += own
    if opened is not None:
        gain += closed(opened)
    for r in rows.mapInArrow(lambda b: _ranges(b, draws, before), "at long, gain array<double>").collect():
        gain += np.array(r["gain"])
    return total[0], gain


def ranges_of(n: int, cores: int) -> int:
    """Into how many ranges n rows are put: as many as there are cores, or as keep each at ROWS."""
    return max(1, min(MOST, max(-(-n // ROWS), min(cores, -(-n // LEAST)))))


def paired(scored: DataFrame, key: str, y: str, model: str, base: str, w: str | None, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Average precisions of both scores in every draw that has positives."""
    low = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    rows = written(scored.select(F.col(key).cast("string").alias("_key"), (F.coalesce(F.col(y), F.lit(0)) == 1).alias("_y"), low(model).alias("_p"), low(base).alias("_b"), (F.col(w).cast("double") if w else F.lit(1.0)).alias("_w")), "scored-rows")
    # dealt by the work, which is rows times draws: by their bytes all rows would be one task's
    ranges = ranges_of(rows.count(), scored.sparkSession.sparkContext.defaultParallelism)
    by_model = ranks.ranked(rows, [F.col("_p").desc(), F.col("_key"), F.col("_y"), F.col("_b")], "by-model", ranges)
    removed(rows)
    sizes = by_model.groupBy(F.shiftright("_pos", ranks.LOW).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    n = sum(r.n for r in sizes)
    if not n:
        removed(by_model)
        return np.zeros(0), np.zeros(0)
    starts = dict(zip((r.part for r in sizes), np.cumsum([0, *(r.n for r in sizes)]).tolist()))
    offsets = scored.sparkSession.createDataFrame(list(starts.items()), "_part long, _start long")
    placed = by_model.withColumn("_part", F.shiftright("_pos", ranks.LOW)).join(F.broadcast(offsets), "_part")
    placed = placed.select("_pos", (F.col("_start") + F.col("_pos").bitwiseAND((1 << ranks.LOW) - 1)).alias("_place"), "_p", "_b", "_y", "_w")
    counted = written(placed.mapInArrow(lambda b: _counted(b, n, draws, seed), "_pos long, _place long, _p double, _b double, _y boolean, _w double, _k binary"), "counted")
    by_base = ranks.ranked(counted.select("_place", "_y", "_w", "_k", F.col("_b").alias("_p")), [F.col("_p").desc(), F.col("_place")], "by-base", ranges)
    out = [precisions(t, draws) for t in (counted, by_base)]
    removed(by_model, counted, by_base)
    some = out[0][0] > 0
    return tuple(gain[some] / positives[some] for positives, gain in out)
