"""Places of rows in a total order, by ranges: what is counted, cut or picked by place needs the ranges' totals and one range, never one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgrid.sources.shared import written

#: Bits of a place inside its range.
LOW = 33
#: Places that are counted together when one is looked for.
BLOCK = 1024


def ranked(df: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """df as a table in this order, with _pos: it grows along the order, and its bits from LOW on are the range's number. Equal rows may be in any order.

    parts: how many ranges; by default their number follows from the bytes.
    """
    return written(df.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id()), name)


def edges(table: DataFrame, shares: dict[str, tuple[str | None, float]], group: str | None = None) -> dict[str, int]:
    """For each name (group value to leave out, share): the _pos of the last of the first int(share * n) rows of the others; -1 where that is none.

    Two passes for all names together: counts of ranges and groups, then of the blocks of the ranges that the edges are in, and the rows of those blocks.
    """
    value = F.col(group).cast("string") if group else F.lit(None).cast("string")
    rows = table.select("_pos", value.alias("_g"))

    def counted(part: DataFrame, bits: int | None) -> dict[int, dict]:
        out: dict[int, dict] = {}
        at = F.col("_pos").bitwiseAND(-1) if bits is None else F.shiftright("_pos", bits)
        for r in part.groupBy(at.alias("_at"), "_g").agg(F.count("*").alias("n")).collect():
            out.setdefault(r["_at"], {})[r["_g"]] = r["n"]
        return dict(sorted(out.items()))

    def found(counts: dict[int, dict], without: str | None, rank: int) -> tuple[int, int]:
        """The first key whose running count reaches the rank, and the rank inside it."""
        for at, by in counts.items():
            own = sum(n for g, n in by.items() if without is None or g != without)
            if rank <= own:
                return at, rank
            rank -= own
        raise AssertionError("a rank beyond all rows")

    ranges = counted(rows, LOW)
    state = {}
    for name, (without, share) in shares.items():
        n = sum(k for by in ranges.values() for g, k in by.items() if without is None or g != without)
        if int(share * n):
            state[name] = found(ranges, without, int(share * n))
    bits = BLOCK.bit_length() - 1
    for low in (LOW, bits):
        if not state:
            break
        some = sorted({at for at, _ in state.values()})
        inside = rows.where(" or ".join(f"_pos between {at << low} and {((at + 1) << low) - 1}" for at in some))
        counts = counted(inside, bits if low == LOW else None)
        state = {name: found({k: v for k, v in counts.items() if k >> (low - bits if low == LOW else low) == at}, shares[name][0], rank) for name, (at, rank) in state.items()}
    return {name: state[name][0] if name in state else -1 for name in shares}


#: Buckets of a histogram, and rows whose values are looked at one by one.
BUCKETS, FEW = 4096, 4096


def nth(df: DataFrame, keys: list[tuple[str, bool]], k: int) -> list:
    """The keys, (number column, whether it falls) each, of the k-th row from 1 on in their order; nulls come last.

    Each key is found by histograms that narrow in on it, ties by the next key: neither a sort nor a task for all rows.
    """
    out = []
    for column, falling in keys:
        known = df.where(F.col(column).isNotNull())
        value, k = _selected(known.select((-F.col(column) if falling else F.col(column)).alias("v")), k)
        out.append(value if value is None or not falling else -value)
        df = df.where(F.col(column) == F.lit(out[-1])) if value is not None else df.where(F.col(column).isNull())
    return out


def _selected(rows: DataFrame, k: int) -> tuple:
    """(the k-th least v, how many rows up to k have it); (None, k less all rows) where there are fewer."""
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if k > n:
        return None, k - n
    while low != high and n > FEW:
        share = F.least((F.col("v") - F.lit(low)).cast("double") / float(high - low), F.lit(1.0))
        parts = rows.groupBy(F.floor(share * BUCKETS).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect()
        for r in parts:
            if k <= r["n"]:
                break
            k -= r["n"]
        low, high, n = r["low"], r["high"], r["n"]
        rows = rows.where(F.col("v").between(F.lit(low), F.lit(high)))
    if low != high:
        for r in rows.groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect():
            if k <= r["n"]:
                return r["v"], k
            k -= r["n"]
    return low, k
