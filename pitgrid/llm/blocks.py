"""Splitting of large groups into pairs of bounded blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(rows: DataFrame, group: list[str], size: str, spread: str, block: int):
    """Groups ``rows`` for comparisons of all members of a group, so that no group passed to Python has over about 2 * block rows.

    size: a column with the group's number of rows. A group of k blocks becomes k * (k + 1) / 2 groups: each block with itself (side 2)
    and each pair of blocks (sides 0 and 1). Returns grouped data; the column ``side`` is added.
    """
    k = F.greatest(F.lit(1), F.ceil(F.col(size) / block)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(11), F.col(spread)), F.col("_blocks")).cast("int")
    return (
        rows.withColumn("_blocks", k)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("side", F.expr("case when _other = _own then 2 when _own < _other then 0 else 1 end"))
        .withColumn("_low", F.least("_own", "_other"))
        .withColumn("_high", F.greatest("_own", "_other"))
        .drop("_blocks", "_own", "_other", size)
        .groupBy(*group, "_low", "_high")
    )
