"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.workspace import cut, drop


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (id, component), a table: the smallest id reachable, for every id of an edge with two ends.

    Null ends and loops are left out; order and repetition of the pairs do not matter; no edges give no rows.
    Each round takes partial minima and joins them back from tables in the shared folder: both sides of a join are then
    shuffled, so adaptive skew splitting can keep a hub's neighbours out of a single task.
    """
    at = cut(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        if _all_stars(at):
            break
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        # every larger neighbour is hung onto the smallest id around its hub
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # then every id's smaller neighbours, and the id itself, onto the smallest of them
        large = cut(large, "large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = cut(small, "edges")
        drop(at, lowest, large, least)
        at = after
    else:
        raise RuntimeError("components did not settle")
    roots = at.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = cut(at.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "components")
    drop(at)
    return out


def _all_stars(at: DataFrame) -> bool:
    """Whether each larger end u of the distinct edges hangs on one v only, and no v hangs on another: then each v is its component's smallest id."""
    ends = at.selectExpr("u as id", "1 as up", "0 as down").unionByName(at.selectExpr("v as id", "0 as up", "1 as down"))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def extended(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (id, component), a table, of the links behind ``found``, which components() gave, and of ``edges`` (a, b) together.

    Only the edges, between components instead of ids, are contracted again.
    """
    own = lambda end: found.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
    between = edges.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = components(between)
    moved = found.join(joined.selectExpr("id as component", "component as now"), "component", "left").selectExpr("id", "coalesce(now, component) as component")
    out = cut(moved.unionByName(joined.join(found, "id", "left_anti")), "components")
    drop(joined)
    return out
