"""Positions, budgets and best-of lists that hold at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut


def with_position(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with the 0-based position of each row in the given order, without moving all rows into one task.

    Rows are range-partitioned and sorted; a row's position is its place in its partition plus the sizes of the
    partitions before. The ids are cut from their lineage first, as a recomputation could draw other ranges.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    out = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, (F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint")).drop("_id", "_part", "_start")


def budget_prefix(df: DataFrame, by: list[str], order: list[Column], tokens: Column, budget: int, least: int = 0) -> DataFrame:
    """Per group, the leading rows in the order whose running sum of tokens stays within the budget: kept up to the first overflow.

    If every row has at least `least` tokens, only so many rows can fit: a group limit below the shuffle then bounds what
    a group brings together, whatever its size.
    """
    if least > 0:
        df = df.withColumn("_first", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_first") <= budget // least).drop("_first")
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used_tokens", F.sum(tokens).over(w)).where(F.col("used_tokens") <= budget)


def best_of(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group in the order, with their rank from 1 (a group limit, pushed below the shuffle)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def fuse_rankings(rankings: DataFrame, by: list[str], item: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (by..., item, rank, weight): the sum of weight / (k + rank)."""
    return rankings.groupBy(*by, item).agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"))
