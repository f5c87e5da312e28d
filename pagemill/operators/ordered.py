"""Operators over an order within a key, for keys of any size.

A window over a whole key puts a very large key into one task. Here the order is cut
into blocks; within a block a window runs as usual, and what passes on to later blocks
is one row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096


def _block(order: str, size: int) -> Column:
    return F.floor(F.col(order) / size).cast("bigint")


def fill_forward(df: DataFrame, key: str, order: str, value: str, out: str, default: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Adds ``out``: the last ``value`` that is not null up to each row, else ``default``.

    ``order`` is an integer, unique within the key. Rows with a null key or order
    get only their own value.
    """
    rows = df.withColumn("__b", _block(order, block))
    within = Window.partitionBy(key, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__v", F.last(value, True).over(within))
    ends = rows.groupBy(key, "__b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("__end"))
    earlier = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(key, "__b", F.last("__end", True).over(earlier).alias("__before"))
    joined = rows.join(before, [key, "__b"], "left")
    filled = F.coalesce("__v", "__before", *([default] if default is not None else []))
    return joined.withColumn(out, filled).select(*[F.col(f"`{c}`") for c in df.columns], out)


def running_sum(df: DataFrame, key: str, order: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """Adds ``out``: the sum of ``value`` up to and with each row."""
    rows = df.withColumn("__b", _block(order, block)).withColumn("__x", F.coalesce(value, F.lit(0)))
    within = Window.partitionBy(key, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__v", F.sum("__x").over(within))
    ends = rows.groupBy(key, "__b").agg(F.sum("__x").alias("__end"))
    earlier = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(key, "__b", F.sum("__end").over(earlier).alias("__before"))
    joined = rows.join(before, [key, "__b"], "left")
    return joined.withColumn(out, F.col("__v") + F.coalesce("__before", F.lit(0))).select(*[F.col(f"`{c}`") for c in df.columns], out)


def runs(df: DataFrame, key: str, value: str) -> DataFrame:
    """Runs of consecutive integers: key, first, last, length. ``df`` holds distinct values of a key."""
    order = Window.partitionBy(key).orderBy(value)
    island = df.select(key, value).filter(f"{value} is not null").withColumn("__i", F.col(value) - F.row_number().over(order))
    return island.groupBy(key, "__i").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("length")).drop("__i")


def with_neighbours(df: DataFrame, key: str, order: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """Adds ``prev_<c>`` and ``next_<c>`` of the rows before and after.

    The first and last row of each block also stand, as copies, in the block next to
    theirs; blocks without rows between two others are bridged by the order of the
    blocks that exist.
    """
    rows = df.withColumn("__b", _block(order, block))
    whole = F.struct(*columns)
    blocks = rows.groupBy(key, "__b").agg(F.min_by(whole, order).alias("__first"), F.max_by(whole, order).alias("__last"))
    chain = Window.partitionBy(key).orderBy("__b")
    edges = blocks.select(key, "__b", F.lag("__last").over(chain).alias("__before"), F.lead("__first").over(chain).alias("__after"))
    within = Window.partitionBy(key, "__b").orderBy(order)
    first, last = F.row_number().over(within) == 1, F.lead(order).over(within).isNull()
    moved = rows.select("*", *[F.lag(c).over(within).alias(f"__p_{c}") for c in columns], *[F.lead(c).over(within).alias(f"__n_{c}") for c in columns], first.alias("__is_first"), last.alias("__is_last"))
    joined = moved.join(edges, [key, "__b"], "left")
    for c in columns:
        joined = joined.withColumn(f"prev_{c}", F.when(F.col("__is_first"), F.col(f"__before.{c}")).otherwise(F.col(f"__p_{c}")))
        joined = joined.withColumn(f"next_{c}", F.when(F.col("__is_last"), F.col(f"__after.{c}")).otherwise(F.col(f"__n_{c}")))
    return joined.select(*df.columns, *[f"prev_{c}" for c in columns], *[f"next_{c}" for c in columns])
