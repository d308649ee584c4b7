"""Running totals and neighbours along an order that no single task can hold.

Rows of a group are cut into stretches of the ordering number; each stretch is a window of its
own, and only one row a stretch goes through the window of the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 4096


def along(
    df: DataFrame,
    by: list[str],
    order: str,
    width: int = WIDTH,
    totals: dict[str, Column] | None = None,
    before: dict[str, str] | None = None,
    after: dict[str, str] | None = None,
) -> DataFrame:
    """``df`` with, by new name: ``totals``, sums of expressions over the rows before each row in its group;
    ``before`` and ``after``, columns of the row before and after it, null at the ends of a group. Rows without
    an order stand first in their group; rows without a group (a null in ``by``) are left out. Rows of one order stand
    in no certain order."""
    totals, before, after = totals or {}, before or {}, after or {}
    key = [*by, "_stretch"]
    cut = df.select(
        "*",
        F.coalesce(F.floor(F.col(order) / width), F.lit(-(1 << 62))).alias("_stretch"),
        *[c.alias(f"_v_{n}") for n, c in totals.items()],
        *([F.struct(*[F.col(c).alias(n) for n, c in before.items()]).alias("_b")] if before else []),
        *([F.struct(*[F.col(c).alias(n) for n, c in after.items()]).alias("_a")] if after else []),
    )
    sums = [F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals]
    edges = ([F.max_by("_b", order).alias("_last")] if before else []) + ([F.min_by("_a", order).alias("_first")] if after else [])
    whole = Window.partitionBy(*by).orderBy("_stretch")
    told = [F.coalesce(F.sum(f"_s_{n}").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_s_{n}") for n in totals]
    told += ([F.lag("_last").over(whole).alias("_last")] if before else []) + ([F.lead("_first").over(whole).alias("_first")] if after else [])
    stretches = cut.groupBy(*key).agg(*sums, *edges).select(*key, *told)
    own = Window.partitionBy(*key).orderBy(order)
    near = [F.coalesce(F.sum(f"_v_{n}").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_w_{n}") for n in totals]
    near += ([F.lag("_b").over(own).alias("_nb")] if before else []) + ([F.lead("_a").over(own).alias("_na")] if after else [])
    joined = cut.select(*df.columns, "_stretch", *near).join(stretches, key)
    return joined.select(
        *df.columns,
        *[(F.col(f"_s_{n}") + F.col(f"_w_{n}")).alias(n) for n in totals],
        *[F.coalesce("_nb", "_last")[n].alias(n) for n in before],
        *[F.coalesce("_na", "_first")[n].alias(n) for n in after],
    )


def running_total(df: DataFrame, by: list[str], order: str, value: Column, into: str, width: int = WIDTH) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each row in its group."""
    return along(df, by, order, width, totals={into: value})


def cyclic(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """``df`` with next_value and previous_value, ``value`` of the row after and before in its group; after the last row
    comes the first."""
    placed = along(df, by, order, before={"_before": value}, after={"_after": value})
    ends = df.groupBy(*by).agg(F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
    joined = placed.join(ends, by)
    return joined.select(*df.columns, F.coalesce("_after", "_first").alias("next_value"), F.coalesce("_before", "_last").alias("previous_value"))
