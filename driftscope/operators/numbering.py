"""Row numbers and ranks over large groups without putting a group into one task.

Rows need a whole number that orders them and is unique in its group.  The
numbers are cut into blocks of fixed width, so a block holds at most that many
rows whatever the group; rows are numbered inside their block and shifted by
the rows of earlier blocks.  Blocks are summed up the same way, inside stretches
of fixed width and then stretch by stretch, so no window is larger than WIDTH
rows until ids exceed WIDTH cubed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 20


def block(order_id: str, width: int) -> Column:
    return F.expr(f"{order_id} div {width} AS _block")


def block_counts(df: DataFrame, group: list[str], order_id: str, width: int = WIDTH, *more: Column) -> DataFrame:
    """Rows per group and block, with further aggregates if wanted."""
    return df.groupBy(*group, block(order_id, width)).agg(F.expr("count(1) AS _rows"), *more)


def _rows_before(group: list[str], order: str, rows: str) -> Column:
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(rows).over(window), F.lit(0))


def block_offsets(blocks: DataFrame, group: list[str], width: int = WIDTH) -> DataFrame:
    """``_before``: rows of the group in earlier blocks, for each block."""
    located = blocks.selectExpr(*group, "_block", "_rows", f"_block div {width} AS _stretch")
    inside = located.withColumn("_in_stretch", _rows_before([*group, "_stretch"], "_block", "_rows"))
    stretches = located.groupBy(*group, "_stretch").agg(F.expr("sum(_rows) AS _rows")).withColumn(
        "_earlier", _rows_before(group, "_stretch", "_rows")).drop("_rows")
    return inside.join(stretches, [*group, "_stretch"]).selectExpr(
        *group, "_block", "_in_stretch + _earlier AS _before")


def number_rows(df: DataFrame, order_id: str, name: str = "row_number", group: list[str] | None = None,
                offsets: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """Add the position of each row, counted from 1, in the order of ``order_id``.

    ``group`` starts again at 1 for each group.  ``offsets`` (group, ``_block``,
    ``_before`` and any columns to attach) replaces the running sums per group.
    """
    group = group or []
    if offsets is None:
        offsets = block_offsets(block_counts(df, group, order_id, width), group, width)
    inside = Window.partitionBy(*group, "_block").orderBy(order_id)
    numbered = df.withColumn("_block", block(order_id, width)).withColumn("_inside", F.row_number().over(inside))
    return numbered.join(offsets, [*group, "_block"]).withColumn(
        name, F.expr("cast(_inside + _before AS bigint)")
    ).drop("_block", "_inside", "_before")


def value_ranks(df: DataFrame, group: list[str], value: str, name: str, scale: int = 0,
                width: int = WIDTH) -> DataFrame:
    """The distinct values of each group with their dense rank, the largest first.

    ``scale`` is the number of decimal places of ``value``, which turns it into
    a whole number.
    """
    order = f"-{value}" if scale == 0 else f"cast(-{value} * {10 ** scale} AS decimal(38,0))"
    distinct = df.select(*group, value).distinct().selectExpr("*", f"{order} AS _order")
    return number_rows(distinct, "_order", name, group, width=width).selectExpr(
        *group, value, f"cast({name} AS int) AS {name}")
