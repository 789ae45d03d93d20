"""Ordered operators that keep working when one meeting holds a large part of all rows.

A plain window partitioned by meeting puts that meeting in one task. Here rows are cut into
blocks of bounded size along the order; each block is windowed on its own, one summary row per
block is carried over the earlier (or later) blocks, and the carry is joined back. Only the
summaries of a meeting, one row per BLOCK_ROWS rows, meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import written

BLOCK_ROWS = 65_536
_BLOCK = "_block"
_RANGE = "_range"


@dataclass(frozen=True)
class Axis:
    """Total order inside a key; `block` must not decrease along `order`."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    block: Column


def dense_axis(key: str, index: str) -> Axis:
    """Axis over a dense per-key index: every block holds at most BLOCK_ROWS rows."""
    return Axis((key,), (index,), F.floor(F.col(index) / F.lit(BLOCK_ROWS)))


def equal_ranges(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], ranges: int | None = None) -> tuple[DataFrame, Axis]:
    """The rows in ranges of about equal numbers along (keys, order), and the axis whose blocks are these ranges.

    For orders without a dense index, such as times or counts: Spark samples the borders, so a key with very many rows, all at one time even, is cut
    into as many blocks as it needs. The rows are written once, since a second sample would cut elsewhere.
    """
    by = [*keys, *order]
    cut = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return written(cut.withColumn(_RANGE, F.spark_partition_id()), "ranges"), Axis(keys, order, F.col(_RANGE))


@dataclass(frozen=True)
class Running:
    """One output of scan(); build it with the functions below."""

    kind: str
    value: Column


def running_sum(value: Column) -> Running:
    """Sum of value over this row and all earlier ones."""
    return Running("sum", value)


def running_max(value: Column) -> Running:
    """Largest value up to this row."""
    return Running("max", value)


def last_known(value: Column) -> Running:
    """Most recent non-null value up to this row (forward fill)."""
    return Running("last", value)


def known_before(value: Column) -> Running:
    """Most recent non-null value before this row."""
    return Running("before", value)


def previous(value: Column) -> Running:
    """Value of the row before, null on the first row."""
    return Running("prev", value)


def following(value: Column) -> Running:
    """Value of the row after, null on the last row."""
    return Running("next", value)


def scan(df: DataFrame, axis: Axis, **outputs: Running) -> DataFrame:
    """Add each running output as a column; exact for any block size."""
    keys = list(axis.keys)
    blocked = df.withColumn(_BLOCK, axis.block)
    place = F.col(axis.order[0]) if len(axis.order) == 1 else F.struct(*axis.order)
    totals = blocked.groupBy(*keys, _BLOCK).agg(
        *[_total(r, place).alias(f"_t_{n}") for n, r in outputs.items()]
    )
    across = Window.partitionBy(*keys).orderBy(_BLOCK)
    carried = totals.select(
        *keys, _BLOCK, *[_carried(r, F.col(f"_t_{n}"), across).alias(f"_c_{n}") for n, r in outputs.items()]
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*axis.order)
    local = blocked
    for name, r in outputs.items():
        local = local.withColumn(f"_l_{name}", _local(r, inside))
    joined = local.join(carried, [*keys, _BLOCK])
    return joined.select(
        *[F.col(c) for c in df.columns if c not in outputs and c != _RANGE],
        *[_merged(r, F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, r in outputs.items()],
    )


def places(df: DataFrame, key: str, order: tuple[str, ...], ranges: int | None = None) -> DataFrame:
    """Number the rows of each key from 1 along the order: places inside a range, plus the rows of the ranges before."""
    return scan(*equal_ranges(df, (key,), order, ranges), place=running_sum(F.lit(1)))


def _total(r: Running, place: Column) -> Column:
    if r.kind == "sum":
        return F.sum(r.value)
    if r.kind == "max":
        return F.max(r.value)
    if r.kind in ("last", "before"):
        return F.max_by(r.value, F.when(r.value.isNotNull(), place))
    if r.kind == "prev":
        return F.max_by(F.struct(r.value.alias("v")), place)
    return F.min_by(F.struct(r.value.alias("v")), place)


def _carried(r: Running, total: Column, across) -> Column:
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    if r.kind == "sum":
        return F.sum(total).over(before)
    if r.kind == "max":
        return F.max(total).over(before)
    if r.kind in ("last", "before", "prev"):
        return F.last(total, ignorenulls=True).over(before)
    return F.lead(total).over(across)


def _local(r: Running, inside) -> Column:
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    if r.kind == "sum":
        return F.sum(r.value).over(upto)
    if r.kind == "max":
        return F.max(r.value).over(upto)
    if r.kind == "last":
        return F.last(r.value, ignorenulls=True).over(upto)
    if r.kind == "before":
        return F.last(r.value, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    if r.kind == "prev":
        return F.lag(F.struct(r.value.alias("v"))).over(inside)
    return F.lead(F.struct(r.value.alias("v"))).over(inside)


def _merged(r: Running, local: Column, carry: Column) -> Column:
    if r.kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if r.kind == "max":
        return F.greatest(local, carry)
    if r.kind in ("last", "before"):
        return F.coalesce(local, carry)
    return F.coalesce(local, carry).getField("v")


def joined_text(text: str, order: list[str], sep: str = " ") -> Column:
    """Aggregate: text values of a group joined in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_piece"))))
    return F.array_join(F.transform(rows, lambda x: x["_piece"]), sep)


def concat_in_order(df: DataFrame, keys: list[str], index: str, text: str, sep: str = " ") -> DataFrame:
    """Join the text of each group in index order, first inside bounded pieces, then across them.

    Rows never gather in one task as single words; a group's pieces do, as one cell, because
    that cell is the result asked for.
    """
    piece = (
        df.withColumn(_BLOCK, F.floor(F.col(index) / 1024))
        .groupBy(*keys, _BLOCK)
        .agg(joined_text(text, [index], sep).alias(text))
    )
    return piece.groupBy(*keys).agg(joined_text(text, [_BLOCK], sep).alias(text))


def with_halo(df: DataFrame, index: str, before: int, after: int) -> DataFrame:
    """Copy rows near a block border into the neighbouring block, for windows of a few rows.

    Window over (key, _block), then keep the rows where `_own = _block`.
    """
    home = F.sequence(F.floor((F.col(index) - after) / BLOCK_ROWS), F.floor((F.col(index) + before) / BLOCK_ROWS))
    return df.withColumn("_own", F.floor(F.col(index) / BLOCK_ROWS)).withColumn(_BLOCK, F.explode(home))
