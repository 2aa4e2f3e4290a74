"""Joins and neighbours over integer ranges, without comparing all pairs.

A range is cut into dyadic blocks, aligned ranges whose length is a power of two:
at most two for each level. A point lies in a range exactly if it lies in one of
these blocks, and at each level it lies in one block only, so a range condition
becomes an equality on (level, block), which Spark hashes, aggregates partially
and splits when skewed. Cost grows with the logarithm of the longest range, not
with the number of ranges over a point, and not with the size of the largest
file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize


def blocks(start: Column, end: Column) -> Column:
    """The dyadic blocks of the range from ``start`` to ``end``, both included,
    as an array of ``(level, block)``; empty for an empty range."""
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(end - start + 1, F.lit(1)))).cast("int"))

    def at_level(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low = F.call_function("shiftright", start + size - 1, level)
        high = F.call_function("shiftright", end + 1, level)
        piece = lambda there, block: F.when(there & (low < high), F.struct(level.alias("level"), block.alias("block")))
        return F.array(piece(low % 2 == 1, low), piece(high % 2 == 1, high - 1))

    found = F.filter(F.flatten(F.transform(levels, at_level)), lambda b: b.isNotNull())
    return F.when(end >= start, found)


def above(point: Column, levels: list[int]) -> Column:
    """The blocks that hold ``point``, one for each of ``levels``."""
    return F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright(point, level).alias("block")) for level in levels])


def in_blocks(ranges: DataFrame, start: str, end: str) -> tuple[DataFrame, list[int]]:
    """``ranges`` with ``_level`` and ``_block``, a row for each dyadic block,
    written once; and the levels that occur, which are fewer than 64."""
    cut = ranges.withColumn("_b", F.explode(blocks(F.col(start), F.col(end))))
    cut = materialize(cut.withColumn("_level", F.col("_b.level")).withColumn("_block", F.col("_b.block")).drop("_b"))
    return cut, sorted(r[0] for r in cut.select("_level").distinct().collect())


def stab_join(points: DataFrame, point: str, ranges: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """Rows of ``points`` with each range of ``ranges`` that holds their point and
    has equal ``keys``. Other columns must have different names."""
    right, levels = in_blocks(ranges, start, end)
    if not levels:
        return points.join(ranges, keys).limit(0)
    left = points.withColumn("_b", F.explode(above(F.col(point), levels)))
    left = left.withColumn("_level", F.col("_b.level")).withColumn("_block", F.col("_b.block")).drop("_b")
    return left.join(right, [*keys, "_level", "_block"]).drop("_level", "_block")


def overlap_join(a: DataFrame, a_start: str, a_end: str, b: DataFrame, b_start: str, b_end: str, keys: list[str]) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` with equal ``keys`` whose ranges share a
    point, each pair once: either b starts inside a, or a starts inside b after
    b's start. Both tables are used twice; give tables that are written."""
    inside_a = stab_join(b.where(F.col(b_start) <= F.col(b_end)), b_start, a, a_start, a_end, keys)
    inside_b = stab_join(a.where(F.col(a_start) <= F.col(a_end)), a_start, b, b_start, b_end, keys).where(F.col(b_start) < F.col(a_start))
    return inside_a.unionByName(inside_b)


def parted(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``df`` written once in stretches of about equal size in ``keys`` and then
    ``order``, with ``_part``, the number of each row's stretch. Spark draws the
    bounds from a sample, so a key with very many rows has many stretches."""
    return materialize(df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))


def with_neighbours(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[Column, int]]) -> DataFrame:
    """Append for each ``name: (value, step)`` of ``values`` the value of the row
    before (``step`` -1) or after (1) in ``order`` among rows with equal ``keys``;
    null if there is none.

    Only the rows of one stretch meet in a task. A stretch's first and last rows
    take their neighbours from a table with one row for each stretch, whose size
    is the number of partitions.
    """
    held = {name: f"_held_{name}" for name in values}
    rows = parted(df.withColumns({held[name]: value for name, (value, _) in values.items()}), keys, order)
    row, place = F.struct(*keys, *held.values()), F.struct(*keys, order)
    ends = rows.groupBy("_part").agg(F.min_by(row, place).alias("first"), F.max_by(row, place).alias("last"))
    across = W.orderBy("_part")  # one row for each partition
    beside = ends.select("_part", F.lag("last").over(across).alias("_row_before"), F.lead("first").over(across).alias("_row_after"))
    within = W.partitionBy("_part").orderBy(*keys, order)
    rows = rows.withColumns({"_row_prev": F.lag(row).over(within), "_row_next": F.lead(row).over(within)}).join(F.broadcast(beside), "_part")

    def pick(name: str, step: int) -> Column:
        other = F.coalesce("_row_prev", "_row_before") if step < 0 else F.coalesce("_row_next", "_row_after")
        same = F.lit(True)
        for k in keys:
            same = same & other[k].eqNullSafe(F.col(k))
        return F.when(other.isNotNull() & same, other[held[name]]).alias(name)

    return rows.select(*df.columns, *[pick(name, step) for name, (_, step) in values.items()])


def running(df: DataFrame, keys: list[str], order: str, name: str, value: Column, fold) -> DataFrame:
    """Append ``name``, the aggregate ``fold`` (F.sum, F.max or F.min) of ``value``
    over the rows with equal ``keys`` up to each row in ``order``, itself included.

    A row's part is the fold inside its stretch, and what stretches before it have
    come to for its key, from a table with one row for each key and stretch.
    """
    rows = parted(df.withColumn("_value", value), keys, order)
    upto = W.partitionBy("_part", *keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy(*keys, "_part").agg(fold("_value").alias("_all"))
    parts = materialize(parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), fold("_all").over(before).alias("_carry")))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = rows.withColumn("_inner", fold("_value").over(upto)).join(parts, on)
    both = F.array("_inner", "_carry")
    merged = {F.sum: lambda: F.coalesce(F.col("_inner"), F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0)), F.max: lambda: F.array_max(both), F.min: lambda: F.array_min(both)}
    return rows.select(*df.columns, merged[fold]().alias(name))
