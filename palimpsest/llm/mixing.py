"""Mixing sources to target weights by capped water-filling. DataFrame
functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, word_count

# The weights that sources take in turn, in code-point order.
WEIGHTS = (5, 2, 1)
BITS = 11  # of a pick that one round looks at
LEVELS = 12  # rounds over the 128 bits of pick and tie
RANKED = 10_000  # rows of a source that are sorted at most
SENT = 100_000  # sources up to which their table is sent to all tasks


def water_fill(sources: DataFrame, total: Column, max_epochs: float = 3.0) -> DataFrame:
    """Append ``target`` to ``sources(source, source_size, weight)``.

    ``total`` is shared in proportion to ``weight``; a source whose share is
    above ``max_epochs`` times its size is clamped there and the excess goes to
    the others by weight, until none is above. That fixed point is reached in
    one pass: in ascending order of cap / weight, clamped sources form a prefix,
    and the first source at which the level (what is left, over the weight that
    is left) no longer exceeds its ratio gives the level for all.
    """
    up = W.orderBy("_ratio", "_rank").rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.orderBy("_ratio", "_rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    down = W.orderBy("_ratio", "_rank").rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (total - F.coalesce(F.sum("_cap").over(up), F.lit(0.0))) / F.sum("weight").over(down)
    return (
        sources.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_level", level)
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(all_rows)["_level"])
        .withColumn("target", F.coalesce(F.least("_cap", F.col("_level") * F.col("weight")), F.col("_cap")))
    )


def mix_plan(sizes: DataFrame, max_epochs: float = 3.0, weights: tuple = WEIGHTS) -> tuple[DataFrame, int]:
    """One row per source of ``sizes(source, size, pick, tie)``, and their number:
    size, target, the whole repetitions that each of its documents gets, and the
    ``cut_pick, cut_tie`` up to which documents get one more; of those that
    stand exactly there, ``more`` do.

    ``pick`` is a seeded hash and ``tie`` parts rows of one pick. The documents of
    a source in that order are taken once more until their words come to the
    fraction that the target leaves over the whole repetitions, so the words
    taken miss the target by less than one document. The cut is found by radix:
    sums by the next bits tell the range that holds it, round by round, until
    no range has over RANKED rows; only such a range is sorted.
    """
    by_bin = cut_lineage(summed(sizes, 0))
    sources = by_bin.groupBy("source").agg(F.sum("words").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_rank") % len(weights) + 1)
    sources = sources.withColumn("_rank", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    everything = W.orderBy("_rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sources = sources.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
    sources = water_fill(sources, F.col("_total"), max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = cut_lineage(
        sources.withColumn("_epochs", F.least(epochs, F.lit(float(max_epochs))))
        .withColumn("whole", F.floor("_epochs").cast("long"))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("source", "source_size", "target", "whole", "need")
    )
    n = sources.count()

    near = sizes.select("source", "size", "pick", "tie")
    at = sources.where("need > 0").select("source", F.lit(0).cast("long").alias("before"), "need")
    for level in range(LEVELS):
        at = cut_lineage(range_at_cut(by_bin if level == 0 else summed(near, level), at, n))
        here = small(at.select(F.col("source").alias("_s"), F.col("bin").alias("_bin")), n)
        near = near.join(here, F.col("source").eqNullSafe(F.col("_s")) & (digit(level) == F.col("_bin"))).drop("_s", "_bin")
        if (at.agg(F.max("n")).first()[0] or 0) <= RANKED:
            break
        near = cut_lineage(near)

    start = small(at.select(F.col("source").alias("_s"), "before", "need"), n)
    run = W.partitionBy("source").orderBy("u", "v").rowsBetween(W.unboundedPreceding, -1)
    groups = near.groupBy("source", unsigned_order(F.col("pick")).alias("u"), unsigned_order(F.col("tie")).alias("v"))
    groups = groups.agg(F.count("*").alias("n"), F.sum("size").alias("words")).join(start, F.col("source").eqNullSafe(F.col("_s")))
    groups = groups.withColumn("from", F.col("before") + F.coalesce(F.sum("words").over(run), F.lit(0)))
    each = F.col("words") / F.col("n")
    fits = F.col("from") + each / 2 <= F.col("need")
    rows = F.when(fits & (each > 0), F.least(F.col("n"), F.floor((F.col("need") - F.col("from")) / each + 0.5))).when(fits, F.col("n")).otherwise(0)
    # The last group of which a row fits; the first, without a row, if none fits.
    place = F.struct(fits.alias("fits"), F.when(fits, F.col("u")).otherwise(-1 - F.col("u")), F.when(fits, F.col("v")).otherwise(-1 - F.col("v")))
    chosen = groups.groupBy("source").agg(F.max_by(F.struct("u", "v", rows.cast("long").alias("more")), place).alias("cut"))
    chosen = chosen.select(F.col("source").alias("_s"), F.col("cut.u").alias("cut_pick"), F.col("cut.v").alias("cut_tie"), "cut.more")
    plan = sources.join(chosen, sources["source"].eqNullSafe(chosen["_s"]), "left")
    return cut_lineage(plan.select("source", "source_size", "target", "whole", "cut_pick", "cut_tie", "more")), n


def digit(level: int) -> Column:
    """The bits of ``pick``, and behind them of ``tie``, that round ``level`` looks at."""
    per_key = LEVELS // 2
    return F.shiftrightunsigned("pick" if level < per_key else "tie", max(0, 64 - BITS * (level % per_key + 1))).bitwiseAND(F.lit((1 << BITS) - 1))


def summed(rows: DataFrame, level: int) -> DataFrame:
    return rows.groupBy("source", digit(level).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))


def range_at_cut(bins: DataFrame, at: DataFrame, n: int) -> DataFrame:
    """``source, bin, n, before, need``: of each source the range of ``bins`` at
    which its words, after ``before``, come to ``need``."""
    up = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("_up", F.coalesce(F.sum("words").over(up), F.lit(0)))
    at = small(at.select(F.col("source").alias("_s"), F.col("before").alias("_before"), "need"), n)
    bins = bins.join(at, F.col("source").eqNullSafe(F.col("_s"))).withColumn("before", F.col("_before") + F.col("_up"))
    return bins.where("before < need and need <= before + words").select("source", "bin", "n", "before", "need")


def small(table: DataFrame, n: int) -> DataFrame:
    """A table of ``n`` rows to be sent to all tasks, if it is not too large."""
    return F.broadcast(table) if n <= SENT else table


def one_more() -> Column:
    """Whether a row stands before its source's cut."""
    u, v = unsigned_order(F.col("pick")), unsigned_order(F.col("tie"))
    return F.coalesce((u < F.col("cut_pick")) | ((u == F.col("cut_pick")) & (v < F.col("cut_tie"))), F.lit(False))


def at_cut() -> Column:
    u, v = unsigned_order(F.col("pick")), unsigned_order(F.col("tie"))
    return F.coalesce((u == F.col("cut_pick")) & (v == F.col("cut_tie")), F.lit(False))


def unsigned_order(bits: Column) -> Column:
    """A long that orders as ``bits`` read without a sign."""
    return bits.bitwiseXOR(F.lit(-(1 << 63)))


def mix(docs: DataFrame, seed: int = 42, max_epochs: float = 3.0) -> DataFrame:
    """``doc_id, source, size, source_size, target, whole, extra, taken`` of each
    row of ``docs(doc_id, text, source)``.

    ``taken`` is ``size`` times ``whole + extra`` repetitions. Rows are picked by
    id and text together, and rows equal in both one by one, so neither null ids
    nor copies are taken or left as a block. Defined results: a null text has
    size 0; a null source is a source of its own, the last in order; of repeated
    rows, which are interchangeable, any may be those taken; extra columns are not
    read; an empty table gives no rows. A source without words has target 0.
    The driver receives nothing; the table of sources, which is sorted in one
    task, has one row for each.
    """
    sizes = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("pick"),
        F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
    )
    sizes = cut_lineage(sizes)
    plan, n = mix_plan(sizes, max_epochs)
    extra = (one_more() | (at_cut() & (F.col("more") > 0))).cast("int")
    return (
        sizes.join(small(plan.withColumnRenamed("source", "_s"), n), F.col("source").eqNullSafe(F.col("_s")), "left")
        .withColumn("extra", extra)
        .withColumn("taken", F.col("size") * (F.col("whole") + F.col("extra")))
        .select("doc_id", "source", "size", "source_size", "target", "whole", "extra", "taken")
    )


def mix_rows(docs: DataFrame, seed: int = 42, max_epochs: float = 3.0) -> DataFrame:
    """The rows of ``docs``, each repeated as often as ``mix`` takes it, so that
    rows not taken go. Texts are not shuffled, but for the rows at the cut, one of
    each source and its equals: those are counted, and as many made again."""
    columns = docs.columns
    held = fresh(docs, "row")
    rows = docs.select(
        "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("pick"),
        F.xxhash64(*columns).alias("tie"), F.struct(*columns).alias(held),
    )
    plan, n = mix_plan(cut_lineage(rows.select("source", "size", "pick", "tie")), max_epochs)
    plan = small(plan.select(F.col("source").alias("_s"), "whole", "cut_pick", "cut_tie", "more"), n)
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    clear = joined.where(~at_cut()).select(held, (F.col("whole") + one_more().cast("int")).alias("times"))
    equal = joined.where(at_cut()).groupBy(held, "whole", "more").agg(F.count("*").alias("n"))
    equal = equal.select(held, (F.col("n") * F.col("whole") + F.least("n", "more")).alias("times"))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))
    return clear.unionAll(equal).select(held, copies).select(f"{held}.*")
