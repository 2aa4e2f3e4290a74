"""Consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage

SHARDS = 16
VIRTUAL = 128
POINTS = 1 << 40  # positions on the ring
PER_RUN = 20_000  # rows that one task ranks, about


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise. A shard's nodes do
    not depend on how many other shards there are."""
    nodes = []
    for shard in range(shards):
        for v in range(virtual):
            digest = hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest()
            nodes.append((int.from_bytes(digest, "big") % POINTS, shard))
    return sorted(nodes)


def ring_position(key: Column, other: Column) -> Column:
    """Place of a key on the ring; a null key takes the place of ``other``, so
    that rows without a key do not all meet."""
    return F.pmod(F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(F.lit("null"), other)), F.lit(POINTS))


def bounded_plan(counts: list[int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Where each arc's keys go: (arc, first rank, end rank, shard, first slot).

    The capacities are the most even split of all keys. First every shard takes
    keys of its own arcs, clockwise, until it is full; then the keys left over
    continue clockwise from their arc to the next virtual node of a shard that
    has room. Sizes: ``counts`` has one number for each virtual node, whatever
    the number of keys.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slot = [0] * shards
    plan, left = [], []
    for arc, (n, (_, shard)) in enumerate(zip(counts, nodes, strict=True)):
        take = min(n, room[shard])
        if take:
            plan.append((arc, 0, take, shard, slot[shard]))
            room[shard] -= take
            slot[shard] += take
        if n > take:
            left.append((arc, take, n))
    for arc, start, end in left:
        step = arc
        while start < end:
            step = (step + 1) % len(nodes)
            shard = nodes[step][1]
            take = min(end - start, room[shard])
            if take:
                plan.append((arc, start, start + take, shard, slot[shard]))
                room[shard] -= take
                slot[shard] += take
                start += take
    return plan


def shard_rows(keyed: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """Append ``shard`` and ``slot`` to ``keyed(pos, ...)``, whose ``pos`` is a
    ring position.

    Balance: the shards' row counts are at most one apart. Slots run from 0
    without gaps in each shard. Movement: one more row, or one more shard, moves
    the rows that the ring itself moves and those that fit elsewhere because room
    has changed; the tests bound their share.

    Each arc is cut into runs of about PER_RUN rows by position, and only a run
    is ranked in one task; a run's offset in its arc comes from the table of
    counts. Only the counts by arc, ``shards * virtual`` numbers, reach the
    driver. Ties in position are ranked by all columns, so equal rows alone are
    interchangeable.
    """
    spark = keyed.sparkSession
    nodes = ring(shards, virtual)
    starts = [p for p, _ in nodes]
    arc_of = arc_table(starts)
    n = keyed.count()
    runs = max(1, math.ceil(n / len(nodes) / PER_RUN))
    cell = max(1, POINTS // (len(nodes) * runs * 4))
    keyed = arc_of(keyed).withColumn("run", F.floor(F.col("pos") / cell).cast("long"))
    by_run = cut_lineage(keyed.groupBy("arc", "run").agg(F.count("*").alias("n")))
    by_arc = {r["arc"]: r["n"] for r in by_run.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    plan = bounded_plan([by_arc.get(a, 0) for a in range(len(nodes))], nodes, shards)
    plan = spark.createDataFrame(plan, "arc int, lo long, hi long, shard int, slot0 long")
    before = W.partitionBy("arc").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_run.select("arc", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    others = [c for c in keyed.columns if c not in ("arc", "run", "pos")]
    within = W.partitionBy("arc", "run").orderBy("pos", *others)
    ranked = keyed.withColumn("rank", F.row_number().over(within) - 1)
    ranked = ranked.join(offsets, ["arc", "run"]).withColumn("rank", F.col("rank") + F.col("offset"))
    placed = ranked.join(F.broadcast(plan), "arc").where("lo <= rank and rank < hi")
    return placed.select(*others, "pos", "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"))


def arc_table(starts: list[int]):
    """A function that appends ``arc``, the number of the first virtual node at
    or after ``pos``, wrapping to node 0. The lookup is a join with a table of
    ring cells: each cell of fixed width knows the few nodes in it."""
    cells = 4096
    width = POINTS // cells
    rows = []
    for cell in range(cells):
        first = bisect.bisect_left(starts, cell * width)
        last = bisect.bisect_left(starts, (cell + 1) * width)
        rows.append((cell, first, starts[first:last]))

    def append(df: DataFrame) -> DataFrame:
        table = df.sparkSession.createDataFrame(rows, "cell long, first int, nodes array<long>")
        df = df.withColumn("cell", F.floor(F.col("pos") / width).cast("long"))
        passed = F.size(F.filter("nodes", lambda p: p < F.col("pos")))
        joined = df.join(F.broadcast(table), "cell")
        return joined.withColumn("arc", F.pmod(F.col("first") + passed, F.lit(len(starts)))).drop("cell", "first", "nodes")

    return append


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, pos, shard, slot`` of every row of
    ``docs(doc_id, text)``. ``size`` is the text's UTF-8 bytes plus 1.

    Defined results: a null text counts as empty (size 1, CRC 0); rows with a
    null doc_id take their place by the text's CRC; repeated rows are each
    placed; extra columns are not read; an empty table gives no rows. Texts are
    read once and never shuffled.
    """
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    keyed = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    keyed = keyed.withColumn("pos", ring_position(F.col("doc_id"), F.col("text_crc32")))
    return shard_rows(cut_lineage(keyed), shards)
