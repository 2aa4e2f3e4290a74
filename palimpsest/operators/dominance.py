"""Overlapping ranges by their order in time, counted without making a pair.

A range overlaps an earlier one if it ends at or after the other's start, less the
cases in which it starts after the other's end. Both are counts of pairs that stand
in one order in time and in one order in position. Spark deals the rows out twice:
in blocks of time and, of these rows, in stretches of position. A pair meets in its
block, or in its stretch if its blocks differ; if both differ, numbers of rows by
block and stretch tell. Tasks count in numpy, a bit of the compared value at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

PART_ROWS = 250_000  # rows of a block
MOST_PARTS = 400  # blocks and stretches, whose product bounds the numbers by both
COUNTS = "owner long, first int, later int, late int, n long"
CELLS = "block int, stretch int, role int, write int"


def ordered_overlaps(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``owner, first, later, late, n`` of ``ranges(start, end, seq, sync, write, ...)``:
    numbers of pairs of overlapping ranges with equal ``keys``, whole numbers, by the
    first key and by ``write`` of the earlier and the later range. With ``late`` 0 those
    whose earlier ``seq`` is below the later one, with 1 those whose earlier ``sync`` is.
    Rows are not summed up. Give a table that is written."""
    times = F.array(F.struct(F.col("seq").alias("t"), F.lit(0).alias("late"), F.lit(0).cast("long").alias("tie")), F.struct(F.col("sync").alias("t"), F.lit(1).alias("late"), F.col("seq").alias("tie")))
    names = [f"k{i}" for i in range(len(keys))]
    rows = ranges.select(*[F.col(k).cast("long").alias(n) for k, n in zip(keys, names)], "start", "end", F.col("write").cast("int").alias("write"), F.explode(times).alias("m"))
    rows = rows.select(*names, "start", "end", "write", "m.*").where("t is not null").dropna(subset=names)
    parts = min(MOST_PARTS, 1 + 2 * ranges.count() // PART_ROWS)
    # A row's time is a mark; its seq also asks for marks before it. At one time those that ask stand first.
    blocks = materialize(rows.repartitionByRange(parts, *names, "t", "late", "tie").withColumn("block", F.spark_partition_id()))
    inside = blocks.mapInArrow(_whole(lambda c: _in_block(c, names)), COUNTS)
    # At one position starts stand before ends: a range may start where another ends, and meets it.
    places = F.array(F.struct(F.col("start").alias("x"), F.lit(0).alias("role")), F.struct(F.col("end").alias("x"), F.lit(1).alias("role")))
    ends = blocks.select(*names, "write", "late", "t", "block", F.explode(places).alias("p")).select(*names, "write", "late", "t", "block", "p.*")
    stretches = ends.repartitionByRange(parts, *names, "x", "role", "t", "late").withColumn("stretch", F.spark_partition_id())
    key_fields = "".join(f"{n} long, " for n in names)
    both = materialize(stretches.mapInArrow(_whole(lambda c: _in_stretch(c, names)), f"{key_fields}{COUNTS}, {CELLS}"))
    beside = both.where("role is null").select("owner", "first", "later", "late", "n")
    cells = both.where("role is not null").select(*names, "block", "stretch", "role", "write", "late", "n")
    across = cells.groupBy(*names).applyInArrow(_across, COUNTS)
    return inside.unionByName(beside).unionByName(across)


def _whole(count: Callable[[dict], dict]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function on a partition from one on its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            table = pa.Table.from_batches(got)
            yield count({name: table[name].to_numpy() for name in table.column_names})

    return run


def _groups(columns: list[np.ndarray]) -> np.ndarray:
    """Number of each row's combination of values, in their order."""
    number = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        values, inverse = np.unique(column, return_inverse=True)
        number = np.unique(number * len(values) + inverse, return_inverse=True)[1]
    return number


def _counts(owner: np.ndarray, group: np.ndarray, value: np.ndarray, role: np.ndarray, write: np.ndarray, late: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of COUNTS for rows in order of group and position: pairs of a group whose
    value and place both rise. An end asks for the starts before it, and a start for
    the ends, which are taken off. No pair of two reads is counted."""
    owners, code = np.unique(owner, return_inverse=True)
    kind = (role * 4 + late * 2 + write).astype(np.int8)
    group, value, code = group.astype(np.int32), value.astype(np.int32), code.astype(np.int32)
    total = np.zeros((2, 2, 2 * len(owners)), np.int64)  # late, first; owner and later
    at = np.arange(len(value), dtype=np.int32)
    for bit in reversed(range(int(value.max()).bit_length())):
        # Rows are in order of their higher bits, then of group and position.
        node, one = value >> (bit + 1), (value >> bit & 1).astype(bool)
        new = np.r_[True, node[1:] != node[:-1]]
        run = np.maximum.accumulate(np.where(new | np.r_[True, group[1:] != group[:-1]], at, 0))
        for asks in (0, 1):
            who = np.flatnonzero(one & ((kind == asks * 4) | (kind == asks * 4 + 1)))
            for mark_late in (0, 1):
                for first in (0, 1):
                    some = who if first else who[kind[who] == asks * 4 + 1]
                    marks = (kind == (1 - asks) * 4 + mark_late * 2 + first) & ~one
                    before = np.concatenate(([0], np.cumsum(marks, dtype=np.int32)))
                    met = before[some] - before[run[some]]
                    got = np.bincount(code[some] * 2 + (kind[some] & 1), weights=met, minlength=2 * len(owners))
                    total[mark_late, first] += (1 if asks else -1) * got.astype(np.int64)
        # Next, zeros of a node before its ones, each in the order they have.
        begin = np.maximum.accumulate(np.where(new, at, 0))
        zeros = np.concatenate(([0], np.cumsum(~one, dtype=np.int32)))
        index = np.flatnonzero(new)
        here = np.diff(zeros[np.append(index, len(value))])[np.cumsum(new) - 1]
        passed = zeros[:-1] - zeros[begin]
        to = np.where(one, begin + here + (at - begin) - passed, begin + passed)
        for a in (value, group, code, kind):
            a[to] = a.copy()
    lates, firsts, cells = np.nonzero(total)
    return {
        "owner": owners[cells // 2].astype(np.int64), "first": firsts.astype(np.int32), "later": (cells % 2).astype(np.int32),
        "late": lates.astype(np.int32), "n": total[lates, firsts, cells],
    }


def _in_block(c: dict, names: list[str]) -> pa.RecordBatch:
    """Pairs of one block of time."""
    twice = {k: np.tile(v, 2) for k, v in c.items() if k not in ("start", "end", "t")}
    x, role = np.concatenate((c["start"], c["end"])), np.repeat([0, 1], len(c["start"]))
    group, value = _groups([twice[n] for n in names]), np.tile(np.unique(c["t"], return_inverse=True)[1], 2)
    o = np.lexsort((role, x, group))
    return pa.RecordBatch.from_pydict(_counts(twice["k0"][o], group[o], value[o], role[o], twice["write"][o], twice["late"][o]))


def _in_stretch(c: dict, names: list[str]) -> pa.RecordBatch:
    """Pairs of one stretch of positions in different blocks; and numbers of rows by
    block, of the first and the last group, which alone go on in other stretches."""
    group = _groups([c[n] for n in names])
    o = np.lexsort((c["role"], c["x"], group))
    c, group = {k: v[o] for k, v in c.items()}, group[o]
    found = _counts(c["k0"], group, c["block"] - c["block"].min(), c["role"], c["write"], c["late"])
    edge = np.flatnonzero((group == group[0]) | (group == group[-1]))
    fields = [*names, "block", "stretch", "role", "write", "late"]
    _, at, n = np.unique(_groups([c[f][edge] for f in fields]), return_index=True, return_counts=True)
    cells = {f: c[f][edge[at]] for f in fields} | {"n": n}
    columns = []
    for f in [*names, "owner", "first", "later", "late", "n", "block", "stretch", "role", "write"]:
        kind = pa.int64() if f in (*names, "owner", "n") else pa.int32()
        columns.append(pa.concat_arrays([pa.array(t[f], kind) if f in t else pa.nulls(len(t["n"]), kind) for t in (found, cells)]))
    return pa.RecordBatch.from_arrays(columns, names=[*names, "owner", "first", "later", "late", "n", "block", "stretch", "role", "write"])


def _across(cells: pa.Table) -> pa.Table:
    """Pairs of one group in different blocks and stretches: sums of its numbers over
    all blocks before and all stretches before."""
    c = {name: cells[name].to_numpy() for name in cells.column_names}
    blocks, b = np.unique(c["block"], return_inverse=True)
    stretches, s = np.unique(c["stretch"], return_inverse=True)
    rows = np.zeros((2, 2, 2, len(blocks) + 1, len(stretches) + 1), np.int64)  # role, late, write
    np.add.at(rows, (c["role"], c["late"], c["write"], b + 1, s + 1), c["n"])
    before = rows.cumsum(3).cumsum(4)[..., :-1, :-1]
    out = []
    for late, first, later in ((0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0), (1, 1, 1)):
        asked = [int((rows[role, 0, later, 1:, 1:] * before[1 - role, late, first]).sum()) for role in (0, 1)]
        out.append((int(c["k0"][0]), first, later, late, asked[1] - asked[0]))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.table([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=["owner", "first", "later", "late", "n"])
