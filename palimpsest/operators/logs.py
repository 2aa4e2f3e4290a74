"""Log storage: where bytes go in a client's log, and allocation of its slots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import running
from .reads import serve

CHUNK = 4 << 20


def chunk_count(n_bytes: Column, chunk: int = CHUNK) -> Column:
    return F.ceil(n_bytes / chunk).cast("long")


def memory_spill(offset: Column, length: Column, memory: int) -> Column:
    """How a log range splits into ``mem`` bytes in memory and ``spill`` bytes in
    the spill file, the latter from ``spill_off``; -1 where nothing is spilled. A
    range over the seam starts at 0 in the spill file."""
    end = offset + length
    split = lambda mem, spill, at: F.struct(mem.cast("long").alias("mem"), spill.cast("long").alias("spill"), at.cast("long").alias("spill_off"))
    return (
        F.when(end <= memory, split(length, F.lit(0), F.lit(-1)))
        .when(offset >= memory, split(F.lit(0), length, offset - memory))
        .otherwise(split(memory - offset, end - memory, F.lit(0)))
    )


def append_offsets(writes: DataFrame) -> DataFrame:
    """Position of each write in its client's log if space is never freed: what
    the client wrote before."""
    before = W.partitionBy("svr_rank", "app_id", "cli_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return writes.withColumn("log_pos", F.coalesce(F.sum("length").over(before), F.lit(0)))


def write_records(writes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``seq, gfid, svr_rank, app_id, cli_id, file_pos, length, log_pos, n_chunks`` of
    ``writes``: each gets whole chunks of its client's log behind those of the writes
    before it, and its index entry names the first."""
    counted = writes.withColumn("n_chunks", chunk_count(F.col("length"), chunk))
    placed = running(counted, ["svr_rank", "app_id", "cli_id"], "seq", "upto", F.col("n_chunks"), F.sum)
    log_pos = (F.col("upto") - F.col("n_chunks")) * chunk
    return placed.select("seq", "gfid", "svr_rank", "app_id", "cli_id", "file_pos", "length", log_pos.alias("log_pos"), "n_chunks")


HOLDER = ["svr_rank", "app_id", "cli_id"]


def stored(pieces: DataFrame, memory: int) -> DataFrame:
    """Pieces ``svr_rank, app_id, cli_id, log_start, payload`` of logs as they are kept:
    ``store`` is 0 for the first ``memory`` bytes of a log and 1 for its spill file,
    ``at`` the place in it. A piece over the seam becomes two."""
    split = memory_spill(F.col("log_start"), F.octet_length("payload").cast("long"), memory)
    pieces = pieces.withColumn("s", split)
    part = lambda store, at, start, n: F.struct(F.lit(store).alias("store"), at.cast("long").alias("at"), F.substring("payload", start, n.cast("int")).alias("payload"), n.alias("n"))
    both = F.array(part(0, F.col("log_start"), F.lit(1), F.col("s.mem")), part(1, F.col("s.spill_off"), (F.col("s.mem") + 1).cast("int"), F.col("s.spill")))
    return pieces.select(*HOLDER, F.explode(F.filter(both, lambda p: p["n"] > 0)).alias("p")).select(*HOLDER, "p.store", "p.at", "p.payload")


def fetched(kept: DataFrame, ranges: DataFrame, memory: int) -> DataFrame:
    """Ranges ``req_id, svr_rank, app_id, cli_id, log_offset, length`` with ``data``, read
    from what ``stored`` keeps; a range over the seam is put together from both
    sides. Null where a byte is in neither."""
    split = memory_spill(F.col("log_offset"), F.col("length"), memory)
    ranges = ranges.where("length > 0").withColumn("s", split)
    part = lambda store, at, n: F.struct(F.lit(store).alias("store"), at.alias("at"), n.alias("n"))
    both = F.array(part(0, F.col("log_offset"), F.col("s.mem")), part(1, F.col("s.spill_off"), F.col("s.spill")))
    asked = ranges.select("req_id", *HOLDER, F.explode(F.filter(both, lambda p: p["n"] > 0)).alias("p"))
    # Either store is a log of its own to the reader.
    own = lambda store: F.concat_ws("/", F.col("cli_id"), store).alias("cli_id")
    asked = asked.select("req_id", "svr_rank", "app_id", own(F.col("p.store")), F.col("p.store").alias("store"), F.col("p.at").alias("log_offset"), F.col("p.n").alias("length"))
    got = serve(asked, kept.select("svr_rank", "app_id", own(F.col("store")), F.col("at").alias("log_start"), "payload"))
    whole = got.groupBy("req_id").agg(F.sort_array(F.collect_list(F.struct("store", "data"))).alias("p"), F.bool_and(F.col("data").isNotNull()).alias("full"))
    data = F.when(F.col("full"), F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["data"])))
    return ranges.drop("s").join(whole.select("req_id", data.alias("data")), "req_id", "left")


def log_sizes(logs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Bytes, chunks, and the parts in memory and spilled of each client's log,
    from ``logs(svr_rank, app_id, cli_id, log_pos, length)``."""
    return logs.groupBy("svr_rank", "app_id", "cli_id").agg(
        F.sum("length").alias("n_bytes"), F.max(F.col("log_pos") + F.col("length")).alias("end")
    ).withColumn("n_chunks", chunk_count(F.col("end"), chunk))


class Slots:
    """First-fit reservation in a bitmap kept as an integer. Requests for more
    than eight slots start at a multiple of eight, and are looked for from the byte
    of the highest slot in use, so that they fill no hole below it."""

    def __init__(self, total: int):
        self.total, self.used = total, 0

    def reserve(self, count: int, limit: int | None = None) -> int | None:
        step = 8 if count > 8 else 1
        run = (1 << count) - 1
        at = (self.used.bit_length() - 1) // 8 * 8 if count > 8 and self.used else 0
        while at + count <= (self.total if limit is None else limit):
            taken = (self.used >> at) & run
            if not taken:
                self.used |= run << at
                return at
            at += -(-taken.bit_length() // step) * step
        return None

    def free_at(self, at: int, count: int) -> bool:
        return at + count <= self.total and not (self.used >> at) & ((1 << count) - 1)

    def take(self, at: int, count: int) -> None:
        self.used |= ((1 << count) - 1) << at

    def tail(self) -> int:
        """Free slots at the end."""
        return self.total - self.used.bit_length()

    def release(self, at: int, count: int) -> None:
        self.used &= ~(((1 << count) - 1) << at)


class Log:
    """Chunks of one client's log: a map of those in memory and one of those in
    the spill file, whose numbers go on after the former."""

    def __init__(self, memory: int, spill: int):
        self.memory, self.spill = Slots(memory), Slots(spill)

    def allocate(self, count: int) -> int | None:
        """First chunk of ``count`` consecutive ones: in memory, else over the seam
        from memory's free tail, else in the spill file; None if all is full."""
        if count <= self.memory.total and (at := self.memory.reserve(count)) is not None:
            return at
        tail = self.memory.tail()
        if 0 < tail < count and self.spill.free_at(0, count - tail):
            start = self.memory.total - tail
            self.memory.take(start, tail)
            self.spill.take(0, count - tail)
            return start
        at = self.spill.reserve(count) if count <= self.spill.total else None
        return None if at is None else self.memory.total + at

    def release(self, at: int, count: int) -> None:
        inside = max(0, min(count, self.memory.total - at))
        if inside:
            self.memory.release(at, inside)
        if count > inside:
            self.spill.release(max(0, at - self.memory.total), count - inside)


def fold(ops: DataFrame, keys: list[str], step, schema: str) -> DataFrame:
    """Run the operations of each group in order of ``seq`` through ``step(state,
    row) -> (state, value)``. Order matters here, so a group is one task; it comes
    batch by batch and only the state is kept, so its length does not matter."""
    columns = [*keys, "seq", "op", "count", "ref"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state = None, None
        for pdf in batches:
            out = []
            for row in pdf[columns].itertuples(index=False, name=None):
                if row[: len(keys)] != group:
                    group, state = row[: len(keys)], None
                state, value = step(state, *row[len(keys) :])
                out.append(value)
            yield pdf[[*keys, "seq", "op", "count"]].assign(start=pd.array(out, dtype="Int64"))

    ordered = ops.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "seq")
    return ordered.mapInPandas(run, schema)


def slot_map(ops: DataFrame, total: int) -> DataFrame:
    """``start`` of each of ``ops(map_id, seq, op, count, ref)``: RESERVE gets the
    first free run of ``count`` slots, RELEASE gives back what the operation with
    seq ``ref`` got. Null where nothing fits or nothing was held."""

    def step(state, seq, op, count, ref):
        slots, held = state or (Slots(total), {})
        if op == "RESERVE":
            at = slots.reserve(int(count))
            if at is not None:
                held[seq] = (at, int(count))
            return (slots, held), at
        at, n = held.pop(int(ref), (None, 0)) if ref == ref and ref is not None else (None, 0)
        if at is not None:
            slots.release(at, n)
        return (slots, held), at

    return fold(ops, ["map_id"], step, "map_id long, seq long, op string, count long, start long")


def log_allocation(ops: DataFrame, memory: int, spill: int) -> DataFrame:
    """As ``slot_map`` for chunks of each client's log (``log_id``) with ``memory``
    chunks in memory and ``spill`` chunks in the spill file."""

    def step(state, seq, op, count, ref):
        log, held = state or (Log(memory, spill), {})
        if op == "RESERVE":
            at = log.allocate(int(count))
            if at is not None:
                held[seq] = (at, int(count))
            return (log, held), at
        at, n = held.pop(int(ref), (None, 0)) if ref == ref and ref is not None else (None, 0)
        if at is not None:
            log.release(at, n)
        return (log, held), at

    return fold(ops, ["log_id"], step, "log_id long, seq long, op string, count long, start long")


def id_stack(ops: DataFrame, capacity: int) -> DataFrame:
    """Ids that POP takes from a stack of free ones and PUSH (of what the pop with
    seq ``ref`` took) gives back, last in first out."""

    def step(state, seq, op, count, ref):
        free, held = state or (list(range(capacity - 1, -1, -1)), {})
        if op == "POP":
            got = free.pop() if free else None
            if got is not None:
                held[seq] = got
            return (free, held), got
        got = held.pop(int(ref), None) if ref == ref and ref is not None else None
        if got is not None:
            free.append(got)
        return (free, held), got

    return fold(ops, ["map_id"], step, "map_id long, seq long, op string, count long, start long")


def longest_zero_run(byte: Column) -> Column:
    """Length and start of the longest run of zero bits in a byte; of equal runs
    the lowest."""
    starts = F.sequence(F.lit(0), F.lit(7))
    bit = lambda at: F.get(F.array(*[F.getbit(byte.cast("long"), F.lit(i)) for i in range(8)]), at)

    def run_from(start: Column) -> Column:
        step = lambda acc, at: F.when((at < start) | acc["stop"], acc).otherwise(
            F.struct((bit(at) != 0).alias("stop"), F.when(bit(at) == 0, acc["n"] + 1).otherwise(acc["n"]).alias("n"))
        )
        first = F.struct(F.lit(False).alias("stop"), F.lit(0).alias("n"))
        return F.struct(F.aggregate(starts, first, step, lambda a: a["n"]).alias("n"), (-start).alias("at"))

    best = F.array_max(F.transform(starts, run_from))
    return F.struct(best["n"].alias("length"), F.when(best["n"] > 0, -best["at"]).alias("start"))
