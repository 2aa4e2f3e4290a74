"""Extent algebra: which write holds each byte of a file.

``writes`` have ``seq, gfid, svr_rank, app_id, cli_id, file_pos, length,
log_pos``; extents have ``gfid, start, end, svr_rank, app_id, cli_id, log_pos``
with both ends included, and those of a file are disjoint. ``seq`` is the order
of commits; no two writes to a byte may share one, for which ``check_order`` looks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .intervals import above, blocks, overlap_join, with_neighbours

OWNER = ["svr_rank", "app_id", "cli_id"]
EXTENT = ["gfid", "start", "end", *OWNER, "log_pos"]


def pieces(writes: DataFrame) -> DataFrame:
    """Elementary ranges ``gfid, start, end`` between neighbouring ends of writes,
    each with the last write over it: ``seq``, its owner, and the log position of
    the piece. Writes without length and ranges under no write give nothing.

    Each write paints its dyadic blocks; a block keeps the write with the highest
    ``seq``, by partial aggregation; a piece then takes the highest among the
    blocks over it. No write is compared with another. Rows of a file that share a
    ``seq`` must be disjoint, as are the pieces left of one write.
    """
    writes = writes.where("length > 0").withColumn("end", F.col("file_pos") + F.col("length") - 1)
    painted = writes.select("gfid", "seq", F.explode(blocks(F.col("file_pos"), F.col("end"))).alias("b"))
    painted = materialize(painted.groupBy("gfid", F.col("b.level").alias("level"), F.col("b.block").alias("block")).agg(F.max("seq").alias("seq")))
    levels = sorted(r[0] for r in painted.select("level").distinct().collect())  # fewer than 64
    points = writes.select("gfid", F.explode(F.array(F.col("file_pos"), F.col("end") + 1)).alias("start")).distinct()
    points = with_neighbours(points, ["gfid"], "start", {"next": (F.col("start"), 1)}).where("next is not null")
    points = points.select("gfid", "start", "next", F.explode(above(F.col("start"), levels or [0])).alias("b"))
    points = points.select("gfid", "start", "next", F.col("b.level").alias("level"), F.col("b.block").alias("block"))
    over = points.join(painted, ["gfid", "level", "block"]).groupBy("gfid", "start", "next").agg(F.max("seq").alias("seq"))
    log_pos = F.col("log_pos") + F.col("start") - F.col("file_pos")
    held = over.join(writes.select("gfid", "seq", *OWNER, "file_pos", "end", "log_pos"), ["gfid", "seq"]).where("file_pos <= start and start <= end")
    return materialize(held.select("gfid", "start", (F.col("next") - 1).alias("end"), "seq", *OWNER, log_pos.alias("log_pos")))


def check_order(writes: DataFrame) -> DataFrame:
    """``writes``, after a look for two writes to one file with one ``seq``, for which
    there is no newest: ValueError names such a file."""
    twice = writes.groupBy("gfid", "seq").agg(F.count("*").alias("n")).where("n > 1").first()
    if twice is not None:
        raise ValueError(f"file {twice['gfid']} has {twice['n']} writes numbered {twice['seq']}")
    return writes


def join_up(ranges: DataFrame, same: list[str]) -> DataFrame:
    """Merge ranges of a file that are neighbours in the file and in the log and
    agree on ``same``. Rows that neither begin nor end a run go, and each run is
    then a beginning followed by its ending, so no running sum is needed."""
    facts = F.struct(F.col("end"), F.col("log_pos"), F.col("start"), *same)
    def fits(a: Column, b: Column) -> Column:
        on = (a["end"] + 1 == b["start"]) & (a["log_pos"] + a["end"] - a["start"] + 1 == b["log_pos"])
        for c in same:
            on = on & a[c].eqNullSafe(b[c])
        return F.coalesce(on, F.lit(False))

    here = F.struct("end", "log_pos", "start", *same)
    both = with_neighbours(ranges, ["gfid"], "start", {"prev": (facts, -1), "next": (facts, 1)})
    both = both.withColumn("begins", ~fits(F.col("prev"), here)).withColumn("ends", ~fits(here, F.col("next")))
    edges = both.where("begins or ends").drop("prev", "next")
    edges = with_neighbours(edges, ["gfid"], "start", {"last": (F.col("end"), 1)})
    end = F.when(F.col("ends"), F.col("end")).otherwise(F.col("last"))
    return edges.where("begins").withColumn("end", end).drop("begins", "ends", "last")


def overlay(writes: DataFrame) -> DataFrame:
    """Extents that are left after all writes, the newest on top, one for each
    unbroken stretch of one write. A trimmed extent keeps its own owner, and its
    log position moves with its start."""
    return join_up(pieces(writes), ["seq", *OWNER])


def extents(writes: DataFrame) -> DataFrame:
    """``overlay`` with neighbours merged where file, log and owner all go on.
    Merging as writes come and merging at the end give the same extents."""
    return join_up(pieces(writes).drop("seq"), OWNER).select(*EXTENT)


def coalesce(table: DataFrame, same_client: bool = True) -> DataFrame:
    """Merge neighbours of an extent table; with ``same_client`` false the client
    is not compared and the first one's stays."""
    return join_up(table.select(*EXTENT), OWNER if same_client else ["svr_rank", "app_id"])


def first_free(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The first part of range 1 outside range 2: the part to its left, else that
    to its right, else null. The ranges overlap."""
    part = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    return F.when(s1 < s2, part(s1, s2 - 1)).when(e1 > e2, part(e2 + 1, e1))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= e2) & (s2 <= e1)


def compare(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """-1, 0 or 1: before, overlapping, after."""
    return F.when(e1 < s2, -1).when(s1 > e2, 1).otherwise(0)


def find(table: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each of ``ranges(req_id, gfid, lo, hi)`` the extent with the lowest
    start that overlaps it; ranges without one keep nulls."""
    hits = overlap_join(ranges, "lo", "hi", table.select(*EXTENT), "start", "end", ["gfid"])
    first = hits.groupBy("req_id").agg(F.min_by(F.struct("start", "end", "log_pos"), "start").alias("x"))
    return ranges.join(first, "req_id", "left").select("req_id", "gfid", "lo", "hi", "x.start", "x.end", "x.log_pos")


def truncate(table: DataFrame, sizes: DataFrame) -> DataFrame:
    """Extents cut at the new sizes of ``sizes(gfid, size)``; a file without a new
    size keeps its extents, and size 0 removes all."""
    cut = table.join(sizes, "gfid", "left").where("size is null or start < size")
    return cut.withColumn("end", F.coalesce(F.least("end", F.col("size") - 1), F.col("end"))).select(*EXTENT)


def remove_range(table: DataFrame, ranges: DataFrame) -> DataFrame:
    """Extents without the bytes from ``lo`` to ``hi`` of ``ranges(gfid, lo, hi)``, of
    which a file may have any number, overlapping too; extents that reach over one
    are split. A removal is a write on top that is then left out."""
    blank = {c: F.lit(None).cast(table.schema[c].dataType).alias(c) for c in (*OWNER, "log_pos")}
    cuts = ranges.where("lo <= hi").groupBy("gfid", F.greatest("lo", F.lit(0).cast("long")).alias("file_pos")).agg(F.max("hi").alias("hi"))
    cuts = cuts.select(F.col("file_pos").alias("seq"), "gfid", *[blank[c] for c in OWNER], "file_pos", (F.col("hi") - F.col("file_pos") + 1).alias("length"), blank["log_pos"])
    left = pieces(as_writes(table).unionByName(cuts)).where("seq < 0")
    return join_up(left, ["seq", *OWNER]).select(*EXTENT)


def as_writes(table: DataFrame) -> DataFrame:
    """An extent table as writes that are older than any of a log, whose numbers
    are not negative. Extents are disjoint, so their own order does not matter;
    the start, taken negative, tells those of a file apart."""
    return table.select((-F.col("start") - 1).alias("seq"), "gfid", *OWNER, F.col("start").alias("file_pos"), (F.col("end") - F.col("start") + 1).alias("length"), "log_pos")


def add(files: DataFrame, table: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What commits do to ``files(gfid, size, is_laminated)`` and their extents:
    ``batches`` with ``rc`` (ENOENT for a file that is not there, EINVAL for one that
    is published, else OK), the extents with the accepted writes on top, and files
    with sizes grown to their last byte."""
    there = files.select("gfid", F.lit(True).alias("_there"), F.col("is_laminated").alias("_done"))
    rc = F.when(F.col("_there").isNull(), "ENOENT").when(F.col("_done"), "EINVAL").otherwise("OK")
    judged = batches.join(there, "gfid", "left").withColumn("rc", rc).drop("_there", "_done")
    good = judged.where("rc = 'OK'").drop("rc")
    after = materialize(extents(as_writes(table).unionByName(good)))
    ends = good.where("length > 0").groupBy("gfid").agg((F.max(F.col("file_pos") + F.col("length"))).alias("_end"))
    grown = files.join(ends, "gfid", "left").withColumn("size", F.greatest("size", F.coalesce("_end", F.lit(0)))).drop("_end")
    return judged, after, grown


def truncate_files(files: DataFrame, table: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``add`` for new sizes ``sizes(gfid, size)``, one for a file: ``sizes`` with
    ``rc``, the extents cut, and files with the sizes set; growth leaves a hole."""
    there = files.select("gfid", F.lit(True).alias("_there"), F.col("is_laminated").alias("_done"))
    rc = F.when(F.col("_there").isNull(), "ENOENT").when(F.col("_done"), "EINVAL").otherwise("OK")
    judged = sizes.join(there, "gfid", "left").withColumn("rc", rc).drop("_there", "_done")
    good = judged.where("rc = 'OK'").select("gfid", "size")
    after = files.join(good.withColumnRenamed("size", "_new"), "gfid", "left").withColumn("size", F.coalesce("_new", "size")).drop("_new")
    return judged, truncate(table, good), after


def stats(table: DataFrame) -> DataFrame:
    """Number of extents, bytes held and highest offset of each file."""
    return table.groupBy("gfid").agg(
        F.count("*").alias("n_extents"), F.sum(F.col("end") - F.col("start") + 1).alias("n_bytes"), F.max("end").alias("max_offset")
    )


def clip(start: Column, end: Column, log_pos: Column, lo: Column, hi: Column) -> Column:
    """An extent within a request: offset, length, and log position moved by what
    is cut off on the left."""
    first = F.greatest(start, lo)
    return F.struct(first.alias("offset"), (F.least(end, hi) - first + 1).alias("length"), (log_pos + first - start).alias("log_offset"))


def chunks(table: DataFrame, requests: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """For ``requests(req_id, gfid, offset, length)`` the clipped parts of all
    extents that they meet: ``req_id, gfid, offset, length, log_offset`` and the
    holder. ``keys`` are what both must agree on, the file if not given."""
    keys = keys or ["gfid"]
    asked = requests.where("length > 0").select("req_id", *keys, F.col("offset").alias("lo"), (F.col("offset") + F.col("length") - 1).alias("hi"))
    met = overlap_join(asked, "lo", "hi", table.select(*EXTENT), "start", "end", keys)
    part = clip(F.col("start"), F.col("end"), F.col("log_pos"), F.col("lo"), F.col("hi"))
    return met.select("req_id", "gfid", part.alias("p"), *OWNER).select("req_id", "gfid", "p.*", *OWNER)


def coverage(parts: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request the number of its chunks and bytes, the first and last
    byte covered, and whether no byte is missing: extents are disjoint, so it is
    covered if its chunks' bytes add up to its length."""
    got = parts.groupBy("req_id").agg(
        F.count("*").alias("n_chunks"), F.sum("length").alias("n_bytes"), F.min("offset").alias("first"),
        F.max(F.col("offset") + F.col("length") - 1).alias("last"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = requests.join(got, "req_id", "left")
    nread = F.coalesce(F.col("last") + 1 - F.col("offset"), F.lit(0)).alias("nread")
    return joined.select("req_id", "gfid", zero("n_chunks"), zero("n_bytes"), (F.col("first") - F.col("offset")).alias("begin"), nread, (F.coalesce("n_bytes", F.lit(0)) == F.col("length")).alias("covered"))


def flatten_index(pending: DataFrame) -> DataFrame:
    """The index that a sync hands over: disjoint entries of unsynced writes in
    order of file and position, as ``gfid, file_pos, log_pos, length``."""
    entries = extents(pending).select("gfid", F.col("start").alias("file_pos"), "log_pos", (F.col("end") - F.col("start") + 1).alias("length"))
    return entries.orderBy("gfid", "file_pos")
