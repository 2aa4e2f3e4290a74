"""Batches of file operations, transfers between namespaces, and staging."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .intervals import running, with_neighbours
from .reads import readable

# Operations of a batch, the phase in which each runs, and sizes.
PHASES = {"READ": 1, "WRITE": 2, "ZERO": 2, "TRUNC": 3, "SYNC_META": 4, "SYNC_DATA": 4}
COPY_CHUNK = 8 << 20
STAGE_BLOCK = 16 << 20
STAGE_LEAST = 8


def phases(requests: DataFrame) -> DataFrame:
    """Requests ``batch, pos, op, gfid, offset, nbytes`` with ``phase`` and ``turn``,
    their place in the order in which a batch runs: reads, then writes, then
    truncations, then syncs. Operations without effect have no turn; an unknown one
    fails its whole batch."""
    table = F.create_map(*[F.lit(x) for pair in PHASES.items() for x in pair])
    known = requests.withColumn("phase", table[F.col("op")])
    bad = F.max((F.col("phase").isNull() & (F.col("op") != "NOP")).cast("int")).over(W.partitionBy("batch")) == 1
    by = W.partitionBy("batch", F.col("phase").isNull()).orderBy("phase", "pos")
    turn = F.when(F.col("phase").isNotNull() & ~bad, F.row_number().over(by))
    return known.withColumn("rc", F.when(bad, "EINVAL").otherwise("OK")).withColumn("turn", turn)


def batch_sizes(requests: DataFrame, sizes: DataFrame) -> DataFrame:
    """``gfid, batch, before, after``: the size of each file of ``sizes(gfid, size)``
    before and after each batch of ``requests``, which have passed ``phases`` and run
    in order of ``batch``. Writes grow a file, and then the last truncation of the
    batch sets its size. A truncation starts a stretch of batches, in which the size
    is a running maximum."""
    end = F.max(F.when(F.col("op").isin("WRITE", "ZERO") & (F.col("nbytes") > 0), F.col("offset") + F.col("nbytes")))
    cut = F.max_by("offset", F.when(F.col("op") == "TRUNC", F.col("pos")))
    steps = requests.where("turn is not null").groupBy("gfid", "batch").agg(end.alias("end"), cut.alias("cut")).join(sizes.select("gfid", "size"), "gfid")
    steps = running(steps, ["gfid"], "batch", "since", F.when(F.col("cut").isNotNull(), F.col("batch")), F.max)
    steps = running(steps, ["gfid", "since"], "batch", "most", F.coalesce("cut", "end"), F.max)
    after = F.when(F.col("since").isNotNull(), F.col("most")).otherwise(F.greatest("size", "most"))
    steps = with_neighbours(steps.withColumn("after", after), ["gfid"], "batch", {"before": (F.col("after"), -1)})
    return steps.select("gfid", "batch", F.coalesce("before", "size").alias("before"), "after")


def dispatch(requests: DataFrame, sizes: DataFrame) -> DataFrame:
    """``requests`` with ``rc`` and ``count`` after their batches have run on the files
    of ``sizes(gfid, size)``: a read returns what stands before the end that the file
    has before its batch, a write or zeroing its bytes, others 0; a file that is not
    there is EINVAL, as is each request of a batch with an unknown operation. Of a
    batch's SYNC_DATA requests only the first does anything (``acts``)."""
    known = phases(requests)
    table = materialize(batch_sizes(known, sizes).select("gfid", "batch", "before"))
    joined = known.join(sizes.select("gfid", F.lit(True).alias("there")), "gfid", "left").join(table, ["gfid", "batch"], "left")
    lost = F.col("there").isNull() & F.col("turn").isNotNull() & (F.col("op") != "SYNC_DATA")
    rc = F.when(lost, "EINVAL").otherwise(F.col("rc"))
    did = F.when(F.col("turn").isNull() | lost, 0).when(F.col("op") == "READ", readable(F.col("offset"), F.col("nbytes"), F.col("before")))
    did = did.when(F.col("op").isin("WRITE", "ZERO"), F.col("nbytes")).otherwise(0).cast("long")
    first = F.min(F.when((F.col("op") == "SYNC_DATA") & F.col("turn").isNotNull(), F.col("pos"))).over(W.partitionBy("batch"))
    acts = F.col("turn").isNotNull() & ~lost & ((F.col("op") != "SYNC_DATA") | (F.col("pos") == first))
    return joined.withColumn("acts", acts).select("batch", "pos", "op", "gfid", "phase", "turn", rc.alias("rc"), did.alias("count"), "acts")


def batch_writes(requests: DataFrame, sizes: DataFrame) -> DataFrame:
    """``seq, gfid, file_pos, length, zero`` of what the batches write, less what a
    later truncation cuts off, so that an overlay of them is the files' content;
    ``zero`` tells those that write zeros. A batch's truncations come after its
    writes, so a write is cut at the least size set in its batch or later."""
    good = phases(requests).where("turn is not null").join(sizes.select("gfid"), "gfid", "left_semi")
    steps = good.groupBy("gfid", "batch").agg(F.min(F.when(F.col("op") == "TRUNC", F.col("offset"))).alias("cut"))
    steps = running(steps.withColumn("back", -F.col("batch")), ["gfid"], "back", "limit", F.col("cut"), F.min)
    steps = materialize(steps.select("gfid", "batch", "limit"))
    per_batch = 1 << 20  # requests of a batch are fewer
    writes = good.where("op in ('WRITE', 'ZERO')").join(steps, ["gfid", "batch"])
    length = F.greatest(F.lit(0), F.least("nbytes", F.coalesce(F.col("limit") - F.col("offset"), F.col("nbytes"))))
    seq = F.col("batch") * per_batch + F.col("turn")
    return writes.select(seq.alias("seq"), "gfid", F.col("offset").alias("file_pos"), length.cast("long").alias("length"), (F.col("op") == "ZERO").alias("zero"))


def sync_epochs(ops: DataFrame) -> DataFrame:
    """Operations ``seq, cli_id, gfid, op`` with ``epoch``: the ``seq`` of the sync
    that makes each write of a client to a file visible, null while it is not."""
    later = W.partitionBy("cli_id", "gfid").orderBy("seq").rowsBetween(W.currentRow, W.unboundedFollowing)
    sync = F.when(F.col("op") != "WRITE", F.col("seq"))
    return ops.withColumn("epoch", F.min(sync).over(later))


def finished(requests: DataFrame) -> DataFrame:
    """Whether all, and whether any, of each batch's requests are done."""
    return requests.groupBy("batch").agg(F.bool_and("done").alias("all_done"), F.bool_or("done").alias("any_done"), F.count("*").alias("n"))


def validate_transfer(src_inside: Column, dst_inside: Column) -> Column:
    """Exactly one side of a transfer is in the namespace; copying in is left to
    staging."""
    return F.when(src_inside == dst_inside, "EINVAL").when(dst_inside, "ENOSYS").otherwise("OK")


def server_transfers(extents: DataFrame, wanted: DataFrame) -> DataFrame:
    """What each server copies of the files in ``wanted(gfid)``: its own extents,
    as their number, bytes and last byte."""
    mine = extents.join(wanted, "gfid", "left_semi")
    return mine.groupBy("gfid", "svr_rank").agg(
        F.count("*").alias("n_extents"), F.sum(F.col("end") - F.col("start") + 1).alias("n_bytes"), F.max("end").alias("last")
    )


def copy_batches(extents: DataFrame, buffer: int) -> DataFrame:
    """Extents ``gfid, svr_rank, start, end`` with ``batch`` and ``at``: packed in
    order into a buffer that is written when the next one does not fit; one
    longer than the buffer has a batch of its own. What a batch holds depends on
    all before it, so a server's part of a file is one ordered task; only the
    fill is kept."""
    columns = ["gfid", "svr_rank", "start", "end"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, batch, fill = None, 0, 0
        for pdf in batches:
            out, ats = [], []
            for gfid, rank, start, end in pdf[columns].itertuples(index=False, name=None):
                n = end - start + 1
                if (gfid, rank) != group:
                    group, batch, fill = (gfid, rank), 0, 0
                elif fill + n > buffer:
                    batch, fill = batch + 1, 0
                out.append(batch)
                ats.append(fill)
                fill += n
            yield pdf[columns].assign(batch=out, at=ats)

    ordered = extents.select(*columns).repartition("gfid", "svr_rank").sortWithinPartitions(*columns)
    types = {f.name: f.dataType.simpleString() for f in ordered.schema}
    return ordered.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in columns) + ", batch long, at long")


def rank_parts(files: DataFrame, ranks: int, chunk: int = COPY_CHUNK) -> DataFrame:
    """Chunks of ``files(gfid, size)`` that each rank copies: equal shares in a row
    with the remainder one each from rank 0; rank 0 takes all if there are no
    more chunks than ranks."""
    n = F.ceil(F.col("size") / chunk).cast("long")
    serial = F.col("n_chunks") <= ranks
    share, rest = F.floor(F.col("n_chunks") / ranks), F.col("n_chunks") % ranks
    table = files.withColumn("n_chunks", n).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))
    first = F.when(serial, F.lit(0)).otherwise(F.col("rank") * share + F.least(F.col("rank").cast("long"), rest))
    count = F.when(serial, F.when(F.col("rank") == 0, F.col("n_chunks")).otherwise(0)).otherwise(share + (F.col("rank") < rest).cast("long"))
    out = table.select("gfid", "rank", first.cast("long").alias("first_chunk"), count.cast("long").alias("n_chunks"), "size").where("n_chunks > 0")
    start = F.col("first_chunk") * chunk
    return out.select("gfid", "rank", "first_chunk", "n_chunks", start.alias("offset"), (F.least(start + F.col("n_chunks") * chunk, F.col("size")) - start).alias("n_bytes"))


def stage_parts(files: DataFrame, ranks: int, block: int = STAGE_BLOCK, least: int = STAGE_LEAST) -> DataFrame:
    """Blocks of ``files(gfid, size)`` that each rank stages: ``least`` or an equal
    share, rounded up so that no block at the end is left out."""
    n = F.ceil(F.col("size") / block).cast("long")
    per_rank = F.greatest(F.lit(least).cast("long"), F.ceil(F.col("n_blocks") / ranks))
    table = files.withColumn("n_blocks", n).withColumn("per_rank", per_rank)
    table = table.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))
    first = F.col("rank") * F.col("per_rank")
    return table.where(first < F.col("n_blocks")).select(
        "gfid", "rank", (first * block).alias("offset"), (F.least((first + F.col("per_rank")) * block, F.col("size")) - first * block).alias("n_bytes"),
    )


def transfer_manager(index: Column, ranks: int) -> Column:
    """The rank that runs the transfer with this number, counted from 1."""
    return F.pmod(index - 1, F.lit(ranks)).cast("int")


def manifest(lines: DataFrame) -> DataFrame:
    """``line_no, src, dst, rc`` of a staging manifest's ``lines(line_no, line)``:
    two names on a line, in quotes where they hold spaces; blank lines and
    comments are left out, and other numbers of names are EINVAL."""
    used = lines.where(~F.col("line").rlike(r"^\s*(#.*)?$"))
    words = F.regexp_extract_all("line", F.lit(r'"([^"]*)"|([^\s"]+)'), F.lit(0))
    words = F.transform(words, lambda w: F.btrim(w, F.lit('"')))
    good = (F.size("words") == 2) & (F.size(F.split("line", '"')) % 2 == 1)
    pick = lambda i: F.when(good, F.get("words", F.lit(i)))
    return used.withColumn("words", words).select("line_no", pick(0).alias("src"), pick(1).alias("dst"), F.when(good, "OK").otherwise("EINVAL").alias("rc"))


def stage(lines: DataFrame, files: DataFrame, copies: DataFrame, times: DataFrame, ranks: int, block: int = STAGE_BLOCK) -> DataFrame:
    """What staging a manifest does, a row for each of its lines: ``rc`` (EINVAL for a
    bad line, ENOENT for a source that is not in ``files(path, data)``, EIO for one
    whose copy in ``copies(path, data)`` has other bytes, else OK), bytes and ranks
    that copied, and ``seconds``, those of the slowest rank in ``times(path, rank,
    seconds)``."""
    asked = manifest(lines)
    known = files.select(F.col("path").alias("src"), F.octet_length("data").cast("long").alias("size"), F.md5("data").alias("md5"))
    made = copies.select(F.col("path").alias("dst"), F.md5("data").alias("copied"))
    joined = materialize(asked.join(known, "src", "left").join(made, "dst", "left"))
    parts = stage_parts(joined.where("size is not null").select(F.col("line_no").alias("gfid"), "size"), ranks, block)
    parts = parts.join(joined.select(F.col("line_no").alias("gfid"), F.col("src").alias("path")), "gfid").join(times, ["path", "rank"], "left")
    done = parts.groupBy(F.col("gfid").alias("line_no")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_ranks"), F.max("seconds").alias("seconds"))
    rc = F.when(F.col("rc") != "OK", F.col("rc")).when(F.col("size").isNull(), "ENOENT").when(~F.col("md5").eqNullSafe(F.col("copied")), "EIO").otherwise("OK")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.withColumn("rc", rc).join(done, "line_no", "left").select("line_no", "src", "dst", "rc", zero("n_bytes"), zero("n_ranks"), "seconds")


def verify(source: DataFrame, copy: DataFrame) -> DataFrame:
    """Whether ``source(gfid, data)`` and ``copy`` have the same MD5, by file."""
    left = source.select("gfid", F.md5("data").alias("src_md5"))
    right = copy.select("gfid", F.md5("data").alias("dst_md5"))
    return left.join(right, "gfid", "full").withColumn("same", F.col("src_md5").eqNullSafe(F.col("dst_md5")))


def write_out(parts: DataFrame, folder: str) -> None:
    """Sink for staged bytes ``path, offset, data``: Parquet in order of path and
    offset, cut by ranges of both, so that no large file passes through one task."""
    parts.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset").write.mode("overwrite").parquet(folder)
