"""Synthetic access patterns, bandwidth figures, and conflicting accesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .dominance import ordered_overlaps
from .intervals import running


def access_pattern(spark: SparkSession, pattern: str, ranks: int, blocks: int, block: int, chunk: int) -> DataFrame:
    """``rank, block_no, chunk_no, gfid, offset, length, reader`` of each access:
    ``n1`` shares one file, in which a block of every rank stands before the next
    of any; ``nn`` has a file for each rank. ``reader`` reads what another wrote."""
    per_block = -(-block // chunk)
    base = spark.range(ranks * blocks * per_block).select(
        F.floor(F.col("id") / (blocks * per_block)).cast("int").alias("rank"),
        F.floor(F.col("id") / per_block % blocks).cast("int").alias("block_no"), (F.col("id") % per_block).cast("int").alias("chunk_no"),
    )
    inside = F.col("chunk_no").cast("long") * chunk
    shared = F.col("block_no").cast("long") * block * ranks + F.col("rank").cast("long") * block
    own = F.col("block_no").cast("long") * block
    return base.select(
        "rank", "block_no", "chunk_no", (F.lit(0) if pattern == "n1" else F.col("rank")).alias("gfid"),
        ((shared if pattern == "n1" else own) + inside).alias("offset"), F.least(F.lit(chunk), block - inside).cast("long").alias("length"),
        (ranks - 1 - F.col("rank")).alias("reader"),
    )


def bandwidth(times: DataFrame) -> DataFrame:
    """Of ``times(phase, rank, n_bytes, seconds)``: bytes, the sum of the ranks'
    rates (aggregate), and all bytes over the slowest rank's time (effective)."""
    return times.groupBy("phase").agg(
        F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("n_bytes") / F.col("seconds")).alias("aggregate_rate"),
        (F.sum("n_bytes") / F.max("seconds")).alias("effective_rate"), F.count("*").alias("n_ranks"),
    )


def overlapping_pairs(writes: DataFrame, keys: list[str]) -> DataFrame:
    """``n_pairs`` of overlapping ranges among rows with equal ``keys``, counted
    without making a pair: all pairs less those of which one ends before the
    other starts. ``writes`` have ``file_pos`` and ``length``."""
    ends = F.struct((F.col("file_pos") + F.col("length")).alias("at"), F.lit(0).alias("is_start"))
    starts = F.struct(F.col("file_pos").alias("at"), F.lit(1).alias("is_start"))
    marks = writes.where("length > 0").select(*keys, F.explode(F.array(ends, starts)).alias("m")).select(*keys, "m.at", "m.is_start")
    marks = marks.groupBy(*keys, "at").agg(F.sum(1 - F.col("is_start")).alias("ended"), F.sum("is_start").alias("started"))
    before = running(marks, keys, "at", "gone", F.col("ended"), F.sum)
    before = before.withColumn("gone", F.col("gone").cast("decimal(38,0)") * F.col("started"))
    got = before.groupBy(*keys).agg(F.sum("started").cast("decimal(19,0)").alias("n"), F.sum("gone").alias("apart"))
    return got.select(*keys, (F.col("n") * (F.col("n") - 1) / 2 - F.col("apart")).cast("long").alias("n_pairs"))


def conflicts(writes: DataFrame) -> DataFrame:
    """Overlapping pairs of writes to each file: by one client and by two."""
    same = overlapping_pairs(writes, ["gfid", "cli_id"]).groupBy("gfid").agg(F.sum("n_pairs").alias("same_client"))
    every = overlapping_pairs(writes, ["gfid"])
    return every.join(same, "gfid").select("gfid", "same_client", (F.col("n_pairs") - F.col("same_client")).alias("different_clients"))


def conflict_kinds(accesses: DataFrame) -> DataFrame:
    """``gfid, kind, synced, n_pairs`` of overlapping accesses by two clients in
    ``accesses(seq, gfid, cli_id, op, offset, length)``, where one of the two writes:
    RAW, WAR or WAW by the order of ``seq``. A pair is ``synced`` if the earlier
    client's next SYNC of the file comes before the later access. ``op`` is READ,
    WRITE or SYNC; SYNC rows have no range. Ids are whole numbers. Pairs are counted
    without being made: all of a file less those of one client."""
    syncs = accesses.withColumn("mark", F.when(F.col("op") == "SYNC", F.col("seq")))
    synced = running(syncs.withColumn("back", -F.col("seq")), ["gfid", "cli_id"], "back", "sync", F.col("mark"), F.min)
    ranges = synced.where("op <> 'SYNC' and length > 0").select(
        "gfid", "cli_id", "seq", "sync", (F.col("op") == "WRITE").alias("write"), F.col("offset").alias("start"), (F.col("offset") + F.col("length") - 1).alias("end"),
    )
    ranges = materialize(ranges.dropna(subset=["gfid", "cli_id", "seq", "start"]))
    every, same = ordered_overlaps(ranges, ["gfid"]), ordered_overlaps(ranges, ["gfid", "cli_id"])
    counts = every.unionByName(same.withColumn("n", -F.col("n"))).groupBy("owner", "first", "later")
    n = lambda late: F.coalesce(F.sum(F.when(F.col("late") == late, F.col("n"))), F.lit(0))
    counts = counts.agg(n(1).alias("synced"), (n(0) - n(1)).alias("other"))
    letter = lambda side: F.when(F.col(side) == 1, "W").otherwise("R")
    split = F.explode(F.array(F.struct(F.lit(True).alias("synced"), F.col("synced").alias("n_pairs")), F.struct(F.lit(False).alias("synced"), F.col("other").alias("n_pairs"))))
    found = counts.select(F.col("owner").cast(accesses.schema["gfid"].dataType).alias("gfid"), F.concat(letter("later"), F.lit("A"), letter("first")).alias("kind"), split.alias("c"))
    return found.select("gfid", "kind", "c.synced", "c.n_pairs").where("n_pairs > 0")
