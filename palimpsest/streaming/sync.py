"""Commits as a stream: each micro-batch of an operation log is an epoch."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators.extents import OWNER, coalesce, extents, overlay
from ..session import materialize, shared_folder

LOG = "seq long, gfid int, svr_rank int, app_id int, cli_id int, file_pos long, length long, log_pos long"
TABLE = "gfid int, start long, end long, seq long, svr_rank int, app_id int, cli_id int, log_pos long, epoch long, bucket int"
BUCKETS = 64  # parts of the table by file, of which an epoch writes those that it touches
ROWS_PER_FILE = 1_000_000


def read_log(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of writes from Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def bucket_of(file_id: Column) -> Column:
    return F.pmod(F.xxhash64(file_id), F.lit(BUCKETS)).cast("int")


def latest(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The rows of the table at ``table``, of each bucket those of its last epoch, or
    its last one before ``before``; None where there is no table yet."""
    try:
        rows = spark.read.schema(TABLE).parquet(table)
    except AnalysisException:
        return None
    rows = rows.where(F.col("epoch") < before) if before is not None else rows
    last = rows.groupBy("bucket").agg(F.max("epoch").alias("epoch"))
    return rows.join(F.broadcast(last), ["bucket", "epoch"])  # one row for each bucket


def commit(before: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The pieces of the buckets that ``batch`` touches after one more epoch. Pieces
    keep the ``seq`` of their write, so a commit that comes late finds its place."""
    batch = batch.select(*[c.split(" ")[0] for c in LOG.split(", ")])
    if before is not None:
        touched = batch.select(bucket_of(F.col("gfid")).alias("bucket")).distinct()
        old = before.join(F.broadcast(touched), "bucket", "left_semi")  # BUCKETS rows at most
        held = old.select("seq", "gfid", *OWNER, F.col("start").alias("file_pos"), (F.col("end") - F.col("start") + 1).alias("length"), "log_pos")
        batch = held.unionByName(batch)
    return overlay(batch).withColumn("bucket", bucket_of(F.col("gfid")))


def maintain(log: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep the table at ``table`` up to date with the stream ``log``.

    An epoch writes the buckets that it touches to ``table/epoch=N/bucket=B``, from
    each one's last epoch before it, so an epoch that is run again after a failure
    overwrites itself: each write counts once. What counts is the order of ``seq``,
    whatever the batches."""
    spark = log.sparkSession

    def epoch(batch: DataFrame, number: int) -> None:
        made = commit(latest(spark, table, number), batch)
        made.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/epoch={number}")

    return log.writeStream.foreachBatch(epoch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def size_changes(log: DataFrame) -> DataFrame:
    """Running size of each file and number of writes, as an update stream."""
    return log.groupBy("gfid").agg(F.max(F.col("file_pos") + F.col("length")).alias("size"), F.count("*").alias("n_writes"))


def replay(writes: DataFrame, epochs: int) -> DataFrame:
    """The extent table after ``writes`` have come in about ``epochs`` commits, by order
    of ``seq``, through a stream; files are kept in the shared folder, and have about
    ROWS_PER_FILE rows in a large log. An empty log gives an empty table."""
    spark = writes.sparkSession
    writes = materialize(writes.select([c.split(" ")[0] for c in LOG.split(", ")]))
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    n = writes.count()
    if not n:
        return extents(writes)
    per_epoch = max(1, math.ceil(n / epochs / ROWS_PER_FILE))
    writes.repartitionByRange(epochs * per_epoch, "seq").write.parquet(f"{folder}/log")
    maintain(read_log(spark, f"{folder}/log", per_epoch), f"{folder}/table", f"{folder}/progress").awaitTermination()
    return coalesce(latest(spark, f"{folder}/table"))
