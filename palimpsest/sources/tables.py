"""The engine's input tables, derived from the tables in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import gfid


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_log(spark: SparkSession, folder: str) -> DataFrame:
    """A log of writes from ``events``: many clients on few files, some writing in
    a row and some at scattered places."""
    by_user = W.partitionBy("user_id").orderBy("event_id")
    streams = F.col("event_type").isin("view", "click")
    placed = read(spark, folder, "events").select("event_id", "user_id", "event_type").withColumn("rn", F.row_number().over(by_user) - 1)
    log = placed.select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 10).cast("int").alias("gfid"), (F.col("user_id") % 4).cast("int").alias("svr_rank"),
        F.lit(1).alias("app_id"), F.col("user_id").cast("int").alias("cli_id"),
        F.when(streams, F.col("rn").cast("long") * 64).otherwise(F.col("event_id") * 7919 % 8192).alias("file_pos"),
        F.when(streams, F.lit(64).cast("long")).otherwise(1 + F.col("event_id") * 104729 % 256).alias("length"),
    )
    before = W.partitionBy("cli_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return log.withColumn("log_pos", F.coalesce(F.sum("length").over(before), F.lit(0)))


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    events = read(spark, folder, "events").where("event_id % 50 = 0")
    return events.select(
        F.col("event_id").alias("req_id"), (F.col("user_id") % 10).cast("int").alias("gfid"), F.col("user_id").cast("int").alias("cli_id"),
        (F.col("event_id") * 31 % 8192).alias("offset"), (1 + F.col("event_id") % 512).alias("length"),
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    path = F.concat(F.lit("/work/"), F.col("url"))
    return pages.select(
        "page_id", path.alias("filename"), gfid(path).alias("gfid"), F.octet_length("html").cast("long").alias("size"),
        F.when(F.col("page_id") % 3 == 0, 0o444).otherwise(0o644).cast("int").alias("mode"),
        (F.col("page_id") % 5 != 0).alias("is_shared"), (F.col("page_id") % 3 == 0).alias("is_laminated"),
    )


def attribute_ops(spark: SparkSession, folder: str) -> DataFrame:
    kinds = {"signup": "CREATE", "view": "UTIME", "click": "DATA", "purchase": "CHMOD", "error": "TRUNCATE"}
    op = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    n = F.col("event_id")
    return read(spark, folder, "events").select(
        n.alias("seq"), (F.col("user_id") % 10).cast("int").alias("gfid"), F.coalesce(op, F.lit("LAMINATE")).alias("op"),
        F.when(n % 7 != 0, n * 17 % 512).alias("mode"), F.when(n % 3 != 0, n * 31 % 65536).alias("size"),
        F.when(n % 5 != 0, n * 1000).alias("mtime"), F.when(n % 11 != 0, n % 1000).alias("uid"),
    )


def payload(spark: SparkSession, folder: str, piece: int = 64, uneven: bool = False) -> DataFrame:
    """Client logs from ``documents``: the UTF-8 bytes of each text in pieces of
    ``piece`` bytes; with ``uneven``, each odd one ends 23 bytes later."""
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("cli_id"), data.alias("data"))
    last = F.greatest(F.octet_length("data") - 1, F.lit(0)).cast("long")
    cut = docs.withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / piece))))
    late = lambda no: F.when(F.lit(uneven) & (no > 0) & (no % 2 == 0), 23).otherwise(0)
    start, end = F.col("no") * piece + late(F.col("no")), (F.col("no") + 1) * piece + late(F.col("no") + 1)
    bytes_of = F.col("data").substr((F.col("log_start") + 1).cast("int"), (end - F.col("log_start")).cast("int"))
    cut = cut.withColumn("log_start", start)
    return cut.select((F.col("cli_id") % 4).cast("int").alias("svr_rank"), F.lit(1).alias("app_id"), "cli_id", "log_start", bytes_of.alias("payload"))
