"""Read planning and assembly: from requests to bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import owner
from ..session import materialize
from .extents import chunks, coverage

RESPONSE = 4 << 20  # bytes of an answer to a client at most
CELL = 12  # bits of the narrowest cells in which pieces of logs are looked up


def ordered(requests: DataFrame) -> DataFrame:
    return requests.orderBy("gfid", "offset")


def server_plan(parts: DataFrame) -> DataFrame:
    """Number and bytes of the chunks that each request takes from each server."""
    return parts.groupBy("req_id", "svr_rank").agg(F.count("*").alias("n_chunks"), F.sum("length").alias("n_bytes"))


def submit(parts: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request with its number of servers, chunks and bytes, and ``rc``:
    ENODATA if no extent holds a byte of it."""
    plan = server_plan(parts).groupBy("req_id").agg(F.count("*").alias("n_servers"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_bytes").alias("n_bytes"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rc = F.when(F.col("n_chunks").isNull(), "ENODATA").otherwise("OK").alias("rc")
    return requests.join(plan, "req_id", "left").select("req_id", "gfid", zero("n_servers"), zero("n_chunks"), zero("n_bytes"), rc)


def extent_source(rank: Column, file_id: Column, laminated: Column, shared: Column, local_cover: Column, servers: int) -> Column:
    """Who resolves a request's extents: this server as owner, from a published
    shared file, or from its own clients' extents if they cover the request;
    else the owner."""
    return (
        F.when(owner(file_id, servers) == rank, "owner").when(laminated & shared, "laminated")
        .when(local_cover, "local").otherwise("remote")
    )


def split_local(extents: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests ``req_id, gfid, cli_id, offset, length`` with ``local``: whether the
    client's own extents hold every byte, so nothing is forwarded. Only a client's
    own extents meet its requests."""
    parts = chunks(extents, requests, ["gfid", "cli_id"])
    got = parts.groupBy("req_id").agg(F.sum("length").alias("got"))
    joined = requests.join(got, "req_id", "left")
    return joined.select("req_id", "gfid", "cli_id", (F.coalesce("got", F.lit(0)) == F.col("length")).alias("local"))


def in_server_order(parts: DataFrame) -> DataFrame:
    """Chunks with ``place``, their turn within their request: by server, and on a
    server by offset. A request's chunks are bounded by its length."""
    by = W.partitionBy("req_id").orderBy("svr_rank", "offset")
    return parts.withColumn("place", F.row_number().over(by))


def serve(parts: DataFrame, logs: DataFrame) -> DataFrame:
    """Chunks with ``data``, their bytes from ``logs(svr_rank, app_id, cli_id,
    log_start, payload)``, whose rows are disjoint pieces of each client's log, of
    any length. A chunk of which some byte is in no piece has ``read_rc`` -5 and no
    data.

    A piece lies in one or two cells of a width that is its length rounded up to a
    power of two, CELL at least; a chunk looks into the cells of each such width, so
    that a log, which has no gaps, gives it few pieces that it does not need, and
    bytes are sent once or twice. No log is put together as a whole; only the pieces
    of a chunk, which is bounded by its request, are concatenated.
    """
    holder = ["svr_rank", "app_id", "cli_id"]
    pieces = logs.select(*holder, F.col("log_start").alias("_from"), (F.col("log_start") + F.octet_length("payload") - 1).alias("_to"), "payload")
    width = F.greatest(F.lit(CELL), F.ceil(F.log2(F.col("_to") - F.col("_from") + 1)).cast("int"))
    pieces = materialize(pieces.where("_from <= _to").withColumn("_width", width))
    widths = sorted(r[0] for r in pieces.select("_width").distinct().collect())  # fewer than 64
    cell = lambda at, width: F.call_function("shiftright", at, width)
    pieces = pieces.withColumn("_cell", F.explode(F.sequence(cell(F.col("_from"), F.col("_width")), cell(F.col("_to"), F.col("_width")))))
    wanted = materialize(parts.withColumn("_id", F.monotonically_increasing_id()).withColumn("_last", F.col("log_offset") + F.col("length") - 1))
    asked = wanted.select("_id", *holder, "log_offset", "_last", F.explode(F.array(*[F.lit(w) for w in widths or [CELL]])).alias("_width"))
    asked = asked.withColumn("_cell", F.explode(F.sequence(cell(F.col("log_offset"), F.col("_width")), cell(F.col("_last"), F.col("_width")))))
    met = asked.join(pieces, [*holder, "_width", "_cell"]).where("_from <= _last and log_offset <= _to")
    # A pair that meets in two cells counts in the later of the two first ones.
    met = met.where(F.col("_cell") == cell(F.greatest("_from", "log_offset"), F.col("_width")))
    first = F.greatest("_from", "log_offset")
    cut = F.substring("payload", (first - F.col("_from") + 1).cast("int"), (F.least("_to", "_last") - first + 1).cast("int"))
    got = met.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct(first.alias("at"), cut.alias("bytes")))).alias("_p"))
    data = F.aggregate("_p", F.lit(b""), lambda acc, x: F.concat(acc, x["bytes"]))
    out = wanted.join(got.select("_id", data.alias("data")), "_id", "left").select(*parts.columns, "data")
    full = F.coalesce(F.octet_length("data") == F.col("length"), F.lit(False))
    return out.withColumn("read_rc", F.when(full, F.col("length")).otherwise(F.lit(-5))).withColumn("data", F.when(full, F.col("data")))


def responses(parts: DataFrame, limit: int = RESPONSE) -> DataFrame:
    """Chunks cut into answers of at most ``limit`` bytes."""
    cuts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(limit).cast("long"))
    return parts.select("req_id", "gfid", F.col("offset").alias("chunk_offset"), F.col("length").alias("chunk_length"), F.explode(cuts).alias("shift")).select(
        "req_id", "gfid", (F.col("chunk_offset") + F.col("shift")).alias("offset"), F.least(F.lit(limit).cast("long"), F.col("chunk_length") - F.col("shift")).alias("length")
    )


def complete(replies: DataFrame) -> DataFrame:
    """Requests whose servers have all answered, ``replies(req_id, svr_rank, done,
    rc)``: done, number of servers, first error."""
    return replies.groupBy("req_id").agg(F.bool_and("done").alias("complete"), F.count("*").alias("n_servers"), F.min("rc").alias("rc"))


def readable(offset: Column, length: Column, size: Column) -> Column:
    """Bytes that a read can return: none at or after the file's end."""
    return F.greatest(F.lit(0), F.least(length, size - offset)).cast("long")


def assemble(served: DataFrame, requests: DataFrame, sizes: DataFrame) -> DataFrame:
    """``req_id, gfid, nread, data`` of each request: its chunks' bytes in order,
    zeros in every hole, cut at the file's end. A request's bytes are one value,
    so requests should be split at a few MiB first."""
    asked = requests.join(sizes, "gfid", "left").withColumn("nread", readable(F.col("offset"), F.col("length"), F.coalesce("size", F.lit(0))))
    parts = served.select("req_id", F.col("offset").alias("at"), "data").where("data is not null")
    got = parts.groupBy("req_id").agg(F.sort_array(F.collect_list(F.struct("at", "data"))).alias("parts"))
    joined = asked.join(got, "req_id", "left")
    zeros = lambda n: F.unhex(F.repeat(F.lit("00"), n.cast("int")))
    start = F.struct(F.col("offset").alias("at"), F.lit(b"").alias("data"))

    def add(state: Column, part: Column) -> Column:
        data = F.concat(state["data"], zeros(part["at"] - state["at"]), part["data"])
        return F.struct((part["at"] + F.length(part["data"])).alias("at"), data.alias("data"))

    end = F.col("offset") + F.col("nread")
    whole = F.aggregate(F.coalesce("parts", F.expr("cast(array() as array<struct<at:bigint,data:binary>>)")), start, add, lambda s: F.concat(s["data"], zeros(F.greatest(end - s["at"], F.lit(0)))))
    return joined.select("req_id", "gfid", "nread", whole.substr(F.lit(1), F.col("nread").cast("int")).alias("data"))


__all__ = [
    "assemble", "chunks", "complete", "coverage", "extent_source", "in_server_order", "ordered", "readable", "responses", "serve", "server_plan", "split_local", "submit",
]
