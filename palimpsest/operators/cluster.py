"""Trees of servers, reductions over them, and last-value tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tree(servers: DataFrame, n: int, root: int = 0, k: int = 2) -> DataFrame:
    """Parent and children of each of ``servers(rank)`` in the ``k``-ary tree of
    ``n`` servers, turned so that ``root`` is on top."""
    place = F.pmod(F.col("rank") - root, F.lit(n))
    parent = F.when(place > 0, F.pmod(F.floor((place - 1) / k) + root, F.lit(n)).cast("int"))
    below = F.filter(F.sequence(k * place + 1, k * place + k), lambda c: c < n)
    children = F.transform(below, lambda c: F.pmod(c + root, F.lit(n)).cast("int"))
    steps = F.sequence(F.lit(1), F.lit(max(1, n.bit_length())))
    up = F.aggregate(steps, F.struct(place.cast("long").alias("at"), F.lit(0).alias("d")), lambda s, _: F.when(s["at"] > 0, F.struct(F.floor((s["at"] - 1) / k).alias("at"), (s["d"] + 1).alias("d"))).otherwise(s), lambda s: s["d"])
    return servers.select("rank", parent.alias("parent"), children.alias("children"), F.size(children).alias("n_children"), up.alias("depth"))


def merged_result(codes: DataFrame) -> DataFrame:
    """Result of a collective ``codes(op_id, rank, rc)``: 0 if all are 0, else the
    code of the lowest rank that failed, with the number of servers that did."""
    failed = F.col("rc") != 0
    return codes.groupBy("op_id").agg(
        F.coalesce(F.min_by("rc", F.when(failed, F.col("rank"))), F.lit(0)).alias("rc"),
        F.count("*").alias("n_servers"), F.sum(failed.cast("long")).alias("n_failed"),
    )


def last_values(published: DataFrame) -> DataFrame:
    """Current value of each key of ``published(seq, scope, key, value)``."""
    return published.groupBy("scope", "key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def host_order(ranks: DataFrame) -> DataFrame:
    """Ranks by host and then rank, with the number of ranks on each host."""
    on_host = ranks.groupBy("host").agg(F.count("*").alias("n_on_host"), F.min("rank").alias("first_on_host"))
    return ranks.join(on_host, "host").orderBy("host", "rank")


def callbacks(events: DataFrame) -> DataFrame:
    """Clients to call for each file, each once, from ``events(gfid, app_id,
    cli_id)``."""
    return events.select("gfid", "app_id", "cli_id").distinct()


def callback_turns(events: DataFrame) -> DataFrame:
    """What each round of ``events(round, kind, app_id, cli_id, gfid)`` calls, and in
    which ``turn``: by kind, then client, then file, each once. A round holds what
    has come since the last one."""
    each = events.select("round", "kind", "app_id", "cli_id", "gfid").distinct()
    return each.withColumn("turn", F.row_number().over(W.partitionBy("round").orderBy("kind", "app_id", "cli_id", "gfid")))


def state_of(live: Column, last_beat_ms: Column, now_ms: Column, every_ms: int = 30_000) -> Column:
    """Whether a client that should beat every ``every_ms`` is to be probed."""
    return F.when(~live, "gone").when(now_ms - last_beat_ms > every_ms, "probe").otherwise("ok")
