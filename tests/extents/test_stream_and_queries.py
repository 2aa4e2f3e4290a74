import random

from palimpsest.operators.extents import coalesce, extents
from palimpsest.plans import oracle, queries
from palimpsest.streaming import sync

WRITES = "seq long, gfid int, svr_rank int, app_id int, cli_id int, file_pos long, length long, log_pos long"


def test_commits_of_a_stream_equal_one_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 3), 0, 1, rng.randint(1, 2), rng.randint(0, 80), rng.randint(1, 20), i * 20) for i in range(60)]
    for part in (1, 0, 2):  # the first commits come late
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], WRITES).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    table = str(tmp_path / "table")
    stream = sync.maintain(sync.read_log(spark, str(tmp_path / "log")), table, str(tmp_path / "checkpoint"))
    stream.awaitTermination(120)
    assert stream.exception() is None
    key = lambda r: (r["gfid"], r["start"], r["end"], r["cli_id"], r["log_pos"])
    got = sorted(map(key, coalesce(sync.latest(spark, table)).collect()))
    assert got == sorted(map(key, extents(spark.createDataFrame(rows, WRITES)).collect()))

    # An epoch that is run again gives the same table.
    third = spark.read.parquet(str(tmp_path / "log")).where("seq >= 40")
    again = sync.commit(sync.latest(spark, table, 2), third)
    assert sorted(map(key, again.collect())) == sorted(map(key, spark.read.parquet(f"{table}/epoch=2").collect()))


def test_every_query_with_sql_has_that_name():
    assert set(oracle.oracle_sql()) <= set(queries.queries())
