import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import extents as ex
from palimpsest.operators import intervals

from .models import maximal, overlay

WRITES = "seq long, gfid int, svr_rank int, app_id int, cli_id int, file_pos long, length long, log_pos long"

# Fixed values: (start, end, log position) of writes in order, and what is left.
GOLDEN = {
    "overlay": (
        [(5, 10, 0), (100, 150, 100), (2, 7, 200), (9, 12, 300), (3, 4, 400), (4, 120, 500)],
        [(2, 2, 200), (3, 3, 400), (4, 120, 500), (121, 150, 121)],
    ),
    "before the last": (
        [(5, 10, 0), (100, 150, 100), (2, 7, 200), (9, 12, 300), (3, 4, 400)],
        [(2, 2, 200), (3, 4, 400), (5, 7, 203), (8, 8, 3), (9, 12, 300), (100, 150, 100)],
    ),
    "sawtooth": (
        [(0, 50, 50), (0, 0, 0), (2, 2, 2), (4, 4, 4), (6, 6, 6)],
        [(0, 0, 0), (1, 1, 51), (2, 2, 2), (3, 3, 53), (4, 4, 4), (5, 5, 55), (6, 6, 6), (7, 50, 57)],
    ),
    "same range": ([(20, 30, 0), (20, 30, 8)], [(20, 30, 8)]),
    "coalesce": (
        [(5, 10, 105), (100, 150, 200), (2, 7, 102), (9, 12, 109), (3, 4, 103), (4, 120, 104)],
        [(2, 150, 102)],
    ),
    "coalesce before the last": (
        [(5, 10, 105), (100, 150, 200), (2, 7, 102), (9, 12, 109), (3, 4, 103)],
        [(2, 12, 102), (100, 150, 200)],
    ),
}


def log(spark, ranges, cli=1):
    return spark.createDataFrame([(i, 1, 0, 1, cli, s, e - s + 1, p) for i, (s, e, p) in enumerate(ranges)], WRITES)


@pytest.mark.parametrize("case", GOLDEN)
def test_golden_states(spark, case):
    writes, want = GOLDEN[case]
    table = ex.extents(log(spark, writes))
    assert sorted((r["start"], r["end"], r["log_pos"]) for r in table.collect()) == want
    row = ex.stats(table).first()
    assert (row["n_extents"], row["max_offset"]) == (len(want), max(e for _, e, _ in want))


def test_golden_find_and_remove(spark):
    table = ex.extents(log(spark, [*GOLDEN["overlay"][0][:5], (100, 200, 900)]))
    ranges = spark.createDataFrame([(1, 1, 2, 7), (2, 1, 90, 120), (3, 1, 2000, 3000)], "req_id long, gfid int, lo long, hi long")
    got = {r["req_id"]: r["start"] for r in ex.find(table, ranges).collect()}
    assert got == {1: 2, 2: 100, 3: None}
    table = ex.extents(log(spark, [(0, 0, 0), (1, 10, 101), (20, 30, 20), (31, 40, 131)]))
    for lo, hi, want in (
        (0, 0, [(1, 10, 101), (20, 30, 20), (31, 40, 131)]),
        (25, 31, [(1, 10, 101), (20, 24, 20), (32, 40, 132)]),
    ):
        table = ex.remove_range(table, spark.createDataFrame([(1, lo, hi)], "gfid int, lo long, hi long"))
        assert sorted((r["start"], r["end"], r["log_pos"]) for r in table.collect()) == want


@pytest.fixture
def many_parts(spark):
    """Stretches stay as small as they are made."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_random_logs_against_a_byte_map(spark, many_parts):
    rng = random.Random(4)
    writes = []
    for gfid in range(40):
        tail = {}
        for _ in range(rng.randint(1, 14)):
            cli = rng.randint(1, 2)
            n = rng.choice([0, 1, 2, 5, 20])
            at = rng.choice([rng.randint(0, 42), tail.get((gfid, cli), 0)])
            pos = tail.get(cli, 0)
            writes.append(dict(seq=len(writes), gfid=gfid, svr_rank=cli % 2, app_id=1, cli_id=cli, file_pos=at, length=n, log_pos=pos))
            tail[cli] = pos + n
            tail[gfid, cli] = at + n
    table = spark.createDataFrame([tuple(w.values()) for w in writes], WRITES)
    held = overlay(writes)
    got = [(r["gfid"], r["start"], r["end"], r["log_pos"], (r["svr_rank"], r["cli_id"])) for r in ex.extents(table).collect()]
    assert sorted(got) == maximal(held, ["svr_rank", "cli_id"])
    got = [(r["gfid"], r["start"], r["end"], r["log_pos"], (r["seq"],)) for r in ex.overlay(table).collect()]
    assert sorted(got) == maximal(held, ["seq"])

    requests = spark.createDataFrame([(i, i % 40, rng.randint(0, 45), rng.randint(1, 30)) for i in range(120)], "req_id long, gfid int, offset long, length long")
    parts = ex.chunks(ex.extents(table), requests)
    cover = {r["req_id"]: r for r in ex.coverage(parts, requests).collect()}
    seen = {}
    for r in parts.collect():
        for i in range(r["length"]):
            assert held[r["gfid"], r["offset"] + i][1] == r["log_offset"] + i
            assert seen.setdefault((r["req_id"], r["offset"] + i), True) is True
            seen[r["req_id"], r["offset"] + i] = False
    for r in requests.collect():
        there = [i for i in range(r["offset"], r["offset"] + r["length"]) if (r["gfid"], i) in held]
        assert sum((r["req_id"], i) in seen for i in there) == len(there) == cover[r["req_id"]]["n_bytes"]
        assert cover[r["req_id"]]["covered"] == (len(there) == r["length"])
        assert cover[r["req_id"]]["nread"] == (max(there) + 1 - r["offset"] if there else 0)


def test_blocks_cover_a_range_once(spark):
    rng = random.Random(3)
    ranges = [(s, s + rng.randint(-1, 70)) for s in (rng.randint(0, 90) for _ in range(150))]
    table = spark.createDataFrame(ranges, "s long, e long").select("s", "e", F.explode_outer(intervals.blocks(F.col("s"), F.col("e"))).alias("b")).collect()
    got = {}
    for r in table:
        got.setdefault((r["s"], r["e"]), set()).update([] if r["b"] is None else [tuple(r["b"])])
    for (s, e), found in got.items():
        points = [p for level, b in found for p in range(b << level, (b + 1) << level)]
        assert sorted(points) == list(range(s, e + 1))


def test_overlap_join_against_all_pairs(spark):
    rng = random.Random(5)
    make = lambda n: [(i, i % 3, s, s + rng.choice([0, 3, 40])) for i, s in enumerate(rng.randint(0, 200) for _ in range(n))]
    a, b = make(80), make(90)
    left = spark.createDataFrame(a, "i long, k long, s long, e long")
    right = spark.createDataFrame(b, "j long, k long, s2 long, e2 long")
    got = intervals.overlap_join(left, "s", "e", right, "s2", "e2", ["k"]).select("i", "j").collect()
    want = [(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_truncate_scenarios(spark):
    table = ex.extents(log(spark, [(0, 1023, 0), (2048, 3071, 1024)]))
    for size, want in ((5120, [(0, 1023), (2048, 3071)]), (2500, [(0, 1023), (2048, 2499)]), (512, [(0, 511)]), (0, []), (1 << 40, [(0, 1023), (2048, 3071)])):
        cut = ex.truncate(table, spark.createDataFrame([(1, size)], "gfid int, size long"))
        assert sorted((r["start"], r["end"]) for r in cut.collect()) == want


def test_first_free_part_and_comparison(spark):
    rows = [(1, 5, 3, 9), (3, 9, 1, 5), (1, 9, 3, 5), (3, 5, 1, 9), (1, 2, 3, 4), (3, 4, 1, 2)]
    cols = [F.col(c) for c in ("a", "b", "c", "d")]
    table = spark.createDataFrame(rows, "a long, b long, c long, d long")
    got = table.select(ex.first_free(*cols).alias("p"), ex.compare(*cols).alias("o")).collect()
    assert [tuple(r["p"]) if r["p"] else None for r in got[:4]] == [(1, 2), (6, 9), (1, 2), None]
    assert [r["o"] for r in got] == [0, 0, 0, 0, -1, 1]


def test_empty_log(spark):
    table = ex.extents(log(spark, []).limit(0))
    assert table.count() == 0 and ex.stats(table).count() == 0
    assert ex.extents(log(spark, [(5, 4, 0)])).count() == 0


def test_removals_of_several_ranges(spark):
    rng = random.Random(8)
    table = ex.extents(log(spark, [(0, 99, 1000), (120, 180, 0), (200, 210, 70)]))
    for _ in range(3):
        cuts = [(1, lo, lo + rng.randint(-1, 30)) for lo in (rng.randint(0, 220) for _ in range(rng.randint(1, 6)))] + [(2, 0, 5)]
        got = ex.remove_range(table, spark.createDataFrame(cuts, "gfid int, lo long, hi long"))
        gone = {p for g, lo, hi in cuts if g == 1 for p in range(lo, hi + 1)}
        left = {p: log + p - s for s, e, log in ((0, 99, 1000), (120, 180, 0), (200, 210, 70)) for p in range(s, e + 1) if p not in gone}
        assert {p: r["log_pos"] + p - r["start"] for r in got.collect() for p in range(r["start"], r["end"] + 1)} == left


def test_running_folds_and_neighbours_against_one_by_one(spark, many_parts):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, rng.randint(-5, 9)])) for i in rng.sample(range(1000), 300)]
    table = spark.createDataFrame(rows, "k int, i long, v long")
    by = {k: sorted((r for r in rows if r[0] == k), key=lambda r: r[1]) for k in (1, 2, None)}
    for fold, step in ((F.sum, lambda a, v: (a or 0) + (v or 0)), (F.max, lambda a, v: v if a is None else a if v is None else max(a, v))):
        got = {r["i"]: r["x"] for r in intervals.running(table, ["k"], "i", "x", F.col("v"), fold).collect()}
        for group in by.values():
            at = None
            for _, i, v in group:
                at = step(at, v)
                assert got[i] == at
    got = {r["i"]: (r["p"], r["n"]) for r in intervals.with_neighbours(table, ["k"], "i", {"p": (F.col("i"), -1), "n": (F.col("v"), 1)}).collect()}
    for group in by.values():
        for x, (_, i, _) in enumerate(group):
            assert got[i] == (group[x - 1][1] if x else None, group[x + 1][2] if x + 1 < len(group) else None)


def test_commits_and_new_sizes_that_are_refused(spark):
    files = spark.createDataFrame([(1, 10, False), (2, 5, True)], "gfid int, size long, is_laminated boolean")
    table = ex.extents(log(spark, [(0, 9, 0)]))
    batch = spark.createDataFrame([(i, g, 0, 1, 1, 8, 12, 100) for i, g in enumerate((1, 2, 3))], WRITES)
    judged, after, grown = ex.add(files, table, batch)
    assert {r["gfid"]: r["rc"] for r in judged.collect()} == {1: "OK", 2: "EINVAL", 3: "ENOENT"}
    assert sorted((r["gfid"], r["start"], r["end"], r["log_pos"]) for r in after.collect()) == [(1, 0, 7, 0), (1, 8, 19, 100)]
    assert {r["gfid"]: r["size"] for r in grown.collect()} == {1: 20, 2: 5}
    judged, after, files = ex.truncate_files(grown, after, spark.createDataFrame([(1, 4), (2, 0), (3, 0)], "gfid int, size long"))
    assert {r["gfid"]: r["rc"] for r in judged.collect()} == {1: "OK", 2: "EINVAL", 3: "ENOENT"}
    assert [(r["start"], r["end"]) for r in after.collect()] == [(0, 3)] and {r["gfid"]: r["size"] for r in files.collect()} == {1: 4, 2: 5}
    with pytest.raises(ValueError):
        ex.check_order(batch.unionAll(batch))
