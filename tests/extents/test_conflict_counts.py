import random
from collections import Counter

import pytest

from palimpsest.operators import dominance, workloads

ACCESSES = "seq long, gfid int, cli_id int, op string, offset long, length long"


def all_pairs(rows):
    rows, want = [x for x in rows if x[3] == "SYNC" or x[5] > 0], Counter()
    for a in rows:
        sync = min((x[0] for x in rows if x[1:3] == a[1:3] and x[3] == "SYNC" and x[0] >= a[0]), default=None)
        for b in rows:
            if a[0] < b[0] and None not in (a[1], a[2], b[2]) and a[1] == b[1] and a[2] != b[2] and "SYNC" not in (a[3], b[3]) and "WRITE" in (a[3], b[3]) and a[4] < b[4] + b[5] and b[4] < a[4] + a[5]:
                want[a[1], f"{b[3][0]}A{a[3][0]}", sync is not None and sync < b[0]] += 1
    return dict(want)


@pytest.mark.parametrize("width", [1, 6, 300])
def test_conflicts_over_many_blocks_and_stretches(spark, monkeypatch, width):
    """One file with most accesses, one client with most of them, positions with many ties, few syncs."""
    monkeypatch.setattr(dominance, "PART_ROWS", 40)
    rng = random.Random(width)
    rows = []
    for i in range(400):
        gfid, cli = rng.choice([0, 0, 0, 0, 1, 7, None]), rng.choice([1, 1, 1, 2, 3, *range(4, 30), None])
        rows.append((i * 3 - 200, gfid, cli, rng.choice(["READ", "WRITE"] * 12 + ["SYNC"]), rng.randrange(-width, width), rng.choice([0, 1, 1, 2, 9, width])))
    got = workloads.conflict_kinds(spark.createDataFrame(rows, ACCESSES)).collect()
    assert {(r["gfid"], r["kind"], r["synced"]): r["n_pairs"] for r in got} == all_pairs(rows) and len(got) == len(all_pairs(rows))
    assert workloads.conflict_kinds(spark.createDataFrame(rows[:1], ACCESSES).limit(0)).count() == 0


def test_conflicts_of_one_range_are_not_made_one_by_one(spark):
    """4,000 accesses of one byte are 8 million pairs, which as rows take minutes; no plan may hold a join of them."""
    table = spark.range(4000).selectExpr("id as seq", "0 as gfid", "cast(id % 1000 as int) as cli_id", "if(id % 2 = 0, 'READ', 'WRITE') as op", "0L as offset", "1L as length")
    got = workloads.conflict_kinds(table)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    n, same = 4000, 1000 * 4 * 3 // 2
    reads = 2000 * 1999 // 2 - 500 * 4 * 3 // 2
    assert sum(r["n_pairs"] for r in got.collect()) == n * (n - 1) // 2 - same - reads
