from pyspark.sql import functions as F

from palimpsest.functions import evaluator as ev
from palimpsest.functions import identity as ident
from palimpsest.operators import cluster, files, logs, reads, transfers, workloads
from palimpsest.operators import extents as ex

KB = 1024


def test_reads_over_holes_and_the_end(spark):
    """Data, hole, data, then a hole to the size of 4 KB."""
    table = spark.createDataFrame([(1, 0, KB - 1, 0, 1, 7, 0), (1, 2 * KB, 3 * KB - 1, 0, 1, 7, KB)], "gfid int, start long, end long, svr_rank int, app_id int, cli_id int, log_pos long")
    log = spark.createDataFrame([(0, 1, 7, i * 100, bytearray(b"\x01" * min(100, 2 * KB - i * 100))) for i in range(21)], "svr_rank int, app_id int, cli_id int, log_start long, payload binary")
    asked = spark.createDataFrame(
        [(1, 1, 0, KB), (2, 1, KB, KB), (3, 1, KB // 2, KB), (4, 1, 3 * KB + KB // 2, KB), (5, 1, 4 * KB, 10), (6, 2, 0, 10), (7, 1, 0, 4 * KB)],
        "req_id long, gfid int, offset long, length long",
    )
    sizes = spark.createDataFrame([(1, 4 * KB)], "gfid int, size long")
    served = reads.serve(ex.chunks(table, asked), log)
    assert served.where("read_rc <> length").count() == 0
    got = {r["req_id"]: (r["nread"], bytes(r["data"])) for r in reads.assemble(served, asked, sizes).collect()}
    one, zero = b"\x01", b"\x00"
    assert got[1] == (KB, one * KB) and got[2] == (KB, zero * KB)
    assert got[3] == (KB, one * (KB // 2) + zero * (KB // 2)) and got[4] == (KB // 2, zero * (KB // 2))
    assert got[5] == (0, b"") and got[6] == (0, b"")
    assert got[7] == (4 * KB, one * KB + zero * KB + one * KB + zero * KB)
    lost = reads.serve(ex.chunks(table, asked), log.where("log_start < 500"))
    assert {r["read_rc"] for r in lost.collect()} >= {-5}


def test_slots_against_a_bitmap(spark):
    import random

    rng = random.Random(12345678)
    slots, used = logs.Slots(200), [False] * 200
    held = []
    for _ in range(400):
        n = rng.randint(1, 17)
        if held and rng.random() < 0.45:
            at, n = held.pop(rng.randrange(len(held)))
            slots.release(at, n)
            used[at : at + n] = [False] * n
            continue
        step = 8 if n > 8 else 1
        last = max((i for i, taken in enumerate(used) if taken), default=0)
        want = next((a for a in range(last // 8 * 8 if n > 8 else 0, 201 - n, step) if not any(used[a : a + n])), None)
        assert slots.reserve(n) == want
        if want is not None:
            used[want : want + n] = [True] * n
            held.append((want, n))
    ops = spark.createDataFrame([(1, 1, "RESERVE", 10, None), (1, 2, "RESERVE", 3, None), (1, 3, "RELEASE", 0, 1), (1, 4, "RESERVE", 4, None), (2, 1, "RESERVE", 30, None), (2, 2, "RELEASE", 0, 99)], "map_id long, seq long, op string, count long, ref long")
    got = {(r["map_id"], r["seq"]): r["start"] for r in logs.slot_map(ops, 20).collect()}
    assert got == {(1, 1): 0, (1, 2): 10, (1, 3): 0, (1, 4): 0, (2, 1): None, (2, 2): None}


def test_log_allocation_goes_over_the_seam(spark):
    ops = [("RESERVE", 6, None), ("RESERVE", 4, None), ("RESERVE", 1, None), ("RELEASE", 0, 1), ("RESERVE", 5, None), ("RESERVE", 9, None)]
    table = spark.createDataFrame([(1, i + 1, op, n, ref) for i, (op, n, ref) in enumerate(ops)], "log_id long, seq long, op string, count long, ref long")
    got = {r["seq"]: r["start"] for r in logs.log_allocation(table, 8, 8).collect()}
    # 0-5; 6-7 and the first two spilled; 10; free; 0-4; nine are too many
    assert got == {1: 0, 2: 6, 3: 10, 4: 0, 5: 0, 6: None}


def test_memory_and_spill(spark):
    rows = spark.createDataFrame([(0, 10), (95, 10), (100, 5), (300, 1)], "o long, n long")
    got = [tuple(r[0]) for r in rows.select(logs.memory_spill(F.col("o"), F.col("n"), 100)).collect()]
    assert got == [(10, 0, -1), (5, 5, 0), (0, 5, 0), (0, 1, 200)]


def test_attributes_take_the_last_allowed_value(spark):
    ops = [(1, 1, "CREATE", 0o644, 0), (1, 2, "DATA", 0o111, 50), (1, 3, "CHMOD", 0o600, 99), (1, 4, "TRUNCATE", None, None), (1, 5, "UTIME", 0o777, 1)]
    row = files.attributes(spark.createDataFrame(ops, "gfid int, seq long, op string, mode int, size long")).first()
    assert (row["mode"], row["size"]) == (0o600, 50)


def test_lamination_rule(spark):
    table = spark.createDataFrame([(0o644, 0o444), (0o444, 0o444), (0o644, 0o200), (0o666, 0o400), (0o422, 0o200)], "m int, n int")
    assert [r[0] for r in table.select(ident.laminates(F.col("m"), F.col("n"))).collect()] == [True, False, False, True, True]


def test_rename_and_unlink(spark):
    table = spark.createDataFrame([(1, "/a"), (2, "/b"), (3, "/c")], "gfid int, filename string")
    moved = files.rename(table, spark.createDataFrame([(1, "/a", "/b")], "seq long, src string, dst string"))
    assert sorted((r["gfid"], r["filename"]) for r in moved.collect()) == [(1, "/b"), (3, "/c")]


def test_renames_one_after_another(spark):
    import random

    rng = random.Random(21)
    for _ in range(4):
        names = [f"/f{i}" for i in range(6)]
        moves = [(i, rng.choice(names), rng.choice(names + ["/g", "/h"])) for i in range(8)]
        want = {name: i for i, name in enumerate(names)}
        for _, a, b in moves:
            if a in want and a != b:
                want[b] = want.pop(a)
        table = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "gfid int, filename string")
        got = files.rename(table, spark.createDataFrame(moves, "seq long, src string, dst string"))
        assert {r["filename"]: r["gfid"] for r in got.collect()} == want, moves


def test_creations_in_a_log_count(spark):
    ops = spark.createDataFrame([(1, 1, "DATA"), (2, 1, "CREATE"), (3, 1, "DATA"), (4, 1, "CREATE"), (5, 2, "CREATE")], "seq long, gfid int, op string")
    got = {r["seq"]: r["rc"] for r in files.dispatch(ops, spark.createDataFrame([(2,)], "gfid int")).collect()}
    assert got == {1: "ENOENT", 2: "OK", 3: "OK", 4: "EEXIST", 5: "EEXIST"}


def test_pieces_of_many_lengths_are_served(spark):
    log = spark.createDataFrame([(0, 1, 7, 0, bytearray(b"0123456789")), (0, 1, 7, 14, bytearray(b"efghijklmn")), (0, 1, 7, 10, bytearray(b"abcd"))], "svr_rank int, app_id int, cli_id int, log_start long, payload binary")
    parts = spark.createDataFrame([(1, 0, 24), (2, 9, 6), (3, 20, 9), (4, 12, 1)], "req_id long, log_offset long, length long")
    parts = parts.selectExpr("req_id", "1 as gfid", "0L as offset", "length", "log_offset", "0 as svr_rank", "1 as app_id", "7 as cli_id")
    got = {r["req_id"]: (r["read_rc"], r["data"] and bytes(r["data"])) for r in reads.serve(parts, log).collect()}
    assert got == {1: (24, b"0123456789abcdefghijklmn"), 2: (6, b"9abcde"), 3: (-5, None), 4: (1, b"c")}
    kept = logs.stored(log, 12)
    asked = spark.createDataFrame([(1, 0, 24), (2, 11, 2), (3, 13, 3), (4, 30, 2)], "req_id long, log_offset long, length long").selectExpr("*", "0 as svr_rank", "1 as app_id", "7 as cli_id")
    got = {r["req_id"]: r["data"] and bytes(r["data"]) for r in logs.fetched(kept, asked, 12).collect()}
    assert got == {1: b"0123456789abcdefghijklmn", 2: b"bc", 3: b"def", 4: None}


def test_arithmetic_of_settings(spark):
    for text, want in {
        "1+2*3": 7, "-2^2": 4, "2^3^2": 64, "(1,2,3)*2": 6, "pow(2,10)": 1024, "sqrt 16+1": 5, "-sqrt 4^2": 4, "10%4": 2, "--1": 1, "2*-3": -6, "1,2": 2,
        "pi()-pi": 0, "fac(5)": 120, "npr(5,2)": 20, "1/0": float("inf"), "1+": None, "foo(1)": None, "pow(1)": None, "3 4": None, "(1": None, "1)": None, "": None,
    }.items():
        assert ev.arithmetic(text) == want, text
    words = ["2 * (3 + 4)", "-7 / 2", "0x1F", "-017", "12UL", "1.5f", "2e3", "x", None]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(ev.as_integer(F.col("w")), ev.as_float(F.col("w"))).collect()
    assert [tuple(r) for r in rows] == [(14, 14.0), (-3, -3.5), (31, None), (-15, -17.0), (12, None), (None, 1.5), (2000, 2000.0), (None, None), (None, None)]


def batch_model(rows, sizes):
    """Requests one by one: results, and which request holds each byte."""
    held, size, out = {}, dict(sizes), {}
    for batch in sorted({r[0] for r in rows}):
        mine = sorted(r for r in rows if r[0] == batch)
        bad = any(r[2] not in (*transfers.PHASES, "NOP") for r in mine)
        done = False
        for phase in (1, 2, 3, 4):
            for _, pos, op, g, at, n in mine:
                if transfers.PHASES.get(op) != phase or bad:
                    continue
                acts, count, rc = True, 0, "OK"
                if op == "SYNC_DATA":
                    acts, done = not done, True
                elif g not in size:
                    acts, rc = False, "EINVAL"
                elif op == "READ":
                    count = max(0, min(n, size[g] - at))
                elif op == "TRUNC":
                    size[g] = at
                    held = {k: v for k, v in held.items() if k[0] != g or k[1] < at}
                elif phase == 2:
                    count = n
                    size[g] = max(size[g], at + n) if n else size[g]
                    held |= {(g, at + i): (batch, pos, op == "ZERO") for i in range(n)}
                out[batch, pos] = (rc, count, acts)
        for _, pos, op, *_ in mine:
            out.setdefault((batch, pos), ("EINVAL" if bad else "OK", 0, False))
    return out, held


def test_batches_against_requests_one_by_one(spark):
    import random

    rng = random.Random(22)
    names = ["READ", "WRITE", "ZERO", "TRUNC", "SYNC_META", "SYNC_DATA", "NOP", "WRITE", "READ"]
    rows = [(b, p, rng.choice(names) if rng.random() > 0.02 else "BAD", rng.randint(0, 4), rng.randint(0, 60), rng.randint(0, 30)) for b in range(25) for p in range(6)]
    sizes = {0: 0, 1: 50, 2: 5, 3: 0}
    table = spark.createDataFrame(rows, "batch long, pos long, op string, gfid int, offset long, nbytes long")
    known = spark.createDataFrame(list(sizes.items()), "gfid int, size long")
    want, held = batch_model(rows, sizes)
    got = transfers.dispatch(table, known).collect()
    assert {(r["batch"], r["pos"]): (r["rc"], r["count"], r["acts"]) for r in got} == want
    turn = {(r["batch"], r["turn"]): r["pos"] for r in got if r["turn"] is not None}
    log = transfers.batch_writes(table, known).selectExpr("seq", "gfid", "0 as svr_rank", "1 as app_id", "1 as cli_id", "file_pos", "length", "seq * 1000 as log_pos", "zero")
    zero = {r["seq"]: r["zero"] for r in log.collect()}
    left = {}
    for r in ex.overlay(log.drop("zero")).collect():
        for i in range(r["start"], r["end"] + 1):
            batch = r["seq"] >> 20
            left[r["gfid"], i] = (batch, turn[batch, r["seq"] & 0xFFFFF], zero[r["seq"]])
    assert left == held


def test_kinds_of_conflicts_against_all_pairs(spark):
    import random
    from collections import Counter

    rng = random.Random(23)
    rows = [(i, rng.randint(0, 1), rng.randint(1, 3), rng.choice(["READ", "WRITE", "WRITE", "SYNC"]), rng.randint(0, 40), rng.randint(1, 9)) for i in range(120)]
    want = Counter()
    for a in rows:
        sync = min((x[0] for x in rows if x[1:3] == a[1:3] and x[3] == "SYNC" and x[0] >= a[0]), default=None)
        for b in rows:
            if a[0] < b[0] and a[1] == b[1] and a[2] != b[2] and "SYNC" not in (a[3], b[3]) and "WRITE" in (a[3], b[3]) and a[4] < b[4] + b[5] and b[4] < a[4] + a[5]:
                want[a[1], f"{b[3][0]}A{a[3][0]}", sync is not None and sync < b[0]] += 1
    table = spark.createDataFrame(rows, "seq long, gfid int, cli_id int, op string, offset long, length long")
    assert {(r["gfid"], r["kind"], r["synced"]): r["n_pairs"] for r in workloads.conflict_kinds(table).collect()} == dict(want)


def test_empty_directories(spark):
    dirs = spark.createDataFrame([("/w",), ("/w/a",), ("/w/ab",), ("/x",)], "path string")
    got = files.empty_directories(dirs, spark.createDataFrame([("/w/a/f",), ("/xy",)], "path string"))
    assert {r["path"]: r["is_empty"] for r in got.collect()} == {"/w": False, "/w/a": False, "/w/ab": True, "/x": True}


def test_gfid_and_paths(spark):
    row = spark.sql("select '/work/a' as p").select(ident.gfid(F.col("p")).alias("g"), ident.normal_path(F.lit("x/./../y//z/"), F.lit("/w")).alias("n")).first()
    assert (row["g"], row["n"]) == (612165337, "/w/y/z")


def test_manifest_lines(spark):
    lines = ["a b", '"a b" c', "# note", "", "one", "a b c", '"x y" "z w"', '"open b']
    table = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    got = {r["line_no"]: (r["src"], r["dst"], r["rc"]) for r in transfers.manifest(table).collect()}
    bad = (None, None, "EINVAL")
    assert got == {0: ("a", "b", "OK"), 1: ("a b", "c", "OK"), 4: bad, 5: bad, 6: ("x y", "z w", "OK"), 7: bad}


def test_stage_parts_leave_nothing_out(spark):
    for size in (1, 64 * 8, 64 * 25 + 1, 64 * 100):
        parts = transfers.stage_parts(spark.createDataFrame([(1, size)], "gfid long, size long"), 3, 64).collect()
        assert sum(r["n_bytes"] for r in parts) == size
        parts = transfers.rank_parts(spark.createDataFrame([(1, size)], "gfid long, size long"), 4, 64).collect()
        assert sum(r["n_bytes"] for r in parts) == size


def test_dispatch_order(spark):
    ops = [("SYNC_META", 0), ("WRITE", 1), ("READ", 2), ("TRUNC", 3), ("NOP", 4), ("ZERO", 5)]
    rows = [(1, pos, op) for op, pos in ops] + [(2, 0, "READ"), (2, 1, "WHAT")]
    got = {(r["batch"], r["pos"]): (r["turn"], r["rc"]) for r in transfers.phases(spark.createDataFrame(rows, "batch long, pos long, op string")).collect()}
    assert got == {(1, 0): (5, "OK"), (1, 1): (2, "OK"), (1, 2): (1, "OK"), (1, 3): (4, "OK"), (1, 4): (None, "OK"), (1, 5): (3, "OK"), (2, 0): (None, "EINVAL"), (2, 1): (None, "EINVAL")}


def test_tree_reaches_everyone(spark):
    for n, root, k in ((1, 0, 2), (7, 3, 2), (10, 5, 3)):
        rows = {r["rank"]: r for r in cluster.tree(spark.range(n).select(F.col("id").cast("int").alias("rank")), n, root, k).collect()}
        assert rows[root]["parent"] is None and rows[root]["depth"] == 0
        for rank, r in rows.items():
            assert all(rows[c]["parent"] == rank and rows[c]["depth"] == r["depth"] + 1 for c in r["children"])
        assert sum(len(r["children"]) for r in rows.values()) == n - 1


def test_settings_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    lit = lambda x: F.lit(float(x))
    assert value(ev.factorial(lit(5))) == 120 and value(ev.factorial(lit(171))) == float("inf") and value(ev.factorial(lit(-1))) != value(ev.factorial(lit(-1)))
    assert value(ev.combinations(lit(30), lit(15))) == 155117520 and value(ev.permutations(lit(5), lit(2))) == 20
    assert value(ev.divide(lit(-1), lit(0))) == float("-inf") and value(ev.log_ten(lit(1000))) == 3
    words = ["4 * 1024", "1e3", "12UL", "-5", "x"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(ev.as_integer(F.col("w")), ev.is_expression(F.col("w"))).collect()
    assert [tuple(r) for r in got] == [(4096, True), (1000, False), (12, False), (-5, False), (None, False)]


def test_overlapping_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(9)
    rows = [(i, rng.randint(0, 3), rng.randint(1, 3), rng.randint(0, 60), rng.randint(1, 9)) for i in range(150)]
    table = spark.createDataFrame(rows, "seq long, gfid int, cli_id int, file_pos long, length long")
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] == b[1] and a[3] < b[3] + b[4] and b[3] < a[3] + a[4]:
                pair = want.setdefault(a[1], [0, 0])
                pair[a[2] != b[2]] += 1
    got = {r["gfid"]: [r["same_client"], r["different_clients"]] for r in workloads.conflicts(table).collect()}
    assert got == want
