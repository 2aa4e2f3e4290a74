import random
import re

from pyspark.sql import functions as F

from palimpsest.operators import calls


def test_cursors_against_an_array_of_bytes(spark):
    rng = random.Random(5)
    names = ["READ", "WRITE", "APPEND", "PREAD", "PWRITE", "SEEK_SET", "SEEK_CUR", "SEEK_END", "SEEK_DATA", "SEEK_HOLE", "TELL", "REWIND", "TRUNCATE", "NOPE"]
    ops = [(fd, seq, rng.choice(names), rng.randint(-5, 60)) for fd in range(8) for seq in range(60)]
    got = {(r["fd"], r["seq"]): (r["ret"], r["pos"], r["size"]) for r in calls.cursors(spark.createDataFrame(ops, "fd long, seq long, op string, n long").repartition(5)).collect()}
    for fd in range(8):
        data, pos = bytearray(), 0
        for _, seq, op, n in [o for o in ops if o[0] == fd]:
            ret = calls.EINVAL
            if op in ("SEEK_SET", "SEEK_CUR", "SEEK_END"):
                to = {"SEEK_SET": 0, "SEEK_CUR": pos, "SEEK_END": len(data)}[op] + n
                if to >= 0:
                    ret = pos = to
            elif op in ("SEEK_DATA", "SEEK_HOLE"):
                ret = calls.ENXIO
                if 0 <= n <= len(data):
                    ret = pos = n if op == "SEEK_DATA" else len(data)
            elif op == "TELL":
                ret = pos
            elif op == "REWIND":
                ret = pos = 0
            elif n >= 0 and op == "READ":
                ret = len(data[pos : pos + n])
                pos += ret
            elif n >= 0 and op == "PREAD":
                ret = len(data[:n])
            elif n >= 0 and op in ("WRITE", "APPEND", "PWRITE"):
                at = {"WRITE": pos, "APPEND": len(data), "PWRITE": 0}[op]
                if n:
                    data.extend(bytes(max(0, at + n - len(data))))
                pos, ret = (pos if op == "PWRITE" else at + n), n
            elif n >= 0 and op == "TRUNCATE":
                data = data[:n] + bytes(max(0, n - len(data)))
                ret = 0
            assert got[fd, seq] == (ret, pos, len(data)), (fd, seq, op, n)
    assert calls.cursors(spark.createDataFrame([], "fd long, seq long, op string, n long")).count() == 0


def test_holes_against_a_byte_map(spark):
    rng = random.Random(6)
    extents, sizes, want = [], [], []
    for gfid in range(20):
        at, held = 0, set()
        for _ in range(rng.randint(0, 6)):
            start = at + rng.randint(0, 9)
            at = start + rng.randint(1, 9)
            extents.append((gfid, start, at - 1))
            held |= set(range(start, at))
        size = rng.randint(0, 50)
        sizes.append((gfid, size))
        want += [(gfid, b) for b in range(size) if b not in held]
    got = calls.holes(spark.createDataFrame(extents, "gfid int, start long, end long"), spark.createDataFrame(sizes, "gfid int, size long")).collect()
    assert sorted((r["gfid"], b) for r in got for b in range(r["start"], r["end"] + 1)) == sorted(want)


def test_scanned_fields(spark):
    cases = [
        ("%d:%d", "12:-7", ["12", "-7"]), ("%d:%d", "12 x", ["12", None]), ("%s %s", "  a   b c", ["a", "b"]), ("%3d%s", "12345", ["123", "45"]),
        ("%*d %f", "7 1.5e3", ["1.5e3"]), ("[%[a-c]]", "[abca]", ["abca"]), ("%[^,],%x", "key,0xfF", ["key", "0xfF"]), ("%2c%d", "ab12", ["ab", "12"]),
    ]
    for form, line, want in cases:
        assert spark.range(1).select(calls.scanned(F.lit(line), form).alias("f")).first()["f"] == want, form


def test_lines_in_pieces(spark):
    text = "short\n\n" + "x" * 25 + "\nlast"
    got = calls.text_lines(spark.createDataFrame([(1, text)], "gfid int, text string"), 11).orderBy("line_no", "piece_no").collect()
    assert "".join(r["piece"] for r in got) == text and max(len(r["piece"]) for r in got) == 10
    assert [r["piece"] for r in got] == [p for line in re.findall(r"[^\n]*\n|[^\n]+", text) for p in re.findall(r"(?s).{1,10}", line)]


def test_typed_ranges(spark):
    lines = spark.createDataFrame(list(enumerate(["0,10", "0x1F,010", "bad", " 7 , 8", "quit", "1,2"])), "line_no int, line string")
    got = {r["line_no"]: (r["offset"], r["length"]) for r in calls.range_requests(lines).collect()}
    assert got == {0: (0, 10), 1: (31, 8), 2: (None, None), 3: (7, 8)}


def test_descriptors_of_a_shared_file(spark):
    ops = [
        (0, "OPEN", 0, 0), (0, "WRITE", 10, 0), (0, "DUP", 1, 0), (1, "WRITEV", 5, 0), (2, "OPEN", 0, 0), (2, "FREAD", 20, 0), (2, "FEOF", 0, 0), (2, "UNGETC", 65, 0),
        (2, "FEOF", 0, 0), (2, "FREAD", 1, 0), (0, "SEEK", 0, 3), (1, "READ", 4, 0), (0, "PREAD", 9, 10), (0, "PWRITE", 4, 30), (0, "CLOSE", 0, 0), (0, "READ", 1, 0),
        (1, "APPEND", 2, 0), (2, "FAIL", 0, 0), (2, "FERROR", 0, 0), (2, "CLEARERR", 0, 0), (2, "FERROR", 0, 0), (1, "FSYNC", 0, 0),
    ]
    table = spark.createDataFrame([(7, fd, i, op, n, at) for i, (fd, op, n, at) in enumerate(ops)], "gfid long, fd long, seq long, op string, n long, at long")
    got = calls.shared_descriptors(table)
    rows = {r["seq"]: r for r in got.collect()}
    assert [rows[i]["ret"] for i in range(len(ops))] == [0, 10, 1, 5, 0, 15, 1, 65, 0, 1, 3, 4, 5, 4, 0, -9, 2, -1, 1, 0, 0, 0]
    assert (rows[3]["offset"], rows[11]["offset"], rows[11]["length"], rows[16]["offset"], rows[21]["size"]) == (10, 3, 4, 34, 36)
    seen = {r["seq"]: r["epoch"] for r in calls.synced_writes(got).collect()}
    assert seen == {1: 14, 13: 14, 3: 21, 16: 21}


def test_directory_cursors(spark):
    ops = ["READ", "READ", "TELL", "READ", "READ", "TELL", "REWIND", "READ", "SEEK", "READ", "TELL"]
    table = spark.createDataFrame([(1, i, op, 2) for i, op in enumerate(ops)] + [(2, 0, "READ", 0)], "dir long, seq long, op string, n long")
    names = spark.createDataFrame([(1, x) for x in "cab"] + [(1, "a")], "dir long, name string")
    got = {(r["dir"], r["seq"]): (r["pos"], r["name"]) for r in calls.directory_reads(table, names).collect()}
    want = [(0, "a"), (1, "b"), (2, None), (2, "c"), (3, None), (3, None), (None, None), (0, "a"), (None, None), (2, "c"), (3, None)]
    assert [got[1, i] for i in range(len(ops))] == want and got[2, 0] == (0, None)


def test_scans_with_lengths_counts_and_bases(spark):
    form = "%li %hho%n|%p %*d %3i"
    lines = ["0x1f 17|0xAb 5 1234", "-12 8", "7 7| ff 1 0x12"]
    got = [list(r[0]) for r in spark.createDataFrame([(x,) for x in lines], "x string").select(calls.scanned(F.col("x"), form)).collect()]
    assert got == [["0x1f", "17", "7", "0xAb", "123"], ["-12", None, None, None, None], ["7", "7", "3", "ff", "0x12"]]
