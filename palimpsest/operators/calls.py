"""File calls as tables: descriptor cursors, batches of reads, directories,
formatted text, holes, and what a file system shows of itself."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .intervals import running, with_neighbours
from .reads import readable

# Results of a call that fails, block size and longest name of the
# file system, its usual type number, and the error codes beyond the system's.
EINVAL, ENXIO, EBADF = -22, -6, -9
FS_TYPE, FS_BLOCK, FS_NAME = 0x01021994, 4 << 20, 1024
ERROR_BASE = 1000
ERRORS = {
    "BADCONFIG": "Configuration has invalid setting", "GOTCHA": "Gotcha operation error", "KEYVAL": "Key-value store operation error",
    "MARGO": "Mercury/Argobots operation error", "NYI": "Not yet implemented", "PMI": "PMI2/PMIx error",
    "SHMEM": "Shared memory region init/access error", "THREAD": "POSIX thread operation failed", "TIMEOUT": "Timed out",
}
# Kinds of small metadata operations of a workload.
SMALL_OPS = (
    "open", "close", "file stat", "lseek", "read", "write", "chdir", "directory stat", "statfs", "readdir", "mkdir", "rmdir",
    "unlink", "rename", "creat", "truncate", "symlink", "readlink", "link to one file", "link to a file per process", "fcntl locking",
)

CURSOR = "fd long, seq long, op string, n long, ret long, pos long, size long"


def cursors(ops: DataFrame) -> DataFrame:
    """``ops(fd, seq, op, n)`` of open descriptors, each on a file of its own that
    is empty at first, with ``ret``, ``pos`` and ``size``: what the call returns,
    the cursor and the file's size after it.

    SEEK_SET, SEEK_CUR, SEEK_END, SEEK_DATA and SEEK_HOLE move the cursor and
    return it; a place before the start is EINVAL, and the last two are ENXIO
    beyond the end, where data is the given place and the only hole is the end.
    READ returns what is there, WRITE and APPEND write ``n`` bytes at the cursor
    and at the end, PREAD and PWRITE work at 0 and leave the cursor, TRUNCATE sets
    the size, TELL tells the cursor, REWIND sets it to 0. Anything else is EINVAL.
    A call depends on all before it, so a descriptor is one ordered task, of which
    two numbers are kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, pos, size = None, 0, 0
        for pdf in batches:
            out = []
            for fd, op, n in pdf[["fd", "op", "n"]].itertuples(index=False, name=None):
                if fd != current:
                    current, pos, size = fd, 0, 0
                ret, pos, size = call(op, int(n), pos, size)
                out.append((ret, pos, size))
            ret, pos_, size_ = zip(*out, strict=True) if out else ((), (), ())
            yield pdf.assign(ret=list(ret), pos=list(pos_), size=list(size_))

    columns = ["fd", "seq", "op", "n"]
    ordered = ops.select(*columns).repartition("fd").sortWithinPartitions("fd", "seq")
    return ordered.mapInPandas(run, CURSOR)


def call(op: str, n: int, pos: int, size: int) -> tuple[int, int, int]:
    """What one call returns, and the cursor and size after it."""
    if op.startswith("SEEK_") and op[5:] in ("SET", "CUR", "END"):
        to = n + {"SET": 0, "CUR": pos, "END": size}[op[5:]]
        return (EINVAL, pos, size) if to < 0 else (to, to, size)
    if op in ("SEEK_DATA", "SEEK_HOLE"):
        to = n if op == "SEEK_DATA" else size
        return (to, to, size) if 0 <= n <= size else (ENXIO, pos, size)
    if op in ("TELL", "REWIND"):
        return (pos, pos, size) if op == "TELL" else (0, 0, size)
    if n < 0:
        return EINVAL, pos, size
    if op in ("READ", "PREAD"):
        got = max(0, min(n, size - (pos if op == "READ" else 0)))
        return got, pos + got * (op == "READ"), size
    if op in ("WRITE", "APPEND", "PWRITE"):
        end = {"WRITE": pos, "APPEND": size, "PWRITE": 0}[op] + n
        return n, (pos if op == "PWRITE" else end), max(size, end if n else 0)
    return (0, pos, n) if op == "TRUNCATE" else (EINVAL, pos, size)


SHARED = "gfid long, fd long, seq long, op string, n long, at long, ret long, pos long, size long, offset long, length long, eof boolean, error boolean"


class SharedFile:
    """A file and the descriptors and streams on it. Descriptors made by DUP share
    one cursor; each keeps its own flags and the characters pushed back."""

    def __init__(self):
        self.size, self.cursors = 0, {}

    def call(self, fd: int, op: str, n: int, at: int) -> tuple:
        """``ret, pos, size, offset, length, eof, error`` of one call; ``offset`` and
        ``length`` are the bytes that it reads or writes."""
        if op == "OPEN":
            self.cursors[fd] = [[0], False, False, 0]
            return 0, 0, self.size, None, 0, False, False
        known = self.cursors.get(fd)
        if known is None:
            return EBADF, None, self.size, None, 0, None, None
        cursor, ret, offset, length = known[0], 0, None, 0
        if op == "DUP":
            self.cursors[n] = [cursor, False, False, 0]
            ret = n
        elif op == "CLOSE":
            del self.cursors[fd]
        elif op in ("READ", "READV", "FREAD"):
            back = min(known[3], n)
            offset, length = cursor[0], max(0, min(n - back, self.size - cursor[0]))
            cursor[0] += length
            known[3] -= back
            ret = back + length
            known[1] = known[1] or (op == "FREAD" and ret < n)
        elif op in ("WRITE", "WRITEV", "APPEND"):
            offset, length, known[3] = (self.size if op == "APPEND" else cursor[0]), n, 0
            cursor[0], ret = offset + n, n
            self.size = max(self.size, offset + n) if n else self.size
        elif op in ("PREAD", "PWRITE"):
            offset, length = at, max(0, min(n, self.size - at)) if op == "PREAD" else n
            self.size, ret = (max(self.size, at + n) if op == "PWRITE" and n else self.size), length
        elif op == "UNGETC":
            known[1], known[3], ret = False, known[3] + 1, n
        elif op in ("SEEK", "REWIND"):
            cursor[0], known[1], known[3] = (at if op == "SEEK" else 0), False, 0
            known[2] = known[2] and op == "SEEK"
            ret = cursor[0]
        elif op == "CLEARERR":
            known[1] = known[2] = False
        elif op == "FAIL":
            known[2], ret = True, -1
        elif op in ("FEOF", "FERROR"):
            ret = int(known[1] if op == "FEOF" else known[2])
        elif op != "FSYNC":
            ret = EINVAL
        return ret, cursor[0] - known[3], self.size, offset, length, known[1], known[2]


def shared_descriptors(ops: DataFrame) -> DataFrame:
    """``ops(gfid, fd, seq, op, n, at)`` on the descriptors of shared files, empty at
    first, with what each call returns, the cursor, the file's size, the range of
    bytes that it reads or writes, and the stream's flags after it.

    OPEN, DUP (as descriptor ``n``, with the same cursor), CLOSE, FSYNC; READ, READV,
    WRITE, WRITEV and APPEND of ``n`` bytes in all; PREAD and PWRITE of ``n`` at ``at``;
    SEEK to ``at``, REWIND; FREAD, which sets the end flag when it gets less than ``n``;
    UNGETC, which puts one back; CLEARERR, FEOF, FERROR; FAIL is a call that fails. A
    descriptor that is not open is EBADF. A call depends on all before it in its
    file, so a file's calls are one ordered task that keeps sizes and cursors.
    """
    columns = ["gfid", "fd", "seq", "op", "n", "at"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, file = None, SharedFile()
        for pdf in batches:
            out = []
            for gfid, fd, op, n, at in pdf[["gfid", "fd", "op", "n", "at"]].itertuples(index=False, name=None):
                if gfid != current:
                    current, file = gfid, SharedFile()
                out.append(file.call(fd, op, int(n), int(at)))
            made = pd.DataFrame(out, columns=["ret", "pos", "size", "offset", "length", "eof", "error"], index=pdf.index)
            yield pd.concat([pdf[columns], made.astype({"pos": "Int64", "offset": "Int64", "eof": "boolean", "error": "boolean"})], axis=1)

    ordered = ops.select(*columns).repartition("gfid").sortWithinPartitions("gfid", "seq")
    return ordered.mapInPandas(run, SHARED)


def synced_writes(calls: DataFrame) -> DataFrame:
    """Writes of ``shared_descriptors`` that others see, as ``seq, gfid, fd, file_pos,
    length, epoch``: those before a CLOSE or FSYNC of their descriptor, whose ``seq``
    is the epoch."""
    mark = F.when(F.col("op").isin("CLOSE", "FSYNC") & (F.col("ret") == 0), F.col("seq"))
    later = running(calls.withColumn("back", -F.col("seq")), ["gfid", "fd"], "back", "epoch", mark, F.min)
    writes = later.where("op in ('WRITE', 'WRITEV', 'APPEND', 'PWRITE') and length > 0 and epoch is not null")
    return writes.select("seq", "gfid", "fd", F.col("offset").alias("file_pos"), "length", "epoch")


def directory_reads(ops: DataFrame, entries: DataFrame) -> DataFrame:
    """``ops(dir, seq, op, n)`` of open directories with ``pos``, the place before the
    call, and ``name``, the entry that READ finds there, in order of name; null at the
    end. SEEK goes to ``n``, REWIND to 0, TELL tells the place. The place is that of
    the last SEEK or REWIND and the reads since, no further than the end."""
    listed = entries.select("dir", "name").distinct()
    listed = running(listed, ["dir"], "name", "rank", F.lit(1), F.sum).withColumn("rank", F.col("rank") - 1)
    counts = listed.groupBy("dir").agg(F.count("*").alias("n_entries"))
    moves = F.col("op").isin("SEEK", "REWIND")
    ops = running(ops, ["dir"], "seq", "since", F.when(moves, F.col("seq")), F.max)
    ops = running(ops, ["dir"], "seq", "reads", (F.col("op") == "READ").cast("long"), F.sum)
    start = ops.where(moves).select("dir", F.col("seq").alias("since"), F.when(F.col("op") == "SEEK", F.col("n")).otherwise(0).alias("from"), F.col("reads").alias("reads_then"))
    joined = ops.join(start, ["dir", "since"], "left").join(counts, "dir", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    gone = F.col("reads") - zero("reads_then") - (F.col("op") == "READ").cast("long")
    before = F.when(moves, F.lit(None)).otherwise(zero("from") + F.greatest(F.lit(0), F.least(gone, zero("n_entries") - zero("from"))))
    joined = joined.withColumn("pos", before.cast("long"))
    named = joined.join(listed.select("dir", F.col("rank").alias("pos"), "name"), ["dir", "pos"], "left")
    return named.select("dir", "seq", "op", "pos", F.when(F.col("op") == "READ", F.col("name")).alias("name"))


def list_io(requests: DataFrame, sizes: DataFrame) -> DataFrame:
    """Requests ``batch, pos, op, gfid, offset, nbytes`` of a list of transfers with
    ``ret`` and ``err``: a write returns its bytes, a read what lies before the
    file's end in ``sizes(gfid, size)`` before the batch; an unknown file is
    EINVAL, and an operation of another kind does nothing (both null)."""
    joined = requests.join(sizes.select("gfid", "size"), "gfid", "left")
    known = F.col("size").isNotNull()
    read = readable(F.col("offset"), F.col("nbytes"), F.col("size"))
    ret = F.when((F.col("op") == "WRITE") & known, F.col("nbytes")).when((F.col("op") == "READ") & known, read)
    err = F.when(F.col("op").isin("READ", "WRITE"), F.when(known, 0).otherwise(-EINVAL))
    return joined.select("batch", "pos", "op", "gfid", ret.cast("long").alias("ret"), err.cast("int").alias("err"))


def exists(asked: DataFrame, files: DataFrame) -> DataFrame:
    """``asked(req_id, path)`` with ``rc``: OK if ``files(path)`` has the path or a
    file below it, else ENOENT. Each file names its ancestors once."""
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    known = files.select(F.explode(above).alias("path")).distinct().withColumn("rc", F.lit("OK"))
    return asked.join(known, "path", "left").select("req_id", "path", F.coalesce("rc", F.lit("ENOENT")).alias("rc"))


def change_directories(ops: DataFrame, directories: DataFrame) -> DataFrame:
    """``ops(seq, op, path)`` of MKDIR and RMDIR with ``rc``, each path by itself: a
    path of ``directories(path, is_empty)`` is there at first. MKDIR of one that is
    there is EEXIST, RMDIR of one that is not is ENOENT, and of one with files in
    it ENOTEMPTY. Directories of the log hold no files, so after the first
    operation on a path it is there exactly if the last operation made it."""
    there = directories.select("path", "is_empty")
    joined = ops.join(there, "path", "left").withColumn("full", F.coalesce(~F.col("is_empty"), F.lit(False)))
    before = with_neighbours(joined, ["path"], "seq", {"last": (F.col("op"), -1)})
    is_there = F.when(F.col("full"), True).when(F.col("last").isNull(), F.col("is_empty").isNotNull()).otherwise(F.col("last") == "MKDIR")
    rc = F.when(F.col("op") == "MKDIR", F.when(is_there, "EEXIST").otherwise("OK")).otherwise(
        F.when(~is_there, "ENOENT").when(F.col("full"), "ENOTEMPTY").otherwise("OK")
    )
    return before.select("seq", "op", "path", rc.alias("rc"))


def holes(extents: DataFrame, sizes: DataFrame) -> DataFrame:
    """``gfid, start, end`` of the ranges below each file's end, in ``sizes(gfid,
    size)``, that no extent holds: before the first extent, between neighbours,
    and after the last, each cut at the end."""
    known = extents.select("gfid", "start", "end").join(sizes.select("gfid", "size"), "gfid", "left_semi")
    marks = known.unionByName(sizes.select("gfid", F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end")))
    gaps = with_neighbours(marks, ["gfid"], "start", {"next": (F.col("start"), 1)}).join(sizes.select("gfid", "size"), "gfid")
    gaps = gaps.select("gfid", (F.col("end") + 1).alias("start"), (F.least(F.coalesce("next", "size"), "size") - 1).alias("end"))
    return gaps.where("start <= end")


def file_system(files: DataFrame, max_files: int) -> DataFrame:
    """The row that a statfs call shows, with the number of files in use."""
    used = files.agg(F.count("*").alias("f_used"))
    return used.select(
        F.lit(FS_TYPE).cast("long").alias("f_type"), F.lit(FS_BLOCK).cast("long").alias("f_bsize"), F.lit(max_files).cast("long").alias("f_files"),
        "f_used", F.lit(FS_NAME).cast("long").alias("f_namelen"),
    )


def scanned(line: Column, form: str) -> Column:
    """The fields of a formatted scan as an array of strings, null from the first
    that does not fit: ``%d %u %i %o %x %p %f %e %g %s %c %[set]``, with a width and a
    length (``hh h l ll j z t L q``), ``%n``, which is the number of characters up to
    there, and ``%*`` for a field that is skipped; white space stands for any run of
    it, ``%%`` for a percent sign, other characters for themselves. A width on ``%f``,
    ``%e`` and ``%g`` is not looked at."""
    real = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    classes = {
        "d": r"[+-]?[0-9]{1,W}", "u": r"[0-9]{1,W}", "x": r"(?:0[xX])?[0-9a-fA-F]{1,W}", "p": r"(?:0[xX])?[0-9a-fA-F]{1,W}", "o": r"[+-]?[0-7]{1,W}",
        "i": r"[+-]?(?:0[xX][0-9a-fA-F]{1,W}|0[0-7]{1,W}|[0-9]{1,W})", "f": real, "e": real, "g": real, "s": r"\S{1,W}", "c": r".{W}",
    }
    pattern, fields = "^", []
    for m in re.finditer(r"%(\*?)([0-9]*)(?:hh|h|ll|l|[jztLq])?(\[\^?\]?[^\]]*\]|[duioxpfegscn%])|(\s+)|(.)", form):
        skip, width, kind, space, other = m.groups()
        if space:
            pattern += r"\s*+"
        elif other or kind == "%":
            pattern += re.escape(other or "%")
        elif kind == "n":
            fields.append((pattern, 0))
        else:
            body = f"{kind}{{1,W}}" if kind.startswith("[") else classes[kind]
            body = body.replace("{1,W}", f"{{1,{width}}}" if width else "+").replace("{W}", f"{{{width or 1}}}")
            body = f"(?>{body})"  # a field gives nothing back to the next
            lead = "" if kind.startswith("[") or kind == "c" else r"\s*+"
            if skip:
                pattern += lead + body
            else:
                pattern += f"{lead}({body})"
                fields.append((pattern, sum(group > 0 for _, group in fields) + 1))
    # A field is there if the line fits the format as far as that field.
    found = lambda p, group: F.regexp_extract(line, p, group) if group else F.length(F.regexp_extract(line, p, 0)).cast("string")
    return F.array(*[F.when(line.rlike(p), found(p, group)) for p, group in fields])


def printed(form: str, *values: Column) -> Column:
    """Formatted text, and the number of bytes that writing it returns."""
    text = F.format_string(form, *values)
    return F.struct(text.alias("text"), F.octet_length(text).cast("long").alias("ret"))


def text_lines(files: DataFrame, most: int) -> DataFrame:
    """What reading ``files(gfid, text)`` line by line into a buffer of ``most``
    bytes gives: ``gfid, line_no, piece_no, piece``; a piece ends with its line's
    end or, in ASCII text, after ``most - 1`` characters."""
    lines = files.select("gfid", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))).alias("line_no", "line"))
    pieces = F.regexp_extract_all("line", F.lit(rf"(?s).{{1,{most - 1}}}"), F.lit(0))
    return lines.select("gfid", "line_no", F.posexplode(pieces).alias("piece_no", "piece"))


def range_requests(lines: DataFrame) -> DataFrame:
    """``line_no, offset, length`` of requests typed as ``offset,length``, in decimal,
    hexadecimal or octal; what stands after the first ``quit`` is not read, and
    other lines give nulls."""
    last = lines.where(F.col("line").startswith("quit")).agg(F.min("line_no").alias("stop"))
    used = lines.crossJoin(F.broadcast(last)).where("stop is null or line_no < stop")  # one row

    def number(i: int) -> Column:
        word = F.trim(F.get(F.split("line", ",", 2), F.lit(i)))
        base = lambda pattern, radix: F.when(word.rlike(rf"^{pattern}"), F.conv(F.regexp_extract(word, pattern, 1), radix, 10).cast("long"))
        return F.coalesce(base(r"0[xX]([0-9a-fA-F]+)", 16), base(r"0([0-7]+)", 8), base(r"([0-9]+)", 10))

    return used.select("line_no", number(0).alias("offset"), number(1).alias("length"))


def errors(spark: SparkSession) -> DataFrame:
    """``code, name, text`` of the error codes."""
    return spark.createDataFrame([(ERROR_BASE + 1 + i, n, t) for i, (n, t) in enumerate(ERRORS.items())], "code int, name string, text string")


def small_operations(spark: SparkSession, ranks: int, rounds: int, shared: bool) -> DataFrame:
    """``seq, rank, op, path``: every kind of small operation by every rank, on one
    shared path or on one path for each rank."""
    names = F.array(*[F.lit(x) for x in SMALL_OPS])
    per_round = len(SMALL_OPS) * ranks
    base = spark.range(rounds * per_round).select(
        F.col("id").alias("seq"), (F.col("id") % ranks).cast("int").alias("rank"), F.get(names, (F.floor(F.col("id") / ranks) % len(SMALL_OPS)).cast("int")).alias("op")
    )
    stem = F.concat(F.lit("/simul_"), F.regexp_replace("op", " ", "_"))
    return base.withColumn("path", stem if shared else F.concat(stem, F.lit("."), F.col("rank")))
