"""Identity, placement and mode expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
SLICE = 1 << 20  # bytes of a slice
MASK = 0o777
DEFAULT_MODE = 0o666
WRITE_BITS = 0o222
BLOCK = 4096  # bytes of a block in a stat row


def gfid(path: Column) -> Column:
    """File id of a path: the first 32 bits of its MD5 without the lowest one.
    0 is not a valid id; different paths may share one, so join on paths."""
    return F.shiftright(F.conv(F.substring(F.md5(path), 1, 8), 16, 10).cast("long"), 1).cast("int")


def owner(file_id: Column, servers: int) -> Column:
    """The server that owns a file's metadata."""
    return F.pmod(file_id, F.lit(servers)).cast("int")


def slice_count(offset: Column, length: Column, size: int = SLICE) -> Column:
    """Number of slices that a range touches; 0 for an empty range."""
    last = F.floor((offset + length - 1) / F.lit(size))
    return F.when(length > 0, last - F.floor(offset / F.lit(size)) + 1).otherwise(0).cast("long")


def in_namespace(path: Column, mount: str) -> Column:
    """Whether a path is the mount point or lies under it."""
    return (path == mount) | path.startswith(mount.rstrip("/") + "/")


def normal_path(path: Column, working: Column) -> Column:
    """An absolute path with single slashes, without ``.`` steps and without a
    slash at its end; ``..`` steps are taken back in order."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(working, F.lit("/"), path))
    steps = F.filter(F.split(whole, "/"), lambda s: (s != "") & (s != "."))
    empty = F.expr("cast(array() as array<string>)")
    back = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    kept = F.aggregate(steps, empty, lambda done, s: F.when(s == "..", back(done)).otherwise(F.concat(done, F.array(s))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def created_mode(permissions: Column, umask: Column) -> Column:
    """Mode of a new file: the given permissions, 0666 if none, less the mask."""
    asked = F.when(permissions == 0, F.lit(DEFAULT_MODE)).otherwise(permissions)
    return asked.bitwiseAND(F.lit(MASK)).bitwiseAND(F.bitwise_not(umask))


def laminates(mode: Column, new_mode: Column) -> Column:
    """Whether a change of mode publishes the file: it had a write bit, and the
    new mode clears every one that it had."""
    had = mode.bitwiseAND(F.lit(WRITE_BITS))
    return (had != 0) & (had.bitwiseAND(new_mode) == 0)


def open_flags(mode: Column) -> Column:
    """What a stream's mode string asks for: read, write, create, truncate,
    append; null for a string that is no mode."""
    plus = mode.contains("+")
    letter = F.substring(mode, 1, 1)
    flags = F.struct(
        ((letter == "r") | plus).alias("read"), ((letter != "r") | plus).alias("write"), (letter != "r").alias("create"),
        (letter == "w").alias("truncate"), (letter == "a").alias("append"),
    )
    return F.when(mode.rlike(r"^[rwa](b\+?|\+b?)?$"), flags)


def range_overflows(offset: Column, length: Column) -> Column:
    """Whether ``offset + length`` leaves the range of a long."""
    return F.try_add(offset, length).isNull()
