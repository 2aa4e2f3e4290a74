"""Near duplicates at a similarity of word shingles that SimHash is too coarse for:
a byte-position inverted index over fingerprints of minwise bytes.

Two texts whose sets of shingles have Jaccard similarity s agree at a position of
a SimHash fingerprint's bytes with a probability that is about 0.3 for s = 0.8,
so that no number of shared bytes is guaranteed. A byte of a minwise fingerprint
agrees with probability s. The index and the count of shared positional bytes are
those of the SimHash operator; they propose pairs, and the texts' sets of shingles
decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .components import connected_components

POSITIONS = 128  # bytes of a fingerprint
KEYS, KEY_BYTES = 32, 4  # a pair of similarity 0.8 meets under some key with probability 1 - 5e-8
SIMILARITY = 0.8
SLACK = 2.0  # standard deviations of the count of shared bytes
LOOSE = 4.0  # the same, where sets of shingles decide: a pair of 0.8 is proposed with probability 0.9999
SMALL_POSTING = 32
TILE = 1024  # nodes of a part of a large posting, about
TILE_CHARS = 8_000_000  # characters of their texts, likewise
FIRST = 8  # one in so many large postings goes first
READ_AT_ONCE = 2_000_000  # elements of sets that a tile keeps in memory

_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(1, 1 << 63, POSITIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, POSITIONS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def sketch(hashes: np.ndarray) -> bytes:
    """A byte for each position: 8 bits of the least of the shingles' hashes under
    the position's own permutation. No shingles: zeros. Slices bound the memory."""
    if not len(hashes):
        return bytes(POSITIONS)
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[i : i + 2048, None] * _FACTORS + _SHIFTS).min(0), out=least)
    least ^= least >> np.uint64(32)
    return ((least * _MIX) >> np.uint64(56)).astype(np.uint8).tobytes()


def least_shared(similarity: float = SIMILARITY, slack: float = SLACK) -> int:
    """Bytes that a pair of this similarity shares, less ``slack`` deviations."""
    p = similarity + (1 - similarity) / 256
    return int(POSITIONS * p - slack * (POSITIONS * p * (1 - p)) ** 0.5)


def shared(x: Column, y: Column) -> Column:
    """Positions at which two fingerprints hold the same byte."""
    same = lambda i: F.substring(x, i, F.lit(1)) == F.substring(y, i, F.lit(1))
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(POSITIONS)), same))


def overlaps(one: np.ndarray, others: list) -> np.ndarray:
    """How many elements each of ``others`` shares with ``one``; all are sorted sets."""
    flat = np.concatenate([np.zeros(0, np.uint64), *others])
    if not len(one):
        return np.zeros(len(others), np.int64)
    hits = np.r_[0, np.cumsum(one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat)]
    ends = np.cumsum([len(o) for o in others], dtype=np.int64)
    return hits[ends] - hits[np.r_[0, ends[:-1]]] if len(ends) else ends


def similar(one: np.ndarray, others: list) -> np.ndarray:
    """Which of ``others`` have a Jaccard similarity of SIMILARITY or more with
    ``one``, in whole numbers."""
    both = overlaps(one, others)
    either = len(one) + np.array([len(o) for o in others], np.int64) - both
    return 100 * both >= round(100 * SIMILARITY) * either


Read = Callable[[bytes], np.ndarray]


def set_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


class Sets:
    """Sets of shingles by place, made from ``data`` when asked for. Those made are
    kept until they come to READ_AT_ONCE elements."""

    def __init__(self, data: list, read: Read):
        self.data, self.read, self.kept, self.held = data, read, {}, 0

    def __getitem__(self, i: int) -> np.ndarray:
        found = self.kept.get(i)
        if found is None:
            found = self.read(self.data[i])
            if self.held > READ_AT_ONCE:
                self.kept, self.held = {}, 0
            self.kept[i] = found
            self.held += len(found)
        return found


def sketch_links(
    nodes: DataFrame, least: int | None = None, small: int = SMALL_POSTING, sets: Callable[[DataFrame], DataFrame] | None = None, read: Read = set_of
) -> DataFrame:
    """Edges ``a, b`` whose components are those of the graph that links the rows
    of ``nodes(node, sketch, chars)`` which meet under a key and share ``least``
    bytes. With ``sets``, which gives ``node, data`` for a table of nodes, such a
    pair is linked if the Jaccard similarity of the sets that ``read`` makes of its
    data is SIMILARITY or more.

    A posting lists the nodes that hold the same four bytes at a key's positions.
    In one of up to ``small`` nodes each pair is tallied. A larger one, as a group
    of near copies makes, is worked on in tiles of two parts of about TILE nodes;
    every pair lies in a tile, and a tile searches from node to node among those
    not yet reached, so that a group costs little more than its size, and returns
    a spanning forest, never its pairs. The nodes of a group meet in most of the
    KEYS postings: one posting in FIRST goes first, and of the others only those
    whose nodes are not all linked by then. Nodes are distinct; there is no cap.
    """
    if least is None:
        least = least_shared() if sets is None else least_shared(slack=LOOSE)
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", k * POSITIONS // KEYS + 1, KEY_BYTES)) for k in range(KEYS)])
    index = nodes.select("node", "chars", F.explode(keys).alias("key"))
    sizes = cut_lineage(index.groupBy("key").agg(F.count("*").alias("n"), F.sum("chars").alias("of")).where("n > 1"))
    index = cut_lineage(index.drop("chars").join(sizes, "key"))

    few = index.where(F.col("n") <= small)
    pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").where("a < b")
    pairs = pairs.select("a", "b").distinct()
    marks = nodes.select("node", "sketch")
    pairs = pairs.join(marks.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")
    pairs = pairs.join(marks.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    pairs = pairs.where(shared(F.col("x"), F.col("y")) >= least).select("a", "b")

    many = index.where(F.col("n") > small)
    if sets is not None:
        # Sets travel only for the nodes that need them.
        pairs = cut_lineage(pairs)
        wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).unionAll(many.select("node")).distinct()
        held = cut_lineage(sets(wanted))
        pairs = pairs.join(held.select(F.col("node").alias("a"), F.col("data").alias("x")), "a")
        pairs = pairs.join(held.select(F.col("node").alias("b"), F.col("data").alias("y")), "b")

        def verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                keep = [bool(similar(read(x), [read(y)])[0]) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
                yield pdf.loc[np.array(keep, bool), ["a", "b"]]

        pairs = pairs.mapInPandas(verified, "a long, b long")
        marks = marks.join(held, "node")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        ids = pdf["node"].to_numpy()
        bytes_ = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(ids), POSITIONS)
        a, b = forest(bytes_, least, Sets(pdf["data"].tolist(), read) if "data" in pdf else None)
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    def tiles(rows: DataFrame) -> DataFrame:
        parts = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("of") / TILE_CHARS)).cast("int")
        rows = rows.withColumn("parts", parts).withColumn("p", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
        rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.select("key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "node").join(marks, "node")
        return rows.groupBy("key", "i", "j").applyInPandas(tile, "a long, b long").distinct()

    goes_first = F.pmod(F.xxhash64("key"), F.lit(FIRST)) == 0
    found = cut_lineage(pairs.unionAll(tiles(many.where(goes_first))))
    roots = connected_components(found)
    rest = many.where(~goes_first)
    root = F.coalesce("root", "node")
    open_ = rest.join(roots, "node", "left").groupBy("key").agg(F.min(root).alias("lo"), F.max(root).alias("hi")).where("lo < hi")
    return found.unionAll(tiles(rest.join(cut_lineage(open_.select("key")), "key", "left_semi")))


def forest(bytes_: np.ndarray, least: int, sets: Sets | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the rows that share ``least`` bytes and, if
    ``sets`` are given, have similar sets; each edge is a pair that was compared."""
    unseen, ends, starts = np.arange(len(bytes_)), [], []
    while len(unseen):
        start, unseen = unseen[0], unseen[1:]
        todo = [start]
        while todo and len(unseen):
            at = todo.pop()
            near = (bytes_[unseen] == bytes_[at]).sum(1) >= least
            if sets is not None:
                one, tried = sets[at], np.flatnonzero(near)
                for i in range(0, len(tried), 256):
                    part = tried[i : i + 256]
                    near[part] = similar(one, [sets[k] for k in unseen[part]])
            found = unseen[near]
            ends.append(found)
            starts.append(np.full(len(found), at))
            todo.extend(found.tolist())
            unseen = unseen[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends])
