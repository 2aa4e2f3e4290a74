"""SimHash near-duplicates through a byte-position inverted index."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_by_block, cut_lineage, fresh, sent, words_of
from .components import connected_components
from .sketch import sketch, sketch_links

SHINGLE = 3
STAGE_SHINGLE = 5
SEED = 42
DISTANCE = 2
LARGE_POSTING = 64

# The ASCII capitals and their small letters.
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the word shingles of one text in order, repeats included; fewer
    words than a shingle has are one. No words: none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words).translate(_LOWER)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = list(itertools.accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0] + [e + 1 for e in ends[:-shingle]]
    hashes = (digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=True))
    return np.fromiter(hashes, np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint, as a signed long: a bit is 1 if it is set in over half of
    the hashes. Sums run over slices, so memory is bounded. No hashes: zero."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        bits = hashes[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1).sum(0, dtype=np.int64)
    fingerprint = np.packbits(2 * ones > len(hashes)).view(">u8")[0]
    return int(np.uint64(fingerprint).astype(np.int64))


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, name: str = "fp") -> DataFrame:
    """Append ``name``, a long, to ``docs(text, ...)`` without a shuffle."""
    fields = T.StructType([T.StructField(name, T.LongType())])
    return append_by_block(docs, "text", lambda texts: {name: [simhash(t) for t in texts]}, fields)


# Byte positions that make up an index key. Two fingerprints at most DISTANCE =
# 2 bits apart differ in at most two bytes, and for any two of the eight
# positions some row here avoids both, so such a pair meets in some posting.
KEY_POSITIONS = (
    (0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 4, 5), (2, 3, 6, 7), (0, 1, 6, 7), (2, 3, 4, 5),
)


def byte_at(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def shared_bytes(x: Column, y: Column) -> Column:
    """Number of positions at which two fingerprints hold the same byte."""
    return sum(((byte_at(x, p) == byte_at(y, p)).cast("int") for p in range(8)), F.lit(0))


def links(distinct: DataFrame, large: int = LARGE_POSTING) -> DataFrame:
    """Edges ``a, b`` whose connected components are those of the graph that
    links fingerprints of ``distinct(fp)`` at 2 or fewer differing bits.

    The index maps four bytes, with their positions, to the fingerprints that
    hold them. Within a posting each pair is a candidate; it stays if at least
    six of its eight positional bytes agree, which two differing bits guarantee,
    and is verified by the number of differing bits.

    A posting of more than ``large`` fingerprints, as a group of near copies
    makes, is not paired off, which would be quadratic. There each fingerprint
    is listed under itself and its one-bit variants: two fingerprints differ in
    at most 2 bits exactly if they share a variant, and those that share one are
    all linked, so each is linked with the least. That is exact and linear.
    """
    # Masks are signed longs of the four bytes of a key.
    masks = []
    for positions in KEY_POSITIONS:
        mask = sum(0xFF << (8 * p) for p in positions)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    index = distinct.select("fp", F.explode(keys).alias("p")).select("fp", "p.k", "p.key")
    sizes = index.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    index = index.join(sizes, ["k", "key"])

    small = index.where(F.col("n") <= large)
    left, right = small.select("k", "key", F.col("fp").alias("a")), small.select("k", "key", F.col("fp").alias("b"))
    pairs = left.join(right, ["k", "key"]).where("a < b")
    pairs = pairs.where(shared_bytes(F.col("a"), F.col("b")) >= 8 - DISTANCE)
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)

    crowded = index.where(F.col("n") > large).select("fp").distinct()
    flips = [F.lit(0)] + [F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)]
    variants = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(x.cast("long")) for x in flips])).alias("variant"))
    least = variants.groupBy("variant").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = variants.join(least, "variant").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.select("a", "b").unionAll(stars).distinct()


def near_duplicate_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, fp)`` of every row, and ``(fp, root, component_id)`` of every
    fingerprint, where fingerprints of a component share ``root``."""
    prints = cut_lineage(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"))
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    classes = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Both are written, so that a root that very many share is a plain join, which Spark can split.
    classes = cut_lineage(classes)
    ids = cut_lineage(classes.groupBy("root").agg(F.min("least").alias("component_id")))
    return prints, classes.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of each row of ``docs(doc_id, text)``;
    ``component_id`` is the least doc_id of the rows reachable by links.

    Texts are read once and not shuffled; documents of one fingerprint are one
    node, by partial aggregation, so exact copies cost nothing further.
    Defined results: null, empty and blank texts have fingerprint zero and link
    like others; a null doc_id counts only where no other id is in its component,
    and then component_id is null; repeated rows each give a row; extra columns
    are not read; an empty table gives no rows.
    """
    prints, classes = near_duplicate_classes(docs)
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def node_of(hashes: np.ndarray, fp: int) -> int:
    """A number for a fingerprint and a set of shingles together, as a signed long."""
    number = xxhash.xxh64_intdigest(np.unique(hashes).astype("<u8").tobytes(), fp & (1 << 64) - 1)
    return number - (1 << 64) if number >> 63 else number


def marked(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs(text, ...)`` without the text, with both fingerprints, ``fp`` and
    ``sketch``, ``node``, a number for ``fp`` and the set of shingles, and ``chars``."""
    fields = T.StructType(
        [T.StructField("fp", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("node", T.LongType()), T.StructField("chars", T.LongType())]
    )

    def marks(texts: list) -> dict[str, list]:
        hashes = [shingle_hashes(t, shingle) for t in texts]
        fps = [majority(h) for h in hashes]
        nodes = [node_of(h, fp) for h, fp in zip(hashes, fps, strict=True)]
        return {"fp": fps, "sketch": [sketch(h) for h in hashes], "node": nodes, "chars": [len(t or "") for t in texts]}

    return append_by_block(docs, "text", marks, fields).drop("text")


def packed(docs: DataFrame) -> DataFrame:
    """``docs(text, ...)`` with the text as compressed ``data``."""
    fields = T.StructType([T.StructField("data", T.BinaryType())])
    pack = zstandard.compress
    return append_by_block(docs, "text", lambda texts: {"data": [pack((t or "").encode("utf-8", "surrogatepass")) for t in texts]}, fields).drop("text")


def unpacked_set(data: bytes, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """The sorted set of shingles of a text from ``packed``."""
    return np.unique(shingle_hashes(zstandard.decompress(data).decode("utf-8", "surrogatepass"), shingle))


def similar_classes(marks: DataFrame, docs: DataFrame, shingle: int = STAGE_SHINGLE) -> DataFrame:
    """``root, first`` of every group of the rows of ``marks``, which are ``marked``;
    ``first`` is the least ``(no_id, doc_id, text_hash)`` of its rows. Nodes link if
    their SimHash fingerprints differ in at most DISTANCE bits, or if the sketches
    propose them and the sets of shingles of their texts, read from ``docs(text,
    text_hash)``, have a Jaccard similarity of 0.8 or more."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = cut_lineage(marks.groupBy("node", "fp", "sketch").agg(F.min(first).alias("first"), F.max("chars").alias("chars")))
    prints = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("one")))
    near = links(prints.select("fp"))
    near = near.join(prints.select(F.col("fp").alias("a"), F.col("one").alias("from")), "a")
    near = near.join(prints.select(F.col("fp").alias("b"), F.col("one").alias("to")), "b")
    same = nodes.join(prints, "fp").select(F.col("one").alias("a"), F.col("node").alias("b"))

    def sets(wanted: DataFrame) -> DataFrame:
        hashes = cut_lineage(nodes.join(wanted, "node").select("node", F.col("first.text_hash").alias("text_hash")))
        found = docs.select("text", "text_hash").join(sent(hashes), "text_hash")
        return packed(found.select("node", "text")).dropDuplicates(["node"])

    read = functools.partial(unpacked_set, shingle=shingle)
    edges = sketch_links(nodes.select("node", "sketch", "chars"), sets=sets, read=read).unionAll(same).unionAll(near.select("from", "to"))
    roots = connected_components(edges)
    classes = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return classes.groupBy("root").agg(F.min("first").alias("first"))


def keep_one(docs: DataFrame, shingle: int = STAGE_SHINGLE) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group, that with the least
    doc_id; of repeated rows with that id one stays, of different texts with it that
    of the least hash. A group without any doc_id keeps one of its rows too. Columns
    are those of ``docs``.

    Shingles have five words. At a similarity of 0.8 SimHash fingerprints differ
    in about nine of 64 bits, far beyond DISTANCE, so links by SimHash are joined
    by those of ``sketch_links``. A second pass over the texts finds those of the
    nodes that the sketches propose, which are compared exactly. Texts are shuffled
    where they are compared, compressed, and where the same row is there twice.
    """
    columns, key, row = docs.columns, fresh(docs, "text_hash"), fresh(docs, "row")
    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    marks = cut_lineage(marked(texts, shingle))
    kept = similar_classes(marks, texts, shingle).select("first.doc_id", "first.text_hash")
    times = marks.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    kept = cut_lineage(kept.alias("a").join(times.alias("b"), same).select("a.doc_id", "a.text_hash", F.col("b.n") > 1))
    kept = kept.toDF("_id", "_hash", "_twice")
    rows = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", key, F.struct(*columns).alias(row))
    stay = rows.join(sent(kept), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(key) == F.col("_hash")))
    twice = stay.where("_twice").dropDuplicates(["doc_id", key])
    return stay.where("not _twice").select(f"{row}.*").unionAll(twice.select(f"{row}.*"))
