"""Stupid-backoff language-model scores of documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, word_count

ORDER = 3
BACKOFF = 0.4
BLOCK_CHARS = 6_000_000
GRAMS_PER_BUCKET = 2_000_000
PACKED_BUCKETS = 8192  # up to so many, rows are long enough to be compressed one by one

BLOCK = pa.schema([("block", pa.int64()), ("keys", pa.list_(pa.string())), ("ends", pa.list_(pa.int64())), ("texts", pa.binary())])
NUMBERS = [("bucket", pa.int64()), ("block", pa.int64()), ("width", pa.int32())]
GRAMS = pa.schema([*NUMBERS, ("low", pa.binary()), *[(c, pa.binary()) for c in ("high", "high_more", "counts", "counts_more")]])
OTHERS = pa.schema([*NUMBERS[:2], ("others", pa.binary()), ("others_more", pa.binary())])
SCORES = pa.schema([("key", pa.string()), ("n_words", pa.int64()), ("score", pa.float64())])
# Arrow's types and Spark's.
NAMES = {"int64": "long", "int32": "int", "string": "string", "double": "double", "binary": "binary"}


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that mixes their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


class Block:
    """The n-grams of some documents, texts as bytes, laid end to end: ``flat`` are the hashes of
    all orders, one order after the other; ``real[k]`` tells the positions at
    which an n-gram of k + 1 words ends, which is not at the start of a
    document."""

    def __init__(self, texts: list, order: int):
        hashes, ids, lengths = WordHashes(), [], []
        for text in texts:
            words = text.split()
            lengths.append(len(words))
            ids.extend(map(hashes.__getitem__, words))
        self.lengths = np.array(lengths, np.int64)
        word = np.array(ids, np.uint64)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.lengths)
        self.at = np.arange(len(word)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.real = [self.at >= k for k in range(order)]
        gram = spread(word + np.uint64(1))
        parts = [gram]
        for k in range(1, order):
            longer = gram.copy()
            longer[1:] = spread(gram[:-1] * np.uint64(3) + word[1:] + np.uint64(k + 1))
            gram = longer
            parts.append(gram[self.real[k]])
        self.flat = np.concatenate(parts)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes in ascending order, and how often each occurs."""
        ordered = np.sort(self.flat)
        first = np.flatnonzero(run_starts(ordered))
        return ordered[first], np.diff(np.r_[first, len(ordered)])

    def scores(self, elsewhere: np.ndarray, n_words: int, backoff: float) -> np.ndarray:
        """Summed log score of each document under the counts of all others;
        ``elsewhere`` are the counts of the distinct n-grams outside the block.
        Sorting by hash keeps a document's n-grams together, so one order serves
        the counts of a position's n-gram in the block and in the document."""
        if not len(self.flat):
            return np.zeros(len(self.lengths))
        by = np.argsort(self.flat, kind="stable")
        new_gram = run_starts(self.flat[by])
        docs = np.concatenate([self.doc[r] for r in self.real])[by]
        own_run = np.flatnonzero(new_gram | run_starts(docs))
        own = np.repeat(np.diff(np.r_[own_run, len(by)]), np.diff(np.r_[own_run, len(by)]))
        totals = elsewhere + np.diff(np.r_[np.flatnonzero(new_gram), len(by)])
        others = np.empty(len(by), np.int64)
        others[by] = totals[np.cumsum(new_gram) - 1] - own
        score, lower, start = None, None, 0
        for k, real in enumerate(self.real):
            n = int(np.count_nonzero(real))
            count = others[start : start + n]
            start += n
            if k == 0:
                rest = np.maximum(n_words - self.lengths, 1)[self.doc]
                score, lower = np.log(np.maximum(count, 1) / rest), count
                continue
            here = np.flatnonzero(real)
            context = lower[here - 1]
            # A context without a count, where its n-gram has one, is a clash of hashes.
            seen = (count > 0) & (context > 0)
            score[here] += math.log(backoff)
            score[here[seen]] = np.log(count[seen] / context[seen])
            lower = np.zeros(len(real), np.int64)
            lower[here] = count
        return np.bincount(self.doc, weights=score, minlength=len(self.lengths))


def run_starts(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    return np.r_[np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]


def low_bytes(values: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` lowest bytes of each number, one after the other."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).reshape(-1)


def from_bytes(data: np.ndarray, width: int) -> np.ndarray:
    whole = np.zeros((len(data) // width, 8), np.uint8)
    whole[:, :width] = data.reshape(-1, width)
    return whole.view("<u8").reshape(-1)


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie end to end in ``data``, up to ``ends``."""
    offsets = np.r_[0, ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def laid_out(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of binary values, end to end, and their lengths."""
    parts = []
    for chunk in column.chunks:
        if not len(chunk):
            continue
        offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)
        parts.append((data[offsets[0] : offsets[-1]], np.diff(offsets)))
    data, lengths = zip(*parts, strict=True) if parts else ((), ())
    return np.concatenate([np.zeros(0, np.uint8), *data]), np.concatenate([np.zeros(0, np.int64), *lengths])


def planes(values: np.ndarray, ends: np.ndarray, pack: bool) -> tuple[pa.Array, pa.Array]:
    """Rows of mostly small numbers, which end at ``ends``: a byte for each number,
    255 for one that is larger, and the larger ones in full."""
    low, large = np.minimum(values, 255).astype(np.uint8), values >= 255
    more = binaries(low_bytes(values[large], 8), 8 * np.cumsum(large)[ends - 1] if len(ends) else ends)
    if not pack:
        return binaries(low, ends), more
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    return pa.array([zstandard.compress(low[i:j].tobytes(), 1) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()), more


def read_planes(low: pa.ChunkedArray, more: pa.ChunkedArray, packed: bool) -> np.ndarray:
    data = np.frombuffer(b"".join(map(zstandard.decompress, low.to_pylist())), np.uint8) if packed else laid_out(low)[0]
    values = data.astype(np.uint64)
    values[data == 255] = from_bytes(laid_out(more)[0], 8)
    return values


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``block, keys, ends, texts`` of about BLOCK_CHARS characters each: ids and
    texts of neighbouring documents, the texts compressed together. A block's
    number is that of its task and its place in it."""
    task, made, keys, texts, chars = TaskContext.get().partitionId(), 0, [], [], 0

    def row() -> pa.RecordBatch:
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(d) for d in data], dtype=np.int64)
        packed = zstandard.compress(b"".join(data), 3)
        columns = [[task << 32 | made], [keys], [ends.tolist()], [packed]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, BLOCK.types, strict=True)], schema=BLOCK)

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            keys.append(key)
            texts.append(text)
            chars += len(text or "")
            if chars >= BLOCK_CHARS:
                yield row()
                made, keys, texts, chars = made + 1, [], [], 0
    if keys:
        yield row()


def documents_of(table: pa.Table) -> tuple[list, list]:
    """Ids and texts of the one row of a block."""
    row = table.to_pylist()[0]
    data, starts = zstandard.decompress(row["texts"]), [0, *row["ends"]]
    return row["keys"], [data[i:j] for i, j in zip(starts, row["ends"], strict=False)]


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """``doc_id, n_words, score, mean_score`` of every row of
    ``docs(doc_id, text)``: the sum over its words of the log of the
    stupid-backoff score, under counts of the n-grams in all other rows.

    The relations: ``grams(bucket, block, grams, counts)`` are the distinct
    n-grams of a block of neighbouring documents, exploded by hash range; grouped
    by bucket they give the corpus counts, which are joined to each block's n-grams
    and go back to their block, where they are summed by document. Blocks have
    BLOCK_CHARS characters and buckets GRAMS_PER_BUCKET n-grams at every size of the
    input. A row has those n-grams of a block that fall into a bucket, as the gaps
    between sorted hashes: about 5.6 bytes for each while blocks have many in a
    bucket, and in a corpus of a thousand times the size a row becomes a single
    n-gram. Encoding goes over all of a block's n-grams at once; there is a step for
    a row only up to PACKED_BUCKETS buckets, to compress it. Hashes have all 64 bits: n different n-grams make
    n * n / 2**65 clashing pairs on average, which is six among 1.5e10. A clash
    adds the counts of two n-grams, and where it leaves a context without a count
    the score backs off. A frequent n-gram adds one number for each block, and
    repeated rows lie where they stand in the input, so no key is hot. Counts
    cover all rows. Texts are shuffled once, compressed by block.

    Defined results: null, empty and blank texts have 0 words, score 0 and a
    null mean; a word never seen elsewhere counts as seen once; a null doc_id is
    kept; repeated rows are rows like others, each scored against the rest,
    copies included; extra columns are not read; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    n_words = docs.agg(F.sum(word_count(F.col("text"))).alias("words")).first()["words"] or 0
    bits = max(0, math.ceil(math.log2(max(1, order * n_words / GRAMS_PER_BUCKET))))
    # One exchange by block serves both uses below.
    blocks = short_batches(docs.select(F.col("doc_id").cast("string").alias("key"), "text")).mapInArrow(block_rows, "block long, keys array<string>, ends array<long>, texts binary")

    pack = 1 << bits <= PACKED_BUCKETS

    def explode(table: pa.Table) -> pa.Table:
        grams, counts = Block(documents_of(table)[1], order).grams()
        bucket = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
        first = np.flatnonzero(run_starts(bucket))
        gaps = np.diff(grams, prepend=np.uint64(0))
        # A row's first gap counts from its bucket's lower end.
        gaps[first] = grams[first] - ((bucket[first].astype(np.uint64) << np.uint64(64 - bits)) if bits else np.uint64(0))
        ends = np.r_[first[1:], len(grams)][: len(first)]
        width = int(64 - math.log2(max(2, len(grams)))) // 8  # bytes of a gap that are as good as random
        low = binaries(low_bytes(gaps, width), ends * width)
        numbers = [bucket[first], np.full(len(first), table["block"][0].as_py()), np.full(len(first), width, np.int32)]
        columns = [*map(pa.array, numbers), low, *planes(gaps >> np.uint64(8 * width), ends, pack), *planes(counts, ends, pack)]
        return pa.Table.from_arrays(columns, schema=GRAMS)

    def count(table: pa.Table) -> pa.Table:
        flat, own, lengths, rows = [], [], [], []
        for width in pc.unique(table["width"]).to_pylist():
            part = table.filter(pc.equal(table["width"], width))
            data, sizes = laid_out(part["low"])
            n = sizes // width
            gaps = from_bytes(data, width) + (read_planes(part["high"], part["high_more"], pack) << np.uint64(8 * width))
            values = np.cumsum(gaps, dtype=np.uint64)
            values -= np.repeat(np.r_[np.uint64(0), values][np.cumsum(n) - n], n)
            flat.append(values)
            own.append(read_planes(part["counts"], part["counts_more"], pack))
            lengths.append(n)
            rows.append(part.select(["bucket", "block"]))
        flat, own, ends = np.concatenate(flat), np.concatenate(own).astype(np.int64), np.cumsum(np.concatenate(lengths))
        by = np.argsort(flat, kind="stable")
        first = run_starts(flat[by])
        sums = np.add.reduceat(own[by], np.flatnonzero(first))
        others = np.empty(len(flat), np.int64)
        others[by] = sums[np.cumsum(first) - 1]
        made = planes(others - own, ends, pack)
        return pa.Table.from_arrays([*pa.concat_tables(rows).combine_chunks().columns, *made], schema=OTHERS)

    def score(table: pa.Table, others: pa.Table) -> pa.Table:
        keys, texts = documents_of(table)
        block = Block(texts, order)
        others = others.sort_by("bucket")
        elsewhere = read_planes(others["others"], others["others_more"], pack).astype(np.int64)
        # Ids travel as text: a null among numbers would make them floats.
        return pa.Table.from_arrays([pa.array(keys, pa.string()), pa.array(block.lengths), pa.array(block.scores(elsewhere, n_words, backoff))], schema=SCORES)

    of = lambda schema: ", ".join(f"{f.name} {NAMES[str(f.type)]}" for f in schema)
    grams = blocks.groupBy("block").applyInArrow(explode, of(GRAMS))
    others = grams.groupBy("bucket").applyInArrow(count, of(OTHERS))
    scored = blocks.groupBy("block").cogroup(others.groupBy("block")).applyInArrow(score, of(SCORES))
    mean = F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words"))
    return scored.select(F.col("key").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words", "score", mean.alias("mean_score"))
