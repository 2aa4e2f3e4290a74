"""Quality rules on repetition inside a document, from a suffix array."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CHARS, append_by_block, fresh, words_of

# Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 3  # words of the windows behind n_repeat_words
MIN_WORDS = 50
LEAST_REPEAT = 8  # words; shorter repeats are ordinary phrases
MOST_COVERED = 0.30  # of the words, in repeats of LEAST_REPEAT or more
MOST_LONGEST = 60  # words of the longest repeat, as it stands at both places

FIELDS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)


def repeat_lengths(words: np.ndarray, doc: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each position the length, in words, of the longest substring starting
    there that also starts elsewhere in the same document (0 or 1 if below 2).

    ``words`` and ``doc`` number the words and documents of a block laid end to
    end; ``end`` is the position after each one's document. A suffix array is
    built by prefix doubling: positions are sorted by their first two words,
    then only groups that are still tied are refined by the rank of what stands
    2, 4, 8, ... words on. Ranks are group starts, so settled positions keep
    theirs. The longest common prefix of neighbours is read off the ranks of every
    second level, and a position's longest repeat is the larger of its neighbours'
    values, the height of the LCP intervals that hold it. A level is kept as four
    bytes a word, so a text of n equal words takes about 2 n log2(n) bytes.
    """
    n = len(words)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    at = np.arange(n)
    size = int(words.max()) + 2
    following = np.zeros(n, np.int64)
    following[:-1] = words[1:] + 1
    following[at + 1 >= end] = 0
    key = (doc * size + words) * size + following
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    starts = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
    sizes = np.diff(np.r_[starts, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, sizes)
    tied = np.repeat(sizes > 1, sizes)
    active = order[tied]  # in order of rank
    slots = np.flatnonzero(tied)  # their places in ``order``
    repeated = active
    levels, h = [(2, rank.astype(np.int32))], 2
    while len(active):
        on = active + h
        inside = on < end[active]
        second = np.where(inside, rank[np.minimum(on, n - 1)] + 1, 0)
        first = rank[active]
        by = np.lexsort((second, first))
        active, first, second = active[by], first[by], second[by]
        order[slots] = active
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        group = np.flatnonzero(new)
        sizes = np.diff(np.r_[group, len(active)])
        rank[active] = np.repeat(slots[group], sizes)
        h *= 2
        keep = np.repeat(sizes > 1, sizes)
        active, slots = active[keep], slots[keep]
        if len(active) and h == 4 * levels[-1][0]:
            levels.append((h, rank.astype(np.int32)))
    # Neighbours in the suffix array that share two words at least.
    level2 = levels[0][1]
    place = np.empty(n, np.int64)
    place[order] = at
    where = np.sort(place[repeated])
    x = order[where[:-1]]
    y = order[where[1:]]
    near = (where[1:] == where[:-1] + 1) & (level2[x] == level2[y])
    x, y = x[near], y[near]
    same = np.zeros(len(x), np.int64)
    for step, ranks in reversed(levels):
        for _ in range(3):
            i, j = x + same, y + same
            fits = (i + step <= end[x]) & (j + step <= end[y])
            fits &= ranks[np.minimum(i, n - 1)] == ranks[np.minimum(j, n - 1)]
            if not fits.any():
                break
            same += step * fits
    i, j = x + same, y + same
    same += (i < end[x]) & (j < end[y]) & (words[np.minimum(i, n - 1)] == words[np.minimum(j, n - 1)])
    np.maximum.at(out, x, same)
    np.maximum.at(out, y, same)
    return out


def covered(lengths: np.ndarray, least: int, bounds: np.ndarray) -> np.ndarray:
    """Words of each document in the union of the spans ``[i, i + lengths[i])``
    of ``least`` words or more; ``bounds`` are the documents' ends."""
    n = len(lengths)
    steps = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(lengths >= least)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + lengths[at], -1)
    inside = np.r_[0, np.cumsum(np.cumsum(steps[:-1]) > 0)]
    return np.diff(inside[np.r_[0, bounds]])


def measure(texts: list) -> dict[str, list]:
    """The columns of FIELDS for a block of texts."""
    number: dict[bytes, int] = {}
    ids, counts = [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        ids.extend([number.setdefault(w, len(number)) for w in words])
    counts = np.array(counts, np.int64)
    bounds = np.cumsum(counts)
    words = np.array(ids, np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    lengths = repeat_lengths(words, doc, np.repeat(bounds, counts))
    in_windows = covered(lengths, WINDOW, bounds)
    in_repeats = covered(lengths, LEAST_REPEAT, bounds)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, np.where(lengths >= 2, lengths, 0))
    failed = (counts < MIN_WORDS) | (100 * in_windows > 50 * counts)
    kept = ~failed & (in_repeats <= MOST_COVERED * counts) & (longest <= MOST_LONGEST)
    return {
        "n_words": counts,
        "word_chars": [0 if t is None else len(t) - sum(map(t.count, SPACE_CHARS)) for t in texts],
        "n_symbols": [0 if t is None else sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": [duplicate_lines(t) for t in texts],
        "n_repeat_words": in_windows,
        "covered_words": in_repeats,
        "longest_repeat": longest,
        "base_failed": failed,
        "kept": kept,
    }


def duplicate_lines(text: str | None) -> int:
    """Lines that hold a word and equal an earlier line."""
    if text is None or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACE_CHARS)]
    return len(lines) - len(set(lines))


def quality(docs: DataFrame) -> DataFrame:
    """Append FIELDS to every row of ``docs(text, ...)``, without a shuffle.

    ``covered_words`` and ``longest_repeat`` come from the suffix array of the
    document's words; a document is kept if it passes the base rules, at most
    MOST_COVERED of its words lie in repeats of LEAST_REPEAT or more words, and
    no repeat exceeds MOST_LONGEST words. Defined results: null, empty and blank
    texts have no words and fail; rows do not affect each other; input columns
    that bear a name of FIELDS are replaced; an empty table gives no rows.
    """
    return append_by_block(docs, "text", measure, FIELDS, block_chars=2_000_000)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with the columns of ``docs``. Rows
    with a null, empty or blank text go; of repeated rows all stay or all go; a null
    doc_id does not matter; an empty table gives no rows."""
    name = fresh(docs, "kept")
    verdict = T.StructType([T.StructField(name, T.BooleanType())])
    judged = append_by_block(docs, "text", lambda texts: {name: measure(texts)["kept"]}, verdict, block_chars=2_000_000)
    return judged.where(F.col(name)).drop(name)
