"""Rows that every operator must bear: nulls, blanks, ties, copies, a very long
text, other scripts, and columns named like an operator's own."""

import random

WORDS = "the of and to in a is that for it with as was on be at by an this from or had not are but we".split()


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", "er"]) for _ in range(n)]
    return " ".join(w + (".\n" if i % 13 == 12 else "") for i, w in enumerate(words))


def texts(seed: int = 7) -> list:
    rng = random.Random(seed)
    some = [prose(rng, n) for n in (60, 80, 120, 300, 90, 75)]
    return some + [
        None, "", " \n\t ", "word", "two words", some[0], some[0], some[1].upper(), some[2] + " more", prose(rng, 30_000),
        "日本語 テキスト 😀 é ü", "a a a a a a a a a a a a", "x" * 50_000, "\n\n\n", "same line\nsame line\nother\nsame line",
    ]


CLASHES = ("fp", "node", "size", "base", "spans", "kept", "shard", "pos", "key", "block", "n_words", "target", "_kept", "rank", "whole")


def documents(spark, rows=None):
    """``doc_id, text, lang, source, n_chars`` and clashing columns. One id is
    null, one row is there twice, sources tie and one is null."""
    if rows is None:
        rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts())]
        rows += [(None, "no id here", None, None, None), rows[3]]
    clash = ", ".join(f"`{c}` string" for c in CLASHES)
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {clash}"
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], schema)
