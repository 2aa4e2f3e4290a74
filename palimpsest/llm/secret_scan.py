"""Secret scan with multipart credential linking. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE_KINDS = ("assign", "access", "hex")

# Parts of a credential that say little alone. A secret part is a run of 32 or
# more characters of base64 that is no word; an identifier part is an assigned
# user, client or account name; an endpoint is an address that takes both.
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[A-Z0-9+/_=-]*+[a-z])(?=[a-z0-9+/_=-]*+[A-Z])[A-Za-z0-9+/_=-]{32,}+"
WEAK_ID = r"""(?i)(?<![a-z0-9_])(?:user(?:name)?|login|(?:access|client|account)[_-]?(?:key[_-]?)?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}+"""
ENDPOINT = r"(?i)(?:https?|jdbc:[a-z0-9]+|mongodb|postgres(?:ql)?|mysql|redis|amqps?|ftps?|sftp|s3)://[A-Za-z0-9._~%:@/?#&=+-]{4,}+"
WEAK_KINDS = ("weak_secret", "weak_id", "endpoint")
KINDS = BASE_KINDS + WEAK_KINDS
SCOPE = 200  # code points between the parts of one credential
STRETCH = 256  # elements that one step of a scan goes over
PIECE = 4096  # code points of the pieces into which a text with secrets is cut

SPAN = "struct<start:bigint,rank:int,end:bigint>"


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def scanned(values: Column, add) -> Column:
    """For each of the longs ``values``, none negative, what ``add`` makes of all
    before it, 0 for the first. Stretches are folded by themselves and then moved
    by what stands before them, so that no long array is copied at each step."""

    def fold(stretch: Column, value) -> Column:
        start = F.expr("struct(0L as at, cast(array() as array<bigint>) as before)")
        return F.aggregate(stretch, start, lambda s, x: F.struct(add(s["at"], value(x)).alias("at"), F.concat(s["before"], F.array(s["at"])).alias("before")))

    def parts(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(STRETCH))
        inner = F.transform(starts, lambda i: fold(F.slice(v, i, F.lit(STRETCH)), lambda x: x))
        shift = lambda p: F.zip_with(p, fold(p, lambda x: x["at"])["before"], lambda x, by: F.transform(x["before"], lambda y: add(by, y)))
        return F.flatten(bound(inner, shift))

    return bound(values, parts)


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as an array of
    ``(start, end, value)`` in code points: the gaps between matches come from
    ``split`` and the matches from ``regexp_extract_all``, and both are laid end
    to end."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda p: p["hit"].isNotNull())

    def placed(pairs: Column) -> Column:
        before = scanned(F.transform(pairs, lambda p: (F.length(p["gap"]) + F.length(p["hit"])).cast("long")), lambda x, y: x + y)

        def span(pair: Column, at: Column) -> Column:
            start = at + F.length(pair["gap"])
            return F.struct(start.alias("start"), (start + F.length(pair["hit"])).alias("end"), pair["hit"].alias("value"))

        return F.zip_with(pairs, before, span)

    return bound(pairs, placed)


def kind_spans(text: Column, kind: str) -> Column:
    """Spans of one kind, an array of ``(start, rank, end)``; an empty array
    where the text has none, found by a test that costs one pass."""
    rank = F.lit(KINDS.index(kind)).alias("rank")
    pattern, keep = {
        "assign": (ASSIGN, lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6),
        "access": (ACCESS, lambda s: s["end"] - s["start"] >= 20),
        # Runs are maximal, so a length in the pattern drops the failing ones early.
        "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}+", None),
        "weak_secret": (WEAK_SECRET, None),
        "weak_id": (WEAK_ID, None),
        "endpoint": (ENDPOINT, None),
    }[kind]
    spans = found(text, pattern)
    spans = F.filter(spans, keep) if keep else spans
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank, s["end"].alias("end")))
    return F.when(F.rlike(text, F.lit(pattern)), spans.cast(f"array<{SPAN}>")).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def extremes(points: Column, last: Column, scope: int) -> Column:
    """``(least, most)`` of the longs ``points`` in each stretch of ``scope``
    numbers from 0 to the stretch of ``last``, and beyond it one that is empty;
    nulls where a stretch has none."""
    stretches = F.sequence(F.lit(0).cast("long"), F.floor(last / scope) + 1)

    def firsts(sign: int) -> Column:
        # Sorted with an end mark for each stretch, the first of a stretch is its extreme.
        entries = F.concat(
            F.transform(points, lambda x: F.struct(F.floor(x / scope).alias("in"), (sign * x).alias("at"))),
            F.transform(stretches, lambda k: F.struct(k.alias("in"), F.lit((1 << 63) - 1).alias("at"))),
        )
        first = lambda e: F.filter(e, lambda x, i: (i == 0) | (F.get(e, i - 1)["in"] < x["in"]))
        value = lambda x: F.when(x["at"] != (1 << 63) - 1, sign * x["at"])
        return F.transform(bound(F.sort_array(entries), first), value)

    return F.arrays_zip(firsts(1).alias("least"), firsts(-1).alias("most"))


def linked(parts: Column, scope: int = SCOPE) -> Column:
    """The weak spans among ``parts`` that have a complement within ``scope``.

    An interval join inside the document, by position. A complement after a part
    starts in the stretch of ``scope`` numbers of the part's end or in the next:
    there is one exactly if the highest start in the former is not before that
    end, or the lowest in the latter is within ``scope`` of it; likewise ends for
    one before a part. So two looks into a table of stretches decide, whatever the
    length or number of parts. Complements: a secret part needs an identifier
    (weak, or an access key), an identifier needs a secret (weak, or any base kind
    but access), and an endpoint needs both.
    """
    rank = {k: i for i, k in enumerate(KINDS)}
    ids = [rank["weak_id"], rank["access"]]
    secrets = [rank["weak_secret"], rank["assign"], rank["hex"]]

    def tables(parts: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(parts, lambda p: p["end"])), F.lit(0).cast("long"))
        of = lambda kinds, side: extremes(F.transform(F.filter(parts, lambda p: p["rank"].isin(kinds)), lambda p: p[side]), last, scope)
        made = {f"{name}_{side}": of(kinds, side) for name, kinds in (("id", ids), ("secret", secrets)) for side in ("start", "end")}
        return F.struct(parts.alias("parts"), *[table.alias(name) for name, table in made.items()])

    def near(t: Column, p: Column, name: str) -> Column:
        stretch = lambda x: F.floor(x / scope).cast("int")
        look = lambda side, k: F.get(t[f"{name}_{side}"], k)
        after, before = stretch(p["end"]), stretch(p["start"])
        return (
            F.coalesce(look("start", after)["most"] >= p["end"], F.lit(False)) | F.coalesce(look("start", after + 1)["least"] <= p["end"] + scope, F.lit(False))
            | F.coalesce(look("end", before)["least"] <= p["start"], F.lit(False)) | F.coalesce((before > 0) & (look("end", before - 1)["most"] >= p["start"] - scope), F.lit(False))
        )

    def complete(t: Column, p: Column) -> Column:
        return (
            F.when(p["rank"] == rank["weak_secret"], near(t, p, "id"))
            .when(p["rank"] == rank["weak_id"], near(t, p, "secret"))
            .when(p["rank"] == rank["endpoint"], near(t, p, "id") & near(t, p, "secret"))
            .otherwise(F.lit(True))
        )

    return bound(bound(parts, tables), lambda t: F.filter(t["parts"], lambda p: complete(t, p)))


def secret_spans(docs: DataFrame, base: str = "base", spans: str = "spans") -> DataFrame:
    """Append ``base`` and ``spans`` to ``docs(text, ...)``: the base spans, and
    all spans, as arrays of ``(start, rank, end)`` in order of start and then of
    kind, ``rank`` pointing into KINDS, in code points, ends exclusive.

    One pass over the text, no shuffle: the scope of a credential is a stretch
    of one document, so the interval join stays inside the row. Columns with the
    new columns' names are replaced. Defined results: null and empty texts have no spans;
    rows are independent of each other, so repeated rows and null ids each give
    their own spans; an empty table gives no rows.
    """
    text, weak = F.coalesce(F.col("text"), F.lit("")), fresh(docs, "weak")
    strong = F.concat(*[kind_spans(text, k) for k in BASE_KINDS])
    docs = docs.drop(base, spans).withColumn(base, F.sort_array(strong))
    docs = docs.withColumn(weak, F.concat(*[kind_spans(text, k) for k in WEAK_KINDS]))
    every = F.when(F.size(weak) == 0, F.col(base)).otherwise(linked(F.sort_array(F.concat(base, weak))))
    return docs.withColumn(spans, every).drop(weak)


def span_text(spans: Column, kinds: tuple = KINDS) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    name = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["rank"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret in ``text`` replaced by ``mask``.

    Identifiers and endpoints stay: alone they open nothing. Overlapping spans
    become one mask. Rows without a secret keep their text as it is, null too.
    Spans that meet are made one by a running maximum of their ends, and the text
    between them is taken from equal pieces of it, so that the work grows with the
    text and with the number of spans, and not with their product.
    """
    columns = docs.columns
    base, spans = fresh(docs, "base"), fresh(docs, "spans")
    found_in = secret_spans(docs, base, spans)
    text = F.col("text")

    def hidden(spans: Column) -> Column:
        reach = scanned(F.transform(spans, lambda s: s["end"]), F.greatest)
        both = F.arrays_zip(spans.alias("s"), reach.alias("reach"))
        opening = lambda both: F.filter(both, lambda b, i: (i == 0) | (b["s"]["start"] >= b["reach"]))
        # Before each mask stands the text from the end of the last one.
        gaps = F.transform(bound(both, opening), lambda b: F.struct(b["reach"].alias("from"), b["s"]["start"].alias("to")))
        rest = F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("from"), F.length(text).cast("long").alias("to"))
        pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
        return F.array_join(bound(pieces, lambda p: F.transform(F.concat(gaps, F.array(rest)), lambda g: between(p, g))), mask)

    hide = F.filter(spans, lambda s: s["rank"] <= KINDS.index("weak_secret"))
    new = F.when(F.size(hide) == 0, text).otherwise(bound(hide, hidden))
    return found_in.withColumn("text", new).select(*columns)


def between(pieces: Column, gap: Column) -> Column:
    """The text from one place to another, out of equal ``pieces`` of it."""
    first, last = F.floor(gap["from"] / PIECE).cast("int"), F.floor(gap["to"] / PIECE).cast("int")
    joined = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.substring(joined, (gap["from"] - first * PIECE + 1).cast("int"), (gap["to"] - gap["from"]).cast("int"))
