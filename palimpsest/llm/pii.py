"""Personal data by anchor expansion."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_by_block

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("address", "account")
FIELDS = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS] + [T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())]
)

# Characters of an address before the at-sign.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# Schemes whose address names a person, or may carry a name before an at-sign.
PERSON_SCHEMES = ("mailto:", "tel:", "sip:", "sips:", "xmpp:", "skype:")
WEB_SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "imap://", "smtp://")
CUES = (
    "iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "social security", "passport",
    "routing", "sort code", "customer no", "kundennummer", "tax id", "steuer-id", "nif",
)

# Local parsers, each matched at one place only.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HANDLE = re.compile(r"[A-Za-z0-9._%+()-]{3,}(?:@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)?")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+(?::[^\s@/]*)?@[A-Za-z0-9.-]+")
_AFTER_CUE = re.compile(r"(?:[\x20]?(?:number|no|nr|num|n°|id|code))?[\x20]?[.:#=]{1,2}[\x20]?", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])")
_NUMBER = re.compile(r"[A-Z]{0,3}[0-9](?:[\x20-]?[0-9]){5,17}(?![0-9A-Za-z])")


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    """Anchors, in small letters, and what they stand for. Digits anchor numbers and dotted quads,
    as their cue is the character itself."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
        found.add_word("+" + d, ("plus", 2))
    for scheme in PERSON_SCHEMES + WEB_SCHEMES:
        found.add_word(scheme, ("person" if scheme in PERSON_SCHEMES else "web", len(scheme)))
    for cue in CUES:
        found.add_word(cue, ("cue", len(cue)))
    found.make_automaton()
    return found


def small_letters(text: str) -> str:
    """The text with small letters for its ASCII capitals; all others keep their
    place, which str.lower does not grant."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [sum(divmod(2 * d, 10)) for d in values[1::2]]) % 10 == 0


def iban_end(text: str, start: int) -> int | None:
    """End of a valid IBAN at ``start``: the longest prefix that leaves 1 on
    division by 97."""
    m = _IBAN.match(text, start)
    stop = m.end() if m else start
    while stop - start >= 15:
        value = text[start:stop].replace(" ", "")
        if 15 <= len(value) <= 34 and text[stop - 1] != " " and not text[stop : stop + 1].isalnum():
            if int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1:
                return stop
        stop -= 1
    return None


def account(text: str, start: int) -> tuple[int, int] | None:
    """The account that stands after a cue ending at ``start``, if valid."""
    sign = _AFTER_CUE.match(text, start)
    at = sign.end() if sign else start + (text[start : start + 1] == " ")
    stop = iban_end(text, at)
    if stop is None:
        m = _SSN.match(text, at)
        if m and m.group()[:3] not in ("000", "666") and m.group()[0] != "9" and m.group()[4:6] != "00" and m.group()[7:] != "0000":
            stop = m.end()
    # A bare number needs the sign of an assignment, and is no misspelt IBAN.
    if stop is None and sign and not _IBAN.match(text, at):
        m = _NUMBER.match(text, at)
        stop = m.end() if m else None
    return None if stop is None else (at, stop)


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    """``(start, rank, end)`` of all spans of a text in order, ``rank`` pointing
    into KINDS; code points, ends exclusive. Anchors come in order of position,
    and a parser skips those inside what its kind has already consumed."""
    spans: list[tuple[int, int, int]] = []
    if not text:
        return spans
    mail_end = number_end = quad_end = phone_end = account_end = 0
    for last, (kind, length) in automaton().iter(small_letters(text)):
        if kind == "digit":
            if last >= number_end:
                m = _CARD.match(text, last)
                if m:
                    number_end = m.end()
                    if m.end() - last >= 14:
                        digits = m.group().replace(" ", "").replace("-", "")
                        if 14 <= len(digits) <= 19 and luhn(digits):
                            spans.append((last, 2, m.end()))
                else:
                    number_end = last + 1
            if last >= quad_end:
                m = _IP.match(text, last)
                if m:
                    quad_end = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                        spans.append((last, 1, m.end()))
                else:  # a dotted chain too short: no later digit of it can start one
                    quad_end = last + 1
                    while quad_end < len(text) and text[quad_end] in "0123456789":
                        quad_end += 1
        elif kind == "at":
            start = last
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, last + 1) if start < last else None
            if m:
                mail_end = m.end()
                spans.append((start, 0, m.end()))
        elif kind == "plus":
            m = _PHONE.match(text, last - 1) if last - 1 >= phone_end else None
            if m:
                phone_end = m.end()
                if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    spans.append((last - 1, 3, m.end()))
        elif kind == "cue":
            got = account(text, last + 1) if last + 1 >= account_end else None
            if got:
                account_end = got[1]
                spans.append((got[0], 5, got[1]))
        else:
            start = last + 1 - length
            m = (_HANDLE if kind == "person" else _USERINFO).match(text, last + 1)
            if m and not (start and text[start - 1].isalnum()):
                end = m.end()
                while text[end - 1] in ".,-(":
                    end -= 1
                if end > last + 3:
                    spans.append((start, 4, end))
    return sorted(spans)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[rank]}:{start}:{end}" for start, rank, end in spans)


def describe(texts: list) -> dict[str, list]:
    found = [spans_of(t) for t in texts]
    columns: dict[str, list] = {f"n_{k}": [sum(s[1] == rank for s in spans) for spans in found] for rank, k in enumerate(BASE_KINDS)}
    columns["base"] = [spell([s for s in spans if s[1] < len(BASE_KINDS)]) for spans in found]
    columns["spans"] = [spell(spans) for spans in found]
    return columns


def personal_data(docs: DataFrame) -> DataFrame:
    """Append FIELDS to every row of ``docs(text, ...)``: counts of the base
    kinds, and spans as ``kind:start:end`` in order, comma-joined.

    One Aho-Corasick pass finds the anchors of all kinds; each anchor is
    expanded by a local parser that validates (dotted parts, Luhn, length, IBAN
    modulus, SSN areas). Nothing is shuffled. Defined results: null and empty
    texts have no spans; rows do not affect each other; input columns with a
    name of FIELDS are replaced; an empty table gives no rows.
    """
    return append_by_block(docs, "text", describe, FIELDS)


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind; of overlapping spans the
    first names it."""
    out, at = [], 0
    for start, rank, end in spans_of(text):
        if start >= at:
            out += [text[at:start], f"[{KINDS[rank].upper()}]"]
        at = max(at, end)
    return text if not at else "".join(out) + text[at:]


def base_digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
