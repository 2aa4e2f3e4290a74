"""Byte-level BPE by a lazily determinised transducer, and streaming decode."""

from __future__ import annotations

import base64
import codecs
import hashlib
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_by_block

FIELDS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
MOST_STATES = 700_000
MOST_HEADS = 100_000
MOST_PAIRS = 1_000_000
MOST_KEPT = 300_000  # in each of two generations
SMALL_TABLES = 0.1  # of these bounds, where other work shares the memory
EMIT_AFTER = 64  # bytes; shorter pre-tokens are emitted at their end
HEAD = 6  # bytes of a pre-token whose walk is kept
DECODE_STEP = 65_536
TOKEN_BITS = 24
TOKEN_MASK = (1 << TOKEN_BITS) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 token and rank lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


class Transducer:
    """Encodes one pre-token, byte by byte, left to right.

    Every prefix of the input has one BPE encoding, and a sequence of tokens is
    an encoding exactly if each token pair in it is the encoding of its own
    bytes. So the last token of a prefix is the one token that ends there and is
    compatible with the last token of the prefix before it.

    A later token can only start at a *live* position, one from which the bytes
    read so far begin some token; the lookahead is bounded by the longest token.
    A state is the live positions, each with its place in the trie of tokens and
    the last token before it; all else about the past is settled. A transition
    gives the new state and the last token of the longer prefix; where a single
    live position is left, what came before is emitted. States and transitions
    are made when first needed and kept in tables that are emptied when full,
    also inside a long pre-token, which changes no result.
    """

    def __init__(self, ranks: dict[bytes, int], share: float = 1.0):
        self.ranks = ranks
        self.most_states, self.most_heads, self.most_pairs = (int(n * share) for n in (MOST_STATES, MOST_HEADS, MOST_PAIRS))
        self.tokens = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                below = self.children[node].get(byte)
                if below is None:
                    below = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = below
            self.token_at[node] = rank
        self.edges: dict[int, tuple[list, list]] = {}
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        # A live position is one number: its trie node and its last token plus 1.
        start = (0,)
        self.states: dict[tuple, int] = {start: 0}
        self.lives: list[tuple] = [start]
        # State and byte in one number, to the new state and the token in one.
        self.moves: dict[int, int] = {}
        self.heads: dict[bytes, tuple[int, list[int]]] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """Encoding of a few bytes by the definition: merge the pair of least
        rank, the leftmost first, until none is a token."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            i = self.next_merge(parts)
            if i is None:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def next_merge(self, parts: list[bytes]) -> int | None:
        ranked = [self.ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
        least = min(ranked)
        return None if least == 1 << 40 else ranked.index(least)

    def edge_parts(self, token: int) -> tuple[list, list]:
        """The parts that stand at the left and at the right edge while the bytes
        of ``token`` are merged, each with the ranks at which it is formed and
        merged away. Empty lists mark a token that its bytes do not merge into."""
        known = self.edges.get(token)
        if known is None:
            whole = self.tokens[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            edges: tuple[list, list] = ([], [])
            since = [-1, -1]
            while True:
                i = self.next_merge(parts) if len(parts) > 1 else None
                if i is None:
                    break
                rank = self.ranks[parts[i] + parts[i + 1]]
                for side, here in ((0, i == 0), (1, i == len(parts) - 2)):
                    if here:
                        edges[side].append((parts[-side], since[side], rank))
                        since[side] = rank
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if parts == [whole]:
                for side in (0, 1):
                    edges[side].append((whole, since[side], 1 << 41))
            else:
                edges = ([], [])
            known = self.edges[token] = edges
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a, b`` is the encoding of its bytes (``a`` -1: none before).
        It is not if, at some rank, the parts at the seam both stand and their
        union has that rank; merges happen in order of rank, of equal the
        leftmost first."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            lefts = self.edge_parts(b)[0]
            known = bool(lefts)
            if a >= 0 and known:
                # At each rank one part stands on either side of the seam, so the
                # pairs that stand together are met by going along both lists.
                rights, get, i, j = self.edge_parts(a)[1], self.ranks.get, 0, 0
                while i < len(rights) and j < len(lefts):
                    x, x_from, x_to = rights[i]
                    y, y_from, y_to = lefts[j]
                    rank = get(x + y)
                    if rank is not None and x_from < rank < x_to and y_from < rank <= y_to:
                        known = False
                        break
                    i += x_to <= y_to
                    j += y_to <= x_to
            self.pairs[a << 32 | b] = known
        return known

    def make(self, state: int, byte: int) -> int:
        """The transition of ``state`` on ``byte``: the new state, and the last
        token of the prefix that ends with it."""
        lives, last = [], -1
        for live in self.lives[state]:  # the longest first
            below = self.children[live >> TOKEN_BITS].get(byte)
            if below is not None:
                token = self.token_at[below]
                if last < 0 <= token and self.compatible((live & TOKEN_MASK) - 1, token):
                    last = token
                if self.children[below]:
                    lives.append(below << TOKEN_BITS | live & TOKEN_MASK)
        lives.append(last + 1)
        key = tuple(lives)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.lives)
            self.lives.append(key)
        move = self.moves[state << 8 | byte] = to << TOKEN_BITS | last
        return move

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. A pre-token that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.lives) > self.most_states:
            self.reset()
        # The start of a word is often known: begin with the state behind it.
        head = piece[:HEAD]
        known = self.heads.get(head)
        if known is None:
            if len(self.heads) >= self.most_heads:
                self.heads.clear()
            known = self.heads[head] = self.walk(0, head)
        if len(piece) <= HEAD:
            return self.emit(known[1])
        state, last = known
        if len(piece) <= EMIT_AFTER:
            return self.emit(last + self.walk(state, piece[HEAD:])[1])
        out: list[int] = []
        for i in range(HEAD, len(piece), EMIT_AFTER):
            state, more = self.walk(state, piece[i : i + EMIT_AFTER])
            last += more
            if len(self.lives[state]) == 1:
                out += self.emit(last)
                last = []
            if len(self.lives) > self.most_states:
                # The live positions are all that a state stands for.
                live = self.lives[state]
                self.reset()
                if live not in self.states:
                    self.states[live] = len(self.lives)
                    self.lives.append(live)
                state = self.states[live]
        return out + self.emit(last)

    def walk(self, state: int, piece: bytes) -> tuple[int, list[int]]:
        """The state after ``piece``, and the last token of each prefix."""
        get, last = self.moves.get, []
        for byte in piece:
            move = get(state << 8 | byte)
            if move is None:
                move = self.make(state, byte)
            state = move >> TOKEN_BITS
            last.append(move & TOKEN_MASK)
        return state, last

    def emit(self, last: list[int]) -> list[int]:
        """The tokens of settled bytes: back from the end, token by token."""
        at, found, length = len(last), [], self.length
        while at:
            token = last[at - 1]
            found.append(token)
            at -= length[token]
        found.reverse()
        return found


class Memory(dict):
    """Results of ``make`` for stretches of text already met. Of two generations
    the older is dropped when the newer is full."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, text: str) -> bytes:
        made = self.older.get(text)
        if made is None:
            made = self.make(text)
        if len(text) < 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[text] = made
        return made


class Codec:
    """Text to ids, as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, share: float = 1.0):
        self.machine, most = Transducer(ranks, share), int(MOST_KEPT * share)
        self.find = regex.compile(pattern).findall
        self.cut_at_spaces = pattern == public_tokenizers.PATTERN
        self.odd_space = regex.compile(r"\s\x20|\x20\s|^\x20|\x20\Z").search
        self.pieces = Memory(lambda piece: little(array("I", self.machine.encode(piece.encode()))), most)
        self.spaced = Memory(self.encode_spaced, most)
        self.plain = Memory(self.encode_exact, most)

    def forget(self) -> None:
        """Empty all tables that grow with the text."""
        self.machine.reset()
        self.machine.pairs.clear()
        for memory in (self.pieces, self.spaced, self.plain):
            memory.older = {}
            memory.clear()

    def encode_exact(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode_spaced(self, chunk: str) -> bytes:
        """A space and a stretch without one; ASCII letters alone are one match."""
        if chunk.isascii() and chunk.isalpha():
            return little(array("I", self.machine.encode(b" " + chunk.encode())))
        return self.encode_exact(" " + chunk)

    def encode(self, text: str) -> bytes:
        """A single space between two non-spaces always starts a match of the usual
        pattern, so such a text is cut there and each stretch looked up; a text
        with other runs of space, or under another pattern, is matched as a whole."""
        if not text:
            return b""
        if not self.cut_at_spaces or self.odd_space(text):
            return self.encode_exact(text)
        first, *others = text.split(" ")
        return self.plain[first] + b"".join(map(self.spaced.__getitem__, others))

    def decode(self, ids: bytes) -> tuple[str, bytes]:
        """Text of ``ids`` and its SHA-256. Tokens may cut characters: their
        bytes go, step by step, through an incremental UTF-8 state machine that
        holds back an unfinished character."""
        machine = codecs.getincrementaldecoder("utf-8")("strict")
        numbers, digest, out = array("I", ids), hashlib.sha256(), []
        if little(numbers) != ids:
            numbers.byteswap()
        tokens = self.machine.tokens
        for i in range(0, len(numbers), DECODE_STEP):
            piece = b"".join([tokens[n] for n in numbers[i : i + DECODE_STEP]])
            digest.update(piece)
            out.append(machine.decode(piece))
        out.append(machine.decode(b"", True))
        return "".join(out), digest.digest()


def little(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


@lru_cache(4)
def codec(path: str, pattern: str, share: float) -> Codec:
    """One codec for each worker and vocabulary."""
    return Codec(read_ranks(path), pattern, share)


def tokens(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, small: bool = False) -> DataFrame:
    """Append FIELDS, and ``token_ids`` (binary) if ``with_ids``, to every row of
    ``docs(text, ...)``: each match of ``pattern`` is encoded separately with the
    ranks in the file at ``path``, then the ids are decoded again.

    The vocabulary must be at ``path`` on each executor; nothing is shuffled and
    the tables of a worker are bounded. With ``small`` they have SMALL_TABLES of
    their bounds and are emptied after each task, for jobs whose other stages need
    the workers' memory; results are the same, and take longer. Defined results: null and empty texts
    have no tokens, and the digests of nothing; rows do not affect each other;
    input columns with a new column's name are replaced; an empty table gives no
    rows. A text whose decoding differs from it raises ValueError.
    """
    fields = T.StructType(FIELDS.fields + [T.StructField("token_ids", T.BinaryType())] * with_ids)

    share = SMALL_TABLES if small else 1.0

    def run(texts: list) -> dict[str, list]:
        coder = codec(path, pattern, share)
        out: dict[str, list] = {f.name: [] for f in fields}
        for text in texts:
            ids = coder.encode(text or "")
            back, digest = coder.decode(ids)
            if back != (text or ""):
                raise ValueError("decoding does not give the text back")
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(digest.hex())
            if with_ids:
                out["token_ids"].append(ids)
        return out

    return append_by_block(docs, "text", run, fields, at_end=lambda: codec(path, pattern, share).forget() if small else None)
