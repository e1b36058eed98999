"""Byte-level BPE: exact merges in linear time by backtracking over longest matches.

A text is split by the tokenizer's pattern. In each piece, whose bytes are mapped to
Latin-1 characters, an Aho-Corasick automaton finds the longest token at every place. The
encoder takes longest tokens from left to right; a token may follow another only if BPE
itself would keep the two side by side, which is looked up in a memo of adjacent pairs.
Where no token fits, it steps back, and a bit for each place keeps it from trying a place
twice. What comes out is what merging by rank would give.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Step, append_steps
from .token_counts import strict_spaces

#: Entries of a worker's caches: of pieces with their ids, of pieces seen once, and of adjacent pairs.
PIECE_CACHE, SEEN_ONCE, PAIR_CACHE, CACHED_CHARS = 200_000, 300_000, 1_000_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens with their ranks, which are their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BytePairEncoder:
    """Encoder and decoder of one vocabulary of ranks."""

    def __init__(self, path: str):
        import ahocorasick

        ranks = read_ranks(path)
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        size = max(ranks.values()) + 1
        self.length = [0] * size
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.automaton.add_word(token, (len(token) - 1, rank))
        self.automaton.make_automaton()
        self.prefix = [-1] * size
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        #: For each token which tokens may follow it and which may not, as far as it is known.
        self.memo: list[dict[int, bool]] = [{} for _ in range(size)]
        self.noted = 0
        self.pieces: dict[str, bytes] = {}
        self.once: set[int] = set()
        self._undo_merges()

    def _undo_merges(self) -> None:
        """For each token its longest proper prefix that is a token, and the pair it is merged from."""
        ids = self.ids
        for rank in sorted(self.bytes_of):
            token = self.bytes_of[rank].decode("latin-1")
            self.prefix[rank] = next((ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ids), -1)
        for rank in sorted(self.bytes_of):
            token, left = self.bytes_of[rank].decode("latin-1"), self.prefix[rank]
            self.halves[rank] = (rank, rank)
            while left >= 0:
                right = ids.get(token[self.length[left] :], -1)
                if 0 <= right < rank and left < rank and self._adjacent(left, right):
                    self.halves[rank] = (left, right)
                    self.merged[left, right] = rank
                    break
                left = self.prefix[left]

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether BPE keeps two tokens side by side.

        Both are split back, the later merge first; at each state the pair that touches
        the border must not have a merge that comes before the splits undone so far.
        """
        limit = 1 << 62
        a, b = left, right
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.halves[a][1]
                if a == limit:
                    limit, b = b + 1, self.halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.halves[b][0]
                if b + 1 == limit:
                    limit, a = a, self.halves[a][1]
                    if a == limit:
                        return True

    def adjacent(self, left: int, right: int) -> bool:
        """``_adjacent``, noted in the memo of what may follow ``left``."""
        if self.noted >= PAIR_CACHE:
            self.noted = 0
            for after in self.memo:
                after.clear()
        self.noted += 1
        known = self.memo[left][right] = self._adjacent(left, right)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece of Latin-1 characters that stand for its bytes."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        total = len(piece)
        longest = [-1] * total
        for end, (back, rank) in self.automaton.iter(piece):
            longest[end - back] = rank  # matches from one start come in order of their ends
        length, prefix, memo = self.length, self.prefix, self.memo
        token = longest[0]
        at = length[token]
        out, last, closed = [token], token, None
        token = longest[at]
        while True:
            end = at + length[token]
            if closed is not None and closed[end]:
                fits = False
            elif last >= 0:
                fits = memo[last].get(token)
                if fits is None:
                    fits = self.adjacent(last, token)
            else:
                fits = True
            if fits:
                out.append(token)
                if end == total:
                    return out
                last, at = token, end
                token = longest[at]
            elif prefix[token] >= 0:
                token = prefix[token]
            else:
                if closed is None:
                    closed = bytearray(total + 1)
                token = -1
                while token < 0:
                    closed[at] = 1
                    token = out.pop()
                    at -= length[token]
                    token = prefix[token]
                last = out[-1] if out else -1

    def packed(self, pieces: list[str]) -> bytes:
        """Ids of a text, from the pieces that the pattern gives, as native 32-bit integers."""
        cache, once = self.pieces, self.once
        if len(cache) >= PIECE_CACHE:
            cache.clear()
        lacking = set(pieces).difference(cache)
        if not lacking:
            return b"".join(map(cache.__getitem__, pieces))
        if len(once) >= SEEN_ONCE:
            once.clear()
        passing, room = [], PIECE_CACHE - len(cache)
        for piece in lacking:
            cache[piece] = array("i", self.encode_piece(piece.encode("utf-8").decode("latin-1"))).tobytes()
            seen = hash(piece)
            if room > 0 and seen in once and len(piece) <= CACHED_CHARS:
                room -= 1
            else:  # most pieces never come again, so that one is kept from the second time on
                once.add(seen)
                passing.append(piece)
        out = b"".join(map(cache.__getitem__, pieces))
        for piece in passing:
            del cache[piece]
        return out

    def encode(self, pieces: list[str]) -> list[int]:
        """Ids of a text from the pieces that the pattern gives."""
        return array("i", self.packed(pieces)).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def encode_step(path: str, pattern: str, text: str, out: str) -> Step:
    """Each task makes its own encoder (in about half a second) and gives it up at its end, so
    that idle workers hold no memory that other stages need."""

    def make():
        import regex

        split, codec = regex.compile(strict_spaces(pattern)).findall, BytePairEncoder(path)

        def work(texts):
            parts = [codec.packed(split(t)) if t else b"" for t in texts.to_pylist()]
            ends = [0]
            for p in parts:
                ends.append(ends[-1] + len(p) // 4)
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(parts))])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)]

        return work

    return Step([text], make, [T.StructField(out, T.ArrayType(T.IntegerType()))], arrays=True)


def decode_step(path: str, ids: str, out: str) -> Step:
    def make():
        bytes_of = {rank: token for token, rank in read_ranks(path).items()}
        tokens = pa.array([bytes_of.get(i) for i in range(max(bytes_of) + 1)], pa.large_binary())

        def work(lists):
            lists = pa.array([row or [] for row in lists.to_pylist()], pa.list_(pa.int32())) if lists.null_count else lists
            # the bytes of all ids in order; a text's bytes are those between its first id and its last
            told = tokens.take(lists.flatten())
            if told.null_count:
                raise ValueError("an id that the vocabulary lacks")
            starts = pa.array([0, *lists.value_lengths().to_pylist()], pa.int64()).to_numpy().cumsum()
            offsets = np.frombuffer(told.buffers()[1], np.int64)[told.offset : told.offset + len(told) + 1][starts]
            data = told.buffers()[2] or pa.py_buffer(b"")
            return [pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets.copy()), data]).cast(pa.binary())]

        return work

    return Step([ids], make, [T.StructField(out, T.BinaryType())], arrays=True)


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text, without special tokens.

    A null or empty text gives an empty array; a very long one is encoded whole, in time
    that grows with its length; repeated rows are encoded alike, and there are no ties,
    since one sequence of merges is right; an empty table gives an empty one. A column
    named as ``out`` is replaced, other columns stay.
    """
    return append_steps(docs, encode_step(path, pattern, text, out))


def bpe_decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that an array of ids stands for; a null array gives no bytes.

    An id that the vocabulary lacks is an error. A column named as ``out`` is replaced.
    """
    return append_steps(docs, decode_step(path, ids, out))


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", drop: Sequence[str] = ()) -> DataFrame:
    """As ``bpe_decode`` of ``bpe_encode``, in one pass, without the columns named in ``drop``."""
    return append_steps(docs, encode_step(path, pattern, text, ids), decode_step(path, ids, decoded), drop=drop)
