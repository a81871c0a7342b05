"""Byte-level BPE of a whole corpus, exact and in linear time.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over text can match tokens over bytes. A
piece of text is encoded from its longest matches: a token may follow another only if the two, merged on their own,
would stay two tokens (the compatibility of neighbours, which is memoised); where that fails a shorter match is taken,
and where none is left the token before is taken back. A position once found dead is never entered again, so the work
is linear in the piece. The result equals that of applying the merges in rank order.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-tokenizer's pattern of the public byte-level tokenizers, and what it says of ASCII text.
#: White space is Unicode's property: the control characters 28 to 31, that Python adds, are none.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Pieces whose ids a worker remembers; beyond that the memory is emptied and filled anew, results stay the same.
MEMO = 400_000
#: Rows whose ids are held in memory before they are handed on.
ROWS = 512
#: Longer pieces are not remembered.
MEMO_LENGTH = 64


def _byte_of_char() -> dict[str, int]:
    """The tokenizer files' printable stand-ins of bytes: printable bytes stand for themselves, the rest follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encoder of one tokenizer file (the ``tokenizers`` JSON of a byte-level BPE)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_of_char()
        as_latin = lambda s: "".join(chr(byte[c]) for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = {as_latin(k): v for k, v in model["vocab"].items() if all(c in byte for c in k)}
        #: Internal numbers are in merge order: 256 bytes, then one token per merge.
        self.text = [chr(b) for b in range(256)]
        number = {t: i for i, t in enumerate(self.text)}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            left, right = number[as_latin(a)], number[as_latin(b)]
            t = self.text[left] + self.text[right]
            if t not in number:
                number[t] = len(self.text)
                self.text.append(t)
                self.halves.append((left, right))
            self.joined.setdefault((left, right), number[t])
        self.ids = [vocab[t] for t in self.text]
        self.length = [len(t) for t in self.text]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.text):
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.number = number
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.pieces, self.ascii_pieces = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` stay as they are side by side: no merge over their border comes before the merges within them."""
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        limit = sys.maxsize
        while True:
            over = self.joined.get((a, b))
            if over is not None and over < limit:
                return False
            # Undo the later of the two merges at the border and look whether a merge over it would have come first.
            if a > b:
                limit = a
                a = self.halves[a][1]
                if a == limit:
                    limit = b + 1
                    b = self.halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = self.halves[b][0]
                if b + 1 == limit:
                    limit = a
                    a = self.halves[a][1]
                    if a == limit:
                        return True

    def _longest(self, s: str, at: int) -> int:
        """The longest token that begins at ``at``."""
        for _, t in self.automaton.iter_long(s, at):
            return t
        raise AssertionError("every byte is a token")

    def _next_shorter(self, t: int) -> int:
        """The longest token that is a proper prefix of ``t``; -1 for single bytes."""
        known = self.shorter.get(t)
        if known is None:
            s = self.text[t]
            known = self.shorter[t] = next((self.number[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.number), -1)
        return known

    def encode_bytes(self, s: str) -> tuple[int, ...]:
        """Ids of one piece, given as Latin-1 text of its bytes."""
        whole = self.number.get(s)
        if whole is not None and self._is_own(whole):
            return (self.ids[whole],)
        out: list[int] = []
        dead = bytearray(len(s) + 1)
        at, t = 0, self._longest(s, 0)
        while True:
            end = at + self.length[t]
            if not dead[end] and (not out or self.compatible(out[-1], t)):
                out.append(t)
                at = end
                if at == len(s):
                    return tuple(self.ids[x] for x in out)
                t = self._longest(s, at)
                continue
            t = self._next_shorter(t)
            if t < 0:
                dead[at] = 1
                t = out.pop()
                at -= self.length[t]

    def _is_own(self, t: int) -> bool:
        """Whether a token's text encodes to the token itself: its halves stay apart until they are merged last."""
        a, b = self.halves[t]
        return t < 256 or (self.joined.get((a, b)) == t and self._own(t))

    @lru_cache(maxsize=None)  # noqa: B019
    def _own(self, t: int) -> bool:
        a, b = self.halves[t]
        if a == t:
            return True
        # The merge must be the first over this border, and each half must be its own encoding.
        return self._own(a) and self._own(b) and self._apart_until(a, b, t)

    def _apart_until(self, a: int, b: int, t: int) -> bool:
        known = self.joined.pop((a, b))
        try:
            return self._compatible(a, b)
        finally:
            self.joined[(a, b)] = known

    def encode(self, text: str) -> list[int]:
        """Ids of a text; text that looks like a special token is ordinary text."""
        memo = self.memo
        pieces = self.ascii_pieces(text) if text.isascii() else self.pieces(text)
        out: list[int] = []
        for piece in pieces:
            ids = memo.get(piece)
            if ids is None:
                ids = self.encode_bytes(piece.encode("utf-8", "surrogatepass").decode("latin-1"))
                if len(piece) <= MEMO_LENGTH:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder, built once per process."""
    return Encoder(path)


def encode_column(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids array<int>): every row's text encoded without special tokens, one row each, repeats included.

    Null and empty texts have an empty list. Whole texts are encoded, whatever their length. The work is a single
    pass over Arrow batches without a shuffle; each worker keeps one automaton and a bounded memory of pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        # A few rows at a time, so that long texts and their ids are not all held at once.
        for b in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
            flat: list[int] = []
            ends = [0]
            for t in b.column(1).to_pylist():
                if t:
                    flat += enc.encode(t)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.asarray(ends, dtype=np.int32)), pa.array(np.asarray(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["key", "ids"])

    kind = dict(df.select(key).dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
