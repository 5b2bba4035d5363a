"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Words of equal length advance together, one character at a time: hashes of all substrings
that end there probe the sorted hashes of the pieces, and the best predecessor is stored as
a backpointer. For a unigram model the best is the greatest sum of scores. A byte-pair model
has no such sum: its result is the one path on which every two neighbouring pieces are what
the merges make of their characters, so a candidate counts only if it goes with the piece
before it, and the longest one that does is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.llm.tables import chunks

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Words that fill a worker's memory; those not met since it last filled are then forgotten.
REMEMBERED = 1 << 17
#: Bits of a place in the table of pairs of pieces, and in that of hashes of pieces and of their ends.
PAIR_BITS = 21
MARK_BITS = 22
_MARK_SHIFT = np.uint64(64 - MARK_BITS)
_WHOLE, _SUFFIX = np.uint8(1), np.uint8(2)
#: Characters of the texts whose new words are looked up at once, and of the words that advance together.
CHUNK_CHARS = 1 << 21
TOGETHER = 1 << 18
UNKNOWN = -1
_NONE = -2


class PieceModel:
    """Pieces of a byte-pair model without text normalisation, with a leading space and byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(self.size)]
        usual = [i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.ids = {self.text[i]: i for i in usual}
        self.score = {self.text[i]: model.get_score(i) for i in usual}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(self.size) if model.is_byte(i)}
        byte_of = {i: b for b, i in self.byte.items()}
        self.raw = [bytes([byte_of[i]]) if i in byte_of else p.encode("utf-8") for i, p in enumerate(self.text)]
        self.longest = max(map(len, self.ids))
        keys = np.array([self._hash(p) for p in self.ids], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(list(self.ids.values()))[order]
        self.marks = np.zeros(1 << MARK_BITS, np.uint8)
        self.marks[(self.keys >> _MARK_SHIFT).astype(np.int64)] |= _WHOLE
        ends = {p[i:] for p in self.ids for i in range(1, len(p))}
        self.marks[(np.array([self._hash(e) for e in ends], np.uint64) >> _MARK_SHIFT).astype(np.int64)] |= _SUFFIX
        self.pair = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_fits = np.zeros(1 << PAIR_BITS, bool)
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_FACTOR) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _merged(self, symbols: list[str]) -> list[str]:
        """The pieces that merges make of a short run of characters: best score first, leftmost of equals."""
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.score.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _goes(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow the one before it (UNKNOWN: a character that is no piece).

        Answers are kept in a table of fixed size, a pair's place in which another pair may take over.
        """
        code = (before + 2).astype(np.int64) * (self.size + 2) + piece
        at = ((code.astype(np.uint64) * _FACTOR) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        new = np.flatnonzero(self.pair[at] != code)
        out = self.pair_fits[at]
        if len(new):
            pairs, first, back = np.unique(code[new], return_index=True, return_inverse=True)
            fits = np.array([self._fits(c) for c in pairs.tolist()])
            self.pair[at[new][first]], self.pair_fits[at[new][first]] = pairs, fits
            out[new] = fits[back]
        return out

    def _fits(self, code: int) -> bool:
        a, b = code // (self.size + 2) - 2, code % (self.size + 2)
        left = [self.text[a]] if a >= 0 else []
        return self._merged([*"".join(left), *self.text[b]]) == [*left, self.text[b]]

    def _found(self, codes: np.ndarray, i: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and hashes of the substrings ending before character ``i`` that may be pieces, by length from 1.

        A row leaves as soon as no piece ends with its substring.
        """
        out = []
        rows, sums = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        power = np.uint64(1)
        for size in range(1, min(i, self.longest) + 1):
            sums = sums + codes[rows, i - size] * power
            power = power * _FACTOR
            seen = self.marks[(sums >> _MARK_SHIFT).astype(np.int64)]
            whole = np.flatnonzero(seen & _WHOLE)
            out.append((rows[whole], sums[whole]))
            going = np.flatnonzero(seen & _SUFFIX)
            if not len(going):
                break
            rows, sums = rows[going], sums[going]
        return out

    def _viterbi(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length as 32-bit integers; a character that is no piece gives its bytes."""
        n, length = len(words), len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length)
        with np.errstate(over="ignore"):
            codes = points.astype(np.uint64) + np.uint64(1)
            last = np.full((n, length + 1), _NONE, np.int32)
            last[:, 0] = UNKNOWN  # nothing before
            step = np.zeros((n, length + 1), np.int32)
            for i in range(1, length + 1):
                found = self._found(codes, i)
                for size in range(len(found), 0, -1):
                    rows, key = found[size - 1]
                    open_ = np.flatnonzero((last[rows, i] == _NONE) & (last[rows, i - size] != _NONE))
                    if not len(open_):
                        continue
                    rows, key = rows[open_], key[open_]
                    at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    is_piece = self.keys[at] == key
                    rows, at = rows[is_piece], at[is_piece]
                    if len(rows):
                        ids = self.key_ids[at]
                        fit = self._goes(last[rows, i - size], ids)
                        last[rows[fit], i], step[rows[fit], i] = ids[fit], size
                rest = np.flatnonzero((last[:, i] == _NONE) & (last[:, i - 1] != _NONE))
                alone = [r for r in rest.tolist() if words[r][i - 1] not in self.ids]
                last[alone, i], step[alone, i] = UNKNOWN, 1
        # the best paths, all words one piece back at a time
        on = np.zeros((n, length + 1), bool)
        rows, at = np.arange(n), np.full(n, length)
        while len(rows):
            on[rows, at] = True
            back = step[rows, at]
            at = np.where(back > 0, at - back, 0)
            rows, at = rows[at > 0], at[at > 0]
        flat = last[on].astype(np.int32).tobytes()
        ends = (on.sum(axis=1).cumsum() * 4).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for r in np.flatnonzero((on & (last == UNKNOWN)).any(axis=1)).tolist():
            ids = []
            for i in np.flatnonzero(on[r]).tolist():
                if last[r, i] == UNKNOWN:
                    ids += [self.byte[b] for b in words[r][i - 1].encode("utf-8", "surrogatepass")]
                else:
                    ids.append(int(last[r, i]))
            out[r] = np.array(ids, np.int32).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids in self.encode_arrays(texts)]

    def encode_arrays(self, texts: list[str]) -> list[np.ndarray]:
        units = [_UNITS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known_before, self.known = self.known, {}
        by: dict[int, list[str]] = {}
        for word in {w for own in units for w in own}.difference(self.known):
            if (ids := self.known_before.get(word)) is None:
                by.setdefault(len(word), []).append(word)
            else:
                self.known[word] = ids
        for own in by.values():
            size = max(1, TOGETHER // len(own[0]))
            for at in range(0, len(own), size):
                self.known.update(zip(own[at : at + size], self._viterbi(own[at : at + size]), strict=True))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, own)), np.int32) for own in units]

    def decode(self, ids: list[int]) -> str:
        data = b"".join([self.raw[i] for i in ids])
        text = data.decode("utf-8", "surrogatepass").replace(SPACE, " ")
        return text.removeprefix(" ")


@cache
def _model(path: str) -> PieceModel:
    """One for all tasks of a worker."""
    return PieceModel(path)


def encoded(text: Column, path: str) -> Column:
    """Ids of a whole text; none for an empty text, null for a null one.

    Each row is encoded by itself, so repeated rows get equal ids, no rows give none and other columns
    play no part. A word of any length is searched whole, in time and memory linear in its length.
    """

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            null = iter(batch.isna().tolist())
            for part in chunks([t or "" for t in batch], CHUNK_CHARS):
                # rows go on by the chunk, so that the ids of a batch are never held together
                yield pd.Series([None if next(null) else ids for ids in _model(path).encode_arrays(part)], dtype=object)

    return encode(text)


def encoded_and_checked(text: Column, path: str) -> Column:
    """Struct of a text's ids and of whether they decode to the text, made by one worker a task.

    Rows are treated as by ``encoded``; for a null text both are null.
    """

    @F.pandas_udf("ids array<int>, round_trip boolean")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            null = iter(batch.isna().tolist())
            model = _model(path)
            for part in chunks([t or "" for t in batch], CHUNK_CHARS):
                ids = model.encode_arrays(part)
                same = [model.decode(own.tolist()) == t for own, t in zip(ids, part, strict=True)]
                rows = [(None, None) if next(null) else row for row in zip(ids, same, strict=True)]
                yield pd.DataFrame(rows, columns=["ids", "round_trip"], dtype=object)

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """Text of an array of ids; null for null. A text's own U+2581 characters come back as spaces."""

    @F.pandas_udf("string")
    def decode(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: _model(path).decode(x.tolist()) if x is not None else None)

    return decode(ids)
