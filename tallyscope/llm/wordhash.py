"""Vectorised helpers over the texts of an Arrow batch: pieces of bounded size, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
PIECE = 1 << 19

#: An odd multiplier (2^64 divided by the golden ratio) and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Byte classes: True where a byte belongs to a word.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, dtype=bool)
LETTERS[ord("a") : ord("z") + 1] = LETTERS[ord("A") : ord("Z") + 1] = LETTERS[0x80:] = True


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows whose texts have about `limit` bytes; null counts as empty. The text of
    row i is bytes[offsets[i]:offsets[i + 1]]."""
    if batch.num_rows == 0:
        return
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of `h`."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * PIECE)
        tables = np.empty((2, size), dtype=np.uint64)
        tables[:, 0], tables[0, 1:], tables[1, 1:] = 1, BASE, INVERSE
        _powers[:] = [np.cumprod(row, dtype=np.uint64) for row in tables]
    return _powers[0][:n], _powers[1][:n]


class Words:
    """The words of some texts, a word being a run of bytes of the class `inside`, never across two texts.

    start, end: byte positions; doc: index of the text; first: index of each text's first word (one more at the end).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_BLANK):
        self.data = data
        self._base, self._sums = -1, np.zeros(0, dtype=np.uint64)
        if len(data) == 0:
            self.start = self.end = self.doc = np.zeros(0, dtype=np.int64)
            self.first = np.zeros(len(offsets), dtype=np.int64)
            return
        member = inside[data]
        begins = member.copy()
        begins[1:] &= ~member[:-1]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[edges] = member[edges]
        ends = member.copy()
        ends[:-1] &= ~member[1:]
        ends[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = member[offsets[1:][offsets[:-1] < offsets[1:]] - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def _runs(self) -> Iterator[tuple[int, int]]:
        """(first, last + 1) of runs of words that lie within about 2 * PIECE bytes."""
        at = 0
        while at < len(self.start):
            end = max(int(np.searchsorted(self.end, self.start[at] + 2 * PIECE, side="right")), at + 1)
            yield at, end
            at = end

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word with A-Z lower-cased, or of its first `most` bytes."""
        raw = np.empty(len(self.start), dtype=np.uint64)
        end = self.end if most is None else np.minimum(self.end, self.start + most)
        for low, high in self._runs():  # what is held beside the result is bounded, however long a text is
            base, stop = int(self.start[low]), int(end[high - 1])
            if stop - base > 2 * PIECE:
                raw[low] = _hash_of_long(self.data[base:stop])
                continue
            if self._base == base and len(self._sums) > stop - base:
                sums = self._sums
            else:
                sums = np.zeros(stop - base + 1, dtype=np.uint64)
                terms = (LOWER[self.data[base:stop]].astype(np.uint64) + np.uint64(1)) * _power_tables(stop - base + 1)[0][: stop - base]
                np.cumsum(terms, out=sums[1:])
                self._base, self._sums = base, sums
            inverse = _power_tables(len(sums))[1]
            begin = self.start[low:high] - base
            raw[low:high] = (sums[end[low:high] - base] - sums[begin]) * inverse[begin]
        return mix(raw + (end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _hash_of_long(word: np.ndarray) -> np.uint64:
    total, lead = 0, 1
    step, power = pow(BASE, PIECE, 1 << 64), _power_tables(PIECE)[0]
    for low in range(0, len(word), PIECE):
        own = LOWER[word[low : low + PIECE]].astype(np.uint64) + np.uint64(1)
        total += int((own * power[: len(own)]).sum(dtype=np.uint64)) * lead
        lead = lead * step % (1 << 64)
    return np.uint64(total % (1 << 64))


def hash_words(words: list[str], most: int | None = None) -> np.ndarray:
    """The hashes that `Words` gives to these words."""
    raw = [w.encode() for w in words]
    offsets = np.cumsum([0, *map(len, raw)])
    found = Words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, np.ones(256, dtype=bool))
    return found.hashes(most)


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `values` (rows by word) for each text, whose values begin at first[i]; 0 for texts without any."""
    total = np.zeros((len(first), *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    full = first[:-1] < first[1:]
    if full.any():
        total[:-1][full] = np.add.reduceat(values, first[:-1][full], axis=0, dtype=total.dtype)
    return total[:-1]
