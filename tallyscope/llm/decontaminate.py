"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A passage of n characters that stands in a text with at most e edits shares n + 1 - q * (e + 1) of its q-grams with
it, all within e + 1 neighbouring diagonals. Texts are searched for the q-grams of the passages, matches are counted in
overlapping bands of diagonals, and regions whose band meets that bound are aligned with the passage within the band.
q is 8, and less for passages so short that the bound would come to nothing.

Characters are the bytes of the normalised text in UTF-8: A-Z lower-cased, each run of blanks one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import drop_rows, in_arrow, materialize, text_mark
from tallyscope.llm.wordhash import LOWER, NOT_BLANK, PIECE, pieces

Q = 8
#: Edits allowed for each character of a segment.
EDIT_RATE = 0.1
#: A longer passage is searched for in segments of this length, each overlapping half of the next: so a copy of a part
#: one and a half segments long is found too. One of up to one and a half segments is searched for whole as well, since
#: its edits may all lie where its segments overlap.
SEGMENT = 120
#: Bytes of passages that one search takes; more are searched for in blocks, one pass over the texts each.
BLOCK_BYTES = 4 << 20
#: Keeps diagonals above 0: more than a segment is long.
LEAD = 4096
#: Bytes of a long text in which regions are sought at once; neighbours share OVERLAP, more than a region is long.
WINDOW, OVERLAP = PIECE, 1024
#: Places of q-grams of passages that are counted at once.
AT_ONCE = 1 << 18
#: A shorter passage says nothing about where a text comes from: a text that holds it isn't dropped for it.
MIN_CHARS = 8


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of the texts, their offsets, and the place in `data` of every byte kept."""
    kept, out = [], []
    for low in range(0, len(data), 4 * PIECE):  # so that what is held beside the result is bounded
        own = data[low : low + 4 * PIECE]
        word = NOT_BLANK[own]
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[0] = low == 0 or NOT_BLANK[data[low - 1]]
        begins = offsets[:-1][(offsets[:-1] >= low) & (offsets[:-1] < low + len(own))] - low
        before[begins] = True
        at = np.flatnonzero(word | before)
        text = LOWER[own[at]]
        text[~word[at]] = 0x20
        out.append(text)
        kept.append((at + low).astype(np.int64 if len(data) >> 31 else np.int32))
    if not kept:
        return data, offsets, np.zeros(0, dtype=np.int32)
    at = np.concatenate(kept)
    return np.concatenate(out), np.searchsorted(at, offsets), at


def budget(n: int, rate: float = EDIT_RATE) -> int:
    """Edits allowed in a segment of n characters; below 0 if it has none."""
    return int(rate * n) if n else -1


def width_of(n: int, edits: int) -> int:
    """The q for a segment of n characters: Q, or so much less that the bound on shared q-grams is 1 or more."""
    return min(Q, n // (edits + 1))


class Grams:
    """The q-grams, for one q, of some segments, sorted, with the segments and places where they stand."""

    def __init__(self, q: int, ids: list[int], texts: list[bytes], edits: list[int]):
        self.q, self.ids = q, np.array(ids, dtype=np.int64)
        own = [grams_of(np.frombuffer(t, dtype=np.uint8), q) for t in texts]
        grams = np.concatenate(own)
        segment = np.repeat(np.arange(len(own)), [len(g) for g in own])
        place = np.concatenate([np.arange(len(g)) for g in own])
        order = np.lexsort((place, segment, grams))
        self.gram, at = np.unique(grams[order], return_inverse=True)
        self.place = place[order]
        self.segment = segment[order]
        self.entry = at * len(own) + self.segment  # sorted: the places of a gram in a range of segments are a slice
        self.edit = np.array(edits, dtype=np.int64)
        self.need = np.array([len(t) + 1 - q * (e + 1) for t, e in zip(texts, edits, strict=True)], dtype=np.int64)
        # 16 to 32 slots a gram, 1 << 22 at most: each worker holds a sieve for every q
        self.bits = min(22, max(10, (16 * len(self.gram)).bit_length()))
        self.sieve = np.zeros(1 << self.bits, dtype=bool)
        self.sieve[_slot(self.gram, self.bits)] = True


class Passages:
    """The segments of some passages and their q-grams."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = EDIT_RATE):
        if not 0 <= rate < 0.5:
            raise ValueError("rate is from 0 to below 0.5")
        self.item, self.text, self.edits = [], [], []
        for item, raw in items:
            whole = normalise(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))[0].tobytes().strip()
            last = max(0, len(whole) - SEGMENT)
            parts = [whole[s : s + SEGMENT] for s in sorted({*range(0, last, SEGMENT // 2), last})]
            if SEGMENT < len(whole) <= SEGMENT + SEGMENT // 2:
                parts.append(whole)
            for part in parts:
                if part:
                    self.item.append(item)
                    self.text.append(part)
                    self.edits.append(budget(len(part), rate))
        self.edit = np.array(self.edits, dtype=np.int64)
        by_width: dict[int, list[int]] = {}
        for i, (t, e) in enumerate(zip(self.text, self.edits, strict=True)):
            by_width.setdefault(width_of(len(t), e), []).append(i)
        self.grams = [Grams(q, ids, [self.text[i] for i in ids], [self.edits[i] for i in ids]) for q, ids in sorted(by_width.items())]


def grams_of(data: np.ndarray, q: int = Q) -> np.ndarray:
    """All runs of q bytes, 8 at most, each as one 64-bit number."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    data = np.concatenate([data, np.zeros(8 - q, dtype=np.uint8)]) if q < 8 else np.ascontiguousarray(data)
    runs = np.ndarray((n,), dtype="<u8", buffer=data.data, strides=(1,))
    return runs.astype(np.uint64) if q == 8 else runs & np.uint64((1 << 8 * q) - 1)


def _slot(grams: np.ndarray, bits: int) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def find_regions(data: np.ndarray, offsets: np.ndarray, index: Passages) -> np.ndarray:
    """Rows (text, segment, first diagonal) of the bands that hold enough shared q-grams: diagonals in which the segment
    would begin at that byte of `data`, or up to 2 * (edits + 1) later. A long text is searched window by window."""
    out = [np.zeros((0, 3), dtype=np.int64)]
    if len(data) <= WINDOW + OVERLAP or len(offsets) > 2:
        out += [_regions(data, offsets, g) for g in index.grams]
    else:
        for low in range(0, len(data), WINDOW):
            own = data[low : low + WINDOW + OVERLAP]
            for g in index.grams:
                found = _regions(own, np.array([0, len(own)]), g)
                found[:, 2] += low
                out.append(found)
    return np.concatenate(out)


def _regions(data: np.ndarray, offsets: np.ndarray, index: Grams) -> np.ndarray:
    gram = grams_of(data, index.q)
    at = np.flatnonzero(index.sieve[_slot(gram, index.bits)])
    found = np.minimum(np.searchsorted(index.gram, gram[at]), len(index.gram) - 1)
    real = index.gram[found] == gram[at]
    at, found = at[real], found[real]
    doc = np.searchsorted(offsets, at, side="right") - 1
    inside = at + index.q <= offsets[doc + 1]
    at, found, doc = at[inside], found[inside], doc[inside]
    # a text with fewer hits than the least bound can't hold a passage
    enough = np.bincount(doc, minlength=len(offsets) - 1) >= index.need.min()
    at, found, doc = at[enough[doc]], found[enough[doc]], doc[enough[doc]]
    if len(at) == 0:
        return np.zeros((0, 3), dtype=np.int64)
    return np.concatenate(list(_counted(at, found, doc, offsets, index, 0, len(index.ids))))


def _counted(at: np.ndarray, found: np.ndarray, doc: np.ndarray, offsets: np.ndarray, index: Grams, low: int, high: int) -> Iterator[np.ndarray]:
    """The bands of the segments from `low` to below `high`, counted in halves where these have too many places; bands
    of different segments don't touch, so nothing is lost between the halves."""
    first = np.searchsorted(index.entry, found * len(index.ids) + low)
    n = np.searchsorted(index.entry, found * len(index.ids) + high) - first
    total = int(n.sum())
    if total > AT_ONCE and high - low > 1:
        some = n > 0
        at, found, doc = at[some], found[some], doc[some]
        yield from _counted(at, found, doc, offsets, index, low, (low + high) // 2)
        yield from _counted(at, found, doc, offsets, index, (low + high) // 2, high)
    elif total > AT_ONCE and doc[0] < doc[-1]:  # nor do bands of different texts
        cut = np.searchsorted(doc, (doc[0] + doc[-1] + 1) // 2)
        yield from _counted(at[:cut], found[:cut], doc[:cut], offsets, index, low, high)
        yield from _counted(at[cut:], found[cut:], doc[cut:], offsets, index, low, high)
    elif total > AT_ONCE:
        # one segment in one text: by places; what counts for a band lies within `reach` of its begin
        reach = int(index.need[low] - 1 + (index.q + 2) * (index.edit[low] + 1))
        step = max(reach, AT_ONCE // int(n.max()))
        for begin in range(int(at[0]) - reach, int(at[-1]) + 1, step):
            own = slice(*np.searchsorted(at, [begin, begin + step + reach]))
            if own.start < own.stop:
                bands = _bands(at[own], first[own], n[own], doc[own], offsets, index)
                yield bands[(bands[:, 2] >= begin) & (bands[:, 2] < begin + step)]
    elif total:
        yield _bands(at, first, n, doc, offsets, index)


def _bands(at: np.ndarray, first: np.ndarray, n: np.ndarray, doc: np.ndarray, offsets: np.ndarray, index: Grams) -> np.ndarray:
    entry = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    segment, doc = index.segment[entry], np.repeat(doc, n)
    place = np.repeat(at, n) - index.place[entry] - offsets[doc] + LEAD
    # cells of e + 1 diagonals; a band is two neighbouring cells, so any e + 1 neighbours lie within one
    cell = place // (index.edit[segment] + 1)
    both, pair = np.unique(doc * len(index.ids) + segment, return_inverse=True)
    key = np.concatenate([pair, pair]) << 32 | np.concatenate([cell, cell - 1])
    band, at_band, count = np.unique(key, return_inverse=True, return_counts=True)
    need = index.need[both[band >> 32] % len(index.ids)]
    # the bound is on places of the segment, so one that is met again and again counts once
    some = (count >= need)[at_band]
    spot = np.unique(at_band[some] << 20 | np.tile(index.place[entry], 2)[some])
    band = band[np.bincount(spot >> 20, minlength=len(band)) >= need]
    doc, segment = np.divmod(both[band >> 32], len(index.ids))
    start = (band & ((1 << 32) - 1)) * (index.edit[segment] + 1) - LEAD + offsets[doc]
    return np.stack([doc, index.ids[segment], start], 1)


def banded_edits(patterns: np.ndarray, regions: np.ndarray, lanes: int) -> np.ndarray:
    """For each row the least number of edits that turn the pattern into a run of the region, along the diagonals that
    begin at its first `lanes` places. `patterns` has n columns, `regions` n + lanes."""
    step = np.arange(lanes, dtype=np.int16)
    row = np.zeros((len(patterns), lanes), dtype=np.int16)
    for i in range(patterns.shape[1]):
        change = row + (regions[:, i : i + lanes] != patterns[:, i : i + 1])
        np.minimum(change[:, :-1], row[:, 1:] + 1, out=change[:, :-1])
        change -= step
        row = np.minimum.accumulate(change, axis=1) + step
    return row.min(1)


def align_regions(segments: np.ndarray, regions: list[bytes], index: Passages, at_once: int = 2000) -> np.ndarray:
    """The edits of each region's segment within its band; regions of one shape are aligned side by side."""
    out = np.zeros(len(regions), dtype=np.int64)
    size = np.array([len(t) for t in index.text], dtype=np.int64)[segments]
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        lanes = band_lanes(index.edits[segments[rows[0]]])
        for own in (rows[k : k + at_once] for k in range(0, len(rows), at_once)):
            patterns = np.frombuffer(b"".join(index.text[s] for s in segments[own]), dtype=np.uint8).reshape(len(own), n)
            padded = np.frombuffer(b"".join(regions[i][: n + lanes].ljust(n + lanes, b"\xff") for i in own), dtype=np.uint8)
            out[own] = banded_edits(patterns, padded.reshape(len(own), n + lanes), lanes)
    return out


def band_lanes(edits: int) -> int:
    """Diagonals that are aligned: two cells of edits + 1, and as many as edits reach on either side."""
    return 2 * (edits + 1) + 2 * edits


def find_passages(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """doc_id, item_id, start, end, edits: one row for each document and passage of `benchmark` (item_id, text) that
    stands in it, whole or by a segment, within `rate` edits a character.

    start and end are bytes of the text in UTF-8 around all its segments found there, edits the fewest of a segment.
    Null and empty passages, or those of blanks, are not searched for; a null text holds none; repeated rows count as
    one document, rows of one doc_id with different texts as one for each text; equal passages under two ids are both
    found, items of one id are one passage that stands where any does; empty tables give an empty result. Other columns
    are ignored.
    """
    return _hits(docs, benchmark, rate).groupBy("doc_id", "mark", "item_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("edits").alias("edits")
    ).drop("mark")


def _hits(docs: DataFrame, benchmark: DataFrame, rate: float, least: int = 0) -> DataFrame:
    """doc_id, mark, item_id, start, end, edits of every segment found; of passages of `least` characters or more."""
    docs = docs.select("doc_id", text_mark(F.col("text")).alias("mark"), "text")
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("raw"))
    hits, block, size = [], [], 0
    # passages are the query set: they come to the driver in blocks of bounded size, and the texts are searched by each
    for item in items.toLocalIterator():
        block.append((item["item_id"], bytes(item["raw"])))
        size += len(block[-1][1])
        if size >= BLOCK_BYTES:
            hits.append(_search_block(docs, block, rate, least))
            block, size = [], 0
    if block or not hits:
        hits.append(_search_block(docs, block, rate, least))
    whole = hits[0]
    for more in hits[1:]:
        whole = whole.unionByName(more)
    return whole


def _search_block(docs: DataFrame, block: list[tuple[int, bytes]], rate: float, least: int) -> DataFrame:
    """The hits of some passages, written."""
    shared = docs.sparkSession.sparkContext.broadcast(Passages(block, rate))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, mark, segment, from, begin, places, region): what is to be aligned, with each byte's place in the text."""
        index = shared.value
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text"):
                if len(data) == 0 or not index.text:
                    continue
                plain, ends, source = normalise(data, offsets)
                found = find_regions(plain, ends, index)
                for low in range(0, len(found), 20_000):
                    out = []
                    for doc, segment, first in found[low : low + 20_000].tolist():
                        e, n = index.edits[segment], len(index.text[segment])
                        lead = first - e
                        begin, end = max(lead, int(ends[doc])), min(first + 2 * (e + 1) + n + e, int(ends[doc + 1]))
                        if end > begin:
                            start = int(source[begin] - offsets[doc])
                            stop = int(source[end - 1] + 1 - offsets[doc])
                            out.append((doc, segment, start, stop, b"\xff" * (begin - lead) + plain[begin:end].tobytes()))
                    if out:
                        doc, segment, start, stop, text = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [*[rows.column(c).take(pa.array(doc)) for c in ("doc_id", "mark")], pa.array(segment, pa.int32()),
                             pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(text, pa.binary())],
                            ["doc_id", "mark", "segment", "start", "end", "region"],
                        )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            segments = batch.column("segment").to_numpy()
            edits = align_regions(segments, batch.column("region").to_pylist(), index)
            long_enough = np.array([not least or len(index.text[s]) >= least for s in segments.tolist()], dtype=bool)
            good = pa.array((edits <= index.edit[segments]) & long_enough, pa.bool_())
            item = pa.array([index.item[s] for s in segments.tolist()], pa.int64())
            columns = (batch.column("doc_id"), batch.column("mark"), item, batch.column("start"), batch.column("end"), pa.array(edits))
            yield pa.RecordBatch.from_arrays([x.filter(good) for x in columns], ["doc_id", "mark", "item_id", "start", "end", "edits"])

    found = in_arrow(docs, regions, f"doc_id {kind}, mark long, segment int, start long, end long, region binary")
    dealt = found.repartition(F.xxhash64("doc_id", "segment", "start"))
    hits = in_arrow(dealt, align, f"doc_id {kind}, mark long, item_id long, start long, end long, edits long")
    hits = materialize(hits, "hits")
    shared.destroy()
    return hits


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, least: int = MIN_CHARS) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) in which no passage of `benchmark` (item_id, text) of `least` characters
    or more stands.

    Rows are told apart by id and text: a clean row stays when another of its id leaks; rows repeated whole go or stay
    together. A null or empty text is clean, a null doc_id an id like others; null and empty passages stand nowhere;
    without passages all stays, and an empty table gives an empty result. All columns are kept, whatever their names.
    """
    return drop_rows(docs, _hits(docs, benchmark, rate, least).select("doc_id", "mark"))
