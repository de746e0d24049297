"""Ranked lexical search over a tiered index, with exact answers.

The index holds documents in blocks, one row each. A block's postings lie in tiers, each a column of its own, so that a
search of the upper tiers reads no lower one: of every term the postings of the highest impact come first, and for each
term and tier it is known what the best posting below can add at most (the residual bound).

A search begins with the first tier. The scores found there are lower bounds; with the residual bounds of the terms a
document wasn't found under, they are upper bounds too. An item is proven when only few documents can still reach the
score of its twentieth: those are scored in full, and no other can be among the answers. Items that lack this proof fall
through to the next tier. The last tier holds all postings that are left, so what arrives there is scored exactly.

Impacts are integers, and so are scores and bounds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import in_arrow, materialize

#: What separates terms becomes a blank, and A-Z lower-case; bytes of other characters are parts of terms.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
FOLD = bytes.maketrans(SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(SEPARATORS) + bytes(range(0x61, 0x7B)))
#: Of a term's postings, at least so many and so large a share may stand in the first tiers; the rest is the last.
TIERS = ((64, 1 / 16), (256, 1 / 4))
#: Width, as a power of two, of the impact levels by which postings are dealt to tiers.
LEVEL = 12
#: Documents of a block; items scored side by side; bytes of a long text worked on at once; of items searched for at once.
BLOCK_DOCS, SIDE, PIECE, QUERY_BYTES = 4096, 128, 1 << 20, 1 << 20
#: Documents that may still reach an item's last rank, for the item to be proven by scoring these alone.
CONTENDERS = 500
TOP = 20
#: The doc_id of a row whose doc_id is null, beside a mask; it ranks last.
NO_ID = (1 << 63) - 1

FORWARD = "doc_id long, n long, terms array<int>, tfs array<long>"
COLUMNS = [f"tier{i}" for i in range(len(TIERS) + 1)]
FOUND = "item int, doc_id long, score long"


class Item(NamedTuple):
    """A query: its place among the items, its id and its terms with their numbers of occurrences."""

    at: int
    item_id: object
    terms: Counter


def term_runs(text: memoryview) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, piece by piece; a piece ends between terms."""
    begin, size = 0, len(text)
    while begin < size:
        end = min(begin + PIECE, size)
        piece = bytes(text[begin:end]).translate(FOLD)
        while end < size and (cut := piece.rfind(b" ")) < 0:  # a term longer than a piece
            end = min(end + PIECE, size)
            piece = bytes(text[begin:end]).translate(FOLD)
        if end < size:
            piece = piece[: cut + 1]
            end = begin + cut + 1
        yield piece.split()
        begin = end


def terms_of(text: str | None) -> Counter:
    counts: Counter = Counter()
    for run in term_runs(memoryview((text or "").encode())):
        counts.update(run)
    return counts


def _forward(docs: DataFrame, vocab: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs of every document: all its terms counted, those of `vocab` by number."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            texts, ns, terms, tfs = batch.column("text"), [], [], []
            for i in range(batch.num_rows):
                n, counts = 0, Counter()
                raw = texts[i].as_buffer()
                for run in term_runs(memoryview(raw) if raw is not None else memoryview(b"")):
                    n += len(run)
                    counts.update(map(number, run))
                counts.pop(None, None)
                ns.append(n)
                terms.append(list(counts))
                tfs.append(list(counts.values()))
            columns = (batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "n", "terms", "tfs"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), count, FORWARD)


def _impact(tf, m):
    """What a term's occurrences count in a document, before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _length_factor(n, docs: int, terms: int):
    return 75 + (25 * n * docs) // terms


def _tier_cuts(forward: DataFrame, docs: int, terms: int) -> DataFrame:
    """term, df, cuts, rests: the least impact of each tier but the last, and the largest below each of these."""
    m = F.expr(f"75L + (25L * n * {docs}L) div {terms}L")
    posting = forward.select(m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    impact = F.expr("(1000000000L * p.tfs) div (1000L * p.tfs + 12L * m)")
    levels = posting.select(F.col("p.terms").alias("term"), impact.alias("impact"))
    levels = levels.groupBy("term", F.shiftright("impact", LEVEL).alias("level")).agg(F.count("*").alias("n"), F.max("impact").alias("most"))
    down = Window.partitionBy("term").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("term")  # a row for each level
    levels = levels.withColumns({"upto": F.sum("n").over(down), "df": F.sum("n").over(own), "top": F.max("level").over(own)})
    inside: list[Column] = [(F.col("upto") <= F.greatest(F.lit(float(least)), share * F.col("df"))) | (F.col("level") == F.col("top")) for least, share in TIERS]
    cuts = F.array(*[F.min(F.when(x, F.shiftleft("level", LEVEL))) for x in inside])
    rests = F.array(*[F.coalesce(F.max(F.when(~x, F.col("most"))), F.lit(0)) for x in inside])
    return levels.groupBy("term").agg(F.first("df").alias("df"), cuts.alias("cuts"), rests.alias("rests"))


def _index(forward: DataFrame, cuts: np.ndarray, docs: int, terms: int) -> DataFrame:
    """block, ids and the tiers: a tier is (term, document, impact), each as 32-bit integers, by term and falling impact."""
    shared = forward.sparkSession.sparkContext.broadcast(cuts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bounds = TaskContext.get().partitionId() << 33, shared.value
        for batch in batches:
            for rows in (batch.slice(i, BLOCK_DOCS) for i in range(0, batch.num_rows, BLOCK_DOCS)):
                held = np.diff(rows.column("terms").offsets.to_numpy())
                term = rows.column("terms").flatten().to_numpy().astype(np.int32)
                if not len(term):
                    continue
                doc = np.repeat(np.arange(rows.num_rows, dtype=np.int32), held)
                tf = rows.column("tfs").flatten().to_numpy()
                impact = _impact(tf, _length_factor(rows.column("n").to_numpy(), docs, terms)[doc]).astype(np.int32)
                tier = (impact[:, None] < bounds[term]).sum(1)
                order = np.lexsort((-impact, term))
                packed = []
                for t in range(len(COLUMNS)):
                    own = order[tier[order] == t]
                    packed.append(pa.array([np.stack([term[own], doc[own], impact[own]]).astype(np.int32).tobytes()], pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())), *packed], ["block", "ids", *COLUMNS])
                number += 1

    return in_arrow(forward, pack, "block long, ids array<long>, " + ", ".join(f"{c} binary" for c in COLUMNS))


class Wanted:
    """The items that are still searched for: by term, the items that have it, how often, and its residual bound."""

    def __init__(self, items: list[Item], vocab: dict[bytes, int], weight: np.ndarray, rest: np.ndarray):
        self.at = np.array([x.at for x in items], dtype=np.int32)
        pairs = sorted((vocab[t], k, q) for k, x in enumerate(items) for t, q in x.terms.items())
        term, self.item, often = (np.array(c, dtype=np.int64) for c in zip(*pairs, strict=True))
        self.gain = often * weight[term]
        self.bound = self.gain * rest[term]
        self.first = np.searchsorted(term, np.arange(len(weight) + 1))
        self.unseen = np.zeros(len(items), dtype=np.int64)
        np.add.at(self.unseen, self.item, self.bound)


def block_scores(tiers: list[bytes], docs: int, wanted: Wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first item, scores, upper bounds of what the lower tiers leave open) of a block, some items at a time: a row for
    each item, a column for each document."""
    term, doc, impact = np.concatenate([np.frombuffer(t, dtype=np.int32).reshape(3, -1) for t in tiers], axis=1)
    if len(tiers) > 1:
        order = np.argsort(term, kind="stable")
        term, doc, impact = term[order], doc[order], impact[order]
    edges = np.flatnonzero(np.diff(term, prepend=-1, append=-1)) if len(term) else np.zeros(1, dtype=np.int64)
    runs = [(int(term[a]), doc[a:b], impact[a:b].astype(np.int64)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for low in range(0, len(wanted.at), SIDE):
        high = min(low + SIDE, len(wanted.at))
        scores = np.zeros((high - low, docs), dtype=np.int64)
        rest = np.repeat(wanted.unseen[low:high, None], docs, axis=1)
        for t, at, value in runs:
            a, b = wanted.first[t], wanted.first[t + 1]
            a, b = a + np.searchsorted(wanted.item[a:b], [low, high])
            for k in range(a, b):
                row = wanted.item[k] - low
                scores[row, at] += wanted.gain[k] * value
                if wanted.bound[k]:
                    rest[row, at] -= wanted.bound[k]
        yield low, scores, rest


def _ids(row) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in row], dtype=np.int64)


def _batch(item: list, doc_id: list, score: list) -> pa.RecordBatch:
    item, score = np.concatenate(item), np.concatenate(score)
    ids = np.concatenate(doc_id)
    return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids, mask=ids == NO_ID), pa.array(score)], ["item", "doc_id", "score"])


def _best(index: DataFrame, tiers: int, wanted: Wanted, top: int) -> DataFrame:
    """item, doc_id, score: of each task and item the `top` documents with the highest score above 0."""
    shared = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, names = shared.value, COLUMNS[:tiers]
        held = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in want.at]
        for batch in batches:
            for i in range(batch.num_rows):
                ids = _ids(batch.column("ids")[i].as_py())
                for low, scores, _ in block_scores([batch.column(c)[i].as_py() for c in names], len(ids), want):
                    for k, own in enumerate(scores, low):
                        keep = np.flatnonzero(own)
                        if len(keep) > top:
                            keep = keep[own[keep] >= np.partition(own[keep], -top)[-top]]
                        all_ids, all_scores = np.concatenate([held[k][0], ids[keep]]), np.concatenate([held[k][1], own[keep]])
                        order = np.lexsort((all_ids, -all_scores))[:top]
                        held[k] = all_ids[order], all_scores[order]
        if any(len(x) for x, _ in held):
            yield _batch([np.full(len(x), at) for at, (x, _) in zip(want.at, held, strict=True)], [x for x, _ in held], [s for _, s in held])

    return in_arrow(index.select("ids", *COLUMNS[:tiers]), run, FOUND)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """item, doc_id, score, rank of the first `top` of each item; Spark keeps no more of an item in any task."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _contenders(index: DataFrame, tiers: int, wanted: Wanted, least: np.ndarray) -> DataFrame:
    """item, block, doc: the documents whose upper bound comes to `least` of the item; of an item with too many in a task,
    doc is -1."""
    shared = index.sparkSession.sparkContext.broadcast((wanted, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, bar = shared.value
        number, lost = np.zeros(len(want.at), dtype=np.int64), np.zeros(len(want.at), dtype=bool)
        for batch in batches:
            for i in range(batch.num_rows):
                out, block = [], batch.column("block")[i].as_py()
                for low, scores, rest in block_scores([batch.column(c)[i].as_py() for c in COLUMNS[:tiers]], batch.column("n_docs")[i].as_py(), want):
                    row, doc = np.nonzero(scores + rest >= bar[low : low + len(scores), None])
                    number[low : low + len(scores)] += np.bincount(row, minlength=len(scores))
                    good = number[row + low] <= CONTENDERS
                    out.append((row[good] + low, doc[good]))
                new = (number > CONTENDERS) & ~lost
                lost |= new
                item = np.concatenate([*[x for x, _ in out], np.flatnonzero(new)])
                doc = np.concatenate([*[x for _, x in out], np.full(int(new.sum()), -1)])
                if len(item):
                    yield pa.RecordBatch.from_arrays([pa.array(want.at[item]), pa.array(np.full(len(item), block)), pa.array(doc.astype(np.int32))], ["item", "block", "doc"])

    return in_arrow(index.select("block", F.size("ids").alias("n_docs"), *COLUMNS[:tiers]), run, "item int, block long, doc int")


def _in_full(index: DataFrame, contenders: DataFrame, wanted: Wanted) -> DataFrame:
    """item, doc_id, score of every contender, over all tiers. At most CONTENDERS for each item: their blocks alone are
    read on."""
    by_block = contenders.groupBy("block").agg(F.collect_list("item").alias("items"), F.collect_list("doc").alias("docs"))
    shared = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = shared.value
        place = {at: k for k, at in enumerate(want.at.tolist())}
        for batch in batches:
            for i in range(batch.num_rows):
                ids = _ids(batch.column("ids")[i].as_py())
                item = np.array([place[x] for x in batch.column("items")[i].as_py()], dtype=np.int64)
                doc = np.array(batch.column("docs")[i].as_py(), dtype=np.int64)
                score = np.zeros(len(item), dtype=np.int64)
                for low, scores, _ in block_scores([batch.column(c)[i].as_py() for c in COLUMNS], len(ids), want):
                    own = (item >= low) & (item < low + len(scores))
                    score[own] = scores[item[own] - low, doc[own]]
                yield _batch([want.at[item]], [ids[doc]], [score])

    return in_arrow(index.join(F.broadcast(by_block), "block").drop("block"), run, FOUND)


def _search_block(docs: DataFrame, items: list[Item], top: int) -> DataFrame:
    """item, doc_id, score, rank, tier of some items, written."""
    spark = docs.sparkSession
    vocab = {t: i for i, t in enumerate(sorted({t for x in items for t in x.terms}))}
    forward = materialize(_forward(docs, vocab), "forward")
    n_docs, n_terms = forward.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df, cuts, rests = np.zeros(len(vocab), np.int64), np.zeros((len(vocab), len(TIERS)), np.int64), np.zeros((len(vocab), len(TIERS)), np.int64)
    if n_terms:
        for r in _tier_cuts(forward, n_docs, n_terms).toLocalIterator():  # a row for each term of the items
            df[r["term"]], cuts[r["term"]], rests[r["term"]] = r["df"], r["cuts"], r["rests"]
    index = materialize(_index(forward, cuts, n_docs, max(n_terms, 1)), "tiers")
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
    left, answers = [x for x in items if x.terms], []
    for tier in range(len(TIERS)):
        if not left:
            break
        wanted = Wanted(left, vocab, weight, rests[:, tier])
        last = {r["item"]: r["score"] for r in _ranked(_best(index, tier + 1, wanted, top), top).where(F.col("rank") == top).collect()}  # an item a row
        bar = np.array([max(last.get(x.at, 0), 1) for x in left], dtype=np.int64)
        hope = np.flatnonzero(wanted.unseen < bar)
        if not len(hope):
            continue
        hopeful = [left[k] for k in hope]
        wanted = Wanted(hopeful, vocab, weight, rests[:, tier])
        found = materialize(_contenders(index, tier + 1, wanted, bar[hope]), "contenders")
        counts = found.groupBy("item").agg(F.count("*").alias("n"), F.min("doc").alias("least")).collect()  # an item a row
        many = {r["item"] for r in counts if r["n"] > CONTENDERS or r["least"] < 0}
        proven = [x for x in hopeful if x.at not in many]
        if proven:
            own = spark.createDataFrame([(x.at,) for x in proven], "item int")
            full = _in_full(index, found.join(F.broadcast(own), "item"), Wanted(proven, vocab, weight, rests[:, tier]))
            answers.append(_ranked(full.where("score > 0"), top).withColumn("tier", F.lit(tier)))
            gone = {x.at for x in proven}
            left = [x for x in left if x.at not in gone]
    if left:
        wanted = Wanted(left, vocab, weight, np.zeros(len(vocab), dtype=np.int64))
        answers.append(_ranked(_best(index, len(COLUMNS), wanted, top), top).withColumn("tier", F.lit(len(TIERS))))
    ids = spark.createDataFrame([(x.at, x.item_id) for x in items], f"item int, item_id {_id_type(items)}")
    whole = spark.createDataFrame([], "item int, doc_id long, score long, rank int, tier int")
    for more in answers:
        whole = whole.unionByName(more)
    return materialize(whole.join(F.broadcast(ids), "item"), "answers")


def _id_type(items: list[Item]) -> str:
    return "string" if any(isinstance(x.item_id, str) for x in items) else "long"


def _blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    """The items, the query set: they come to the driver in blocks of bounded size."""
    block, size, at = [], 0, 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append(Item(at, row["item_id"], terms_of(row["text"])))
        at, size = at + 1, size + len(row["text"] or "")
        if size >= QUERY_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def ranked_search(docs: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score, tier: for each row of `benchmark` (item_id, text) the `top` rows of `docs` (doc_id,
    text) with the highest score above 0, all if fewer. tier is the one that proved the answer.

    Terms are runs of letters and digits of ASCII and of all other characters beyond it, only A-Z lower-cased. The score
    sums weight * impact over the item's terms, repeats included, in 64-bit integers. Equal scores rank by ascending
    doc_id, a null one last. Null and empty texts have no term: such an item has no row, such a document counts in no
    statistic. Rows of one item_id, or of one doc_id, are items and documents of their own; empty tables give an empty
    result. Texts are read whole. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    whole = None
    for block in _blocks(benchmark):
        found = _search_block(docs, block, top)
        whole = found if whole is None else whole.unionByName(found)
    if whole is None:
        whole = spark.createDataFrame([], "item int, doc_id long, score long, rank int, tier int, item_id long")
    return whole.select("item_id", "rank", "doc_id", "score", "tier")
