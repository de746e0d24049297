"""Jaccard join of word n-gram sets by set-relation skipping.

Two relations between sets spare most of the work of a prefix-filter join, and none of its answers:

* Answers from a similar set. Documents with equal sets are one class. A class that is compared exactly with a leader of
  one of its bands of minimum hashes, and links with it, joins the leader's group, and what it has beyond the leader is
  kept as a number. The answers of a group's members against another group are then derived from the answer of their
  leaders: the leaders' common tokens and those numbers bound what any two members share, and only where neither the
  leaders link nor the bound is too low are members looked at themselves.
* Skipping blocks of the index. The index lists, by token, the sets that hold it in their prefix. All sets of one group
  in a list are one block with bounds on their size and on the tokens that can still match after their position. Blocks
  of groups that are already linked are skipped whole, as are blocks whose bounds exclude each other.

Every pair of classes at or above the threshold shares a prefix token, so each lies within one component of linked
groups or among the blocks that are left.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import checked, drop_rows, in_arrow, materialize, remove_folder, text_mark
from tallyscope.llm.components import connected_components
from tallyscope.llm.wordhash import Words, mix, pieces

#: Bins of the minimum-hash sketch and bins for each band.
BINS, BAND = 32, 2
#: Leaders of a band: its central set and others by different hashes.
LEADERS = 4
#: Tokens that go to the end of the common order, at most; they are broadcast (8 bytes each). They are those that repeat
#: within some neighbouring documents, the most frequent first, and then those whose lists in the index are longer than
#: LONG_LIST, counted over the whole index, which is built anew for them ORDERS times at most. This order only decides
#: which tokens make up a prefix: the join is exact under any, but a prefix of rare tokens meets few others.
MAX_FREQUENT, LONG_LIST, ORDERS = 500_000, 64, 4
#: Columns of 64 bits in the parity map of fixed length that travels with the index entries.
SKETCH = [f"s{i}" for i in range(8)]
#: Tokens of neighbouring documents that are counted at once.
COUNTED = 1_000_000
#: Entries of the index whose blocks are formed at once.
INDEXED = 300_000

STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                  0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct runs of `width` words; of all its words if it has fewer."""
    words = Words(data, offsets)
    h, n = words.hashes(), np.diff(words.first)
    sums = np.zeros(len(h), dtype=np.uint64)
    for k in range(min(width, len(h))):
        sums[: len(h) - k] += mix(h[k:] * STEPS[k % len(STEPS)] + np.uint64(k))
    sums = mix(sums)
    out = []
    for i in range(len(n)):
        begin, end = words.first[i], words.first[i + 1]
        if n[i] >= width:
            out.append(np.unique(sums[begin : end - width + 1]))
        elif n[i]:
            own = h[begin:end] * STEPS[np.arange(n[i]) % len(STEPS)] + np.arange(n[i]).astype(np.uint64)
            out.append(mix(np.array([mix(own).sum(dtype=np.uint64) + np.uint64(n[i])], dtype=np.uint64)))
        else:
            out.append(sums[:0])
    return out


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set, as two numbers."""
    n = np.uint64(len(tokens))
    total = np.array([mix(tokens + STEPS[k]).sum(dtype=np.uint64) + n for k in (1, 5)], dtype=np.uint64)
    return tuple(mix(total).view(np.int64).tolist())


def bands(tokens: np.ndarray) -> np.ndarray:
    """Hashes of BAND neighbouring minima of the set's BINS bins (an empty bin takes that of the next)."""
    spread = np.sort(mix(tokens ^ STEPS[2]))
    first = np.searchsorted(spread, np.arange(BINS, dtype=np.uint64) << np.uint64(59))
    least = spread[np.where(first < len(spread), first, 0)].reshape(-1, BAND)
    return mix((least * STEPS[:BAND]).sum(1, dtype=np.uint64) + np.arange(len(least)).astype(np.uint64)).view(np.int64)


def parity_map(tokens: np.ndarray) -> np.ndarray:
    """64-bit words of which each bit tells whether an even or odd number of tokens fall on it; two words or more for
    every 64 tokens. Two maps differ in no more bits than their sets differ in tokens, also when the longer one is
    folded to the length of the shorter."""
    bits = 64 << max(0, int(np.ceil(np.log2(max(len(tokens), 1) / 32))))
    odd = np.bincount((mix(tokens ^ STEPS[3]) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def sketch(tokens: np.ndarray) -> np.ndarray:
    """A parity map of as many words as SKETCH has names."""
    bits = 64 * len(SKETCH)
    odd = np.bincount((mix(tokens ^ STEPS[3]) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _fold(longer: Column, shorter: Column) -> Column:
    n = F.size(shorter)
    half = F.zip_with(F.slice(longer, 1, n), F.slice(longer, n + 1, n), lambda a, b: a.bitwiseXOR(b))
    return F.when(F.size(longer) == 2 * n, half).otherwise(longer)


def prefix_of(tokens: np.ndarray, frequent: np.ndarray, t: int) -> np.ndarray:
    """The first tokens of a set in the common order (frequent ones last, then by hash), so many that any set of t
    percent similarity shares one of them."""
    n = len(tokens)
    length = n - -(-t * n // 100) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        common = frequent[at] == tokens
        if common.any():
            tokens = np.concatenate([tokens[~common], tokens[common]])
    return tokens[:length]


DESCRIBED = (
    "doc_id long, mark long, n_shingles long, s0 long, s1 long, bands array<long>, map array<long>, token long, df long"
)


def _repeated(sets: list[np.ndarray]) -> pa.RecordBatch:
    token, df = np.unique(np.concatenate(sets), return_counts=True)
    often = df >= 2
    k = int(often.sum())
    longs, lists = [pa.nulls(k, pa.int64())] * 5, [pa.nulls(k, pa.list_(pa.int64()))] * 2
    counted = [pa.array(token[often].view(np.int64)), pa.array(df[often].astype(np.int64))]
    return pa.RecordBatch.from_arrays([*longs, *lists, *counted], [x.split()[0] for x in DESCRIBED.split(", ")])


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text"):
                sets = shingle_sets(data, offsets, width)
                held += sets
                n += sum(map(len, sets))
                if n >= COUNTED:
                    yield _repeated(held)
                    held, n = [], 0
                signs = [signature(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        rows.column("mark"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *[pa.array([s[k] for s in signs], pa.int64()) for k in (0, 1)],
                        pa.array([bands(s) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                        pa.array([parity_map(s) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                        *[pa.nulls(len(sets), pa.int64())] * 2,
                    ],
                    [x.split()[0] for x in DESCRIBED.split(", ")],
                )
        if held:
            yield _repeated(held)

    return run


def _own_sets(rows: pa.RecordBatch, column: str, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part, data, offsets in pieces(rows, column):
        yield part, shingle_sets(data, offsets, width)


def _real(part: pa.RecordBatch, sets: list[np.ndarray], met: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of the rows whose set is that of their class (texts of one doc_id may share a mark) and whose class
    isn't in `met` yet."""
    node, s0, s1 = (part.column(c).to_pylist() for c in ("node", "s0", "s1"))
    for i, s in enumerate(sets):
        if len(s) and node[i] not in met and signature(s) == (s0[i], s1[i]):
            met.add(node[i])
            yield i, s


class _Join:
    """The classes of one corpus and the steps that compare them."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int, frequent: np.ndarray):
        self.docs, self.classes, self.width, self.t = docs, classes, width, percent
        self.frequent = docs.sparkSession.sparkContext.broadcast(frequent)

    def texts(self, nodes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        """Rows with the texts of `nodes` (node and the columns `carry`, one row for each class); not yet told apart by
        _real. A few nodes are broadcast to the texts, so that these aren't shuffled."""
        wanted = nodes.join(self.classes.select("node", "doc_id", "mark", "s0", "s1"), "node")
        wanted = materialize(wanted.select("node", "doc_id", "mark", "s0", "s1", *carry), "wanted")
        texts = self.docs.select("doc_id", text_mark(F.col("text")).alias("mark"), "text")  # rows of one id are many, of one text few
        return texts.join(checked(wanted), ["doc_id", "mark"]).select("node", "s0", "s1", *carry, "text")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """a, b, both: the number of common tokens of each pair of classes, counted on their texts."""
        width, ends = self.width, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: set[int] = set()
            for batch in batches:
                for part, sets in _own_sets(batch, "text", width):
                    kept = pa.array([i for i, _ in _real(part, sets, met)], pa.int64())
                    yield part.select(["node", "text"]).take(kept)

        texts = materialize(in_arrow(self.texts(ends), once, "node long, text string").repartition("node").dropDuplicates(["node"]), "texts")
        own = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, left in _own_sets(batch, "text_a", width):
                    right = [s for _, some in _own_sets(part, "text_b", width) for s in some]
                    both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(both, pa.int64())], ["a", "b", "both"])

        return in_arrow(pairs.select("a", "b").join(own("a"), "a").join(own("b"), "b"), count, "a long, b long, both long")

    def linked(self) -> Column:
        """Whether a pair with n_a, n_b and both is at or above the threshold."""
        return (100 + self.t) * F.col("both") >= self.t * (F.col("n_a") + F.col("n_b"))

    def possible(self, pairs: DataFrame, room: Column | None = None, least: Column | None = None) -> DataFrame:
        """`pairs` (a, b, ...) with n_a and n_b, without those whose parity maps rule out a link: of a and b, or, with
        `room` more common tokens and a sum of sizes of `least`, of what they stand for. Maps whose lengths are more
        than one doubling apart aren't compared."""
        own = lambda x: self.classes.select(F.col("node").alias(x), F.col("map").alias(f"map_{x}"), F.col("n_shingles").alias(f"n_{x}"))
        p, q = _fold(F.col("map_a"), F.col("map_b")), _fold(F.col("map_b"), F.col("map_a"))
        off = F.aggregate(F.zip_with(p, q, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda s, c: s + c)
        sizes = F.col("n_a") + F.col("n_b")
        twice = sizes - off + 2 * (F.lit(0) if room is None else room)  # the most common tokens, twice
        fits = (F.size(p) != F.size(q)) | ((100 + self.t) * twice >= 2 * self.t * (sizes if least is None else least))
        return pairs.join(own("a"), "a").join(own("b"), "b").where(fits).drop("map_a", "map_b")

    def leader_links(self) -> DataFrame:
        """node, leader, extra: the links of a class with leaders of its bands, and the number of tokens that it has and
        the leader has not. Each band has a few leaders, so these grow with the classes alone."""
        banded = self.classes.select("node", F.posexplode("bands").alias("band", "value"))
        shared = banded.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
        banded = materialize(banded.join(materialize(shared, "shared"), ["band", "value"]), "bands")
        # the set that shares its bands with most others lies in the middle of its group: it links with more than others do
        known = materialize(banded.groupBy("node").agg(F.sum("n").alias("known")), "known")
        first = F.max(F.struct(F.col("known"), F.xxhash64("node").alias("rank"), F.col("node").alias("leader")))
        others = [F.max(F.struct(F.xxhash64(F.col("node"), F.lit(i)).alias("rank"), F.col("node").alias("leader"))) for i in range(1, LEADERS)]
        heads = banded.join(known, "node").groupBy("band", "value").agg(F.array(*[x["leader"] for x in (first, *others)]).alias("leaders"))
        led = banded.join(materialize(heads, "leaders"), ["band", "value"]).select("node", F.explode(F.array_distinct("leaders")).alias("leader"))
        low, high = F.least("node", "leader"), F.greatest("node", "leader")
        pairs = (
            led.where("node <> leader").groupBy(low.alias("a"), high.alias("b"))
            .agg(F.max(F.col("leader") == low).alias("a_leads"), F.max(F.col("leader") == high).alias("b_leads"))
        )
        pairs = materialize(self.possible(materialize(pairs, "leader-pairs")), "possible")
        found = pairs.join(self.compared(pairs), ["a", "b"]).where(self.linked())
        side = lambda own, other: F.struct(F.col(own).alias("node"), F.col(other).alias("leader"), (F.col(f"n_{own}") - F.col("both")).alias("extra"))
        both = F.array(F.when(F.col("b_leads"), side("a", "b")), F.when(F.col("a_leads"), side("b", "a")))
        return materialize(found.select(F.inline(F.filter(both, lambda x: x.isNotNull()))), "leader-links")

    def groups(self) -> DataFrame:
        """node, n_shingles, grp, extra, comp for every class: its group, named after the leader, what it has beyond
        the leader, and the component of linked groups."""
        links = self.leader_links()
        chosen = links.groupBy("node").agg(F.min(F.struct("leader", "extra")).alias("x"))
        chosen = materialize(chosen.select("node", F.col("x.leader").alias("grp"), F.col("x.extra").alias("extra")), "chosen")
        own = chosen.select("node", "grp")
        # of a member its group is linked with its other leaders; of a leader the group it leads with the one it is in
        edges = links.join(own, "node").select(F.col("grp").alias("a"), F.col("leader").alias("b"))
        heads = chosen.select(F.col("grp").alias("node")).distinct().join(own, "node").select(F.col("node").alias("a"), F.col("grp").alias("b"))
        found = connected_components(edges.unionByName(heads).distinct())
        whole = self.classes.select("node", "n_shingles").join(chosen, "node", "left").select(
            "node", "n_shingles", F.coalesce("grp", "node").alias("grp"), F.coalesce("extra", F.lit(0).cast("long")).alias("extra")
        )
        found = found.withColumnRenamed("node", "grp")
        return materialize(whole.join(found, "grp", "left").withColumn("comp", F.coalesce("component", "grp")).drop("component"), "groups")

    def met(self, groups: DataFrame) -> DataFrame:
        """p, q: the groups of different components that meet in a list of the index and whose bounds fit.

        A list of very many groups would make pairs with the square of their number. So the lists are counted, and the
        tokens of long ones go to the end of the common order, until no list is long or that end is full; the last index
        is joined. Which tokens go there changes the work, never the answer.
        """
        index = self.index(groups)
        for _ in range(ORDERS):
            long = index.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LONG_LIST)
            room = MAX_FREQUENT - len(self.frequent.value)
            found = long.orderBy(F.col("n").desc(), "token").limit(room).select("token").toArrow().column("token").to_numpy().view(np.uint64)
            found = np.setdiff1d(found, self.frequent.value)
            if not len(found):
                break
            frequent = np.union1d(self.frequent.value, found)
            self.frequent.destroy()
            self.frequent = self.docs.sparkSession.sparkContext.broadcast(frequent)
            old, index = index, self.index(groups)
            remove_folder(self.docs.sparkSession, os.path.dirname(old.inputFiles()[0]))  # the last index alone is joined
        t = self.t
        x, y = index.alias("x"), index.alias("y")
        fits = (
            (F.col("x.comp") < F.col("y.comp"))
            & (100 * F.col("x.high") >= t * F.col("y.low"))
            & (100 * F.col("y.high") >= t * F.col("x.low"))
            # the tokens of one list entry and those after it bound the intersection
            & ((100 + t) * F.least("x.rest", "y.rest") >= t * (F.col("x.low") + F.col("y.low")))
        )
        pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & fits).select(F.col("x.grp").alias("p"), F.col("y.grp").alias("q"))
        return materialize(pairs.distinct(), "met")

    def index(self, groups: DataFrame) -> DataFrame:
        """token, grp, comp, low, high, rest: the blocks of the index under the order of tokens as it is, written."""
        width, t, frequent = self.width, self.t, self.frequent

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(token, grp, comp, low, high, rest): of one group's sets in a list, the sizes and the most tokens from there on."""
            met: set[int] = set()
            held: tuple[list, ...] = ([], [], [], [], [])
            for batch in batches:
                for part, sets in _own_sets(batch, "text", width):
                    token, grp, comp, size, rest = held
                    g, c = part.column("grp").to_pylist(), part.column("comp").to_pylist()
                    for i, s in _real(part, sets, met):
                        p = prefix_of(s, frequent.value, t)
                        token.append(p)
                        grp.append(np.full(len(p), g[i]))
                        comp.append(np.full(len(p), c[i]))
                        size.append(np.full(len(p), len(s)))
                        rest.append(len(s) - np.arange(len(p)))
                    if sum(map(len, token)) >= INDEXED:
                        yield joined(*held)
                        held = ([], [], [], [], [])
            if held[0]:
                yield joined(*held)

        def joined(*held: list) -> pa.RecordBatch:
            token, grp, comp, size, rest = (np.concatenate(x) for x in held)
            order = np.lexsort((grp, token))
            token, grp, comp, size, rest = (x[order] for x in (token, grp, comp, size, rest))
            new = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (grp[1:] != grp[:-1])]))
            return pa.RecordBatch.from_arrays(
                [pa.array(token[new].view(np.int64)), pa.array(grp[new]), pa.array(comp[new]),
                 pa.array(np.minimum.reduceat(size, new).astype(np.int32)), pa.array(np.maximum.reduceat(size, new).astype(np.int32)),
                 pa.array(np.maximum.reduceat(rest, new).astype(np.int32))],
                ["token", "grp", "comp", "low", "high", "rest"],
            )

        return materialize(in_arrow(self.texts(groups, ("grp", "comp")), blocks, "token long, grp long, comp long, low int, high int, rest int"), "index")

    def member_links(self, groups: DataFrame, open_pairs: DataFrame) -> DataFrame:
        """p, q: of the pairs of groups in `open_pairs` those of which some members link."""
        width, t, frequent = self.width, self.t, self.frequent
        some = groups.join(open_pairs.select(F.explode(F.array("p", "q")).alias("grp")).distinct(), "grp", "left_semi")

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(token, grp, comp, node, size, rest) and the sketch for every set and token of its prefix."""
            met: set[int] = set()
            for batch in batches:
                for part, sets in _own_sets(batch, "text", width):
                    own = [np.array(part.column(c).to_pylist(), dtype=np.int64) for c in ("grp", "comp", "node")]
                    token, rows, rest = [], [], []
                    maps, size = np.zeros((len(sets), len(SKETCH)), dtype=np.int64), np.array([len(s) for s in sets], dtype=np.int32)
                    for i, s in _real(part, sets, met):
                        p = prefix_of(s, frequent.value, t)
                        maps[i] = sketch(s)
                        token.append(p.view(np.int64))
                        rows.append(np.full(len(p), i))
                        rest.append(len(s) - np.arange(len(p)))
                    if token:
                        rows = np.concatenate(rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.concatenate(token)), *[pa.array(c[rows]) for c in own], pa.array(size[rows]),
                             pa.array(np.concatenate(rest).astype(np.int32)), *[pa.array(maps[rows, k]) for k in range(len(SKETCH))]],
                            ["token", "grp", "comp", "node", "size", "rest", *SKETCH],
                        )

        shape = "token long, grp long, comp long, node long, size int, rest int, " + ", ".join(f"{k} long" for k in SKETCH)
        lists = materialize(in_arrow(self.texts(some, ("grp", "comp")), entries, shape), "lists")
        x, y = lists.alias("x"), lists.alias("y")
        off = sum((F.bit_count(F.col(f"x.{k}").bitwiseXOR(F.col(f"y.{k}"))) for k in SKETCH), F.lit(0))
        sizes = F.col("x.size") + F.col("y.size")
        fits = (
            (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") < F.col("y.comp"))
            & (100 * F.least("x.size", "y.size") >= t * F.greatest("x.size", "y.size"))
            & ((100 + t) * F.least("x.rest", "y.rest") >= t * sizes)
            & ((100 + t) * off <= (100 - t) * sizes)
        )
        ends = (F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.grp").alias("p"), F.col("y.grp").alias("q"))
        pairs = materialize(x.join(y, fits).select(*ends).distinct(), "member-pairs").join(open_pairs, ["p", "q"], "left_semi")
        pairs = materialize(self.possible(pairs), "possible")
        return materialize(pairs.join(self.compared(pairs), ["a", "b"]).where(self.linked()).select("p", "q").distinct(), "member-links")

    def components(self) -> DataFrame:
        """node, comp for every class."""
        groups = self.groups()
        bounds = groups.groupBy("grp").agg(F.min("n_shingles").alias("low"), F.max("extra").alias("extra"), F.first("comp").alias("comp"))
        bounds = materialize(bounds, "bounds")
        own = lambda x: bounds.select(F.col("grp").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("low", "extra", "comp")])
        pairs = self.met(groups).join(own("p"), "p").join(own("q"), "q")
        # a group is named after its leader: its answer is computed, those of the members derived from it
        room, least = F.col("extra_p") + F.col("extra_q"), F.col("low_p") + F.col("low_q")
        pairs = pairs.withColumns({"a": F.col("p"), "b": F.col("q")})
        pairs = materialize(self.possible(pairs, room, least), "leaders-met")
        known = materialize(pairs.join(self.compared(pairs), ["a", "b"]).withColumn("linked", self.linked()), "leaders-compared")
        links = known.where("linked").select(F.col("comp_p").alias("a"), F.col("comp_q").alias("b"))
        left = known.where(~F.col("linked") & ((100 + self.t) * (F.col("both") + room) >= self.t * least))
        left = left.select("p", "q", "comp_p", "comp_q")
        if not left.isEmpty():
            # pairs whose groups other links join need no look at their members
            joined = connected_components(links)
            end = lambda x: joined.select(F.col("node").alias(f"comp_{x}"), F.col("component").alias(f"end_{x}"))
            left = left.join(end("p"), "comp_p", "left").join(end("q"), "comp_q", "left")
            apart = ~F.coalesce("end_p", "comp_p").eqNullSafe(F.coalesce("end_q", "comp_q"))
            left = materialize(left.where(apart).select("p", "q", "comp_p", "comp_q"), "open")
            more = left.join(self.member_links(groups, left.select("p", "q")), ["p", "q"])
            links = links.unionByName(more.select(F.col("comp_p").alias("a"), F.col("comp_q").alias("b")))
        ends = connected_components(links).withColumnRenamed("node", "comp")
        return groups.select("node", "comp").join(ends, "comp", "left").select("node", F.coalesce("component", "comp").alias("comp"))


def _frequent(told: DataFrame) -> np.ndarray:
    """The most frequent of the counted tokens, sorted, MAX_FREQUENT at most: those above a count, which comes from a
    histogram by eighths of a power of two."""
    counts = materialize(told.where("token is not null").groupBy("token").agg(F.sum("df").alias("df")), "repeated")
    level = F.floor(F.log2("df") * 8)
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # 504 rows at most
    total, least = 0, None
    for r in sizes:
        total += r["n"]
        if total > MAX_FREQUENT:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, dtype=np.uint64)
    return np.sort(counts.where(level >= least).select("token").toArrow().column("token").to_numpy().view(np.uint64))


def _classified(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows doc_id, mark, n_shingles, s0, s1 of `docs` (doc_id, text), and their classes s0, s1, class_id, comp,
    least (the smallest doc_id of the component with the least mark of its texts)."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is from 1 to 100")
    told = materialize(in_arrow(docs.withColumn("mark", text_mark(F.col("text"))), _describe(width), DESCRIBED), "described")
    classes = (
        told.where("s0 is not null").groupBy("s0", "s1")
        .agg(F.min(F.struct("doc_id", "mark")).alias("head"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "map")])
        .select(F.monotonically_increasing_id().alias("node"), "s0", "s1", "head", F.col("head.doc_id").alias("doc_id"), F.col("head.mark").alias("mark"), "n_shingles", "bands", "map")
    )
    classes = materialize(classes, "classes")
    join = _Join(docs, classes, width, percent, _frequent(told))
    ends = materialize(join.components(), "components")
    join.frequent.destroy()
    named = materialize(classes.select("node", "s0", "s1", "head").join(ends, "node"), "named")
    least = materialize(named.groupBy("comp").agg(F.min("head").alias("least")), "heads")
    named = named.join(least, "comp").select("s0", "s1", F.col("head.doc_id").alias("class_id"), "comp", "least")
    own = told.where("n_shingles is not null").select("doc_id", "mark", "n_shingles", "s0", "s1")
    return own, materialize(named, "named")


def _keyed(docs: DataFrame) -> tuple[DataFrame, Column]:
    """doc_id as a number (a null one as the largest, which is returned too) and text."""
    last = F.lit((1 << 63) - 1)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("doc_id"), "text"), last


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for every row of `docs` (doc_id, text).

    A document's set holds its distinct runs of `width` words (A-Z lower-cased); with fewer words, all of them as one.
    Two documents are linked where 100 * |intersection| >= percent * |union|. n_shingles is the size of the set,
    class_id the smallest doc_id with an equal set, component_id the smallest doc_id that links lead to. A null or
    empty text, or one of blanks, has an empty set and is linked with nothing: both ids are its own. Repeated rows are
    in one class, rows of one doc_id with different texts in the classes of their texts; a null doc_id counts as larger
    than any other. An empty table gives an empty result. Other columns are ignored.
    """
    keyed, last = _keyed(docs)
    own, named = _classified(keyed, width, percent)
    shown = lambda x: F.nullif(F.coalesce(x, F.col("doc_id")), last)
    return own.join(named, ["s0", "s1"], "left").select(
        shown(F.col("doc_id")).alias("doc_id"),
        "n_shingles",
        shown(F.col("class_id")).alias("class_id"),
        shown(F.col("least.doc_id")).alias("component_id"),
    )


def keep_representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) that represent their component: of each the row with the smallest doc_id
    (a null one is the largest), and among rows of that id with different texts the one whose text has the least hash.

    Rows are told apart by id and text: another row of a dropped row's id stays if it stands for a component of its own.
    Rows repeated whole stay or go together. A null or empty text, or one of blanks, is a component of its own and
    stays. An empty table gives an empty result. All columns are kept as they are, whatever their names.
    """
    keyed, last = _keyed(docs)
    own, named = _classified(keyed, width, percent)
    here = F.struct(F.col("doc_id"), F.col("mark"))
    gone = own.join(named, ["s0", "s1"]).where(here != F.col("least"))
    return drop_rows(docs, gone.select(F.nullif("doc_id", last).alias("doc_id"), "mark"))
