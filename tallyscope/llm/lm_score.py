"""Cross-entropy difference: how much better a target-domain model codes a text than a background model.

Two word bigram models of the same order, smoothing and vocabulary are counted over the whole corpus, one from the
target texts and one from all texts. The vocabulary is every word of the corpus, so the models grow with it and are
never gathered: the bigrams of the texts are dealt by their second word into buckets of bounded size, and a bucket
counts its words and bigrams and adds up the bits of each text in the same pass. Words too frequent for one bucket are
dealt by bigram, and bigrams too frequent by text; the counts of these few, fewer than a bound, travel to the tasks.

Texts travel as pieces, some MB of them at once: a bucket gets one block of a piece, in which a text is a place, and
returns one block of sums. What is shuffled is linear in the number of words; the sums are at most one for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import SMALL, checked, in_arrow, materialize
from tallyscope.llm.wordhash import BASE, Words, mix, pieces

#: Weight of the unigram model in the bigram estimate, in pseudo-counts (Dirichlet smoothing).
PRIOR = 200.0
#: Bigrams of a bucket, on average; there are as many buckets as the corpus needs.
BUCKET = 1 << 20
#: A word that is an eighth of a bucket is dealt by bigram, a bigram that is half of one by text; in a large corpus only
#: those of so large a share of all words, which bounds their number.
HOT_WORD, HOT_PAIR = 1 / (1 << 16), 1 / (1 << 14)
#: Bytes of text whose bigrams are dealt at once.
DEALT = 4 << 20

UNKNOWN, BEGIN = 0, 1
#: Bytes of the hash of a bigram that travel: it is compared only with the other bigrams of its second word.
PAIR_BYTES = 6
#: Flags of an entry: its text is a target; its word is the last of the text; the first; its bigram is a frequent one.
AIM, LAST, FIRST, HOT = 1, 2, 4, 8
COUNTS = ("n", "n_target", "n_last", "n_target_last")
#: A block of a piece: the piece, the keys of its texts (with one block of each piece), entries or sums.
BLOCK = ("piece", "keys", "block")
DEALT_AS = pa.schema([("bucket", pa.int32()), ("piece", pa.int64()), ("keys", pa.binary()), ("block", pa.binary())])
SUMS = ["key", "n", "target", "background"]


def coded(found: Words, vocab: np.ndarray | None) -> np.ndarray:
    """The hashes of the words; UNKNOWN for words outside `vocab`, if there is one."""
    words = found.hashes()
    if vocab is None:
        return words
    return np.where(np.isin(words, vocab), words, np.uint64(UNKNOWN))


def flags_of(found: Words, aim: np.ndarray) -> np.ndarray:
    """AIM and LAST of every word."""
    flags = np.where(aim[found.doc] == 1, AIM, 0).astype(np.uint8)
    flags[found.first[1:][found.first[:-1] < found.first[1:]] - 1] |= LAST
    return flags


def tally(values: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, the place of each value among them, and COUNTS (rows) of each."""
    own, place = np.unique(values, return_inverse=True)
    aim, last = flags & AIM != 0, flags & LAST != 0
    chosen = (place, place[aim], place[last], place[aim & last])
    return own, place, np.stack([np.bincount(x, minlength=len(own)) for x in chosen])


def pairs_of(previous: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each bigram."""
    return mix(mix(word) + previous * np.uint64(BASE))


def previous_of(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each; BEGIN for the first of a text."""
    previous = np.empty_like(word)
    previous[1:] = word[:-1]
    previous[first[:-1][first[:-1] < first[1:]]] = BEGIN
    return previous


def piece_of(key: np.ndarray) -> int:
    """A 64-bit hash of the keys of a piece in their order. Pieces of equal keys are repeats, and may be added up as one."""
    turn = np.arange(len(key), dtype=np.uint64) * np.uint64(BASE)
    return int(mix(np.add.reduce(mix(key.view(np.uint64) + turn), keepdims=True)).view(np.int64)[0])


def place_type(n_docs: int) -> type:
    """The narrowest type for a place among so many texts."""
    return np.uint16 if n_docs <= 1 << 16 else np.uint32


def pack(word: np.ndarray, pair: np.ndarray, place: np.ndarray, flags: np.ndarray, n_docs: int) -> bytes:
    """Entries sorted by word: each word once, the place of the text in its piece, and PAIR_BYTES of a bigram's hash."""
    words, runs = np.unique(word, return_counts=True)
    low = np.ascontiguousarray(pair).view(np.uint8).reshape(-1, 8)[:, :PAIR_BYTES]
    parts = (np.array([n_docs, len(word), len(words)], np.int32), words, runs.astype(np.int32), place.astype(place_type(n_docs)), low, flags)
    return b"".join(x.tobytes() for x in parts)


def parts_of(held: bytes, at: int, kinds: list[tuple[type, int]]) -> list[np.ndarray]:
    """The arrays of these types and lengths that stand one after another from byte `at`."""
    out = []
    for kind, count in kinds:
        out.append(np.frombuffer(held, kind, count, at))
        at += out[-1].nbytes
    return out


def unpack(held: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts of the piece, word, low bytes of the bigram, place, flags) of the entries that `pack` was given."""
    n_docs, n, n_words = np.frombuffer(held, np.int32, 3).tolist()
    kinds = [(np.uint64, n_words), (np.int32, n_words), (place_type(n_docs), n), (np.uint8, n * PAIR_BYTES), (np.uint8, n)]
    words, runs, place, low, flags = parts_of(held, 12, kinds)
    pair = np.zeros((n, 8), dtype=np.uint8)
    pair[:, :PAIR_BYTES] = low.reshape(n, PAIR_BYTES)
    return n_docs, np.repeat(words, runs), pair.view(np.uint64).ravel(), place, flags


def pack_sums(n_docs: int, place: np.ndarray, n: np.ndarray, target: np.ndarray, background: np.ndarray) -> bytes:
    """Words and bits of the texts at these places of a piece, bits as 32-bit floats."""
    parts = (np.array([n_docs, len(place)], np.int32), place.astype(place_type(n_docs)), n.astype(np.int32))
    return b"".join(x.tobytes() for x in (*parts, target.astype(np.float32), background.astype(np.float32)))


def unpack_sums(held: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What `pack_sums` was given."""
    n_docs, n = np.frombuffer(held, np.int32, 2).tolist()
    return n_docs, *parts_of(held, 8, [(place_type(n_docs), n), (np.int32, n), (np.float32, n), (np.float32, n)])


def low_bytes(pair: np.ndarray) -> np.ndarray:
    """The part of a bigram's hash that travels."""
    return pair & np.uint64((1 << 8 * PAIR_BYTES) - 1)


def listed(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column, sorted, and COUNTS (rows) of each."""
    own = table.column(column).to_numpy().view(np.uint64)
    order = np.argsort(own)
    return own[order], np.stack([table.column(c).to_numpy()[order] for c in COUNTS])


def found_in(listed: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is listed, and where."""
    if len(listed) == 0:
        return np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=np.int64)
    at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
    return listed[at] == values, at


def bits_of(pair: np.ndarray, word: np.ndarray, total: int, width: int) -> np.ndarray:
    """The part of a bigram's bits that depends on its second word."""
    return -np.log2(pair + PRIOR * (word + 1.0) / (total + width))


def top_words(words: DataFrame, size: int) -> np.ndarray:
    """The hashes of the `size` most frequent words, sorted; ties by hash."""
    top = words.orderBy(F.desc("n"), "word").limit(size).toArrow()
    return np.sort(top.column("word").to_numpy().view(np.uint64))


def score_documents(docs: DataFrame, target_ids: DataFrame, vocab_size: int | None = None) -> DataFrame:
    """doc_id, n_words, ce_target, ce_background, score for every row of `docs` (doc_id, text).

    The target model learns from the documents whose id is in `target_ids` (doc_id; repeats count once), the background
    model from all. ce_* are bits for each word, score their difference: the lower, the closer to the target. Without
    words all three are 0; null counts as empty; with no target documents the target model is uniform over the
    vocabulary; repeated rows are scored alike and count as often as they stand; an empty table gives an empty result.
    With `vocab_size` only the most frequent words are told apart, the others count as one. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    ids = target_ids.where("doc_id is not null").select("doc_id").distinct().withColumn("aim", F.lit(1))
    ids = materialize(ids, "targets")
    n_ids = ids.count()
    aimed = docs.join(checked(ids, n_ids), "doc_id", "left").select("key", "text", F.coalesce("aim", F.lit(0)).alias("aim"))
    if n_ids > SMALL:  # the texts are read three times, but shuffled once
        aimed = materialize(aimed, "aimed")
    context = docs.sparkSession.sparkContext

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text", DEALT):
                found = Words(data, offsets)
                if len(found.start):
                    word, _, counts = tally(found.hashes(), flags_of(found, rows.column("aim").to_numpy()))
                    yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), *map(pa.array, counts)], ["word", *COUNTS])

    counted = in_arrow(aimed, count_words, "word long, " + ", ".join(f"{c} long" for c in COUNTS))
    words = materialize(counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS]), "words")
    size, *sums = words.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in COUNTS]).first()
    vocab = top_words(words, vocab_size) if vocab_size is not None else None
    width = (size if vocab is None else len(vocab)) + 2
    if vocab is not None:
        top = docs.sparkSession.createDataFrame(pa.table({"word": vocab.view(np.int64), "known": np.ones(len(vocab), bool)}))
        known = words.join(top, "word", "left").withColumn("word", F.when(F.col("known"), F.col("word")).otherwise(F.lit(UNKNOWN)))
        words = known.groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS])
    total, buckets = sums[0], sums[0] // BUCKET + 1
    word_from, pair_from = max(2, BUCKET // 8, int(total * HOT_WORD)), max(2, BUCKET // 2, int(total * HOT_PAIR))
    hot_words = listed(words.where(F.col("n") >= word_from).toArrow(), "word")
    often = hot_words[0][hot_words[1][0] >= pair_from]
    likely = context.broadcast((np.append(often, np.uint64(BEGIN)), vocab))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, vocab = likely.value
        often = np.sort(often)
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text", DEALT):
                found = Words(data, offsets)
                word = coded(found, vocab)
                previous = previous_of(word, found.first)
                both = found_in(often, word)[0] & found_in(often, previous)[0]
                if both.any():
                    flags = flags_of(found, rows.column("aim").to_numpy())
                    pair, _, counts = tally(pairs_of(previous, word)[both], flags[both])
                    yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), *map(pa.array, counts)], ["pair", *COUNTS])

    pairs = in_arrow(aimed, count_pairs, "pair long, " + ", ".join(f"{c} long" for c in COUNTS))
    pairs = pairs.groupBy("pair").agg(*[F.sum(c).alias(c) for c in COUNTS]).where(F.col("n") >= pair_from)
    hot_pairs = listed((pairs if len(often) else pairs.limit(0)).toArrow(), "pair")
    shared = context.broadcast((hot_words, hot_pairs, vocab))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text", DEALT):
                found = Words(data, offsets)
                if len(found.start) == 0:
                    continue
                hot_words, hot_pairs, vocab = shared.value
                word = coded(found, vocab)
                previous, flags = previous_of(word, found.first), flags_of(found, rows.column("aim").to_numpy())
                pair, key = pairs_of(previous, word), rows.column("key").to_numpy()
                hot = found_in(hot_pairs[0], pair)[0]
                flags[previous == BEGIN] |= FIRST
                flags[hot] |= HOT
                route = np.where(found_in(hot_words[0], word)[0], pair, word)
                route = mix(np.where(hot, key[found.doc].view(np.uint64), route))
                bucket = (route % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((word, bucket))
                own, first = np.unique(bucket[order], return_index=True)
                held = [pack(word[x], pair[x], found.doc[x], flags[x], len(key)) for x in np.split(order, first[1:])]
                piece = pa.array(np.full(len(own), piece_of(key)))
                keys = pa.array([key.tobytes(), *[None] * (len(own) - 1)], pa.binary())  # with one of the blocks
                yield pa.RecordBatch.from_arrays([pa.array(own), piece, keys, pa.array(held, pa.binary())], ["bucket", *BLOCK])

    def weigh(held: list[bytes]) -> list[bytes]:
        n_docs, *columns = zip(*map(unpack, held), strict=True)
        block = np.repeat(np.arange(len(held), dtype=np.int64) << 32, [len(x) for x in columns[0]])
        word, low, place, flags = (np.concatenate(x) for x in columns)
        text, at_text = np.unique(block + place, return_inverse=True)
        hot_words, hot_pairs, _ = shared.value
        own, place, here = tally(word, flags)
        known, at = found_in(hot_words[0], own)
        here[:, known] = hot_words[1][:, at[known]]
        counts = here[:, place]
        # a bigram is told from the others of its word by the bytes that travel
        own, place, here = tally(mix(word) + low, flags)
        some = np.zeros(len(own), dtype=np.int64)
        some[place] = np.arange(len(place))
        some = some[known := flags[some] & HOT != 0]
        order = np.argsort(low_bytes(hot_pairs[0]))
        here[:, known] = hot_pairs[1][:, order[np.searchsorted(low_bytes(hot_pairs[0])[order], low[some])]]
        pair = here[:, place]
        goes_on, begins = flags & LAST == 0, flags & FIRST != 0
        found = [np.bincount(at_text)]
        for model in (1, 0):
            bits = bits_of(pair[model], counts[model], sums[model], width)
            # the weight of a word that another follows, and of the beginning
            bits += np.where(goes_on, np.log2(counts[model] - counts[model + 2] + PRIOR), 0.0)
            bits += np.where(begins, np.log2(sums[model + 2] + PRIOR), 0.0)
            found.append(np.bincount(at_text, bits))
        ends = np.searchsorted(text, np.arange(1, len(held), dtype=np.int64) << 32)
        found = zip(*(np.split(x, ends) for x in (text & 0xFFFFFFFF, *found)), strict=True)
        return [pack_sums(n, *x) for n, x in zip(n_docs, found, strict=True)]

    def weigh_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = pa.Table.from_batches(batches, DEALT_AS).drop_columns("bucket")
        if blocks.num_rows:
            found = pa.array(weigh(blocks.column("block").to_pylist()), pa.binary())
            yield from blocks.set_column(2, "block", found).combine_chunks().to_batches()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = keys = found = None
        for batch in batches:
            for piece, own, block in zip(*(batch.column(c).to_pylist() for c in BLOCK), strict=True):
                if piece != last and last is not None:
                    yield pa.RecordBatch.from_arrays([keys, *map(pa.array, found)], SUMS)
                n_docs, place, *columns = unpack_sums(block)
                if piece != last:
                    last, found = piece, (np.zeros(n_docs, np.int64), np.zeros(n_docs), np.zeros(n_docs))
                if own is not None:
                    keys = pa.array(np.frombuffer(own, np.int64))
                for total, column in zip(found, columns, strict=True):
                    total[place] += column
        if last is not None:
            yield pa.RecordBatch.from_arrays([keys, *map(pa.array, found)], SUMS)

    kinds = ", ".join(f"{c} {t}" for c, t in zip(BLOCK, ("long", "binary", "binary"), strict=True))
    dealt = in_arrow(aimed, deal, "bucket int, " + kinds).repartitionById(buckets, F.col("bucket"))
    weighed = in_arrow(dealt, weigh_bucket, kinds).repartition("piece").sortWithinPartitions("piece")
    found = in_arrow(weighed, add_up, "key long, n long, target double, background double")
    found = found.groupBy("key").agg(*[F.sum(c).alias(c) for c in SUMS[1:]])
    # rows of one key are repeats: their bits and words are in the sums as often as they stand
    rows = docs.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.first("doc_id").alias("doc_id"))
    rows = rows.join(found, "key", "left").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    mean = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0))
    return rows.select(
        "doc_id",
        F.coalesce((F.col("n") / F.col("times")).cast("long"), F.lit(0).cast("long")).alias("n_words"),
        mean("target").alias("ce_target"),
        mean("background").alias("ce_background"),
        (mean("target") - mean("background")).alias("score"),
    )
