"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicons are learned from the labelled texts: words and word beginnings whose documents are mostly marked toxic,
beside a short list of insults. The features of a text are densities of lexicon hits, their closeness to the second
person, and rates of capitals, punctuation and obfuscated words; Spark ML fits the trees and the calibration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import id_remainder, in_arrow, materialize
from tallyscope.llm.wordhash import LETTERS, Words, hash_words, per_doc, pieces

#: Labelled texts that the lexicons, the trees and the calibration learn from, about; drawn by a hash of the id.
MAX_TRAIN_DOCS = 20_000
#: A lexicon entry stands in so many training texts at least, of which so large a share is toxic.
MIN_DOCS, MIN_SHARE = 6, 0.7
#: Lengths in bytes of the word beginnings; 0 stands for whole words.
KINDS = (0, 4, 5, 6)
#: Largest lexicon of a kind; the entries with most toxic texts stay.
MAX_ENTRIES = 20_000

INSULTS = (
    "idiot idiots moron morons imbecile stupid dumb dumbass loser losers scum trash garbage worthless pathetic "
    "disgusting filthy vermin clown pig pigs creep freak retard retarded bastard bitch whore slut asshole shit "
    "fuck fucking crap damn hate kill die ugly"
).split()
SECOND_PERSON = (
    "you your yours yourself du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes "
    "tú ti tuyo vosotros vuestro"
).split()

FEATURES = [
    *[f"learned_{k}" for k in KINDS], *[f"learned_{k}_per_100" for k in KINDS], "insults", "insults_per_100",
    "near_second_person", "second_person_per_100", "capitals", "shouted", "punctuation", "exclamations",
    "obfuscated_per_100", "log_words",
]

CAPITAL = np.zeros(256, dtype=bool)
CAPITAL[ord("A") : ord("Z") + 1] = True
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[i for i in range(0x21, 0x7F) if not chr(i).isalnum()]] = True
EXCLAIM = np.zeros(256, dtype=bool)
EXCLAIM[[ord("!"), ord("?")]] = True
#: Signs that stand for letters in hidden insults.
MASK = np.zeros(256, dtype=bool)
MASK[[ord(c) for c in "*@$#0134579"]] = True


def _member(values: np.ndarray, entries: np.ndarray) -> np.ndarray:
    if len(entries) == 0:
        return np.zeros(len(values), dtype=bool)
    return entries[np.minimum(np.searchsorted(entries, values), len(entries) - 1)] == values


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, term, n, toxic): in how many texts of the batch, toxic or not, a word or word beginning stands."""
    for batch in batches:
        for rows, data, offsets in pieces(batch, "text"):
            words = Words(data, offsets, LETTERS)
            marks = rows.column("toxic").to_numpy()
            for kind in KINDS:
                long = words.end - words.start >= max(kind, 3)
                term = words.hashes(kind or None).view(np.int64)[long]
                both = np.unique(np.stack([words.doc[long], term], 1), axis=0) if len(term) else np.zeros((0, 2), np.int64)
                found, at = np.unique(both[:, 1], return_inverse=True)
                n, toxic = np.bincount(at, minlength=len(found)), np.bincount(at, weights=marks[both[:, 0]], minlength=len(found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), kind)), pa.array(found), pa.array(n.astype(np.int64)), pa.array(toxic.astype(np.int64))],
                    ["kind", "term", "n", "toxic"],
                )


def learn_lexicons(labelled: DataFrame) -> dict[int, np.ndarray]:
    """Sorted hashes of the entries of each kind, from `labelled` (text, toxic); equal texts count once."""
    texts = labelled.groupBy("text").agg(F.max("toxic").alias("toxic"))
    terms = (
        in_arrow(texts, count_terms, "kind long, term long, n long, toxic long")
        .groupBy("kind", "term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        .where((F.col("n") >= MIN_DOCS) & (F.col("toxic") >= MIN_SHARE * F.col("n")))
    )
    first = Window.partitionBy("kind").orderBy(F.desc("toxic"), "term")
    found = terms.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= MAX_ENTRIES).toArrow()
    kind, term = found.column("kind").to_numpy(), found.column("term").to_numpy()
    return {k: np.sort(term[kind == k]) for k in KINDS}


def text_features(data: np.ndarray, offsets: np.ndarray, lexicons: dict[int, np.ndarray]) -> np.ndarray:
    """The columns of FEATURES for each text."""
    words = Words(data, offsets, LETTERS)
    n = np.diff(words.first)
    hundreds, length = np.maximum(n, 1) / 100.0, np.maximum(np.diff(offsets), 1)
    count = lambda hit: per_doc(hit.astype(np.int64), words.first)
    span = words.end - words.start
    own = {k: _member(words.hashes(k or None).view(np.int64), lexicons[k]) & (span >= max(k, 3)) for k in KINDS}
    plain = words.hashes().view(np.int64)
    insult, second = _member(plain, np.sort(hash_words(INSULTS).view(np.int64))), _member(plain, np.sort(hash_words(SECOND_PERSON).view(np.int64)))
    hit = insult | own[0] | own[5]
    at = np.flatnonzero(second)
    near = np.zeros(len(plain))
    if len(at):
        where = np.flatnonzero(hit)
        for step in (-1, 0):
            other = at[np.clip(np.searchsorted(at, where) + step, 0, len(at) - 1)]
            close = np.where(words.doc[other] == words.doc[where], 1.0 / (1.0 + np.abs(other - where)), 0.0)
            near[where] = np.maximum(near[where], close)
    capital = CAPITAL[data]
    ups = np.concatenate([[0], np.cumsum(capital)])
    shouted = (span >= 4) & (ups[words.end] - ups[words.start] == span)
    # a sign inside a run of letters: its neighbours on both sides are letters of the same text
    sign = np.zeros(len(data), dtype=np.int64)
    if len(data) > 2:
        sign[1:-1] = MASK[data[1:-1]] & LETTERS[data[:-2]] & LETTERS[data[2:]]
    rate = lambda mask: per_doc(mask.astype(np.int64), offsets) / length
    counts = [count(own[k]) for k in KINDS]
    return np.stack(
        [
            *counts, *[c / hundreds for c in counts], count(insult), count(insult) / hundreds, per_doc(near, words.first),
            count(second) / hundreds, rate(capital), count(shouted) / hundreds, rate(PUNCTUATION[data]),
            rate(EXCLAIM[data]), per_doc(sign, offsets) / hundreds, np.log1p(n),
        ], 1,
    ).astype(np.float64)


def with_features(docs: DataFrame, lexicons: dict[int, np.ndarray], carry: list[str]) -> DataFrame:
    """The columns `carry` of `docs` and those of FEATURES, from its whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text"):
                table = text_features(data, offsets, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in carry], *[pa.array(table[:, i]) for i in range(len(FEATURES))]], [*carry, *FEATURES]
                )

    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return in_arrow(docs.select(*carry, "text"), compute, ", ".join([kept, *[f"{f} double" for f in FEATURES]]))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text).

    Learns from the rows of `labels` (doc_id, toxic) with crc32(doc_id) mod 3 other than 1 and a toxic value of 0 or
    1, about `max_docs` of them; labels of one doc_id count once, by the largest. Lexicons and trees learn from four
    fifths, and the rest, which neither has seen, calibrates the trees; where one of these parts lacks a class, both
    steps take all. Where labels of either class are missing altogether, the score is their mean (0 without labels). A
    null text counts as empty; repeated rows are scored alike; an empty table gives an empty result. Other columns are
    ignored.
    """
    docs = docs.select("doc_id", "text")
    held = id_remainder(F.col("doc_id"))
    share: Column = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    usable = labels.where((held != 1) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    quota = max_docs / max(usable.count(), 1)
    drawn = docs.where((held != 1) & (share < quota)).join(usable.where(share < quota), "doc_id")
    drawn = materialize(drawn.select("doc_id", "text", "toxic"), "labelled")
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(5)) == 0
    mean, classes = drawn.agg(F.avg("toxic"), F.count_distinct("toxic")).first()
    if classes < 2:
        score = F.lit(float(mean or 0.0))
        return docs.select("doc_id", (held == 1).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    if drawn.select(fold.alias("fold"), "toxic").distinct().count() == 4:
        learns, calibrates = ~fold, fold
    else:
        learns = calibrates = F.lit(True)
    lexicons = learn_lexicons(drawn.where(learns))
    table = materialize(with_features(drawn, lexicons, ["doc_id", "toxic"]), "features")
    gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
    margin = vector_to_array(F.col("rawPrediction"))[1]
    ready = gather.transform(table.withColumn("label", F.col("toxic").cast("double")))
    trees = GBTClassifier(maxIter=12, maxDepth=3, maxBins=32, stepSize=0.3, seed=7).fit(ready.where(learns).select("features", "label"))
    bind = VectorAssembler(inputCols=["margin"], outputCol="margins")
    raw = lambda rows: bind.transform(trees.transform(rows).withColumn("margin", margin))
    scale = IsotonicRegression(featuresCol="margins", labelCol="label", predictionCol="score").fit(raw(ready.where(calibrates)).select("margins", "label"))
    scored = scale.transform(raw(gather.transform(with_features(docs, lexicons, ["doc_id"]))).select("doc_id", "margins"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scored.select("doc_id", (held == 1).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
