"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts with escape probabilities (a symbol seen n times in a context
of total t with q distinct symbols gets n / (t + q), an escape to the next shorter context q / (t + q), and below the
empty context all bytes are alike). The statistics are frozen after training, so the code length of a byte depends on
the context's longest known suffix alone: the trees become one table of code lengths, by context, byte and language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import fresh, id_remainder, in_arrow
from tallyscope.llm.wordhash import pieces

ORDER = 3
#: Training texts for each language, about; drawn by a hash of the id.
MAX_TRAIN_DOCS = 1500
#: A context of three bytes is kept where training met it so often in some language.
MIN_CONTEXT = 8


def _padded(data: np.ndarray, offsets: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the texts with ORDER zeros before each; the index windows (begin, end) of each text's bytes."""
    n = len(offsets) - 1
    begin = offsets[:-1] + ORDER * np.arange(n)
    out = np.zeros(len(data) + ORDER * n, dtype=np.int32)
    symbols = code[data]
    for i in range(n):
        out[begin[i] + ORDER : begin[i] + ORDER + offsets[i + 1] - offsets[i]] = symbols[offsets[i] : offsets[i + 1]]
    return out, begin, begin + np.diff(offsets)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): the runs of ORDER + 1 bytes, each text led by zeros; byte b counts as b + 1, in base 257."""
    code = np.arange(1, 257, dtype=np.int64)
    for batch in batches:
        for rows, data, offsets in pieces(batch, "text"):
            s, begin, end = _padded(data, offsets, code)
            s = s.astype(np.int64)
            gram = np.zeros(max(len(s) - ORDER, 0), dtype=np.int64)
            for k in range(ORDER + 1):
                gram = gram * 257 + s[k : len(s) - ORDER + k]
            langs = np.array(rows.column("lang").to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                own = [gram[begin[i] : end[i]] for i in np.flatnonzero(langs == lang)]
                found, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"],
                )


class ContextTrees:
    """Frozen context trees of all languages as tables: `follow` leads from a context and a byte to the longest known
    suffix, `bits` has the code length of each byte there for each language."""

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        every = np.concatenate([g for g, _ in grams.values()])
        seen = np.unique(np.concatenate([every // 257**k % 257 for k in range(ORDER + 1)]))
        seen = np.union1d(seen, [0])
        a = self.size = len(seen) + 1  # and one for bytes that training never met
        self.code = np.full(256, a - 1, dtype=np.int32)
        self.code[seen[seen > 0] - 1] = np.flatnonzero(seen > 0)
        lookup = np.zeros(257, dtype=np.int64)
        lookup[seen] = np.arange(len(seen))
        split = {x: np.stack([lookup[g // 257**k % 257] for k in range(ORDER, -1, -1)]) for x, (g, _) in grams.items()}
        nodes = 1
        self.node = {0: np.zeros(1, dtype=np.int64)}
        keys, self.keys = {0: np.zeros(1, dtype=np.int64)}, {}
        for k in range(1, ORDER + 1):
            ids, total = [], []
            for x in langs:
                context = self._join(split[x][ORDER - k : ORDER])
                found, at = np.unique(context, return_inverse=True)
                often = np.bincount(at, weights=grams[x][1]) >= (MIN_CONTEXT if k == ORDER else 1)
                ids.append(found[often])
            keys[k] = np.unique(np.concatenate(ids))
            self.node[k] = nodes + np.arange(len(keys[k]))
            nodes += len(keys[k])
            total.append(len(keys[k]))
        self.keys = keys
        self.bits = np.empty((nodes, a, len(langs)), dtype=np.float32)
        for j, x in enumerate(langs):
            self._fill(j, split[x], grams[x][1])
        self._follow()

    def _join(self, symbols: np.ndarray) -> np.ndarray:
        out = np.zeros(symbols.shape[1], dtype=np.int64)
        for row in symbols:
            out = out * self.size + row
        return out

    def _fill(self, j: int, split: np.ndarray, n: np.ndarray) -> None:
        a = self.size
        for k in range(ORDER + 1):
            context, symbol = self._join(split[ORDER - k : ORDER]), split[ORDER]
            place = np.searchsorted(self.keys[k], context)
            ok = (place < len(self.keys[k])) & (self.keys[k][np.minimum(place, len(self.keys[k]) - 1)] == context)
            cells = np.bincount(place[ok] * a + symbol[ok], weights=n[ok], minlength=len(self.keys[k]) * a)
            cells = cells.reshape(-1, a)
            total, kinds = cells.sum(1, keepdims=True), (cells > 0).sum(1, keepdims=True)
            if k == 0:
                shorter = np.full((1, a), 8.0)
            else:
                shorter = self.bits[self._suffix(self.keys[k] % a ** (k - 1), k - 1), :, j]
            with np.errstate(divide="ignore", invalid="ignore"):
                own = -np.log2(cells / (total + kinds))
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            self.bits[self.node[k], :, j] = np.where(cells > 0, own, escape + shorter)

    def _suffix(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Nodes of the longest known suffixes of contexts of k bytes."""
        place = np.searchsorted(self.keys[k], keys)
        place = np.minimum(place, len(self.keys[k]) - 1)
        found = self.keys[k][place] == keys
        out = self.node[k][place]
        if k and not found.all():
            out[~found] = self._suffix(keys[~found] % self.size ** (k - 1), k - 1)
        return out

    def _follow(self) -> None:
        a, tables = self.size, []
        for k in range(ORDER):
            longer = (self.keys[k][:, None] * a + np.arange(a)).ravel()
            tables.append(self._suffix(longer, k + 1))
        self.follow = np.concatenate(tables).astype(np.int32)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        s, begin, end = _padded(data, offsets, self.code)
        a, flat = self.size, self.bits.reshape(-1, len(self.langs))
        out = np.zeros((len(begin), len(self.langs)))
        for low in range(0, max(len(s) - ORDER, 0), at_once):
            high = min(low + at_once, len(s) - ORDER)
            node = self.follow[s[low:high]]
            for k in range(1, ORDER):
                node = self.follow[node * a + s[low + k : high + k]]
            cost = flat[node.astype(np.int64) * a + s[low + ORDER : high + ORDER]]
            first, last = np.clip(begin, low, high) - low, np.clip(end, low, high) - low
            some = np.flatnonzero(first < last)
            if len(some):
                cuts = np.stack([first[some], last[some]], 1).ravel()
                cost = np.concatenate([cost, np.zeros((1, cost.shape[1]), dtype=cost.dtype)])
                out[some] += np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)[::2]
        return out


def train(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> ContextTrees | None:
    """Trees of the languages of `docs` (doc_id, text, lang), from whole texts with a language; None if there are none.

    From each language about `max_docs` documents are drawn by a hash of the id (that bounds the model; prediction
    covers every document).
    """
    known = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    drawn = F.lit(False)
    for lang, n in sizes.items():
        drawn = drawn | ((F.col("lang") == lang) & (share < F.lit(max_docs / n)))
    grams = in_arrow(known.where(drawn).select("lang", "text"), count_grams, "lang string, gram long, n long")
    counted = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(counted.column("lang").to_pylist(), dtype=object)
    gram, n = counted.column("gram").to_numpy(), counted.column("n").to_numpy()
    trees = {x: (gram[names == x], n[names == x]) for x in sorted(set(names))}
    return ContextTrees(list(trees), trees) if trees else None


def predict(docs: DataFrame, trees: ContextTrees | None, named: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """`docs` with three columns of the names `named`: the language of the shortest code, its posterior under equal
    priors (0 to 1), and that code's bits for each byte. `und` with score 0 where the text is null or has no letter, or
    nothing was learned."""
    if trees is None:
        return docs.withColumns(dict(zip(named, (F.lit("und"), F.lit(0.0), F.lit(0.0)), strict=True)))
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    # the columns go through Python by place, so that their names may be any
    outer, names, letters = [*docs.columns, *named], [f"c{i}" for i in range(len(docs.columns))], fresh("letters")
    text = names[docs.columns.index("text")]
    kinds = [f.dataType for f in docs.schema] + [T.StringType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField(n, kind) for n, kind in zip([*names, *named], kinds, strict=True)])
    docs = docs.withColumn(letters, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).toDF(*names, letters)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = np.array([*model.langs, "und"], dtype=object)
        for batch in batches:
            for rows, data, offsets in pieces(batch, text):
                bits = model.code_lengths(data, offsets)
                best = bits.min(1)
                posterior = 1.0 / np.exp2(np.maximum(best[:, None] - bits, -1000.0)).sum(1)
                known = rows.column(letters).to_numpy(zero_copy_only=False)
                pick = np.where(known, bits.argmin(1), len(langs) - 1)
                rate = best / np.maximum(np.diff(offsets), 1)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(x) for x in names]
                    + [pa.array(langs[pick], pa.string()), pa.array(np.where(known, posterior, 0.0)), pa.array(np.where(known, rate, 0.0))],
                    [*names, *named],
                )

    return in_arrow(docs, score, schema).toDF(*outer)


def identify(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte for every row of `docs` (doc_id, text, lang).

    Rows with crc32(doc_id) mod 3 = 1 are held out of training; lang, source and doc_id are no inputs of a prediction.
    Equal code lengths go to the first language by name; repeated rows are judged alike; an empty table gives an empty
    result. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang")
    trees = train(rows.where(id_remainder(F.col("doc_id")) != 1), max_docs)
    return predict(rows.select("doc_id", "text"), trees).select(
        "doc_id",
        (id_remainder(F.col("doc_id")) == 1).alias("held_out"),
        "lang_pred",
        "score",
        "bits_per_byte",
    )


def keep_identified(docs: DataFrame, min_score: float = 0.5, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang, ...) whose language is found: not `und`, and with a score of `min_score`
    or more.

    Null texts and texts without a letter go; if no language can be learned, all do. Repeated rows are judged alike,
    and of rows of one doc_id each by its own text; an empty table gives an empty result. All columns are kept,
    whatever their names.
    """
    trees = train(docs.select("doc_id", "text", "lang").where(id_remainder(F.col("doc_id")) != 1), max_docs)
    lang, score, bits = named = fresh("lang"), fresh("score"), fresh("bits")
    judged = predict(docs, trees, named)
    return judged.where((F.col(lang) != "und") & (F.col(score) >= min_score)).drop(*named)
