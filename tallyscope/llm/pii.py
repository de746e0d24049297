"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field labels what they leave open: its nodes are the tokens with a digit or an @
(other tokens are clamped to "none"). Potentials come from a token's shape and cue words, from adjacent tokens (the
chain) and from repeated or similar tokens anywhere in the document (the skip edges: equal tokens with letters, equal
local parts of addresses, equal last seven digits). Loopy message passing spreads the labels of the base spans, which
are observed, along both kinds of edge, so that one entity is labelled alike throughout its document. Three or more
tokens of one key are tied to a node of their own for that key, so any two of them are two steps apart; as they say the
same over and over, each has only its part of what one such token would say by its shape.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import in_arrow

KINDS = ("email", "ip", "card", "phone")
#: Documents that the potentials are learned from, about; drawn by a hash of the id.
MAX_TRAIN_DOCS = 20_000
#: Bytes of the texts that are solved together.
GRAPH_BYTES = 1 << 20
#: A document's messages have settled when none of them changes by more in a round; rounds after which they are taken as
#: they are, should they never settle.
SETTLED, MAX_ROUNDS = 1e-4, 2000
#: Posterior from which a token that no base span covers becomes a span of its own.
CERTAIN = 0.5
#: Share of the tokens without a base span that are taken to be entities the patterns miss.
MISSED = 0.1
#: Pseudo-counts of skip edges whose ends share a label, and don't, before any are seen.
AGREEMENT = (20.0, 0.5)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MAYBE = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
BLANK = frozenset("\x20\x09\x0a\x0b\x0c\x0d")
EDGE = "\"'`,;:!?()[]{}<>|.=#*"
NOT_DIGIT = re.compile(r"[^0-9]+")
CUES = {
    "email": ("mail", "email", "e-mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "tél", "teléfono"),
}


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str) -> list[tuple[int, int, int]]:
    # A match begins at the first local character after the last blank, @ or match: found from each @ backwards, so that
    # a long run without one costs a single look.
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (found := DOMAIN.match(text, at + 1)):
            out.append((0, begin, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start, in code points: leftmost non-overlapping matches of each kind that pass
    its check."""
    if not MAYBE.search(text):
        return []
    out = _emails(text)
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups()):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


class Token(NamedTuple):
    start: int
    end: int
    label: int  # 1 + kind of the base span it overlaps, else 0
    shape: int  # bit pattern of its features
    keys: tuple[str, ...]  # skip edges lead to tokens of the same key
    joined: bool  # only blanks or signs lie between it and the token before


#: Stands for a node of a key.
HUB = Token(0, 0, 0, -1, (), False)


def _shape(word: str, digits: str, before: str) -> int:
    n = len(digits)
    flags = [
        "@" in word, word.count(".") == 3, word.count(".") in (1, 2), word[:1] == "+", "-" in word, "(" in word,
        any(c.isalpha() for c in word), n <= 3, 4 <= n <= 6, 7 <= n <= 9, 10 <= n <= 12, 13 <= n <= 19, n >= 20,
        *[any(c == before for c in CUES[k]) for k in KINDS],
    ]
    return sum(1 << i for i, f in enumerate(flags) if f)


SHAPE_BITS = 17


def tokens(text: str, spans: list[tuple[int, int, int]]) -> list[Token]:
    """The tokens of a text that have a digit or an @."""
    out: list[Token] = []
    ordered, at, done = sorted((s, e, k) for k, s, e in spans), 0, 0
    for m in TOKEN.finditer(text):
        start, end = m.span()
        if start < done:
            continue
        while start > done and text[start - 1] not in BLANK:
            start -= 1
        done = end
        word = text[start:end]
        lead = len(word) - len(word.lstrip(EDGE))
        start, end = start + lead, start + len(word.rstrip(EDGE))
        if start >= end:
            continue
        word = text[start:end]
        while at < len(ordered) and ordered[at][1] <= start:
            at += 1
        label = 1 + ordered[at][2] if at < len(ordered) and ordered[at][0] < end else 0
        digits = NOT_DIGIT.sub("", word)
        low, keys = word.lower().partition("@")[0], []
        if len(low) >= 4 and any(c.isalpha() for c in low):
            keys.append("w" + low)
        if len(digits) >= 7:
            keys.append("d" + digits[-7:])
        left = text[max(0, start - 24) : start].rstrip(" :=\n\t").rpartition(" ")[2].lower()
        gap = text[out[-1].end : start] if out and start - out[-1].end <= 8 else "x"
        joined = bool(out) and not any(c.isalnum() for c in gap)
        out.append(Token(start, end, label, _shape(word, digits, left), tuple(keys), joined))
    return out


def _of_key(nodes: list[Token]) -> list[list[int]]:
    """The tokens of each key that more than one has."""
    own: dict[str, list[int]] = {}
    for i, node in enumerate(nodes):
        for k in node.keys:
            own.setdefault(k, []).append(i)
    return [x for x in own.values() if len(x) > 1]


def skip_edges(nodes: list[Token]) -> list[tuple[int, int]]:
    """Edges between tokens of the same key: of a pair directly, of more to a node of the key, numbered after the
    tokens."""
    out, hub = set(), len(nodes)
    for own in _of_key(nodes):
        if len(own) > 2:
            out |= {(i, hub) for i in own}
            hub += 1
        elif own[1] != own[0] + 1 or not nodes[own[1]].joined:
            out.add((own[0], own[1]))
    return sorted(out)


class Field(NamedTuple):
    """Log potentials: unary[shape bit, label] with bias[label], chain[label, label], skip[label, label]."""

    unary: np.ndarray
    bias: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def scores(self, shapes: np.ndarray) -> np.ndarray:
        bits = (shapes[:, None] >> np.arange(SHAPE_BITS)) & 1
        return bits @ self.unary + self.bias

    def posteriors(self, shapes: np.ndarray, observed: np.ndarray, chain: np.ndarray, skip: np.ndarray, parts: np.ndarray, share: np.ndarray | float = 1.0) -> np.ndarray:
        """Marginals of all nodes by loopy sum-product; `observed` is a label above 0 where it is known. A shape below 0
        is that of a node of a key, which has no potential of its own. `parts` numbers the document of each node, below
        the number of nodes; `share` is the part of a node's own potential that counts."""
        own = np.where(shapes[:, None] >= 0, self.scores(np.maximum(shapes, 0)), 0.0) * np.reshape(share, (-1, 1))
        known = observed > 0
        own[known] = -30.0
        own[known, observed[known]] = 0.0
        ends = np.concatenate([chain, skip]).reshape(-1, 2)
        if len(ends) == 0:
            return _softmax(own)
        tables = np.concatenate([np.tile(self.chain, (len(chain), 1, 1)), np.tile(self.skip, (len(skip), 1, 1))])
        source = np.concatenate([ends[:, 0], ends[:, 1]])
        target = np.concatenate([ends[:, 1], ends[:, 0]])
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        opposite = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
        sent = np.zeros((len(source), own.shape[1]))
        part, live = parts[source], np.arange(len(source))
        for rounds in range(MAX_ROUNDS):
            belief = own.copy()
            np.add.at(belief, target, sent)
            out = _lse((belief[source[live]] - sent[opposite[live]])[:, :, None] + tables[live])
            out -= out.max(1, keepdims=True)
            moved = np.zeros(len(own))
            np.maximum.at(moved, part[live], np.abs(out - sent[live]).max(1))
            sent[live] = 0.5 * sent[live] + 0.5 * out if rounds else out
            live = live[moved[part[live]] >= SETTLED]  # each document ends by itself, whatever shares its batch
            if len(live) == 0:
                break
        belief = own.copy()
        np.add.at(belief, target, sent)
        return _softmax(belief)


def _lse(x: np.ndarray) -> np.ndarray:
    top = x.max(1, keepdims=True)
    return np.log(np.exp(x - top).sum(1)) + top[:, 0]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(what, a, b, n): counts of (shape, label), and of label pairs along chain and skip edges."""
    for batch in batches:
        counts: dict[tuple[str, int, int], int] = {}
        for text in batch.column("text").to_pylist():
            nodes = tokens(text, base_spans(text)) if text and MAYBE.search(text) else []
            # the later tokens of a span of several look like any number: they say nothing about shapes
            later = {i for i in range(1, len(nodes)) if nodes[i].joined and nodes[i].label == nodes[i - 1].label > 0}
            # nor do repeats of what a pattern found: that no pattern covers them doesn't make them other than entities
            named = {k for x in nodes if x.label for k in x.keys}
            open_ = {i for i, x in enumerate(nodes) if not x.label and named.intersection(x.keys)}
            seen = [("unary", x.shape, x.label) for i, x in enumerate(nodes) if i not in later and i not in open_]
            both = [(i - 1, i) for i in range(1, len(nodes)) if nodes[i].joined and not {i - 1, i} & open_]
            seen += [("chain", nodes[i].label, nodes[j].label) for i, j in both]
            both = [x for own in _of_key(nodes) for x in zip(own, own[1:], strict=False)]
            seen += [("skip", nodes[i].label, nodes[j].label) for i, j in both if nodes[i].label and nodes[j].label]
            for key in seen:
                counts[key] = counts.get(key, 0) + 1
        rows = [(*k, n) for k, n in sorted(counts.items())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)]],
            ["what", "a", "b", "n"],
        )


def learn_field(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> Field:
    """Potentials from the base spans of about `max_docs` whole texts: a logistic regression of label on shape,
    smoothed pointwise mutual information of the labels along chain edges, and along skip edges the log odds that ends
    which both lie in base spans share a label (an end outside says nothing: the patterns may have missed it)."""
    n = docs.count()
    share = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    drawn = docs.where(share < F.lit(max_docs / max(n, 1))).select("text")
    rows = (
        in_arrow(drawn, _evidence, "what string, a long, b long, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
        .orderBy("what", "a", "b").collect()
    )  # fmt: skip  # shapes and labels only: a few thousand rows at most
    return fit_field(rows)


def fit_field(rows: list) -> Field:
    """Potentials from the rows (what, a, b, n) of _evidence."""
    labels = 1 + len(KINDS)
    unary = [(r["a"], r["b"], r["n"]) for r in rows if r["what"] == "unary"]
    weights, bias = np.zeros((SHAPE_BITS, labels)), np.zeros(labels)
    if unary:
        shape, label, count = (np.array(x) for x in zip(*unary, strict=True))
        bits = ((shape[:, None] >> np.arange(SHAPE_BITS)) & 1).astype(float)
        aim, share_ = np.eye(labels)[label], count / count.sum()
        aim[label == 0] = [1 - MISSED, *[MISSED / len(KINDS)] * len(KINDS)]
        for _ in range(400):
            off = (_softmax(bits @ weights + bias) - aim) * share_[:, None]
            weights -= 4.0 * (bits.T @ off + 1e-4 * weights)
            bias -= 4.0 * off.sum(0)
    table = np.full((labels, labels), 0.5)
    agree, differ = AGREEMENT
    for r in rows:
        if r["what"] == "chain":
            table[r["a"], r["b"]] += r["n"]
        elif r["what"] == "skip":
            agree, differ = (agree + r["n"], differ) if r["a"] == r["b"] else (agree, differ + r["n"])
    joint = table / table.sum()
    chain = np.clip(np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True))), -4.0, 4.0)
    skip = np.eye(labels) * np.clip(np.log(agree / differ), 1.0, 4.0)
    return Field(weights, bias, chain, skip)


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds to each text; the texts of a batch are solved as one graph of separate parts."""
    nodes, owner, chain, skip, share = [], [], [], [], []
    for i, (text, base) in enumerate(zip(texts, bases, strict=True)):
        own = tokens(text, base) if MAYBE.search(text) else []
        if own and any(x.label == 0 for x in own):
            at = len(nodes)
            chain += [(at + j - 1, at + j) for j in range(1, len(own)) if own[j].joined]
            edges = skip_edges(own)
            hubs = max([b + 1 for _, b in edges], default=0) - len(own)
            skip += [(at + a, at + b) for a, b in edges]
            nodes += own + [HUB] * max(hubs, 0)
            owner += [i] * (len(nodes) - at)
            alike = [1] * (len(nodes) - at)
            for a, b in edges:
                alike[b] += b >= len(own)
            for a, b in edges:
                alike[a] = max(alike[a], alike[b] - 1) if b >= len(own) else alike[a]
            share += [1 / n for n in alike]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not nodes:
        return out
    edge = lambda x: np.array(x, dtype=np.int64).reshape(-1, 2)
    observed = np.array([x.label for x in nodes])
    shapes = np.array([x.shape for x in nodes], dtype=np.int64)
    parts = np.unique(owner, return_inverse=True)[1]
    belief = field.posteriors(shapes, observed, edge(chain), edge(skip), parts, np.array(share))
    pick = np.where((observed == 0) & (shapes >= 0) & (belief[:, 1:].max(1) > CERTAIN), belief[:, 1:].argmax(1), -1)
    for i in np.flatnonzero(pick >= 0):
        spans, kind = out[owner[i]], int(pick[i])
        if nodes[i].joined and spans and pick[i - 1] == kind and spans[-1][2] == nodes[i - 1].end:
            spans[-1] = (kind, spans[-1][1], nodes[i].end)
        else:
            spans.append((kind, nodes[i].start, nodes[i].end))
    return out


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts are GRAPH_BYTES together, or one longer text: what is one graph in memory."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
    low = 0
    while low < batch.num_rows:
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + GRAPH_BYTES, side="right")))
        yield batch.slice(low, high - low)
        low = high


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base, added for every row of `docs` (doc_id, text): arrays of (kind, start, end), by kind as in KINDS,
    then start; positions in code points, end exclusive.

    `field` defaults to one learned from `docs`. A null text counts as empty and has no spans; repeated rows are
    searched alike; an empty table gives an empty result. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(field or learn_field(docs))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    named = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(spans)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                texts = [t or "" for t in rows.column("text").to_pylist()]
                bases = [base_spans(t) for t in texts]
                more = added_spans(texts, bases, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), *[pa.array([named(x) for x in found], pa.list_(span)) for found in (bases, more)]],
                    ["doc_id", "base", "added"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<kind:string,start:int,end:int>>"
    return in_arrow(docs, search, f"doc_id {kind}, base {spans}, added {spans}")
