import itertools
import random
import re

import numpy as np

from tallyscope.llm.pii import KINDS, SHAPE_BITS, Field, added_spans, base_spans, find_personal_data, learn_field, luhn, skip_edges, tokens
from tallyscope.llm.queries import op4_pii

SCHEMA = "doc_id long, text string"


def naive(text):
    """The patterns as they are written, one search each."""
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    r = random.Random(3)
    bits = ["a", "é", "@", ".", "-", "+", " ", "1", "22", "255", "256", "4111111111111111", "x@y.z", "(", ")", "%", "1.2.3.4", "+1 (555) 555-2485", "0004"]
    for _ in range(20_000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(1, 14)))
        assert base_spans(text) == naive(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 2_000_000 + " x@y", "1" * 2_000_000, "1." * 500_000, "@" * 500_000, "+1" * 500_000, "1 " * 500_000):
        base_spans(text)


def test_the_field_spreads_labels(spark):
    known = [(i, f"mail me: user.{i:03}@host.example.com or +1 (555) 555-{1000 + i} thanks, code {i}") for i in range(200)]
    repeats = [(1000, "write to anna.77@host.example.org today. Later anna.77 wrote again, room 12."), (1001, "call +49 30 5551234 now; as said, 30-5551234 it is, for 3 days")]
    docs = spark.createDataFrame(known + repeats, SCHEMA)
    got = {r.doc_id: r for r in find_personal_data(docs).collect()}
    texts = dict(known + repeats)
    added = [(s.kind, texts[1000][s.start : s.end]) for s in got[1000].added]
    assert added == [("email", "anna.77")]
    assert all(texts[i][s.start : s.end] != f"{i}" for i in range(200) for s in got[i].added)
    for i, t in texts.items():
        assert [(KINDS.index(s.kind), s.start, s.end) for s in got[i].base] == naive(t)


def test_skip_edges_form_chains():
    text = " ".join(["id77"] * 50)
    nodes = tokens(text, [])
    assert len(nodes) == 50 and len(skip_edges(nodes)) <= 50


def random_field(r, labels=5):
    table = lambda: np.array([[r.uniform(-1, 1) for _ in range(labels)] for _ in range(labels)])
    skip = table()
    return Field(np.array([[r.uniform(-1, 1) for _ in range(labels)] for _ in range(SHAPE_BITS)]), table()[0], table(), skip + skip.T)


def test_marginals_equal_enumeration():
    """On trees, chains and nodes of keys among them, the messages give exact marginals."""
    r = random.Random(4)
    for _ in range(6):
        field, n = random_field(r), 5
        shapes = np.array([r.randrange(1 << SHAPE_BITS) for _ in range(n - 1)] + [-1])
        observed = np.array([r.choice([0, 0, 0, 2]) for _ in range(n - 1)] + [0])
        chain, skip = np.array([[0, 1]]), np.array([[1, 4], [2, 4], [3, 4]])
        own = np.where(shapes[:, None] >= 0, field.scores(np.maximum(shapes, 0)), 0.0)
        total = np.zeros((n, 5))
        for labels in itertools.product(range(5), repeat=n):
            if any(o and o != x for o, x in zip(observed, labels)):
                continue
            weight = sum(own[i, x] for i, x in enumerate(labels) if not observed[i])
            weight += sum(field.chain[labels[a], labels[b]] for a, b in chain) + sum(field.skip[labels[a], labels[b]] for a, b in skip)
            for i, x in enumerate(labels):
                total[i, x] += np.exp(weight)
        got = field.posteriors(shapes, observed, chain, skip, np.zeros(n, dtype=np.int64))
        assert np.allclose(got, total / total.sum(1, keepdims=True), atol=2e-3)


def test_a_document_does_not_depend_on_its_batch():
    r = random.Random(5)
    field = random_field(r)
    texts = [" ".join(r.choice(["id77", "id77", "+1 (555) 555-2485", "5552485", "x@y.zz", "x9", "12", "word"]) for _ in range(25)) for _ in range(20)]
    bases = [base_spans(t) for t in texts]
    assert added_spans(texts, bases, field) == [added_spans([t], [b], field)[0] for t, b in zip(texts, bases)]


def test_repeats_far_apart_are_all_found(spark):
    """Repeats of what a pattern found don't teach the field that they are no entities."""
    text = lambda i, k: f"mail user.{i:03}@host.example.com now. " + "".join(f"Then user.{i:03} wrote, line {j} of it. " for j in range(k))
    docs = spark.createDataFrame([(i, text(i, 30 if i < 4 else 1)) for i in range(100)], SCHEMA)
    for r in find_personal_data(docs).collect():
        assert len([s for s in r.added if s.kind == "email"]) == (30 if r.doc_id < 4 else 1)


def test_defined_results(spark, tmp_path):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.cc", "x"), (3, "a@b.cc", "x"), (None, "1.2.3.4 and é 5.6.7.8", "x"), (4, "no data", "x")]
    docs = spark.createDataFrame(rows, SCHEMA + ", base string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in op4_pii(spark, str(tmp_path)).collect())
    assert got == [
        ("1", 0, 0, 0, 0, ""), ("2", 0, 0, 0, 0, ""), ("3", 1, 0, 0, 0, "email:0:6"), ("3", 1, 0, 0, 0, "email:0:6"),
        ("4", 0, 0, 0, 0, ""), ("None", 0, 2, 0, 0, "ip:0:7,ip:14:21"),
    ]
    assert find_personal_data(docs.limit(0)).collect() == []
    assert learn_field(docs.limit(0)).bias.shape == (5,)


def test_slices_are_bounded_and_whole(monkeypatch):
    import pyarrow as pa

    from tallyscope.llm import pii

    monkeypatch.setattr(pii, "GRAPH_BYTES", 10)
    texts = ["", "a" * 4, "b" * 6, None, "c" * 30, "d", "é" * 5, None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got = [b.column("text").to_pylist() for b in pii.slices(batch)]
    assert sum(got, []) == texts and all(len(g) == 1 or sum(len((t or "").encode()) for t in g) <= 10 for g in got)
    assert list(pii.slices(batch.slice(0, 0))) == []
