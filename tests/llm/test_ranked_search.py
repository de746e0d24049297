import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyscope.llm import ranked_search as rs

DOCS, ITEMS = "doc_id long, text string, lang string", "item_id long, text string, rank string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_force(docs, items, top=20):
    held = [(doc_id, Counter(terms(text)), len(terms(text))) for doc_id, text in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, counts, _ in held for t in counts)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, counts, n in held:
            m = 75 + (25 * n * n_docs) // n_terms if n_terms else 0
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(q * weight(t) * ((1000000000 * counts[t]) // (1000 * counts[t] + 12 * m)) for t, q in Counter(terms(text)).items() if t in counts)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1)]
    return sorted(map(repr, out))


def search(spark, docs, items, **more):
    got = rs.ranked_search(spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS), **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score", "tier"]
    return got.collect()


def rows(found):
    return sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in found)


def made(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = [f"w{i}" if i % 3 else f"Wört{i}" for i in range(vocabulary)]
    pick = lambda k: " ".join(words[min(int(r.expovariate(0.02)), vocabulary - 1)] + r.choice([" ", ", ", "-"]) for _ in range(k))
    docs = [(i, pick(r.choice([0, 1, 5, 40, 200]))) for i in range(n)]
    return docs, [(i, pick(r.choice([1, 3, 12]))) for i in range(30)], r


def test_equals_brute_force(spark):
    docs, items, r = made(1, 700)
    docs += [(7, docs[7][1]), (None, docs[9][1]), (None, None), (9000, ""), (9001, "\x00 .,;\t"), (9002, "w1 " * 5000), (9003, docs[11][1] * 40)]
    items += [(3, items[3][1]), (None, "w1 w2"), (900, None), (901, ""), (902, "nowhere"), (903, " ".join(d[1] for d in docs[:20]))]
    assert rows(search(spark, docs, items)) == brute_force(docs, items)


@pytest.mark.parametrize("tiers, contenders", [(((1, 0.01), (4, 0.1)), 25), (((2, 0.5),), 5000), (((10**9, 1.0), (10**9, 1.0)), 10**9)])
def test_every_way_through_the_tiers_is_exact(spark, monkeypatch, tiers, contenders):
    docs, items, r = made(2, 500)
    marks = [f"rare{i}" for i in range(5)]
    docs += [(5000 + i, " ".join([marks[i % 5]] * 3 + ["w1"] * (i % 7))) for i in range(200)]
    items += [(500 + i, f"{mark} {mark} w399") for i, mark in enumerate(marks)]
    monkeypatch.setattr(rs, "TIERS", tiers)
    monkeypatch.setattr(rs, "COLUMNS", [f"tier{i}" for i in range(len(tiers) + 1)])
    monkeypatch.setattr(rs, "CONTENDERS", contenders)
    found = search(spark, docs, items)
    assert rows(found) == brute_force(docs, items)
    if contenders == 5000:
        assert {r.tier for r in found} == {0, 1}  # proven above, and fallen through
    if contenders == 10**9:
        assert {r.tier for r in found} == {0}


def test_bounds_hold():
    vocab, weight = {b"a": 0, b"b": 1}, np.array([5, 7])
    wanted = rs.Wanted([rs.Item(4, 4, Counter({b"a": 2, b"b": 1}))], vocab, weight, np.array([3, 10]))
    assert wanted.unseen.tolist() == [2 * 5 * 3 + 7 * 10]
    tier = np.array([[0], [1], [9]], dtype=np.int32).tobytes()
    ((low, scores, rest),) = rs.block_scores([tier], 3, wanted)
    assert (low, scores.tolist(), rest.tolist()) == (0, [[0, 90, 0]], [[100, 70, 100]])


def test_long_texts_are_read_whole_in_pieces(monkeypatch):
    monkeypatch.setattr(rs, "PIECE", 7)
    for text in ["", "a", "abc DEF-ghi", "x" * 50, " " * 30 + "Ünder" + " " * 9, "ab " * 20 + "y" * 20 + " z"]:
        assert sum(rs.term_runs(memoryview(text.encode())), []) == [t.encode() for t in terms(text)]


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    docs, items, _ = made(3, 60)
    monkeypatch.setattr(rs, "QUERY_BYTES", 100)
    assert rows(search(spark, docs, items, top=3)) == brute_force(docs, items, 3)
    assert search(spark, [], items[:2]) == [] and search(spark, docs, []) == [] and search(spark, [(1, None)], [(1, "a")]) == []
