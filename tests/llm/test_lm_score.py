import math
import re

import pytest

from tallyscope.llm.lm_score import PRIOR, score_documents
from tallyscope.llm.wordhash import hash_words

SCHEMA = "doc_id long, text string"


def brute(rows, targets, vocab_size):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for i, t in rows}
    counts = {}
    for own in words.values():
        for w in own:
            counts[w] = counts.get(w, 0) + 1
    order = sorted(counts, key=lambda w: (-counts[w], hash_words([w]).view("int64")[0]))
    vocab = set(order[:vocab_size])
    width = len(vocab) + 2

    def model(ids):
        pair, one, left = {}, {}, {}
        for i in ids:
            last = "<s>"
            for w in words[i]:
                w = w if w in vocab else "<unk>"
                pair[last, w] = pair.get((last, w), 0) + 1
                left[last] = left.get(last, 0) + 1
                one[w] = one.get(w, 0) + 1
                last = w
        n = sum(one.values())

        def loss(text):
            bits, last = 0.0, "<s>"
            for w in text:
                w = w if w in vocab else "<unk>"
                base = (one.get(w, 0) + 1) / (n + width)
                bits -= math.log2((pair.get((last, w), 0) + PRIOR * base) / (left.get(last, 0) + PRIOR))
                last = w
            return bits / max(len(text), 1)

        return loss

    aim, every = model([i for i in words if i in targets]), model(list(words))
    return {i: (len(w), aim(w), every(w)) for i, w in words.items()}


def test_equals_brute_force(spark):
    rows = [(i, " ".join(["The", "cat", "sat", f"x{i % 7}", "on é mat"][k % 5] for k in range(i % 23))) for i in range(120)]
    targets = {i for i in range(120) if i % 7 == 3}
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    ids = spark.createDataFrame([(i,) for i in targets] * 2, "doc_id long")
    want = brute(rows, targets, 6)
    for r in score_documents(docs, ids, vocab_size=6).collect():
        assert r.n_words == want[r.doc_id][0]
        assert (r.ce_target, r.ce_background) == pytest.approx(want[r.doc_id][1:], rel=1e-5, abs=1e-6)
        assert r.score == pytest.approx(r.ce_target - r.ce_background)


def test_target_like_texts_score_lower(spark):
    rows = [(i, "red green blue " * 20 if i % 2 else "one two three " * 20) for i in range(40)]
    ids = spark.createDataFrame([(i,) for i in range(1, 20, 2)], "doc_id long")
    got = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(rows, SCHEMA), ids).collect()}
    assert max(got[i] for i in got if i % 2) < min(got[i] for i in got if not i % 2)


def test_defined_results(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0), (None, "a", 0), (4, "w " * 300_000, 0)]
    docs = spark.createDataFrame(rows, SCHEMA + ", score int")
    none = spark.createDataFrame([], "doc_id long")
    got = sorted((str(r.doc_id), r.n_words) for r in score_documents(docs, none).collect())
    assert got == [("1", 0), ("2", 0), ("3", 2), ("3", 2), ("4", 300_000), ("None", 1)]
    assert all(r.score == 0 for r in score_documents(docs, none).where("n_words = 0").collect())
    assert score_documents(docs.limit(0), none).collect() == []


def test_rare_words_are_told_apart(spark):
    # 1,500 words, all but the first 1,022 of them rarer: two texts of rare words alone
    rows = [(i, " ".join(f"w{k}" for k in range(10 * i, 10 * i + 10))) for i in range(150)]
    rows += [(1000 + i, " ".join(f"w{k}" for k in range(1022))) for i in range(2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, {140}, 10**6)
    got = {r.doc_id: r for r in score_documents(docs, spark.createDataFrame([(140,)], "doc_id long")).collect()}
    assert {i: (r.n_words, pytest.approx(r.ce_target), pytest.approx(r.ce_background)) for i, r in got.items()} == want
    assert got[140].score < got[141].score


def test_hot_words_and_bigrams_in_small_buckets(spark, monkeypatch):
    monkeypatch.setattr("tallyscope.llm.lm_score.BUCKET", 64)
    monkeypatch.setattr("tallyscope.llm.lm_score.DEALT", 300)  # several pieces of a batch
    rows = [(i, " ".join(["of the", "cat", "sat of the", f"x{i % 7}", f"mat{i}"][k % 5] for k in range(i % 23))) for i in range(120)]
    targets = {i for i in range(120) if i % 5 == 3}
    want = brute(rows, targets, 10**6)
    got = score_documents(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i,) for i in targets], "doc_id long")).collect()
    assert {r.doc_id: (r.n_words, pytest.approx(r.ce_target), pytest.approx(r.ce_background)) for r in got} == want
