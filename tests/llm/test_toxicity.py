import math
import os
import random
import re

import numpy as np
import pytest

from tallyscope.llm.toxicity import INSULTS, KINDS, MIN_DOCS, MIN_SHARE, SECOND_PERSON, learn_lexicons, score_toxicity, text_features
from tallyscope.llm.wordhash import hash_words

DOCS, LABELS = "doc_id long, text string", "doc_id long, toxic int"
SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("score", "toxic", "predicted").collect()
    good = [r.score for r in got if r.toxic]
    bad = [r.score for r in got if not r.toxic]
    assert len(good) > 50
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.95
    caught = sum(r.predicted for r in got if r.toxic) / len(good)
    false = sum(r.predicted for r in got if not r.toxic) / len(bad)
    assert caught > 0.85 and false < 0.01
    assert all(0 <= r.score <= 1 for r in got)


def naive_features(text, lexicons):
    """The features of one text (ASCII), word by word."""
    words = [(m.start(), m[0]) for m in re.finditer("[A-Za-z]+", text)]
    n, hundreds, length = len(words), max(len(words), 1) / 100, max(len(text), 1)
    low = [w.lower() for _, w in words]
    own = {k: [len(w) >= max(k, 3) and (w[:k] if k else w) in lexicons[k] for w in low] for k in KINDS}
    insult, second = [w in INSULTS for w in low], [i for i, w in enumerate(low) if w in SECOND_PERSON]
    near = sum(
        max((1 / (1 + abs(i - j)) for j in second), default=0) for i in range(n) if insult[i] or own[0][i] or own[5][i]
    )
    hidden = sum(1 for i in range(1, len(text) - 1) if text[i] in "*@$#0134579" and text[i - 1].isalpha() and text[i + 1].isalpha())
    counts = [sum(own[k]) for k in KINDS]
    return [
        *counts, *[c / hundreds for c in counts], sum(insult), sum(insult) / hundreds, near, len(second) / hundreds,
        sum("A" <= c <= "Z" for c in text) / length, sum(w.isupper() and len(w) >= 4 for _, w in words) / hundreds,
        sum(not c.isalnum() and " " < c < chr(127) for c in text) / length, sum(c in "!?" for c in text) / length, hidden / hundreds, math.log1p(n),
    ]


def test_features_equal_a_plain_count():
    r = random.Random(6)
    bits = ["you", "YOUR", "idiot", "i*iot", "scum", "Calm", "WORDS", "fooling", "fool", "a1b", "!", "?!", "--", ".", "stupid,", "x"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randrange(0, 40))) for _ in range(60)]
    entries = {0: ["calm", "fool"], 4: ["fool"], 5: ["stupi"], 6: ["foolin"]}
    lexicons = {k: np.sort(hash_words(v).view(np.int64)) for k, v in entries.items()}
    raw = [t.encode() for t in texts]
    got = text_features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), lexicons)
    assert np.allclose(got, [naive_features(t, entries) for t in texts])


def test_lexicons_equal_a_plain_count(spark):
    r = random.Random(7)
    rows = [(" ".join(r.choice(["grotty", "grot", "fine", "finer", "ok"]) for _ in range(r.randrange(0, 4))) + f" t{i}", 0) for i in range(200)]
    rows = [(t, int("grot" in t and r.random() < 0.9)) for t, _ in rows]
    got = learn_lexicons(spark.createDataFrame(rows, "text string, toxic long"))
    for k in KINDS:
        want = set()
        for term in {(w[:k] if k else w) for t, _ in rows for w in re.findall("[a-z]+", t) if len(w) >= max(k, 3)}:
            own = [mark for t, mark in rows if any(len(w) >= max(k, 3) and (w[:k] if k else w) == term for w in re.findall("[a-z]+", t))]
            if len(own) >= MIN_DOCS and sum(own) >= MIN_SHARE * len(own):
                want.add(term)
        assert got[k].tolist() == sorted(hash_words(sorted(want)).view(np.int64).tolist())


def test_few_labels_still_teach(spark):
    """Neither a score of all alike nor an error: with few labels both steps take all of them."""
    docs = spark.createDataFrame([(i, "you idiot, you scum" if i % 2 else "a calm sentence about rain") for i in range(12)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], LABELS)
    got = {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()}
    assert all(got[i] > got[i - 1] for i in range(1, 12, 2))


def test_defined_results(spark):
    docs = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (3, "you stupid loser", 1), (3, "you stupid loser", 1), (None, "fine words", 1), (4, "a " * 200_000, 1)],
        DOCS + ", toxic int",
    )
    none = spark.createDataFrame([], LABELS)
    got = score_toxicity(docs, none).collect()
    assert len(got) == 6 and all(r.score == 0 and r.predicted == 0 for r in got)
    assert score_toxicity(docs.limit(0), none).collect() == []
    # enough labels to learn from, with nulls, values out of range and repeats among them
    rows = [(i, ("you idiot, stupid scum " if i % 3 == 0 else "a calm sentence about rain ") + f"w{i % 11} " * (i % 5)) for i in range(400)]
    marks = [(i, int(i % 3 == 0)) for i in range(400)] + [(5, None), (7, 9), (None, 1), (0, 1), (1, 0)]
    many = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(i + 10, t) for i, t in rows], DOCS))
    got = score_toxicity(many, spark.createDataFrame([(None if i is None else i + 10, t) for i, t in marks], LABELS)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 406 and by[10].score > by[11].score and by[10].predicted == 1 and by[11].predicted == 0
    assert all(0 <= r.score <= 1 for r in got)
