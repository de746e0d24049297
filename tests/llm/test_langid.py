import math
import os

import pytest

from tallyscope.llm.langid import MIN_CONTEXT, ORDER, identify, keep_identified, train

SCHEMA = "doc_id long, text string, lang string"
SF = "/root/testdata/sf0.01"


def naive_bits(train_texts, text):
    """Code length by walking the contexts from the longest down, with escapes."""
    counts = {}
    for t in train_texts:
        s = [0] * ORDER + [b + 1 for b in t.encode()]
        for i in range(ORDER, len(s)):
            for k in range(ORDER + 1):
                own = counts.setdefault((k, tuple(s[i - k : i])), {})
                own[s[i]] = own.get(s[i], 0) + 1
    return counts


def walk(counts, kept, text):
    s = [0] * ORDER + [b + 1 for b in text.encode()]
    bits = 0.0
    for i in range(ORDER, len(s)):
        for k in range(ORDER, -2, -1):
            if k < 0:
                bits += 8.0
                break
            context = tuple(s[i - k : i])
            if k == ORDER and context not in kept:
                continue
            own = counts.get((k, context))
            if not own:
                continue
            total, kinds = sum(own.values()), len(own)
            if s[i] in own:
                bits -= math.log2(own[s[i]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
    return bits


def test_code_lengths_equal_the_walk(spark):
    texts = {"aa": ["the cat sat on the mat. " * 4, "a cat and a hat"], "bb": ["der hund und die katze über dem haus " * 3, "ein hund"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((x, t) for x in texts for t in texts[x])]
    trees = train(spark.createDataFrame(rows, SCHEMA))
    assert trees.langs == ["aa", "bb"]
    counts = {x: naive_bits(texts[x], "") for x in texts}
    kept = {c for x in texts for (k, c), own in counts[x].items() if k == ORDER and sum(own.values()) >= MIN_CONTEXT}
    import numpy as np

    for text in ("the hund sat", "q", "über", "\x00\x01 zzz", "the cat " * 30):
        raw = text.encode()
        got = trees.code_lengths(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), at_once=7)[0]
        assert got == pytest.approx([walk(counts[x], kept, text) for x in trees.langs], rel=1e-5)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify(docs, max_docs=150).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_defined_results(spark):
    rows = [(i, f"the cat number {'x' * (i % 5)} sat down", "en", 1) for i in range(30)] + [(i, "der hund bellt über das haus", "de", 1) for i in range(30, 60)]
    rows += [(60, None, "en", 1), (61, "", None, 1), (62, "12 34 !!", "de", 1), (63, "the cat", None, 1), (63, "the cat", None, 1), (64, "der hund " * 50_000, None, 1), (None, "das haus", "de", 1)]
    docs = spark.createDataFrame(rows, SCHEMA + ", score int")
    got = {(r.doc_id, r.lang_pred) for r in identify(docs).collect()}
    assert {(60, "und"), (61, "und"), (62, "und"), (63, "en"), (64, "de"), (None, "de")} <= got
    assert identify(docs).count() == len(rows)
    assert {r.lang_pred for r in identify(docs.where("lang is null")).collect()} == {"und"}
    assert identify(docs.limit(0)).collect() == []
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_kept_rows_keep_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(i, f"the river runs by the old town number {i} in summer" if i % 2 else f"der alte fluss nummer {i} der stadt im sommer", "en" if i % 2 else "de", 1, 2, 3) for i in range(60)]
        + [(1, "12 34", "en", 1, 2, 3), (100, None, None, 1, 2, 3)],
        "doc_id long, text string, lang string, __lang int, score int, `__letters.x` int",
    )
    kept = keep_identified(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == list(range(60)) and all(tuple(r)[3:] == (1, 2, 3) for r in rows)
    assert keep_identified(docs.limit(0)).collect() == []
