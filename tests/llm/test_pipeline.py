import random

import corpus_pipeline
from test_ngram_join import brute


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "source_mix"]


def corpus():
    r = random.Random(11)
    english = "the river of our town runs slowly by old stone walls and under a bridge where people meet in summer".split()
    german = "der alte fluss unserer stadt läuft langsam an grauen mauern vorbei und unter einer brücke hindurch wo menschen sich treffen".split()
    text = lambda words, n: " ".join(r.choice(words) + str(r.randrange(40)) * (r.random() < 0.3) for _ in range(n))
    passage = "which of these seven careful answers explains why the copper kettle sang before dawn on tuesday"
    rows = [(i, text(english if i % 2 else german, r.randrange(30, 120)), "en" if i % 2 else "de", f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, rows[i][1], rows[i][2], "s1") for i in range(0, 20)]  # exact copies
    near = text(english, 100).split()
    for i in range(12):
        near[(7 * i) % 100] = f"swap{i}"
        rows.append((300 + i, " ".join(near), "en", "s2"))
    rows += [(400 + i, text(english, 20) + " " + (passage.upper() if i % 2 else passage.replace("copper", "coper")) + " " + text(english, 20), "en", "s0") for i in range(6)]
    rows += [(500, None, "en", "s0"), (501, "", None, None), (502, "12 34 -- 56", "de", "s0"), (503, text(german, 50), None, None)]
    return rows, [(1, passage), (2, "a question that stands nowhere in any of these documents at all")]


def write(spark, folder, rows, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_run_equals_brute_force(spark, tmp_path):
    rows, items = corpus()
    write(spark, tmp_path, rows, items)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    last = {r[1]: r[0] for r in sorted(left)}
    left = [r for r in left if last[r[1]] == r[0]]
    first = {doc: head for doc, _, head in brute([(r[0], r[1]) for r in left])}
    left = [r for r in left if first[r[0]] == r[0]]
    leaks = {r[0] for r in left if any(w in r[1].lower() for w in ("copper kettle sang", "coper kettle sang"))}
    left = [r for r in left if r[0] not in leaks]
    assert len(leaks) == 6
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in left)
    sizes = {r[0]: len(r[1].split()) for r in left}
    assert {r.doc_id: r.size for r in got} == sizes
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(sizes.values())
    places = [r.position for r in got if r.position is not None]
    assert all(0 <= p <= 1 for p in places)


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_mix_returns_the_position_of_every_copy(spark):
    docs = spark.createDataFrame([(i, "a few words " * (1 + i % 5), f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    got = corpus_pipeline.source_mix(spark, docs, "").collect()
    assert any(r.copies > 1 for r in got)
    assert all(len(r.positions) == r.copies and r.position == (r.positions[0] if r.positions else None) for r in got)
