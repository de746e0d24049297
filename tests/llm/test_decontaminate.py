import random

import numpy as np
import pytest

from tallyscope.llm.decontaminate import SEGMENT, Passages, banded_edits, budget, drop_contaminated, find_passages, find_regions

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def plain(text):
    return " ".join("".join(c.lower() if c.isascii() else c for c in text).split()).encode()


def least_edits(pattern, text):
    """Edit distance of `pattern` to the nearest run of `text`."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(r, text, edits):
    text = list(text)
    for _ in range(edits):
        i = r.randrange(len(text))
        kind = r.randrange(3)
        if kind == 0:
            text[i] = r.choice("xyz")
        elif kind == 1:
            text.insert(i, r.choice("xyz"))
        elif len(text) > 1:
            del text[i]
    return "".join(text)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "é"]) for _ in range(r.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(r.choice([2, 4, 8, 16]))) for i in range(12)]
    docs = []
    for i in range(80):
        parts = [prose(r.randrange(0, 25))]
        if i % 2:
            one = r.choice(items)[1]
            parts += [edited(r, one.upper() if i % 4 == 1 else one.replace(" ", " \n "), r.randrange(0, 12)), prose(r.randrange(0, 9))]
        docs.append((i, " ".join(parts)))
    hits = find_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    want = set()
    for i, text in docs:
        for k, item in items:
            p = plain(item)
            assert len(p) <= SEGMENT + SEGMENT // 2
            if budget(len(p)) >= 0 and least_edits(p, plain(text)) <= budget(len(p)):
                want.add((i, k))
    assert {(h.doc_id, h.item_id) for h in hits} == want
    assert len(hits) == len(want)
    by = {i: t.encode() for i, t in docs}
    for h in hits:
        assert 0 <= h.start < h.end <= len(by[h.doc_id])


def test_part_of_a_long_passage(spark):
    r = random.Random(5)
    item = " ".join(str(r.random()) for _ in range(40))
    docs = [(1, "before " + item[200:390] + " after"), (2, "before " + item[200:290] + " after"), (3, "nothing")]
    hits = find_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(4, item)], ITEMS))
    assert [(h.doc_id, h.item_id, h.edits) for h in hits.collect()] == [(1, 4, 0)]


def test_part_of_a_passage_of_one_and_a_half_segments(spark):
    r = random.Random(6)
    item = " ".join(str(r.random()) for _ in range(9))[:175].strip()
    assert SEGMENT < len(item) <= SEGMENT + SEGMENT // 2
    middle = list(item)
    for k in range(60, 60 + 2 * (len(item) // 10), 2):
        middle[k] = "#"  # as many edits as the whole allows, more than a segment does
    docs = [(1, "before " + item[:125] + " after"), (2, "before " + item[-125:] + " after"), (3, "before " + item[:90]), (4, "a " + item), (5, "a " + "".join(middle))]
    hits = find_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(4, item)], ITEMS))
    assert sorted((h.doc_id, h.edits) for h in hits.collect()) == [(1, 0), (2, 0), (4, 0), (5, len(item) // 10)]


def test_short_passages(spark):
    """Also those whose length leaves no room for 8-grams: q shrinks until the bound holds."""
    r = random.Random(8)
    items = [(n, "".join(r.choice("abcdefgh") for _ in range(n))) for n in (1, 3, 7, 8, 10, 12, 15, 17, 21, 23, 30, 31)]
    docs = []
    for i in range(120):
        n, text = r.choice(items[1:])
        docs.append((i, "".join(r.choice("mnop ") for _ in range(r.randrange(30))) + edited(r, text, r.randrange(0, 4)) + "".join(r.choice("mnop ") for _ in range(9))))
    got = {(h.doc_id, h.item_id) for h in find_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(i, k) for i, t in docs for k, item in items if least_edits(plain(item), plain(t)) <= budget(len(item))}
    few = spark.createDataFrame([(1, "abc"), (2, "x")], DOCS)
    assert [h.doc_id for h in find_passages(few, spark.createDataFrame([(5, "b")], ITEMS)).collect()] == [1]
    assert drop_contaminated(few, spark.createDataFrame([(5, "b")], ITEMS)).count() == 2


def test_a_common_opening_of_many_passages():
    """The places of its q-grams are counted in parts, so that what is held is bounded."""
    import tracemalloc

    opening = "which of the following statements about the history of the town is true "
    r = random.Random(2)
    items = [(i, (opening + " ".join(str(r.random()) for _ in range(8))).encode()[:175]) for i in range(2000)]
    index = Passages(items)
    text = ((opening + "and so on ") * 20).encode() + items[7][1]
    data = np.frombuffer(text, np.uint8)
    tracemalloc.start()
    found = find_regions(data, np.array([0, len(data)]), index)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert 7 in {index.item[s] for s in found[:, 1]}


def test_windows_of_a_long_text(spark):
    passage = " ".join(str(random.Random(3).random()) for _ in range(9))[:150]
    fill = "words without end " * 1000
    long = fill * 58 + passage[:140] + "#" + passage[141:] + " " + fill * 60 + passage + fill
    hits = find_passages(spark.createDataFrame([(1, long), (2, fill)], DOCS), spark.createDataFrame([(4, passage)], ITEMS)).collect()
    assert [(h.doc_id, h.item_id, h.edits) for h in hits] == [(1, 4, 0)]
    first, last = long.index(passage[:140]), long.rindex(passage)
    assert hits[0].start <= first and hits[0].end >= last + len(passage)


def test_rows_of_one_id_are_told_apart(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs away"
    docs = spark.createDataFrame([(1, passage, 0), (1, "clean", 0), (None, passage, 0), (None, None, 0), (2, passage, 0), (2, passage, 0)], DOCS + ", `__leak.x` int")
    kept = drop_contaminated(docs, spark.createDataFrame([(7, passage)], ITEMS))
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "clean"), ("None", None)]


def test_banded_edits():
    regions = [b"zzabcdefghzzzz", b"zzabXdefghzzzz", b"zzabdefghzzzzz", b"zzabcdXXefghzz"]
    rows = lambda x: np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)
    assert banded_edits(rows([b"abcdefgh"] * 4), rows(regions), 6).tolist() == [0, 1, 1, 2]


def test_defined_results(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs away"
    long = "filler words go on and on " * 40_000
    docs = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (3, long + passage, 0), (None, passage, 0), (4, passage, 0), (4, passage, 0)], DOCS + ", item_id int"
    )
    items = spark.createDataFrame([(7, passage), (7, passage), (8, None), (9, ""), (10, "short"), (11, passage)], ITEMS)
    got = sorted((str(h.doc_id), h.item_id) for h in find_passages(docs, items).collect())
    assert got == [("3", 7), ("3", 11), ("4", 7), ("4", 11), ("None", 7), ("None", 11)]
    assert sorted(r.doc_id for r in drop_contaminated(docs, items).collect()) == [1, 2]
    assert drop_contaminated(docs, items).columns == docs.columns
    assert find_passages(docs, items.limit(0)).collect() == []
    assert find_passages(docs.limit(0), items).collect() == []


def test_places_of_one_segment_are_counted_in_windows(monkeypatch):
    from tallyscope.llm import decontaminate as d

    r = random.Random(3)
    for base in ("_" * 120, "ab" * 60, "".join(r.choice("abc") for _ in range(120))):
        text = np.frombuffer((base * 12 + "zz" + base[:80] * 9 + edited(r, base, 5)).encode(), dtype=np.uint8)
        index, ends = Passages([(1, base.encode())]), np.array([0, len(text)])
        monkeypatch.setattr(d, "AT_ONCE", 1 << 30)
        whole = sorted(map(tuple, find_regions(text, ends, index).tolist()))
        monkeypatch.setattr(d, "AT_ONCE", 500)
        assert whole and sorted(map(tuple, find_regions(text, ends, index).tolist())) == whole


def test_a_self_similar_text_takes_bounded_memory():
    import subprocess
    import sys

    code = (
        "import sys, resource, numpy as np; sys.path.insert(0, '.')\n"
        "from tallyscope.llm.decontaminate import Passages, find_regions\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "text = np.full(500_000, 95, dtype=np.uint8)\n"
        "assert len(find_regions(text, np.array([0, len(text)]), Passages([(1, b'_' * 120)]))) > 30_000\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)"
    )
    taken = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) // 1024
    assert taken < 500


def test_the_sieve_is_of_the_size_of_its_grams():
    from tallyscope.llm.decontaminate import Passages

    text = b"a passage of a benchmark that a worker holds a sieve for"
    (own,) = Passages([(1, text)]).grams
    assert 16 * len(own.gram) <= len(own.sieve) <= 32 * len(own.gram) + 1024 and own.sieve.sum() <= len(own.gram)
