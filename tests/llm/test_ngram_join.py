import random
import re

import pytest

from tallyscope.llm.ngram_join import jaccard_components, keep_representatives

SCHEMA = "doc_id long, text string"


def brute(rows, width=5, percent=80):
    def shingles(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        if len(words) < width:
            return {tuple(words)} if words else set()
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}

    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least[find(i)]) for i, (doc, s) in enumerate(sets))


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"W{r.randrange(400)}" for _ in range(400)]
    text = lambda k: [r.choice(vocab) for _ in range(k)]
    common = text(12)
    docs = [text(r.choice([0, 1, 3, 4, 5, 6, 9, 30, 80])) for _ in range(n)]
    base = text(60)
    for k in range(n):  # a large group of near copies, whose ends differ more and more
        docs.append(base[:])
        for _ in range(r.randrange(0, 5)):
            docs[-1][r.randrange(60)] = r.choice(vocab)
    for k in range(10):  # a chain: each is similar to the next only
        docs.append(docs[-1][:])
        docs[-1][6 * k % 55] = "x"
    docs += [common + text(r.randrange(0, 40)) for _ in range(n)]
    docs += [text(20) + common + text(3) for _ in range(n // 2)]
    docs += [d[:] for d in docs[:: 7]]
    r.shuffle(docs)
    sep = [" ", "  ", "\n", "\t"]
    return [(i, "".join(w + r.choice(sep) for w in d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize(("seed", "percent"), [(1, 80), (2, 80), (3, 50)])
def test_equals_brute_force(spark, seed, percent):
    rows = corpus(seed, 60)
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(5), percent=percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, percent=percent)


def test_links_that_no_leader_sees(spark):
    """Short sets share few bands: their links come from the index alone."""
    rows = [(i, " ".join(f"a{(i * 3 + k) % 90}" for k in range(14))) for i in range(30)] + [
        (100 + i, " ".join(f"b{k}" for k in range(24)) + f" c{i}" * (i % 3)) for i in range(12)
    ]
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA), percent=50)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, percent=50)


def test_defined_results(spark):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(5, None), (3, ""), (4, " \n"), (9, "A b c"), (8, "a  B C"), (8, "a  B C"), (7, long), (6, long + " x"), (None, "a b c"), (2, "a b c d")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", component_id int, cls int")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(docs).collect())
    n = 997
    assert got == sorted(
        [("5", 0, "5"), ("3", 0, "3"), ("4", 0, "4"), ("9", 1, "8"), ("8", 1, "8"), ("8", 1, "8"), ("7", n, "6"), ("6", n + 1, "6"), ("None", 1, "8"), ("2", 1, "2")]
    )
    assert jaccard_components(docs.limit(0)).collect() == []


def test_groups_that_only_members_link(spark):
    """Two groups whose leaders are apart and whose members aren't: the bound from the leaders must let them through."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for side in range(2):
        for k in range(40):
            text = base[:]
            for i in r.sample(range(40), 1 + k % 4):
                text[(i + 40 * side) % 80] = f"s{side}x{i}"
            rows.append((len(rows), " ".join(text)))
    for percent in (60, 80, 90):
        got = jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3), percent=percent)
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == brute(rows, percent=percent)


def test_rows_of_one_id_are_told_apart(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "A b c d e f g", "y"), (2, "quite another text of its own", "z"), (3, None, "n"), (3, " ", "m"), (1, "a b c d e f g", "x")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", source string, `__gone.x` int")
    kept = keep_representatives(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text or "") for r in kept.collect())
    assert got == [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "quite another text of its own"), (3, ""), (3, " ")]
    assert keep_representatives(docs.limit(0)).collect() == []


def test_representatives_keep_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (3, None, "z")], SCHEMA + ", source string")
    kept = keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_rows_of_one_id_are_read_once(spark):
    from pyspark.sql import functions as F

    from tallyscope.llm import ngram_join as n

    docs = spark.createDataFrame([(None, f"text number {i} of all the rows without any id {i * 7}") for i in range(300)], SCHEMA)
    keyed = n._keyed(docs)[0]
    mark = n.text_mark(F.col("text"))
    classes = keyed.select(F.monotonically_increasing_id().alias("node"), "doc_id", mark.alias("mark"), F.lit(0).cast("long").alias("s0"), F.lit(0).cast("long").alias("s1"))
    join = n._Join(keyed, n.materialize(classes, "classes"), 5, 80, n.np.zeros(0, dtype=n.np.uint64))
    assert join.texts(join.classes.select("node")).count() == 300
    assert len(jaccard_components(docs).collect()) == 300


def test_thinly_spread_openings_make_no_square_of_pairs(spark, monkeypatch):
    import random

    from tallyscope.llm import ngram_join as n

    r = random.Random(8)
    opening = " ".join(f"open{i}" for i in range(28))
    rows = [(i, opening + " " + " ".join(f"w{r.randrange(10**9)}" for _ in range(32))) for i in range(150)]
    met, real = [], n._Join.met
    monkeypatch.setattr(n._Join, "met", lambda self, groups: met.append(real(self, groups)) or met[-1])
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted((x.doc_id, x.component_id) for x in jaccard_components(docs.repartition(150, "doc_id")).collect()) == [(i, i) for i in range(150)]
    assert met[-1].count() == 0
    monkeypatch.setattr(n, "LONG_LIST", 2)
    text = lambda: [r.choice("abcdefgh") for _ in range(40)]
    base = [text() for _ in range(6)]
    rows = [(i, " ".join([*r.choice(base)[: r.choice([30, 38, 40])], *text()[: r.choice([0, 2, 10])]])) for i in range(80)]
    found = jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(40)).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in found) == brute(rows)
