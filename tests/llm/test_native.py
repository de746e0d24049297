"""The four operators on built-in functions alone."""

import hashlib

import pytest

from tallyscope.llm.components import connected_components
from tallyscope.llm.digest_index import DigestIndex, dedup_once, keep_first, scratch_index
from tallyscope.llm.line_dedup import drop_site_boilerplate
from tallyscope.llm.mixing import curriculum_mix, in_training_order, source_targets, training_sequence
from tallyscope.llm.queries import RULES
from tallyscope.llm.url_filters import Rule, filter_urls

PAGES, DOCS = "page_id long, url string, html string", "doc_id long, text string, source string"


def verdicts(spark, rows, rules=RULES, **more):
    got = filter_urls(spark.createDataFrame(rows, PAGES), rules, **more)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}


def test_rules(spark):
    urls = [
        "http://A.Example.COM/en/5?q#f", "https://x.com/en/77", "http://example.com/en/7x", "https://b.example.com/en/71", "ftp://net/de/1",
        "http://k.example.net/de/8", "http://notexample.net/de/8", "http://org/es/", "http://xorg/es/", None, "no scheme", "http://h.org", "http://h.org?x#y", "http://com/En/1",
    ]
    got = verdicts(spark, [(i, u, None) for i, u in enumerate(urls)])
    assert [got[i] for i in range(len(urls))] == [
        ("a.example.com", "/en/5", "com/en/", "block"), ("x.com", "/en/77", "com/en/", "block"), ("example.com", "/en/7x", "example.com/en/7", "allow"),
        ("b.example.com", "/en/71", "example.com/en/7", "allow"), ("net", "/de/1", "net/de/", "allow"), ("k.example.net", "/de/8", "example.net/de/8", "block"),
        ("notexample.net", "/de/8", "net/de/", "allow"), ("org", "/es/", "org/es/", "block"), ("xorg", "/es/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("h.org", "", None, "allow"), ("h.org", "", None, "allow"), ("com", "/En/1", None, "allow"),
    ]


def test_aliases(spark):
    canonical = lambda u: f'<head><link href="{u}" rel="canonical"></head>'
    refresh = lambda u: f"<meta http-equiv=refresh content='0; URL={u}'>"
    rows = [
        (1, "http://bad.test/a", None), (2, "http://b.test/x", canonical("http://bad.test/a")), (3, "http://c.test/y#f", refresh("http://B.test/x")),
        (4, "http://good.test/z", canonical("//c.test/y")), (5, "http://d.test/1", canonical("/2")), (6, "http://d.test/2", refresh("http://bad.test/q")),
        (7, "http://e.test/", canonical("relative")), (8, "http://c.test/other", None), (8, "http://c.test/other", None), (9, None, canonical("http://bad.test/a")),
    ]
    rules = [Rule("block", "bad.test", "/"), Rule("allow", "good.test", "/")]
    got = verdicts(spark, rows, rules)
    assert {i: v[3] for i, v in got.items()} == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "allow"}
    got = verdicts(spark, rows, rules[:1])
    assert {i for i, v in got.items() if v[3] == "block"} == {1, 2, 3, 4, 5, 6}
    moved = spark.createDataFrame([("http://c.test/other", "http://bad.test/moved"), (None, "http://bad.test/a"), ("x", "y")], "from_url string, to_url string")
    assert verdicts(spark, rows, rules, redirects=moved)[8][3] == "block"
    assert verdicts(spark, [], rules) == {}


def test_components_equal_union_find(spark):
    import random

    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = connected_components(spark.createDataFrame(edges + [(7, None), (5, 5)], "a long, b long")).collect()
    assert {(g.node, g.component) for g in got} == {(x, find(x)) for x in parent if find(x) != x}
    assert len(got) == len({g.node for g in got})


def test_line_dedup(spark):
    nav = "<nav><ul><li>Home</li><li>Me &amp; you</li></ul></nav>"
    rows = [(i, f"http://s.test/{i}", f"<html><script>x</script>{nav}<p>Text <b>{i}</b></p><p>Home</p>{'<p>rare</p>' * (i < 3)}</html>") for i in range(6)]
    rows += [(20 + i, f"http://u.test/{i}", f"{nav}<p>own {i}</p><script>never closed {'<script' * 20_000 * (i == 1)}") for i in range(2)]
    rows += [(10, "http://t.test/1", nav), (11, None, nav), (12, "http://s.test/7", None), (12, "http://s.test/7", ""), (13, "http://s.test/8", "<p>" + "long " * 100_000 + "</p>")]
    docs = spark.createDataFrame([(*r, 5, 6) for r in rows], PAGES + ", row int, lines int")
    got = {}
    for r in drop_site_boilerplate(docs).collect():
        got.setdefault(r.page_id, []).append((r.host, r.n_lines, r.n_dropped, r.text))
    assert got[0] == [("s.test", 5, 3, "Text 0\nrare")] and got[5] == [("s.test", 4, 3, "Text 5")]
    assert got[10] == [("t.test", 2, 2, "")] and got[11] == [("", 2, 2, "")]  # a line of a host's only page is on all its pages
    assert got[20] == [("u.test", 3, 2, "own 0")] and got[21] == [("u.test", 3, 2, "own 1")]
    assert got[12] == [("s.test", 0, 0, "")] * 2 and got[13][0][1:3] == (1, 0)
    assert drop_site_boilerplate(docs.limit(0)).collect() == []
    kept = {r.page_id: r.text for r in drop_site_boilerplate(docs, min_seen=2).collect()}
    assert kept[10] == "Home\nMe &amp; you" and kept[0] == "Text 0\nrare"


def test_text_after_an_unclosed_script_is_read(spark, tmp_path):
    import random
    import time

    import duckdb

    from tallyscope.llm.queries import QUERIES, SQL

    pages = ["<p>own</p><script>never <p>closed</p>", "<style><p>a</p><script>x</script><p>b</p><!-- y --><p>c</p>", "<p>a</p><!-- b <style>c</style> d <script>e", "<script " * 100_000 + "<p>end</p>"]
    rng, parts = random.Random(5), ("<script>", "</script>", "<style>", "</style>", "<!--", "-->", "<p>", "a", "b ", "\n", "<scr", "ipt", "<scripted>", "<!-->")
    pages += ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(1000)]
    spark.createDataFrame([(i, f"http://h.test/{i}", x) for i, x in enumerate(pages)], PAGES).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    began = time.time()
    found = QUERIES["op2_line_dedup"](spark, str(tmp_path))
    got, twin = found.collect(), db.sql(SQL["op2_line_dedup"])
    assert time.time() - began < 60
    places = [twin.columns.index(c) for c in found.columns]
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(tuple(r[i] for i in places)) for r in twin.fetchall())
    n_lines = {r.page_id: r.n_lines for r in got}
    assert [n_lines[i] for i in range(4)] == [3, 3, 2, 2]


def test_unclosed_tags_are_text_and_cost_no_rescan(spark):
    import time

    rows = [(1, "http://s.test/1", "<p " * 400_000), (2, "http://s.test/2", "<" * 1_000_000), (3, "http://s.test/3", "a <b <i>c</i> d < e > f"), (4, "http://s.test/4", "<link " * 300_000)]
    began = time.time()
    got = {r.page_id: r.text for r in drop_site_boilerplate(spark.createDataFrame(rows, PAGES), min_seen=2).collect()}
    assert got[1] == ("<p " * 400_000).strip() and got[2] == "<" * 1_000_000 and got[3] == "a <b c d  f"
    assert {v[3] for v in verdicts(spark, rows).values()} == {"allow"}
    assert time.time() - began < 60


def test_exact_dedup(spark):
    rows = [(1, "x"), (2, "y"), (3, "x"), (3, "x"), (4, None), (5, ""), (6, " x"), (None, "z"), (7, "long " * 200_000), (8, "long " * 200_000), (9, "y")]
    docs = spark.createDataFrame([(*r, "s", 0) for r in rows], DOCS + ", digest int")
    index = scratch_index(spark, buckets=3)
    first = index.dedup(docs)
    got = first.collect()
    assert len(got) == len(rows)
    by = lambda text: sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()), key=str)
    assert by("x") == [(1, 3, 3, False), (3, 3, 3, False), (3, 3, 3, True)]
    assert by("y") == [(2, 9, 2, False), (9, 9, 2, True)] and by("") == [(4, 5, 2, False), (5, 5, 2, True)]
    assert by(" x") == [(6, 6, 1, True)] and by("z") == [(None, None, 1, True)]
    kept = keep_first(docs, first)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["3", "5", "6", "8", "9", "None"]
    # a second batch meets the index, also when it is opened anew where no catalog knows it
    index.close()
    assert not spark.catalog.tableExists(index.table)
    again = DigestIndex(spark.newSession(), index.path)
    again.spark.conf.set("spark.sql.shuffle.partitions", 7)
    assert again.buckets == 3 and again.rows().count() == 6
    more = spark.createDataFrame([(20, "y", "s"), (21, "new", "s"), (22, "new", "s")], DOCS)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in again.dedup(more).collect())
    assert got == [(20, 9, 2, False), (21, 22, 2, False), (22, 22, 2, True)]
    assert again.rows().count() == 7
    assert again.dedup(docs.limit(0)).collect() == [] and again.rows().count() == 7
    # more buckets: the same rows, and the same answers
    again.rebuild(5)
    once_more = DigestIndex(spark, index.path)
    assert once_more.buckets == 5 and once_more.rows().count() == 7
    assert not any(r.kept for r in once_more.dedup(docs).collect()) and once_more.rows().count() == 7


def test_no_rows_are_lost_between_handles_and_broken_writes(spark, monkeypatch):
    index = scratch_index(spark, buckets=2)
    other = DigestIndex(spark, index.path)  # both opened empty
    docs = spark.createDataFrame([(i, f"t{i}", "s") for i in range(10)], DOCS)
    rows = lambda df: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())
    first = rows(index.dedup(docs, batch="monday"))
    assert len(first) == 10 and all(r[3] for r in first)
    assert rows(other.dedup(docs)) == [(*r[:3], False) for r in first]
    # the same batch again, by another handle and session: the same answer, and nothing is appended
    again = DigestIndex(spark.newSession(), index.path)
    assert rows(again.dedup(docs, batch="monday")) == first and again.rows().count() == 10
    # a write that dies before it is noted leaves no trace
    more = spark.createDataFrame([(20 + i, f"u{i}", "s") for i in range(5)], DOCS)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(DigestIndex, "_note", dies)
        with pytest.raises(RuntimeError, match="lost"):
            again.dedup(more, batch="tuesday")
    assert spark.read.parquet(f"{index.path}/{index.folder}").count() == 15
    assert DigestIndex(spark, index.path).rows().count() == 10
    assert rows(index.dedup(more, batch="tuesday")) == [(20 + i, 20 + i, 1, True) for i in range(5)]
    assert rows(other.dedup(more)) == [(20 + i, 20 + i, 1, False) for i in range(5)]
    # dealt anew: the half-written rows are gone, answers and batches stay, and so does no old folder
    folder = index.folder
    index.rebuild(3)
    assert spark.read.parquet(f"{index.path}/{index.folder}").count() == 15
    assert rows(other.dedup(docs, batch="monday")) == first and other.rows().count() == 15
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{index.path}/{folder}")


def test_the_index_is_not_shuffled(spark):
    from pyspark.sql import functions as F

    index = scratch_index(spark, buckets=3)
    index.dedup(spark.createDataFrame([(i, f"t{i}", "s") for i in range(50)], DOCS))
    groups = spark.range(9).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        plan = index._dealt(groups, index.buckets).join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1


def test_rows_of_one_id_are_told_apart(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "something else entirely here and there", "y"), (2, "a b c d e f g", "z"), (2, None, "w"), (2, "", "v"), (None, "a b c d e f g", "u")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", `__gone.x` int")
    kept = keep_first(docs, dedup_once(docs))
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert got == [("1", "something else entirely here and there"), ("2", ""), ("2", "a b c d e f g")]


def fill(sizes, weights, ratio, most):
    """The targets by resharing the excess again and again."""
    left, capped = ratio * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        room = left - sum(most * sizes[i] for i in capped)
        share = {i: room * weights[i] / sum(weights[k] for k in free) for i in free}
        over = {i for i in free if share[i] > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


@pytest.mark.parametrize("sizes", [[100, 900, 30, 5, 700, 1], [10, 10, 10], [1, 1000], [7], [0, 5, 5]])
def test_targets_equal_resharing(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
    got = {r.source: r.target for r in source_targets(rows, (5.0, 2.0, 1.0), 1.5, 2).collect()}
    want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5, 2)
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_curriculum(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 4}" if i % 9 else None, 0) for i in range(2000)] + [(3000, None, "s0", 0), (3000, None, "s0", 0)]
    docs = spark.createDataFrame(rows, DOCS + ", rank int")
    mix = in_training_order(curriculum_mix(docs))
    got = mix.collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {r[0] for r in rows}
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert len({r.target for r in own}) == 1 and sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 17
    assert all(r.taken == r.copies * r.size and r.copies == len(r.positions) and r.taken <= 2 * r.size for r in got)
    placed = [r.position for r in got if r.position is not None]
    assert placed == sorted(placed) and all(0 <= p <= 1 for p in placed)
    steps = [r.position is not None for r in got]
    assert steps == sorted(steps, reverse=True)
    again = in_training_order(curriculum_mix(docs.repartition(7))).collect()
    assert [(r.doc_id, r.taken, r.positions) for r in again] == [(r.doc_id, r.taken, r.positions) for r in got]
    # the share of a source among the words up to time t follows the integral of its schedule
    copies = training_sequence(curriculum_mix(docs)).collect()
    early = [c for c in copies if c.position < 0.5]
    for source, share in (("s0", 0.625), ("s1", 0.5), ("s2", 0.375)):
        words = lambda rows: sum(c.size for c in rows if c.source == source)  # noqa: B023, E731
        assert words(early) / words(copies) == pytest.approx(share, abs=0.03)
    assert in_training_order(curriculum_mix(docs.limit(0))).collect() == []
    empty = in_training_order(curriculum_mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], DOCS)))
    assert sorted((r.doc_id, r.size, r.taken) for r in empty.collect()) == [(1, 0, 0), (2, 0, 0)]
