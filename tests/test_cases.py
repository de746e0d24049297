import pytest


@pytest.mark.parametrize("name", ["q07_source_claim_alignment", "q09_key_point_recall", "q10_compression_curve"])
@pytest.mark.parametrize("ids", [range(0, 60), [3, 70, 900]])
def test_every_item_has_documents(spark, tmp_path, name, ids):
    from tallyscope.queries import QUERIES

    items = [(i, f"The passage of number {i} stands here.") for i in ids]
    docs = [(d, f"The passage of number {items[d % len(items)][0]} stands here. ") for d in range(120)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(120))
    if name == "q10_compression_curve":
        assert {r.ratio for r in got} == {1.0}
    else:
        assert {(r.item_id, r.doc_id, r.score) for r in got} == {(items[d % len(items)][0], d, 1.0) for d in range(120)}


def test_cases_of_any_number_of_items(spark):
    """Also where there are more items than in the smallest tables."""
    from tallyscope.plans.documents import with_cases

    items = spark.createDataFrame([(3 * i,) for i in range(57)], "item_id long")
    docs = spark.createDataFrame([(i,) for i in range(400)], "doc_id long")
    got = with_cases(docs, items).collect()
    assert len(got) == 400 and {r.item_id for r in got} == {3 * i for i in range(57)}


def test_running_sums_equal_a_plain_loop(spark):
    import random

    from pyspark.sql import functions as F

    from tallyscope.operators.sampling import running_before

    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), i * i % 1009 + i * 1009, r.randrange(9)) for i in range(700)]
    got = running_before(spark.createDataFrame(rows, "k string, seq long, v long"), "k", "seq", F.col("v"), "before").collect()
    total, want = {}, {}
    for k, seq, v in sorted(rows, key=lambda x: x[1]):
        want[seq] = total.get(k, 0)
        total[k] = want[seq] + v
    assert {x.seq: x.before for x in got} == want
