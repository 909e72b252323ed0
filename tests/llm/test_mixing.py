import math

from pyspark.sql import functions as F

from driftscope.llm import mixing
from driftscope.llm.scratch import Scratch
from tests.llm.conftest import CLASHING, ROWS


def levels(sizes, weights=(5, 2, 1), limit=3):
    """Targets by sharing again and again until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), set()
    while True:
        left = total - sum(limit * sizes[s] for s in fixed)
        shared = sum(weight[s] for s in order if s not in fixed)
        target = {s: limit * sizes[s] if s in fixed else left * weight[s] / shared for s in order}
        above = {s for s in order if target[s] > limit * sizes[s]}
        if not above:
            return target
        fixed |= above


def test_targets(spark):
    sizes = {"a": 100, "b": 7, "c": 1, "d": 9000, "e": 0, None: 40, "f": 3}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(Scratch(spark, "t"), rows).collect()}
    want = levels(sizes)
    assert all(math.isclose(got[s], want[s]) for s in sizes) and math.isclose(sum(got.values()), 9151)


def test_copies_follow_rates(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'x y' AS text", "if(id % 4 = 0, 'a', 'b') AS source")
    mixed = mixing.mix(docs).groupBy("source").count().collect()
    target = levels({"a": 2000, "b": 6000})
    for row in mixed:
        assert abs(row["count"] * 2 - target[row.source]) < 0.05 * target[row.source]
    again = mixing.mix(docs.repartition(7)).groupBy("doc_id").count()
    assert sorted(again.collect()) == sorted(mixing.mix(docs).groupBy("doc_id").count().collect())


def test_odd_rows(spark, odd, none):
    words = {r.doc_id: r.n for r in odd.select("doc_id", mixing.words(F.col("text")).alias("n")).collect()}
    assert [words[i] for i in (1, 2, 3, 4, 5)] == [9, 0, 0, 0, 40_000]
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    # a source without words has target 0
    assert {r.source for r in mixed.select("source").distinct().collect()} <= {"a", "b", "\u00e9", None}
    targets = mixing.source_targets(Scratch(spark, "t"), odd.select("source", mixing.words(F.col("text")).alias("size")))
    counted = mixing.with_copies(odd, targets)
    assert counted.count() == len(ROWS) and set(CLASHING) <= set(counted.columns)
    assert counted.schema["copies"].dataType.simpleString() == "bigint"
    assert max(r.copies for r in counted.collect()) <= 3
    assert mixing.mix(none).count() == 0
