import math
import random

from pyspark.sql import functions as F

from driftscope.llm import topk


def brute(rows, k, asks):
    usable = {i: [math.floor(256 * x) for x in v] for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in usable.items():
        if asks(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def ask(spark, rows, k=5, element="float"):
    frame = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{element}>")
    frame = frame.selectExpr("*", "1 AS score", "2 AS rank", "3 AS id", "4 AS v").repartition(4)
    return sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 10 == 0, k).collect())


def test_equals_brute_force_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 70)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 15)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(12)]) for i in range(500)]
    rows += [(1000 + i, [0.125] * 12) for i in range(60)]  # many equal vectors: ties go to smaller ids
    assert ask(spark, rows, element="double") == brute(rows, 5, lambda i: i % 10 == 0)


def test_stops_early_and_stays_exact():
    import numpy as np
    rng = np.random.default_rng(1)
    vectors = np.zeros((3000, 4), np.int64)
    vectors[:, 0] = rng.permutation(3000)
    vectors[:, 1] = rng.integers(0, 3, 3000)
    found = topk.threshold_top(vectors, np.array([[5, 1, 0, -1]]), np.array([7]), 3)
    scores = vectors @ np.array([5, 1, 0, -1])
    want = sorted((-scores[i], i) for i in range(3000) if i != 7)[:3]
    assert found == [(0, i, -s) for s, i in want]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (10, None), (20, [1.0, None]), (30, [float("nan"), 1.0]), (40, [float("inf"), 1.0]),
            (50, []), (60, [3.0]), (None, [9.0, 9.0]), (1, [1e30, 1.0]), (2, [-1e30, 0.0])]
    got = ask(spark, rows)
    assert {q for q, *_ in got} == {0, 50, 60}
    assert [i for q, _, i, _ in got if q == 0] == [1, None, 60, 50, 2]
    assert max(s for *_, s in got) == 2 ** 63 - 1 and min(s for *_, s in got) == -2 ** 63
    assert [(i, s) for q, _, i, s in got if q == 50] == [(0, 0), (1, 0), (2, 0), (60, 0), (None, 0)]
    assert ask(spark, [(0, [1.0])]) == []
    assert ask(spark, []) == []


def test_rows_with_equal_or_no_ids_are_candidates_each(spark):
    got = ask(spark, [(0, [1.0]), (3, [2.0]), (3, [0.5]), (3, [2.0]), (None, [4.0]), (None, [4.0])])
    assert sorted(got, key=lambda r: r[1]) == [
        (0, 1, None, 262144), (0, 2, None, 262144), (0, 3, 3, 131072), (0, 4, 3, 131072), (0, 5, 3, 32768)]
    # each of two queries with one id finds the other
    assert ask(spark, [(0, [1.0]), (0, [3.0]), (9, [0.5])], k=1) == [(0, 1, 0, 196608), (0, 1, 0, 196608)]


def test_rows_with_repeated_ids_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 10)
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(60)]), [rng.choice([-0.5, 0.25, 1.0]) for _ in range(6)]) for _ in range(300)]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for n, (q, a) in enumerate(whole):
        if q is not None and q % 10 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i is None, i or 0)
                          for m, (i, b) in enumerate(whole) if m != n)[:5]
            want += [(q, r + 1, -1 if none else i, -s) for r, (s, none, i) in enumerate(best)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    got = topk.top_k(frame, F.col("vec_id") % 10 == 0).na.fill(-1, ["vec_id"]).collect()
    assert sorted(map(tuple, got)) == sorted(want)
