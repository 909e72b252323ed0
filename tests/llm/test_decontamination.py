import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftscope.llm import decontamination as dc
from tests.llm.conftest import LONG, ROWS

ITEM = " ".join(f"Item{i}" for i in range(30))
REPEATED = " ".join("aa bb" for _ in range(12))
ITEMS = [(1, ITEM), (2, REPEATED), (3, "short item"), (4, None), (5, " -- "), (6, "six words make two shingles here"),
         (1, ITEM.upper())]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w):
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(docs, items, least=0.8, least_words=1):
    best = {}
    for doc, text in docs:
        w = words(text)
        for item, passage in items:
            p = words(passage)
            b = shingles(p)
            for at in range(len(w) - len(p) + 1) if p else ():
                if len(p) < min(5, least_words) and len(w) != len(p):
                    continue
                a = shingles(w[at:at + len(p)])
                if a.keys().isdisjoint(b):
                    continue
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= least and s > best.get((doc, item), (0, 0))[0]:
                    best[doc, item] = (s, at)
    return best


def found(spark, docs, items=ITEMS, **options):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS words", "2 AS shingles")
    rows = dc.contaminations(frame, spark.createDataFrame(items, "item_id bigint, text string"), **options).collect()
    return {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in rows}


@pytest.mark.parametrize("options", [{}, {"max_shingles": 20}])
def test_equals_brute_force(spark, options):
    changed = words(ITEM)
    changed[2] = "other"  # near the edge: most shingles stay
    middle = words(ITEM)
    middle[15] = "other"
    docs = [(0, f"before, {ITEM}! after"), (1, ITEM.replace(" ", "\n###  ").upper()), (2, "x " + " ".join(changed)),
            (3, " ".join(middle)), (4, " ".join(ITEM.split()[:20])), (5, f"{LONG} {REPEATED} {LONG}"), (6, "Short, item."),
            (7, "a short item here"), (8, "SIX words make two shingles here"), (9, None), (10, ""),
            (11, " ".join(words(ITEM)[:28]) + " z z"), (12, REPEATED + " aa bb"), (13, f"{ITEM} {ITEM}"), (None, ITEM)]
    got = found(spark, docs, **options)
    assert got == brute(docs, ITEMS)
    assert {(0, 1), (1, 1), (5, 2), (6, 3), (7, 3), (13, 1), (None, 1)} <= set(got) and not {d for d, _ in got} & {4, 9, 10}
    got = found(spark, docs, least_words=3, **options)
    assert got == brute(docs, ITEMS, least_words=3) and (6, 3) in got and (7, 3) not in got


def test_items_of_one_to_four_words(spark):
    items = [(1, "alpha beta gamma delta"), (2, "Alpha"), (3, "beta gamma"), (4, "alpha alpha alpha"), (5, "beta, GAMMA")]
    docs = [(0, "alpha beta gamma delta"), (1, "see alpha beta gamma delta, here and alpha beta gamma delta"),
            (2, "alpha alpha alpha alpha"), (3, "beta x gamma"), (4, "gamma beta"), (5, "beta gamma"), (6, "ALPHA")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, least_words=5) == brute(docs, items, least_words=5)


def test_windows_meet_few_of_many_items():
    """Of 20,000 items of one length a window meets those it shares shingles with."""
    pick = random.Random(11)
    texts = [" ".join(f"w{pick.randrange(3000)}" for _ in range(30)) for _ in range(20_000)]
    shingled = [dc.shingle_hashes(t)[1] for t in texts]
    index = dc.ItemIndex(np.concatenate(shingled), np.full(26 * len(texts), 30, np.int32),
                         np.repeat(np.arange(len(texts)), 26), 5, 0.8)
    met = [list(index.windows(f"some words before {t} and some behind")) for t in texts[:200]]
    assert all(n in {item for *_, item, _, _ in found} for n, found in enumerate(met))
    windows = sum(len({first for first, *_ in found}) for found in met)
    share = sum(map(len, met)) / windows / len(texts)
    print(f"{share:.2e} of the items of its length meet a window")
    assert share < 0.001


@pytest.mark.parametrize("max_shingles, most", [(10**9, 1), (25, 10)])
def test_slices_hold_as_much_as_asked_or_one_item(spark, max_shingles, most):
    items = dc.benchmark_items(spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    items = items.withColumn("item", F.xxhash64("shingles"))
    slices, filled = dc._slices(items, max_shingles)
    sizes = {}
    for row in items.select("item", F.size("shingles").alias("n")).distinct().collect():
        sizes.setdefault(row.item % slices, []).append(row.n)
    assert all(sum(v) <= max_shingles or len(v) == 1 for v in sizes.values()) and slices <= 1 << most
    assert sorted(sizes) == filled


def test_needed_drops_nothing():
    for n in range(1, 80):
        for shared in range(n + 1):
            if shared / (2 * n - shared) >= 0.8:
                assert shared >= dc.needed(n, 0.8)


def test_decontaminate(spark, odd, none):
    benchmark = spark.createDataFrame([(1, ROWS[0][1]), (2, None)], "item_id bigint, text string")
    kept = dc.decontaminate(odd, benchmark)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 4, 5, 7]
    assert dc.decontaminate(none, benchmark).count() == 0
    assert dc.decontaminate(odd, benchmark.where("false")).count() == len(ROWS)


def brute_of_shorter(docs, items, least=0.8):
    """Documents of fewer words than an item, each as one window."""
    best = {}
    for doc, text in docs:
        for item, passage in items:
            w, p = words(text), words(passage)
            if w and len(w) < len(p):
                a, b = shingles(w), shingles(p)
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= least:
                    best[doc, item] = (s, 0)
    return best


def test_documents_shorter_than_items(spark):
    items = ITEMS[:6]
    docs = [(n, " ".join(words(ITEM)[a:30 - b])) for n, (a, b) in enumerate(
        (a, b) for a in range(5) for b in range(5))]
    docs += [(50, REPEATED[:-6]), (51, "six words make two shingles"), (52, "short"), (53, None),
             (54, " ".join(words(ITEM)[:28] + ["other"]))]
    expected = brute(docs, items)
    for key, value in brute_of_shorter(docs, items).items():
        assert expected.setdefault(key, value) == value
    assert len(expected) > 15
    assert found(spark, docs, items) == expected
    kept = dc.decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"),
                            spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in docs} - {d for d, _ in expected})


def test_radius_loses_nothing_at_the_similarity():
    """Items with one or two words replaced: exact similarity decides, not the distance of the fingerprints."""
    pick, far, most = random.Random(3), 0, 0
    for n in range(4000):
        item = [f"w{pick.randrange(10**6)}" for _ in range(pick.randrange(15, 60))]
        other = list(item)
        for _ in range(1 + n % 2):
            other[pick.randrange(len(other))] = "other"
        (_, a), (_, b) = (dc.shingle_hashes(" ".join(x)) for x in (item, other))
        if dc._similarity(a.tolist(), b.tolist()) >= dc.SIMILARITY:
            one, two = (int(dc._fingerprints(dc._bits(x).sum(axis=0)[None, :], len(x))[0]) for x in (a, b))
            far, most = far + ((one ^ two).bit_count() > 15), max(most, (one ^ two).bit_count())
    assert far > 0 and most <= dc.RADIUS
