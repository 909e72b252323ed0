import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from driftscope.llm import near_copies as nc
from tests.llm.conftest import LONG, ROWS


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """Ids that stay: the smallest of each component of pairs at 0.8 or more."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            low, high = sorted((top(i), top(j)))
            root[high] = low
    return sorted(docs[i][0] for i in range(len(docs)) if top(i) == i)


def planted():
    pick = random.Random(7)
    texts = []
    for n in range(60):
        base = [f"w{pick.randrange(5000)}" for _ in range(pick.randrange(40, 200))]
        texts.append(base)
        for _ in range(4):  # from well above to below 0.8, some of them chains
            base = list(base)
            for _ in range(pick.randrange(1, 1 + max(1, len(base) // 40))):
                base[pick.randrange(len(base))] = f"new{pick.randrange(10**6)}"
            texts.append(base)
    texts += [["one", "two"], ["One", "two"], ["one", "three"], ["a"] * 50, ["a"] * 60]
    docs = [(i, "  ".join(t)) for i, t in enumerate(texts)]
    return docs + [(len(docs), ""), (len(docs) + 1, None), (len(docs) + 2, LONG), (len(docs) + 3, LONG + " end")]


@pytest.mark.parametrize("options", [{}, {"cell_shingles": 200}])
def test_equals_brute_force(spark, options):
    docs = planted()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    expected = brute(docs)
    assert len(expected) < len(docs) - 100
    assert sorted(r.doc_id for r in nc.drop_near_copies(frame, **options).collect()) == expected


def test_stage_finds_near_copies(spark):
    """Pairs at 0.8 that lie more than three bits apart, which the stage kept both of before."""
    docs = planted()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, "")
    assert sorted(r.doc_id for r in kept.collect()) == brute(docs)


def test_fingerprints_within_three_bits_are_candidates(spark, monkeypatch):
    """Ball hashing by itself, without any band."""
    monkeypatch.setattr(nc, "bands", lambda shingles: np.zeros(0, np.int64))
    texts = [" ".join(f"w{i}x{n}" for i in range(2000)) for n in range(3)]
    docs = [(i, t + end) for i, t in enumerate(texts) for end in ("", " more")]
    docs = [(2 * i + e, t) for e in (0, 1) for i, t in enumerate(t for _, t in docs[e::2])]
    prints = [nc.majority(nc.shingle_set(nc._tokens(t.encode()))) for _, t in sorted(docs)]
    assert all(1 <= (a ^ b).bit_count() <= 3 or a == b for a, b in zip(prints[::2], prints[1::2]))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in nc.drop_near_copies(frame).collect()) == [0, 2, 4]


def test_odd_rows(spark, odd, none):
    kept = nc.drop_near_copies(odd)
    assert kept.columns == odd.columns and nc.drop_near_copies(none).count() == 0
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 7]
    assert nc.near_copies(odd).count() == len(ROWS)
