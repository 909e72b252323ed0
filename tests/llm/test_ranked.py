import re
from collections import Counter

import numpy as np
import pytest

from driftscope.llm import ranked
from tests.llm.conftest import ROWS


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    own = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n, total = sum(size > 0 for *_, size in own), sum(size for *_, size in own)
    holding = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, count, size in own:
            m = 75 + 25 * size * n // total if total else 0
            score = sum(ranked.term_weight(n, holding[t]) * (10**9 * count[t] // (1000 * count[t] + 12 * m))
                        for t in words(text) if count[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def rows(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    draw = np.random.default_rng(3)
    pool = [f"w{i}" for i in range(300)]
    def text(n):
        return " ".join(pool[int(i)] for i in np.minimum(draw.zipf(1.3, n) - 1, 299))
    docs = [(i, text(int(draw.integers(0, 60)))) for i in range(900)]
    docs += [(i + 900, docs[i][1]) for i in range(0, 60, 2)]
    return docs, [(i, text(int(draw.integers(0, 12)))) for i in range(40)]


def test_equal_to_all_scores(spark, texts):
    docs, items = texts
    one = spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    two = spark.createDataFrame(items, "item_id int, text string")
    want = brute(docs, items, 7)
    counted = []
    assert rows(ranked.ranked(one, two, k=7, counted=counted)) == want
    scored = {r.item: r.n for r in counted[0].collect()}
    assert 0 < scored[-1] < scored[-2]
    # several blocks of items
    assert rows(ranked.ranked(one, two, k=7, block_bytes=200)) == want


@pytest.mark.parametrize("groups", [1, 7, 4096])
def test_bounds_hold(groups):
    draw = np.random.default_rng(groups)
    dense = draw.integers(0, 10**6, (200, 50)) * (draw.random((200, 50)) < 0.2)
    edge = np.concatenate([[0], np.cumsum((dense > 0).sum(axis=1))])
    tree = ranked.BallTree(ranked.Rows(edge, np.nonzero(dense)[1], dense[dense > 0], 50), groups)
    query = draw.integers(0, 20_000, 50)
    norm = np.sqrt(np.bincount(tree.group, query.astype(float) ** 2, minlength=tree.groups))

    def below(node):
        return [tree.order[tree.leaf_of[node]]] if tree.leaf_of[node] >= 0 else [x for c in tree.child[node] for x in below(c)]

    for node in range(len(tree.child)):
        members = np.concatenate(below(node))
        assert (dense[members] @ query).max() <= tree.centre[node] @ query + tree.radius[node] @ norm + 1
    assert sorted(np.concatenate(tree.order).tolist()) == list(range(200))


def test_pruning_saves_documents():
    """Of documents in clusters an item scores few."""
    draw = np.random.default_rng(1)
    column = np.concatenate([(i % 16) * 10 + np.sort(draw.choice(10, 4, False)) for i in range(1024)])
    docs = ranked.Rows(np.arange(0, 4097, 4), column, draw.integers(1, 10**6, 4096), 160)
    item = ranked.Rows(np.array([0, 3]), np.array([31, 34, 37]), np.array([5000, 4000, 3000]), 160)
    best, count = ranked.Best(1, 5), Counter()
    ranked.search(ranked.BallTree(docs), item, np.arange(1024), np.zeros(1024, bool), best, count)
    score = np.bincount(docs.row, docs.value * np.isin(docs.column, item.column) * np.select(
        [docs.column == c for c in item.column], item.value, 0))
    want = np.lexsort((np.arange(1024), -score))[:5]
    assert best.id[0].tolist() == want.tolist() and best.score[0].tolist() == score[want].tolist()
    assert count["scored"] < 200


def test_odd_rows(spark, odd, none):
    items = [(1, "Of the heron"), (1, "Of the heron"), (None, "été the"), (2, None), (3, " - "), (4, "w7x7 w7x7 unknown"),
             (5, "the " * 3000)]
    two = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS rank", "2 AS score", "3 AS before")
    docs = [(r[0], r[1]) for r in ROWS]
    assert rows(ranked.ranked(odd, two, k=4)) == brute(docs, items, 4)
    assert ranked.ranked(none, two).count() == 0 == ranked.ranked(odd, two.where("false")).count()
