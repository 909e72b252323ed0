import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftscope.llm import simhash
from driftscope.llm.components import components
from driftscope.llm.scratch import Scratch
from tests.llm.conftest import ROWS


def plain_fingerprint(text, words=3):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints, radius):
    """Smallest fingerprint reachable from each, by comparing all pairs."""
    prints = sorted(prints)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("text", ["", None, " \n", "One", "one TWO", "a b c", "Straße ÉCOLE été x y z", "a\tb\x0bc\x1cd e"
                                  " f g", "x y " * 300])
def test_fingerprint(text):
    got = simhash.fingerprint(None if text is None else text.encode())
    assert got % (1 << 64) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [2, 3])
def test_ball_covers_the_radius(radius):
    """Any two fingerprints within the radius share a variant, and an even centre is near all that share one."""
    rng = random.Random(radius)
    even, odd = (set(m.tolist()) for m in simhash.ball_masks(radius))
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, radius)):
            b ^= 1 << bit
        balls = [{p ^ m for m in (odd if p.bit_count() & 1 else even)} for p in (a, b)]
        assert balls[0] & balls[1]
    with pytest.raises(ValueError):
        simhash.ball_masks(4)


@pytest.mark.parametrize("radius, size", [(3, simhash.BUCKET_VARIANTS), (3, 2000), (2, 5000)])
def test_links_equal_all_pairs(spark, monkeypatch, radius, size):
    monkeypatch.setattr(simhash, "BUCKET_VARIANTS", size)
    rng = random.Random(9)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):  # clusters and chains of near fingerprints, and lone ones
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(p)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                p ^= 1 << bit
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.linked_fingerprints(spark.createDataFrame(signed, "f bigint"), radius)
    roots = {r.node % (1 << 64): r.root for r in components(Scratch(spark, "t"), links).collect()}
    want = reachable(prints, radius)
    groups = {}
    for p in prints:
        groups.setdefault(want[p], set()).add(roots.get(p, p if p < 1 << 63 else p - (1 << 64)))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7), (300, 100)]
    got = {r.node: r.root for r in components(Scratch(spark, "t"), spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS)
    assert sorted((r.doc_id or 0, r.fingerprint % (1 << 64)) for r in rows) == sorted(
        (d or 0, plain_fingerprint(t)) for d, t, *_ in ROWS)
    component = {r.doc_id: r.component_id for r in rows}
    assert (component[1], component[6], component[2], component[3], component[4], component[5]) == (1, 1, 2, 2, 2, 5)
    assert simhash.near_duplicates(none).count() == 0


def test_deduplicate(spark, odd, none):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i or 0 for i in ids) == [0, 1, 2, 5, 7]
    again = odd.unionByName(odd).withColumn("doc_id", F.lit(None).cast("bigint"))
    assert simhash.deduplicate(again).count() == 5
    assert simhash.deduplicate(none).count() == 0


def test_hex(spark):
    value = spark.range(1).select(simhash.fingerprint_hex(F.lit(-2)).alias("a"), simhash.fingerprint_hex(F.lit(10)).alias("b"))
    assert tuple(value.first()) == ("fffffffffffffffe", "000000000000000a")
    assert np.array([-2]).view(np.uint64)[0] == (1 << 64) - 2
