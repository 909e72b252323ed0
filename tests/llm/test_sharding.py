import zlib

import pytest

from driftscope.llm.scratch import Scratch
from driftscope.llm.sharding import kd_shards, with_slots
from tests.llm.conftest import ROWS


@pytest.fixture(scope="module")
def docs(spark):
    # a third of all rows is one text, and one source has half
    return spark.range(3000).selectExpr(
        "id AS doc_id", "if(id % 3 = 0, 'the same text', repeat(concat('w', cast(id AS string), ' '), 1 + id % 40)) AS text",
        "if(id % 2 = 0, 'a', concat('s', cast(id % 17 AS string))) AS source", "if(id % 5 = 0, 'fr', 'en') AS lang")


def test_shards_are_near_equal_and_keep_copies_together(spark, docs):
    rows = kd_shards(docs, shards=7).collect()
    assert len(rows) == 3000
    size, of_text = {}, {}
    for r in rows:
        size[r.shard] = size.get(r.shard, 0) + r.size
        of_text.setdefault(r.text_crc32, set()).add(r.shard)
    assert set(size) == set(range(7))
    mean = sum(size.values()) / 7
    assert all(abs(n - mean) < 0.03 * mean for n in size.values())
    assert all(len(s) == 1 for c, s in of_text.items() if c != zlib.crc32(b"the same text"))


def test_target_bytes(docs):
    total = sum(r.size for r in kd_shards(docs, shards=1).collect())
    assert kd_shards(docs, target_bytes=total // 3 + 1).select("shard").distinct().count() == 3


def test_large_group_is_cut_by_ids(spark):
    same = spark.range(1000).selectExpr("id AS doc_id", "'x' AS text", "'a' AS source", "'en' AS lang")
    count = [r["count"] for r in kd_shards(same, shards=4).groupBy("shard").count().collect()]
    assert len(count) == 4 and max(count) - min(count) <= 4


def test_slots(spark, docs):
    scratch = Scratch(spark, "t")
    rows = with_slots(scratch, kd_shards(docs, shards=5, scratch=scratch)).collect()
    for shard in range(5):
        own = sorted((r.slot, r.doc_id) for r in rows if r.shard == shard)
        assert [s for s, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)


def test_odd_rows(spark, odd, none):
    scratch = Scratch(spark, "t")
    rows = with_slots(scratch, kd_shards(odd, shards=3, scratch=scratch)).collect()
    assert len(rows) == len(ROWS)
    assert sorted((r.doc_id or 0, r.size) for r in rows) == sorted((d or 0, len((t or "").encode()) + 8) for d, t, *_ in ROWS)
    assert {r.text_crc32 for r in rows} == {zlib.crc32((t or "").encode()) for _, t, *_ in ROWS}
    assert kd_shards(none, shards=4).count() == 0
