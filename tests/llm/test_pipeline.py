import pytest

import __spark_entry__ as contract
import corpus_pipeline
from driftscope.llm.queries import ORACLE_SQL, QUERIES
from driftscope.llm.scratch import Scratch
from tests.llm.conftest import ROWS
from tools.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"


def test_registered():
    queries = contract.queries()
    assert set(QUERIES) <= set(queries) and queries["pipeline"] is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near-duplicates", "decontamination", "mixing", "token-ids"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    problem, rows = compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLE_SQL[name], SF_DIR)
    assert not problem and rows > 0


def test_stages_keep_columns(spark, odd, none):
    for docs in (odd, none):
        now = docs
        scratch = Scratch(spark, "t")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = scratch.keep(stage(spark, now, SF_DIR), name)
            assert now.columns == docs.columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, now, SF_DIR)
        assert out.count() == now.count()
    assert scratch.keep(odd, "all").count() == len(ROWS)


def test_run(spark):
    """Each document of the result has passed all stages, and is emitted as often as its source asks for."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    left = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        left = stage(spark, left, SF_DIR)
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    assert {r.doc_id for r in rows} <= ids and len(ids) < docs.count()
    ends = sorted((r.start, r.start + r.n_tokens) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
