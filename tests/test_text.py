import hashlib

import pytest
from pyspark.sql import functions as F

from driftscope.functions import text as tx
from driftscope.functions.report import flag_list, pair_text, shown


def column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").coalesce(1)
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


TEXTS = ["  SELECT\r\n\tA  b ", None, "", "\t\t", "x" * 5000 + "Y"]


def test_normalize_keeps_runs_of_spaces(spark):
    got = column(spark, TEXTS, tx.normalize(F.col("t")))
    assert got == ["select   a  b", None, "", "", "x" * 5000 + "y"]


def test_normalize_compact_and_cut(spark):
    assert column(spark, TEXTS[:1], tx.normalize(F.col("t"), compact=True)) == ["select a b"]
    assert [len(t) for t in column(spark, TEXTS[4:], tx.normalize(F.col("t"), 4000))] == [4000]


@pytest.mark.parametrize("charset", ["UTF-16LE", "UTF-8"])
def test_digest(spark, charset):
    texts = ["abc", "é€", "\U0001F600", ""]
    got = column(spark, texts, tx.text_digest(F.col("t"), charset))
    assert [bytes(d) for d in got] == [hashlib.sha256(t.encode(charset)).digest() for t in texts]


def test_hex_text(spark):
    assert column(spark, ["ab"], tx.hex_text(F.encode("t", "UTF-8"))) == ["0x6162"]


@pytest.mark.parametrize("text, clean, kind", [
    ("SELECT 1", "SELECT 1", "SELECT"),
    ("  \t(@p int, @q int) update t", "update t", "UPDATE"),
    # the block ends at the first closing parenthesis
    ("(@p decimal(10,2))DELETE t", ")DELETE t", "DELETE"),
    ("(no end SELECT", "(no end SELECT", "SELECT"),
    ("WITH c AS (SELECT 1) INSERT t", "WITH c AS (SELECT 1) INSERT t", "SELECT"),
    # keywords count inside other words
    ("exec dbo.p_UpdateThenDelete", "exec dbo.p_UpdateThenDelete", "UPDATE"),
    ("MERGE t", "MERGE t", None),
    ("", "", None),
    (None, None, None),
])
def test_statement_type(spark, text, clean, kind):
    assert column(spark, [text], tx.without_parameter_block(F.col("t"))) == [clean]
    assert column(spark, [text], tx.statement_type(F.col("t"))) == [kind]


def test_statement_type_reads_whole_texts(spark):
    late = "-" * 6000 + "DELETE t"
    assert column(spark, [late], tx.statement_type(F.col("t"))) == ["DELETE"]
    assert column(spark, [late], tx.statement_type(F.col("t"), 4000)) == [None]


def test_report_texts(spark):
    row = spark.sql(f"""SELECT {pair_text('1', 'NULL')} AS pair, {shown('cast(-2.345 AS decimal(38,6))')} AS down,
        {flag_list("'A;B;'")} AS flags""").first()
    assert (row.pair, str(row.down), row.flags) == ("1 - ?", "-2.35", ["A", "B"])
