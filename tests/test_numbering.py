import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftscope import Comparison, CompareParams
from driftscope.operators.drilldown import multi_plan_detail
from driftscope.operators.numbering import number_rows, value_ranks
from tests.test_compare import SIDES


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(7)
    ids = rng.sample(range(-400, 3000), 300)
    return spark.createDataFrame([(rng.choice("aaab"), i, rng.randrange(40)) for i in ids], "g string, i bigint, v bigint")


@pytest.mark.parametrize("group", [[], ["g"]])
@pytest.mark.parametrize("width", [3, 64, 1 << 20])
def test_number_rows(numbers, group, width):
    got = number_rows(numbers, "i", "n", group, width=width)
    want = numbers.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy("i")).cast("bigint"))
    assert sorted(got.select("g", "i", "n").collect()) == sorted(want.select("g", "i", "n").collect())


@pytest.mark.parametrize("width", [2, 1 << 20])
def test_value_ranks(numbers, width):
    tenths = numbers.selectExpr("g", "cast(v / 8 AS decimal(38,6)) AS v")
    got = tenths.join(value_ranks(tenths, ["g"], "v", "r", scale=6, width=width), ["g", "v"])
    want = tenths.withColumn("r", F.dense_rank().over(Window.partitionBy("g").orderBy(F.desc("v"))))
    assert sorted(got.select("g", "v", "r").collect()) == sorted(want.select("g", "v", "r").collect())


def test_drilldown_ranks_agree(runs):
    low = [(p, 1, 1, 0, 20 + p % 3, p % 4) for p in range(1, 13)]
    high = [(p, 1, 1, 0, 30, 90 + p % 2) for p in range(1, 5)]
    c = Comparison(runs.both(low, high), CompareParams(min_exec=10), SIDES)
    rows = multi_plan_detail(c.multi_plan_rows, c.run.plan, c.params).collect()
    assert len(rows) == 16
    for ranked, value in (("rank_by_avg", "avg_metric"), ("rank_by_exec", "sum_exec")):
        for side in "LH":
            own = [r for r in rows if r.side == side]
            order = sorted({r[value] for r in own}, reverse=True)
            assert all(r[ranked] == order.index(r[value]) + 1 for r in own)
