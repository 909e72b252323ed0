import os

import pytest

from driftscope.operators.buckets import BucketTable, delete_cascade_in_place
from driftscope.operators.changes import update_by_key, without

SCHEMA = "id bigint, name string, age int"


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(1, 2001).selectExpr("id", "concat('n', id) AS name", "cast(id % 90 AS int) AS age")
    rows = rows.unionByName(spark.createDataFrame([(None, "nobody", 1), (7, "n7", 8)], SCHEMA))
    return BucketTable(spark, f"{tmp_path}/users", "id", rows.schema, 16).create(rows)


def files(table):
    return {(folder, name) for folder, _, names in os.walk(table.path) for name in names if name.endswith(".parquet")}


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def folders(found):
    return {os.path.basename(folder) for folder, _ in found}


def test_update_rewrites_touched_buckets_only(spark, table):
    requests = spark.createDataFrame([(1, 7, "x"), (2, 7, "y"), (3, 9999, "z"), (4, None, "w"), (5, 11, None)],
                                     "seq int, id bigint, new string")
    wanted = rows(update_by_key(table.rows(), requests, "id", "seq", {"name": "new"}))
    before = files(table)
    touched = {f"key_bucket={b}" for b in table.touched(requests)}
    table.update(requests, "seq", {"name": "new"})
    after = files(table)
    assert 1 <= len(touched) <= 3
    assert folders(before - after) == folders(after - before) == touched
    assert rows(table.rows()) == wanted
    table.update(requests, "seq", {"name": "new"})
    assert rows(table.rows()) == wanted
    scan = table.part(requests)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [key_bucket" in scan
    with pytest.raises(ValueError):
        table.update(requests, "seq", {"id": "seq"})


def test_delete_empties_buckets_and_table(spark, table):
    some = spark.createDataFrame([(7,), (7,), (12,), (None,), (5000,)], "id bigint")
    wanted = rows(without(table.rows(), some, "id"))
    before, touched = files(table), table.touched(some)
    table.delete(some)
    assert folders(before - files(table)) == {f"key_bucket={b}" for b in touched}
    assert rows(table.rows()) == wanted and len(wanted) == 1999
    table.delete(spark.range(0, 2001))
    assert rows(table.rows()) == [(None, "nobody", 1)]
    assert len(folders(files(table))) == 1
    table.delete(spark.range(0, 2001).where("id < 0"))
    table.add(spark.createDataFrame([("new", 3, 4)], "name string, age int, id bigint"))
    assert rows(table.rows()) == [(4, "new", 3), (None, "nobody", 1)]
    assert rows(table.lookup(some)) == []


def test_all_rows_gone(spark, tmp_path):
    one = spark.createDataFrame([(1, "a", 2)], SCHEMA)
    table = BucketTable(spark, f"{tmp_path}/one", "id", one.schema, 4).create(one)
    table.delete(one)
    table.delete(one)
    assert rows(table.rows()) == []
    table.add(one)
    assert rows(table.rows()) == [(1, "a", 2)]


def test_cascade(spark, tmp_path):
    def make(name, key, values, schema):
        frame = spark.createDataFrame(values, schema)
        return BucketTable(spark, f"{tmp_path}/{name}", key, frame.schema, 8).create(frame)

    users = make("u", "user", [(1,), (2,), (3,)], "user bigint")
    orders = make("o", "user", [(10, 1), (11, 1), (12, 2), (13, None)], "order bigint, user bigint")
    lines = make("l", "order", [(10, 1), (10, 2), (12, 1), (99, 1)], "order bigint, line int")
    delete_cascade_in_place(spark.createDataFrame([(1,), (3,)], "user bigint"), users, orders,
                            grandchildren=((lines, orders),))
    assert (rows(users.rows()), rows(orders.rows()), rows(lines.rows())) == (
        [(2,)], [(12, 2), (13, None)], [(12, 1), (99, 1)])
