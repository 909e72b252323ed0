import datetime as dt

import pytest

from driftscope.operators import changes
from driftscope.operators.changes import ACCEPTED, Guard


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "a", 20), (2, "b", 30), (4, None, None)], "id bigint, name string, age int")


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_update_takes_the_last_request_and_keeps_nulls(spark, users):
    requests = spark.createDataFrame(
        [(1, 1, "x", 1), (1, 3, None, 3), (1, 2, "y", 2), (4, 1, "d", 40), (9, 1, "z", 9)],
        "id bigint, seq int, new_name string, new_age int")
    got = changes.update_by_key(users, requests, "id", "seq", {"name": "new_name", "age": "new_age"})
    assert rows(got) == [(1, None, 3), (2, "b", 30), (4, "d", 40)]
    assert got.schema.simpleString() == users.schema.simpleString()


def test_update_of_some_columns(spark, users):
    requests = spark.createDataFrame([(2, 1, 31)], "id bigint, seq int, new_age int")
    assert (2, "b", 31) in rows(changes.update_by_key(users, requests, "id", "seq", {"age": "new_age"}))


def test_insert_with_child(spark, users):
    homes = spark.createDataFrame([(7, 1, "here")], "home bigint, id bigint, city string")
    requests = spark.createDataFrame([(30, "q", "c30"), (10, "p", "c10"), (20, "r", "c20")], "req bigint, n string, c string")
    parents, children = changes.insert_with_child(
        requests, users, homes, "id", "req", {"name": "n"}, {"city": "c"}, child_key="home")
    assert rows(parents.where("id > 4")) == [(5, "p", None), (6, "r", None), (7, "q", None)]
    assert rows(children) == [(10, 7, "c30"), (7, 1, "here"), (8, 5, "c10"), (9, 6, "c20")]


def test_insert_into_empty_table(spark, users):
    requests = spark.createDataFrame([(3, "n")], "req bigint, n string")
    parents, _ = changes.insert_with_child(requests, users.where("false"), users.select("id"), "id", "req", {"name": "n"}, {})
    assert rows(parents) == [(1, "n", None)]


def test_delete_cascade(spark, users):
    orders = spark.createDataFrame([(100, 1), (101, 2), (102, 1)], "order_id bigint, id bigint")
    lines = spark.createDataFrame([(100, 1), (101, 1), (102, 1), (999, 1)], "order_id bigint, line int")
    keys = spark.createDataFrame([(1,), (1,), (8,)], "id bigint")
    left = changes.delete_cascade(keys, "id", users, {"orders": orders}, {"lines": (lines, "orders", "order_id")})
    assert [r[0] for r in rows(left["parent"])] == [2, 4]
    assert rows(left["orders"]) == [(101, 2)]
    # a line of no known order stays
    assert rows(left["lines"]) == [(101, 1), (999, 1)]


def test_guards_name_the_first_failure(spark, users):
    products = spark.createDataFrame([(5,), (5,), (6,)], "product bigint")
    requests = spark.createDataFrame([(1, 1, 5), (2, 9, 5), (3, 9, 9), (4, 2, 9), (5, None, 5)], "req bigint, u bigint, p bigint")
    guards = [Guard(users, "id", "u", "no user"), Guard(products, "product", "p", "no product")]
    got = {r.req: r.status for r in changes.guarded(requests, guards).collect()}
    assert got == {1: ACCEPTED, 2: "no user", 3: "no user", 4: "no product", 5: "no user"}


def test_guarded_insert(spark, users):
    orders = spark.createDataFrame([(50, 1, dt.date(2025, 1, 1))], "order_id bigint, user bigint, day date")
    requests = spark.createDataFrame([(2, 2, dt.date(2025, 1, 3)), (1, 9, dt.date(2025, 1, 2)), (0, 1, None)],
                                     "req bigint, u bigint, d date")
    table, rejected = changes.guarded_insert(orders, requests, [Guard(users, "id", "u", "no user")], "order_id", "req",
                                             {"user": "u", "day": "d"})
    assert rows(table) == [(50, 1, dt.date(2025, 1, 1)), (51, 1, None), (52, 2, dt.date(2025, 1, 3))]
    assert [(r.req, r.status) for r in rejected.collect()] == [(1, "no user")]


def test_guards_are_joined_once(spark, users, tmp_path):
    users.write.parquet(f"{tmp_path}/users")
    stored = spark.read.parquet(f"{tmp_path}/users")
    orders = spark.createDataFrame([(50, 1)], "order_id bigint, user bigint")
    requests = spark.range(0, 40).selectExpr("id AS req", "id % 6 AS u")
    table, rejected = changes.guarded_insert(orders, requests, [Guard(stored, "id", "u", "no user")], "order_id", "req",
                                             {"user": "u"})
    for result in (table, rejected):
        assert not any(name.startswith(f"file://{tmp_path}/users") for name in result.inputFiles())
    known = {r.id for r in users.collect()}
    assert table.count() == 1 + sum(i % 6 in known for i in range(40))
    assert rejected.count() == sum(i % 6 not in known for i in range(40))
    assert sorted(r.order_id for r in table.collect()) == list(range(50, 50 + table.count()))


def test_lookups(spark, users):
    assert rows(changes.lookup(users, "id", 2, "name")) == [("b",)]
    keys = spark.createDataFrame([(1,), (1,), (3,)], "id bigint")
    assert rows(changes.matching(users, keys, "id")) == [(1, "a", 20)]
    assert [r[0] for r in rows(changes.without(users, keys, "id"))] == [2, 4]


def test_seed_is_repeatable_and_in_range(spark):
    first, again, other = (changes.seed_tables(spark.range(1, 501), seed) for seed in (1, 1, 2))
    assert rows(first["order_details"]) == rows(again["order_details"]) != rows(other["order_details"])
    users = first["users"].collect()
    assert len(users) == 500 and {20 <= u.Age < 60 for u in users} == {True}
    details = first["order_details"].collect()
    assert {d.ProductID for d in details} == {1, 2, 3, 4, 5, 6}
    assert min(d.Quantity for d in details) >= 1 and max(d.Quantity for d in details) <= 100
    days = [o.OrderDate for o in first["orders"].collect()]
    assert min(days) >= dt.date(2022, 1, 1) and max(days) <= dt.date(2022, 12, 31)
    assert all(10000 <= int(a.PostalCode) < 99999 for a in first["addresses"].collect())


def test_catalogue(spark):
    made = changes.seed_catalogue(spark)
    assert made["categories"].count() == 6 and made["categories"].select("CategoryName").distinct().count() == 3
    assert [str(p.Price) for p in changes.lookup(made["products"], "ProductName", "Laptop").orderBy("ProductID").collect()] == [
        "1000.00", "1700.00"]
