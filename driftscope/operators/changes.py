"""Apply a frame of change requests to a table, as a set.

Requests act on the table as it was before the batch.  Functions return the new
table, or the requests with a status; tables that are changed where they lie are
in :mod:`driftscope.operators.buckets`.  New keys follow the table's highest, so
a batch that has been added to the stored table must not be added again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftscope.operators.numbering import number_rows
from driftscope.session import work_dir

ACCEPTED = "accepted"


@dataclass(frozen=True)
class Guard:
    """A request needs a row with the same key in ``parent``."""

    parent: DataFrame
    parent_key: str
    request_key: str
    message: str


def new_ids(requests: DataFrame, table: DataFrame, key: str, order_id: str) -> DataFrame:
    """Requests with ids that continue the table's, in the order of ``order_id``."""
    highest = table.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint")).scalar()
    return number_rows(requests, order_id, "_position").withColumn(
        key, F.col("_position") + highest
    ).drop("_position")


def insert_with_child(requests: DataFrame, parent: DataFrame, child: DataFrame, key: str, order_id: str,
                      parent_values: Mapping[str, str], child_values: Mapping[str, str],
                      child_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Add one parent and one child per request; the child takes the parent's new id.

    The mappings give the request column for each table column; columns not
    named stay NULL.  ``child_key`` numbers the child rows the same way.
    """
    numbered = new_ids(requests, parent, key, order_id)
    new_parents = numbered.select(key, *[F.col(v).alias(c) for c, v in parent_values.items()])
    child_source = numbered if child_key is None else new_ids(numbered, child, child_key, order_id)
    own = [] if child_key is None else [child_key]
    new_children = child_source.select(*own, key, *[F.col(v).alias(c) for c, v in child_values.items()])
    return (
        parent.unionByName(new_parents, allowMissingColumns=True),
        child.unionByName(new_children, allowMissingColumns=True),
    )


def update_by_key(table: DataFrame, requests: DataFrame, key: str, sequence: str,
                  values: Mapping[str, str]) -> DataFrame:
    """Overwrite columns of the rows with the requests' keys.

    The last request per key counts.  NULL is a value like any other, and a
    request without a row in the table does nothing.
    """
    last = requests.groupBy(key).agg(
        F.max(F.struct(sequence, F.struct(*[F.col(v).alias(c) for c, v in values.items()]).alias("new"))).alias("_last")
    )
    joined = table.join(last, key, "left")
    hit = F.col("_last").isNotNull()
    return joined.select(*[
        F.when(hit, F.col(f"_last.new.{c}")).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c)
        if c in values else F.col(c)
        for c in table.columns
    ])


def without(table: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows whose key is not among ``keys`` (anti-join)."""
    return table.join(keys.select(*columns).distinct(), list(columns), "left_anti").select(*table.columns)


def matching(table: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows whose key is among ``keys`` (semi-join); for a list of keys to look up."""
    return table.join(keys.select(*columns), list(columns), "left_semi").select(*table.columns)


def delete_cascade(keys: DataFrame, key: str, parent: DataFrame, children: Mapping[str, DataFrame],
                   grandchildren: Mapping[str, tuple[DataFrame, str, str]] | None = None) -> dict[str, DataFrame]:
    """Delete parents together with all that hangs on them.

    ``children`` hold the parent's key themselves.  ``grandchildren`` name the
    child they hang on and the column that links them to it.  Returns what is
    left of each table, the parents as ``parent``.
    """
    left = {"parent": without(parent, keys, key)}
    left.update({name: without(child, keys, key) for name, child in children.items()})
    for name, (table, child, link) in (grandchildren or {}).items():
        doomed = matching(children[child], keys, key)
        left[name] = without(table, doomed, link)
    return left


def guarded(requests: DataFrame, guards: Sequence[Guard]) -> DataFrame:
    """Requests with ``status``: accepted, or the message of the first failed guard."""
    checked = requests
    for number, guard in enumerate(guards):
        present = guard.parent.select(F.col(guard.parent_key).alias(guard.request_key)).distinct()
        checked = checked.join(present.withColumn(f"_found_{number}", F.lit(True)), guard.request_key, "left")
    failed = [
        F.when(F.col(f"_found_{n}").isNull(), F.lit(guard.message)) for n, guard in enumerate(guards)
    ]
    return checked.select(*requests.columns, F.coalesce(*failed, F.lit(ACCEPTED)).alias("status"))


def guarded_insert(table: DataFrame, requests: DataFrame, guards: Sequence[Guard], key: str, order_id: str,
                   values: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """The table with the accepted requests added, and the rejected ones with their reason.

    The guards are evaluated once: the requests are written with their verdicts
    below the shared folder, and numbering as well as both results read that.
    """
    verdicts = guarded(requests, guards)
    path = work_dir(requests.sparkSession, "verdicts")
    verdicts.write.parquet(path)
    checked = requests.sparkSession.read.schema(verdicts.schema).parquet(path)
    added = new_ids(checked.where(F.col("status") == ACCEPTED), table, key, order_id).select(
        key, *[F.col(v).alias(c) for c, v in values.items()]
    )
    return table.unionByName(added, allowMissingColumns=True), checked.where(F.col("status") != ACCEPTED)


def lookup(table: DataFrame, key: str, value, *columns: str) -> DataFrame:
    """Some columns of the rows with one key."""
    return table.where(F.col(key) == value).select(*(columns or table.columns))


# The demo catalogue, its price ranges and its first order date.
CATEGORIES = ("Electronics", "Clothing", "Home Goods")
PRODUCTS = (("Laptop", 1, "1000.00"), ("Shirt", 2, "20.00"), ("Toaster", 3, "30.00"),
            ("Laptop", 1, "1700.00"), ("Shirt", 2, "20.00"), ("Toaster", 3, "30.00"))
FIRST_ORDER_DATE = "2022-01-01"


def draw(row_id: Column, purpose: str, seed: int, below: int) -> Column:
    """A repeatable whole number from 0 to below-1 for a row."""
    digest = F.md5(F.concat(F.lit(f"{seed}/{purpose}/"), row_id.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(below)).cast("int")


def _element(values: Sequence[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def seed_tables(ids: DataFrame, seed: int = 0, id_column: str = "id") -> dict[str, DataFrame]:
    """Demo rows for every id: users, addresses, orders and order details.

    Values depend on id and seed alone, so the tables can be built in parallel
    and built again.  ``ids`` may be ``spark.range(1, n + 1)``.
    """
    row = F.col(id_column).cast("bigint")
    text = row.cast("string")
    product = draw(row, "product", seed, len(PRODUCTS))
    return {
        "users": ids.select(
            row.alias("UserID"), F.concat(F.lit("Name"), text).alias("FirstName"),
            F.concat(F.lit("Surname"), text).alias("LastName"), (draw(row, "age", seed, 40) + 20).alias("Age"),
        ),
        "addresses": ids.select(
            row.alias("AddressID"), row.alias("UserID"), F.concat(F.lit("City"), text).alias("City"),
            (draw(row, "postal", seed, 89999) + 10000).cast("string").alias("PostalCode"),
        ),
        "orders": ids.select(
            row.alias("OrderID"), row.alias("UserID"),
            F.date_add(F.lit(FIRST_ORDER_DATE).cast("date"), draw(row, "date", seed, 365)).alias("OrderDate"),
        ),
        "order_details": ids.select(
            row.alias("OrderDetailID"), row.alias("OrderID"),
            _element([name for name, _, _ in PRODUCTS], product).alias("ProductName"),
            (draw(row, "quantity", seed, 100) + 1).alias("Quantity"), (product + 1).alias("ProductID"),
        ),
    }


def seed_catalogue(spark: SparkSession) -> dict[str, DataFrame]:
    """The demo categories and products; both lists are inserted twice."""
    categories = [(i + 1, name) for i, name in enumerate(CATEGORIES * 2)]
    products = [(i + 1, name, category, price) for i, (name, category, price) in enumerate(PRODUCTS)]
    return {
        "categories": spark.createDataFrame(categories, "CategoryID int, CategoryName string"),
        "products": spark.createDataFrame(
            products, "ProductID int, ProductName string, CategoryID int, Price string"
        ).withColumn("Price", F.col("Price").cast("decimal(10,2)")),
    }
