"""Every operator as a query over the given tables.

All queries read whole tables.  Texts are hashed as UTF-8 here so that SQL can
check the digests.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contract import inputs
from contract.inputs import derived_event_stream, derived_events, derived_run, table
from driftscope.functions.text import hex_text, normalize, statement_type, text_digest, without_parameter_block
from driftscope.operators import capture, changes, checks
from driftscope.operators.buckets import BucketTable, delete_cascade_in_place
from driftscope.operators.compare import group_names
from driftscope.operators.daily import DailyTotals
from driftscope.operators.dominant import dominant_pairs, dominant_plans
from driftscope.operators.groups import GROUP
from driftscope.operators.texts import text_features
from driftscope.params import CompareParams
from driftscope.plans.comparison import Comparison
from driftscope.plans.persist import save_files
from driftscope.plans.steps import Steps
from driftscope.session import work_dir
from driftscope.sources.capture import EVENT_SCHEMA, load_events
from driftscope.sources.runs import load_run, run_tables, union_runs
from driftscope.sources.sides import order_pairs
from driftscope.streaming import capture as streaming

Query = Callable[[SparkSession, str], DataFrame]
TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
WINDOW_START, WINDOW_END = dt.datetime(1996, 3, 15), dt.datetime(2000, 7, 1)


def params(**changed) -> CompareParams:
    return CompareParams(**{"charset": "UTF-8", "min_exec": 300, **changed})


_latest: list[Comparison] = []


def comparison(spark: SparkSession, sf_dir: str, store: str | None = "groups", **changed) -> Comparison:
    """A new comparison; what the previous one stored is released."""
    while _latest:
        _latest.pop().release()
    _latest.append(Comparison(derived_run(spark, sf_dir), params(**changed), inputs.SIDES, store=store))
    return _latest[0]


# --- sides, plans, texts --------------------------------------------------

def resolve_sides(spark, sf_dir):
    """Every customer names two databases; the second one may not exist."""
    nation = table(spark, sf_dir, "nation")
    databases = nation.select(
        F.col("n_name").alias("name"), (F.col("n_regionkey") * 10 + 110).cast("smallint").alias("compatibility_level"))
    pairs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pair_id"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("db_a"),
        F.concat(F.lit("NATION_"), (F.col("c_custkey") % 27).cast("string")).alias("db_b"))
    return order_pairs(databases, pairs)


def _plan_columns(stats: DataFrame) -> DataFrame:
    return stats.drop("query_hash")


def plan_preagg(spark, sf_dir):
    return _plan_columns(comparison(spark, sf_dir).plan_stats)


def plan_preagg_window(spark, sf_dir):
    return _plan_columns(comparison(
        spark, sf_dir, start=WINDOW_START, end=WINDOW_END, include_adhoc=False, primary_replica_only=True).plan_stats)


def _daily(spark, sf_dir) -> tuple[DailyTotals, Comparison]:
    """Plan totals taken in by two deliveries of days that overlap."""
    c = comparison(spark, sf_dir, None)
    store = DailyTotals(spark, work_dir(spark, "daily-totals"))
    first, last = table(spark, sf_dir, "lineitem").agg(
        F.min(F.trunc("l_shipdate", "month")), F.max(F.trunc("l_shipdate", "month"))).first()
    middle = first + (last - first) / 2
    store.add(c.run, first, middle)
    store.add(c.run, middle - dt.timedelta(days=100), last)
    return store, c


def daily_totals(spark, sf_dir):
    store, c = _daily(spark, sf_dir)
    return store.rows(c.run)


def plan_stats_from_days(spark, sf_dir):
    store, c = _daily(spark, sf_dir)
    return _plan_columns(store.plan_stats(c.run, params()))


def plan_stats_from_days_window(spark, sf_dir):
    store, c = _daily(spark, sf_dir)
    return _plan_columns(store.plan_stats(c.run, params(
        start=WINDOW_START, end=WINDOW_END, include_adhoc=False, primary_replica_only=True)))


def text_features_query(spark, sf_dir):
    c = comparison(spark, sf_dir, include_sp=False)
    found = text_features(c.run.query_text, c.params, c.plan_stats)
    return found.select(
        "side", "query_text_id", "query_text_sample", "normalized_sample",
        hex_text(F.col("query_text_hash")).alias("text_hash_hex"),
        hex_text(F.col("normalized_hash")).alias("normalized_hash_hex"))


def text_dedup_documents(spark, sf_dir):
    """Documents that are one and the same text once normalised; whole texts."""
    documents = table(spark, sf_dir, "documents")
    key = text_digest(normalize(F.col("text")), "UTF-8")
    return documents.select("doc_id", key.alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"),
    ).select(hex_text(F.col("key")).alias("key_hex"), "copies", "first_doc_id", "last_doc_id")


def statement_type_query(spark, sf_dir):
    texts = derived_run(spark, sf_dir).query_text
    return texts.select(
        "side", "query_text_id", without_parameter_block(F.col("query_sql_text")).alias("clean_text"),
        statement_type(F.col("query_sql_text")).alias("detected_type"))


def statement_type_conversations(spark, sf_dir):
    """The same on free text: the keywords also count inside other words."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", statement_type(F.col("text")).alias("detected_type"))


# --- groups and comparison ------------------------------------------------

def _groups(**changed) -> Query:
    def query(spark, sf_dir):
        return comparison(spark, sf_dir, None, **changed).groups.select(
            "side", "query_type", "obj_name", hex_text(F.col("group_key")).alias("group_key_hex"),
            "query_hash", "object_id", "query_text_sample", "query_id_min", "query_id_max",
            "plan_count", "exec_count", "total_metric", "avg_metric", "total_duration", "avg_duration",
            "interval_start_min", "interval_end_max")
    return query


def _compare(**changed) -> Query:
    def query(spark, sf_dir):
        return comparison(spark, sf_dir, **changed).compared.withColumn(
            "group_key_hex", hex_text(F.col("group_key"))).drop("group_key", "obj_key")
    return query


def regressed_groups(spark, sf_dir):
    return comparison(spark, sf_dir, group_by="NormalizedText").regressed_groups.select(
        hex_text(F.col("group_key")).alias("group_key_hex"), "query_type", "obj_key")


def multi_plan_only(spark, sf_dir):
    rows = comparison(spark, sf_dir, only_multi_plan=True).regressions
    return rows.select(hex_text(F.col("group_key")).alias("group_key_hex"), "query_type", "obj_name",
                       "query_id_range_l", "query_id_range_h", "plan_count_l", "plan_count_h",
                       "regression_ratio", "impact_score")


def _name_back(rows: DataFrame) -> DataFrame:
    """obj_key as the name it stands for."""
    return rows.withColumn("obj_name", F.nullif("obj_key", F.lit(""))).withColumn(
        "group_key_hex", hex_text(F.col("group_key"))).drop("group_key", "obj_key")


def dominant_plans_query(spark, sf_dir):
    c = comparison(spark, sf_dir, "plans", group_by="NormalizedText")
    return _name_back(dominant_plans(c.plans, c.regressed_groups))


def dominant_pairs_query(spark, sf_dir):
    c = comparison(spark, sf_dir, "plans", group_by="NormalizedText")
    pairs = dominant_pairs(c.plans, c.regressed_groups)
    return _name_back(pairs.select(*GROUP, "plan_id_l", "plan_id_h", "query_id_l", "query_id_h"))


def multi_plan_dominant(spark, sf_dir):
    return _name_back(comparison(spark, sf_dir).multi_plan_pairs)


def plan_indicators(spark, sf_dir):
    found = comparison(spark, sf_dir).indicators
    return _name_back(found.withColumn("plan_xml_hash_hex", hex_text(F.col("plan_xml_hash"))).drop("plan_xml_hash"))


# --- reports --------------------------------------------------------------

def _report(name: str, store: str = "groups", **changed) -> Query:
    def query(spark, sf_dir):
        return getattr(comparison(spark, sf_dir, store, **changed), name)()
    return query


def persisted_regressions(spark, sf_dir):
    """Write the result rows to the shared folder and read them back."""
    rows = comparison(spark, sf_dir).result_rows()
    path = work_dir(spark, "regressions")
    save_files(rows, path)
    return spark.read.parquet(path).drop("CollectedAt").withColumn(
        "GroupKeyHash", hex_text(F.col("GroupKeyHash")))


def persisted_history(spark, sf_dir):
    """Two runs kept side by side, one of them saved twice."""
    path = work_dir(spark, "history")
    for run, metric in (("a", "LogicalReads"), ("b", "CPU"), ("a", "LogicalReads")):
        rows = comparison(spark, sf_dir, metric=metric).result_rows()
        save_files(rows, path, history=True, run={"name": run, "metric": metric})
    kept = spark.read.parquet(path)
    return kept.groupBy("Metric", "QueryType").agg(
        F.count("*").alias("regressions"), F.countDistinct("RunId").alias("runs"), F.sum("PlanCount_H").alias("plans"),
        F.sum("ExecCount_H").alias("executions"))


def step_metrics(spark, sf_dir):
    steps = Steps(spark)
    comparison(spark, sf_dir, None).timed(steps)
    steps.release()
    return steps.metrics().select("step_no", "step_name", "rows_affected")


def collection_check(spark, sf_dir):
    return checks.collection_check(derived_run(spark, sf_dir))


def table_row_counts(spark, sf_dir):
    return checks.row_counts({name: table(spark, sf_dir, name) for name in TABLE_NAMES})


# --- captured events ------------------------------------------------------

def _classified(spark, sf_dir, replay_type: int = 3) -> DataFrame:
    return capture.classify(capture.replayable(derived_events(spark, sf_dir), replay_type))


def event_counts_by_file(spark, sf_dir):
    return capture.counts_by_file(derived_events(spark, sf_dir))


def event_counts_total(spark, sf_dir):
    counts = capture.counts_by_file(derived_events(spark, sf_dir))
    return counts.agg(F.sum("rpc_count").alias("rpc_count"), F.sum("batch_count").alias("batch_count"),
                      F.sum("total_count").alias("total_count"), F.count(F.lit(1)).alias("files"))


def files_without_events(spark, sf_dir):
    return capture.files_without_events(derived_events(spark, sf_dir))


def capture_filter(spark, sf_dir):
    return capture.restrict_capture(derived_events(spark, sf_dir), 2, "sp-and-adhoc").select(
        "event_id", "event_name", "database_id", "object_name", "statement", "batch_text")


def event_classification(spark, sf_dir):
    return _classified(spark, sf_dir).select("event_id", "event_name", "object_name", "kind", "sql_text")


def replay_calls_only(spark, sf_dir):
    return _classified(spark, sf_dir, 1).groupBy("kind", "object_name").agg(F.count(F.lit(1)).alias("events"))


def statement_rewrite(spark, sf_dir):
    return capture.rewrite(_classified(spark, sf_dir)).select("event_id", "kind", "replay_text")


def statement_parameters(spark, sf_dir):
    return capture.call_parameters(_classified(spark, sf_dir), "event_id")


def replay_sequence(spark, sf_dir):
    """Files are as old as their first event."""
    events = derived_events(spark, sf_dir).withColumn("file_created", F.col("ts"))
    return capture.sequence(capture.replayable(events)).select(
        "event_id", "file_name", "exec_no", "total_count", "percent")


def replay_outcomes(spark, sf_dir):
    return capture.outcomes(_classified(spark, sf_dir), "file_name")


def replay_outcomes_total(spark, sf_dir):
    return capture.outcomes(_classified(spark, sf_dir))


def replay_duration_text(spark, sf_dir):
    events = derived_events(spark, sf_dir)
    return capture.run_duration(events, "file_name").select("file_name", "seconds", "duration_text")


def interval_rollup(spark, sf_dir):
    return capture.interval_rollup(_classified(spark, sf_dir), "kind", "object_name")


def statement_digests(spark, sf_dir):
    """Digests of statements in the default encoding, two bytes a character."""
    texts = capture.classify(derived_events(spark, sf_dir)).where("sql_text IS NOT NULL")
    return texts.select("event_id", hex_text(text_digest(F.col("sql_text"))).alias("digest_hex"))


def loaded_events(spark, sf_dir):
    """Events written as files and read back with the facts of their files."""
    path = work_dir(spark, "capture")
    derived_events(spark, sf_dir).select(*EVENT_SCHEMA.names).write.parquet(path)
    events = load_events(spark, path)
    return events.groupBy("event_name").agg(
        F.count(F.lit(1)).alias("events"), F.sum("duration").cast("decimal(38,2)").alias("duration"),
        F.count_if(F.col("file_name").endswith(".parquet") & F.col("file_created").isNotNull()).alias("with_file"))


def loaded_run(spark, sf_dir):
    """Run tables written as files and read back, the candidate's intervals without their ends."""
    run, sides = derived_run(spark, sf_dir), []
    for side in ("L", "H"):
        paths = {}
        for name, frame in run_tables(run).items():
            paths[name] = work_dir(spark, f"{name}-{side}")
            own = frame.where(F.col("side") == side).drop("side")
            (own.drop("end_time") if (name, side) == ("interval", "H") else own).write.parquet(paths[name])
        sides.append(load_run(spark, paths, side))
    c = Comparison(union_runs(*sides), params(group_by="NormalizedText"), inputs.SIDES, store=None)
    ends = c.groups.select("side", *GROUP, "interval_end_max")
    low, high = (ends.where(F.col("side") == s).drop("side").withColumnRenamed("interval_end_max", f"end_{t}")
                 for s, t in (("L", "l"), ("H", "h")))
    rows = c.compared.select(*GROUP, "obj_name", "exec_count_l", "exec_count_h", "confidence_flags").join(
        low, GROUP, "left").join(high, GROUP, "left")
    return rows.withColumn("group_key_hex", hex_text(F.col("group_key"))).drop("group_key", "obj_key")


# --- streams --------------------------------------------------------------

def _finish(query) -> None:
    query.awaitTermination()


def stream_classified(spark, sf_dir):
    out = work_dir(spark, "classified")
    stream = streaming.classified_stream(derived_event_stream(spark, sf_dir))
    _finish(streaming.to_files(stream.select("event_id", "kind", "replay_text"), out, work_dir(spark, "checkpoint")))
    return spark.read.parquet(out)


def stream_counts(spark, sf_dir):
    out = work_dir(spark, "counts")
    counts = streaming.running_counts(derived_event_stream(spark, sf_dir))
    _finish(streaming.changes_to_files(counts.withColumnRenamed("count", "events"), out, work_dir(spark, "checkpoint"),
                                       key=("file_name", "kind"), every=4))
    return streaming.newest(spark, out, "file_name", "kind")


def stream_interval_rollup(spark, sf_dir):
    out = work_dir(spark, "rollup")
    events = streaming.classified_stream(derived_event_stream(spark, sf_dir))
    _finish(streaming.changes_to_files(
        streaming.rollup_stream(events, "kind", "object_name"), out, work_dir(spark, "checkpoint")))
    return streaming.newest(spark, out, "kind", "object_name", "start_time", "end_time")


# --- bulk changes ---------------------------------------------------------
# customer, orders, lineitem and part stand in for users, orders, order lines
# and products.  Every event is a request; its type chooses its values.

NO_USER = "no such user"
NO_ORDER = "no such order"
NO_PRODUCT = "no such product"
NO_CATEGORY = "no such category"


def _requests(spark, sf_dir, **values: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", *[f"{v} AS {c}" for c, v in values.items()])


def _users(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def _addresses(spark, sf_dir) -> DataFrame:
    """One address per customer."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("City"), F.col("c_custkey").cast("string")).alias("city"))


def _products(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_type", F.col("p_retailprice").cast("decimal(10,2)").alias("p_price"))


def _lines(spark, sf_dir) -> DataFrame:
    """Order lines with a key of their own; nobody has given them product names."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS line_id", "l_orderkey", "l_partkey", "cast(l_quantity AS int) AS quantity",
        "cast(NULL AS string) AS product_name")


def add_with_child(spark, sf_dir):
    requests = _requests(spark, sf_dir, new_name="concat(event_type, cast(user_id AS string))",
                         new_city="concat('Town', cast(event_id AS string))")
    parents, children = changes.insert_with_child(
        requests, _users(spark, sf_dir), _addresses(spark, sf_dir), "c_custkey", "event_id",
        {"c_name": "new_name"}, {"city": "new_city"})
    return parents.join(children, "c_custkey", "left")


def _user_requests(spark, sf_dir) -> DataFrame:
    return _requests(spark, sf_dir, c_custkey="if(event_type = 'click', user_id * 11, -1 - user_id)",
                     new_name="concat('Renamed', cast(event_id AS string))",
                     new_nation="if(event_id % 3 <> 0, cast(user_id % 25 AS int), NULL)")


def update_by_key(spark, sf_dir):
    """Some keys are requested many times, some are unknown, some values are NULL."""
    return changes.update_by_key(_users(spark, sf_dir), _user_requests(spark, sf_dir), "c_custkey", "event_id",
                                 {"c_name": "new_name", "c_nationkey": "new_nation"})


def _kept_in_buckets(rows: DataFrame, key: str) -> BucketTable:
    return BucketTable(rows.sparkSession, work_dir(rows.sparkSession, key), key, rows.schema, 32).create(rows)


def update_in_buckets(spark, sf_dir):
    """The same requests on a table that is changed where it lies."""
    users = _kept_in_buckets(_users(spark, sf_dir), "c_custkey")
    users.update(_user_requests(spark, sf_dir), "event_id", {"c_name": "new_name", "c_nationkey": "new_nation"})
    return users.rows()


def update_product(spark, sf_dir):
    requests = _requests(spark, sf_dir, p_partkey="if(event_type = 'view', event_id % 2500, -1 - event_id)",
                         new_name="concat('Product', cast(event_id AS string))", new_type="'UNCHECKED'",
                         new_price="cast(value AS decimal(10,2))")
    return changes.update_by_key(_products(spark, sf_dir), requests, "p_partkey", "event_id",
                                 {"p_name": "new_name", "p_type": "new_type", "p_price": "new_price"})


def _doomed_users(spark, sf_dir) -> DataFrame:
    return _requests(spark, sf_dir, c_custkey="if(event_type = 'error', user_id * 3, -1 - user_id)")


def _user_tables(spark, sf_dir) -> dict[str, DataFrame]:
    return {
        "parent": _users(spark, sf_dir), "addresses": _addresses(spark, sf_dir),
        "orders": table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("order_key")),
        "lines": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), "l_linenumber"),
    }


def _keys_left(left: dict[str, DataFrame]) -> DataFrame:
    none = F.lit(None).cast("bigint")

    def rows(name: str, first: str, second=none):
        return left[name].select(F.lit(name).alias("table_name"), F.col(first).alias("key_1"), second.alias("key_2"))

    return (rows("parent", "c_custkey").unionByName(rows("addresses", "c_custkey"))
            .unionByName(rows("orders", "order_key", F.col("c_custkey")))
            .unionByName(rows("lines", "order_key", F.col("l_linenumber").cast("bigint"))))


def delete_cascade(spark, sf_dir):
    """What is left of four tables after deleting the customers named by requests."""
    tables = _user_tables(spark, sf_dir)
    return _keys_left(changes.delete_cascade(
        _doomed_users(spark, sf_dir), "c_custkey", tables["parent"],
        {"addresses": tables["addresses"], "orders": tables["orders"]},
        {"lines": (tables["lines"], "orders", "order_key")}))


def delete_cascade_in_buckets(spark, sf_dir):
    """The same deletions in tables that are changed where they lie."""
    kept = {name: _kept_in_buckets(rows, "order_key" if name == "lines" else "c_custkey")
            for name, rows in _user_tables(spark, sf_dir).items()}
    delete_cascade_in_place(_doomed_users(spark, sf_dir), kept["parent"], kept["addresses"], kept["orders"],
                            grandchildren=((kept["lines"], kept["orders"]),))
    return _keys_left({name: held.rows() for name, held in kept.items()})


def delete_product(spark, sf_dir):
    keys = _requests(spark, sf_dir, p_partkey="if(event_type = 'view', user_id * 7, -1 - user_id)")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber")
    left = changes.delete_cascade(keys, "p_partkey", _products(spark, sf_dir), {"lines": lines})
    return left["parent"].select(
        F.lit("products").alias("table_name"), "p_partkey", F.lit(None).cast("bigint").alias("l_orderkey"),
        F.lit(None).cast("int").alias("l_linenumber"),
    ).unionByName(left["lines"].withColumn("table_name", F.lit("lines")))


def guarded_insert(spark, sf_dir):
    """The orders after adding those of known customers."""
    requests = _requests(spark, sf_dir, user_key="user_id * if(event_type = 'purchase', 13, 29)",
                         order_date="cast(ts AS timestamp)")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    guard = changes.Guard(table(spark, sf_dir, "customer"), "c_custkey", "user_key", NO_USER)
    added, _ = changes.guarded_insert(orders, requests, [guard], "o_orderkey", "event_id",
                                      {"o_custkey": "user_key", "o_orderdate": "order_date"})
    return added


def _line_requests(spark, sf_dir) -> tuple[DataFrame, list[changes.Guard]]:
    requests = _requests(spark, sf_dir, order_key="event_id * if(event_type = 'purchase', 3, 1)",
                         product_key="user_id * if(event_type = 'signup', 17, 2)",
                         new_quantity="cast(event_id % 50 + 1 AS int)")
    return requests, [changes.Guard(table(spark, sf_dir, "orders"), "o_orderkey", "order_key", NO_ORDER),
                      changes.Guard(table(spark, sf_dir, "part"), "p_partkey", "product_key", NO_PRODUCT)]


def guarded_insert_two(spark, sf_dir):
    """The verdict on order lines that need an order and a product."""
    return changes.guarded(*_line_requests(spark, sf_dir))


def insert_order_lines(spark, sf_dir):
    """All order lines after adding the accepted ones, and the rejected requests with their reason."""
    requests, guards = _line_requests(spark, sf_dir)
    added, rejected = changes.guarded_insert(
        _lines(spark, sf_dir), requests, guards, "line_id", "event_id",
        {"l_orderkey": "order_key", "l_partkey": "product_key", "quantity": "new_quantity"})
    return added.withColumn("status", F.lit(changes.ACCEPTED)).unionByName(rejected.selectExpr(
        "event_id AS line_id", "order_key AS l_orderkey", "product_key AS l_partkey", "new_quantity AS quantity",
        "cast(NULL AS string) AS product_name", "status"))


def _product_requests(spark, sf_dir) -> tuple[DataFrame, list[changes.Guard]]:
    requests = _requests(spark, sf_dir, new_name="concat('Made', cast(event_id AS string))",
                         category="CASE WHEN user_id % 4 = 0 THEN 'NO SUCH TYPE' WHEN event_type = 'view' THEN 'STANDARD'"
                                  " ELSE 'ECONOMY' END",
                         new_price="cast(value AS decimal(10,2))")
    types = table(spark, sf_dir, "part").select("p_type")
    return requests, [changes.Guard(types, "p_type", "category", NO_CATEGORY)]


def guarded_insert_category(spark, sf_dir):
    """The verdict on products that need a category."""
    requests, guards = _product_requests(spark, sf_dir)
    return changes.guarded(requests.select("event_id", "category"), guards)


def insert_products(spark, sf_dir):
    """All products after adding the accepted ones, and the rejected requests with their reason."""
    requests, guards = _product_requests(spark, sf_dir)
    added, rejected = changes.guarded_insert(
        _products(spark, sf_dir), requests, guards, "p_partkey", "event_id",
        {"p_name": "new_name", "p_type": "category", "p_price": "new_price"})
    return added.withColumn("status", F.lit(changes.ACCEPTED)).unionByName(rejected.selectExpr(
        "event_id AS p_partkey", "new_name AS p_name", "category AS p_type", "new_price AS p_price", "status"))


def list_users(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_name", "c_nationkey", "c_mktsegment")


def orders_by_user(spark, sf_dir):
    """Orders of all users who were active."""
    active = table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    return changes.matching(orders, active, "o_custkey")


def order_lines(spark, sf_dir):
    """Lines of the orders that events name."""
    named = _requests(spark, sf_dir, l_orderkey="event_id * if(event_type = 'purchase', 1, 5)")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("int").alias("quantity"))
    return changes.matching(lines, named, "l_orderkey")


def products_by_category(spark, sf_dir):
    return changes.lookup(_products(spark, sf_dir), "p_type", "ECONOMY", "p_name", "p_price")


def categories(spark, sf_dir):
    """One row per product: a category list keeps its duplicates."""
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("category_name"))


def seed_tables(spark, sf_dir):
    """Demo rows for every customer, the four tables side by side."""
    ids = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("id"))
    made = changes.seed_tables(ids, seed=42)
    users, orders = made["users"], made["orders"].drop("UserID")
    catalogue = changes.seed_catalogue(spark)
    products = catalogue["products"].join(catalogue["categories"], "CategoryID").select("ProductID", "CategoryName", "Price")
    return (users.join(made["addresses"], "UserID")
            .join(orders, F.col("OrderID") == F.col("UserID"))
            .join(made["order_details"], "OrderID").join(products, "ProductID"))


QUERIES: dict[str, Query] = {
    "resolve_sides": resolve_sides,
    "plan_preagg": plan_preagg,
    "plan_preagg_window": plan_preagg_window,
    "daily_totals": daily_totals,
    "plan_stats_from_days": plan_stats_from_days,
    "plan_stats_from_days_window": plan_stats_from_days_window,
    "text_features": text_features_query,
    "text_dedup_documents": text_dedup_documents,
    "statement_type": statement_type_query,
    "statement_type_conversations": statement_type_conversations,
    "group_agg_hash": _groups(),
    "group_agg_text": _groups(group_by="QueryText"),
    "group_agg_normalized": _groups(group_by="NormalizedText"),
    "group_agg_select_only": _groups(statement_type="SELECT"),
    "group_agg_merged": _groups(group_by="NormalizedText"),
    "compare_hash": _compare(),
    "compare_text": _compare(group_by="QueryText"),
    "compare_normalized": _compare(group_by="NormalizedText"),
    "compare_cpu": _compare(metric="CPU"),
    "compare_duration": _compare(metric="Duration"),
    "compare_merged": _compare(group_by="NormalizedText"),
    "compare_split": _compare(group_by="NormalizedText", split_by_hash=True),
    "regressed_groups": regressed_groups,
    "multi_plan_only": multi_plan_only,
    "dominant_plans": dominant_plans_query,
    "dominant_pairs": dominant_pairs_query,
    "multi_plan_dominant": multi_plan_dominant,
    "plan_indicators": plan_indicators,
    "regression_overview": _report("overview", min_exec=100, top_n=100),
    "regression_overview_text": _report("overview", group_by="QueryText", metric="CPU", top_n=None),
    "regression_summary": _report("summary"),
    "multi_plan_drilldown": _report("drilldown", store="plans"),
    "plan_shape_diff": _report("shape_report"),
    "persisted_regressions": persisted_regressions,
    "persisted_history": persisted_history,
    "step_metrics": step_metrics,
    "collection_check": collection_check,
    "table_row_counts": table_row_counts,
    "event_counts_by_file": event_counts_by_file,
    "event_counts_total": event_counts_total,
    "files_without_events": files_without_events,
    "capture_filter": capture_filter,
    "event_classification": event_classification,
    "replay_calls_only": replay_calls_only,
    "statement_rewrite": statement_rewrite,
    "statement_parameters": statement_parameters,
    "replay_sequence": replay_sequence,
    "replay_outcomes": replay_outcomes,
    "replay_outcomes_total": replay_outcomes_total,
    "replay_duration_text": replay_duration_text,
    "interval_rollup": interval_rollup,
    "statement_digests": statement_digests,
    "loaded_events": loaded_events,
    "loaded_run": loaded_run,
    "stream_classified": stream_classified,
    "stream_counts": stream_counts,
    "stream_interval_rollup": stream_interval_rollup,
    "add_with_child": add_with_child,
    "update_by_key": update_by_key,
    "update_in_buckets": update_in_buckets,
    "update_product": update_product,
    "delete_cascade": delete_cascade,
    "delete_cascade_in_buckets": delete_cascade_in_buckets,
    "delete_product": delete_product,
    "guarded_insert": guarded_insert,
    "guarded_insert_two": guarded_insert_two,
    "guarded_insert_category": guarded_insert_category,
    "insert_order_lines": insert_order_lines,
    "insert_products": insert_products,
    "list_users": list_users,
    "orders_by_user": orders_by_user,
    "order_lines": order_lines,
    "products_by_category": products_by_category,
    "categories": categories,
    "seed_tables": seed_tables,
}
