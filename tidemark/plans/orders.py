"""The order domain as read models: totals, customers with open and recent orders, order state, fulfilment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import fold
from tidemark.sources.events import table

REGISTERED, PLACED, LINE_ADDED, CANCELLED = range(4)


def order_totals(log: DataFrame) -> DataFrame:
    """(order_id, total, status): an upsert when placed, a later cancellation sets the status."""
    per = log.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.max(F.when(F.col("kind") == PLACED, F.col("amount"))).alias("total"),
        F.max(F.col("kind") == CANCELLED).alias("cancelled"),
    )
    return per.select("order_id", "total", F.when(F.col("cancelled"), "Cancelled").otherwise("Pending").alias("status"))


def customer_orders(log: DataFrame) -> DataFrame:
    """(customer_id, name, open_orders, recent_orders, spent, order_count), collections as sorted text.

    A cancellation names its order only; its customer is looked up in the orders placed, an equality join.
    """
    placed = log.where(F.col("kind") == PLACED).select("customer_id", "order_id", "amount", F.struct("recorded_at", "order_id").alias("ord"))
    gone = log.where(F.col("kind") == CANCELLED).select("order_id", F.lit(True).alias("gone"))
    sums = placed.groupBy("customer_id").agg(F.sum("amount").cast("double").alias("spent"), F.count(F.lit(1)).alias("order_count"))
    open_ = placed.join(gone, "order_id", "left_anti").groupBy("customer_id").agg(F.array_sort(F.collect_set("order_id")).alias("open_orders"))
    recent = fold.last_n(placed.select("customer_id", "ord", F.col("order_id").alias("value")), ["customer_id"], 5)
    names = log.where(F.col("kind") == REGISTERED).select("customer_id", "name")
    rows = names.join(sums, "customer_id", "full").join(open_, "customer_id", "left").join(recent, "customer_id", "left")
    text = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit("")).alias(c)
    return rows.select("customer_id", "name", text("open_orders"), text("items").alias("recent_orders"), F.coalesce("spent", F.lit(0.0)).alias("spent"), F.coalesce("order_count", F.lit(0)).alias("order_count"))


def order_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, status, n_lines, qty): lines are entities, the last one of a line number replaces the others."""
    l = table(spark, sf_dir, "lineitem")
    rank = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    lines = l.groupBy("l_orderkey", "l_linenumber").agg(F.max_by(F.col("l_quantity").cast("decimal(18,2)"), rank).alias("qty"))
    per = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("qty").alias("qty"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderstatus") == "F", "Cancelled").otherwise("Pending").alias("status"))
    out = o.join(per, F.col("order_id") == F.col("l_orderkey"), "left")
    return out.select("order_id", "status", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.col("qty").cast("double"), F.lit(0.0)).alias("qty"))


def fulfilment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, state, n_events): a process instance per order, its state after all its triggers."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    state = F.when(F.col("o_orderstatus") == "F", "cancelled").when((F.col("n") > 0) & (F.col("o_orderstatus") == "O"), "shipped").when(F.col("n") > 0, "prepared").otherwise("requested")
    return o.select(F.col("o_orderkey").alias("order_id"), state.alias("state"), F.coalesce("n", F.lit(0)).alias("n_events"))


def timers_due(spark: SparkSession, sf_dir: str, now: str) -> DataFrame:
    """(order_id, due_us): the timers of orders in progress, six hours after they were placed, due by ``now``."""
    due = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("interval 6 hours")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("order_id"), due.alias("due"))
    return o.where(F.col("due") <= F.lit(now).cast("timestamp_ntz")).select("order_id", F.unix_micros(F.col("due").cast("timestamp")).alias("due_us"))
