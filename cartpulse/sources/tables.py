"""Adapters from the given Parquet tables to the canonical purchase-line shape.

Canonical purchase line (one row per invoice line):
  family_id, subcat_id, subcat_name, item_id, invoice_id, store_id, day,
  qty, list_price, net_sales, discount, division

TPC-H style mapping (lineitem joined to its order and part):
  family_id   o_custkey (``households=n`` groups customers into n households by
              o_custkey mod n; a grouping key, every line is kept)
  subcat_id   digits of p_brand          subcat_name  p_brand
  item_id     l_partkey                  invoice_id   l_orderkey
  store_id    l_suppkey                  day          order date
  qty         l_quantity                 list_price   l_extendedprice
  net_sales   l_extendedprice * (1 - l_discount)
  discount    l_extendedprice * l_discount
  division    'A' for ECONOMY / STANDARD parts, 'B' for PROMO / SMALL, else null
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartpulse.functions.periods import as_date
from cartpulse.session import size_shuffles

CANONICAL = [
    "family_id", "subcat_id", "subcat_name", "item_id", "invoice_id", "store_id",
    "day", "qty", "list_price", "net_sales", "discount", "division",
]

# Division labels of the item dimension (fixed values of the test mapping).
DIVISIONS = {"A": ("ECONOMY", "STANDARD"), "B": ("PROMO", "SMALL")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ts_bound(day) -> F.Column:
    # the order date column is timestamp_ntz; comparing against a literal of
    # the same type keeps the predicate pushable into the Parquet scan
    return F.lit(dt.datetime.combine(as_date(day), dt.time())).cast("timestamp_ntz")


def order_dates(spark: SparkSession, sf_dir: str, since=None, until=None) -> DataFrame:
    """Orders restricted to [since, until) on the order date, as pushed filters."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if since is not None:
        orders = orders.filter(F.col("o_orderdate") >= _ts_bound(since))
    if until is not None:
        orders = orders.filter(F.col("o_orderdate") < _ts_bound(until))
    return orders


def division_of(p_type: F.Column) -> F.Column:
    expr = None
    for label, types in DIVISIONS.items():
        cond = p_type.isin(*types)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def purchase_lines(spark: SparkSession, sf_dir: str, households: int | None = 100,
                   since=None, until=None) -> DataFrame:
    """Purchase lines from lineitem, orders and part.

    ``since`` (inclusive) / ``until`` (exclusive) bound the order date and are
    pushed into the orders scan.  Joins are plain equi-joins; AQE turns a side
    into a broadcast only from its runtime size, otherwise both sides are
    shuffled on the key.  The join order is chosen for the shuffle-join case:

    * whole history (no ``since``): part first, orders last.  The last join
      leaves the lines hash-partitioned by order key = invoice, which already
      satisfies every (family, subcat[, item], invoice) aggregation
      downstream, so the fact table is shuffled twice, not three times;
    * a date window (``since`` given: labels, holdout): orders first, so the
      date filter drops lines before the second join shuffles them.

    The shuffles of the session start with partitions by the number of lines (``size_shuffles``).
    """
    li = table(spark, sf_dir, "lineitem")
    size_shuffles(spark, li)
    li = li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    orders = order_dates(spark, sf_dir, since, until)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    family = F.col("o_custkey") if not households else F.col("o_custkey") % F.lit(households)
    if since is None:
        joined = li.join(part, li.l_partkey == part.p_partkey).join(orders, li.l_orderkey == orders.o_orderkey)
    else:
        joined = li.join(orders, li.l_orderkey == orders.o_orderkey).join(part, li.l_partkey == part.p_partkey)
    return joined.select(
        family.cast("bigint").alias("family_id"),
        F.expr("try_cast(substring(p_brand, 7) AS BIGINT)").alias("subcat_id"),
        F.col("p_brand").alias("subcat_name"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_orderkey").alias("invoice_id"),
        F.col("l_suppkey").alias("store_id"),
        F.to_date("o_orderdate").alias("day"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("list_price"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_sales"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("discount"),
        division_of(F.col("p_type")).alias("division"),
    )


def event_lines(spark: SparkSession, sf_dir: str, since=None, until=None) -> DataFrame:
    """The event log as purchase lines: family = user, subcat = event type,
    invoice = event id, value as the money columns."""
    ev = table(spark, sf_dir, "events")
    size_shuffles(spark, ev)
    ev = ev.select("event_id", "ts", "user_id", "event_type", "value")
    if since is not None:
        ev = ev.filter(F.col("ts") >= _ts_bound(since))
    if until is not None:
        ev = ev.filter(F.col("ts") < _ts_bound(until))
    return ev.select(
        F.col("user_id").cast("bigint").alias("family_id"),
        F.col("event_type").alias("subcat_id"),
        F.col("event_type").alias("subcat_name"),
        F.col("event_type").alias("item_id"),
        F.col("event_id").alias("invoice_id"),
        F.lit(None).cast("bigint").alias("store_id"),
        F.to_date("ts").alias("day"),
        F.lit(1.0).alias("qty"),
        F.col("value").alias("list_price"),
        F.col("value").alias("net_sales"),
        F.lit(0.0).alias("discount"),
        F.lit(None).cast("string").alias("division"),
    )


def item_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item -> subcategory, division (one row per part)."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.expr("try_cast(substring(p_brand, 7) AS BIGINT)").alias("subcat_id"),
        division_of(F.col("p_type")).alias("division"),
    )


def subcat_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.expr("try_cast(substring(p_brand, 7) AS BIGINT)").alias("subcat_id"),
        F.col("p_brand").alias("subcat_name"),
    ).distinct()
