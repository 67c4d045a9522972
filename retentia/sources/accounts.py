"""Account table derived from the order history tables.

Mapping (ours, documented in FIXTURES.md): one account per customer; the five
activity numbers come from calendar-2000 orders and their line items, and the
label says whether the customer ordered again from 2001-01-01 on. Customers
without a 2000 order keep null activity, which exercises numeric coercion.

Plan at scale:
* both order scans push their date filter down and read only their columns;
* line items are joined to the orders of the year first and aggregated per
  order afterwards, on the join's own partitioning;
* the per-customer aggregation is partial-then-final (a customer holding a
  third of all orders is combined map-side before the shuffle); customers with
  later orders come in as rows of the same aggregation;
* both customer-keyed sides are unique on the key, so the left join cannot
  fan out or skew.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import table

HISTORY_START = dt.datetime(2000, 1, 1)
HISTORY_END = dt.datetime(2001, 1, 1)
CUTOFF_DATE = dt.date(2001, 1, 1)

# Fixed values of the synthetic mapping: market segment -> plan text, spelled
# unevenly on purpose so that plan normalization has work to do.
SEGMENT_PLANS = (
    ("AUTOMOBILE", "starter"),
    ("BUILDING", "growth"),
    ("FURNITURE", "Business "),
    ("HOUSEHOLD", " ENTERPRISE"),
)
OTHER_PLAN = "legacy"


def account_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``account_id`` + the six source columns + ``renewed`` (0/1)."""
    lineitem = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")

    # Line items meet the orders of the year before they are aggregated, so
    # that those of other years are dropped in the join (its runtime filter
    # prunes them before the shuffle); the aggregation keeps its partitioning.
    year = orders.where((F.col("o_orderdate") >= F.lit(HISTORY_START)) & (F.col("o_orderdate") < F.lit(HISTORY_END)))
    has_lines = F.col("l_orderkey").isNotNull()
    per_order = (
        year.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
        .join(lineitem.select("l_orderkey", "l_quantity", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
        .agg(
            F.sum("l_quantity").alias("qty"),
            F.sum(F.when(has_lines & (F.col("l_returnflag") == "R"), 1).when(has_lines, 0)).alias("returned"),
        )
    )
    # Later orders only tell that there is one; a customer with nothing else
    # keeps null activity, exactly like one without any order.
    later = orders.where(F.col("o_orderdate") >= F.lit(HISTORY_END)).select("o_custkey", F.lit(1).alias("_later"))
    history = per_order.select("o_custkey", "o_orderdate", "o_orderstatus", "qty", "returned", F.lit(1).alias("_one"))
    activity = (
        history.unionByName(later, allowMissingColumns=True)
        .groupBy("o_custkey")
        .agg(
            (F.sum("qty") / F.lit(12.0)).alias("monthly_usage_hours"),
            F.sum("_one").cast(T.DoubleType()).alias("login_frequency"),
            F.max("o_orderdate").cast(T.DateType()).alias("last_seen"),
            F.sum("returned").cast(T.DoubleType()).alias("support_tickets"),
            F.sum(F.when(F.col("_one") == 1, F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)))
            .cast(T.DoubleType())
            .alias("payment_failures"),
            F.max("_later").alias("_later"),
        )
    )

    plan = F.lit(OTHER_PLAN)
    for segment, name in reversed(SEGMENT_PLANS):
        plan = F.when(F.col("c_mktsegment") == segment, F.lit(name)).otherwise(plan)

    return (
        customer.select("c_custkey", "c_mktsegment")
        .join(activity, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").alias("account_id"),
            "monthly_usage_hours",
            "login_frequency",
            F.datediff(F.lit(CUTOFF_DATE), F.col("last_seen")).cast(T.DoubleType()).alias("last_login_days"),
            "support_tickets",
            "payment_failures",
            plan.alias("subscription_plan"),
            F.coalesce(F.col("_later"), F.lit(0)).alias("renewed"),
        )
    )


# DuckDB text of the same mapping, used by the oracle queries.
ACCOUNTS_SQL = """
li AS (
  SELECT l_orderkey, SUM(l_quantity) AS qty,
         SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned
  FROM lineitem GROUP BY l_orderkey),
hist AS (
  SELECT o_custkey,
         SUM(li.qty) / 12.0 AS monthly_usage_hours,
         CAST(COUNT(*) AS DOUBLE) AS login_frequency,
         CAST(MAX(o_orderdate) AS DATE) AS last_seen,
         CAST(SUM(li.returned) AS DOUBLE) AS support_tickets,
         CAST(SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS DOUBLE) AS payment_failures
  FROM orders LEFT JOIN li ON o_orderkey = li.l_orderkey
  WHERE o_orderdate >= TIMESTAMP '2000-01-01 00:00:00'
    AND o_orderdate <  TIMESTAMP '2001-01-01 00:00:00'
  GROUP BY o_custkey),
fut AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00'),
accounts AS (
  SELECT c.c_custkey AS account_id,
         h.monthly_usage_hours, h.login_frequency,
         CAST(datediff('day', h.last_seen, DATE '2001-01-01') AS DOUBLE) AS last_login_days,
         h.support_tickets, h.payment_failures,
         CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'starter' WHEN 'BUILDING' THEN 'growth'
              WHEN 'FURNITURE' THEN 'Business ' WHEN 'HOUSEHOLD' THEN ' ENTERPRISE' ELSE 'legacy' END AS subscription_plan,
         CASE WHEN f.o_custkey IS NULL THEN 0 ELSE 1 END AS renewed
  FROM customer c LEFT JOIN hist h ON c.c_custkey = h.o_custkey
  LEFT JOIN fut f ON c.c_custkey = f.o_custkey)
"""
