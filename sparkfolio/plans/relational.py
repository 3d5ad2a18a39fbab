"""Relational queries over the star schema. They are extensions: the engine gets them from Spark as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import read_table
from .registry import query


@query("""
    select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n
    from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def ext_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""
    select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1""")
def ext_revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, customers, nations = (read_table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    per_order = lines.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    joined = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("""
    select c_mktsegment, c_custkey, c_acctbal from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as r from customer) where r <= 3""")
def ext_top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return read_table(spark, sf_dir, "customer").withColumn("r", F.row_number().over(best)).filter("r <= 3").select("c_mktsegment", "c_custkey", "c_acctbal")


@query("""
    select o_orderpriority, o_orderstatus, count(*) as n from orders group by rollup (o_orderpriority, o_orderstatus)""")
def ext_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("""
    select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)""")
def ext_customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
