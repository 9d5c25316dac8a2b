"""Graphs derived from the shared relational tables; the SQL runs unchanged in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..graph import Graph

COPURCHASE = """select a.l_partkey as src, b.l_partkey as dst, count(*) as weight from lineitem a join lineitem b
 on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey where a.l_quantity >= 41 and b.l_quantity >= 41 group by 1, 2"""
SUPPLIER_PART = "select distinct l_suppkey as src, 1000000 + l_partkey as dst, 1 as weight from lineitem"
ORDER_PART = "select distinct 10000000 + l_orderkey as src, l_partkey as dst, 1 as weight from lineitem"
TRADE = """select cast(s_nationkey as bigint) as src, cast(c_nationkey as bigint) as dst, cast(sum(l_quantity) as bigint) as weight
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
 where s_nationkey <> c_nationkey group by 1, 2"""
#: From the nation that sells the other more than it buys from it.
SURPLUS = f"""select a.src, a.dst, a.weight - coalesce(b.weight, 0) as weight from ({TRADE}) a left join ({TRADE}) b
 on b.src = a.dst and b.dst = a.src where a.weight > coalesce(b.weight, 0)"""
ORDER_CHAIN = """select o_orderkey as src, nx as dst, cast(round((np - o_totalprice) * 100) as bigint) as weight from (
 select o_orderkey, o_totalprice, lead(o_orderkey) over w as nx, lead(o_totalprice) over w as np from orders
 window w as (partition by o_custkey order by o_orderdate, o_orderkey)) t where nx is not null"""


def table_rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for name in ("lineitem", "orders", "customer", "supplier"):
        if name in sql:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


def table_graph(spark: SparkSession, sf_dir: str, sql: str, directed: bool = False, weighted: bool = True) -> Graph:
    return Graph.from_edges(table_rows(spark, sf_dir, sql), directed, weighted, ordered=False)
