"""A property graph from relational tables: nations define customers and
suppliers, customers call orders, orders reference parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.schema import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tag(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _node(df: DataFrame, id_: Column, kind: str, name: Column, path: Column, language: Column, line: Column) -> DataFrame:
    return df.select(
        id_.alias("id"),
        F.lit(kind).alias("kind"),
        name.alias("name"),
        path.alias("path"),
        language.alias("language"),
        line.cast("int").alias("start_line"),
        line.cast("int").alias("end_line"),
        F.lit("").alias("error"),
    )


def _edge(df: DataFrame, src: Column, dst: Column, type_: str, path: Column, line: Column) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(type_).alias("type"), path.alias("path"), line.cast("int").alias("line"), F.lit(0).alias("col"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    read = lambda name: table(spark, sf_dir, name)
    nation, region, customer, supplier, part = map(read, ("nation", "region", "customer", "supplier", "part"))
    orders = read("orders").join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    of = lambda key: _tag("nation/", key)
    none, zero = F.lit(""), F.lit(0)
    nodes = [
        _node(nation, _tag("file::nation/", "n_nationkey"), "file", F.col("n_name"), of("n_nationkey"), F.lit("nation"), F.lit(1)),
        _node(customer, _tag("customer::", "c_custkey"), "class", F.col("c_name"), of("c_nationkey"), F.lower("c_mktsegment"), F.col("c_custkey")),
        _node(supplier, _tag("supplier::", "s_suppkey"), "interface", F.col("s_name"), of("s_nationkey"), F.lit("supplier"), F.col("s_suppkey")),
        _node(orders, _tag("order::", "o_orderkey"), "function", _tag("order_", "o_orderkey"), of("c_nationkey"), F.lower("o_orderstatus"), F.col("o_orderkey")),
        _node(part, _tag("external::", "p_partkey"), "external", F.col("p_name"), none, none, zero),
        _node(region, _tag("region::", "r_regionkey"), "constant", F.col("r_name"), none, F.lit("region"), zero),
    ]
    items = read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber").distinct()
    items = items.join(orders.select("o_orderkey", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = [
        _edge(customer, _tag("file::nation/", "c_nationkey"), _tag("customer::", "c_custkey"), "defines", of("c_nationkey"), F.col("c_custkey")),
        _edge(supplier, _tag("file::nation/", "s_nationkey"), _tag("supplier::", "s_suppkey"), "defines", of("s_nationkey"), F.col("s_suppkey")),
        _edge(orders, _tag("customer::", "o_custkey"), _tag("order::", "o_orderkey"), "calls", of("c_nationkey"), F.col("o_orderkey")),
        _edge(nation, _tag("file::nation/", "n_nationkey"), _tag("region::", "n_regionkey"), "imports", of("n_nationkey"), F.col("n_nationkey")),
        _edge(items, _tag("order::", "l_orderkey"), _tag("external::", "l_partkey"), "references", of("c_nationkey"), F.col("l_linenumber")),
    ]
    return Graph(_all(nodes), _all(edges))


def _all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


#: The same graph in SQL, as common table expressions for oracles.
SQL = """
nodes as (
    select 'file::nation/' || n_nationkey as id, 'file' as kind, n_name as name, 'nation/' || n_nationkey as path, 'nation' as language, 1 as start_line from nation
    union all select 'customer::' || c_custkey, 'class', c_name, 'nation/' || c_nationkey, lower(c_mktsegment), cast(c_custkey as int) from customer
    union all select 'supplier::' || s_suppkey, 'interface', s_name, 'nation/' || s_nationkey, 'supplier', cast(s_suppkey as int) from supplier
    union all select 'order::' || o_orderkey, 'function', 'order_' || o_orderkey, 'nation/' || c_nationkey, lower(o_orderstatus), cast(o_orderkey as int) from orders join customer on c_custkey = o_custkey
    union all select 'external::' || p_partkey, 'external', p_name, '', '', 0 from part
    union all select 'region::' || r_regionkey, 'constant', r_name, '', 'region', 0 from region),
edges as (
    select src, dst, type, path, line, 0 as col from (
        select 'file::nation/' || c_nationkey as src, 'customer::' || c_custkey as dst, 'defines' as type, 'nation/' || c_nationkey as path, cast(c_custkey as int) as line from customer
        union all select 'file::nation/' || s_nationkey, 'supplier::' || s_suppkey, 'defines', 'nation/' || s_nationkey, cast(s_suppkey as int) from supplier
        union all select 'customer::' || o_custkey, 'order::' || o_orderkey, 'calls', 'nation/' || c_nationkey, cast(o_orderkey as int) from orders join customer on c_custkey = o_custkey
        union all select 'file::nation/' || n_nationkey, 'region::' || n_regionkey, 'imports', 'nation/' || n_nationkey, n_nationkey from nation
        union all select distinct 'order::' || l_orderkey, 'external::' || l_partkey, 'references', 'nation/' || c_nationkey, l_linenumber
            from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey))
"""
