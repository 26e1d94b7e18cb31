"""The star-schema tables as a property graph."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Region, Nation, Customer, Supplier, Part, Order, Event and Item nodes with the relationships between them."""
    read = lambda n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet")
    g = Graph(spark)

    def nodes(label: str, name: str, key: str, prefix: str, drop: tuple = ()):
        df = read(name)
        g.add_nodes(label, df, key, {c: c.removeprefix(prefix) for c in df.columns}, drop)
        return df

    nodes("Region", "region", "r_regionkey", "r_")
    nation = nodes("Nation", "nation", "n_nationkey", "n_", ("n_regionkey",))
    customer = nodes("Customer", "customer", "c_custkey", "c_", ("c_nationkey",))
    supplier = nodes("Supplier", "supplier", "s_suppkey", "s_", ("s_nationkey",))
    nodes("Part", "part", "p_partkey", "p_")
    orders = nodes("Order", "orders", "o_orderkey", "o_", ("o_custkey",))
    events = nodes("Event", "events", "event_id", "")
    nodes("Item", "embeddings", "vec_id", "")
    line = read("lineitem")
    col = F.col
    g.add_rels("IN_REGION", nation, ("Nation", col("n_nationkey")), ("Region", col("n_regionkey")), col("n_nationkey"))
    g.add_rels("IN_NATION", customer, ("Customer", col("c_custkey")), ("Nation", col("c_nationkey")), col("c_custkey") * 2)
    g.add_rels("IN_NATION", supplier, ("Supplier", col("s_suppkey")), ("Nation", col("s_nationkey")), col("s_suppkey") * 2 + 1)
    g.add_rels("PLACED", orders, ("Customer", col("o_custkey")), ("Order", col("o_orderkey")), col("o_orderkey"))
    key = col("l_orderkey") * 8 + col("l_linenumber")
    props = {c.removeprefix("l_"): col(c) for c in line.columns if c not in ("l_orderkey", "l_partkey", "l_suppkey")}
    g.add_rels("CONTAINS", line, ("Order", col("l_orderkey")), ("Part", col("l_partkey")), key, props)
    g.add_rels("SUPPLIED_BY", line, ("Order", col("l_orderkey")), ("Supplier", col("l_suppkey")), key)
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    g.add_rels("NEXT_EVENT", events.withColumn("next", after).where("next IS NOT NULL"), ("Event", col("event_id")), ("Event", col("next")), col("event_id"))
    g.catalog["items"] = {"what": "INDEX", "type": "VECTOR", "entity": "node", "label": "Item", "props": ["embedding"], "similarity": "cosine"}
    return g
