"""Transactions out of the standard tables.

events: an event is a page view with one episode; its circumstances are the customer's
place and segment.  orders: an order is a page view and its lines are the episodes, so
there are several transactions per event.  baskets: an order is one transaction of
brands and types.  pages: addresses as hierarchical items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import items as I
from tidemark.operators import transactions as T

#: Upper bounds of fast and acceptable.
VALUE_BOUNDS = [("fast", 20.0), ("acceptable", 70.0)]
QUANTITY_BOUNDS = [("fast", 15.0), ("acceptable", 35.0)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, nation and region names; nations and regions are fixed small dimensions."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    where = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return table(spark, sf_dir, "customer").join(F.broadcast(where), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name", "c_mktsegment")


def place_items() -> Column:
    return F.array(F.concat(F.lit("location:"), "r_name"), F.concat_ws(":", F.lit("location"), "r_name", "n_name"))


def day(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts) / 86400).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_id, event_id, ts, items."""
    return events_of(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), spark, sf_dir)


def events_of(e: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for given rows of events, such as a micro-batch."""
    k = F.floor(F.get_json_object("props", "$.k").cast("int") / 25).cast("int")
    items = F.concat(
        T.episode_items(F.col("event_type"), I.speed(F.col("value"), VALUE_BOUNDS, "slow")),
        F.array(F.concat(F.lit("k:"), k.cast("string"))),
        place_items(),
        F.array(F.concat_ws(":", F.lit("isp"), "n_name", "c_mktsegment")),
    )
    rows = e.join(places(spark, sf_dir), F.col("user_id") == F.col("c_custkey"), "left")
    return rows.select(F.col("event_id").alias("tx_id"), "event_id", "ts", T.canonical(items).alias("items"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_id, event_id (the order), ts, items; one row per line."""
    o = table(spark, sf_dir, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp")).join(places(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"), "left")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    items = F.concat(
        T.episode_items(F.col("p_type"), I.speed(F.col("l_quantity"), QUANTITY_BOUNDS, "slow")),
        F.array(F.concat(F.lit("priority:"), "o_orderpriority"), F.concat(F.lit("segment:"), "c_mktsegment")),
        place_items(),
    )
    rows = line.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("tx_id"), F.col("o_orderkey").alias("event_id"), "ts", T.canonical(items).alias("items"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_id, items: brands and types of an order; repeated parts count once."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    both = line.select("l_orderkey", F.explode(F.array(F.concat(F.lit("brand:"), "p_brand"), F.concat(F.lit("type:"), "p_type"))).alias("item"))
    return both.groupBy(F.col("l_orderkey").alias("tx_id")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_id, items: `page:host:dir:...` of each address, without query and fragment."""
    bare = F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")
    path = F.array_join(F.filter(F.split(F.regexp_replace(bare, ":", "_"), "/"), lambda p: p != ""), ":")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("tx_id"), F.array(F.concat(F.lit("page:"), path)).alias("items"))


def daily(tx: DataFrame) -> DataFrame:
    """One batch per day that has data."""
    return T.with_batches(tx, day(F.col("ts")))


def quarterly(tx: DataFrame) -> DataFrame:
    return T.with_batches(tx, T.quarter(F.col("ts")))


def minutely(tx: DataFrame) -> DataFrame:
    """One batch per minute, those without data included."""
    return T.with_batches(tx, F.floor(F.unix_timestamp("ts") / 60).cast("long"), "wall")
