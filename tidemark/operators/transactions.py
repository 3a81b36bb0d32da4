"""Page views to transactions, batches and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import QUARTER_SECONDS
from tidemark.functions import items as I


def shared_items(location: str = "location", agent: str = "agent", status: str = "status", url: str = "url") -> Column:
    """Items that all episodes of a page view share; missing dimensions give none."""
    loc, ua = F.col(location), F.col(agent)
    place = F.when(loc.isNotNull(), I.location_items(loc["continent"], loc["country"], loc["region"], loc["isp"])).otherwise(F.array().cast("array<string>"))
    client = F.when(ua.isNotNull(), I.ua_items(ua["platform"], ua["browser_name"], ua["major"], ua["minor"], ua["is_mobile"])).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(I.url_item(F.col(url))), place, client, I.status_items(F.col(status)))


def episode_items(name: Column, speed: Column) -> Column:
    return F.array_compact(F.array(F.concat(F.lit("episode:"), name), F.concat(F.lit("duration:"), speed)))


def explode_views(views: DataFrame, shared: Column, episodes: str = "episodes") -> DataFrame:
    """One row per episode: the page view's columns, name, duration and the shared items."""
    return views.withColumn("shared", shared).withColumn("_e", F.explode(episodes)).select("*", "_e.name", "_e.duration").drop("_e", episodes)


def canonical(items: Column) -> Column:
    """Distinct items in binary order, the form in which itemsets are compared."""
    return F.array_sort(F.array_distinct(F.array_compact(items)))


def quarter(ts: Column) -> Column:
    """Number of the quarter of an hour since the epoch."""
    return F.floor(F.unix_timestamp(ts) / QUARTER_SECONDS).cast("long")


def with_batches(df: DataFrame, tick: Column, clock: str = "ordinal") -> DataFrame:
    """Adds batch_id from a whole-numbered tick.

    ordinal: only ticks with data count, as when an empty quarter makes no batch;
    wall: every tick counts.  Ranks the distinct ticks, never the rows.
    """
    rows = df.withColumn("_tick", tick)
    ticks = rows.select("_tick").where("_tick is not null").distinct()
    if clock == "wall":
        low = ticks.agg(F.min("_tick").alias("_low"))
        return rows.join(F.broadcast(low)).withColumn("batch_id", F.col("_tick") - F.col("_low")).drop("_tick", "_low")
    if clock != "ordinal":
        raise ValueError(f"no clock {clock!r}")
    ranked = ticks.withColumn("batch_id", (F.row_number().over(Window.orderBy("_tick")) - 1).cast("long"))
    return rows.join(ranked, "_tick", "left").drop("_tick")


def batch_sizes(tx: DataFrame) -> DataFrame:
    """batch_id, n_tx, n_events."""
    return tx.groupBy("batch_id").agg(F.count("*").alias("n_tx"), F.count_distinct("event_id").alias("n_events"))


def transactions_per_event(tx: DataFrame) -> DataFrame:
    return tx.agg(F.count("*").alias("n_tx"), F.count_distinct("event_id").alias("n_events")).withColumn("ratio", F.col("n_tx") / F.col("n_events"))


def statistics(tx: DataFrame, min_count: int, ts: str = "ts") -> DataFrame:
    """Start, end, page views, transactions, distinct and frequent items."""
    items = tx.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").count()
    seen = items.agg(F.count("*").alias("unique_items"), F.sum((F.col("count") >= min_count).cast("long")).alias("frequent_items"))
    span = tx.agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count_distinct("event_id").alias("page_views"), F.count("*").alias("transactions"))
    return span.join(F.broadcast(seen))
