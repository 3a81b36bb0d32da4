"""Patterns over time: sparse supports by batch, ranges of buckets, and tail pruning.

The pattern table is (items, batch_id, support) and the batch table (batch_id, n_tx,
n_events).  All windows follow one clock of batches; an absent row is a zero.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import LEVELS, YEAR_BUCKET
from tidemark.functions.tilted import bucket
from tidemark.operators.constraints import Constraints
from tidemark.operators.itemsets import spread, subsets
from tidemark.operators.rules import rules
from tidemark.operators.transactions import batch_sizes, canonical


def batch_patterns(tx: DataFrame, min_pattern_support: float, max_len: int = 3, sizes: DataFrame | None = None) -> DataFrame:
    """items, batch_id, support of itemsets with support >= max(1, floor(share * events)) in their batch.

    Items that are rare in their batch go before subsets are emitted; those that stay are at
    most the items of an event / share, so each batch's list of them is short.
    """
    sizes = batch_sizes(tx) if sizes is None else sizes
    least = sizes.select("batch_id", F.greatest(F.lit(1), F.floor(F.lit(min_pattern_support) * F.col("n_events"))).alias("_k"))
    rows = spread(tx.select("batch_id", "items")).select("batch_id", canonical(F.col("items")).alias("items"))
    single = rows.select("batch_id", F.explode("items").alias("item")).groupBy("batch_id", "item").agg(F.count("*").alias("n"))
    often = single.join(least.where("_k > 1"), "batch_id").where("n >= _k").groupBy("batch_id").agg(F.collect_list("item").alias("_often"))
    kept = rows.join(often, "batch_id", "left").join(least, "batch_id").where("_k = 1 or _often is not null")
    items = F.when(F.col("_k") > 1, F.array_intersect("items", "_often")).otherwise(F.col("items"))
    each = F.concat(*[subsets(F.col("items"), k) for k in range(1, max_len + 1)])
    found = kept.select("batch_id", items.alias("items")).select("batch_id", F.explode(each).alias("items")).groupBy("batch_id", "items").agg(F.count("*").alias("support"))
    return found.join(least, "batch_id").where("support >= _k").select("items", "batch_id", "support")


def with_bucket(df: DataFrame, n: int) -> DataFrame:
    """Adds the tilted-time bucket; rows that have aged out are gone."""
    return df.withColumn("bucket", bucket(F.col("batch_id"), F.lit(n))).where("bucket is not null")


def windows(patterns: DataFrame, n: int) -> DataFrame:
    """items, bucket, support: each pattern's tilted-time window."""
    return with_bucket(patterns, n).groupBy("items", "bucket").agg(F.sum("support").alias("support"))


def compacted(patterns: DataFrame, n: int) -> DataFrame:
    """The pattern table with aged-out batches dropped and each bucket under its first batch."""
    return with_bucket(patterns, n).groupBy("items", "bucket").agg(F.min("batch_id").alias("batch_id"), F.sum("support").alias("support")).drop("bucket")


def range_events(sizes: DataFrame, n: int, first: int, last: int) -> DataFrame:
    """One row: events in the buckets first..last."""
    return with_bucket(sizes, n).where(F.col("bucket").between(first, last)).agg(F.coalesce(F.sum("n_events"), F.lit(0)).alias("events"))


def range_supports(patterns: DataFrame, n: int, first: int, last: int) -> DataFrame:
    return with_bucket(patterns, n).where(F.col("bucket").between(first, last)).groupBy("items").agg(F.sum("support").alias("support"))


def range_itemsets(patterns: DataFrame, sizes: DataFrame, n: int, first: int, last: int, min_support: float, constraints: Constraints | None = None, known: Mapping[str, int] | None = None) -> DataFrame:
    """items, support, events: support > ceil(min_support * events of the range)."""
    found = range_supports(patterns, n, first, last).join(F.broadcast(range_events(sizes, n, first, last)))
    found = found.where(F.col("support") > F.ceil(F.lit(min_support) * F.col("events")))
    return found.where(constraints.after_counting(known)) if constraints else found


def range_rules(patterns: DataFrame, sizes: DataFrame, n: int, first: int, last: int, min_support: float, min_confidence: float, itemsets: Constraints | None = None, consequent: Constraints | None = None, max_consequent: int = 1, known: Mapping[str, int] | None = None) -> DataFrame:
    """antecedent, consequent, support, confidence, events over a range of buckets."""
    both = (itemsets or Constraints()).merged(consequent or Constraints())
    wanted = range_itemsets(patterns, sizes, n, first, last, min_support, both, known)
    found = rules(wanted, range_supports(patterns, n, first, last), min_confidence, consequent, max_consequent, known)
    return found.join(F.broadcast(range_events(sizes, n, first, last)))


def droppable_tail(patterns: DataFrame, sizes: DataFrame, n: int, min_support: float, min_pattern_support: float) -> DataFrame:
    """items, drop_from: the first granularity (0 quarter .. 4 year) that may be dropped.

    From the pattern's oldest bucket on, a run of buckets is droppable as long as each
    stays under min_support of its events and the run so far under min_pattern_support;
    what is dropped are whole granularities that begin within the run.
    """
    events = with_bucket(sizes, n).groupBy("bucket").agg(F.sum("n_events").alias("size"))
    own = windows(patterns, n)
    grid = own.groupBy("items").agg(F.max("bucket").alias("oldest")).join(F.broadcast(events)).where("bucket <= oldest")  # at most 72 buckets a pattern
    full = grid.join(own, ["items", "bucket"], "left").withColumn("support", F.coalesce("support", F.lit(0)))
    old = Window.partitionBy("items").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    run = full.withColumn("sum", F.sum("support").over(old)).withColumn("events", F.sum("size").over(old))
    weak = (F.col("support") < F.ceil(F.lit(min_support) * F.col("size"))) & (F.col("sum") < F.ceil(F.lit(min_pattern_support) * F.col("events")))
    run = run.withColumn("weak", weak.cast("int")).withColumn("weak", F.min("weak").over(old))
    tail = run.where("weak = 1").groupBy("items").agg(F.min("bucket").alias("youngest"))
    starts = [first for _, first in LEVELS] + [YEAR_BUCKET]
    drop = F.coalesce(*[F.when(F.col("youngest") <= s, F.lit(g)) for g, s in enumerate(starts)])
    return tail.withColumn("drop_from", drop).where("drop_from is not null").select("items", "drop_from")


def drop_tail(own: DataFrame, tails: DataFrame) -> DataFrame:
    """Windows (items, bucket, support) without the granularities to drop."""
    starts = F.array(*[F.lit(first) for _, first in LEVELS], F.lit(YEAR_BUCKET))
    return own.join(tails, "items", "left").where(F.col("drop_from").isNull() | (F.col("bucket") < F.get(starts, F.col("drop_from")))).drop("drop_from")


#: Estimated bytes of a pattern's window and of an item's name.
WINDOW_BYTES, NAME_BYTES = 292, 80


def store_size(patterns: DataFrame) -> DataFrame:
    """One row: patterns, their supports by batch, items, and the estimated bytes of windows and names."""
    each = patterns.agg(F.count_distinct("items").alias("patterns"), F.count("*").alias("supports"))
    names = patterns.select(F.explode("items").alias("item")).agg(F.count_distinct("item").alias("items"))
    return each.join(F.broadcast(names)).withColumn("bytes", WINDOW_BYTES * F.col("patterns") + NAME_BYTES * F.col("items"))
