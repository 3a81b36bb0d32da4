"""Pattern stream with pruning on arrival: less state, and lower bounds instead of counts.

In every batch but the first, an itemset is looked at only if the itemset without its most
frequent item was known before and still has support (no supersets of what is new or
has been dropped), and old buckets that cannot matter any more are dropped.  The default
store (`batches.PatternStore`) keeps all supports; this one trades that for a
table that stays small.

The state is the sparse table (items, batch_id, support), the order of items and the sizes
of all batches, written anew for each batch in folders of its own, the sizes last: a batch
that fails leaves the state as it was, and a store that is opened on a folder goes on after
the last whole batch.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import LEVELS, YEAR_BUCKET
from tidemark.operators import patterns
from tidemark.operators.itemsets import item_support, subset_support
from tidemark.operators.transactions import canonical
from tidemark.streaming.batches import _MARKED, folder

_TABLE = "items array<string>, batch_id long, support long"
_SIZES = "batch_id long, n_tx long, n_events long"
_ORDER = "item string, since long, support long"


class PrunedPatterns:
    """Itemsets up to `max_len` above `min_pattern_support` of their batch's events."""

    def __init__(self, spark: SparkSession, min_support: float, min_pattern_support: float, max_len: int = 4, path: str | None = None):
        self.spark, self.sigma, self.epsilon, self.max_len = spark, min_support, min_pattern_support, max_len
        self.path = path or folder(spark)
        self.sizes: list[tuple[int, int, int]] = []
        self.table = spark.createDataFrame([], _TABLE)
        self.order = spark.createDataFrame([], _ORDER)
        top = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/sizes")
        files = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        found = [s.getPath() for s in files.listStatus(top)] if files.exists(top) else []
        done = [int(p.getName().split("=")[1]) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        if done:
            read = lambda name, schema: spark.read.schema(schema).parquet(f"{self.path}/{name}/batch={max(done)}")
            self.table, self.order = read("patterns", _TABLE), read("order", _ORDER)
            self.sizes = sorted(tuple(r) for r in read("sizes", _SIZES).collect())  # one row a batch

    def _kept(self, df: DataFrame, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}/batch={len(self.sizes)}"
        df.write.mode("overwrite").option(_MARKED, "true").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _ranked(self, mined: DataFrame) -> DataFrame:
        """Adds `rest`: the itemset without its most frequent item, in canonical order.

        The order of items only grows: those of earlier batches first, then by support.
        """
        each = mined.select("items", F.explode("items").alias("item")).join(self.order, "item")
        top = each.groupBy("items").agg(F.min(F.struct("since", -F.col("support"), "item"))["item"].alias("top"))
        return mined.join(top, "items").withColumn("rest", F.array_except("items", F.array("top"))).drop("top")

    def sizes_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.sizes, _SIZES)

    def _pruned(self, table: DataFrame) -> DataFrame:
        n, sizes = len(self.sizes), self.sizes_table()
        tails = patterns.droppable_tail(table, sizes, n, self.sigma, self.epsilon)
        starts = F.array(*[F.lit(s) for _, s in LEVELS], F.lit(YEAR_BUCKET))
        rows = patterns.with_bucket(table, n).join(tails, "items", "left")
        return rows.where(F.col("drop_from").isNull() | (F.col("bucket") < F.get(starts, F.col("drop_from")))).select("items", "batch_id", "support")

    def add(self, tx: DataFrame) -> None:
        """One batch of transactions (event_id, items)."""
        number = len(self.sizes)
        counts = tx.agg(F.count("*"), F.count_distinct("event_id")).first()
        before = self.order, self.sizes
        self.sizes = [*self.sizes, (number, int(counts[0]), int(counts[1]))]
        try:
            self._add(tx, number, int(counts[1]))
        except Exception:
            self.order, self.sizes = before
            raise

    def _add(self, tx: DataFrame, number: int, events: int) -> None:
        least = max(1, math.floor(self.epsilon * events))
        tx = tx.select(canonical(F.col("items")).alias("items"))
        fresh = item_support(tx).join(self.order.select("item"), "item", "left_anti").select("item", F.lit(number).cast("long").alias("since"), "support")
        self.order = self._kept(self.order.unionByName(fresh), "order", _ORDER)
        mined = subset_support(tx, 1)
        for k in range(2, self.max_len + 1):
            mined = mined.unionByName(subset_support(tx, k))
        mined = self._kept(mined.where(F.col("support") >= least).withColumn("batch_id", F.lit(number).cast("long")).select("items", "batch_id", "support"), "mined", _TABLE)
        levels = [mined.where(F.size("items") == k) for k in range(1, self.max_len + 1)]
        if number:
            known = self.table.select("items").distinct()
            # known itemsets that still have support once this batch is in
            grown = self._pruned(self.table.unionByName(mined.join(known, "items", "left_semi"))).select("items").distinct().join(known, "items", "left_semi")
            reached, got = levels[0], [levels[0]]
            for m in levels[1:]:
                opened = reached.join(grown, "items", "left_semi").select(F.col("items").alias("rest"))
                reached = self._ranked(m).join(opened, "rest", "left_semi").drop("rest")
                got.append(reached)
            levels = got
        table = self.table
        for m in levels:
            table = table.unionByName(m)
        table = self._kept(self._pruned(table), "patterns", _TABLE)
        self._kept(self.sizes_table(), "sizes", _SIZES)
        self.table = table

    def size(self) -> int:
        return self.table.select("items").distinct().count()

    def windows(self) -> DataFrame:
        return patterns.windows(self.table, len(self.sizes))
