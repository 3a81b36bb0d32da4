"""Supports and frequent itemsets.

Itemsets are arrays of items in binary order.  With a bound on their length all subsets up
to it are counted in one pass: infrequent items go first, each transaction emits its
subsets, and partial aggregation keeps the shuffle at the number of distinct subsets per
task.  Without a bound FP-growth mines them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.constraints import Constraints, count_known
from tidemark.operators.transactions import canonical


def item_support(tx: DataFrame) -> DataFrame:
    """item, support; an item counts once for each transaction."""
    return tx.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count("*").alias("support"))


def subsets(items: Column, size: int) -> Column:
    """All subsets of a size, in order, of an array without repeats."""
    if size == 1:
        return F.transform(items, lambda x: F.array(x))
    return F.flatten(F.transform(items, lambda x, i: F.transform(subsets(F.slice(items, i + 2, F.lit(1 << 20)), size - 1), lambda s: F.concat(F.array(x), s))))


#: Bytes of files that a task reads at once
_TASK_BYTES = 128 << 20


def spread(tx: DataFrame) -> DataFrame:
    """Rows dealt to all threads where their files are too small to give each of them a task.

    Emitting subsets multiplies the rows, so a single small file would keep one thread busy.
    At most a task's bytes for each thread are shuffled; larger tables stay as they are,
    however few files they have.
    """
    spark = tx.sparkSession
    n, names = spark.sparkContext.defaultParallelism, tx.inputFiles()
    if not names or len(names) >= n:
        return tx
    conf, path = spark._jsparkSession.sessionState().newHadoopConf(), spark._jvm.org.apache.hadoop.fs.Path
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in map(path, names))
    return tx.repartition(n) if size < n * _TASK_BYTES else tx


def subset_support(tx: DataFrame, size: int, by: tuple[str, ...] = ()) -> DataFrame:
    """items, support of all subsets of one size (per group `by`)."""
    return spread(tx.select(*by, "items")).select(*by, F.explode(subsets(canonical(F.col("items")), size)).alias("items")).groupBy(*by, "items").agg(F.count("*").alias("support"))


#: Frequent items up to which their names are literals in the plan; more are joined
LITERAL = 512


def frequent_items(tx: DataFrame, min_count: int) -> DataFrame:
    """item of all frequent items; no more than item occurrences / min_count."""
    return item_support(tx).where(F.col("support") >= min_count).select("item")


def _one_of(names: list[str]) -> Callable[[Column], Column]:
    return lambda x: x.isin(names) if names else F.lit(False)


def _literal(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


_CODE_BITS = 15


def _codes(codes: Column, size: int, prefix: Column | None = None) -> Column:
    """All subsets of a size of an ascending array of numbers, packed into one number each."""

    def packed(x: Column) -> Column:
        return x if prefix is None else F.shiftleft(prefix, _CODE_BITS).bitwiseOR(x)

    if size == 1:
        return F.transform(codes, packed)
    return F.flatten(F.transform(codes, lambda x, i: _codes(F.slice(codes, i + 2, F.lit(1 << 20)), size - 1, packed(x))))


def _plainly_counted(tx: DataFrame, max_len: int) -> DataFrame:
    each = F.concat(*[subsets(F.col("items"), k) for k in range(1, max_len + 1)])
    return tx.select(F.explode(each).alias("items")).groupBy("items").agg(F.count("*").alias("support"))


def _counted(tx: DataFrame, names: list[str], max_len: int) -> DataFrame:
    """items, support of all subsets of the frequent items `names` up to a length.

    Up to four items are counted as one packed number each.
    """
    if max_len > 4:
        return _plainly_counted(tx, max_len)
    if not names:
        return tx.select("items", F.lit(0).cast("long").alias("support")).limit(0)
    number = F.map_from_arrays(_literal(names), F.sequence(F.lit(1).cast("long"), F.lit(len(names)).cast("long")))
    coded = tx.select(F.transform("items", lambda x: F.element_at(number, x)).alias("codes"))
    each = F.concat(*[_codes(F.col("codes"), k) for k in range(1, max_len + 1)])
    found = coded.select(F.explode(each).alias("code")).groupBy("code").agg(F.count("*").alias("support"))
    digits = F.array(*[F.shiftright("code", _CODE_BITS * k).bitwiseAND((1 << _CODE_BITS) - 1).cast("int") for k in reversed(range(max_len))])
    return found.select(F.transform(F.filter(digits, lambda d: d > 0), lambda d: F.element_at(_literal(names), d)).alias("items"), "support")


def frequent_itemsets(tx: DataFrame, min_count: int, max_len: int | None = None, constraints: Constraints | None = None, backend: str = "subsets") -> DataFrame:
    """items, support of all itemsets with support >= min_count that meet the constraints.

    Without `max_len` itemsets of any length are mined, by FP-growth.  Constraints that
    an itemset needs an item for also drop the transactions without it, before counting.
    """
    min_count = max(1, min_count)
    known = count_known(tx, constraints.patterns()) if constraints else {}
    if constraints:
        tx = tx.withColumn("items", constraints.prune(F.col("items"))).where(constraints.needed(F.col("items"), known))
    tx = spread(tx.select("items")).select(canonical(F.col("items")).alias("items"))
    often = frequent_items(tx, min_count)
    names = sorted(r["item"] for r in often.limit(LITERAL + 1).collect())
    if len(names) <= LITERAL:
        tx = tx.select(F.filter("items", _one_of(names)).alias("items"))
    elif max_len is not None and backend != "fpgrowth":
        each = tx.withColumn("_tx", F.monotonically_increasing_id()).select("_tx", F.explode("items").alias("item"))
        tx = each.join(often, "item", "left_semi").groupBy("_tx").agg(F.array_sort(F.collect_list("item")).alias("items")).select("items")
    if max_len is None or backend == "fpgrowth":
        found = fpgrowth(tx, min_count)
        found = found if max_len is None else found.where(F.size("items") <= max_len)
    else:
        counted = _counted(tx, names, max_len) if len(names) <= LITERAL else _plainly_counted(tx, max_len)
        found = counted.where(F.col("support") >= min_count)
    return found.where(constraints.after_counting(known)) if constraints else found


def fpgrowth(tx: DataFrame, min_count: int) -> DataFrame:
    """The same by parallel FP-growth, of any length."""
    tx = tx.select(canonical(F.col("items")).alias("items")).where(F.size("items") > 0)
    n = tx.count()
    if not n:
        return tx.select("items", F.lit(0).cast("long").alias("support")).limit(0)
    # the threshold is ceil(minSupport * n); half a count less avoids a rounding overshoot
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_count - 0.5) / n)).fit(tx)
    return model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("support"))


def itemset_support(tx: DataFrame, wanted: list[list[str]]) -> DataFrame:
    """items, support of given itemsets, 0 included, in one pass; the empty set counts all."""
    sets = [sorted(set(w)) for w in wanted]
    holds = [F.sum(F.when(F.size(F.array_except(F.array(*[F.lit(x) for x in s]).cast("array<string>"), F.col("items"))) == 0, 1).otherwise(0)).alias(str(i)) for i, s in enumerate(sets)]
    row = tx.agg(*holds)
    return row.select(F.explode(F.array(*[F.struct(F.array(*[F.lit(x) for x in s]).cast("array<string>").alias("items"), F.coalesce(F.col(str(i)), F.lit(0)).cast("long").alias("support")) for i, s in enumerate(sets)])).alias("x")).select("x.*")
