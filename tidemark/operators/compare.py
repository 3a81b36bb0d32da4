"""Comparison of the rules of two time ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.patterns import with_bucket


def compare_rules(older: DataFrame, newer: DataFrame) -> DataFrame:
    """One full outer join on (antecedent, consequent).

    `state` is both, newer or older.  For rules in both, the variances are newer less
    older (of confidence and of support relative to the events), and the newer row is
    shown; rules in one range only are marked +1 or -1.
    """
    key = ["antecedent", "consequent"]
    a = older.select(*key, *[F.col(c).alias(f"_o_{c}") for c in ("support", "confidence", "events")])
    b = newer.select(*key, *[F.col(c).alias(f"_n_{c}") for c in ("support", "confidence", "events")])
    both = F.col("_o_support").isNotNull() & F.col("_n_support").isNotNull()
    mark = F.when(F.col("_n_support").isNotNull(), 1.0).otherwise(-1.0)
    return a.join(b, key, "full").select(
        *key,
        F.when(both, "both").when(F.col("_n_support").isNotNull(), "newer").otherwise("older").alias("state"),
        F.coalesce("_n_support", "_o_support").alias("support"),
        F.coalesce("_n_confidence", "_o_confidence").alias("confidence"),
        F.when(both, F.col("_n_confidence") - F.col("_o_confidence")).otherwise(mark).alias("confidence_variance"),
        F.when(both, F.col("_n_support") / F.col("_n_events") - F.col("_o_support") / F.col("_o_events")).otherwise(mark).alias("support_variance"),
        F.coalesce("_n_events", "_o_events").alias("events"),
    )


def combined_events(sizes: DataFrame, n: int, older: tuple[int, int], newer: tuple[int, int]) -> DataFrame:
    """One row: events in the older, the newer and the union of both ranges."""
    inside = [F.col("bucket").between(*r) for r in (older, newer)]
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n_events"))), F.lit(0))
    return with_bucket(sizes, n).agg(total(inside[0]).alias("older_events"), total(inside[1]).alias("newer_events"), total(inside[0] | inside[1]).alias("union_events"))
