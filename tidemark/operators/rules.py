"""Association rules from itemsets and their supports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.constraints import Constraints
from tidemark.operators.itemsets import subsets


def rules(itemsets: DataFrame, supports: DataFrame, min_confidence: float, consequent: Constraints | None = None, max_consequent: int = 1, known: Mapping[str, int] | None = None) -> DataFrame:
    """antecedent, consequent, support, confidence.

    `itemsets` are those to explain; `supports` has the support of all antecedents,
    unconstrained, so that none is missing.  Every item of a consequent must meet the
    constraints.  Since confidence never rises when items move to the consequent,
    filtering all subsets equals level-wise generation.
    """
    allowed = F.filter("items", lambda x: consequent.item_predicate(x, known)) if consequent else F.col("items")
    each = F.concat(*[subsets(allowed, k) for k in range(1, max_consequent + 1)])
    wanted = itemsets.where(F.size("items") >= 2).select("items", "support", F.explode(each).alias("consequent")).where(F.size("consequent") < F.size("items"))
    wanted = wanted.select(F.array_except("items", "consequent").alias("antecedent"), "consequent", "support")
    base = supports.select(F.col("items").alias("antecedent"), F.col("support").alias("_base"))
    return wanted.join(base, "antecedent").withColumn("confidence", F.col("support") / F.col("_base")).where(F.col("confidence") >= min_confidence).drop("_base")
