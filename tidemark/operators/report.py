"""Cause reports, their filters and the concept hierarchy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.items import glob_regex


def episode_of(items: Column) -> Column:
    """The first item of the episode category."""
    return F.get(F.filter(items, lambda x: x.startswith("episode")), F.lit(0))


def _cause(rules: DataFrame) -> list[Column]:
    """Episode name and the other items of the antecedent."""
    e = episode_of(F.col("antecedent"))
    name = F.substring(e, F.instr(e, ":") + 1, F.length(e))
    rest = F.filter("antecedent", lambda x: ~x.eqNullSafe(e))
    return [name.alias("episode"), F.array_join(rest, ", ").alias("circumstances"), (F.col("confidence") * 100).alias("pct_slow"), F.col("support").alias("n_slow")]


def cause_report(rules: DataFrame) -> DataFrame:
    """episode, circumstances, pct_slow, n_slow, rel_slow of each rule."""
    return rules.select(*_cause(rules), (F.col("support") / F.col("events")).alias("rel_slow"))


def compare_report(compared: DataFrame) -> DataFrame:
    """The same with changes in percent and in number; rules in one range change by all they have."""
    number = F.when(F.col("state") == "both", F.round(F.col("support_variance") * F.col("events"))).otherwise(F.signum("support_variance") * F.col("support"))
    return compared.select(*_cause(compared), (F.col("confidence_variance") * 100).alias("pct_change"), number.cast("long").alias("n_change"), F.signum("confidence_variance").cast("int").alias("sign"), "state")


def filter_causes(report: DataFrame, text: str) -> DataFrame:
    """Rows that match a filter `entry, entry, ...`.

    `episode:X` asks for X in the episode's name (the last such entry counts), other
    entries for a wildcard anywhere in the circumstances; letters match in either case.
    """
    entries = [e.strip() for e in text.split(",") if e.strip()]
    episodes = [e[len("episode:") :] for e in entries if e.startswith("episode:")]
    tests = [F.col("circumstances").rlike(f"(?i)(?s:{glob_regex(e)})") for e in entries if not e.startswith("episode:")]
    if episodes:
        tests.append(F.lower("episode").contains(episodes[-1].lower()))
    return report.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def sort_causes(report: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Sorted by a column, the episode without regard to case; ties by the other columns."""
    key = F.upper(by) if by == "episode" else F.col(by)
    return report.orderBy(key.desc() if descending else key.asc(), *[F.upper("episode") if c == "episode" else c for c in ("episode", "circumstances", "n_slow") if c != by])


def hierarchy(items: DataFrame, banned: tuple[str, ...] = ("duration", "url"), item: str = "item") -> DataFrame:
    """path, parent, label, depth of every prefix of every item outside the banned categories."""
    parts = F.filter(F.split(F.col(item), ":"), lambda p: p != "")
    paths = items.select(parts.alias("_p")).where((F.size("_p") > 0) & ~F.get("_p", F.lit(0)).isin(*banned)).distinct()
    steps = paths.select("_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("depth"))
    return steps.select(
        F.array_join(F.slice("_p", F.lit(1), F.col("depth")), ":").alias("path"),
        F.when(F.col("depth") > 1, F.array_join(F.slice("_p", F.lit(1), F.col("depth") - 1), ":")).alias("parent"),
        F.get("_p", F.col("depth") - 1).alias("label"),
        "depth",
    ).distinct()


def sorted_hierarchy(tree: DataFrame) -> DataFrame:
    return tree.orderBy(F.upper("path"), "path")


def complete(tree: DataFrame, text: str) -> DataFrame:
    """Paths that continue the last entry of a filter text, under the same parent."""
    entry = text.rsplit(", ", 1)[-1]
    return tree.where(F.lower("path").startswith(entry.lower()) & (F.col("depth") == entry.count(":") + 1))


def rollup_counts(tx: DataFrame, banned: tuple[str, ...] = ()) -> DataFrame:
    """path, support: transactions that hold an item at or under each path."""
    parts = F.filter(F.split("item", ":"), lambda p: p != "")
    each = tx.select("tx_id", F.explode("items").alias("item")).select("tx_id", parts.alias("_p"))
    if banned:
        each = each.where(~F.get("_p", F.lit(0)).isin(*banned))
    paths = each.select("tx_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("_p")), lambda k: F.array_join(F.slice("_p", F.lit(1), k), ":"))).alias("path"))
    return paths.distinct().groupBy("path").agg(F.count("*").alias("support"))
