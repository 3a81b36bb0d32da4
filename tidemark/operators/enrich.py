"""Joins of page views with address, agent and speed dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK_BITS = 16


def with_location(views: DataFrame, geo: DataFrame, ip: str = "address") -> DataFrame:
    """Left join on the address range that holds `ip`; ranges do not overlap.

    Ranges are cut at blocks of 65,536 addresses, so the join is an equi-join on the
    block with the range as residue: it works at any size of either side.  Only
    distinct addresses are looked up.
    """
    fields = [c for c in geo.columns if c not in ("ip_lo", "ip_hi")]
    block = lambda c: F.shiftright(c, _BLOCK_BITS)
    cut = geo.withColumn("_block", F.explode(F.sequence(block("ip_lo"), block("ip_hi"))))
    known = views.select(F.col(ip).alias("_ip")).where("_ip is not null").distinct().withColumn("_block", block("_ip"))
    found = known.join(cut, "_block").where(F.col("_ip").between(F.col("ip_lo"), F.col("ip_hi"))).select("_ip", F.struct(*fields).alias("location"))
    return views.join(found, views[ip] == found["_ip"], "left").drop("_ip")


def _regex(pattern: Column) -> Column:
    """Whole-string regular expression of a wildcard with * and ?, in either case."""
    escaped = F.regexp_replace(pattern, r"([\\\\.^$|(){}+\[\]])", r"\\$1")
    return F.concat(F.lit("(?is)^"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


_PREFIX = 16


def with_agent(views: DataFrame, agents: DataFrame, ua: str = "ua") -> DataFrame:
    """Left join on the longest wildcard pattern that matches; distinct agents only.

    An equi-join on the literal beginning of a pattern, up to its first wildcard and at most
    `_PREFIX` characters, in lower case; the pattern as a whole is the residue.  Each agent
    takes part with its own beginnings of all these lengths.
    """
    fields = [c for c in agents.columns if c != "pattern"]
    head = F.substring(F.lower(F.regexp_replace("pattern", r"(?s)[*?].*$", "")), 1, _PREFIX)
    rules = agents.select(F.col("pattern").alias("_pattern"), _regex(F.col("pattern")).alias("_regex"), head.alias("_head"), F.struct(*fields).alias("_agent"))
    heads = F.transform(F.sequence(F.lit(0), F.lit(_PREFIX)), lambda n: F.substring(F.lower(F.col("_ua")), F.lit(1), n))
    known = views.select(F.col(ua).alias("_ua")).where("_ua is not null").distinct().withColumn("_head", F.explode(F.array_distinct(heads)))
    hits = known.join(rules, "_head").where(F.expr("_ua rlike _regex"))
    best = hits.groupBy("_ua").agg(F.max_by("_agent", F.struct(F.length("_pattern"), "_pattern")).alias("agent"))
    return views.join(best, views[ua] == best["_ua"], "left").drop("_ua")


def with_speed(episodes: DataFrame, speeds: DataFrame, name: str = "name", duration: str = "duration") -> DataFrame:
    """Adds `speed`: equi-join on the name, with lo < duration <= hi; null for unknown names.

    `speeds` has a few rows for each name of an episode; Spark broadcasts it when small.
    """
    s = speeds.select(F.col("name").alias("_name"), "lo", "hi", "speed")
    on = (episodes[name] == s["_name"]) & (F.col(duration) > F.col("lo")) & (F.col(duration) <= F.col("hi"))
    return episodes.join(s, on, "left").drop("_name", "lo", "hi")
