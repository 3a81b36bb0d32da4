"""All queries over the standard tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import items as I
from tidemark.functions import tilted as W
from tidemark.operators import compare, enrich, itemsets, parse, patterns, report, rules
from tidemark.operators import transactions as T
from tidemark.operators.constraints import DEFAULT_CONSEQUENT, DEFAULT_ITEMSETS, Constraints, count_known
from tidemark.plans import flows
from tidemark.plans.analyst import Analyst
from tidemark.sources import files
from tidemark.streaming import batches as stream
from tidemark.streaming.pruned import PrunedPatterns

SIGMA, EPSILON, CONFIDENCE = 0.05, 0.04, 0.2
#: Share for ranges of time, where itemsets of three are asked for
RANGE_SIGMA = 0.01
_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        _Q[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = sql.strip()
        return f

    return register


def queries():
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def shown(df: DataFrame) -> DataFrame:
    """Arrays of items as strings joined by bars."""
    return df.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else c for c, t in df.dtypes])


# -- shared SQL -----------------------------------------------------------------

_PLACES = "places AS (SELECT c_custkey, n_name, r_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_EVENTS = f"""{_PLACES}, txl AS MATERIALIZED (
  SELECT event_id AS tx_id, event_id, ts, list_sort(list_distinct([
    'episode:' || event_type,
    'duration:' || CASE WHEN value <= 20 THEN 'fast' WHEN value <= 70 THEN 'acceptable' ELSE 'slow' END,
    'k:' || (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) // 25),
    'location:' || r_name, 'location:' || r_name || ':' || n_name, 'isp:' || n_name || ':' || c_mktsegment])) AS items
  FROM events LEFT JOIN places ON user_id = c_custkey)"""
_ORDERS = f"""{_PLACES}, txl AS MATERIALIZED (
  SELECT l_orderkey * 100 + l_linenumber AS tx_id, o_orderkey AS event_id, o_orderdate AS ts, list_sort(list_distinct([
    'episode:' || p_type,
    'duration:' || CASE WHEN l_quantity <= 15 THEN 'fast' WHEN l_quantity <= 35 THEN 'acceptable' ELSE 'slow' END,
    'priority:' || o_orderpriority, 'segment:' || c_mktsegment,
    'location:' || r_name, 'location:' || r_name || ':' || n_name])) AS items
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey LEFT JOIN places ON o_custkey = c_custkey)"""
_BASKETS = """bt AS (SELECT l_orderkey, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
  txl AS MATERIALIZED (SELECT l_orderkey AS tx_id, list_sort(list_distinct(list('brand:' || p_brand) || list('type:' || p_type))) AS items FROM bt GROUP BY l_orderkey)"""
_PAGES = """txl AS MATERIALIZED (SELECT page_id AS tx_id, ['page:' || array_to_string(list_filter(string_split(replace(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), ':', '_'), '/'), lambda p: p != ''), ':')] AS items FROM pages)"""


def _subsets(most: int, keys: str = "", source: str = "txl") -> str:
    """CTEs tx(item rows) and sets(items, support) of all subsets up to a size, by self-joins."""
    lead = f"{keys}, " if keys else ""
    parts = []
    for k in range(1, most + 1):
        joins = "".join(f" JOIN tx t{i} ON t{i}.tx_id = t1.tx_id AND t{i}.item > t{i - 1}.item" for i in range(2, k + 1))
        value = " || '|' || ".join(f"t{i}.item" for i in range(1, k + 1))
        cols = "".join(f"t1.{c.strip()}, " for c in keys.split(",")) if keys else ""
        parts.append(f"SELECT {cols}{value} AS items, count(*) AS support FROM tx t1{joins} GROUP BY ALL")
    return f"numbered AS MATERIALIZED (SELECT row_number() OVER () AS uid, * FROM {source}), tx AS MATERIALIZED (SELECT uid AS tx_id, {lead}unnest(items) AS item FROM numbered), sets AS MATERIALIZED ({' UNION ALL '.join(parts)})"


_LIST = "string_split(items, '|')"
_N = "(SELECT count(*) FROM txl)"


def _least(share: float) -> str:
    return f"CAST(ceil({share} * {_N}) AS BIGINT)"


def _mined(flow: str, share: float, most: int, where: str = "TRUE") -> str:
    return f"WITH {flow}, {_subsets(most)} SELECT items, support FROM sets WHERE support >= {_least(share)} AND {where}"


def _count(spark: SparkSession, tx: DataFrame, share: float) -> int:
    import math

    return math.ceil(share * tx.count())


# -- supports and itemsets ----------------------------------------------------------


@query(f"WITH {_EVENTS}, {_subsets(1)} SELECT items AS item, support FROM sets")
def item_support(spark, sf):
    return itemsets.item_support(flows.events(spark, sf))


@query(f"WITH {_BASKETS}, {_subsets(1)} SELECT items AS item, support FROM sets")
def basket_item_support(spark, sf):
    return itemsets.item_support(flows.baskets(spark, sf))


@query(f"WITH {_EVENTS}, {_subsets(2)} SELECT items, support FROM sets WHERE contains(items, '|')")
def pair_support(spark, sf):
    return shown(itemsets.subset_support(flows.events(spark, sf), 2))


@query(f"WITH {_EVENTS}, {_subsets(3)} SELECT items, support FROM sets WHERE len({_LIST}) = 3")
def triple_support(spark, sf):
    return shown(itemsets.subset_support(flows.events(spark, sf), 3))


@query(_mined(_EVENTS, SIGMA, 4))
def freq_itemsets_k4(spark, sf):
    tx = flows.events(spark, sf)
    return shown(itemsets.frequent_itemsets(tx, _count(spark, tx, SIGMA), 4))


@query(_mined(_EVENTS, SIGMA, 4))
def freq_itemsets_fpgrowth(spark, sf):
    tx = flows.events(spark, sf)
    return shown(itemsets.frequent_itemsets(tx, _count(spark, tx, SIGMA), 4, backend="fpgrowth"))


@query(_mined(_EVENTS, 0.02, 6))
def freq_itemsets_any_length(spark, sf):
    """Transactions of events hold up to six items."""
    tx = flows.events(spark, sf)
    return shown(itemsets.frequent_itemsets(tx, _count(spark, tx, 0.02)))


@query(_mined(_BASKETS, 0.1, 2))
def freq_itemsets_baskets(spark, sf):
    tx = flows.baskets(spark, sf)
    return shown(itemsets.frequent_itemsets(tx, _count(spark, tx, 0.1), 2))


_WANTED = [["duration:slow", "episode:view"], ["duration:fast", "k:0", "location:ASIA"], ["episode:nothing"], []]


@query(f"""WITH {_EVENTS} SELECT '{'|'.join(_WANTED[0])}' AS items, count(*) FILTER (list_has_all(items, {_WANTED[0]})) AS support FROM txl
UNION ALL SELECT '{'|'.join(_WANTED[1])}', count(*) FILTER (list_has_all(items, {_WANTED[1]})) FROM txl
UNION ALL SELECT 'episode:nothing', 0 UNION ALL SELECT '', count(*) FROM txl""")
def itemset_support(spark, sf):
    return shown(itemsets.itemset_support(flows.events(spark, sf), _WANTED))


# -- constraints ----------------------------------------------------------------------

_CONSTRAINED = {
    "constraint_pos_any": (Constraints(positive_any=("episode:view", "episode:click")), f"list_has_any({_LIST}, ['episode:view', 'episode:click'])"),
    "constraint_pos_all": (Constraints(positive_all=("episode:view", "duration:slow")), f"list_has_all({_LIST}, ['episode:view', 'duration:slow'])"),
    "constraint_neg_all": (Constraints(negative_all=("duration:fast", "k:0")), f"NOT list_has_any({_LIST}, ['duration:fast', 'k:0'])"),
    "constraint_neg_any": (Constraints(negative_any=("duration:slow", "episode:view")), f"NOT list_has_all({_LIST}, ['duration:slow', 'episode:view'])"),
    "constraint_wildcard": (Constraints(positive_any=("location:A*:NATION_*", "epi*")), f"len(list_filter({_LIST}, lambda x: regexp_full_match(x, 'location:A.*:NATION_.*'))) > 0 AND len(list_filter({_LIST}, lambda x: starts_with(x, 'epi'))) > 0"),
    "constraint_wildcard_all": (Constraints(positive_all=("duration:sl*",), negative_all=("isp:*",)), f"len(list_filter({_LIST}, lambda x: starts_with(x, 'duration:sl'))) = 1 AND len(list_filter({_LIST}, lambda x: starts_with(x, 'isp:'))) = 0"),
    "constraint_wildcard_neg_any": (Constraints(negative_any=("duration:*",)), f"len(list_filter({_LIST}, lambda x: starts_with(x, 'duration:'))) < 3"),
}


def _constrained(name: str, constraints: Constraints):
    def run(spark, sf):
        tx = flows.events(spark, sf)
        return shown(itemsets.frequent_itemsets(tx, _count(spark, tx, 0.01), 3, constraints))

    run.__name__ = name
    return run


for _name, (_c, _where) in _CONSTRAINED.items():
    query(_mined(_EVENTS, 0.01, 3, _where), _name)(_constrained(_name, _c))


# -- rules ------------------------------------------------------------------------------

_RULES = f"""pairs AS (SELECT items, support, unnest({_LIST}) AS c FROM sets WHERE support >= {{least}} AND contains(items, '|')),
  named AS (SELECT array_to_string(list_filter({_LIST}, lambda x: x != c), '|') AS antecedent, c AS consequent, support FROM pairs),
  found AS (SELECT antecedent, consequent, n.support, n.support / s.support AS confidence FROM named n JOIN sets s ON s.items = antecedent)"""


def _rules_sql(flow: str, share: float, most: int, where: str, confidence: float = CONFIDENCE) -> str:
    return f"WITH {flow}, {_subsets(most)}, {_RULES.format(least=_least(share))} SELECT * FROM found WHERE confidence >= {confidence} AND {where}"


def _rules(tx: DataFrame, least: int, most: int | None, confidence: float, itemset: Constraints | None, consequent: Constraints | None, max_consequent: int = 1) -> DataFrame:
    every = itemsets.frequent_itemsets(tx, least, most)
    both = (itemset or Constraints()).merged(consequent or Constraints())
    wanted = every.where(both.after_counting(count_known(tx, both.patterns()))) if both else every
    return rules.rules(wanted, every, confidence, consequent, max_consequent)


@query(_rules_sql(_EVENTS, 0.005, 4, "consequent = 'duration:slow' AND contains(antecedent, 'episode:')"))
def rules_slow(spark, sf):
    tx = flows.events(spark, sf)
    return shown(_rules(tx, _count(spark, tx, 0.005), 4, CONFIDENCE, DEFAULT_ITEMSETS, DEFAULT_CONSEQUENT))


@query(_rules_sql(_EVENTS, 0.01, 3, "TRUE"))
def rules_all(spark, sf):
    tx = flows.events(spark, sf)
    return shown(_rules(tx, _count(spark, tx, 0.01), 3, CONFIDENCE, None, None))


@query(_rules_sql(_EVENTS, 0.01, 6, "consequent = 'duration:slow' AND contains(antecedent, 'episode:')"))
def rules_any_length(spark, sf):
    tx = flows.events(spark, sf)
    return shown(_rules(tx, _count(spark, tx, 0.01), None, CONFIDENCE, DEFAULT_ITEMSETS, DEFAULT_CONSEQUENT))


@query(_rules_sql(_BASKETS, 0.02, 2, "TRUE", 0.3))
def rules_baskets(spark, sf):
    tx = flows.baskets(spark, sf)
    return shown(_rules(tx, _count(spark, tx, 0.02), 2, 0.3, None, None))


@query(f"""WITH {_ORDERS}, {_subsets(3)}, big AS (SELECT items, support, {_LIST} AS l FROM sets WHERE support >= {_least(0.02)} AND contains(items, '|')),
  cons AS (SELECT items, support, l, [unnest(l)] AS c FROM big UNION ALL SELECT items, support, l, list_filter(l, lambda x: x != y.o) FROM (SELECT items, support, l, unnest(l) AS o FROM big WHERE len(l) = 3) y),
  named AS (SELECT array_to_string(list_filter(l, lambda x: NOT list_contains(c, x)), '|') AS antecedent, array_to_string(c, '|') AS consequent, support FROM cons)
SELECT antecedent, consequent, n.support, n.support / s.support AS confidence FROM named n JOIN sets s ON s.items = antecedent WHERE n.support / s.support >= 0.2""".replace("list_filter(l, lambda x: x != y.o)", "list_filter(y.l, lambda x: x != y.o)"))
def rules_multi_consequent(spark, sf):
    tx = flows.orders(spark, sf)
    return shown(_rules(tx, _count(spark, tx, 0.02), 3, 0.2, None, None, max_consequent=2))


# -- items, transactions, statistics ------------------------------------------------------


@query("SELECT event_id, CASE WHEN value <= 20 THEN 'fast' WHEN value <= 70 THEN 'acceptable' ELSE 'slow' END AS speed FROM events")
def discretize(spark, sf):
    return flows.table(spark, sf, "events").select("event_id", I.speed(F.col("value"), flows.VALUE_BOUNDS, "slow").alias("speed"))


_SPEED_LINES = ["click,fast,10,acceptable,40,slow", "view,fast,20,acceptable,70,slow", "error,fast,5,slow"]


@query("""WITH s(name, lo, hi, speed) AS (VALUES ('click', -1, 10, 'fast'), ('click', 10, 40, 'acceptable'), ('click', 40, 65535, 'slow'), ('view', -1, 20, 'fast'),
  ('view', 20, 70, 'acceptable'), ('view', 70, 65535, 'slow'), ('error', -1, 5, 'fast'), ('error', 5, 65535, 'slow'))
SELECT event_id, event_type AS name, CAST(floor(value) AS INT) AS duration, speed FROM events LEFT JOIN s ON name = event_type AND floor(value) > lo AND floor(value) <= hi""")
def discretize_table(spark, sf):
    bounds = files.speeds(spark.createDataFrame([(x,) for x in _SPEED_LINES], "value string"))
    e = flows.table(spark, sf, "events").select("event_id", F.col("event_type").alias("name"), F.floor("value").cast("int").alias("duration"))
    return enrich.with_speed(e, bounds)


@query(f"WITH {_ORDERS} SELECT tx_id, event_id, array_to_string(items, '|') AS items FROM txl")
def tx_explode(spark, sf):
    return shown(flows.orders(spark, sf).select("tx_id", "event_id", "items"))


@query(f"WITH {_ORDERS} SELECT count(*) AS n_tx, count(DISTINCT event_id) AS n_events, count(*) / count(DISTINCT event_id) AS ratio FROM txl")
def tx_per_event(spark, sf):
    return T.transactions_per_event(flows.orders(spark, sf))


@query("""SELECT c_custkey, array_to_string(['location:' || r_name, 'location:' || r_name || ':' || n_name, 'location:' || r_name || ':' || n_name || ':' || c_mktsegment, 'isp:' || n_name || ':' || c_mktsegment], '|') AS items
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def location_items(spark, sf):
    p = flows.places(spark, sf)
    return shown(p.select("c_custkey", I.location_items(F.col("r_name"), F.col("n_name"), F.col("c_mktsegment"), F.col("c_mktsegment")).alias("items")))


@query("""SELECT p_partkey, 'ua:' || p_type || '|ua:' || p_type || ':' || p_brand || '|ua:' || p_type || ':' || p_brand || ':' || (p_size // 10) || '|ua:' || p_type || ':' || p_brand || ':' || (p_size // 10) || ':' || (p_size % 10)
  || CASE WHEN p_size > 40 THEN '|ua:isMobile' ELSE '' END AS items FROM part""")
def ua_items(spark, sf):
    size = F.col("p_size")
    return shown(flows.table(spark, sf, "part").select("p_partkey", I.ua_items(F.col("p_type"), F.col("p_brand"), F.floor(size / 10), size % 10, size > 40).alias("items")))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'status:500' ELSE '' END AS items FROM events")
def status_items(spark, sf):
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    return shown(flows.table(spark, sf, "events").select("event_id", I.status_items(status).alias("items")))


@query(f"""WITH {_EVENTS}, i AS (SELECT item, count(*) AS n FROM (SELECT tx_id, unnest(items) AS item FROM txl) GROUP BY item)
SELECT CAST(epoch(min(ts)) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) AS BIGINT) AS "end", count(DISTINCT event_id) AS page_views, count(*) AS transactions, (SELECT count(*) FROM i) AS unique_items, (SELECT count(*) FROM i WHERE n >= 500) AS frequent_items FROM txl""".replace("CAST(epoch(min(ts)) AS BIGINT)", "CAST(floor(epoch(min(ts))) AS BIGINT)"))
def stats(spark, sf):
    s = T.statistics(flows.events(spark, sf), 500)
    return s.withColumn("start", F.unix_timestamp("start")).withColumn("end", F.unix_timestamp("end"))


# -- hierarchy ------------------------------------------------------------------------------

_TREE = """parts AS (SELECT DISTINCT list_filter(string_split(item, ':'), lambda p: p != '') AS p FROM (SELECT unnest(items) AS item FROM txl)),
  tree AS (SELECT DISTINCT array_to_string(p[1:d], ':') AS path, CASE WHEN d > 1 THEN array_to_string(p[1:d - 1], ':') END AS parent, p[d] AS label, CAST(d AS INT) AS depth
    FROM (SELECT p, unnest(range(1, len(p) + 1)) AS d FROM parts WHERE p[1] NOT IN ('duration', 'url')))"""


def _items(tx: DataFrame) -> DataFrame:
    return tx.select(F.explode("items").alias("item"))


@query(f"WITH {_EVENTS}, {_TREE} SELECT * FROM tree")
def hierarchy(spark, sf):
    return report.sorted_hierarchy(report.hierarchy(_items(flows.events(spark, sf))))


@query(f"WITH {_PAGES}, {_TREE} SELECT * FROM tree")
def hierarchy_pages(spark, sf):
    return report.hierarchy(_items(flows.pages(spark, sf)))


@query(f"WITH {_EVENTS}, {_TREE} SELECT * FROM tree WHERE starts_with(lower(path), 'location:a') AND depth = 2")
def hierarchy_completion(spark, sf):
    return report.complete(report.hierarchy(_items(flows.events(spark, sf))), "episode:view, location:a")


@query(f"""WITH {_PAGES}, e AS (SELECT DISTINCT tx_id, array_to_string(p[1:d], ':') AS path FROM (SELECT tx_id, p, unnest(range(1, len(p) + 1)) AS d FROM (SELECT tx_id, string_split(unnest(items), ':') AS p FROM txl)))
SELECT path, count(*) AS support FROM e GROUP BY path""")
def hierarchy_rollup_counts(spark, sf):
    return report.rollup_counts(flows.pages(spark, sf))


# -- batches and tilted windows --------------------------------------------------------------

_DAILY = "ranked AS (SELECT *, floor(epoch(ts) / 86400) AS tick FROM txl), tb AS (SELECT r.* EXCLUDE (tick), b.batch_id FROM ranked r JOIN (SELECT tick, row_number() OVER (ORDER BY tick) - 1 AS batch_id FROM (SELECT DISTINCT tick FROM ranked)) b USING (tick))"
_QUARTERLY = _DAILY.replace("86400", "900")
_SIZES = "sizes AS (SELECT batch_id, count(*) AS n_tx, count(DISTINCT event_id) AS n_events FROM tb GROUP BY batch_id)"
_NB = "(SELECT count(*) FROM sizes)"


@query(f"WITH {_EVENTS}, {_QUARTERLY} SELECT event_id, batch_id FROM tb")
def batches(spark, sf):
    return flows.quarterly(flows.events(spark, sf)).select("event_id", "batch_id")


@query(f"WITH {_EVENTS}, q AS (SELECT event_id, CAST(floor(epoch(ts) / 900) AS BIGINT) AS t FROM txl) SELECT event_id, t - (SELECT min(t) FROM q) AS batch_id FROM q")
def batches_wall_clock(spark, sf):
    return T.with_batches(flows.events(spark, sf), T.quarter(F.col("ts")), "wall").select("event_id", "batch_id")


@query(f"WITH {_ORDERS}, {_DAILY}, {_SIZES} SELECT * FROM sizes")
def batch_sizes(spark, sf):
    return T.batch_sizes(flows.daily(flows.orders(spark, sf)))


@query(f"WITH n AS (SELECT unnest([1, 4, 5, 97, 101, 2780, 3000]) AS n), b AS (SELECT n, unnest(range(n)) AS b FROM n) SELECT n, b, {W.bucket_sql('b', 'n')} AS bucket FROM b")
def tilted_buckets(spark, sf):
    n = spark.createDataFrame([(x,) for x in (1, 4, 5, 97, 101, 2780, 3000)], "n long")
    b = n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("b"))
    return b.withColumn("bucket", W.bucket(F.col("b"), F.col("n")))


@query(f"""WITH {_EVENTS}, {_QUARTERLY}, {_SIZES} SELECT item, {W.bucket_sql('batch_id', _NB)} AS bucket, count(*) AS support
FROM (SELECT batch_id, unnest(items) AS item FROM tb) GROUP BY ALL""")
def tilted_windows(spark, sf):
    tx = flows.quarterly(flows.events(spark, sf))
    n = T.batch_sizes(tx).count()
    p = tx.select("batch_id", F.explode("items").alias("items")).groupBy("items", "batch_id").agg(F.count("*").alias("support"))
    return patterns.windows(p, n).withColumnRenamed("items", "item")


@query(f"""WITH {_EVENTS}, {_QUARTERLY}, {_SIZES}, w AS (SELECT {W.bucket_sql('batch_id', _NB)} AS bucket, n_events FROM sizes),
r(name, a, z) AS (VALUES {', '.join(f"('{k}', {a}, {z})" for k, (a, z) in C.TIME_RANGES.items())})
SELECT name, CAST(coalesce(sum(n_events), 0) AS BIGINT) AS events FROM r LEFT JOIN w ON bucket BETWEEN a AND z GROUP BY name""")
def tilted_range_support(spark, sf):
    sizes = T.batch_sizes(flows.quarterly(flows.events(spark, sf)))
    w = patterns.with_bucket(sizes, sizes.count())
    r = spark.createDataFrame([(k, *v) for k, v in C.TIME_RANGES.items()], "name string, a int, z int")
    return F.broadcast(r).join(w, F.col("bucket").between(F.col("a"), F.col("z")), "left").groupBy("name").agg(F.coalesce(F.sum("n_events"), F.lit(0)).alias("events"))


_PAT = f"""{_subsets(3, 'batch_id', 'tb')}, pat AS (SELECT s.* FROM sets s JOIN sizes z USING (batch_id) WHERE support >= greatest(1, CAST(floor({EPSILON} * n_events) AS BIGINT)))"""
_BUCKETED = f"wp AS (SELECT items, support, {W.bucket_sql('batch_id', _NB)} AS bucket FROM pat), ws AS (SELECT n_events, {W.bucket_sql('batch_id', _NB)} AS bucket FROM sizes)"


def _range(tag: str, first: int, last: int) -> str:
    return f"""ev{tag} AS (SELECT CAST(coalesce(sum(n_events), 0) AS BIGINT) AS events FROM ws WHERE bucket BETWEEN {first} AND {last}),
  sup{tag} AS (SELECT items, CAST(sum(support) AS BIGINT) AS support FROM wp WHERE bucket BETWEEN {first} AND {last} GROUP BY items),
  its{tag} AS (SELECT items, support, events FROM sup{tag}, ev{tag} WHERE support > CAST(ceil({RANGE_SIGMA} * events) AS BIGINT)),
  rul{tag} AS (SELECT antecedent, consequent, n.support, n.support / s.support AS confidence, events FROM (
      SELECT array_to_string(list_filter({_LIST}, lambda x: x != 'duration:slow'), '|') AS antecedent, 'duration:slow' AS consequent, support, events FROM its{tag}
      WHERE list_contains({_LIST}, 'duration:slow') AND len({_LIST}) > 1 AND contains(items, 'episode:')) n JOIN sup{tag} s ON s.items = antecedent WHERE n.support / s.support >= {CONFIDENCE})"""


_TIMED = f"WITH {_EVENTS}, {_DAILY}, {_SIZES}, {_PAT}, {_BUCKETED}"


def _timed(spark, sf):
    tx = flows.daily(flows.events(spark, sf))
    sizes = T.batch_sizes(tx)
    return patterns.batch_patterns(tx, EPSILON, 3, sizes), sizes, sizes.count()


@query(f"WITH {_EVENTS}, {_DAILY}, {_SIZES}, {_PAT} SELECT items, batch_id, support FROM pat")
def batch_patterns(spark, sf):
    return shown(_timed(spark, sf)[0])


@query(f"{_TIMED}, {_range('', 0, 71)} SELECT * FROM its")
def range_itemsets(spark, sf):
    p, sizes, n = _timed(spark, sf)
    return shown(patterns.range_itemsets(p, sizes, n, 0, 71, RANGE_SIGMA))


_TIMED_ORDERS = f"WITH {_ORDERS}, {_DAILY}, {_SIZES}, {_PAT}, {_BUCKETED}"
_MINUTELY = "ranked AS (SELECT *, CAST(floor(epoch(ts) / 60) AS BIGINT) AS tick FROM txl), tb AS (SELECT * EXCLUDE (tick), tick - (SELECT min(tick) FROM ranked) AS batch_id FROM ranked)"
_TIMED_MINUTES = f"WITH {_EVENTS}, {_MINUTELY}, {_SIZES}, {_PAT}, {_BUCKETED}".replace(_NB, "(SELECT max(batch_id) + 1 FROM sizes)")


def _timed_orders(spark, sf):
    tx = flows.daily(flows.orders(spark, sf))
    sizes = T.batch_sizes(tx)
    return patterns.batch_patterns(tx, EPSILON, 3, sizes), sizes, sizes.count()


def _timed_minutes(spark, sf):
    tx = flows.minutely(flows.events(spark, sf))
    sizes = T.batch_sizes(tx)
    return patterns.batch_patterns(tx, EPSILON, 3, sizes), sizes, (sizes.agg(F.max("batch_id")).first()[0] or 0) + 1


def _register_ranges() -> None:
    """Short ranges over daily batches of events, days and weeks over orders, which span years
    of daily batches, months and the year over batches of a minute, of which a month of
    events has more than the buckets below."""
    flow = {"day": (_timed_orders, _TIMED_ORDERS), "week": (_timed_orders, _TIMED_ORDERS), "month": (_timed_minutes, _TIMED_MINUTES), "year": (_timed_minutes, _TIMED_MINUTES)}
    for name, (first, last) in C.TIME_RANGES.items():
        timed, sql = flow.get(name, (_timed, _TIMED))

        def run(spark, sf, first=first, last=last, timed=timed):
            p, sizes, n = timed(spark, sf)
            return shown(patterns.range_rules(p, sizes, n, first, last, RANGE_SIGMA, CONFIDENCE, DEFAULT_ITEMSETS, DEFAULT_CONSEQUENT))

        query(f"{sql}, {_range('', first, last)} SELECT * FROM rul", f"range_rules_{name}")(run)


_register_ranges()


_TAIL = f"""{_TIMED}, ev AS (SELECT bucket, sum(n_events) AS size FROM ws GROUP BY bucket), own AS (SELECT items, bucket, CAST(sum(support) AS BIGINT) AS support FROM wp GROUP BY ALL),
  f AS (SELECT g.items, g.bucket, size, coalesce(support, 0) AS support FROM (SELECT items, bucket, size FROM (SELECT items, max(bucket) AS oldest FROM own GROUP BY items), ev WHERE bucket <= oldest) g LEFT JOIN own USING (items, bucket)),
  r AS (SELECT items, bucket, support < ceil({SIGMA * 4} * size) AND sum(support) OVER o < ceil({EPSILON * 4} * sum(size) OVER o) AS weak FROM f WINDOW o AS (PARTITION BY items ORDER BY bucket DESC ROWS UNBOUNDED PRECEDING)),
  t AS (SELECT items, min(bucket) AS y FROM (SELECT items, bucket, bool_and(weak) OVER (PARTITION BY items ORDER BY bucket DESC ROWS UNBOUNDED PRECEDING) AS weak FROM r) WHERE weak GROUP BY items),
  tails AS (SELECT items, CASE WHEN y <= 0 THEN 0 WHEN y <= 4 THEN 1 WHEN y <= 28 THEN 2 WHEN y <= 59 THEN 3 ELSE 4 END AS drop_from FROM t)"""


@query(f"{_TAIL} SELECT * FROM tails")
def droppable_tail(spark, sf):
    p, sizes, n = _timed(spark, sf)
    return shown(patterns.droppable_tail(p, sizes, n, SIGMA * 4, EPSILON * 4))


@query(f"{_TAIL} SELECT items, bucket, support FROM own LEFT JOIN tails USING (items) WHERE drop_from IS NULL OR bucket < [0, 4, 28, 59, 71][drop_from + 1]")
def windows_without_tail(spark, sf):
    p, sizes, n = _timed(spark, sf)
    return shown(patterns.drop_tail(patterns.windows(p, n), patterns.droppable_tail(p, sizes, n, SIGMA * 4, EPSILON * 4)))


@query(f"{_TIMED} SELECT count(DISTINCT items) AS patterns, count(*) AS supports, (SELECT count(DISTINCT i) FROM (SELECT unnest({_LIST}) AS i FROM pat)) AS items, 292 * count(DISTINCT items) + 80 * (SELECT count(DISTINCT i) FROM (SELECT unnest({_LIST}) AS i FROM pat)) AS bytes FROM pat")
def pattern_store_size(spark, sf):
    return patterns.store_size(_timed(spark, sf)[0])


@query(f"{_TIMED}, {_range('', 0, 71)} SELECT * FROM rul")
def analyst_rules(spark, sf):
    """Thresholds come from settings that were saved and loaded."""
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as d:  # the driver's own settings file, not data
        C.Settings(SIGMA, EPSILON, CONFIDENCE, range_support=RANGE_SIGMA).save(str(Path(d) / "settings.json"))
        settings = C.Settings.load(str(Path(d) / "settings.json"))
    return shown(Analyst(flows.daily(flows.events(spark, sf)), settings).rules("all"))


# -- comparison and reports ---------------------------------------------------------------------

_COMPARED = f"""{_TIMED}, {_range('o', 4, 27)}, {_range('n', 0, 3)},
  cmp AS (SELECT coalesce(n.antecedent, o.antecedent) AS antecedent, coalesce(n.consequent, o.consequent) AS consequent,
    CASE WHEN n.support IS NULL THEN 'older' WHEN o.support IS NULL THEN 'newer' ELSE 'both' END AS state,
    coalesce(n.support, o.support) AS support, coalesce(n.confidence, o.confidence) AS confidence,
    CASE WHEN n.support IS NULL THEN -1.0::DOUBLE WHEN o.support IS NULL THEN 1.0::DOUBLE ELSE n.confidence - o.confidence END AS confidence_variance,
    CASE WHEN n.support IS NULL THEN -1.0::DOUBLE WHEN o.support IS NULL THEN 1.0::DOUBLE ELSE n.support / n.events - o.support / o.events END AS support_variance,
    coalesce(n.events, o.events) AS events
  FROM rulo o FULL JOIN ruln n ON o.antecedent = n.antecedent AND o.consequent = n.consequent)"""


def _compared(spark, sf):
    p, sizes, n = _timed(spark, sf)
    older, newer = (patterns.range_rules(p, sizes, n, a, z, RANGE_SIGMA, CONFIDENCE, DEFAULT_ITEMSETS, DEFAULT_CONSEQUENT) for a, z in ((4, 27), (0, 3)))
    return compare.compare_rules(older, newer)


@query(f"{_COMPARED} SELECT * FROM cmp")
def compare_rules(spark, sf):
    return shown(_compared(spark, sf))


@query(f"""{_TIMED} SELECT CAST(coalesce(sum(n_events) FILTER (bucket BETWEEN 4 AND 27), 0) AS BIGINT) AS older_events, CAST(coalesce(sum(n_events) FILTER (bucket BETWEEN 0 AND 4), 0) AS BIGINT) AS newer_events,
CAST(coalesce(sum(n_events) FILTER (bucket BETWEEN 0 AND 27), 0) AS BIGINT) AS union_events FROM ws""")
def compare_events(spark, sf):
    _, sizes, n = _timed(spark, sf)
    return compare.combined_events(sizes, n, (4, 27), (0, 4))


_EP = "list_filter(string_split(antecedent, '|'), lambda x: starts_with(x, 'episode'))[1]"
_CAUSE = f"substr({_EP}, strpos({_EP}, ':') + 1) AS episode, array_to_string(list_filter(string_split(antecedent, '|'), lambda x: NOT starts_with(x, 'episode')), ', ') AS circumstances, confidence * 100 AS pct_slow, support AS n_slow"
_REPORT = f"{_TIMED_MINUTES}, {_range('', *C.TIME_RANGES['month'])}, rep AS (SELECT {_CAUSE}, support / events AS rel_slow FROM rul)"


@query(f"{_COMPARED} SELECT {_CAUSE}, confidence_variance * 100 AS pct_change, CAST(CASE WHEN state = 'both' THEN round(support_variance * events) ELSE sign(support_variance) * support END AS BIGINT) AS n_change, CAST(sign(confidence_variance) AS INT) AS sign, state FROM cmp")
def compare_report(spark, sf):
    return report.compare_report(_compared(spark, sf))


def _report(spark, sf):
    p, sizes, n = _timed_minutes(spark, sf)
    return report.cause_report(patterns.range_rules(p, sizes, n, *C.TIME_RANGES["month"], RANGE_SIGMA, CONFIDENCE, DEFAULT_ITEMSETS, DEFAULT_CONSEQUENT))


@query(f"{_REPORT} SELECT * FROM rep")
def cause_report(spark, sf):
    return _report(spark, sf)


@query(f"{_REPORT} SELECT * FROM rep WHERE contains(lower(episode), 'i') AND regexp_matches(circumstances, '(?i)LOCATION.*a')")
def cause_filter(spark, sf):
    return report.filter_causes(_report(spark, sf), "episode:I, LOCATION*a")


@query(f"{_REPORT} SELECT * FROM rep ORDER BY n_slow DESC")
def cause_sorted(spark, sf):
    return report.sort_causes(_report(spark, sf), "n_slow", descending=True)


@query(f"""WITH t AS (SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS s, CAST(floor(epoch(max(ts))) AS BIGINT) AS e FROM events), r(name, near, far) AS (VALUES {', '.join(f"('{k}', {W.quarter_distance(a, False)}, {W.quarter_distance(z, True)})" for k, (a, z) in C.TIME_RANGES.items())})
SELECT name, greatest(CAST(ceil(e / 900) AS BIGINT) * 900 - far * 900, s) AS from_s, greatest(CAST(ceil(e / 900) AS BIGINT) * 900 - near * 900, s) AS to_s FROM t, r""")
def bucket_interval(spark, sf):
    t = flows.table(spark, sf, "events").agg(F.unix_timestamp(F.min(F.col("ts").cast("timestamp"))).alias("s"), F.unix_timestamp(F.max(F.col("ts").cast("timestamp"))).alias("e"))
    each = [F.struct(F.lit(k).alias("name"), *[c.alias(n) for c, n in zip(W.interval(a, z, F.col("s"), F.col("e")), ("from_s", "to_s"), strict=True)]) for k, (a, z) in C.TIME_RANGES.items()]
    return t.select(F.explode(F.array(*each)).alias("x")).select("x.*")


@query("SELECT c_custkey, 0.05 * (1 - (abs(c_custkey) % 100) / 100) AS support, 100 * (1 - 0.05 * (1 - (abs(c_custkey) % 100) / 100) / 0.05) AS margin FROM customer")
def error_margin(spark, sf):
    percent = F.abs("c_custkey") % 100
    support = C.support_from_margin(0.05, percent)
    return flows.table(spark, sf, "customer").select("c_custkey", support.alias("support"), C.margin_from_support(0.05, support).alias("margin"))


# -- logs ------------------------------------------------------------------------------------------


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines out of events; every 97th is cut short."""
    ip = F.concat_ws(".", F.lit("10"), (F.col("user_id") % 7).cast("string"), F.floor(F.col("user_id") / 250).cast("string"), (F.col("user_id") % 250).cast("string"))
    time = F.date_format(F.col("ts").cast("timestamp"), "EEEE, dd-MMM-yyyy HH:mm:ss")
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    line = F.concat(ip, F.lit(" ["), time, F.lit(' +0530] "?ets='), "event_type", F.lit(":"), F.floor("value").cast("string"), F.lit(',css:7" '), status, F.lit(' "http://x/'), F.col("user_id").cast("string"), F.lit('" "Agent/'), F.col("event_type"), F.lit(' 1.0" "x"'))
    return flows.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 97 == 96, F.substring(line, 1, 30)).otherwise(line).alias("value"))


_LINE = "ev AS (SELECT *, event_id % 97 = 96 AS bad FROM events)"


@query(f"""WITH {_LINE} SELECT '10.' || (user_id % 7) || '.' || (user_id // 250) || '.' || (user_id % 250) AS ip, 10 * 16777216 + (user_id % 7) * 65536 + (user_id // 250) * 256 + user_id % 250 AS ip_number,
CAST(floor(epoch(ts)) AS BIGINT) - 19800 AS epoch, event_type || ':' || CAST(floor(value) AS BIGINT) || '|css:7' AS episodes, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, 'http://x/' || user_id AS url, 'Agent/' || event_type || ' 1.0' AS ua, 'x' AS "domain"
FROM ev WHERE NOT bad""")
def parse_log(spark, sf):
    p = parse.parse(_log(spark, sf)).where("_corrupt is null")
    e = F.array_join(F.transform("episodes", lambda x: F.concat(x["name"], F.lit(":"), x["duration"].cast("string"))), "|")
    return p.select("ip", "ip_number", F.unix_timestamp("time").alias("epoch"), e.alias("episodes"), "status", "url", "ua", "domain")


@query(f"WITH {_LINE} SELECT count(*) FILTER (bad) AS corrupt, count(*) FILTER (NOT bad) AS good FROM ev")
def parse_corrupt(spark, sf):
    return parse.parse(_log(spark, sf)).agg(F.count("_corrupt").alias("corrupt"), F.count("ip").alias("good"))


_GEO = [(0x0A000000 + 65536 * i, 0x0A000000 + 65536 * i + 65535 if i != 3 else 0x0A000000 + 65536 * i + 99, c, f"C{i}", f"R{i}", f"T{i}", f"I{i}") for i, c in enumerate(("EU", "NA", "AS", "AF", "SA"))]
_UA = [("Agent/*", "any", "Agent", "1.0", 1, 0, False), ("Agent/c*", "desktop", "Agent", "1.0", 1, 0, False), ("Agent/click*", "phone", "Agent", "1.0", 1, 0, True), ("Other*", "x", "x", "1", 1, 1, False)]


def _views(spark, sf):
    v = parse.parse(_log(spark, sf)).where("_corrupt is null")
    v = enrich.with_location(v, spark.createDataFrame(_GEO, files.GEO_SCHEMA))
    return enrich.with_agent(v, spark.createDataFrame(_UA, files.UA_SCHEMA))


@query(f"""WITH {_LINE}, g(i, continent) AS (VALUES (0, 'EU'), (1, 'NA'), (2, 'AS'), (3, 'AF'), (4, 'SA'))
SELECT coalesce(continent, '-') AS continent, CASE WHEN event_type = 'click' THEN 'phone' ELSE 'any' END AS platform, count(*) AS views
FROM ev LEFT JOIN g ON i = user_id % 7 AND (i != 3 OR (user_id // 250) * 256 + user_id % 250 <= 99) WHERE NOT bad GROUP BY ALL""")
def enrich_views(spark, sf):
    return _views(spark, sf).groupBy(F.coalesce("location.continent", F.lit("-")).alias("continent"), F.col("agent.platform").alias("platform")).agg(F.count("*").alias("views"))


@query(f"""WITH {_LINE}, g(i, continent) AS (VALUES (0, 'EU'), (1, 'NA'), (2, 'AS'), (3, 'AF'), (4, 'SA')), v AS (
  SELECT *, CASE WHEN event_type = 'click' THEN 'phone' ELSE 'any' END AS pl FROM ev LEFT JOIN g ON i = user_id % 7 AND (i != 3 OR (user_id // 250) * 256 + user_id % 250 <= 99) WHERE NOT bad),
  e AS (SELECT *, event_type AS n, CASE WHEN floor(value) <= 20 THEN 'fast' WHEN floor(value) <= 70 THEN 'acceptable' ELSE 'slow' END AS s FROM v UNION ALL SELECT *, 'css', 'fast' FROM v),
  x AS (SELECT unnest(list_distinct(list_filter(['episode:' || n, 'duration:' || s, 'url:http://x/' || user_id, 'ua:' || pl, 'ua:' || pl || ':Agent', 'ua:' || pl || ':Agent:1', 'ua:' || pl || ':Agent:1:0', CASE WHEN pl = 'phone' THEN 'ua:isMobile' END,
    CASE WHEN event_type = 'error' THEN 'status:500' END, 'location:' || continent, 'location:' || continent || ':C' || i, 'location:' || continent || ':C' || i || ':R' || i, 'isp:C' || i || ':I' || i], lambda z: z IS NOT NULL))) AS item FROM e)
SELECT item, count(*) AS support FROM x GROUP BY item""")
def log_to_items(spark, sf):
    """Lines to parsed, enriched, discretised transactions, counted by item."""
    each = T.explode_views(_views(spark, sf), T.shared_items())
    speed = F.when(F.col("name") == "css", "fast").otherwise(I.speed(F.col("duration"), flows.VALUE_BOUNDS, "slow"))
    return itemsets.item_support(each.select(F.concat(T.episode_items(F.col("name"), speed), "shared").alias("items")))


@query(_SQL["enrich_views"])
def enrich_files(spark, sf):
    """The same from files: lines of text, address ranges and agents as CSV."""
    top = stream.folder(spark)
    _log(spark, sf).select("value").write.text(f"{top}/log")
    spark.createDataFrame(_GEO, files.GEO_SCHEMA).write.csv(f"{top}/geo", header=True)
    spark.createDataFrame(_UA, files.UA_SCHEMA).write.csv(f"{top}/agents", header=True)
    v = parse.parse(files.read_log(spark, f"{top}/log")).where("_corrupt is null")
    v = enrich.with_agent(enrich.with_location(v, files.read_geo(spark, f"{top}/geo")), files.read_ua(spark, f"{top}/agents"))
    files.write_result(v.groupBy(F.coalesce("location.continent", F.lit("-")).alias("continent"), F.col("agent.platform").alias("platform")).agg(F.count("*").alias("views")), f"{top}/views")
    return spark.read.parquet(f"{top}/views")


# -- streams ------------------------------------------------------------------------------------------


@query(f"WITH {_EVENTS} SELECT CAST(floor(epoch(ts) / 900) AS BIGINT) AS quarter, count(*) AS n_events FROM txl GROUP BY ALL")
def stream_batches(spark, sf):
    return stream.collected(stream.quarter_counts(stream.event_stream(spark, sf, None)), spark, "append")


@query(f"""WITH {_EVENTS}, q AS (SELECT *, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS tick FROM txl), {_subsets(3, 'tick', 'q')}
SELECT tick, items, support FROM sets WHERE support >= 3""")
def stream_patterns(spark, sf):
    store = stream.PatternStore(spark, max_len=3)
    store.run(stream.event_stream(spark, sf), lambda batch: flows.events_of(batch, spark, sf))
    return shown(store.patterns(min_count=3))


_LATE = """ev AS (SELECT event_id, ts, CAST(floor(epoch(ts) / 900) AS BIGINT) AS quarter, event_id % 20 = 7 AS held, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
  seen AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM ev, (SELECT min(t) AS low, max(t) AS high FROM ev) WHERE NOT held AND floor(3 * (t - low) / (high - low + 1)) < 2)"""


@query(f"WITH {_LATE} SELECT quarter, count(*) AS n_events FROM ev, seen WHERE NOT held OR (quarter + 1) * 900 > epoch(mark) GROUP BY quarter")
def stream_late(spark, sf):
    """Four micro-batches, the last of rows held back: those behind the watermark of a day are dropped.

    Spark judges lateness by the watermark that the batch before last has left.
    """
    top = stream.folder(spark)
    e = flows.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts")
    held = F.col("event_id") % 20 == 7
    low, high = e.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts"))).first()
    third = F.floor(3 * (F.unix_timestamp("ts") - (low or 0)) / ((high or 0) - (low or 0) + 1))
    for k, part in enumerate([*(e.where(~held & (third == t)) for t in (0, 1, 2)), e.where(held)]):
        part.coalesce(1).write.mode("append").parquet(f"{top}/events/part={k}")
    rows = spark.readStream.schema("event_id long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{top}/events")
    return stream.collected(stream.quarter_counts(rows, "1 day"), spark, "append")


#: Batches of transactions, one letter an item, and what is stored after the fifth.
_GOLDEN = ["ABCD AB AC ABC AD ACD CB BC CD CE", "A A C" + 20 * " CAD", 20 * "AB ", 20 * "AD ", "E"]
_STORED = "A 4 68, A|B 4 23, A|D 4 43, B 4 25, C 4 29, A|C 4 24, A|C|D 4 22, B|C 4 4, C|D 4 23, D 4 44, E 0 1".split(", ")


@query("SELECT * FROM (VALUES " + ", ".join("('{}', {}, CAST({} AS BIGINT))".format(*x.split()) for x in _STORED) + ") t(items, bucket, support)")
def stream_pruned(spark, sf):
    """The pattern stream with pruning over its golden sequence."""
    store = PrunedPatterns(spark, 0.4, 0.05)
    for rows in _GOLDEN:
        store.add(spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows.split())], "event_id long, items array<string>"))
    return shown(store.windows())
