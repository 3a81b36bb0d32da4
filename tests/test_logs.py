"""Log parsing, dimensions, transactions and streams."""

import duckdb
from pyspark.sql import functions as F

from tidemark.functions import items as I
from tidemark.operators import enrich, parse
from tidemark.operators import transactions as T
from tidemark.plans import flows, registry
from tidemark.sources import files
from tidemark.streaming import batches as stream

LINES = [
    '218.56.155.59 [Sunday, 14-Nov-2010 06:27:03 +0100] "?ets=css:203,headerjs:94,frontend:1547" 200 "http://x.net/a" "Agent/4.0 (x; y)" "x.net"',
    '1.2.3.4 [Sunday, 14-Nov-2010 06:27:03 +0530] "?ets=css:0,odd,bad:x" 404 "http://x.net/" "Other" "x.net"',
    "not a log line",
    "",
    '300.2.x.4 [Sunday, 14-Nov-2010 06:27:03 +0100] "?ets=a:1" 200 "u" "a" "d"',
    '1.2.3.4 [Sunday, 99-Nov-2010 06:27:03 +0100] "?ets=a:1" 200 "u" "a" "d"',
]


def parsed(spark):
    return parse.parse(spark.createDataFrame([(x,) for x in [*LINES, None]], "value string"))


def test_parse(spark):
    rows = parsed(spark).withColumn("epoch", F.unix_timestamp("time")).collect()
    a, b = rows[:2]
    assert (a.ip_number, a.epoch, a.status, a.url, a.domain) == (3661142843, 1289712423, 200, "http://x.net/a", "x.net")
    assert [tuple(e) for e in a.episodes] == [("css", 203), ("headerjs", 94), ("frontend", 1547)]
    assert b.epoch == 1289712423 + 3600 - 19800 and [tuple(e) for e in b.episodes] == [("css", 0)]
    assert [r._corrupt for r in rows[2:]] == [*LINES[2:], None] and all(r.ip is None for r in rows[2:])


def test_read_files(spark, tmp_path):
    (tmp_path / "log.txt").write_text("\n".join(LINES[:2]))
    assert files.read_log(spark, str(tmp_path / "log.txt")).count() == 2
    (tmp_path / "speeds.csv").write_text("css,fast,100,acceptable,500,slow\ntabs , fast, 10, slow\n\nodd\n")
    speeds = files.read_speeds(spark, str(tmp_path / "speeds.csv"))
    e = spark.createDataFrame([("css", d) for d in (0, 100, 101, 500, 501)] + [("tabs", 11), ("unknown", 5)], "name string, duration int")
    assert [r.speed for r in enrich.with_speed(e, speeds).orderBy("name", "duration").collect()] == ["fast", "fast", "acceptable", "acceptable", "slow", "slow", None]


GEO = [(0x01020300, 0x010203FF, "EU", "BE", "BRU", "Brussels", "P1"), (0x01020400, 0x0104FFFF, "NA", "US", "TX", "Austin", "P2")]
UA = [("Agent/*", "win", "Agent", "4.0", 4, 0, False), ("Agent/4*(x*", "phone", "Agent", "4.0", 4, 0, True)]


def test_enrich_and_explode(spark):
    v = parsed(spark).where("_corrupt is null and ip is not null")
    v = enrich.with_agent(enrich.with_location(v, spark.createDataFrame(GEO, files.GEO_SCHEMA)), spark.createDataFrame(UA, files.UA_SCHEMA))
    rows = {r.ip: r for r in v.collect()}
    assert rows["1.2.3.4"].location.city == "Brussels" and rows["218.56.155.59"].location is None
    assert rows["218.56.155.59"].agent.is_mobile and rows["1.2.3.4"].agent is None
    tx = T.explode_views(v, T.shared_items())
    items = {(r.ip, r["name"]): r.shared for r in tx.collect()}
    assert items["1.2.3.4", "css"] == ["url:http://x.net/", "location:EU", "location:EU:BE", "location:EU:BE:BRU", "isp:BE:P1", "status:404"]
    assert items["218.56.155.59", "css"] == ["url:http://x.net/a", "ua:phone", "ua:phone:Agent", "ua:phone:Agent:4", "ua:phone:Agent:4:0", "ua:isMobile"]
    assert len(items) == 4


def test_address_parts_above_255(spark):
    """They stay in their network instead of running over into another one."""
    line = '{} [Sunday, 14-Nov-2010 06:27:03 +0100] "?ets=a:1" 200 "u" "Agent/4" "d"'
    v = parse.parse(spark.createDataFrame([(line.format(ip),) for ip in ("1.2.259.4", "1.2.3.300", "1.2.4.4", "1.1.515.7")], "value string"))
    rows = {r.ip: r for r in enrich.with_location(v, spark.createDataFrame(GEO, files.GEO_SCHEMA)).collect()}
    assert {ip: r.location and r.location.city for ip, r in rows.items()} == {"1.2.259.4": "Austin", "1.2.3.300": "Brussels", "1.2.4.4": "Austin", "1.1.515.7": None}
    assert rows["1.1.515.7"].ip_number == 0x01030307


def equals_sql_of_many_users(spark, sf, folder, name):
    """The query against its SQL where the numbers of users give parts of an address above 255."""
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_id < 500").withColumn("k", F.explode(F.array(*[F.lit(k) for k in (0, 63_500, 88_500, 884_999)])))
    e.withColumn("event_id", F.col("event_id") + F.col("k") * 500).withColumn("user_id", F.col("user_id") + F.col("k")).drop("k").coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"SET timezone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = registry.queries()[name](spark, str(folder)).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, found.fetchall()), key=str)


def test_enrich_views_of_many_users(spark, sf, tmp_path):
    equals_sql_of_many_users(spark, sf, tmp_path, "enrich_views")


def test_enrich_files_of_many_users(spark, sf, tmp_path):
    equals_sql_of_many_users(spark, sf, tmp_path, "enrich_files")


def test_log_to_items_of_many_users(spark, sf, tmp_path):
    equals_sql_of_many_users(spark, sf, tmp_path, "log_to_items")


def test_globs():
    assert I.glob_regex("a*b?[xy]") == "a.*b.[xy]" and I.glob_regex("[!a]+") == "[^a]\\+"


def test_ratio_and_statistics(spark, sf):
    tx = flows.orders(spark, sf)
    r = T.transactions_per_event(tx).first()
    assert r.ratio == r.n_tx / r.n_events > 1
    s = T.statistics(tx, 10).first()
    assert s.transactions == r.n_tx and s.frequent_items <= s.unique_items


def test_stream_equals_batch(spark, sf):
    events = flows.events(spark, sf)
    want = {(r.q, r.n) for r in events.groupBy(T.quarter(F.col("ts")).alias("q")).agg(F.count("*").alias("n")).collect()}
    got = stream.collected(stream.quarter_counts(stream.event_stream(spark, sf)), spark, "append")
    assert {(r.quarter, r.n_events) for r in got.collect()} == want


def test_pattern_store_replaces_repeated_batches(spark):
    rows = [("2024-01-01 00:00:00", ["a", "b"]), ("2024-01-01 05:00:00", ["a"]), ("2024-01-02 00:00:00", ["b"])]
    tx = spark.createDataFrame(rows, "t string, items array<string>").withColumn("ts", F.col("t").cast("timestamp"))
    store = stream.PatternStore(spark, max_len=2)
    store.add(tx, 0)
    store.add(tx, 0)
    store.add(tx.limit(1), 1)
    got = {(r.tick - 19723, "".join(r["items"])): r.support for r in store.patterns().collect()}
    assert got == {(0, "a"): 3, (0, "b"): 2, (0, "ab"): 2, (1, "b"): 1}
