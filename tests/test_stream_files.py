"""The event stream over a table of several part files."""

import shutil

from tidemark.plans import flows, registry
from tidemark.streaming.batches import PatternStore, event_stream


def test_table_of_part_files(spark, sf, tmp_path):
    for t in ("customer", "nation", "region"):
        shutil.copy(f"{sf}/{t}.parquet", tmp_path)
    # dealt at random, so that each file spans all times
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_batches", "stream_patterns"):
        whole, parts = (sorted(map(tuple, registry.queries()[name](spark, str(d)).collect())) for d in (sf, tmp_path))
        assert whole and parts == whole


def test_pattern_store_compacts(spark, tmp_path):
    store = PatternStore(spark, max_len=2, path=tmp_path.as_uri() + "/store")
    tx = lambda day, *rows: spark.createDataFrame([(list(r), day * 86400) for r in rows], "items array<string>, s long").selectExpr("items", "timestamp_seconds(s) as ts")
    read = lambda: {(r.tick, "".join(r["items"])): r.support for r in store.patterns().collect()}
    assert read() == {}
    store.add(tx(1, "ab", "a"), 0)
    store.add(tx(2, "ab"), 1)
    store.add(tx(1, "ab"), 2)
    before = read()
    assert before[1, "ab"] == 2 and before[1, "a"] == 3 and before[2, "b"] == 1
    store.compact()
    store.compact()
    assert read() == before
    store.add(tx(3, "b"), 3)
    store.add(tx(3, "b"), 3)  # a repeated micro-batch replaces itself
    assert read() == before | {(3, "b"): 1}
    store.compact(keep_ticks=2)
    assert {t for t, _ in read()} == {2, 3} and read()[3, "b"] == 1


def test_throughput_of_a_stream(spark, sf):
    store = PatternStore(spark, max_len=1)
    told = store.run(event_stream(spark, sf), lambda batch: flows.events_of(batch, spark, sf))
    assert sum(b["rows"] for b in told) == spark.read.parquet(f"{sf}/events.parquet").count() and all(b["ms"] > 0 and b["rows_per_second"] > 0 for b in told)
