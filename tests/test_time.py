"""Tilted windows, ranges, tail pruning and comparison."""

import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import tilted
from tidemark.operators import compare, patterns
from tidemark.operators import transactions as T

SERIES = [45, 67, 88, 93, 34, 49, 36, 97, *[50] * 4, *[25] * 84, 10, 10, 10, 10, 20, 20, 20, 20, 30]


def simulate(values):
    """The window by its rules: a full granularity is summed and passed on before the next entry."""
    caps = [c for c, _ in config.LEVELS] + [1]
    held = [[] for _ in caps]

    def store(g, v):
        if len(held[g]) == caps[g]:
            total = sum(held[g])
            held[g].clear()
            if g + 1 < len(caps):
                store(g + 1, total)
        held[g].insert(0, v)

    for v in values:
        store(0, v)
    starts = [s for _, s in config.LEVELS] + [config.YEAR_BUCKET]
    return {starts[g] + i: v for g, h in enumerate(held) for i, v in enumerate(h)}


def window(spark, values):
    rows = spark.createDataFrame([(["x"], i, v) for i, v in enumerate(values)], "items array<string>, batch_id long, support long")
    return {r.bucket: r.support for r in patterns.windows(rows, len(values)).collect()}


@pytest.mark.parametrize("n", [1, 4, 5, 8, 12, 96, 97, 101, 105])
def test_golden_series(spark, n):
    assert window(spark, SERIES[:n]) == simulate(SERIES[:n])


def test_golden_buckets(spark):
    w = window(spark, SERIES[:101])
    assert (w[0], w[4], w[28]) == (20, 40, 2809)
    assert window(spark, SERIES[:97])[0] == 10


def test_long_series(spark):
    n = 38_800
    rows = spark.range(n).select(F.array(F.lit("x")).alias("items"), F.col("id").alias("batch_id"), (F.col("id") % 7).alias("support"))
    assert {r.bucket: r.support for r in patterns.windows(rows, n).collect()} == simulate([i % 7 for i in range(n)])


def test_aged_out(spark):
    n = 80_000
    rows = spark.range(n).select(F.array(F.lit("x")).alias("items"), F.col("id").alias("batch_id"), F.lit(1).cast("long").alias("support"))
    kept = patterns.with_bucket(rows, n)
    assert kept.count() < n and kept.agg(F.max("bucket")).first()[0] == config.YEAR_BUCKET
    again = patterns.compacted(rows, n)
    assert again.agg(F.sum("support")).first()[0] == kept.count()


def test_window_array(spark):
    df = spark.createDataFrame([({0: 5, 2: 7},)], "m map<int,long>")
    assert df.select(tilted.window_array(F.col("m"), 4).alias("a")).first().a == [5, None, 7, None]


def test_distances(spark):
    assert [tilted.quarter_distance(b, i) for b, i in ((0, False), (0, True), (4, False), (28, False), (71, True))] == [0, 1, 4, 100, 100 + 31 * 96 + 12 * 2976 + 35712]
    with pytest.raises(ValueError):
        tilted.quarter_distance(72, False)
    a, b = tilted.interval(4, 4, F.lit(0), F.lit(10_000))
    assert spark.range(1).select(a.alias("a"), b.alias("b")).first() == (10_800 - 8 * 900, 10_800 - 4 * 900)


def test_margins(tmp_path):
    assert config.support_from_margin(0.05, 20) == pytest.approx(0.04)
    assert config.margin_from_support(0.05, 0.04) == pytest.approx(20)
    s = config.Settings(min_support=0.1)
    s.save(str(tmp_path / "s.json"))
    assert config.Settings.load(str(tmp_path / "s.json")) == s
    assert config.Settings.load(str(tmp_path / "none")) == config.Settings()


def test_clocks(spark):
    df = spark.createDataFrame([(0, 0), (1, 900), (2, 901), (3, 3 * 900), (4, None)], "event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    by = lambda clock: {r.event_id: r.batch_id for r in T.with_batches(df, T.quarter(F.col("ts")), clock).collect()}
    assert by("ordinal") == {0: 0, 1: 1, 2: 1, 3: 2, 4: None}
    assert by("wall") == {0: 0, 1: 1, 2: 1, 3: 3, 4: None}
    with pytest.raises(ValueError):
        by("sun")


@pytest.mark.parametrize(("events", "drop"), [(2, None), (3, None), (20, None), (21, 1)])
def test_droppable_tail(spark, events, drop):
    """One old hour bucket with a single occurrence; five batches make quarter 0 and hour 4."""
    p = spark.createDataFrame([(["x"], 3, 1), (["x"], 4, 0)], "items array<string>, batch_id long, support long")
    sizes = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, events, events), (4, 0, 0)], "batch_id long, n_tx long, n_events long")
    found = patterns.droppable_tail(p, sizes, 5, 0.4, 0.05).collect()
    assert [r.drop_from for r in found] == ([] if drop is None else [drop])
    if drop:
        left = patterns.drop_tail(patterns.windows(p, 5), patterns.droppable_tail(p, sizes, 5, 0.4, 0.05))
        assert {r.bucket for r in left.collect()} == {0}


def stream(spark):
    """The batches of the golden pattern stream, one event each."""
    ten = ["ABCD", "AB", "AC", "ABC", "AD", "ACD", "CB", "BC", "CD", "CE"]
    rows = [ten, ["A", "A", "C", *["CAD"] * 20], ["AB"] * 20, ["AD"] * 20, ["E"]]
    each = [(b, i, list(x)) for b, part in enumerate(rows) for i, x in enumerate(part)]
    return spark.createDataFrame([(n, *x) for n, x in enumerate(each)], "event_id long, batch_id long, tx_id long, items array<string>")


def test_range_sums(spark):
    tx = stream(spark)
    sizes = T.batch_sizes(tx)
    assert patterns.range_events(sizes, 5, 4, 4).first().events == 73
    p = patterns.batch_patterns(tx, 0.0, 4, sizes)
    own = {("".join(r["items"]), r.bucket): r.support for r in patterns.windows(p, 5).collect()}
    golden = {"A": 68, "AB": 23, "AD": 43, "B": 25, "C": 29, "AC": 24, "ACD": 22, "BC": 4, "CD": 23, "D": 44}
    assert {k: own[k, 4] for k in golden} == golden
    assert own["E", 0] == 1
    strict = {"".join(r["items"]): r.support for r in patterns.range_itemsets(p, sizes, 5, 0, 71, 0.4).collect()}
    assert strict == {"A": 68, "AD": 43, "D": 44}  # more than ceil(0.4 * 74) = 30


def test_confidence_has_unconstrained_antecedents(spark):
    rows = [(i, 0, ["duration:slow", "episode:a"]) for i in range(10)] + [(10 + i, 1, ["duration:slow", "episode:a"]) for i in range(2)] + [(12, 1, ["duration:fast", "episode:a"])]
    tx = spark.createDataFrame(rows, "event_id long, batch_id long, items array<string>")
    from tidemark.operators.constraints import DEFAULT_CONSEQUENT, DEFAULT_ITEMSETS

    sizes = T.batch_sizes(tx)
    p = patterns.batch_patterns(tx, 0.04, 2, sizes)
    found = patterns.range_rules(p, sizes, 2, 0, 71, 0.05, 0.2, DEFAULT_ITEMSETS, DEFAULT_CONSEQUENT).collect()
    assert [(r.antecedent, r.support, r.confidence, r.events) for r in found] == [(["episode:a"], 12, 12 / 13, 13)]


def test_compare(spark):
    schema = "antecedent array<string>, consequent array<string>, support long, confidence double, events long"
    old = spark.createDataFrame([(["a"], ["s"], 10, 0.5, 100), (["b"], ["s"], 5, 0.3, 100)], schema)
    new = spark.createDataFrame([(["a"], ["s"], 10, 0.75, 50), (["c"], ["s"], 7, 0.9, 50)], schema)
    found = {r.antecedent[0]: (r.state, r.support, r.confidence_variance, r.support_variance, r.events) for r in compare.compare_rules(old, new).collect()}
    assert found == {"a": ("both", 10, 0.25, 0.1, 50), "b": ("older", 5, -1.0, -1.0, 100), "c": ("newer", 7, 1.0, 1.0, 50)}
    sizes = spark.createDataFrame([(i, 1, 10) for i in range(5)], "batch_id long, n_tx long, n_events long")
    assert tuple(compare.combined_events(sizes, 5, (0, 4), (0, 0)).first()) == (50, 10, 50)
