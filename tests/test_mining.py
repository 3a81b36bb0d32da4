"""Itemsets, constraints and rules against golden values and brute force."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import itemsets, report, rules
from tidemark.operators.constraints import Constraints, count_known

TEN = ["ABCD", "AB", "AC", "ABC", "AD", "ACD", "CB", "BC", "CD", "CE"]


def tx(spark, rows):
    return spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "tx_id long, items array<string>")


def got(df):
    return {"".join(r["items"]): r.support for r in df.collect()}


def brute(rows, least, most=9):
    out = {}
    for r in rows:
        for k in range(1, most + 1):
            for s in combinations(sorted(set(r)), k):
                out["".join(s)] = out.get("".join(s), 0) + 1
    return {s: n for s, n in out.items() if n >= least}


@pytest.mark.parametrize("backend", ["subsets", "fpgrowth"])
def test_golden(spark, backend):
    t = tx(spark, TEN)
    assert got(itemsets.frequent_itemsets(t, 4, 4, backend=backend)) == {"A": 6, "B": 5, "C": 8, "D": 4, "AC": 4, "BC": 4}
    assert got(itemsets.frequent_itemsets(t, 0, 4, backend=backend)) == brute(TEN, 1)
    assert len(brute(TEN, 1)) == 17
    only = Constraints(positive_any=("A",))
    assert got(itemsets.frequent_itemsets(t, 4, 4, only, backend)) == {"A": 6, "AC": 4}


def test_repeated_items_count_once(spark):
    assert got(itemsets.frequent_itemsets(tx(spark, ["AAB", "BA", "A", ""]), 1, 3)) == {"A": 3, "B": 2, "AB": 2}
    assert {r["item"]: r.support for r in itemsets.item_support(tx(spark, ["AB", "BC", "ABC", "AD"])).collect()} == {"A": 3, "B": 3, "C": 2, "D": 1}


def test_support_of_given_itemsets(spark):
    assert got(itemsets.itemset_support(tx(spark, TEN), [["C", "A"], ["E", "A"], [], ["A", "B", "C", "D"]])) == {"AC": 4, "AE": 0, "": 10, "ABCD": 1}
    assert got(itemsets.itemset_support(tx(spark, TEN).limit(0), [["A"]])) == {"A": 0}


def test_empty_table(spark):
    empty = tx(spark, TEN).limit(0)
    assert got(itemsets.frequent_itemsets(empty, 1, 3)) == {}
    assert got(itemsets.frequent_itemsets(empty, 1, 3, backend="fpgrowth")) == {}


def test_rules(spark):
    every = itemsets.frequent_itemsets(tx(spark, TEN), 4, 4)
    found = rules.rules(every, every, 0.8).collect()
    assert [(r.antecedent, r.consequent, r.support, r.confidence) for r in found] == [(["B"], ["C"], 4, 0.8)]


def test_rules_with_long_consequents(spark):
    every = itemsets.frequent_itemsets(tx(spark, TEN), 1, 4)
    found = {("".join(r.antecedent), "".join(r.consequent)): (r.support, r.confidence) for r in rules.rules(every, every, 0.4, max_consequent=3).collect()}
    s = brute(TEN, 1)
    want = {}
    for items, n in s.items():
        for k in range(1, len(items)):
            for c in combinations(items, k):
                a = "".join(x for x in items if x not in c)
                if n / s[a] >= 0.4:
                    want[a, "".join(c)] = (n, n / s[a])
    assert found == want
    some = rules.rules(every, every, 0.0, Constraints(positive_any=("D",)), 3).collect()
    assert some and all(r.consequent == ["D"] for r in some)


CASES = [
    (Constraints(positive_all=("A", "C")), lambda s: {"A", "C"} <= s),
    (Constraints(positive_any=("B", "D")), lambda s: bool(s & {"B", "D"})),
    (Constraints(negative_all=("A", "E")), lambda s: not s & {"A", "E"}),
    (Constraints(negative_any=("A", "C")), lambda s: not {"A", "C"} <= s),
    (Constraints(positive_any=("[AB]*", "C*")), lambda s: bool(s & {"A", "B"}) and "C" in s),
    (Constraints(positive_all=("[AB]*",)), lambda s: {"A", "B"} <= s),
    (Constraints(negative_any=("[AB]*",)), lambda s: not {"A", "B"} <= s),
    (Constraints(negative_all=("?*",)), lambda s: False),
    (Constraints(positive_any=("Z*",)), lambda s: False),
    (Constraints(positive_any=("Z*",), vacuous=True), lambda s: True),
    (Constraints(positive_all=("Z*",), negative_any=("Z*",), negative_all=("Z*",)), lambda s: True),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_constraints(spark, case):
    constraints, test = CASES[case]
    found = got(itemsets.frequent_itemsets(tx(spark, TEN), 1, 4, constraints))
    assert found == {s: n for s, n in brute(TEN, 1).items() if test(set(s))}


def test_constraints_need_known_counts(spark):
    c = Constraints().add("positive_all", "x:*")
    with pytest.raises(ValueError):
        c.predicate(F.col("items"), {})
    with pytest.raises(ValueError):
        c.add("sometimes", "x")
    t = spark.createDataFrame([(0, ["x:1", "x:2"]), (1, ["y"])], "tx_id long, items array<string>")
    assert count_known(t, c.patterns()) == {"x:*": 2}
    assert c.merged(Constraints(positive_all=("y",))).positive_all == ("x:*", "y")


def test_hierarchy(spark):
    items = spark.createDataFrame([("ua:X:Y",), ("ua:X:Z:1",), ("duration:slow",), ("url:http://a",), ("b::c",), ("",)], "item string")
    tree = report.sorted_hierarchy(report.hierarchy(items))
    assert [(r.path, r.parent, r.label, r.depth) for r in tree.collect()] == [("b", None, "b", 1), ("b:c", "b", "c", 2), ("ua", None, "ua", 1), ("ua:X", "ua", "X", 2), ("ua:X:Y", "ua:X", "Y", 3), ("ua:X:Z", "ua:X", "Z", 3), ("ua:X:Z:1", "ua:X:Z", "1", 4)]
    assert {r.path for r in report.complete(tree, "episode:a, ua:x").collect()} == {"ua:X"}


def test_reports(spark):
    r = spark.createDataFrame([(["duration:x", "episode:Css:a", "k:1"], ["duration:slow"], 4, 0.5, 8), (["episode:js"], ["duration:slow"], 2, 0.25, 8)], "antecedent array<string>, consequent array<string>, support long, confidence double, events long")
    rep = report.cause_report(r)
    assert [tuple(x) for x in report.sort_causes(rep, "episode").collect()] == [("Css:a", "duration:x, k:1", 50.0, 4, 0.5), ("js", "", 25.0, 2, 0.25)]
    assert [x.episode for x in report.filter_causes(rep, "episode:zzz, episode:CS, K:?*").collect()] == ["Css:a"]
    assert report.filter_causes(rep, "").count() == 2


def test_many_frequent_items_and_any_length(spark, monkeypatch):
    from tidemark.operators import itemsets as M

    tx = spark.createDataFrame([(list(r),) for r in ["abcde", "abcde", "abcd", "xy", "x", "", "abz"]], "items array<string>")
    want = {tuple(r["items"]): r.support for r in M.frequent_itemsets(tx, 2, 5).collect()}
    assert want[tuple("abcde")] == 2 and want[tuple("ab")] == 4 and ("z",) not in want
    assert {tuple(r["items"]): r.support for r in M.frequent_itemsets(tx, 2).collect()} == want
    monkeypatch.setattr(M, "LITERAL", 2)
    assert {tuple(r["items"]): r.support for r in M.frequent_itemsets(tx, 2, 5).collect()} == want
    only = M.frequent_itemsets(tx, 2, 5, Constraints(positive_all=("a",), positive_any=("d", "e")))
    assert {tuple(r["items"]): r.support for r in only.collect()} == {k: v for k, v in want.items() if "a" in k and set("de") & set(k)}
