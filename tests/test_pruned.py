"""The pattern stream with pruning, against its golden sequence."""

from tidemark.streaming.pruned import PrunedPatterns

TEN = ["ABCD", "AB", "AC", "ABC", "AD", "ACD", "CB", "BC", "CD", "CE"]
BATCHES = [TEN, ["A", "A", "C", *["CAD"] * 20], ["AB"] * 20, ["AD"] * 20, ["E"], ["E"], ["F"]]
SIZES = [17, 17, 17, 17, 11]


def test_golden_stream(spark):
    store = PrunedPatterns(spark, 0.4, 0.05)
    for k, rows in enumerate(BATCHES):
        store.add(spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "event_id long, items array<string>"))
        if k < len(SIZES):
            assert store.size() == SIZES[k]
        if k == 4:
            own = {("".join(r["items"]), r.bucket): r.support for r in store.windows().collect()}
            assert own == {("A", 4): 68, ("AB", 4): 23, ("AD", 4): 43, ("B", 4): 25, ("C", 4): 29, ("AC", 4): 24, ("ACD", 4): 22, ("BC", 4): 4, ("CD", 4): 23, ("D", 4): 44, ("E", 0): 1}
    own = {("".join(r["items"]), r.bucket): r.support for r in store.windows().collect()}
    assert own["F", 0] == 1 and own["E", 1] == 1 and own["E", 2] == 1 and own["A", 4] == 68


def test_store_goes_on_after_a_restart(spark, tmp_path):
    rows = lambda x: spark.createDataFrame([(i, list(r)) for i, r in enumerate(x)], "event_id long, items array<string>")
    path = tmp_path.as_uri() + "/store"
    for k, batch in enumerate(["AB AC AB", "AB B", "AC C"]):
        store = PrunedPatterns(spark, 0.4, 0.05, max_len=2, path=path)
        assert len(store.sizes) == k
        store.add(rows(batch.split()))
    whole = PrunedPatterns(spark, 0.4, 0.05, max_len=2)
    for batch in ["AB AC AB", "AB B", "AC C"]:
        whole.add(rows(batch.split()))
    key = lambda s: sorted((tuple(r["items"]), r.bucket, r.support) for r in s.windows().collect())
    assert key(store) == key(whole) and store.sizes == whole.sizes


def test_supersets_of_new_itemsets_wait(spark):
    store = PrunedPatterns(spark, 0.4, 0.0, max_len=3)
    add = lambda *rows: store.add(spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "event_id long, items array<string>"))
    add("z", "z")
    seen = []
    for _ in range(3):
        add("abc", "abc")
        seen.append({"".join(r["items"]) for r in store.table.select("items").distinct().collect()} - {"z"})
    assert seen[0] == {"a", "b", "c"} and len(seen[1]) == 6 and "abc" in seen[2]
