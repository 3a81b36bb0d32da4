"""Operators over the whole corpus, against brute force on small fixtures."""

import hashlib
import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_text import ODD, SCHEMA, grams, path, plain_contamination
from tidemark.llm import components, jaccard, packing, pii, ppm, quality, queries, substring
from tidemark.llm import textcore as X


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 1) for i, t in rows], SCHEMA)


def corpus(n=60, seed=0, vocabulary=400):
    """Documents with copies, near copies, shared passages and ties."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "X,", "y."]
    text = lambda k: list(rng.choice(words, k))
    passage, docs = text(70), []
    for i in range(n):
        kind = i % 6
        if kind == 1 and docs:
            base = list(docs[int(rng.integers(len(docs)))])
        elif kind == 2 and docs:
            base = list(docs[int(rng.integers(len(docs)))])
            for _ in range(int(rng.integers(1, 4))):
                if base:
                    base[int(rng.integers(len(base)))] = "edited"
        elif kind == 3:
            base = text(int(rng.integers(0, 30))) + passage + text(int(rng.integers(0, 90)))
        elif kind == 4:
            base = text(int(rng.integers(0, 7)))
        else:
            base = text(int(rng.integers(40, 200)))
        docs.append(base)
    order = rng.permutation(n)
    return [(int(order[i]) * 3, " ".join(d) if i % 7 else "\n".join(d) + "\t") for i, d in enumerate(docs)]


def plain_dedup(rows, window):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first.get(tuple(w[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "seed", "vocabulary"), [(50, 10, 400), (50, 1, 400), (12, 4, 6), (3, 3, 4), (1, 1, 5)])
def test_substring_dedup(spark, window, seed, vocabulary):
    rows = [*corpus(60, 1, vocabulary), (None, "no id " * 60), (500, "no id " * 60), (501, "no id " * 60), (501, "no id " * 60), (501, "other text")]
    got = substring.deduplicate(frame(spark, rows), window, seed).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_dedup(rows, window)


def test_substring_dedup_odd(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    assert sorted((tuple(r) for r in substring.deduplicate(odd).collect()), key=str) == plain_dedup([r[:2] for r in ODD], 50)
    assert substring.deduplicate(odd.limit(0), texts=False).count() == 0
    with pytest.raises(ValueError):
        substring.deduplicate(odd, 5, 6)


def plain_classes(rows, num=75, den=100):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    ids = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(x)].append(i)
    return sorted(((i, len(sets[x]), (min(ids[find(x)]) if ids[find(x)] else None) if sets[x] else i) for x, (i, _) in enumerate(rows)), key=str)


def jaccard_rows(seed):
    rng = np.random.default_rng(seed)
    rows = corpus(70, seed, 60)
    base = [f"b{i}" for i in range(120)]
    for i in range(60):  # a cloud of near copies whose pairs lie on both sides of the threshold
        d = list(base)
        for _ in range(int(rng.integers(1, 6))):
            d[int(rng.integers(len(d)))] = f"e{rng.integers(1000)}"
        rows.append((1000 + i, " ".join(d)))
    rows += [(None, "only words without an id here"), (None, "ONLY words without an id here"), (7000, "one"), (7001, "ONE"), (7001, "one"), (7002, None)]
    return rows


@pytest.mark.parametrize(("seed", "num", "block"), [(1, 75, 1024), (2, 75, 4), (3, 50, 1024), (4, 30, 7), (5, 95, 1024), (6, 100, 1024)])
def test_jaccard_classes(spark, seed, num, block):
    rows = jaccard_rows(seed)
    got = jaccard.classes(frame(spark, rows), num=num, block=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_classes(rows, num)


@pytest.mark.parametrize("block", [1024, 5])
def test_jaccard_links(spark, block):
    rows = jaccard_rows(8)
    found, members = jaccard.links(frame(spark, rows), block=block)
    of = defaultdict(list)
    for i, r in enumerate(frame(spark, rows).collect()):
        of[frozenset(grams(r.text))].append(i)
    sets = [s for s in of if s]
    want = sum(100 * len(a & b) >= 75 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    pairs = [tuple(r) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) == want and all(a < b for a, b in pairs) and want > 100
    assert members.select("class").where("class is not null").distinct().count() == len(sets)


def test_jaccard_odd(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    assert sorted((tuple(r) for r in jaccard.classes(odd).collect()), key=str) == plain_classes([r[:2] for r in ODD])
    assert jaccard.classes(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard.classes(odd, num=0)


def test_region_recursion_loses_no_link():
    rng = np.random.default_rng(9)
    sets = []
    for _ in range(12):
        center = rng.choice(1 << 40, 60, replace=False)
        for _ in range(40):
            c = center.copy()
            k = int(rng.integers(0, 14))
            c[rng.choice(60, k, replace=False)] = rng.choice(1 << 40, k)
            sets.append(np.unique(c).astype(np.uint64))
    trace = []
    x, y = jaccard.region_links(sets, 75, 100, every=True, trace=trace)
    got = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    s = [set(z.tolist()) for z in sets]
    want = {(a, b) for b in range(len(s)) for a in range(b) if 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])}
    assert got == want and len(want) > 500
    # windows leave most of a region out, and known components leave out more
    assert sum(window < whole for _, _, window, whole in trace) > 10
    few = []
    x, y = jaccard.region_links(sets, 75, 100, trace=few)
    assert rooted(len(sets), zip(x, y, strict=True)) == rooted(len(sets), want) and len(x) < len(sets) and sum(h * w for _, h, w, _ in few) < sum(h * w for _, h, w, _ in trace)
    label = np.array([min(c) if len(c) % 2 else -1 for c in (rooted_class(want, len(sets), i) for i in range(len(sets)))])
    x, y = jaccard.region_links(sets, 75, 100, comp=label)
    known = [(i, j) for i in range(len(sets)) for j in range(i) if label[i] == label[j] >= 0]
    assert rooted(len(sets), [*zip(x, y, strict=True), *known]) == rooted(len(sets), want)


def rooted(n, pairs):
    root = list(range(n))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        root[max(a, b)] = min(a, b)
    return [find(v) for v in range(n)]


def rooted_class(pairs, n, i, held={}):  # noqa: B006
    if not held:
        held.update(enumerate(rooted(n, pairs)))
    return [j for j in held if held[j] == held[i]]


def test_regions_of_two_and_three_use_pivots():
    a = np.arange(100, dtype=np.uint64)
    b, c = np.arange(5, 105, dtype=np.uint64), np.arange(40, 140, dtype=np.uint64)
    assert [z.tolist() for z in jaccard.region_links([a, b], 75, 100)] == [[0], [1]]
    assert [z.tolist() for z in jaccard.region_links([a, c], 75, 100)] == [[], []]
    x, y = jaccard.region_links([a, b, c], 75, 100, every=True)
    assert {(min(p, q), max(p, q)) for p, q in zip(x.tolist(), y.tolist(), strict=True)} == {(0, 1)}


def test_large_groups_of_near_copies_are_sent_a_few_times(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(600):
        d = list(base)
        for _ in range(int(rng.integers(1, 6))):
            d[int(rng.integers(len(d)))] = f"e{rng.integers(10**6)}"
        rows.append((i, " ".join(d)))
    sent = []
    count = jaccard.joined_regions

    def counted(kept, sets, *rest):
        sent.append(kept.join(sets, "class").count())
        return count(kept, sets, *rest)

    turn = jaccard._turn

    def turned(region, sets, *rest):
        sent.append(region.join(sets, "class").count())
        return turn(region, sets, *rest)

    monkeypatch.setattr(jaccard, "joined_regions", counted)
    monkeypatch.setattr(jaccard, "_turn", turned)
    got = jaccard.classes(frame(spark, rows), block=100).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_classes(rows)
    assert len(sent) > 1 and sum(sent) < 10 * len(rows), sent


def test_first_shingles_are_compared_in_small_parts():
    """A region of copies of nearly one text is cleared within a bounded memory, with the same result."""
    m, cells = 1024, 24
    member = np.repeat(np.arange(4 * m), cells)
    cell = np.tile(np.arange(cells), 4 * m)
    group, n = np.repeat(np.arange(4), m), np.full(4 * m, 4 * (cells - 1))
    marks = np.tile(np.arange(16, dtype=np.uint32), (4 * m, 1))
    others = jaccard._Others(group, np.ones(4 * m, np.int64), group)
    tracemalloc.start()
    hopeful = jaccard._hopeful(group, n, marks, member, cell, others, 75, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hopeful.all() and peak < 64 << 20, peak


def test_tasks_send_small_batches_and_give_memory_back(monkeypatch):
    """Rows leave a task in batches of about two megabytes, all of them and in order."""
    import pyarrow as pa

    given = []
    monkeypatch.setattr(X, "give_back", lambda: given.append(1))
    rows = pa.record_batch({"doc_id": list(range(5000)), "text": ["word " * 400] * 5000})
    whole = list(X.tidy(lambda batches: batches)(iter([rows, rows.slice(0, 0), rows.slice(0, 1)])))
    assert sum(b.num_rows for b in whole) == 5001 and max(b.nbytes for b in whole) < 3 << 20 and given == [1]
    assert pa.Table.from_batches(whole[:-1]).combine_chunks().to_batches()[0].equals(rows)
    group = pa.table({"a": list(range(200_000))})
    assert X.tidy_group(lambda key, t: t)((1,), group) is group and given == [1, 1]
    assert X.tidy_group(lambda key, t: t)((1,), group.slice(0, 5)).num_rows == 5 and given == [1, 1]


def test_plans_of_the_join_stay_small(spark, monkeypatch):
    """No step's plan reads tables over and over, which would cost the driver memory."""
    reads, write = [], X.Staged.write

    def counted(self, df, share=0):
        reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return write(self, df, share)

    monkeypatch.setattr(X.Staged, "write", counted)
    rows = jaccard_rows(3)
    got = jaccard.classes(frame(spark, rows), block=5).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_classes(rows)
    assert len(reads) > 20 and max(reads) <= 24, reads


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [tuple(int(v) for v in rng.integers(200, 400, 2)) for _ in range(120)] + [(-5, 60), (500, 500)]
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), X.Staged(spark)).collect()}
    linked = {v for e in edges if e[0] != e[1] for v in e}
    assert got == {v: find(v) for v in linked}


def plain_scores(rows, depth):
    train = [t or "" for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 != 0]
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    count, context = Counter(), defaultdict(Counter)
    for t in train:
        count.update(tokens(t))
        x = [0] * depth + [b + 1 for b in t.encode()] + [0]
        for j in range(depth, len(x)):
            context[tuple(x[j - depth : j])][x[j]] += 1
    n, v = sum(count.values()), len(count)
    for k in range(depth, 0, -1):  # a shorter context counts each longer one in which a symbol was seen once
        for c in [c for c in context if len(c) == k]:
            for s in context[c]:
                context[c[1:]][s] += 1

    def probability(c, s):
        """The full distribution is not needed: walk down from the longest context."""
        out, out_of_it = 1.0, set()
        for k in range(depth + 1):
            left = {a: m for a, m in context.get(c[k:], {}).items() if a not in out_of_it}
            if not left:
                continue
            total = sum(left.values())
            if s in left:
                return out * (left[s] - ppm.ESCAPE) / total
            out *= ppm.ESCAPE * len(left) / total
            out_of_it |= set(left)
        return out / (257 - len(out_of_it))

    result = []
    for i, t in rows:
        x = [0] * depth + [b + 1 for b in (t or "").encode()] + [0]
        score = sum(math.log10(probability(tuple(x[j - depth : j]), x[j])) for j in range(depth, len(x)))
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        result.append((i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, base, score))
    return result, probability


@pytest.mark.parametrize("block_bytes", [1 << 25, 2000])
def test_lm_scores(spark, block_bytes):
    rows = [*corpus(40, 5, 30), *[(900 + i, t) for i, t in enumerate(["", None, "É\nß\x00", "THE the"])], (None, "the w1")]
    want, probability = plain_scores(rows, ppm.DEPTH)
    got = {r.doc_id: r for r in ppm.score(frame(spark, rows), block_bytes=block_bytes).collect()}
    for r in want:
        assert tuple(got[r[0]])[1:5] == r[1:5]
        assert got[r[0]].base_score == pytest.approx(r[5]) and got[r[0]].score == pytest.approx(r[6])
    assert sum(probability((0, 0, 0, 0, 120), s) for s in range(257)) == pytest.approx(1)


def test_lm_scores_by_file_and_odd(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = ({r.doc_id: (r.n_known, round(r.score, 4)) for r in ppm.score(docs, by_file=f).collect()} for f in (True, False))
    assert a == b and len(a) == docs.count()
    odd = spark.createDataFrame(ODD, SCHEMA)
    assert ppm.score(odd).count() == len(ODD)
    assert ppm.score(odd.limit(0)).count() == 0
    alone = ppm.score(frame(spark, [(None, "nothing learned")])).first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and alone.base_score == 0 and alone.score == pytest.approx(-16 * math.log10(257))


def test_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = quality.fit(docs, labels)
    rows = quality.score(docs, net).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows if r.held_out]) > 0.85
    odd = spark.createDataFrame(ODD, SCHEMA)
    assert quality.score(odd, net).count() == len(ODD) and quality.score(odd.limit(0), net).count() == 0
    kept = {r.doc_id for r in quality.score(docs, net).where("predicted = 1").collect()}
    assert {r.doc_id for r in quality.accepted(docs, net).collect()} == kept
    # a chunked score equals that of the text on its own, whatever stands beside it
    texts = [r.text for r in docs.limit(20).collect()] + ["", "x" * 5000]
    import pyarrow as pa

    together = np.concatenate([net.scores(d, o) for *_, d, o in X.chunks(pa.array(texts))])
    alone = [float(net.scores(d, o)[0]) for t in texts for *_, d, o in X.chunks(pa.array([t]))]
    assert together == pytest.approx(alone, abs=1e-5)


def test_quality_scores_against_plain_loops():
    net = quality.Net(filters=3, hidden=4)
    net.ready()
    texts = ["", "a", "short text", "é" * 40 + " x" * 100, "".join(chr(97 + i * i % 26) for i in range(700))]

    def plain(text):
        data = text.encode()
        padded = [0] * 3 + list(data)
        padded += [0] * (-len(padded) % 128) + [0] * 4
        blocks = (len(data) + 3 + 127) // 128
        pooled = [[max(sum(float(net.taps[k, padded[128 * b + i + k], f]) for k in range(4)) for i in range(128)) for f in range(3)] for b in range(blocks)]
        chunks = [[math.tanh(max(p, q)) for p, q in zip(pooled[b], pooled[min(b + 1, blocks - 1)], strict=True)] for b in range(max(1, blocks - 1))]
        x = [sum(c[f] for c in chunks) / len(chunks) for f in range(3)] + [max(c[f] for c in chunks) for f in range(3)] + [math.log1p(min(len(data), 256)) / 5]
        h = [math.tanh(sum(a * float(net.w1[i, j]) for i, a in enumerate(x)) + float(net.b1[j])) for j in range(4)]
        return 1 / (1 + math.exp(-sum(a * float(w) for a, w in zip(h, net.w2, strict=True)) - float(net.b2[0])))

    import pyarrow as pa

    got = np.concatenate([net.scores(d, o) for *_, d, o in X.chunks(pa.array(texts))])
    assert got.tolist() == pytest.approx([plain(t) for t in texts], abs=1e-5)


def test_quality_without_labels(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(odd, quality.fit(odd, none)).collect()} == {0.5}
    one = spark.createDataFrame([*((i, 1, 0) for i in (1, 2, 4, 5, 6)), (3, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(odd, quality.fit(odd, one)).collect()} == {1.0}


def test_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names if n != "pipeline"] == [f"op{k}" for k in range(1, 11)] and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


def test_pipeline_against_plain_stages(spark, sf):
    """Each stage on its own input, against a plain version of its decision."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    staged = X.Staged(spark)
    inputs, now = [], docs
    for _, stage in corpus_pipeline.STAGES:
        inputs.append({r.doc_id: r.asDict() for r in now.collect()})
        now = staged.write(stage(spark, now, sf))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert now.columns == list(corpus_pipeline.COLUMNS)
    scored = {r.doc_id for r in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).where("predicted = 1").collect()}
    assert set(inputs[1]) == scored
    linked = {i: c for i, _, c in plain_classes([(i, r["text"]) for i, r in inputs[1].items()])}
    assert set(inputs[2]) == {i for i, c in linked.items() if c == i}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    bad = plain_contamination([(i, r["text"]) for i, r in inputs[2].items()], items)
    assert set(inputs[3]) == {i for i in inputs[2] if not bad[i][4]}
    for i, r in inputs[4].items():
        before = inputs[3][i]["text"] or ""
        assert r["text"] == pii.redacted(before, pii.find(before))
    packed = now.collect()
    plain = packing._tokenizer(path())[0]
    length = defaultdict(int)
    for r in packed:
        length[r.doc_id] += r.length
    assert length == {i: len(plain.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in inputs[4].items()}
    whole = sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf).collect())
    assert whole == sorted(tuple(r)[:5] for r in packed)


def test_pipeline_stages_take_empty_and_odd_tables(spark, sf):
    for rows in ([], [r[:5] for r in ODD]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() >= bool(rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(found.fetchall(), key=str)
