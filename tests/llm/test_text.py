"""Shared machinery and the operators that work row by row, against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontaminate, langid, merkle, packing, pii, secrets, shingles, substring
from tidemark.llm import textcore as X

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, part int, n long"
ODD = [
    (1, None, None, None, None, "x", 1, 1),
    (2, "", "en", "a", 0, "x", 1, 1),
    (None, "alpha beta", "en", None, 10, "x", 1, 1),
    (3, " \t\n ", None, "a", 4, None, None, None),
    (4, "wörd " * 30_000, "de", "b", 150_000, "x", 1, 1),
    (4, "wörd " * 30_000, "de", "b", 150_000, "x", 1, 1),
    (4, "another text under the same id", "en", "b", 30, "x", 1, 1),
    (5, "x" * 100_000, "en", "b", 100_000, "x", 1, 1),
    (6, "12345 ☃ …", "en", "b", 9, "x", 1, 1),
]
words = st.text(alphabet="abAB é,.\n\t\x0b\x1c", max_size=40)


def split(texts, kind=X.SPACED):
    out = []
    for lo, hi, data, off in X.chunks(pa.array(texts, pa.string()), 64):
        starts, ends, first = X.words(data, off, kind)
        for i in range(hi - lo):
            out.append([data[a:b].tobytes() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)])
    return out


@given(st.lists(st.none() | words, max_size=8))
@settings(max_examples=200, deadline=None)
def test_words(texts):
    assert split(texts) == [(t or "").encode().split() for t in texts]
    alnum = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "") for t in texts]
    assert split(texts, X.ALNUM) == [[w.encode() for w in ws] for ws in alnum]


def test_slices_of_columns():
    column = pa.array(["a b", None, "c", "", "d e f"], pa.large_string()).slice(1, 4)
    assert [len(w) for w in split(column.to_pylist())] == [0, 1, 0, 3]
    assert sum(hi - lo for lo, hi, *_ in X.chunks(column)) == 4
    assert list(X.chunks(pa.array([], pa.string()))) == []


@given(st.lists(words, min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_hashes_depend_on_the_word_only(texts):
    seen = {}
    for lower in (False, True):
        for lo, hi, data, off in X.chunks(pa.array(texts, pa.string())):
            s, e, _ = X.words(data, off)
            for h, a, b in zip(X.word_hashes(data, s, e, lower).tolist(), s, e, strict=True):
                w = data[a:b].tobytes()
                assert seen.setdefault((lower, h), w.lower() if lower else w) == (w.lower() if lower else w)
    assert len({(k[0], v) for k, v in seen.items()}) == len(seen)


THUE = "a"
for _ in range(11):
    THUE += THUE.translate(str.maketrans("ab", "ba"))
ALTER = THUE.translate(str.maketrans("ab", "ba"))


def test_hashes_of_balanced_sequences_differ():
    """Words and runs of words on which a polynomial modulo a power of two has one value."""
    for n in (8, 64, 65, 128, 1024, 2048):
        data, off = X.raw(pa.array([THUE[:n], ALTER[:n], THUE[:n]]))
        h = X.span_hashes(data, off[:-1], off[1:])
        assert h[0] == h[2] != h[1]
        codes = X.mix(np.array([ord(c) for c in THUE[:n] + ALTER[:n] + THUE[:n]], np.uint64))
        r = X.Runs(codes).hash(np.array([0, n, 2 * n]), np.array([n, n, n]))
        assert r[0] == r[2] != r[1]
    data, off = X.raw(pa.array([THUE, ALTER]))
    assert X.same_spans(data, off[:-1], data, off[[0, 0]], np.diff(off)).tolist() == [True, False]
    assert X.same_spans(data, np.array([0, 5]), data, np.array([0, 6]), np.array([0, 1])).tolist() == [True, data[5] == data[6]]


@given(st.lists(st.integers(0, 2), min_size=1, max_size=24), st.integers(1, 24))
@settings(max_examples=100, deadline=None)
def test_hashes_of_runs(codes, n):
    runs = X.gram_hashes(X.mix(np.array(codes, np.uint64)), n)
    plain = [tuple(codes[i : i + n]) for i in range(len(codes) - n + 1)]
    assert len(runs) == len(plain) and all((runs[i] == runs[j]) == (plain[i] == plain[j]) for i in range(len(plain)) for j in range(i))


def test_balanced_texts_are_told_apart(spark):
    """Texts that a hash of the polynomial kind would take for each other."""
    assert len({f[:32] for f in merkle.fingerprints([THUE, ALTER])}) == 2
    ids, bounds = packing.Encoder(path()).encode(*X.raw(pa.array([THUE, ALTER])))
    plain = packing._tokenizer(path())[0]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in (THUE, ALTER)]
    line = lambda w: " ".join([f"w{i}" for i in range(30)] + [w] + [f"v{i}" for i in range(29)])
    docs = spark.createDataFrame([(1, line(THUE), "en", "s", 1, "x", 1, 1), (2, line(ALTER), "en", "s", 1, "x", 1, 1), (3, ALTER, "en", "s", 1, "x", 1, 1)], SCHEMA)
    assert {r.doc_id: r.n_removed for r in substring.deduplicate(docs).collect()} == {1: 0, 2: 0, 3: 0}
    items = spark.createDataFrame([(1, THUE)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, items).collect()} == {1: 1, 2: 0, 3: 0}
    words = [" ".join(t) for t in (THUE[:64], ALTER[:64])]
    docs = spark.createDataFrame([(k, w, "en", "s", 1, "x", 1, 1) for k, w in enumerate(words)], SCHEMA)
    got = substring.deduplicate(docs).collect()
    seen = {tuple(words[0].split()[i : i + 50]) for i in range(15)}
    assert (got[0].n_removed > 0 or got[1].n_removed > 0) == any(tuple(words[1].split()[i : i + 50]) in seen for i in range(15))


def test_equal_hashes_are_compared(monkeypatch):
    """Even if all words had one hash, bytes decide in the search and in the encoder's memory."""
    monkeypatch.setattr(X, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    p = decontaminate.Patterns(["one two three"], ["1"])
    text = decontaminate.Words(*X.raw(pa.array(["one two three four", "one two four"])))
    covered, rows, items = p.search(text)
    assert covered.tolist() == [True] * 3 + [False] * 4 and rows.tolist() == [0] and items.tolist() == [0]
    ids, bounds = packing.Encoder(path()).encode(*X.raw(pa.array(["one two", "three"])))
    plain = packing._tokenizer(path())[0]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in ("one two", "three")]


def test_index():
    keys = np.array([5, -1, 0, -2, 1 << 62], np.int64)
    index = X.Index(keys, np.arange(5.0))
    assert index.get(keys[[4, 0, 3, 3]]).tolist() == [4.0, 0.0, 3.0, 3.0]
    with pytest.raises(KeyError):
        index.get(np.array([7]))
    with pytest.raises(KeyError):
        X.Index(keys[:0], np.zeros(0)).get(np.array([7]))


def test_anchors_are_window_minima():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 6, 80).astype(np.uint64)
    for span in (1, 2, 3, 7, 41, 80, 81):
        got = substring.anchors(grams, span)
        want = [i + span - 1 - int(np.argmin(grams[i : i + span][::-1])) for i in range(len(grams) - span + 1)]
        assert got.tolist() == want


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_pii(text):
    out = []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


pieces = st.sampled_from(["a@b.c", "@", ".", "..", "+", "-", " ", "(", "1", "25", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 123-4567", "10.0.0.1", "x", "é", "://", "IBAN "])


@given(st.lists(pieces, max_size=14).map("".join))
@settings(max_examples=600, deadline=None)
def test_pii_equals_patterns(text):
    assert [s for s in pii.find(text) if s[0] in pii.KINDS] == plain_pii(text)


def test_pii_added_and_long_texts():
    text = "IBAN: DE89 3704 0044 0532 0130 00, see https://me:secret@host.example/x"
    assert [s[0] for s in pii.find(text)] == ["email", "iban", "login"]
    assert pii.find("IBAN DE00 3704 0044 0532 0130 00") == []
    assert pii.redacted(text, pii.find(text)).startswith("IBAN: <IBAN>, see <LOGIN>")
    for long in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "@" * 100_000, "+1" * 100_000):
        pii.find(long)


def test_pii_rows(spark):
    docs = spark.createDataFrame([*ODD, (9, "mail a@b.cc, 10.0.0.300 and 10.0.0.1", "en", "s", 36, "x", 1, 1)], SCHEMA)
    rows = pii.personal_spans(docs).collect()
    assert len(rows) == len(ODD) + 1
    got = next(r for r in rows if r.doc_id == 9)
    assert (got.n_email, got.n_ip, got.spans) == (1, 1, "email:5:11,ip:28:36")
    assert got.base_sha256 == hashlib.sha256(got.spans.encode()).hexdigest()
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[9].text == "mail <EMAIL>, 10.0.0.300 and <IP>" and clean[9].n_chars == len(clean[9].text) and clean[9].row == "x"
    assert clean[1].text is None and pii.redact(docs).count() == len(ODD) + 1
    assert pii.personal_spans(docs.limit(0)).count() == 0


def plain_secrets(text):
    out = []
    kinds = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12), ("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16)]
    for i, (kind, pattern, least) in enumerate(kinds):
        for m in re.finditer(pattern, text, re.I | re.A if kind == "assign" else 0):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), i, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


bits = st.sampled_from(["password", "PassWd", "api_key", "APIKEY", "token", "ſecret", "toKen", '"', "'", " ", ":", "=", "abcdefabcdefabcd", "0123456789", "AKIA", "ABCDEFGHIJKLMNOP", "x", "é", "G"])


@given(st.lists(bits, max_size=12).map("".join))
@settings(max_examples=500, deadline=None)
def test_secrets_equal_patterns(text):
    assert ",".join(f"{k}:{a}:{b}" for k, a, b, _ in secrets.find(text) if k in secrets.KINDS) == plain_secrets(text)
    flagged = [bool(f) for lo, hi, data, off in X.chunks(pa.array(["", text, "é"])) for f in secrets._flagged(data, off)]
    assert flagged[1] or not secrets.find(text)


def test_secret_ownership(spark):
    key = "token = 'abcdefghijkl123'"
    rows = [(i, key, "en", f"s{i % 4}", 1, "x", 1, 1) for i in range(8)] + [(20, "password: only-once-1234", "en", "s1", 1, "x", 1, 1), (21, "password: only-once-1234", "en", "s1", 1, "x", 1, 1)]
    got = {r.doc_id: (r.n_assign, r.n_live, r.n_copied) for r in secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == (1, 0, 1) and got[20] == got[21] == (1, 1, 0)
    held = {r.doc_id: (r.spans, r.holders) for r in secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert held[0] == ("assign:0:24", "copied:4:8") and held[20] == held[21] == ("assign:0:24", "live:1:2")
    by_repo = {r.doc_id: r.holders for r in secrets.scan(spark.createDataFrame(rows, SCHEMA), widely=9, repo="lang").collect()}
    assert by_repo[0] == "shared:4:1" and by_repo[20] == "live:1:1"
    odd = spark.createDataFrame(ODD, SCHEMA)
    assert secrets.scan(odd).count() == len(ODD)
    assert secrets.scan(odd.limit(0)).count() == 0
    assert secrets.scan(odd.select("doc_id", "text")).count() == len(ODD)


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@given(st.lists(st.none() | words, min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_shingle_sets(texts):
    for lo, hi, data, off in X.chunks(pa.array(texts, pa.string())):
        s = shingles.Sets(data, off)
        sets = [grams(t) for t in texts[lo:hi]]
        assert s.sizes.tolist() == [len(x) for x in sets]
        assert all((s.identity[i] == s.identity[j]) == (sets[i] == sets[j]) for i in range(hi - lo) for j in range(hi - lo))


def test_merkle_fingerprints():
    texts = ["", "a", "one two\nthree four\n\nfive six seven " * 30, "word " * 500, "é\nß\n"]
    f = merkle.fingerprints(texts)
    assert len({x[:32] for x in f}) == len(texts) and f == [merkle.fingerprints([t])[0] for t in texts]
    assert [merkle.likeness(x, x) for x in f] == [1.0] * 5 and merkle.likeness(f[2], f[4]) == 0.0


def plain_tree(text):
    """Root, paragraphs and leaves from the bytes alone, given where leaves begin."""
    data = np.frombuffer(text.encode(), np.uint8)
    begin, head = merkle.leaf_starts(data, np.array([0, len(data)]))
    leaves = [text.encode()[a:b] for a, b in zip(begin, [*begin[1:], len(data)], strict=True)]
    digest = lambda x: hashlib.blake2b(x, digest_size=16).digest()
    paragraphs, groups = [], []
    for leaf, first in zip(leaves, head, strict=True):
        if first:
            groups.append([])
        groups[-1].append(leaf)
    paragraphs = [digest(b"".join(map(digest, g))) for g in groups]
    sections = [[]]
    for p, g in zip(paragraphs, groups, strict=True):
        sections[-1].append(p)
        if g == [b"\n"] or p[0] % 4 == 0:
            sections.append([])
    root = digest(b"\x02" + b"".join(digest(b"\x01" + b"".join(s)) for s in sections if s))
    return root.hex(), [b"".join(g) for g in groups], leaves


def paragraphs_of(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{rng.integers(10**6)}" for _ in range(30)) + ("\n" if rng.random() < 0.8 else "\n\n") for _ in range(n)]


def test_merkle_trees_equal_plain_ones():
    for seed in range(4):
        text = "".join(paragraphs_of(30, seed))
        root, groups, leaves = plain_tree(text)
        tree = merkle.Tree(merkle.fingerprints([text])[0])
        assert tree.root == root and "".join(g.decode() for g in groups) == text and len(groups) == len(tree.levels[1]) and len(leaves) == len(tree.levels[2])
        assert max(len(x.split()) for x in leaves) <= merkle.LONGEST
        assert [tree.place(k) for k in range(len(groups))] == [(s, k - a) for s, (a, b) in enumerate(zip(tree.children[0], tree.children[0][1:], strict=False)) for k in range(a, b)]


def longest_common(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
    return int(best[-1, -1])


def test_merkle_likeness_counts_what_stands_in_order():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        before = paragraphs_of(40, seed)
        after, kind = list(before), seed % 6
        at = int(rng.integers(1, 39))
        if kind == 0:
            after[at : at + 1] = []
        elif kind == 1:
            after[at:at] = paragraphs_of(2, 99)
        elif kind == 2:
            after[at] = after[at].replace(" ", " changed ", 1)
        elif kind == 3:
            after.append(before[3])
        elif kind == 4:
            after.insert(0, after.pop(at))
        else:
            after = [after[i] for i in rng.permutation(40)]
        a, b = merkle.fingerprints(["".join(before), "".join(after)])
        x, y = plain_tree("".join(before))[2], plain_tree("".join(after))[2]
        best = 2 * longest_common(x, y) / (len(x) + len(y))
        near = merkle.likeness(a, b)
        assert near == merkle.likeness(b, a) if kind < 5 else near <= best < 0.6
        assert near == pytest.approx(best) if kind < 4 else near <= best + 1e-9
        found = merkle.edits(a, b)
        assert found and merkle.edits(a, a) == []
        places = {k: merkle.Tree(f) for k, f in zip("ab", (a, b), strict=True)}
        flat = lambda tree, place: tree.children[0][place[0]] + place[1]
        names = plain_tree("".join(before))[1], plain_tree("".join(after))[1]
        for what, p, q in found:
            assert (p is not None) == (what in ("removed", "moved")) and (q is not None) == (what in ("added", "moved"))
            if what == "moved":
                assert names[0][flat(places["a"], p)] == names[1][flat(places["b"], q)]
        if kind == 0:
            assert [w for w, *_ in found if w != "removed"] == []
        if kind == 3:
            assert [(w, names[1][flat(places["b"], q)]) for w, _, q in found] == [("added", names[0][[i for i, g in enumerate(names[0]) if g.decode().strip() == before[3].strip()][0]])] or before[3].endswith("\n\n")


@pytest.mark.parametrize("partitions", ["1", "3", "8"])
def test_merkle_neighbours(spark, partitions):
    rows = [*ODD, *((100 - i, f"text {i} " * (i + 1), "en", "s", 1, "x", 1, 1) for i in range(40))]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = merkle.compare_neighbours(spark.createDataFrame(rows, SCHEMA)).collect()
        assert merkle.compare_neighbours(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0
        one = merkle.compare_neighbours(spark.createDataFrame(rows[:1], SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == len(rows) and one[0].near_next == 1.0
    plain = sorted((r[0], r[1] or "") for r in rows if r[0] is not None and r[0] != 4)
    first = "alpha beta"  # the row without an id comes before all others
    by_id = {r.doc_id: r for r in got if r.doc_id != 4}
    for (i, t), (j, u) in zip(plain, [*plain[1:], (None, first)], strict=True):
        if i == 3 or j == 5:
            continue  # its neighbour is one of the rows that share an id
        assert by_id[i].edited_sha256 == hashlib.sha256(merkle.edited(t, u).encode()).hexdigest()
        assert by_id[i].fingerprint == merkle.fingerprints([t])[0] and by_id[i].n_chars == len(t)
    assert by_id[None].edited_sha256 == hashlib.sha256(merkle.edited(first, "").encode()).hexdigest()


def alnum(text):
    return re.findall(r"[0-9a-z\x80-\U0010FFFF]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_contamination(docs, items):
    out = {}
    for doc_id, text in docs:
        w = alnum(text)
        hit, found = [False] * len(w), set()
        for item, t in items:
            v = alnum(t)
            n = min(13, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
                    if item is not None:
                        found.add(str(item))
        k = sum(hit)
        out[doc_id] = (len(w), k, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), k > 0 and 20 * k >= len(w))
    return out


@pytest.mark.parametrize("block_words", [1 << 20, 40])
def test_decontamination(spark, block_words):
    rng = np.random.default_rng(4)
    vocabulary = [f"W{i}" for i in range(12)] + ["é", "X-1"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(int(n))) for i, n in enumerate(rng.integers(1, 30, 12))] + [(50, ""), (51, None), (None, "w1 w2 w3"), (3, text(5))]
    docs = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 600, 25))]
    docs += [(100, "  ".join(["pre", items[0][1].lower(), "post"])), (101, None), (102, "")]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(i, t, None, None, None, "x", 1, 1) for i, t in docs], SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(d, b, block_words=block_words).collect()}
    want = plain_contamination(docs, items)
    assert got == want
    assert {r.doc_id for r in decontaminate.clean(d, b, block_words=block_words).collect()} == {i for i, v in want.items() if not v[4]}
    odd = spark.createDataFrame(ODD, SCHEMA)
    assert decontaminate.contamination(odd, b).count() == len(ODD)
    assert decontaminate.contamination(odd, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(odd.limit(0), b).count() == 0


def test_secret_holders_against_plain_counts(spark):
    rng = np.random.default_rng(6)
    values = [f"token={'abcdefgh'[k]}{k}0123456789ab" for k in range(6)] + ["AKIA" + "Q" * 16, "0123456789abcdef0"]
    rows = [(i, " ".join(str(v) for v in rng.choice(values, int(rng.integers(0, 5)))), "en", f"s{rng.integers(5)}", 1, "x", 1, 1) for i in range(50)] + [(50, values[0], "en", None, 1, "x", 1, 1)]
    owners, repos = {}, {}
    for i, text, _, source, *_ in rows:
        for *_, v in secrets.find(text):
            owners.setdefault(v, set()).add(source)
            repos.setdefault(v, set()).add(i)
    for r in secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect():
        found = secrets.find(rows[r.doc_id][1])
        status = lambda v: "live" if len(owners[v]) == 1 else "copied" if len(owners[v]) >= 3 else "shared"
        assert r.holders == ",".join(f"{status(v)}:{len(owners[v])}:{len(repos[v])}" for *_, v in found)
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found)
        assert r.n_copied == len({v for *_, v in found if status(v) == "copied"}) and r.base_sha256 == hashlib.sha256(plain_secrets(rows[r.doc_id][1]).encode()).hexdigest()


def test_language_scores_against_plain_sums():
    rng = np.random.default_rng(2)
    kinds = {"aa": ["the", "house", "Wäter"], "bb": ["das", "haus", "über"], "cc": ["talo", "vesi", "yö"]}
    texts, langs = zip(*[(" ".join(rng.choice(v, 9)), k) for k, v in kinds.items() for _ in range(30)], strict=True)
    model = langid.Model(list(texts), list(langs), steps=600)
    assert 1e-4 < model.temperature < 1e3 and 1 / 3 < model.least < 1

    def plain(text):
        shown = [0x20] + [(b + 32 if 0x41 <= b <= 0x5A else b) if chr(b).isalpha() or b >= 0x80 else 0x20 for b in text.encode()] + [0x20, 0x20]
        sums, n = np.zeros(3), 0
        for i, b in enumerate(text.encode(), 1):
            if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80):
                continue
            x, y, z, w = (shown[i + k] for k in (-1, 0, 1, 2))
            three = (x << 16 | y << 8 | z) * 0x9E3779B1 & 0xFFFFFFFF
            four = ((y << 16 | z << 8 | w) * 0x85EBCA77 & 0xFFFFFFFF) ^ (x * 0xC2B2AE3D & 0xFFFFFFFF)
            sums += model.table[three >> 17] + model.table[((four * 0x27D4EB2F & 0xFFFFFFFF) >> 17) + (1 << 15)]
            n += 2
        p = np.exp((sums / max(n, 1) + model.bias) / model.temperature)
        return (p / p.sum()).tolist()

    some = [*texts[::9], "the Über, talo!", "x", "", "1 2"]
    for lo, hi, data, off in X.chunks(pa.array(some)):
        best, score = model.predict(data, off)
        want = [plain(t) for t in some[lo:hi]]
        assert best.tolist() == [int(np.argmax(p)) for p in want] and score.tolist() == pytest.approx([max(p) for p in want], abs=1e-4)


def test_language_letters():
    texts = ["", "123 !", "é", "☃", "中", "x", "123\n"]
    got = [bool(x) for lo, hi, data, off in X.chunks(pa.array(texts)) for x in langid.has_letter(data, off)]
    assert got == [any(c.isalpha() for c in t) for t in texts]


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.9
    odd = {r.doc_id: r for r in langid.identify(spark.createDataFrame(ODD, SCHEMA), model).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and odd[6].lang_pred == "und" and odd[5].lang_pred != "und" and odd[None].held_out is False
    nothing = spark.createDataFrame(ODD, SCHEMA).limit(0)
    assert langid.fit(nothing) is None and langid.identify(nothing, None).count() == 0
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame(ODD, SCHEMA), None).collect()} == {"und"}




def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


marks = st.sampled_from(["a", "B", "é", "é", "'", "'s", "9", "²", ".", ",", "…", "\xa0", "　", " ", "\n", "<", "|", ">", "<|endoftext|>", "don't", "\x00", "\x1f", "\x85", "İ", "ς", "中", "😀", "-", "ﬁ", "‍"])


@given(st.lists(st.lists(marks, max_size=12).map("".join), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_encoder_equals_tokenizer(texts):
    encoder = packing.Encoder(path(), held=8)
    plain = packing._tokenizer(path())[0]
    for _ in range(2):
        ids, bounds = encoder.encode(*X.raw(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=200, deadline=None)
def test_best_fit_and_bounds(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets, fill = packing.best_fit(lengths, 40)
    for k in range(len(fill)):
        inside = sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == k))
        assert [o for o, _ in inside] == [0, *np.cumsum([n for _, n in inside])[:-1]] and sum(n for _, n in inside) == fill[k] <= 40
    bound = packing.lower_bound(lengths, 40)
    assert bound <= len(fill) <= max(1.23 * bound + 1, bound + 1)


def test_lower_bounds_see_large_pieces():
    assert packing.lower_bound(np.array([21] * 10), 40) == 10
    assert packing.lower_bound(np.array([14] * 9), 40) == 5


@pytest.mark.parametrize("part_size", [100_000, 20])
def test_packing(spark, part_size):
    rng = np.random.default_rng(2)
    rows = [*ODD, *((10 + i, "some words, more! " * int(n), "en", "s", 1, "x", 1, 1) for i, n in enumerate(rng.integers(0, 900, 60)))]
    got = packing.pack(packing.pieces(spark.createDataFrame(rows, SCHEMA), path()), part_size=part_size).collect()
    plain = packing._tokenizer(path())[0]
    want = []
    for r in rows:
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r[0], k, k * 2048, len(x), zlib.crc32(x.tobytes())) for k in range(-(-len(ids) // 2048)) for x in [ids[k * 2048 : (k + 1) * 2048]]]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in held.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= 2048
    assert len(held) <= packing.lower_bound(np.array([r.length for r in got]), 2048) + (1 if part_size > 1000 else 3)
    assert packing.pack(packing.pieces(spark.createDataFrame(rows, SCHEMA).limit(0), path())).count() == 0
