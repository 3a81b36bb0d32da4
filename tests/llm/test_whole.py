"""Inputs that operators once did only in part."""

import base64
import hashlib
import random
import zlib

import numpy as np

import corpus_pipeline
from tests.llm.test_corpus import plain_classes, plain_dedup
from tests.llm.test_text import path, plain_contamination, plain_pii, plain_secrets
from tidemark.llm import decontaminate, jaccard, langid, merkle, packing, pii, ppm, quality, secrets, substring
from tidemark.llm import textcore as X

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, part int, n long"


def openssh(seed, end=True, newline="\n", kind=b"ssh-ed25519"):
    """An unencrypted key file; all bytes that all keys share come first."""
    fixed = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + b"\0\0\0\1\0\0\0\x33" + len(kind).to_bytes(4, "big") + kind + b"\0\0\0\x20"
    body = base64.b64encode(fixed + random.Random(seed).randbytes(170)).decode()
    lines = ["-----BEGIN OPENSSH PRIVATE KEY-----", *(body[i : i + 70] for i in range(0, len(body), 70))]
    return newline.join([*lines, "-----END OPENSSH PRIVATE KEY-----"] if end else lines)


def value(text):
    return [v for k, *_, v in secrets.find(text) if k == "pem"]


def test_private_keys_of_different_owners(spark):
    rows = [(i, f"key {i}\n" + openssh(i), "en", f"s{i}", 1, "x", 1, 1) for i in range(4)]
    rows += [(10 + i, f"example {i}\n" + openssh(99), "en", f"s{i}", 1, "x", 1, 1) for i in range(3)]
    got = {r.doc_id: (r.spans, r.n_live, r.n_copied) for r in secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i][1:] for i in range(4)] == [(1, 0)] * 4
    assert [got[10 + i][1:] for i in range(3)] == [(0, 1)] * 3
    assert got[0][0].startswith("pem:6:41")


def test_private_key_values():
    (whole,) = value(openssh(1))
    assert len(whole) > 300 and not set(whole) & set(" \n-")
    same = [openssh(1, newline="\r\n") + "\nmore text", openssh(1, newline="\\n"), openssh(1, newline=" "), openssh(1, newline="\n    "), openssh(1, end=False), openssh(1, end=False) + "\nmore text, follows", openssh(1, end=False, newline="\\n") + '"']
    for text in same:
        assert value(text) == [whole], text
    # the END of another key does not close this one, and each key keeps its own value
    assert value(openssh(1, end=False) + "\n" + openssh(2)) == [whole, *value(openssh(2))]
    assert value(openssh(1, end=False)) != value(openssh(2, end=False))
    old = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A\n\n"
    assert value(old + "A" * 64 + "\nB=") != value(old + "A" * 64 + "\nC=")
    assert value("-----BEGIN PRIVATE KEY----- and prose") == [""]
    for long in ("-----BEGIN PRIVATE KEY-----" * 10_000, "-----BEGIN PRIVATE KEY-----" + "\n" * 300_000, "-----BEGIN PRIVATE KEY-----" + "A" * 300_000 + " x" * 100_000):
        secrets.find(long)


def accounts(text):
    return [text[a:b] for k, a, b in pii.find(text) if k == "iban"]


def iban(country, rest):
    digits = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{country}{98 - int(digits) % 97:02d}{rest}"


def test_accounts_before_other_words(spark):
    german = "DE89 3704 0044 0532 0130 00"
    text = f"IBAN {german} BIC COBADEFFXXX"
    assert accounts(text) == [german]
    assert pii.redacted(text, pii.find(text)) == "IBAN <IBAN> BIC COBADEFFXXX"
    for after in (" 17", " EUR 120", " A", " BIC", " IBAN", "\nBIC", ", BIC", "", " Bank", " COBADEFFXXX " * 3):
        assert accounts(f"IBAN: {german}{after}") == [german], after
        assert accounts(f"IBAN: {german.replace(' ', '')}{after}") == [german.replace(" ", "")], after
    assert accounts(f"IBAN {german} IBAN {german} BIC X") == [german] * 2
    # every remainder of a following number leaves the number of the country's length
    assert all(accounts(f"IBAN {german} {n}") == [german] for n in range(10, 300))
    # the longest number that there is, in blocks of four, and a country without a known length
    malta = iban("MT", "MALT011000012345MTLCAST001S")
    blocks = " ".join(malta[i : i + 4] for i in range(0, 31, 4))
    assert accounts(f"IBAN {blocks} BIC X") == [blocks]
    other = iban("ZZ", "1234567890123456")
    assert accounts(f"IBAN {other} BIC") == [other]
    rows = [(1, text, "en", "a", len(text), "x", 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [(r.spans, r.n_added) for r in pii.personal_spans(docs).collect()] == [("iban:5:32", 1)]
    assert [r.text for r in pii.redact(docs).collect()] == ["IBAN <IBAN> BIC COBADEFFXXX"]


def test_rare_languages_are_learned(spark):
    draw = random.Random(3)
    text = lambda words: " ".join(draw.choices(words, k=12))
    kinds = {"aa": ["the", "house", "water", "green", "under"], "bb": ["das", "haus", "wasser", "unter", "blau"], "cc": ["talo", "vesi", "alla", "sininen", "puu"]}
    langs = ["aa"] * 4000 + ["bb"] * 2000 + ["cc"] * 8
    docs = spark.createDataFrame([(i * 4, text(kinds[x]), x, "s", 1, "x", 1, 1) for i, x in enumerate(langs)], SCHEMA)
    model = langid.fit(docs, sample=60, least=20)
    assert model.languages == ["aa", "bb", "cc"]
    held = spark.createDataFrame([(i * 4 + 2, text(kinds[x]), x, "s", 1, "x", 1, 1) for i, x in enumerate(["aa", "bb", "cc"] * 20)], SCHEMA)
    got = {r.doc_id: r.lang_pred for r in langid.identify(held, model).collect()}
    assert sum(got[i * 4 + 2] == x for i, x in enumerate(["aa", "bb", "cc"] * 20)) >= 57
    assert langid.quotas({"a": 10**9, "b": 10**6, "c": 5}, 2400, 60) == {"c": 5, "b": 1197, "a": 1198}
    assert sum(langid.quotas({str(i): 100 for i in range(24)}, 2400, 60).values()) == 2400
    assert set(langid.quotas({str(i): 10**6 for i in range(100)}, 2400, 60).values()) == {60}


def test_near_duplicates_are_told_apart_by_row(spark, sf):
    draw = random.Random(5)
    text = lambda: " ".join(f"w{draw.randrange(10**6)}" for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [
        *[(1, a, "en", "s", 1)] * 3,  # equal rows with the smallest id of their group
        (1, a, "en", "t", 1),  # the same but for its source
        (7, a, "en", "s", 1),
        (7, b, "en", "s", 1),  # shares its id with a copy, but is not linked
        *[(None, c, "en", "s", 1)] * 2,  # copies without an id
        (None, d, "en", "s", 1),
        (9, d, "en", "s", 1),
        (3, e, "en", "s", 1),
        (3, e + " more", "en", "s", 1),  # near copies under one id
        *[(4, "", "en", "s", 0)] * 2,  # nothing to compare
        (None, None, "en", "s", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.jaccard_join(spark, docs, sf).collect()]
    texts = [r[1] for r in got]
    assert len(got) == 8 and got.count((4, "", "en", "s", 0)) == 2 and (None, None, "en", "s", 0) in got
    assert [r[0] for r in got if r[1] == a] == [1] and (7, b, "en", "s", 1) in got
    assert texts.count(c) == 1 and (9, d, "en", "s", 1) in got and texts.count(d) == 1
    assert sum(t in (e, e + " more") for t in texts) == 1


def test_texts_beyond_a_chunk(spark):
    """Texts of more than a megabyte, words and prose, with copies and finds near their ends."""
    draw = random.Random(8)
    words = [f"w{draw.randrange(40_000)}" for _ in range(190_000)]
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(words) + f" {passage} mail a@b.cc password=abcdefghijkl99"
    near = " ".join(["changed", *words[1:]]) + " the end"
    rows = [(1, long), (2, near), (3, long), (4, "x" * 1_200_000), (5, passage + " tail"), (6, "short text")]
    assert all(len(t) > X.CHUNK for _, t in rows[:4])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x", 1, 1) for i, t in rows], SCHEMA)
    assert sorted((tuple(r) for r in substring.deduplicate(docs).collect()), key=str) == plain_dedup(rows, 50)
    assert sorted((tuple(r) for r in jaccard.classes(docs).collect()), key=str) == plain_classes(rows)
    items = [(1, passage), (2, "x" * 1_200_000)]
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == plain_contamination(rows, items)
    for r in pii.personal_spans(docs.where("doc_id != 4")).collect():  # the plain patterns are quadratic on it
        assert r.spans.startswith(",".join(f"{k}:{a}:{b}" for k, a, b in plain_pii(rows[r.doc_id - 1][1])))
    for r in secrets.scan(docs).collect():
        assert r.base_sha256 == hashlib.sha256(plain_secrets(rows[r.doc_id - 1][1]).encode()).hexdigest()
    plain = packing._tokenizer(path())[0]
    want = set()
    for i, t in rows:
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k, len(x), zlib.crc32(x.tobytes())) for k in range(-(-len(ids) // 2048)) for x in [ids[k * 2048 : (k + 1) * 2048]]}
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.pack(packing.pieces(docs, path())).collect()} == want
    for r in merkle.compare_neighbours(docs).collect():
        assert r.fingerprint == merkle.fingerprints([rows[r.doc_id - 1][1]])[0] and r.n_chars == len(rows[r.doc_id - 1][1])
    scored = {r.doc_id: r for r in ppm.score(docs).collect()}
    assert scored[1].score == scored[3].score < 0 and scored[1].n_tokens == 190_000 + 60 + 3 + 1
    assert len({r.score for r in quality.score(docs, _ready()).where("doc_id in (1, 3)").collect()}) == 1
    assert langid.identify(docs, langid.Model(["one two", "eins zwei"], ["en", "de"], steps=10)).count() == 6


def _ready():
    net = quality.Net()
    net.ready()
    return net


def test_clashing_names_and_several_blocks(spark):
    rows = [(1, "one two three", 7), (2, "something else", 8), (2, "one two three", 9), (None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["one two", "x y z " * 20, "one two three"])], "item_id long, text string")
    kept = decontaminate.clean(docs, items, block_words=4)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[3]], key=str)
    few = decontaminate.contamination(docs, items, block_words=4, passes=1)
    assert {(r.doc_id, r.n_hit, r.n_items) for r in few.collect()} == {(1, 3, 2), (2, 0, 0), (2, 3, 2), (None, 0, 0)}
