"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are runs of at most eight words within a paragraph, cut where a word's hash says so,
with the white space that follows; together they cover every byte.  A leaf is the blake2b
digest of its bytes, a paragraph (up to a line break) that of its leaves' digests, a section
(paragraphs up to a blank line, or to one whose digest says so) that of its paragraphs',
and the root that of its sections'.  So equal roots mean equal texts.

A fingerprint is the root in hexadecimal (16 bytes) and, in base64, the number of
paragraphs of each section and of leaves of each paragraph, and the first six bytes of each
section, paragraph and leaf.  Two of these differ but look alike once in 2**48 pairs.

Two trees are compared from the root down: equal roots end the walk; else sections are
aligned in order, only the paragraphs of sections without a partner are aligned, and only
the leaves of paragraphs without one.  The likeness is the share of leaves below aligned
nodes (Dice), so moved parts count as differing; `edits` names the paragraphs that the walk
found to be removed, added or moved.

Defined results: a null text counts as empty; a null doc_id comes before all others;
rows with an equal doc_id follow each other by a hash of their texts; equal rows give
equal results; a single row is its own successor; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textcore as X

LEAF, LONGEST, SECTION = 4, 8, 4
DIGEST, SHOWN = 16, 6


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def leaf_starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each leaf, whether a paragraph begins there)."""
    n = len(data)
    starts, ends, _ = X.words(data, off)
    codes = X.word_hashes(data, starts, ends, False)
    # a leaf begins at a document's start, after a line break, and at the word after a cutting word
    cut = np.flatnonzero(codes % X.U(LEAF) == 0)
    begin, head = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    head[np.flatnonzero(data == 0x0A) + 1] = True
    head[off[:-1]] = True
    head[n] = False
    begin[starts[cut[cut + 1 < len(starts)] + 1]] = True
    begin |= head
    # a run of words without such a cut is cut after every LONGEST words
    first = np.flatnonzero(begin[starts]) if len(starts) else starts
    run = np.diff(np.r_[first, len(starts)])
    more = (run - 1) // LONGEST
    begin[starts[np.repeat(first, more) + LONGEST * (1 + X.ranges(np.zeros(len(more), np.int64), more))]] = True
    leaves = np.flatnonzero(begin)
    return leaves, head[leaves]


def _tree(leaves: list[bytes], heads: list[int], blanks: list[bool]) -> tuple[bytes, list[bytes], list[bytes], list[int], list[int]]:
    """(root, sections, paragraphs, paragraphs of each section, leaves of each paragraph)."""
    paragraphs, sizes = [], []
    for a, b in pairwise([*heads, len(leaves)]):
        paragraphs.append(_digest(b"".join(leaves[a:b])))
        sizes.append(b - a)
    sections, counts, at = [], [], 0
    for i, p in enumerate(paragraphs):
        if blanks[i] or p[0] % SECTION == 0 or i == len(paragraphs) - 1:
            sections.append(_digest(b"\x01" + b"".join(paragraphs[at : i + 1])))
            counts.append(i + 1 - at)
            at = i + 1
    return _digest(b"\x02" + b"".join(sections)), sections, paragraphs, counts, sizes


def fingerprints(texts: list[str]) -> list[str]:
    out: list[str] = []
    for lo, hi, data, off in X.chunks(pa.array(texts, pa.large_string())):
        begin, head = leaf_starts(data, off)
        first = np.searchsorted(begin, off).tolist()
        buffer, ends = data.tobytes(), [*begin[1:].tolist(), len(data)]
        begin = begin.tolist()
        heads = np.flatnonzero(head).tolist()
        cut = np.searchsorted(heads, first).tolist()
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            leaves = [_digest(buffer[x:y]) for x, y in zip(begin[a:b], ends[a:b], strict=True)]
            mine = [h - a for h in heads[cut[i] : cut[i + 1]]]
            blanks = [ends[a + h] - begin[a + h] == 1 and buffer[begin[a + h]] == 0x0A for h in mine]
            root, sections, paragraphs, counts, sizes = _tree(leaves, mine, blanks)
            shape = np.array([len(counts), *counts, *sizes], "<u4").tobytes()
            shown = b"".join([d[:SHOWN] for level in (sections, paragraphs, leaves) for d in level])
            out.append(f"{root.hex()}:{base64.b64encode(shape).decode()}:{base64.b64encode(shown).decode()}")
    return out


class Tree:
    """What a fingerprint tells of its tree: levels of digests, sections first, and first children."""

    def __init__(self, fingerprint: str):
        self.root, shape, shown = fingerprint.split(":")
        n = np.frombuffer(base64.b64decode(shape), "<u4").tolist()
        counts, sizes = n[1 : n[0] + 1], n[n[0] + 1 :]
        digests = base64.b64decode(shown)
        each = [digests[i : i + SHOWN] for i in range(0, len(digests), SHOWN)]
        a, b = len(counts), len(counts) + len(sizes)
        self.levels = each[:a], each[a:b], each[b:]
        self.children = [*accumulate(counts, initial=0)], [*accumulate(sizes, initial=0)]

    def place(self, paragraph: int) -> tuple[int, int]:
        """(section, paragraph within it)."""
        s = bisect_left(self.children[0], paragraph + 1) - 1
        return s, paragraph - self.children[0][s]


def aligned(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of equal entries, ascending on both sides: equal ends, then the longest run that
    pairs the k-th occurrence of an entry with the k-th."""
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    where: dict[bytes, list[int]] = {}
    for j in range(len(b) - hi - 1, lo - 1, -1):
        where.setdefault(b[j], []).append(j)
    pairs = [(i, where[x].pop()) for i, x in enumerate(a[lo : len(a) - hi], lo) if where.get(x)]
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    run, k = [], ends[-1] if ends else -1
    while k >= 0:
        run.append(pairs[k])
        k = before[k]
    return [(i, i) for i in range(lo)] + run[::-1] + [(len(a) - hi + k, len(b) - hi + k) for k in range(hi)]


def walk(a: Tree, b: Tree) -> list[list[tuple[int, int]]]:
    """Aligned pairs of sections, of paragraphs below sections without a partner, and of leaves
    below paragraphs without one."""
    out: list[list[tuple[int, int]]] = []
    gaps = [(0, len(a.levels[0]), 0, len(b.levels[0]))]
    for level in range(3):
        found, below = [], []
        for a0, a1, b0, b1 in gaps:
            pairs = [(a0 + i, b0 + j) for i, j in aligned(a.levels[level][a0:a1], b.levels[level][b0:b1])]
            found += pairs
            if level < 2:
                for (i, j), (k, m) in pairwise([(a0 - 1, b0 - 1), *pairs, (a1, b1)]):
                    if k - i > 1 and m - j > 1:
                        below.append((a.children[level][i + 1], a.children[level][k], b.children[level][j + 1], b.children[level][m]))
        out.append(found)
        gaps = below
    return out


def _alike(a: Tree, b: Tree) -> float:
    if a.root == b.root:
        return 1.0
    sections, paragraphs, leaves = walk(a, b)
    first, leaf = a.children
    common = sum(leaf[first[i + 1]] - leaf[first[i]] for i, _ in sections) + sum(leaf[i + 1] - leaf[i] for i, _ in paragraphs) + len(leaves)
    return 2 * common / max(1, len(a.levels[2]) + len(b.levels[2]))


def likeness(a: str, b: str) -> float:
    """How much of two texts stands in the same order, from their fingerprints alone."""
    return _alike(Tree(a), Tree(b))


def edits(a: str, b: str) -> list[tuple[str, tuple[int, int] | None, tuple[int, int] | None]]:
    """(removed, added or moved; place in `a`; place in `b`) of the paragraphs that differ.

    A place is (section, paragraph within it); a changed paragraph is removed and added.
    """
    x, y = Tree(a), Tree(b)
    if x.root == y.root:
        return []
    sections, paragraphs, _ = walk(x, y)
    same = [{i for s in sections for i in range(t.children[0][s[k]], t.children[0][s[k] + 1])} | {p[k] for p in paragraphs} for k, t in enumerate((x, y))]
    gone, new = ([i for i in range(len(t.levels[1])) if i not in same[k]] for k, t in enumerate((x, y)))
    held: dict[bytes, list[int]] = {}
    for j in reversed(new):
        held.setdefault(y.levels[1][j], []).append(j)
    out: list[tuple[str, tuple[int, int] | None, tuple[int, int] | None]] = []
    moved = set()
    for i in gone:
        if held.get(x.levels[1][i]):
            j = held[x.levels[1][i]].pop()
            moved.add(j)
            out.append(("moved", x.place(i), y.place(j)))
        else:
            out.append(("removed", x.place(i), None))
    return out + [("added", None, y.place(j)) for j in new if j not in moved]


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the first as many of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _part(bounds: list[int], key: Column) -> Column:
    """How many of the sorted bounds are at most the key; looks at about 2 * sqrt(len(bounds))."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    heads = F.lit([r[0] for r in rows])
    row = F.size(F.filter(heads, lambda x: x <= key))
    within = F.element_at(F.array(*[F.lit(r) for r in rows]), F.greatest(row, F.lit(1)))
    return F.when(row == 0, 0).otherwise((row - 1) * width + F.size(F.filter(within, lambda x: x <= key)))


def compare_neighbours(docs: DataFrame, group: int = 256) -> DataFrame:
    """Fingerprints of each row and of its edit by the next row, in the order of doc_id.

    Texts are shuffled once, to ranges of doc_id (rows without one: of their text's hash);
    the first row of each range also goes to the range before it, and the first row of all
    to the last.
    """
    spark = docs.sparkSession
    rows = X.plain(docs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, named = rows.agg(F.count("*"), F.count("doc_id")).first()
    bounds = sorted({int(b) for b in rows.select("doc_id").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    key, part = F.col("doc_id"), _part(bounds, F.col("doc_id"))
    if total > named:
        unnamed = -(-n * (total - named) // total)
        hashed = F.xxhash64(F.coalesce("text", F.lit("")))
        key = F.when(F.col("doc_id").isNull(), hashed).otherwise(F.col("doc_id"))
        share = F.floor((hashed.cast("double") / 2.0**64 + 0.5) * unnamed)
        part = F.when(F.col("doc_id").isNull(), F.least(share, F.lit(unnamed - 1))).otherwise(part + unnamed)
    rows = rows.withColumn("key", key).withColumn("part", part.cast("int"))
    heads = {r.part: r.head for r in rows.groupBy("part").agg(F.min("key").alias("head")).collect()}  # one row a range
    order = sorted(heads)
    if order:
        before = dict(zip(order, [order[-1], *order[:-1]], strict=True))
        every = range(order[-1] + 1)
        head = F.get(F.lit([heads.get(p, 0) for p in every]), F.col("part"))
        own = F.struct(F.col("part"), F.lit(0).alias("tail"))
        tail = F.struct(F.get(F.lit([before.get(p, 0) for p in every]).cast("array<int>"), F.col("part")).alias("part"), F.lit(1).alias("tail"))
        sent = rows.withColumn("to", F.explode(F.when(F.col("key") == head, F.array(own, tail)).otherwise(F.array(own)))).select("doc_id", "text", "key", "to.part", "to.tail")
    else:
        sent = rows.withColumn("tail", F.lit(0)).select("doc_id", "text", "key", "part", "tail")
    sent = sent.repartition(n, "part").sortWithinPartitions("part", "tail", "key", F.xxhash64("text")).select("part", "tail", "doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def compare(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows 0..len(ids) - 1, whose successors are rows 1..len(ids)."""
        own = fingerprints(texts)
        changed = [edited(a, b) for a, b in pairwise(texts)]
        other = fingerprints(changed)
        trees = [Tree(f) for f in own]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array(own[:-1]),
                pa.array(other),
                pa.array([_alike(a, Tree(f)) for a, f in zip(trees, other, strict=False)], pa.float64()),
                pa.array([_alike(a, b) for a, b in pairwise(trees)], pa.float64()),
            ],
            schema=schema,
        )

    def run(batches):
        ids, texts, size, at, ended = [], [], 0, None, False
        for b in batches:
            for p, tail, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if p != at:
                    ids, texts, size, at, ended = [], [], 0, p, False
                if ended:
                    continue  # further rows that share the first id of the next range
                t = t.as_py() or ""
                texts.append(t)
                if tail:
                    ended = True
                else:
                    ids.append(i.as_py())
                size += len(t)
                if tail or (len(texts) > group or size > X.CHUNK) and len(texts) > 1:
                    if len(texts) > 1:
                        yield compare(ids[: len(texts) - 1], texts)
                    ids, texts, size = ids[len(texts) - 1 :], texts[-1:], len(t)

    return sent.mapInArrow(run, _SCHEMA)
