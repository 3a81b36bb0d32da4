"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the 13-word windows of benchmark items (an item with fewer words is one
window).  For each pattern length, blocks of two words have a shift table: a block that
ends no pattern moves the search on by as much as no pattern can begin earlier, and an
unknown block by the most.  Where the shift is zero, the bucket of the suffix and prefix
hashes gives the test strings, and comparing them word by word, byte by byte, confirms them.

Many stretches of text advance in step, so that each move is one vector operation.
The benchmark is cut into blocks of at most `block_words` words; each block's tables are
broadcast (bounded by that parameter) and applied one after the other without a shuffle.
At most `passes` of them are held at once: then what is found so far is written, and they go.

Defined results: a null text has no words; a null item text has no window; an item
without id is searched for but not listed; items that share an id count once; a null
doc_id is carried through; equal rows give equal results; empty tables are fine;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textcore as X

WINDOW = 13
STRETCH = 256
_EMPTY = hashlib.sha256(b"").hexdigest()


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return X.mix(a * X.U(0x9FB21C651E98DF25) + b)


class Words:
    """The words of texts: folded bytes, spans, codes and each row's first word."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = X.FOLD[data]
        self.starts, ends, self.first = X.words(data, off, X.ALNUM)
        self.size = ends - self.starts
        self.codes = X.span_hashes(self.data, self.starts, ends)

    def same(self, at: np.ndarray, other: Words, to: np.ndarray, length: int) -> np.ndarray:
        """Whether the `length` words from at[i] on are those of `other` from to[i] on."""
        x, y = ((i[:, None] + np.arange(length)).ravel() for i in (at, to))
        equal = self.size[x] == other.size[y]
        equal[equal] = X.same_spans(self.data, self.starts[x[equal]], other.data, other.starts[y[equal]], self.size[x[equal]])
        return equal.reshape(len(at), length).all(axis=1)


class Tables:
    """Shift table and buckets of the patterns of one length."""

    def __init__(self, words: Words, at: np.ndarray, item: np.ndarray, length: int):
        self.words, self.length = words, length
        codes = words.codes
        self.block = min(2, length)
        self.most = length - self.block + 1
        rows = at[:, None] + np.arange(length)
        ends = np.arange(self.block - 1, length)
        blocks = self._blocks(codes, rows[:, ends])
        shifts = np.broadcast_to(length - 1 - ends, blocks.shape)
        order = np.lexsort((shifts.ravel(), blocks.ravel()))
        key = blocks.ravel()[order]
        first = np.r_[True, key[1:] != key[:-1]]
        self.keys, self.shift = key[first], shifts.ravel()[order][first]
        bucket = self._bucket(codes, at + length - 1)
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.at, self.item = bucket[order], at[order], item[order]

    def _blocks(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return codes[ends] if self.block == 1 else _pair(codes[ends - 1], codes[ends])

    def _bucket(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        starts = ends - self.length + 1
        return _pair(self._blocks(codes, ends), self._blocks(codes, starts + self.block - 1))

    def search(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, item) of every occurrence."""
        codes, first = text.codes, text.first
        ends = first[1:]
        begin = first[:-1] + self.length - 1
        rows = np.flatnonzero(begin < ends)
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pieces = -(-(ends[rows] - begin[rows]) // STRETCH)
        nth = X.ranges(np.zeros(len(rows), np.int64), pieces)
        pos = np.repeat(begin[rows], pieces) + nth * STRETCH
        stop = np.minimum(pos + STRETCH, np.repeat(ends[rows], pieces))
        found = []
        last = len(self.keys) - 1
        while len(pos):
            block = self._blocks(codes, pos)
            k = np.minimum(np.searchsorted(self.keys, block), last)
            shift = np.where(self.keys[k] == block, self.shift[k], self.most)
            hit = shift == 0
            if hit.any():
                found.append(pos[hit])
                shift = np.where(hit, 1, shift)
            pos = pos + shift
            live = pos < stop
            pos, stop = pos[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end = np.concatenate(found)
        key = self._bucket(codes, end)
        low, high = np.searchsorted(self.bucket, key, "left"), np.searchsorted(self.bucket, key, "right")
        start = np.repeat(end - self.length + 1, high - low)
        test = X.ranges(low, high - low)
        same = np.ones(len(start), bool)
        for k in range(self.length):
            same &= codes[start + k] == self.words.codes[self.at[test] + k]
        start, test = start[same], test[same]
        same = text.same(start, self.words, self.at[test], self.length)
        return start[same], self.item[test][same]


class Patterns:
    """The windows of a block of items; names[i] is None for an item without id."""

    def __init__(self, texts: list[str | None], names: list[str | None], window: int = WINDOW):
        self.names = names
        words = Words(*X.raw(pa.array([t or "" for t in texts], pa.large_string())))
        n = np.diff(words.first)
        begin = np.cumsum(n) - n
        self.tables = []
        size = np.minimum(n, window)
        for length in np.unique(size[size > 0]):
            which = np.flatnonzero(size == length)
            count = n[which] - length + 1
            self.tables.append(Tables(words, X.ranges(begin[which], count), np.repeat(which, count), int(length)))

    def search(self, text: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(covered per word, row of each found pair, its item)."""
        step = np.zeros(len(text.codes) + 1, np.int64)
        rows, items = [], []
        for t in self.tables:
            start, item = t.search(text)
            np.add.at(step, start, 1)
            np.add.at(step, start + t.length, -1)
            rows.append(np.searchsorted(text.first, start, "right") - 1)
            items.append(item)
        none = np.zeros(0, np.int64)
        return np.cumsum(step[:-1]) > 0, np.concatenate([none, *rows]), np.concatenate([none, *items])


def _blocks(benchmark: DataFrame, block_words: int, window: int) -> Iterator[Patterns]:
    texts, names, size = [], [], 0
    for r in benchmark.selectExpr("cast(item_id as string) as item_id", "cast(text as string) as text").toLocalIterator():
        texts.append(r.text)
        names.append(r.item_id)
        size += len((r.text or "").encode()) // 2 + 1  # no fewer than its words
        if size >= block_words:
            yield Patterns(texts, names, window)
            texts, names, size = [], [], 0
    yield Patterns(texts, names, window)


def _covered(patterns: Patterns, column: pa.Array):
    """(lo, hi, first, covered, rows, items) of each chunk of a text column."""
    for lo, hi, data, off in X.chunks(column):
        text = Words(data, off)
        yield lo, hi, text.first, *patterns.search(text)


def _sums(covered: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(covered)]
    return total[first[1:]] - total[first[:-1]]


_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 1 << 20, passes: int = 16) -> DataFrame:
    """One row per row of `docs`: its words, those within occurrences, and the items found.

    contaminated: at least one word in twenty is within an occurrence.
    """
    sc = docs.sparkSession.sparkContext
    state = "doc_id long, text string, hit binary, items array<string>"

    def scan(held, last: bool, begun: bool):
        fields = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("hit", pa.binary()), ("items", pa.list_(pa.string()))])

        def run(batches):
            patterns = held.value
            for b in batches:
                n = b.num_rows
                words, hits = np.zeros(n, np.int64), np.zeros(n, np.int64)
                items: list[list[str]] = [list(x or ()) for x in b.column(3).to_pylist()] if begun else [[] for _ in range(n)]
                masks = b.column(2).to_pylist() if begun else [None] * n
                for lo, hi, first, covered, rows, found in _covered(patterns, b.column(1)):
                    for i, k in {(int(i), int(k)) for i, k in zip(rows, found, strict=True)}:
                        if patterns.names[k] is not None:
                            items[lo + i].append(patterns.names[k])
                    if begun:
                        for i in range(lo, hi):
                            if masks[i]:
                                covered[first[i - lo] : first[i - lo + 1]] |= np.unpackbits(np.frombuffer(masks[i], np.uint8), count=first[i - lo + 1] - first[i - lo]).astype(bool)
                    words[lo:hi], hits[lo:hi] = np.diff(first), _sums(covered, first)
                    if not last:
                        for i in np.flatnonzero(hits[lo:hi]):
                            masks[lo + i] = np.packbits(covered[first[i] : first[i + 1]]).tobytes()
                if last:
                    named = [sorted(set(x)) for x in items]
                    sha = [hashlib.sha256(",".join(x).encode()).hexdigest() if x else _EMPTY for x in named]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(hits), pa.array([len(x) for x in named], pa.int64()), pa.array(sha, pa.string()), pa.array((hits > 0) & (20 * hits >= words))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), pa.array(masks, pa.binary()), pa.array(items, pa.list_(pa.string()))], schema=fields)

        return run

    out, held, staged, before = X.plain(docs), [], X.Staged(docs.sparkSession), None
    blocks = _blocks(benchmark, block_words, window)
    block, begun = next(blocks), False
    while block is not None:
        after = next(blocks, None)
        held.append(sc.broadcast(block))
        out = out.mapInArrow(scan(held[-1], after is None, begun), _SCHEMA if after is None else state)
        if len(held) == passes and after is not None:
            out = staged.write(out)
            staged.drop(before)
            before = out
            for b in held:
                b.destroy()
            held = []
        block, begun = after, True
    return out


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 1 << 20) -> DataFrame:
    """The rows of `docs`, all columns, that are not contaminated."""
    some = _blocks(benchmark, block_words, window)
    first, more = next(some), next(some, None)
    at = docs.columns.index("text")
    if more is not None:
        row = "_row"
        while row in docs.columns:
            row += "_"
        rows = docs.withColumn(row, X.row_id())
        judged = contamination(rows.select(F.col(row).alias("doc_id"), "text"), benchmark, window, block_words)
        return rows.join(judged.where("contaminated").select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(*docs.columns)
    held = docs.sparkSession.sparkContext.broadcast(first)

    def run(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for lo, hi, first, covered, _, _ in _covered(held.value, b.column(at)):
                hits = _sums(covered, first)
                keep[lo:hi] = (hits == 0) | (20 * hits < np.diff(first))
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(X.tidy(run), docs.schema)
