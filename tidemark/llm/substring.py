"""Substring dedup by seed and extend.

Seeds: every window of `window` words picks the smallest hash among its `seed`-word runs
(the rightmost of equals) as its anchor, so equal windows of any two documents pick the
same anchor.  Neighbouring windows with one anchor form a unit; documents are joined on
their anchors, and an anchor that only one document holds ends there.

Extension: a unit's whole stretch (its windows extended both ways as far as the anchor
reaches) is compared first.  If an earlier document holds the same stretch, all windows
of the unit repeat.  Only units that are the first of their stretch, but whose anchor
occurs elsewhere, are compared window by window; the first copy of any window always is
among these, so nothing is lost and a group of copies contributes its windows once.
Neighbouring repeated windows run together to the maximal repeats, whose words go.

Keys are pairs of 64-bit hashes (anchor, and stretch or window) over differently seeded
word codes.  No group of copies is ever gathered in one place: groups are reduced to
their smallest doc_id by aggregation, and anchors, stretches and windows that hold more
than a fair part of the rows are looked up in a bounded list (`textcore.looked_up`).

Defined results: a null text has no words; a document with a null doc_id is neither a
source nor reduced; rows with an equal doc_id are not sources for each other; equal rows
give equal results; empty tables give empty tables; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textcore as X


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For each i, the position of the smallest of grams[i : i + span], the rightmost of equals."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, width = np.arange(len(grams)), 1
    while width < span:
        shift = min(width, span - width)
        left, right = best[:-shift], best[shift:]
        best = np.where(grams[left] < grams[right], left, right)
        width += shift
    return best[:n]


class Units:
    """The units of a chunk of documents: windows that share their anchor."""

    def __init__(self, data: np.ndarray, off: np.ndarray, window: int, seed: int):
        starts, ends, self.first = X.words(data, off)
        codes = X.word_hashes(data, starts, ends, False)
        self.window, self.words = window, X.Runs(X.mix(codes ^ X.U(0x6A09E667F3BCC909)))
        grams = X.gram_hashes(codes, seed)
        at = anchors(grams, window - seed + 1)
        counts = np.maximum(np.diff(self.first) - window + 1, 0)
        #: Starts of all windows, and their rows
        self.starts = X.ranges(self.first[:-1], counts)
        rows = np.repeat(np.arange(len(counts)), counts)
        anchor = at[self.starts]
        new = np.ones(len(rows), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
        begin = np.flatnonzero(new)
        self.row = rows[begin]
        #: Windows from..to of each unit, among all windows
        self.low, self.high = begin, np.r_[begin[1:], len(rows)]
        self.anchor = grams[anchor[begin]] if len(begin) else np.zeros(0, X.U)
        self.stretch = self.words.hash(self.starts[self.low], self.starts[self.high - 1] + window - self.starts[self.low]) if len(begin) else np.zeros(0, X.U)
        #: Number of the unit within its row
        row_first = np.searchsorted(self.row, np.arange(len(counts) + 1))
        self.bounds = row_first
        self.number = np.arange(len(begin)) - row_first[self.row]


def repeats(docs: DataFrame, window: int = 50, seed: int = 10) -> tuple[DataFrame, DataFrame, X.Staged]:
    """(documents by row, repeated windows by row, the tables to drop).

    The second has row, units (numbers of units that repeat as a whole) and windows
    (offsets of single windows that repeat).
    """
    if not 0 < seed <= window:
        raise ValueError("seed must be within the window")
    staged = X.Staged(docs.sparkSession)
    rows = X.plain(docs).withColumn("row", X.row_id()).select("doc_id", "row", "text")

    def seeds(batches):
        for b in batches:
            ids, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for lo, _, data, off in X.chunks(b.column(2)):
                u = Units(data, off, window, seed)
                i = lo + u.row
                yield pa.RecordBatch.from_arrays([pa.array(ids[i].astype(np.int64)), pa.array(keys[i]), pa.array(u.number.astype(np.int32)), pa.array(X.signed(u.anchor)), pa.array(X.signed(u.stretch))], names=["doc_id", "row", "unit", "anchor", "stretch"])

    sources = rows.where(F.col("doc_id").isNotNull())
    units = staged.write(sources.mapInArrow(seeds, "doc_id long, row long, unit int, anchor long, stretch long"))
    stretches = units.groupBy("anchor", "stretch").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("held"))
    total = units.count()
    shared = stretches.groupBy("anchor").agg(F.min("low").alias("a"), F.max("high").alias("z"), F.count("*").alias("held")).where("a < z").select("anchor", "held")
    held = staged.write(X.looked_up(stretches.withColumnRenamed("held", "rows"), shared, ["anchor"], total).select("anchor", "stretch", "low", F.col("rows").alias("held")), share=2)
    judged = X.looked_up(units, held, ["anchor", "stretch"], total).select("row", (F.col("unit") * 2 + (F.col("low") < F.col("doc_id")).cast("int")).alias("mark"))
    marks = judged.groupBy("row").agg(F.collect_set("mark").alias("marks"))
    marks = staged.write(marks.select("row", F.filter("marks", lambda m: m % 2 == 1).alias("whole"), F.filter("marks", lambda m: m % 2 == 0).alias("parts")), share=8)

    def windows(batches):
        for b in batches:
            ids, keys, parts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            for lo, hi, data, off in X.chunks(b.column(2)):
                u = Units(data, off, window, seed)
                wanted = [np.asarray(parts[i].as_py(), np.int64) // 2 + u.bounds[i - lo] for i in range(lo, hi)]
                k = np.sort(np.concatenate(wanted))
                w = X.ranges(u.low[k], (u.high - u.low)[k])
                rows = np.repeat(u.row[k], (u.high - u.low)[k])
                start = u.starts[w]
                hashes = u.words.hash(start, window)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + rows]), pa.array(keys[lo + rows]), pa.array((start - u.first[rows]).astype(np.int32)), pa.array(X.signed(np.repeat(u.anchor[k], (u.high - u.low)[k]))), pa.array(X.signed(hashes))], names=["doc_id", "row", "at", "anchor", "hash"])

    parted = rows.join(marks.where("size(parts) > 0").select("row", "parts"), "row").select("doc_id", "row", "text", "parts")
    single = staged.write(parted.mapInArrow(windows, "doc_id long, row long, at int, anchor long, hash long"), share=4)
    firsts = single.groupBy("anchor", "hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("held")).where("low < high").drop("high")
    firsts = staged.write(firsts, share=4)
    later = X.looked_up(single, firsts, ["anchor", "hash"], single.count()).where("low < doc_id").groupBy("row").agg(F.collect_set("at").alias("windows"))
    found = marks.where("size(whole) > 0").select("row", "whole").join(later, "row", "full")
    return rows, found, staged


_REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def deduplicate(docs: DataFrame, window: int = 50, seed: int = 10, texts: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text."""
    rows, found, _ = repeats(docs, window, seed)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def finish(batches):
        for b in batches:
            n = b.num_rows
            words, removed = np.zeros(n, np.int64), np.zeros(n, np.int64)
            sha, kept = [""] * n, [None] * n
            whole, single = b.column(2), b.column(3)
            for lo, hi, data, off in X.chunks(b.column(1)):
                u = None
                for i in range(lo, hi):
                    text = data[off[i - lo] : off[i - lo + 1]].tobytes().split()
                    words[i] = len(text)
                    if whole[i].is_valid or single[i].is_valid:
                        u = u or Units(data, off, window, seed)
                        step = np.zeros(len(text) + 1, np.int64)
                        k = np.asarray(whole[i].as_py() or [], np.int64) // 2 + u.bounds[i - lo]
                        first = u.first[i - lo]
                        np.add.at(step, u.starts[u.low[k]] - first, 1)
                        np.add.at(step, u.starts[u.high[k] - 1] + window - first, -1)
                        at = np.asarray(single[i].as_py() or [], np.int64)
                        np.add.at(step, at, 1)
                        np.add.at(step, at + window, -1)
                        gone = np.cumsum(step[:-1]) > 0
                        removed[i] = gone.sum()
                        text = [text[j] for j in np.flatnonzero(~gone)]
                    joined = b" ".join(text)
                    sha[i] = hashlib.sha256(joined).hexdigest()
                    if texts:
                        kept[i] = joined.decode()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(removed), pa.array(sha, pa.string()), pa.array(kept, pa.string())], schema=schema)

    joined = rows.join(found, "row", "left").select("doc_id", "text", "whole", "windows")
    out = joined.mapInArrow(finish, _REMOVED)
    return out if texts else out.drop("kept")
