"""Best-fit packing with certified repacking.

Token counts are packed into sequences of `capacity` tokens.  Every partition packs its
pieces by best-fit decreasing and certifies its bin count with lower bounds from dual
feasible functions.  Partitions whose count exceeds their bound put the pieces of their
unfilled bins, certified ones those of their emptiest bin, into a common pool, which is
dealt anew to fewer partitions and packed again.  Rounds end when the count of all bins
equals the bound of all pieces (which the counts of their lengths give), or when one
partition has packed the whole pool; a round that frees no bin doubles the partitions' size
for the next, up to eight times.  Every piece tells the bound and the bins of the whole.

Defined results: a null or empty text is the single id 0; only documents beyond the
capacity are cut, into pieces of the capacity and a last one that may be shorter; a null
doc_id is carried through; equal rows are packed one by one; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textcore as X

CAPACITY = 2048
END = 0


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ends = np.zeros(t.get_vocab_size(), bool)
    ends[[i for w, i in t.get_vocab().items() if w.endswith("</w>")]] = True
    return t, ends


#: Bytes: 0 white space, 1 ASCII letters and digits, 2 ASCII punctuation but the apostrophe, 3 the rest
_KIND = np.full(256, 3, np.uint8)
_KIND[0x21:0x7F] = 2
_KIND[ord("'")] = 3
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
#: Bytes of which a unit must consist to be a single word of the tokenizer
_SINGLE = _KIND.copy()
_SINGLE[0x30:0x3A] = 3


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of stretches that the tokenizer treats on their own.

    It drops white space and never joins letters or digits with punctuation; only the
    apostrophe (contractions) and what lies beyond ASCII stay with their neighbours.
    """
    kind = _KIND[data]
    n = len(data)
    before = np.zeros(n, np.uint8)
    before[1:] = kind[:-1]
    before[off[:-1][off[:-1] < n]] = 0
    starts = np.flatnonzero((kind != 0) & ((before == 0) | (before + kind == 3) & (before != 3) & (kind != 3)))
    after = np.zeros(n, np.uint8)
    after[:-1] = kind[1:]
    after[off[1:][off[1:] > 0] - 1] = 0
    ends = np.flatnonzero((kind != 0) & ((after == 0) | (after + kind == 3) & (after != 3) & (kind != 3))) + 1
    return starts, ends, np.searchsorted(starts, off)


class Encoder:
    """Ids of texts, unit by unit (see `units`), each distinct unit once.

    Units of one word each are encoded together and told apart by the marks of word
    ends; others are joined by a special token; where the tokenizer splits otherwise, units
    are encoded one by one.  A text that contains special tokens itself is encoded directly.
    Units are found again by their hash and compared with the bytes that were encoded; a
    chunk in which two units share a hash is encoded directly.
    """

    def __init__(self, path: str, held: int = 1 << 20):
        self.tokenizer, self.ends = _tokenizer(path)
        self.held = held
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.size, self.ids = np.zeros(0, X.U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        #: Bytes of the known units, and where each one lies
        self.known, self.at, self.length = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _call(self, words: list[str], joint: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(joint.join(words), add_special_tokens=False).ids, np.uint32)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
        return np.array([i for g in got for i in g], np.uint32), np.array([len(g) for g in got], np.int64)

    def _learn(self, keys: np.ndarray, words: list[str], single: np.ndarray) -> None:
        ids, sizes = [self.ids], []
        order = np.argsort(~single, kind="stable")
        plain = int(single.sum())
        for lo in range(0, len(words), 4096):
            part = [words[i] for i in order[lo : min(lo + 4096, plain) if lo < plain else lo + 4096]]
            if lo < plain:
                more = [words[i] for i in order[plain : lo + 4096]]
                got = self._call(part, " ")
                cut = np.flatnonzero(self.ends[got])
                size = np.diff(np.r_[-1, cut])
                if len(cut) != len(part) or size.sum() != len(got):
                    got, size = self._each(part)
                sizes.append(size)
                ids.append(got)
                part = more
            if part:
                got = self._call(part, self.mark)
                cut = np.flatnonzero(got == self.mark_id)
                size = np.diff(np.r_[-1, cut, len(got)]) - 1
                got = got[got != self.mark_id]
                if len(cut) != len(part) - 1:
                    got, size = self._each(part)
                sizes.append(size)
                ids.append(got)
        size = np.concatenate(sizes)
        begin = len(self.ids) + np.cumsum(size) - size
        text = [words[i].encode() for i in order]
        length = np.array([len(w) for w in text], np.int64)
        at = len(self.known) + np.cumsum(length) - length
        self.known = np.concatenate([self.known, np.frombuffer(b"".join(text), np.uint8)])
        keys = keys[order]
        order = np.argsort(all_keys := np.concatenate([self.keys, keys]), kind="stable")
        self.keys, self.begin, self.size = all_keys[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order]
        self.at, self.length = np.concatenate([self.at, at])[order], np.concatenate([self.length, length])[order]
        self.ids = np.concatenate(ids)

    def _direct(self, buffer: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array([*self.tokenizer.encode(buffer[a:b].decode(), add_special_tokens=False).ids, END], np.uint32) for a, b in zip(off[:-1], off[1:], strict=True)]
        return np.concatenate(each), np.r_[0, np.cumsum([len(x) for x in each])]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): those of row i, with the end id, are bounds[i]..bounds[i+1]."""
        buffer = data.tobytes()
        if b"<|" in buffer:
            return self._direct(buffer, off)
        starts, ends, first = units(data, off)
        folded = X.FOLD[data]
        codes = X.span_hashes(folded, starts, ends)
        unique, where, inverse = np.unique(codes, return_index=True, return_inverse=True)
        k = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
        new = self.keys[k] != unique if len(self.keys) else np.ones(len(unique), bool)
        if new.any():
            if len(self.keys) > self.held:
                self.clear()
                new = np.ones(len(unique), bool)
            a, b, lower = starts[where[new]], ends[where[new]], folded.tobytes()
            odd = np.r_[0, np.cumsum(_SINGLE[data] == 3)]
            self._learn(unique[new], [lower[x:y].decode() for x, y in zip(a, b, strict=True)], odd[a] == odd[b])
        k = np.searchsorted(self.keys, unique)[inverse] if len(unique) else np.zeros(0, np.int64)
        length = ends - starts
        if not ((self.length[k] == length).all() and X.same_spans(self.known, self.at[k], folded, starts, length).all()):
            return self._direct(buffer, off)
        size = np.r_[0, np.cumsum(self.size[k])]
        bounds = size[first] + np.arange(len(off))
        out = np.full(bounds[-1], END, np.uint32)
        ids = self.ids[X.ranges(self.begin[k], self.size[k])]
        row = np.repeat(np.arange(len(off) - 1), np.diff(size[first]))
        out[np.arange(len(ids)) + row] = ids
        return out, bounds


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def run(batches):
        encoder = Encoder(path)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            valid = np.asarray(b.column(0).is_valid())
            for lo, hi, data, off in X.chunks(b.column(1)):
                tokens, bounds = encoder.encode(data, off)
                count = -(-np.diff(bounds) // capacity)
                row = np.repeat(np.arange(hi - lo), count)
                piece = X.ranges(np.zeros(hi - lo, np.int64), count)
                start = piece * capacity
                begin = bounds[row] + start
                end = np.minimum(begin + capacity, bounds[row + 1])
                little = tokens.astype("<u4")
                crc = np.fromiter((zlib.crc32(little[x:y]) for x, y in zip(begin, end, strict=True)), np.int64, len(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.where(valid, np.nan_to_num(ids), 0).astype(np.int64)[lo + row] if not valid.all() else ids[lo + row], pa.int64(), mask=~valid[lo + row]), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(end - begin), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return X.plain(docs).mapInArrow(X.tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin of each piece, offset in it, fill of each bin)."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while some open bin has room r
    for i in order:
        size = int(lengths[i])
        above = rooms >> size
        if above:
            room = size + ((above & -above).bit_length() - 1)
            k = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
        else:
            k, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = k, fill[k]
        fill[k] += size
        if left := room - size:
            open_by_room[left].append(k)
            rooms |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of the lower bounds that dual feasible functions give for the bin count."""
    return lower_bound_of(*np.unique(lengths, return_counts=True), capacity)


def lower_bound_of(size: np.ndarray, count: np.ndarray, capacity: int) -> int:
    """The same from how often each length occurs."""
    if not len(size):
        return 0
    best = -(-int((size * count).sum()) // capacity)
    # u(k): multiples of the share x = size / capacity, rounded so that no bin exceeds k
    for k in range(1, 32):
        whole = (k + 1) * size
        value = np.where(whole % capacity == 0, whole * k, (whole // capacity) * capacity * (k + 1))
        best = max(best, -(-int((value * count).sum()) // (capacity * k * (k + 1))))
    # large pieces count as whole bins, small ones under a threshold not at all
    for t in np.unique(np.minimum(size[size <= capacity // 2], capacity // 2)):
        value = np.where(size > capacity - t, capacity, np.where(size >= t, size, 0))
        best = max(best, -(-int((value * count).sum()) // capacity))
    return best


_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"


def _packed(dealt: DataFrame, capacity: int, turn: int) -> DataFrame:
    """Packs each part; `open` marks the pieces of unfilled bins of parts with a gap.

    A certified part gives away its emptiest bin alone, the share that its bound rounds up.
    """

    def run(key, t):
        part = key[0].as_py()
        length = t.column("length").to_numpy()
        bins, offsets, fill = best_fit(length, capacity)
        gap = len(fill) > lower_bound(length, capacity)
        sequence = (np.int64(turn) << 48) | (np.int64(part) << 24) | bins
        loose = (fill[bins] < capacity) & (gap | (bins == fill.argmin()))
        return pa.Table.from_arrays([*(t.column(f).combine_chunks() for f in _COLUMNS), pa.array(sequence), pa.array(offsets), pa.array(loose)], names=[*_COLUMNS, "sequence_id", "offset", "open"])

    return dealt.groupBy("part").applyInArrow(X.tidy_group(run), _PACKED)


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    return df.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(parts)))


def pack(cut: DataFrame, capacity: int = CAPACITY, part_size: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (see `pieces`), and bins and bound of all of them."""
    staged = X.Staged(cut.sparkSession)
    cut = staged.write(cut)
    counts = {int(r["length"]): int(r["count"]) for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    bound = lower_bound_of(np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64), capacity)
    total, closed, turn, wider = sum(counts.values()), 0, 0, 1
    done, pool, before = [], cut, None
    while True:
        parts = max(1, -(-total // (part_size * wider)))
        packed = staged.write(_packed(_dealt(pool, parts), capacity, turn), share=2)
        bins = packed.groupBy("open").agg(F.count("*").alias("n"), F.count_distinct("sequence_id").alias("bins"))
        stat = {r.open: (r.n, r.bins) for r in bins.collect()}
        n, opened = stat.get(True, (0, 0))
        closed += stat.get(False, (0, 0))[1]
        stuck = before is not None and opened >= before
        if not n or parts == 1 or closed + opened <= bound or stuck and wider == 8:
            done.append(packed)
            break
        done.append(packed.where("not open"))
        wider = 2 * wider if stuck else wider
        pool, total, before, turn = packed.where("open").select(*_COLUMNS), n, opened, turn + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*_COLUMNS, "sequence_id", "offset", F.lit(closed + opened).cast("long").alias("bins"), F.lit(bound).cast("long").alias("bound"))
