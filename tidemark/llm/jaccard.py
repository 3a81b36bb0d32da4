"""N-gram Jaccard join in the metric space of shingle sets.

The Jaccard distance is a metric, and almost all pairs of documents lie at distance 1,
so the first pivots are single shingles, in one fixed order with frequent ones last: a
document is nearest to the shingles that it holds, and its Voronoi region is that of
the first.  A partner within the radius may lack the first ones, but not all of the first
`n - ceil(t n) + 1`; so boundary documents are replicated to just these regions, and two
linked documents always meet.

Regions with the same most central document become one region around that document.
Within a region documents are the pivots, whatever its size: members go to the nearest
one and, by the triangle inequality, also to every pivot that is at most two radii farther;
a pivot's links with all members are known from its distances, members that one pivot has
linked are of one component and need no comparison among themselves, and what remains is
joined in the same way until nothing does (`region_links`).

A region that fits into one task (`block` members and `cells` shingles) is joined there;
one of at most `FEW` members is first cleared of those that the number of shared first
shingles rules out, so that only sets with a hope are sent.  A larger one is recursed into by all tasks (`divide`): its members are
dealt out in slices, each of which gets the pivots' sets, so every set is sent once a
round.  Near copies are in one component after the first round.  What has not shrunk
after `ROUNDS` rounds is dealt out as pairs of blocks, each of one known component, without
pairs of blocks of the same one.

Equal sets form one class and take part once.  Frequent shingles come from a bounded
list (`frequent`), which only sets the order and spreads their replicas over all tasks.

Defined results: a null or wordless text has an empty set and is linked with nothing;
a null doc_id takes part, but never names a component (a component of such rows only has
a null id); equal rows are linked like other copies; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textcore as X
from tidemark.llm.components import components
from tidemark.llm.shingles import Sets, by_row

_CHUNK = 2 << 20
#: Pivots of a region, and rounds of a region that no task holds
PIVOTS, ROUNDS = 8, 3
#: Members of a region up to which all pairs are looked at by their first shingles
FEW = 1024
#: Packed columns of a bucket
_BLOBS = {"cells": np.uint64, "classes": np.int64, "ranks": np.uint8, "homes": np.int64, "sizes": np.int32, "marks": np.uint32}


class _Once:
    """Whether a class comes for the first time, as far as a task remembers."""

    def __init__(self, most: int = 1 << 21):
        self.seen: set[int] = set()
        self.most = most

    def first(self, identity: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if len(self.seen) > self.most:
            self.seen.clear()
        out = []
        for i in np.flatnonzero(wanted):
            k = int(identity[i])
            if k not in self.seen:
                self.seen.add(k)
                out.append(i)
        return np.array(out, np.int64)


def profile(docs: DataFrame, size: int, key: Column | None = None) -> DataFrame:
    """Rows doc_id, class, n (and key) of all documents, and (hot) local counts of repeated shingles."""
    keyed = [("key", pa.int64())] if key is not None else []
    schema = pa.schema([("doc_id", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("hot", pa.bool_()), *keyed])

    def run(batches):
        once = _Once()
        for b in batches:
            for lo, hi, data, off in X.chunks(b.column(1), _CHUNK):
                s = Sets(data, off, size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(X.signed(s.identity), mask=s.sizes == 0), pa.array(s.sizes), pa.array(np.zeros(hi - lo, bool)), *(b.column(2).slice(lo, hi - lo) for _ in keyed)], schema=schema)
                new = once.first(s.identity, s.sizes > 0)
                code, count = np.unique(s.codes[X.ranges(s.first[new], s.sizes[new])], return_counts=True)
                code, count = code[count > 1], count[count > 1]
                if len(code):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(code), pa.int64()), pa.array(X.signed(code)), pa.array(count.astype(np.int64)), pa.array(np.ones(len(code), bool)), *(pa.nulls(len(code), pa.int64()) for _ in keyed)], schema=schema)

    more = [key.alias("key")] if keyed else []
    return X.plain(docs, *more).mapInArrow(X.tidy(run), "doc_id long, class long, n long, hot boolean" + ", key long" * len(keyed))


def _needed(n, num: int, den: int):
    """How many shingles a set of n must share at least with a linked one."""
    return -(-(num * n) // den)


def regions(docs: DataFrame, hot: np.ndarray, num: int, den: int, size: int, buckets: int) -> DataFrame:
    """Replicas (shingle, class, rank) packed by bucket, and each class's size and marks.

    A frequent shingle's replicas are dealt to all buckets by their class.  The rank is
    lowest for classes whose first shingles are all frequent: the middle of a large
    group.  The marks are the places in the order of every sixteenth part of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def dealt(where, columns):
        order = np.argsort(where, kind="stable")
        cut = np.searchsorted(where[order], np.arange(buckets + 1))
        return lambda i: [x[order[cut[i] : cut[i + 1]]] for x in columns]

    def packed(held):
        code, identity, rank, is_hot, homes, sizes, marks = (np.concatenate(x) for x in zip(*held, strict=True))
        replicas = dealt(((np.where(is_hot, identity, code) >> X.U(20)) % X.U(buckets)).astype(np.int64), (code, identity, rank))
        profiles = dealt(((homes >> X.U(20)) % X.U(buckets)).astype(np.int64), (homes, sizes, marks))
        for lo in range(0, buckets, 64):
            part = range(lo, min(buckets, lo + 64))
            blobs = [X.binary(list(x)) for x in zip(*[replicas(i) + profiles(i) for i in part], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *blobs], names=["bucket", *_BLOBS])

    def run(batches):
        frequent, once, held, amount = shared.value, _Once(), [], 0
        for b in batches:
            for _, _, data, off in X.chunks(b.column(1), _CHUNK):
                s = Sets(data, off, size)
                new = once.first(s.identity, s.sizes > 0)
                code = s.codes[X.ranges(s.first[new], s.sizes[new])]
                row = np.repeat(np.arange(len(new)), s.sizes[new])
                is_hot = _among(frequent, code)
                key = _order(code, is_hot)
                order = by_row(row, key)
                code, row, is_hot, key = code[order], row[order], is_hot[order], key[order]
                n = s.sizes[new]
                begin = np.cumsum(n) - n
                first = n - _needed(n, num, den) + 1
                kept = X.ranges(begin, first)
                row = row[kept]
                often = np.bincount(row, is_hot[kept], len(new)) / first
                rank = (255 - np.floor(255 * often)).astype(np.uint8)
                at = np.maximum(np.arange(1, 17) * first[:, None] // 16 - 1, 0) + begin[:, None]
                marks = (key[at] >> X.U(32)).astype(np.uint32)
                held.append((code[kept], s.identity[new][row], rank[row], is_hot[kept], s.identity[new], n.astype(np.int32), marks))
                amount += len(kept)
                if amount > 1 << 21:
                    yield from packed(held)
                    held, amount = [], 0
        if amount:
            yield from packed(held)

    return X.plain(docs).mapInArrow(X.tidy(run), "bucket int, " + ", ".join(f"{c} binary" for c in _BLOBS))


def _order(codes: np.ndarray, is_hot: np.ndarray) -> np.ndarray:
    """The place of shingles in the one order of all: frequent ones last, else by hash."""
    return (X.mix(codes) >> X.U(1)) | (is_hot.astype(X.U) << X.U(63))


def _among(listed: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(codes), bool)
    return listed[np.minimum(np.searchsorted(listed, codes), len(listed) - 1)] == codes


def meeting(sent: DataFrame, hot: np.ndarray) -> DataFrame:
    """cell, class, rank, pivot of replicas that may meet another class; class, n, marks of all.

    A whole cell has its pivot, the class of the lowest rank and then the smallest;
    frequent shingles, of which a bucket holds only a share, have none yet.
    """
    shared = sent.sparkSession.sparkContext.broadcast(hot)

    def met(key, t):
        cell, identity, rank, homes, sizes, marks = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t.column(name)]) for name, kind in _BLOBS.items())
        order = np.lexsort((identity, rank, cell))
        cell, identity, rank = cell[order], identity[order], rank[order]
        new = np.ones(len(cell), bool)
        new[1:] = (cell[1:] != cell[:-1]) | (identity[1:] != identity[:-1])
        cell, identity, rank = cell[new], identity[new], rank[new]
        start = np.ones(len(cell), bool)
        start[1:] = cell[1:] != cell[:-1]
        run = np.cumsum(start) - 1
        often = _among(shared.value, cell)
        kept = (np.bincount(run, minlength=1)[run] > 1) | often
        pivot = identity[start][run]
        k, (homes, where) = int(kept.sum()), np.unique(homes, return_index=True)
        marks = marks.reshape(-1, 16)[where]
        none = pa.nulls(len(homes), pa.int64())
        parts = [
            [pa.array(X.signed(cell[kept])), pa.array(identity[kept]), pa.array(rank[kept].astype(np.int32)), pa.array(pivot[kept], mask=often[kept]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())],
            [none, pa.array(homes), pa.nulls(len(homes), pa.int32()), none, pa.array(sizes[where].astype(np.int64)), X.binary(list(marks))],
        ]
        return pa.concat_tables([pa.Table.from_arrays(p, names=["cell", "class", "rank", "pivot", "n", "marks"]) for p in parts])

    return sent.groupBy("bucket").applyInArrow(X.tidy_group(met), "cell long, class long, rank int, pivot long, n long, marks binary")


def _shared(group: np.ndarray, member: np.ndarray, cell: np.ndarray, most: int = 1 << 20):
    """(x, y, count) of members that share cells of their group.

    Comes in parts, each with all partners of some members.
    """
    order = np.lexsort((cell, group))
    g, c = group[order], cell[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    start = np.flatnonzero(new)
    length = np.diff(np.r_[start, len(g)])
    run = np.empty(len(g), np.int64)
    run[order] = np.cumsum(new) - 1
    by_member = np.argsort(member, kind="stable")
    by_member = by_member[length[run[by_member]] > 1]
    size = np.cumsum(length[run[by_member]])
    lo = 0
    while lo < len(by_member):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
        while hi < len(by_member) and member[by_member[hi]] == member[by_member[hi - 1]]:
            hi += 1
        left = by_member[lo:hi]
        n = length[run[left]]
        right = order[X.ranges(start[run[left]], n)]
        key, count = np.unique(np.repeat(member[left], n) * np.int64(1 << 32) + member[right], return_counts=True)
        x, y = key >> 32, key & 0xFFFFFFFF
        yield x[x != y], y[x != y], count[x != y]
        lo = hi


class _Others:
    """Tells pairs of members that also meet in the region of a smaller pivot, where they are judged."""

    def __init__(self, pivot: np.ndarray, lengths: np.ndarray, homes: np.ndarray):
        self.known, code = np.unique(np.concatenate([homes, pivot]), return_inverse=True)
        self.homes, self.pivot = code[: len(homes)], code[len(homes) :]
        self.first, self.lengths = np.cumsum(lengths) - lengths, lengths
        self.keys = np.repeat(np.arange(len(lengths)), lengths) * np.int64(len(self.known)) + self.homes  # ascending

    def elsewhere(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = X.ranges(self.first[x], self.lengths[x])
        pair = np.repeat(np.arange(len(x)), self.lengths[x])
        smaller = self.homes[at] < self.pivot[x[pair]]
        at, pair = at[smaller], pair[smaller]
        key = y[pair] * np.int64(len(self.known)) + self.homes[at]
        found = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
        return np.bincount(pair[found], minlength=len(x)) > 0


def _hopeful(group: np.ndarray, n: np.ndarray, marks: np.ndarray, member: np.ndarray, cell: np.ndarray, others: _Others, num: int, den: int) -> np.ndarray:
    """Members that their first shingles do not rule out to be linked with another one.

    Up to the end of the shorter reaching of two sets' first shingles both are known:
    the marks tell how many shingles each holds there at least, and the cells how
    many they share at most; all others lie in one of them only.
    """
    out = np.zeros(len(n), bool)
    first = n - _needed(n, num, den) + 1
    for x, y, c in _shared(group[member], member, cell):
        until = np.minimum(marks[x, 15], marks[y, 15])[:, None]
        held = sum((marks[z] < until).sum(axis=1) * first[z] // 16 for z in (x, y))
        alike = np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num
        likely = np.flatnonzero(alike & ((held - 2 * c) * (den + num) <= (n[x] + n[y]) * (den - num)))
        x, y = x[likely], y[likely]
        out[x[~others.elsewhere(x, y)]] = True
    return out


def members_of(met: DataFrame) -> DataFrame:
    """pivot, class: members of regions; a frequent shingle's pivot is found among all its replicas."""
    replicas = met.where("cell is not null")
    often = replicas.where("pivot is null").select("cell", "class", "rank")
    pivots = often.groupBy("cell").agg(F.min(F.struct("rank", "class"))["class"].alias("pivot"))
    return replicas.where("pivot is not null").select("pivot", "class").union(often.join(F.broadcast(pivots), "cell").select("pivot", "class")).distinct()  # at most `frequent` rows


def survivors(met: DataFrame, members: DataFrame, keyed: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of `keyed` (region, i, j, root, class, comp) that can have links within (region, i, j).

    `root` is the pivot of the region in `members` that this one is a part of.
    """
    replicas = met.where("cell is not null")
    # half of a cell's name will do for counting: a collision only makes a pair look more alike
    firsts = replicas.groupBy("class").agg(F.collect_list(F.shiftright("cell", 32).cast("int")).alias("cells")).join(met.where("cell is null").select("class", "n", "marks"), "class")
    homes = members.groupBy("class").agg(F.sort_array(F.collect_list("pivot")).alias("pivots"))
    rows = keyed.join(firsts.join(homes, "class"), "class").select("region", "i", "j", "class", "n", "marks", "cells", "pivots", "root", "comp").repartition("region", "i", "j").sortWithinPartitions("region", "i", "j")

    def run(batches):
        held, size = [], 0
        for b in batches:
            lo = 0
            keys = np.stack([b.column(k).to_numpy() for k in range(3)])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if held and b.num_rows and not any(held[-1].column(k)[-1].as_py() != keys[k, 0] for k in range(3)):
                lo = int(cut[0]) if len(cut) else b.num_rows  # the group of the batch before goes on
                held.append(b.slice(0, lo))
                size += len(held[-1].column(6).flatten())
            if size > 1 << 20 and lo < b.num_rows:
                yield from judged(held)
                held, size = [], 0
            if lo < b.num_rows:
                # whole groups only: the last one may go on in the next batch
                held.append(b.slice(lo))
                size += len(held[-1].column(6).flatten())
        if held:
            yield from judged(held)

    def judged(held):
        t = pa.Table.from_batches(held).combine_chunks()
        keys = [t.column(k).to_numpy() for k in range(3)]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        group = np.cumsum(new) - 1
        cells = t.column(6).combine_chunks()
        member = np.repeat(np.arange(t.num_rows), np.asarray(cells.value_lengths()))
        marks = np.stack([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column(5)])
        homes = t.column(7).combine_chunks()
        others = _Others(t.column(8).to_numpy(), np.asarray(homes.value_lengths()), homes.flatten().to_numpy())
        hopeful = _hopeful(group, t.column(4).to_numpy(), marks, member, cells.flatten().to_numpy(), others, num, den)
        yield from t.select([0, 1, 2, 3, 9]).filter(pa.array(hopeful)).to_batches()

    return rows.mapInArrow(X.tidy(run), "region long, i long, j long, class long, comp long")


class _Members:
    """Sets of numbered shingles, one after the other."""

    def __init__(self, codes: list[np.ndarray]):
        self.n = np.array([len(c) for c in codes], np.int64)
        self.first = np.r_[0, np.cumsum(self.n)]
        flat = np.concatenate(codes) if codes else np.zeros(0, X.U)
        distinct, self.code = np.unique(flat, return_inverse=True)
        self.mark = np.zeros(len(distinct), np.int64)

    def common(self, pivot: int, of: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the pivot with the members `of`, which are not empty."""
        own = self.code[self.first[pivot] : self.first[pivot + 1]]
        self.mark[own] = 1
        n = self.n[of]
        hits = self.mark[self.code[X.ranges(self.first[of], n)]]
        self.mark[own] = 0
        return np.add.reduceat(hits, np.cumsum(n) - n) if len(of) else np.zeros(0, np.int64)

    def product(self, pivots: np.ndarray, of: np.ndarray, width: int = 1024) -> np.ndarray:
        """The same of many pivots, as a product of matrices over the shingles that they hold."""
        out = np.zeros((len(pivots), len(of)), np.float32)
        own = self.code[X.ranges(self.first[pivots], self.n[pivots])]
        held = np.zeros(len(self.mark), bool)
        held[own] = True
        number = np.cumsum(held) - 1
        flat = self.code[X.ranges(self.first[of], self.n[of])]
        row = np.repeat(np.arange(len(of)), self.n[of])
        kept = held[flat]
        row, flat = row[kept], number[flat[kept]]
        order = np.argsort(flat, kind="stable")
        row, flat = row[order], flat[order]
        place, column = np.repeat(np.arange(len(pivots)), self.n[pivots]), number[own]
        order = np.argsort(column, kind="stable")
        place, column = place[order], column[order]
        for lo in range(0, int(held.sum()), width):
            a, b = np.zeros((len(pivots), width), np.float32), np.zeros((len(of), width), np.float32)
            for m, r, c in ((a, place, column), (b, row, flat)):
                x, y = np.searchsorted(c, [lo, lo + width])
                m[r[x:y], c[x:y] - lo] = 1
            out += a @ b.T
        return out.astype(np.int64)


def region_links(codes: list[np.ndarray], num: int, den: int, comp: np.ndarray | None = None, every: bool = False, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of a region, each linked, that join all members which links connect.

    A few pivots, each the farthest from those before, make Voronoi regions and windows,
    which are joined in the same way; where these do not get smaller, the next step takes
    eight times as many pivots at once and makes none.  `comp` names known components
    (below 0: none), whose members are not compared.  With `every` all links are returned.
    `trace` is told (pivots, members at home, in the window, in all) of each step.
    """
    held, m = _Members(codes), len(codes)
    radius, slack = 1 - num / den, 1e-9
    label = np.arange(m)
    if comp is not None:
        _, first, group = np.unique(comp, return_index=True, return_inverse=True)
        label = np.where(comp >= 0, first[group], label)
    xs, ys = [], []

    def join(pivot: int, linked: np.ndarray) -> None:
        linked = linked[linked != pivot]
        new = linked
        if not every:  # one pair for each component that the pivot joins
            new = linked[np.unique(label[linked], return_index=True)[1]]
            new = new[label[new] != label[pivot]]
        xs.append(np.full(len(new), pivot))
        ys.append(new)
        if len(new):
            joined = np.append(label[new], label[pivot])
            label[np.isin(label, joined)] = joined.min()

    def apart(home: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Which of `of` can still be new to one of `home`."""
        mine = label[home]
        return np.ones(len(of), bool) if every or (mine != mine[0]).any() else np.isin(of, home) | (label[of] != mine[0])

    everyone = np.arange(m)
    todo = [(everyone, everyone, PIVOTS)]
    while todo:
        home, of, most = todo.pop()
        if not len(home) or len(of) < 2 or not every and (label[of] == label[of[0]]).all():
            continue
        if most > PIVOTS:
            pivots = home[:most]
            both = held.product(pivots, of)
            linked = (den + num) * both >= num * (held.n[pivots][:, None] + held.n[of][None])
            for k, p in enumerate(pivots):
                join(int(p), of[linked[k]])
            rest, left = ~np.isin(of, pivots), home[most:]
            if len(left):
                rest &= apart(left, of)
                if trace is not None:
                    trace.append((len(pivots), len(left), int(rest.sum()), len(of)))
                todo.append((left, of[rest], min(8 * most, 64 * PIVOTS)))
            continue
        away, pivots = np.zeros((0, len(of))), []
        pivot = int(home[0])
        while True:
            both = held.common(pivot, of)
            n = held.n[of] + held.n[pivot]
            join(pivot, of[(den + num) * both >= num * n])
            away = np.vstack([away, 1 - both / (n - both)])
            pivots.append(pivot)
            if len(pivots) == min(most, len(home)):
                break
            far = away.min(axis=0)[np.searchsorted(of, home)]
            far[np.isin(home, pivots)] = -1
            pivot = int(home[far.argmax()])
        nearest, least = away.argmin(axis=0), away.min(axis=0)
        rest = ~np.isin(of, pivots)
        at_home = np.isin(of, home) & rest
        parts = []
        for k in range(len(pivots)):
            inner = at_home & (nearest == k)
            if not inner.any():
                continue
            window = rest & (away[k] <= least + 2 * radius + slack)
            low, high = away[:, inner].min(axis=1) - radius - slack, away[:, inner].max(axis=1) + radius + slack
            window &= ((away >= low[:, None]) & (away <= high[:, None])).all(axis=0) & apart(of[inner], of)
            parts.append((of[inner], of[window]))
            if trace is not None:
                trace.append((len(pivots), int(inner.sum()), int(window.sum()), len(of)))
        if sum(len(a) * len(b) for a, b in parts) < 0.7 * at_home.sum() * rest.sum():
            todo += [(a, b, most) for a, b in parts]
        elif parts:
            left = of[at_home]
            todo.append((left, of[rest & apart(left, of)], 8 * most))
    x, y = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (xs, ys))
    return x, y


def sets_of(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """class, codes of the needed classes, and of few others.

    A bitmap of 16 bits for each needed class, 128 MB at most, tells the readers which these
    may be; a false hit costs a set sent in vain.
    """
    shared = docs.sparkSession.sparkContext.broadcast(X.bitmap(needed.select("class")))

    def send(batches):
        once, wanted = _Once(), shared.value
        for b in batches:
            for _, _, data, off in X.chunks(b.column(1), _CHUNK):
                s = Sets(data, off, size)
                hit = X.in_bitmap(wanted, X.signed(s.identity))
                new = once.first(s.identity, hit & (s.sizes > 0))
                for lo in range(0, len(new), 256):
                    part = new[lo : lo + 256]
                    yield pa.RecordBatch.from_arrays([pa.array(X.signed(s.identity[part])), X.binary([s.codes[s.first[i] : s.first[i + 1]] for i in part])], names=["class", "codes"])

    return X.plain(docs).mapInArrow(X.tidy(send), "class long, codes binary").groupBy("class").agg(F.min("codes").alias("codes"))


def _codes(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(c.as_buffer(), np.uint64) for c in t.column("codes")]


def joined_regions(kept: DataFrame, sets: DataFrame, num: int, den: int, every: bool) -> DataFrame:
    """a, b: linked classes; of each (region, i, j) as many pairs as join its components, or all."""

    def joined(key, t):
        t = t.sort_by("class")
        name, comp = t.column("class").to_numpy(), t.column("comp").combine_chunks()
        number = comp.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        x, y = region_links(_codes(t), num, den, number, every)
        return pa.table({"a": np.minimum(name[x], name[y]), "b": np.maximum(name[x], name[y])})

    return kept.join(sets, "class").groupBy("region", "i", "j").applyInArrow(X.tidy_group(joined), "a long, b long")


def _sized(rows: DataFrame, block: int, cells: int, *more: str) -> DataFrame:
    """region, held, free, slices: members, those of no known component, and how many tasks' worth."""
    free = F.count("*") - F.count("comp") if "comp" in rows.columns else F.count("*")
    return rows.groupBy("region", *more).agg(F.count("*").alias("held"), free.alias("free"), F.ceil(F.greatest(F.count("*") / block, F.sum("n") / cells)).alias("slices"))


def _turn(region: DataFrame, sets: DataFrame, num: int, den: int, total: int, turn: int) -> DataFrame:
    """One round of recursion over large regions (region, slices, held, class, n, home, comp, root).

    Returns (a, b) for links with pivots, and the members of the new regions: (region, class,
    n, home, comp, root, parent, own); a member's `own` region is that of its nearest pivot.
    """
    radius = 1 - num / den
    draw = F.xxhash64("class", F.lit(turn))
    free = region.where("home and comp is null").withColumn("draw", draw).withColumn("central", F.col("class") != F.col("root"))
    # about 2 * PIVOTS draws of each region, of which the smallest stay, and always the smallest of all
    often = F.pmod(F.xxhash64("draw"), F.greatest(F.floor(F.col("held") / (2 * PIVOTS)), F.lit(1))) == 0
    order = F.struct("central", "draw", "class")
    pivots = free.groupBy("region", "slices").agg(F.min(order).alias("least"), F.sort_array(F.collect_list(F.when(often, order))).alias("others"))
    pivots = pivots.select("region", F.explode(F.slice(F.array_distinct(F.concat(F.array("least"), "others")), 1, PIVOTS)).alias("p"), "slices").select("region", F.col("p.class").alias("class"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    rows = region.withColumn("slice", F.pmod(F.xxhash64("class", F.lit(-1)), F.col("slices"))).select("region", "slice", "class", "home", "comp", "root", F.lit(False).alias("pivot"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("home", "boolean"), ("comp", "long"), ("root", "long"))]
    sent = rows.unionByName(pivots.select("region", "slice", "class", *none, F.lit(True).alias("pivot"))).join(sets, "class")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("region", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("home", pa.bool_()), ("comp", pa.int64()), ("root", pa.int64()), ("parent", pa.int64()), ("own", pa.bool_())])

    def divided(key, t):
        t = t.sort_by([("pivot", "descending"), ("class", "ascending")])
        k = int(pa.compute.sum(t.column("pivot").cast(pa.int64())).as_py())
        name = t.column("class").to_numpy()
        pivot = name[:k]
        own = np.flatnonzero(np.r_[np.zeros(k, bool), ~np.isin(name[k:], pivot)])  # all links of the pivots are found here
        if not k:
            return schema.empty_table()
        held = _Members(_codes(t))
        none = lambda c, kind=pa.int64(): pa.nulls(c, kind)

        def found(a, b):
            return pa.Table.from_arrays([pa.array(a), pa.array(b), *(none(len(a), f.type) for f in list(schema)[2:])], schema=schema)

        among = []
        if key[1].as_py() == 0 and k > 1:
            both = np.stack([held.common(p, np.arange(k)) for p in range(k)])
            p, x = np.nonzero(np.triu((den + num) * both >= num * (held.n[:k][None] + held.n[:k][:, None]), 1))
            among.append(found(pivot[p], pivot[x]))
        if not len(own):
            return pa.concat_tables([schema.empty_table(), *among])
        both = np.stack([held.common(p, own) for p in range(k)])
        n = held.n[own][None] + held.n[:k][:, None]
        away = 1 - both / (n - both)
        linked = (den + num) * both >= num * n
        nearest, least = away.argmin(axis=0), away.min(axis=0)
        comp = t.column("comp").combine_chunks()
        taken = np.asarray(comp.is_valid())[own]
        names = np.where(taken, np.asarray(comp.fill_null(0))[own], pivot[linked.argmax(axis=0)])
        has = taken | linked.any(axis=0)
        home = np.asarray(t.column("home").combine_chunks().fill_null(False))[own]
        root = np.asarray(t.column("root").combine_chunks().fill_null(0))[own]
        p, x = np.nonzero(linked)
        links = found(pivot[p], name[own][x])
        p, x = np.nonzero((away <= least + 2 * radius + 1e-9) | (nearest == np.arange(k)[:, None]))
        region = X.signed(X.mix(np.full(len(p), key[0].as_py(), np.int64).view(X.U) ^ X.mix(pivot[p].view(X.U))))
        rows = [none(len(p)), none(len(p)), pa.array(region), pa.array(name[own][x]), pa.array(held.n[own][x]), pa.array(home[x] & (nearest[x] == p)), pa.array(names[x], mask=~has[x]), pa.array(root[x]), pa.array(np.full(len(p), key[0].as_py(), np.int64)), pa.array(nearest[x] == p)]
        return pa.concat_tables([links, *among, pa.Table.from_arrays(rows, schema=schema)])

    return sent.groupBy("region", "slice").applyInArrow(X.tidy_group(divided), "a long, b long, region long, class long, n long, home boolean, comp long, root long, parent long, own boolean")


def divide(large: DataFrame, sets: DataFrame, num: int, den: int, block: int, cells: int, staged: X.Staged, every: bool) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """(links, regions that fit into a task, pairs of blocks of the rest) out of large regions.

    `large` has region, class, n, home, comp, root.  All three are lists of tables: (a, b),
    (region, class, comp) and (region, i, j, root, class, comp).

    What is read several times is written, small as it is: a plan that holds it over and
    over costs the driver more memory than the rows do.
    """
    links, ready, rest = [], [], []
    now = large
    for turn in range(ROUNDS if not every else 0):
        total = now.count()
        if not total:
            break
        sizes = staged.write(_sized(now, block, cells), share=8)
        placed = X.looked_up(now, sizes.select("region", "held", "slices", F.col("held").alias("size")), ["region"], total).withColumnRenamed("size", "held")
        found = staged.write(_turn(placed, sets, num, den, total, turn))
        links.append(found.where("a is not null").select("a", "b"))
        after = found.where("a is null").drop("a", "b")
        # regions without a free member to be a pivot stay as they are
        idle = staged.write(sizes.join(now.where("home and comp is null").select("region").distinct(), "region", "left_anti").select("region", "held"), share=8)
        rest.append(X.looked_up(now, idle, ["region"], total))
        # a region is split only where that saves comparisons; else it stays whole, without its pivots
        whole = after.where("own").withColumn("region", F.col("parent"))
        stats = [_sized(rows, block, cells, "parent").join(rows.groupBy("region").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.min("comp").alias("low"), F.max("comp").alias("high")), "region") for rows in (after, whole)]
        stats = [staged.write(s, share=8) for s in stats]
        saved = stats[0].groupBy("parent").agg(F.sum(F.col("homes") * F.col("held")).alias("cost"), F.sum("homes").alias("all"))
        saved = saved.join(sizes.select(F.col("region").alias("parent"), F.col("held").alias("before"), F.col("free").alias("free_before")), "parent")
        members = []
        for rows, stat, split in ((after, stats[0], True), (whole, stats[1], False)):
            kind = stat.join(saved.where((F.col("cost") < 0.7 * F.col("all") * F.col("before")) == split), "parent")
            kind = kind.where("held > 1 and homes > 0 and not (free = 0 and low = high)")
            shrunk = (F.col("free") < 0.5 * F.col("free_before")) | (F.lit(split) & (F.col("held") < 0.7 * F.col("before")))
            kind = staged.write(kind.select("region", "held", "slices", shrunk.alias("shrunk")), share=8)
            members.append(X.looked_up(rows.drop("parent", "own"), kind, ["region"], after.count()))
        members = staged.write(members[0].unionByName(members[1]))
        ready.append(members.where("slices <= 1").select("region", "class", "comp"))
        left = members.where("slices > 1")
        rest.append(left.where("not shrunk").select(*now.columns))
        now = left.where("shrunk").select(*now.columns)
    rest.append(now)
    out = rest[0]
    for r in rest[1:]:
        out = out.unionByName(r)
    out = staged.write(out)
    total = out.count()
    if not total:
        return links, ready, []
    parts = out.groupBy("region", "comp").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / cells)).alias("slices"), F.count("*").alias("held")).withColumn("part", F.xxhash64("comp"))
    parts = staged.write(parts, share=8)
    blocks = parts.select("region", "comp", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda k: F.xxhash64("region", "comp", k))).alias("block"))
    every_block = blocks.groupBy("region").agg(F.collect_list(F.struct("block", "comp")).alias("blocks")).join(out.groupBy("region").agg(F.count("*").alias("held")), "region")
    every_block = staged.write(every_block, share=8)
    own = X.looked_up(out.withColumn("part", F.xxhash64("comp")), parts.select("region", "part", "slices", "held"), ["region", "part"], total)
    own = own.withColumn("own", F.xxhash64("region", "comp", F.pmod(F.xxhash64("class", F.lit(-2)), F.col("slices")))).select("region", "class", "comp", "root", "own")
    own = staged.write(own)
    met = X.looked_up(own, every_block, ["region"], total).withColumn("other", F.explode(F.filter("blocks", lambda b: b["comp"].isNull() | F.col("comp").isNull() | (b["comp"] != F.col("comp")))))
    return links, ready, [met.select("region", F.least("own", "other.block").alias("i"), F.greatest("own", "other.block").alias("j"), "root", "class", "comp")]


def linked_classes(docs: DataFrame, rows: DataFrame, known: DataFrame, staged: X.Staged, num: int, den: int, size: int, frequent: int, block: int, cells: int, every: bool = False) -> DataFrame:
    """a, b: links between classes that connect all components, or (`every`) all links; staged."""
    spark = docs.sparkSession
    listed = known.where("hot").groupBy("class").agg(F.sum("n").alias("count")).where("count >= 16").orderBy(F.desc("count"), "class").limit(frequent).select("class").toArrow()
    hot = np.sort(listed.column(0).to_numpy().astype(np.int64).view(X.U))
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(min(16, int(spark.conf.get("spark.sql.shuffle.partitions"))), total * (den - num) // den // 1_000_000)

    met = staged.write(meeting(regions(docs, hot, num, den, size, buckets), hot), share=4)
    members = staged.write(members_of(met).withColumnRenamed("pivot", "region").join(met.where("cell is null").select("class", "n"), "class"), share=2)
    sizes = staged.write(_sized(members, block, cells).where("held > 1"), share=8)
    placed = X.looked_up(members, sizes.drop("free").withColumn("size", F.col("held")), ["region"], members.count()).select("region", "class", "n", "size", "slices", F.lit(True).alias("home"), F.lit(None).cast("long").alias("comp"), F.col("region").alias("root"))
    several = members.select(F.col("region").alias("pivot"), "class").join(sizes.withColumnRenamed("region", "pivot"), "pivot", "left_semi")
    zero = F.lit(0).cast("long")
    whole = placed.where("slices <= 1").select("region", zero.alias("i"), zero.alias("j"), "root", "class", "comp", "size")
    cleared = survivors(met, several, whole.where(F.col("size") <= FEW).drop("size"), num, den)
    kept = staged.write(cleared.unionByName(whole.where(F.col("size") > FEW).drop("size", "root")), share=8)
    large = placed.where("slices > 1").drop("slices", "size")
    if sizes.where("slices > 1").isEmpty():
        out = joined_regions(kept, sets_of(docs, kept, size), num, den, every)
    else:
        large = staged.write(large)
        sets = staged.write(sets_of(docs, kept.select("class").union(large.select("class")).distinct(), size))
        found, ready, rest = divide(large, sets, num, den, block, cells, staged, every)
        parts = [kept, *(r.select("region", zero.alias("i"), zero.alias("j"), "class", "comp") for r in ready), *(staged.write(survivors(met, several, r, num, den), share=8) for r in rest)]
        every_part = parts[0]
        for p in parts[1:]:
            every_part = every_part.unionByName(p)
        out = joined_regions(every_part, sets, num, den, every)
        for f in found:
            out = out.unionByName(f.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    links = staged.write(out.where("a != b").distinct(), share=16)
    staged.drop(met, members)
    return links


def labelled(docs: DataFrame, num: int = 75, den: int = 100, size: int = 5, frequent: int = 1 << 16, block: int = 2048, cells: int = 1 << 21, key: Column | None = None) -> tuple[DataFrame, DataFrame, X.Staged]:
    """(rows, classes): per row doc_id, class, n (and its key, if asked for); per class its
    smallest doc_id, the rows that it holds and the label of its component."""
    if not 0 < num <= den:
        raise ValueError("the similarity must be above 0 and at most 1")
    staged = X.Staged(docs.sparkSession)
    known = staged.write(profile(docs, size, key))
    rows = known.where("not hot").drop("hot")
    links = linked_classes(docs, rows, known, staged, num, den, size, frequent, block, cells)
    held = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("held"))
    if links.isEmpty():
        return rows, held.withColumn("label", F.col("class")), staged
    labels = components(links, staged)
    return rows, held.join(labels.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("label", F.coalesce("root", "class")).drop("root"), staged


def classes(docs: DataFrame, num: int = 75, den: int = 100, size: int = 5, frequent: int = 1 << 16, block: int = 2048, cells: int = 1 << 21) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    rows, named, staged = labelled(docs, num, den, size, frequent, block, cells)
    total = rows.count()
    named = staged.write(named, share=4)
    first = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("held"))
    own = X.looked_up(named.select("class", "label", F.col("held").alias("rows")), first, ["label"], total)
    own = staged.write(own.select("class", "component_id", F.col("rows").alias("held")), share=4)
    some = X.looked_up(rows.where("class is not null"), own, ["class"], total).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(rows.where("class is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def links(docs: DataFrame, num: int = 75, den: int = 100, size: int = 5, frequent: int = 1 << 16, block: int = 2048, cells: int = 1 << 21) -> tuple[DataFrame, DataFrame]:
    """(links, membership): all pairs (a, b) of linked classes, and doc_id, class, n of each row.

    Rows of one class have equal sets and are linked with each other and with all rows of
    linked classes.  The number of pairs may grow with the square of a group's size.
    """
    if not 0 < num <= den:
        raise ValueError("the similarity must be above 0 and at most 1")
    staged = X.Staged(docs.sparkSession)
    known = staged.write(profile(docs, size))
    rows = known.where("not hot").drop("hot")
    return linked_classes(docs, rows, known, staged, num, den, size, frequent, block, cells, every=True), rows


def single(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without words, and one row of each component.

    The smallest doc_id stays, null after all others; among rows that share it the one
    with the smallest hash over all columns; of rows that are equal in whole, one.
    """
    whole = F.xxhash64(*docs.columns)
    rows, named, staged = labelled(docs, key=whole)
    total = rows.count()
    named = staged.write(named.select("class", "label", "held"), share=4)
    labels = X.looked_up(rows.where("class is not null"), named, ["class"], total).select("doc_id", "key", "label")
    labels = staged.write(labels.groupBy("label", "doc_id", "key").agg(F.count("*").alias("rows")))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    first = labels.groupBy("label").agg(F.min(place).alias("first"), F.count("*").alias("held"))
    judged = X.looked_up(labels, first, ["label"], total)
    stays = place == F.col("first")
    other = judged.where(~stays | (F.col("rows") > 1)).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), stays.alias("_stays"))
    other = staged.write(other, share=16)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_whole") == F.col("_key"))
    rows = docs.withColumn("_whole", whole)
    shared = docs.sparkSession.sparkContext.broadcast(X.bitmap(other.select("_key")))

    def judged_rows(listed: bool):
        """Rows that the bitmap of `other` lists, or not: only the former need the join."""

        def run(batches):
            for b in batches:
                hit = X.in_bitmap(shared.value, b.column(b.num_columns - 1).to_numpy())
                yield b.filter(pa.array(hit == listed))

        return rows.mapInArrow(X.tidy(run), T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema]))

    listed = judged_rows(True)
    kept = listed.join(other, same, "left_anti").drop("_whole")
    repeated = listed.join(other.where("_stays"), same, "left_semi")
    return judged_rows(False).drop("_whole").unionByName(kept).unionByName(repeated.dropDuplicates(["doc_id", "_whole"]).drop("_whole"))
