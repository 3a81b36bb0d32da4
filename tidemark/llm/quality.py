"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of four bytes run over the whole document, which is cut into blocks of
128 bytes; a chunk is two neighbouring blocks, so chunks overlap by half.  Each filter is
max-pooled within every chunk; the mean and the maximum over all chunks, and the
length, go through one hidden layer to a single probability.  A filter is the sum of
two tables of byte pairs, so its response costs two look-ups per byte.

The network is fitted on a bounded sample of labelled rows, always on their whole texts:
about `sample` rows of each label, drawn by a hash of doc_id, at most four times as many in
all (the smallest hashes), none with a text of more than `longest` bytes.

Defined results: a null text counts as empty and is scored; a null doc_id is never
learned from and is not held out; conflicting labels of a document count as the lower
one; without labels of both kinds every score is the share of label 1 (0.5 without any);
equal rows give equal results; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textcore as X

BLOCK, WIDTH = 128, 4


def layout(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes padded with zeros to whole blocks, first block of each row).

    Every row begins with zeros, so that no filter sees bytes of two rows.
    """
    size = np.diff(off)
    blocks = -(-(size + WIDTH - 1) // BLOCK)
    first = np.r_[0, np.cumsum(blocks)]
    out = np.zeros(int(first[-1]) * BLOCK + WIDTH, np.uint8)
    out[X.ranges(first[:-1] * BLOCK + WIDTH - 1, size)] = data
    return out, first


class Net:
    def __init__(self, filters: int = 32, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.f = filters
        self.taps = rng.normal(0, 0.3, (WIDTH, 256, filters)).astype(np.float32)
        self.w1 = rng.normal(0, 0.2, (2 * filters + 1, hidden)).astype(np.float32)
        self.b1 = np.zeros(hidden, np.float32)
        self.w2 = rng.normal(0, 0.3, hidden).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)
        self.fixed: float | None = None
        self.pairs: np.ndarray | None = None

    def responses(self, padded: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Filter responses at the positions of blocks lo..hi."""
        a, n = lo * BLOCK, (hi - lo) * BLOCK
        pair = padded[a : a + n + 3].astype(np.int32)
        pair = (pair[:-1] << 8) | pair[1:]
        out = self.pairs[0].take(pair[:n], axis=0)
        out += self.pairs[1].take(pair[2 : n + 2], axis=0)
        return out

    def ready(self) -> None:
        t = self.taps
        self.pairs = np.stack([(t[k][:, None] + t[k + 1][None]).reshape(65536, self.f) for k in (0, 2)])

    def pooled(self, padded: np.ndarray, blocks: int) -> np.ndarray:
        out = np.empty((blocks, self.f), np.float32)
        for lo in range(0, blocks, 64):
            hi = min(blocks, lo + 64)
            out[lo:hi] = self.responses(padded, lo, hi).reshape(hi - lo, BLOCK, self.f).max(axis=1)
        return out

    @staticmethod
    def chunked(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left block, right block, first chunk of each row): chunks are neighbouring blocks."""
        count = np.maximum(np.diff(first) - 1, 1)
        left = X.ranges(first[:-1], count)
        right = np.minimum(left + 1, np.repeat(first[1:] - 1, count))
        return left, right, np.r_[0, np.cumsum(count)]

    def features(self, pooled: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        left, right, at = self.chunked(first)
        chunk = np.tanh(np.maximum(pooled[left], pooled[right]))
        mean = np.add.reduceat(chunk, at[:-1], axis=0) / np.diff(at)[:, None]
        return np.concatenate([mean, np.maximum.reduceat(chunk, at[:-1], axis=0), np.log1p(np.minimum(size, 256))[:, None] / 5], axis=1, dtype=np.float32)

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(off) - 1, self.fixed)
        padded, first = layout(data, off)
        x = self.features(self.pooled(padded, int(first[-1])), first, np.diff(off))
        z = np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = 12, steps: int = 1200, rate: float = 0.01, batch: int = 16, seed: int = 5) -> None:
        """Adam over `epochs` rounds, more for few texts; both labels weigh the same in all."""
        rng = np.random.default_rng(seed)
        epochs = max(epochs, -(-steps * batch // len(texts)))
        weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
        names = ("taps", "w1", "b1", "w2", "b2")
        mean = {k: np.zeros_like(getattr(self, k)) for k in names}
        square = {k: np.zeros_like(getattr(self, k)) for k in names}
        step, total = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                grad = self._gradients([texts[i] for i in rows], labels[rows], weight[rows])
                step += 1
                now = rate * (1 - step / (total + 1))
                for k in names:
                    mean[k] += 0.1 * (grad[k] - mean[k])
                    square[k] += 0.01 * (grad[k] ** 2 - square[k])
                    getattr(self, k)[...] -= now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
        self.ready()

    def _gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        off = np.r_[0, np.cumsum([len(t) for t in texts])]
        padded, first = layout(np.frombuffer(b"".join(texts), np.uint8), off)
        blocks = int(first[-1])
        pooled, where = np.empty((blocks, self.f), np.float32), np.empty((blocks, self.f), np.int64)
        for lo in range(0, blocks, 64):
            hi = min(blocks, lo + 64)
            a, n = lo * BLOCK, (hi - lo) * BLOCK
            r = sum(self.taps[k].take(padded[a + k : a + k + n], axis=0) for k in range(WIDTH)).reshape(hi - lo, BLOCK, self.f)
            best = r.argmax(axis=1)
            where[lo:hi] = best + (np.arange(lo, hi) * BLOCK)[:, None]
            pooled[lo:hi] = np.take_along_axis(r, best[:, None], 1)[:, 0]
        x = self.features(pooled, first, np.diff(off))
        h = np.tanh(x @ self.w1 + self.b1)
        p = 1 / (1 + np.exp(-(h @ self.w2 + self.b2)))
        dz = (weight * (p - y) / len(y)).astype(np.float32)
        dh = np.outer(dz, self.w2) * (1 - h**2)
        dx = dh @ self.w1.T
        left, right, at = self.chunked(first)
        rows = np.repeat(np.arange(len(texts)), np.diff(at))
        from_right = pooled[right] > pooled[left]
        chunk = np.tanh(np.where(from_right, pooled[right], pooled[left]))
        top = x[:, self.f : 2 * self.f][rows]
        d = dx[:, : self.f][rows] / np.diff(at)[rows][:, None] + dx[:, self.f : 2 * self.f][rows] * (chunk == top)
        d *= 1 - chunk**2
        source = np.where(from_right, right[:, None], left[:, None])
        spot = where[source, np.arange(self.f)[None]]
        taps = np.zeros_like(self.taps)
        column = np.broadcast_to(np.arange(self.f), spot.shape)
        for k in range(WIDTH):
            taps[k] = np.bincount((padded[spot + k].astype(np.int64) * self.f + column).ravel(), d.ravel(), 256 * self.f).reshape(256, self.f)
        return {"taps": taps, "w1": x.T @ dh, "b1": dh.sum(0), "w2": h.T @ dz, "b2": dz.sum(keepdims=True)}


def fit(docs: DataFrame, labels: DataFrame, sample: int = 900, mod: int = 3, held: int = 1, longest: int = 1 << 16) -> Net:
    """A network of about `sample` rows of each label, none from the held-out remainder."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where((X.remainder(mod) != held) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    count = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    net = Net()
    bound = F.lit(0)
    for q, n in count.items():
        bound = F.when(F.col("quality") == q, F.lit(int(min(1.0, sample / n) * (1 << 20)))).otherwise(bound)
    place = F.xxhash64("doc_id", F.lit(13))
    drawn = known.where(F.pmod(place, F.lit(1 << 20)) < bound).orderBy(place, "doc_id").limit(4 * sample)
    short = X.plain(docs).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    got = short.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "quality").orderBy(place, F.xxhash64("text")).limit(4 * sample).collect() if count else []
    got.sort(key=lambda r: (r.doc_id, r.text or ""))
    y = np.array([r.quality for r in got], np.float32)
    if len(set(y.tolist())) < 2:
        net.fixed = float(y.mean()) if len(y) else 0.5
        return net
    net.train([(r.text or "").encode() for r in got], y)
    return net


def score(docs: DataFrame, net: Net, mod: int = 3, held: int = 1) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = X.plain(docs).select("doc_id", F.coalesce(X.remainder(mod) == held, F.lit(False)).alias("held_out"), "text")

    def run(batches):
        n = shared.value
        for b in batches:
            out = np.zeros(b.num_rows)
            for lo, hi, data, off in X.chunks(b.column(2)):
                out[lo:hi] = n.scores(data, off)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, net: Net) -> DataFrame:
    """The rows of `docs`, all columns, whose score is at least 0.5."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        n = shared.value
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for lo, hi, data, off in X.chunks(b.column(at)):
                keep[lo:hi] = n.scores(data, off) >= 0.5
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(X.tidy(run), docs.schema)
