"""Language ID: averaged hashed subword embeddings and a linear softmax.

Subwords are byte 3-grams and 4-grams around each letter byte, lower-cased, where every
other byte reads as a space.  A text's vector is the mean of their embeddings; both
the embeddings and the softmax are learned by stochastic gradient descent in numpy.
For prediction the two linear maps are folded into one table.

The model is fitted on a bounded sample of labelled rows (about `sample` rows, dealt evenly
over the languages and drawn by a hash, none of more than `longest` bytes).  A third of
that sample is kept from learning and calibrates: the temperature is the one at which the
mean score equals the share of right predictions (with one more of each outcome, so that
it is not 1), and predictions under the score that `REJECTED` of the right ones stay
below count as rejected.

Defined results: `und` with score 0 for a null text, a text without letters, or when
nothing can be learned; a null doc_id is never learned from and is not held out; equal
rows give equal results; empty tables give empty tables; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textcore as X

BITS = 15
REJECTED = 0.01
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_ASCII_LETTER = _LETTER.copy()
_ASCII_LETTER[0x80:] = False
_SHOWN = np.where(_LETTER, X.FOLD, 0x20).astype(np.uint32)


def subwords(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds): those of row i are bounds[i]..bounds[i+1]."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    shown = np.empty(n + 3, np.uint32)
    shown[1 : n + 1] = _SHOWN[data]
    shown[0] = shown[n + 1] = shown[n + 2] = 0x20
    begins = off[:-1][off[:-1] < n]
    ends = off[1:][off[1:] > 0] - 1
    before, here, after, second = shown[:n].copy(), shown[1 : n + 1], shown[2 : n + 2].copy(), shown[3 : n + 3].copy()
    before[begins] = 0x20
    after[ends] = 0x20
    second[ends] = 0x20
    second[np.maximum(ends - 1, 0)] = 0x20
    at = np.flatnonzero(_LETTER[data])
    three = ((before[at] << np.uint32(16)) | (here[at] << np.uint32(8)) | after[at]) * np.uint32(0x9E3779B1)
    four = (((here[at] << np.uint32(16)) | (after[at] << np.uint32(8)) | second[at]) * np.uint32(0x85EBCA77)) ^ (before[at] * np.uint32(0xC2B2AE3D))
    out = np.empty(2 * len(at), np.int64)
    out[0::2] = three >> np.uint32(32 - BITS)
    out[1::2] = ((four * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)) + (1 << BITS)
    return out, 2 * np.searchsorted(at, off)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


class Model:
    """table: logits of each bucket; languages, temperature and the rejection score."""

    def __init__(self, texts: list[str], langs: list[str], dims: int = 16, epochs: int = 6, steps: int = 6000, rate: float = 0.5, seed: int = 7):
        """`epochs` rounds over the texts, more for few of them."""
        self.languages = sorted(set(langs))
        k = len(self.languages)
        label = np.array([self.languages.index(x) for x in langs])
        column = pa.array(texts, pa.string())
        rows = []
        for _, _, data, off in X.chunks(column):
            buckets, bounds = subwords(data, off)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                u, c = np.unique(buckets[a:b], return_counts=True)
                rows.append((u, (c / max(1, b - a)).astype(np.float32)))
        rng = np.random.default_rng(seed)
        emb = rng.normal(0, 0.1, (2 << BITS, dims)).astype(np.float32)
        out = np.zeros((dims, k), np.float32)
        bias = np.zeros(k, np.float32)
        order = rng.permutation(len(rows))
        own = [order[label[order] == c] for c in range(k)]
        kept = np.concatenate([x[: len(x) // 3] for x in own]) if len(order) > 30 else order[:0]  # no language's only row
        fit = order[~np.isin(order, kept)]
        epochs = max(epochs, -(-steps // max(1, len(fit))))
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for i in rng.permutation(fit):
                u, w = rows[i]
                if not len(u):
                    continue
                v = w @ emb[u]
                p = _softmax((v @ out + bias)[None])[0]
                p[label[i]] -= 1
                back = out @ p
                out -= step * np.outer(v, p)
                bias -= 0.02 * step * p
                emb[u] -= (20 * step * w)[:, None] * back[None]
        self.table, self.bias, self.temperature, self.least = emb @ out, bias, 1.0, 0.0
        if len(kept):
            logits = np.array([rows[i][1] @ self.table[rows[i][0]] + bias if len(rows[i][0]) else bias for i in kept])
            right = logits.argmax(1) == label[kept]
            goal = max((right.sum() + 1) / (len(kept) + 2), 1 / k + 1e-6)
            low, high = 1e-4, 1e3  # the mean score falls from 1 to 1 / k between them
            for _ in range(60):
                self.temperature = float(np.sqrt(low * high))
                sure = _softmax(logits / self.temperature).max(1).mean() > goal
                low, high = (self.temperature, high) if sure else (low, self.temperature)
            score = _softmax(logits / self.temperature).max(1)
            self.least = float(np.quantile(score[right], REJECTED)) if right.any() else 1.0

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        buckets, bounds = subwords(data, off)
        n = np.diff(bounds)
        sums = np.zeros((len(n), len(self.languages)), np.float32)
        full = np.flatnonzero(n)
        if len(full):
            sums[full] = np.add.reduceat(self.table.take(buckets, axis=0), bounds[:-1][full], axis=0)
        p = _softmax((sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature)
        return p.argmax(1), p.max(1)


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each row holds a Unicode letter."""
    plain = np.diff(np.searchsorted(np.flatnonzero(_ASCII_LETTER[data]), off)) > 0
    for i in np.flatnonzero(~plain & (np.diff(np.searchsorted(np.flatnonzero(data >= 0x80), off)) > 0)):
        plain[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode())
    return plain


def quotas(count: dict[str, int], sample: int, least: int) -> dict[str, int]:
    """Rows to draw of each language: about `sample` in all, dealt evenly, `least` of each if it has them."""
    out, left = {}, sample
    for k, (lang, n) in enumerate(sorted(count.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(least, left // (len(count) - k)))
        left = max(0, left - out[lang])
    return out


def fit(docs: DataFrame, sample: int = 2400, mod: int = 4, held: int = 2, least: int = 60, longest: int = 1 << 16) -> Model | None:
    """A model of about `sample` labelled rows outside the held-out remainder, drawn by language."""
    rows = X.plain(docs, F.col("lang").cast("string").alias("lang")).where((X.remainder(mod) != held) & F.col("lang").isNotNull() & (F.octet_length("text") <= longest))
    count = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not count:
        return None
    drawn = quotas(count, sample, least)
    bound = F.create_map(*[F.lit(x) for lang, n in count.items() for x in (lang, int(drawn[lang] / n * (1 << 40)))])
    place = F.xxhash64("doc_id", "text", F.lit(11))
    got = rows.where(F.pmod(place, F.lit(1 << 40)) < bound[F.col("lang")]).orderBy(place, "doc_id", "lang").limit(2 * sum(drawn.values())).collect()
    got.sort(key=lambda r: (r.doc_id, r.text))
    return Model([r.text for r in got], [r.lang for r in got]) if got else None


def identify(docs: DataFrame, model: Model | None, mod: int = 4, held: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            n = b.num_rows
            lang, score = np.full(n, "und", object), np.zeros(n)
            for lo, hi, data, off in X.chunks(b.column(2)) if m else ():
                best, p = m.predict(data, off)
                known = has_letter(data, off)
                lang[lo:hi] = np.where(known, np.array(m.languages, object)[best], "und")
                score[lo:hi] = np.where(known, p, 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(score < (m.least if m else 1.0))], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = X.plain(docs).select("doc_id", F.coalesce(X.remainder(mod) == held, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
