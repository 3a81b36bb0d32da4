"""Language-model scoring by prediction by partial matching.

The model is a trie of byte contexts up to five bytes deep, pretrained on the whole
training part of the corpus.  The longest contexts count occurrences; a shorter one counts
a symbol once for each longer context in which it was seen, which is where coding comes
down to it.  A byte is coded in its longest context that was seen; where it did not occur
there, an escape is coded (`ESCAPE` of a count for every distinct follower, taken from the
followers' own counts) and the next shorter context is tried without the symbols already
ruled out.  The end of a text is a symbol of its own.  Code lengths of a text add up to its
score.  Beside it stands a unigram word model of the same corpus as the base.

The trie and the word counts grow with the corpus, so no task ever holds them.  The
corpus is read in blocks; every block sums its own words and byte grams and sends them in
packed form to `buckets` by key, where counts of all blocks meet one after the other.  Trie
nodes are divided by their three nearest context bytes; the levels above are bounded (at
most 257**3 counts, those that occur) and given to all.  Each block gets back just the
entries that its texts need.  A task holds the distinct keys of a bucket, those below some
nodes, or those of one block.

Defined results: a null text counts as empty; a null doc_id is scored, but neither learned
from nor held out; equal rows give equal results; with nothing to learn from, the base
gives every token probability 1 and the model is uniform; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textcore as X

DEPTH, SYMBOL_BITS, SYMBOLS = 5, 9, 257
ESCAPE = 0.3
WORDS, GRAMS, DOCS = 0, 1, 9
_PENDING = 4 << 20


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grams, bounds): each text's bytes and its end, as symbols under their contexts.

    A gram holds five context symbols and the symbol coded, nine bits each; 0 stands
    for the end and for what precedes a text.
    """
    size = np.diff(off)
    begin = off[:-1] + np.arange(len(size)) * (DEPTH + 1) + DEPTH
    line = np.zeros(len(data) + len(size) * (DEPTH + 1), np.int64)
    line[X.ranges(begin, size)] = data.astype(np.int64) + 1
    at = X.ranges(begin, size + 1)
    grams = line[at]
    for k in range(1, DEPTH + 1):
        grams |= line[at - k] << (SYMBOL_BITS * k)
    return grams, off + np.arange(len(off))


def _reduce(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return (X.mix(keys.view(X.U)) >> X.U(16)).astype(np.int64) % n


class Summed:
    """Words and grams of one block; counts are those of its training texts."""

    def __init__(self):
        self.held: dict[int, tuple[list, list]] = {WORDS: ([], []), GRAMS: ([], [])}
        self.size = 0
        self.tokens = self.texts = 0

    def add(self, data: np.ndarray, off: np.ndarray, train: np.ndarray) -> None:
        starts, ends, first = X.words(data, off)
        codes = X.signed(X.word_hashes(data, starts, ends, True))
        grams, bounds = symbols(data, off)
        self.tokens += int(((np.diff(first) + 1) * train).sum())
        self.texts += int(train.sum())
        for kind, keys, sizes in ((WORDS, codes, np.diff(first)), (GRAMS, grams, np.diff(bounds))):
            learned = np.repeat(train, sizes)
            for part, factor in ((keys[learned], 1), (keys[~learned], 0)):
                key, count = np.unique(part, return_counts=True)
                self.held[kind][0].append(key)
                self.held[kind][1].append(count * factor)
                self.size += len(key)
        if self.size > 8 << 20:
            self.compact()

    def compact(self) -> None:
        self.size = 0
        for kind, (keys, counts) in self.held.items():
            if keys:
                key, count = _reduce(keys, counts)
                self.held[kind] = ([key], [count])
                self.size += len(key)

    def rows(self, block: int, buckets: int):
        self.compact()
        out = []
        for kind, (keys, counts) in self.held.items():
            if not keys or not len(keys[0]):
                continue
            key, count = keys[0], counts[0]
            where = _bucket(key, buckets)
            order = np.argsort(where, kind="stable")
            cut = np.searchsorted(where[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)):
                part = order[cut[b] : cut[b + 1]]
                out.append((block, kind, int(b), key[part].tobytes(), count[part].tobytes()))
        out.append((block, 2, 0, np.array([self.tokens, self.texts], np.int64).tobytes(), b""))
        return out


_REQUEST = "block long, kind int, bucket int, keys binary, counts binary"
_REQUESTS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _longs(x: pa.Scalar | bytes) -> np.ndarray:
    return np.frombuffer(x.as_buffer() if isinstance(x, pa.Scalar) else x, np.int64)


def _low(order: int) -> int:
    """The bits of a symbol and its `order` nearest context symbols."""
    return (1 << (SYMBOL_BITS * (order + 1))) - 1


class Upper:
    """Counts of the orders 0 to 2 over the whole corpus, from those of order 2."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order].astype(np.int64), counts[order].astype(np.float64)
        context = self.keys >> SYMBOL_BITS
        self.one = np.bincount(self.keys & _low(1), minlength=1 << 2 * SYMBOL_BITS).astype(np.float64)
        contexts = 1 << 2 * SYMBOL_BITS
        self.total = {2: np.bincount(context, self.counts, contexts)}
        self.kinds = {2: np.bincount(context, minlength=contexts).astype(np.float64)}
        self.excluded = {2: np.bincount(context, self.one[self.keys & _low(1)], contexts)}
        seen = np.flatnonzero(self.one)
        self.zero = np.bincount(seen & _low(0), minlength=1 << SYMBOL_BITS).astype(np.float64)
        self.total[1] = np.bincount(seen >> SYMBOL_BITS, self.one[seen], 1 << SYMBOL_BITS)
        self.kinds[1] = np.bincount(seen >> SYMBOL_BITS, minlength=1 << SYMBOL_BITS).astype(np.float64)
        self.excluded[1] = np.bincount(seen >> SYMBOL_BITS, self.zero[seen & _low(0)], 1 << SYMBOL_BITS)

    def two(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0.0)


def ppm(grams: np.ndarray, counts: np.ndarray, upper: Upper) -> np.ndarray:
    """log10 of each gram's probability, given all grams that share their last three context bytes."""
    key = {k: grams & _low(k) for k in range(DEPTH + 1)}
    count, total, kinds, excluded = {}, {}, {}, {}
    distinct, inverse, level = {}, {}, {}
    for k in range(DEPTH, 2, -1):
        distinct[k], inverse[k] = np.unique(key[k], return_inverse=True)
    level[DEPTH] = np.bincount(inverse[DEPTH], counts, len(distinct[DEPTH]))
    for k in range(DEPTH - 1, 2, -1):
        shorter = np.searchsorted(distinct[k], distinct[k + 1] & _low(k))
        level[k] = np.bincount(shorter, level[k + 1] > 0, len(distinct[k]))
    for k in range(DEPTH, 2, -1):
        context, which = np.unique(distinct[k] >> SYMBOL_BITS, return_inverse=True)
        seen, lower = level[k] > 0, distinct[k] & _low(k - 1)
        below = level[k - 1][np.searchsorted(distinct[k - 1], lower)] if k > 3 else upper.two(lower)
        count[k], at = level[k][inverse[k]], which[inverse[k]]
        total[k] = np.bincount(which, level[k], len(context))[at]
        kinds[k] = np.bincount(which, seen, len(context))[at]
        excluded[k] = np.bincount(which, below * seen, len(context))[at]
    count[2], count[1], count[0] = upper.two(key[2]), upper.one[key[1]], upper.zero[key[0]]
    for k in (2, 1):
        context = key[k] >> SYMBOL_BITS
        total[k], kinds[k], excluded[k] = upper.total[k][context], upper.kinds[k][context], upper.excluded[k][context]
    alphabet = int((upper.zero > 0).sum())
    total[0], kinds[0] = np.full(len(grams), upper.zero.sum()), np.full(len(grams), alphabet)
    out, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
    for k in range(DEPTH, -1, -1):
        n = total[k] - (excluded[k + 1] if k < DEPTH else 0)
        d = kinds[k] - (kinds[k + 1] if k < DEPTH else 0)
        used = open_ & (d > 0)
        found = used & (count[k] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(found, np.log10((count[k] - ESCAPE) / n), np.where(used, np.log10(ESCAPE * d / n), 0.0))
        open_ &= ~found
    return out - np.where(open_, np.log10(max(SYMBOLS - alphabet, 1)), 0.0)


def score(docs: DataFrame, mod: int = 10, held: int = 0, by_file: bool = False, block_bytes: int = 16 << 20, block_rows: int = 1 << 15, buckets: int = 1024) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are taken in blocks: with `by_file` stretches of the files that `docs` is read
    from, of two times `block_bytes`, and of at most `block_rows` rows of a split; else by a
    hash, of about `block_bytes` each.  Both readings must find a text in the same block; a
    key without an answer is an error.
    """
    spark = docs.sparkSession
    staged = X.Staged(spark)
    rest = X.remainder(mod)
    flags = [F.coalesce(rest == held, F.lit(False)).alias("held_out"), F.coalesce(rest != held, F.lit(False)).alias("train")]
    if by_file:
        within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        block = F.xxhash64(F.input_file_name(), F.floor(F.input_file_block_start() / (2 * block_bytes)), F.floor(within / block_rows))
        rows = X.plain(docs, block.alias("block")).select("block", "doc_id", "text", *flags)
        gathered = rows
    else:
        size = X.plain(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
        rows = X.plain(docs).withColumn("block", F.pmod(X.row_id(), F.lit(-(-size // block_bytes) or 1))).select("block", "doc_id", "text", *flags)
        gathered = rows.repartition("block").sortWithinPartitions("block")

    def gather(batches):
        at, summed = None, Summed()
        for b in batches:
            blocks = b.column(0).to_numpy()
            cut = np.r_[0, np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, len(blocks)]
            train = b.column(4).to_numpy(zero_copy_only=False)
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                if x == y:
                    continue
                if at is not None and blocks[x] != at:
                    yield from _as_batches(summed.rows(at, buckets))
                    summed = Summed()
                at = int(blocks[x])
                for lo, hi, data, off in X.chunks(b.column(2).slice(x, y - x)):
                    summed.add(data, off, train[x + lo : x + hi])
        if at is not None:
            yield from _as_batches(summed.rows(at, buckets))

    requests = staged.write(gathered.mapInArrow(gather, _REQUEST))
    stats = [_longs(bytes(r.keys)) for r in requests.where("kind = 2").select("keys").toLocalIterator()]
    tokens, texts = (int(x) for x in np.sum(stats, axis=0)) if stats else (0, 0)

    def sum_grams(batches):
        def summed():
            if keys:
                key, count = _reduce(keys, counts)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], names=["gram", "n"])

        at, keys, counts, size = None, [], [], 0
        for b in batches:
            for i, bucket in enumerate(b.column(0).to_numpy()):
                if bucket != at:
                    yield from summed()
                    at, keys, counts, size = bucket, [], [], 0
                keys.append(_longs(b.column(1)[i]))
                counts.append(_longs(b.column(2)[i]))
                size += len(keys[-1])
                if size > _PENDING:
                    key, count = _reduce(keys, counts)
                    keys, counts, size = [key], [count], 0
        yield from summed()

    by_bucket = requests.where(f"kind = {GRAMS}").select("bucket", "keys", "counts").repartition("bucket").sortWithinPartitions("bucket")
    grams = staged.write(by_bucket.mapInArrow(sum_grams, "gram long, n long"), share=8)
    of_order = lambda k: F.col("gram").bitwiseAND(_low(k)).alias("gram")
    two = grams.where("n > 0").select(of_order(3)).distinct().select(of_order(2)).groupBy("gram").count().toArrow()  # at most 257 ** 3 rows
    shared = spark.sparkContext.broadcast(Upper(two.column(0).to_numpy(), two.column(1).to_numpy()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), grams.count() // _PENDING)

    def predict(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        g, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(g)
        g = g[order]
        values = ppm(g, n[order], shared.value).astype(np.float32)
        where = _bucket(g, buckets)
        order = np.argsort(where, kind="stable")
        cut = np.searchsorted(where[order], np.arange(buckets + 1))
        own = np.flatnonzero(np.diff(cut))
        parts = [order[cut[i] : cut[i + 1]] for i in own]
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), X.binary([g[p] for p in parts]), X.binary([values[p] for p in parts])], names=["bucket", "keys", "values"])

    node = F.shiftright("gram", SYMBOL_BITS).bitwiseAND(_low(2))
    predicted = grams.repartition(parts, node).mapInArrow(predict, "bucket int, keys binary, values binary")
    none = F.lit(0).cast("long").alias("block")
    asked = requests.where("kind < 2").select("kind", "bucket", F.lit(1).alias("asks"), "block", "keys", F.lit(None).cast("binary").alias("values"))
    known = predicted.select(F.lit(GRAMS).alias("kind"), "bucket", F.lit(0).alias("asks"), none, "keys", "values")
    words = requests.where(f"kind = {WORDS}").select("kind", "bucket", F.lit(0).alias("asks"), none, "keys", F.col("counts").alias("values"))
    order = ["kind", "bucket", "asks", "block"]
    meeting = known.unionByName(words).unionByName(asked).repartition("kind", "bucket").sortWithinPartitions(*order).select(*order, "keys", "values")
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])

    def row(block, kind, keys, values):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([kind], pa.int32()), X.binary([keys]), X.binary([values])], schema=schema)

    def answer(batches):
        """First comes what a bucket knows, then what each block asks of it, maybe in several parts."""

        def answered():
            if wanted:
                ask = wanted[0] if len(wanted) == 1 else np.unique(np.concatenate(wanted))
                yield row(block, at[0], ask, values[np.searchsorted(keys, ask)])

        at, block, wanted, parts, keys, values, size = None, None, [], [], None, None, 0
        for b in batches:
            kinds, bucket, asks, blocks = (b.column(k).to_numpy() for k in range(4))
            for i in range(b.num_rows):
                if at != (kinds[i], bucket[i]):
                    yield from answered()
                    at, block, wanted, parts, keys, size = (int(kinds[i]), int(bucket[i])), None, [], [], None, 0
                if not asks[i]:
                    parts.append((_longs(b.column(4)[i]), np.frombuffer(b.column(5)[i].as_buffer(), np.int64 if at[0] == WORDS else np.float32)))
                    size += len(parts[-1][0])
                    if at[0] == WORDS and size > _PENDING:
                        parts, size = [_reduce(*zip(*parts, strict=True))], 0
                    continue
                if keys is None:
                    keys, values = _reduce(*zip(*parts, strict=True))  # grams are known once each
                    parts = []
                    if at[0] == WORDS:
                        yield row(0, 2, np.array([(values > 0).sum()], np.int64), np.zeros(0, np.int64))
                if int(blocks[i]) != block:
                    yield from answered()
                    block, wanted = int(blocks[i]), []
                wanted.append(_longs(b.column(4)[i]))
        yield from answered()

    answers = staged.write(meeting.mapInArrow(answer, "block long, kind int, keys binary, values binary"), share=4)
    staged.drop(requests, grams)
    distinct = sum(int(_longs(bytes(r["keys"]))[0]) for r in answers.where("kind = 2").select("keys").toLocalIterator()) + (texts > 0)
    whole = tokens + 0.1 * (distinct + 1)
    known_end = texts > 0
    end_score = float(np.log10((texts + 0.1) / whole))

    nothing = {"doc_id": "long", "text": "string", "held_out": "boolean", "keys": "binary", "values": "binary"}
    null = lambda *names: [F.lit(None).cast(nothing[n]).alias(n) for n in names]
    given = answers.where("kind != 2").select("block", "kind", *null("doc_id", "text", "held_out"), "keys", "values")
    asked = rows.select("block", F.lit(DOCS).alias("kind"), "doc_id", "text", "held_out", *null("keys", "values"))
    met = given.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind")

    def finish(batches):
        at, parts, tables = None, {}, {}
        for b in batches:
            blocks, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            mark = blocks * 2 + (kinds == DOCS)
            cut = np.r_[0, np.flatnonzero(mark[1:] != mark[:-1]) + 1, len(mark)]
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                if x == y:
                    continue
                if blocks[x] != at:
                    at, parts, tables = blocks[x], {WORDS: [], GRAMS: []}, {}
                if kinds[x] != DOCS:
                    for i in range(x, y):
                        parts[int(kinds[i])].append((_longs(b.column(5)[i]), np.frombuffer(b.column(6)[i].as_buffer(), np.int64 if kinds[i] == WORDS else np.float32)))
                    continue
                if not tables:
                    for kind, got in parts.items():
                        keys, values = (np.concatenate(z) for z in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                        tables[kind] = X.Index(keys, values)
                    parts = {}
                ids, out = b.column(2).slice(x, y - x), b.column(4).slice(x, y - x)
                n_tokens, n_known = np.zeros(y - x, np.int64), np.zeros(y - x, np.int64)
                base, scores = np.zeros(y - x), np.zeros(y - x)
                for lo, hi, data, off in X.chunks(b.column(3).slice(x, y - x)):
                    starts, ends, first = X.words(data, off)
                    c = tables[WORDS].get(X.signed(X.word_hashes(data, starts, ends, True)))
                    sums = lambda v, f: np.diff(np.r_[0, np.cumsum(v, dtype=np.float64)][f])
                    n_tokens[lo:hi] = np.diff(first) + 1
                    n_known[lo:hi] = sums(c > 0, first).astype(np.int64) + known_end
                    base[lo:hi] = sums(np.log10((c + 0.1) / whole), first) + end_score
                    grams, bounds = symbols(data, off)
                    scores[lo:hi] = sums(tables[GRAMS].get(grams), bounds)
                yield pa.RecordBatch.from_arrays([ids, out, pa.array(n_tokens), pa.array(n_known), pa.array(np.full(y - x, tokens)), pa.array(base), pa.array(scores)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return met.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _as_batches(rows: list[tuple], size: int = 64):
    for lo in range(0, len(rows), size):
        columns = list(zip(*rows[lo : lo + size], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _REQUESTS, strict=True)], schema=_REQUESTS)
