"""Secret scan with corpus-wide ownership frequency.

Every candidate's value is hashed; the distinct repositories and owners of each hash
are counted over the whole corpus, and each span is told what its value is: `copied` (an
example, found with many owners), `live` (one owner holds it, in however many
repositories) or `shared` (a few owners).  Where rows name no repository, each document is
one.

Base kinds are `assign`, `access` and `hex`; the method adds `pem` (private key
headers; the value is the whole key without white space) and `token` (prefixed access
tokens).

Defined results: a null text counts as empty; a null doc_id is carried through; a null
owner counts as one owner of its own; equal rows give equal results; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textcore as X

KINDS = ("assign", "access", "hex")
ADDED = ("pem", "token")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PEM = re.compile(r"-----BEGIN ([A-Z ]{0,32}PRIVATE KEY)-----")
_MARK = re.compile(r"-----(?:BEGIN|END) ")
_BREAK = r"""(?:[\s"']|\\[nr])"""
#: Header lines, lines of base64, and a shorter last one
_BODY = re.compile(rf"(?:{_BREAK}*+[A-Z][A-Za-z0-9-]*+:[^\n]*+\n)*+(?:{_BREAK}*+[A-Za-z0-9+/]{{16,}}+={{0,2}})*+(?:{_BREAK}*+[A-Za-z0-9+/]++={{0,2}}(?={_BREAK}*+(?:\n|\Z)|\\[nr]))?")
_BREAKS = re.compile(rf"{_BREAK}+")
_TOKEN = re.compile(r"(?:gh[pousr]_|xox[abprs]-)[A-Za-z0-9-]{20,}")
_CUES = (b"passw", b"secret", b"token", b"api_key", b"apikey")
_CASED = (b"AKIA", b"PRIVATE KEY", b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"xox")
_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[[*b"0123456789abcdef"]] = True


def _key(text: str, header: re.Match) -> str:
    """The whole key after a header: up to its END, or the base64 that follows where there is none."""
    mark = _MARK.search(text, header.end())
    if mark and text.startswith(f"-----END {header[1]}-----", mark.start()):
        body = text[header.end() : mark.start()]
    else:
        body = _BODY.match(text, header.end())[0]
    return _BREAKS.sub("", body)


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value), by start, then by kind as listed; code points."""
    out = [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    out += [("pem", *m.span(), _key(text, m)) for m in _PEM.finditer(text)]
    out += [("token", *m.span(), m[0]) for m in _TOKEN.finditer(text)]
    order = KINDS + ADDED
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def _flagged(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that can hold a candidate: a hexadecimal run of 16, or a cue in any case."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _HEX_BYTES[data]
    step = np.diff(inside)
    begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    out = np.zeros(len(off) - 1, bool)
    for k in np.flatnonzero(ends - begins >= 16):  # a run may span rows: each that it touches is looked at
        out[np.searchsorted(off, begins[k], "right") - 1 : np.searchsorted(off, ends[k], "left")] = True
    buffer = data.tobytes()
    for where, cues in ((buffer.lower(), _CUES), (buffer, _CASED)):
        for cue in cues:
            at = where.find(cue)
            while at >= 0:
                row = int(np.searchsorted(off, at, "right")) - 1
                out[row] = True
                at = where.find(cue, int(off[row + 1]))
    return out


_FOUND = "doc_id long, row long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, hashes array<long>"


def candidates(docs: DataFrame, owner: str | None = "source", repo: str | None = None) -> DataFrame:
    """One row per row of `docs` with its spans and the hashes of their values."""
    has = set(docs.columns)
    named = [F.col(c).cast("string").alias(a) if c in has else F.lit(None).cast("string").alias(a) for c, a in ((owner, "owner"), (repo or "doc_id", "repo"))]
    rows = X.plain(docs, *named).withColumn("row", F.xxhash64("doc_id", "text", "owner", "repo")).select("doc_id", "row", "owner", "repo", "text")
    empty = hashlib.sha256(b"").hexdigest()
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("owner", pa.string()), ("repo", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            n = b.num_rows
            counts = np.zeros((len(KINDS), n), np.int64)
            sha, spans, hashes = [empty] * n, [""] * n, [[]] * n
            for lo, _, data, off in X.chunks(b.column(4)):
                for j in np.flatnonzero(_flagged(data, off)):
                    i = lo + int(j)
                    found = find(data[off[j] : off[j + 1]].tobytes().decode())
                    if not found:
                        continue
                    for s in found:
                        if s[0] in KINDS:
                            counts[KINDS.index(s[0]), i] += 1
                    text = [",".join(f"{k}:{a}:{e}" for k, a, e, _ in found if k in kinds) for kinds in (KINDS, KINDS + ADDED)]
                    sha[i], spans[i] = hashlib.sha256(text[0].encode()).hexdigest(), text[1]
                    hashes[i] = [int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True) for *_, v in found]
            arrays = [b.column(k).cast(schema.field(k).type) for k in range(4)] + [pa.array(c) for c in counts] + [pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return rows.mapInArrow(run, _FOUND)


def ownership(each: DataFrame) -> DataFrame:
    """hash, owners, repos, held: distinct holders of each value, and its rows in `each`, over the whole corpus."""
    named = each.select("hash", *(F.coalesce(c, F.lit("\x00")).alias(c) for c in ("owner", "repo")))
    counts = [named.select("hash", c).distinct().groupBy("hash").agg(F.count("*").alias(a)) for c, a in (("owner", "owners"), ("repo", "repos"))]
    return each.groupBy("hash").agg(F.count("*").alias("held")).join(counts[0], "hash").join(counts[1], "hash")


def scan(docs: DataFrame, widely: int = 3, owner: str | None = "source", repo: str | None = None) -> DataFrame:
    """Spans of each row, what the corpus says of each, and its values that look live or copied.

    holders: for each of the spans, in their order, status:owners:repositories; n_live: values
    of a single owner; n_copied: values of at least `widely` owners.
    """
    staged = X.Staged(docs.sparkSession)
    found = staged.write(candidates(docs, owner, repo))
    each = staged.write(found.where("size(hashes) > 0").select("row", "owner", "repo", F.posexplode("hashes").alias("at", "hash")), share=8)
    known = staged.write(ownership(each), share=8)
    status = F.when(F.col("owners") == 1, "live").when(F.col("owners") >= widely, "copied").otherwise("shared")
    judged = X.looked_up(each.select("row", "at", "hash"), known, ["hash"], each.count())
    told = F.struct("at", F.concat_ws(":", status, "owners", "repos").alias("told"))
    of = lambda s: F.size(F.collect_set(F.when(status == s, F.col("hash")))).cast("long")
    judged = judged.groupBy("row").agg(F.sort_array(F.collect_set(told))["told"].alias("told"), of("live").alias("live"), of("copied").alias("copied"))
    out = found.join(judged, "row", "left")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.coalesce(F.array_join("told", ","), F.lit("")).alias("holders"), F.coalesce("live", F.lit(0)).alias("n_live"), F.coalesce("copied", F.lit(0)).alias("n_copied"))
