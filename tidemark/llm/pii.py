"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, schemes and
account cues); a deterministic parser expands each anchor to both sides and validates
what it found.  Parsers never scan a stretch twice, so the time is linear in the text.

Kinds `email`, `ip`, `card` and `phone` equal the leftmost non-overlapping matches of
plain patterns; `iban` (after a cue, with valid check digits) and `login` (credentials
within an address) are added by the method.

Defined results: a null text counts as empty; a null doc_id is carried through; equal
rows give equal results; an empty table gives an empty table; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import textcore as X

KINDS = ("email", "ip", "card", "phone")
ADDED = ("iban", "login")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9]++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[\x20:#]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
#: Lengths of account numbers by country; others may have any from 15 to 34
_IBAN_LENGTH = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 "
        "GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 "
        "OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_LOGIN = re.compile(r"[^\s/@:]++:[^\s/@]++@[A-Za-z0-9.-]+")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_ANCHOR_BYTES = np.zeros(256, bool)
_ANCHOR_BYTES[[*b"@+/0123456789"]] = True


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), ("://", "s"), ("IBAN", "i"), ("iban", "i"), *((d, "d") for d in "0123456789")]:
        a.add_word(word, kind)
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def _iban_valid(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _iban_end(code: str) -> int:
    """Where the account number that `code` begins with ends, at a word break; 0 if there is none.

    That is where the country's length ends, or else all of `code`; where the length is not
    known, the longest end with valid check digits.
    """
    ends = [m.start() for m in re.finditer(r"\x20|\Z", code)][::-1]
    if length := _IBAN_LENGTH.get(code[:2]):
        ends = [e for e in ends if e - code.count(" ", 0, e) == length] + ends[:1]
    return next((e for e in ends if _iban_valid(code[:e])), 0)


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by kind as listed, then by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS + ADDED}
    email_end = ip_end = card_end = phone_end = iban_end = 0
    for at, kind in _automaton().iter(text):
        if kind == "d":
            if at >= card_end:
                m = _CARD.match(text, at)
                if m:
                    card_end = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
            if at >= ip_end:
                m = _IP.match(text, at)
                if m:
                    ip_end = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                        out["ip"].append(m.span())
                else:
                    ip_end = _DIGITS.match(text, at).end()
        elif kind == "@":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                out["email"].append((start, email_end))
        elif kind == "+":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif kind == "s":
            if m := _LOGIN.match(text, at + 1):
                start = at - 2
                while start > 0 and text[start - 1] in _SCHEME:
                    start -= 1
                out["login"].append((start, m.end()))
        elif at >= iban_end and (m := _IBAN.match(text, at + 1)) and (end := _iban_end(m[1])):
            iban_end = m.start(1) + end
            out["iban"].append((m.start(1), iban_end))
    return [(k, a, b) for k, found in out.items() for a, b in found]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind's mark."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def _flagged(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each row holds any byte that an anchor needs."""
    hits = np.flatnonzero(_ANCHOR_BYTES[data])
    return np.diff(np.searchsorted(hits, off)) > 0


def _scan(column: pa.Array):
    """(row, text, spans) of the rows that hold an anchor."""
    for lo, hi, data, off in X.chunks(column):
        for i in np.flatnonzero(_flagged(data, off)):
            text = data[off[i] : off[i + 1]].tobytes().decode()
            yield lo + int(i), text, find(text)


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_spans(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: counts, the digest of the base spans, and all spans."""
    empty = hashlib.sha256(b"").hexdigest()
    fields = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]

    def run(batches):
        for b in batches:
            n = b.num_rows
            counts = np.zeros((len(KINDS) + 1, n), np.int64)
            sha, spans = [empty] * n, [""] * n
            for i, _, found in _scan(b.column(1)):
                base = [s for s in found if s[0] in KINDS]
                for s in found:
                    counts[KINDS.index(s[0]) if s[0] in KINDS else -1, i] += 1
                joined = [",".join(f"{k}:{a}:{e}" for k, a, e in part) for part in (base, found)]
                sha[i], spans[i] = hashlib.sha256(joined[0].encode()).hexdigest(), joined[1]
            arrays = [b.column(0), *(pa.array(c) for c in counts[:-1]), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(counts[-1])]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

    return X.plain(docs).mapInArrow(run, _SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every personal span replaced by its kind's mark; n_chars follows if present.

    Rows without such spans, null texts included, stay as they are.
    """
    names = docs.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for b in batches:
            columns, new = list(b.columns), {}
            for i, text, found in _scan(b.column(at)):
                if found:
                    new[i] = redacted(text, found)
            if new:
                rows = np.fromiter(new, np.int64)
                where = np.zeros(b.num_rows, bool)
                where[rows] = True
                mask = pa.array(where)
                columns[at] = pa.compute.replace_with_mask(columns[at], mask, pa.array(list(new.values()), columns[at].type))
                if chars is not None:
                    columns[chars] = pa.compute.replace_with_mask(columns[chars], mask, pa.array([len(t) for t in new.values()], columns[chars].type))
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    import pyarrow.compute  # noqa: F401

    return docs.mapInArrow(X.tidy(run), T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
