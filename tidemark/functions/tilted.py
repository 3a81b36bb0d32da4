"""Tilted-time windows as column expressions.

The newest batches keep buckets of their own (quarters); older ones merge into hours,
days, months and one year.  A granularity passes its oldest group on only when a new
entry needs the room.  The bucket of a batch follows in closed form from its number and
the count of batches, so a window is a plain aggregation by bucket.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import LEVELS, QUARTER_SECONDS, WIDTHS, YEAR_BUCKET

N_BUCKETS = YEAR_BUCKET + 1
#: Width in quarters of each bucket, and the quarters before it.
BUCKET_WIDTHS = [w for (cap, _), w in zip(LEVELS, WIDTHS, strict=False) for _ in range(cap)] + [WIDTHS[-1]]
BUCKET_STARTS = [0, *accumulate(BUCKET_WIDTHS)]


def _div(x: Column, by: int) -> Column:
    return F.floor(x / F.lit(by)).cast("long")


def bucket(batch: Column, n: Column) -> Column:
    """Bucket of 0-based batch `batch` once `n` batches are in; null when it has aged out."""
    index, count, out = batch.cast("long"), n.cast("long"), F
    for cap, first in LEVELS:
        done = _div(count - 1, cap)
        test = index >= done * cap
        value = (F.lit(first) + count - 1 - index).cast("int")
        out = F.when(test, value) if out is F else out.when(test, value)
        index, count = _div(index, cap), done
    return out.when(index == count - 1, F.lit(YEAR_BUCKET))


def bucket_sql(batch: str, n: str) -> str:
    """The same as SQL text with integer division `//`."""
    index, count, cases = batch, n, []
    for cap, first in LEVELS:
        done = f"(({count} - 1) // {cap})"
        cases.append(f"WHEN {index} >= {done} * {cap} THEN {first} + {count} - 1 - {index}")
        index, count = f"({index} // {cap})", done
    return f"CASE {' '.join(cases)} WHEN {index} = {count} - 1 THEN {YEAR_BUCKET} END"


def quarter_distance(bucket: int, including: bool) -> int:
    """Quarters between now and the near (or, including the bucket, far) edge of a bucket."""
    if not 0 <= bucket < N_BUCKETS:
        raise ValueError(f"no bucket {bucket}")
    return BUCKET_STARTS[bucket + including]


def interval(first: int, last: int, start: Column, end: Column) -> tuple[Column, Column]:
    """Seconds (from, to) that the buckets first..last cover, for data from start to end seconds."""
    now = F.ceil(end / QUARTER_SECONDS) * QUARTER_SECONDS
    return (
        F.greatest(now - quarter_distance(last, True) * QUARTER_SECONDS, start).cast("long"),
        F.greatest(now - quarter_distance(first, False) * QUARTER_SECONDS, start).cast("long"),
    )


def window_array(supports: Column, n: int = N_BUCKETS) -> Column:
    """Array of the first n buckets from a map of bucket to support; null where unused."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at(supports, i))
