"""Thresholds, time ranges and conversions between them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from pathlib import Path

#: Capacity and first bucket of quarters, hours, days and months; the year is one bucket.
LEVELS = ((4, 0), (24, 4), (31, 28), (12, 59))
YEAR_BUCKET = 71
#: Quarters of an hour in one bucket of each granularity.
WIDTHS = (1, 4, 96, 2976, 35712)
QUARTER_SECONDS = 900

#: Bucket ranges by name.
TIME_RANGES = {"quarter": (0, 0), "hour": (4, 4), "day": (28, 28), "week": (28, 34), "month": (59, 59), "year": (71, 71), "all": (0, 71)}


@dataclass(frozen=True)
class Settings:
    """Shares are relative to events (page views), not to transactions."""

    min_support: float = 0.05
    min_pattern_support: float = 0.04
    min_confidence: float = 0.2
    speeds_path: str | None = None
    #: Share of a range's events; the minimum support where it is not set
    range_support: float | None = None

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1))

    @classmethod
    def load(cls, path: str) -> Settings:
        """The saved settings; defaults where the file or a key is missing."""
        p = Path(path)
        known = asdict(cls())
        return replace(cls(), **{k: v for k, v in (json.loads(p.read_text()) if p.exists() else {}).items() if k in known})


def support_from_margin(min_support: float, margin_percent: float) -> float:
    """The pattern threshold that an error margin leaves of the minimum support."""
    return min_support * (1 - margin_percent / 100)


def margin_from_support(min_support: float, min_pattern_support: float) -> float:
    """The error margin, in percent, of a pattern threshold."""
    return 100 * (1 - min_pattern_support / min_support)
