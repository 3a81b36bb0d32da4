"""One entry to batches of transactions, with thresholds from settings."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import TIME_RANGES, Settings
from tidemark.operators import compare, itemsets, patterns, report
from tidemark.operators.constraints import DEFAULT_CONSEQUENT, DEFAULT_ITEMSETS, Constraints, count_known
from tidemark.operators.transactions import batch_sizes


class Analyst:
    """Mines transactions (batch_id, event_id, items) as `settings` say.

    Ranges are names out of `TIME_RANGES` or pairs of buckets.
    """

    def __init__(self, tx: DataFrame, settings: Settings | None = None, wanted: Constraints = DEFAULT_ITEMSETS, consequent: Constraints = DEFAULT_CONSEQUENT, max_len: int = 3):
        self.tx, self.settings, self.wanted, self.consequent, self.max_len = tx, settings or Settings(), wanted, consequent, max_len

    @cached_property
    def sizes(self) -> DataFrame:
        return batch_sizes(self.tx)

    @cached_property
    def batches(self) -> int:
        return int(self.sizes.agg(F.max("batch_id")).first()[0] or 0) + 1

    @cached_property
    def patterns(self) -> DataFrame:
        return patterns.batch_patterns(self.tx, self.settings.min_pattern_support, self.max_len, self.sizes)

    @cached_property
    def _known(self) -> dict[str, int]:
        return count_known(self.tx, self.wanted.merged(self.consequent).patterns())

    @property
    def _share(self) -> float:
        s = self.settings
        return s.min_support if s.range_support is None else s.range_support

    @staticmethod
    def _buckets(period: str | tuple[int, int]) -> tuple[int, int]:
        return TIME_RANGES[period] if isinstance(period, str) else period

    def itemsets(self) -> DataFrame:
        """All frequent itemsets over the whole input, of any length."""
        events = self.tx.select("event_id").distinct().count()
        return itemsets.frequent_itemsets(self.tx, max(1, -int(-self.settings.min_support * events // 1)), None, self.wanted)

    def rules(self, period: str | tuple[int, int]) -> DataFrame:
        return patterns.range_rules(self.patterns, self.sizes, self.batches, *self._buckets(period), self._share, self.settings.min_confidence, self.wanted, self.consequent, known=self._known)

    def causes(self, period: str | tuple[int, int]) -> DataFrame:
        return report.cause_report(self.rules(period))

    def compared(self, older: str | tuple[int, int], newer: str | tuple[int, int]) -> DataFrame:
        return compare.compare_rules(self.rules(older), self.rules(newer))
