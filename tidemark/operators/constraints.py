"""Item constraints as predicates on arrays of items.

Exact names form one group; each wildcard pattern is a group of its own.  Wildcards
stand for all known items that match, so "all" and "not all" compare the number of
matching items in the itemset with the number known (`known`, see `count_known`).
Groups and types are joined by "and".

A wildcard that matches no known item holds no itemset back, except that "any" of it
is false unless `vacuous` is set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.items import is_pattern, matches

TYPES = ("positive_all", "positive_any", "negative_all", "negative_any")


def count_known(tx: DataFrame, patterns: Iterable[str]) -> dict[str, int]:
    """How many distinct items match each wildcard; one small row reaches the driver."""
    wild = [p for p in patterns if is_pattern(p)]
    if not wild:
        return {}
    items = tx.select(F.explode("items").alias("item")).distinct()
    row = items.agg(*[F.sum(matches(F.col("item"), p).cast("long")).alias(str(i)) for i, p in enumerate(wild)]).first()
    return {p: int(row[i] or 0) for i, p in enumerate(wild)}


def _matching(pattern: str) -> Callable[[Column], Column]:
    return lambda x: matches(x, pattern)


@dataclass(frozen=True)
class Constraints:
    positive_all: tuple[str, ...] = ()
    positive_any: tuple[str, ...] = ()
    negative_all: tuple[str, ...] = ()
    negative_any: tuple[str, ...] = ()
    vacuous: bool = False

    def add(self, kind: str, *patterns: str) -> Constraints:
        if kind not in TYPES:
            raise ValueError(f"no constraint type {kind!r}")
        return Constraints(**{**self.__dict__, kind: (*getattr(self, kind), *patterns)})

    def merged(self, other: Constraints) -> Constraints:
        """Both; thus constraints on a consequent also hold for the whole itemset."""
        return Constraints(**{t: tuple(dict.fromkeys((*getattr(self, t), *getattr(other, t)))) for t in TYPES}, vacuous=self.vacuous or other.vacuous)

    def patterns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(p for t in TYPES for p in getattr(self, t)))

    def __bool__(self) -> bool:
        return bool(self.patterns())

    def predicate(self, items: Column, known: Mapping[str, int] | None = None) -> Column:
        known = known or {}
        tests: list[Column] = []
        for kind in TYPES:
            given = getattr(self, kind)
            exact = [p for p in given if not is_pattern(p)]
            if exact:
                names = F.array(*[F.lit(p) for p in exact])
                tests.append({"positive_all": F.size(F.array_except(names, items)) == 0, "positive_any": F.arrays_overlap(items, names), "negative_all": ~F.arrays_overlap(items, names), "negative_any": F.size(F.array_except(names, items)) > 0}[kind])
            for p in filter(is_pattern, given):
                some = F.exists(items, _matching(p))
                if kind in ("positive_all", "negative_any"):
                    if p not in known:
                        raise ValueError(f"{kind} of {p!r} needs the number of known items that match")
                    count = F.size(F.filter(items, _matching(p)))
                    tests.append((count >= known[p]) if kind == "positive_all" else (count < known[p]) | F.lit(known[p] == 0))
                elif kind == "positive_any":
                    tests.append(some | F.lit(self.vacuous and known.get(p) == 0))
                else:
                    tests.append(~some)
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def after_counting(self, known: Mapping[str, int] | None = None) -> Column:
        """The predicate on counted itemsets (items, support).

        It refers to the support, so that it stays above the aggregation: there it sees
        each itemset once, and plans that count the same itemsets can share the work.
        """
        return F.when(F.col("support") >= 0, self.predicate(F.col("items"), known))

    def item_predicate(self, item: Column, known: Mapping[str, int] | None = None) -> Column:
        """The same for a single item."""
        return self.predicate(F.array(item), known)

    def prune(self, items: Column) -> Column:
        """Transactions without the items that no result may hold: a safe push-down."""
        banned = [p for p in self.negative_all]
        return F.filter(items, lambda x: ~reduce(lambda a, b: a | b, [matches(x, p) for p in banned])) if banned else items


    def needed(self, items: Column, known: Mapping[str, int] | None = None) -> Column:
        """Whether a transaction can hold an itemset that meets the positive constraints: a safe push-down.

        Supports of such itemsets stay as they are, since all their transactions stay.
        """
        known, tests = known or {}, []
        for kind in ("positive_all", "positive_any"):
            exact = [p for p in getattr(self, kind) if not is_pattern(p)]
            if exact:
                names = F.array(*[F.lit(p) for p in exact])
                tests.append(F.size(F.array_except(names, items)) == 0 if kind == "positive_all" else F.arrays_overlap(items, names))
            tests += [F.exists(items, _matching(p)) for p in filter(is_pattern, getattr(self, kind)) if known.get(p)]
        return reduce(lambda a, b: a & b, tests, F.lit(True))


#: Page views need an episode; what is explained is slowness.
DEFAULT_ITEMSETS = Constraints(positive_any=("episode:*",))
DEFAULT_CONSEQUENT = Constraints(positive_any=("duration:slow",))
