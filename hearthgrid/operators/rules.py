"""Scenario rules as data.

A rule says: in these scenarios, where this holds, that column takes this value.
Rules of one stage all read the stage's input, so a stage compiles to a single
projection of ``CASE`` expressions; later stages see the results of earlier ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Columns that stand for those of the row while values of one scenario are made.
_seen: dict[str, Column] = {}


def col(name: str) -> Column:
    """A column as rules see it: the row's own, or what earlier stages made of it."""
    return _seen.get(name, F.col(name))


@contextmanager
def seeing(columns: Mapping[str, Column]) -> Iterator[None]:
    before = dict(_seen)
    _seen.update(columns)
    try:
        yield
    finally:
        _seen.clear()
        _seen.update(before)


@dataclass(frozen=True)
class Rule:
    scenarios: frozenset[float]
    column: str
    value: Callable[[], Column]
    when: Callable[[], Column] | None = None

    def applies(self, scenario_column: str) -> Column:
        ids = ", ".join(f"{s!r}D" for s in sorted(self.scenarios))
        chosen = F.expr(f"`{scenario_column}` IN ({ids})")
        return chosen if self.when is None else chosen & self.when()


def rule(scenarios: Iterable[float], column: str, value, when=None) -> Rule:
    """``value`` may be a Python literal or a function returning a Column."""
    make = value if callable(value) else (lambda: F.lit(value))
    return Rule(frozenset(float(s) for s in scenarios), column, make, when)


def apply_stage(
    df: DataFrame,
    rules: Sequence[Rule],
    scenario_column: str = "upgrade_id",
    flag: str | None = None,
) -> DataFrame:
    """Apply one stage. Per column the first rule that holds wins; null conditions do not hold.

    ``flag`` names a column that becomes 1 wherever any rule held.
    """
    by_column: dict[str, list[Rule]] = {}
    for r in rules:
        by_column.setdefault(r.column, []).append(r)
    changed = {}
    for name, own in by_column.items():
        chain = F
        for r in own:
            chain = chain.when(r.applies(scenario_column), r.value())
        changed[name] = chain.otherwise(F.col(name) if name in df.columns else F.lit(None))
    if flag:
        any_rule = F.lit(False)
        for r in rules:
            any_rule = any_rule | F.coalesce(r.applies(scenario_column), F.lit(False))
        changed[flag] = F.when(any_rule, 1).otherwise(F.col(flag))
    return df.withColumns(changed)


def stage_values(
    rules: Callable[[], Sequence[Rule]], scenario: float, seen: Mapping[str, Column]
) -> dict[str, Column]:
    """``seen`` after one stage of one scenario, as expressions over the unchanged row.

    Rules of other scenarios leave nothing behind, so the variants of many scenarios fit
    side by side into one projection.
    """
    by_column: dict[str, list[Rule]] = {}
    changed = {}
    with seeing(seen):
        for r in rules():
            if scenario in r.scenarios:
                by_column.setdefault(r.column, []).append(r)
        for name, own in by_column.items():
            chain = F
            for r in own:
                chain = chain.when(F.lit(True) if r.when is None else r.when(), r.value())
            changed[name] = chain.otherwise(col(name))
    return {**seen, **changed}
