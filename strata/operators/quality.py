"""Expectations: named SQL predicates with the actions drop, warn and fail.

A rule that evaluates to NULL counts as violated.  All counters are taken on the cleaned
input in one pass; ``drop`` rules are applied afterwards as one filter.  Counters come
either from an aggregate (a separate job) or from an ``Observation`` attached to the
action that writes the data (no second scan).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strata.config import Rule, TableConfig, rules_of


class ExpectationFailed(RuntimeError):
    """A ``fail`` rule was violated; nothing was published."""

    def __init__(self, table: str, failures: Mapping[str, int]):
        self.table = table
        self.failures = dict(failures)
        detail = ", ".join(f"{k}: {v} rows" for k, v in sorted(self.failures.items()))
        super().__init__(f"{table}: fail expectations violated ({detail})")


def holds(rule: str) -> Column:
    """The rule as a predicate where NULL means violated."""
    return F.coalesce(F.expr(rule), F.lit(False))


Rules = TableConfig | Mapping[str, Mapping[str, str]] | Iterable[Rule]


def _rules(spec: Rules) -> tuple[Rule, ...]:
    return spec.rules if isinstance(spec, TableConfig) else rules_of(spec)


def violation_counters(rules: Iterable[Rule]) -> list[Column]:
    """One ``count_if(NOT rule)`` per rule plus the row count, as named aggregate columns."""
    return [F.count(F.lit(1)).alias("_rows"), *(F.count_if(~holds(r.expr)).alias(f"_failed:{r.name}") for r in rules)]


def apply_drop(df: DataFrame, spec: Rules) -> DataFrame:
    """Keep the rows for which every ``drop`` rule holds (one filter, pushed down where possible)."""
    drop = [holds(r.expr) for r in _rules(spec) if r.action == "drop"]
    return df.where(reduce(lambda a, b: a & b, drop)) if drop else df


def observed(observation: Observation) -> dict | None:
    """What was observed; None if the plan turned out empty at run time (every row dropped, or
    none there) and the observed node went with it."""
    try:
        return observation.get
    except (AssertionError, Py4JJavaError) as e:
        if "assert" not in f"{type(e).__name__} {e}".lower():
            raise
        return None


@dataclass
class CheckedFrame:
    """A frame with expectations attached.  ``df`` is lazy; counters fill in after an action."""

    df: DataFrame
    rules: tuple[Rule, ...]
    observation: Observation | None
    table: str
    source: DataFrame

    def metrics(self) -> dict[str, dict[str, int]]:
        """``{rule: {action, failed, passed}}``, available once ``df`` has been acted on."""
        if self.observation is None:
            return {}
        got = observed(self.observation)
        if got is None:  # nothing was seen: count the input itself
            got = self.source.agg(*violation_counters(self.rules)).first().asDict()
        rows = int(got.get("_rows", 0))
        failed = {r.name: int(got.get(f"_failed:{r.name}", 0)) for r in self.rules}
        return {r.name: {"action": r.action, "failed": failed[r.name], "passed": rows - failed[r.name]} for r in self.rules}

    def raise_on_fail(self) -> None:
        bad = {n: m["failed"] for n, m in self.metrics().items() if m["action"] == "fail" and m["failed"]}
        if bad:
            raise ExpectationFailed(self.table, bad)


def check(df: DataFrame, spec: Rules, table: str | None = None, observe: bool = False) -> CheckedFrame:
    """Apply ``drop``; with ``observe`` also count every rule on the cleaned input.

    The counters ride on whatever action consumes ``df`` (the Silver write), so they cost
    no extra scan; they are read from the returned frame's :meth:`CheckedFrame.metrics`.
    """
    rules = _rules(spec)
    name = table or (spec.name if isinstance(spec, TableConfig) else "table")
    if not rules or not observe:
        return CheckedFrame(apply_drop(df, rules), rules, None, name, df)
    obs = Observation(f"dq_{name}_{uuid.uuid4().hex[:8]}")
    observed = df.observe(obs, *violation_counters(rules))
    return CheckedFrame(apply_drop(observed, rules), rules, obs, name, df)


def expectation_metrics(df: DataFrame, spec: Rules) -> DataFrame:
    """Per rule: rule, action, passed, failed -- one aggregate pass, then unpivoted.

    The aggregate is partial per task, so only one small row per task is shuffled.
    """
    rules = _rules(spec)
    if not rules:
        raise ValueError("no expectations to measure")
    wide = df.agg(*violation_counters(rules))
    failed = lambda r: F.col(f"`_failed:{r.name}`")
    one = lambda r: F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"), (F.col("_rows") - failed(r)).alias("passed"), failed(r).alias("failed"))
    return wide.select(F.inline(F.array(*map(one, rules))))


def assert_no_failures(df: DataFrame, spec: Rules, table: str = "table") -> None:
    """Evaluate only the ``fail`` rules (one aggregate) and raise if any is violated."""
    rules = [r for r in _rules(spec) if r.action == "fail"]
    if not rules:
        return
    row = df.agg(*violation_counters(rules)).first()
    bad = {r.name: int(row[f"_failed:{r.name}"]) for r in rules if row[f"_failed:{r.name}"]}
    if bad:
        raise ExpectationFailed(table, bad)
