"""Rule sets: the migrations a deployment knows.

A rule set offers Column expressions and table functions over source files.  Optional hooks are
looked up by name, so a rule set states only what it needs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

HOOKS = (
    "pin_rules", "should_plan_artifacts", "artifact_plan_violations", "materialize_artifact_contracts",
    "build_test_normalizations", "seam_decisions",
)


@runtime_checkable
class RuleSet(Protocol):
    name: str

    def matches(self, files: DataFrame) -> DataFrame: ...

    def plan_files(self, files: DataFrame) -> DataFrame: ...


_KNOWN: dict[str, RuleSet] = {}


def register(rules: RuleSet) -> RuleSet:
    _KNOWN[rules.name] = rules
    return rules


def get(name: str) -> RuleSet | None:
    return _KNOWN.get(name)


def known() -> list[str]:
    return sorted(_KNOWN)


def hook(rules: RuleSet, name: str) -> Callable | None:
    """An optional hook of a rule set."""
    if name not in HOOKS:
        raise KeyError(name)
    return getattr(rules, name, None)


@dataclass
class FlaskToFastAPI:
    name: str = "flask_to_fastapi"
    hooks: tuple[str, ...] = field(default=HOOKS)

    def matches(self, files: DataFrame) -> DataFrame:
        from ..operators import migration_plan

        return migration_plan.matching_repos(files)

    def plan_files(self, files: DataFrame) -> DataFrame:
        from ..operators import migration_plan

        return migration_plan.planned_files(files)

    def pin_rules(self):
        from ..operators import contracts

        return contracts.SHIPPED_RULES

    def should_plan_artifacts(self, files: DataFrame) -> DataFrame:
        from ..operators import migration_plan

        return migration_plan.wants_new_modules(files)

    def seam_decisions(self, files: DataFrame, planned: DataFrame) -> DataFrame:
        from ..operators import seams

        return seams.decisions(files, planned)


register(FlaskToFastAPI())
