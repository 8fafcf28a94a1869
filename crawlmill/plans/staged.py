"""Named DataFrame stages with optional checks.

Stages only build a plan, so Catalyst sees the whole chain. A checked stage costs one aggregate; the
frame of a checked stage is cached for it when asked. Wrong column names fail while the plan is built
and stop the run there; errors inside the data surface at the next check or action, or at once with
``eager=True``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]
Check = Column | Callable[[DataFrame], bool]


@dataclass(frozen=True)
class Stage:
    name: str
    transform: Transform
    check: Check | None = None  # aggregate condition, e.g. F.count("*") > 0


@dataclass
class StagedRun:
    """Outcome of a run. ``rows_in`` and ``rows_out`` are counted when first asked for."""

    source: DataFrame
    output: DataFrame
    stages_completed: int = 0
    stage_timings: dict[str, float] = field(default_factory=dict)
    validation_passed: bool = True
    error: Exception | None = None

    @cached_property
    def rows_in(self) -> int:
        return self.source.count()

    @cached_property
    def rows_out(self) -> int:
        return self.output.count()


def _holds(check: Check, df: DataFrame) -> bool:
    if isinstance(check, Column):
        return bool(df.agg(F.coalesce(check, F.lit(False)).alias("ok")).first()["ok"])
    return bool(check(df))


class StagedTransform:
    """An ordered list of named stages; frames are immutable, so the input is never changed."""

    def __init__(self) -> None:
        self._stages: list[Stage] = []

    def add_stage(self, name: str, transform: Transform, check: Check | None = None) -> None:
        self._stages.append(Stage(name, transform, check))

    def stage_names(self) -> list[str]:
        return [s.name for s in self._stages]

    def dry_run(self, df: DataFrame) -> list[str]:
        """Stage names in order; nothing is run."""
        return self.stage_names()

    def remove_stage(self, name: str) -> bool:
        """Remove the first stage of that name; whether there was one."""
        for s in self._stages:
            if s.name == name:
                self._stages.remove(s)
                return True
        return False

    def run(self, df: DataFrame, eager: bool = False) -> StagedRun:
        """Run the stages until one raises or a check fails; the current frame is the output."""
        result = StagedRun(source=df, output=df)
        for stage in self._stages:
            start = time.monotonic()
            try:
                current = stage.transform(result.output)
                if eager:
                    current.write.format("noop").mode("overwrite").save()
            except Exception as exc:  # user code: any error ends the run
                result.validation_passed, result.error = False, exc
                return result
            result.output = current
            result.stage_timings[stage.name] = round((time.monotonic() - start) * 1000, 2)
            result.stages_completed += 1
            if stage.check is None:
                continue
            try:
                passed = _holds(stage.check, current)
            except PySparkException as exc:  # a data error that showed up in the check
                passed, result.error = False, exc
            if not passed:
                result.validation_passed = False
                return result
        return result
