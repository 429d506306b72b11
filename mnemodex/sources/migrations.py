"""Ordered schema versions of a table: each step has a way up and a way down, both frames to frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame


class Step(NamedTuple):
    """Leads from the version before to its own place in the list, counted from 1."""

    up: Callable[[DataFrame], DataFrame]
    down: Callable[[DataFrame], DataFrame]


def migrate(table: DataFrame, have: int, want: int, steps: Sequence[Step]) -> DataFrame:
    """The table of version `have` as version `want`. A version that no step leads to, such as one of later code, is an error.

    The steps are projections of one plan, so the rewrite reads and writes a table once, however many there are.
    """
    for v in (have, want):
        if not 0 <= v <= len(steps):
            raise ValueError(f"schema version {v} is unknown, the last one is {len(steps)}")
    for step in steps[have:want]:
        table = step.up(table)
    for step in reversed(steps[want:have]):
        table = step.down(table)
    return table
