"""The time a micro-batch runs at."""

from __future__ import annotations

from collections.abc import Callable

#: A fixed time in unix ms, so that a run can be repeated, or a function that every batch asks once.
Clock = int | Callable[[], int]


def read_clock(now_ms: Clock) -> int:
    return int(now_ms()) if callable(now_ms) else now_ms
