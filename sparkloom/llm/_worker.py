"""What a Python worker keeps from task to task, and lets go where a task of another stage needs the memory."""

from __future__ import annotations

import gc

_kept: list[dict] = []


def keeping(table: dict) -> dict:
    """`table`, which let_go() empties."""
    _kept.append(table)
    return table


def let_go() -> None:
    """Frees what other stages have kept in this worker; they make it again when they need it."""
    if any(_kept):
        for table in _kept:
            table.clear()
        gc.collect()
