"""Iteration driven by the client: the same step on a head until a predicate or a number of rounds ends it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from weirflow.shared import checkpointed


def iterate(head: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, until: Callable[[DataFrame, DataFrame, int], bool] | None = None, checkpoint_every: int = 10) -> DataFrame:
    """step applied to the head, then to its own result, `rounds` times at most; until(before, after, round) ends it earlier.

    Lineage is cut every `checkpoint_every` rounds, and every round if `until` looks at results.
    """
    for n in range(1, rounds + 1):
        tail = step(head)
        if until is not None or (n % checkpoint_every == 0 and n < rounds):
            tail = checkpointed(tail)
        if until is not None and until(head, tail, n):
            return tail
        head = tail
    return head
