"""Dataflow graphs: named nodes, forward edges, backward edges for loops, and execution as one Spark plan per sink."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from weirflow.shared import checkpointed

#: Kinds of nodes that were never given a meaning; plans that use them are refused.
UNDEFINED = ("loop_control",)


@dataclass
class _Node:
    operator: Callable[..., DataFrame] | str
    inputs: list[str] = field(default_factory=list)
    parallelism: int | None = None


class Graph:
    """A graph of operators. A node is a function of its inputs' frames; sinks are what submit() gives.

    Nodes that feed several others are the same frame there. Backward edges make the graph a loop: submit(rounds=n)
    feeds the result of each edge's start (tail) into its end (head) for the next round, all edges at once.
    """

    def __init__(self, name: str = "graph"):
        self.name = name
        self._nodes: dict[str, _Node] = {}
        self._back: list[tuple[str, str]] = []

    def add(self, name: str, operator: Callable[..., DataFrame] | str, *inputs: str, parallelism: int | None = None) -> Graph:
        if name in self._nodes:
            raise ValueError(f"node {name!r} is there already")
        if isinstance(operator, str):
            raise NotImplementedError(f"operator {operator!r}" + (" is not defined" if operator in UNDEFINED else " is unknown"))
        self._nodes[name] = _Node(operator, list(inputs), parallelism)
        return self

    def connect(self, start: str, end: str, backward: bool = False) -> Graph:
        if backward:
            self._back.append((start, end))
        else:
            self._nodes[end].inputs.append(start)
        return self

    def order(self) -> list[str]:
        """Nodes, inputs first; a cycle of forward edges is an error, and so is a backward edge that closes none."""
        done: list[str] = []
        state: dict[str, int] = {}

        def visit(name: str) -> None:
            if name not in self._nodes:
                raise ValueError(f"no node {name!r}")
            if state.get(name) == 1:
                raise ValueError(f"forward edges form a cycle at {name!r}")
            if state.get(name) != 2:
                state[name] = 1
                for x in self._nodes[name].inputs:
                    visit(x)
                state[name] = 2
                done.append(name)

        for name in self._nodes:
            visit(name)
        for start, end in self._back:
            if end not in self._above(start):
                raise ValueError(f"the backward edge {start!r} to {end!r} closes no cycle")
        return done

    def _above(self, name: str) -> set[str]:
        found = {name}
        for x in self._nodes[name].inputs:
            found |= self._above(x)
        return found

    def sinks(self) -> list[str]:
        used = {x for n in self._nodes.values() for x in n.inputs}
        return [n for n in self._nodes if n not in used]

    def frames(self, given: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """The frame of every node; given: frames in place of nodes."""
        out: dict[str, DataFrame] = dict(given or {})
        for name in self.order():
            if name not in out:
                node = self._nodes[name]
                df = node.operator(*[out[x] for x in node.inputs])
                out[name] = df.repartition(node.parallelism) if node.parallelism else df
        return out

    def submit(self, rounds: int = 1, until: Callable[[DataFrame, DataFrame, int], bool] | None = None, checkpoint_every: int = 10) -> dict[str, DataFrame]:
        """The frames of the sinks, lazily; a failed action raises. With backward edges, those of the tails after so many rounds, or once `until` holds for every edge."""
        if not self._back:
            return {s: f for s, f in self.frames().items() if s in self.sinks()}
        heads = self._loop_heads()
        for n in range(1, rounds + 1):
            frames = self.frames(heads)
            fresh = {head: frames[tail] for tail, head in self._back}
            if until is not None or (n % checkpoint_every == 0 and n < rounds):
                fresh = {head: checkpointed(df) for head, df in fresh.items()}
            done = until is not None and all(until(heads[h], fresh[h], n) for h in fresh)
            heads = fresh
            if done:
                break
        return {tail: heads[head] for tail, head in self._back}

    def _loop_heads(self) -> dict[str, DataFrame]:
        ends = [head for _, head in self._back]
        if len(set(ends)) < len(ends):
            raise ValueError("two backward edges end at one node")
        first = self.frames()
        return {head: first[head] for head in ends}
