"""Operators by name, and plans declared as sequences of them.

A registry refuses a name twice; ``initialize`` fills the default one and may be called any number of times.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from ..errors import Invalid
from ..functions import tdigest
from ..operators import aggregate, asof, filter, merge, pipes, pivot, relational, write  # noqa: A004
from ..ordering import OrderedFrame
from ..sources import files, memory


class Registry:
    def __init__(self):
        self.made: dict[str, Callable] = {}

    def add(self, name: str, operator: Callable) -> None:
        if operator is None:
            raise Invalid("an operator is required")
        if name in self.made:
            raise KeyError(f"{name!r} is registered already")
        self.made[name] = operator

    def get(self, name: str) -> Callable:
        if name not in self.made:
            raise KeyError(f"no operator {name!r}")
        return self.made[name]

    def names(self) -> list[str]:
        return sorted(self.made)


_DEFAULT = Registry()


def operators() -> dict[str, Callable]:
    """Each operator with its inputs first: none for sources, one frame, or a list of frames."""
    return {
        "source": memory.source,
        "table_source": memory.table_source,
        "record_batch_source": memory.record_batch_source,
        "record_batch_reader_source": memory.reader_source,
        "exec_batch_source": memory.exec_batch_source,
        "array_vector_source": memory.array_vector_source,
        "scan": files.scan,
        "filter": filter.filter_rows,
        "project": relational.project,
        "pivot_longer": pivot.pivot_longer,
        "asofjoin": lambda inputs, **o: asof.asof_join(inputs[0], inputs[1:], **o),
        "sorted_merge": merge.sorted_merge,
        "aggregate": aggregate.aggregate,
        "aggregate_sets": aggregate.aggregate_sets,
        "order_by": relational.order_by,
        "fetch": relational.fetch,
        "union": lambda inputs: relational.union(*inputs),
        "intersect": lambda inputs, **o: relational.intersect(*inputs, **o),
        "subtract": lambda inputs, **o: relational.subtract(*inputs, **o),
        "join": lambda inputs, **o: relational.join(*inputs, **o),
        "theta_join": lambda inputs, **o: relational.theta_join(*inputs, **o),
        "analytic": relational.analytic,
        "pipe_source": lambda pipes_, **o: pipes_.source(**o),
        "pipe_sink": lambda frame, pipes, **o: pipes.sink(frame, **o),
        "pipe_tee": lambda frame, pipes, **o: pipes.tee(frame, **o),
        "write": write.write,
        "tee": write.tee,
        "tdigest_quantile_element_wise": lambda frame, **o: frame.with_data(tdigest.quantile_elementwise(frame.data, **o)),
    }


def initialize(registry: Registry | None = None) -> Registry:
    """Fill the default registry (once), or another one."""
    into = registry if registry is not None else _DEFAULT
    if into is _DEFAULT and into.made:
        return into
    for name, operator in operators().items():
        into.add(name, operator)
    return into


@dataclass(frozen=True)
class Declaration:
    """A node of a plan: an operator's name, its options, and its inputs."""

    name: str
    options: dict[str, Any] = field(default_factory=dict)
    inputs: tuple[Declaration | OrderedFrame, ...] = ()

    @classmethod
    def sequence(cls, *steps: Declaration | OrderedFrame) -> Declaration:
        """Each step reads the one before."""
        made = steps[0]
        for s in steps[1:]:
            made = Declaration(s.name, s.options, (made, *s.inputs))
        return made

    def frame(self, registry: Registry | None = None) -> OrderedFrame:
        """Build the plan. Contracts are checked now; rows move when the result is used."""
        operator = (registry or initialize()).get(self.name)
        inputs = [i.frame(registry) if isinstance(i, Declaration) else i for i in self.inputs]
        if not inputs:
            return operator(**self.options)
        many = self.name in ("asofjoin", "sorted_merge", "union", "intersect", "subtract", "join", "theta_join")
        return operator(inputs if many else _single(inputs), **self.options)


def _single(inputs: Sequence[OrderedFrame]) -> OrderedFrame:
    if len(inputs) != 1:
        raise Invalid(f"one input is needed, not {len(inputs)}")
    return inputs[0]
