"""Named pipes: one producer, any number of receivers of the same rows.

Branches of a DataFrame are independent, so a limit on one cannot starve another. The producer's frame is persisted,
which makes receivers see the same rows even if it is not deterministic; ``close`` frees it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import types as T

from ..errors import Invalid
from ..ordering import OrderedFrame, Ordering


@dataclass
class Pipes:
    """The pipes of one plan."""

    held: dict[str, OrderedFrame] = field(default_factory=dict)

    def sink(self, frame: OrderedFrame, name: str, pause_on_any: bool = True, stop_on_any: bool = False, persist: bool = True) -> None:
        """Publish a frame. ``pause_on_any`` has no meaning where receivers pull; stopping all receivers with the first
        one has no relational meaning and is refused."""
        if stop_on_any:
            raise NotImplementedError("stop_on_any: receivers are independent")
        if name in self.held:
            raise Invalid(f"pipe {name!r} has a sink already")
        data = frame.data.persist(StorageLevel.MEMORY_AND_DISK) if persist else frame.data
        self.held[name] = frame.with_data(data)

    def tee(self, frame: OrderedFrame, name: str, **options) -> OrderedFrame:
        """Publish a frame and go on with it."""
        self.sink(frame, name, **options)
        return self.held[name]

    def source(self, name: str, schema: T.StructType | None = None, ordering: Ordering | None = None) -> OrderedFrame:
        """Receive a published frame; its schema and ordering must be what the receiver expects, if it says so."""
        if name not in self.held:
            raise Invalid(f"pipe {name!r} has no sink")
        frame = self.held[name]
        if schema is not None and [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in frame.schema]:
            raise Invalid(f"pipe {name!r} has the schema {frame.schema.simpleString()}, not {schema.simpleString()}")
        if ordering is None or ordering == frame.ordering:
            return frame
        if not ordering.ordered:
            return OrderedFrame.unordered(frame.df)
        if ordering.kind == "implicit" and frame.ordering.ordered:
            return OrderedFrame(frame.data, ordering, frame.non_null)
        raise Invalid(f"pipe {name!r} is {frame.ordering.kind}, which cannot serve as {ordering.kind}")

    def close(self) -> None:
        for f in self.held.values():
            f.data.unpersist()
        self.held.clear()
