"""Streams: a push generator as a source, pipes and write-through tees as sinks."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Invalid

_END = object()


class PushGenerator:
    """A bounded queue between a producer and one consumer, on the driver. ``close`` ends it after what was pushed;
    ``drain`` drops the rest."""

    def __init__(self, capacity: int = 0):
        self.queue: queue.Queue = queue.Queue(capacity)
        self.lock, self.closed, self.taken = threading.Lock(), False, False

    def push(self, item) -> bool:
        """False if the generator is closed."""
        with self.lock:
            if self.closed:
                return False
        self.queue.put(item)
        return True

    def close(self) -> bool:
        """False if it was closed before."""
        with self.lock:
            if self.closed:
                return False
            self.closed = True
        self.queue.put(_END)
        return True

    def drain(self) -> int:
        n = 0
        while not self.queue.empty():
            n += self.queue.get() is not _END
        self.close()
        return n

    def __iter__(self) -> Iterator:
        with self.lock:
            if self.taken:
                raise Invalid("a push generator has one consumer")
            self.taken = True
        while (item := self.queue.get()) is not _END:
            yield item


def fan_out(stream: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]], checkpoint: str, query_name: str | None = None, available_now: bool = True):
    """Give every micro-batch to several sinks. The batch is persisted, so the stream is read once per batch.

    A sink sees ``(batch, number)`` and is called again with the same number after a failure, so it should be
    idempotent, for instance by writing to a folder named after the number.
    """
    if not sinks:
        raise Invalid("a fan-out needs a sink")

    def run(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for s in sinks:
                s(held, number)
        finally:
            held.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.queryName(query_name) if query_name else writer
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed(stream: DataFrame, time: str, width: str, late: str, keys: Sequence[str], aggregates: Sequence, slide: str | None = None) -> DataFrame:
    """Event-time windows with a bound on lateness: state is dropped once a window cannot change."""
    window = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    return stream.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(*aggregates)
