"""Sorted merge: the union of sorted inputs, ordered by one ascending key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Invalid
from ..ordering import SEQ, OrderedFrame, Ordering, SortKey, check_sorted, quoted, top_level

_NOT_SORTABLE = (T.ArrayType, T.MapType, T.StructType, T.NullType, T.VariantType)


def sorted_merge(frames: Sequence[OrderedFrame], ordering: Ordering, nulls: str | None = None, validate: str = "eager") -> OrderedFrame:
    """All rows of all inputs in key order, each row whole; ties between inputs are in the order of the inputs.

    ``nulls`` overrides the key's own placement. ``validate="eager"`` rejects inputs that are not sorted (a sort would
    repair them without a word); ``"off"`` trusts the caller and saves a pass. A row's sequence is its place in the
    merged order (key, input, arrival), so order-dependent operators see the merge; ``numbered`` gives that place as a
    number, and ``sorted`` the rows in order.
    """
    if not frames:
        raise Invalid("a merge needs an input")
    first = frames[0].schema
    for f in frames[1:]:
        if [(x.name, x.dataType, x.nullable) for x in f.schema] != [(x.name, x.dataType, x.nullable) for x in first]:
            raise Invalid(f"schemas differ: {f.schema.simpleString()} and {first.simpleString()}")
    if ordering.kind != "explicit":
        raise Invalid("a merge needs an explicit ordering")
    if len(ordering.keys) != 1 or not ordering.keys[0].ascending:
        raise NotImplementedError("a merge has one ascending key")
    key = SortKey(ordering.keys[0].name, True, nulls or ordering.keys[0].nulls)
    try:
        kind = top_level(frames[0].data, key.name).dataType
    except KeyError as e:
        raise Invalid(str(e)) from e
    if isinstance(kind, _NOT_SORTABLE):
        raise Invalid(f"a key of type {kind.simpleString()}")
    for f in frames:
        if not f.ordering.ordered:
            raise Invalid("a merge needs ordered inputs")
        if validate == "eager":
            check_sorted(f, key.name, key.nulls)
    value = F.col(quoted(key.name))
    late = value.isNull() if key.nulls == "last" else value.isNotNull()
    parts = [f.data.withColumn(SEQ, F.struct(late.alias("late"), value.alias("key"), F.lit(i).alias("input"), F.col(SEQ).alias("seq"))) for i, f in enumerate(frames)]
    if len({p.schema[SEQ].dataType.json() for p in parts}) > 1:
        raise Invalid("the inputs' sequence columns have different types")
    return OrderedFrame(reduce(DataFrame.unionByName, parts), Ordering("explicit", (key,)))
