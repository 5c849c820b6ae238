"""Pivot longer: each row becomes one row per template, with typed feature values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Invalid
from ..ordering import SEQ, OrderedFrame, quoted, top_level


@dataclass(frozen=True)
class Template:
    """Feature values (Columns of literals, e.g. ``F.lit(1).cast('decimal(20,0)')``, or Python values) and, per
    measurement, the column it is read from (None: a null)."""

    features: Sequence[Any]
    measurements: Sequence[str | None]


def pivot_longer(frame: OrderedFrame, templates: Sequence[Template], feature_names: Sequence[str], measurement_names: Sequence[str]) -> OrderedFrame:
    """All input columns, then features, then measurements; rows times templates, unordered. One expression, no shuffle."""
    df = frame.df
    if not templates:
        raise Invalid("a pivot needs a template")
    if not feature_names or not measurement_names:
        raise Invalid("a pivot needs feature and measurement names")
    names = [*df.columns, *feature_names, *measurement_names]
    if len({n.lower() for n in names}) != len(names):
        raise Invalid(f"output names repeat: {names}")
    for t in templates:
        if len(t.features) != len(feature_names) or len(t.measurements) != len(measurement_names):
            raise Invalid("a template has another number of values than names")
        if any(f is None for f in t.features):
            raise Invalid("a feature is missing; a null feature needs a type, e.g. F.lit(None).cast('long')")
        if any(m is not None and "." in m and m not in df.columns for m in t.measurements):
            raise NotImplementedError("nested measurements")
    features = [[f if isinstance(f, Column) else F.lit(f) for f in t.features] for t in templates]
    kinds = [df.select(*row).schema for row in features]
    for k, name in enumerate(feature_names):
        found = {s[k].dataType.simpleString() for s in kinds}
        if len(found) > 1:
            raise Invalid(f"feature {name!r} has the types {sorted(found)}")
    types: list[T.DataType] = []
    for k, name in enumerate(measurement_names):
        found = {top_level(df, t.measurements[k]).dataType.json(): top_level(df, t.measurements[k]).dataType for t in templates if t.measurements[k] is not None}
        if len(found) != 1:
            raise Invalid(f"measurement {name!r} is in no template" if not found else f"measurement {name!r} mixes types")
        types += found.values()
    rows = [
        F.struct(
            *[f.alias(n) for f, n in zip(row, feature_names, strict=True)],
            *[(F.lit(None).cast(kind) if m is None else F.col(quoted(m))).alias(n) for m, n, kind in zip(t.measurements, measurement_names, types, strict=True)],
        )
        for t, row in zip(templates, features, strict=True)
    ]
    out = df.select(*[F.col(quoted(c)) for c in df.columns], F.inline(F.array(*rows)))
    assert SEQ not in out.columns
    return OrderedFrame(out, type(frame.ordering).unordered())
