"""A PySpark-native engine for ordered, time-series-style data."""

from .errors import CapacityError, Invalid
from .functions import tdigest
from .operators.aggregate import Agg, aggregate, aggregate_sets
from .operators.asof import Bounds, Keys, asof_join, output_schema
from .operators.filter import filter_rows
from .operators.merge import sorted_merge
from .operators.pipes import Pipes
from .operators.pivot import Template, pivot_longer
from .operators.relational import analytic, fetch, intersect, join, order_by, project, subtract, theta_join, union
from .operators.write import WriteOptions, tee, write
from .ordering import OrderedFrame, Ordering, SortKey
from .plans.registry import Declaration, Registry, initialize
from .sources.files import scan
from .sources.memory import array_vector_source, batch_source, exec_batch_source, reader_source, record_batch_source, source, table_source
from .sources.rows import frame_from_rows, rows_from_frame, schema_of
from .sources.stream import Feed, stream_source

__all__ = [
    "Agg", "Bounds", "CapacityError", "Declaration", "Feed", "Invalid", "Keys", "OrderedFrame", "Ordering", "Pipes", "Registry", "SortKey", "Template",
    "WriteOptions", "aggregate", "aggregate_sets", "analytic", "array_vector_source", "asof_join", "batch_source", "exec_batch_source", "fetch", "filter_rows",
    "frame_from_rows", "initialize", "intersect", "join", "order_by", "output_schema", "pivot_longer", "project", "reader_source", "record_batch_source",
    "rows_from_frame", "scan", "schema_of", "sorted_merge", "source", "stream_source", "subtract", "table_source", "tdigest", "tee", "theta_join", "union", "write",
]
