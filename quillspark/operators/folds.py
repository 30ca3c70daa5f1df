"""Ordered folds over sorted partitions: the rows of a key go by once, in order, with a state that only that key's rows see."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "timestamp_ntz": pa.timestamp("us")}


def ordered_fold(rows: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], Any], step: Callable[[Any, dict], tuple | None]) -> DataFrame:
    """Rows that step(state, row) gives, in the order of `order` inside each key; None gives no row. A key's rows are never held together: memory is one batch and one state."""
    fields = [x.split() for x in schema.split(", ")]
    out_schema = pa.schema([(n, _KINDS[k]) for n, k in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != last:
                    last, state = row[key], start()
                made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(out_schema)], schema=out_schema)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
