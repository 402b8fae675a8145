"""Ordered folds: a state machine run over each key's rows in order, streaming through sorted partitions.

A key's rows are never gathered: a task holds one state and one Arrow batch. Rows of one key are read in one task, as their
order demands; keys are dealt over all tasks. Values keep their types: a null is None, a long stays exact.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], object], step: Callable[[object, object], list], schema: str,
    finish: Callable[[object, tuple], list] | None = None, drop: Sequence[str] = (),
) -> DataFrame:
    """``step(state, row)`` changes the state and gives output tuples; ``finish(state, key)`` gives more at a key's end.

    Columns of ``drop`` only order the rows.
    """
    fields = to_arrow_schema(StructType.fromDDL(schema))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).drop(*drop)
    row_type, places = spread.columns, [spread.columns.index(k) for k in keys]

    def made(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def run(batches):
        row, key_of = namedtuple("row", row_type, rename=True), itemgetter(*places)
        state, now = None, None
        for batch in batches:
            out = []
            for key, rows in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), key_of):
                key = key if len(places) > 1 else (key,)
                if key != now:
                    if now is not None and finish:
                        out += finish(state, now)
                    state, now = start(), key
                for values in rows:
                    out += step(state, row._make(values))
            yield made(out)
        if now is not None and finish:
            yield made(finish(state, now))

    return spread.mapInArrow(run, schema)
