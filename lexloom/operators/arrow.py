"""Arrow bridge for per-document kernels."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Documents whose steps are held at a time.
WINDOW = 1024


def evenly(df: DataFrame) -> DataFrame:
    """Rows dealt anew to all cores, where each is so much work that the shuffle is nothing beside it.

    The number of splits does not tell: all rows of a row group belong to one of them.
    """
    return df if df.isStreaming else df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def per_document(df: DataFrame, schema: str, make: Callable[[dict], list[tuple]], together: Callable[[list], list] | None = None) -> DataFrame:
    """Rows that ``make`` returns for each row; narrow, one Arrow batch at a time.

    A document is one row with its sentences, so whatever is local to a document needs no shuffle.
    With ``together``, ``make`` returns steps, and ``together`` has the rows of ``WINDOW`` of them.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            if together is None:
                rows = [out for row in batch.to_pylist() for out in make(row)]
            else:
                windows = (batch.slice(k, WINDOW).to_pylist() for k in range(0, batch.num_rows, WINDOW))
                rows = [out for window in windows for found in together([make(row) for row in window]) for out in found]
            columns = zip(*rows) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
