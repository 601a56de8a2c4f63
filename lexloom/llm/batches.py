"""Arrow bridges between DataFrames and per-batch Python functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def map_columns(df: DataFrame, schema: str, make: Callable[..., dict | Iterator[dict]], once: Callable | None = None) -> DataFrame:
    """Apply ``make`` to the columns of each Arrow batch; it returns the new columns by name.

    ``make`` gets a dict of pyarrow arrays, and the value of ``once()`` first if that is given;
    ``once`` runs one time per task.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        ready = (once(),) if once else ()
        for batch in batches:
            if batch.num_rows:
                columns = dict(zip(batch.schema.names, batch.columns))
                out = make(*ready, columns)
                for part in out if isinstance(out, Iterator) else [out]:
                    yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
