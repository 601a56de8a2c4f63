"""Visually identical text with different characters: one form, and the groups that share it."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_columns
from .forms import classes, codes, skeleton

#: Values with fewer letters and digits take part in no comparison.
LEAST_VISIBLE = 40


def enough(form: str, least: int = LEAST_VISIBLE) -> bool:
    """Whether a consistent form holds ``least`` letters and digits."""
    if len(form) < least:
        return False
    table = classes()
    c = table[np.minimum(codes(form), len(table) - 1)]
    return int(((c == 1) | (c == 2)).sum()) >= least


def forms_of(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """The consistent form of each field beside its id: ``<field>_form``.

    Null stays null; an empty or blank value becomes the empty string.  Narrow, no shuffle.
    """

    def make(columns):
        out = {id_column: columns["key"]}
        for k, f in enumerate(fields):
            out[f"{f}_form"] = [None if x is None else skeleton(x) for x in columns[f"v{k}"].to_pylist()]
        return out

    chosen = df.select(F.col(f"`{id_column}`").alias("key"), *(F.col(f"`{f}`").alias(f"v{k}") for k, f in enumerate(fields)))
    return map_columns(chosen, f"`{id_column}` bigint, " + ", ".join(f"`{f}_form` string" for f in fields), make)


def fingerprints(df: DataFrame, id_column: str, fields: list[str], least: int = LEAST_VISIBLE) -> DataFrame:
    """``field_name, row, form_hi, form_lo, raw``: hashes of the skeleton (128 bits) and of the value.

    Null values and values with fewer than ``least`` letters and digits have no row.
    """

    def make(columns):
        names, rows, hi, lo, raw = [], [], [], [], []
        keys = columns["key"].to_pylist()
        for k, f in enumerate(fields):
            for key, value in zip(keys, columns[f"v{k}"].to_pylist()):
                if value is None or not enough(form := skeleton(value), least):
                    continue
                h = xxhash.xxh3_128_intdigest(form.encode("utf-8", "surrogatepass"))
                names.append(f)
                rows.append(key)
                hi.append((h >> 64) - (1 << 63))
                lo.append((h & (1 << 64) - 1) - (1 << 63))
                raw.append(xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63))
        return {"field_name": names, "row": rows, "form_hi": hi, "form_lo": lo, "raw": raw}

    chosen = df.select(F.col(f"`{id_column}`").alias("key"), *(F.col(f"`{f}`").alias(f"v{k}") for k, f in enumerate(fields)))
    return map_columns(chosen, "field_name string, row bigint, form_hi bigint, form_lo bigint, raw bigint", make)


def same_reading(df: DataFrame, id_column: str = "row_id", fields: tuple[str, ...] = ("article", "highlights")) -> DataFrame:
    """All pairs of rows whose values of a field read the same but differ in code points.

    Only the hashes travel.  Skeleton groups whose values are all the same code points are dropped
    by a map-side combined aggregate before any pair is formed, so a third of all rows being exact
    copies costs one aggregate row a task; what is left joins on the skeleton and the value's own
    hash differing, which is the result itself.
    """
    group = ["field_name", "form_hi", "form_lo"]
    marks = fingerprints(df, id_column, list(fields))
    varied = marks.groupBy(*group).agg(F.min("raw").alias("first"), F.max("raw").alias("last")).where("first <> last").select(*group)
    kept = marks.join(varied, group, "left_semi")
    a = kept.select(*group, F.col("row").alias("row_a"), F.col("raw").alias("raw_a"))
    b = kept.select(*group, F.col("row").alias("row_b"), F.col("raw").alias("raw_b"))
    return a.join(b, group).where("row_a < row_b AND raw_a <> raw_b").select("field_name", "row_a", "row_b")
