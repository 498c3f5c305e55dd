"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chorus.workspace import stage  # noqa: F401  re-exported for the operators

#: The white space of the contracts, ``[\x20\x09-\x0D]``: also what ``bytes.split`` cuts at.
WHITE = " \t\n\x0b\x0c\r"
LAST_ID = (1 << 63) - 1
ROWS = 1024


def utf8(column: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null stays null."""
    return F.col(column).cast("string").cast("binary")


def order_id(column: str = "doc_id") -> Column:
    """The id used for order: a missing one comes last."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def tuples(df: DataFrame, fn: Callable, schema: str, init: Callable | None = None,
           rows: int = ROWS) -> DataFrame:
    """``mapInArrow`` with a function of column lists to a dictionary of columns.

    ``fn(columns, state)`` is called for at most ``rows`` rows of an Arrow batch, which
    bounds the Python objects alive at once, and returns a dictionary of output columns,
    or None. ``init()`` makes the state of a task.
    """
    out = _arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]):
        state = init() if init else None
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            made = fn(batch, state)
            if made is not None:
                yield pa.RecordBatch.from_arrays(
                    [_column(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


SIEVE_BITS = 25


def marked(df: DataFrame, key: Column, keys: DataFrame, name: str = "_maybe") -> DataFrame:
    """Add a test that is true for keys among ``keys`` (one long column) and few others.

    A bitmap of ``2 ** SIEVE_BITS`` bits, 4 MB whatever the number of keys, so it may be
    broadcast. It only spares rows a shuffle whose exact join follows.
    """
    place = lambda column: F.pmod(column, F.lit(1 << SIEVE_BITS))
    bits = (keys.select(place(F.col(keys.columns[0])).alias("_x"))
            .groupBy(F.bitmap_bucket_number("_x").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_x")).alias("_bits")))
    placed = df.withColumns({"_bucket": F.bitmap_bucket_number(place(key)),
                             "_at": F.bitmap_bit_position(place(key))})
    found = placed.join(F.broadcast(bits), "_bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0
    return found.withColumn(name, F.coalesce(bit, F.lit(False))).drop("_bucket", "_at", "_bits")


def maybe(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    return marked(df, key, keys).filter("_maybe").drop("_maybe")


def _column(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))
