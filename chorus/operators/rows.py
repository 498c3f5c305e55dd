"""Arrays to rows, and filters on costly columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Text of a part that is cut into words.
PART_BYTES = 16 << 20


def unfold(df: DataFrame, values: Column, name: str, *keep: str) -> DataFrame:
    """One row per array element with the kept columns; empty arrays give none.

    A plain ``explode`` makes the optimizer add a filter on the size of the
    array below the projection, and further down to the scan, which computes
    costly arrays two more times. The outer form adds none.
    """
    return df.select(*keep, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


def drop_where(df: DataFrame, column: str, unwanted: Column) -> DataFrame:
    """Drop rows by a test on a costly column, which is computed only once.

    A filter would move below the projection that computes the column and
    compute it there a second time. It cannot move below a generator, so the
    column passes through one as an array of one element.
    """
    others = [c for c in df.columns if c != column]
    once = df.select(*others, F.explode_outer(F.array(column)).alias(column))
    return once.filter(~unwanted).select(*df.columns)


def place(df: DataFrame, key: str, text: str) -> DataFrame:
    """Hash-partition on a key before rows are multiplied.

    Adaptive execution would size the parts by what is shuffled and not by what each row grows
    to afterwards. There are ``spark.sql.shuffle.partitions``, or more, so that one holds some
    ``PART_BYTES`` of text: what a task counts has the same size in tables of all sizes.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.repartition(max(least, -(-size // PART_BYTES)), key)
