"""Column names that can't clash: an operator works on c0, c1, ... and gives a table its own names back at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def neutral(df: DataFrame, *columns: str, without: tuple[str, ...] | list[str] = ()) -> tuple[DataFrame, list[str], Callable[..., DataFrame]]:
    """(df with its columns named c0, c1, ... less those in ``without``, the new names of ``columns``, back).

    ``back(out, *added)`` selects those columns of ``out`` (but ``less``) under their old names, and then the columns
    ``added``.
    Any other name an operator uses is free as long as it isn't a c and a number.
    """
    gone = {w.lower() for w in without} - {c.lower() for c in columns}
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    kept = [(f"c{i}", name) for i, name in enumerate(df.columns) if name.lower() not in gone]
    lower = [c.lower() for c in df.columns]
    places = [f"c{df.columns.index(c) if c in df.columns else lower.index(c.lower())}" for c in columns]

    def back(out: DataFrame, *added: str | Column, less: str = "") -> DataFrame:
        return out.select(*(F.col(c).alias(name) for c, name in kept if c != less), *added)

    return plain.select(*(c for c, _ in kept)), places, back


def with_fields(df: DataFrame, more: str) -> T.StructType:
    """The schema of ``df`` with the fields of the DDL string ``more`` after it."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])
