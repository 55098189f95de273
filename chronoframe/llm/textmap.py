"""Runs a numpy function over the texts of a table, batch by batch, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chronoframe.llm.kernel import binary_list, slices
from chronoframe.llm.storage import small_batches

Texts = list[bytes]


def add_columns(df: DataFrame, make: Callable[[], Callable[[Texts], dict]], fields: str, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """The table with columns computed from its texts.

    ``make`` is called once in each task and returns the function from texts to columns.  A computed
    column takes the place of an input column of the same name.  ``drop`` names columns that don't go on.
    """
    small_batches(df.sparkSession)
    new = T._parse_datatype_string(fields)
    names = {f.name.lower() for f in new.fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names and f.name not in drop]
    arrow = {f.name: to_arrow_type(f.dataType) for f in new.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            texts = binary_list(batch.column(text))
            for a, b in slices(texts):
                got = fn(texts[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(f.name) for f in kept] + [pa.array(got[n], t) for n, t in arrow.items()],
                    names=[f.name for f in kept] + list(arrow),
                )

    return df.mapInArrow(run, T.StructType(kept + new.fields))


def keep_rows(df: DataFrame, make: Callable[[], Callable[[Texts], object]], text: str = "text") -> DataFrame:
    """The rows whose texts the function marks True, with all their columns."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            texts = binary_list(batch.column(text))
            for a, b in slices(texts):
                yield batch.slice(a, b - a).filter(pa.array(fn(texts[a:b]), pa.bool_()))

    return df.mapInArrow(run, df.schema)
