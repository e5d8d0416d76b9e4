"""A column computed from another in Arrow batches, as a step of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


def map_column(
    df: DataFrame, source: Column, output: str, kind: T.DataType, function: Callable[[pa.Array], pa.Array]
) -> DataFrame:
    """Add ``output``: ``function`` of ``source``, batch by batch.

    Unlike a function in an expression it is never computed twice, however often
    the result is used, or taken into an expression that can't hold it.
    """
    names = [c for c in df.columns if c != output]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(output, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = function(batch.column(len(names)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*names, output])

    return df.select(*[df[f"`{c}`"] for c in names], source.alias("_source")).mapInArrow(run, schema)


def bounded_runs(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs that add up to ``most`` at most, or hold one entry."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)
