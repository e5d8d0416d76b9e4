"""What the operators share: reading their inputs, row identity, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.sources.staging import stage

WHITESPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` alone, so no other column of ``docs`` can clash; a null
    text is empty."""
    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))


def stage_rows(docs: DataFrame, label: str, **keys: Column) -> DataFrame:
    """Write ``docs`` once as ``(row_no, row, *keys)`` and read it back.

    ``row`` holds all columns under their own names, so keys cannot clash with
    them. ``row_no`` tells rows apart even where ids repeat or are null; it is
    stored, so it stays the same when lost work is done again.
    """
    return stage(
        docs.select(
            F.monotonically_increasing_id().alias("row_no"),
            F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
            *[value.alias(name) for name, value in keys.items()],
        ),
        label,
    )


def keep_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The original rows of ``stage_rows`` whose ``row_no`` is in ``kept``."""
    return rows.join(kept.select("row_no"), "row_no", "left_semi").select("row.*")


Batches = Iterator[pa.RecordBatch]
# rows whose results a worker holds at a time
_SLICE = 256


def per_document(
    docs: DataFrame, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], schema: str
) -> DataFrame:
    """``doc_id`` and the columns of ``schema``, computed batch by batch.

    ``make`` runs once in each task and returns a function from the texts of a
    batch to its columns. Rows stay where they are and come in Arrow batches of
    bounded size, so memory does not grow with the table.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[part.split()[0] for part in schema.split(", ")]]

    def run(batches: Batches) -> Batches:
        columns_of = make()
        for whole in batches:
            for start in range(0, len(whole), _SLICE):
                batch = whole.slice(start, _SLICE)
                columns = columns_of(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return ids_and_texts(docs).mapInArrow(run, f"doc_id {id_type}, {schema}")
