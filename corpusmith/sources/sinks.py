"""Writing corpora: parquet between stages, CSV at the edges."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_corpus(
    df: DataFrame,
    path: str,
    columns: Sequence[str] = ("ID", "text", "target"),
    fmt: str = "parquet",
    mode: str = "overwrite",
) -> None:
    """Write the chosen columns; helper columns such as ``row_key`` stay behind."""
    out = df.select(*columns)
    if fmt == "csv":
        # quotes are doubled, empty strings are not nulls and spaces at the ends
        # stay, as readers expect
        options = {"header": True, "escape": '"', "emptyValue": '""'}
        options |= {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        out.write.mode(mode).options(**options).csv(path)
    else:
        out.write.mode(mode).format(fmt).save(path)


def append_corpus(
    df: DataFrame,
    path: str,
    columns: Sequence[str] = ("text", "target"),
    fmt: str = "csv",
) -> None:
    """Append to a table. Every part file has its own header, so a reader sees
    the header once per file and never as a row."""
    write_corpus(df, path, columns, fmt, mode="append")


def unquoted_line(columns: Sequence[str]):
    """One CSV line without quotes: specials are preceded by a backslash."""
    fields = [
        F.regexp_replace(
            F.coalesce(F.col(c).cast("string"), F.lit("")), r'([\\,"\r\n])', r"\\$1"
        )
        for c in columns
    ]
    return F.concat_ws(",", *fields)


def write_unquoted(
    df: DataFrame, path: str, columns: Sequence[str] = ("ID", "text", "target")
) -> None:
    """CSV without any quoting, backslash-escaped; Spark's own CSV writer always
    has a quote character, so the lines go through the text sink. Every part file
    with rows has its own header line."""
    header = ",".join(columns)

    def with_header(batches):
        for i, batch in enumerate(batches):
            if i == 0:
                yield pa.RecordBatch.from_pydict({"value": [header]}, batch.schema)
            yield batch

    lines = df.select(unquoted_line(columns).alias("value"))
    lines.mapInArrow(with_header, "value string").write.mode("overwrite").text(path)
