"""Generation records as a stream: parse new files, append their titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusmith.functions.columns import hash_hex
from corpusmith.operators.ranking import number_rows, rank_rows
from corpusmith.operators.sampling import ID_FORMAT, SPLIT_SEED
from corpusmith.operators.synth import COPIED_PHRASES, clean_generated, parse_generations
from corpusmith.sources.staging import stage

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("row_key", T.StringType()),
        T.StructField("target", T.IntegerType()),
        T.StructField("output", T.StringType()),
    ]
)


def read_generations(
    spark: SparkSession,
    folder: str,
    fmt: str = "json",
    schema: T.StructType = RECORD_SCHEMA,
    max_files: int = 1000,
) -> DataFrame:
    """Stream of generation records from a folder that keeps growing."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return reader.format(fmt).load(folder)


def append_titles(
    generations: DataFrame, folder: str, checkpoint: str, fmt: str = "parquet"
) -> StreamingQuery:
    """Parse, clean and append every record that is there, then stop.

    Stateless, so a restart continues from the checkpoint; the file sink's log
    keeps each batch exactly once.
    """
    titles = clean_generated(parse_generations(generations))
    writer = titles.writeStream.format(fmt).outputMode("append")
    return (
        writer.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(folder)
    )


TITLE_SCHEMA = "ID string, text string, target int, batch long"


def _titles(generations: DataFrame, phrases: Sequence[str]) -> DataFrame:
    key = F.concat_ws("#", "row_key", "title_no")
    titles = parse_generations(generations).withColumn("row_key", key)
    return clean_generated(titles, phrases)


def _order(seed: int):
    return hash_hex(seed, F.lit("id"), F.col("row_key"))


def numbered_rounds(
    generations: DataFrame, phrases: Sequence[str] = COPIED_PHRASES, seed: int = SPLIT_SEED
) -> DataFrame:
    """``(ID, text, target)``: titles of all rounds with dense identifiers, in the order of
    the integer column ``round``, then of a hash. The batch form of ``append_numbered``."""
    titles = stage(_titles(generations, phrases), "titles")
    numbered = rank_rows(titles, "round", _order(seed), name="_no")
    return numbered.select(F.format_string(ID_FORMAT, "_no").alias("ID"), "text", "target")


def append_numbered(
    generations: DataFrame,
    folder: str,
    checkpoint: str,
    phrases: Sequence[str] = COPIED_PHRASES,
    seed: int = SPLIT_SEED,
) -> StreamingQuery:
    """Parse, clean, number and append every record that is there, then stop.

    Identifiers go on where the batch before ended, so they are dense over all
    batches and restarts: those that ``numbered_rounds`` gives if the rounds are the
    batches. Each batch has a folder of its own, which a repeated batch writes
    anew, and its titles and how many there are by its end are written by
    themselves; a batch that was broken off starts from the same number again.
    Read the result with ``read_numbered``.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # read twice: to count the hash buckets, and to number the rows
        titles = stage(_titles(batch, phrases), "titles")
        before = _ends_at(spark, folder, number - 1)
        numbered = number_rows(titles, _order(seed), name="_no")
        named = numbered.select(F.format_string(ID_FORMAT, F.col("_no") + before).alias("ID"), "text", "target")
        named.write.mode("overwrite").parquet(f"{folder}/titles/batch={number}")
        end = titles.agg((F.count(F.lit(1)) + before).alias("end"))
        end.write.mode("overwrite").parquet(f"{folder}/ends/batch={number}")

    writer = generations.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def _ends_at(spark: SparkSession, folder: str, number: int) -> int:
    """How many titles there are by the end of a batch; batches are numbered from 0."""
    if number < 0:
        return 0
    return spark.read.schema("end long").parquet(f"{folder}/ends/batch={number}").head()[0]


def read_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """``(ID, text, target)`` of all batches whose end was written."""
    titles = spark.read.schema(TITLE_SCHEMA).parquet(f"{folder}/titles")
    done = spark.read.schema("end long, batch long").parquet(f"{folder}/ends").select("batch")
    return titles.join(F.broadcast(done), "batch", "left_semi").select("ID", "text", "target")
