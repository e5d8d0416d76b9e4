"""Inputs of the query catalogue, derived from the given tables.

The tables hold no Hangul, dictionaries or generated blocks, so those are made
from their texts by fixed rules; the oracles apply the same rules in SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions import text as tx
from corpusmith.functions.columns import below_fraction, dot, hash_hex, let, softmax
from corpusmith.operators.dictionary import MOST_ASKED, PivotLookup, correction_lookup, token_keys
from corpusmith.operators.eda import SynonymLookup
from corpusmith.operators.linear import LinearSpec
from corpusmith.operators.spelling import token_counts
from corpusmith.operators.synth import LIST_MARKER
from corpusmith.plans.flows import Resources
from corpusmith.sources.staging import stage

LATIN_LETTERS = "abcdefghijklmnopqrstuvwxyz"
HANGUL_LETTERS = "가나다라마바사아자차카타파하거너더러머버서어저처커터"
LANGUAGES = ("en", "zh-CN", "de")
NUM_CLASSES = 10
# few steps: SQL has a subquery of its own for each
LINEAR = LinearSpec(num_features=4096, num_classes=4, iterations=3, decay=0.001)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on scans of fewer splits than cores; large inputs are left
    alone. For scans only: their splits are known without running anything."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    # observe() keeps Catalyst from moving later filters below the repartition,
    # where they would run on the few original splits
    name = f"spread-{uuid.uuid4().hex}"
    return df.repartition(cores).observe(name, F.count(F.lit(1)).alias("n"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, row_key, ID, text, lang, target)``, 7 classes by text length."""
    docs = table(spark, folder, "documents").select(
        "doc_id",
        F.col("doc_id").cast("string").alias("row_key"),
        F.col("doc_id").cast("string").alias("ID"),
        "text",
        "lang",
        (F.col("n_chars") % 7).cast("int").alias("target"),
    )
    return spread(docs)


ODD_TEXTS = ("null", "empty", "blank", "dots", "ellipsis")


def odd_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents and, for every tenth, five more rows: a null text, an empty one, a
    blank one, the text between dots, and the text with ellipses for full stops."""
    docs = documents(spark, folder).select("row_key", "ID", "text", "target")
    text = F.col("text")
    made = {
        "null": F.lit(None).cast("string"),
        "empty": F.lit(""),
        "blank": F.lit(" \t\u3000\n"),
        "dots": F.concat(F.lit("....."), text, F.lit(" ... …")),
        "ellipsis": F.replace(text, F.lit("."), F.lit("...")),
    }
    some = docs.where(F.col("row_key").cast("long") % 10 == 0)
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in made.items()]))
    more = some.select("row_key", "ID", "target", rows)
    key = F.concat_ws("#", "row_key", "kind")
    return docs.unionByName(more.withColumn("row_key", key).drop("kind"))


def korean_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their lower-case letters written in Hangul."""
    return documents(spark, folder).withColumn(
        "text", F.translate("text", LATIN_LETTERS, HANGUL_LETTERS)
    )


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents; 4 classes from the two label columns, null without a label."""
    labels = table(spark, folder, "labels").select(
        "doc_id", (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("target")
    )
    # spread the scan: asking a join for its partitions would run it
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    key = F.col("doc_id").cast("string")
    return docs.join(labels, "doc_id", "left").select(
        key.alias("row_key"), key.alias("ID"), "text", "target"
    )


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_key, ID, text, target)``: one row per turn."""
    key = F.concat_ws("#", "conv_id", "turn")
    return spread(
        table(spark, folder, "conversations").select(
            key.alias("row_key"),
            key.alias("ID"),
            "text",
            (F.col("conv_id") % 7).cast("int").alias("target"),
        )
    )


def vocabulary(texts: DataFrame) -> DataFrame:
    """Distinct tokens; repeats inside a task go before the shuffle does."""
    return texts.select("text").mapInArrow(_tokens_of_task, "token string").distinct()


def _tokens_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of a task, again if more than ``MOST_ASKED`` others came between."""
    found: list[pa.Array] = []

    def sent() -> pa.RecordBatch:
        tokens = pa.concat_arrays(found).unique()
        found.clear()
        return pa.RecordBatch.from_arrays([tokens], ["token"])

    for batch in batches:
        found.append(token_keys(batch.column("text")))
        if sum(map(len, found)) >= MOST_ASKED:
            yield sent()
    if found:
        yield sent()


def synonyms(words: DataFrame) -> DataFrame:
    """``(token, n, synonym)``: up to three per word of five letters or more."""
    token = F.col("token")
    forms = F.array(
        F.concat(token, F.lit("s")), F.reverse(token), F.concat(F.lit("re"), token)
    )
    some = F.slice(forms, F.lit(1), (F.length(token) % 3 + 1).cast("int"))
    return words.where(F.length(token) >= 5).select(
        "token", F.posexplode(some).alias("n", "synonym")
    )


def corrections(words: DataFrame) -> DataFrame:
    """``(token, correction)``: vowels of words of seven letters or more move on."""
    return words.where(F.length("token") >= 7).select(
        "token", F.translate("token", "aeiou", "eioua").alias("correction")
    )


def pivots(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forward and back dictionaries; long words are missing in some languages."""
    limits = {"en": 20, "zh-CN": 1000, "de": 16}
    langs = F.explode(
        F.array(
            *[
                F.struct(F.lit(x).alias("lang"), F.lit(limits[x]).alias("limit"))
                for x in LANGUAGES
            ]
        )
    ).alias("l")
    pairs = words.select("token", langs).where(F.length("token") < F.col("l.limit"))
    foreign = F.concat_ws(":", F.col("l.lang"), F.reverse("token"))
    home = F.translate("token", "aeiou", "uaeio")
    forward = pairs.select("l.lang", F.col("token").alias("src"), foreign.alias("dst"))
    back = pairs.select("l.lang", foreign.alias("src"), home.alias("dst"))
    return forward, back


def phrase_pivots(texts: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forward and back tables of phrases: the words that ``pivots`` has, and two and three
    words that follow each other somewhere, chosen by their length. In one language
    the words are short, so that its longer phrases decide what is covered."""
    tokens = tx.tokens(F.col("text"))

    def following(n: int) -> DataFrame:
        places = F.sequence(F.lit(1), F.size("t") - (n - 1))
        runs = F.when(F.size("t") >= n, F.transform(places, lambda i: F.array_join(F.slice("t", i, n), " ")))
        found = texts.select(tokens.alias("t")).select(F.explode(F.array_distinct(runs)).alias("src"))
        return found.where(F.length("src") % (n + 1) == 0).distinct()

    longer = following(2).unionByName(following(3))
    langs = F.explode(F.array(*[F.lit(x) for x in LANGUAGES])).alias("lang")
    foreign = F.concat_ws(":", F.col("lang"), F.reverse("src")).alias("dst")
    forward, back = pivots(words)
    more = longer.select("src", langs).select("lang", "src", foreign)
    home = F.concat(F.lit("<"), F.translate("src", "aeiou", "uaeio"), F.lit(">"))
    return (
        forward.unionByName(more),
        back.unionByName(more.select("lang", F.col("dst").alias("src"), home.alias("dst"))),
    )


def word_lists(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``unknown (token)`` and ``known (token, n)``: words of the letters a to z that
    occur less than three times, and the others."""
    counts = stage(token_counts(texts.withColumn("text", F.lower("text"))), "word-counts")
    words = counts.where(F.col("token").rlike("^[a-z]+\\z"))
    return words.where("n < 3").select("token"), words.where("n >= 3")


def resources(texts: DataFrame) -> Resources:
    words = stage(vocabulary(texts), "words")
    return Resources(
        synonyms=SynonymLookup(synonyms(words)),
        pivots=PivotLookup(*pivots(words), LANGUAGES),
        corrections=correction_lookup(corrections(words)),
        recover=lambda prompts: prompts.select(
            "row_key", F.concat("prompt", corrected_json(F.col("row_key"))).alias("output")
        ),
    )


def corrected_json(text: Column) -> Column:
    return F.concat(F.lit('{"corrected_text": "'), F.replace(text, F.lit('"'), F.lit("")), F.lit('"}'))


def recovery_outputs(docs: DataFrame) -> DataFrame:
    """Model outputs by language: one match (en), two (fr), none (de), no row (es)."""
    answer = corrected_json(F.col("text"))
    output = (
        F.when(F.col("lang") == "en", F.concat(F.lit("Output:\n"), answer))
        .when(
            F.col("lang") == "fr",
            F.concat(
                F.lit('Output:\n{"corrected_text": "example"}\nOutput:\n'),
                F.lit('{"corrected_text": "first"} '),
                answer,
            ),
        )
        .when(F.col("lang") == "de", F.lit('Output:\n"corrected_text" is missing'))
    )
    return docs.where(F.col("lang") != "es").select("row_key", output.alias("output"))


def generations(docs: DataFrame) -> DataFrame:
    """Each document as a generated block: its sentences as a numbered list with
    stray brackets and quotes, an un-numbered line, and a late numbered one."""

    def line(sentence: Column, i: Column) -> Column:
        dressed = (
            F.when(i % 3 == 1, F.concat(F.lit('"'), sentence, F.lit('",')))
            .when(i % 3 == 2, F.concat(F.lit("['"), sentence, F.lit("']")))
            .otherwise(sentence)
        )
        return F.concat((i + 1).cast("string"), F.lit(". "), dressed)

    sentences = F.split("text", "\\. ")
    output = F.concat(
        F.lit(f"prompt\n{LIST_MARKER}\n1. example\n---\n{LIST_MARKER}\n"),
        F.array_join(F.transform(sentences, line), "\n"),
        F.lit("\nEND\n99. late"),
    )
    return docs.select("row_key", "target", output.alias("output"))


# --- scores from embeddings ---------------------------------------------------


def embedding_folds(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_key, target, v, fold)``: every row, in one of two folds."""
    key = F.col("vec_id").cast("string")
    rows = spread(
        table(spark, folder, "embeddings").select(
            key.alias("row_key"),
            F.col("label").alias("target"),
            F.transform("embedding", lambda x: x.cast("double")).alias("v"),
        )
    )
    fold = below_fraction(hash_hex("fold", F.col("row_key")), 0.5).cast("int")
    return rows.withColumn("fold", fold)


def centroids(learn: DataFrame) -> DataFrame:
    """One row: array of the class centroids, in class order.

    A vector mean, merged before the shuffle; classes x dimensions numbers in all.
    """
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("v"))))
    per_class = learn.groupBy("target").agg(mean.alias("c"))
    classes = F.sort_array(F.collect_list(F.struct("target", "c")))
    return per_class.agg(classes["c"].alias("c"))


def _with_centroids(rows: DataFrame) -> DataFrame:
    """Add the centroids of the other fold, so no row is scored by itself."""
    zero, one = (centroids(rows.where(F.col("fold") == f)).scalar() for f in (0, 1))
    return rows.withColumn("_centroids", F.when(F.col("fold") == 0, one).otherwise(zero))


def _six_places(x: Column) -> Column:
    return F.round(x * F.lit(1e6)) / F.lit(1e6)


def centroid_scores(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_key, target, probs)``: softmax of 10 x dot product with each centroid."""
    rows = _with_centroids(embedding_folds(spark, folder))
    logits = F.transform("_centroids", lambda c: dot(F.col("v"), c) * 10.0)
    probs = F.transform(softmax(logits), _six_places)
    return rows.select("row_key", "target", probs.alias("probs"))


def slice_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Four models: cosine to the centroids on four slices of 16 dimensions.

    ``(row_key, target, raw0, raw1, raw2, raw3)``.
    """
    rows = _with_centroids(embedding_folds(spark, folder))

    def cosine(a: Column, b: Column) -> Column:
        return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))

    def raw(first: int) -> Column:
        def part(x: Column) -> Column:
            return F.slice(x, first, 16)

        def against(mine: Column) -> Column:
            return F.transform(
                "_centroids",
                lambda c: _six_places(let(part(c), lambda other: cosine(mine, other))),
            )

        return let(part(F.col("v")), against)

    return rows.select(
        "row_key", "target", *[raw(16 * i + 1).alias(f"raw{i}") for i in range(4)]
    )
