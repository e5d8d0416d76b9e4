"""The query catalogue: every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions import text as tx
from corpusmith.operators import dictionary, eda, isolate, metrics, models, relabel
from corpusmith.operators import sampling, spelling, synth
from corpusmith.operators.augment import augment, naive_augment, noise_filtering
from corpusmith.operators.bayes import BayesSpec
from corpusmith.operators.linear import train_linear
from corpusmith.operators.models import TextModelSpec
from corpusmith.plans import flows, inputs
from corpusmith.profiles import GROUP_BINS, KOREAN, LATIN, ZERO_GROUP_BINS
from corpusmith.sources.readers import GENERATED_SCHEMA, as_dataframe, read_corpus
from corpusmith.sources.sinks import append_corpus, write_corpus, write_unquoted
from corpusmith.sources.staging import new_path, stage
from corpusmith.streaming.generations import (
    RECORD_SCHEMA,
    append_numbered,
    append_titles,
    read_generations,
    read_numbered,
)
from corpusmith.streaming.generations import numbered_rounds as batch_rounds

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- noise measurement and isolation ------------------------------------------


# all documents, and null, empty, blank and ellipsis texts made from some of them


@query
def noise_ratios_of_odd_texts(spark, sf):
    odd = inputs.odd_documents(spark, sf)
    hard = tx.hard_noise_ratio(F.col("text"), LATIN).alias("hard")
    soft = tx.soft_noise_ratio(tx.soft_clean_text(F.col("text")), LATIN).alias("soft")
    return odd.select("row_key", hard, soft)


@query
def isolation_of_odd_texts(spark, sf):
    odd = inputs.odd_documents(spark, sf)
    sides = []
    for mode in ("hard", "soft"):
        for side, rows in zip(("noisy", "clean"), isolate.isolate(odd, mode, LATIN)):
            sides.append(rows.select("row_key", "text", F.lit(f"{mode} {side}").alias("side")))
    return sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3])


@query
def noise_filter_of_odd_texts(spark, sf):
    return noise_filtering(inputs.odd_documents(spark, sf), LATIN).select(*VARIANT)


def _hard(docs: DataFrame, profile) -> DataFrame:
    return isolate.measure_noise(docs, "hard", profile)


def _soft(docs: DataFrame, profile) -> DataFrame:
    return isolate.measure_noise(docs, "soft", profile)


@query
def hard_noise_ratio(spark, sf):
    return _hard(inputs.documents(spark, sf), LATIN).select("doc_id", "noise_ratio")


@query
def hard_noise_ratio_korean(spark, sf):
    docs = inputs.korean_documents(spark, sf)
    return _hard(docs, KOREAN).select("doc_id", "noise_ratio")


@query
def remove_allowed_terms(spark, sf):
    reduced = tx.reduce_text(F.col("text"), LATIN)
    return inputs.documents(spark, sf).select("doc_id", reduced.alias("reduced"))


@query
def noise_histogram(spark, sf):
    measured = _hard(inputs.korean_documents(spark, sf), KOREAN)
    return isolate.noise_histogram(measured, GROUP_BINS)


@query
def noise_histogram_zero_group(spark, sf):
    measured = _hard(inputs.documents(spark, sf), LATIN)
    return isolate.noise_histogram(measured, ZERO_GROUP_BINS)


@query
def noise_groups(spark, sf):
    measured = _hard(inputs.documents(spark, sf), LATIN)
    group = isolate.noise_group(F.col("noise_ratio"))
    return measured.select("doc_id", group.alias("noise_group"))


@query
def isolate_hard_noisy(spark, sf):
    sides = isolate.isolate(inputs.documents(spark, sf), "hard", LATIN)
    return sides.noisy.select("ID", "text", "target")


@query
def isolate_hard_clean(spark, sf):
    sides = isolate.isolate(inputs.documents(spark, sf), "hard", LATIN)
    return sides.clean.select("ID", "text", "target")


@query
def soft_noise_ratio(spark, sf):
    return _soft(inputs.documents(spark, sf), LATIN).select("doc_id", "noise_ratio")


@query
def soft_noise_ratio_korean(spark, sf):
    docs = inputs.korean_documents(spark, sf)
    return _soft(docs, KOREAN).select("doc_id", "noise_ratio")


@query
def noise_characters(spark, sf):
    docs = inputs.documents(spark, sf)
    clean = tx.soft_clean_text(F.col("text"))
    return docs.select("doc_id", tx.noise_chars(clean, LATIN).alias("non_kor"))


@query
def isolate_soft_noisy(spark, sf):
    sides = isolate.isolate(inputs.documents(spark, sf), "soft", LATIN)
    return sides.noisy.select("ID", "text", "target")


@query
def isolate_soft_clean(spark, sf):
    sides = isolate.isolate(inputs.documents(spark, sf), "soft", LATIN)
    return sides.clean.select("ID", "text", "target")


@query
def isolation_summary(spark, sf):
    docs = inputs.documents(spark, sf)
    hard = isolate.isolation_summary(_hard(docs, LATIN), "hard", LATIN)
    soft = isolate.isolation_summary(_soft(docs, LATIN), "soft", LATIN)
    return hard.select(F.lit("hard").alias("mode"), "*").unionByName(
        soft.select(F.lit("soft").alias("mode"), "*")
    )


# --- cleaning and augmentation ------------------------------------------------

VARIANT = ("row_key", "ID", "text", "target", "aug_kind")


@query
def noise_filter_text(spark, sf):
    return noise_filtering(inputs.documents(spark, sf), LATIN).select(*VARIANT)


@query
def noise_filter_korean(spark, sf):
    docs = inputs.korean_documents(spark, sf)
    return noise_filtering(docs, KOREAN).select(*VARIANT)


@query
def naive_variants(spark, sf):
    return naive_augment(inputs.documents(spark, sf), LATIN).select(*VARIANT)


@query
def naive_variants_korean(spark, sf):
    docs = inputs.korean_documents(spark, sf)
    return naive_augment(docs, KOREAN).select(*VARIANT)


@query
def eda_delete(spark, sf):
    docs = inputs.documents(spark, sf)
    return eda.eda_augment(docs, None, ["delete"]).select(*VARIANT)


@query
def eda_swap(spark, sf):
    docs = inputs.documents(spark, sf)
    return eda.eda_augment(docs, None, ["swap"]).select(*VARIANT)


def _with_words(spark, sf) -> tuple[DataFrame, DataFrame]:
    turns = inputs.conversations(spark, sf)
    return turns, stage(inputs.vocabulary(turns), "words")


def _with_synonyms(spark, sf) -> tuple[DataFrame, DataFrame]:
    turns, words = _with_words(spark, sf)
    return turns, inputs.synonyms(words)


@query
def eda_synonym(spark, sf):
    turns, synonyms = _with_synonyms(spark, sf)
    return eda.eda_augment(turns, synonyms, ["synonym"]).select(*VARIANT)


@query
def eda_insert(spark, sf):
    turns, synonyms = _with_synonyms(spark, sf)
    return eda.eda_augment(turns, synonyms, ["insert"]).select(*VARIANT)


@query
def eda_all(spark, sf):
    turns, synonyms = _with_synonyms(spark, sf)
    return eda.eda_augment(turns, synonyms, eda.ALL_OPS).select(*VARIANT)


@query
def eda_notebook(spark, sf):
    turns, synonyms = _with_synonyms(spark, sf)
    return eda.eda_augment(turns, synonyms, eda.NOTEBOOK_OPS).select(*VARIANT)


@query
def correct_tokens(spark, sf):
    turns, words = _with_words(spark, sf)
    corrections = inputs.corrections(words)
    return dictionary.correct_tokens(turns, corrections).select(*VARIANT)


@query
def pivot_rewrite_keep(spark, sf):
    turns, words = _with_words(spark, sf)
    pivots = dictionary.PivotLookup(*inputs.pivots(words))
    return dictionary.pivot_rewrite(turns, pivots).select(*VARIANT)


@query
def pivot_rewrite_drop(spark, sf):
    turns, words = _with_words(spark, sf)
    pivots = dictionary.PivotLookup(*inputs.pivots(words))
    return dictionary.pivot_rewrite(turns, pivots, on_error="drop").select(*VARIANT)


# the same, joined by shuffle as if the dictionaries were too large to broadcast


@query
def eda_all_joined(spark, sf):
    turns, synonyms = _with_synonyms(spark, sf)
    lookup = eda.SynonymLookup(synonyms, broadcast_bytes=0)
    return eda.eda_augment(turns, lookup, eda.ALL_OPS).select(*VARIANT)


@query
def spelling_corrections(spark, sf):
    unknown, known = inputs.word_lists(inputs.conversations(spark, sf))
    return spelling.spelling_corrections(unknown, known)


@query
def correct_unknown_tokens(spark, sf):
    turns = inputs.conversations(spark, sf)
    found = stage(spelling.spelling_corrections(*inputs.word_lists(turns)), "corrections")
    return dictionary.correct_tokens(turns, found.select("token", "correction")).select(*VARIANT)


@query
def phrase_rewrite_keep(spark, sf):
    turns, words = _with_words(spark, sf)
    phrases = dictionary.PhraseLookup(*inputs.phrase_pivots(turns, words))
    return dictionary.phrase_rewrite(turns, phrases).select(*VARIANT)


@query
def phrase_rewrite_drop_joined(spark, sf):
    turns, words = _with_words(spark, sf)
    phrases = dictionary.PhraseLookup(*inputs.phrase_pivots(turns, words), broadcast_bytes=0)
    return dictionary.phrase_rewrite(turns, phrases, on_error="drop").select(*VARIANT)


@query
def correct_tokens_joined(spark, sf):
    turns, words = _with_words(spark, sf)
    lookup = dictionary.correction_lookup(inputs.corrections(words), broadcast_bytes=0)
    return dictionary.correct_tokens(turns, lookup).select(*VARIANT)


@query
def pivot_rewrite_joined(spark, sf):
    turns, words = _with_words(spark, sf)
    pivots = dictionary.PivotLookup(*inputs.pivots(words), broadcast_bytes=0)
    return dictionary.pivot_rewrite(turns, pivots).select(*VARIANT)


@query
def score_batches(spark, sf):
    def factory():
        return lambda texts: texts.str.replace("e", "", regex=False)

    docs = inputs.documents(spark, sf).select("row_key", "text")
    return models.score_batches(docs, factory)


@query
def score_batches_in_order(spark, sf):
    # a state machine over the characters: each state depends on the one before
    def factory():
        def last_state(text: str | None) -> str | None:
            state = 7
            for c in text or "":
                state = (state * 31 + ord(c)) % 1009
            return None if text is None else str(state)

        return lambda texts: texts.map(last_state)

    docs = inputs.documents(spark, sf).select("row_key", "text")
    return models.score_batches(docs, factory, "state", max_bytes=1 << 20).select("row_key", "state")


@query
def accumulator_counts(spark, sf):
    turns, words = _with_words(spark, sf)
    synonyms = inputs.synonyms(words)
    pivots = dictionary.PivotLookup(*inputs.pivots(words))
    everything = augment(
        turns,
        [
            lambda base: eda.eda_augment(base, synonyms),
            lambda base: dictionary.pivot_rewrite(base, pivots),
            lambda base: naive_augment(base, LATIN),
        ],
    )
    return everything.groupBy("aug_kind").agg(F.count(F.lit(1)).alias("n_rows"))


# --- prompts and generated text -----------------------------------------------


@query
def recovery_prompts(spark, sf):
    return synth.recovery_prompts(inputs.documents(spark, sf))


def _recovery(spark, sf, on_missing):
    docs = inputs.documents(spark, sf)
    outputs = inputs.recovery_outputs(docs)
    return synth.apply_recovery(docs, outputs, on_missing).select(*VARIANT)


@query
def apply_recovery_null(spark, sf):
    return _recovery(spark, sf, "null")


@query
def apply_recovery_keep(spark, sf):
    return _recovery(spark, sf, "keep")


@query
def apply_recovery_drop(spark, sf):
    return _recovery(spark, sf, "drop")


@query
def quote_strip_filter(spark, sf):
    docs = inputs.documents(spark, sf)
    return synth.clean_generated(docs, ["http", "###"]).select("ID", "text", "target")


@query
def sequential_ids(spark, sf):
    docs = inputs.documents(spark, sf)
    return sampling.sequential_ids(docs.drop("ID")).select("doc_id", "ID")


@query
def few_shot_sample(spark, sf):
    docs = inputs.documents(spark, sf)
    return sampling.sample_per_class(docs).select("row_key", "target", "rank", "text")


@query
def few_shot_prompts(spark, sf):
    return synth.few_shot_prompts(inputs.documents(spark, sf))


def _generations(spark, sf) -> DataFrame:
    return inputs.generations(inputs.documents(spark, sf))


TITLE = ("row_key", "target", "title_no", "text")


@query
def parse_generations(spark, sf):
    return synth.parse_generations(_generations(spark, sf)).select(*TITLE)


@query
def stream_parse_generations(spark, sf):
    source, target = new_path(spark, "records"), new_path(spark, "titles")
    _generations(spark, sf).write.json(source)
    stream = append_titles(
        read_generations(spark, source, "json", RECORD_SCHEMA),
        target,
        new_path(spark, "stream"),
    )
    stream.awaitTermination()
    return spark.read.parquet(target).select(*TITLE)


@query
def stream_numbered_titles(spark, sf):
    """Three rounds of records, each found by a stream that was started anew."""
    source, target, checkpoint = (new_path(spark, x) for x in ("records", "numbered", "stream"))
    records = _generations(spark, sf)
    for round_ in range(3):
        mine = F.col("row_key").cast("long") % 3 == round_
        records.where(mine).write.mode("append").json(source)
        found = read_generations(spark, source, "json", RECORD_SCHEMA, max_files=1 << 30)
        append_numbered(found, target, checkpoint).awaitTermination()
    return read_numbered(spark, target)


@query
def numbered_rounds(spark, sf):
    round_ = (F.col("row_key").cast("long") % 3).alias("round")
    return batch_rounds(_generations(spark, sf).select("*", round_))


def _synthetic(spark, sf) -> DataFrame:
    # parsed once; numbering and merging read the titles several times
    titles = stage(synth.parse_generations(_generations(spark, sf)), "titles")
    key = F.concat_ws("#", "row_key", "title_no")
    return synth.finalize_synthetic(titles.withColumn("row_key", key), ["http"])


@query
def synthetic_final(spark, sf):
    return _synthetic(spark, sf).select("ID", "text", "target")


@query
def synthetic_merge(spark, sf):
    # documents carry identifiers of the same format, so some of them clash
    docs = inputs.documents(spark, sf)
    ids = F.format_string(sampling.ID_FORMAT, "doc_id")
    return synth.merge_synthetic(docs.withColumn("ID", ids), _synthetic(spark, sf))


# --- splits and orders ----------------------------------------------------------


def _labelled_sides(split: sampling.Split) -> DataFrame:
    train = split.train.select("row_key", F.lit("train").alias("side"))
    return train.unionByName(split.valid.select("row_key", F.lit("valid").alias("side")))


@query
def split_hash(spark, sf):
    return _labelled_sides(sampling.split_hash(inputs.documents(spark, sf)))


@query
def split_exact(spark, sf):
    return _labelled_sides(sampling.split_exact(inputs.documents(spark, sf)))


@query
def split_group(spark, sf):
    variants = naive_augment(inputs.documents(spark, sf), LATIN)
    return _labelled_sides(sampling.split_group(variants))


@query
def shuffle_order(spark, sf):
    docs = inputs.documents(spark, sf)
    return sampling.shuffle_positions(docs).select("doc_id", "position")


@query
def shuffled_documents(spark, sf):
    return sampling.shuffle_rows(inputs.documents(spark, sf)).select("ID", "text", "target")


# --- scores, relabelling, metrics -----------------------------------------------


@query
def class_centroid_scores(spark, sf):
    scores = inputs.centroid_scores(spark, sf)
    return scores.select(
        "row_key", "target", F.posexplode("probs").alias("class", "prob")
    )


@query
def ensemble_relabel(spark, sf):
    scores = inputs.slice_scores(spark, sf)
    label = relabel.ensemble_label([F.col(f"raw{i}") for i in range(4)])
    return relabel.overwrite_target(scores, label).select("row_key", "target")


@query
def ensemble_relabel_by_model(spark, sf):
    # the same with each model's scores in rows of their own
    scores = inputs.slice_scores(spark, sf)
    raws = F.array(*[F.col(f"raw{i}") for i in range(4)])
    long = scores.select("row_key", F.posexplode(raws).alias("model", "raw"))
    means = relabel.mean_scores(long, inputs.NUM_CLASSES)
    label = relabel.argmax(F.transform("raw", lambda x: F.round(x, 9)))
    return means.select("row_key", label.alias("target"))


def _scored(spark, sf) -> DataFrame:
    return stage(inputs.centroid_scores(spark, sf), "scores")


@query
def label_thresholds(spark, sf):
    return relabel.label_thresholds(_scored(spark, sf), inputs.NUM_CLASSES)


@query
def confident_joint(spark, sf):
    return relabel.confident_joint(_scored(spark, sf), inputs.NUM_CLASSES)


@query
def label_issues(spark, sf):
    flagged = relabel.flag_issues(_scored(spark, sf), inputs.NUM_CLASSES)
    return relabel.label_issues(flagged)


@query
def corrected_labels(spark, sf):
    flagged = relabel.flag_issues(_scored(spark, sf), inputs.NUM_CLASSES)
    return flagged.select("row_key", relabel.corrected_target().alias("target"))


@query
def corrected_labels_by_key(spark, sf):
    scored = _scored(spark, sf)
    issues = relabel.label_issues(relabel.flag_issues(scored, inputs.NUM_CLASSES))
    return relabel.apply_corrections(scored, issues).select("row_key", "target")


@query
def issue_rows(spark, sf):
    scored = _scored(spark, sf)
    issues = relabel.label_issues(relabel.flag_issues(scored, inputs.NUM_CLASSES))
    return relabel.issue_texts(scored, issues).select("row_key", "target")


def _predicted(spark, sf) -> DataFrame:
    scores = inputs.centroid_scores(spark, sf)
    return scores.withColumn("prediction", relabel.argmax(F.col("probs")))


@query
def class_f1(spark, sf):
    return metrics.class_f1(_predicted(spark, sf)).select(
        "class", F.round("f1", 9).alias("f1")
    )


@query
def macro_f1(spark, sf):
    return metrics.macro_f1(_predicted(spark, sf)).select(
        F.round("macro_f1", 9).alias("macro_f1")
    )


# --- trained models: SQL checks that each row gets a class ------------------------

WORDS = TextModelSpec("word", 1, num_features=4096, max_iter=5, num_classes=4)
SPECS = (
    WORDS,
    TextModelSpec("word", 2, num_features=4096, max_iter=5, num_classes=4),
    TextModelSpec("char", 2, num_features=1024, max_iter=5, num_classes=4),
    TextModelSpec("char", 3, num_features=4096, max_iter=5, num_classes=4),
)


def _classes(rows: DataFrame) -> DataFrame:
    known = F.col("target").between(0, WORDS.num_classes - 1)
    return rows.select("row_key", F.coalesce(known, F.lit(False)).alias("has_class"))


def _cross_fitted(docs: DataFrame, fit: Callable, use: Callable) -> DataFrame:
    """All rows, each half scored by a model of the other half."""
    halves = sampling.split_hash(docs, 0.5)
    sides = (halves.train, halves.valid), (halves.valid, halves.train)
    first, second = (use(rest, fit(learn)) for learn, rest in sides)
    return first.unionByName(second)


@query
def mllib_predict(spark, sf):
    docs = inputs.labelled_documents(spark, sf)
    model = models.train(docs, WORDS)
    unlabelled = docs.where(F.col("target").isNull()).drop("target")
    return _classes(models.predict(unlabelled, model))


@query
def mllib_evaluate(spark, sf):
    labelled = inputs.labelled_documents(spark, sf).where("target is not null")
    return flows.train_and_evaluate(labelled, WORDS)[1]


@query
def mllib_relabel_all(spark, sf):
    docs = inputs.labelled_documents(spark, sf)
    return _classes(_cross_fitted(docs, lambda x: models.train(x, WORDS), models.relabel_all))


@query
def mllib_ensemble(spark, sf):
    docs = inputs.labelled_documents(spark, sf)
    return _classes(
        _cross_fitted(docs, lambda x: models.train_ensemble(x, SPECS), models.relabel_ensemble)
    )


@query
def mllib_label_issues(spark, sf):
    docs = inputs.labelled_documents(spark, sf)
    scored = _cross_fitted(docs, lambda x: models.train(x, WORDS), models.score).select(
        "row_key", "target", "probs"
    )
    flagged = relabel.flag_issues(stage(scored, "scores"), WORDS.num_classes)
    return relabel.label_issues(flagged)


# --- naive Bayes: the same steps with a model that SQL can train ------------------

BAYES = (
    BayesSpec(1, num_features=4096, num_classes=4),
    BayesSpec(2, num_features=4096, num_classes=4),
)


@query
def bayes_predict(spark, sf):
    docs = inputs.labelled_documents(spark, sf)
    model = models.train(docs, BAYES[0])
    unlabelled = docs.where(F.col("target").isNull())
    return models.predict(unlabelled, model).select("row_key", "target")


@query
def bayes_evaluate(spark, sf):
    labelled = inputs.labelled_documents(spark, sf).where("target is not null")
    f1 = flows.train_and_evaluate(labelled, BAYES[0])[1]
    return f1.select(F.round("macro_f1", 9).alias("macro_f1"))


@query
def bayes_relabel_all(spark, sf):
    docs = inputs.labelled_documents(spark, sf)
    relabelled = _cross_fitted(docs, lambda x: models.train(x, BAYES[0]), models.relabel_all)
    return relabelled.select("row_key", "target")


@query
def bayes_ensemble(spark, sf):
    docs = inputs.labelled_documents(spark, sf)
    relabelled = _cross_fitted(
        docs, lambda x: models.train_ensemble(x, BAYES), models.relabel_ensemble
    )
    return relabelled.select("row_key", "target")


@query
def bayes_label_issues(spark, sf):
    docs = inputs.labelled_documents(spark, sf)
    scored = _cross_fitted(docs, lambda x: models.train(x, BAYES[0]), models.score)
    kept = stage(scored.select("row_key", "target", "probs"), "scores")
    return relabel.label_issues(relabel.flag_issues(kept, BAYES[0].num_classes))


@query
def bayes_best_spec(spark, sf):
    split = sampling.split_hash(inputs.labelled_documents(spark, sf).where("target is not null"))
    model, f1 = models.train_best(split.train, split.valid, BAYES)
    # what the chosen model makes of all the rows it was chosen by
    return models.predict(split.valid, model).select(
        "row_key", "target", F.lit(model.spec.ngram).alias("ngram"), F.round(F.lit(f1), 9).alias("macro_f1")
    )


def _linear(spark, sf, model: int | None) -> DataFrame:
    docs = inputs.labelled_documents(spark, sf)
    return train_linear(docs, inputs.LINEAR).predict(docs, model=model).select("row_key", "target")


@query
def linear_softmax(spark, sf):
    return _linear(spark, sf, 0)


@query
def linear_logistic(spark, sf):
    return _linear(spark, sf, 1)


@query
def linear_hinge(spark, sf):
    return _linear(spark, sf, 2)


@query
def linear_squares(spark, sf):
    return _linear(spark, sf, 3)


@query
def linear_ensemble(spark, sf):
    # four estimators that differ, on one scale
    return _linear(spark, sf, None)


@query
def bayes_cross_validated_spec(spark, sf):
    labelled = inputs.labelled_documents(spark, sf).where("target is not null")
    model, f1 = models.cross_validated(labelled, BAYES, folds=5)
    # each row gets the class that the model without its fold gives it
    return models.predict(labelled, model).select(
        "row_key", "target", F.lit(model.spec.ngram).alias("ngram"), F.round(F.lit(f1), 9).alias("macro_f1")
    )


# --- end to end --------------------------------------------------------------------


def _counts(result: DataFrame) -> DataFrame:
    side = F.element_at(F.split("row_key", "#"), 2)
    return result.groupBy(side.alias("side"), "aug_kind").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query
def hard_flow_counts(spark, sf):
    corpus = inputs.labelled_documents(spark, sf)
    return _counts(flows.hard_flow(corpus, inputs.resources(corpus), SPECS[:2], LATIN))


def _flow_rows(result: DataFrame) -> DataFrame:
    """Texts do not depend on a model, targets do on the clean side."""
    noisy = F.element_at(F.split("row_key", "#"), 2) == "noisy"
    target = F.when(noisy, F.col("target").cast("string"))
    return result.select("row_key", "ID", "aug_kind", "text", target.alias("target"))


@query
def hard_flow_rows(spark, sf):
    corpus = inputs.labelled_documents(spark, sf)
    return _flow_rows(flows.hard_flow(corpus, inputs.resources(corpus), SPECS[:2], LATIN))


@query
def notebook_flow_rows(spark, sf):
    corpus = inputs.labelled_documents(spark, sf)
    return _flow_rows(flows.notebook_flow(corpus, inputs.resources(corpus), SPECS[:1], LATIN))


@query
def soft_flow_rows(spark, sf):
    corpus = inputs.labelled_documents(spark, sf)
    return _flow_rows(flows.soft_flow(corpus, inputs.resources(corpus), WORDS, LATIN))


@query
def relabel_run(spark, sf):
    # from files: one half of the documents trains, the other is relabelled
    halves = sampling.split_hash(inputs.labelled_documents(spark, sf), 0.5)
    paths = [new_path(spark, side) + ".parquet" for side in ("train", "relabel")]
    for path, half in zip(paths, halves):
        write_corpus(half, path)
    return flows.relabel_run(*paths, BAYES[0], spark).select("ID", "target")


@query
def soft_flow_counts(spark, sf):
    corpus = inputs.labelled_documents(spark, sf)
    return _counts(flows.soft_flow(corpus, inputs.resources(corpus), WORDS, LATIN))


@query
def notebook_flow_counts(spark, sf):
    corpus = inputs.labelled_documents(spark, sf)
    result = flows.notebook_flow(corpus, inputs.resources(corpus), SPECS[:1], LATIN)
    return _counts(result)


# --- CSV in and out ----------------------------------------------------------------


@query
def path_or_frame(spark, sf):
    # CSV by path, Parquet by path, and a frame, which passes
    docs = inputs.documents(spark, sf).select("ID", "text", "target")
    csv, parquet = new_path(spark, "csv"), new_path(spark, "table") + ".parquet"
    write_corpus(docs, csv, fmt="csv")
    write_corpus(docs, parquet)
    read = [as_dataframe(spark, csv), as_dataframe(spark, parquet, strict=True), as_dataframe(spark, docs, strict=True)]
    named = [df.select("ID", "text", "target", F.lit(i).alias("source")) for i, df in enumerate(read)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query
def csv_round_trip(spark, sf):
    path = new_path(spark, "csv")
    write_corpus(inputs.documents(spark, sf), path, fmt="csv")
    return read_corpus(spark, path)


@query
def csv_many_files(spark, sf):
    # all documents in three folders, whose columns differ in order and number
    docs = inputs.documents(spark, sf)
    orders = (("ID", "text", "target"), ("target", "text", "ID"), ("text", "ID"))
    paths = []
    for i, columns in enumerate(orders):
        paths.append(new_path(spark, "csv"))
        write_corpus(docs.where(F.col("target") % 3 == i), paths[-1], columns, fmt="csv")
    # as text: data frames on the driver differ in how they hold missing integers
    return read_corpus(spark, paths).withColumn("target", F.col("target").cast("string"))


@query
def csv_append(spark, sf):
    path = new_path(spark, "csv")
    docs = inputs.documents(spark, sf)
    append_corpus(docs, path)
    append_corpus(docs.withColumn("text", F.lower("text")), path)
    return read_corpus(spark, path, GENERATED_SCHEMA)


@query
def csv_unquoted(spark, sf):
    # the lines of all files that have a header
    path = new_path(spark, "csv")
    write_unquoted(inputs.documents(spark, sf), path)
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    header = F.col("value") == "ID,text,target"
    with_header = lines.where(header).select("file").distinct()
    return lines.where(~header).join(with_header, "file", "left_semi").select("value")
