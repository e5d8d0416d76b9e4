"""Text classifiers, on MLlib and naive Bayes: training, scoring and ensembles."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF
from pyspark.ml.functions import vector_to_array
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.functions.arrow import bounded_runs
from corpusmith.functions.columns import argmax
from corpusmith.operators.bayes import SHARED, BayesFolds, BayesModel, BayesSpec, train_bayes, train_folds, words
from corpusmith.operators.grams import HashedGrams
from corpusmith.operators.metrics import macro_f1
from corpusmith.operators.relabel import ensemble_label, overwrite_target
from corpusmith.sources.staging import stage


@dataclass(frozen=True)
class TextModelSpec:
    """Features and hyper-parameters of one classifier.

    ``unit`` is "word" or "char", ``ngram`` the n-gram length. ``idf`` weights the
    features, at the price of one more pass over the training set; the classifier
    standardises them anyway, which undoes any such weighting.
    """

    unit: str = "word"
    ngram: int = 1
    num_features: int = 1 << 14
    max_iter: int = 20
    reg_param: float = 0.01
    num_classes: int = 7
    idf: bool = False


Spec = TextModelSpec | BayesSpec
Model = PipelineModel | BayesModel | BayesFolds

# Four models that differ in what they see of a text. Naive Bayes is not among
# them: its log scores grow with the text and would outweigh the others' in a mean.
ENSEMBLE = (
    TextModelSpec("word", 1),
    TextModelSpec("word", 2),
    TextModelSpec("char", 2),
    TextModelSpec("char", 3),
)


def _grams(spec: TextModelSpec, output: str = "_tf") -> HashedGrams:
    return HashedGrams(
        inputCol="_text", outputCol=output, numFeatures=spec.num_features, unit=spec.unit, n=spec.ngram
    )


def _estimators(spec: TextModelSpec) -> list[Estimator]:
    """What is fitted to the counts of n-grams."""
    stages, column = [], "_tf"
    if spec.idf:
        stages.append(IDF(inputCol="_tf", outputCol="_idf"))
        column = "_idf"
    stages.append(
        LogisticRegression(
            featuresCol=column,
            labelCol="labels",
            rawPredictionCol="_raw",
            probabilityCol="_probability",
            predictionCol="_prediction",
            family="multinomial",
            maxIter=spec.max_iter,
            regParam=spec.reg_param,
        )
    )
    return stages


def build_pipeline(spec: TextModelSpec) -> Pipeline:
    return Pipeline(stages=[_grams(spec), *_estimators(spec)])


def _labels(spec: TextModelSpec) -> Column:
    # all models know all classes, even those absent from this training set
    classes = {"ml_attr": {"type": "nominal", "num_vals": spec.num_classes}}
    return F.col("labels").alias("labels", metadata=classes)


def _prepared(df: DataFrame) -> DataFrame:
    return df.where(F.col("target").isNotNull()).select(
        F.coalesce("text", F.lit("")).alias("_text"), F.col("target").cast("double").alias("labels")
    )


def train(df: DataFrame, spec: Spec = TextModelSpec()) -> Model:
    """Fit a classifier on ``text`` and ``target`` (0..num_classes-1)."""
    if isinstance(spec, BayesSpec):
        return train_bayes(df, spec)
    return build_pipeline(spec).fit(_prepared(df).select("_text", _labels(spec)))


def train_ensemble(
    df: DataFrame, specs: Sequence[Spec] = ENSEMBLE
) -> list[Model]:
    """Fit a classifier per specification.

    One pass counts the n-grams of all of them; each is then fitted to its staged counts
    and reads no text again.
    """
    texts = {i: spec for i, spec in enumerate(specs) if isinstance(spec, TextModelSpec)}
    if len(texts) < 2:
        return [train(df, spec) for spec in specs]
    frame = _prepared(df)
    for i, spec in texts.items():
        frame = _grams(spec, f"_tf{i}").transform(frame)
    vectors = stage(frame.drop("_text"), "vectors")

    def fitted(i: int, spec: Spec) -> Model:
        if i not in texts:
            return train(df, spec)
        mine = vectors.select(F.col(f"_tf{i}").alias("_tf"), _labels(spec))
        return PipelineModel([_grams(spec), *Pipeline(stages=_estimators(spec)).fit(mine).stages])

    return [fitted(i, spec) for i, spec in enumerate(specs)]


def score(
    df: DataFrame, model: Model, probs: str = "probs", raw: str = "raw"
) -> DataFrame:
    """Add class probabilities and raw scores to the rows they belong to."""
    if isinstance(model, BayesModel | BayesFolds):
        return model.score(df, probs, raw)
    scored = model.transform(df.withColumn("_text", F.coalesce("text", F.lit(""))))
    return scored.select(
        *df.columns,
        vector_to_array("_probability").alias(probs),
        vector_to_array("_raw").alias(raw),
    )


def predict(df: DataFrame, model: Model, output: str = "target") -> DataFrame:
    """Write the most probable class into ``output``."""
    keep = [c for c in df.columns if c != output]
    return score(df, model).select(*keep, argmax(F.col("probs")).alias(output))


def relabel_all(df: DataFrame, model: Model) -> DataFrame:
    """Overwrite every target with one model's prediction."""
    return predict(df, model).select(*df.columns)


def relabel_ensemble(df: DataFrame, models: Sequence[Model]) -> DataFrame:
    """Overwrite every target with the arg-max of the mean raw scores.

    The models score the same rows one after another, so their scores meet on
    the row and need no join.
    """
    scored = df
    if sum(isinstance(model, BayesModel | BayesFolds) for model in models) > 1:
        scored = scored.withColumn(SHARED, words())
    for i, model in enumerate(models):
        scored = score(scored, model, f"_probs{i}", f"_raw{i}")
    raws = [F.col(f"_raw{i}") for i in range(len(models))]
    return overwrite_target(scored, ensemble_label(raws)).select(*df.columns)


def evaluate(df: DataFrame, model: Model) -> DataFrame:
    """Macro F1 of a model on a labelled frame, one row."""
    return macro_f1(predict(df, model, output="prediction"))


def train_best(
    train_df: DataFrame, valid_df: DataFrame, specs: Iterable[Spec]
) -> tuple[Model, float]:
    """Train each candidate and keep the one with the best validation macro F1.

    Raises ``ValueError`` without validation rows that have a label.
    """
    best: tuple[Model, float] | None = None
    for spec in specs:
        model = train(train_df, spec)
        f1 = evaluate(valid_df, model).head()[0]
        if f1 is None:
            raise ValueError("no labelled rows to choose a model by")
        if best is None or f1 > best[1]:
            best = (model, f1)
    if best is None:
        raise ValueError("no model specifications given")
    return best


def cross_validated(
    df: DataFrame, specs: Sequence[BayesSpec], folds: int = 5
) -> tuple[BayesFolds, float]:
    """The models of the specification with the best macro F1 on unseen rows, and that F1.

    Every row is judged by the model that was trained without its fold. All
    models are counted in one pass, and one more pass scores all specifications.
    Of equal F1 the first specification wins; without labelled rows F1 is 0.
    """
    trained = train_folds(df, specs, folds)
    scored = df.where(F.col("target").between(0, specs[0].num_classes - 1))
    scored = scored.withColumn(SHARED, words())
    for i, model in enumerate(trained):
        scored = predict(scored, model, f"_prediction{i}")
    guesses = [
        F.struct(F.lit(i).alias("spec"), F.col(f"_prediction{i}").alias("prediction"))
        for i in range(len(trained))
    ]
    judged = macro_f1(scored.select("target", F.inline(F.array(*guesses))), by=["spec"])
    f1s = {r.spec: r.macro_f1 for r in judged.collect()}
    best = max(range(len(trained)), key=lambda i: (f1s.get(i, 0.0), -i))
    return trained[best], f1s.get(best, 0.0)


_loaded: dict[str, Callable] = {}


def _model(name: str, factory: Callable[[], Callable]) -> Callable:
    """The worker's model: built for its first batch and kept from task to task."""
    if name not in _loaded:
        _loaded.clear()  # one model at a time, as it may fill the memory
        _loaded[name] = factory()
    return _loaded[name]


def score_batches(
    df: DataFrame,
    factory: Callable[[], Callable],
    output: str = "text",
    max_bytes: int = 16 << 20,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Run any Python model over ``text``, batch by batch.

    ``factory`` builds the model once per Python worker; the model maps a pandas
    Series of texts to a Series of texts. The result replaces ``output``. A batch
    holds at most ``max_bytes`` of text, or one text, so that long texts don't add
    up. ``profile`` asks for executors and tasks with the resources the model
    needs (memory, cores, accelerators) for this stage alone.
    """
    name = uuid.uuid4().hex
    schema = df.schema if output in df.columns else df.withColumn(output, F.col("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for start, stop in bounded_runs(sizes, max_bytes):
                # only the texts of the part become Python's, and only while it lasts
                part = batch.slice(start, stop - start)
                texts = part.column("text")
                kind = part.column(output).type if output in part.schema.names else texts.type
                made = pa.array(_model(name, factory)(texts.to_pandas()), kind, from_pandas=True)
                columns = [made if c == output else part.column(c) for c in schema.names]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.mapInArrow(run, schema, profile=profile)
