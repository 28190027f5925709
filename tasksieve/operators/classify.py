"""Classifiers: features and labels, splits, training, evaluation, scoring, explanations."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tasksieve import constants as K
from tasksieve.functions.text import prepare_for_scoring
from tasksieve.operators import logistic
from tasksieve.operators.features import embed_texts, feature_packs, strip_accents, tfidf_of_packs, token_packs
from tasksieve.session import checkpointed, rows_table, small_side, top_per_group


def align_features(vec: DataFrame, labels: DataFrame, id_col: str = "task_id") -> DataFrame:
    """Vectors with a label, joined by id."""
    return vec.join(labels, id_col)


def encode_labels(df: DataFrame, label: str = "label", out: str = "label_index") -> DataFrame:
    """Labels as numbers from 0 in alphabetical order."""
    names = df.select(label).distinct()
    order = F.array_sort(F.collect_list(label))
    index = names.agg(order.alias("all")).select(F.posexplode("all").alias(out, label))
    return df.join(small_side(index), label).select(*df.columns, F.col(out).cast("bigint").alias(out))


# ------------------------------------------------------------------ splits


def _draw(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def label_position(df: DataFrame, label: str, seed: int = 42, id_col: str = "task_id") -> DataFrame:
    """Adds ``position`` (from 1) and ``size``: a row's place in a seeded shuffle of its label.

    Exact per label without sorting a label in one task: rows are counted per
    label and slice of the draw (4,096 slices), and only the rows of one slice
    are ranked together.
    """
    drawn = df.withColumn("__draw", _draw(id_col, seed)).withColumn("__slice", F.substring("__draw", 1, 3))
    counts = drawn.groupBy(label, "__slice").agg(F.count("*").alias("__n"))
    order = Window.partitionBy(label).orderBy("__slice")
    offsets = counts.select(
        label, "__slice", (F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")).alias("__before"),
        F.sum("__n").over(Window.partitionBy(label)).alias("size"))
    inside = F.row_number().over(Window.partitionBy(label, "__slice").orderBy("__draw", id_col))
    ranked = drawn.withColumn("__inside", inside)
    return (ranked.join(offsets, [label, "__slice"])
            .select(*df.columns, (F.col("__before") + F.col("__inside")).alias("position"), "size"))


def stratified_split(df: DataFrame, label: str, test: float = 0.2, seed: int = 42, id_col: str = "task_id") -> DataFrame:
    """Adds ``is_test``: the first ``ceil(test * size)`` rows of each label's shuffle.

    Only ids are counted and ranked, up to the last id of each label that is in; rows are then told by their own draw, so they
    stay where they are.  Rows without a label or an id have no place and are left out.  If rows with the same id lie across the cut,
    all places are found, see ``label_position``.
    """
    drawn = df.select(label, id_col, _draw(id_col, seed).alias("__draw")).withColumn("__slice", F.substring("__draw", 1, 3))
    counts = drawn.groupBy(label, "__slice").agg(F.count("*").alias("__n"))
    order = Window.partitionBy(label).orderBy("__slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.sum("__n").over(Window.partitionBy(label))
    cuts = counts.select(label, "__slice", "__n", F.sum("__n").over(order).alias("__upto"), F.ceil(F.round(size * test, 9)).alias("__cut"))
    last = cuts.filter((F.col("__cut") > F.col("__upto") - F.col("__n")) & (F.col("__cut") <= F.col("__upto"))).select(
        label, "__slice", (F.col("__cut") - F.col("__upto") + F.col("__n")).alias("__more"))
    same = drawn.join(small_side(last), [label, "__slice"]).groupBy(label, "__draw", id_col).agg(F.count("*").alias("__n"), F.first("__more").alias("__more"))
    upto = F.sum("__n").over(Window.partitionBy(label).orderBy("__draw", id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    border = (same.withColumn("__upto", upto).filter((F.col("__more") > F.col("__upto") - F.col("__n")) & (F.col("__more") <= F.col("__upto")))
              .select(label, F.struct("__draw", F.col(id_col).alias("__id")).alias("__last"), (F.col("__more") < F.col("__upto")).alias("__across"))
              .persist(StorageLevel.MEMORY_AND_DISK))
    if border.filter("__across").limit(1).count():
        placed = label_position(df, label, seed, id_col)
        cut = F.ceil(F.round(F.col("size") * test, 9))
        return placed.withColumn("is_test", F.col("position") <= cut).drop("position", "size")
    named = df.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).join(small_side(border.drop("__across")), label, "left")
    own = F.struct(_draw(id_col, seed).alias("__draw"), F.col(id_col).alias("__id"))
    return named.select(*df.columns, F.coalesce(own <= F.col("__last"), F.lit(False)).alias("is_test"))


def stratified_folds(df: DataFrame, label: str, k: int = 5, seed: int = 42, id_col: str = "task_id") -> DataFrame:
    """Adds ``fold``, 0 to k-1, dealt in turn along each label's shuffle."""
    placed = label_position(df, label, seed, id_col)
    return placed.withColumn("fold", (F.col("position") % k).cast("bigint")).drop("position", "size")


# ---------------------------------------------------------------- training


def one_a_core(rows: DataFrame) -> DataFrame:
    """The rows in no more partitions than there are cores.

    Each task of a training step sends sums as long as the model, so what a step sends must not grow with the number of
    partitions, that is, with the rows.
    """
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)


def as_features(df: DataFrame, vector: str = "embedding", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vector).cast("array<double>")))


def _label_stages(label: str, **logreg) -> list:
    indexer = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip")
    model = LogisticRegression(featuresCol="features", labelCol="label_index", family="multinomial",
                               standardization=False, elasticNetParam=0.0, **logreg)
    return [indexer, model]


def _with_names(fitted: PipelineModel, first: list) -> PipelineModel:
    """The model without its label indexer, so that it scores rows without labels."""
    indexer, model = fitted.stages
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=list(indexer.labels))
    return PipelineModel(stages=[*first, model, back])


def train_logreg(df: DataFrame, label: str = "label", C: float = 1.0, max_iter: int = 1000) -> PipelineModel:
    """Multinomial logistic regression on a vector column ``features``.

    ``C`` weighs the summed loss against the penalty, so the penalty on the mean
    loss is ``1 / (C n)``.
    """
    n = df.count()
    return _with_names(Pipeline(stages=_label_stages(label, maxIter=max_iter, regParam=1 / (C * n))).fit(df), [])


def train_tfidf_logreg(df: DataFrame, text: str = "cleaned_text", label: str = "label", C: float = 5.0, balanced: bool = True,
                       vocab: int = 25_000, min_df: int = 2, max_iter: int = 1000) -> PipelineModel:
    """TF-IDF of words and word pairs, then logistic regression with balanced label weights, see ``logistic``.

    Rows without a label count for the penalty only.  Expects ``text`` after ``strip_accents``; see ``tfidf_input``.
    """
    named = df.select(F.col(label).cast("string").alias("label"), F.when(F.col(label).isNotNull(), F.col(text)).alias(text))
    packs = checkpointed(token_packs(named, text, ["label"], K.TFIDF_TOKEN))
    sizes = dict(packs.select(F.explode("c_label").alias("label")).groupBy("label").agg(F.count("*").alias("n")).collect())
    n, k, known = sum(sizes.values()), len(sizes), sum(m for c, m in sizes.items() if c is not None)
    features = tfidf_of_packs(packs, known, text, vocab=vocab, min_df=min_df)
    classes = sorted(c for c in sizes if c is not None)
    weights = [n / k / sizes[c] if balanced else 1.0 for c in classes]
    vectors = features.stages[0]
    terms, idf = vectors.vocabulary, np.array(vectors.getOrDefault(vectors.idf_))
    stored = checkpointed(feature_packs(packs, ["label"], terms, idf))
    model = logistic_model(*logistic.fit(stored, "label", classes, weights, idf, 1 / (C * n), max_iter=max_iter))
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=classes)
    return PipelineModel(stages=[*features.stages, model, back])


def logistic_model(coefficients: np.ndarray, intercepts: np.ndarray) -> LogisticRegressionModel:
    """Coefficients as the model MLlib's own training returns."""
    k, v = coefficients.shape
    spark = SparkSession.getActiveSession()
    matrix = _py2java(spark.sparkContext, DenseMatrix(k, v, coefficients.ravel(), True))
    made = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"logreg_{uuid.uuid4().hex[:12]}", matrix, _py2java(spark.sparkContext, DenseVector(intercepts)), k, True)
    return LogisticRegressionModel(made).setFeaturesCol("features").setPredictionCol("prediction")


def tfidf_input(df: DataFrame, text: str = "cleaned_text") -> DataFrame:
    return df.withColumn(text, strip_accents(F.lower(text)))


def cross_val_predict(df: DataFrame, train, label: str = "label", k: int = 5, seed: int = 42, id_col: str = "task_id") -> DataFrame:
    """``(id, label, fold, predicted)``: each row predicted by a model that has not seen it."""
    folds = checkpointed(stratified_folds(df, label, k, seed, id_col))
    out = None
    for fold in range(k):
        model = train(folds.filter(F.col("fold") != fold))
        part = model.transform(folds.filter(F.col("fold") == fold)).select(id_col, label, "fold", "predicted")
        out = part if out is None else out.unionByName(part)
    return out


def cross_val_scores(predicted: DataFrame, label: str = "label") -> DataFrame:
    """One row per fold, and ``ALL``: mean accuracy, twice its deviation, and the band around the mean."""
    per_fold = predicted.groupBy("fold").agg(F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("accuracy"))
    spread = 2 * F.stddev_pop("accuracy")
    mean = F.avg("accuracy")
    overall = per_fold.agg(mean.alias("accuracy"), spread.alias("two_sigma"), (mean - spread).alias("low"), (mean + spread).alias("high"))
    none = F.lit(None).cast("double")
    return per_fold.select(F.col("fold").cast("string").alias("fold"), "accuracy", none.alias("two_sigma"), none.alias("low"),
                           none.alias("high")).unionByName(overall.select(F.lit("ALL").alias("fold"), "accuracy", "two_sigma", "low", "high"))


# -------------------------------------------------------------- evaluation


def accuracy(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def average_confidence(df: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    return df.agg(F.avg(F.array_max(probabilities)).alias("average_confidence"))


def confusion_counts(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, label: str = "label", predicted: str = "predicted", values: list[str] | None = None) -> DataFrame:
    grouped = df.groupBy(label)
    return (grouped.pivot(predicted, values) if values else grouped.pivot(predicted)).count().na.fill(0)


def classification_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """``(class, precision, recall, f1, support)`` per class plus macro and weighted averages.

    Everything follows from the counts per (label, prediction).  Divisions by
    zero give 0.
    """
    counts = confusion_counts(df, label, predicted)
    own = F.col(label) == F.col(predicted)
    sides = counts.select(F.inline(F.array(
        F.struct(F.col(label).cast("string").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"),
                 F.when(own, F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col(predicted).cast("string").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"),
                 F.lit(0).cast("bigint").alias("hits")))))
    sums = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hits"), F.col("guessed")), ratio(F.col("hits"), F.col("support"))
    per_class = sums.select("class", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")
    scores = ["precision", "recall", "f1"]
    macro = per_class.agg(*[F.avg(c).alias(c) for c in scores], F.sum("support").alias("support"))
    weighted = per_class.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in scores],
                             F.sum("support").alias("support"))
    cols = ["class", *scores, "support"]
    return (per_class.unionByName(macro.select(F.lit("macro avg").alias("class"), *cols[1:]))
            .unionByName(weighted.select(F.lit("weighted avg").alias("class"), *cols[1:])))


# ----------------------------------------------------------------- scoring


def class_names(model: PipelineModel) -> list[str]:
    return list(model.stages[-1].getLabels())


def ranked_classes(probability: Column, names: list[str]) -> Column:
    """``array<struct<p, label>>`` with the most probable class first, ties by name."""
    pairs = F.zip_with(probability, F.array(*[F.lit(n) for n in names]), lambda p, n: F.struct((-p).alias("minus"), n.alias("label")))
    return F.transform(F.array_sort(pairs), lambda x: F.struct((-x["minus"]).alias("p"), x["label"].alias("label")))


def decide(scored: DataFrame, ranked: str, pillars: DataFrame, names: list[str], short: Column, alternatives: int, keep: list[str],
           default: str = "Unknown") -> DataFrame:
    """Top class, its pillar, its probability and the runners-up; pillars are looked up for the model's classes only."""
    known = pillars.filter(F.col("label").isin(names)).groupBy("label").agg(F.min("business_pillar").alias("p")).collect()
    lookup = F.create_map(*[F.lit(x) for r in known for x in (r["label"], r["p"])]) if known else None

    def pillar(name: Column) -> Column:
        return F.coalesce(F.try_element_at(lookup, name), F.lit(default)) if lookup is not None else F.lit(default)

    best = F.try_element_at(F.col(ranked), F.lit(1))
    others = F.transform(F.slice(F.col(ranked), 2, alternatives), lambda x: F.struct(
        x["label"].alias("sub_type"), pillar(x["label"]).alias("issue_type"), x["p"].alias("confidence")))
    none = F.array().cast("array<struct<sub_type:string,issue_type:string,confidence:double>>")
    return scored.select(
        *keep, F.when(short, default).otherwise(best["label"]).alias("sub_type"),
        F.when(short, default).otherwise(pillar(best["label"])).alias("issue_type"),
        F.when(short, 0.0).otherwise(best["p"]).alias("confidence"),
        F.when(short, none).otherwise(others).alias("alternatives"))


def score(df: DataFrame, model: PipelineModel, pillars: DataFrame, text: str = "text", min_chars: int = 5, alternatives: int = 3,
          id_col: str = "task_id", mask: bool = True, features: str = "tfidf", make_encoder=None) -> DataFrame:
    """``(id, sub_type, issue_type, confidence, alternatives)``; texts below ``min_chars`` are Unknown.

    ``features='tfidf'`` for models of ``train_tfidf_logreg``, ``'embedding'`` for
    models on vectors, which are made here with ``make_encoder``.
    """
    clean = df.select(id_col, prepare_for_scoring(F.col(text), mask).alias("__clean"))
    if features == "tfidf":
        column = model.stages[0].getInputCol()
        ready = clean.withColumn(column, strip_accents(F.lower("__clean")))
    else:
        vectors = embed_texts(clean, "__clean", make_encoder, id_col)
        ready = as_features(clean.join(vectors, id_col))
    scored = model.transform(ready).withColumn("__ranked", ranked_classes(vector_to_array("probability"), class_names(model)))
    return decide(scored, "__ranked", pillars, class_names(model), F.length("__clean") < min_chars, alternatives, [id_col])


def score_batch(df: DataFrame, model: PipelineModel, pillars: DataFrame, **options) -> DataFrame:
    """Many texts at once: the same operator without alternatives."""
    return score(df, model, pillars, alternatives=0, **options).drop("alternatives")


def score_alternatives(probs: DataFrame, n: int = 3, pillars: DataFrame | None = None, id_col: str = "task_id", label: str = "label",
                       prob: str = "prob") -> DataFrame:
    """``(id, rank, label, prob)``: ranks 2 to n+1 of a long probability table (one row per id and class)."""
    order = F.array_sort(F.collect_list(F.struct((-F.round(prob, 12)).alias("minus"), F.col(label).alias("label"), F.col(prob).alias("p"))))
    ranked = probs.groupBy(id_col).agg(F.slice(order, 2, n).alias("r")).select(id_col, F.posexplode("r").alias("i", "x"))
    out = ranked.select(id_col, (F.col("i") + 2).cast("bigint").alias("rank"), F.col("x.label").alias(label), F.col("x.p").alias(prob))
    if pillars is None:
        return out
    return out.join(small_side(pillars), label, "left").withColumn("business_pillar", F.coalesce("business_pillar", F.lit("Unknown")))


def coefficient_table(model: PipelineModel, spark) -> DataFrame:
    """``(label, term, coefficient)`` of a TF-IDF model; as long as vocabulary times labels."""
    vocabulary = next(s for s in model.stages if hasattr(s, "vocabulary")).vocabulary
    weights = next(s for s in model.stages if hasattr(s, "coefficientMatrix")).coefficientMatrix.toArray()
    rows = [(name, vocabulary[j], float(w[j])) for name, w in zip(class_names(model), weights) for j in np.flatnonzero(w)]
    return rows_table(spark, rows, "label string, term string, coefficient double")


def explain_prediction(features: DataFrame, coefficients: DataFrame, predicted: DataFrame, k: int = 10, id_col: str = "task_id",
                       label: str = "label") -> DataFrame:
    """``(id, rank, term, contribution)``: the terms that spoke most for the predicted class.

    ``features (id, term, weight)``, ``coefficients (label, term, coefficient)``,
    ``predicted (id, label)``; only positive contributions are reported.
    """
    joined = features.join(predicted.select(id_col, label), id_col).join(
        small_side(coefficients, 1_000_000), [label, "term"])
    worth = joined.withColumn("contribution", F.col("weight") * F.col("coefficient")).filter("contribution > 0")
    return top_per_group(worth, [id_col], [F.desc(F.round("contribution", 9)), F.asc("term")], k).select(
        id_col, "rank", "term", "contribution")
