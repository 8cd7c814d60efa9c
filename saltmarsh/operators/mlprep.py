"""Feature preparation, training and scoring on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions import text as tx
from saltmarsh.operators.ordering import attach_row, exact_quantiles, row_rank
from saltmarsh.operators.pairing import LABELS, VECTORS, reverse_expressions, reverse_places
from saltmarsh.session import small_table

INFINITE = float("inf")
# A category with more values than this is an error, not a feature.
MAX_LEVELS = 100_000


def finite(column: Column) -> Column:
    """NaN and infinities become null."""
    number = column.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != INFINITE), number)


# --- imputation, scaling, categories ------------------------------------------------


def medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the training median of every column, 0 for an empty one.

    Columns are counted by their place: numbers are quicker to group by than names.
    """
    places = train.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("feature", "value"))
    found = exact_quantiles(places.withColumn("value", finite(F.col("value"))), ["feature"], "value", {"median": 0.5})
    return found.agg(*[
        F.coalesce(F.max(F.when(F.col("feature") == i, F.col("median"))), F.lit(0.0)).alias(f"_m_{c}")
        for i, c in enumerate(columns)
    ])


def impute(df: DataFrame, columns: Sequence[str], train_medians: DataFrame) -> DataFrame:
    """Fill missing and infinite numbers with the training medians.

    A column the table does not have is created from its median.
    """
    widened = df.select("*", *[F.lit(None).cast("double").alias(c) for c in columns if c not in df.columns])
    joined = attach_row(widened, train_medians)
    filled = {c: F.coalesce(finite(F.col(c)), F.col(f"_m_{c}")) for c in columns}
    return joined.withColumns(filled).drop(*[f"_m_{c}" for c in columns])


def scale(df: DataFrame, columns: Sequence[str], train: DataFrame) -> DataFrame:
    """Center and scale with training mean and population deviation."""
    stats = train.agg(
        *[F.avg(c).alias(f"_avg_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_dev_{c}") for c in columns],
    )
    joined = attach_row(df, stats)
    # A constant column is centered only.
    scaled = {
        c: (F.col(c) - F.col(f"_avg_{c}"))
        / F.when(F.col(f"_dev_{c}") > 0, F.col(f"_dev_{c}")).otherwise(1.0)
        for c in columns
    }
    return joined.withColumns(scaled).drop(*[f"_avg_{c}" for c in columns], *[f"_dev_{c}" for c in columns])


def category_levels(train: DataFrame, column: str) -> DataFrame:
    """Sorted training levels with codes; ``unknown`` is 0."""
    known = train.select(column).filter((F.col(column) != tx.UNKNOWN) & F.col(column).isNotNull()).distinct()
    numbered = row_rank(known, [], [F.col(column)], "code")
    unknown = small_table(train.sparkSession, [(tx.UNKNOWN, 0)], f"{column} string, code bigint")
    return numbered.select(column, "code").unionByName(unknown)


def ordinal(df: DataFrame, column: str, levels: DataFrame, name: str = "code") -> DataFrame:
    """Code of each category; unseen ones are 0."""
    codes = levels.select(F.col(column), F.col("code").cast("double").alias("_code"))
    return df.join(codes, column, "left").withColumn(name, F.coalesce("_code", F.lit(0.0))).drop("_code")


def native_category(df: DataFrame, column: str, levels: DataFrame, name: str = "level") -> DataFrame:
    """Category text limited to training levels; unseen ones are ``unknown``."""
    known = levels.select(F.col(column), F.col(column).alias("_level"))
    return df.join(known, column, "left").withColumn(name, F.coalesce("_level", F.lit(tx.UNKNOWN))).drop("_level")


def one_hot(df: DataFrame, column: str, levels: Sequence[str], prefix: str) -> DataFrame:
    """One 0/1 column per training level; an unseen level is all zeros."""
    return df.withColumns({
        f"{prefix}{level}": F.when(F.col(column) == level, 1.0).otherwise(0.0) for level in levels
    })


# --- training -----------------------------------------------------------------------


def feature_stages(numeric: Sequence[str], category: str | None = None) -> list:
    """Assemble numbers and an optional category; unseen categories are kept apart."""
    inputs, stages = list(numeric), []
    if category:
        stages = [
            StringIndexer(inputCol=category, outputCol="_index", handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCol="_index", outputCol="_hot", dropLast=False),
        ]
        inputs.append("_hot")
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error")]


def regressors(target: str, weight: str, seed: int = 42) -> dict:
    common = {"labelCol": target, "featuresCol": "features", "weightCol": weight, "seed": seed}
    return {
        "random_forest": RandomForestRegressor(numTrees=20, maxDepth=6, **common),
        "decision_tree": DecisionTreeRegressor(maxDepth=6, **common),
        "boosted_trees": GBTRegressor(maxIter=10, maxDepth=4, **common),
    }


def classifiers(target: str, weight: str, seed: int = 42) -> dict:
    return {
        "random_forest": RandomForestClassifier(
            labelCol=target, featuresCol="features", weightCol=weight, seed=seed, numTrees=20, maxDepth=6
        ),
        "logistic": LogisticRegression(
            labelCol=target, featuresCol="features", weightCol=weight, maxIter=20, regParam=0.01
        ),
    }


def pair_vectors(
    pairs: DataFrame, numeric: Sequence[str], train_medians: DataFrame | None = None, held: Column | None = None
) -> DataFrame:
    """Pairs with the vectors of both reading directions in place of the model columns.

    Written once, these serve every fit and every score, which then assemble nothing.  With ``train_medians``
    gaps are filled as by ``impute``.  Rows for which ``held`` is false have no vectors; a gap in others fails the job.

    A row's numbers go through as one array: one expression for each of them makes code too long to be compiled.
    """
    rows = pairs.withColumn("_values", F.array(*[F.col(c).cast("double") for c in numeric]))
    if train_medians is not None:
        rows = attach_row(rows, train_medians.select(F.array(*[f"_m_{c}" for c in numeric]).alias("_medians")))
        filled = F.zip_with("_values", "_medians", lambda value, median: F.coalesce(finite(value), median))
        rows = rows.withColumn("_values", filled).drop("_medians")
    # Null if a number is missing, true if one is NaN.
    gap = F.coalesce(F.array_contains("_values", F.lit(float("nan"))), F.lit(True))
    whole = F.when(gap, F.raise_error(F.lit("a model column has no number"))).otherwise(F.col("_values"))
    rows = rows.withColumn("_values", whole if held is None else F.when(held, whole))
    places, signs = (F.array(*[F.lit(v) for v in values]) for values in reverse_places(numeric))
    back = F.zip_with(places, signs, lambda place, sign: F.get("_values", place) * sign)
    sides = dict(zip(VECTORS, ("_values", F.when(F.col("_values").isNotNull(), back))))
    return rows.withColumns({
        name: F.when(F.col("_values").isNotNull(), array_to_vector(values)) for name, values in sides.items()
    }).drop("_values", *numeric)


def has_vectors(rows: DataFrame) -> bool:
    return set(VECTORS) <= set(rows.columns)


def fit_stages(train: DataFrame, stages: Sequence) -> PipelineModel:
    """Fitted pipeline; rows that already hold the vectors of pairs go straight to the last stage."""
    if has_vectors(train):
        *preparation, estimator = stages
        return PipelineModel(stages=[*preparation, estimator.fit(train)])
    return Pipeline(stages=list(stages)).fit(train)


def fit(train: DataFrame, numeric: Sequence[str], estimator, category: str | None = None) -> PipelineModel:
    return fit_stages(train, [*feature_stages(numeric, category), estimator])


def compare_regressors(
    train: DataFrame, test: DataFrame, numeric: Sequence[str], target: str, weight: str, category: str | None = None
) -> DataFrame:
    """Scored rows of every regressor on both sides, tagged by model and split."""
    frames = []
    for name, estimator in regressors(target, weight).items():
        model = fit(train, numeric, estimator, category)
        for side, rows in (("train", train), ("test", test)):
            frames.append(model.transform(rows).select(
                F.lit(name).alias("model"), F.lit(side).alias("split"), "id",
                F.col(target).alias("y_true"), F.col("prediction").alias("y_pred"),
            ))
    return reduce(lambda a, b: a.unionByName(b), frames)


def label_index(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in LABELS]), label).cast("double") - 1.0


def importance(model: PipelineModel, names: Sequence[str], spark) -> DataFrame:
    """Feature importances, largest first; encoded categories are summed."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(names, values[: len(names)]))
    if len(values) > len(names):
        rows.append(("category", float(sum(values[len(names):]))))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def tune(
    train: DataFrame, numeric: Sequence[str], estimator, grid: Mapping[str, Sequence], fold: str, metric: str,
    category: str | None = None, parallelism: int = 4,
):
    """Grid search over given folds; best mean fold score wins."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    if metric in ("mae", "rmse", "r2"):
        evaluator = RegressionEvaluator(labelCol=estimator.getLabelCol(), metricName=metric)
    else:
        evaluator = MulticlassClassificationEvaluator(labelCol=estimator.getLabelCol(), metricName=metric)
    folds = train.select(F.col(fold)).distinct().count()
    search = CrossValidator(
        estimator=Pipeline(stages=[*feature_stages(numeric, category), estimator]),
        estimatorParamMaps=builder.build(), evaluator=evaluator, numFolds=folds, foldCol=fold,
        parallelism=parallelism, collectSubModels=False,
    )
    return search.fit(train)


def trial_table(fitted, spark) -> DataFrame:
    """One row per grid point with its mean and deviation over the folds."""
    rows = []
    for number, (params, mean, dev) in enumerate(
        zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics, fitted.stdMetrics)
    ):
        text = "; ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda i: i[0].name))
        rows.append((number, text, float(mean), float(dev)))
    return spark.createDataFrame(rows, "trial bigint, params string, value double, std double")


# --- scoring --------------------------------------------------------------------------


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Predicted logarithm and its value in the original unit."""
    return model.transform(df).select(
        *keep, F.col("prediction").alias("pred_log10"), F.pow(F.lit(10.0), F.col("prediction")).alias("pred_value")
    )


def _probabilities(column: str, prefix: str) -> dict[str, Column]:
    """Probability columns per label, normalized to sum 1."""
    values = vector_to_array(F.col(column))
    total = F.aggregate(values, F.lit(0.0), lambda t, x: t + x)
    return {f"{prefix}probability_{label}": F.get(values, i) / total for i, label in enumerate(LABELS)}


def argmax_label(columns: Sequence[Column]) -> Column:
    """Label of the largest probability, the first one on a tie."""
    best = F.greatest(*columns)
    choice = F.when(columns[0] == best, LABELS[0])
    for column, label in zip(columns[1:], LABELS[1:]):
        choice = choice.when(column == best, label)
    return choice


def symmetric(df: DataFrame, forward: str = "forward_probability_", backward: str = "reverse_probability_") -> DataFrame:
    """Average of the forward and the class-reversed backward probabilities.

    Backward columns hold the probabilities of the swapped pair; its increase is
    this pair's decrease.
    """
    opposite = dict(zip(LABELS, reversed(LABELS)))
    rows = df.withColumns({
        f"reverse_aligned_probability_{label}": F.col(f"{backward}{opposite[label]}") for label in LABELS
    })
    rows = rows.withColumns({
        f"probability_{label}": (F.col(f"{forward}{label}") + F.col(f"reverse_aligned_probability_{label}")) / 2.0
        for label in LABELS
    })
    return rows.withColumn("predicted_label", argmax_label([F.col(f"probability_{v}") for v in LABELS]))


def prediction_table(df: DataFrame, keep: Sequence[str], truth: str) -> DataFrame:
    """Predictions with correctness and forward/backward disagreement."""
    gaps = [
        F.abs(F.col(f"forward_probability_{v}") - F.col(f"reverse_aligned_probability_{v}")) for v in LABELS
    ]
    disagreement = reduce(lambda a, b: a + b, gaps) / F.lit(float(len(LABELS)))
    probabilities = [
        f"{prefix}probability_{v}" for prefix in ("", "forward_", "reverse_aligned_") for v in LABELS
    ]
    return df.select(
        *keep, truth, "predicted_label", (F.col(truth) == F.col("predicted_label")).alias("correct"),
        *probabilities, disagreement.alias("forward_reverse_probability_mae"),
    )


def score_pairs(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """Swap-symmetric probabilities and label of pair features.

    The swapped features are extra columns of the same row, so both directions
    are scored in one narrow pass without a join.  Pairs may come with their vectors (``pair_vectors``).
    """
    *preparation, assembler, classifier = model.stages
    if has_vectors(pairs):
        features_back, rows = VECTORS[1], pairs
    else:
        features_back = "_features_back"
        inputs = assembler.getInputCols()
        reversed_columns = [c for c in inputs if c in pairs.columns]
        swapped = reverse_expressions(reversed_columns)
        rows = pairs.withColumns({f"_r_{c}": swapped.get(c, F.col(c)) for c in reversed_columns})
        for stage in preparation:
            rows = stage.transform(rows)
        backward = assembler.copy()
        backward.setInputCols([f"_r_{c}" if c in reversed_columns else c for c in inputs])
        backward.setOutputCol(features_back)
        rows = backward.transform(assembler.transform(rows))
    scored = classifier.transform(rows).withColumns(_probabilities(classifier.getProbabilityCol(), "forward_"))
    second = classifier.copy({
        classifier.featuresCol: features_back, classifier.predictionCol: "_prediction_back",
        classifier.probabilityCol: "_probability_back", classifier.rawPredictionCol: "_raw_back",
    })
    scored = second.transform(scored).withColumns(_probabilities("_probability_back", "reverse_"))
    kept = [f"{d}_probability_{v}" for d in ("forward", "reverse") for v in LABELS]
    return symmetric(scored.select(*pairs.columns, *kept))
