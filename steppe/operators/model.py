"""Boosted trees on lag features, with leakage controls."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steppe.config import Target
from steppe.operators.panel import split_label, with_dimension
from steppe.operators.windows import by_cell, lag_features
from steppe.storage import materialize


def training_table(panel: DataFrame, columns: list[str], target: Target, splits: dict, lags=(0, 1, 2, 3, 6), static: DataFrame | None = None) -> DataFrame:
    """Features, the label ``lead`` months ahead, and the split of the issue date.

    ``static``: cell_id and features that do not change in time, one row a cell;
    they come as ``static_<name>``. Rows of cells without them go, as all with a missing feature do.
    """
    label = F.lead(target.name, target.lead_months).over(by_cell())
    rows = panel.withColumn("actual_raw", label)
    actual = (F.col("actual_raw") < target.threshold).cast("double") if target.kind == "classification" else F.col("actual_raw")
    rows = rows.select("cell_id", "date", "actual_raw", actual.alias("actual"))
    found = lag_features(panel, columns, lags).join(rows, ["cell_id", "date"])
    found = found.withColumn("split", split_label(F.col("date"), splits)).filter("split is not null")
    if static is not None:
        fixed = [F.col(c).alias(f"static_{c}") for c in static.columns if c != "cell_id"]
        found = with_dimension(found, static.select("cell_id", *fixed))
    return found.na.drop()


def feature_names(table: DataFrame) -> list[str]:
    return [c for c in table.columns if "_lag" in c or c.startswith("static_") or c in ("month_sin", "month_cos")]


def available_targets(targets: list[Target], columns: list[str]) -> tuple[list[Target], list[Target]]:
    """Targets whose column is there, and those to skip."""
    return [t for t in targets if t.name in columns], [t for t in targets if t.name not in columns]


def best_round(errors: list[float], patience: int) -> int:
    """Number of trees before the first run of ``patience`` rounds without a smaller error."""
    best = 0
    for k, error in enumerate(errors):
        if error < errors[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def prepared(table: DataFrame) -> DataFrame:
    """The table with its features as one vector, written once: every fit and every score reads that."""
    return materialize(VectorAssembler(inputCols=feature_names(table), outputCol="features").transform(table), "model-rows")


def _vectors(table: DataFrame) -> DataFrame:
    if "features" in table.columns:
        return table
    return VectorAssembler(inputCols=feature_names(table), outputCol="features").transform(table)


def first_trees(model, n: int):
    """The model of the first ``n`` trees of a boosted model: trees do not depend on later ones."""
    if n >= model.getNumTrees:
        return model
    grown = model._java_obj
    kind, size = type(model), [model.numFeatures, *([model.numClasses] if isinstance(model, GBTClassificationModel) else [])]
    gateway = SparkContext._active_spark_context._gateway
    package = gateway.jvm.org.apache.spark.ml
    trees = gateway.new_array(package.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for k, (tree, weight) in enumerate(zip(list(grown.trees())[:n], model.treeWeights[:n], strict=True)):
        trees[k], weights[k] = tree, weight
    place = package.classification if isinstance(model, GBTClassificationModel) else package.regression
    return model._copyValues(kind(getattr(place, kind.__name__)(f"{model.uid}-{n}", trees, weights, *size)))


def fit_trees(table: DataFrame, target: Target, trees: int = 300, depth: int = 5, step: float = 0.05, seed: int = 42, patience: int = 20):
    """A boosted model with as many trees as validation asks for.

    All trees are grown on the training rows; one pass over the validation rows
    gives the error of each number of trees, which says where it has not improved
    for ``patience`` rounds. The trees up to there are the model. Where the session
    names a checkpoint folder, the residuals are cut from their lineage every ten trees.
    """
    kind = GBTClassifier if target.kind == "classification" else GBTRegressor
    rows = _vectors(table)
    train, validation = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "validation")
    model = kind(
        labelCol="actual", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.8,
        featureSubsetStrategy="0.8", seed=seed, checkpointInterval=10,
    ).fit(train)
    if validation.isEmpty():
        return model
    errors = model.evaluateEachIteration(validation) if target.kind == "classification" else model.evaluateEachIteration(validation, "squared")
    return first_trees(model, best_round(errors, patience))


def importances(model, table: DataFrame) -> DataFrame:
    """feature and importance, largest first: one row for each feature."""
    rows = list(zip(feature_names(table), map(float, model.featureImportances.toArray()), strict=True))
    return table.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _forecast(target: Target) -> Column:
    return vector_to_array("probability")[1] if target.kind == "classification" else F.col("prediction").cast("double")


def predict(model, table: DataFrame, target: Target) -> DataFrame:
    """Predictions keyed by issue date, with the date they verify on beside it."""
    rows, value = model.transform(_vectors(table)), _forecast(target)
    return rows.select(
        "cell_id", F.col("date").alias("issue_date"), F.add_months("date", target.lead_months).alias("verification_date"),
        F.lit(target.name).alias("target"), F.lit(target.lead_months).alias("lead_months"), F.lit(target.kind).alias("kind"),
        "actual", "actual_raw", value.alias("prediction"), "split",
    )


def permuted(table: DataFrame, seed: int = 42) -> DataFrame:
    """Labels shuffled within each split and date: skill on them must vanish."""
    own = Window.partitionBy("split", "date")
    rows = table.withColumn("_at", F.row_number().over(own.orderBy("cell_id")))
    labels = table.select("split", "date", "actual", F.row_number().over(own.orderBy(F.md5(F.concat_ws("-", "cell_id", "date", F.lit(seed))), "cell_id")).alias("_at"))
    return rows.drop("actual").join(labels, ["split", "date", "_at"]).drop("_at")


def linear_skill(table: DataFrame, feature: str, groups: list[str] = ()) -> DataFrame:
    """Skill (1 - MSE / variance) on the test rows of a line fitted on the training rows.

    The line and the training mean come from one aggregation of one row (or one
    for each group), so the control runs in the JVM at any size.
    """
    train, test = table.filter("split = 'train'"), table.filter("split = 'test'")
    groups = list(groups)
    line = train.groupBy(*groups).agg(F.regr_slope("actual", feature).alias("slope"), F.regr_intercept("actual", feature).alias("intercept"), F.avg("actual").alias("mean"))
    return _line_scores(test.join(line, groups) if groups else test.join(F.broadcast(line)), feature, groups)


def _line_scores(rows: DataFrame, feature: str, groups: list[str]) -> DataFrame:
    error = F.col("actual") - (F.col("intercept") + F.col("slope") * F.col(feature))
    naive = F.col("actual") - F.col("mean")
    scores = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(error * error).alias("mse"), F.avg(naive * naive).alias("mse_mean"))
    return scores.withColumn("skill", 1 - F.try_divide("mse", "mse_mean"))


def cross_validated_line(table: DataFrame, fold: str, feature: str) -> DataFrame:
    """Each spatial fold scored by the line of all other folds.

    The sums of a fold are subtracted from those of all, so one pass over the
    table gives the lines of all folds.
    """
    x, y = F.col(feature), F.col("actual")
    sums = table.groupBy(fold).agg(*[F.sum(v).alias(k) for k, v in {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "xy": x * y}.items()])
    everything = Window.partitionBy(F.lit(1))  # one row for each fold
    rest = sums.select(fold, *[(F.sum(k).over(everything) - F.col(k)).alias(k) for k in ("n", "x", "y", "xx", "xy")])
    slope = F.try_divide(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), F.col("n") * F.col("xx") - F.col("x") * F.col("x"))
    lines = rest.select(fold, slope.alias("slope"), ((F.col("y") - slope * F.col("x")) / F.col("n")).alias("intercept"), (F.col("y") / F.col("n")).alias("mean"))
    return _line_scores(table.join(lines, fold), feature, [fold])


def spatial_fold(i: Column, j: Column, block: int, folds: int) -> Column:
    """Fold of a cell's block: neighbouring cells are held out together."""
    return F.pmod(F.floor(i / block) * 7919 + F.floor(j / block) * 104729, F.lit(folds)).cast("int")


def trials(tables: dict[str, DataFrame], target: Target, parallel: int = 4, **size) -> DataFrame:
    """trial, n_train, n_trees, n, mse, mse_mean, t and skill of the forecaster, fitted anew on each table.

    A table has the rows to fit on (split train), to stop by (validation) and to
    score (test). Fits run ``parallel`` at a time, each in a thread that waits for its
    Spark jobs, so the short jobs of one fill the executors that another leaves idle.
    ``mse_mean`` is the error of the mean of the rows fitted on, ``t`` the paired
    statistic of what the model gains on it row by row; for probabilities the errors
    are Brier scores. Without test rows the scores are null; a table
    without training rows is an error.
    """
    spark = next(iter(tables.values())).sparkSession

    def one(name: str) -> DataFrame:
        rows = _vectors(tables[name])
        n_train, mean = rows.filter("split = 'train'").agg(F.count("*"), F.avg("actual")).first()
        if not n_train:
            raise ValueError(f"{name}: no rows to fit on")
        model = fit_trees(rows, target, **size)
        scored = model.transform(rows.filter("split = 'test'")).select("actual", _forecast(target).alias("forecast"))
        error, naive = F.col("actual") - F.col("forecast"), F.col("actual") - F.lit(mean)
        gain = naive * naive - error * error
        paired = F.try_divide(F.avg(gain), F.stddev_samp(gain) / F.sqrt(F.count("*"))).alias("t")
        scores = scored.agg(F.count("*").alias("n"), F.avg(error * error).alias("mse"), F.avg(naive * naive).alias("mse_mean"), paired)
        facts = [F.lit(name).alias("trial"), F.lit(n_train).cast("long").alias("n_train"), F.lit(model.getNumTrees).alias("n_trees")]
        return scores.select(*facts, "*", (1 - F.try_divide("mse", "mse_mean")).alias("skill"))

    with ThreadPool(max(1, min(parallel, len(tables)))) as pool:
        found = pool.map(inheritable_thread_target(spark)(one), list(tables))
    return reduce(DataFrame.unionByName, found)


def cross_validated_trees(table: DataFrame, fold: str, folds: int, target: Target, parallel: int = 4, **size) -> DataFrame:
    """The forecaster's skill on the test rows of each of ``folds`` spatial folds (0, 1, ...).

    A fold's model is fitted on the training rows of the other folds and stopped by
    their validation rows, so that neither the blocks nor the months that are scored
    were seen. Rows without a fold are fitted on and never scored.
    """
    rows = prepared(table)
    own = {k: F.coalesce(F.col(fold) == k, F.lit(False)) for k in range(folds)}
    tables = {str(k): rows.filter(F.when(F.col("split") == "test", held).otherwise(~held)) for k, held in own.items()}
    return trials(tables, target, parallel, **size).withColumn("fold", F.col("trial").cast("int")).drop("trial")


def permutation_trees(table: DataFrame, target: Target, seeds: tuple[int, ...] = (42,), parallel: int = 4, **size) -> DataFrame:
    """The forecaster's skill on the labels (trial ``real``), and on labels shuffled within dates by each seed, where it must vanish."""
    rows = prepared(table)
    tables = {"real": rows} | {f"shuffled-{seed}": materialize(permuted(rows, seed), "model-shuffled") for seed in seeds}
    return trials(tables, target, parallel, **size)
