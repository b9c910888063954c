"""Training table, grouped folds, boosted trees with sigmoid calibration, scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelweave.functions.columns import clean
from voxelweave.functions.storage import checked_broadcast, cut
from voxelweave.operators import linking, stats
from voxelweave.operators.windows import running
from voxelweave.sources.tables import label_of, table

FEATURES = ["quantity", "price", "lines", "spread", "discount"]


#: Windows (years of order) of the plain training pool, and the one that widens it.
PLAIN, WIDER = [1996, 1997, 1998], [1996, 1997, 1998, 1999]


def training_table(spark: SparkSession, d: str, windows: list[int] | None = None) -> DataFrame:
    """(candidate_id, volume, window, component, y, weight, features): line items summed by order, labelled
    by order status, weighted by 1 / size of their component (orders of a customer). With `windows`, only orders
    of those years, and components count what is left."""
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("candidate_id")).agg(
        F.sum("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"), F.count("*").cast("double").alias("lines"),
        F.coalesce(F.stddev_samp("l_quantity"), F.lit(0.0)).alias("spread"), F.avg("l_discount").alias("discount"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("y"),
    )
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.col("o_orderpriority").alias("volume"), F.col("o_custkey").alias("component"), F.year("o_orderdate").alias("window"), label_of().alias("label"))
    if windows is not None:
        o = o.where(F.col("window").isin(windows))
    return linking.sample_weights(o.join(per, "candidate_id").where("label in (0, 1)"), "component")


def cleaned(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows whose columns hold 0 where a value is missing, NaN or infinite."""
    return rows.withColumns({c: clean(F.col(c)) for c in columns})


def folds(rows: DataFrame, group: str, k: int) -> DataFrame:
    """rows with fold: groups go whole, those with most positives first, forth and back over the folds, so that
    folds are alike in positives and in size. Groups are ranked by running sums, never in one task."""
    size = rows.groupBy(group).agg(F.sum("y").alias("_pos"), F.count("*").alias("_n"), F.lit(1).alias("_one")).withColumn("_rank", -F.col("_pos") * (1 << 32) - F.col("_n"))
    rank = running(size, [], ["_rank", group], ["_one"]).withColumn("_at", F.col("_one_before") % (2 * k))
    fold = F.when(F.col("_at") < k, F.col("_at")).otherwise(2 * k - 1 - F.col("_at")).cast("int")
    return rows.join(checked_broadcast(cut(rank.select(group, fold.alias("fold")), "folds")), group)


def calibrated_trees(train: DataFrame, seed: int = 0):
    """Boosted trees and a logistic curve over their margin."""
    trees = Pipeline(stages=[Imputer(inputCols=FEATURES, outputCols=[f"i_{c}" for c in FEATURES], strategy="median"), VectorAssembler(inputCols=[f"i_{c}" for c in FEATURES], outputCol="x"), GBTClassifier(featuresCol="x", labelCol="y", weightCol="weight", maxIter=10, maxDepth=3, seed=seed, predictionCol="tree_y")]).fit(train)
    margin = VectorAssembler(inputCols=["margin"], outputCol="m")
    raw = lambda df: margin.transform(trees.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1]))
    sigmoid = LogisticRegression(featuresCol="m", labelCol="y", weightCol="weight", rawPredictionCol="line", probabilityCol="prob", predictionCol="yes").fit(raw(train))
    return lambda df: sigmoid.transform(raw(df)).withColumn("p", F.round(vector_to_array("prob")[1], 6))


def out_of_fold(rows: DataFrame, k: int) -> DataFrame:
    """Scores of every row by a model that saw none of its group."""
    out = None
    for i in range(k):
        part = calibrated_trees(rows.where(F.col("fold") != i))(rows.where(F.col("fold") == i)).select("candidate_id", "component", "y", "weight", "p", "fold")
        out = part if out is None else out.unionByName(part)
    return out


def train_gbt(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold Brier score and average precision of each of five folds, grouped by volume and stratified."""
    rows = cut(folds(training_table(spark, d), "volume", 5), "training")
    oof = cut(out_of_fold(rows, 5), "scored")
    return stats.brier(oof, "p", "y", "weight", ["fold"]).join(stats.average_precision(oof, "p", "y", "weight", ["fold"]), "fold")


def penalised_logistic(train: DataFrame):
    """Logistic regression on standardised features, the squared weights penalised as much as one row."""
    n = train.count()
    steps = [VectorAssembler(inputCols=FEATURES, outputCol="v"), StandardScaler(inputCol="v", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / max(n, 1), standardization=False, maxIter=2000)]
    m = Pipeline(stages=steps).fit(train)
    return lambda df: m.transform(df).withColumn("p", vector_to_array("probability")[1])


def held_out_auc(rows: DataFrame, group: str, fit: Callable, most: int = 100) -> DataFrame:
    """(held, n, positives, auc) for each group (null is one) with both classes, by the model that `fit` makes from all
    other rows, groups of one class included. A model is fitted for each group, so more than `most` are an
    error; folds() puts many groups into few. Group names and counts reach the driver, no rows."""
    rows = cut(cleaned(rows, FEATURES).select(F.col(group).alias("held"), "y", *FEATURES), "training")
    size = rows.groupBy("held").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
    both = size.where("positives > 0 and positives < n")
    names = [r[0] for r in both.select("held").take(most + 1)]
    if len(names) > most:
        raise ValueError(f"more than {most} groups: use folds of groups")
    scored = both.select("held").limit(0).select("held", F.lit(0).alias("y"), F.lit(0.0).alias("p"))
    for name in names:
        out = F.col("held").eqNullSafe(F.lit(name))
        scored = scored.unionByName(fit(rows.where(~out))(rows.where(out)).select("held", "y", "p"))
    a = stats.auc(scored, "p", "y", ["held"]).withColumnRenamed("held", "_held")
    return both.join(F.broadcast(a), F.col("held").eqNullSafe(F.col("_held"))).select("held", "n", "positives", "auc")  # a row a group


def leave_one_out_auc(spark: SparkSession, d: str) -> DataFrame:
    """AUC of each volume by a logistic model and by trees that saw all others."""
    rows = cut(training_table(spark, d), "pool")
    by = {"logistic": penalised_logistic, "trees": lambda train: calibrated_trees(train.withColumn("weight", F.lit(1.0)))}
    line, trees = (held_out_auc(rows, "volume", fit).withColumn("model", F.lit(name)) for name, fit in by.items())
    return line.unionByName(trees)


def _pool(spark: SparkSession, d: str, windows: list[int]) -> DataFrame:
    """Out-of-fold scores of a pool, with windows."""
    rows = cut(folds(training_table(spark, d, windows), "volume", 5), "training")
    return cut(out_of_fold(rows, 5).join(rows.select("candidate_id", "window"), "candidate_id"), "scored")


def widened_window(spark: SparkSession, d: str) -> DataFrame:
    """(pool, n, particles, positives, ap, brier): the plain training pool beside one with a further window, both scored out
    of fold with the same grouping."""
    out = None
    for name, windows in (("plain", PLAIN), ("wider", WIDER)):
        s = _pool(spark, d, windows).withColumn("pool", F.lit(name))
        n = s.groupBy("pool").agg(F.count("*").alias("n"), F.count_distinct("component").alias("particles"), F.sum("y").alias("positives"))
        one = n.join(stats.average_precision(s, "p", "y", "weight", ["pool"]), "pool").join(stats.brier(s, "p", "y", "weight", ["pool"]), "pool")
        out = one if out is None else out.unionByName(one)
    return out


def window_auc(spark: SparkSession, d: str) -> DataFrame:
    """(window, n, auc): out-of-fold AUC of each window; null where it has one class only."""
    s = _pool(spark, d, WIDER)
    return s.groupBy("window").agg(F.count("*").alias("n")).join(stats.auc(s, "p", "y", ["window"]), "window")


def permuted(rows: DataFrame, key: str, column: str, seed: int, size: int = 10_000) -> DataFrame:
    """rows with `column` shuffled among the rows of each hash bucket of about `size` rows, so no task ranks all rows."""
    buckets = rows.count() // size + 1
    b = F.pmod(F.xxhash64(key), F.lit(buckets))
    here = Window.partitionBy("_b").orderBy(key)
    there = Window.partitionBy("_b").orderBy(F.xxhash64(key, F.lit(seed)), key)
    base = rows.withColumn("_b", b)
    mixed = base.select("_b", F.row_number().over(there).alias("_r"), F.col(column).alias("_v"))
    return base.withColumn("_r", F.row_number().over(here)).join(mixed, ["_b", "_r"]).drop(column, "_b", "_r").withColumnRenamed("_v", column)


def permutation_importance(spark: SparkSession, d: str, repeats: int = 3, k: int = 5) -> DataFrame:
    """(feature, drop, sd): mean loss of average precision when a feature is shuffled, over repeats and held-out
    folds. All shuffled versions of a fold are scored together."""
    rows = cut(folds(training_table(spark, d), "volume", k), "training")
    scored = None
    for i in range(k):
        held = rows.where(F.col("fold") == i)
        tried = None
        for f in [None, *FEATURES]:
            for r in range(repeats if f else 1):
                one = (permuted(held, "candidate_id", f, r) if f else held).select("candidate_id", *FEATURES, "y", "weight", F.lit(f or "none").alias("feature"), F.lit(r).alias("round"))
                tried = one if tried is None else tried.unionByName(one)
        part = calibrated_trees(rows.where(F.col("fold") != i))(tried).select("feature", "round", F.lit(i).alias("fold"), "p", "y", "weight")
        scored = part if scored is None else scored.unionByName(part)
    ap = cut(stats.average_precision(scored, "p", "y", "weight", ["feature", "round", "fold"]), "precision")
    full = ap.where("feature = 'none'").select("fold", F.col("ap").alias("full"))
    lost = ap.where("feature <> 'none'").join(F.broadcast(full), "fold").withColumn("lost", F.col("full") - F.col("ap"))  # a row a fold
    return lost.groupBy("feature").agg(F.avg("lost").alias("drop"), F.stddev_samp("lost").alias("sd"))


def network_scores(spark: SparkSession, d: str) -> DataFrame:
    """(fold, brier, ap) of a small neural network beside the trees, on the same folds."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    rows = cut(folds(training_table(spark, d), "volume", 5), "training")
    out = None
    for i in range(5):
        steps = [Imputer(inputCols=FEATURES, outputCols=[f"i_{c}" for c in FEATURES], strategy="median"), VectorAssembler(inputCols=[f"i_{c}" for c in FEATURES], outputCol="v"), StandardScaler(inputCol="v", outputCol="x", withMean=True), MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[len(FEATURES), 16, 2], maxIter=40, seed=0)]
        model = Pipeline(stages=steps).fit(rows.where(F.col("fold") != i))
        part = model.transform(rows.where(F.col("fold") == i)).select("fold", "y", "weight", F.round(vector_to_array("probability")[1], 6).alias("p"))
        out = part if out is None else out.unionByName(part)
    out = cut(out, "scored")
    return stats.brier(out, "p", "y", "weight", ["fold"]).join(stats.average_precision(out, "p", "y", "weight", ["fold"]), "fold")


def logistic_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """(feature, coefficient, odds): median-imputed, standardised logistic regression."""
    rows = training_table(spark, d)
    steps = [Imputer(inputCols=FEATURES, outputCols=[f"i_{c}" for c in FEATURES], strategy="median"), VectorAssembler(inputCols=[f"i_{c}" for c in FEATURES], outputCol="v"), StandardScaler(inputCol="v", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight")]
    c = Pipeline(stages=steps).fit(rows).stages[-1].coefficients
    return spark.createDataFrame([(f, float(v)) for f, v in zip(FEATURES, c)], "feature string, coefficient double").withColumn("odds", F.exp("coefficient"))


def queries() -> dict[str, Callable]:
    return {f.__name__: f for f in (train_gbt, permutation_importance, network_scores, logistic_coefficients, leave_one_out_auc, widened_window, window_auc)}
