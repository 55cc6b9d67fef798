"""Group-disjoint splits, preprocessing and metrics."""

from __future__ import annotations

import json
from collections.abc import Iterable
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def greedy_split(sizes: Iterable[tuple[object, int]], fractions: dict[str, float], seed: int | None = None) -> dict[object, str]:
    """Largest group first, each to the part that is least filled against its target; ties by the parts' order, then by group.

    With a seed, groups of one size come in an order that it decides.
    """
    tie = (lambda g: str(g)) if seed is None else lambda g: md5(f"{seed}:{g}".encode()).hexdigest()
    sizes = sorted(sizes, key=lambda x: (-x[1], tie(x[0])))
    total = sum(n for _, n in sizes)
    filled = dict.fromkeys(fractions, 0)
    out = {}
    for group, n in sizes:
        part = min(fractions, key=lambda p: filled[p] / (fractions[p] * total))
        out[group] = part
        filled[part] += n
    return out


def assign_groups(df: DataFrame, group: str, fractions: dict[str, float], seed: int | None = None) -> DataFrame:
    """(group, split, n_rows). The greedy order is sequential, so the group sizes, one number a group, go to the driver."""
    sizes = {r[0]: r[1] for r in df.where(F.col(group).isNotNull()).groupBy(group).count().collect()}
    split = greedy_split(sizes.items(), fractions, seed)
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame([(g, split[g], n) for g, n in sizes.items()], f"{group} {kind}, split string, n_rows long")


def group_folds(df: DataFrame, group: str, n: int) -> DataFrame:
    """(group, fold): largest group to the lightest fold."""
    part = assign_groups(df, group, {str(k): 1.0 for k in range(n)})
    return part.select(group, F.col("split").cast("int").alias("fold"))


def split_violations(assignment: DataFrame, group: str) -> DataFrame:
    """Groups in more than one split."""
    return assignment.groupBy(group).agg(F.countDistinct("split").alias("n_splits")).where("n_splits <> 1")


def collapse_rare(df: DataFrame, label: str, least: int = 10, other: str = "other") -> DataFrame:
    """df with labels that fewer than `least` rows have under one name; counts are joined, so no row of a frequent label moves for them."""
    rare = df.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") < least).select(label, F.lit(True).alias("_rare"))
    return df.join(rare, label, "left").withColumn(label, F.when(F.col("_rare"), F.lit(other)).otherwise(F.col(label))).select(*df.columns)


def frequencies(train: DataFrame, column: str) -> DataFrame:
    """(column, freq) of the training rows; a level that isn't there counts 0 when joined."""
    n = train.groupBy(column).agg(F.count("*").alias("_n"))
    return n.select(column, (F.col("_n") / F.sum("_n").over(Window.partitionBy())).alias("freq"))


def one_hot(column: str, levels: list[str]) -> list[Column]:
    from evenkeel.functions.scalars import category

    return [(category(F.col(column)) == v).cast("double").alias(f"{column}={v}") for v in levels]


def encode(train: DataFrame, test: DataFrame, numeric: list[str], categorical: list[str], most_levels: int = 30, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Numeric columns with the training median for what is missing (0 without one); categories one-hot up to
    `most_levels`, else by training frequency. Levels are those of both tables, or of the training rows when strict."""
    from evenkeel.functions.scalars import category, finite

    medians = {}
    if numeric:
        from .relational import exact_quantiles

        numbers = train.select(*[finite(F.col(c).cast("double")).alias(c) for c in numeric])
        medians = {r.column: r.value for r in exact_quantiles(numbers, numeric, [0.5]).collect()}
    out = []
    levels, counts = {}, {}
    for c in categorical:
        rows = train.select(category(F.col(c)).alias("v")) if strict else train.select(category(F.col(c)).alias("v")).union(test.select(category(F.col(c)).alias("v")))
        levels[c] = sorted(r.v for r in rows.distinct().limit(most_levels + 1).collect())
    for df in (train, test):
        cols = [F.coalesce(finite(F.col(c).cast("double")), F.lit(medians.get(c) or 0.0)).alias(c) for c in numeric]
        for c in categorical:
            if len(levels[c]) <= most_levels:
                cols += one_hot(c, levels[c])
            else:
                counts.setdefault(c, frequencies(train.select(category(F.col(c)).alias(c)), c).withColumnRenamed("freq", f"{c}_freq"))
                df = df.withColumn(c, category(F.col(c))).join(counts[c], c, "left")
                cols.append(F.coalesce(f"{c}_freq", F.lit(0.0)).alias(f"{c}_freq"))
        out.append(df.select("*", *[x.alias(f"x{k}") for k, x in enumerate(cols)]))
    return out[0], out[1]


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(truth, pred).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(class, precision, recall, f1, support) over the classes of truth and prediction; 0 where nothing divides."""
    cells = confusion(df, truth, pred)
    rows = cells.select(F.explode(F.array(F.struct(F.col(truth).alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col(pred).alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("r"), F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0).alias("hit"))
    sums = rows.groupBy("r.class").agg(F.sum("r.t").alias("support"), F.sum("r.p").alias("predicted"), (F.sum(F.when(F.col("r.t") > 0, F.col("hit")).otherwise(0))).alias("hits"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    h, s, p = F.col("hits"), F.col("support"), F.col("predicted")
    return sums.select("class", share(h, p).alias("precision"), share(h, s).alias("recall"), share(2 * h, s + p).alias("f1"), "support")


def class_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row (balanced_acc, macro_f1, acc, n_test): recall averaged over true classes, F1 over all."""
    c = per_class(df, truth, pred)
    hits = F.sum(F.col("recall") * F.col("support"))
    return c.agg(F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_acc"), F.avg("f1").alias("macro_f1"), (hits / F.sum("support")).alias("acc"), F.sum("support").alias("n_test"))


def regression_metrics(truth: Column, pred: Column) -> list[Column]:
    """mae and r2 (null with two rows or fewer or a constant truth)."""
    n, error = F.count(truth), F.sum((truth - pred) * (truth - pred))
    total = F.sum(truth * truth) - F.sum(truth) * F.sum(truth) / n
    return [F.avg(F.abs(truth - pred)).alias("mae"), F.when((n > 2) & (total > 0), 1 - F.try_divide(error, total)).alias("r2")]


#: Makers of models by name; others can be added.
MODELS: dict[str, object] = {}


def register(name: str):
    def put(make):
        MODELS[name] = make
        return make

    return put


#: Names that stand for one model in classifications and for another in regressions.
BY_TASK = {"auto": ("boosted_classes", "boosted"), "logistic": ("classes", "ridge")}


def maker(name: str, task: str | None = None):
    """The maker of a model by name; `auto` and `logistic` go by the task, where it is told."""
    if task and name in BY_TASK:
        name = BY_TASK[name][task != "classification"]
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}: {sorted({*MODELS, *BY_TASK})}")
    return MODELS[name]


class _Line:
    """Least squares on one feature, in closed form: one aggregate of the training rows."""

    def __init__(self, feature: str, label: str):
        self.feature, self.label = feature, label

    def fit(self, df: DataFrame) -> "_Line":
        x, y = F.col(f"`{self.feature}`").cast("double"), F.col(f"`{self.label}`").cast("double")
        fitted = _Line(self.feature, self.label)
        fitted.slope, fitted.start = df.agg(F.regr_slope(y, x), F.regr_intercept(y, x)).first()
        if fitted.slope is None:
            fitted.slope, fitted.start = 0.0, df.agg(F.avg(y)).first()[0] or 0.0
        return fitted

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.col(f"`{self.feature}`").cast("double") * self.slope + self.start)

    def save(self, path: str) -> None:
        state = json.dumps({"feature": self.feature, "slope": self.slope, "start": self.start})
        SparkSession.active().createDataFrame([(state,)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "_Line":
        state = json.loads(spark.read.text(path).first()[0])
        out = cls(state["feature"], "")
        out.slope, out.start = state["slope"], state["start"]
        return out


@register("line")
def _line(features: list[str], label: str):
    return _Line(features[0], label)


@register("classes")
def _classes(features: list[str], label: str):
    """A logistic model with any number of classes, each with the same weight altogether."""
    from pyspark.ml import Estimator, Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages: list[Estimator] = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    model = Pipeline(stages=[*stages, LogisticRegression(labelCol=label, weightCol="_weight", maxIter=50, regParam=0.01)])

    class Balanced:
        def fit(self, df: DataFrame):
            counts = df.groupBy(label).agg(F.count("*").alias("_n"))
            weights = counts.select(label, (F.lit(1.0) / F.col("_n")).alias("_weight"))
            return model.fit(df.join(F.broadcast(weights), label))

    return Balanced()


@register("logistic")
def _logistic(features: list[str], label: str):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, maxIter=50, regParam=0.01)])


@register("ridge")
def _ridge(features: list[str], label: str):
    """A linear model whose penalty is the one of the least leave-one-out error."""
    from .ridge import Ridge

    return Ridge(features, label)


@register("boosted_classes")
def _boosted_classes(features: list[str], label: str):
    from .boosting import Boosted

    return Boosted(features, label)


@register("forest")
def _forest(features: list[str], label: str):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), RandomForestClassifier(labelCol=label, numTrees=20, seed=1)])


@register("boosted")
def _boosted(features: list[str], label: str):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), GBTRegressor(labelCol=label, maxIter=10, seed=1)])
