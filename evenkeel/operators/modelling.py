"""The evaluation loop as one call: what is learned from, folds, feature arms, scores that survive a failing fold, kept models."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.scalars import category, finite

from . import evaluation as V
from .boosting import BoostedModel
from .encoding import RowEncoder, RowEncoderModel
from .ridge import RidgeModel


@dataclass(frozen=True)
class Features:
    """Columns that a model sees, and the one that tells groups apart."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    group: str | None = None

    def of(self, df: DataFrame) -> Features:
        """Those that a table has."""
        here = set(df.columns)
        return replace(self, numeric=tuple(c for c in self.numeric if c in here), categorical=tuple(c for c in self.categorical if c in here))


def prepare(df: DataFrame, features: Features, target: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a target: the features that there are, categories as text, the group, and the target as `label`."""
    f = features.of(df)
    others = dict.fromkeys([*keep, *([f.group] if f.group else [])])
    return df.where(F.col(f"`{target}`").isNotNull()).select(*[F.col(f"`{c}`") for c in (*others, *f.numeric)], *[category(F.col(f"`{c}`")).alias(c) for c in f.categorical], F.col(f"`{target}`").alias("label"))


def arm(features: Features, name: str, prefix: str, base: tuple[str, ...] = (), drop: frozenset[str] = frozenset(), groups: dict[str, tuple[str, ...]] | None = None) -> Features | None:
    """The features of one arm of an ablation: `base` (all without the prefix), `block` (those with it), `both`, or the base
    and a named group of the block, with the block's `base` columns. None if the block is empty."""
    rest = tuple(c for c in features.numeric if not c.startswith(prefix) and c not in drop)
    block = tuple(c for c in features.numeric if c.startswith(prefix) and c not in drop)
    if name == "base":
        return replace(features, numeric=rest)
    if name == "both":
        return replace(features, numeric=rest + block)
    if name == "block":
        return replace(features, numeric=block, categorical=()) if block else None
    if groups and name in groups:
        chosen = tuple(dict.fromkeys(c for c in (*base, *groups[name]) if c not in drop))
        return replace(features, numeric=rest + chosen) if chosen else None
    raise ValueError(f"unknown arm {name!r}: base, block, both or one of {sorted(groups or ())}")


def leave_one_out(df: DataFrame, group: str) -> DataFrame:
    """(group, fold): a fold for each group, in the groups' order."""
    groups = [r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().collect()]
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame([(g, k) for k, g in enumerate(sorted(groups))], f"{group} {kind}, fold int")


@dataclass
class Evaluation:
    """Metrics fold by fold, their means, and the folds that failed, with what was wrong."""

    folds: list[dict] = field(default_factory=list)
    failed: list[tuple[int, str]] = field(default_factory=list)

    @property
    def mean(self) -> dict[str, float]:
        names = [c for c in self.folds[0] if c != "fold"] if self.folds else []
        some = {c: [f[c] for f in self.folds if f[c] is not None] for c in names}
        return {c: sum(x) / len(x) for c, x in some.items() if x}

    def rows(self, spark: SparkSession) -> DataFrame:
        """(fold, metric, value)."""
        return spark.createDataFrame([(f["fold"], c, float(v)) for f in self.folds for c, v in f.items() if c != "fold" and v is not None], "fold int, metric string, value double")


def evaluate(df: DataFrame, folds: DataFrame, features: Features, model: str, task: str, least: int = 20) -> Evaluation:
    """Trains and scores `model` on each fold (group, fold) of rows as prepare() gives them.

    Categories and missing numbers are encoded by each fold's training rows. A fold without test
    rows, with fewer than `least` training rows or (in a classification) one class is left out; one
    that raises is kept among the failed ones and the others go on.
    """
    found = Evaluation()
    data = df.join(folds, features.group).persist()
    try:
        sizes = {r.fold: r["count"] for r in data.groupBy("fold").count().collect()}
        total = sum(sizes.values())
        for k in sorted(sizes):
            if total - sizes[k] < least:
                continue
            try:
                train, test = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
                if task == "classification" and train.select("label").distinct().limit(2).count() < 2:
                    continue
                scored, _ = fit_and_predict(train, test, features, model, task, hold=False)
                if task == "classification":
                    metrics = V.class_metrics(scored, "label", "prediction").first().asDict()
                else:
                    metrics = scored.agg(*V.regression_metrics(F.col("label").cast("double"), F.col("prediction")), F.count("*").alias("n_test")).first().asDict()
                found.folds.append({"fold": k} | metrics)
            except Exception as e:  # noqa: BLE001 - one fold must not end the others
                found.failed.append((k, f"{type(e).__name__}: {str(e)[:160]}"))
    finally:
        data.unpersist()
    return found


@dataclass
class Fitted:
    """A model with the encoder that its raw rows go through, and the text labels that its numbers stand for."""

    encoder: RowEncoderModel
    model: object
    labels: list[str] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """df with a prediction, for raw rows with the columns of training in any order; further columns stay."""
        rest = [c for c in df.columns if c.lower() != "prediction"]
        scored = self.model.transform(self.encoder.transform(df.select(*[F.col(f"`{c}`") for c in rest])))
        out = F.col("prediction")
        if self.labels:
            out = F.get(F.array(*map(F.lit, self.labels)), out.cast("int"))
        return scored.select(*[F.col(f"`{c}`") for c in rest], out.alias("prediction"))


def fit(train: DataFrame, features: Features, model: str, task: str | None = None, hold: bool = True) -> Fitted:
    """Encoder and model, learned from rows as prepare() gives them. Text labels are numbered in their order.

    Learning goes over the rows many times; they are held meanwhile, unless they are cheap to get again.
    """
    train = train.persist() if hold else train
    try:
        encoder = RowEncoder(list(features.numeric), list(features.categorical)).fit(train)
        rows, label, labels = encoder.transform(train), "label", None
        if train.schema["label"].dataType.simpleString() == "string":
            task = task or "classification"
            labels = sorted(r.label for r in train.select("label").where("label is not null").distinct().collect())
            number = F.create_map(*[F.lit(x) for pair in ((n, float(k)) for k, n in enumerate(labels)) for x in pair])
            label = f"{encoder.prefix}label"
            rows = rows.withColumn(label, number[F.col("label")])
        return Fitted(encoder, V.maker(model, task)(encoder.columns, label).fit(rows), labels)
    finally:
        if hold:
            train.unpersist()


def fit_and_predict(train: DataFrame, test: DataFrame, features: Features, model: str, task: str | None = None, hold: bool = True) -> tuple[DataFrame, Fitted]:
    """test with a prediction, and what was fitted; a label that is only in the test rows is never predicted."""
    fitted = fit(train, features, model, task, hold)
    return fitted.transform(test), fitted


def evaluate_ridge(df: DataFrame, features: list[str], label: str, fold: str) -> DataFrame:
    """(fold, alpha, mae, r2, n_test) of a ridge regression for each fold, all folds in the same few passes."""
    from . import ridge

    models = ridge.fit_folds(df, features, label, fold)
    scored = ridge.predict_folds(df.where(F.abs(F.col(f"`{label}`").cast("double")) < float("inf")), models, fold)
    alpha = F.create_map(*[x for k, m in models.items() for x in (F.lit(k), F.lit(m.alpha))]) if models else F.create_map().cast("map<bigint,double>")
    y = F.col(f"`{label}`").cast("double")
    out = scored.groupBy(F.col(f"`{fold}`").cast("long").alias("fold")).agg(*V.regression_metrics(y, F.col("prediction")), F.count("*").alias("n_test"))
    return out.select("fold", alpha[F.col("fold")].alias("alpha"), "mae", "r2", "n_test")


def compare(df: DataFrame, folds: DataFrame, arms: dict[str, Features | None], model: str, task: str) -> DataFrame:
    """(fold, arm, metric, base, other, delta) of every arm against the arm `base`, fold by fold; an arm of None is left out."""
    out = None
    for name, features in arms.items():
        if features is None:
            continue
        part = evaluate(df, folds, features, model, task).rows(df.sparkSession).withColumn("arm", F.lit(name))
        out = part if out is None else out.unionByName(part)
    wide = out.groupBy("fold", "metric").pivot("arm", [a for a, f in arms.items() if f is not None]).agg(F.first("value"))
    others = [a for a, f in arms.items() if f is not None and a != "base"]
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("other")) for a in others])).alias("p")
    rows = wide.select("fold", "metric", F.col("base"), pairs)
    return rows.select("fold", "p.arm", "metric", "base", "p.other", (F.col("p.other") - F.col("base")).alias("delta")).where("delta is not null")


#: Models that write themselves, by the name under which a kept model says what it is.
KINDS = {"line": V._Line, "ridge": RidgeModel, "boosted": BoostedModel}


def keep_model(fitted, columns: list[str] | None = None, path: str = "") -> None:
    """Writes what fit() gave, encoder included; of a bare model the numeric columns that it was trained on are kept.

    The folder is replaced: its note, without which nothing can be loaded, is written last.
    """
    spark = SparkSession.active()
    if not isinstance(fitted, Fitted):
        fitted = Fitted(RowEncoderModel(list(columns), dict.fromkeys(columns, 0.0), [], {}, "", None), fitted)
    kind = next((k for k, c in KINDS.items() if isinstance(fitted.model, c)), "pipeline")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/note")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    fitted.encoder.write().overwrite().save(f"{path}/encoder")
    if kind == "pipeline":
        fitted.model.write().overwrite().save(f"{path}/model")
    else:
        fitted.model.save(f"{path}/model")
    note = json.dumps({"kind": kind, "labels": fitted.labels, "bare": not fitted.encoder.prefix})
    spark.createDataFrame([(note,)], "note string").coalesce(1).write.mode("overwrite").text(f"{path}/note")


def kept_model(spark: SparkSession, path: str) -> tuple[Fitted, bool]:
    """What keep_model() wrote, and whether it was a bare model, whose columns go in as they are."""
    from pyspark.ml import PipelineModel

    note = json.loads(spark.read.text(f"{path}/note").first()[0])
    model = PipelineModel.load(f"{path}/model") if note["kind"] == "pipeline" else KINDS[note["kind"]].load(spark, f"{path}/model")
    return Fitted(RowEncoderModel.load(f"{path}/encoder"), model, note["labels"]), note["bare"]


def predict(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Predictions of a kept model for raw rows, the same as before it was kept.

    Columns of its training that the rows haven't count as missing; rows with none of them are an
    error. For a bare model such columns count as 0 and are added.
    """
    fitted, bare = kept_model(spark, path)
    if not bare:
        return fitted.transform(rows)
    here, columns = {c.lower() for c in rows.columns}, fitted.encoder.numeric
    if not any(c.lower() in here for c in columns):
        raise ValueError(f"rows have none of the columns {columns}")
    missing = {c: F.lit(0.0) for c in columns if c.lower() not in here}
    present = {c: F.coalesce(finite(F.col(f"`{c}`").cast("double")), F.lit(0.0)) for c in columns if c.lower() in here}
    return fitted.model.transform(rows.withColumns(present | missing)).drop("raw", "features")


def predict_one(df: DataFrame, key: dict, features: Features, target: str, models: list[str], task: str) -> dict:
    """What each model, trained on the rows of other groups, says of one row; a model that fails says why."""
    where = lambda d: [F.col(c) == v for c, v in key.items()]
    row = df
    for condition in where(df):
        row = row.where(condition)
    found = row.limit(1).collect()
    if not found:
        raise KeyError(f"no row with {key}")
    rest = df.where(~F.col(features.group).eqNullSafe(F.lit(found[0][features.group])))
    # the row is scored whether it has a target or not
    train, test = prepare(rest, features, target), prepare(row.limit(1).withColumn("_t", F.lit(0)), features, "_t")
    test = test.withColumn("label", F.lit(None).cast(train.schema["label"].dataType))
    n = train.count()
    out: dict = {"key": key, "target": target, "n_train": n, "degenerate": n < 100, "actual": found[0][target], "models": {}}
    for name in models:
        try:
            scored, _ = fit_and_predict(train, test, features, name, task)
            out["models"][name] = {"available": True, "prediction": scored.first()["prediction"]}
        except Exception as e:  # noqa: BLE001 - one model must not end the others
            out["models"][name] = {"available": False, "error": f"{type(e).__name__}: {str(e)[:160]}"}
    return out


def status(assignment: DataFrame) -> dict:
    """Which models there are, and how many groups and rows each split has."""
    rows = assignment.groupBy("split").agg(F.count("*").alias("groups"), F.sum("n_rows").alias("rows")).collect()
    return {"models": sorted(V.MODELS), "splits": {r["split"]: {"groups": r["groups"], "rows": r["rows"]} for r in rows}}


def split_summary(df: DataFrame, assignment: DataFrame, group: str, target: str) -> DataFrame:
    """(split, n_groups, n_rows, row_share, class, n, class_share) of a split's rows, class by class."""
    rows = df.join(assignment.select(group, "split"), group)
    of = rows.groupBy("split").agg(F.countDistinct(group).alias("n_groups"), F.count("*").alias("n_rows"))
    total = of.agg(F.sum("n_rows").alias("_total"))
    classes = rows.where(F.col(target).isNotNull()).groupBy("split", F.col(target).alias("class")).agg(F.count("*").alias("n"))
    out = classes.join(of, "split").join(F.broadcast(total))
    return out.select("split", "n_groups", "n_rows", (F.col("n_rows") / F.col("_total")).alias("row_share"), "class", "n", (F.col("n") / F.col("n_rows")).alias("class_share"))


def model_table(link: DataFrame, labels: DataFrame, keys: list[str], required: str, text: tuple[str, ...] = (), numeric_prefixes: tuple[str, ...] = ("pre_", "post_"), deny: frozenset[str] = frozenset()) -> tuple[DataFrame, dict]:
    """The linked rows with their labels, and a record of its columns.

    Only links with one match count; each must find a row with `required`, else an error. Columns
    with a numeric prefix become numbers unless they are text. Features are numeric pre_ columns; a
    post_ or denied column among them is an error, since targets are learned from what comes before.
    """
    from .relational import join_complete

    rows = link.where("n_match = 1").drop("n_match")
    out = join_complete(rows, labels.where(F.col(required).isNotNull()), keys)
    out = out.withColumns({c: finite(F.col(c).try_cast("double")) for c in out.columns if c.startswith(numeric_prefixes) and c not in text})
    features = [c for c, kind in out.dtypes if c.startswith("pre_") and kind == "double"]
    leaks = [c for c in features if c.startswith("post_") or c in deny]
    if leaks:
        raise ValueError(f"columns that tell the target: {leaks}")
    record = {"features_numeric": features, "targets": [c for c in out.columns if c.startswith("post_")], "keys": keys}
    return out, record
