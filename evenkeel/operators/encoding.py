"""What a model sees of raw rows, learned from training rows and kept with the model."""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.scalars import category, finite


class RowEncoder(Estimator):
    """Learns medians of numeric columns, and the levels of categories or, beyond `most_levels`, their frequencies."""

    def __init__(self, numeric: list[str], categorical: list[str] = (), most_levels: int = 30):
        super().__init__()
        self.numeric, self.categorical, self.most_levels = list(numeric), list(categorical), most_levels

    def _fit(self, df: DataFrame) -> RowEncoderModel:
        from .relational import exact_quantiles

        medians = {}
        if self.numeric:
            names = {f"n{k}": c for k, c in enumerate(self.numeric)}
            numbers = df.select(*[finite(F.col(f"`{c}`").cast("double")).alias(n) for n, c in names.items()])
            medians = {names[r.column]: r.value for r in exact_quantiles(numbers, list(names), [0.5]).collect()}
        levels, many = {}, []
        for c in self.categorical:
            found = sorted(r.v for r in df.select(category(F.col(f"`{c}`")).alias("v")).distinct().limit(self.most_levels + 1).collect())
            if len(found) > self.most_levels:
                many.append(c)
            else:
                levels[c] = found
        shares = None
        for c in many:
            counted = df.groupBy(category(F.col(f"`{c}`")).alias("level")).agg(F.count("*").alias("n"))
            total = df.count()
            part = counted.select(F.lit(c).alias("column"), "level", (F.col("n") / F.lit(float(total))).alias("share"))
            shares = part if shares is None else shares.unionByName(part)
        taken, prefix = {c.lower() for c in df.columns}, "x"
        while any(t.startswith(prefix) and t[len(prefix) :].isdigit() for t in taken):
            prefix += "_"
        return RowEncoderModel(self.numeric, {c: medians.get(c) or 0.0 for c in self.numeric}, self.categorical, levels, prefix, shares)


class RowEncoderModel(Model, MLWritable, MLReadable):
    """Adds a double column for each numeric column, level and many-levelled category.

    A number that is missing, not finite or in no column of the rows is the training median; a level that training
    didn't have is none of the levels, or has a share of 0. Categories with many levels are joined with
    their shares, which stay a table however many there are. Rows that already have a column of an
    encoded one's name are an error, as are rows with none of the training's columns.
    """

    def __init__(self, numeric: list[str], medians: dict[str, float], categorical: list[str], levels: dict[str, list[str]], prefix: str, shares: DataFrame | None):
        super().__init__()
        self.numeric, self.medians, self.categorical, self.levels, self.prefix, self.shares = list(numeric), dict(medians), list(categorical), dict(levels), prefix, shares

    @property
    def columns(self) -> list[str]:
        """Names of the encoded columns."""
        n = len(self.numeric) + sum(len(self.levels[c]) if c in self.levels else 1 for c in self.categorical)
        return [f"{self.prefix}{k}" for k in range(n)]

    def _transform(self, df: DataFrame) -> DataFrame:
        here = {c.lower() for c in df.columns}
        if here & set(self.columns):
            raise ValueError(f"rows have a column of an encoded one's name: {sorted(here & set(self.columns))}")
        wanted = [*self.numeric, *self.categorical]
        if wanted and not any(c.lower() in here for c in wanted):
            raise ValueError(f"rows have none of the columns {wanted}")
        number = lambda c: finite(F.col(f"`{c}`").cast("double")) if c.lower() in here else F.lit(None).cast("double")
        text = lambda c: category(F.col(f"`{c}`") if c.lower() in here else F.lit(None))
        original, cols = [F.col(f"`{c}`") for c in df.columns], [F.coalesce(number(c), F.lit(float(self.medians[c]))) for c in self.numeric]
        joined = []
        for c in self.categorical:
            if c in self.levels:
                cols += [(text(c) == v).cast("double") for v in self.levels[c]]
            else:
                share = f"{self.prefix}share{len(joined)}"
                part = self.shares.where(F.col("column") == c).select(F.col("level").alias(f"{share}l"), F.col("share").alias(share))
                joined.append((text(c), part, share))
                cols.append(F.coalesce(F.col(share), F.lit(0.0)))
        for key, part, share in joined:
            df = df.join(part, key == F.col(f"{share}l"), "left")
        return df.select(*original, *[x.alias(n) for n, x in zip(self.columns, cols)])

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: RowEncoderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, self.sparkSession
        DefaultParamsWriter.saveMetadata(m, path, spark)
        state = {"numeric": m.numeric, "medians": m.medians, "categorical": m.categorical, "levels": m.levels, "prefix": m.prefix}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.text(f"{path}/state")
        if m.shares is not None:
            m.shares.write.parquet(f"{path}/shares")


class _Reader(MLReader):
    def load(self, path: str) -> RowEncoderModel:
        spark = self.sparkSession
        DefaultParamsReader.loadMetadata(path, spark, f"{RowEncoderModel.__module__}.{RowEncoderModel.__name__}")
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        many = [c for c in state["categorical"] if c not in state["levels"]]
        return RowEncoderModel(**state, shares=spark.read.parquet(f"{path}/shares") if many else None)
