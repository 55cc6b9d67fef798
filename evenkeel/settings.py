"""Settings of a run, from the environment or as given."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Tolerance of matching times (s), window and step of decisions (s), split fractions and seed, folds."""

    match_within_s: float = 3.0
    window_s: float = 3.5
    stride_s: float = 0.5
    fractions: tuple[tuple[str, float], ...] = (("train", 0.6), ("val", 0.2), ("test", 0.2))
    seed: int = 0
    folds: int = 5

    @classmethod
    def from_environment(cls, environment: dict[str, str] | None = None) -> Settings:
        """EVENKEEL_MATCH_WITHIN_S, EVENKEEL_WINDOW_S and so on, of the type that the setting has; fractions as train=0.6,val=0.2."""
        env = os.environ if environment is None else environment
        found = {}
        for name, default in asdict(cls()).items():
            if (text := env.get(f"EVENKEEL_{name.upper()}")) is None:
                continue
            if name == "fractions":
                found[name] = tuple((k.strip(), float(v)) for k, v in (part.split("=") for part in text.split(",")))
            else:
                found[name] = type(default)(text)
        return cls(**found)

    def record(self, spark: SparkSession) -> dict:
        """The settings and what Spark they ran on, for a report."""
        return asdict(self) | {"spark": spark.version, "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions"))}
