"""A random forest kept as stored parts of some trees, as all nodes of a large one do not fit the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsreach.sources.workspace import copy, discard, kept_path, materialize, release


@dataclass(frozen=True)
class PartedForest:
    """Paths of stored forests and how many trees each has; the whole predicts the mean of all trees."""

    paths: tuple[str, ...]
    trees: tuple[int, ...]
    column: str
    out: str

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows, stored once, with the prediction; the parts are read and sent to the tasks one after the other."""
        spark, total = df.sparkSession, sum(self.trees)
        rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "forest-rows")
        shares = kept_path(spark, "forest-shares")
        for place, (path, count) in enumerate(zip(self.paths, self.trees)):
            found = RandomForestRegressionModel.load(path).transform(rows.select("__row", self.column))
            share = F.col(self.out) * (count / total)
            found.select("__row", F.lit(place).alias("place"), share.alias("share")).write.mode("append").parquet(shares)
            del found
            release(spark)
        # added in the order of the parts, so that the sums repeat to the last digit
        parts = F.sort_array(F.collect_list(F.struct("place", "share")))
        sums = spark.read.schema("__row long, place int, share double").parquet(shares).groupBy("__row").agg(
            F.aggregate(parts, F.lit(0.0), lambda found, part: found + part["share"]).alias(self.out)
        )
        return rows.join(sums, "__row").drop("__row")

    def write(self) -> PartedForest:
        return self

    def overwrite(self) -> PartedForest:
        return self

    def save(self, path: str) -> None:
        """Store the parts below ``path``, in place of what is there, so that ``models.load_model`` finds them."""
        if any(part.startswith(f"{path}/") for part in self.paths):
            return  # it comes from there
        spark = SparkSession.active()
        discard(spark, path)
        for place, part in enumerate(self.paths):
            copy(spark, part, f"{path}/part-{place}")
        about = {"class": f"{__name__}.{type(self).__name__}", "trees": self.trees, "column": self.column, "out": self.out}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")

    @classmethod
    def load(cls, path: str) -> PartedForest:
        """Reload a forest stored below ``path``."""
        about = json.loads(SparkSession.active().read.text(f"{path}/metadata").first()[0])
        trees = tuple(about["trees"])
        return cls(tuple(f"{path}/part-{place}" for place in range(len(trees))), trees, about["column"], about["out"])
