"""The source registry: which file holds which split, model and condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

REGISTRY_ROW = StructType([
    StructField("file", StringType(), False), StructField("split", StringType(), False),
    StructField("model", StringType(), False), StructField("ablation_type", StringType()),
    StructField("condition", StringType()), StructField("temperature", DoubleType()),
])


def registry_frame(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, REGISTRY_ROW)


def coverage(registered: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Names on disk that nobody registered, and registered names without a file."""
    return (present.select(key).join(registered.select(key), key, "left_anti")
            .withColumn("problem", F.lit("unregistered"))
            .unionByName(registered.select(key).join(present.select(key), key, "left_anti")
                         .withColumn("problem", F.lit("ghost"))))
