"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, pairs: Mapping, key: str, value: str) -> DataFrame:
    """A two-column table of constants, sized so that the optimizer sees how small it is."""
    rows = [F.struct(F.lit(k).alias(key), F.lit(v).alias(value)) for k, v in pairs.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))
