"""Row expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_as(df: DataFrame, array: str, name: str) -> DataFrame:
    """One row per element of `array`, which is dropped.

    The outer form is used on purpose: for a plain explode the optimizer infers a `size(array) > 0` filter and pushes
    it below the projection, where a costly array expression would be computed a second time.
    """
    return df.withColumn(name, F.explode_outer(array)).drop(array).filter(F.col(name).isNotNull())
