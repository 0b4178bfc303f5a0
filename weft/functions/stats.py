"""Statistics of trials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trial_stats(values: DataFrame, column: str) -> DataFrame:
    """sum, mean, hmean, stddev (sample; null for one trial), min and max."""
    x = F.col(column).cast("double")
    return values.agg(F.sum(x).alias("sum"), F.avg(x).alias("mean"), (F.count(x) / F.sum(1 / x)).alias("hmean"), F.stddev_samp(x).alias("stddev"), F.min(x).alias("min"), F.max(x).alias("max"))
