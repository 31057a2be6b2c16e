"""Diversity of surveys from long counts; no community matrix is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diversity(df: DataFrame, ids: Sequence[str], count: str = "count") -> DataFrame:
    """Total, richness and Shannon index in one aggregation: H = ln N - sum(c ln c) / N."""
    c = F.col(count).cast("double")
    total = F.sum(c)
    present = F.sum(F.when(c > 0, c * F.ln(c)).otherwise(0.0))
    return df.groupBy(*ids).agg(
        F.sum(count).alias("total_abundance"),
        F.sum(F.when(c > 0, 1).otherwise(0)).cast("bigint").alias("richness"),
        F.when(total > 0, F.greatest(F.lit(0.0), F.ln(total) - present / total)).otherwise(0.0).alias("shannon"),
    )


def diversity_summary(div: DataFrame, by: Sequence[str]) -> DataFrame:
    return div.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("shannon").alias("mean_shannon"),
        F.var_samp("shannon").alias("variance_shannon"),
        F.min("shannon").alias("minimum_shannon"),
        F.max("shannon").alias("maximum_shannon"),
        F.sum(F.when(F.col("total_abundance") == 0, 1).otherwise(0)).cast("bigint").alias("zero_abundance_surveys"),
    )
