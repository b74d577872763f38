"""Feature summaries and the training distribution used as support."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundcast.functions import fixed_values as fv
from roundcast.functions.scoring import support


def long_form(
    df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "feature"
) -> DataFrame:
    """One row per (row, column)."""
    return df.unpivot(list(keep), list(columns), name, "value")


def describe_features(df: DataFrame, columns: Sequence[str] = fv.FEATURES) -> DataFrame:
    """Min, max, mean and sample deviation per feature, in one pass over the rows."""
    wide = df.agg(
        *[
            F.struct(
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
            ).alias(c)
            for c in columns
        ]
    )
    return wide.unpivot([], list(columns), "feature", "s").select("feature", "s.*")


def fit_support(df: DataFrame, columns: Sequence[str] = fv.FEATURES) -> DataFrame:
    """One row with mean_<feature> and std_<feature> of the training rows."""
    return df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"std_{c}") for c in columns],
    )


def support_score(
    df: DataFrame,
    fitted: DataFrame | None,
    columns: Sequence[str] = fv.FEATURES,
    sigmas: float = fv.SUPPORT_SIGMAS,
    name: str = "support",
) -> DataFrame:
    """Add how familiar each row is; 1 everywhere when nothing was fitted.

    The fitted statistics are one row and enter as a scalar subquery.
    """
    if fitted is None:
        return df.withColumn(name, F.lit(1.0))
    packed = fitted.select(F.struct(*fitted.columns).alias("s")).scalar()
    with_stats = df.withColumn("__s", packed)
    mean = {c: F.col(f"__s.mean_{c}") for c in columns}
    deviation = {c: F.col(f"__s.std_{c}") for c in columns}
    return with_stats.withColumn(name, support(columns, mean, deviation, sigmas)).drop("__s")
