"""Confidence of predictions: decisive, familiar and steady."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundcast.functions import scoring
from roundcast.operators.live import recent_stability


def score_confidence(
    df: DataFrame,
    probability: str = "ct_win_probability",
    support: str = "support",
    keys: Sequence[str] = ("match_id",),
    order: str = "sequence",
    **stability,
) -> DataFrame:
    """Add the three components, their geometric mean, its band and the weakest part."""
    steady = recent_stability(df, probability, keys, order, **stability)
    with_parts = steady.withColumn("decisiveness", scoring.decisiveness(F.col(probability)))
    parts = {
        "decisiveness": F.col("decisiveness"),
        "training support": F.col(support),
        "stability": F.col("stability"),
    }
    scored = with_parts.withColumn("score", scoring.combined_confidence(*parts.values()))
    weakest = scoring.weakest_component(parts)
    return scored.withColumns(
        {
            "band": scoring.confidence_band(F.col("score")),
            "is_trustworthy": scoring.confidence_band(F.col("score")) != "low",
            "limited_by": weakest["name"],
        }
    ).drop("recent_deviation", "recent_samples")
