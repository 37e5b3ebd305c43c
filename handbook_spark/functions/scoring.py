"""Agreement of two extractions of the same module."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def agreement(model_value: Column, regex_value: Column) -> Column:
    """0.5 when the model gave nothing, 1 when both agree, else 0 (also for a missing regex value)."""
    return (
        F.when(model_value.isNull(), F.lit(0.5)).when(model_value == regex_value, F.lit(1.0)).otherwise(F.lit(0.0))
    )


def confidence(*scores: Column) -> Column:
    """Mean of the agreements."""
    return sum(scores[1:], scores[0]) / len(scores)


def retrieval_score(*scores: Column) -> Column:
    """Mean of the agreements cut to whole numbers, so that 0.5 counts as 0."""
    return confidence(*[s.cast("int") for s in scores])


def code_credibility(model_code: Column, regex_code: Column) -> Column:
    """0 when the model gave no code, -1 when it gave another one, 1 when both agree."""
    return (
        F.when(model_code.isNull(), F.lit(0))
        .when(model_code.eqNullSafe(regex_code), F.lit(1))
        .otherwise(F.lit(-1))
    )
