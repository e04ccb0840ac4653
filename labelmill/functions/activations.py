"""Activations and losses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def inverse_sigmoid(p: Column, eps: float = 1e-5) -> Column:
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return F.ln(F.greatest(p, F.lit(eps)) / F.greatest(1.0 - p, F.lit(eps)))


def softmax_over(df: DataFrame, keys: list[str], value: Column, out: str, temperature: float = 1.0) -> DataFrame:
    """df with the softmax of value / temperature over the rows of equal keys."""
    scaled = value / F.lit(temperature)
    w = Window.partitionBy(*keys)
    shifted = F.exp(scaled - F.max(scaled).over(w))
    return df.withColumn(out, shifted).withColumn(out, F.col(out) / F.sum(out).over(w))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce_with_logits(x: Column, target: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * target + F.log1p(F.exp(-F.abs(x)))


def focal_loss(x: Column, target: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p = sigmoid(x)
    miss = 1.0 - (p * target + (1.0 - p) * (1.0 - target))
    balance = F.lit(alpha) * target + F.lit(1.0 - alpha) * (1.0 - target)
    return balance * bce_with_logits(x, target) * F.pow(miss, F.lit(gamma))


def focal_class_cost(x: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Cost of giving a query a class: its focal loss as a positive less that as a negative."""
    p = sigmoid(x)
    pos = F.lit(alpha) * F.pow(1.0 - p, F.lit(gamma)) * -F.ln(p + 1e-8)
    neg = F.lit(1.0 - alpha) * F.pow(p, F.lit(gamma)) * -F.ln(1.0 - p + 1e-8)
    return pos - neg
