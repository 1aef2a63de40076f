"""Error and coverage metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((actual - predicted) * (actual - predicted)))


def pinball(actual: Column, predicted: Column, quantile: float) -> Column:
    """Loss of one row at ``quantile``."""
    error = actual - predicted
    return F.greatest(error * F.lit(quantile), error * F.lit(quantile - 1.0))


def pinball_loss(actual: Column, predicted: Column, quantile: float) -> Column:
    return F.avg(pinball(actual, predicted, quantile))


def coverage(actual: Column, lower: Column, upper: Column) -> Column:
    """Share of rows with lower <= actual <= upper."""
    return F.avg(actual.between(lower, upper).cast("double"))


def quantile_label(quantile: float) -> str:
    return f"p{int(quantile * 100)}"


def quantile_metrics(actual: str, predictions: dict[float, str], prefix: str = "val_") -> list[Column]:
    """Pinball loss, MAE and RMSE of each quantile's column, for one ``agg``."""
    metrics = []
    for quantile, column in predictions.items():
        y, p, name = F.col(actual), F.col(column), quantile_label(quantile)
        metrics += [
            pinball_loss(y, p, quantile).alias(f"{prefix}pinball_{name}"),
            mae(y, p).alias(f"{prefix}mae_{name}"),
            rmse(y, p).alias(f"{prefix}rmse_{name}"),
        ]
    return metrics


def evaluate(df: DataFrame, actual: str, predictions: dict[float, str], prefix: str = "val_") -> DataFrame:
    """One row with all metrics; the outermost two quantiles give the coverage."""
    columns = quantile_metrics(actual, predictions, prefix)
    if len(predictions) > 1:
        low, high = predictions[min(predictions)], predictions[max(predictions)]
        columns.append(coverage(F.col(actual), F.col(low), F.col(high)).alias(f"{prefix}coverage"))
    return df.agg(*columns)
