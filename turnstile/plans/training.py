"""Train, evaluate and register quantile models."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.operators import registry
from turnstile.operators.boosting import BoostingParams, QuantileModel, fit_quantiles, score
from turnstile.operators.dataset import ordered_split, training_rows
from turnstile.operators.features import FEATURES
from turnstile.operators.halving import halving_search
from turnstile.operators.metrics import evaluate, quantile_label
from turnstile.plans import transit
from turnstile.sources.tables import read_table


@dataclass
class TrainingRun:
    models: dict[str, QuantileModel]
    metrics: dict[str, float]
    importance: dict[str, float]
    params: BoostingParams


@dataclass
class TrainingConfig:
    horizon_min: int = 10
    start: str | None = None
    end: str | None = None
    features: Sequence[str] = FEATURES
    label: str = "label_p50"
    quantiles: Sequence[float] = transit.QUANTILES
    trials: int = 0
    boosting: BoostingParams = field(default_factory=BoostingParams)


def train_quantiles(
    rows: DataFrame,
    features: Sequence[str],
    label: str,
    quantiles: Sequence[float],
    order: Sequence[str],
    boosting: BoostingParams = BoostingParams(),
    trials: int = 0,
) -> TrainingRun:
    """One model per quantile on the first 80 % by ``order``, measured on the
    rest. With ``trials`` the parameters are searched at the first quantile, by
    halving, and the search's model is that quantile's."""
    train, valid = ordered_split(rows, order)
    models = {}
    if trials:
        search = halving_search(train, valid, features, label, quantiles[0], trials, boosting)
        boosting, models = search.params, {quantile_label(quantiles[0]): search.model}
    rest = quantiles[len(models) :]
    models |= zip(map(quantile_label, rest), fit_quantiles(train, valid, features, label, rest, boosting), strict=True)
    columns = {float(q): quantile_label(q) for q in quantiles}
    measured = evaluate(score(valid, models).dropna(subset=[label]), label, columns).first()
    metrics = {k: float(v) for k, v in measured.asDict().items() if v is not None}
    importance = {f"mean_importance_{n}": m.mean_importance() for n, m in models.items()}
    importance |= {f"importance_{n}_{c}": v for n, m in models.items() for c, v in m.feature_importance().items()}
    return TrainingRun(models, metrics | importance, importance, boosting)


def run_training(spark: SparkSession, root: str, config: TrainingConfig = TrainingConfig(), gold: DataFrame | None = None) -> dict:
    """Fit on Gold, save the models, register them and append the report."""
    gold = read_table(spark, transit.gold_path(root)) if gold is None else gold
    rows = training_rows(gold, config.horizon_min, config.start, config.end, features=config.features, label=config.label)
    rows = rows.withColumn("minute", F.col("minute").try_cast("timestamp"))
    run = train_quantiles(
        rows,
        config.features,
        config.label,
        config.quantiles,
        ["minute", "origin_stop", "dest_stop", *config.features, config.label],
        config.boosting,
        config.trials,
    )
    folder = f"{root}/models/gbt-{uuid.uuid4().hex}"
    artifacts = {}
    for name, model in run.models.items():
        artifacts[name] = f"{folder}/{name}"
        model.save(spark, artifacts[name])
    params = {
        "dataset": {"horizon_min": config.horizon_min, "start": config.start, "end": config.end, "feature_columns": list(config.features)},
        "trainer": {"type": "gbt", "params": {"quantiles": list(config.quantiles), **asdict(run.params)}},
    }
    entry = registry.register(spark, transit.registry_path(root), "gbt", artifacts, params, run.metrics)
    registry.append_report(spark, transit.reports_path(root), entry)
    return entry


def load_models(spark: SparkSession, root: str, model_name: str = "gbt") -> dict[str, QuantileModel]:
    """Models of the newest registered entry; none if there is no entry."""
    entry = registry.latest(spark, transit.registry_path(root), model_name)
    if entry is None:
        return {}
    return {name: QuantileModel.load(spark, path) for name, path in entry["artifacts"].items() if name.startswith("p")}
