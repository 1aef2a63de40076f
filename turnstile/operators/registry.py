"""Model registry and run metrics as append-only tables."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = (
    "model_name string, version string, artifacts map<string,string>, params string, "
    "metrics map<string,double>, created_at string, run_id string"
)
REPORT = "model_name string, version string, created_at string, kind string, name string, number double, text string"


def register(
    spark: SparkSession,
    path: str,
    model_name: str,
    artifacts: dict[str, str],
    params: dict,
    metrics: dict[str, float],
    *,
    created_at: datetime | None = None,
    run_id: str | None = None,
) -> dict:
    """Append one entry; nested ``params`` are kept as JSON."""
    created = created_at or datetime.now(timezone.utc)
    entry = {
        "model_name": model_name,
        "version": created.strftime("%Y%m%d%H%M%S"),
        "artifacts": dict(artifacts),
        "params": json.dumps(params, sort_keys=True),
        "metrics": {k: float(v) for k, v in metrics.items()},
        "created_at": created.replace(tzinfo=None).isoformat(),
        "run_id": run_id,
    }
    spark.createDataFrame([entry], ENTRY).coalesce(1).write.mode("append").parquet(path)
    return entry


def entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY).parquet(path)


def latest_entries(df: DataFrame, keys: list[str], created: str, tiebreak: list[str]) -> DataFrame:
    """Newest entry of each model, whole rows."""
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(created, *tiebreak))
    return df.groupBy(*keys).agg(newest.alias("__e")).select(*keys, "__e.*").select(*df.columns)


def latest(spark: SparkSession, path: str, model_name: str):
    """Newest entry of one model, or None. The name is required: the newest of
    any type may be one the caller cannot score with."""
    rows = entries(spark, path).filter(F.col("model_name") == model_name)
    return latest_entries(rows, ["model_name"], "created_at", ["version"]).first()


def append_report(spark: SparkSession, path: str, entry: dict) -> None:
    """Append a run's metrics and artifacts, one row each."""
    head = (entry["model_name"], entry["version"], entry["created_at"])
    rows = [(*head, "metric", k, v, None) for k, v in entry["metrics"].items()]
    rows += [(*head, "artifact", k, None, v) for k, v in entry["artifacts"].items()]
    spark.createDataFrame(rows, REPORT).coalesce(1).write.mode("append").parquet(path)


def report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(path)
