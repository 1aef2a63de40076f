"""Cut lineage with a written table below the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from turnstile.session import remove_work, work_path

#: Spark deletes the shuffles of a query as it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once as Parquet below ``spark.checkpoint.dir`` and read them back."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the path for ``forget``."""
    spark = df.sparkSession
    path, before = work_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def forget(df: DataFrame, path: str) -> None:
    """Delete a table of ``stored_at`` that nothing reads any more."""
    remove_work(df.sparkSession, path)
