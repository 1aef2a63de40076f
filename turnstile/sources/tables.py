"""Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.operators.curate import cast_numbers, on_date
from turnstile.operators.quality import Check, enforce_observed, observed, passes_all
from turnstile.session import remove_work, work_path

# The schedule files that are read, all columns as text.
SCHEDULE_TABLES = ("stops", "shapes", "trips", "routes", "stop_times")


def read_table(
    spark: SparkSession, path: str, date: str | None = None, merge_schema: bool = False, contract: T.StructType | None = None
) -> DataFrame:
    """A table folder; with ``date`` only that date.

    The columns are those of one file. Optional fields of ``contract`` come in any
    case, null where a file is from before they were added, so no other footer is
    read; ``merge_schema`` asks all of them.

    The folder of one date is listed alone: a table that streams write has many
    small partitions, and listing them all would take longer than the read.
    """

    def load(place: str, **options: str) -> DataFrame:
        reader = spark.read.options(mergeSchema=merge_schema, **options)
        rows = reader.parquet(place)
        added = [f for f in contract or () if f.nullable and f.name not in rows.columns]
        return reader.schema(T.StructType([*rows.schema, *added])).parquet(place) if added else rows

    if date is None:
        return load(path)
    try:
        rows = load(f"{path}/date={date}", basePath=path)
    except AnalysisException as error:  # no such date, or not partitioned by it
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = load(path)
    return on_date(rows, "date", date)


def read_naive(spark: SparkSession, path: str) -> DataFrame:
    """A table whose zone-less timestamps become UTC timestamps."""
    df = spark.read.parquet(path)
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def read_dimension(spark: SparkSession, root: str, table: str, casts: dict[str, str] | None = None) -> DataFrame:
    """``{root}/{table}.parquet``; text columns are cast as given."""
    df = spark.read.parquet(f"{root}/{table}.parquet")
    for column, kind in (casts or {}).items():
        df = cast_numbers(df, [column], kind)
    return df


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace only the partitions that ``df`` holds rows for.

    The rebalance hint lets AQE give each file a fair size: it merges small
    partitions and splits a hot one over several tasks.
    """
    (
        df.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def swap_partitions(spark: SparkSession, staged: str, path: str, by: str) -> list[str]:
    """Put the partition folders of ``staged`` in place of those of ``path`` by renaming; returns their names.

    Both must lie in one file system. An old folder is moved aside before the new one
    comes and deleted afterwards; until then a run that broke off has lost nothing.
    """
    Path = spark._jvm.org.apache.hadoop.fs.Path
    source, target = Path(staged), Path(path)
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(source):
        return []
    files.mkdirs(target)
    moved = []
    for status in files.listStatus(source):
        name = status.getPath().getName()
        if not name.startswith(f"{by}="):
            continue
        new, old = Path(target, name), Path(target, f"_old-{uuid.uuid4().hex}")
        had = files.exists(new)
        if had and not files.rename(new, old):
            raise OSError(f"cannot move {new.toString()}")
        if not files.rename(status.getPath(), new):
            raise OSError(f"cannot move {status.getPath().toString()}")
        if had:
            files.delete(old, True)
        moved.append(name)
    return moved


def write_checked(df: DataFrame, path: str, by: str, checks: Sequence[Check], table: str, bad_path: str | None = None) -> list[dict]:
    """Write the rows once, and let them replace their partitions of ``path`` only if the checks hold.

    The checks are counted on the write itself, into a hidden folder of the table;
    publishing renames folders. With ``bad_path`` rows that fail a check go there
    instead, and nothing is raised. Returns the results of the checks.
    """
    spark = df.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    rows, seen = observed(df, checks)
    if bad_path is not None:
        rows = rows.withColumn("__good", F.coalesce(passes_all(checks), F.lit(False)))
    parts = ([] if bad_path is None else ["__good"]) + [by]
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = not files.exists(folder.getParent())
    try:
        rows.hint("rebalance", *parts).write.partitionBy(*parts).parquet(staged)
        if bad_path is None:
            results = enforce_observed(seen, table, checks)
            swap_partitions(spark, staged, path, by)
            return results
        swap_partitions(spark, f"{staged}/__good=false", bad_path, by)
        swap_partitions(spark, f"{staged}/__good=true", path, by)
        return [seen.get]
    finally:
        files.delete(folder, True)
        if fresh and not files.listStatus(folder.getParent()):
            files.delete(folder.getParent(), True)


def overwrite_changed(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace only the partitions whose rows differ from the stored ones.

    Rows are staged once in the shared folder; a partition is compared by its
    row count and the sum of its rows' hashes, both pre-aggregated.
    """
    spark = df.sparkSession
    staged = work_path(spark, "changed")
    try:
        df.write.parquet(staged)
        rows = spark.read.schema(df.schema).parquet(staged)
        try:
            kinds = {f.name: f.dataType for f in df.schema}
            stored = spark.read.parquet(path)
            stored = stored.select([F.col(c).cast(kinds[c]) for c in df.columns]) if set(stored.columns) == set(kinds) else None
        except AnalysisException as error:  # no table yet
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            stored = None
        if stored is not None:
            same = partition_digests(rows, by).join(partition_digests(stored, by), on=[*by, "rows", "digest"], how="left_semi")
            rows = rows.join(same.select(*by), on=list(by), how="left_anti").select(df.columns)
        overwrite_partitions(rows, path, by)
    finally:
        remove_work(spark, staged)


def partition_digests(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, rows, digest) of each partition."""
    hashed = F.xxhash64(*sorted(c for c in df.columns if c not in by)).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(hashed).alias("digest"))


def csv_to_parquet(spark: SparkSession, source: str, target: str, tables: Sequence[str] = SCHEDULE_TABLES, suffix: str = ".txt") -> list[str]:
    """Rewrite schedule files with a header as Parquet, every column as text.

    Missing files are skipped; returns the names that were found.
    """
    found = []
    for name in tables:
        try:
            rows = spark.read.option("header", True).option("escape", '"').csv(f"{source}/{name}{suffix}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        rows.write.mode("overwrite").parquet(f"{target}/{name}.parquet")
        found.append(name)
    return found


def compact(
    spark: SparkSession,
    path: str,
    sort_by: Sequence[str],
    *,
    partition_by: Sequence[str] = (),
    target: str | None = None,
    files: int | None = None,
    date: str | None = None,
) -> str:
    """Rewrite a table into fewer files, ordered so that scans can skip.

    Rows are spread by ranges of (partition, sort columns), so a hot partition
    gets several files with distinct ranges. A partitioned table may be
    rewritten in place, one ``date`` at a time; else give a new ``target``. Do
    not write to the same partitions meanwhile.
    """
    if target is None and not partition_by:
        raise ValueError("a table without partitions needs a target path")
    rows = read_table(spark, path, date)
    order = [*partition_by, *sort_by]
    spread = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    writer = spread.sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target or path)
    return target or path


#: Bits per column of the clustering curve: 64 ranges.
CURVE_BITS = 6
#: Rows, about, from which the ranges of the curve are taken; they steer the layout, not the content.
CURVE_SAMPLE = 20_000


def range_cuts(df: DataFrame, columns: Sequence[str], bits: int = CURVE_BITS, rows: int = CURVE_SAMPLE, seed: int = 7) -> dict[str, list]:
    """For each column at most 2 ** bits - 1 ascending values that cut a sample of it into equal parts."""
    total = df.count()
    sample = df.select(*columns).sample(min(1.0, rows / max(total, 1)), seed).collect()
    cuts = {}
    for c in columns:
        values = sorted(r[c] for r in sample if r[c] is not None and r[c] == r[c])
        parts = 1 << bits
        cuts[c] = sorted({values[len(values) * i // parts] for i in range(1, parts)}) if values else []
    return cuts


def curve(cuts: dict[str, list], schema: T.StructType, bits: int = CURVE_BITS) -> Column:
    """The place of a row on a curve that keeps rows close which are close in all columns.

    Each column's value becomes the number of its range, null the first; the bits of
    these numbers are interleaved, the highest of every column first.
    """
    place = F.lit(0).cast("long")
    for i, (name, values) in enumerate(cuts.items()):
        known = F.array(*[F.lit(v).cast(schema[name].dataType) for v in values]) if values else F.array()
        rank = F.size(F.filter(known, lambda v: v <= F.col(name))) if values else F.lit(0)
        for b in range(bits):
            bit = F.shiftright(rank, b).bitwiseAND(F.lit(1)).cast("long")
            place = place + F.shiftleft(bit, b * len(cuts) + (len(cuts) - 1 - i))
    return place


def cluster(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    *,
    partition_by: Sequence[str] = (),
    target: str | None = None,
    files: int | None = None,
    date: str | None = None,
    bits: int = CURVE_BITS,
) -> str:
    """As ``compact``, but laid out along a curve over several columns, at most 62 / bits of them.

    A linear order lets scans skip files by its first column only. Here every file
    covers a narrow range of each column, so the files' statistics serve filters on
    any of them.
    """
    if target is None and not partition_by:
        raise ValueError("a table without partitions needs a target path")
    if not columns or len(columns) * bits > 62:
        raise ValueError(f"1 to {62 // bits} columns")
    rows = read_table(spark, path, date)
    place = curve(range_cuts(rows, columns, bits), rows.schema, bits)
    order = [*partition_by, "__place"]
    rows = rows.withColumn("__place", place)
    spread = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    writer = spread.sortWithinPartitions(*order).drop("__place").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target or path)
    return target or path
