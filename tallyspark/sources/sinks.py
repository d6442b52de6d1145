"""Sinks. Every one refuses to overwrite; appends are explicit."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from .readers import BOM


def write_json_lines(df: DataFrame, path: str, order: Sequence[str] = (), one_file: bool = False) -> None:
    """JSON lines in a total order across part files (range partitioned, then sorted)."""
    out = df.orderBy(*order) if order else df
    if one_file:
        out = out.coalesce(1)
    out.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, headers: Sequence[str], bom: bool = True) -> None:
    """CSV with fixed header order; columns beyond the headers are left out."""
    out = df.select(*headers)
    if bom:  # the header is the first line of each part file, so its first name carries the mark
        out = out.withColumnRenamed(headers[0], BOM + headers[0])
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    out.write.mode("errorifexists").options(header=True, escape='"', **keep).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A small report as JSON with sorted keys, in one file."""
    report.select(*sorted(report.columns)).coalesce(1).write.mode("errorifexists").option(
        "ignoreNullFields", "false").json(path)


def append_events(events: DataFrame, path: str, fmt: str = "parquet") -> None:
    events.write.mode("append").format(fmt).save(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def publish(
    spark: SparkSession, tables: Mapping[str, DataFrame], path: str,
    validate: Callable[[Mapping[str, DataFrame]], None] | None = None,
) -> dict[str, DataFrame]:
    """All tables or none: write beside the target, check what was written, then rename."""
    if exists(spark, path):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging"
    fs, staged = _hadoop(spark, staging)
    if fs.exists(staged):
        raise FileExistsError(staging)
    try:
        for name, df in tables.items():
            write_table(df, f"{staging}/{name}")
        written = {name: spark.read.schema(df.schema).parquet(f"{staging}/{name}") for name, df in tables.items()}
        if validate:
            validate(written)
        _, target = _hadoop(spark, path)
        if not fs.rename(staged, target):
            raise OSError(f"cannot publish {path}")
    except BaseException:
        fs.delete(staged, True)
        raise
    return {name: spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in tables.items()}


def refuse_existing(spark: SparkSession, paths: Sequence[str]) -> None:
    found = [p for p in paths if exists(spark, p)]
    if found:
        raise FileExistsError("refusing to overwrite: " + ", ".join(found))
