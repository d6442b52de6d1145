"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: a lost executor never repeats what lies before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that a job of several rounds writes for itself and drops once the last round that reads them is written.

    Only paths that it has written itself are ever dropped. What follows must read tables written later: a plan that still refers
    to a dropped one cannot be run again.
    """

    def __init__(self) -> None:
        self._paths: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(df.sparkSession, name)
        df.write.parquet(path)
        table = df.sparkSession.read.schema(df.schema).parquet(path)
        self._paths.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Drop these tables, or all that are left."""
        gone = [(t, p) for t, p in self._paths if not tables or any(t is x for x in tables)]
        self._paths = [(t, p) for t, p in self._paths if all(p != q for _, q in gone)]
        for table, path in gone:
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def crc_fold(column: str | Column, folds: int) -> Column:
    """crc32 of the value's text modulo ``folds``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column, F.lit(""))) % folds


def text_slices(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` characters; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        length = len(text or "")
        if i > start and size + length > limit:
            yield start, i
            start, size = i, 0
        size += length
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, inputs: list[str], schema: str, make: Callable[[], Callable[..., dict[str, list]]],
              keep: tuple[str, ...] = ()) -> DataFrame:
    """One output row for each row: ``make()`` runs once in a task and returns a function of the input lists.

    That function gives a list for each column of ``schema``; the columns in ``keep`` are passed through. Rows are
    handed over in slices of bounded size (by the first input), so memory does not follow the batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(schema)
    out = StructType([df.schema[c] for c in keep] + made.fields)
    target = to_arrow_schema(out)
    names, n_keep, types = list(inputs), len(keep), [target.field(f.name).type for f in made.fields]
    made_names = made.fieldNames()

    def run(batches):
        work = make()
        for batch in batches:
            columns = [batch.column(n_keep + k).to_pylist() for k in range(len(names))]
            for a, b in text_slices(columns[0]):
                got = work(*[c[a:b] for c in columns])
                kept = [batch.column(k).slice(a, b - a).cast(target.field(k).type) for k in range(n_keep)]
                yield pa.RecordBatch.from_arrays(
                    kept + [v if isinstance(v := got[n], pa.Array) else pa.array(v, t) for n, t in zip(made_names, types)],
                    schema=target)

    picked = df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").alias(f"__in{k}") for k, c in enumerate(inputs)])
    return picked.mapInArrow(run, out)
