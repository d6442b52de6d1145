"""File sources: nested JSON with lineage, JSON lines, CSV and prepared tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.checks import ContractError
from ..operators.distributed import bucket_offsets

BOM = "﻿"


def json_records(spark: SparkSession, folder: str, pattern: str = "*.json", lines: bool = False) -> DataFrame:
    """(source_file, source_ordinal, record) for every record; ``record`` is a variant.

    Array files (one JSON array per file) are one row until exploded, so a file must
    fit a task; many files are read in parallel. Large exports come as JSON lines,
    which Spark splits: their ordinal is the position inside the split plus the rows of
    the file's earlier splits.
    """
    read = spark.read.option("singleVariantColumn", "record").option("pathGlobFilter", pattern)
    if not lines:
        files = read.option("multiLine", True).json(folder).select(
            F.col("_metadata.file_name").alias("source_file"), "record")
        return files.select(
            "source_file", F.posexplode(F.variant_get("record", "$", "array<variant>")).alias("source_ordinal", "record")
        ).withColumn("source_ordinal", F.col("source_ordinal").cast("long"))
    rows = read.json(folder).select(
        F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"), "record")
    blocks = rows.groupBy("source_file", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__w"))
    offsets = bucket_offsets(blocks.drop("__first"), "source_file", ["__block"])
    starts = blocks.join(offsets, ["source_file", "__block"]).select("source_file", "__block", "__first", "__off")
    return rows.join(F.broadcast(starts), ["source_file", "__block"]).select(  # one row a split; a shuffle would send a split's records to one task
        "source_file", (F.col("__id") - F.col("__first") + F.col("__off")).alias("source_ordinal"), "record")


def not_an_array(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Files whose root is something else than a JSON array."""
    files = (
        spark.read.option("singleVariantColumn", "record").option("pathGlobFilter", pattern)
        .option("multiLine", True).json(folder)
    )
    return files.where(~F.schema_of_variant("record").startswith("ARRAY")).select(
        F.col("_metadata.file_name").alias("source_file"))


def file_names(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Names of the matching files; only listings are read."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return sorted(r.path.rsplit("/", 1)[-1] for r in listing.collect())


def require_files(spark: SparkSession, folder: str, pattern: str, count: int) -> list[str]:
    found = file_names(spark, folder, pattern)
    if len(found) != count:
        raise ContractError(f"Expected {count} files like {pattern}, found {len(found)}")
    return found


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed records of JSON array files."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Typed JSON lines; blank lines are skipped. Not strict: bad lines stay, in ``_bad``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line_number, line, partition columns) of text files, numbered from 1, blank lines included.

    A file is read in as many splits as Spark makes; a line's number is its place in the split plus the lines of the file's
    earlier splits, so only counts for each split meet.
    """
    text = spark.read.text(path)
    rows = text.select(
        F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"), F.col("value").alias("line"), *[c for c in text.columns if c != "value"])
    blocks = rows.groupBy("__file", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__w"))
    offsets = bucket_offsets(blocks.drop("__first"), "__file", ["__block"])
    starts = blocks.join(offsets, ["__file", "__block"]).select("__file", "__block", (F.col("__off") - F.col("__first") + 1).alias("__add"))
    return rows.join(F.broadcast(starts), ["__file", "__block"]).withColumn("line_number", F.col("__id") + F.col("__add")).drop("__file", "__block", "__id", "__add")


def bad_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(source_file, line_number, line, partition columns) of the lines that are neither blank nor valid records."""
    parsed = F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = numbered_lines(spark, path).where(F.length(F.trim("line")) > 0)
    return rows.withColumn("__p", parsed).where(F.col("__p._bad").isNotNull()).drop("__p")


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header as string columns, empty where nothing is written; a byte order
    mark before the header is dropped."""
    df = (
        spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True)
        .option("escape", '"').csv(path)
    )
    return df.toDF(*[c.lstrip(BOM) for c in df.columns]).fillna("")


def csv_typed(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Schema-first CSV; only the asked columns are parsed."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*columns) if columns else df


# --- fixed values: pieces of a file that is hashed, and endings of files that readers unpack ---
CHUNK_BYTES = 1 << 16
PACKED = r"\.(?:gz|bz2|deflate|lz4|snappy|zst)$"
# -------------------------------------------------------------------------------------------------


def _chunks(batches):
    """Arrow batches of lines, in the order of their split, as rows of some 64 KB of joined lines."""
    import pyarrow as pa

    names = ["path", "length", "block", "seq", "chunk"]
    key, held, size, seq = None, [], 0, 0
    for batch in batches:
        rows = []
        for path, length, block, line in zip(*[batch.column(c).to_pylist() for c in ("path", "length", "block", "line")]):
            if held and (size >= CHUNK_BYTES or (path, length, block) != key):
                rows.append((*key, seq, b"\n".join(held)))
                held, size, seq = [], 0, seq + 1
            key = (path, length, block)
            held.append(line)
            size += len(line) + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, seq, b"\n".join(held))], names)


def _digests(batches):
    """(path, sha256) from chunks in file order; only the state of one hash is held.

    Readers take off a byte order mark and the last line's end. The file's length tells which of them were there.
    """
    import hashlib

    import pyarrow as pa

    mark = BOM.encode()
    current, seen, plain, marked = None, 0, None, None

    def done():
        path, length = current
        ends = {0: (plain, b""), 1: (plain, b"\n"), len(mark): (marked, b""), len(mark) + 1: (marked, b"\n")}
        if length - seen not in ends:
            raise ValueError(f"{path} has {length} bytes, of which {seen} were read")
        state, end = ends[length - seen]
        state.update(end)
        return pa.RecordBatch.from_pydict({"path": [path], "sha256": [state.hexdigest()]})

    for batch in batches:
        for path, length, chunk in zip(*[batch.column(c).to_pylist() for c in ("path", "length", "chunk")]):
            if (path, length) != current:
                if current:
                    yield done()
                current, seen, plain, marked = (path, length), 0, hashlib.sha256(), hashlib.sha256(mark)
                part = chunk
            else:
                part = b"\n" + chunk
            plain.update(part)
            marked.update(part)
            seen += len(part)
    if current:
        yield done()


def file_manifest(spark: SparkSession, folder: str, row_counts: DataFrame | None = None, pattern: str = "*") -> DataFrame:
    """(file_name, sha256 of the bytes, logical rows). ``row_counts`` is (source_file, rows).

    A file is read in splits, its lines are packed into chunks, and the chunks pass one hash in file order, so a task holds a batch of
    chunks and never a file. Only packed files (.gz and the like), which readers would unpack, and a single line are held whole.
    Empty files are not listed, as Spark's readers pass over them.
    """
    read = spark.read.option("pathGlobFilter", pattern)
    listing = read.format("binaryFile").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    packed = [r.path for r in listing.where(F.col("path").rlike(PACKED)).collect()]
    lines = read.option("lineSep", "\n").text(folder).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    chunks = lines.where(~F.col("path").rlike(PACKED)).mapInArrow(
        _chunks, "path string, length long, block long, seq long, chunk binary")
    placed = chunks.repartition("path").sortWithinPartitions("path", "block", "seq")
    hashed = placed.mapInArrow(_digests, "path string, sha256 string")
    if packed:
        hashed = hashed.unionByName(spark.read.format("binaryFile").load(packed).select("path", F.sha2("content", 256).alias("sha256")))
    files = hashed.select(name, "sha256")
    if row_counts is None:
        return files
    counted = row_counts.select(F.col("source_file").alias("file_name"), F.col("rows").alias("logical_row_count"))
    return files.join(counted, "file_name", "left").fillna(0, ["logical_row_count"])


def rows_per_file(records: DataFrame) -> DataFrame:
    return records.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))


