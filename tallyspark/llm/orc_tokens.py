"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on document ids.

Documents are dealt into ranges of ascending id, sorted, encoded and written in one job; each file holds one range, so file
order is id order. ORC keeps an array of ids as one stream of run-length encoded integers, cuts files into stripes that tasks read
independently, and indexes every ``row_stride`` rows by minimum, maximum and a Bloom filter of the document id, so that
a lookup by id skips files, stripes and row groups. The start of a document is the sum of its file's predecessors (one row for
each file) plus its running start within the file, which was written beside the ids.

Null and empty texts become the end id alone. Documents with the same id follow each other in the order of their texts' hashes; a
null id sorts first. An empty table writes no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .chunked_bpe import GPT2_PATTERN, ChunkEncoder, worker_cache
from .common import text_slices


@dataclass(frozen=True)
class OrcLayout:
    stripe_bytes: int = 16 << 20
    row_stride: int = 1_000
    bloom_fpp: float = 0.01
    compress: str = "zlib"


def library_encoder(path: str) -> ChunkEncoder:
    """The tokenizer of a tokenizers-library file, kept by the worker; strings of special tokens are ordinary text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    cache = worker_cache()
    if ("orc_tokens", path) not in cache:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        cache["orc_tokens", path] = ChunkEncoder(tokenizer, GPT2_PATTERN)
    return cache["orc_tokens", path]


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
                 layout: OrcLayout = OrcLayout()) -> None:
    """Write (key, part, local_start, n_tokens, ids) as ORC files in ascending key order."""
    key_type = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, part int, local_start long, n_tokens long, ids array<int>"

    def encode(batches):
        from pyspark import TaskContext

        encoder, part, start = library_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_slices(texts):
                flat, counts = encoder(texts[a:b])
                ends = np.cumsum(counts)
                flat = np.insert(flat.astype(np.int32), ends, end_id)
                sizes = counts + 1
                stops = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part), pa.int32()), pa.array(start + stops[:-1], pa.int64()),
                    pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(flat, pa.int32()))],
                    names=[key, "part", "local_start", "n_tokens", "ids"])
                start += int(stops[-1])

    order = [F.col(f"`{key}`").asc_nulls_first(), F.xxhash64(text)]
    dealt = df.select(f"`{key}`", f"`{text}`").repartitionByRange(*order).sortWithinPartitions(*order)
    (dealt.mapInArrow(encode, schema).write.option("compression", layout.compress)
     .option("orc.stripe.size", layout.stripe_bytes).option("orc.row.index.stride", layout.row_stride)
     .option("orc.bloom.filter.columns", key).option("orc.bloom.filter.fpp", layout.bloom_fpp).orc(path))


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) from the files, ``start`` counting the ids of all documents before."""
    rows = spark.read.orc(path)
    sizes = rows.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("size"))
    # One row for each file: the running total is over the number of files, not of documents.
    starts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("part_start"))
    return rows.join(F.broadcast(starts), "part").select(
        key, (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def find_tokens(spark: SparkSession, path: str, keys: list, key: str = "doc_id") -> DataFrame:
    """Rows of a few keys; the filter reaches the files' statistics, row indexes and Bloom filters."""
    return spark.read.orc(path).where(F.col(key).isin(keys)).select(key, "n_tokens", "ids")


def with_checksum(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32): the checksum of the ids as little-endian unsigned 32-bit integers."""
    key_type = tokens.schema[key].dataType.simpleString()

    def check(batches):
        for batch in batches:
            ids = batch.column(3)
            stops = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [crc32(flat[a:b]) for a, b in zip(stops[:-1], stops[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(sums, pa.int64())],
                                             names=[key, "start", "n_tokens", "ids_crc32"])

    return tokens.select(key, "start", "n_tokens", "ids").mapInArrow(check, f"`{key}` {key_type}, start long, n_tokens long, ids_crc32 long")
