"""A corpus pipeline of five stages: quality, near duplicates, leaked test items, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame that ``run`` writes as Parquet and reads again as the next stage's
``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.llm import boosted_quality, byte_bpe, containment, deobfuscated_pii, prefix_tree_join
from tallyspark.llm.common import map_texts, read_table, written
from tallyspark.llm.queries import pattern, tokenizer_file

#: Near copies of the stage; op10's query has a contract of its own. Heads grow with what a partner may lack (0.24 at 85 %).
NEAR = prefix_tree_join.JoinPolicy(width=5, percent=80, head_share=0.32)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more; it learns from the labels of the documents given.

    Statistics are worked out first for the labelled documents that the fit may use, then once for each document as it is scored.
    """
    labels = read_table(spark, sf_dir, "labels").where("quality is not null")
    most = boosted_quality.BoostPolicy().max_rows
    # The fit takes the rows with the smallest hashes of their ids: no text is read to find which.
    first = docs.select("doc_id").join(labels.select("doc_id"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).distinct()
    known = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id", "left_semi")
    model = boosted_quality.fit_quality(written(boosted_quality.document_statistics(known), "statistics"), labels)

    def make():
        import zstandard

        compress = zstandard.ZstdCompressor(level=1).compress
        return lambda texts: {"score": model.score(boosted_quality.text_statistics(texts, compress)).tolist()}

    # Scored beside the whole row, which travels as one value: ids need not be unique, columns may have any name, no join carries texts.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    scored = map_texts(rows, ["text"], "score double", make, ("row",))
    return scored.where("score >= 0.3").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard 0.8 or more."""
    return prefix_tree_join.one_of_each(docs, policy=NEAR)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return containment.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts with personal data replaced by its kind, and their new lengths."""
    columns = tuple(docs.columns)
    found = deobfuscated_pii.redact(docs, keep=columns)
    clean = found.withColumn("text", F.col("redacted"))
    if "n_chars" in columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids and the ids of every text that is left."""
    ranks = byte_bpe.read_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    ids = byte_bpe.encode_bytes_bpe(docs, ranks, pattern())
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", no_leaks),
    ("personal data", no_personal_data),
    ("byte-level BPE", token_ids),
]

#: The classifier is not SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
