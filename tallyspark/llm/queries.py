"""The registered queries of this folder: every operator on its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import (backoff_langid, boosted_quality, byte_bpe, column_bwt, compression_bands, containment, deobfuscated_pii, fill_in_middle,
               hard_negatives, html_blocks, orc_tokens, pattern_packing, prefix_tree_join)
from .common import crc_fold, read_table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@_query
def op1_html_blocks(spark: SparkSession, folder: str) -> DataFrame:
    pages = html_blocks.extract_main_text(read_table(spark, folder, "pages"))
    return pages.select("page_id", "url", "text", "n_chars")


@_query
def op2_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    return compression_bands.compression_quality(read_table(spark, folder, "documents"))


@_query
def op3_column_bwt(spark: SparkSession, folder: str) -> DataFrame:
    return column_bwt.remove_repeats(read_table(spark, folder, "documents"))


@_query
def op4_orc_tokens(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    orc_tokens.write_tokens(read_table(spark, folder, "documents"), path, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return orc_tokens.with_checksum(orc_tokens.read_tokens(spark, path))


@_query
def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.round_trip_digest(read_table(spark, folder, "documents"), ranks, pattern())


@_query
def op6_boosted_quality(spark: SparkSession, folder: str) -> DataFrame:
    stats = written(boosted_quality.document_statistics(read_table(spark, folder, "documents")), "statistics")
    held_out = crc_fold("doc_id", 5) == 0
    labels = read_table(spark, folder, "labels").where(crc_fold("doc_id", 5) != 0)
    model = boosted_quality.fit_quality(stats, labels)
    scored = boosted_quality.score_quality(stats, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@_query
def op7_containment(spark: SparkSession, folder: str) -> DataFrame:
    return containment.contained_items(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@_query
def op8_backoff_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = backoff_langid.train_languages(docs.where(crc_fold("doc_id", 3) != 1))
    found = backoff_langid.predict_language(docs, model)
    return found.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@_query
def op9_deobfuscated_pii(spark: SparkSession, folder: str) -> DataFrame:
    return deobfuscated_pii.span_digest(read_table(spark, folder, "documents"))


@_query
def op10_prefix_tree_join(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_tree_join.ngram_components(read_table(spark, folder, "documents"))


@_query
def op11_exception_index_fim(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(read_table(spark, folder, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_in_middle.restored_text(), 256).alias("restored_sha256"))


@_query
def op12_pattern_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "pieces")
    pattern_packing.write_pieces(read_table(spark, folder, "documents"), path, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    pieces = spark.read.parquet(path).withColumn("ids_crc32", F.crc32("ids"))
    return pattern_packing.pack_pieces(pieces, payload=("ids_crc32",))


@_query
def op13_strassen_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, label=label)


@_query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


SQL["op7_containment"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
     b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
     ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
     bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
     n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_found
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 80
"""

SQL["op10_prefix_tree_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') || ' #' || len(w) ELSE array_to_string(w[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""

SQL["op13_strassen_negatives"] = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""

SQL["op11_exception_index_fim"] = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
i AS (SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
             ('0x' || substr(h, 17, 8))::BIGINT % 100 AS z, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS o FROM h),
c AS (SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
             CASE WHEN n = 0 OR z >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                  WHEN o < 20 THEN 'spm' ELSE 'psm' END AS form FROM i),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
