"""run() of the pipeline against the same stages worked out by hand."""


import random

import numpy as np
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import boosted_quality, byte_bpe, deobfuscated_pii
from tallyspark.llm.common import read_table
from tallyspark.llm.queries import pattern, tokenizer_file

from test_llm_operators import brute_components, brute_containment, frame, words

SF = "/root/testdata/sf0.001"


def test_pipeline_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in read_table(spark, SF, "documents").collect()}
    compress = zstandard.ZstdCompressor(level=1).compress
    stats = boosted_quality.document_statistics(read_table(spark, SF, "documents"))
    model = boosted_quality.fit_quality(stats, read_table(spark, SF, "labels"))
    score = model.score(np.array([boosted_quality.statistics(t, compress) for t in docs.values()]))
    docs = {i: t for (i, t), s in zip(docs.items(), score) if s >= 0.3}
    groups = brute_components(list(docs.items()))
    docs = {i: t for i, t in docs.items() if groups[i][0] == 0 or groups[i][1] == i}
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    leaks = {d for d, _ in brute_containment(list(docs.items()), items)}
    own = tiktoken.Encoding("own", pat_str=pattern(), special_tokens={},
                            mergeable_ranks=byte_bpe.read_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken")))
    want = {}
    for i, t in docs.items():
        if i not in leaks:
            want[i] = own.encode_ordinary(deobfuscated_pii.redacted(t, [s for p in deobfuscated_pii.find_all(t) for s in p]))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and leaks


def test_near_copies_of_the_stage_are_those_of_five_words_and_80_percent(spark):
    rng = random.Random(11)
    texts = [None, "", "a b c d", "a b c d", "a b c d e"]
    for n in (12, 60, 248, 600, 1632):
        base = words(rng, n).split()
        for share in (0, 0.01, 0.017, 0.019, 0.02, 0.021, 0.022, 0.023, 0.03):
            w = list(base)
            for k in rng.sample(range(n), round(share * n)):
                w[k] = f"n{rng.random()}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    want, four = ({i for i, (n, c) in brute_components(rows, *p).items() if n == 0 or c == i} for p in ((5, 80), (4, 85)))
    got = {r.doc_id for r in corpus_pipeline.one_of_each(spark, frame(spark, texts), SF).collect()}
    assert got == want and want < four


ODD_DOCS = "doc_id long, text string, lang string, source string, n_chars long, __score string, __text string, __name string, __leak string, row string"


def odd_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "a", "b", "c", "d", str(k)) for k, (i, t) in enumerate(rows)], ODD_DOCS)


def test_near_copies_with_null_and_repeated_ids_by_brute_force(spark):
    rng = random.Random(21)
    base, other, third = (words(rng, 300) for _ in range(3))
    near = [" ".join(w if k != n else "changed" for k, w in enumerate(base.split())) for n in (40, 90, 200)]
    rows = [(5, base), (None, near[0]), (None, near[1]), (6, near[2]), (6, other), (None, third), (None, third), (None, ""), (None, ""), (7, None),
            (7, None), (8, "x"), (8, "x"), (9, other), (9, third)]
    groups = brute_components([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)
    kept = corpus_pipeline.one_of_each(spark, odd_docs(spark, rows), SF).collect()
    # The row of each group with the smallest id, null last; rows without words all stay.
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    best = {}
    for k, (n, g) in groups.items():
        best.setdefault(g if n else (g, k), []).append(k)
    want = sorted((rows[min(v, key=order)] for v in best.values()), key=str)
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == want
    assert all((r["__score"], r["__text"], r["__name"], r["__leak"]) == ("a", "b", "c", "d") for r in kept)


def test_leaks_with_null_and_repeated_ids_take_no_other_row(spark, tmp_path):
    rng = random.Random(22)
    item = words(rng, 12)
    clean = [words(rng, 40) for _ in range(4)]
    rows = [(None, f"{clean[0]} {item}"), (None, clean[1]), (None, None), (3, f"{item} {clean[2]}"), (3, clean[3]), (3, clean[3])]
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.no_leaks(spark, odd_docs(spark, rows), str(tmp_path)).collect()
    assert sorted(int(r.row) for r in kept) == [1, 2, 4, 5] and all((r["__score"], r["__leak"]) == ("a", "d") for r in kept)


def test_quality_stage_passes_any_column_through(spark, tmp_path):
    spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "a text of words"), (None, "another"), (None, None), (2, "")]
    docs = odd_docs(spark, rows)
    kept = corpus_pipeline.good_quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and all((r["__score"], r["__text"], r["__name"], r["__leak"]) == ("a", "b", "c", "d") for r in kept.collect())


def test_many_template_texts_need_little_memory():
    """20,000 texts of one block that differ in their last word: their 200 million links are united, never listed."""
    import resource

    from tallyspark.llm import prefix_tree_join

    base = " ".join(f"w{k}" for k in range(30))
    sets = prefix_tree_join.shingle_sets([f"{base} end{k}" for k in range(20_000)], 5)
    before, seen = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0
    for i, linked in prefix_tree_join.overlap_links(sets, 80):
        seen += len(linked)
    assert seen == 20_000 * 19_999 // 2
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # kB


@pytest.mark.parametrize("texts", [[None, "", "x", "x", "a b c d e f g h", "a b c d e f g h"], []])
def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path, texts):
    docs = frame(spark, texts)
    docs = docs.unionByName(docs.limit(2)).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, columns in (("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(rows) <= docs.count() and bool(rows) == bool(texts)
