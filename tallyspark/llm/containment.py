"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by size (their number of distinct five-word shingles, in powers of two). An item's MinHash signature are
its ``k`` smallest shingle hashes, with ``k`` one more than the shingles that an item of its partition may miss at the wanted
containment: a document that contains the item has at least one of them, so the search loses nothing. Documents whose shingle
hashes meet a signature are candidates; their shingles, as text, are then counted against the whole items.

Words are runs of letters and digits, lower-cased. Items with fewer words than a shingle, and null or empty texts on
either side, are never found. Rows with the same id are looked at one by one, and a pair is reported once, with its best row.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class ContainmentPolicy:
    """``literal_hashes`` bounds the signatures that travel inside the plan; larger benchmarks are joined."""

    words: int = 5
    percent: int = 80
    literal_hashes: int = 20_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: Column, width: int, joined: bool) -> Column:
    """All shingles of an array of words, as text or as hashes.

    The array is bound by an outer lambda: named as a column, the optimizer would put its expression, the splitting of the
    whole text, into the inner one and run it for every word.
    """
    def at(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i + k) for k in range(width)]

    made = (lambda w, i: F.concat_ws(" ", *at(w, i))) if joined else (lambda w, i: F.xxhash64(*at(w, i)))
    found = F.transform(F.array(words), lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: made(w, i))))
    return F.get(found, F.lit(0))


def item_table(items: DataFrame, item: str, text: str, policy: ContainmentPolicy) -> DataFrame:
    """(item, n_item, shingle, hash, in_signature): the shingles of every item, with its MinHash signature marked."""
    rows = (
        items.where(F.col(text).isNotNull())
        .select(F.col(item).alias("item"), F.xxhash64(text).alias("item_row"), _words(F.col(text)).alias("w"))
        .select("item", "item_row", F.array_distinct(_shingles(F.col("w"), policy.words, True)).alias("s")).where(F.size("s") > 0)
        .dropDuplicates(["item", "item_row"])
    )
    # The largest size of the partition decides how many shingles may be missing.
    top = F.pow(F.lit(2), F.ceil(F.log2(F.size("s")))).cast("long")
    missing = top - F.ceil(top * policy.percent / 100)
    hashed = F.expr("array_sort(transform(s, x -> struct(xxhash64(x) as h, x as shingle)))")
    return rows.select(
        "item", "item_row", F.size("s").alias("n_item"), (missing + 1).alias("k"), F.posexplode(hashed).alias("at", "c"),
    ).select("item", "item_row", "n_item", "c.shingle", (F.col("at") < F.col("k")).alias("in_signature"))


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                    item_text: str = "text", policy: ContainmentPolicy = ContainmentPolicy()) -> DataFrame:
    """(key, item, n_item, n_found): every document and the items it contains at ``percent`` or more."""
    found = _found(docs, items, key, text, item, item_text, policy)
    best = F.max_by(F.struct("n_item", "n_found"), F.col("n_found") / F.col("n_item"))
    return found.groupBy("key", "item").agg(best.alias("b")).select(
        F.col("key").alias(key), F.col("item").alias(item), F.col("b.n_item").cast("long").alias("n_item"), F.col("b.n_found").alias("n_found"))


def _found(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str, policy: ContainmentPolicy) -> DataFrame:
    """(key, row, item, item_row, n_item, n_found); ``row`` are 128 bits of the text, which with the key name a document."""
    table = item_table(items, item, item_text, policy)
    word_hash = F.xxhash64(*[F.get(F.split("shingle", " "), F.lit(k)) for k in range(policy.words)])
    signature = table.where("in_signature").select(word_hash.alias("h")).distinct()
    words = docs.where(F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.unhex(F.md5(text)).alias("row"), _words(F.col(text)).alias("w"))
    hashed = words.withColumn("hashes", _shingles(F.col("w"), policy.words, False))
    hashes = [r[0] for r in signature.limit(policy.literal_hashes + 1).collect()]
    if len(hashes) <= policy.literal_hashes:
        # One constant, folded from text: thousands of single literals would burden every step of planning.
        literal = F.split(F.lit(",".join(map(str, hashes))), ",").cast("array<bigint>")
        candidates = hashed.where(F.arrays_overlap("hashes", literal) if hashes else F.lit(False)).select("key", "row", "w")
    else:
        met = hashed.select("key", "row", F.explode("hashes").alias("h")).join(signature, "h", "left_semi").select("key", "row").distinct()
        candidates = words.join(met, words.key.eqNullSafe(met.key) & (words.row == met.row), "left_semi")
    return (
        candidates.select("key", "row", F.explode(_shingles(F.col("w"), policy.words, True)).alias("shingle"))
        .join(table.select("item", "item_row", "n_item", "shingle"), "shingle")
        .groupBy("key", "row", "item", "item_row", "n_item").agg(F.count_distinct("shingle").alias("n_found"))
        .where(F.col("n_found") * 100 >= F.col("n_item") * policy.percent)
    )


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", policy: ContainmentPolicy = ContainmentPolicy()) -> DataFrame:
    """The documents that contain no item. Rows are named by id and text, so a null or repeated id takes no other row with it."""
    # Structs with null fields equal each other, so this is a plain equi-join.
    leaks = _found(docs, items, key, text, item, item_text, policy).select(
        F.struct(F.col("key").alias("id"), F.col("row").alias("tid")).alias("name")).distinct()
    # The row travels as one value: its columns may have any name.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(
        F.col(f"`{key}`").alias("id"), F.unhex(F.md5(F.col(f"`{text}`"))).alias("tid")).alias("name"))
    return rows.join(leaks, "name", "left_anti").select("row.*")
