"""Similarity self-join of texts on word shingles, and groups of linked rows.

Texts with equal shingle sets are one class, and only classes are joined. First a class posts only the smallest hashes of its set, three
tenths of them as a rule, and unless enough of these are posted by other classes too, it has no partner and leaves; most classes never
pass more than that. The rest list their shingles from rare to frequent; of two classes that link at Jaccard ``percent``, both must hold a
common shingle among their first ``n - ceil(percent * n) + 1``. Shingles that only one class holds are the rarest of all, so a class with
enough of them has no partner and leaves before any pair is formed.

Pairs that meet in such a shingle are bounded by length and by the two positions, and what is left is counted on the whole sets. Large
groups of near copies are settled in rounds: as long as many pairs are open, each class meets one hub for each shingle, and only
classes that are not yet in one group meet each other afterwards, so the rows of the join follow the links that are still to be
found, not the square of a group. The posts of a frequent shingle are dealt over salted parts on one side and repeated for these parts on the other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage


@dataclass(frozen=True)
class SimilarityPolicy:
    """Linked when 100 * intersection >= percent * union. The rest shapes the work, never the result: rounds of hubs end
    early once no more than ``linear`` pairs for each post are left, or a round settles less than half of them; ``extra`` percent of a
    set are posted beyond the least that can be; up to ``broadcast_ids`` row numbers are broadcast to pick rows, and
    up to ``broadcast_sets`` sets of ``broadcast_shingles`` in all to compare others with."""

    width: int = 5
    percent: int = 80
    rounds: int = 6
    linear: int = 4
    part_rows: int = 2_000
    extra: int = 10
    broadcast_ids: int = 1_000_000
    broadcast_sets: int = 50_000
    broadcast_shingles: int = 4_000_000


_POST = ("d", "n", "pos", "g")


def shingle_set(words: Column, width: int) -> Column:
    """Sorted hashes of the distinct shingles; fewer words than a shingle count as one, their set; no words give an empty array."""
    def made(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        short = F.array(F.xxhash64(F.lit("short"), F.array_join(F.array_sort(F.array_distinct(w)), " ")))
        return F.when(F.size(w) >= width, F.array_sort(F.array_distinct(runs))).when(F.size(w) > 0, short).otherwise(
            F.array().cast("array<bigint>"))

    # Bound by an outer lambda, the words are split once and not for every shingle.
    return F.get(F.transform(F.array(F.coalesce(words, F.array().cast("array<string>"))), made), F.lit(0))


def set_digest(shingles: Column) -> Column:
    """128 bits that name a shingle set."""
    return F.unhex(F.substring(F.sha2(F.array_join(F.transform(shingles, lambda x: x.cast("string")), ","), 256), 1, 32))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b); the component is the smallest node.

    A node takes the smallest label near it and then that label's label, so long chains shrink fast. Rounds are written tables, and
    the driver sees whether anything changed.
    """
    ways = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component"))
    labels = cut_lineage(labels)
    while True:
        seen = ways.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        step = labels.join(seen, "node").select("node", F.col("component").alias("was"), F.least("component", "seen").alias("via"))
        hop = step.select(F.col("node").alias("via"), F.col("via").alias("hop"))
        step = cut_lineage(step.join(hop, "via", "left").select("node", "was", F.least("via", "hop").alias("component")))
        labels = step.select("node", "component")
        if step.where("was <> component").isEmpty():
            return labels


def _pick(rows: DataFrame, ids: DataFrame, policy: SimilarityPolicy, how: str = "left_semi") -> DataFrame:
    """The rows whose ``d`` is (left_anti: is not) in ``ids``. So long as these are few, the rows stay where they are."""
    return rows.join(F.broadcast(ids) if ids.count() <= policy.broadcast_ids else ids, "d", how)


def _shared(posts: DataFrame) -> DataFrame:
    """The posts of shingles that two classes or more hold, with their number ``c``. One shuffle; a class posts a shingle once, so the most
    frequent one has a row of each class, and all have hundreds."""
    from pyspark.sql import Window as W

    return posts.withColumn("c", F.count(F.lit(1)).over(W.partitionBy("h")).cast("int")).where("c > 1")


def _with_partners(classes: DataFrame, policy: SimilarityPolicy) -> DataFrame:
    """(d) of classes (d, s) that may link, judged by the smallest hashes of their sets.

    A set of n may miss n - ceil(percent * n) of its shingles in a partner. So of its first n - ceil(percent * n) + 1 + k at least k + 1 are
    in the partner, and if these end before the partner's do, they are among the partner's first too; else the same holds the
    other way round. A partner has ceil(percent * n) shingles or more, and k grows with n, so k of that size is what a class must share.
    """
    def least(n: str) -> str:
        return f"(({policy.percent} * ({n}) + 99) div 100)"

    def beyond(n: str) -> str:
        return f"least(({policy.extra} * ({n})) div 100, {least(n)} - 1)"

    sized = classes.select("d", "s", F.size("s").alias("n"))
    first = F.expr(f"slice(s, 1, cast(n - {least('n')} + 1 + {beyond('n')} as int))")
    posts = sized.select("d", F.expr(f"cast({beyond(least('n'))} + 1 as int)").alias("need"), F.explode(first).alias("h"))
    return _shared(posts).groupBy("d", "need").agg(F.count(F.lit(1)).alias("m")).where("m >= need").select("d")


def _prefixes(classes: DataFrame, policy: SimilarityPolicy) -> DataFrame:
    """(h, d, n, pos): the shingles by which a class can meet its partners; ``pos`` counts from its rarest."""
    from pyspark.sql import Window as W

    mine = W.partitionBy("d")  # one text's shingles
    met = _shared(classes.select("d", "n", F.explode("s").alias("h"))).select(
        "*", (F.col("n") - F.count(F.lit(1)).over(mine)).alias("alone"), F.row_number().over(mine.orderBy("c", "h")).alias("r"))
    spare = F.col("n") - F.ceil(F.col("n") * policy.percent / 100)
    return met.where(F.col("alone") + F.col("r") <= spare + 1).select(
        "h", "d", "n", (F.col("alone") + F.col("r") - 1).alias("pos"))


def _possible(policy: SimilarityPolicy) -> str:
    """Length and position bounds of a pair (d, n, pos) and (d2, n2, pos2) that holds a shingle in common."""
    need = f"({policy.percent} * (n + n2) + {99 + policy.percent}) div {100 + policy.percent}"
    most = "least(pos, pos2) + 1 + least(n - pos, n2 - pos2) - 1"
    return f"100 * least(n, n2) >= {policy.percent} * greatest(n, n2) and {most} >= {need}"


def _verified(pairs: DataFrame, classes: DataFrame, policy: SimilarityPolicy) -> DataFrame:
    """The pairs (a, b) that link, counted on the whole sets.

    The sets with most pairs, hubs and texts around one passage, come by broadcast, ``broadcast_shingles`` in all at most. The other side of such a
    pair is passed once, however many pairs it has, so that only pairs of two sets with few pairs carry a set each.
    """
    from pyspark.sql import Window as W

    pairs = cut_lineage(pairs)
    degrees = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("k")))
    sets = _pick(classes, degrees.select("d"), policy).select("d", "n", "s")
    often = sets.select("d", "n").join(degrees.where("k > 1"), "d").orderBy(F.desc("k"), "d").limit(policy.broadcast_sets)
    upto = F.sum("n").over(W.orderBy(F.desc("k"), "d").rowsBetween(W.unboundedPreceding, 0))  # over broadcast_sets rows at most
    heavy = F.broadcast(cut_lineage(often.withColumn("upto", upto).where(F.col("upto") <= policy.broadcast_shingles).select("d")))
    for x in "ab":
        pairs = pairs.join(heavy.select(F.col("d").alias(x), F.lit(True).alias(f"h{x}")), x, "left")
    turned = "hb is null and ha is not null"
    pairs = pairs.selectExpr(f"if({turned}, b, a) as x", f"if({turned}, a, b) as y", "ha is not null or hb is not null as known")

    def named(frame: DataFrame, x: str) -> DataFrame:
        return frame.select(F.col("d").alias(x), F.col("s").alias(f"s_{x}"))

    known = pairs.where("known").join(named(sets, "x"), "x").join(F.broadcast(named(classes.join(heavy, "d"), "y")), "y")
    rest = pairs.where("not known").join(named(sets, "x"), "x").join(named(sets, "y"), "y")
    both = F.size(F.array_intersect("s_x", "s_y"))
    linked = 100 * both >= policy.percent * (F.size("s_x") + F.size("s_y") - both)
    return known.unionByName(rest).where(linked).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_classes(classes: DataFrame, policy: SimilarityPolicy = SimilarityPolicy()) -> DataFrame:
    """(a, b) links of classes (d, n, s): all that matter, so that components of the links are the groups of the whole join."""
    posts = cut_lineage(_prefixes(classes, policy))
    links = None

    def labelled() -> DataFrame:
        if links is None:  # each class is a group of its own
            return posts.withColumn("g", F.col("d"))
        groups = connected_components(links).withColumnRenamed("node", "d")
        return posts.join(groups, "d", "left").withColumn("g", F.coalesce("component", "d")).drop("component")

    few, turn, before = policy.linear * posts.count(), 0, None
    while True:
        now = cut_lineage(labelled()) if turn else labelled()
        mixed = now.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high")
        left = mixed.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()[0]
        if not left:
            return links if links is not None else posts.select(F.col("d").alias("a"), F.col("d").alias("b")).limit(0)
        last = turn == policy.rounds or left <= few or (before is not None and 2 * left > before)
        before = left
        if last:
            parts = now.join(mixed.select("h", F.ceil(F.col("m") / policy.part_rows).cast("int").alias("parts")), "h")
            one = parts.withColumn("part", F.pmod(F.xxhash64("d"), F.col("parts").cast("long")).cast("int")).drop("parts")
            two = parts.select("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"{c}2") for c in _POST])
            pairs = one.join(two, ["h", "part"]).where("d < d2")
        else:
            # Another hub each round: the first by a hash that the round changes.
            hubs = now.groupBy("h").agg(F.min_by(F.struct(*[F.col(c).alias(f"{c}2") for c in _POST]), F.xxhash64("d", F.lit(turn))).alias("hub"))
            pairs = now.join(hubs.select("h", "hub.*"), "h")
        pairs = pairs.where(f"g <> g2 and {_possible(policy)}").select(F.least("d", "d2").alias("a"), F.greatest("d", "d2").alias("b")).distinct()
        found = _verified(pairs, classes, policy)
        links = cut_lineage(found if links is None else links.unionByName(found).distinct())
        if last:
            return links
        turn += 1


def similar_groups(rows: DataFrame, words: Column, also: Column | None = None, policy: SimilarityPolicy = SimilarityPolicy()) -> DataFrame:
    """``rows`` (but for a column ``__words``) with ``__group``: rows whose shingle sets link, directly or through others, or that agree in ``also``, share it.

    Rows without words share a group only by ``also``; without it each of them has a null group.
    """
    kept = [c for c in rows.columns if c != "__words"]
    sets = rows.select(*kept, shingle_set(words, policy.width).alias("__s"), (F.lit(None).cast("binary") if also is None else also).alias("__also"))
    sets = sets.withColumn("__d", F.when(F.size("__s") > 0, set_digest(F.col("__s"))))
    sets = cut_lineage(sets.withColumn("__row", F.monotonically_increasing_id()))
    # A class goes by the number of its first row, whose set is read where it was written.
    rows_of = sets.where("__d is not null").select("__d", F.col("__row").alias("d"))
    names = cut_lineage(rows_of.groupBy("__d").agg(F.min("d").alias("first"), F.count(F.lit(1)).alias("m")))
    copies = cut_lineage(rows_of.join(names.where("m > 1").select("__d", "first"), "__d").where("d <> first").select("d"))
    every = _pick(sets.where("__d is not null").select(F.col("__row").alias("d"), F.col("__s").alias("s")), copies, policy, "left_anti")
    able = cut_lineage(_with_partners(every, policy))
    classes = cut_lineage(_pick(every, able, policy).select("d", F.size("s").alias("n"), "s"))
    edges = similar_classes(classes, policy)
    for x in "ab":
        edges = edges.join(names.select(F.col("first").alias(x), F.col("__d").alias(f"__{x}")), x)
    edges = edges.select(F.col("__a").alias("a"), F.col("__b").alias("b"))
    sets = sets.drop("__s")
    if also is not None:
        # Sets under one other name are tied to the smallest of them; equal rows are combined before the shuffle.
        both = sets.where("__d is not null and __also is not null").select("__d", "__also").distinct()
        least = both.groupBy("__also").agg(F.min("__d").alias("a"), F.max("__d").alias("high")).where("a <> high").select("__also", "a")
        edges = edges.unionByName(both.join(least, "__also").where("__d <> a").select("a", F.col("__d").alias("b")))
    groups = connected_components(edges)
    # The name that can be a third of all rows is looked up once for each distinct name.
    own = F.coalesce("__d", "__also")
    named = sets.select(own.alias("node")).where("node is not null").distinct().join(groups, "node", "left").select(
        "node", F.coalesce("component", "node").alias("__group"))
    return sets.withColumn("node", own).join(named, "node", "left").select(*kept, "__group")
