"""Jaccard self-join of documents on word n-grams, through prefix trees.

Sets. A document's set holds the hashes of its distinct n-grams. Documents with equal sets are one class and only classes are
joined. All sets share one order: n-grams met often within a stretch of the input ("heavy", a bounded list from all
documents, which only shapes the order) come last, the others by hash.

Heads. A class posts the n-grams in the first part of that order (hashes below a fixed share), or all of them where the head
is too small for the prefix rule. A linked partner has all but ``p - 1`` of them, so a class with ``p`` or more postings nobody
else has can have no partner and leaves. What is left joins in two steps:

1. Each class points at the smallest class among its sharers with which it shares most postings. Groups of this forest are
   brought together in blocks of bounded text. In a block the whole sets are stored in a trie and each path is followed once
   with a vector of partial overlaps with all other sets; sets with a common start share that part of the walk, and a
   subtree is left when no set can reach its needed overlap in the length that remains.
2. Pairs of different components and blocks meet by prefixes: a class puts its open postings in one global order, rarest
   first, and posts only so many that a linked partner cannot lack them all, counting as passed those that nobody outside
   shares. A meeting counts if enough postings are left behind it on both sides, since the first meeting of a linked pair
   has them (pairs inside the largest block of a posting are never formed). Pairs whose heads then have the overlap that a
   link forces on them are compared exactly.

Every link between different texts lies inside a component or is found in step 2, so components are exact.

Null texts and texts without words have the empty set and no links. Repeated rows are one class. ``component_id`` is the
smallest document id reachable; null ids take part and are reported only if nothing else is reachable.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, map_texts, text_slices, written
from .components import connected_components

_UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SEED = np.uint64(0xD1B54A32D192ED03)


@dataclass(frozen=True)
class JoinPolicy:
    """Link when 100 * intersection >= percent * union. The rest shapes the work, never the result."""

    width: int = 4
    percent: int = 85
    head_share: float = 0.24
    heavy_share: float = 0.001
    heavy_least: int = 8
    heavy_most: int = 100_000
    block_chars: int = 4_000_000

    def missing(self, n: int) -> int:
        """Most n-grams of a set of ``n`` that a linked partner may lack."""
        return n - -(-self.percent * n // 100)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams; a text of fewer words has one, of its whole sequence."""
    data = [(t or "").encode("utf-8", "surrogatepass").translate(_UPPER) for t in texts]
    lengths = np.array([len(d) + 1 for d in data], np.int64)
    stops = np.cumsum(lengths)
    b = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    word = np.concatenate([[False], ~blank, [False]])
    first, last = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    last, first = last[: len(first)], first
    steps = np.ones(len(b) + 1, np.uint64)
    steps[1:] = _BASE
    np.multiply.accumulate(steps, out=steps)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * steps[:-1], dtype=np.uint64, out=total[1:])
    # Dividing by the power of the start makes equal words equal wherever they stand; the inverse powers are made alike.
    steps[0], steps[1:] = 1, _BACK
    np.multiply.accumulate(steps, out=steps)
    words = _mixed((total[last] - total[first]) * steps[first])
    bounds = np.searchsorted(first, np.concatenate([[0], stops]))
    grams = np.zeros(0, np.uint64)
    if len(words) >= width:
        grams = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            grams = _mixed(grams * _BASE + words[k:len(words) - width + 1 + k])
    out = []
    for a, z in zip(bounds[:-1], bounds[1:]):
        if z - a >= width:
            out.append(np.unique(grams[a:z - width + 1]))
        elif z > a:
            h = np.array([_SEED + np.uint64(z - a)])
            for w in words[a:z]:
                h = _mixed(h * _BASE + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def heavy_grams(docs: DataFrame, text: str, policy: JoinPolicy) -> np.ndarray:
    """N-grams that a stretch of the input (about a million n-grams) holds often, over all documents; a bounded list."""

    def count(batches):
        sets: list[np.ndarray] = []
        seen: set[bytes] = set()
        size = 0

        def often():
            grams, n = np.unique(np.concatenate(sets), return_counts=True)
            top = n >= max(policy.heavy_least, policy.heavy_share * len(sets))
            return pa.RecordBatch.from_arrays([pa.array(_signed(grams[top])), pa.array(n[top].astype(np.int64))], names=["gram", "n"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in text_slices(texts):
                for s in shingle_sets(texts[a:b], policy.width):
                    key = blake2b(s.tobytes(), digest_size=8).digest()
                    if len(s) and key not in seen:
                        seen.add(key)
                        sets.append(s)
                        size += len(s)
                        if size > 2_000_000:
                            yield often()
                            sets, size = [], 0
                            seen.clear()
        if sets:
            yield often()

    rows = (
        docs.where(F.col(text).isNotNull()).select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "gram").limit(policy.heavy_most).toPandas()
    )
    return np.sort(rows["gram"].to_numpy(np.int64).view(np.uint64))


def text_name(text: str) -> Column:
    """128 bits of a text: with the id it names a row, since ids may be null or repeated."""
    return F.unhex(F.md5(F.col(f"`{text}`")))


def document_sets(docs: DataFrame, heavy: np.ndarray, key: str, text: str, policy: JoinPolicy) -> DataFrame:
    """(key, tid, digest, cid, n, p, whole, core, head): the class of each document and what it posts.

    ``p`` is how many n-grams a partner may lack, ``whole`` tells that the head is the whole set. The first ``core`` n-grams are
    those of the head proper, which is all that a partner whose head is not whole can share.
    """
    limit = np.uint64(int(policy.head_share * 2**64))
    named = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text), text_name(text).alias("tid"))

    def make():
        def work(texts):
            out = {k: [] for k in ("digest", "cid", "n", "p", "whole", "core", "head")}
            for s in shingle_sets(texts, policy.width):
                n = len(s)
                digest = blake2b(s.tobytes(), digest_size=16).digest() if n else None
                missing = policy.missing(n)
                head = s[:np.searchsorted(s, limit)]
                if len(heavy):
                    head = head[heavy[np.minimum(np.searchsorted(heavy, head), len(heavy) - 1)] != head]
                whole, core = len(head) <= missing, len(head)
                if whole:
                    head = np.concatenate([head, np.setdiff1d(s, head, assume_unique=True)])
                for k, v in zip(out, (digest, int.from_bytes(digest[:8], "big", signed=True) if n else None, n, missing, whole, core,
                                      _signed(head))):
                    out[k].append(v)
            return out

        return work

    return map_texts(named, [text], "digest binary, cid long, n long, p long, whole boolean, core int, head array<long>", make, (key, "tid"))


def overlap_links(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j > i that link with it) by one walk over the trie of all sets; a caller unites them as they come."""
    m = len(sets)
    if m < 2:
        return
    sizes = np.array(list(map(len, sets)), np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    kinds, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    # Most shared first: sets with much in common then have long common paths. Ties go by hash.
    rank = np.empty(len(kinds), np.int64)
    rank[np.lexsort((kinds, -count))] = np.arange(len(kinds))
    code = rank[code]
    by_code = np.argsort(code, kind="stable")
    holders = owner[by_code]
    at = np.searchsorted(code[by_code], np.arange(len(kinds) + 1))
    starts = np.cumsum(sizes) - sizes
    paths = [np.sort(code[a:a + n]) for a, n in zip(starts, sizes)]
    order = sorted(range(m), key=lambda i: paths[i].astype(">u8").tobytes())
    lcp = [0] * (m + 1)
    for k in range(1, m):
        a, b = paths[order[k - 1]], paths[order[k]]
        short = min(len(a), len(b))
        differ = np.flatnonzero(a[:short] != b[:short])
        lcp[k] = int(differ[0]) if len(differ) else short
    saved: list[tuple[int, np.ndarray]] = [(0, np.zeros(m, np.int64))]
    for k, i in enumerate(order):
        while saved[-1][0] > lcp[k]:
            saved.pop()
        depth, overlap = saved[-1][0], saved[-1][1].copy()
        # Depths at which later paths leave this one.
        stops, low = [], sizes[i] + 1
        for later in range(k + 1, m):
            if lcp[later] < low:
                low = lcp[later]
                stops.append(low)
            if low <= depth:
                break
        wanted = set(stops)
        need = -(-percent * (sizes[i] + sizes) // (100 + percent))
        path, n = paths[i], int(sizes[i])
        far = True
        while depth < n:
            t = path[depth]
            overlap[holders[at[t]:at[t + 1]]] += 1
            depth += 1
            if depth in wanted:
                saved.append((depth, overlap.copy()))
            if depth % 16 == 0:
                open_ = overlap + (n - depth) >= need
                open_[i] = False
                if not open_.any():
                    far = False
                    break
        if far:
            good = np.flatnonzero(overlap >= need)
            if good[-1] > i:
                yield i, good[good > i]


def _pair_links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _groups(docs: DataFrame, key: str, text: str, policy: JoinPolicy) -> DataFrame:
    """(key, tid, n_shingles, g): every row with its group, null where the set is empty."""
    scratch = Scratch()
    rows = scratch.write(document_sets(docs, heavy_grams(docs, text, policy), key, text, policy), "ngram-sets")
    # A class is read again by one of its rows, named by id and text.
    classes = rows.where("digest is not null").groupBy("digest").agg(
        F.min(F.struct(F.col(key).alias("id"), "tid")).alias("first"), *[F.first(c).alias(c) for c in ("cid", "n", "p", "whole", "core", "head")])
    classes = scratch.write(classes, "ngram-classes")
    # Heads are read from the classes from here on; of the rows only their names stay.
    named = scratch.write(rows.select(key, "tid", "digest", F.col("n").alias("n_shingles")), "ngram-rows")
    scratch.drop(rows)
    links = _links(docs, classes, key, text, policy)
    label = connected_components(links)
    scratch.drop(classes)
    members = named.join(
        label.select(F.col("node").alias("digest"), "component"), "digest", "left")
    return members.select(key, "tid", "n_shingles", F.coalesce("component", "digest").alias("g"))


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", policy: JoinPolicy = JoinPolicy()) -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``docs``."""
    members = _groups(docs, key, text, policy)
    # Documents of one component may be a third of all: the minimum is combined before its shuffle, and the way back is a join.
    first = members.where("g is not null").groupBy("g").agg(F.min(key).alias("component_id"))
    joined = members.join(first, "g", "left")
    return joined.select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id"))


def _links(docs: DataFrame, classes: DataFrame, key: str, text: str, policy: JoinPolicy) -> DataFrame:
    """(a, b): digests of linked classes, at least enough of them to give the right components."""
    scratch = Scratch()
    posts = classes.select("cid", "core", F.posexplode("head").alias("at", "gram")).select("cid", "gram", (F.col("at") < F.col("core")).alias("core"))
    shared = posts.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram")
    met = posts.join(shared, "gram")
    # N-grams of the head proper are seen in every partner's postings, so the rule may count those that nobody shares.
    seen = met.groupBy("cid").agg(F.count("*").alias("n_met"))
    alive = classes.join(seen, "cid").where(
        F.col("whole") | (F.size("head") - F.col("n_met") <= F.col("p")))
    alive = scratch.write(alive.select("cid", "digest", "first", "n", "p", "whole", F.size("head").alias("h")), "ngram-alive")
    met = scratch.write(met.join(alive.select("cid"), "cid", "left_semi"), "ngram-met")

    # Step 1: the forest of best sharers.
    least = met.groupBy("gram").agg(F.min("cid").alias("hub"))
    votes = met.join(least, "gram").where("hub < cid").groupBy("cid", "hub").agg(F.count("*").alias("votes"))
    best = votes.groupBy("cid").agg(F.max_by("hub", F.struct("votes", "hub")).alias("hub"))
    forest = connected_components(best.select(F.col("cid").alias("a"), F.col("hub").alias("b")))
    source = docs.where(F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{key}`").alias("id"), text_name(text).alias("tid"), F.col(f"`{text}`").alias("text"), F.length(f"`{text}`").alias("chars"))
    bodies = scratch.write(_bodies(source, alive), "ngram-bodies")
    grouped = bodies.join(forest.withColumnRenamed("node", "cid"), "cid")
    blocks = grouped.groupBy("component").agg(F.ceil(F.sum("chars") / policy.block_chars).cast("int").alias("blocks"))
    placed = grouped.join(blocks, "component")
    # The root of a large group is a member of each of its blocks.
    every = F.when(F.col("cid") == F.col("component"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")))
    width, percent = policy.width, policy.percent

    def block_links(group: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets(group["text"].tolist(), width)
        names = group["digest"].tolist()
        root = list(range(len(names)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, linked in overlap_links(sets, percent):
            for j in linked.tolist():
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
        star = [(names[i], names[find(i)]) for i in range(len(names)) if find(i) != i]
        return pd.DataFrame(star, columns=["a", "b"])

    near = scratch.write(
        placed.select("component", F.explode(every).alias("block"), "digest", "text").groupBy("component", "block")
        .applyInPandas(block_links, "a binary, b binary"), "ngram-links")

    # Step 2: what still shares postings across components. ``r`` is what a link forces a class to share with its partner:
    # all but p of its head; of a whole set that holds only if the partner posts its whole set too.
    label = connected_components(near)
    part = F.conv(F.substring(F.hex(F.coalesce("component", "digest")), 1, 16), 16, -10).cast("long")
    facts = alive.join(label.withColumnRenamed("node", "digest"), "digest", "left").select(
        "cid", part.alias("comp"), "n", "whole", (F.col("h") - F.col("p")).alias("r"))
    # A block has compared all its pairs, so only pairs of different blocks and different components are left.
    block = placed.select("cid", F.xxhash64("component", F.get(every, F.lit(0))).alias("block"))
    facts = facts.join(block, "cid", "left").select("cid", "comp", "n", "whole", "r", F.coalesce("block", "cid").alias("part"))
    tagged, read = met.join(facts, "cid"), met
    for _ in range(2):
        # A class goes if fewer of its postings than a link forces are shared outside its component. Twice, since those
        # that went leave others alone.
        mixed = tagged.groupBy("gram").agg(
            F.count("*").alias("m"),
            *[f(c).alias(f"{c}_{n}") for c in ("part", "comp") for n, f in (("lo", F.min), ("hi", F.max))]).where(
            "part_lo < part_hi and comp_lo < comp_hi").select("gram", "m")
        tagged = scratch.write(tagged.drop("m").join(mixed, "gram"), "ngram-mixed")
        scratch.drop(read)
        enough = tagged.groupBy("cid").agg(
            F.count("*").alias("k"), F.first("r").alias("r"), F.first("whole").alias("whole"), F.max("core").alias("core")).where(
            "k >= r or (whole and core)").select("cid")
        read, tagged = tagged, scratch.write(tagged.join(enough, "cid", "left_semi"), "ngram-tagged")
        scratch.drop(read)
        read = tagged
    # Rarest first; ``own`` counts the postings from this one on, ``other`` those of the head proper, which is what a partner of
    # the other kind can meet. The order is that of the last count, the same for all, so the prefix rule holds.
    down = Window.partitionBy("cid").orderBy(F.desc("m"), F.desc("gram"))
    so_far = F.sum(F.col("core").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = tagged.select("*", F.row_number().over(down).alias("own"), F.when(F.col("core"), so_far).otherwise(0).alias("other"))
    prefix = scratch.write(ranked.where("own >= r or (whole and core)").drop("core", "m"), "ngram-prefix")
    scratch.drop(tagged)
    sizes = prefix.groupBy("gram", "part").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("gram").agg(F.count("*").alias("parts"), F.max_by("part", F.struct("k", "part")).alias("largest")).where("parts > 1")
    mixed = prefix.join(largest.select("gram", "largest"), "gram")
    facts = ("cid", "n", "whole", "r", "own", "other", "part", "comp")
    right = mixed.select("gram", *[F.col(c).alias(f"{c}2") for c in facts], (F.col("part") == F.col("largest")).alias("big"))
    left = mixed.where("part <> largest").select("gram", *facts)
    pairs = left.join(right, "gram").where(
        f"part <> part2 and comp <> comp2 and (big or cid < cid2) and 100 * least(n, n2) >= {policy.percent} * greatest(n, n2)"
        " and case when whole = whole2 then least(own, own2) >= greatest(r, r2) else least(other, other2) >= if(whole, r2, r) end")
    pairs = pairs.select(F.least("cid", "cid2").alias("c1"), F.greatest("cid", "cid2").alias("c2")).distinct()
    heads = classes.select("cid", "whole", (F.size("head") - F.col("p")).alias("r"), "head")
    for side in "12":
        pairs = pairs.join(heads.select(*[F.col(c).alias(f"{c[0]}{side}") for c in heads.columns]), f"c{side}")
    forced = F.when(F.col("w1") == F.col("w2"), F.greatest("r1", "r2")).otherwise(F.when(F.col("w1"), F.col("r2")).otherwise(F.col("r1")))
    pairs = pairs.where(F.size(F.array_intersect("h1", "h2")) >= forced).select("c1", "c2")
    name = alive.select("cid", "digest")
    pairs = pairs.join(name.select(F.col("cid").alias("c1"), F.col("digest").alias("a")), "c1").join(
        name.select(F.col("cid").alias("c2"), F.col("digest").alias("b")), "c2").select("a", "b")
    texts = bodies.select("digest", "text")
    both = pairs.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("t1")), "a").join(
        texts.select(F.col("digest").alias("b"), F.col("text").alias("t2")), "b")

    def make():
        return lambda one, two: {"linked": [_pair_links(x, y, percent) for x, y in zip(shingle_sets(one, width), shingle_sets(two, width))]}

    exact = map_texts(both, ["t1", "t2"], "linked boolean", make, ("a", "b")).where("linked").select("a", "b")
    # Read by the caller, so written beside what is dropped here.
    links = written(near.unionByName(exact), "ngram-all-links")
    scratch.drop()
    return links


def _bodies(source: DataFrame, alive: DataFrame) -> DataFrame:
    """(cid, digest, text, chars): one text of every class that is left, met by the id and text of the row that stands for it."""
    wanted = alive.select(F.col("first.id").alias("want"), F.col("first.tid").alias("tid"), "cid", "digest")
    met = source.join(wanted, (source["tid"] == wanted["tid"]) & source["id"].eqNullSafe(wanted["want"]))
    return met.select("cid", "digest", "text", "chars").dropDuplicates(["digest"])


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", policy: JoinPolicy = JoinPolicy()) -> DataFrame:
    """One row of every component, one with the smallest id (null ids last, then by text); rows without words all stay.

    Rows are named by id and text, so null and repeated ids are documents of their own; of rows equal in both one stays.
    """
    members = _groups(docs, key, text, policy).where("g is not null")
    name = F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("id"), F.col("tid"))
    winners = members.groupBy("g").agg(F.min(name).alias("name")).select("name")
    # The row travels as one value: its columns may have any name.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(
        F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("id"), text_name(text).alias("tid")).alias("name"),
        F.coalesce(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    kept = rows.where("worded").join(winners, "name", "left_semi").dropDuplicates(["name"])
    return kept.select("row").unionByName(rows.where("not worded").select("row")).select("row.*")
