"""Hard-negative mining: exact integer scores by Strassen's recursion, kept in mergeable heaps.

Each component becomes ``floor(scale * x)`` (x as double) and a score is the integer inner product with the anchor. Scores of a tile
of anchors and a tile of candidates come from one Strassen product of int64 matrices, padded with zeros to even halves; its sums
and differences are exact (and modulo 2**64 even where an intermediate one is too large), so no score is rounded.

Two passes read the candidates, and together they multiply each anchor with each candidate once:

1. candidates of the anchor's label go into its positive heap (the best ``positives``);
2. candidates of other labels go into a window heap for each positive: the best ``negatives`` of those whose score lies
   between ``window_percent`` percent of the positive's score and that score.

A task keeps the heaps of all its candidates and sends at most their size; heaps of tasks are merged by a ranked window
whose bound is known before the shuffle. Anchors are the query set: they are dealt by hash into blocks of ``block_bytes``, whose size is
checked before a block travels to the tasks, so neither the candidates nor unbounded anchors are ever shuffled, paired as rows or
broadcast. A table with more anchors takes more blocks, each reading the candidates again.

Rows with a null label, a null vector, or a null, NaN or infinite component take no part; nor do rows whose squared length after
the floor is 2**56 or more, since their scores do not fit a long. Vectors of different lengths are filled up with zeros. An
anchor never meets a row of its own id, and a pair of id and score counts once in a heap, so repeated rows change nothing; anchors that share
an id but not label or vector are mined each for itself. Null ids are never anchors and come after all others in ties. A
negative positive score leaves its window empty. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

#: Stands for a null id: it loses every tie.
NO_ID = np.iinfo(np.int64).max
_LOW = np.iinfo(np.int64).min


@dataclass(frozen=True)
class MiningPolicy:
    """What is mined (first four), and the sizes that shape the work but never a result."""

    scale: int = 256
    positives: int = 5
    negatives: int = 5
    window_percent: int = 80
    block_bytes: int = 32 << 20
    anchor_tile: int = 256
    candidate_tile: int = 4096
    leaf: int = 16


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 16) -> np.ndarray:
    """The product of int64 matrices (m, k) and (k, n) of any shape, by seven products of halves where all sides exceed ``leaf``."""
    (m, k), n = a.shape, b.shape[1]
    levels = 0
    while min(m, k, n) >> (levels + 1) >= leaf:
        levels += 1
    step = 1 << levels
    pad = [(-s) % step for s in (m, k, n)]
    if any(pad):
        a = np.pad(a, ((0, pad[0]), (0, pad[1])))
        b = np.pad(b.T, ((0, pad[2]), (0, pad[1]))).T
    return _halves(a, b, levels)[:m, :n]


def _halves(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return a @ b
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = _halves(a11 + a22, b11 + b22, levels - 1)
    p2 = _halves(a21 + a22, b11, levels - 1)
    p3 = _halves(a11, b12 - b22, levels - 1)
    p4 = _halves(a22, b21 - b11, levels - 1)
    p5 = _halves(a11 + a12, b22, levels - 1)
    p6 = _halves(a21 - a11, b11 + b12, levels - 1)
    p7 = _halves(a12 - a22, b21 + b22, levels - 1)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out


class TopHeaps:
    """The best ``size`` (score, id) pairs of each of ``count`` heaps: higher scores first, then smaller ids; repeats count once.

    A heap is a row of two arrays in order, so two states merge by putting their pairs together, and its last entry bounds
    what can still enter.
    """

    def __init__(self, count: int, size: int):
        self.size = size
        self.score = np.full((count, size), _LOW, np.int64)
        self.id = np.full((count, size), NO_ID, np.int64)
        self.full = np.zeros(count, bool)
        self.n = np.zeros(count, np.int64)

    def may_enter(self, heaps: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of ``scores`` (heap x candidate) could still enter; ``heaps`` are the rows' heaps."""
        last, last_id = self.score[heaps, -1][:, None], self.id[heaps, -1][:, None]
        return ~self.full[heaps][:, None] | (scores > last) | ((scores == last) & (ids[None, :] < last_id))

    def push(self, heap: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(heap):
            return
        met = np.unique(heap)
        held = np.arange(self.size)[None, :] < self.n[met][:, None]
        heap = np.concatenate([np.repeat(met, self.n[met]), heap])
        score = np.concatenate([self.score[met][held], score])
        id_ = np.concatenate([self.id[met][held], id_])
        order = np.lexsort((id_, ~score, heap))  # ~x turns the order of int64 around without overflow
        heap, score, id_ = heap[order], score[order], id_[order]
        new = np.ones(len(heap), bool)
        new[1:] = (heap[1:] != heap[:-1]) | (score[1:] != score[:-1]) | (id_[1:] != id_[:-1])
        heap, score, id_ = heap[new], score[new], id_[new]
        first = np.searchsorted(heap, met)
        at = np.arange(len(heap)) - first[np.searchsorted(met, heap)]
        best = at < self.size
        self.score[met], self.id[met] = _LOW, NO_ID
        self.score[heap[best], at[best]], self.id[heap[best], at[best]] = score[best], id_[best]
        self.n[met] = np.minimum(np.diff(np.append(first, len(heap))), self.size)
        self.full[met] = self.n[met] == self.size

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(heap, score, id) of all that is held."""
        heap, at = np.nonzero(np.arange(self.size)[None, :] < self.n[:, None])
        return heap, self.score[heap, at], self.id[heap, at]


def _matrix(vectors: pa.Array, least: int = 0) -> np.ndarray:
    """Rows of a list<long> array as a matrix, filled up with zeros to the longest (``least`` at least)."""
    values, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    width = max(int(sizes.max()) if len(sizes) else 0, least, 1)
    if len(sizes) and (sizes == width).all():
        return values[offsets[0]:offsets[-1]].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    inside = np.arange(width)[None, :] < sizes[:, None]
    out[inside] = values[offsets[0]:offsets[-1]]
    return out


@dataclass
class AnchorBlock:
    """Anchors in order of label; ``at`` is an anchor's number."""

    at: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> "AnchorBlock":
        table = table.combine_chunks()
        labels = table["label"].to_numpy()
        order = np.argsort(labels, kind="stable")
        vectors = table["q"].chunk(0) if table.num_rows else pa.array([], pa.list_(pa.int64()))
        return AnchorBlock(table["at"].to_numpy()[order], table["id"].to_numpy()[order], labels[order], _matrix(vectors)[order])

    def tiles(self, size: int):
        """Ranges of anchors of one label."""
        kinds, starts = np.unique(self.labels, return_index=True)
        for label, a, b in zip(kinds, starts, np.append(starts[1:], len(self.labels))):
            for first in range(int(a), int(b), size):
                yield label, first, min(first + size, int(b))


def _candidate_tiles(batch: pa.RecordBatch, size: int, width: int):
    """(ids, labels, matrix) of bounded size, each in order of label."""
    for first in range(0, batch.num_rows, size):
        part = batch.slice(first, size)
        labels = part.column(1).to_numpy(zero_copy_only=False)
        order = np.argsort(labels, kind="stable")
        ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        yield ids[order], labels[order], _matrix(part.column(2), width)[order]


def _scores(anchors: np.ndarray, candidates: np.ndarray, leaf: int) -> np.ndarray:
    short = candidates.shape[1] - anchors.shape[1]
    return strassen(np.pad(anchors, ((0, 0), (0, short))) if short else anchors, candidates.T, leaf)


def mine_positives(block: AnchorBlock, tiles, policy: MiningPolicy) -> TopHeaps:
    """The positive heaps of a block over some candidate tiles."""
    heaps = TopHeaps(len(block.at), policy.positives)
    for ids, labels, matrix in tiles:
        for label, a, b in block.tiles(policy.anchor_tile):
            lo, hi = np.searchsorted(labels, label, "left"), np.searchsorted(labels, label, "right")
            if lo == hi:
                continue
            score = _scores(block.vectors[a:b], matrix[lo:hi], policy.leaf)
            rows = np.arange(a, b)
            good = heaps.may_enter(rows, score, ids[lo:hi]) & (ids[None, lo:hi] != block.ids[a:b, None])
            i, j = np.nonzero(good)
            heaps.push(rows[i], score[i, j], ids[lo:hi][j])
    return heaps


def mine_negatives(block: AnchorBlock, positive: np.ndarray, n_positive: np.ndarray, tiles, policy: MiningPolicy) -> TopHeaps:
    """The window heaps (anchor x positive) of a block over some candidate tiles; ``positive`` holds the scores in order."""
    size = policy.positives
    heaps = TopHeaps(len(block.at) * size, policy.negatives)
    # percent * p <= 100 * s is s >= ceil(percent * p / 100); with p below zero no s is between.
    low = -((-policy.window_percent * positive) // 100)
    for ids, labels, matrix in tiles:
        for label, a, b in block.tiles(policy.anchor_tile):
            other = labels != label
            if not other.any():
                continue
            score, names = _scores(block.vectors[a:b], matrix[other], policy.leaf), ids[other]
            rows = np.arange(a, b)
            for k in range(size):
                heap = rows * size + k
                inside = (score >= low[a:b, k, None]) & (score <= positive[a:b, k, None]) & (n_positive[a:b, None] > k)
                if not inside.any():
                    continue
                i, j = np.nonzero(inside & heaps.may_enter(heap, score, names))
                heaps.push(heap[i], score[i, j], names[j])
    return heaps


def usable_rows(df: DataFrame, key: str, vector: str, label: str | Column, policy: MiningPolicy) -> DataFrame:
    """(id, label, q): the rows that take part, with their integer vectors."""
    label = F.col(label) if isinstance(label, str) else label
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(policy.scale)) * x.cast("double")))
    squares = F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.lit(float(policy.scale)) * x.cast("double")).cast("double"), F.lit(2.0)))
    # A null component makes the sum null, NaN and infinity make it fail the comparison.
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return df.where(label.isNotNull() & F.col(vector).isNotNull()).where(finite).where(squares < float(2**56)).select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("q"))


def hard_negatives(df: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
                   policy: MiningPolicy = MiningPolicy()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchors`` is a condition on ``df``.

    Ids and labels are integers. Counts the anchors and runs two jobs for each block of them when called.
    """
    rows = usable_rows(df, key, vector, label, policy)
    chosen = usable_rows(df.where(anchors), key, vector, label, policy).where("id is not null").distinct()
    numbered = written(chosen.withColumn("at", F.monotonically_increasing_id()), "anchors")
    size = numbered.agg(F.coalesce(F.sum(F.size("q") * 8 + 64), F.lit(0)).alias("b"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("w"),
                        F.count("*").alias("n")).first()
    # Rows are as wide as the longest, and a block is aimed at half its bound, so that uneven dealing stays below it.
    blocks = max(1, -(-2 * size["n"] * (size["w"] * 8 + 64) // policy.block_bytes))
    parts = [_mined(rows, numbered.where(F.pmod(F.xxhash64("at"), F.lit(blocks)) == k), policy) for k in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _ranked(df: DataFrame, by: list[str], most: int, rank: str) -> DataFrame:
    """Merge heaps: the best ``most`` of each group; the bound reaches the map side, so tasks send no more than their heaps."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id"))
    # Two tasks may hold the same pair, for repeated rows: it has one dense rank and stays once.
    return df.withColumn(rank, F.dense_rank().over(order)).where(F.col(rank) <= most).dropDuplicates([*by, rank])


def _mined(rows: DataFrame, anchors: DataFrame, policy: MiningPolicy) -> DataFrame:
    spark = rows.sparkSession
    block = AnchorBlock.of(anchors.toArrow())
    if block.vectors.nbytes > policy.block_bytes:
        raise ValueError("a block of anchors is larger than its bound; raise block_bytes")
    shared = spark.sparkContext.broadcast((block.at, block.ids, block.labels, block.vectors))

    def tiles(batches, width):
        for batch in batches:
            yield from _candidate_tiles(batch, policy.candidate_tile, width)

    def positives(batches):
        own = AnchorBlock(*shared.value)
        heap, score, id_ = mine_positives(own, tiles(batches, own.vectors.shape[1]), policy).entries()
        yield pa.RecordBatch.from_arrays([pa.array(own.at[heap]), pa.array(score), pa.array(id_)], names=["at", "score", "id"])

    found = rows.mapInArrow(positives, "at long, score long, id long")
    best = written(_ranked(found, ["at"], policy.positives, "k"), "positives").toArrow()
    n, size = len(block.at), policy.positives
    score, name, held = np.zeros((n, size), np.int64), np.zeros((n, size), np.int64), np.zeros(n, np.int64)
    place = np.argsort(block.at)
    i = place[np.searchsorted(block.at[place], best["at"].to_numpy())] if best.num_rows else np.zeros(0, np.int64)
    k = best["k"].to_numpy().astype(np.int64) - 1
    score[i, k], name[i, k] = best["score"].to_numpy(), best["id"].to_numpy()
    np.add.at(held, i, 1)
    windows = spark.sparkContext.broadcast((score, name, held))
    schema = "at long, k int, anchor_id long, positive_id long, positive_score long, score long, id long"

    def negatives(batches):
        own = AnchorBlock(*shared.value)
        positive, names, count = windows.value
        heap, got, id_ = mine_negatives(own, positive, count, tiles(batches, own.vectors.shape[1]), policy).entries()
        a, k = heap // size, heap % size
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.at[a]), pa.array(k.astype(np.int32)), pa.array(own.ids[a]), pa.array(names[a, k]), pa.array(positive[a, k]),
             pa.array(got), pa.array(id_)], names=["at", "k", "anchor_id", "positive_id", "positive_score", "score", "id"])

    found = rows.mapInArrow(negatives, schema)
    null_if_none = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c)).alias
    return _ranked(found, ["at", "k"], policy.negatives, "rank").select(
        "anchor_id", null_if_none("positive_id")("positive_id"), F.col("rank").cast("int").alias("rank"),
        null_if_none("id")("negative_id"), "positive_score", F.col("score").alias("negative_score"))
