"""Packing token ids into sequences of bounded length by patterns of few documents.

1. Every text is encoded once, an end id is added, and what is longer than a sequence is cut (the first piece takes the remainder).
   Pieces are written with their ids, the task that made them and their number among its pieces of the same length.
2. The histogram of lengths, one count for each length, is all that reaches the driver. Patterns, pairs and triples of lengths
   that fill a sequence (all but ``waste`` of it), are enumerated; how often to repeat each is fitted to the histogram by non-negative least squares
   (accelerated projected gradient on a set of columns that grows by those with the steepest descent), rounded, and bounded by
   what is left of each length. The fit is repeated on what remains, and the residual is packed by best fit, longest first, on
   counts as well, after the fit that leaves the fewest sequences. The work depends on the length of a sequence, not on the number of documents.
3. A piece's rank among all of its length is its task's base plus its number; the rank falls into one slot range of the plan, which
   gives sequence and offset by division. No window ever holds the pieces of a length: bases are running totals over tasks.

Null and empty texts are the end id alone. Every row is a document of its own, so repeated rows and ids are packed each; a null id stays
null. Only key and text are read. An empty table has no pieces and no sequences.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import text_slices
from .orc_tokens import library_encoder


@dataclass(frozen=True)
class PackPolicy:
    """``max_tokens`` is the contract; the rest shapes the fit."""

    max_tokens: int = 1024
    columns: int = 1024
    rounds: int = 10
    steps: int = 300
    refits: int = 6
    waste: float = 1 / 64
    #: (power of the length that weighs what is left, what is added before counts are cut to whole numbers)
    weightings: tuple[tuple[float, float], ...] = ((2, 0.0), (4, 0.5))


def cut_sizes(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, length) of the pieces of documents of these sizes; only the first piece may be shorter than ``most``."""
    pieces = -(-sizes // most)
    document = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(document)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return document, piece, np.where(piece == 0, sizes[document] - (pieces[document] - 1) * most, most)


def _numbered(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The number of each length among its equals, going on from ``seen``, which is brought up to date."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    first = np.searchsorted(ordered, ordered, "left")
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(lengths)) - first
    out += seen[lengths]
    seen += np.bincount(lengths, minlength=len(seen))
    return out


def write_pieces(df: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
                 policy: PackPolicy = PackPolicy()) -> None:
    """Write (key, piece, start, length, ids, part, nth) as Parquet; ``ids`` are little-endian unsigned 32-bit integers."""
    key_type, most = df.schema[key].dataType.simpleString(), policy.max_tokens

    def encode(batches):
        from pyspark import TaskContext

        encoder, part, seen = library_encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_slices(texts):
                flat, counts = encoder(texts[a:b])
                flat = np.insert(flat.astype("<u4"), np.cumsum(counts), end_id)
                document, piece, length = cut_sizes(counts + 1, most)
                stops = np.concatenate([[0], np.cumsum(length)])
                first = np.concatenate([[0], np.cumsum(counts + 1)])
                ids = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer((stops * 4).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a).take(pa.array(document)), pa.array(piece, pa.int32()), pa.array(stops[:-1] - first[document], pa.int64()),
                    pa.array(length, pa.int64()), ids, pa.array(np.full(len(length), part), pa.int32()), pa.array(_numbered(length, seen))],
                    names=[key, "piece", "start", "length", "ids", "part", "nth"])

    schema = f"`{key}` {key_type}, piece int, start long, length long, ids binary, part int, nth long"
    df.select(f"`{key}`", f"`{text}`").mapInArrow(encode, schema).write.parquet(path)


# The plan, from the histogram alone.

def full_patterns(lengths: np.ndarray, most: int, waste: int = 0) -> np.ndarray:
    """Pairs and triples of the given lengths that leave at most ``waste`` of ``most``, as rows in descending order; pairs end with 0.

    Each pair comes with the longest third length that still fits, if any does.
    """
    small = np.unique(lengths[lengths > 0])
    if not len(small):
        return np.zeros((0, 3), np.int64)
    below = np.zeros(most + 1, np.int64)
    below[small] = small
    np.maximum.accumulate(below, out=below)
    found = []
    for b in small[2 * small <= most].tolist():
        a = small[(small >= b) & (small <= most - b)]
        c = below[np.minimum(most - a - b, b)]
        good = a + b + c >= most - waste
        found.append(np.stack([a[good], np.full(int(good.sum()), b), c[good]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _fit(patterns: np.ndarray, x: np.ndarray, wanted: np.ndarray, weight: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative x that brings the lengths the patterns use near to ``wanted``, by accelerated projected gradient."""
    slots, flat = patterns.shape[1], patterns.ravel()

    def used(v):
        return np.bincount(flat, np.repeat(v, slots), len(wanted))

    def back(r):
        return (weight * r)[patterns].sum(1)

    v = np.ones(len(patterns))
    top = 1.0
    for _ in range(20):
        v = back(used(v))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(y - back(used(y) - wanted) / (1.02 * top), 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        # Momentum that points uphill is dropped.
        t, y = (1.0, new) if ((y - new) * (new - x)).sum() > 0 else (u, new + (t - 1) / u * (new - x))
        x = new
    return x


def fitted_counts(patterns: np.ndarray, wanted: np.ndarray, power: float, policy: PackPolicy) -> np.ndarray:
    """How often each pattern should be repeated. Columns enter by the steepest descent, so few patterns get a count."""
    # Long documents have few partners: what is left of them is dearest.
    weight = (np.arange(len(wanted)) / max(1, len(wanted) - 1)) ** power
    weight[0] = 0
    chosen = np.zeros(len(patterns), bool)
    x = np.zeros(len(patterns))
    for _ in range(policy.rounds):
        used = np.bincount(patterns.ravel(), np.repeat(x, patterns.shape[1]), len(wanted))
        slope = (weight * (used - wanted))[patterns].sum(1)
        slope[chosen] = 0
        new = np.argsort(slope, kind="stable")[:policy.columns]
        new = new[slope[new] < 0]
        if not len(new):
            break
        chosen[new] = True
        at = np.flatnonzero(chosen)
        x[at] = _fit(patterns[at], x[at], wanted, weight, policy.steps)
        chosen &= x > 0
    return x


def _best_fit(left: np.ndarray, most: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first, on counts: [([(length, copies), ...], sequences), ...] that hold all of ``left``."""
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    spaces = np.zeros(most + 1, bool)

    def put(space, contents, count):
        if count:
            open_.setdefault(space, []).append((contents, count))
            spaces[space] = True

    for length in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[length])
        while todo:
            room = np.flatnonzero(spaces[length:])
            space = length + int(room[0]) if len(room) else most
            contents, count = open_[space].pop() if len(room) else ([], todo)
            if len(room) and not open_[space]:
                spaces[space] = False
            copies = space // length
            full = min(count, todo // copies)
            put(space - copies * length, [*contents, (length, copies)], full)
            todo, count = todo - full * copies, count - full
            if todo and count:
                put(space - todo * length, [*contents, (length, todo)], 1)
                todo, count = 0, count - 1
            if len(room):
                put(space, contents, count)
    return [group for groups in open_.values() for group in groups]


def pattern_plan(histogram: np.ndarray, policy: PackPolicy = PackPolicy()) -> list[tuple[list[tuple[int, int]], int]]:
    """[([(length, copies), ...], sequences), ...] for a histogram of lengths 0 to ``max_tokens``.

    For each weighting of ``policy`` fits follow each other on what the last one left. Any of them may be the last before the residual
    is packed: the plan with the fewest sequences stays, the earliest of equals.
    """
    most, rest = policy.max_tokens, histogram.astype(np.int64).copy()
    whole = [([(most, 1)], int(rest[most]))] if rest[most] else []
    rest[most] = rest[0] = 0
    best: tuple[int, list] | None = None
    for power, rounding in policy.weightings:
        left, plan = rest.copy(), []
        for _ in range(policy.refits):
            patterns = full_patterns(np.flatnonzero(left), most, int(most * policy.waste))
            placed = []
            if len(patterns):
                x = fitted_counts(patterns, left.astype(float), power, policy)
                for k in np.argsort(-x, kind="stable").tolist():
                    if x[k] + rounding < 1:
                        break
                    kinds, copies = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
                    count = int(min(np.floor(x[k] + rounding), (left[kinds] // copies).min()))
                    if count:
                        left[kinds] -= count * copies
                        placed.append((list(zip(kinds.tolist(), copies.tolist())), count))
            plan = plan + placed
            full = plan + _best_fit(left, most)
            total = sum(count for _, count in full)
            if best is None or total < best[0]:
                best = total, full
            if not placed:
                break
    return whole + best[1]


@dataclass
class Slots:
    """Ranges of ranks of each length and where they go, in order of (length, first rank)."""

    key: np.ndarray
    sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray

    BITS = 44

    @staticmethod
    def of(plan: list[tuple[list[tuple[int, int]], int]], most: int) -> "Slots":
        at, sequence, rows = np.zeros(most + 1, np.int64), 0, []
        for contents, count in plan:
            offset = 0
            for length, copies in contents:
                rows.append(((length << Slots.BITS) + int(at[length]), sequence, copies, offset))
                at[length] += count * copies
                offset += length * copies
            sequence += count
        rows.sort()
        return Slots(*(np.array(c, np.int64) for c in (zip(*rows) if rows else ([], [], [], []))))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and rank."""
        k = np.searchsorted(self.key, (length << Slots.BITS) + rank, "right") - 1
        nth = (length << Slots.BITS) + rank - self.key[k]
        return self.sequence[k] + nth // self.copies[k], self.offset[k] + nth % self.copies[k] * length


def pack_pieces(pieces: DataFrame, key: str = "doc_id", payload: tuple[str, ...] = ("ids",), policy: PackPolicy = PackPolicy()) -> DataFrame:
    """(key, piece, start, length, *payload, sequence_id, offset) of written pieces; plans, from their counts, when called.

    The payload travels with its piece, so name no more of it than is wanted.
    """
    counts = pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    histogram = np.zeros(policy.max_tokens + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row for each length at most
        histogram[length] = n
    slots = Slots.of(pattern_plan(histogram, policy), policy.max_tokens)
    # One row for each task and length.
    base = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    names = [key, "piece", "start", "length", *payload]
    schema = StructType([*(pieces.schema[c] for c in names), StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches):
        for batch in batches:
            sequence, offset = slots.place(batch.column(3).to_numpy(), batch.column(len(names)).to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(sequence), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    ranked = pieces.join(base, ["part", "length"]).select(*[F.col(f"`{c}`") for c in names], (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, schema)


def sequences(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, documents): the packed sequences and what lies in them; a group holds ``max_tokens`` ids at most."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", F.col(key).alias("id"), "piece", "ids")))
    packed = pieces.groupBy("sequence_id").agg(inside.alias("p"))
    return packed.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
                         F.transform("p", lambda x: F.struct(x["id"].alias(key), x["piece"].alias("piece"), x["offset"].alias("offset"),
                                                             x["length"].alias("length"))).alias("documents"))
