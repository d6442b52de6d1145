"""Removal of long strings that occur twice: a column-wise Burrows-Wheeler transform over many short segments.

A string of ``length`` bytes has one anchor: the first of its windows of ``gram`` bytes with the smallest hash. Equal strings have
equal anchors at equal places, so a string can only repeat among the strings of its anchor. A document is thus a row of
segments, each holding the strings of one anchor; segments meet by anchor, equal segments are counted once, and what must be
compared are the different segments of one anchor.

These go, many anchors together, through the construction of their common Burrows-Wheeler transform: each round inserts one symbol
of every segment, from the last to the first, reading the transform from one file and writing the next. Every string runs
through its anchor, so suffixes that start behind one are never asked for: once the anchors are reached, the order of what follows
them is kept and the transform goes on with the symbols before them. The places of the inserted suffixes follow from the number of
equal symbols before them. When all rounds are done suffixes are in order, and the common prefixes of neighbours tell which
strings repeat. An anchor with very many different segments would be a task of its own: its strings are dealt out by their
own hash and counted instead, which is exact as well.

Texts count as UTF-8 bytes, null as none. Strings never reach over a document's end. Repeated rows repeat each other's bytes.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import map_texts, written

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


@dataclass(frozen=True)
class RepeatPolicy:
    """``length`` is the contract; the rest shapes the work: window of an anchor, segments of a bucket, of one anchor."""

    length: int = 200
    gram: int = 96
    bucket_segments: int = 3_000
    anchor_segments: int = 1_500
    block_bytes: int = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = np.full(n, _BASE), np.full(n, _BACK)
            for t in (self.up, self.down):
                t[0] = 1
                np.multiply.accumulate(t, out=t)
        return self.up, self.down


def segments(data: np.ndarray, policy: RepeatPolicy, powers: _Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, segment hash, first start, number of starts, anchor place) of every segment of one document."""
    n, k = len(data), policy.gram
    w = policy.length - k + 1
    starts = n - policy.length + 1
    if starts <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    up, down = powers.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=total[1:])
    grams = _mixed((total[k:] - total[:-k]) * down[:n - k + 1])
    # Smallest upper half of a hash in each window of w grams, the first of equals: minima of blocks from both sides.
    blocks = -(-len(grams) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(grams)] = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    ahead = np.minimum.accumulate(padded.reshape(blocks, w), axis=1).ravel()
    behind = np.minimum.accumulate(padded.reshape(blocks, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[:starts], ahead[w - 1:w - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    anchor = place[first]
    count = np.diff(np.append(first, starts))
    stop = first + count - 1 + policy.length
    whole = _mixed(_mixed((total[stop] - total[first]) * down[first]) ^ (anchor - first).astype(np.uint64) ^ (count.astype(np.uint64) << np.uint64(20)))
    return grams[anchor], whole, first, count, anchor


def column_wise_order(strings: list[np.ndarray], folder: str) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of the strings in order, as (string, start): one symbol of every string is inserted in each round.

    The transform lies in a file that each round reads from front to back while writing the next, and then removes: to write over it would
    make the file system wait for the disk. Symbol 0 is the border before a string; the ends of strings sort before every symbol, by string.
    """
    m = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    rounds = int(sizes.max()) if m else 0
    flat = np.concatenate(strings) if m else np.zeros(0, np.uint8)
    stop = np.cumsum(sizes)
    names = [os.path.join(folder, str(t)) for t in range(rounds + 1)]
    symbol = np.where(sizes > 0, flat[np.maximum(stop - 1, 0)] if len(flat) else 0, 0).astype(flat.dtype)
    symbol.tofile(names[0])
    place = np.arange(m, dtype=np.int64)  # of each string's newest suffix in the transform
    history = [(np.arange(m), place)]
    alive = np.flatnonzero(sizes > 0)
    for t in range(1, rounds + 1):
        bwt = np.fromfile(names[t - 1], flat.dtype)
        os.remove(names[t - 1])
        by_symbol = np.argsort(bwt, kind="stable")  # a radix sort: one pass for each byte of a symbol
        rank = np.empty(len(bwt), np.int64)
        rank[by_symbol] = np.arange(len(bwt))
        # Strings that are complete have the border symbol and no further suffix.
        new = m - np.count_nonzero(bwt == 0) + rank[place[alive]]
        before = np.where(sizes[alive] > t, flat[np.maximum(stop[alive] - t - 1, 0)], 0).astype(flat.dtype)
        order = np.argsort(new)
        spots = new[order] - np.arange(len(new))  # where np.insert counts places of the old array
        # Everything inserted before moves on by the number of new suffixes in front of it.
        np.insert(bwt, spots, before[order]).tofile(names[t])
        history.append((alive, new))
        place = place.copy()
        place[alive] = new
        alive = alive[sizes[alive] > t]
    os.remove(names[rounds])
    # Replay the moves once, from the last round back, to learn where every suffix ended.
    n = int(sizes.sum()) + m
    string, start = np.empty(n, np.int64), np.empty(n, np.int64)
    free = np.arange(n)
    for t in range(rounds, 0, -1):
        who, where = history[t]
        string[free[where]], start[free[where]] = who, sizes[who] - t
        free = np.delete(free, where)
    string[free], start[free] = np.arange(m), sizes
    return string, start


def anchored_order(parts: list[np.ndarray], anchors: list[int], at: list[int], gram: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """All starts up to the anchors of the segments in order, as (segment, start).

    Every string runs through its anchor, so no suffix that starts behind one is ever asked for. The construction goes from the ends of
    the segments to their anchors; from there on the order of what follows an anchor is all that is kept of it, as the order in
    which the strings before anchors end.
    """
    symbols = [p + np.uint8(1) for p in parts]  # UTF-8 has no byte 255
    behind, first = column_wise_order([s[x + gram:] for s, x in zip(symbols, at)], folder)
    number = {a: i for i, a in enumerate(dict.fromkeys(anchors))}
    ends = behind[first == 0]
    ends = ends[np.argsort([number[anchors[i]] for i in ends], kind="stable")]
    string, start = column_wise_order([symbols[i][:at[i]] for i in ends], folder)
    return ends[string], start


def repeated_starts(parts: list[np.ndarray], anchors: list[int], at: list[int], counts: list[int], policy: RepeatPolicy, folder: str) -> list[np.ndarray]:
    """For each segment of a bucket, which of its starts begin a string that another segment of the same anchor holds."""
    string, start = anchored_order(parts, anchors, at, policy.gram, folder)
    limit = np.array(counts)
    mine = start < limit[string]
    # Only starts of strings matter: neighbours among them, since all have the full length.
    string, start = string[mine], start[mine]
    begin = np.cumsum([0, *map(len, parts)])[:-1]
    flat = np.concatenate(parts)
    where = begin[string] + start
    same = np.zeros(len(string), bool)
    step = 20_000
    group = np.unique(anchors, return_inverse=True)[1][string]
    whole = np.lib.stride_tricks.sliding_window_view(flat, policy.length)
    short = np.lib.stride_tricks.sliding_window_view(flat, min(8, policy.length))
    for a in range(0, len(string) - 1, step):
        b = min(a + step, len(string) - 1)
        near = np.flatnonzero(group[a:b] == group[a + 1:b + 1]) + a
        # Many neighbours differ early: compare a few bytes first, then all of what is left.
        for view in (short, whole):
            near = near[(view[where[near]] == view[where[near + 1]]).all(1)]
        same[near] = True
    again = same.copy()
    again[1:] |= same[:-1]
    edge = np.cumsum([0, *counts])
    flags = np.zeros(edge[-1], bool)
    flags[edge[string[again]] + start[again]] = True
    return np.split(flags, edge[1:-1])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _segment_rows(docs: DataFrame, policy: RepeatPolicy) -> DataFrame:
    """(anchor, segment, row, first, n) of every segment of every document."""

    def run(batches):
        powers = _Powers()
        for batch in batches:
            out, rows, size = [], [], 0

            def flush():
                cols = [np.concatenate([o[k] for o in out]) for k in range(4)]
                made = [pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)),
                        pa.array(np.repeat(np.array(rows, np.int64), [len(o[0]) for o in out])), pa.array(cols[2]), pa.array(cols[3].astype(np.int32))]
                return pa.RecordBatch.from_arrays(made, names=["anchor", "segment", "row", "first", "n"])

            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = segments(_bytes(text), policy, powers)
                if len(found[0]):
                    out.append(found)
                    rows.append(row)
                    size += len(found[0])
                if size > 50_000:
                    yield flush()
                    out, rows, size = [], [], 0
            if out:
                yield flush()

    return docs.select("row", "text").mapInArrow(run, "anchor long, segment long, row long, first long, n int")


def repeated_ranges(docs: DataFrame, policy: RepeatPolicy = RepeatPolicy()) -> DataFrame:
    """(row, start, stop): byte ranges of (row, text) covered by strings that start twice or more; ranges may overlap."""
    often = F.count("*").over(W.partitionBy("anchor"))
    met = written(_segment_rows(docs, policy).withColumn("often", often).where("often > 1").drop("often"), "repeat-segments")
    kinds = met.groupBy("anchor", "segment").agg(F.count("*").alias("c"), F.min(F.struct("row", "first", "n")).alias("one"))
    kinds = written(kinds.select("anchor", "segment", "c", "one.row", "one.first", "one.n"), "repeat-kinds")
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("c").alias("least")).where("kinds > 1 and least = 1")
    open_ = kinds.join(groups.select("anchor", "kinds"), "anchor")

    # The bytes of the segments that must be compared.
    spots = open_.groupBy("row").agg(F.collect_list(F.struct("anchor", "segment", "first", "n", "c", "kinds")).alias("spots"))

    def cut(batches):
        powers = _Powers()
        for batch in batches:
            rows = {k: [] for k in ("anchor", "segment", "at", "n", "c", "kinds", "bytes")}
            for text, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = _bytes(text)
                _, _, first, _, anchor = segments(data, policy, powers)
                for s in spots:
                    rows["at"].append(int(anchor[np.searchsorted(first, s["first"])]) - s["first"])
                    rows["bytes"].append(data[s["first"]:s["first"] + s["n"] - 1 + policy.length].tobytes())
                    for k in ("anchor", "segment", "n", "c", "kinds"):
                        rows[k].append(s[k])
                    if len(rows["n"]) >= 20_000:
                        yield pa.RecordBatch.from_pydict(rows, schema=target)
                        rows = {k: [] for k in rows}
            yield pa.RecordBatch.from_pydict(rows, schema=target)

    target = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("c", pa.int64()),
                        ("kinds", pa.int64()), ("bytes", pa.binary())])
    cuts = docs.join(spots, "row").select("text", "spots").mapInArrow(
        cut, "anchor long, segment long, at int, n int, c long, kinds long, bytes binary")
    # Rows that repeat are cut twice; one of them is enough.
    cuts = written(cuts.dropDuplicates(["anchor", "segment"]), "repeat-cuts")

    few = cuts.where(F.col("kinds") <= policy.anchor_segments)
    buckets = max(1, -(-few.count() // policy.bucket_segments))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(b, np.uint8) for b in group["bytes"]]
        with tempfile.TemporaryDirectory() as folder:
            again = repeated_starts(parts, group["anchor"].tolist(), group["at"].tolist(), group["n"].tolist(), policy, folder)
        rows = [(a, s, x, y) for a, s, flags in zip(group["anchor"], group["segment"], again) for x, y in _runs(flags)]
        return pd.DataFrame(rows, columns=["anchor", "segment", "a", "b"]).astype("int64")

    compared = few.where("n > 0").groupBy(F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket")).applyInPandas(
        compare, "anchor long, segment long, a long, b long")

    # Anchors with very many segments: every string is counted by its hash, in 128 bits.
    def strings(batches):
        import xxhash

        for batch in batches:
            for anchor, segment, n, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                keys = [xxhash.xxh3_128_digest(data[i:i + policy.length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * n, pa.int64()), pa.array([segment] * n, pa.int64()),
                                                  pa.array(range(n), pa.int64()), pa.array(keys, pa.binary())], names=["anchor", "segment", "a", "key"])

    many = cuts.where(F.col("kinds") > policy.anchor_segments)
    pieces = many.select("anchor", "segment", "n", "bytes").mapInArrow(strings, "anchor long, segment long, a long, key binary")
    twice = pieces.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    counted = pieces.join(twice, "key").select("anchor", "segment", "a", (F.col("a") + 1).alias("b"))

    whole = kinds.where("c > 1").select("anchor", "segment", F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("b"))
    # A segment that occurs twice is covered whole; the others as far as they were found.
    single = compared.unionByName(counted).join(kinds.where("c > 1").select("anchor", "segment"), ["anchor", "segment"], "left_anti")
    found = written(whole.unionByName(single), "repeat-found")
    return met.join(found, ["anchor", "segment"]).select(
        "row", (F.col("first") + F.col("a")).alias("start"), (F.col("first") + F.col("b") - 1 + policy.length).alias("stop"))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", policy: RepeatPolicy = RepeatPolicy(), with_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row, with ``kept`` (the bytes that stay) on request."""
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("row"))
    ranges = repeated_ranges(docs.select("row", "text"), policy).groupBy("row").agg(
        F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    # A range list is bounded by its document's length. Rows that repeat share their key and get the same list.
    joined = docs.join(ranges, "row", "left")

    def make():
        def work(texts, starts, stops):
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))}
            for t, a, b in zip(texts, starts, stops):
                data = _bytes(t)
                edge = np.zeros(len(data) + 1, np.int64)
                if a:
                    np.add.at(edge, np.array(a), 1)
                    np.add.at(edge, np.array(b), -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = data[~gone].tobytes()
                values = [len(data), int(gone.sum()), len(_runs(gone)), sha256(kept).hexdigest(), kept]
                for k, v in zip(out, values):
                    out[k].append(v)
            return out

        return work

    made = map_texts(joined, ["text", "starts", "stops"],
                     "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text, make, ("key",))
    return made.withColumnRenamed("key", key)
