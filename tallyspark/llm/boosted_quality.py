"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from one pass over the texts. Labelled rows are joined to the statistics, never to the texts, and a bounded
sample of them (``BoostPolicy.max_rows``, picked by the hash of the id) is fitted with numpy. The trees are flattened into
arrays (feature, threshold bin, children, leaf value), so that scoring a batch is a few numpy steps for each level.

Null and empty texts get the statistics of the empty text and a score like any other. Rows of the label table that repeat
count as often as they occur; null labels teach nothing. Without any usable label every score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import map_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STATISTICS = (
    "log_words", "mean_word", "sd_word", "letters", "upper", "digits", "blanks", "symbols", "punctuation", "pipes", "exclaims",
    "distinct", "top_word", "top_pair", "same_as_before", "dup_lines", "words_per_line", "symbol_ends", "no_letter_words",
    "zstd", "long_words", "capital_words",
)
#: A character is of the first kind that matches it; the first two separate words.
KINDS = {name: re.compile(pattern, re.DOTALL) for name, pattern in {
    "blanks": r"[ \n\t]", "other_blanks": r"[\r\x0B\x0C]", "upper": r"[A-ZÀ-ÖØ-Þ]", "letters": r"[^\W\d_]", "digits": r"[0-9]", "pipes": r"\|",
    "symbols": r"[#*$%&<>{}\[\]\\^~=+@_/]", "exclaims": r"!", "punctuation": r"[.,;:?'\"()-]", "others": r"."}.items()}


@dataclass(frozen=True)
class BoostPolicy:
    """``max_rows`` bounds the labelled rows that are fitted; the rest are the usual boosting parameters."""

    max_rows: int = 20_000
    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    l2: float = 1.0
    min_rows: int = 5


def _characters(codes: np.ndarray, wanted: Callable[[str], list]) -> np.ndarray:
    """What ``wanted`` says of each character, given once for all different ones."""
    points = np.flatnonzero(np.bincount(codes))
    table = np.zeros(int(points[-1]) + 1 if len(points) else 0, np.int8)
    table[points] = wanted("".join(map(chr, points.tolist())))
    return table[codes]


def _kinds(characters: str) -> list[int]:
    return [next(k for k, pattern in enumerate(KINDS.values()) if pattern.match(c)) for c in characters]


def _distinct_and_top(doc: np.ndarray, value: np.ndarray, values: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """By document, the number of its different values and how often the commonest occurs."""
    keys, counts = np.unique(doc * values + value, return_counts=True)
    owner = keys // values
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, owner, counts)
    return np.bincount(owner, minlength=docs), top


def text_statistics(texts: list[str | None], compress) -> np.ndarray:
    """A row for each text with a value for each name in STATISTICS; shares are of characters, words or lines.

    Texts are laid end to end as code points, so that a few numpy steps serve them all; words are numbered by Arrow.
    """
    texts, docs = [t or "" for t in texts], len(texts)
    data = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, docs)
    stop = np.cumsum(sizes)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _characters(codes, _kinds)
    kinds = np.bincount(np.repeat(np.arange(docs) * len(KINDS), sizes) + kind, minlength=docs * len(KINDS)).reshape(docs, len(KINDS))
    count, numbers = dict(zip(KINDS, kinds.T)), {name: i for i, name in enumerate(KINDS)}

    # Words: stretches without blanks that never cross the end of a text.
    inside = np.append(kind > 1, False)
    ends_before = np.append(True, ~inside[:-1])
    ends_before[stop - sizes] = True
    ends_after = ~inside[1:]
    ends_after[stop[sizes > 0] - 1] = True
    first, last = np.flatnonzero(inside & ends_before), np.flatnonzero(inside[:-1] & ends_after)
    doc = np.searchsorted(stop, first, "right")
    n_words = np.bincount(doc, minlength=docs)
    k = np.maximum(n_words, 1)
    length = (last - first + 1).astype(np.float64)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc, flags, docs) / k

    mean = np.bincount(doc, length, docs) / k
    squares, edge = (length - mean[doc])**2, np.cumsum([0, *n_words])
    variance = np.array([squares[a:b].sum() for a, b in zip(edge, edge[1:])]) / k
    capital = _characters(codes[first], lambda cs: [c.isupper() for c in cs])
    symbol_end = _characters(codes[last], lambda cs: [not c.isalnum() and c not in ".,;:!?'\")" for c in cs])
    letter = (kind == numbers["upper"]) | (kind == numbers["letters"])
    no_letter = ~np.logical_or.reduceat(letter, first) if len(first) else np.zeros(0, bool)  # blanks up to the next word are no letters

    trimmed = pc.ascii_trim_whitespace(pa.array(data, pa.large_string()))  # a blank at either end would make an empty word
    words = pc.ascii_split_whitespace(trimmed.filter(pc.not_equal(trimmed, ""))).flatten().dictionary_encode()
    word, values = words.indices.to_numpy().astype(np.int64), max(len(words.dictionary), 1)
    distinct, top_word = _distinct_and_top(doc, word, values, docs)
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    _, top_pair = _distinct_and_top(doc[inner], word[inner] * values + word[inner + 1], values**2, docs)
    same_as_before = np.bincount(doc[inner], word[inner] == word[inner + 1], docs)

    lines = [[x for x in t.split("\n") if WORD.search(x)] for t in texts]
    n_lines = np.fromiter(map(len, lines), np.int64, docs)
    own_lines = np.fromiter((len(set(x)) for x in lines), np.int64, docs)
    n, some_lines = np.maximum(sizes, 1), np.maximum(n_lines, 1)
    zstd = np.array([len(compress(x)) / max(len(x), 1) for x in data])
    made = {
        "log_words": np.log1p(n_words), "mean_word": mean, "sd_word": np.sqrt(variance), "letters": (count["upper"] + count["letters"]) / n,
        "upper": count["upper"] / n, "digits": count["digits"] / n, "blanks": count["blanks"] / n, "symbols": (count["symbols"] + count["pipes"]) / n,
        "punctuation": (count["punctuation"] + count["exclaims"]) / n, "pipes": count["pipes"] / n, "exclaims": count["exclaims"] / n,
        "distinct": distinct / k, "top_word": top_word / k, "top_pair": top_pair / k, "same_as_before": same_as_before / k,
        "dup_lines": np.where(n_lines > 0, 1 - own_lines / some_lines, 0.0), "words_per_line": n_words / some_lines,
        "symbol_ends": share(symbol_end), "no_letter_words": share(no_letter), "zstd": zstd, "long_words": share(length > 12),
        "capital_words": share(capital),
    }
    return np.stack([made[x] for x in STATISTICS], 1)


def statistics(text: str | None, compress) -> list[float]:
    """The statistics of one text."""
    return text_statistics([text], compress)[0].tolist()


def document_statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``stats`` array<double>, in the order of STATISTICS."""

    def make():
        import zstandard

        compress = zstandard.ZstdCompressor(level=1).compress
        return lambda texts: {"stats": text_statistics(texts, compress).tolist()}

    return map_texts(df, [text], "stats array<double>", make, keep)


@dataclass
class BoostedTrees:
    """Flattened trees: node ``i`` of tree ``t`` has children ``2i+1`` and ``2i+2``; leaves repeat downwards as feature -1."""

    edges: list[np.ndarray]  # by feature: upper edges of its bins
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes: bins up to this one go left
    value: np.ndarray  # trees x nodes of the last level
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        codes, rows = self.binned(np.nan_to_num(x)), np.arange(len(x))
        total = np.full(len(x), self.base)
        depth = int(np.log2(self.feature.shape[1] + 1)) if self.feature.size else 0
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                f = feature[node]
                node = 2 * node + 1 + (codes[rows, np.maximum(f, 0)] > cut[node])
            total += value[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, policy: BoostPolicy = BoostPolicy()) -> BoostedTrees:
    """Second-order boosting on binned features, level by level; all nodes of a level share one histogram pass."""
    n, m = x.shape if x.ndim == 2 else (0, len(STATISTICS))
    empty = BoostedTrees([np.zeros(0)] * m, np.zeros((0, 0), int), np.zeros((0, 0), int), np.zeros((0, 1)), 0.0)
    if not n:
        return empty
    x = np.nan_to_num(x)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, policy.bins + 1)[1:-1])) for j in range(m)]
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = BoostedTrees(edges, empty.feature, empty.cut, empty.value, float(np.log(share / (1 - share))))
    codes = model.binned(x)
    inner, leaves, bins = 2**policy.depth - 1, 2**policy.depth, policy.bins
    flat = codes + np.arange(m) * bins
    raw = np.full(n, model.base)
    features, cuts, values = [], [], []
    for _ in range(policy.trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut, node = np.full(inner, -1), np.full(inner, bins), np.zeros(n, np.int64)
        for level in range(policy.depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (m * bins) + flat).ravel()
            hist = [np.bincount(key, np.repeat(w, m), width * m * bins).reshape(width, m, bins).cumsum(2) for w in (g, h, np.ones(n))]
            gl, hl, cl = hist
            gt, ht, ct = (v[:, :, -1:] for v in hist)
            gain = gl**2 / (hl + policy.l2) + (gt - gl)**2 / (ht - hl + policy.l2) - gt**2 / (ht + policy.l2)
            gain[(cl < policy.min_rows) | (ct - cl < policy.min_rows)] = -1
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                if gain[k].ravel()[best[k]] > 1e-9:
                    feature[first + k], cut[first + k] = divmod(best[k], bins)
            f = feature[node]
            node = 2 * node + 1 + (codes[np.arange(n), np.maximum(f, 0)] > cut[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        value = -policy.rate * gs / (hs + policy.l2)
        raw += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    model.feature, model.cut, model.value = np.array(features), np.array(cuts), np.array(values)
    return model


def fit_quality(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality",
                policy: BoostPolicy = BoostPolicy()) -> BoostedTrees:
    """Fit on at most ``policy.max_rows`` labelled rows, those with the smallest hash of their key."""
    known = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("__key"), F.col(label).cast("double").alias("__y"))
    rows = (
        stats.select(F.col(key).alias("__key"), "stats").join(known, "__key")
        .orderBy(F.xxhash64("__key"), "__key", "__y", "stats").limit(policy.max_rows).select("stats", "__y").toPandas()
    )
    return fit_trees(np.array(rows["stats"].tolist(), np.float64), rows["__y"].to_numpy(np.float64), policy)


def score_quality(stats: DataFrame, model: BoostedTrees, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score``: how likely label 1 is."""

    def make():
        return lambda rows: {"score": model.score(np.array(rows, np.float64).reshape(len(rows), -1)).tolist()}

    return map_texts(stats, ["stats"], "score double", make, keep)
