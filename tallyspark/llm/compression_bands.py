"""Quality rules from zstandard ratios: a band of allowed ratios for each length.

Repetitive text compresses too well, random text too badly, and both limits move with the length because a short
text gives the compressor little to refer back to. The whole document is judged by the band of its length; fixed
chunks are judged one by one, the last of them laid back from the end, so every byte is in a chunk. Odd chunks reject a
document by their share of its bytes or by an unbroken run: a repetitive or random stretch of three chunks (6 KB) less one
byte holds two whole chunks wherever it lies, and is found although the whole looks normal. A text shorter than a chunk is
one chunk, judged by the band of its length.

Null and empty texts have no words, ratio 0 and fail the base rule. Texts below the first band (128 bytes) are too short
for a ratio to mean anything and pass this rule. Repeated rows are judged alike, each in its own row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class BandPolicy:
    """(from bytes on, lowest, highest ratio) by whole length; chunk size, its band, the share of a text's bytes that odd chunks
    may cover, and the bytes of consecutive odd chunks from which on a text is rejected."""

    bands: tuple[tuple[int, float, float], ...] = field(default=(
        (0, 0.0, float("inf")), (128, 0.45, 1.05), (256, 0.43, 0.92), (512, 0.40, 0.85), (1024, 0.36, 0.80),
        (2048, 0.34, 0.75), (4096, 0.32, 0.72), (8192, 0.31, 0.70), (16384, 0.28, 0.70)))
    chunk_bytes: int = 2048
    chunk_band: tuple[float, float] = (0.34, 0.75)
    odd_chunk_share: float = 0.25
    odd_run_bytes: int = 4096
    level: int = 3


def repeated_window_words(words: list[str], width: int = 8) -> int:
    """Words inside ``width``-word windows that occur twice or more; exact, by rank doubling (``width`` a power of 2)."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[str, int] = {}
    ranks = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    span = 1
    while span < width:
        pairs = ranks[:-span] * n + ranks[span:]
        kinds, ranks = np.unique(pairs, return_inverse=True)
        span *= 2
        if len(kinds) == len(pairs):
            return 0
    starts = (np.bincount(ranks) > 1)[ranks]
    edges = np.zeros(n + 1, np.int64)
    edges[:-width][starts] += 1
    edges[width:][starts] -= 1
    return int((np.cumsum(edges[:n]) > 0).sum())


def repeated_lines(text: str) -> int:
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return again


def band_verdict(data: bytes, compress, policy: BandPolicy) -> tuple[float, int, int, bool]:
    """Whole ratio, chunks, chunks outside their band, and whether the document stays inside its limits."""
    if not data:
        return 0.0, 0, 0, True
    ratio = len(compress(data)) / len(data)
    _, low, high = [b for b in policy.bands if b[0] <= len(data)][-1]
    inside, step = low <= ratio <= high, policy.chunk_bytes
    if len(data) < step:
        return ratio, 1, int(not inside), inside
    starts = [*range(0, len(data) - step + 1, step)]
    if len(data) % step:
        starts.append(len(data) - step)
    odd = covered = run = longest = end = 0
    for a in starts:
        part = len(compress(data[a:a + step])) / step
        if policy.chunk_band[0] <= part <= policy.chunk_band[1]:
            run = 0
        else:
            # The last chunk may overlap the one before: bytes count once.
            new = a + step - max(a, end)
            odd, covered, run, end = odd + 1, covered + new, run + (new if run else step), a + step
            longest = max(longest, run)
    return ratio, len(starts), odd, inside and covered <= policy.odd_chunk_share * len(data) and longest < policy.odd_run_bytes


def compression_quality(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                        policy: BandPolicy = BandPolicy()) -> DataFrame:
    """``keep`` columns with the base counts, the ratios and the verdict of every text."""

    def make():
        import zstandard

        compress = zstandard.ZstdCompressor(level=policy.level).compress

        def work(texts):
            out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                   "base_failed", "kept", "ratio", "n_chunks", "n_odd_chunks")}
            for t in texts:
                t = t or ""
                words = WORD.findall(t)
                repeat = repeated_window_words(words)
                failed = len(words) < 20 or 100 * repeat > 30 * len(words)
                ratio, chunks, odd, good = band_verdict(t.encode("utf-8", "replace"), compress, policy)
                for k, v in zip(out, (len(words), sum(map(len, words)), len(SYMBOLS.findall(t)), repeated_lines(t), repeat,
                                      failed, not failed and good, ratio, chunks, odd)):
                    out[k].append(v)
            return out

        return work

    return map_texts(df, [text], "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                     "base_failed boolean, kept boolean, ratio double, n_chunks long, n_odd_chunks long", make, keep)
