"""Fill-in-middle examples: texts cut in three and put in another order, with exact cuts over UTF-8.

Texts stay the UTF-8 bytes that Arrow hands over. The index of a batch records only its exceptions: for each character of more than
one byte its position, in code points and in bytes, and the bytes in excess of one summed up to it. A cut between code points is
turned into a place among the bytes (or the other way round) by one ``searchsorted`` among the exceptions and an addition, so
stretches of ASCII cost no memory and no search of their own, however long they are.

A text of n units gets four numbers from the sha256 of ``seed:key``: the first two, modulo n + 1, are the cuts; the third
decides whether the text stays plain, the fourth between the two orders (prefix-suffix-middle and suffix-prefix-middle). Texts that
hold a marker stay plain, so markers of an output are its own and the text can be rebuilt from output and form.

Null texts count as empty, and empty texts stay plain with an empty output. A null key is hashed as the empty string. Rows are
taken one by one: repeated rows give repeated rows. Only key and text are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class FillPolicy:
    """``unit`` is "char" or "byte"; a byte cut inside a character moves to the character's start."""

    seed: int = 1
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    fill_percent: int = 90
    spm_percent: int = 20
    unit: str = "char"
    slice_bytes: int = 8 << 20


class ExceptionIndex:
    """Code-point and byte positions of a block of UTF-8, from its characters of more than one byte alone."""

    def __init__(self, data: np.ndarray):
        self.byte_at = np.flatnonzero(data >= 0xC0)
        first = data[self.byte_at]
        extra = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        #: Bytes in excess before each exception, and after the last.
        self.excess = np.concatenate([[0], np.cumsum(extra)])
        self.char_at = self.byte_at - self.excess[:-1]

    def to_byte(self, chars: np.ndarray) -> np.ndarray:
        """Bytes before the code point of each number."""
        return chars + self.excess[np.searchsorted(self.char_at, chars, "left")]

    def to_char(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte, which must begin one."""
        return byte - self.excess[np.searchsorted(self.byte_at, byte, "left")]

    def snapped(self, byte: np.ndarray) -> np.ndarray:
        """Each byte moved to the start of the character it lies in."""
        if not len(self.byte_at):
            return byte
        last = np.searchsorted(self.byte_at, byte, "right") - 1
        start = self.byte_at[np.maximum(last, 0)]
        inside = (last >= 0) & (byte <= start + self.excess[last + 1] - self.excess[np.maximum(last, 0)])
        return np.where(inside, start, byte)


def _numbers(names: list[str], seed: int) -> np.ndarray:
    """Four 32-bit numbers for each name."""
    start = f"{seed}:"
    return np.frombuffer(b"".join(sha256((start + n).encode()).digest()[:16] for n in names), ">u4").astype(np.int64).reshape(-1, 4)


def cut_block(data: bytes, offsets: np.ndarray, names: list[str], policy: FillPolicy) -> dict[str, list | np.ndarray]:
    """Units, form, cuts (in characters) and output of the texts that lie one after the other in ``data``."""
    index = ExceptionIndex(np.frombuffer(data, np.uint8))
    starts, stops = offsets[:-1], offsets[1:]
    first = index.to_char(starts)
    h = _numbers(names, policy.seed)
    if policy.unit == "char":
        n = index.to_char(stops) - first
        cuts = np.sort(h[:, :2] % (n + 1)[:, None], 1)
        byte = index.to_byte(first[:, None] + cuts)
    else:
        n = stops - starts
        byte = index.snapped(starts[:, None] + np.sort(h[:, :2] % (n + 1)[:, None], 1))
        cuts = index.to_char(byte) - first[:, None]
    p, s, m = (x.encode() for x in (policy.prefix, policy.suffix, policy.middle))
    fill, spm = (h[:, 2] % 100 < policy.fill_percent).tolist(), (h[:, 3] % 100 < policy.spm_percent).tolist()
    form, output = [], []
    for k, (a, b, c, d) in enumerate(zip(starts.tolist(), byte[:, 0].tolist(), byte[:, 1].tolist(), stops.tolist())):
        text = data[a:d]
        if a == d or not fill[k] or p in text or s in text or m in text:
            form.append("plain")
            output.append(text)
        elif spm[k]:
            form.append("spm")
            output.append(b"".join((s, data[c:d], p, data[a:b], m, data[b:c])))
        else:
            form.append("psm")
            output.append(b"".join((p, data[a:b], s, data[c:d], m, data[b:c])))
    return {"n": n, "form": form, "prefix": cuts[:, 0], "middle": cuts[:, 1] - cuts[:, 0], "output": output}


def _slices(offsets: np.ndarray, limit: int):
    """Row ranges of at most ``limit`` bytes; a longer text is a range of its own."""
    a, rows = 0, len(offsets) - 1
    while a < rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", policy: FillPolicy = FillPolicy()) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) for every row; the cuts are null in plain rows."""
    if policy.unit not in ("char", "byte"):
        raise ValueError("unit is char or byte")
    key_type = df.schema[key].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            names = batch.column(1).to_pylist()
            if not batch.num_rows:
                continue
            offsets = np.frombuffer(texts.buffers()[1], np.int64, batch.num_rows + 1, texts.offset * 8)
            flat = texts.buffers()[2]
            for a, b in _slices(offsets, policy.slice_bytes):
                data = flat[int(offsets[a]):int(offsets[b])].to_pybytes() if offsets[b] > offsets[a] else b""
                got = cut_block(data, offsets[a:b + 1] - offsets[a], names[a:b], policy)
                plain = np.array([f == "plain" for f in got["form"]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(got["n"], pa.int64()), pa.array(got["form"]),
                     pa.array(got["prefix"], pa.int64(), mask=plain), pa.array(got["middle"], pa.int64(), mask=plain),
                     pa.array(got["output"], pa.binary()).cast(pa.string())],
                    names=[key, "n", "form", "prefix_chars", "middle_chars", "output"])

    picked = df.select(F.col(f"`{key}`"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("__name"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    return picked.mapInArrow(cut, f"`{key}` {key_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored_text(policy: FillPolicy = FillPolicy(), output: str = "output", form: str = "form"):
    """The text that an output was made from, as a column."""
    p, s, m = policy.prefix, policy.suffix, policy.middle
    out = F.col(output)
    between = lambda a, b: F.substring_index(F.substring_index(out, a, -1), b, 1)
    last = F.substring_index(out, m, -1)
    return (F.when(F.col(form) == "psm", F.concat(between(p, s), last, between(s, m)))
            .when(F.col(form) == "spm", F.concat(between(p, m), last, between(s, p))).otherwise(out))
