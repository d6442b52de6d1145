"""Batches of texts through the tokenizers library, each distinct chunk once.

A chunk is a word with the one blank before it, or a line end. No match of the GPT-2 pattern reaches over a chunk's border, so
encoding chunks one by one gives what encoding whole texts gives, while most chunks of a batch have been met before. Chunks
are found, hashed and looked up with numpy over the UTF-8 bytes; what the lookup returns is compared byte by byte with the
text, so a hash never decides. New chunks go to the library's BPE model piece by piece if their text is Latin, else through its
whole tokenizer. Texts with longer runs of white space, or other white space than blanks and line ends, go through the
tokenizer whole.
"""

from __future__ import annotations

import re
import sys
import types

import numpy as np

OTHER_SCRIPT = re.compile(r"[^\x00-ɏ‐-‧]")
#: The pattern whose matches never reach over a chunk's border, and the same for Latin text in the quicker ``re``: there
#: the digits beyond 0 to 9 are the six raised and broken ones.
GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_²³¹¼½¾]+| ?[0-9²³¹¼½¾]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SPACE_RUNS = ("  ", "\n\n", " \n", "\n ")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def byte_table() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else one from U+0100 on, in order."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, for what one task learns and the next can use."""
    return sys.modules.setdefault("_tallyspark_worker", types.ModuleType("_tallyspark_worker")).__dict__


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, … (sizes[i] of them), one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ahead = np.cumsum(sizes) - sizes
    return np.arange(total, dtype=np.int64) + np.repeat(starts - ahead, sizes)


class ChunkEncoder:
    """ids of texts as one flat array with the number of ids of each text.

    ``tokenizer`` is a byte-level BPE of the tokenizers library whose pre-tokenizer splits by GPT2_PATTERN. Chunks are remembered
    until they fill ``remember`` bytes of text, then all are forgotten, so memory is bounded.
    """

    def __init__(self, tokenizer, pattern: str, remember: int = 12_000_000, block: int = 1 << 20):
        if pattern != GPT2_PATTERN:
            raise ValueError("chunks are defined for the GPT-2 pattern only")
        self.tokenizer, self.model, self.remember, self.block = tokenizer, tokenizer.model, remember, block
        self.mapped = dict(enumerate(byte_table()))
        steps = np.arange(2 * block + 1, dtype=np.uint64)
        self.power, self.unpower = np.ones(len(steps), np.uint64), np.ones(len(steps), np.uint64)
        for table, base in ((self.power, _BASE), (self.unpower, _BACK)):
            table[1:] = base
            np.multiply.accumulate(table, out=table)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.data, self.data_at, self.data_n = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.ids_at, self.ids_n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _chunk(self, chunk: str) -> list[int]:
        if not chunk.isascii() and OTHER_SCRIPT.search(chunk):
            return self.whole(chunk)
        out, tokenize = [], self.model.tokenize
        for piece in LATIN.findall(chunk):
            if piece.isascii():
                mapped = "Ġ" + piece[1:] if piece[0] == " " else piece
                if not mapped.isprintable():
                    mapped = piece.translate(self.mapped)
            else:
                mapped = piece.encode().decode("latin-1").translate(self.mapped)
            out += [t.id for t in tokenize(mapped)]
        return out

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        got = [self._chunk(c.decode()) for c in chunks]
        n = len(self.data_n)
        for what, sizes in (("ids", [len(g) for g in got]), ("data", [len(c) for c in chunks])):
            sizes = np.array(sizes, np.int64)
            at = len(getattr(self, what)) + np.cumsum(sizes) - sizes
            setattr(self, f"{what}_at", np.concatenate([getattr(self, f"{what}_at"), at]))
            setattr(self, f"{what}_n", np.concatenate([getattr(self, f"{what}_n"), sizes]))
        self.ids = np.concatenate([self.ids, np.array([i for g in got for i in g], np.uint32)])
        self.data = np.concatenate([self.data, np.frombuffer(b"".join(chunks), np.uint8)])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.codes = np.insert(self.keys, place, keys), np.insert(self.codes, place, np.arange(n, n + len(keys)))

    def _block(self, data: bytes, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """ids of a block of texts that begin at ``firsts``, and where each text's ids begin; None if a hash deceived."""
        b = np.frombuffer(data, np.uint8)
        start = np.zeros(len(b) + 1, bool)
        ends_line = b == 10
        start[:-1] = (b == 32) | ends_line
        start[1:] |= ends_line
        start[firsts] = True
        at = np.flatnonzero(start[:-1])
        sizes = np.diff(at, append=len(b))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b * self.power[:len(b)], dtype=np.uint64, out=total[1:])
        keys = (total[at + sizes] - total[at]) * self.unpower[at]
        keys ^= (sizes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        kinds, first, kind = np.unique(keys, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, kinds), max(len(self.keys) - 1, 0))
        new = self.keys[place] != kinds if len(self.keys) else np.ones(len(kinds), bool)
        if new.any():
            if len(self.data) > self.remember:
                self._forget()
                new = np.ones(len(kinds), bool)
            self._learn(kinds[new], [data[at[i]:at[i] + sizes[i]] for i in first[new]])
            place = np.searchsorted(self.keys, kinds)
        codes = self.codes[place][kind]
        if not (np.array_equal(self.data_n[codes], sizes) and np.array_equal(self.data[ranges(self.data_at[codes], sizes)], b)):
            return None
        n = self.ids_n[codes]
        begin = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(at, firsts)]
        return self.ids[ranges(self.ids_at[codes], n)], begin

    def _long(self, text: str) -> list[str]:
        """A long text cut before blanks that begin a chunk."""
        out, last = [], 0
        while len(text) - last > self.block // 4:
            cut = text.find(" ", last + self.block // 8)
            if cut < 0:
                break
            out.append(text[last:cut])
            last = cut
        return [*out, text[last:]]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(texts), np.int64)
        out: list[np.ndarray] = []
        block: list[tuple[int, str, bytes]] = []
        size = 0

        def flush():
            nonlocal size
            if not block:
                return
            lengths = np.array([len(d) for _, _, d in block])
            got = self._block(b"".join(d for _, _, d in block), np.cumsum(lengths) - lengths) if lengths.sum() < len(self.power) else None
            if got is None:
                for i, text, _ in block:
                    ids = self.whole(text)
                    out.append(np.array(ids, np.uint32))
                    counts[i] += len(ids)
            else:
                out.append(got[0])
                for (i, _, _), n in zip(block, np.diff(got[1], append=len(got[0]))):
                    counts[i] += n
            block.clear()
            size = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if any(r in text for r in SPACE_RUNS) or OTHER_SPACE.search(text):
                flush()
                ids = self.whole(text)
                out.append(np.array(ids, np.uint32))
                counts[i] = len(ids)
                continue
            for part in self._long(text):
                data = part.encode()
                if size + len(data) > self.block:
                    flush()
                block.append((i, part, data))
                size += len(data)
        flush()
        return np.concatenate(out) if out else np.zeros(0, np.uint32), counts
