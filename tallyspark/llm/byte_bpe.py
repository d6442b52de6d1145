"""Byte-level BPE from a file of ranks, through the tokenizers library, and back.

Bytes are mapped to printable characters (the usual byte table), so that the library's BPE, which works on characters, works on
bytes. Ranks say which concatenations may merge and in which order; the library wants pairs, so every split of a token
into two tokens becomes a pair, in rank order. A piece that is a token itself is taken whole. Texts are cut by the library's
``Split`` with the given pattern.

Decoding looks every id's bytes up in the reversed table and concatenates them. Characters that several tokens share are
bytes until the whole is put together; ``decode_text`` turns the bytes into text, with the replacement character for bytes that
form no character. Null and empty texts have no ids and decode to nothing. Repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from .chunked_bpe import ChunkEncoder, byte_table, ranges, worker_cache
from .common import map_texts


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank from a file of base64 and rank lines (a vocabulary: bounded, so the driver may hold it)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def library_parts(ranks: dict[bytes, int]) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and merges for the library."""
    table = byte_table()
    name = {token: "".join(table[b] for b in token) for token in ranks}
    merges = [(name[t[:k]], name[t[k:]]) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1
              for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    return {name[t]: r for t, r in ranks.items()}, merges


def library_tokenizer(ranks: dict[bytes, int], pattern: str):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    vocab, merges = library_parts(ranks)
    tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


class ByteDecoder:
    """Bytes of flat ids: one gather from the pool of all tokens' bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = sorted(ranks.items(), key=lambda x: x[1])
        size = by_id[-1][1] + 1 if by_id else 0
        self.sizes, self.starts = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = 0
        for token, i in by_id:
            self.starts[i], self.sizes[i] = at, len(token)
            at += len(token)
        self.pool = np.frombuffer(b"".join(t for t, _ in by_id), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        return self.pool[ranges(self.starts[ids], self.sizes[ids])].tobytes()


def token_offsets(text: str, ids: np.ndarray, decoder: ByteDecoder) -> list[tuple[int, int]]:
    """Character span of every token; tokens that share a character all cover it."""
    data = text.encode("utf-8", "surrogatepass")
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    ends = np.cumsum(decoder.sizes[ids])
    starts = ends - decoder.sizes[ids]
    return [(int(char[a]), int(char[b - 1]) + 1) for a, b in zip(starts, ends)]


def encode_bytes_bpe(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                     offsets: bool = False) -> DataFrame:
    """``keep`` columns, ``ids`` array<int>, and with ``offsets`` the character span of every id."""

    def make():
        encoder, decoder = _encoder(ranks, pattern), ByteDecoder(ranks)

        def work(texts):
            flat, counts = encoder(texts)
            parts = np.split(flat, np.cumsum(counts)[:-1])
            out = {"ids": [p.astype(np.int32) for p in parts]}
            if offsets:
                out["offsets"] = [[{"start": a, "end": b} for a, b in token_offsets(t or "", p, decoder)] for t, p in zip(texts, parts)]
            return out

        return work

    return map_texts(df, [text], "ids array<int>" + ", offsets array<struct<start int, end int>>" * offsets, make, keep)


def decode_text(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the decoded ``text``; null ids decode to the empty text."""

    def make():
        decoder = ByteDecoder(ranks)
        return lambda rows: {"text": [decoder(np.array(r or [], np.int64)).decode("utf-8", "replace") for r in rows]}

    return map_texts(df, [ids], "text string", make, keep)


def round_trip_digest(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Number and hash of the ids, and the hash of the bytes they decode to."""

    def make():
        encoder, decoder = _encoder(ranks, pattern), ByteDecoder(ranks)

        def work(texts):
            flat, counts = encoder(texts)
            parts = np.split(flat.astype("<u4"), np.cumsum(counts)[:-1])
            return {"n_tokens": counts.tolist(), "ids_sha256": [sha256(p.tobytes()).hexdigest() for p in parts],
                    "decoded_sha256": [sha256(decoder(p)).hexdigest() for p in parts]}

        return work

    return map_texts(df, [text], "n_tokens long, ids_sha256 string, decoded_sha256 string", make, keep)


def _encoder(ranks: dict[bytes, int], pattern: str) -> ChunkEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = ("byte_bpe", pattern, len(ranks), sha256(b"".join(sorted(ranks, key=ranks.get))).digest())
    cache = worker_cache()
    if key not in cache:
        cache[key] = ChunkEncoder(library_tokenizer(ranks, pattern), pattern)
    return cache[key]
