"""Fill-in-middle, packing and hard negatives against brute force, on small frames with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import fill_in_middle, hard_negatives, pattern_packing
from tallyspark.llm.queries import QUERIES, tokenizer_file

DOCS = "doc_id long, text string, n string, form string, output string, sequence_id string, ids string"
ODD = [None, "", " ", "x", "x", "é", "中文 字符 " * 40, "a <P> b", "<S>", "ends in <", "S>starts", "<" * 50, "𝄞é" * 333, "plain words " * 4000, "\x1c\x1d\x00"]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "n", "f", "o", "s", "i") for i, t in rows], DOCS)


# Fill in the middle.

def brute_fim(key, text, unit="char"):
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in (0, 8, 16, 24)]
    text = text or ""
    if unit == "char":
        n = len(text)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    else:
        n = len(text.encode())
        a, b = (len(text.encode()[:c].decode(errors="ignore")) for c in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def fim_rows():
    rng = random.Random(1)
    alphabet = [*"abc <>PSM", "é", "中", "𝄞", "\n"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["wide é " * 200_000]
    rows = list(enumerate(texts))
    return rows + rows[:5] + [(None, "no id"), (None, "no id"), (-7, "below zero")]


@pytest.mark.parametrize("unit", ["char", "byte"])
@pytest.mark.parametrize("slice_bytes", [50, 8 << 20])
def test_fim_by_brute_force(spark, unit, slice_bytes):
    rows = fim_rows()
    policy = fill_in_middle.FillPolicy(unit=unit, slice_bytes=slice_bytes)
    made = fill_in_middle.fill_in_middle(docs_of(spark, rows), policy=policy).withColumn("back", fill_in_middle.restored_text(policy))
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect())
    assert got == Counter((k, *brute_fim(k, t, unit), t or "") for k, t in rows)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}


def test_fim_query_on_odd_rows_and_empty_tables(spark, tmp_path):
    for name, rows in (("odd", fim_rows()), ("none", [])):
        docs_of(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = Counter(map(tuple, QUERIES["op11_exception_index_fim"](spark, f"{tmp_path}/{name}").collect()))
        want = Counter()
        for key, text in rows:
            n, form, a, b, output = brute_fim(key, text)
            want[key, n, form, a, b, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
        assert got == want


def test_exception_index_goes_both_ways():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("abcé中𝄞") for _ in range(rng.randrange(30)))
        data = text.encode()
        index = fill_in_middle.ExceptionIndex(np.frombuffer(data, np.uint8))
        byte = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
        assert (index.to_byte(np.arange(len(text) + 1)) == byte).all() and (index.to_char(byte) == np.arange(len(text) + 1)).all()
        every = np.arange(len(data) + 1)
        assert (index.snapped(every) == byte[np.searchsorted(byte, every, "right") - 1]).all()
        assert len(index.byte_at) == sum(ord(c) > 127 for c in text)


# Packing.

def check_packing(rows, pieces, most):
    """Every id of every document is packed once, pieces are cut as they should be, sequences have no gap."""
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    want = Counter()
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % most or most
        cuts = [0, *range(first, len(ids) + 1, most)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[key, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    inside = defaultdict(list)
    for p in pieces:
        inside[p.sequence_id].append((p.offset, p.length))
    for held in inside.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= most
    return len(inside)


@pytest.mark.parametrize("rows", [
    [*enumerate(ODD), *enumerate(ODD[:4]), (None, "no id"), (None, None), (99, "word " * 5000), (100, "word " * 1023), (101, "word " * 1024)], []])
def test_packing_query_on_odd_rows_and_empty_tables(spark, tmp_path, rows):
    docs_of(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert bool(check_packing(rows, QUERIES["op12_pattern_packing"](spark, str(tmp_path)).collect(), 1024)) == bool(rows)


def test_packing_holds_every_id_and_few_sequences(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    pieces = QUERIES["op12_pattern_packing"](spark, folder).collect()
    n = check_packing(rows, pieces, 1024)
    assert n <= 1.02 * math.ceil(sum(p.length for p in pieces) / 1024)


def test_packed_sequences_give_the_documents_back(spark, tmp_path):
    rows = [*enumerate(ODD), *enumerate(ODD[:3])]
    policy, path = pattern_packing.PackPolicy(max_tokens=64), tokenizer_file("byte_bpe_50k.json")
    pattern_packing.write_pieces(docs_of(spark, rows), f"{tmp_path}/p", path, 2, policy=policy)
    packed = pattern_packing.pack_pieces(spark.read.parquet(f"{tmp_path}/p"), policy=policy)
    found = defaultdict(list)
    for r in pattern_packing.sequences(packed).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) <= 64 and len(ids) == sum(d.length for d in r.documents)
        for d in r.documents:
            found[d.doc_id, d.piece].append(ids[d.offset:d.offset + d.length])
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    for i, text in rows[:len(ODD)]:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        n = max(k for key, k in found if key == i) + 1
        assert [t for k in range(n) for t in found[i, k][0]] == ids
        assert all(len(set(map(tuple, found[i, k]))) == 1 and len(found[i, k]) == (2 if i < 3 else 1) for k in range(n))


def test_plans_hold_each_length_and_are_not_worse_than_best_fit():
    rng = np.random.default_rng(3)
    for most, kinds, size in ((16, 16, 50), (64, 64, 1000), (256, 40, 5000), (1024, 1024, 20000), (8, 3, 10**12)):
        histogram = np.zeros(most + 1, np.int64)
        np.add.at(histogram, rng.choice(np.arange(1, most + 1), kinds, False), rng.integers(1, max(2, size // kinds), kinds))
        plan = pattern_packing.pattern_plan(histogram, pattern_packing.PackPolicy(max_tokens=most))
        held = np.zeros(most + 1, np.int64)
        for contents, count in plan:
            assert count > 0 and sum(a * k for a, k in contents) <= most
            for length, copies in contents:
                held[length] += copies * count
        assert (held == histogram).all()
        plain = sum(c for _, c in pattern_packing._best_fit(histogram, most))
        assert sum(c for _, c in plan) <= 1.01 * plain + 1
    assert pattern_packing.pattern_plan(np.zeros(1025, np.int64)) == []


def test_least_squares_is_non_negative_and_near_the_best():
    # Two lengths, one pattern each: 10 + 6 and 8 + 8 fill 16.
    wanted = np.zeros(17)
    wanted[[10, 6, 8]] = 40, 40, 30
    patterns = pattern_packing.full_patterns(np.flatnonzero(wanted), 16)
    assert {tuple(p) for p in patterns.tolist()} == {(10, 6, 0), (8, 8, 0)}
    x = pattern_packing.fitted_counts(patterns, wanted, 2, pattern_packing.PackPolicy(max_tokens=16))
    assert {tuple(p): round(float(v)) for p, v in zip(patterns.tolist(), x)} == {(10, 6, 0): 40, (8, 8, 0): 15}


# Hard negatives.

def test_strassen_is_exact_for_all_shapes():
    rng = np.random.default_rng(4)
    for m, k, n, leaf in ((1, 1, 1, 16), (3, 5, 7, 1), (17, 64, 33, 4), (100, 64, 257, 16), (65, 129, 70, 8), (5, 0, 3, 2)):
        a, b = rng.integers(-2**20, 2**20, (m, k)), rng.integers(-2**20, 2**20, (k, n))
        assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()
    a, b = np.full((64, 64), 2**28), np.full((64, 64), -2**28)
    assert (hard_negatives.strassen(a, b, 4) == -2**62).all()


def brute_negatives(rows, every=100, n=5):
    """By the docstring: rows (id, vector, label) after relabelling."""
    q = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * x) for x in v]
        if sum(x * x for x in v) < 2**56:
            q.append((i, tuple(v), label))
    low = lambda i: (i is None, i or 0)
    out = Counter()
    for a, v, label in {r for r in q if r[0] is not None and r[0] % every == 0}:
        score = {(sum(x * y for x, y in zip(v, w)), i, other == label) for i, w, other in q if i != a}
        best = lambda pairs: sorted(pairs, key=lambda p: (-p[0], low(p[1])))[:n]
        for ps, p in best((s, i) for s, i, same in score if same):
            for k, (s, i) in enumerate(best((s, i) for s, i, same in score if not same and 80 * ps <= 100 * s <= 100 * ps), 1):
                out[a, p, k, i, ps, s] += 1
    return out


VECTORS = "vec_id long, embedding array<float>, label int, q string, at string, score string"


def vector_rows(seed, n, labels=3, width=9, values=None):
    rng = random.Random(seed)
    draw = (lambda: rng.choice(values)) if values else (lambda: float(np.float32(rng.gauss(0, 0.4))))
    return [(i, [draw() for _ in range(width)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("rows", [
    vector_rows(1, 900), vector_rows(2, 700, values=(0.0, 0.5, -0.5)), vector_rows(3, 400, labels=1), [],
    [*vector_rows(4, 300), *vector_rows(4, 120), *vector_rows(5, 40), (None, [0.5] * 9, 1), (None, [0.5] * 9, 1), (None, [0.5] * 9, 0),
     (100, None, 1), (200, [0.1, None], 1), (200, [float("nan")] * 9, 1), (200, [float("inf")] * 9, 1), (300, [0.5] * 3, None), (300, [0.7] * 3, 1),
     (400, [], 2), (-100, [0.9] * 12, 2), (500, [3e38] * 9, 1)]])
@pytest.mark.parametrize("policy", [hard_negatives.MiningPolicy(), hard_negatives.MiningPolicy(block_bytes=1200, anchor_tile=2, candidate_tile=7, leaf=2)])
def test_negatives_by_brute_force(spark, rows, policy):
    df = spark.createDataFrame([(*r, "q", "a", "s") for r in rows], VECTORS).repartition(3)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, policy=policy)
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows)


def test_negatives_query_relabels_and_orders_ties(spark, tmp_path):
    rows = vector_rows(6, 800, labels=10, values=(0.0, 0.25, -0.25))
    spark.createDataFrame([(*r, "q", "a", "s") for r in rows], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute_negatives([(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows])
    assert Counter(map(tuple, QUERIES["op13_strassen_negatives"](spark, str(tmp_path)).collect())) == want and want


def test_heaps_merge_to_the_same_in_any_order():
    rng = np.random.default_rng(7)
    entries = [(int(h), int(s), int(i)) for h, s, i in zip(rng.integers(0, 4, 300), rng.integers(-3, 3, 300), rng.integers(0, 30, 300))]
    want = {h: sorted({(-s, i) for g, s, i in entries if g == h})[:5] for h in range(4)}
    for _ in range(5):
        rng.shuffle(entries)
        heaps = hard_negatives.TopHeaps(4, 5)
        for part in np.array_split(np.array(entries), 6):
            heaps.push(part[:, 0], part[:, 1], part[:, 2])
        other = hard_negatives.TopHeaps(4, 5)
        other.push(*heaps.entries())
        h, s, i = other.entries()
        assert {k: [(-int(a), int(b)) for a, b in zip(s[h == k], i[h == k])] for k in range(4)} == want
