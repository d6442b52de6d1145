"""The similarity self-join and near-duplicate listings against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import listing as ls, similarity
from tallyspark.operators.similarity import SimilarityPolicy, connected_components, similar_groups


def brute(texts, width=5, percent=80):
    """{key: (representative, copies)} by comparing all pairs."""
    words, sets = {}, {}
    for key, text in texts:
        w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        words[key] = frozenset(w)
        sets[key] = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {frozenset(w)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if words[a] == words[b] or both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    sizes = Counter(find(k) for k in keys)
    return {k: (find(k), sizes[find(k)]) for k in keys}


def changed(rng, text, share):
    w = text.split()
    for k in rng.sample(range(len(w)), round(share * len(w))):
        w[k] = f"n{rng.randrange(10**6)}"
    return " ".join(w)


def texts_with_copies(seed):
    rng = random.Random(seed)
    prose = lambda n, v=900: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    passage = prose(60)
    texts = [None, "", " ", "!?", "red bag", "Bag, RED!", "red red bag", "one two three four", "four three two one"]
    for n in (6, 30, 60, 200, 700):
        base = prose(n)
        texts += [base, base.upper(), *[changed(rng, base, s) for s in (0.005, 0.01, 0.015, 0.018, 0.02, 0.022, 0.025, 0.04, 0.2)]]
    texts += [f"{passage} {prose(n)}" for n in (2, 5, 10, 15, 20, 40, 80) for _ in range(3)]
    texts += [" ".join(rng.sample(texts[9].split(), 6)) for _ in range(3)]
    return list(enumerate(texts))


@pytest.mark.parametrize("policy", [SimilarityPolicy(), SimilarityPolicy(linear=0, part_rows=3), SimilarityPolicy(rounds=0, part_rows=1), SimilarityPolicy(width=2, percent=60)])
def test_near_duplicates_by_brute_force(spark, policy):
    rows = texts_with_copies(1)
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "id long, t string, h string")
    got = {r.id: (r.representative, r.copies) for r in ls.near_duplicates(df, "id", "t", policy).collect()}
    assert got == brute(rows, policy.width, policy.percent)


def test_one_changed_word_is_found_and_empty_tables_pass(spark):
    text = " ".join(f"word{k}" for k in range(60))
    df = spark.createDataFrame([(1, text), (2, text.replace("word30", "other")), (3, text.replace("word", "else"))], "id int, t string")
    assert {r.id: (r.representative, r.copies) for r in ls.near_duplicates(df, "id", "t").collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 1)}
    assert ls.near_duplicates(df.limit(0), "id", "t").count() == 0


def test_a_large_group_of_near_copies_needs_few_rows(spark):
    """600 texts that all link: rounds of hubs settle them, and the all-pairs step has nothing left to join."""
    rng = random.Random(3)
    base = " ".join(f"w{k}" for k in range(80))
    rows = [(k, changed(rng, base, 0.0125)) for k in range(600)] + [(600 + k, " ".join(f"v{rng.randrange(10**6)}" for _ in range(20))) for k in range(50)]
    df = spark.createDataFrame(rows, "id long, t string").select("id", F.split("t", " ").alias("__words"))
    groups = [r[0] for r in similar_groups(df, F.col("__words")).groupBy("__group").count().select("count").collect()]
    assert sorted(groups) == [1] * 50 + [600]


def test_components_are_the_smallest_reachable_node(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 101), (7, 7), (200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99, 101: 99}


@pytest.mark.parametrize("policy", [
    SimilarityPolicy(extra=0), SimilarityPolicy(extra=100), SimilarityPolicy(extra=37, percent=61, width=3), SimilarityPolicy(broadcast_ids=0, broadcast_sets=0),
    SimilarityPolicy(broadcast_shingles=400), SimilarityPolicy(linear=0, broadcast_ids=5, broadcast_sets=3)])
def test_what_is_posted_or_broadcast_changes_no_group(spark, policy):
    rows = texts_with_copies(2)
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: (r.representative, r.copies) for r in ls.near_duplicates(df, "id", "t", policy).collect()}
    assert got == brute(rows, policy.width, policy.percent)


def test_texts_without_partners_leave_before_their_whole_sets_are_passed(spark, monkeypatch):
    """A passage that 200 texts quote does not keep them, nor do exact copies: only the near copies are posted whole."""
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    quoted, base = prose(12), prose(120)
    rows = [(k, f"{quoted} {prose(150)}") for k in range(200)] + [(200 + k, base) for k in range(20)] + [(300, base.replace(" ", " new ", 1)), (301, f"{base} end")]
    df = spark.createDataFrame(rows, "id long, t string")
    seen, posted = [], similarity._prefixes

    def spy(classes, policy):
        seen.append(classes.count())
        return posted(classes, policy)

    monkeypatch.setattr(similarity, "_prefixes", spy)
    got = {r.id: (r.representative, r.copies) for r in ls.near_duplicates(df, "id", "t").collect()}
    assert got == brute(rows) and got[301] == (200, 22) and seen == [3]


def test_rounds_that_settle_little_are_given_up(spark, monkeypatch):
    """100 texts around one passage meet in all pairs, but the longer ones do not link: at most two rounds of hubs are spent on them."""
    rng = random.Random(7)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = prose(90)
    rows = [(k, f"{passage} {prose(rng.choice((9, 14, 19)))}") for k in range(100)]
    df = spark.createDataFrame(rows, "id long, t string")
    met, verified = [], similarity._verified

    def spy(pairs, classes, policy):
        met.append(pairs.count())
        return verified(pairs, classes, policy)

    monkeypatch.setattr(similarity, "_verified", spy)
    got = {r.id: (r.representative, r.copies) for r in ls.near_duplicates(df, "id", "t", SimilarityPolicy(linear=0)).collect()}
    assert got == brute(rows) and len(met) <= 3
