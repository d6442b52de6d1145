"""The training-data operators against brute force, round trips and held-out accuracy, on small frames with odd rows."""

import base64
import collections
import hashlib
import random
import re
import tempfile
import zlib
from pathlib import Path

import numpy as np
import pytest
import tiktoken
import zstandard
from pyspark.sql import Row, functions as F
from tokenizers import Tokenizer

from tallyspark.llm import (backoff_langid, boosted_quality, byte_bpe, column_bwt, compression_bands, containment, deobfuscated_pii,
                            html_blocks, orc_tokens, prefix_tree_join)
from tallyspark.llm.common import crc_fold, read_table
from tallyspark.llm.components import connected_components
from tallyspark.llm.queries import QUERIES, pattern, tokenizer_file
from tallyspark.session import shared_folder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row string"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or ""), "k", "r") for i, t in enumerate(texts)], DOCS)


def words(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " ", "\n\n", "x", "x", "é" * 300, "A b  c\td", "a" * 3000, "a" * 3000, "\x1c\x1d", "中文 字符 " * 40]


def test_every_operator_takes_odd_rows_and_empty_tables(spark):
    for texts in (ODD, []):
        docs = frame(spark, texts)
        ranks = byte_bpe.read_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
        with tempfile.TemporaryDirectory() as folder:
            orc_tokens.write_tokens(docs, f"{folder}/t", tokenizer_file("byte_bpe_50k.json"), 2)
            counts = [
                html_blocks.extract_main_text(docs, "text", ("doc_id",)).count(), compression_bands.compression_quality(docs).count(),
                column_bwt.remove_repeats(docs).count(), orc_tokens.with_checksum(orc_tokens.read_tokens(spark, f"{folder}/t")).count() if texts else 0,
                byte_bpe.round_trip_digest(docs, ranks, pattern()).count(), deobfuscated_pii.span_digest(docs).count(),
                prefix_tree_join.ngram_components(docs).count(), boosted_quality.document_statistics(docs).count()]
        assert counts == [len(texts)] * 8
        assert containment.contained_items(docs, docs.withColumnRenamed("doc_id", "item_id")).count() >= 0


@pytest.mark.parametrize("texts", [ODD, []])
def test_odd_rows_and_empty_tables_to_the_end(spark, tmp_path, texts):
    docs = frame(spark, texts)
    orc_tokens.write_tokens(docs, str(tmp_path / "t"), tokenizer_file("byte_bpe_50k.json"), 2)
    back = orc_tokens.with_checksum(orc_tokens.read_tokens(spark, str(tmp_path / "t"))).collect()
    assert sorted(r.doc_id for r in back) == list(range(len(texts)))
    got = containment.contained_items(docs, docs.withColumnRenamed("doc_id", "item_id")).collect()
    rows = list(enumerate(texts))
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(brute_containment(rows, rows)) and bool(got) == bool(texts)
    found = backoff_langid.predict_language(docs, backoff_langid.train_languages(docs)).collect()
    assert len(found) == len(texts)


def test_html_main_text(spark):
    tree = html_blocks.fit_tree()
    page = ("<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>One &amp; two<br>three</p>"
            "<p>x</p><div class='comments'><p>nice post</p></div><form><p>Name</p></form></article><aside>About us</aside>"
            "<div class=ad>Buy now and save</div><footer>&copy; me</footer><script>var a='<p>no</p>'</script></body></html>")
    assert html_blocks.main_text(page, tree) == "Title One & two three x"
    assert html_blocks.main_text("<article><p>cut off in a ta<a hre", tree) == "cut off in a ta"
    assert html_blocks.main_text(None, tree) == html_blocks.main_text("", tree) == ""
    rng = np.random.default_rng(0)
    inside = np.stack([rng.integers(1, 90, 300), rng.random(300), rng.integers(0, 90, 300), rng.random(300), rng.integers(0, 90, 300),
                       rng.random(300), *rng.integers(0, 2, (2, 300)), np.ones(300), np.zeros(300)], 1)
    assert tree.predict(inside).mean() > 0.97
    inside[:, 9] = 1
    assert not tree.predict(inside).any()


@pytest.mark.parametrize("opening,kept", [
    ('<article class="post-12 post tag-news category-bar">', True), ('<div class="content has-sidebar">', True),
    ('<main class="no-sidebar">', True), ('<div class="main no-sidebar">', True), ('<div class="story with-comments">', True),
    ('<article class="sidebar-left">', True), ('<div class="entry comments_closed category-social">', True),
    ('<div class="site-footer">', False), ('<div id="comments" class="comments-area">', False), ('<div class="post tag-cloud">', False),
    ('<div class="has-sidebar sidebar">', False), ('<div class="main-nav">', False), ('<div class=comments><article class=post>', False),
])
def test_names_about_the_page_are_not_furniture(opening, kept):
    page = f"<body><nav><a href=/>Home</a></nav>{opening}<h1>Title</h1><p>A text of <a href=/x>some</a> words stands here.</p>"
    assert html_blocks.main_text(page, html_blocks.fit_tree()) == ("Title A text of some words stands here." if kept else "")


def test_repeated_windows_by_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        w = [rng.choice("ab" if rng.random() < .5 else "abcdefgh") for _ in range(rng.randrange(40))]
        seen = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        hit = {k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
        assert compression_bands.repeated_window_words(w) == len(hit)
    assert compression_bands.repeated_lines("a\nb\na\n\n\na") == 2


def test_compression_rejects_repetition_and_noise_only(spark):
    rng = random.Random(2)
    plain = words(rng, 400)
    noise = base64.b64encode(rng.randbytes(6000)).decode()
    noise = " ".join(noise[i:i + 7] for i in range(0, len(noise), 7))
    rows = {r.doc_id: r for r in compression_bands.compression_quality(frame(spark, [plain, " ".join(f"same{k % 9}{k // 9 % 2}" for k in range(900)), noise])).collect()}
    assert rows[0].kept and not rows[1].kept and not rows[2].kept


def test_odd_stretches_reject_wherever_they_lie(spark):
    rng = random.Random(12)
    prose = words(rng, 9000)
    noise = base64.b64encode(rng.randbytes(9000)).decode()
    line = "the same line of text again and again\n" * 300
    texts = [prose[:2048] + noise[:1950], prose[:32768] + line[:8192], prose[:32768] + noise[:8192],
             *[prose[:n] + odd[:6143] + prose[n:40000] for n in (0, 1, 777, 2047, 20001, 39999) for odd in (line, noise)],
             *[prose[:n] for n in (1500, 2048, 2049, 4095, 5000, 40000)], prose[:20000] + noise[:2048] + prose[20000:40000]]
    rows = {r.doc_id: r for r in compression_bands.compression_quality(frame(spark, texts)).collect()}
    assert not any(rows[i].kept for i in range(15)) and all(rows[i].kept for i in range(15, len(texts)))
    assert [rows[i].n_chunks for i in range(15, 21)] == [1, 1, 2, 2, 3, 20]
    assert all(0.3 < rows[i].ratio < 0.7 for i in range(1, 15))  # the whole looks normal


def test_repeated_strings_by_brute_force(spark):
    rng = random.Random(3)
    base = [words(rng, 120) for _ in range(6)]
    texts = [*base, base[0], base[1][:500] + words(rng, 60), words(rng, 50) + base[2][100:420] + words(rng, 30), "ab" * 400, "é" * 250,
             *[words(rng, 30) + base[3][50:350] + words(rng, 20) for _ in range(8)], None, ""]
    for policy in (column_bwt.RepeatPolicy(), column_bwt.RepeatPolicy(anchor_segments=3, bucket_segments=5), column_bwt.RepeatPolicy(length=40, gram=12)):
        got = {r.doc_id: r for r in column_bwt.remove_repeats(frame(spark, texts), policy=policy).collect()}
        data = [(t or "").encode() for t in texts]
        size = policy.length
        seen = collections.Counter(b[i:i + size] for b in data for i in range(len(b) - size + 1))
        for i, b in enumerate(data):
            gone = np.zeros(len(b), bool)
            for p in range(len(b) - size + 1):
                if seen[b[p:p + size]] > 1:
                    gone[p:p + size] = True
            kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
            assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), gone.sum(), hashlib.sha256(kept).hexdigest())
            assert got[i].n_spans == (np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()


def test_column_wise_order_is_suffix_order(tmp_path):
    rng = random.Random(4)
    for _ in range(60):
        strings = [np.array([rng.randint(1, 3) for _ in range(rng.randint(0, 12))], np.uint16) for _ in range(rng.randint(1, 8))]
        at = list(zip(*column_bwt.column_wise_order(strings, str(tmp_path))))
        suffixes = [tuple(strings[a][b:].tolist()) for a, b in at]
        assert suffixes == sorted(suffixes) and len(set(at)) == sum(map(len, strings)) + len(strings)


def test_starts_up_to_anchors_are_ordered_in_half_the_rounds(tmp_path, monkeypatch):
    """The construction ends at the anchors, takes no round for what lies behind other anchors, and leaves no file behind."""
    rng = random.Random(8)
    gram, rounds, built = 4, [], column_bwt.column_wise_order

    def spy(strings, folder):
        rounds.append(max(map(len, strings)))
        return built(strings, folder)

    monkeypatch.setattr(column_bwt, "column_wise_order", spy)
    for _ in range(40):
        at = [rng.randint(0, 6) for _ in range(9)]
        anchors = [rng.choice((5, -3, 40)) for _ in at]
        names = {5: b"aaaa", -3: b"abab", 40: b"bbbb"}
        parts = [bytes(rng.choices(b"ab", k=x)) + names[a] + bytes(rng.choices(b"ab", k=rng.randint(0, 6))) for a, x in zip(anchors, at)]
        got = list(zip(*column_bwt.anchored_order([np.frombuffer(p, np.uint8) for p in parts], anchors, at, gram, str(tmp_path))))
        first = {a: i for i, a in enumerate(dict.fromkeys(anchors))}
        keys = [(parts[i][s:at[i]], first[anchors[i]], parts[i][at[i] + gram:]) for i, s in got]
        assert keys == sorted(keys) and sorted(got) == [(i, s) for i, x in enumerate(at) for s in range(x + 1)]
    assert max(rounds) <= 6 and not list(tmp_path.iterdir())


def test_segments_are_made_in_one_scan_and_one_shuffle(spark, monkeypatch):
    tables, keep = {}, column_bwt.written

    def spy(df, name):
        tables[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(column_bwt, "written", spy)
    text = words(random.Random(1), 90)
    assert column_bwt.remove_repeats(frame(spark, [text, text, None])).agg(F.sum("n_removed")).first()[0] == 2 * len(text.encode())
    plan = tables["repeat-segments"]
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_orc_round_trip_and_lookup(spark, tmp_path):
    path, texts = tokenizer_file("byte_bpe_50k.json"), ["hello world", None, "", "  two  spaces\n\n", "don't stop 123", "naïve 中文"]
    docs = frame(spark, texts).orderBy(F.desc("doc_id"))
    orc_tokens.write_tokens(docs, str(tmp_path / "t"), path, 2)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    start = 0
    for r in orc_tokens.with_checksum(orc_tokens.read_tokens(spark, str(tmp_path / "t"))).orderBy("doc_id").collect():
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    found = orc_tokens.find_tokens(spark, str(tmp_path / "t"), [4])
    assert [r.doc_id for r in found.collect()] == [4]
    assert "doc_id" in found._jdf.queryExecution().toString().split("PushedFilters")[1]


def test_byte_bpe_equals_tiktoken_and_decodes(spark):
    ranks = byte_bpe.read_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    alphabet = [*"aab -=.'\n\t  sdé中1२١|²½ªµ_", "\x1c", "\xa0", "aaaaa", "--", "the", "'s", "😀", "\r\n", "\x85", "​"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["a" * 99, "=" * 99, None, "", "word " * 30000]
    rows = byte_bpe.encode_bytes_bpe(frame(spark, texts), ranks, pattern(), offsets=True)
    for r in rows.collect():
        text = texts[r.doc_id] or ""
        assert r.ids == own.encode_ordinary(text)
        for (a, b), i in zip(r.offsets, r.ids):
            assert text[a:b].encode().find(own.decode_single_token_bytes(i)) >= 0 or len(text[a:b]) >= 1
    back = {r.doc_id: r.text for r in byte_bpe.decode_text(rows, ranks).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))


def plain_statistics(t, compress):
    """The statistics of one text by their definitions, one after the other."""
    t = t or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, k, lengths = max(len(t), 1), max(len(found), 1), np.array([*map(len, found)] or [0], float)
    counts, pairs = collections.Counter(found), collections.Counter(zip(found, found[1:]))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    share = lambda p: len(re.findall(p, t)) / n
    data = t.encode("utf-8", "replace")
    return [
        float(np.log1p(len(found))), lengths.mean(), lengths.std(), share(r"[^\W\d_]"), share("[A-ZÀ-ÖØ-Þ]"), share("[0-9]"), share(r"[ \n\t]"),
        share(r"[#*$%&|<>{}\[\]\\^~=+@_/]"), share(r"[.,;:!?'\"()-]"), share(r"\|"), share("!"), len(counts) / k, max(counts.values(), default=0) / k,
        max(pairs.values(), default=0) / k, sum(a == b for a, b in zip(found, found[1:])) / k, 1 - len(set(lines)) / len(lines) if lines else 0.0,
        len(found) / max(len(lines), 1), sum(not w[-1].isalnum() and w[-1] not in ".,;:!?'\")" for w in found) / k,
        sum(not re.search(r"[^\W\d_]", w) for w in found) / k, len(compress(data)) / max(len(data), 1), sum(len(w) > 12 for w in found) / k,
        sum(w[0].isupper() for w in found) / k]


def test_statistics_of_many_texts_at_once_are_those_of_each():
    rng = random.Random(9)
    compress = zstandard.ZstdCompressor(level=1).compress
    texts = [None, "", " ", "\n", "a", " a", "a ", "A b A b A b", "\x0b\x0c\r", "x\x0by\x0cz\rw", "a\x85c\x1fd　e", "² ½ Ⅷ 〇 ٣", "a\n\na\n \na", "\ud800 x", ""]
    texts += ["".join(rng.choices(" \n\t\r\x0b\x0cabAB|!.,#_9é中²٣\x85\xa0\x1c\U0001f600", k=rng.randrange(80))) for _ in range(300)]
    texts += [words(rng, n) for n in (1, 7, 8, 9, 129, 3000)]
    want = [plain_statistics(t, compress) for t in texts]
    assert boosted_quality.text_statistics(texts, compress).tolist() == want
    assert [boosted_quality.statistics(t, compress) for t in texts] == want
    assert boosted_quality.text_statistics([], compress).shape == (0, len(boosted_quality.STATISTICS))


def test_a_slice_of_texts_is_worked_out_at_once(spark, monkeypatch):
    """The map over the texts takes whole slices: 500 short texts in one task are one call."""
    calls, many = [], boosted_quality.text_statistics
    monkeypatch.setattr(boosted_quality, "text_statistics", lambda texts, compress: calls.append(len(texts)) or many(texts, compress))
    made = {}
    monkeypatch.setattr(boosted_quality, "map_texts", lambda df, inputs, schema, make, keep: made.update(work=make()) or df)
    boosted_quality.document_statistics(frame(spark, []))
    assert len(made["work"](["a b"] * 500)["stats"]) == 500 and calls == [500]


def test_boosted_trees_learn_and_flatten():
    rng = np.random.default_rng(6)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > .5) ^ (x[:, 3] > .3)).astype(float)
    model = boosted_quality.fit_trees(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > .5) == y[1500:]).mean() > .97
    assert boosted_quality.fit_trees(np.zeros((0, 5)), np.zeros(0)).score(np.zeros((2, 5))).tolist() == [.5, .5]


def test_quality_and_language_on_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in read_table(spark, SF, "labels").collect()}
    rows = [r for r in QUERIES["op6_boosted_quality"](spark, SF).collect() if r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= .9 * len(rows)
    langs = {r.doc_id: r.lang for r in read_table(spark, SF, "documents").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op8_backoff_langid"](spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in rows) >= .97 * len(rows)


def test_language_sample_takes_one_row_of_a_text(spark):
    texts = ["one two three"] * 400 + [f"four word{k}" for k in range(5)]
    docs = frame(spark, texts)
    once = backoff_langid.train_languages(docs.dropDuplicates(["text"]))
    hot = backoff_langid.train_languages(docs)
    assert hot.words == once.words and hot.grams == once.grams and (hot.gram_scores == once.gram_scores).all()


def test_language_of_texts_without_letters(spark):
    model = backoff_langid.train_languages(frame(spark, ["the cat sat the cat", "the dog"]))
    got = backoff_langid.predict_language(frame(spark, [None, "", "12 34", "cat"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en"] and all(0 <= r.score <= 1 for r in got)


def brute_containment(docs, items, width=5, percent=80):
    cut = lambda t: (lambda w: {tuple(w[i:i + width]) for i in range(len(w) - width + 1)})(re.findall(r"[^\W_]+", (t or "").lower()))
    return {(d, i) for d, t in docs for i, q in items if cut(q) and len(cut(t) & cut(q)) * 100 >= percent * len(cut(q))}


@pytest.mark.parametrize("bound", [20_000, 0])
def test_containment_by_brute_force(spark, bound):
    rng = random.Random(7)
    items = [words(rng, n) for n in (16, 30, 55, 5, 4, 40)] + [None, ""]
    docs = [words(rng, 200) + " " + t + " " + words(rng, 100) for t in items if t] + [
        " ".join(w for k, w in enumerate((items[2]).split()) if k != 20), items[5][:150], None, "", words(rng, 2000)]
    table = frame(spark, items).withColumnRenamed("doc_id", "item_id")
    got = containment.contained_items(frame(spark, docs), table, policy=containment.ContainmentPolicy(literal_hashes=bound))
    want = brute_containment(list(enumerate(docs)), list(enumerate(items)))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) >= 5
    assert {r.doc_id for r in containment.without_leaks(frame(spark, docs), table).collect()} == set(range(len(docs))) - {d for d, _ in want}
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().toString())


@pytest.mark.parametrize("text,kinds", [
    ("mail jo.doe@mail.example.com now", [("email", True)]), ("jo.doe [at] mail7 [dot] example (dot) com", [("email", False)]),
    ("jo at mail dot example dot com", [("email", False)]), ("jо@exаmple.com", [("email", False)]), ("look at the dot on a map", []),
    ("192.168.0.1 or 10[.]0[.]0[.]7", [("ip", True), ("ip", False)]), ("４１１１１１１１１１１１１１１１", [("card", False)]),
    ("4111 1111 1111 1111", [("card", True)]), ("4111 1111 1111 1112", []), ("+1 (068) 555-1234", [("phone", True)]),
    ("plus one zero six eight five five five one two three four", [("phone", False)]), ("one two three", []), ("", []),
])
def test_personal_data(text, kinds):
    plain, more = deobfuscated_pii.find_all(text)
    assert sorted([(k, True) for k, _, _ in plain] + [(k, False) for k, _, _ in more]) == sorted(kinds)
    assert all(0 <= a < b <= len(text) for _, a, b in plain + more)
    clean = deobfuscated_pii.redacted(text, plain + more)
    assert not deobfuscated_pii.find_plain(clean) and len(re.findall(r"<(?:email|ip|card|phone)>", clean)) == len(kinds)


@pytest.mark.parametrize("text,kind", [
    ("plus 1 068 555 1234", "phone"), ("plus one 068 555 1234", "phone"), ("+1 068 555 123 four", "phone"), ("4111 1111 1111 111 one", "card"),
    ("10.0.0.seven", "ip"), ("192.168.one.10", "ip"), ("jo@example . com", "email"),
])
def test_each_disguise_is_found_alone(text, kind):
    _, more = deobfuscated_pii.find_all(text)
    assert deobfuscated_pii.redacted(text, more) == f"<{kind}>"


@pytest.mark.parametrize("text,kind", [
    ("jo\u200e@example.com", "email"), ("jo@exam\u2066ple.com", "email"), ("jo@example\ufe0f.com", "email"), ("jo &#64; example.com", "email"),
    ("jo%40example.com", "email"), ("jo@example&#46;com", "email"), ("jo AT example DOT nz", "email"), ("jo AT example.nz", "email"),
    ("jo at example[.]com", "email"), ("jo dot doe at example.com", "email"), ("jo_at_example.com", "email"), ("j\u043e at example.com", "email"),
])
def test_further_disguises(text, kind):
    plain, more = deobfuscated_pii.find_all(text)
    assert not [s for s in plain if s[1] == 0] and deobfuscated_pii.redacted(text, more) == f"<{kind}>"


@pytest.mark.parametrize("text", [
    "we look at example.com for it", "Write to us at mail.example.org today", "more at www.example.co.uk, or here", "AT A GLANCE AT EXAMPLE.COM",
    "100% sure & at home \u2764\ufe0f", "one point at which we meet", "a look-at-example.com host",
])
def test_prose_has_no_added_spans(text):
    assert deobfuscated_pii.find_all(text) == ([], [])


def test_base_columns_by_a_plain_twin(spark):
    """Counts, hash and spans of the query's columns against the four patterns applied one by one."""
    rng = random.Random(21)
    pieces = [*"0123456789", "4111 1111 1111 1111", "10.0.0.1", "256.1.1.1", "+1 (068) 555-1234", "+12", "jo@a.example", "@", ".", "x.y@b-c.d.e", "word", "\n", "é"]
    texts = [None, ""] + ["".join(rng.choice(pieces) + rng.choice(["", " ", "-", ". "]) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    want = []
    for i, t in enumerate(texts):
        found = []
        for k, (kind, rule) in enumerate({
                "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()):
            for m in re.finditer(rule, t or ""):
                d = [int(c) for c in m[0] if c in "0123456789"]
                doubled = [x if j % 2 == 0 else sum(divmod(2 * x, 10)) for j, x in enumerate(reversed(d))]
                if (kind == "email" or kind == "ip" and max(map(int, m[0].split("."))) <= 255 or kind == "phone" and 10 <= len(d) <= 15
                        or kind == "card" and 14 <= len(d) <= 19 and sum(doubled) % 10 == 0):
                    found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        spans = [x[2] for x in sorted(found)]
        want.append((i, *(sum(x[1] == k for x in found) for k in range(4)), hashlib.sha256(",".join(spans).encode()).hexdigest(), set(spans)))
    got = deobfuscated_pii.span_digest(frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r)[:6] for r in got] == [w[:6] for w in want]
    assert all(w[6] <= set(r.spans.split(",")) for r, w in zip(got, want))


def ungated(text):
    """Every transducer on the whole text, none left out."""
    d, m = deobfuscated_pii, deobfuscated_pii.Mapped(text)
    m.rewrite([(x.start(), x.end(), d.FOLDS[x[0]]) for x in re.finditer(r"(?s).", m.text) if x[0] in d.FOLDS])
    for pattern_, new in ((d.CODED, "@"), (d.CODED_DOT, "."), (d.BRACKET_AT, "@"), (d.BRACKET_DOT, "."), (d.CAPITAL_AT, "@"), (None, ""),
                          (d.WORD_DOT, "."), (d.SPACED_AT, "@")):
        m.rewrite([(x.start(), x.end(), new) for x in pattern_.finditer(m.text)] if pattern_ else d._word_ats(m))
    m.rewrite([(b.start(), b.end(), ".") for x in d.SPACED_HOST.finditer(m.text) for b in d.BLANK_DOT.finditer(m.text, x.start(), x.end())])
    m.rewrite([(x.start(), x.end(), "+") for x in d.PLUS.finditer(m.text)])
    m.rewrite(d._digit_pieces(m.text))
    m.rewrite([(x.start(), x.end(), d.DIGIT_OF[d._lower(x[0])]) for x in d.SPELLED_WORD.finditer(m.text)
               if d.DOT_BEFORE.search(m.text, max(0, x.start() - 2), x.start()) or d.DOT_AFTER.match(m.text, x.end())])
    return m


def test_no_transducer_is_left_out_wrongly():
    rng = random.Random(10)
    pieces = [*"0123456789", "068", "555", "4111", *deobfuscated_pii.DIGIT_OF, "Seven", "\u017fix", "F\u0130VE", "plus", "Plu\u017f", "+", "&#64;", "%40", "&#x2E;", "\ufe0f", "at", "AT", "dot",
              "pun\u212at", "jo", "example", "com", "[at]", "( . )", "{@}", "<dot>", "@", ".", "\u2013", "\xa0", "\u200b", "x", "\u0662", "(", "]"]
    changed = 0
    for _ in range(30_000):
        t = "".join(rng.choice(pieces) + rng.choice(["", " ", " ", "-", ".", "_", ", ", "  "]) for _ in range(rng.randrange(1, 12)))
        got, want = deobfuscated_pii.normalised(t), ungated(t)
        assert (got.text, got.starts, got.ends, got.changed) == (want.text, want.starts, want.ends, want.changed), t
        changed += want.starts is not None
    assert changed > 10_000


def test_plain_emails_equal_the_pattern():
    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choice("a.@-b_ @") for _ in range(rng.randrange(25)))
        assert [s[1:] for s in deobfuscated_pii.find_plain(t) if s[0] == "email"] == [m.span() for m in deobfuscated_pii.EMAIL.finditer(t)]


def brute_components(rows, width=4, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("policy", [prefix_tree_join.JoinPolicy(), prefix_tree_join.JoinPolicy(block_chars=1500, heavy_least=2, heavy_share=0.0)])
def test_prefix_tree_join_by_brute_force(spark, policy):
    rng = random.Random(9)
    passage, texts = words(rng, 30), [None, "", "one", "one", "ONE", "a b c", "a b c d", "a b c d e"]
    for _ in range(12):
        base = words(rng, rng.choice((12, 60, 150, 400))).split()
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 60) + 2)):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
            texts.append(" ".join(w) + (" " + passage if rng.random() < .3 else ""))
    texts += [texts[-1]] * 3
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in prefix_tree_join.ngram_components(frame(spark, texts), policy=policy).collect()}
    want = brute_components(list(enumerate(texts)))
    assert got == want
    kept = {r.doc_id for r in prefix_tree_join.one_of_each(frame(spark, texts), policy=policy).collect()}
    assert kept == {i for i, (n, c) in want.items() if n == 0 or c == i}


def test_rounds_of_the_join_leave_no_tables_of_finished_rounds(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    rng = random.Random(31)
    base = [" ".join(str(rng.random()) for _ in range(80)) for _ in range(3)]
    docs = frame(spark, [f"{b} {k}" for k in range(4) for b in base])
    before = set(folder.iterdir()) if folder.exists() else set()
    got = prefix_tree_join.ngram_components(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k % 3 for k in range(12)}
    assert {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before} == {"labels", "ngram-all-links", "ngram-rows"}


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}
