"""Language identification by words first, and by character n-grams for words nobody has seen.

For each language the model holds log frequencies of its known words and of character n-grams (1 to ``max_gram``, with a
border mark at both ends of a word). A known word adds its log frequency in every language. An unseen word is walked from
left to right: at each place the longest known n-gram that ends there counts, each step to a shorter one costs a fixed
penalty, and the mean over the places takes the word's place. A document's score is the sum over its words; the posterior of
the best language is reported. Ties go to the language that sorts first.

Counts are Spark aggregations over a bounded sample of documents for each language (``LanguagePolicy.max_documents``, by the
hash of the text), and the model keeps the most frequent entries (``max_words``, ``max_grams`` for each language).
Null texts and texts without a letter are ``und`` with score 0. Nothing learned: every text is ``und``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_texts, written

LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class LanguagePolicy:
    max_documents: int = 1_000
    max_words: int = 20_000
    max_grams: int = 20_000
    max_gram: int = 5
    min_word_count: int = 2
    penalty: float = 1.0
    cache_words: int = 200_000


@dataclass
class LanguageModel:
    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_scores: np.ndarray  # words x languages
    gram_scores: np.ndarray  # (grams + 1) x languages; the last row stands for nothing known
    max_gram: int
    penalty: float
    cache_words: int

    def unseen(self, word: str, grams: dict[str, int]) -> tuple[list[int], float]:
        """Rows of the n-grams used, and the mean penalty."""
        padded, used, shorter = f"^{word}$", [], 0
        for end in range(2, len(padded) + 1):
            for start in range(max(0, end - self.max_gram), end):
                row = grams.get(padded[start:end])
                if row is not None:
                    used.append(row)
                    shorter += min(self.max_gram, end) - (end - start)
                    break
            else:
                used.append(len(grams))
                shorter += self.max_gram
        return used, self.penalty * shorter / len(used)

    def predictor(self):
        """A function from texts to (language, score) lists; unseen words are remembered up to a bound."""
        known, fresh = dict(self.words), []
        table = self.word_scores

        def work(texts):
            nonlocal known, table, fresh
            if len(known) > len(self.words) + self.cache_words:
                known, table = dict(self.words), self.word_scores
            found = [[w for w in LETTERS.findall(t.lower())] if t else [] for t in texts]
            new = {w for ws in found for w in ws if w not in known} if self.languages else set()
            if new:
                new = sorted(new)
                used, starts, costs, n = [], [], [], 0
                for w in new:
                    rows, cost = self.unseen(w, self.grams)
                    starts.append(n)
                    used += rows
                    n += len(rows)
                    costs.append(cost)
                sums = np.add.reduceat(self.gram_scores[used], starts, axis=0)
                lengths = np.diff([*starts, n])
                table = np.concatenate([table, sums / lengths[:, None] - np.array(costs)[:, None]])
                base = len(known)
                known.update((w, base + i) for i, w in enumerate(new))
            best, scores = [], []
            for ws in found:
                if not ws or not self.languages:
                    best.append("und")
                    scores.append(0.0)
                    continue
                total = table[[known[w] for w in ws]].sum(0)
                k = int(total.argmax())
                best.append(self.languages[k])
                scores.append(float(1 / np.exp(np.minimum(total - total[k], 0)).sum()))
            return {"lang_pred": best, "score": scores}

        return work


def _log_rows(counts: list[tuple[str, str, int]], languages: list[str], totals: dict[str, int]) -> tuple[dict[str, int], np.ndarray]:
    index: dict[str, int] = {}
    for _, entry, _ in counts:
        index.setdefault(entry, len(index))
    table = np.zeros((len(index) + 1, len(languages)))
    column = {x: j for j, x in enumerate(languages)}
    for lang, entry, n in counts:
        table[index[entry], column[lang]] = n
    sizes = np.array([totals.get(x, 0) for x in languages], float)
    return index, np.log((table + 0.5) / (sizes + 0.5 * (len(index) + 1)))


def train_languages(docs: DataFrame, text: str = "text", lang: str = "lang", policy: LanguagePolicy = LanguagePolicy()) -> LanguageModel:
    """Learn from rows with a text and a language."""
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    # The hashes are ranked without the texts; a window with a limit keeps that many rows of a language before the shuffle.
    rank = Window.partitionBy("lang").orderBy("h")
    picked = usable.select("lang", "h").distinct().withColumn("r", F.row_number().over(rank)).where(F.col("r") <= policy.max_documents).drop("r")
    # One text of a hash: a text that fills a third of the table counts once. Copies are combined before they are shuffled.
    sample = usable.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"\P{L}+")).alias("entry")).where("entry <> ''").groupBy("lang", "entry").count()
    words = written(words, "language-words")
    padded = F.concat(F.lit("^"), "entry", F.lit("$"))
    sizes = F.sequence(F.lit(1), F.lit(policy.max_gram))
    grams = (
        words.select("lang", "count", padded.alias("p"), F.explode(sizes).alias("n")).where("length(p) >= n")
        .select("lang", "count", F.explode(F.expr("transform(sequence(1, length(p) - n + 1), i -> substring(p, i, n))")).alias("entry"))
        .groupBy("lang", "entry").agg(F.sum("count").alias("count"))
    )
    grams = written(grams, "language-grams")

    def top(frame: DataFrame, bound: int) -> tuple[list[tuple[str, str, int]], dict[str, int]]:
        order = Window.partitionBy("lang").orderBy(F.col("count").desc(), "entry")
        rows = frame.withColumn("r", F.row_number().over(order)).where(F.col("r") <= bound).select("lang", "entry", "count").collect()
        sums = {r["lang"]: r["n"] for r in frame.groupBy("lang").agg(F.sum("count").alias("n")).collect()}
        return sorted((r[0], r[1], r[2]) for r in rows), sums

    word_rows, word_totals = top(words.where(F.col("count") >= policy.min_word_count), policy.max_words)
    gram_rows, gram_totals = top(grams, policy.max_grams)
    languages = sorted(gram_totals)
    index, table = _log_rows(word_rows, languages, word_totals)
    gram_index, gram_table = _log_rows(gram_rows, languages, gram_totals)
    return LanguageModel(languages, index, gram_index, table[:len(index)], gram_table, policy.max_gram, policy.penalty, policy.cache_words)


def predict_language(df: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score``."""
    return map_texts(df, [text], "lang_pred string, score double", model.predictor, keep)
