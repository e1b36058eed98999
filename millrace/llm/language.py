"""Language identification that backs off from words to character n-grams.

A known word scores each language by its log frequency there. An unseen word is scored by
its character n-grams instead: at each place the longest known n-gram, from four
characters down to one. The language with the greatest sum wins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Step, append_steps, emitted, remove_path, stored

UNKNOWN = "und"
#: Unseen words whose scores a worker keeps; when full, it starts anew.
CACHED_WORDS = 200_000
_words = re.compile(r"[^\W\d_]+").findall


@dataclass(frozen=True)
class Fit:
    """The sample that the model is fitted on, of which it keeps all words and n-grams."""

    sample_rows: int = 6_000  #: labelled rows about, chosen by a hash of the id
    longest: int = 4  #: characters of the longest n-grams


def letters(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case; other digits than decimal ones are no letters."""
    words = _words(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return [w for part in words for w in ("".join(c if c.isalpha() else " " for c in part)).split()]


def _word_rows():
    """Counts of (lang, word), gathered within each task before they leave it."""

    class Work:
        def __init__(self):
            self.counts = Counter()

        def __call__(self, texts, langs):
            for text, lang in zip(texts, langs, strict=True):
                for word, n in Counter(letters(text)).items():
                    self.counts[lang, word] += n
            if len(self.counts) > 200_000:
                yield from self.rest()

        def rest(self):
            out = [(*k, n) for k, n in self.counts.items()]
            self.counts.clear()
            return out

    return Work()


@dataclass(frozen=True)
class Model:
    """Log frequencies of words and n-grams, a row of the arrays for each and a column for each language."""

    langs: tuple[str, ...]
    words: list[str]
    word_logs: np.ndarray
    grams: list[str]
    gram_logs: np.ndarray
    longest: int


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", how: Fit = Fit()) -> Model:
    """The model from rows with a key, a text and a language; of many rows a sample by the key's hash is used.

    What comes to the driver are the sample's words and n-grams with a count for each language.
    """
    rows = labelled.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull())
    n = rows.select(F.lit(1)).count()
    if n > how.sample_rows:
        share = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(1 << 20))
        rows = rows.where(share < F.lit(math.ceil((1 << 20) * how.sample_rows / n)))
    counts = emitted(rows, [text, lang], _word_rows, "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    counts = stored(counts, "language-counts")
    langs = tuple(sorted(r.lang for r in counts.select("lang").distinct().collect()))
    padded = F.concat(F.lit(" "), F.col("unit"), F.lit(" "))
    size = F.lit(how.longest)
    starts = F.explode(F.sequence(F.lit(1), F.length("unit") + 2)).alias("at")
    cuts = counts.select("lang", "n", padded.alias("word"), starts).select("lang", "n", "word", "at", F.explode(F.sequence(F.lit(1), F.least(size, F.length("word") - F.col("at") + 1))).alias("size"))
    grams = cuts.select("lang", F.expr("substring(word, at, size)").alias("unit"), "n").groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    tables = [_log_table(t, langs) for t in (counts, grams)]
    remove_path(counts.sparkSession, counts._scratch)
    return Model(langs, *tables[0], *tables[1], how.longest)


def _log_table(counts: DataFrame, langs: tuple[str, ...]) -> tuple[list[str], np.ndarray]:
    """The units in order, and the logs of their frequencies in each language."""
    if not langs:
        return [], np.empty((0, 0))
    by = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
    got = counts.groupBy("unit").agg(*by).orderBy("unit").toArrow()
    n = np.stack([got.column(f"n{i}").to_numpy() for i in range(len(langs))], 1).astype(float)
    return got.column("unit").to_pylist(), np.log((n + 0.1) / (n.sum(0) + 1.0))


class Scorer:
    """Scores texts with a model; unseen words' scores are cached up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.rows = {w: i for i, w in enumerate(model.words)}
        self.grams = {g: i for i, g in enumerate(model.grams)}
        self.table = np.concatenate([model.word_logs, np.zeros((CACHED_WORDS, len(model.langs)))])
        self.gram_table = model.gram_logs
        self.cached: dict[str, int] = {}

    def unseen(self, words: list[str]) -> np.ndarray:
        """For each word the mean, over the places in it, of the longest known n-gram that starts there."""
        grams, longest = self.grams, self.model.longest
        flat, counts = [], []
        for word in words:
            padded, before = f" {word} ", len(flat)
            size = len(padded)
            for i in range(size - 1):
                for n in range(min(longest, size - i), 0, -1):
                    at = grams.get(padded[i : i + n])
                    if at is not None:
                        flat.append(at)
                        break
            counts.append(len(flat) - before)
        counts = np.array(counts, np.int64)
        sums = np.concatenate([np.zeros((1, len(self.model.langs))), np.cumsum(self.gram_table[flat], 0)]) if flat else np.zeros((1, len(self.model.langs)))
        ends = np.cumsum(counts)
        return (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1)[:, None]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share (0 to 1) among the languages' likelihoods for each word."""
        words = letters(text)
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        rows, cached, known, of, lacking, times = self.rows, self.cached, [], [], [], []
        for word, n in Counter(words).items():
            at = rows.get(word)
            if at is None:
                at = cached.get(word)
            if at is None:
                lacking.append(word)
                times.append(n)
            else:
                known.append(at)
                of.append(n)
        total = np.array(of, float) @ self.table[known] if known else np.zeros(len(self.model.langs))
        for at in range(0, len(lacking), 10_000):
            some = lacking[at : at + 10_000]
            scores = self.unseen(some)
            total = total + np.array(times[at : at + 10_000], float) @ scores
            self.remember(some, scores)
        best = int(np.argmax(total))
        shares = np.exp((total - total[best]) / len(words))
        return self.model.langs[best], float(1.0 / shares.sum())

    def remember(self, words: list[str], scores: np.ndarray) -> None:
        first = len(self.rows)
        if len(self.cached) + len(words) > CACHED_WORDS:
            self.cached.clear()
        start = first + len(self.cached)
        self.table[start : start + len(words)] = scores
        self.cached.update(zip(words, range(start, start + len(words)), strict=True))


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, from the text alone.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if
    no language was learned; a very long text is judged by all its words; ties go to the
    language that sorts first; repeated rows are judged alike; an empty table gives an empty
    one; columns named lang_pred or score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def work(texts):
            for t in texts:
                yield scorer.predict(t)

        return work

    return append_steps(docs, Step([text], make, FIELDS))


def held_out(key: str = "doc_id") -> F.Column:
    """The fold that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
