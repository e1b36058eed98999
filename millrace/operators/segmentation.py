"""Words of scripts that put no spaces between them, by a lexicon that the corpus itself teaches.

Candidates are the strings of a few characters that come often and hold together. Each run of
characters is a lattice of the words it may consist of; the path of greatest log frequency is its
segmentation. The words of those paths are counted over the corpus, and their frequencies make the
next lattice, for some rounds. Search mode adds the shorter words that stand inside long ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written

#: Runs that are segmented: Chinese characters, kana without spaces.
UNSPACED = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{20000}-\x{2FFFF}]+"
#: Other tokens: runs of letters and digits of any script.
SPACED = r"[\p{L}\p{M}\p{N}]+"
#: Words of a lexicon at most, the most frequent ones; it is broadcast.
LEXICON_WORDS = 200_000
#: Segmentations that a task remembers; longer runs aren't.
CACHED_RUNS, CACHED_CHARS = 50_000, 32
#: Characters of a run that are segmented at once; a cut falls where the best path has a boundary.
LATTICE_CHARS = 4_096


@dataclass(frozen=True)
class Lexicon:
    """Words with their log frequencies, the longest word's length and what an unknown character costs."""

    words: dict[str, float]
    longest: int
    unknown: float

    @classmethod
    def of(cls, counts: dict[str, int]) -> Lexicon:
        total = sum(counts.values()) or 1
        return cls({w: float(np.log(n / total)) for w, n in counts.items()}, max(map(len, counts), default=1), float(np.log(0.5 / total)))


def best_path(run: str, lexicon: Lexicon) -> list[str]:
    """The words of the lattice's path of greatest log frequency; of equal paths the one with longer words from the end."""
    words, longest, unknown = lexicon.words, lexicon.longest, lexicon.unknown
    out: list[str] = []
    while run:
        part = run[:LATTICE_CHARS]
        score, back = [0.0] * (len(part) + 1), [0] * (len(part) + 1)
        for end in range(1, len(part) + 1):
            best, at = score[end - 1] + words.get(part[end - 1], unknown), end - 1
            for start in range(end - 2, max(-1, end - longest - 1), -1):
                known = words.get(part[start:end])
                if known is not None and score[start] + known >= best:
                    best, at = score[start] + known, start
            score[end], back[end] = best, at
        path, end = [], len(part)
        while end:
            path.append(part[back[end] : end])
            end = back[end]
        path.reverse()
        if len(part) < len(run):  # the last words may go on beyond the part
            kept = path[: max(1, len(path) - longest)]
            out += kept
            run = run[sum(map(len, kept)) :]
        else:
            out += path
            run = ""
    return out


def searched(word: str, lexicon: Lexicon) -> list[str]:
    """A word as search mode gives it: known words of two and three characters inside it, then itself."""
    inside = [word[i : i + n] for n in (2, 3) if len(word) > n for i in range(len(word) - n + 1)]
    return [w for w in inside if w in lexicon.words] + [word]


def _runs(docs: DataFrame, text: str, runs: str) -> DataFrame:
    """(run, n): the distinct runs of the texts and how often they come."""
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(runs), F.lit(0))).alias("run"))
    return found.groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def _most(counts: DataFrame, words: int) -> dict[str, int]:
    return {r.word: r.n for r in counts.orderBy(F.desc("n"), "word").limit(words).toLocalIterator()}


def candidates(runs: DataFrame, longest: int, least: int, cohesion: float) -> DataFrame:
    """(word, n): single characters, and strings of up to ``longest`` that come ``least`` times and hold together.

    A string holds together if at each place it is ``cohesion`` times as frequent as its two halves would be by chance.
    """
    chars = runs.select(F.split("run", "").alias("c"), "n")
    grams = F.expr(f"flatten(transform(filter(sequence(1, {longest}), k -> k <= size(c)), k -> transform(sequence(1, size(c) - k + 1), i -> array_join(slice(c, i, k), ''))))")
    counts = written(chars.select(F.explode(grams).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.length("word") == 1)), "segment-grams")
    total = counts.where("length(word) = 1").agg(F.sum("n")).first()[0] or 1
    halves = counts.where("length(word) > 1").select("word", "n", F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> struct(substring(word, 1, i) as a, substring(word, i + 1) as b))")).alias("h")).select("word", "n", "h.*")
    parts = [counts.select(F.col("word").alias(c), F.col("n").alias(f"n{c}")) for c in ("a", "b")]
    halves = halves.join(parts[0], "a").join(parts[1], "b")
    tight = halves.groupBy("word").agg(F.first("n").alias("n"), F.min(F.col("n") * F.lit(float(total)) / (F.col("na").cast("double") * F.col("nb"))).alias("hold"))
    return counts.where("length(word) = 1").unionByName(tight.where(F.col("hold") >= cohesion).select("word", "n"))


def _counted(rows: DataFrame, shared) -> DataFrame:
    """(word, n) of the best paths of all runs (run, n), summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, held = shared.value, {}
        for batch in batches:
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in best_path(text, lexicon):
                    held[word] = held.get(word, 0) + n
            if len(held) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
                held = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learned(docs: DataFrame, text: str = "text", runs: str = UNSPACED, longest: int = 4, least: int = 3, cohesion: float = 8.0, rounds: int = 3, words: int = LEXICON_WORDS) -> Lexicon:
    """The lexicon of a corpus: candidates, then ``rounds`` of segmenting all runs and counting the words of the paths.

    A word that no path uses leaves; single characters stay known. Null texts are read as empty;
    a corpus without runs gives an empty lexicon.
    """
    rows = written(_runs(docs, text, runs), "segment-runs")
    lexicon = Lexicon.of(_most(candidates(rows, longest, least, cohesion), words))
    spark = docs.sparkSession
    for _ in range(rounds if lexicon.words else 0):
        lexicon = Lexicon.of(_most(_counted(rows, spark.sparkContext.broadcast(lexicon)), words))
    return lexicon


def from_words(counts: DataFrame, words: int = LEXICON_WORDS) -> Lexicon:
    """A lexicon of given words (word, n)."""
    return Lexicon.of(_most(counts, words))


def _segmented(texts: pd.Series, lexicon, search: bool, runs: str) -> list[list[str] | None]:
    import regex

    split = regex.compile(f"(?P<run>{_named(runs)})|(?:(?!{_named(runs)}){SPACED})+").finditer
    held, cache, out = lexicon.value, {}, []
    for text in texts:
        if text is None:
            out.append(None)
            continue
        row: list[str] = []
        for m in split(text.lower()):
            if m.group("run") is None:
                row.append(m.group())
                continue
            found = cache.get(m.group())
            if found is None:
                path = best_path(m.group(), held)
                found = [x for w in path for x in searched(w, held)] if search else path
                if len(m.group()) <= CACHED_CHARS:
                    if len(cache) >= CACHED_RUNS:
                        cache.clear()
                    cache[m.group()] = found
            row += found
        out.append(row)
    return out


def _named(pattern: str) -> str:
    """Java's \\x{...} as this library writes characters."""
    import re

    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m.group(1), 16):08X}", pattern)


def segmenter(spark, lexicon: Lexicon, search: bool = True, runs: str = UNSPACED):
    """A function from a column of texts to their tokens, in order: words of runs, and other letters and digits as they stand.

    A null text has no tokens. Usable as ``words`` of the keyword index.
    """
    work = partial(_segmented, lexicon=spark.sparkContext.broadcast(lexicon), search=search, runs=runs)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series(work(texts))

    def column(text: Column) -> Column:
        return cut(F.coalesce(text, F.lit("")))

    return column
