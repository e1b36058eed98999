"""How sources of a language differ in their words: wide term vectors, pair contributions, sums.

Each kept term is one row with an array that has a place for every source of its language.
Higher-order functions turn the counts into smoothed shares and emit what the term adds to
pairs of sources; sums by pair are formed on the map side first. All arithmetic is exact:
shares are whole billionths plus one, and divisions round down.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release_memory, stored

#: What stands between terms, which are runs of ASCII letters and of characters beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A share is 1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept terms)).
SCALE, SMOOTH = 1_000_000_000, 2
#: Documents whose words are summed at once within a task.
SUMMED_DOCS = 2_048
#: The table of sources is broadcast if it has no more rows than this, else joined by a shuffle.
BROADCAST_SOURCES = 50_000


@dataclass(frozen=True)
class TermVectors:
    """``terms``: lang, term, n (by source, in the order of ``sources``); ``sources``: lang, sources, totals, kept."""

    terms: DataFrame
    sources: DataFrame


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term and documents that have it.

    The term null stands for the document itself, so that each source has a row. Words are
    split in the JVM and summed in Arrow batches, some documents at a time, before rows are made of them.
    """
    words = F.array_remove(F.split(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), _UPPER, _LOWER), BETWEEN), "")
    names = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    schema = T._parse_datatype_string("lang string, source string, term string, n long, docs long")

    def summed(langs: pa.Array, sources: pa.Array, lists: pa.Array) -> pa.RecordBatch:
        n = len(langs)
        codes = [c.cast(pa.string()).dictionary_encode() for c in (langs, sources)]
        many = max(1, len(codes[1].dictionary))
        of = codes[0].indices.to_numpy().astype(np.int64) * many + codes[1].indices.to_numpy()
        group, of = np.unique(of, return_inverse=True)
        coded = lists.flatten().cast(pa.string()).dictionary_encode()
        keys = coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lists.value_lengths().to_numpy())
        keys, times = np.unique(keys, return_counts=True)
        both, at = np.unique((keys // n) * len(group) + of[keys % n], return_inverse=True)
        term, g = both // max(1, len(group)), np.concatenate([both % max(1, len(group)), np.arange(len(group))])
        sums = [np.concatenate([np.bincount(at, w, len(both)).astype(np.int64), last]) for w, last in ((times, np.zeros(len(group), np.int64)), (None, np.bincount(of, minlength=len(group))))]
        terms = pa.concat_arrays([coded.dictionary.take(pa.array(term)), pa.nulls(len(group), pa.string())])
        columns = [codes[0].dictionary.take(pa.array(group[g] // many)), codes[1].dictionary.take(pa.array(group[g] % many)), terms, pa.array(sums[0]), pa.array(sums[1])]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SUMMED_DOCS):
                yield summed(*batch.slice(at, SUMMED_DOCS).columns)
        release_memory()

    rows = docs.select(*names, words.alias("words")).mapInArrow(run, schema)
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def term_vectors(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10) -> TermVectors:
    """The terms that at least ``least_docs`` documents of a language have, with their counts by source."""
    counts = term_counts(docs, text, lang, source)
    # one row per term; its list is as long as the term has sources
    lists = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by_source"))
    kept = stored(lists.where(F.col("term").isNull() | (F.col("docs") >= least_docs)), "divergence-terms")
    # each source has the row of the term null, with n = 0, and so a total
    totals = kept.select("lang", "term", F.explode("by_source").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("total"))
    terms = kept.where(F.col("term").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    by_lang = totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("all")).join(terms, "lang", "left")
    sources = stored(by_lang.select("lang", F.col("all.source").alias("sources"), F.col("all.total").alias("totals"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept")), "divergence-sources")
    few = (sources.agg(F.sum(F.size("sources"))).first()[0] or 0) <= BROADCAST_SOURCES
    own = F.map_from_entries("by_source")
    wide = kept.where(F.col("term").isNotNull()).select("lang", "term", own.alias("own")).join(F.broadcast(sources) if few else sources, "lang")
    return TermVectors(wide.select("lang", "term", F.transform("sources", lambda s: F.coalesce(F.try_element_at("own", s), F.lit(0).cast("long"))).alias("n"), "sources", "totals", "kept"), sources)


def share(n: Column, total: Column, kept: Column) -> Column:
    """A count's smoothed share in billionths, plus one; decimals, since the product can pass 64 bits."""
    whole = (n + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", whole, (total + SMOOTH * kept).cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so that the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_gaps(vectors: TermVectors) -> DataFrame:
    """(lang, source, other, value) for every two sources of a language, both ways.

    A term is emitted only for pairs of which one source has it: those that have it with all
    after them, and with those before that lack it. Where neither has a term, its part
    depends on the two totals alone, so that it is counted once and multiplied.
    """
    p = F.zip_with("n", "totals", lambda n, total: share(n, total, F.col("kept")))
    wide = vectors.terms.select("lang", "n", p.alias("p"))
    met = "flatten(transform(filter(sequence(0, size(n) - 1), i -> n[i] > 0), i -> transform(filter(sequence(0, size(n) - 1), j -> j > i or (j < i and n[j] = 0)), j -> struct(least(i, j) as a, greatest(i, j) as b, (p[i] - p[j]) * (p[i] - p[j]) div (p[i] + p[j]) as f))))"
    sums = wide.select("lang", F.inline(F.expr(met))).groupBy("lang", "a", "b").agg(F.sum("f").alias("value"), F.count(F.lit(1)).alias("met"))
    # every pair of sources: as many rows as the report itself has
    numbered = vectors.sources.select("lang", "sources", "totals", "kept", F.posexplode("sources").alias("a", "source"))
    pairs = numbered.select("lang", "sources", "totals", "kept", "a", "source", F.posexplode("sources").alias("b", "other")).where("a <> b")
    none = F.lit(0).cast("long")
    both = [share(none, F.col("totals")[F.col(c)], F.col("kept")) for c in ("a", "b")]
    pairs = pairs.select("lang", "source", "other", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kept", F.when(F.col("kept") > 0, gap(*both)).otherwise(0).alias("apart"))
    out = pairs.join(sums, ["lang", "a", "b"], "left")
    value = F.coalesce("value", none) + (F.col("kept") - F.coalesce("met", none)) * F.col("apart")
    return out.select("lang", "source", "other", value.cast("long").alias("value"))


def term_gaps(vectors: TermVectors) -> DataFrame:
    """(lang, source, term, value) for terms that a source has more of than its language."""
    whole = F.aggregate("n", F.lit(0).cast("long"), lambda x, y: x + y)
    total = F.aggregate("totals", F.lit(0).cast("long"), lambda x, y: x + y)
    q = vectors.terms.select("*", share(whole, total, F.col("kept")).alias("q"))
    rows = q.select("lang", "term", "q", "kept", F.inline(F.arrays_zip("sources", "totals", "n"))).where("n > 0")
    rows = rows.select("lang", F.col("sources").alias("source"), "term", "q", share(F.col("n"), F.col("totals"), F.col("kept")).alias("p")).where("p > q")
    return rows.select("lang", "source", "term", gap(F.col("p"), F.col("q")).alias("value"))


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10) -> DataFrame:
    """The audit: (lang, source, part, item, value, rank).

    Part ``pair`` ranks the other sources of the language by their distance; part ``term``
    ranks the ``top`` terms that stand out in the source. Null texts, languages and sources
    are read as empty; an empty or very long text is one document like others, and a language
    without kept terms has pairs of value 0. Repeated rows count as often as they stand there.
    Ties go by the item's bytes. An empty table gives an empty report. Other columns, with
    any names, are not looked at.
    """
    vectors = term_vectors(docs, text, lang, source, least_docs)
    parts = {"pair": pair_gaps(vectors).withColumnRenamed("other", "item"), "term": term_gaps(vectors).withColumnRenamed("term", "item")}
    ranked = None
    for part, rows in parts.items():
        place = F.expr("row_number() over (partition by lang, source order by value desc, item)")
        rows = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))
        rows = rows.where(F.col("rank") <= top) if part == "term" else rows  # the first of each task go on
        ranked = rows if ranked is None else ranked.unionByName(rows)
    return ranked
