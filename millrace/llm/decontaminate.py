"""Benchmark decontamination with a generalised suffix automaton of the test items.

All items go into one automaton over words. A document's words are streamed through it;
the state tells the longest suffix read so far that occurs in an item, so a word ends an
occurrence of a window as soon as that length reaches the window's. Items shorter than a
window are windows as a whole. Hit words are merged into spans, and spans or documents
beyond the limits are removed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Step, append_steps, emitted, stored

#: Words of an item or document once A-Z are lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Items are put into automata of at most so many words (or one item), each broadcast by itself.
AUTOMATON_WORDS = 100_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_find = re.compile(WORD).finditer
_words = re.compile(WORD).findall


def words_of(text: str | None) -> list[str]:
    return _words(text.translate(_LOWER)) if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the windows that end in each state."""

    def __init__(self, items: Iterable[tuple[str | None, list[str]]], window: int):
        self.window = window
        self.next: list[dict[str, int]] = [{}]
        self.link: list[int] = [-1]
        self.len: list[int] = [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._mark(items)

    def _new(self, length: int, edges: dict[str, int], link: int) -> int:
        self.next.append(edges)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, q: int, w: str) -> int:
        """A copy of q for the shorter words that reach it from p and p's suffixes."""
        copy = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: str) -> int:
        q = self.next[last].get(w)
        if q is not None:  # an earlier item has this sequence
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, w)
        new, p = self._new(self.len[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, w)
        return new

    def _mark(self, items: list[tuple[str | None, list[str]]]) -> None:
        """For each state the state of its suffix of a window's length, short items that end in it, items by window."""
        size, window = len(self.len), self.window
        self.full: list[int] = [-1] * size
        for s in sorted(range(size), key=self.len.__getitem__):
            if self.len[s] >= window:
                self.full[s] = s if self.len[self.link[s]] < window else self.full[self.link[s]]
        self.items: dict[int, set] = {}
        short: dict[int, list[tuple[int, str | None]]] = {}
        for name, words in items:
            s = 0
            for i, w in enumerate(words):
                s = self.next[s][w]
                if i + 1 >= window:
                    self.items.setdefault(self.full[s], set()).add(name)
            if len(words) < window:
                while self.len[self.link[s]] >= len(words):
                    s = self.link[s]
                short.setdefault(s, []).append((len(words), name))
        self.short = short
        #: The state itself or its nearest suffix that has short items, or -1.
        self.near: list[int] = [-1] * size
        for s in sorted(range(size), key=self.len.__getitem__):
            self.near[s] = s if s in short else self.near[self.link[s]] if s else -1

    def scan(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end, matched length, state) for each word at which an item's words are matched."""
        edges, link, length, s, n = self.next, self.link, self.len, 0, 0
        for i, w in enumerate(words):
            t = edges[s].get(w)
            if t is None:
                while s and t is None:
                    s = link[s]
                    t = edges[s].get(w)
                if t is None:
                    n = 0
                    continue
                n = length[s]
            s = t
            n += 1
            yield i + 1, n, s

    def match(self, words: list[str]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans [start, end) of hit words, and the names of items with occurring windows."""
        spans: list[tuple[int, int]] = []
        names: set = set()
        window, near, full, short = self.window, self.near, self.full, self.short
        any_short = bool(short)
        for end, n, s in self.scan(words):
            start = end
            if n >= window:
                start = end - window
                names |= self.items[full[s]]
            if any_short:
                t = near[s]
                while t >= 0:
                    for size, name in short[t]:
                        if size <= n:
                            start = min(start, end - size)
                            names.add(name)
                    t = near[self.link[t]] if t else -1
            if start < end:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, end))
        return spans, names


def _blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str | None, list[str]]]]:
    """Items in blocks of at most ``limit`` words (or one item), a block at a time on the driver."""
    block, size = [], 0
    for row in items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t")).toLocalIterator():
        words = words_of(row.t)
        if block and size + len(words) > limit:
            yield block
            block, size = [], 0
        block.append((row.i, words))
        size += len(words)
    yield block


FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
])


def _digest(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text", automaton_words: int = AUTOMATON_WORDS, after: Sequence[Step] = (), drop: Sequence[str] = ()) -> DataFrame:
    """``docs`` with n_words, hit_spans (word offsets, end exclusive) and hit_items (sorted).

    Items come to the driver in blocks, one at a time, each of at most ``automaton_words``
    words or one item, and each block's automaton is broadcast alone, so that what workers
    hold doesn't grow with the number of items. One block is matched in one narrow pass. Of
    several, each gives only the spans and items of texts that it hits, by the texts'
    digests; these meet the documents in one join at the end, and no text is written.

    Null or empty texts and items have no words. A very long text is streamed whole; its
    words are held at once, and so are a very long item's. An item with a null id counts for
    hits but isn't named; equal ids count as one item, and items that tie are all named.
    Repeated rows are matched alike. Without documents or items there are no rows or no
    hits. Columns of ``docs`` named like the three new ones are replaced. ``after`` are
    steps that follow in the same pass, and columns named in ``drop`` are left out.
    """
    blocks = _blocks(items, item_id, item_text, automaton_words)
    first, more = next(blocks), next(blocks, None)
    if more is None:
        return append_steps(docs, Step([text], _matching(docs, first, window), FIELDS.fields), *after, drop=drop)
    source = docs.select(F.col(f"`{text}`").alias("t")).where("t is not null")
    found = None
    for block in chain([first, more], blocks):
        hits = emitted(source.select("t", _digest(F.col("t")).alias("digest")), ["t", "digest"], _hit_rows(_matching(docs, block, window)), _HITS)
        hits = stored(hits.distinct(), "benchmark-hits")
        found = hits if found is None else found.unionByName(hits)
    own = uuid.uuid4().hex  # no column of the documents is named so
    held = [f"{name}_{own}" for name in ("digest", "spans", "items")]
    hit_items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items"))))
    by_text = found.groupBy(F.col("digest").alias(held[0])).agg(F.flatten(F.collect_list("hit_spans")).alias(held[1]), hit_items.alias(held[2]))
    joined = docs.withColumn(held[0], _digest(F.col(f"`{text}`"))).join(stored(by_text, "benchmark-texts"), held[0], "left")
    return append_steps(joined, Step([text, *held[1:]], _merging, FIELDS.fields), *after, drop=[*held, *drop])


def _matching(docs: DataFrame, block: list, window: int):
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def make():
        machine = SuffixAutomaton(shared.value, window)

        def work(texts):
            for t in texts:
                words = words_of(t)
                spans, names = machine.match(words)
                names.discard(None)
                yield len(words), spans, sorted(names)

        return work

    return make


_HITS = "digest binary, hit_spans array<array<int>>, hit_items array<string>"


def _hit_rows(matching):
    def make():
        match = matching()

        def work(texts, digests):
            for digest, (_, spans, names) in zip(digests, match(texts), strict=True):
                if spans:
                    yield digest, spans, names

        return work

    return make


def _merging():
    def work(texts, spans, names):
        for t, own, items in zip(texts, spans, names, strict=True):
            yield len(words_of(t)), merged([tuple(s) for s in own or []]), items or []

    return work


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def hit_words() -> F.Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, s: total + (s[1] - s[0]).cast("long"))


def contaminated(coverage_percent: int = 5) -> F.Column:
    """Whether the hit words are at least ``coverage_percent`` of a document's words."""
    return (hit_words() > 0) & (hit_words() * 100 >= F.col("n_words") * coverage_percent)


def cut_step(text: str = "text", least_words: int = 13) -> Step:
    """Cuts the hit spans of ``least_words`` words or more out of the text."""

    def make():
        def work(texts, spans):
            for t, own in zip(texts, spans, strict=True):
                long = [s for s in own or [] if s[1] - s[0] >= least_words]
                if not t or not long:
                    yield (t,)
                    continue
                places, parts, at = [m.span() for m in _find(t.translate(_LOWER))], [], 0
                for start, end in long:
                    parts.append(t[at : places[start][0]])
                    at = places[end - 1][1]
                yield ("".join([*parts, t[at:]]),)

        return work

    return Step([text, "hit_spans"], make, [T.StructField(text, T.StringType())])


def without_spans(docs: DataFrame, text: str = "text", least_words: int = 13) -> DataFrame:
    """Rows of ``benchmark_hits`` with the hit spans of ``least_words`` words or more cut out of the text.

    A null text stays null; without such spans a text, whatever its length, stays as it is.
    """
    return append_steps(docs, cut_step(text, least_words))


def decontaminated(docs: DataFrame, items: DataFrame, coverage_percent: int = 5, least_words: int = 13, window: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, without long hit spans, in one pass where one block of items suffices.

    A document whose hit words are at least ``coverage_percent`` of its words goes; of the
    others, spans of ``least_words`` hit words or more are cut out. Nulls, long texts, ties
    and the rest are as in ``benchmark_hits``; documents without hits stay as they are, and
    so do the columns, but for the three that ``benchmark_hits`` names.
    """
    hits = benchmark_hits(docs, items, window, text, item_id, item_text, after=[cut_step(text, least_words)], drop=["hit_items"])
    return hits.where(~contaminated(coverage_percent)).drop("hit_spans", "n_words")
