"""Personal data by rules, extended by bootstrapped lexical patterns.

Base spans (e-mail addresses, IP addresses, card and phone numbers) are the seeds. Mentions
are base spans and stretches of a looser shape of the same kinds. The lexical patterns of a
mention are up to three words before it, two words after it, or a word on each side. Spark
scores the graph of patterns and instances in rounds: a pattern is as good as the belief in
its instances over all that stands in its place, an instance as good as its good patterns
together. Instances that are believed in induce new patterns in the next round. Patterns
above a confidence find identifiers that the rules miss.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Step, append_steps, dropped_after, emitted, stored

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")


@dataclass(frozen=True)
class Bootstrap:
    """Parameters of the extension by patterns."""

    rounds: int = 4
    least_known: int = 5  #: distinct known instances that a pattern must stand beside
    confidence: float = 0.6  #: of a pattern that may find identifiers
    counted: int = 1_000_000  #: patterns whose other words are counted in one pass over the texts, 8 bytes each
    broadcast: int = 200_000  #: good patterns up to which they are broadcast, 8 bytes each; more are joined


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str):
    for m in _NUMBERS.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) in code points, by kind and start."""
    if not text:
        return []
    out = [(0, *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, *s) for s in _ips(text)]
        out += [(2, *s) for s in _cards(text)]
        if "+" in text:
            out += [(3, *s) for s in _phones(text)]
    return out


_AT = re.compile(r" ?(?:@|\(at\)|\[at\]) ?")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]+)*")
_ADDRESS = re.compile(r"[0-9A-Fa-f.:]+")
_ADDRESS_SHAPE = re.compile(r"[0-9]+(?:[.:][0-9]+){3,}|[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){2,7}")
_CALL = re.compile(r"[(]?[0-9](?:[ ().-]{0,2}[0-9])*")
_TOKEN = re.compile(r"\S+")
#: The words before and after a place that its patterns have.
SHAPES = ((1, 0), (2, 0), (3, 0), (0, 2), (1, 1))
_BEFORE, _AFTER = max(a for a, _ in SHAPES), max(b for _, b in SHAPES)


def _loose_emails(text: str):
    end = 0
    for m in _AT.finditer(text):
        start = m.start()
        if start < end:
            continue
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (host := _HOST.match(text, m.end())):
            end = host.end()
            yield start, end


def _loose_spans(text: str):
    """(kind, start, end) of stretches that look like identifiers, by kind and start, in linear time."""
    if "@" in text or "(at)" in text or "[at]" in text:
        yield from ((0, *s) for s in _loose_emails(text))
    if _DIGIT.search(text) is None:
        return
    for m in _ADDRESS.finditer(text):
        if m.end() - m.start() >= 5 and _ADDRESS_SHAPE.fullmatch(m[0]):
            yield 1, *m.span()
    for m in _CARD.finditer(text):
        if 12 <= len(_DIGIT.findall(m[0])) <= 19:
            yield 2, *m.span()
    for m in _CALL.finditer(text):
        if 7 <= len(_DIGIT.findall(m[0])) <= 15:
            yield 3, *m.span()


def loose_mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the looser stretches that begin where a word does and meet no base span."""
    taken = sorted((s, e) for _, s, e in base)
    reach = [0]  # the furthest end of the base spans up to each one
    for _, e in taken:
        reach.append(max(reach[-1], e))
    out = []
    for kind, start, end in _loose_spans(text):
        if (not start or text[start - 1].isspace()) and reach[bisect_left(taken, (end,))] <= start:
            out.append((kind, start, end))
    return out


def _normal(text: str) -> str:
    return _DIGIT.sub("0", text).lower()


def _words_back(text: str, start: int) -> list[str]:
    """The last words before a place, with digits as 0; none if it doesn't begin a word."""
    if start and not text[start - 1].isspace():
        return []
    size = 120
    while True:
        words = _normal(text[max(0, start - size) : start]).split()
        if len(words) > _BEFORE or size >= start:  # of one more than needed the first may be cut
            return words[-_BEFORE:]
        size *= 4


def _words_on(text: str, end: int) -> list[str]:
    """The first words after a place, but for what is joined to its end."""
    size = 120
    while True:
        part = text[end : end + size]
        words = _normal(part).split()[0 if part[:1].isspace() else 1 :]
        if len(words) > _AFTER or end + size >= len(text):
            return words[:_AFTER]
        size *= 4


_MASK, _MULT = (1 << 64) - 1, 0x9E3779B97F4A7C15


def _word_code(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def _mixed(code, word):
    """One step of a pattern's name, for ints of 64 bits or arrays of them."""
    if isinstance(word, np.ndarray):
        code = code * np.uint64(_MULT) + word
        return code ^ (code >> np.uint64(29))
    code = (code * _MULT + word) & _MASK
    return code ^ (code >> 29)


def _signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


def pattern_name(before: list[str], after: list[str]) -> int:
    """64 bits that name the pattern of these words."""
    code = 4 * len(before) + len(after) + 1
    for w in [*before, *after]:
        code = _mixed(code, _word_code(w))
    return _signed(code)


def patterns_at(text: str, start: int, end: int) -> list[tuple[int, str]]:
    """(name, words with _ in the place) of each pattern that a place has."""
    back, on = _words_back(text, start), _words_on(text, end)
    sides = [(back[len(back) - a :] if a else [], on[:b]) for a, b in SHAPES if a <= len(back) and b <= len(on)]
    return [(pattern_name(x, y), " ".join([*x, "_", *y])) for x, y in sides]


def _mention_rows():
    def work(texts):
        for t in texts:
            if not t:
                continue
            base, rows = base_spans(t), set()
            for known, spans in ((True, base), (False, loose_mentions(t, base))):
                for kind, start, end in spans:
                    for name, words in patterns_at(t, start, end):
                        rows.add((kind, t[start:end].lower(), known, name, words))
            yield from rows

    return work


def other_words(text: str, wanted: np.ndarray, closed: np.ndarray, codes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, word) for each word that stands in the place of a wanted pattern that isn't closed, and is no mention's."""
    words = _normal(text).split()
    for w in words:
        if w not in codes:
            codes[w] = _word_code(w)
    w = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    n, names, places = len(w), [], []
    for a, b in SHAPES:
        if n <= a + b:
            continue
        code = np.full(n - a - b, 4 * a + b + 1, np.uint64)
        for j in [*range(a), *range(a + 1, a + 1 + b)]:
            code = _mixed(code, w[j : j + n - a - b])
        at = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
        hit = np.flatnonzero((wanted[at] == code) & ~closed[at])
        names.append(code[hit])
        places.append(hit + a)
    if not any(map(len, names)):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    name, place = np.concatenate(names), np.concatenate(places)
    base = base_spans(text)
    if spans := base + loose_mentions(text, base):
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        starts, ends, taken = [s for s, _ in tokens], [e for _, e in tokens], np.zeros(n, bool)
        for _, start, end in spans:
            taken[bisect_right(ends, start) : bisect_left(starts, end)] = True
        name, place = name[~taken[place]], place[~taken[place]]
    return name, w[place]


def _other_rows(shared):
    """Rows (pattern, word), each once for a stretch of texts, and (pattern, null) of patterns that have too many.

    A pattern comes with the number of other words beyond which it can never be good; once
    a task has seen more of them, it closes the pattern and sends that alone.
    """

    def make():
        names, limits = shared.value
        order = np.argsort(names.view(np.uint64))
        wanted, limits = names.view(np.uint64)[order], limits[order]

        class Work:
            def __init__(self):
                self.codes, self.found, self.size, self.closed = {}, [], 0, np.zeros(len(wanted), bool)

            def __call__(self, texts):
                for t in texts:
                    if not t:
                        continue
                    if len(self.codes) > 200_000:
                        self.codes.clear()
                    self.found.append(np.stack(other_words(t, wanted, self.closed, self.codes)))
                    self.size += self.found[-1].shape[1]
                    if self.size > 200_000:
                        self.shrink()
                        if self.size > 100_000:
                            yield from self.pairs()

            def shrink(self):
                name, word = np.concatenate(self.found, 1)
                _, once = np.unique(_mixed(name, word), return_index=True)
                name, word = name[once], word[once]
                own, n = np.unique(name, return_counts=True)
                at = np.searchsorted(wanted, own)
                self.closed[at[n > limits[at]]] = True
                still = ~self.closed[np.searchsorted(wanted, name)]
                self.found = [np.stack([name[still], word[still]])]
                self.size = np.count_nonzero(still)

            def pairs(self):
                if self.found:
                    self.shrink()
                rows = [tuple(r) for f in self.found for r in f.view(np.int64).T.tolist()]
                self.found, self.size = [], 0
                return rows

            def rest(self):
                return [*self.pairs(), *((n, None) for n in wanted[self.closed].view(np.int64).tolist())]

        return Work()

    return make


def _name_blocks(names: DataFrame, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (name, most) in blocks of about ``limit``, by the names' own bits."""
    blocks = 1 + names.count() // limit
    for i in range(blocks):
        got = names.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == i).toArrow()
        if len(got):
            yield got.column("name").to_numpy(), got.column("most").to_numpy()


def good_patterns(docs: DataFrame, text: str = "text", how: Bootstrap = Bootstrap()) -> DataFrame | None:
    """(kind, name, pattern, confidence) of the patterns that may find identifiers, or None without any.

    All counts are over all rows, of distinct instances and distinct other words, so that
    copies of a text weigh no more than one. The texts are read once for the mentions and
    once for each ``how.counted`` patterns that enough instances have; of a pattern that has
    too many other words ever to be good only that is kept. The rounds are joins of what was
    gathered there.
    """
    spark = docs.sparkSession
    rows = emitted(docs, [text], _mention_rows, "kind int, instance string, base boolean, name long, pattern string")
    rows = stored(rows.groupBy("kind", "name", "instance").agg(F.max("base").alias("base"), F.min("pattern").alias("pattern")), "pii-mentions")
    support = rows.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.count_if("base").alias("seeds"), F.min("pattern").alias("pattern"))
    support = stored(support.where(F.col("n") >= how.least_known), "pii-support")
    if not support.where(F.col("seeds") >= how.least_known).head(1):  # else no pattern could ever be believed
        return None
    edges = stored(rows.join(support.select("name").distinct(), "name").select("kind", "name", "instance", "base"), "pii-edges")
    instances = edges.select("name", "instance").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("instances"))
    # with more other words than this, not even belief in all instances of a kind would do
    most = F.floor(F.col("n") / how.confidence - F.col("instances") + 1e-9)
    names = stored(support.groupBy("name").agg(F.max("n").alias("n")).join(instances, "name").select("name", "instances", F.greatest(most, F.lit(-1)).alias("most")), "pii-names")
    others = None
    for block in _name_blocks(names.select("name", "most"), how.counted):
        found = emitted(docs, [text], _other_rows(spark.sparkContext.broadcast(block)), "name long, word long").distinct()
        found = found.groupBy("name").agg(F.when(F.max(F.col("word").isNull()), F.lit(float("inf"))).otherwise(F.count("word").cast("double")).alias("others"))
        found = stored(found, "pii-others")
        others = found if others is None else others.unionByName(found)
    total = names.join(others, "name", "left").select("name", (F.col("instances") + F.coalesce("others", F.lit(0.0))).alias("total"))
    support = stored(support.join(total, "name").select("kind", "name", "pattern", "total"), "pii-patterns")
    seeds = edges.where("base").select("kind", "instance").distinct().withColumn("belief", F.lit(1.0))
    believed, before, good = seeds, None, None
    for _ in range(how.rounds):
        known = edges.join(believed, ["kind", "instance"]).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.sum("belief").alias("s"))
        scored = known.where(F.col("n") >= how.least_known).join(support, ["kind", "name"]).withColumn("confidence", F.col("s") / F.col("total"))
        good = stored(scored.where(F.col("confidence") >= how.confidence).select("kind", "name", "pattern", "confidence"), "pii-good")
        now = tuple(good.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("kind", "name"))).first())
        if not now[0] or now == before:
            break
        before = now
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), F.lit(1.0) - F.col("confidence")))))
        new = edges.where("not base").join(good, ["kind", "name"]).groupBy("kind", "instance").agg((F.lit(1.0) - doubt).alias("belief"))
        believed = stored(seeds.unionByName(new).groupBy("kind", "instance").agg(F.max("belief").alias("belief")), "pii-beliefs")
    return dropped_after(good, rows, names, edges, support)


def _extended(base: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans that meet no base span those without overlaps, from the left; of one place the longest, then the first kind."""
    out, reached = [], 0
    for kind, start, end in sorted(set(found), key=lambda s: (s[1], -s[2], s[0])):
        if start >= reached:
            out.append((kind, start, end))
            reached = end
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_NEW = [T.StructField("base_spans", SPANS), T.StructField("spans", SPANS)]


def _both(base, found):
    as_rows = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans]
    return as_rows(base), as_rows(sorted(base + _extended(base, found)) if found else base)


def _finding(shared):
    """Base spans, and all spans by the good patterns, of texts."""

    def make():
        good = {kind: frozenset(names.tolist()) for kind, names in (shared.value if shared else {}).items()}

        def work(texts):
            for t in texts:
                base = base_spans(t)
                loose = loose_mentions(t, base) if t and good else []
                yield _both(base, [m for m in loose if m[0] in good and any(n in good[m[0]] for n, _ in patterns_at(t, *m[1:]))])

        return work

    return make


def _digest(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _place_rows():
    def work(texts, digests):
        for t, digest in zip(texts, digests, strict=True):
            for kind, start, end in loose_mentions(t, base_spans(t)) if t else ():
                for name, _ in patterns_at(t, start, end):
                    yield digest, kind, start, end, name

    return work


def _joined(docs: DataFrame, good: DataFrame, text: str, after: Sequence[Step], drop: Sequence[str]) -> DataFrame:
    """As ``_finding``, for good patterns that are too many for a broadcast: places meet them in a join by name."""
    source = docs.select(F.col(f"`{text}`").alias("t")).where("t is not null")
    places = emitted(source.select("t", _digest(F.col("t")).alias("digest")), ["t", "digest"], _place_rows, "digest binary, kind int, start int, end int, name long")
    hits = places.distinct().join(good.select("kind", "name"), ["kind", "name"]).select("digest", F.struct("kind", "start", "end").alias("span")).distinct()
    held = [f"{name}_{uuid.uuid4().hex}" for name in ("digest", "found")]
    by_text = stored(hits.groupBy(F.col("digest").alias(held[0])).agg(F.collect_list("span").alias(held[1])), "pii-found")
    joined = docs.withColumn(held[0], _digest(F.col(f"`{text}`"))).join(by_text, held[0], "left")

    def make():
        def work(texts, found):
            for t, own in zip(texts, found, strict=True):
                yield _both(base_spans(t), [(s["kind"], s["start"], s["end"]) for s in own or []])

        return work

    return append_steps(joined, Step([text, held[1]], make, _NEW), *after, drop=[*held, *drop])


def personal_data(docs: DataFrame, text: str = "text", how: Bootstrap = Bootstrap(), after: Sequence[Step] = (), drop: Sequence[str] = ()) -> DataFrame:
    """``docs`` with base_spans and spans (base and found ones), each by kind and start.

    Offsets are code points, ends exclusive. A null or empty text has no spans; a very long
    one is read whole, and so are long identifiers and words beside them. Of overlapping
    found spans the one that starts first stays, then the longest, then the kind listed
    first. Repeated rows get equal spans and support patterns once; an empty table learns
    no pattern. Columns named base_spans or spans are replaced, other columns stay.
    ``after`` are steps that follow in the same pass, and columns named in ``drop`` are
    left out.
    """
    good = good_patterns(docs, text, how)
    if good is not None and good.count() > how.broadcast:
        return _joined(docs, good, text, after, drop)
    names: dict[int, list[int]] = {}
    for r in good.select("kind", "name").collect() if good is not None else ():
        names.setdefault(r.kind, []).append(r.name)
    shared = docs.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in names.items()}) if names else None
    return append_steps(docs, Step([text], _finding(shared), _NEW), *after, drop=drop)


def redact_step(text: str = "text") -> Step:
    """Replaces spans by their kind in brackets."""

    def make():
        def work(texts, spans):
            for t, own in zip(texts, spans, strict=True):
                if not t or not own:
                    yield (t,)
                    continue
                parts, at, end = [], 0, 0
                for s in sorted(own, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] < end:
                        end = max(end, s["end"])
                        continue
                    parts += [t[max(at, end) : s["start"]], f"[{s['kind'].upper()}]"]
                    at, end = s["start"], s["end"]
                yield ("".join([*parts, t[end:]]),)

        return work

    return Step([text, "spans"], make, [T.StructField(text, T.StringType())])


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``personal_data`` with spans replaced by their kind in brackets.

    Where spans of several kinds overlap, the whole stretch gets the first one's kind; null
    texts stay null, and texts without spans, whatever their length, stay as they are.
    """
    return append_steps(docs, redact_step(text))


def without_personal_data(docs: DataFrame, text: str = "text", how: Bootstrap = Bootstrap()) -> DataFrame:
    """``docs`` with what ``personal_data`` finds replaced as by ``redacted``, in one pass where patterns are broadcast.

    Columns named base_spans or spans are left out.
    """
    return personal_data(docs, text, how, [redact_step(text)], ["base_spans", "spans"])


def joined_spans(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(column: str, kind: str) -> F.Column:
    return F.filter(column, lambda s: s["kind"] == kind)
