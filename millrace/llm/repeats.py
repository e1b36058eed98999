"""Long strings that occur more than once, found by prefix doubling over chosen positions.

Names stand for strings as ranks do in prefix doubling: the name of a string of twice the
length is made of the names of its halves. Within a text names are doubled up to ``PROBE``
bytes at every position; a position goes on only if its name is the least in some window, so
that each string of ``min_bytes`` has an anchor, at the same place wherever it occurs. Spark
then sorts anchors by (name, name of the whole surroundings) and names them anew at growing
lengths: anchors with a name of their own leave, those whose whole surroundings come again are
settled, and the others are compared or, where many share a name, narrowed to longer strings
until they are alone or as long as asked for.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Step, append_steps, joined_by, maybe_among, release_memory, stored

#: Bytes that are named at once; longer texts are read in parts that overlap.
PART_BYTES = 1 << 21
#: Repeats at no more than this distance are settled within a part, so that runs of few bytes don't make an anchor of each.
SHORT_PERIOD = 64
#: Groups of one name with more different surroundings are narrowed, others are compared pair by pair within a task.
PAIRED = 128
#: Parts that a range of offsets is cut to at once: each round is some shuffles, however few rows are left.
NARROWED = 8
#: Rows and pairs that are compared at once.
SOLVED_ROWS, SOLVED_PAIRS = 2_000, 16_384
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def probe_bytes(min_bytes: int) -> int:
    """The length of an anchor's own string: a power of two, at most a third of ``min_bytes``."""
    if min_bytes < 24:
        raise ValueError("min_bytes must be 24 at least")
    return 1 << (min_bytes // 3).bit_length() - 1


def _doubled(names: np.ndarray, step: int, length: int) -> np.ndarray:
    """Names of strings made of two named ones, ``step`` apart; ``length`` tells the new length."""
    a, b = names[:-step], names[step:]
    out = a * np.uint64(_FACTORS[0])
    out ^= (b ^ (b >> np.uint64(31))) * np.uint64(_FACTORS[1])
    out += np.uint64(length)
    out ^= out >> np.uint64(29)
    out *= np.uint64(_FACTORS[2])
    out ^= out >> np.uint64(32)
    return out


def names_of(data: np.ndarray, length: int) -> np.ndarray:
    """The name of the string of ``length`` bytes, a power of two of 8 at least, from each position."""
    names = data.astype(np.uint64)
    for k in (1, 2, 4):
        names = names[:-k] | (names[k:] << np.uint64(8 * k))
    k = 8
    while k < length:
        names = _doubled(names, k, 2 * k)
        k *= 2
    return names


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima from both sides of blocks."""
    blocks = np.full((-(-len(keys) // width), width), np.iinfo(np.uint64).max, np.uint64)
    blocks.ravel()[: len(keys)] = keys
    after = np.minimum.accumulate(blocks, axis=1).ravel()[: len(keys)]
    before = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[: len(keys)]
    return np.minimum(before[: len(keys) - width + 1], after[width - 1 :])


def anchors_in(data: np.ndarray, starts: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts of ``min_bytes`` at least that lie one after another, from ``starts``.

    Gives the anchors' positions and names, and first and last starts of runs of strings that
    come again at a short distance. Of such a run only the first period is sent on, for others to meet.
    """
    probe = probe_bytes(min_bytes)
    names = names_of(data, probe)
    inside = np.ones(len(data) - min_bytes + 1, bool)
    for end in starts[1:]:
        inside[end - min_bytes + 1 : end] = False
    places = (1 << 24) - 1
    least = _least((names & np.uint64(~places & (1 << 64) - 1)) | np.arange(len(names), dtype=np.uint64), min_bytes - probe + 1)
    at = np.flatnonzero(inside)
    chosen = (least[at] & np.uint64(places)).astype(np.int64)
    new = np.flatnonzero(np.diff(chosen, prepend=-1))
    anchors = chosen[new]
    gap = np.diff(anchors, prepend=anchors[:1] - SHORT_PERIOD - 1)
    gap[1:][names[anchors[1:]] != names[anchors[:-1]]] = SHORT_PERIOD + 1
    near = gap <= SHORT_PERIOD
    if not near.any():
        return anchors, names[anchors], at[:0], at[:0]
    whole, k = names, probe
    while 2 * k <= min_bytes:
        whole = _doubled(whole, k, 2 * k)
        k *= 2
    if k < min_bytes:
        whole = _doubled(whole, min_bytes - k, min_bytes)
    which = np.cumsum(np.diff(chosen, prepend=-1) != 0) - 1
    back = np.where(near[which], gap[which], 0)
    first = starts[np.searchsorted(starts, at, "right") - 1]
    again = np.flatnonzero((back > 0) & (at - back >= first))
    again = again[whole[at[again]] == whole[at[again] - back[again]]]
    local = np.zeros(len(inside), bool)
    local[at[again]] = local[at[again] - back[again]] = True
    kept = np.ones(len(at), bool)
    kept[again] = False
    anchors = np.unique(chosen[kept])
    edges = np.flatnonzero(np.diff(local.astype(np.int8), prepend=0, append=0))
    return anchors, names[anchors], edges[::2], edges[1::2] - 1


def _parts(texts: list[bytes], min_bytes: int) -> Iterator[list[tuple[int, int, int]]]:
    """Pieces (number of the text, from, to) to be read together; pieces of one text share ``min_bytes - 1`` bytes."""
    held, total = [], 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at >= min_bytes:
            end = min(len(text), at + PART_BYTES)
            if held and total + end - at > PART_BYTES:
                yield held
                held, total = [], 0
            held.append((i, at, end))
            total += end - at
            at = end - min_bytes + 1
    if held:
        yield held


ANCHORS = "x long, y long, pos int, name long, c1 long, c2 long, until int"


def anchor_rows(texts: DataFrame, min_bytes: int) -> DataFrame:
    """(x, y, pos, name, c1, c2, until) of ``texts`` (x, y, text).

    An anchor has its name and a digest of its surroundings (c1, c2); a row with ``until``
    instead is a span that is known to come again at a short distance.
    """
    width = min_bytes - probe_bytes(min_bytes)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def rows(xs, ys, texts: list[bytes]):
        last = (-1, -1)
        for part in _parts(texts, min_bytes):
            data = np.frombuffer(b"".join([texts[i][a:b] for i, a, b in part]), np.uint8)
            starts = np.cumsum([0, *(b - a for _, a, b in part)])
            found, names, first, final = anchors_in(data, starts[:-1], min_bytes)
            owner = np.searchsorted(starts, found, "right") - 1
            out: list[list] = [[] for _ in kinds]
            digests = []
            for at, k, name in zip(found.tolist(), owner.tolist(), names.view(np.int64).tolist(), strict=True):
                i, a, _ = part[k]
                pos = at - int(starts[k]) + a
                if last == (i, pos):  # the piece before had it
                    continue
                last = (i, pos)
                left = min(pos, width)
                digests.append(hashlib.blake2b(texts[i][pos - left : pos + min_bytes], digest_size=16, salt=left.to_bytes(4, "little")).digest())
                for column, value in zip(out, (xs[i], ys[i], pos, name), strict=False):
                    column.append(value)
            both = np.frombuffer(b"".join(digests), np.int64)
            out[4], out[5], out[6] = both[::2], both[1::2], [None] * len(digests)
            if len(first):
                of = np.searchsorted(starts, first, "right") - 1
                for k, a, b in zip(of.tolist(), first.tolist(), final.tolist(), strict=True):
                    i, shift = part[k][0], part[k][1] - int(starts[k])
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((xs[i], ys[i], a + shift, None, None, None, b + shift + min_bytes), kinds, strict=True)], names=schema.names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=schema.names)

    schema = T._parse_datatype_string(ANCHORS)

    def run(batches):
        for batch in batches:
            at = 0
            sizes = pa.compute.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
            while at < batch.num_rows:  # some megabytes at a time
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 2 * PART_BYTES, "right")))
                part = batch.slice(at, n)
                yield from rows(*(part.column(k).to_pylist() for k in range(3)))
                at += n
        release_memory()

    return texts.select("x", "y", F.col("text").cast("binary").alias("text")).where(F.octet_length("text") >= min_bytes).mapInArrow(run, schema)


def _surroundings(texts: DataFrame, places: DataFrame, min_bytes: int) -> DataFrame:
    """``places`` (x, y, pos, name, single, classes) with the bytes before each anchor's string and after it.

    g1 is the name, g2 a digest of the string itself, so that no two strings share both.
    """
    probe = probe_bytes(min_bytes)
    width = min_bytes - probe
    wanted = places.groupBy("x", "y").agg(F.collect_list(F.struct("pos", "name", "single", "classes")).alias("places"))
    some = maybe_among(texts, "x", wanted, "maybe").where("maybe").drop("maybe")
    rows = joined_by(some, wanted, ["x", "y"]).select("x", "y", F.col("text").cast("binary").alias("text"), "places")
    schema = T._parse_datatype_string("x long, y long, pos int, g1 long, g2 long, single boolean, classes long, before binary, after binary")
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]

    def told(x, y, text, place):
        pos = place["pos"]
        own = int.from_bytes(hashlib.blake2b(text[pos : pos + probe], digest_size=8).digest(), "little", signed=True)
        return x, y, pos, place["name"], own, place["single"], place["classes"], text[max(0, pos - width) : pos], text[pos + probe : pos + min_bytes]

    def run(batches):
        done: set[tuple[int, int]] = set()  # copies of a text give the same rows
        for batch in batches:
            for at in range(batch.num_rows):
                x, y, text, found = (batch.column(k)[at].as_py() for k in range(4))
                if (x, y) in done:
                    continue
                if len(done) >= 100_000:
                    done.clear()
                done.add((x, y))
                for some in range(0, len(found), 5_000):
                    out = [told(x, y, text, p) for p in found[some : some + 5_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)
        release_memory()

    return rows.mapInArrow(run, schema)


def _common(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """How many bytes the rows of two matrices have in common at their beginning."""
    differ = a != b
    at = differ.argmax(axis=1)
    at[~differ[np.arange(len(at)), at]] = a.shape[1]
    return np.minimum(at, np.minimum(la, lb))


def _solved(keys: list, pos: np.ndarray, single: np.ndarray, before: list[bytes], after: list[bytes], min_bytes: int) -> list[tuple[int, int, int]]:
    """(row, from, to) of the longest strings around single anchors that another row of their key has too."""
    width = min_bytes - probe_bytes(min_bytes)
    sides = []
    for rows, turned in ((before, True), (after, False)):
        m, n = np.zeros((len(rows), width), np.uint8), np.zeros(len(rows), np.int64)
        for i, row in enumerate(rows):
            got = np.frombuffer(row, np.uint8)
            m[i, : len(got)] = got[::-1] if turned else got
            n[i] = len(got)
        sides.append((m, n))
    left, right = np.full(len(pos), -1), np.full(len(pos), -1)
    pairs, held = [], 0

    def compare():
        one, two = (np.concatenate(z) for z in zip(*pairs, strict=True))
        for s in range(0, len(one), SOLVED_PAIRS):
            i, j = one[s : s + SOLVED_PAIRS], two[s : s + SOLVED_PAIRS]
            (l, r) = (_common(m[i], m[j], n[i], n[j]) for m, n in sides)
            ok = l + r >= width
            np.maximum.at(left, i[ok], l[ok])
            np.maximum.at(right, i[ok], r[ok])
        pairs.clear()

    at = 0
    while at < len(keys):
        end = at
        while end < len(keys) and keys[end] == keys[at]:
            end += 1
        mine = at + np.flatnonzero(single[at:end])
        if len(mine) and end - at > 1:
            one, two = np.repeat(mine, end - at), np.tile(np.arange(at, end), len(mine))
            other = one != two
            pairs.append((one[other], two[other]))
            held += len(one)
            if held >= SOLVED_PAIRS:
                compare()
                held = 0
        at = end
    if pairs:
        compare()
    probe = probe_bytes(min_bytes)
    return [(i, int(pos[i] - left[i]), int(pos[i] + probe + right[i])) for i in np.flatnonzero(left >= 0).tolist()]


def _compared(rows: DataFrame, min_bytes: int) -> DataFrame:
    """Spans (x, y, start, until) of single anchors, from rows (g1, g2, x, y, pos, single, before, after) of groups of bounded size."""
    names = ["g1", "g2", "x", "y", "pos", "single", "before", "after"]
    dealt = rows.select(*names).repartition("g1", "g2").sortWithinPartitions("g1", "g2", "x", "y", "pos")
    schema = T._parse_datatype_string("x long, y long, start int, until int")
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches):
        held: list[tuple] = []

        def flushed(rows):
            keys = [r[:2] for r in rows]
            out = [(rows[i][2], rows[i][3], a, b) for i, a, b in _solved(keys, np.array([r[4] for r in rows]), np.array([r[5] for r in rows], bool), [r[6] for r in rows], [r[7] for r in rows], min_bytes)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if held and row[:5] == held[-1][:5]:
                    continue  # the same place, told by another copy of the text
                if len(held) >= SOLVED_ROWS and row[:2] != held[-1][:2]:
                    yield from flushed(held)
                    held = []
                held.append(row)
        if held:
            yield from flushed(held)
        release_memory()

    return dealt.mapInArrow(run, schema)


def _narrowed(rows: DataFrame, width: int) -> DataFrame:
    """The parts of each row's range of offsets, with the names of what a part needs and of what settles it.

    A string that begins ``o`` bytes before an anchor, for o from ``lo`` to ``hi``, needs ``lo`` bytes
    before the anchor and ``width - hi`` after it; ``hi`` and ``width - lo`` of them settle all such strings.
    """
    edge = "int(lo + floor(({k}) * (hi - lo + 1) / {n}))"
    low, high = edge.format(k="k", n=NARROWED), edge.format(k="k + 1", n=NARROWED)
    ranges = F.expr(f"filter(transform(sequence(0, {NARROWED - 1}), k -> struct({low} as lo, {high} - 1 as hi)), r -> r.lo <= r.hi)")
    parts = rows.withColumn("part", F.explode(ranges)).withColumn("lo", F.col("part.lo")).withColumn("hi", F.col("part.hi")).drop("part")
    parts = parts.where((F.octet_length("before") >= F.col("lo")) & (F.octet_length("after") >= width - F.col("hi")))
    ends = {k: F.expr(f"if({k} = 0, X'', substring(before, octet_length(before) - {k} + 1, {k}))") for k in ("lo", "hi")}
    starts = {k: F.substring("after", F.lit(1), F.lit(width) - F.col(k)) for k in ("lo", "hi")}
    need = [F.lit(0), "g1", "g2", "lo", "hi", ends["lo"], starts["hi"]]
    full = (F.octet_length("before") >= F.col("hi")) & (F.octet_length("after") >= width - F.col("lo"))
    own = [F.when(full, F.hex(ends["hi"])).otherwise(F.concat_ws(" ", "x", "y", "pos")), F.when(full, F.hex(starts["lo"]))]
    new = [F.xxhash64(*need), F.xxhash64(F.lit(1), *need), F.xxhash64(*need, *own), F.xxhash64(F.lit(1), *need, *own)]
    return parts.select("x", "y", "pos", "single", "before", "after", "lo", "hi", *(c.alias(n) for c, n in zip(new, ("n1", "n2", "e1", "e2"), strict=True))).withColumnsRenamed({"n1": "g1", "n2": "g2"})


def _refined(rows: DataFrame, min_bytes: int, paired: int) -> list[DataFrame]:
    """Spans of the single anchors in groups of too many surroundings: narrow, name anew, settle, until the groups are small."""
    width = min_bytes - probe_bytes(min_bytes)
    spans = []
    now = rows.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(width))
    while True:
        parts = stored(_narrowed(now, width).dropDuplicates(["g1", "g2", "x", "y", "pos"]), "repeats-parts")
        classes = parts.groupBy("g1", "g2", "e1", "e2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("x", "y", "pos")).alias("one"), F.bool_and("single").alias("alone"))
        classes = stored(classes.withColumn("open", F.col("alone") & (F.col("n") == 1)), "repeats-classes")
        settled = joined_by(parts.where("single"), classes.where("n > 1").select("g1", "g2", "e1", "e2"), ["g1", "g2", "e1", "e2"])
        spans.append(settled.select("x", "y", F.expr("pos - hi").alias("start"), F.expr(f"pos + {min_bytes} - lo").alias("until")))
        groups = classes.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("classes"), F.max("open").alias("any"))
        groups = groups.where("classes > 1 and any").drop("any")
        ones = joined_by(classes, groups, ["g1", "g2"]).select("g1", "g2", "one.*", F.col("open").alias("still"), "classes")
        ones = joined_by(parts.drop("e1", "e2"), ones, ["g1", "g2", "x", "y", "pos"]).drop("single").withColumnRenamed("still", "single")
        ones = stored(ones, "repeats-ones")
        spans.append(_compared(ones.where(F.col("classes") <= paired), min_bytes))
        now = ones.where((F.col("classes") > paired) & (F.col("lo") < F.col("hi")))
        if not now.take(1):
            return spans


def repeated_spans(texts: DataFrame, min_bytes: int, paired: int = PAIRED) -> DataFrame:
    """(x, y, spans) for ``texts`` (x, y: a key of the text; text) that share a string of ``min_bytes`` with another place.

    ``spans`` are (start, until) in bytes, unordered and overlapping.
    """
    probe = probe_bytes(min_bytes)
    width = min_bytes - probe
    rows = stored(anchor_rows(texts, min_bytes), "repeats-anchors")
    anchors = rows.where(F.col("until").isNull()).drop("until")
    # positions of a name of their own leave
    again = stored(anchors.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "repeats-names")
    some = maybe_among(anchors, "name", again, "maybe").where("maybe").drop("maybe")
    shared = stored(joined_by(some, again, "name"), "repeats-shared")
    same = ["name", "c1", "c2"]
    classes = stored(shared.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("x", "y", "pos")).alias("one")), "repeats-surroundings")
    settled = joined_by(shared, classes.where("n > 1").select(*same), same).select("x", "y", F.greatest(F.lit(0), F.col("pos") - width).alias("start"), (F.col("pos") + min_bytes).alias("until"))
    groups = classes.groupBy("name").agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least")).where("classes > 1 and least = 1").drop("least")
    places = joined_by(classes, groups, "name").select("one.*", "name", (F.col("n") == 1).alias("single"), "classes")
    around = stored(_surroundings(texts, places, min_bytes), "repeats-around")
    spans = [rows.where(F.col("until").isNotNull()).select("x", "y", F.col("pos").alias("start"), "until"), settled, _compared(around.where(F.col("classes") <= paired), min_bytes)]
    many = around.where(F.col("classes") > paired).select("g1", "g2", "x", "y", "pos", "single", "before", "after")
    if many.take(1):
        spans += _refined(many, min_bytes, paired)
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    return every.distinct().groupBy("x", "y").agg(F.collect_list(F.struct("start", "until")).alias("spans"))


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Spans in order, cut at ``size``, those that touch as one."""
    out: list[list[int]] = []
    for start, until in sorted(spans):
        until = min(until, size)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], until)
        else:
            out.append([start, until])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, text: str = "text", min_bytes: int = 400, removed: str = "removed", kept: str = "kept", drop: Sequence[str] = (), paired: int = PAIRED) -> DataFrame:
    """``docs`` with the spans of bytes that a string of ``min_bytes`` covers which also starts elsewhere, and the rest.

    ``removed`` is an array of (start, until) in bytes of the UTF-8 text, in order and without
    overlaps; ``kept`` has the bytes that are left. All occurrences of a repeated string go,
    those in the same text included. A null text is read as empty; it and texts shorter than
    ``min_bytes`` lose nothing; a very long one is read whole, in parts. Repeated rows repeat
    each other and lose all if they are long enough. There are no ties. An empty table gives
    an empty one. Columns named as the new ones are replaced, other columns stay.
    """
    x, y, spans, maybe = (f"{n}_{uuid.uuid4().hex}" for n in ("x", "y", "spans", "maybe"))
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keys = [F.xxhash64(content), F.xxhash64(F.lit(1), content)]
    texts = docs.select(keys[0].alias("x"), keys[1].alias("y"), content.alias("text"))
    found = stored(repeated_spans(texts, min_bytes, paired), "repeats-spans").withColumnsRenamed({"x": x, "y": y, "spans": spans})
    told = maybe_among(docs.withColumn(x, keys[0]).withColumn(y, keys[1]), x, found, maybe)
    parts = joined_by(told.where(maybe), found, [x, y], "left"), told.where(f"not {maybe}").withColumn(spans, F.lit(None).cast(found.schema[spans].dataType))
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("until", T.LongType())]))

    def make():
        def work(texts, cuts):
            for t, cut in zip(texts, cuts, strict=True):
                data = (t or "").encode()
                out = merged([(c["start"], c["until"]) for c in cut], len(data)) if cut else []
                ends = [0, *(b for _, b in out)]
                starts = [*(a for a, _ in out), len(data)]
                yield [{"start": a, "until": b} for a, b in out], b"".join([data[a:b] for a, b in zip(ends, starts, strict=True)])

        return work

    step = Step([text, spans], make, [T.StructField(removed, kind), T.StructField(kept, T.BinaryType())])
    return append_steps(parts[0].unionByName(parts[1]), step, drop=[x, y, spans, maybe, *drop])
