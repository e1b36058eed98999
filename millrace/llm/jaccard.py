"""N-gram Jaccard join with prefix trees.

Documents become sets of hashed word n-grams; equal sets are one. Two linked sets share
n-grams among the first few of each under any global order, so only sets that share one
there are compared:

1. Under the order of the hashes, with n-grams that are frequent in a sample moved to the
   end, a prefix somewhat longer than needed is compared. A set that shares too few n-grams
   with all others' prefixes can't be linked with any and is dropped. Most sets are.
2. For the others, n-grams are ordered by their exact number of sets.
3. Copies are drawn together: each set goes to the room of one n-gram of its prefix, chosen
   by a hash, and a room's sets, in parts of bounded size, go into a prefix tree. A set is
   compared by one walk, in which sets that begin alike share the overlap counted so far; a
   subtree is left when the rest of its lengths can't reach the threshold, or when all its
   sets are connected with the walking one already. Further rounds take other n-grams and
   parts, and only rooms with sets that are still apart, so a group of near copies costs a
   few walks for each copy and no list of pairs. Rounds save pairs; they decide no result.
4. Of what is then still apart, sets are compared that share an n-gram of their prefixes at
   places, and with lengths, from which a link is possible: each such set walks the prefix
   trees of its candidates. Sets that are connected already are no candidates, so that texts
   which share passages without being near copies cost what they share.

The result is exact but for 64-bit hashes of n-grams; sets are named by 128-bit hashes.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, dropped_after, emitted, joined_by, maybe_among, stored
from .components import components

_U = np.uint64
_MULT, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Bytes that are hashed at once; bounds the tables of powers unless a word is longer.
_PIECE = 1 << 18
#: The sample that tells frequent n-grams: rows, sets that must have one, n-grams kept.
SAMPLE_ROWS, SAMPLE_LEAST, FREQUENT = 5_000, 8, 100_000
#: Sets that a task remembers to have sent already.
_SEEN = 50_000
#: Sets, and n-grams of sets, that are put into one tree, about.
PART_SETS, PART_GRAMS = 96, 2_000_000
#: Sets, and n-grams, that are handed to Python in one call, about.
BATCH_SETS, BATCH_GRAMS = 1_500, 4_000_000
#: Rounds in which copies are drawn together before pairs are looked at: at most so many, and
#: another one only while a round connects one of so many sets that took part.
ROUNDS, WORTH = 6, 16
#: Lengths of one band are within this factor.
BAND = 1.1


class _Powers:
    up = np.ones(1, _U)
    down = np.ones(1, _U)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, _MULT, _U)]))
                cls.down = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, _INV, _U)]))
        return cls.up, cls.down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word (bytes other than space and 9 to 13), in order."""
    b = np.frombuffer(data, np.uint8)
    word = (b != 32) & ((b < 9) | (b > 13))
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(b) and word[0]:
        edges = np.concatenate([[0], edges])
    if len(edges) % 2:
        edges = np.concatenate([edges, [len(b)]])
    starts, ends = edges[::2], edges[1::2]
    out, first = np.empty(len(starts), _U), 0
    while first < len(starts):
        base = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, base + _PIECE, "right")))
        stop = int(ends[last - 1])
        up, down = _Powers.to(max(stop - base, _PIECE))
        sums = np.concatenate([np.zeros(1, _U), np.cumsum((b[base:stop].astype(_U) + _U(1)) * up[: stop - base])])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = _mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))
        first = last
    return out


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams, or of all words if they are fewer."""
    if not text:
        return np.empty(0, np.int64)
    words = word_hashes(text.encode("utf-8").lower())
    n = min(size, len(words))
    if not n:
        return np.empty(0, np.int64)
    count = len(words) - n + 1
    g = np.full(count, n, _U)
    for i in range(n):
        g = g * _U(_MULT) + words[i : i + count]
    return np.unique(_mixed(g).view(np.int64))


def signature(grams: np.ndarray) -> bytes | None:
    """128 bits that name a set, or None for the empty one."""
    import xxhash

    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def short(sig: bytes | None) -> int | None:
    """64 bits of a signature, for the first pass, in which a clash costs no result."""
    return int.from_bytes(sig[:8], "little", signed=True) if sig is not None else None


def _split(grams: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(frequent):
        return grams, grams[:0]
    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
    hot = frequent[at] == grams
    return grams[~hot], grams[hot]


def _least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


class _Seen:
    """Remembers the latest sets of a task, so that copies are sent once."""

    def __init__(self):
        self.kept: OrderedDict[bytes, None] = OrderedDict()

    def __call__(self, sig: bytes) -> bool:
        if sig in self.kept:
            self.kept.move_to_end(sig)
            return True
        self.kept[sig] = None
        if len(self.kept) > _SEEN:
            self.kept.popitem(last=False)
        return False


def _set_rows(size: int):
    def make():
        def work(ids, texts):
            for i, t in zip(ids, texts, strict=True):
                grams = shingles(t, size)
                sig = signature(grams)
                yield i, len(grams), sig, short(sig)

        return work

    return make


def _gram_rows(size: int):
    def make():
        seen = _Seen()

        def work(texts):
            for t in texts:
                grams = shingles(t, size)
                sig = signature(grams)
                if sig is not None and not seen(sig):
                    yield from ((h,) for h in grams.tolist())

        return work

    return make


def _prefix_rows(size: int, percent: int, shared):
    """(gram, short sig, need): a prefix's n-grams that aren't frequent, and how many must be shared.

    The prefix has n // 12 n-grams beyond those needed, so a linked set shares as many; the
    least partner has ``percent`` of n, hence ``need``. Frequent n-grams count as shared. A
    set that needs no more sends (sig, sig, 0) to stay, and its prefix for others to meet.
    """

    def make():
        seen, frequent = _Seen(), shared.value

        def work(texts):
            for t in texts:
                grams = shingles(t, size)
                sig, n = signature(grams), len(grams)
                if sig is None or seen(sig):
                    continue
                cold, _ = _split(grams, frequent)
                least = _least_overlap(n, percent)
                length = min(n, n - least + max(1, n // 12))
                need, own = max(1, least // 12) - max(0, length - len(cold)), short(sig)
                if need <= 0:
                    yield own, own, 0
                yield from ((h, own, max(0, need)) for h in cold[:length].tolist())

        return work

    return make


def _full_rows(size: int, shared):
    def make():
        seen, frequent = _Seen(), shared.value

        def work(texts):
            for t in texts:
                grams = shingles(t, size)
                sig = signature(grams)
                if sig is not None and not seen(sig):
                    cold, hot = _split(grams, frequent)
                    yield sig, len(grams), cold, hot

        return work

    return make


class PrefixTree:
    """Sets of small ints, ordered, in a tree whose nodes hold chains; walks find links."""

    def __init__(self, percent: int, width: int, groups: list):
        self.percent = percent
        self.mark = np.zeros(width, bool)
        self.top = _Node(np.empty(0, np.int64), 0)
        self.parent = list(range(len(groups)))
        first: dict = {}
        for i, g in enumerate(groups):  # sets of one group are connected already
            self.parent[i] = first.setdefault(g, i)

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def insert(self, i: int, grams: np.ndarray) -> None:
        node, at, n = self.top, 0, len(grams)
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if node.member < 0:
                node.member = i
            elif not node.several and self.find(node.member) != self.find(i):
                node.several = True
            if at == n:
                node.ends.append(i)
                return
            child = node.children.get(int(grams[at]))
            if child is None:
                child = node.children[int(grams[at])] = _Node(grams[at:], n)
                at = n
            else:
                k = min(len(child.chain), n - at)
                differ = np.flatnonzero(child.chain[:k] != grams[at : at + k])
                k = int(differ[0]) if len(differ) else k
                if k < len(child.chain):
                    upper = _Node(child.chain[:k], child.depth - len(child.chain) + k)
                    upper.least, upper.most, upper.member, upper.several = child.least, child.most, child.member, child.several
                    child.chain = child.chain[k:]
                    upper.children[int(child.chain[0])] = child
                    node.children[int(grams[at])] = child = upper
                at += k
            node = child

    def links(self, i: int, grams: np.ndarray) -> list[int]:
        """Sets of the tree that ``i`` links with and wasn't connected with; they are connected then."""
        out, n, percent, mark = [], len(grams), self.percent, self.mark
        mark[grams] = True
        stack = [(self.top, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.member < 0 or node.most * 100 < percent * n or node.least * percent > 100 * n:
                continue
            if not node.several and self.find(node.member) == self.find(i):
                continue
            rest = n
            if len(node.chain):
                overlap += int(np.count_nonzero(mark[node.chain]))
                rest = n - int(np.searchsorted(grams, node.chain[-1], "right"))
            need = -(-percent * (n + max(node.least, _least_overlap(n, percent))) // (100 + percent))
            if overlap + min(rest, node.most - node.depth) < need:
                continue
            for j in node.ends:
                if 100 * overlap >= percent * (n + node.depth - overlap) and self.find(j) != self.find(i):
                    self.parent[self.find(j)] = self.find(i)
                    out.append(j)
            stack += [(child, overlap) for child in node.children.values()]
        mark[grams] = False
        return out


class _Node:
    __slots__ = ("chain", "depth", "children", "ends", "least", "most", "member", "several")

    def __init__(self, chain: np.ndarray, depth: int):
        self.chain, self.depth, self.children, self.ends = chain, depth, {}, []
        self.least, self.most, self.member, self.several = 1 << 60, 0, -1, False


def tree_links(sets: list[np.ndarray], groups: list, probes: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links that connect what can be connected: every set that is no probe is in the tree, and
    every set walks it (each one before it goes in), or only the probes if there are any."""
    if not sets:
        return []
    sizes = [len(s) for s in sets]
    grams, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(grams), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(grams))  # frequent ones first: long common beginnings
    ordered = [np.sort(s) for s in np.split(rank[code], np.cumsum(sizes)[:-1])]
    tree, out = PrefixTree(percent, len(grams), groups), []
    if any(probes):
        for i, probe in enumerate(probes):
            if not probe:
                tree.insert(i, ordered[i])
        for i, probe in enumerate(probes):
            if probe:
                out += [(i, j) for j in tree.links(i, ordered[i])]
        return out
    for i in sorted(range(len(sets)), key=sizes.__getitem__):
        out += [(i, j) for j in tree.links(i, ordered[i])]
        tree.insert(i, ordered[i])
    return out


def _walked(percent: int):
    """Links (a, b), as the sets' groups, found in the rooms of a batch, each of which has a prefix tree of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, room in pdf.groupby("room", sort=False):
            sets = [np.concatenate([c, h]).astype(np.int64) for c, h in zip(room.cold, room.hot, strict=True)]
            groups = room.grp.tolist()
            links += [(groups[i], groups[j]) for i, j in tree_links(sets, groups, room.probe.tolist(), percent)]
        return pd.DataFrame(links, columns=["a", "b"], dtype=object)

    return run


def _linked(rooms: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, bool]:
    """Links between groups (a, b) within the rooms of rows (room, sig, n, grp, probe), and whether they are many."""
    rooms = stored(rooms, "jaccard-rooms")
    rows, grams = rooms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0))).first()
    batches = 1 + max(rows // BATCH_SETS, grams // BATCH_GRAMS)
    dealt = rooms.drop("n").withColumn("batch", F.pmod("room", F.lit(batches)))
    present = maybe_among(sets.select("sig", "cold", "hot"), "sig", rooms, "maybe").where("maybe").drop("maybe")
    found = dealt.join(present, "sig").groupBy("batch").applyInPandas(_walked(percent), "a binary, b binary")
    found = dropped_after(stored(found, "jaccard-links"), rooms)
    return found, found.count() * WORTH > rows


def ngram_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, sig, short): the size of a document's set and the hashes that name it (null: empty)."""
    kind = docs.schema[key].dataType.simpleString()
    return emitted(docs, [key, text], _set_rows(size), f"doc_id {kind}, n_shingles long, sig binary, short long")


def frequent_grams(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Hashes of n-grams that many sampled sets have, sorted; they only decide the order."""
    rows = docs.select(F.col(f"`{text}`").alias("t"))
    n = rows.select(F.lit(1)).count()
    if n > SAMPLE_ROWS:
        rows = rows.where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < F.lit(max(1, (1 << 20) * SAMPLE_ROWS // n)))
    counts = emitted(rows, ["t"], _gram_rows(size), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.where(F.col("n") >= SAMPLE_LEAST).orderBy(F.desc("n"), "gram").limit(FREQUENT).collect()
    return np.array(sorted(r.gram for r in kept), np.int64)


def near_sets(docs: DataFrame, sets_of: DataFrame, key: str, text: str, percent: int, size: int) -> DataFrame:
    """(sig, n, cold, hot) of the sets that share enough of a prefix with others, and perhaps of a few more, frequent n-grams apart."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_grams(docs, text, size))
    prefix = emitted(docs, [text], _prefix_rows(size, percent, shared), "gram long, sig long, need int")
    by_gram = Window.partitionBy("gram")
    met = prefix.withColumn("lo", F.min("sig").over(by_gram)).withColumn("hi", F.max("sig").over(by_gram))
    met = met.where("if(need = 0, gram = sig, lo <> hi)").select("sig", "gram", "need").distinct()
    near = met.groupBy("sig").agg(F.count(F.lit(1)).alias("met"), F.max("need").alias("need")).where("met >= need").select(F.col("sig").alias("short"))
    # their sets, from the texts of one document each; a few more do no harm, so that no text need be shuffled
    ids = stored(sets_of.join(near, "short").groupBy("sig").agg(F.min("doc_id").alias("id")).where("id is not null").select("id"), "jaccard-near")
    source = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("t"))
    texts = maybe_among(source, "id", ids, "maybe").where("maybe or id is null")
    full = emitted(texts, ["t"], _full_rows(size, shared), "sig binary, n int, cold array<bigint>, hot array<bigint>", rows_at_once=SLICE_ROWS)
    return dropped_after(stored(full.dropDuplicates(["sig"]), "jaccard-sets"), ids)


def needed_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(sig, n, own, taken): of each set's needed prefix, under the order by the number of sets that
    have an n-gram and frequent n-grams last, how many no other set has, and those others have."""
    grams = sets.select("sig", F.explode("cold").alias("gram"))
    counted = grams.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("gram"))).where("df > 1")
    common = counted.groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("common"))
    n, none = F.col("n"), F.array().cast("array<bigint>")
    ordered = F.concat(F.coalesce(F.transform("common", lambda x: x["gram"]), none), F.col("hot"))
    own = (F.col("n_cold") - F.when(F.col("common").isNull(), 0).otherwise(F.size("common"))).cast("int")
    take = (n - F.ceil(n * F.lit(percent) / F.lit(100)) + 1).cast("int") - own
    taken = F.when(take > 0, F.slice(ordered, F.lit(1), take)).otherwise(none)
    first = sets.select("sig", "n", F.size("cold").alias("n_cold"), "hot").join(common, "sig", "left").select("sig", "n", own.alias("own"), taken.alias("taken"))
    return first.where(F.size("taken") > 0)


def _merged(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (sig, grp) once the links between groups are followed; a group is named by its least set."""
    roots = components(links).select(F.col("node").alias("grp"), "root")
    out = grouped.join(roots, "grp", "left").select("sig", F.coalesce("root", "grp").alias("grp"))
    return dropped_after(stored(out, "jaccard-groups"), grouped, links)


def _drawn_together(first: DataFrame, turn: int, part_sets: int) -> DataFrame:
    """Rooms of the sets that chose the same n-gram of their prefixes and aren't all connected."""
    chosen = F.array_min(F.transform("taken", lambda g: F.struct(F.xxhash64(F.lit(turn), g).alias("h"), g.alias("g"))))["g"]
    members = first.select("sig", "n", "grp", chosen.alias("gram"))
    sizes = members.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n").cast("long")).alias("w"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
    sizes = sizes.where("lo <> hi").select("gram", F.greatest(F.ceil(F.col("m") / part_sets), F.ceil(F.col("w") / PART_GRAMS)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(turn), "sig"), F.col("parts"))
    return joined_by(members, sizes, "gram").select(F.xxhash64("gram", part).alias("room"), "sig", "n", "grp", F.lit(False).alias("probe"))


def candidate_pairs(first: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, na, ga, b, nb, gb), a not shorter, of sets that aren't connected and may link by their prefixes.

    The first n-gram that two linked sets share stands so early in both that the rest can
    still hold the overlap they need; pairs meet by (n-gram, band of the shorter length).
    Of each n-gram's sets, those of the largest group are never paired with each other.
    """
    placed = first.select("sig", "n", "grp", F.posexplode("taken").alias("i", "gram"), "own").withColumn("pos", F.col("own") + F.col("i")).drop("i", "own")
    by_group = placed.groupBy("gram", "grp").agg(F.count(F.lit(1)).alias("m"))
    mixed = by_group.groupBy("gram").agg(F.max_by("grp", F.struct("m", "grp")).alias("major"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select("gram", "major")
    placed = stored(joined_by(placed, mixed, "gram").withColumn("minor", F.col("grp") != F.col("major")).drop("major"), "jaccard-placed")

    def overlap(n, m):  # that two sets of such lengths need
        return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))

    def band(n):
        return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(BAND)))).cast("int")

    n, pos = F.col("n"), F.col("pos")
    least = F.ceil(n * F.lit(percent) / F.lit(100))
    index = placed.where(n - pos >= overlap(n, n)).select("gram", band(n).alias("band"), *(F.col(c).alias(f"{c}_b") for c in ("sig", "n", "grp", "pos", "minor")))
    probe = placed.withColumn("band", F.explode(F.sequence(band(least), band(n))))
    probe = probe.where(n - pos >= overlap(n, F.greatest(least, F.floor(F.pow(F.lit(BAND), F.col("band"))) - 1)))
    na, nb = n, F.col("n_b")
    may = ((na > nb) | ((na == nb) & (F.col("sig") > F.col("sig_b")))) & (F.lit(100) * nb >= F.lit(percent) * na) & (F.col("grp") != F.col("grp_b"))
    may = may & (na - pos >= overlap(na, nb)) & (nb - F.col("pos_b") >= overlap(na, nb))
    ways = ((probe.where("minor"), index), (probe.where("not minor"), index.where("minor_b")))
    met = [a.join(b, ["gram", "band"]).where(may).select("sig", "n", "grp", "sig_b", "n_b", "grp_b") for a, b in ways]
    return dropped_after(stored(met[0].unionByName(met[1]).distinct(), "jaccard-pairs"), placed)


def _visits(pairs: DataFrame, part_sets: int) -> DataFrame:
    """Rooms in which a set walks the tree of its candidates, or of a part of them."""
    degree = pairs.groupBy("sig").agg(F.greatest(F.ceil(F.count(F.lit(1)) / part_sets), F.ceil(F.sum(F.col("n_b").cast("long")) / PART_GRAMS)).cast("int").alias("parts"))
    room = lambda part: F.xxhash64(F.lit("visit"), "sig", part).alias("room")
    hosts = joined_by(pairs, degree, "sig").select(room(F.pmod(F.xxhash64("sig_b"), F.col("parts")).cast("int")), F.col("sig_b").alias("sig"), F.col("n_b").alias("n"), F.col("grp_b").alias("grp"), F.lit(False).alias("probe"))
    guests = pairs.select("sig", "n", "grp").distinct().join(degree, "sig").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return hosts.unionByName(guests.select(room(F.col("part").cast("int")), "sig", "n", "grp", F.lit(True).alias("probe")))


def set_groups(sets: DataFrame, percent: int, part_sets: int = PART_SETS) -> DataFrame:
    """(sig, grp) of the sets of ``near_sets`` that may link with any; the sets that are linked, directly or not, have one grp."""
    first = stored(needed_prefixes(sets, percent), "jaccard-first")
    grouped = stored(first.select("sig", F.col("sig").alias("grp")), "jaccard-groups")
    for turn in range(ROUNDS):
        links, many = _linked(_drawn_together(first.join(grouped, "sig"), turn, part_sets), sets, percent)
        grouped = _merged(grouped, links)
        if not many:
            break
    pairs = candidate_pairs(first.join(grouped, "sig"), percent)
    links, _ = _linked(_visits(pairs, part_sets), sets, percent)
    return dropped_after(_merged(grouped, links), first, pairs)


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, size: int = 5, part_sets: int = PART_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Rows link when the Jaccard similarity of their sets is at least ``percent`` per cent, a
    tie at the threshold included. A null text, or one without words, has an empty set and
    links with nothing. A very long text is one set like any other, which a tree of its own
    may hold. Repeated rows have one component and stay rows; a null id can't name a
    component unless all its ids are null; an empty table gives an empty result; other
    columns, whatever their names, are not read.
    """
    rows = stored(ngram_sets(docs, key, text, size), "jaccard-docs")
    sets_of = rows.where("sig is not null")
    sets = near_sets(docs, sets_of, key, text, percent, size)
    groups = dropped_after(set_groups(sets, percent, part_sets), sets)
    least = sets_of.groupBy("sig").agg(F.min("doc_id").alias("least"))
    named = stored(least.join(groups, "sig", "left").select("sig", F.coalesce("grp", "sig").alias("grp"), "least"), "jaccard-named")
    ids = named.groupBy("grp").agg(F.min("least").alias("component_id"))
    out = rows.join(joined_by(named, ids, "grp").select("sig", "component_id"), "sig", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, size: int = 5, part_sets: int = PART_SETS) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates as ``ngram_components`` has them.

    The row with the least id stays, null ids being the greatest; of different texts under
    that id, the one whose digest is least. Rows that agree in id and text are one document,
    of which the row with the least hash stays; an empty text and a null one agree. Texts
    without words are near duplicates of nothing. All columns are kept; an empty table stays
    empty; texts of any length are compared whole.
    """
    own, body = F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = F.struct(own.isNull().alias("none"), own.alias("id"), F.substring(F.unhex(F.sha2(body.cast("binary"), 256)), 1, 16).alias("digest"))
    found = ngram_components(docs.select(named.alias("key"), F.col(f"`{text}`").alias("text")), "key", "text", percent, size, part_sets)
    held, flag = f"key_{uuid.uuid4().hex}", f"maybe_{uuid.uuid4().hex}"
    # keys that go or are repeated; only rows that may have one are shuffled, the others stay as they are
    keys = found.groupBy(F.col("doc_id").alias(held)).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"), F.count(F.lit(1)).alias("copies"))
    keys = stored(keys.where("not first or copies > 1").select(held, "first"), "jaccard-keys")
    rows, columns = maybe_among(docs.withColumn(held, named), held, keys, flag), [F.col(f"`{c}`") for c in docs.columns]
    unsure = rows.where(F.col(flag))
    once = rows.where(~F.col(flag)).select(columns).unionByName(unsure.join(keys, held, "left_anti").select(columns))
    repeated = unsure.join(keys.where("first"), held, "left_semi").groupBy(held).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row"))
    return once.unionByName(repeated.select("row.*"))
