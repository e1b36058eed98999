"""How the tokens of two tokenizers line up, text by text and over a corpus.

The ends of B's tokens in a text are a static index of intervals. For each token of A a
bisection finds which of B's it overlaps; offsets that no token of either spans are the
boundaries of groups. Links are all pairs of an A and a B token of one group. How many
documents hold a pair is summed over the corpus, within tasks first.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Step, append_steps, joined_by, release_memory, stored
from .token_counts import strict_spaces

#: Pairs in the broadcast table (16 bytes each); counts of the others are joined.
TABLE_PAIRS = 1_000_000
#: Pairs that a task sums at once.
SUMMED_PAIRS = 2_000_000
#: A token's text in the byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100.
_PRINTABLE = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))


def _byte_alphabet() -> dict[str, int]:
    plain = {b for r in _PRINTABLE for b in r}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def byte_level_encoder(path: str, pattern: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes | None]]:
    """Encodes with a byte-level BPE of the ``tokenizers`` format; bytes of each id.

    Where a token's id tells the order of its merge, as usual, and pre-tokens are those of
    the pattern, ``tiktoken`` gives the same ids in a quarter of the time; else the file's own library.
    """
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    model, plain = config["model"], config["pre_tokenizer"]
    alphabet = _byte_alphabet()
    vocabulary = {t: i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
    added = {t["content"] for t in config.get("added_tokens", [])}
    bytes_of: list[bytes | None] = [None] * (max(model["vocab"].values()) + 1)
    for token, i in vocabulary.items():
        if token not in added:
            bytes_of[i] = bytes(alphabet[c] for c in token)
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [vocabulary.get(m, -1) for m in merges]
    ordered = all(a < b for a, b in zip(ids, ids[1:], strict=False)) and len(merges) + 256 == sum(b is not None for b in bytes_of)
    simple = plain["type"] == "ByteLevel" and plain.get("use_regex") and not plain.get("add_prefix_space") and not config.get("normalizer") and not model.get("ignore_merges")
    if ordered and simple:
        import tiktoken

        ranks = {b: i for i, b in enumerate(bytes_of) if b is not None}
        own = tiktoken.Encoding("aligned", pat_str=strict_spaces(pattern), mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [own.encode_ordinary(t) for t in texts], bytes_of
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)], bytes_of


def piece_encoder(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes | None]]:
    """Encodes with a ``sentencepiece`` model; bytes of each id, U+2581 read as a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    bytes_of: list[bytes | None] = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        bytes_of.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else None if model.is_control(i) else piece.replace("▁", " ").encode())
    return lambda texts: model.encode(texts, num_threads=1), bytes_of


def group_numbers(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B, from the offsets where tokens end; both cover the same bytes.

    Each end of A is looked for in the index of B's ends: where B has it too, no token spans it.
    """
    at = np.searchsorted(ends_b, ends_a)
    both = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a
    cuts = ends_a[both]
    return np.cumsum(both) - both, np.searchsorted(cuts, ends_b)


def linked_pairs(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair of ids as a * n_b + b, in order; how many links have it) over all groups of a text.

    ``of_a`` and ``of_b`` tell how many tokens a group has. In long groups tokens that come again
    are counted, not paired again.
    """
    a, b, times_a, times_b = a.astype(np.int64), b.astype(np.int64), None, None
    if (of_a * of_b).max() > PAIRED_PLAINLY:
        (a, of_a, times_a), (b, of_b, times_b) = (_distinct(x, of, n_b) for x, of in ((a, of_a), (b, of_b)))
    first, many = np.cumsum(of_b) - of_b, np.repeat(of_b, of_a)
    left = np.repeat(np.arange(len(a)), many)
    right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.repeat(first, of_a), many)
    pairs = a[left] * n_b + b[right]
    if times_a is None:
        return np.unique(pairs, return_counts=True)
    links = times_a[left] * times_b[right]
    pairs, at = np.unique(pairs, return_inverse=True)
    out = np.zeros(len(pairs), np.int64)
    np.add.at(out, at, links)
    return pairs, out


#: Groups of more links than this have their repeated tokens counted first.
PAIRED_PLAINLY = 64


def _distinct(ids: np.ndarray, of: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each group, how many a group has, and how often each comes."""
    base = max(int(ids.max()) + 1, n_b)
    keys, times = np.unique(np.repeat(np.arange(len(of)), of) * base + ids, return_counts=True)
    return keys % base, np.bincount(keys // base, minlength=len(of)), times


def spelled(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, names_a: list[str], names_b: list[str]) -> str:
    """Groups as text: ``a1,a2|b1;a3|b2,b3``; most are one token each, the others are written over."""
    at, bt = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
    out = [f"{names_a[i]}|{names_b[j]}" for i, j in zip(a[at].tolist(), b[bt].tolist(), strict=True)]
    for k in np.flatnonzero((of_a > 1) | (of_b > 1)).tolist():
        i, j = a[at[k] : at[k] + of_a[k]].tolist(), b[bt[k] : bt[k] + of_b[k]].tolist()
        out[k] = f"{','.join([names_a[x] for x in i])}|{','.join([names_b[y] for y in j])}"
    return ";".join(out)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def align_step(path_a: str, path_b: str, pattern: str, text: str, groups: str, pairs: str, links: str) -> Step:
    """New columns: the counts of tokens, groups and links, the groups as text, the pairs of ids and the links of each."""

    def make():
        (encode_a, bytes_a), (encode_b, bytes_b) = byte_level_encoder(path_a, pattern), piece_encoder(path_b)
        held = [pa.array(x, pa.large_binary()) for x in (bytes_a, bytes_b)]
        sizes = [np.array([len(x) if x is not None else 0 for x in y]) for y in (bytes_a, bytes_b)]
        lacking = [np.array([x is None for x in y]) for y in (bytes_a, bytes_b)]
        names = [[str(i) for i in range(len(y))] for y in (bytes_a, bytes_b)]

        def joined(side: int, ids: np.ndarray) -> bytes | None:
            if lacking[side][ids].any():
                return None
            told = held[side].take(pa.array(ids))
            at = np.frombuffer(told.buffers()[1], np.int64)
            return told.buffers()[2].to_pybytes()[at[0] : at[len(ids)]] if told.buffers()[2] else b""

        def work(texts):
            texts = [t or "" for t in texts.to_pylist()]
            counts, spelt, lists = [], [], ([], [])
            for t, a, b in zip(texts, encode_a([" " + t if t else "" for t in texts]), encode_b(texts), strict=True):
                row, said, found = (0, 0, 0, 0), "", (np.zeros(0, np.int64),) * 2
                if t and a and b:
                    whole, x, y = (" " + t).encode(), np.array(a), np.array(b)
                    if joined(0, x) == whole == joined(1, y):
                        in_a, in_b = group_numbers(np.cumsum(sizes[0][x]), np.cumsum(sizes[1][y]))
                        of_a, of_b = np.bincount(in_a), np.bincount(in_b)
                        found = linked_pairs(x, y, of_a, of_b, len(bytes_b))
                        row = len(a), len(b), len(of_a), int((of_a * of_b).sum())
                        said = spelled(x, y, of_a, of_b, *names)
                counts.append(row)
                spelt.append(said)
                for column, values in zip(lists, found, strict=True):
                    column.append(values)
            told = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 4
            return [*told, pa.array(spelt, pa.string()), *(_lists(c) for c in lists)]

        return work

    longs = T.ArrayType(T.LongType())
    return Step([text], make, [*(T.StructField(n, T.LongType()) for n in COUNTS), T.StructField(groups, T.StringType()), T.StructField(pairs, longs), T.StructField(links, longs)], arrays=True)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(r) for r in rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.int64()))


def pair_documents(aligned: DataFrame, pairs: str = "pairs") -> DataFrame:
    """(pair, n): how many rows hold each pair; tasks sum before rows are dealt by pair."""
    schema = T._parse_datatype_string("pair long, n long")

    def run(batches):
        held, total = [], 0

        def summed():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=schema.names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                values = batch.column(0).slice(at, 256).flatten().to_numpy(zero_copy_only=False)
                held.append(values)
                total += len(values)
                if total >= SUMMED_PAIRS:
                    yield summed()
                    held, total = [], 0
        if total:
            yield summed()
        release_memory()

    return aligned.select(pairs).where(F.col(pairs).isNotNull()).mapInArrow(run, schema).groupBy("pair").agg(F.sum("n").alias("n"))


def pair_table(aligned: DataFrame, n_b: int, pairs: str = "pairs") -> DataFrame:
    """(pair, n, best): the documents of each pair, and whether its A id has no pair of more."""
    counts = stored(pair_documents(aligned, pairs), "alignment-pairs").withColumn("a", F.floor(F.col("pair") / n_b))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # no more rows than A's vocabulary has
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(aligned: DataFrame, counts: DataFrame, pairs: str, links: str, n_best: str, count_sum: str, table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """``aligned`` with ``n_best`` (links whose pair is one of its A id's best) and ``count_sum`` (over links).

    The pairs of most documents are looked up in a broadcast table of bounded size; what rows
    hold of others is sent to their counts and back, as sums for each list of pairs.
    """
    spark = aligned.sparkSession
    common = counts.orderBy(F.desc("n"), "pair").limit(table_pairs).toArrow().combine_chunks()
    order = np.argsort(common["pair"].to_numpy())
    known = tuple(common[c].to_numpy()[order] for c in ("pair", "n", "best"))
    shared = spark.sparkContext.broadcast(known)
    rest_pairs, rest_links, k1, k2 = (f"{n}_{uuid.uuid4().hex}" for n in ("pairs", "links", "k1", "k2"))

    def make():
        table, n, best = shared.value

        def work(lists, counts):
            starts = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat, times = (x.flatten().to_numpy(zero_copy_only=False) for x in (lists, counts))
            at = np.minimum(np.searchsorted(table, flat), max(len(table) - 1, 0))
            found = table[at] == flat if len(table) else np.zeros(len(flat), bool)
            values = np.where(found, times * n[at], 0) if len(table) else np.zeros(len(flat), np.int64)
            hits = np.where(found & best[at], times, 0) if len(table) else values
            sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[starts]) for v in (hits, values)]
            left = np.concatenate([[0], np.cumsum(~found)])[starts]
            rest = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(v[~found], pa.int64())) for v in (flat, times)]
            return [pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), *rest]

        return work

    longs = T.ArrayType(T.LongType())
    fields = [T.StructField(n_best, T.LongType()), T.StructField(count_sum, T.LongType()), T.StructField(rest_pairs, longs), T.StructField(rest_links, longs)]
    looked = append_steps(aligned, Step([pairs, links], make, fields, arrays=True))
    if len(common) < table_pairs:  # the table has them all
        return looked.drop(rest_pairs, rest_links)
    looked = stored(looked.withColumn(k1, F.when(F.size(rest_pairs) > 0, F.xxhash64(rest_pairs, rest_links))).withColumn(k2, F.when(F.size(rest_pairs) > 0, F.xxhash64(F.lit(1), rest_pairs, rest_links))), "alignment-looked")
    lists = looked.where(F.col(k1).isNotNull()).select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.explode(F.arrays_zip(F.col(rest_pairs).alias("pair"), F.col(rest_links).alias("links"))).alias("p"))
    rows = lists.select("k1", "k2", "p.*").distinct()  # rows with the same list share its sums
    rows = joined_by(rows, counts, "pair").groupBy("k1", "k2").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more"))
    more = [f"{n}_{uuid.uuid4().hex}" for n in ("best", "sum")]
    rows = rows.withColumnsRenamed({"k1": k1, "k2": k2, "more_best": more[0], "more": more[1]})
    out = joined_by(looked.where(F.col(k1).isNotNull()), rows, [k1, k2])
    out = out.withColumn(n_best, F.col(n_best) + F.col(more[0])).withColumn(count_sum, F.col(count_sum) + F.col(more[1])).drop(*more)
    return out.unionByName(looked.where(F.col(k1).isNull())).drop(k1, k2, rest_pairs, rest_links)


def align_tokenizers(
    docs: DataFrame, path_a: str, path_b: str, pattern: str, text: str = "text", drop: Sequence[str] = (), told: Callable[[Column], Column] | None = None, table_pairs: int = TABLE_PAIRS
) -> DataFrame:
    """``docs`` with how the tokens of " " + text by A line up with those of text by B.

    New columns: ``n_a``, ``n_b``, ``n_groups``, ``n_links``; ``groups`` as text (ids of A,
    ``|``, ids of B; groups are separated by ``;``), or what ``told`` makes of it; ``n_best`` and
    ``count_sum`` over links, from the number of documents that hold a pair of ids linked. Texts
    that are null, empty or not given back by the joined bytes of their tokens have no tokens:
    zeros and ''. Very long texts are aligned whole; in long groups distinct ids are paired, so
    that a run of one token costs one pair. Repeated rows count as documents of their own; ties
    for an A id's best pair all are best. An empty table gives an empty one. Columns named as the
    new ones are replaced, other columns stay.
    """
    pairs, links = (f"{n}_{uuid.uuid4().hex}" for n in ("pairs", "links"))
    n_b = len(piece_encoder(path_b)[1])
    rows = append_steps(docs, align_step(path_a, path_b, pattern, text, "groups", pairs, links), drop=drop)
    rows = stored(rows.withColumn("groups", told(F.col("groups"))) if told else rows, "alignment")
    counts = stored(pair_table(rows, n_b, pairs), "alignment-counts")
    return scored(rows, counts, pairs, links, "n_best", "count_sum", table_pairs).drop(pairs, links)
