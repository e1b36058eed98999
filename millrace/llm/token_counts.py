"""Token counts by a two-tier look-up on the map side.

Tier one is a compact table of frequent pre-tokens with their lengths in tokens, made
from a bounded sample of texts and broadcast. Tier two is a cache in each worker, which
the tokenizer library fills for pre-tokens that tier one lacks. No pre-token is ever
shuffled; the tables decide the speed only, since both tiers hold what the library says.
"""

from __future__ import annotations

import json
import math
import os
from array import array
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Step, append_steps

#: Bounds of tier one: sampled texts, characters of a sampled text, entries.
SAMPLE_ROWS, SAMPLE_CHARS, TABLE_ENTRIES = 1_000, 20_000, 30_000
#: Entries of a worker's cache, which starts anew when it is full.
CACHE_ENTRIES = 300_000
#: Longer pre-tokens aren't cached.
CACHED_CHARS = 64


def strict_spaces(pattern: str) -> str:
    """The pattern with ``\\s`` spelled as the Unicode property that the libraries use."""
    return pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}")


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _splitters(path: str, pattern: str):
    """A function from a text to (special tokens in it, its pre-tokens)."""
    import regex

    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    plain = config["pre_tokenizer"]
    if config.get("normalizer") or plain["type"] != "ByteLevel" or plain["add_prefix_space"] or not plain["use_regex"]:
        raise ValueError("only tokenizers that split bytes by the pattern, without a normalizer, are supported")
    added = config.get("added_tokens", [])
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that take in their surroundings are not supported")
    special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
    words = regex.compile(strict_spaces(pattern)).findall

    def split(text: str) -> tuple[int, list[str]]:
        if special is None or special.search(text) is None:
            return 0, words(text)
        parts = special.split(text)
        return len(parts) - 1, [w for p in parts for w in words(p)]

    return split


def frequent_lengths(docs: DataFrame, text: str, path: str, pattern: str, sample_rows: int = SAMPLE_ROWS, entries: int = TABLE_ENTRIES) -> tuple[list[str], bytes]:
    """Tier one: pre-tokens that are frequent in a bounded sample, and their lengths."""
    texts = docs.select(F.col(f"`{text}`").alias("t"))
    share = sample_rows / max(1, texts.select(F.lit(1)).count())
    if share < 1:  # by a hash of the text, so that no part of the table is favoured
        texts = texts.where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < F.lit(math.ceil((1 << 20) * share)))
    rows = texts.where(F.length("t") <= SAMPLE_CHARS).limit(2 * sample_rows).collect()
    split, counts = _splitters(path, pattern), Counter()
    for row in rows:
        counts.update(split(row.t)[1])
    words = [w for w, _ in counts.most_common(entries) if len(w) <= CACHED_CHARS]
    lengths = [len(e.ids) for e in _tokenizer(path).encode_batch(words, add_special_tokens=False)]
    return words, array("H", lengths).tobytes()


def token_counts(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text, as the library gives it.

    Special tokens' strings in a text count as one token, the library's default. A null
    or empty text has 0 tokens; a very long one is counted whole; repeated rows each get
    their count; words that tie for a place in tier one cost time at most; an empty table
    gives an empty one. A column named as ``out`` is replaced, other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text, path, pattern))

    def make():
        words, packed = shared.value
        lengths = array("H")
        lengths.frombytes(packed)
        known = dict(zip(words, lengths, strict=True))
        split, library, cache = _splitters(path, pattern), _tokenizer(path), {}

        def work(texts):
            nonlocal cache
            parts = [split(t) if t else (0, ()) for t in texts]
            lacking = {w for _, ws in parts for w in ws if w not in known and w not in cache}
            if len(cache) + len(lacking) > CACHE_ENTRIES:
                cache = {}
                lacking = {w for _, ws in parts for w in ws if w not in known}
            own, order = {}, list(lacking)
            for at in range(0, len(order), 4096):
                some = order[at : at + 4096]
                for w, e in zip(some, library.encode_batch(some, add_special_tokens=False), strict=True):
                    (cache if len(w) <= CACHED_CHARS else own)[w] = len(e.ids)
            for n_special, ws in parts:
                n = n_special
                for w in ws:
                    k = known.get(w)
                    if k is None:
                        k = cache.get(w)
                        if k is None:
                            k = own[w]
                    n += k
                yield (n,)

        return work

    return append_steps(docs, Step([text], make, [T.StructField(out, T.LongType())]))
