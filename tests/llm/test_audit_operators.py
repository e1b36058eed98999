"""Alignment, divergence and repeated strings against brute force; odd rows; limits that were lifted."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from millrace.llm import alignment, divergence, embeddings, language, repeats, sharding, warc

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", "  two  spaces ", "tabs\tand\nlines\r\n", "naïve café", "日本語のテキスト", "emoji 👩‍👩‍👧 🇩🇪", "▁ lower block ▁", "<|endoftext|> here", "<0x41><s></s><unk>",
    "ﬁ ligature ½ ①", " nbsp　wide", "a\x00b", "x" * 3_000, "the the the " * 900, "=" * 700, "É é", "don't we'll 12345 3.14",
]


# --- alignment ---


def plain_groups(text, tok, sp, alphabet):
    if not text:
        return []
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    in_a = [bytes(alphabet[c] for c in tok.id_to_token(i)) for i in a]
    in_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in b)]
    if b"".join(in_a) != (" " + text).encode() or b"".join(in_b) != (" " + text).encode():
        return []
    ends = [set(itertools.accumulate(map(len, x))) for x in (in_a, in_b)]
    cuts = sorted(ends[0] & ends[1])
    out = [([], []) for _ in cuts]
    for side, (ids, told) in enumerate(((a, in_a), (b, in_b))):
        for i, end in zip(ids, itertools.accumulate(map(len, told)), strict=True):
            out[next(k for k, c in enumerate(cuts) if end <= c)][side].append(i)
    return out


@pytest.fixture(scope="module")
def aligned_texts():
    rng = random.Random(4)
    words = ["the", "Größe", "über", "tokenizer", "naïve", "e", "12", "foo_bar", "日本", "≠", "--", "\n"]
    return ODD + [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)] + ["the same text", "the same text"]


@pytest.mark.parametrize("table_pairs", [1_000_000, 40, 0])
def test_alignment_equals_brute_force(spark, aligned_texts, table_pairs):
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    groups = [plain_groups(t, tok, sp, alignment._byte_alphabet()) for t in aligned_texts]
    counts = Counter(p for g in groups for p in {(x, y) for a, b in g for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    want = []
    for i, g in enumerate(groups):
        links = [(x, y) for a, b in g for x in a for y in b]
        told = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        want.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), told))
    docs = spark.createDataFrame(list(enumerate(aligned_texts)), "doc_id long, text string").withColumn("pair", F.lit("kept")).withColumn("n_a", F.lit("replaced")).repartition(3)
    out = alignment.align_tokenizers(docs, A, B, P.PATTERN, table_pairs=table_pairs)
    got = sorted(tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect())
    assert got == want
    assert out.select("pair").distinct().collect() == [("kept",)]
    assert any(w[1] == 0 and t for w, t in zip(want, aligned_texts, strict=True)) and want[1][7] == ""


def test_alignment_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_tokenizers(docs, A, B, P.PATTERN).collect() == []


def test_fast_encoder_equals_the_files_library(aligned_texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    encode, bytes_of = alignment.byte_level_encoder(A, P.PATTERN)
    texts = [" " + t for t in aligned_texts if t]
    assert encode(texts) == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(b"".join(bytes_of[i] for i in ids) == t.encode() for ids, t in zip(encode(texts), texts, strict=True))


def test_runs_of_one_token_are_paired_once():
    pairs, links = alignment.linked_pairs(np.array([7] * 1_000), np.array([3] * 900), np.array([1_000]), np.array([900]), 10)
    assert pairs.tolist() == [73] and links.tolist() == [900_000]


# --- divergence ---


def plain_divergence(rows, least_docs, top=10):
    """rows (text, lang, source)"""
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        df = Counter(t for w, _, _ in own for t in set(w))
        kept = sorted(t for t, n in df.items() if n >= least_docs)
        sources = sorted({d[2] for d in own})
        n = {s: Counter(t for w, _, x in own if x == s for t in w if df[t] >= least_docs) for s in sources}
        n[None] = sum(n.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in n.items()}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if n[s][t] > 0 and p[s][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, rank) for rank, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "broadcast"), [(1, 50_000), (2, 0)])
def test_divergence_equals_brute_force(spark, monkeypatch, seed, broadcast):
    monkeypatch.setattr(divergence, "BROADCAST_SOURCES", broadcast)
    monkeypatch.setattr(divergence, "SUMMED_DOCS", 50)
    rng = random.Random(seed)
    words = ["Alpha", "alpha", "BETA", "gamma", "ÉCOLE", "école", "zu", "日本", "x1y", "don't", "ß", "😀"]
    rows = [(" ".join(rng.choices(words, [rng.random() for _ in words], k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "é"])) for _ in range(240)]
    rows += [(None, "en", "only nulls"), ("", "fr", "a"), ("rare words", "fr", "b"), ("...", None, None), ("alpha " * 5_000, "en", "long")] + rows[:10]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("n", F.lit(2)).repartition(3)
    assert sorted(tuple(r) for r in divergence.source_divergence(docs).collect()) == plain_divergence(rows, 10)


def test_divergence_of_an_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_shares_of_large_counts_stay_exact(spark):
    n, total, kept = 9_000_000_000_000_000, 10_000_000_000_000_007, 12_345
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * kept)


# --- repeated strings ---


def plain_repeats(texts, size):
    """Removed spans of each text by looking at every string of ``size`` bytes."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        hit = np.zeros(len(d) + 2, np.int64)
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                hit[i] += 1
                hit[i + size] -= 1
        edges = np.flatnonzero(np.diff((np.cumsum(hit) > 0).astype(np.int8), prepend=0))
        out.append([(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)])
    return out


def repeated_texts(seed, size):
    rng = random.Random(seed)

    def some(n, letters="abcdefgh é"):
        return "".join(rng.choices(letters, k=n))

    base = [some(rng.randint(size // 2, 6 * size)) for _ in range(10)]
    texts = list(base) + base[:2]
    for _ in range(30):  # pieces of other texts, of about the length that counts, side by side and apart
        t = some(rng.randint(0, size))
        for _ in range(rng.randint(1, 3)):
            src = rng.choice(texts)
            at = rng.randint(0, max(0, len(src) - 1))
            t += src[at : at + rng.choice([size - 1, size, size + 1, size // 2, 2 * size])] + some(rng.randint(0, 3))
        texts.append(t)
    line = some(size // 2)
    texts += [line + some(size) for _ in range(12)] + [some(size // 3) + line + some(size // 3) for _ in range(12)] + [some(5) + line * 4, "a" * (size - 1), "a" * size, "b" * size, "a" * (3 * size) + some(9), "ab" * size + some(3) + "ba" * size]
    return texts + [None, "", "short", some(size) * 2]


@pytest.mark.parametrize(("seed", "size", "paired", "part"), [(1, 60, 128, 1 << 21), (2, 60, 2, 700), (3, 41, 3, 1 << 21), (4, 400, 2, 3_000), (5, 24, 128, 300)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, size, paired, part):
    monkeypatch.setattr(repeats, "PART_BYTES", part)
    texts = repeated_texts(seed, size)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("x", F.lit(1)).withColumn("spans", F.lit("s")).withColumn("name", F.lit("n")).repartition(3)
    out = {r.doc_id: r for r in repeats.remove_repeats(docs, min_bytes=size, paired=paired).collect()}
    for i, (text, spans) in enumerate(zip(texts, plain_repeats(texts, size), strict=True)):
        assert [tuple(s) for s in out[i].removed] == spans, i
        data = (text or "").encode()
        cut = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(data)], strict=True))
        assert out[i].kept == cut and (out[i].x, out[i].spans, out[i].name, out[i].text) == (1, "s", "n", text)


def test_large_groups_of_surroundings_take_few_rounds(spark, monkeypatch):
    rounds, stored = [], repeats.stored
    monkeypatch.setattr(repeats, "stored", lambda df, label: rounds.append(label) or stored(df, label))
    rng = random.Random(6)
    line, copy = ("".join(rng.choices("abcdefgh ", k=n)) for n in (380, 900))
    texts = ["".join(rng.choices("abcdefgh ", k=300)) + line[: 380 - i % 5] for i in range(60)]
    texts += [copy[: 7 * i] + "|" + copy[7 * i + 1 :] for i in range(1, 120)]  # near copies, each with a change of its own
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: [tuple(s) for s in r.removed] for r in repeats.remove_repeats(docs, min_bytes=400, paired=2).collect()}
    assert out == dict(enumerate(plain_repeats(texts, 400)))
    assert 1 <= rounds.count("repeats-ones") <= 4


def test_long_passages_are_removed_whatever_their_words(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 10))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=rng.randint(80, 300))) for _ in range(80)]
    planted = {}
    for k in range(40):  # over 50 words each, of less and of more than 400 bytes
        passage = " ".join(rng.choices(words, k=rng.randint(51, 90)))
        for i in (2 * k, 2 * k + 1):
            at = rng.randint(0, len(texts[i]))
            texts[i] = f"{texts[i][:at]} {'xy'[i % 2]} {passage} {'xy'[i % 2]} {texts[i][at:]}"
            planted[i] = len(passage)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.removed for r in repeats.remove_repeats(docs, min_bytes=400).collect()}
    assert {n >= 398 for n in planted.values()} == {True, False}
    for i, n in planted.items():  # a blank on either side comes again, too
        assert sum(s.until - s.start for s in out[i]) == (n + 2 if n + 2 >= 400 else 0), i


def test_repeats_of_empty_tables_and_short_lengths(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(docs).collect() == []
    with pytest.raises(ValueError, match="24"):
        repeats.remove_repeats(docs, min_bytes=10)


def test_every_long_string_has_an_anchor_at_one_place():
    rng = random.Random(9)
    text = bytes(rng.choices(b"abc", k=5_000))
    size = 100
    whole = set(repeats.anchors_in(np.frombuffer(text, np.uint8), np.array([0, len(text)]), size)[0].tolist())
    for at in range(0, len(text) - size, 37):
        alone = repeats.anchors_in(np.frombuffer(text[at : at + size], np.uint8), np.array([0, size]), size)[0]
        assert {a + at for a in alone.tolist()} <= whole
    assert len(whole) < len(text) / 20


def test_runs_of_one_byte_make_few_anchors():
    data = np.frombuffer(b"x" * 100_000, np.uint8)
    anchors, _, first, last = repeats.anchors_in(data, np.array([0, len(data)]), 400)
    assert len(anchors) <= 2 and first.tolist() == [0] and last.tolist() == [len(data) - 400]


# --- limits that were lifted ---


def test_languages_are_not_learned_from_rows_without_an_id(spark):
    rows = [(i, f"word{i % 7} other", "en") for i in range(60)] + [(None, "zorgon blip", "xx")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, how=language.Fit(sample_rows=30))
    assert model.langs == ("en",) and "zorgon" not in model.words


def test_very_large_and_small_components(spark):
    rows = [(1, [1e200, 0.0]), (2, [2e200, 0.0]), (3, [1e-200, 1e-200]), (4, [1e-200, 5e-200]), (5, [3e-310, 3e-310]), (6, [1e300, 1e300])]
    out = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (0, 4), 5: (2, 3), 6: (2, 3)}


def test_urls_of_any_length_are_written(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/" + "u" * 70_000, "one"), (2, "http://b/" + "v" * 17_000_000, "two"), (3, None, None)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    data = b"".join(warc.unzipped(bytes(r.content)) for r in spark.read.format("binaryFile").load(path).collect() if not r.path.rsplit("/", 1)[1].startswith(("_", ".")))
    assert sorted(len(u) for u in re.findall(rb"WARC-Target-URI: (\S+)", data)) == [70_009, 17_000_009]
    assert {(r.page_id, r.payload_bytes) for r in warc.read_warc(spark, path).collect()} == {(1, 3), (2, 3), (3, 0)}


def test_rows_without_an_id_are_numbered_in_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_GROUP_ROWS", 8)
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(400)] + [(i, "x" * 200_000) for i in range(3)], "doc_id long, text string")
    out = sharding.hash_tree_shards(docs).collect()
    none = [r for r in out if r.doc_id is None]
    assert len({r.shard for r in none}) == 1
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    assert {r.text_crc32 for r in none} == {__import__("zlib").crc32(f"text {i}".encode()) for i in range(400)}
    assert hashlib.sha256(b"").hexdigest()
