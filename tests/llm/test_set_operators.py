"""WARC, Jaccard join, sharding and embeddings against plain versions; the pipeline."""

import base64
import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import components, embeddings, jaccard, sharding, warc
from millrace.llm.common import scratch_path


def least_reachable(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert out == least_reachable(nodes, [e for e in edges if e[0] != e[1]])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- Jaccard --------------------------------------------------------------------------


def plain_set(text, size=5):
    words = (text or "").encode().lower().split()
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def plain_components(rows, percent=75):
    sets = {i: plain_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, least_reachable(ids, links)


def edited(rnd, words, rate):
    return [w if rnd.random() > rate else rnd.choice(["xx", "yy", "zz"]) + str(rnd.randrange(50)) for w in words]


@pytest.mark.parametrize(("seed", "part_sets"), [(0, 96), (1, 4), (2, 3)])
def test_jaccard_equals_plain_join(spark, seed, part_sets):
    rnd = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(25):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([3, 8, 40, 120]))]
        if rnd.random() < 0.5:
            base = passage[: rnd.choice([20, 60])] + base
        for _ in range(rnd.choice([1, 2, 6]) if g else 40):
            rows.append(" ".join(edited(rnd, base, rnd.choice([0, 0.005, 0.01, 0.03]))))
    rows += [None, "", " \t ", "one two", "ONE  two", "a b c d e", "A b c d e", " nb sp ", "long " * 30_000]
    docs = list(enumerate(rows)) + [(3, rows[3])]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], "doc_id long, text string, sig string, component_id string")
    sizes, expected = plain_components(docs)
    out = jaccard.ngram_components(df.repartition(5), part_sets=part_sets).collect()
    assert len(out) == len(docs)
    assert all(r.n_shingles == sizes[r.doc_id] and r.component_id == expected[r.doc_id] for r in out)


def test_jaccard_meets_sets_whose_frequent_grams_cover_their_need(spark):
    passage, rows = [f"p{i}" for i in range(69)], []  # 65 shingles that all sets have
    for pair in range(24):
        own = [f"o{pair}-{i}" for i in range(15 + 2 * (pair % 4))]
        more = [f"m{pair}-{i}" for i in range(20 + pair % 5)]
        rows += [" ".join(passage + own), " ".join(passage + own + more)]
    docs = list(enumerate(rows))
    _, expected = plain_components(docs)
    assert sum(expected[i] != i for i in expected) >= 20
    out = jaccard.ngram_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == expected


def test_jaccard_odd_tables(spark):
    assert jaccard.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (None, "only here"), (None, None)]
    out = jaccard.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.n_shingles) for r in out) == [("7", "7", 2), ("None", "7", 2), ("None", "None", 0), ("None", "None", 1)]


def test_jaccard_work_grows_with_passages_shared_not_with_their_chains(spark, monkeypatch):
    """Texts of ten passages, each in three texts, no two near: walks and n-grams handed on grow as the texts do."""
    handed = []
    monkeypatch.setattr(jaccard, "_linked", lambda rooms, sets, percent, walk=jaccard._linked: handed.append(rooms.count()) or walk(rooms, sets, percent))

    def rows(n):
        rnd = random.Random(n)
        passages = [" ".join(f"w{rnd.randrange(50_000)}" for _ in range(40)) for _ in range(n * 10 // 3)]
        dealt = (passages * 3)[: n * 10]
        rnd.shuffle(dealt)
        return [(i, " ".join(dealt[i::n])) for i in range(n)]

    work = []
    for n in (300, 1200):
        handed.clear()
        out = jaccard.ngram_components(spark.createDataFrame(rows(n), "doc_id long, text string").repartition(4)).collect()
        assert all(r.component_id == r.doc_id for r in out)
        work.append(sum(handed))
    assert work[0] > 300 and work[1] <= 5 * work[0]


def test_jaccard_of_many_near_copies_hands_on_a_few_walks_each(spark, monkeypatch):
    handed = []
    monkeypatch.setattr(jaccard, "_linked", lambda rooms, sets, percent, walk=jaccard._linked: handed.append(rooms.count()) or walk(rooms, sets, percent))
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join(edited(rnd, base, 0.02))) for i in range(700)] + [(2_000 + i, " ".join(edited(rnd, base, 0.2))) for i in range(20)]
    out = {r.doc_id: r.component_id for r in jaccard.ngram_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    _, expected = plain_components(docs)
    assert out == expected and sum(handed) < 15 * len(docs)


def test_first_of_groups_keeps_nulls_and_reused_ids(spark):
    base = " ".join(f"w{i}" for i in range(30))
    rows = [(None, "null id alone here with words", "a"), (2, base, "b"), (None, base, "c"), (1, base.upper(), "d"), (7, "one text under seven", "e"), (7, "an other one, of equal length", "f"),
            (7, "one text under seven", "g"), (8, None, "h"), (8, None, "i"), (8, "", "j"), (None, None, "k"), (9, "x " * 50_000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = jaccard.first_of_groups(docs)
    assert out.columns == docs.columns
    got = sorted((str(r.doc_id), (r.text or "")[:20]) for r in out.collect())
    assert got == sorted([("None", "null id alone here w"), ("1", base.upper()[:20]), ("7", "one text under seven"), ("7", "an other one, of equ"), ("8", ""), ("None", ""), ("9", "x x x x x x x x x x ")])
    assert jaccard.first_of_groups(docs.limit(0)).count() == 0


def test_equal_short_hashes_link_nothing(spark, monkeypatch):
    """Sets whose 64-bit names clash stay apart, since 128 bits name them."""
    monkeypatch.setattr(jaccard, "short", lambda sig: None if sig is None else 7)
    rows = [(1, "a b c d e f g"), (2, "q r s t u v w"), (3, "A b c d e f g")]
    sets = {r.doc_id: r.sig for r in spark.createDataFrame([(i, bytes(jaccard.signature(jaccard.shingles(t)))) for i, t in rows], "doc_id long, sig binary").collect()}
    assert sets[1] == sets[3] != sets[2]


def test_tree_links_connect_all():
    rnd = random.Random(4)
    for _ in range(60):
        base = [rnd.sample(range(60), rnd.randrange(1, 20)) for _ in range(6)]
        sets = [np.array(sorted({x if rnd.random() > 0.1 else rnd.randrange(60) for x in rnd.choice(base)}), np.int64) for _ in range(25)]
        percent = rnd.choice([50, 75, 90])
        pairs = [(i, j) for i in range(25) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]
        found = jaccard.tree_links(sets, list(range(25)), [False] * 25, percent)
        assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in pairs}
        assert least_reachable(range(25), found) == least_reachable(range(25), pairs)


# --- WARC -----------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 3_000
    rows = [(1, "http://a", "x"), (2, "http://b\r\nX: y", "x"), (3, None, None), (4, "u", ""), (5, "u", big), (6, "u", big + "!"), (7, "u", big), (8, "u", "once"), (8, "u", "once"), (None, "u", "alone"), (None, "u", "x")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, hex string")
    path = scratch_path(spark, "warc-test")
    warc.write_warc(pages.repartition(3), path)
    out = warc.read_warc(spark, path).collect()
    assert len(out) == len(rows) and all(r.whole for r in out)
    payload = lambda t: (t or "").encode()
    last = {}
    for i, _, t in rows:
        last[payload(t)] = max(last.get(payload(t), -1), -1 if i is None else i)
    expected = Counter()
    for i, _, t in rows:
        top = last[payload(t)]
        again = top >= 0 and i != top
        digest = base64.b32encode(hashlib.sha1(payload(t)).digest()).decode()
        expected[i, len(payload(t)), digest, "revisit" if again else "response", top if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == expected
    assert {bytes(r.payload) for r in out if r.record_type == "response"} == set(last)
    assert warc.warc_records(spark, path).where("segment > 1").count() > 4


def test_warc_files_are_standard(spark):
    """One gzip member for each record; revisits name the record they repeat; names are the same each time."""
    import glob
    import zlib

    pages = spark.createDataFrame([(i, f"http://h/{i}", "same" if i % 3 else f"page {i} " * 3_000) for i in range(30)], "page_id long, url string, html string")
    seen = []
    for parts in (1, 4):
        path = scratch_path(spark, "warc-test")
        warc.write_warc(pages.repartition(parts), path)
        members = []
        for name in glob.glob(f"{path.removeprefix('file:')}/part-*"):
            data = open(name, "rb").read()
            while data:
                one = zlib.decompressobj(31)
                members.append(one.decompress(data))
                assert one.eof
                data = one.unused_data
        assert len(members) == warc.warc_records(spark, path).count() > 30
        assert all(m.startswith(b"WARC/1.1\r\n") and m.count(b"WARC/1.1\r\n") == 1 and m.endswith(b"\r\n\r\n") for m in members)
        headers = [dict(line.split(": ", 1) for line in m.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:]) for m in members]
        ids = {h["WARC-Record-ID"]: h for h in headers}
        assert len(ids) == len(headers)
        revisits = [h for h in headers if h["WARC-Type"] == "revisit"]
        assert len(revisits) == 19
        for h in revisits:
            first = ids[h["WARC-Refers-To"]]
            assert first["WARC-Type"] == "response" and first["X-Page-Id"] == "29" and first["WARC-Target-URI"] == h["WARC-Refers-To-Target-URI"] and first["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
        seen.append(sorted(members))
    assert seen[0] == seen[1]


def test_warc_least_bytes_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    path = scratch_path(spark, "warc-test")
    warc.write_warc(pages, path, least_bytes=3)
    assert {r.page_id: r.record_type for r in warc.read_warc(spark, path).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    path = scratch_path(spark, "warc-test")
    warc.write_warc(pages.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_warc_keeps_every_record_of_large_files(spark):
    pages = spark.range(3_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), F.col("id")).alias("html")).coalesce(1)
    path = scratch_path(spark, "warc-test")
    warc.write_warc(pages, path)
    out = warc.read_warc(spark, path).where("whole").select("page_id").collect()
    assert sorted(r.page_id for r in out) == list(range(3_000))


def test_unzipped_members():
    parts = [b"a" * n for n in (0, 1, 9_000, 300_000)] + [random.Random(1).randbytes(50_000)]
    data = b"".join(gzip.compress(p) for p in parts)
    assert warc.unzipped(data) == warc.unzipped(data, 7) == b"".join(parts) and warc.unzipped(b"WARC/1.1") == b"WARC/1.1"
    with pytest.raises(ValueError):
        warc.unzipped(data[:-3])


def test_broken_segments_are_told(spark):
    records = [r for p in ([b"a" * 50_000], [b"b" * 50_000]) for r in warc.page_records(p[0][0], "u", p[0], warc.payload_digest(p[0]), None, None, False, None, False, 16_384)]
    rows = [tuple(x) for d in records for x in warc.parsed_records(d + b"\r\n\r\n")]
    del rows[1]  # a continuation is lost
    random.Random(1).shuffle(rows)
    out = warc.reassembled(spark.createDataFrame(rows, warc.RECORD)).collect()
    assert sorted((r.page_id, r.whole) for r in out) == [("97", False), ("98", True)]
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab")
    assert warc.unchunked(warc.chunked(b"x" * 10_000, 999)) == b"x" * 10_000 and warc.unchunked(warc.chunked(b"")) == b""


# --- sharding -------------------------------------------------------------------------


def test_sharding_law_and_slots(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("é").alias("text"), F.lit(1).alias("shard"))
    docs = docs.unionByName(spark.createDataFrame([(None, None, 1), (5, "é", 1), (5, "é", 1)], "doc_id long, text string, shard int"))
    rows = sharding.hash_tree_shards(docs).collect()
    assert len(rows) == 20_003 and {r.size for r in rows} == {3, 1}
    assert {r.shard for r in rows} == set(range(16))
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and sum(r.grown_shard == 16 for r in rows) > 500
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) < 1.3 * min(map(len, by.values()))
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1
    assert sharding.hash_tree_shards(docs.limit(0)).count() == 0


def test_weights_move_rows_within_changed_subtrees_only(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"))
    old = sharding.fleet(16)
    new = [sharding.Shard(s.region, s.rack, s.number, 3.0 if s.number == 9 else 1.0) for s in old]
    rows = docs.select(sharding.shard_of(F.col("doc_id"), old).alias("a"), sharding.shard_of(F.col("doc_id"), new).alias("b")).collect()
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    # what moves goes to region 1; from within region 1 to rack 2; from within that rack to shard 9
    assert moved and all(b >= 8 for _, b in moved)
    assert all(8 <= b < 12 for a, b in moved if a >= 8) and all(b == 9 for a, b in moved if 8 <= a < 12)
    n = Counter(r.b for r in rows)
    assert 2 < n[9] / n[10] < 4.5


# --- embeddings -----------------------------------------------------------------------


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(embeddings.hadamard(embeddings.hadamard(x)), x)


@pytest.mark.parametrize("size", [64, 768])
def test_pairs_at_the_threshold_share_a_bucket(size):
    rng = np.random.default_rng(size)
    x, y = rng.normal(size=(2, 1_000, size))
    x /= np.sqrt((x * x).sum(1))[:, None]
    y -= (x * y).sum(1)[:, None] * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.sqrt((y * y).sum(1))[:, None]
    how = embeddings.Hashing()
    a, b = embeddings.probe_codes(x, how), embeddings.probe_codes(y, how)
    met = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3))
    assert met.mean() >= 0.98


def test_large_groups_of_near_vectors_emit_no_pairs(spark):
    """500 different vectors all near each other: every link is counted, and what leaves the comparison stays small."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=16) + rng.normal(size=(500, 16)) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for rows in (512, 64):
        how = embeddings.Hashing(block_rows=rows)
        assert {(r.n_links, r.component_id) for r in embeddings.near_vectors(df, how=how).collect()} == {(499, 0)}
    classes = embeddings.vector_classes(df, "vec_id", "embedding").selectExpr("cls", "1 as n", "v")
    assert embeddings.class_links(classes, 0.95, embeddings.Hashing()).count() < 500 * 12 * 2


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 20))
    rows = [v + rng.normal(size=20) * rng.choice([0, 0.02, 0.08]) for v in base for _ in range(int(rng.integers(1, 7)))]
    rows += [base[0] + rng.normal(size=20) * 0.01 for _ in range(150)] + [base[1]] * 40
    data = [(i, [float(x) for x in v], 1, "clash") for i, v in enumerate(rows)]
    n = len(data)
    bad = [None, [], [0.0] * 20, [float("nan")] * 20, [None] * 20, [float("inf")] + [1.0] * 19, [1.0, 0.0]]
    data += [(n + i, v, 1, "clash") for i, v in enumerate(bad)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, cls string")
    out = {r.vec_id: r for r in embeddings.near_vectors(df, how=embeddings.Hashing(block_rows=20)).collect()}
    x = np.stack(rows)
    x /= np.sqrt((x * x).sum(1))[:, None]
    cos = x @ x.T
    a, b = np.nonzero(np.triu(cos >= 0.95, 1))
    links = Counter(a.tolist()) + Counter(b.tolist())
    expected = least_reachable(range(n), zip(a.tolist(), b.tolist(), strict=True))
    assert sum(out[i].n_links for i in range(n)) >= 0.97 * 2 * len(a)
    assert all(out[i].n_links <= links[i] for i in range(n))
    assert sum(out[i].component_id == expected[i] for i in range(n)) >= 0.97 * n
    assert all(out[n + i].n_links == 0 and out[n + i].component_id == n + i and out[n + i].kept for i in range(len(bad)))
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values())
    assert embeddings.near_vectors(df.limit(0)).count() == 0


# --- pipeline -------------------------------------------------------------------------


def odd_documents(spark):
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n", "en", "s", 2), (4, "12 -- ½", "en", "s", 7), (None, "the cat sat on the mat", "en", None, 22),
            (5, "the cat sat on the mat", "en", "s", 22), (5, "the cat sat on the mat", "en", "s", 22), (6, "der hund und die katze", "de", "s", None),
            (7, "mail joe@example.org or 10.0.0.1 ", None, "s", 32), (8, "the cat " * 30_000, "en", "s", 240_000)]
    return spark.createDataFrame([tuple(dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r, strict=True))[f.name] for f in schema) for r in rows], schema)


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_each_stage_takes_odd_documents(spark, at):
    docs, sf = odd_documents(spark), "/root/testdata/sf0.001"
    name, stage = corpus_pipeline.STAGES[at]
    extra = docs.withColumn("spans", F.lit("clash")).withColumn("N_Words", F.lit("clash")) if at < 4 else docs
    out = stage(spark, extra, sf)
    assert at == 4 or out.columns == extra.columns
    rows = out.collect()
    ids = sorted(str(r.doc_id) for r in rows)
    everything = sorted(str(r.doc_id) for r in docs.collect())
    if name == "language ID":
        assert ids == ["5", "5", "6", "7", "8", "None"]
    elif name == "n-gram Jaccard join":
        assert ids == ["1", "2", "3", "4", "5", "6", "7", "8"]
    else:
        assert ids == everything
    if name == "PII":
        assert [r.text for r in rows if r.doc_id == 7] == ["mail [EMAIL] or [IP] "]
    if name == "byte-level BPE":
        assert all(r.round_trip for r in rows) and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_run_leaves_its_result_only(spark):
    import os

    root = os.path.dirname(scratch_path(spark, "x")).removeprefix("file:")
    before = set(os.listdir(root))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(set(os.listdir(root)) - before) == 1 and out.count() > 0


def test_pipeline_against_plain_stages(spark):
    from millrace.llm import language
    from tests.llm.test_text_operators import plain_hits, plain_spans, tiktoken_encoding
    import public_tokenizers

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf)
        assert frame.columns == columns, name
        frame = spark.createDataFrame(frame.collect(), docs.schema)
        kept[name] = {r.doc_id: r for r in frame.collect()}
    model = language.fit(docs.where(~language.held_out("doc_id")))
    judge = language.Scorer(model)
    rows = {r.doc_id: r.text for r in docs.collect()}
    ok = {i: t for i, t in rows.items() if judge.predict(t)[0] != "und" and judge.predict(t)[1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    assert set(kept["language ID"]) == set(ok) and len(ok) >= 0.95 * len(rows)
    _, groups = plain_components(list(ok.items()))
    ok = {i: t for i, t in ok.items() if groups[i] == i}
    assert set(kept["n-gram Jaccard join"]) == set(ok)
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = {i: plain_hits(t, items, 13) for i, t in ok.items()}
    ok = {i: t for i, t in ok.items() if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])}
    assert set(kept["benchmark decontamination"]) == set(ok)
    for i, r in kept["benchmark decontamination"].items():
        assert r.n_chars == len(r.text) and (r.text == ok[i]) == (not hits[i][1]) and not plain_hits(r.text, items, 13)[1]
    for i, r in kept["PII"].items():
        assert r.n_chars == len(r.text) and not plain_spans(r.text)
        assert r.text == kept["benchmark decontamination"][i].text or plain_spans(kept["benchmark decontamination"][i].text)
    known, _ = tiktoken_encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == set(ok)
    assert all(list(out[i].ids) == known.encode_ordinary(kept["PII"][i].text) and out[i].round_trip for i in out)
