"""Block keyword search, the vector index and the segmenter against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import keywords, retrieval, segmentation, vector_index


def plain_tokens(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def plain_bm25(docs, query, k, allowed=None, pad=False):
    kept = [(i, plain_tokens(t)) for i, t in docs if t and t.strip()]
    avg = sum(len(w) for _, w in kept) / len(kept)
    df = Counter(t for _, w in kept for t in set(w))
    hits = []
    for i, words in kept:
        tf = Counter(words)
        s = sum(math.log(1 + (len(kept) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] / (tf[t] + 1.5 * (0.25 + 0.75 * len(words) / avg)) for t in set(plain_tokens(query)) if t in tf)
        if (s or pad) and (allowed is None or i in allowed):
            hits.append((-round(s, 9), i))
    return [(i, -s) for s, i in sorted(hits)[:k]]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 120)))) for i in range(2_500)]
    return docs + [(2_500, None), (2_501, "  "), (2_502, "Ab, ab; ÉCOLE"), (2_503, docs[0][1]), (2_504, docs[0][1])]


@pytest.mark.parametrize("case", ["plain", "allowed", "pad"])
def test_block_search_equals_scoring_everything(spark, corpus, case, monkeypatch):
    monkeypatch.setattr(keywords, "BLOCK_DOCS", 64)
    monkeypatch.setattr(keywords, "FIRST_SHARE", 4)
    rng = random.Random(1)
    asked = [(i, " ".join(rng.choices([f"w{j}" for j in range(300)], k=rng.randint(1, 30)))) for i in range(12)] + [(12, "école"), (13, "nowhere"), (14, ""), (15, None)]
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    allowed = {i for i, _ in corpus if i % 7 == 2} if case == "allowed" else None
    more = {"allowed": spark.createDataFrame([(i,) for i in allowed], "id long")} if allowed else {"pad": True} if case == "pad" else {}
    hits = keywords.block_search(docs, spark.createDataFrame(asked, "query_id long, text string"), 7, **more).collect()
    for q, text in asked:
        got = sorted((r.place, r.id, r.score) for r in hits if r.query_id == q)
        want = plain_bm25(corpus, text, 7, allowed, case == "pad")
        assert [(i, round(s, 6)) for _, i, s in got] == [(i, round(s, 6)) for i, s in want], q
        assert [p for p, _, _ in got] == list(range(1, len(got) + 1))


def test_blocks_are_passed_over_and_many_queries_are_answered(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(keywords, "BLOCK_DOCS", 64)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    keywords.BlockIndex.build(docs).write(str(tmp_path / "i"))
    index = keywords.BlockIndex.read(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(i, f"w{250 + i} w1 w2 w3") for i in range(20)], "query_id long, text string")
    whole = {(r.query_id, r.id, r.place) for r in index.search(asked, 3).collect()}
    scored = sum(r.scored for r in index.scored_pairs(asked, 3).collect())
    matching = retrieval.bm25_scores(docs, asked).count()
    assert scored < 0.5 * matching
    monkeypatch.setattr(keywords, "MAX_QUERIES", 6)
    assert {(r.query_id, r.id, r.place) for r in index.search(asked, 3).collect()} == whole
    assert {r.id for r in index.documents().collect()} == {i for i, t in corpus if t and t.strip()}


def test_keyword_index_of_empty_tables(spark):
    docs, asked = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert keywords.block_search(docs, asked, 3).collect() == []
    assert keywords.block_search(docs, asked.limit(0), 3, pad=True).collect() == []
    some = spark.createDataFrame([("x", "b"), ("a", "c"), (None, "a")], "doc_id string, text string")
    assert [(r.id, r.score > 0) for r in keywords.block_search(some, asked, 2, pad=True).orderBy("place").collect()] == [(None, True), ("a", False)]


# --- vectors ---


@pytest.fixture(scope="module")
def vectors_table(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 3_000)] + 0.5 * rng.normal(size=(3_000, 32))
    rows = [(i, [float(v) for v in r], i % 5) for i, r in enumerate(x)] + [(3_000, None, 0), (3_001, [0.0] * 32, 0), (3_002, [1.0], 0), (3_003, [float("nan")] * 32, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)


def test_vector_index_finds_neighbours(spark, vectors_table, tmp_path):
    built = vector_index.VectorIndex.build(vectors_table, keep=["label"])
    built.write(str(tmp_path / "v"))
    index = vector_index.VectorIndex.read(spark, str(tmp_path / "v"))
    assert index.rows.count() == 3_000
    asked = vectors_table.where("vec_id % 50 = 0 and vec_id < 3000").select(F.col("vec_id").alias("query_id"), "embedding")
    true = {(r.query_id, r.vec_id): r.distance for r in retrieval.vector_topk_batch(vectors_table.where("vec_id < 3000"), asked, 10).collect()}
    got = {(r.query_id, r.vec_id): r.distance for r in index.search(asked, 10).collect()}
    assert len(got) == len(true) == 600
    assert len(got.keys() & true.keys()) >= 0.9 * len(true)
    assert all(abs(got[p] - true[p]) < 1e-9 for p in got.keys() & true.keys())


def test_vector_index_with_all_cells_and_a_filter_is_exact(spark, vectors_table, monkeypatch):
    index = vector_index.VectorIndex.build(vectors_table, keep=["label"], cells=20)
    asked = vectors_table.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), "embedding")
    where = {"label": {"$in": [1, 3]}}
    true = {(r.query_id, r.vec_id, r.place) for r in retrieval.vector_topk_batch(vectors_table.where("label in (1, 3)"), asked, 4).collect()}
    assert {(r.query_id, r.vec_id, r.place) for r in index.search(asked, 4, where, probes=20, short=3_000).collect()} == true
    monkeypatch.setattr(vector_index, "MAX_QUERIES", 2)
    assert {(r.query_id, r.vec_id, r.place) for r in index.search(asked, 4, where, probes=20, short=3_000).collect()} == true
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "query_id long, embedding array<double>")
    assert index.search(odd, 4).collect() == []


# --- segmenter ---


def all_paths(run, lexicon):
    """The best segmentation of a short run by trying all."""
    best = (-math.inf, [])
    for cuts in range(1 << (len(run) - 1)):
        words, start = [], 0
        for i in range(1, len(run) + 1):
            if i == len(run) or cuts >> (i - 1) & 1:
                words.append(run[start:i])
                start = i
        if any(len(w) > 1 and w not in lexicon.words for w in words):
            continue
        score = sum(lexicon.words.get(w, lexicon.unknown) for w in words)
        best = max(best, (score, words), key=lambda x: x[0])
    return best


def test_lattice_equals_trying_all_segmentations():
    rng = random.Random(2)
    for _ in range(60):
        words = {"".join(rng.choices("天地人山水", k=rng.randint(1, 4))): rng.randint(1, 50) for _ in range(25)}
        lexicon = segmentation.Lexicon.of(words)
        run = "".join(rng.choices("天地人山水火", k=rng.randint(1, 11)))
        path = segmentation.best_path(run, lexicon)
        assert "".join(path) == run
        assert math.isclose(sum(lexicon.words.get(w, lexicon.unknown) for w in path), all_paths(run, lexicon)[0], abs_tol=1e-9)


def test_long_runs_are_cut_where_the_best_path_is(monkeypatch):
    lexicon = segmentation.Lexicon.of({"天地": 5, "山水人": 5, "人": 2, "天": 1})
    run = "天地山水人" * 200
    whole = segmentation.best_path(run, lexicon)
    monkeypatch.setattr(segmentation, "LATTICE_CHARS", 37)
    assert segmentation.best_path(run, lexicon) == whole == ["天地", "山水人"] * 200


@pytest.fixture(scope="module")
def planted():
    """Sentences of planted Chinese words without spaces, with their true words."""
    rng = random.Random(11)
    chars = [chr(0x4E00 + 7 * i) for i in range(400)]
    words = list({"".join(rng.sample(chars, n)) for n in [1] * 40 + [2] * 150 + [3] * 40 + [4] * 10})
    weights = [1 / (1 + i) ** 0.7 for i in range(len(words))]
    return [rng.choices(words, weights, k=rng.randint(3, 14)) for _ in range(3_000)]


def test_lexicon_is_learned_from_the_corpus(spark, planted):
    docs = spark.createDataFrame([(i, "，".join(["".join(s)]) + "。abc Ünï 12") for i, s in enumerate(planted)] + [(-1, None), (-2, "")], "doc_id long, text string")
    lexicon = segmentation.learned(docs)
    cut = segmentation.segmenter(spark, lexicon, search=False)
    rows = {r.doc_id: r.w for r in docs.select("doc_id", cut(F.col("text")).alias("w")).collect()}
    assert rows[-1] == rows[-2] == []
    right = found = true = 0
    for i, s in enumerate(planted):
        assert rows[i][-3:] == ["abc", "ünï", "12"]
        assert "".join(rows[i][:-3]) == "".join(s)

        def spans(words):
            ends = np.cumsum([len(w) for w in words]).tolist()
            return set(zip([0, *ends[:-1]], ends, strict=True))

        a, b = spans(rows[i][:-3]), spans(s)
        right, found, true = right + len(a & b), found + len(a), true + len(b)
    assert right / found >= 0.9 and right / true >= 0.9, (right / found, right / true)
    print("precision", right / found, "recall", right / true)


def test_search_mode_and_keyword_search_in_chinese(spark):
    lexicon = segmentation.Lexicon.of({"中华人民共和国": 9, "中华": 5, "人民": 6, "共和国": 4, "共和": 3, "华人": 2, "的": 20, "历史": 7})
    assert segmentation.searched("中华人民共和国", lexicon) == ["中华", "华人", "人民", "共和", "共和国", "中华人民共和国"]
    words = segmentation.segmenter(spark, lexicon)
    docs = spark.createDataFrame([(1, "中华人民共和国的历史"), (2, "历史的历史"), (3, "人民"), (4, "history 历史 2024")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "人民"), (2, "2024 历史")], "query_id long, text string")
    hits = keywords.block_search(docs, asked, 3, words=words).collect()
    assert sorted(r.id for r in hits if r.query_id == 1) == [1, 3]
    assert [r.id for r in hits if r.query_id == 2 and r.place == 1] == [4]
    assert keywords.block_search(docs, asked, 3).where("query_id = 1").select("id").collect() == [(3,)]  # without the segmenter a run is one token


def test_segmenting_tables_without_runs(spark):
    docs = spark.createDataFrame([(1, "only letters")], "doc_id long, text string")
    lexicon = segmentation.learned(docs)
    assert lexicon.words == {}
    assert segmentation.best_path("天地", lexicon) == ["天", "地"]


def test_segment_words_query_equals_a_plain_lattice(spark):
    import pandas as pd

    from millrace.plans import retrieval as plans

    sf = "/root/testdata/sf0.001"
    counts = Counter(w for t in pd.read_parquet(f"{sf}/documents.parquet")["text"] for w in plain_tokens(t))
    kept = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: segmentation.LEXICON_WORDS])
    total = sum(kept.values())
    logs, unknown, longest = {w: math.log(n / total) for w, n in kept.items()}, math.log(0.5 / total), max(map(len, kept))

    def plain(text):
        score = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - longest), end):
                w = text[start:end]
                if w in logs or end - start == 1:
                    score[end] = max(score[end], score[start] + logs.get(w, unknown))
        return score[-1]

    cut = {r.item_id: r.w for r in plans.table(spark, sf, "benchmark").select("item_id", segmentation.segmenter(spark, segmentation.Lexicon.of(kept), False, segmentation.SPACED)(F.array_join(retrieval.tokens(F.col("text")), "")).alias("w")).collect()}
    rows = plans.segment_words(spark, sf).collect()
    assert len(rows) == len(cut)
    for r in rows:
        words = cut[r.item_id]
        assert r.n_found == len(words)
        assert math.isclose(sum(logs.get(w, unknown) for w in words), plain("".join(words)), rel_tol=1e-9)
        assert r.n_right <= min(r.n_words, r.n_found)
    assert sum(r.n_right for r in rows) > 0


@pytest.mark.parametrize("run_bytes", [1, 1 << 25])
def test_index_is_written_without_a_sort_of_whole_tasks(spark, corpus, tmp_path, monkeypatch, run_bytes):
    monkeypatch.setattr(keywords, "BLOCK_DOCS", 64)
    monkeypatch.setattr(keywords, "RUN_BYTES", run_bytes)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").coalesce(1)
    with monkeypatch.context() as m:
        m.setattr(type(docs), "sortWithinPartitions", lambda *_: pytest.fail("a task's rows are sorted whole"))
        keywords.BlockIndex.build(docs).write(str(tmp_path / "i"))
    rows = [(r.term, r.block) for r in spark.read.parquet(str(tmp_path / "i")).coalesce(1).select("term", "block").collect()]
    falls = sum(a > b for a, b in zip(rows, rows[1:], strict=False))
    assert falls == (len({b for _, b in rows}) - 1 if run_bytes == 1 else 0)  # a run for each block, or one for all
    hits = keywords.BlockIndex.read(spark, str(tmp_path / "i")).search(spark.createDataFrame([(0, "w1 w250")], "query_id long, text string"), 5).collect()
    assert [(r.id, round(r.score, 6)) for r in sorted(hits, key=lambda r: r.place)] == [(i, round(s, 6)) for i, s in plain_bm25(corpus, "w1 w250", 5)]
