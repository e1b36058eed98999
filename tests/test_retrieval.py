"""Vectors, keywords, fusion, graph, logs, tasks and scalars."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars, vectors
from millrace.operators import graph, logs, retrieval, tasks


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [-3.0, -4.0])], "a array<double>, z array<double>, b array<double>")
    d = vectors.squared_l2(vectors.normalized(F.col("a")), vectors.normalized(F.col("b")))
    r = df.select(vectors.normalized(F.col("a")).alias("a"), vectors.normalized(F.col("z")).alias("z"), d.alias("d"), vectors.score_from_squared(d).alias("s")).first()
    assert list(r.a) == [0.6, 0.8] and list(r.z) == [0.0, 0.0] and math.isclose(r.d, 4.0) and r.s == 0.0
    assert math.isclose(df.select(vectors.squared_l2(vectors.normalized(F.col("z")), vectors.normalized(F.col("b"))).alias("d")).first().d, 1.0)


def test_vector_topk_batch_answers_more_queries_than_a_block(spark, monkeypatch):
    points = [(i, [math.cos(i), math.sin(i)]) for i in range(30)]
    corpus = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i % 22, v) for i, v in points[:23]], "query_id long, embedding array<double>")  # 0 comes twice
    ranked = lambda: sorted((r.query_id, r.place, r.vec_id, r.distance) for r in retrieval.vector_topk_batch(corpus, queries, 3).collect())
    whole = ranked()
    assert len(whole) == 22 * 3 and all(v == q for q, place, v, _ in whole if place == 1)
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 5)
    assert ranked() == whole
    assert retrieval.vector_topk_batch(corpus, queries.limit(0), 3).count() == 0


def test_vector_topk_batch_equals_sorting(spark):
    import random

    rnd = random.Random(4)
    points = [(i, [rnd.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(400)] + [(400, None), (401, [1.0])]  # many ties
    corpus = spark.createDataFrame(points, "vec_id int, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(str(i), v) for i, v in points[:9]], "query_id string, embedding array<float>")
    unit = lambda v: [x / (math.sqrt(sum(y * y for y in v)) or 1.0) for x in v]
    d = lambda a, b: round(sum((x - y) ** 2 for x, y in zip(unit(a), unit(b), strict=True)), 9)
    out = retrieval.vector_topk_batch(corpus, queries, 4)
    got = {(r.query_id, r.place): (r.vec_id, round(r.distance, 9)) for r in out.collect()}
    assert out.schema["vec_id"].dataType.simpleString() == "int"
    for i, v in points[:9]:
        best = sorted((d(v, w), j) for j, w in points[:400])[:4]
        assert [got[str(i), p] for p in (1, 2, 3, 4)] == [(j, x) for x, j in best]


@pytest.mark.parametrize("limit", [100_000, 0])  # terms broadcast, and not
def test_index_search_equals_the_scan(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", limit)
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 7}" for j in range(i % 5 + 1))) for i in range(40)] + [(90, " ")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "w1 w2 w2"), (1, "w0"), (2, "zz")], "query_id long, text string")
    retrieval.Bm25Index.build(docs).write(str(tmp_path / "i"))
    rows = lambda df: sorted((r.query_id, r.id, round(r.score, 9)) for r in df.collect())
    scan = rows(retrieval.bm25_scores(docs, q))
    assert scan and rows(retrieval.Bm25Index.read(spark, str(tmp_path / "i")).search(q)) == scan


TABLE = "| Name | Unit Price |\n|:--|--:|\n| apple pie | 3 |\n| pear | 4 |"


@pytest.mark.parametrize(("text", "row", "column", "expected"), [
    (TABLE, "PEAR", "price", "根据查找到的表格信息，'pear'的'Unit Price'是'4'。"), (TABLE, "^a.*e$", "the unit price of it", "根据查找到的表格信息，'apple pie'的'Unit Price'是'3'。"),
    (TABLE, "plum", "price", "在表格的'Name'列中未能找到与'plum'相关的行。"), (TABLE, None, "price", "模型未能从问题中生成有效的表格查询指令。"),
    (TABLE, "pear", "weight", "处理表格数据时遇到代码错误: Column 'weight' not found in table."), ("| a |\n|--|\n| b |", "b", "a", "处理表格数据时遇到代码错误: Table for QA must have at least two columns after processing."),
    ("", "b", "a", "处理表格数据时遇到代码错误: Table for QA must have at least two columns after processing."),
])
def test_table_answers(text, row, column, expected):
    answer, reason = retrieval.table_answer(text, row, column)
    assert (answer or reason) == expected and (answer is None) != (reason is None)


def test_bad_patterns_are_reasons():
    assert retrieval.table_answer(TABLE, "(", "price")[1].startswith("处理表格数据时遇到代码错误: ")


def test_dispatch(spark):
    asked = spark.createDataFrame([(0, "pear", "price"), (1, "plum", "price"), (2, None, None), (3, "pear", "price"), (4, "x", "y"), (5, "pear", "price")], "q int, row_identifier string, column_identifier string")
    hits = [(0, 2, "table", TABLE, "f.md", "s0"), (0, 1, "text", "t", "g", "s1"), (0, 3, "table", "| a | price |\n|-|-|\n| pear | 9 |", "f", None), (1, 1, "table", TABLE, None, "only"), (1, 2, "text", "t", "g", "more"),
            (2, 1, "text", "t", "g", "said"), (3, 1, "text", "t", "g", None), (5, 1, "text", "t", "g", ""), (5, 6, "text", "t", "g", "beyond the fifth")]
    df = spark.createDataFrame(hits, "q int, place int, paragraph_type string, content string, filename string, summary string")
    got = {r.q: (r.route, r.answer, r.reason, r.context) for r in retrieval.dispatched(asked, df, ["q"]).collect()}
    assert got[0] == ("table", "根据查找到的表格信息，'pear'的'Unit Price'是'4'。", None, None)
    assert got[1] == ("documents", None, "在表格的'Name'列中未能找到与'plum'相关的行。", "根据文档《未知文档》的信息：only\n\n根据文档《g》的信息：more")
    assert got[2] == ("documents", None, None, "根据文档《g》的信息：said")
    assert got[3] == got[5] == ("documents", None, retrieval.NO_SUMMARIES, None) and got[4] == ("documents", None, retrieval.NO_DOCUMENTS, None)


def test_tool_answer(spark):
    hit = "array<struct<source_type:string,score:double,content:string>>"
    rows = [(" yes ", [("v", 0.126, "c" * 120), (None, None, None), ("x", 1.0, "third")]), ("no hits", []), (None, [("v", 1.0, "c")])]
    got = [r.t for r in spark.createDataFrame(rows, f"a string, h {hit}").select(retrieval.tool_answer(F.col("a"), F.col("h")).alias("t")).collect()]
    assert got[0] == "RAG Answer: yes\n\n\nSupporting Context Snippets (Top 2):\n  - Source: v, Score: 0.13, Content: " + "c" * 100 + "...\n  - Source: N/A, Score: N/A, Content: N/A..."
    assert got[1] == "RAG Answer: no hits" and got[2] == "RAG service processed successfully but found no specific answer."


def test_models_are_columns(spark):
    from millrace.functions import models

    sizes = []

    def encode(texts):
        if "bad" in texts:
            raise RuntimeError("model")
        return [[float(len(t)), 1.0] for t in texts]

    models.register_embedder("test", encode)
    models.register_reranker("test", lambda pairs: [len(set(q) & set(t)) for q, t in pairs])
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None), (4, "bad")], "i int, t string").coalesce(1).sortWithinPartitions("i")
    assert {r.i: r.v for r in df.select("i", models.embedded(F.col("t"), "test", 2).alias("v")).collect()} == {1: [1.0, 1.0], 2: [2.0, 1.0], 3: None, 4: []}
    assert [r.s for r in df.select(models.reranked(F.lit("ab"), F.col("t"), "test").alias("s")).collect()] == [1.0, 1.0, None, 2.0]
    assert models._called(lambda part: sizes.append(len(part)) or [[0.0]] * len(part), list("abcde"), 2, []) == [[0.0]] * 5 and sizes == [2, 2, 1]


def test_context_documents(spark):
    df = spark.createDataFrame([(1, ["a"], ["d"]), (2, [], ["d"]), (3, None, ["d"]), (4, None, None)], "i int, top array<string>, debug array<string>")
    assert {r.i: r.c for r in df.select("i", logs.context_documents(F.col("top"), F.col("debug")).alias("c")).collect()} == {1: ["a"], 2: ["d"], 3: ["d"], 4: None}


def test_metadata_filters(spark):
    df = spark.range(10).select(F.col("id").alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    n = lambda w: df.where(retrieval.where_column(w)).count()
    assert n({"a": 3}) == 1 and n({"a": {"$gt": 3, "$lte": 5}}) == 2 and n({"$or": [{"a": 1}, {"b": {"$in": ["2"]}}]}) == 4 and n({"b": {"$like": "1%"}}) == 3 and n({}) == 10
    user = {"must": [{"key": "a", "match": {"value": 1}}, {"key": "a", "match": {"value": 1}}, "bad", {"key": "x"}]}
    assert retrieval.merged_filter(user, None) == {"a": {"$eq": 1}}
    assert retrieval.merged_filter(user, {"$and": [{"a": {"$eq": 1}}, {"b": "2"}]}) == {"$and": [{"a": {"$eq": 1}}, {"b": "2"}]}
    assert retrieval.merged_filter(None, None) == {}


def test_bm25_formula_and_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, " "), (4, "c c c c")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "A zz a")], "query_id long, text string")
    got = retrieval.bm25_scores(docs, q).collect()
    idf = math.log(1 + (3 - 1 + 0.5) / (1 + 0.5))
    assert len(got) == 1 and math.isclose(got[0].score, idf * 2 / (2 + 1.5 * (1 - 0.75 + 0.75 * 3 / 3)))
    index = retrieval.Bm25Index.build(docs)
    index.write(str(tmp_path / "i"))
    assert {(r.term, r.df) for r in retrieval.Bm25Index.read(spark, str(tmp_path / "i")).terms.collect()} == {("a", 1), ("b", 2), ("c", 2)}


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, place int")
    b = spark.createDataFrame([(2, 1)], "id int, place int")
    out = {r.id: r.score for r in retrieval.rrf(retrieval.union_sources(x=a, y=b)).collect()}
    assert math.isclose(out[2], 1 / 61 + 1 / 62) and math.isclose(out[1], 1 / 61)
    same = {r.id: r.score for r in retrieval.rrf(retrieval.union_sources(x=b, y=a)).collect()}
    assert {k: round(v, 12) for k, v in same.items()} == {k: round(v, 12) for k, v in out.items()}
    hits = spark.createDataFrame([("s", "dup", 2.0), ("s", "other", 1.0), ("t", "dup", None)], "source_type string, content string, score double")
    by = {r.content: r.score for r in retrieval.rrf_by_content(hits).collect()}
    assert math.isclose(by["dup"], 2 / 61) and math.isclose(by["other"], 1 / 62)


def test_parents_rerank_and_context(spark):
    chunks = spark.createDataFrame([(1, "p", "zz", 2, "late"), (2, "p", "aa", 1, "early"), (3, "q", "x", 1, "m")], "id int, parent_id string, chunk_text string, chunk_number int, meta string")
    docs = retrieval.parents(chunks, meta=["meta"])
    assert {r.parent_id: (r.parent_text, r.meta) for r in docs.collect()} == {"p": ("aa\n\nzz", "early"), "q": ("x", "m")}
    hits = spark.createDataFrame([(1, 0.5), (3, 0.7), (9, 1.0)], "id int, score double")
    assert [r.parent_id for r in retrieval.small_to_big(hits, chunks, docs, n=1).collect()] == ["q"]
    scored = spark.createDataFrame([(1, 0.0), (2, None), (3, -0.5)], "id int, s double")
    assert [r.id for r in retrieval.rerank_topn(scored, "s", 3).collect()] == [3, 1, 2]
    ctx = spark.createDataFrame([(0, 2, "k", None, "b"), (0, 1, "v", 0.5, "a")], "q int, place int, source_type string, score double, content string")
    assert retrieval.context_text(ctx, ["q"], ["place"]).first().context == "Source Type: v, Score: 0.5000\nContent: a\n\n---\n\nSource Type: k, Score: N/A\nContent: b"


@pytest.mark.parametrize("separator", ["|:--|--:|", "| --- | --- |"])
def test_table_lookup(spark, separator):
    df = spark.createDataFrame([(f"| Name | Unit Price |\n{separator}\n| apple pie | 3 |\n| pear | 4 |", "PEAR", "price"), (f"| a | b |\n{separator}", "x", "a"), ("no table", "x", "a")], "t string, r string, c string")
    assert [x.v for x in df.select(retrieval.table_lookup(df, "t", F.col("r"), F.col("c")).alias("v")).collect()] == ["4", None, None]


def test_graph(spark):
    rows = spark.createDataFrame([(" Ann  LEE ", "person"), ("ann lee", "Person"), ("Acme", None)], "text string, label string")
    clean = graph.clean_entities(rows)
    nodes = clean.select(graph.node_id(F.col("text"), F.col("label")).alias("id_prop"), "text", "label").distinct()
    assert {(r.text, r.label) for r in nodes.collect()} == {("ann lee", "PERSON"), ("acme", "UNKNOWN")}
    more = nodes.limit(1).withColumn("label", F.lit("X")).withColumn("o", F.lit(1))
    once = graph.upserted_nodes(nodes, more, "o")
    assert once.count() == 2 and graph.upserted_nodes(once, more, "o").exceptAll(once).count() == 0
    rel = spark.createDataFrame([("A", "p", "knows", "B", "p"), ("A", "p", None, "B", "p")], "head_entity_text string, head_entity_label string, relation_type string, tail_entity_text string, tail_entity_label string")
    assert [tuple(r) for r in graph.clean_relations(rel).collect()] == [("a", "P", "KNOWS", "b", "P")]
    records = spark.createDataFrame([("x", None)], "text string, label string")
    assert records.select(graph.record_text(records).alias("t")).first().t == "Entity: x"
    other = spark.createDataFrame([(1,)], "n int")
    assert other.select(graph.record_text(other).alias("t")).first().t == 'Retrieved KG data: {"n":1}'


def test_logs(spark):
    lines = spark.createDataFrame([('{"a":null,"b":"x"}',), ('{"b":"y"}',), ("{}",)], "j string")
    assert [r.v for r in lines.select(logs.alias_value(F.col("j"), ["a", "b"]).alias("v")).collect()] == [None, "y", None]
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), (None, 3, "no")], "key string, n int, v string")
    assert [r.v for r in logs.last_wins(rows, "key", "n").collect()] == ["new"]
    bad = spark.createDataFrame([(1, "not json"), (2, None), (3, "{}")], "id int, evaluation string")
    flat = logs.flat_query_evaluation(bad).where("id = 3").first()
    assert flat.overall_quality_score is None and flat.error_patterns == ""
    assert logs.analysis_name(F.lit("x")) is not None
    assert spark.range(1).select(logs.analysis_name(F.lit("eval_results_a.jsonl")).alias("n")).first().n == "analysis_a.csv"


def test_query_samples_follow_the_rules(spark):
    cases = [
        ("", "1", "x", "", "qwen_and_gemini_cannot_generate"), (None, "5", "try MATCH (n)", "", None), (logs.CANNOT, "3", "hm", "", "qwen_cannot_generate_gemini_unclear"),
        ("M", "4", "", "", "qwen_high_score_by_gemini"), ("M", "3", "```cypher\nMATCH (n) RETURN n```", "", "gemini_suggestion_for_review"), ("M", "3", "cannot be improved MATCH n", "", None),
        ("M", "2", "", "a Schema Violation", "gemini_explicitly_cannot_generate_or_qwen_low_quality"), ("M", "x", "", "fine", None), ("M", "3", logs.CANNOT_MARK, "", "gemini_explicitly_cannot_generate_or_qwen_low_quality"),
    ]
    df = spark.createDataFrame([(i, "q", "", *c[:4]) for i, c in enumerate(cases)], "interaction_id int, question string, prompt string, generated string, score string, suggestion string, judged string")
    out = {r.interaction_id: r for r in logs.query_samples(df).collect()}
    assert {i: out[i].source_of_ideal if i in out else None for i in range(len(cases))} == {i: c[4] for i, c in enumerate(cases)}
    assert out[4].completion == "MATCH (n) RETURN n" and out[3].completion == "M" and out[0].completion == logs.CANNOT


def test_tasks(spark):
    t = spark.createDataFrame([(1, "a", "2024-01-01 10:00:00", 30), (2, "b", None, 5), (3, "c", "2024-01-02 00:00:00", None)], "id int, title string, due string, reminder_offset_minutes int")
    t = tasks.with_defaults(t.withColumn("due_date", F.col("due").cast("timestamp_ntz")).drop("due"))
    got = {r.id: str(r.reminder_time) for r in t.collect()}
    assert got == {1: "2024-01-01 09:30:00", 2: "None", 3: "None"}
    patch = spark.createDataFrame([(1, ["due_date"], None, None), (3, ["reminder_offset_minutes", "title"], "new", 60)], "id int, set_fields array<string>, title string, reminder_offset_minutes int").withColumn("due_date", F.lit(None).cast("timestamp_ntz"))
    after = {r.id: (r.title, str(r.due_date), str(r.reminder_time)) for r in tasks.patched(t, patch).collect()}
    assert after[1] == ("a", "None", "None") and after[2] == ("b", "None", "None") and after[3] == ("new", "2024-01-02 00:00:00", "2024-01-01 23:00:00")
    assert {(r.id, r.job) for r in tasks.due_jobs(t).collect()} == {(1, "reminder"), (1, "execution"), (3, "execution")}
    for bad in (dict(limit=0), dict(limit=101), dict(skip=-1)):
        with pytest.raises(ValueError):
            tasks.page(t, **bad)


@pytest.mark.parametrize(("text", "value"), [
    ("1 + 2 * 3", 7), ("-2^2", -4), ("2^3^2", 512), ("2^-1", 0.5), ("(1+2)!", 6), ("3!!", 720), ("sqrt(16) + pow(2, 3)", 12), ("log(e)", 1), ("log10(100)", 2), ("degrees(pi)", 180),
    ("7 // 2 + 7 % 4", 6), ("1 / 0", None), ("1.5e2", 150), ("sin(radians(90))", 1),
])
def test_calculator(spark, text, value):
    got = spark.range(1).select(scalars.calculate(text).alias("v")).first().v
    assert got == value if value is None else math.isclose(got, value)


@pytest.mark.parametrize("text", ["1 +", "(1", "import os", "x", "1 2", "sqrt(1, 2)", "a.b", "1" * 201, "", "$"])
def test_bad_expressions(spark, text):
    with pytest.raises(scalars.ExpressionError):
        scalars.calculate(text)


def test_bm25_index_counts_without_dealing_texts_out(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "b b A c"), (1, "a b d d"), (2, "B"), (None, "a a"), (3, "--"), (4, " "), (5, None)], "doc_id long, text string")
    want = {("a", 1, 2, 4), ("b", 1, 3, 4), ("c", 1, 1, 4), ("d", 1, 2, 4), ("b", 2, 1, 1), ("a", None, 2, 2)}
    for limit in (100_000, 0):
        monkeypatch.setattr(retrieval, "BROADCAST_TERMS", limit)
        index = retrieval.Bm25Index.build(docs)
        got = [tuple(r) for r in index.with_df().select("term", "id", "tf", "dl", "df").collect()]
        assert len(got) == len(want) and set(got) == {(*p, sum(p[0] == q[0] for q in want)) for p in want}
        assert sorted(r.dl for r in index.lengths.collect()) == [0, 1, 2, 4, 4]
    once = retrieval.Bm25Index.build(docs.where("doc_id is null or doc_id > 1"))
    plan = once.with_df()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and once.postings.count() == 2
    assert "Exchange" not in once.postings._jdf.queryExecution().executedPlan().toString()
