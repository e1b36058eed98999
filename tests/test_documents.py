"""Texts, elements, chunks and parsers."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as tx
from millrace.operators import chunking
from millrace.sources import files, parsers


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first().x


def plain_sentences(text):
    parts = re.findall(r"[^。？！.!?]*[。？！.!?]|[^。？！.!?]+", text)
    return [p.strip() for p in parts if p.strip()]


@pytest.mark.parametrize("text", ["...", "a", "。", "x... y?! z", " wide　blank . b", "", "   ", "一。二？三！"])
def test_sentences(spark, text):
    assert one(spark, tx.sentences(F.col("t")), t=text) == plain_sentences(text)


def test_normalized_text(spark):
    assert one(spark, tx.normalized_text(F.col("t")), t="  Ｆｕｌｌ\t Ｗｉｄｔｈ é ") == "full width e\u0301"
    assert one(spark, tx.normalized_text(F.col("t")), t=" A  b\n") == "a b" and one(spark, tx.normalized_text(F.col("t")), t=None) is None


def test_normalized_documents_equal_plain_ones(spark):
    import hashlib
    import unicodedata

    from millrace.plans import documents

    got = {r.doc_id: r.text_md5 for r in documents.normalize_text(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        plain = re.sub(r"\s+", " ", unicodedata.normalize("NFKD", r.text).lower().strip())
        assert got[r.doc_id] == hashlib.md5(plain.encode()).hexdigest()


def test_latest_file(spark, tmp_path):
    import os

    for i, name in enumerate(("b.txt", "a.txt", "c.txt", "z.log")):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1_000 + 100 * (i % 3), 1_000 + 100 * (i % 3)))
    os.utime(tmp_path / "a.txt", (1_200, 1_200))
    latest = lambda pattern: [r.path.rsplit("/", 1)[1] for r in files.latest_file(spark, str(tmp_path / pattern)).collect()]
    assert latest("*.txt") == ["c.txt"] and latest("a*") == ["a.txt"]


@pytest.mark.parametrize(("f", "text", "expected"), [
    (tx.without_fence, "```json\n{}\n```", "{}"), (tx.without_fence, "plain", "plain"), (tx.salvaged_json, "x {a {b} c} y", "{a {b} c}"), (tx.salvaged_json, "none", None),
    (tx.without_thoughts, "<think>a</think> b <THINK x>c</think>d", "b d"), (tx.without_thoughts, "a <think>open", "a"), (tx.without_lead_in, "Sure, go", "Sure, go"), (tx.without_lead_in, " 好的，  当然，go ", "当然，go"), (tx.without_lead_in, "这里有一些建议：\n1. a", "1. a"), (tx.without_lead_in, "", tx.DEFAULT_SUGGESTION), (tx.without_lead_in, None, tx.DEFAULT_SUGGESTION),
    (tx.last_question, "one?\n好的，two?", "one?"), (tx.last_question, " 好的，two? ", "好的，two?"), (tx.last_question, "好的，" + "long " * 20 + "?", tx.DEFAULT_QUESTION), (tx.last_question, "请问您 where", "请问您 where"), (tx.last_question, "nothing.", tx.DEFAULT_QUESTION), (tx.last_question, None, tx.DEFAULT_QUESTION),
    (tx.extension, "/a/b.TXT", ".txt"), (tx.base_name, "/a/b.TXT", "b.TXT"), (lambda c: tx.preview(c, 3), "abcd", "abc..."), (lambda c: tx.preview(c, 4), "abcd", "abcd"),
])
def test_small_functions(spark, f, text, expected):
    assert one(spark, f(F.col("t")), t=text) == expected


def test_amounts(spark):
    got = [tuple(one(spark, tx.amount_and_unit(F.col("t")), t=t)) for t in ("46.5万元", "7", "much")]
    assert got == [(46.5, "万元"), (7.0, None), (None, None)]


def test_title_hierarchy_equals_a_loop(spark):
    rnd = random.Random(1)
    rows = [(d, i, rnd.choice([None, None, 1, 2, 3]), f"t{d}.{i}") for d in range(5) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id int, idx int, level int, text string")
    got = {(r.doc_id, r.idx): (r.title_1, r.title_2, r.title_3) for r in chunking.title_hierarchy(df).collect()}
    for d in range(5):
        now = {}
        for _, i, level, text in rows[30 * d : 30 * d + 30]:
            if level:
                now = {k: v for k, v in now.items() if k < level} | {level: text}
            assert got[d, i] == tuple(now.get(k) for k in (1, 2, 3))


def test_table_chunks(spark):
    chunk = lambda t: [tuple(c) for c in one(spark, chunking.table_row_chunks(F.col("t")), t=t)]
    assert chunk("|a|\n|-|\n|1|\n|2|\n|3|") == [(0, 2, "|a|\n|-|\n|1|\n|2|"), (2, 3, "|a|\n|-|\n|3|")]
    assert chunk("|a|\n|-|") == [] and chunk("|a|") == []


def test_chunks(spark):
    rows = [(1, 0, "narrative_text", "s. " * 500), (1, 1, "table", "|a|\n|-|\n|1|\n|2|\n|3|"), (1, 2, "narrative_text", "  "), (1, 3, "narrative_text", "short. two.")]
    out = chunking.chunks(spark.createDataFrame(rows, "doc_id int, idx int, element_type string, text string")).orderBy("chunk_number").collect()
    assert [r.chunk_number for r in out] == list(range(1, 504)) and out[0].chunk_text == "s." and out[-1].chunk_text == "short. two."
    assert len({r.chunk_id for r in out}) == 503


def test_row_blocks(spark):
    blanks = [1, 0, 0, 1, 1, 0, 1]
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate(blanks)], "s int, r int, b int")
    out = {r.r: (r.block, r.place) for r in chunking.row_blocks(df, F.col("b") == 1, ["s"], "r").collect()}
    assert out == {1: (0, 0), 2: (0, 1), 5: (1, 0)}


def kinds(elements):
    return [e["element_type"] for e in elements]


def test_html():
    page = """<html><body><nav>skip</nav><main>loose <b>bold</b><h2>Head</h2><p>one<p>two <i>x</i><ul><li>a<ol start=3><li>n</ol></li><li>b</ul>
    <table><caption>cap</caption><thead><tr><th>h1</th><th>h2</th></tr><tr><th>g</th><th></th></tr></thead><tr><td>1|2</td></tr></table>
    <pre class="lang-sh">  ls
</pre><blockquote>q <p>r</p></blockquote><hr><script>no()</script><div>end &amp; done</div></main></body></html>"""
    got = list(parsers.html_elements(page))
    assert kinds(got) == ["narrative_text", "title", "narrative_text", "narrative_text", "list_item", "list_item", "list_item", "table", "code_block", "narrative_text", "page_break", "narrative_text"]
    assert got[0]["text"] == "loose bold" and got[1]["level"] == 2 and (got[5]["text"], got[5]["level"], got[5]["item_number"]) == ("n", 1, "3")
    assert got[7]["markdown_representation"] == "| h1 | h2 |\n| --- | --- |\n| g |  |\n| 1\\|2 |  |" and got[7]["caption"] == "cap"
    assert (got[8]["code"], got[8]["language"]) == ("  ls", "sh") and got[-1]["text"] == "end & done"
    select = list(parsers.html_elements("<body><select><option>kept</option></select><meta name=a><svg><path>no</path></svg><figure>a<figcaption>b</figcaption></figure>c<details><summary>d</summary>e</details></body>"))
    assert [e["text"] for e in select] == ["kept", "a", "b", "c", "d", "e"]
    empty = list(parsers.html_elements("<table><caption>only</caption></table><table></table>"))
    assert [(e["caption"], e["markdown_representation"]) for e in empty] == [("only", "")]
    assert list(parsers.html_elements("")) == [] and kinds(parsers.html_elements("just text")) == ["narrative_text"]


def test_markdown():
    text = "# T #\npara\nmore\n\n- a\n  - b\n2. c\n\n| h | i |\n| :-- | --- |\n| 1 | 2 |\n\n```py\nx = 1\n```\n---\n> q\n> r\n"
    got = list(parsers.markdown_elements(text))
    assert kinds(got) == ["title", "narrative_text", "list_item", "list_item", "list_item", "table", "code_block", "page_break", "narrative_text"]
    assert got[1]["text"] == "para\nmore" and got[3]["level"] == 1 and got[4]["item_number"] == "2" and got[5]["markdown_representation"] == "| h | i |\n|---|---|\n| 1 | 2 |"
    assert got[6]["code"] == "x = 1" and got[6]["language"] == "py" and got[8]["text"] == "q\nr"


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_word_file():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda style, text: f'<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = p('<w:pStyle w:val="Heading2"/>', "Head") + p('<w:numPr><w:ilvl w:val="1"/></w:numPr>', "item") + p("", "text") + '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
    body += "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    got = list(parsers.docx_elements(zipped(word__document_xml=f"<w:document {w}><w:body>{body}</w:body></w:document>")))
    assert [(e["element_type"], e.get("level")) for e in got] == [("title", 2), ("list_item", 1), ("narrative_text", None), ("page_break", None), ("table", None)]


def test_word_file_with_all_its_parts():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
    p = lambda style, text: f'<w:p><w:pPr>{style}</w:pPr><w:r><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'
    item = lambda n, level, text: p(f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{n}"/></w:numPr>', text)
    code = '<w:pStyle w:val="HTMLPreformatted"/>'
    body = item(1, 0, "one") + item(1, 1, "sub") + item(1, 1, "sub two") + item(1, 0, "two") + item(1, 1, "again") + item(2, 0, "dot") + p(code, "x = 1") + p(code, "  y") + p("", "text")
    body += '<w:p><w:r><w:drawing><wp:inline><wp:docPr id="1" name="Picture 1" descr="a cat"/></wp:inline></w:drawing></w:r></w:p>' + p(code, "end")
    levels = lambda i, fmt: f'<w:abstractNum w:abstractNumId="{i}">' + "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="{1 + 2 * k}"/><w:numFmt w:val="{fmt}"/></w:lvl>' for k in (0, 1)) + "</w:abstractNum>"
    numbers = levels(7, "decimal") + levels(8, "bullet") + '<w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="8"/></w:num>'
    edge = lambda kind, text: f"<w:{kind} {w}>{p('', text)}</w:{kind}>"
    data = zipped(
        word__document_xml=f"<w:document {w}><w:body>{body}</w:body></w:document>", word__numbering_xml=f"<w:numbering {w}>{numbers}</w:numbering>",
        word__header1_xml=edge("hdr", "top"), word__header2_xml=edge("hdr", "top"), word__footer1_xml=edge("ftr", "bottom"),
    )
    got = list(parsers.docx_elements(data))
    assert kinds(got) == ["header", *["list_item"] * 6, "code_block", "narrative_text", "image", "code_block", "footer"]
    assert [(e["level"], e["ordered"], e["item_number"]) for e in got[1:7]] == [(0, True, "1"), (1, True, "3"), (1, True, "4"), (0, True, "2"), (1, True, "3"), (0, False, None)]
    assert got[7]["code"] == "x = 1\n  y" and got[9]["text"] == "a cat" and (got[0]["text"], got[-1]["text"]) == ("top", "bottom")


def test_spreadsheet_blocks():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = f'<row r="1">{cell("A1", "h")}{cell("C1", "i")}</row><row r="2">{cell("A2", "1")}</row><row r="5">{cell("A5", "z")}</row>'
    data = zipped(xl__workbook_xml=f'<workbook {s}><sheets><sheet name="S"/></sheets></workbook>', xl__worksheets__sheet1_xml=f"<worksheet {s}><sheetData>{rows}</sheetData></worksheet>")
    got = list(parsers.xlsx_elements(data))
    assert [e["markdown_representation"] for e in got] == ["| h |  | i |\n|---|---|---|\n| 1 |  |  |", "| z |\n|---|"] and got[0]["page_number"] == 1 and got[0]["caption"] == "Sheet: S"


def test_unknown_and_broken_files_give_one_element(spark):
    df = spark.createDataFrame([(1, bytearray(b"x"), ".zip"), (2, bytearray(b"no zip"), ".docx"), (3, bytearray(b"hi"), ".TXT"), (4, None, ".txt"), (5, bytearray(b" "), ".txt"), (6, bytearray(b"<script>x</script>"), ".html")], "k int, c binary, e string")
    out = {r.k: r.text for r in parsers.parsed(df, "k", "c", "e").collect()}
    assert out[1].startswith("[Content Not Parsed") and out[2].startswith("[Critical Parsing Exception") and out[3] == "hi" and out[4].startswith("[Content Not Parsed")
    assert len(out) == 6 and out[5] == "[Content Not Parsed: .txt]" and out[6] == "[Content Not Parsed: .html]"  # one in, one out


def test_directory_scan_and_lists(spark, tmp_path):
    for name in ("a.txt", "b.MD", "c.exe"):
        (tmp_path / name).write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.txt").write_text("x")
    assert {r.filename for r in files.scan_directory(spark, str(tmp_path)).collect()} == {"a.txt", "b.MD"}
    assert files.scan_directory(spark, str(tmp_path / "none")).count() == 0
    lines = spark.createDataFrame([(" q ",), ("# c",), ("",), ("x",)], "value string")
    assert [r.value for r in files.question_list(lines).collect()] == ["q", "x"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00")], "id int, t string").withColumn("t", F.to_timestamp("t"))
    files.append_log(rows, str(tmp_path / "log"), F.col("t"))
    files.append_log(rows, str(tmp_path / "log"), F.col("t"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4 and (tmp_path / "log" / "date=20240101").is_dir()
    files.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbfid,") for f in (tmp_path / "csv").glob("part-*"))
    for _ in range(2):  # the batch comes twice
        files.write_log_batch(rows, str(tmp_path / "batches"), F.col("t"), 3)
    assert spark.read.json(str(tmp_path / "batches")).count() == 2
    files.write_json_lines(rows.withColumn("none", F.lit(None).cast("string")), str(tmp_path / "lines"))
    assert {tuple(r) for r in files.read_json_lines(spark, str(tmp_path / "lines"), T._parse_datatype_string("id int, none string")).collect()} == {(1, None), (2, None)}
    files.write_vectors(rows, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2


def test_cached_requests_follow_a_plain_cache(spark, tmp_path):
    from millrace.streaming import ingest

    rnd = random.Random(2)
    rows = sorted((1_000 + rnd.randrange(5_000), rnd.choice("abc")) for _ in range(200))
    rows = [(t + i * 0, k) for i, (t, k) in enumerate(rows)]
    df = spark.createDataFrame([(k, t) for t, k in rows], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    for part, (low, high) in enumerate([(0, 2_500), (2_500, 4_000), (4_000, 9_000)]):  # three micro-batches
        df.where((F.col("ts").cast("long") >= low) & (F.col("ts").cast("long") < high)).coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = ingest.cached_requests(stream, "key", "ts", 300).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    out.trigger(availableNow=True).start().awaitTermination(300)
    made, expected = {}, []
    for t, k in rows:
        hit = k in made and t < made[k] + 300
        made[k] = made[k] if hit else t
        expected.append((k, t, hit))
    got = [(r.key, r.s, r.hit) for r in spark.read.parquet(str(tmp_path / "out")).select("key", F.col("at").cast("long").alias("s"), "hit").collect()]
    assert sorted(got) == sorted(expected)


@pytest.mark.parametrize(("page", "n"), [("<div>" * 20_000 + "x" + "</div>" * 20_000, 1), ("".join(f"<ul><li>a{i}" for i in range(20_000)) + "</li></ul>" * 20_000, 20_000), ("<font>" * 20_000 + "<p>y</p>" * 20_000, 20_000)])
def test_deep_pages_are_read_in_linear_time(page, n):
    import time

    began = time.process_time()
    assert len(list(parsers.html_elements(page))) == n
    assert time.process_time() - began < 20


def test_lists_within_lists_keep_their_numbers_and_order():
    got = list(parsers.html_elements("<ol start=3><li>a<ul><li>b</li><li>c</li></ul><ol><li>d</ol></li><li>e</li></ol>"))
    assert [(e["text"], e["level"], e["item_number"]) for e in got] == [("a", 0, "3"), ("b", 1, None), ("c", 1, None), ("d", 1, "1"), ("e", 0, "4")]


def test_parsers_as_a_table_function(spark):
    rows = [(1, "# Title\n\ntext", ".md"), (2, "<p>one</p><p>two</p>", ".html"), (3, None, ".txt"), (None, "plain", ".txt"), (5, "?", ".none")]
    files = spark.createDataFrame(rows, "id long, content string, ext string")
    parsers.register_function(spark, "parse_some")
    got = spark.sql("SELECT * FROM parse_some(TABLE({files}))", files=files)
    want = parsers.parsed(files, "id", "content", "ext").withColumnRenamed("id", "key")
    plain = lambda df: sorted(str(tuple(None if v is None else str(v) for v in r)) for r in df.collect())
    assert got.columns == want.columns and plain(got) == plain(want)
