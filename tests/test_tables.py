"""Structured queries: null rules, dates, errors."""

import datetime

import pytest

from millrace.operators import sqo


@pytest.fixture(scope="module")
def rows(spark):
    d = datetime.datetime
    data = [("a", 1.0, "x1", d(2024, 1, 1)), ("b", None, None, None), (None, 3.0, "Y", d(2024, 3, 1)), ("a", 5.0, "none", d(2024, 2, 1))]
    return spark.createDataFrame(data, "k string, n double, s string, t timestamp_ntz")


def kept(df, *filters):
    out, skipped = sqo.apply_filters(df, [dict(zip(("column", "operator", "value", "is_date"), f, strict=False)) for f in filters])
    return sorted((r.n or 0) for r in out.collect()), skipped


@pytest.mark.parametrize(
    ("spec", "expected"),
    [
        (("n", "equals", 3), [3]), (("n", "==", 3), [3]), (("n", "!=", 3), [0, 1, 5]), (("n", "not_equals", 3), [0, 1, 5]), (("n", ">", 3), [5]), (("n", ">=", 3), [3, 5]),
        (("n", "less_than", 3), [1]), (("n", "<=", 3), [1, 3]), (("s", "contains", "^X|y"), [1, 3]), (("s", "contains", "none"), [0, 5]), (("s", "not_contains", "none"), [1, 3]),
        (("n", "in", [1, 3]), [1, 3]), (("n", "not in", [1, 3]), [0, 5]), (("n", "is_not_in_list", [1]), [0, 3, 5]), (("n", "between", [5, 3]), [3, 5]), (("n", "is_null"), [0]), (("n", "notnull"), [1, 3, 5]),
        (("t", ">=", "2024-02-01", True), [3, 5]), (("t", "between", ["2024-03-01", "2024-02-01"], True), [3, 5]), (("t", "in", ["2024-01-01"], True), [1]), (("t", "not in", ["2024-01-01"], True), [0, 3, 5]),
        (("t", "!=", "2024-01-01", True), [0, 3, 5]),
    ],
)
def test_predicates(rows, spec, expected):
    assert kept(rows, spec) == (expected, [])


@pytest.mark.parametrize("spec", [("zz", "==", 1), ("n", "like", 1), ("n", "==", None), ("n", "in", 3), ("n", "between", [1]), ("t", ">", "no date", True), ("t", "contains", "2024", True), ("s", "contains", "(")])
def test_unusable_filters_are_reported(rows, spec):
    got, skipped = kept(rows, spec, ("n", ">", 3))
    assert got == [5] and len(skipped) == 1


def test_dates_in_texts(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("bad", 2.0), (None, 3.0), ("2024-02-01 10:00:00", 4.0)], "t string, n double")
    assert kept(df, ("t", ">", "2024-01-15", True))[0] == [4] and kept(df, ("t", "!=", "2024-01-01", True))[0] == [2, 3, 4]


def test_groups(rows, spark):
    out = {r.k: r.n for r in sqo.group_aggregate(rows, "k", "n", "sum").collect()}
    assert out == {"a": 6.0, "b": 0.0}  # null keys go; the sum of nothing is 0
    assert {r.k: r.n for r in sqo.group_aggregate(rows, ["k"], "n", "std").collect()}["b"] is None
    assert sqo.group_aggregate(rows, [], "n", "max").first().asDict() == {"max": 5.0}
    assert sqo.group_aggregate(rows, [], "n", "nunique", "m").first().m == 3


def test_top_rows_have_nulls_last(rows):
    assert [r.n for r in sqo.top_rows(rows, "n", "n", n=4).collect()] == [5.0, 3.0, 1.0, None]
    assert [r.n for r in sqo.top_rows(rows, ["n"], "n", "ascending", 4).collect()] == [1.0, 3.0, 5.0, None]
    for bad in (dict(n=0), dict(n=True), dict(order="up")):
        with pytest.raises(sqo.QueryError):
            sqo.top_rows(rows, ["n"], "n", **bad)


def test_unique_values(rows):
    assert {r.k for r in sqo.unique_values(rows, "k").collect()} == {"a", "b", None}
    assert {r.k for r in sqo.unique_values(rows, "k", True).collect()} == {"a", "b"}
    assert [r.k for r in sqo.unique_values(rows.where("t is not null"), "k", order="t").collect()] == ["a", None]


def test_answers(rows):
    ask = lambda **q: sqo.respond(rows, q)
    assert ask(operation_type="direct_sql_query", sql_query="SELECT count(*) AS c FROM df")["result"] == 4
    assert ask(operation_type="direct_sql_query", sql_query="SELECT n FROM df WHERE n > 2 ORDER BY n")["result"] == [3.0, 5.0]
    assert ask(operation_type="direct_sql_query", sql_query="SELECT group_concat(k, '-') AS g, 1 AS o FROM df WHERE n = 1")["result"] == {"g": "a", "o": 1}
    assert ask(operation_type="direct_sql_query", sql_query="SELECT 1 AS x FROM df WHERE 1 = 0")["result"] == "the query gave no rows"
    assert not ask(operation_type="nothing")["success"] and "no operation" in ask(operation_type="nothing")["error"]
    assert not ask(operation_type="direct_sql_query", sql_query="SELECT nowhere FROM df")["success"]
    assert not ask(operation_type="group_by_aggregate", group_by_columns=[], aggregation_column="zz", aggregation_function="sum")["success"]


def test_answers_hold_all_values(spark):
    answer = sqo.respond(spark.range(10_050), {"operation_type": "get_unique_values", "column_name": "id"})
    assert answer["success"] and sorted(answer["result"]) == list(range(10_050))


def test_reducers_are_those_of_the_data_frame_library(spark):
    import math

    import pandas as pd

    rows = [("a", x) for x in (1.0, 2.0, 2.5, 9.0, 0.0)] + [("b", 3.0)] * 4 + [("c", 1.0), ("c", 2.0), ("c", None)] + [("d", None)]
    local = pd.DataFrame(rows, columns=["k", "n"]).groupby("k").n
    df = spark.createDataFrame(rows, "k string, n double")
    for name in ("skew", "quantile", "any", "all", "prod", "sem", "std", "median", "nunique"):
        expected = local.agg(name).to_dict()
        got = {r.k: r.n for r in sqo.group_aggregate(df, "k", "n", name).collect()}
        for k, v in expected.items():
            if name == "prod" and k == "d":
                continue
            assert got[k] is None if v != v else math.isclose(got[k], v, abs_tol=1e-9), (name, k)
    for name in ("kurt", "skew"):
        for k in "abcd":
            v = local.get_group(k).agg(name)
            got = sqo.group_aggregate(df.where(f"k = '{k}'"), [], "n", name).first()[name]
            assert got is None if v != v else math.isclose(got, v, abs_tol=1e-9), (name, k)


def test_statements_leave_views_alone(spark, rows):
    spark.range(3).createOrReplaceTempView("df")
    before = {t.name for t in spark.catalog.listTables()}
    assert sqo.sql_query(rows, "WITH x AS (SELECT n FROM df) SELECT count(*) AS c FROM x;").first().c == 4
    assert sqo.sql_query(rows, "SELECT df.n FROM df WHERE df.n = 3").first().n == 3
    assert spark.table("df").count() == 3 and {t.name for t in spark.catalog.listTables()} == before
    spark.catalog.dropTempView("df")


def test_skipped_filters_are_answered(rows):
    answer = sqo.respond(rows, {"operation_type": "get_unique_values", "column_name": "n", "filters": [{"column": "zz", "operator": "=="}, {"column": "n", "operator": ">", "value": 3}]})
    assert answer["success"] and answer["result"] == 5.0 and len(answer["skipped_filters"]) == 1 and "zz" in answer["skipped_filters"][0]


def test_answers_from_a_sheet(spark, tmp_path):
    from tests.test_documents import zipped

    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>' if v != "" else ""
    sheet = lambda rows: f"<worksheet {s}><sheetData>" + "".join(f'<row r="{i}">' + "".join(cell(f"{c}{i}", v) for c, v in zip("ABC", r, strict=False)) + "</row>" for i, r in enumerate(rows, 1)) + "</sheetData></worksheet>"
    data = zipped(
        xl__workbook_xml=f'<workbook {s}><sheets><sheet name="Sheet1"/><sheet name="More"/></sheets></workbook>',
        xl__worksheets__sheet1_xml=sheet([["name", "price", "n"], ["a", "1.5", "2"], ["b", "", "3"]]), xl__worksheets__sheet2_xml=sheet([["x", "x", ""], ["1", "2", "z"]]),
    )
    path = tmp_path / "book.xlsx"
    path.write_bytes(data)
    ask = lambda **q: sqo.respond_sheet(spark, str(path), q)
    assert ask(operation_type="group_by_aggregate", group_by_columns=[], aggregation_column="n", aggregation_function="sum")["result"] == 5
    assert ask(operation_type="find_top_n_rows", select_columns=["name", "price"], condition_column="price", n_rows=2)["result"] == [{"name": "a", "price": 1.5}, {"name": "b", "price": None}]
    assert ask(operation_type="direct_sql_query", sql_query="SELECT * FROM df", sheet_name="More")["result"] == {"x": 1, "x.1": 2, "Unnamed: 2": "z"}
    assert not ask(operation_type="get_unique_values", column_name="n", sheet_name="None")["success"]


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = sqo.apply_filters(df, [{"column": "o_orderdate", "operator": ">", "value": "1998-01-01", "is_date": True}, {"column": "o_orderstatus", "operator": "==", "value": "F"}])[0]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan.select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in text and "GreaterThan(o_orderdate" in text


@pytest.mark.parametrize("engine", ["frame"])
def test_filters_on_values_of_other_types(spark, engine):
    """As pandas has it: equality across types is false, an order across types leaves the filter out."""
    import pandas as pd

    data = {"n": [1, 2, 3], "s": ["5", "x", None], "b": [True, False, True], "f": [1.0, 2.5, 2.0]}
    frame = pd.DataFrame(data)
    rows = spark.createDataFrame(list(zip(range(3), *data.values(), strict=True)), "i long, n long, s string, b boolean, f double")
    cases = [("s", 5), ("n", "x"), ("n", "2"), ("b", 1), ("b", "True"), ("f", 2), ("n", 2.0), ("f", "2.5"), ("s", "x")]
    for column, value in cases:
        for op, plain in (("equals", frame[column] == value), ("not_equals", frame[column] != value)):
            kept, skipped = sqo.apply_filters(rows, [{"column": column, "operator": op, "value": value}])
            assert sorted(r.i for r in kept.collect()) == [i for i, k in enumerate(plain) if k] and not skipped, (column, op, value)
    for column, value in [("n", ["x", 1]), ("s", ["x", 5]), ("s", [5, 6]), ("f", ["a", 2]), ("b", [1, "q"])]:
        for op, plain in (("in", frame[column].isin(value)), ("not in", ~frame[column].isin(value))):
            kept, skipped = sqo.apply_filters(rows, [{"column": column, "operator": op, "value": value}])
            assert sorted(r.i for r in kept.collect()) == [i for i, k in enumerate(plain) if k] and not skipped, (column, op, value)
    for column, op, value in [("s", ">", 5), ("n", "<=", "x"), ("n", "between", ["a", "b"]), ("n", "between", [1, "b"]), ("s", "<", 1.5)]:
        kept, skipped = sqo.apply_filters(rows, [{"column": column, "operator": op, "value": value}])
        assert kept.count() == 3 and len(skipped) == 1
    kept, skipped = sqo.apply_filters(rows, [{"column": "n", "operator": ">=", "value": "2020-01-01", "is_date": True}])
    assert kept.count() == 3 and "no dates" in skipped[0]


def test_any_all_first_and_last(spark):
    rows = spark.createDataFrame([(1, "a", "", 3), (1, "b", None, 1), (2, "c", "x", 2), (2, None, "y", 5)], "g long, s string, t string, at long")
    got = lambda f, column, **more: [r[1] for r in sqo.group_aggregate(rows, "g", column, f, **more).collect()]
    assert got("any", "t") == [False, True] and got("all", "t") == [False, True]
    assert got("first", "s", order="at") == ["b", "c"] and got("last", "s", order="at") == ["a", "c"]
    query = {"operation_type": "group_by_aggregate", "group_by_columns": ["g"], "aggregation_column": "s", "aggregation_function": "last", "order_column": "at"}
    assert [r.s for r in sqo.compile_query(rows, query).collect()] == ["a", "c"]


def workbook(path, sheets, files=None, styles="", date1904=False):
    """A workbook whose tabs are ``sheets`` (name, rows as XML), stored in the files given."""
    import zipfile

    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    files = files or [f"sheet{i}.xml" for i in range(1, len(sheets) + 1)]
    with zipfile.ZipFile(path, "w") as z:
        tabs = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><workbookPr date1904="{int(date1904)}"/><sheets>{tabs}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/{f}"/>' for i, f in enumerate(files, 1)) + "</Relationships>")
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{s}">{styles}</styleSheet>')
        for (_, rows), f in zip(sheets, files, strict=True):
            z.writestr(f"xl/worksheets/{f}", f'<worksheet xmlns="{s}"><sheetData>{rows}</sheetData></worksheet>')


def test_sheets_by_their_relations(spark, tmp_path):
    text = lambda ref, v: f'<c r="{ref}" t="str"><v>{v}</v></c>'
    rows = lambda name, n: f'<row r="1">{text("A1", "what")}{text("B1", "n")}</row><row r="3">{text("A3", name)}<c r="B3"><v>{n}</v></c></row>'
    path = str(tmp_path / "tabs.xlsx")  # tabs in another order than the files, one file left over from a deleted sheet
    workbook(path, [("Totals", rows("total", 1)), ("Raw", rows("raw", 2))], ["sheet2.xml", "sheet7.xml"])
    from millrace.sources import files, parsers

    assert [tuple(r) for r in files.read_excel(spark, path, "Totals").collect()] == [("total", 1)]
    assert [tuple(r) for r in files.read_excel(spark, path, "Raw").collect()] == [("raw", 2)]
    assert [tuple(r) for r in files.read_excel(spark, path, 1).collect()] == [("raw", 2)]
    with pytest.raises(ValueError, match="no sheet"):
        files.read_excel(spark, path, "Sheet1")
    with open(path, "rb") as f:
        assert [e["caption"] for e in parsers.xlsx_elements(f.read())] == ["Sheet: Totals"] * 2 + ["Sheet: Raw"] * 2


def test_dates_and_truth_values_of_sheets(spark, tmp_path):
    import datetime as dt

    styles = '<numFmts><numFmt numFmtId="170" formatCode="[$-409]d\\-mmm\\-yy;@"/><numFmt numFmtId="171" formatCode="0.00&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    head = "".join(f'<c r="{c}1" t="str"><v>{n}</v></c>' for c, n in zip("ABCDE", ["day", "own", "size", "ok", "mixed"], strict=True))
    body = '<row r="2"><c r="A2" s="1"><v>45292</v></c><c r="B2" s="2"><v>36526.5</v></c><c r="C2" s="3"><v>1.5</v></c><c r="D2" t="b"><v>1</v></c><c r="E2" s="1"><v>45292</v></c></row>'
    body += '<row r="3"><c r="A3" s="1"><v>45300</v></c><c r="C3" s="3"><v>2</v></c><c r="D3" t="b"><v>0</v></c><c r="E3" t="str"><v>late</v></c></row>'
    path = str(tmp_path / "dates.xlsx")
    workbook(path, [("Sheet1", f'<row r="1">{head}</row>{body}')], styles=styles)
    from millrace.sources import files

    rows = files.read_excel(spark, path)
    assert dict(rows.dtypes) == {"day": "timestamp_ntz", "own": "timestamp_ntz", "size": "double", "ok": "boolean", "mixed": "string"}
    assert [tuple(r) for r in rows.collect()] == [(dt.datetime(2024, 1, 1), dt.datetime(2000, 1, 1, 12), 1.5, True, "2024-01-01 00:00:00"), (dt.datetime(2024, 1, 9), None, 2.0, False, "late")]
    late = {"operation_type": "get_unique_values", "column_name": "day", "filters": [{"column": "day", "operator": ">=", "value": "2024-01-05", "is_date": True}]}
    assert sqo.respond_sheet(spark, path, late)["result"] == dt.datetime(2024, 1, 9)
    early = str(tmp_path / "early.xlsx")
    workbook(early, [("Sheet1", '<row r="1"><c r="A1" t="str"><v>day</v></c></row><row r="2"><c r="A2" s="1"><v>0</v></c></row>')], styles=styles, date1904=True)
    assert files.read_excel(spark, early).first().day == dt.datetime(1904, 1, 1)


def test_group_concat_in_literals_stays(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k long, s string")
    row = sqo.sql_query(df, "SELECT 'group_concat(' AS a, 'it''s group_concat (' AS b, GROUP_CONCAT (s, '-') AS c /* group_concat( */ FROM df -- group_concat(").first()
    assert (row.a, row.b.replace("'", ""), sorted(row.c.split("-"))) == ("group_concat(", "its group_concat (", ["a", "b"])
