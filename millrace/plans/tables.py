"""Structured queries over the star schema's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sqo
from ..session import table
from . import Catalogue

catalogue = Catalogue()
_ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice"


def _filters(name: str, source: str, columns: str, filters: list[dict], condition: str) -> None:
    """A query that filters a table, and its SQL."""

    def run(spark, sf_dir):
        kept, _ = sqo.apply_filters(table(spark, sf_dir, source), filters)
        return kept.select(*columns.split(", "))

    catalogue.add(name, f"SELECT {columns} FROM {source} WHERE {condition}")(run)


def _f(column, operator, value=None, **more):
    return {"column": column, "operator": operator, "value": value, **more}


_filters("sqo_eq", "orders", _ORDER, [_f("o_orderstatus", "equals", "F")], "o_orderstatus = 'F'")
_filters("sqo_gt", "lineitem", _LINE, [_f("l_quantity", "greater_than", 45)], "l_quantity > 45")
_filters("sqo_ge", "lineitem", _LINE, [_f("l_quantity", ">=", 50)], "l_quantity >= 50")
_filters("sqo_lt", "lineitem", _LINE, [_f("l_extendedprice", "<", 2000.0)], "l_extendedprice < 2000.0")
_filters("sqo_le", "lineitem", _LINE, [_f("l_quantity", "<=", 2)], "l_quantity <= 2")
_filters("sqo_contains", "customer", "c_custkey, c_name, c_mktsegment", [_f("c_mktsegment", "contains", "build|mach")], "regexp_matches(c_mktsegment, 'build|mach', 'i')")
_filters("sqo_not_contains", "part", "p_partkey, p_name, p_type", [_f("p_type", "not_contains", "a")], "NOT regexp_matches(p_type, 'a', 'i')")
_filters("sqo_in", "orders", _ORDER, [_f("o_orderstatus", "is_in_list", ["F", "P"])], "o_orderstatus IN ('F', 'P')")
_filters("sqo_between_swapped", "lineitem", _LINE, [_f("l_quantity", "between", [12, 10])], "l_quantity BETWEEN 10 AND 12")
_filters("sqo_date_filters", "orders", _ORDER, [_f("o_orderdate", ">=", "1996-01-01", is_date=True), _f("o_orderdate", "<", "1996-03-01", is_date=True)], "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01'")
_filters("sqo_date_between", "orders", _ORDER, [_f("o_orderdate", "between", ["1995-02-01", "1995-01-01"], is_date=True)], "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-02-01'")
_filters("sqo_filter_chain", "lineitem", _LINE, [_f("l_quantity", ">", 10), _f("l_discount", "<", 0.05), _f("l_returnflag", "in", ["R", "A"]), _f("l_linestatus", "!=", "O")], "l_quantity > 10 AND l_discount < 0.05 AND l_returnflag IN ('R', 'A') AND l_linestatus <> 'O'")
_filters("sqo_bad_filter_skipped", "orders", _ORDER, [_f("nowhere", "==", 1), _f("o_orderdate", "<", "no date", is_date=True), _f("o_orderstatus", "like", "F"), _f("o_orderstatus", "==", "P")], "o_orderstatus = 'P'")

_NULLED = "CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END"


def _with_nulls(spark, sf_dir):
    """Orders whose status is null where it was F."""
    return table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")))


def _null_filters(name: str, filters: list[dict], condition: str) -> None:
    def run(spark, sf_dir):
        return sqo.apply_filters(_with_nulls(spark, sf_dir), filters)[0].select("o_orderkey", "status", "o_totalprice")

    catalogue.add(name, f"SELECT o_orderkey, status, o_totalprice FROM (SELECT *, {_NULLED} AS status FROM orders) WHERE {condition}")(run)


_null_filters("sqo_ne_keeps_null", [_f("status", "not_equals", "O")], "status IS DISTINCT FROM 'O'")
_null_filters("sqo_not_in_keeps_null", [_f("status", "not in", ["O"])], "status IS NULL OR status <> 'O'")
_null_filters("sqo_is_null", [_f("status", "is_null")], "status IS NULL")
_null_filters("sqo_is_not_null", [_f("status", "notnull")], "status IS NOT NULL")
_null_filters("sqo_contains_null_text", [_f("status", "contains", "^none$")], "regexp_matches(coalesce(status, 'None'), '^none$', 'i')")


def _query(name: str, source, sql: str, query: dict, rounded: list[str] = (), counts: list[str] = ()) -> None:
    """A structured query object over a table (a name or a function), and its SQL."""

    def run(spark, sf_dir):
        df = source(spark, sf_dir) if callable(source) else table(spark, sf_dir, source)
        out = sqo.compile_query(df, query)
        return out.withColumns({c: F.round(c, 6) for c in rounded})

    catalogue.add(name, sql)(run)


_query("sqo_unique", _with_nulls, f"SELECT DISTINCT {_NULLED} AS status FROM orders", {"operation_type": "get_unique_values", "column_name": "status"})
_query("sqo_unique_dropna", _with_nulls, f"SELECT DISTINCT status FROM (SELECT {_NULLED} AS status FROM orders) WHERE status IS NOT NULL", {"operation_type": "get_unique_values", "column_name": "status", "options": {"drop_na": True}})

_GROUPED = {
    "sum": "sum(l_extendedprice)", "mean": "avg(l_extendedprice)", "count": "count(l_extendedprice)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)",
    "nunique": "count(DISTINCT l_extendedprice)", "std": "stddev_samp(l_extendedprice)", "var": "var_samp(l_extendedprice)", "median": "median(l_extendedprice)", "size": "count(*)",
    "sem": "stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice))", "skew": "skewness(l_extendedprice)", "kurt": "kurtosis(l_extendedprice)", "quantile": "quantile_cont(l_extendedprice, 0.5)",
    "any": "bool_or(l_extendedprice <> 0)", "all": "bool_and(l_extendedprice <> 0)",
}
for _name, _sql in _GROUPED.items():
    _whole = _name in ("count", "nunique", "size", "any", "all")
    _digits = 2 if _name in ("sum", "var") else 6

    def _run(spark, sf_dir, name=_name, whole=_whole, digits=_digits):
        query = {"operation_type": "group_by_aggregate", "group_by_columns": ["l_returnflag"], "aggregation_column": "l_extendedprice", "aggregation_function": name, "filters": [_f("l_quantity", ">", 25)]}
        out = sqo.compile_query(table(spark, sf_dir, "lineitem"), query)
        return out if whole else out.withColumn("l_extendedprice", F.round("l_extendedprice", digits))

    _value = _sql if _whole else f"round({_sql}, {_digits})"
    catalogue.add(f"sqo_group_{_name}", f"SELECT l_returnflag, {_value} AS l_extendedprice FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag")(_run)

_query("sqo_group_multi", "lineitem", "SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS mean_discount FROM lineitem GROUP BY ALL",
       {"operation_type": "group_by_aggregate", "group_by_columns": ["l_returnflag", "l_linestatus"], "aggregation_column": "l_discount", "aggregation_function": "mean", "options": {"output_column_name": "mean_discount"}}, rounded=["mean_discount"])
_query("sqo_group_null_keys_dropped", _with_nulls, f"SELECT status, count(o_totalprice) AS o_totalprice FROM (SELECT *, {_NULLED} AS status FROM orders) WHERE status IS NOT NULL GROUP BY status",
       {"operation_type": "group_by_aggregate", "group_by_columns": "status", "aggregation_column": "o_totalprice", "aggregation_function": "count"})
_query("sqo_global_agg", "lineitem", "SELECT max(l_extendedprice) AS max FROM lineitem WHERE l_quantity < 10",
       {"operation_type": "group_by_aggregate", "group_by_columns": [], "aggregation_column": "l_extendedprice", "aggregation_function": "max", "filters": [_f("l_quantity", "<", 10)]})
_query("sqo_output_rename", "orders", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL",
       {"operation_type": "group_by_aggregate", "group_by_columns": "o_orderpriority", "aggregation_column": "o_custkey", "aggregation_function": "nunique", "options": {"output_column_name": "customers"}})
_ALL_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
_query("sqo_topn_desc", "lineitem", f"SELECT {', '.join(_ALL_LINE)} FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate LIMIT 10",
       {"operation_type": "find_top_n_rows", "select_columns": _ALL_LINE, "condition_column": "l_extendedprice", "n_rows": 10, "tie_columns": _ALL_LINE[:5]})
_query("sqo_topn_asc_nulls_last", _with_nulls, f"SELECT o_orderkey, status FROM (SELECT *, {_NULLED} AS status FROM orders) ORDER BY status ASC NULLS LAST, o_orderkey LIMIT 20",
       {"operation_type": "find_top_n_rows", "select_columns": ["o_orderkey", "status"], "condition_column": "status", "sort_order": "ascending", "n_rows": 20, "tie_columns": ["o_orderkey"]})


def _sql(name: str, source: str, text: str, filters: list[dict] | None = None, condition: str = "TRUE") -> None:
    _query(name, source, f"WITH df AS (SELECT * FROM {source} WHERE {condition}) {text}", {"operation_type": "direct_sql_query", "sql_query": text, "filters": filters})


_sql("sqo_sql_filter", "lineitem", "SELECT l_returnflag, count(*) AS n, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS quantity FROM df GROUP BY l_returnflag HAVING count(*) > 10", [_f("l_discount", ">", 0.05)], "l_discount > 0.05")
_sql("sqo_sql_self_join", "nation", "SELECT a.n_name AS first, b.n_name AS second FROM df a JOIN df b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_sql("sqo_sql_window", "nation", "SELECT n_name, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS BIGINT) AS running FROM df")
_sql("sqo_sql_setops", "nation", "SELECT n_regionkey AS k FROM df WHERE n_nationkey < 10 INTERSECT SELECT n_regionkey FROM df WHERE n_nationkey >= 10 UNION SELECT 99 AS k")
