"""Structured query objects: a small dictionary language compiled to DataFrame plans.

``compile_query`` takes a DataFrame and a dictionary with ``operation_type`` (one of
get_unique_values, group_by_aggregate, find_top_n_rows, direct_sql_query), optional
``filters`` and the operation's own keys. Filters are a conjunction; one that can't be
used is left out and reported, as the language asks.
"""

from __future__ import annotations

import datetime
import decimal
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import order as ranks

#: Spellings of the predicates (fixed values of the language).
SPELLINGS = {
    "equals": "eq", "==": "eq",
    "not_equals": "ne", "!=": "ne",
    "greater_than": "gt", ">": "gt",
    "greater_than_or_equal_to": "ge", ">=": "ge",
    "less_than": "lt", "<": "lt",
    "less_than_or_equal_to": "le", "<=": "le",
    "contains": "contains", "not_contains": "not_contains",
    "is_in_list": "in", "in": "in",
    "is_not_in_list": "not_in", "not in": "not_in",
    "between": "between",
    "is_null": "null", "isnull": "null",
    "is_not_null": "not_null", "notnull": "not_null",
}


class QueryError(ValueError):
    """A query that can't be run: a missing key, an unknown column or a bad value."""


def _text(c: Column) -> Column:
    """Text as the language sees it: a null reads 'None'."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def _kind(kind: T.DataType) -> str:
    """Values of one kind can be compared with each other."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return "number"
    return "text" if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)) else "time" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "other"


def _comparable(kind: str, value) -> bool:
    """Whether a value is of a column's kind; a text that is a date is of the kind of times."""
    if isinstance(value, (bool, int, float, decimal.Decimal)):
        return kind == "number"
    if isinstance(value, str):
        return kind == "text" or kind == "time" and _date_value(value) is not None
    return kind in ("time", "other") if isinstance(value, datetime.date) else kind == "other"


def _predicate(c: Column, op: str, value, kind: T.DataType) -> Column:
    """Nulls pass 'ne' and 'not_in', and fail the other comparisons.

    A value of another kind than the column's equals nothing and differs from everything; it
    has no order with the column, so that such a filter can't be used.
    """
    many = list(value) if isinstance(value, (list, tuple)) else None
    if op in ("in", "not_in", "between") and many is None:
        raise QueryError("the value must be a list")
    if op == "between" and len(many) != 2:
        raise QueryError("between takes two bounds")
    own = _kind(kind)
    if isinstance(kind, T.BooleanType) and op not in ("contains", "not_contains", "null", "not_null"):
        c = c.cast("int")  # truth values are the numbers 0 and 1
    if op in ("in", "not_in"):
        many = [int(v) if isinstance(v, bool) else v for v in many if v is None or _comparable(own, v)]
        # a null in the list stands for nulls, as it does where a list holds one
        nothing, many = None in many, [v for v in many if v is not None]
        member = F.coalesce(c.isin(many), F.lit(False)) if many else F.lit(False)
        member = member | c.isNull() if nothing else member
        return member if op == "in" else ~member
    if op in ("eq", "ne") and not _comparable(own, value):
        return F.lit(op == "ne")
    if op in ("gt", "ge", "lt", "le", "between") and not all(_comparable(own, v) for v in (many if op == "between" else [value])):
        raise QueryError(f"{value!r} has no order with values of type {kind.simpleString()}")
    value, many = int(value) if isinstance(value, bool) else value, [int(v) if isinstance(v, bool) else v for v in many or []]
    makers = {
        "eq": lambda: c == F.lit(value),
        "ne": lambda: ~c.eqNullSafe(F.lit(value)),
        "gt": lambda: c > F.lit(value),
        "ge": lambda: c >= F.lit(value),
        "lt": lambda: c < F.lit(value),
        "le": lambda: c <= F.lit(value),
        "contains": lambda: _text(c).rlike(f"(?i){value}"),
        "not_contains": lambda: ~_text(c).rlike(f"(?i){value}"),
        "between": lambda: c.between(F.lit(min(many)), F.lit(max(many))),
        "null": c.isNull,
        "not_null": c.isNotNull,
    }
    return makers[op]()


def _date_value(value):
    """The bound as a timestamp column, or None where it isn't a date."""
    import pandas as pd

    if isinstance(value, (datetime.date, datetime.datetime)):
        return pd.Timestamp(value).to_pydatetime()
    got = pd.to_datetime(value, errors="coerce")
    return None if pd.isna(got) else got.tz_localize(None).to_pydatetime()


def filter_column(df: DataFrame, spec: dict) -> Column:
    """The condition of one filter; a QueryError says why it can't be used."""
    name, spelled = spec.get("column"), spec.get("operator")
    op = SPELLINGS.get(spelled)
    if not name or name not in df.columns:
        raise QueryError(f"no column {name!r}; there are {df.columns}")
    if op is None:
        raise QueryError(f"no operator {spelled!r}")
    value = spec.get("value")
    if op not in ("null", "not_null") and value is None:
        raise QueryError(f"operator {spelled!r} needs a value")
    c = F.col(f"`{name}`")
    if spec.get("is_date") and op not in ("null", "not_null"):
        if "contains" in op:
            raise QueryError("dates have no 'contains'")
        if isinstance(df.schema[name].dataType, T.NumericType):
            raise QueryError(f"{name!r} has numbers, which are no dates")
        if dict(df.dtypes)[name] != "timestamp_ntz":  # such a column is left bare, so that the filter reaches the scan
            c = F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz")
        got = [_date_value(v) for v in value] if isinstance(value, (list, tuple)) else _date_value(value)
        if got is None or isinstance(got, list) and (None in got or not got):
            raise QueryError(f"{value!r} is no date")
        if isinstance(got, list) and op == "between":
            return c.between(_ntz(min(got)), _ntz(max(got)))
        if isinstance(got, list):
            member = reduce(lambda a, b: a | b, [c == _ntz(v) for v in got])
            return member if op == "in" else F.coalesce(~member, F.lit(True))
        return _predicate_ntz(c, op, _ntz(got))
    if "contains" in op:
        try:
            re.compile(str(value))
        except re.error as bad:
            raise QueryError(f"{value!r} is no pattern") from bad
    return _predicate(c, op, value, df.schema[name].dataType)


def _ntz(moment) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def _predicate_ntz(c: Column, op: str, bound: Column) -> Column:
    makers = {"eq": c == bound, "ne": ~c.eqNullSafe(bound), "gt": c > bound, "ge": c >= bound, "lt": c < bound, "le": c <= bound}
    if op not in makers:
        raise QueryError("the value must be a list")
    return makers[op]


def apply_filters(df: DataFrame, filters: list[dict] | None) -> tuple[DataFrame, list[str]]:
    """The rows that pass all usable filters, and a message for each filter left out."""
    skipped, columns = [], []
    for spec in filters or []:
        try:
            columns.append(filter_column(df, spec))
        except QueryError as why:
            skipped.append(str(why))
    return (df.where(reduce(lambda a, b: a & b, columns)) if columns else df), skipped


def _skew(c: Column) -> Column:
    """A sample's skewness; null below three values, 0 where all are equal."""
    n = F.count(c).cast("double")
    own = F.when(F.max(c) == F.min(c), F.lit(0.0)).otherwise(F.skewness(c))
    return F.when(n >= 3, own * F.sqrt(n * (n - 1)) / (n - 2))


def _kurt(c: Column) -> Column:
    """A sample's excess kurtosis; null below four values, 0 where all are equal."""
    n = F.count(c).cast("double")
    own = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n >= 4, F.when(F.max(c) == F.min(c), F.lit(0.0)).otherwise(own))


#: Aggregates by name, for numbers; the sum of nothing is 0, and deviations are those of a sample.
AGGREGATES = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "nunique": F.count_distinct,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "median": F.median,
    "first": lambda c: F.first(c, ignorenulls=True),
    "last": lambda c: F.last(c, ignorenulls=True),
    "prod": F.product,
    "size": lambda c: F.count(F.lit(1)),
    "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)),
    "skew": _skew,
    "kurt": _kurt,
    "kurtosis": _kurt,
    "quantile": F.median,
    "product": F.product,
    "any": lambda c: F.coalesce(F.max(c.cast("boolean")), F.lit(False)),
    "all": lambda c: F.coalesce(F.min(c.cast("boolean")), F.lit(True)),
}


def _listed(value) -> list:
    return [value] if isinstance(value, str) else list(value or [])


def _known(df: DataFrame, names: list[str]) -> None:
    for name in names:
        if name not in df.columns:
            raise QueryError(f"no column {name!r}; there are {df.columns}")


def unique_values(df: DataFrame, column: str, drop_na: bool = False, order: str | None = None) -> DataFrame:
    """Distinct values of a column, with a null among them unless ``drop_na``.

    Rows of a table have no order of their own; where a column ``order`` numbers them, the
    values come as they are first seen.
    """
    _known(df, [column, *([order] if order else [])])
    c = F.col(f"`{column}`")
    if order:
        seen = df.groupBy(c).agg(F.min(f"`{order}`").alias("_seen")).orderBy("_seen").drop("_seen")
        return seen.dropna() if drop_na else seen
    out = df.select(c).distinct()
    return out.dropna() if drop_na else out


def _aggregate(df: DataFrame, column: str, function: str, order: str | None) -> Column:
    """An aggregate by name; texts are true unless they are empty, and ``order`` tells which row comes first."""
    c = F.col(f"`{column}`")
    if function in ("any", "all") and _kind(df.schema[column].dataType) == "text":
        c = F.length(c) > 0
    if function in ("first", "last") and order:
        _known(df, [order])
        at = F.when(c.isNotNull(), F.col(f"`{order}`"))
        return F.min_by(c, at) if function == "first" else F.max_by(c, at)
    return AGGREGATES[function](c)


def group_aggregate(df: DataFrame, keys: list[str] | str, column: str, function: str, name: str | None = None, order: str | None = None) -> DataFrame:
    """One aggregate for each group, ordered by the keys; rows with a null key are left out.

    Rows of a table have no order of their own; ``first`` and ``last`` go by a column ``order`` where there is one.
    """
    keys = _listed(keys)
    _known(df, [*keys, column])
    if function not in AGGREGATES:
        raise QueryError(f"no aggregate {function!r}; there are {sorted(AGGREGATES)}")
    if function in ("median", "quantile"):  # without a group's values in one task
        kept = df.dropna(subset=keys) if keys else df
        out = ranks.quantiles(kept, column, [0.5], keys, [name or (column if keys else function)])
        return out.orderBy(*keys) if keys else out
    value = _aggregate(df, column, function, order)
    if not keys:
        return df.agg(value.alias(name or function))
    return df.dropna(subset=keys).groupBy(*keys).agg(value.alias(name or column)).orderBy(*keys)


def top_rows(df: DataFrame, columns: list[str] | str, by: str, order: str = "descending", n: int = 1, ties: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows by a column, nulls last in both orders; ``ties`` decides between equals."""
    columns, order = _listed(columns), order.lower()
    _known(df, [*columns, by])
    if order not in ("ascending", "descending"):
        raise QueryError(f"no order {order!r}")
    if isinstance(n, bool) or not isinstance(n, int) or n <= 0:
        raise QueryError("n must be a positive integer")
    c = F.col(f"`{by}`")
    first = c.asc_nulls_last() if order == "ascending" else c.desc_nulls_last()
    return df.orderBy(first, *(ties or [])).limit(n).select(*columns)


#: Literals, quoted names and comments of a statement, which stay as they are; and what is read otherwise.
_APART = re.compile(r"""(?P<apart>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/)|\bgroup_concat\s*\(""", re.I | re.S)


def sql_query(df: DataFrame, text: str) -> DataFrame:
    """A Spark SQL statement over the table ``df``; group_concat is read as string_agg.

    The table is a named subquery of this statement alone, so that no view of the user's is
    replaced and statements in several threads don't meet.
    """
    if not text:
        raise QueryError("there is no statement")
    text = _APART.sub(lambda m: m["apart"] or "string_agg(", text.strip().rstrip(";"))
    view = f"df_{uuid.uuid4().hex}"
    own = f"df AS (SELECT * FROM {view})"
    if started := re.match(r"with(\s+recursive)?\s", text, flags=re.I):
        text = f"{started[0]}{own}, {text[started.end() :]}"
    else:
        text = f"WITH {own} {text}"
    df.createTempView(view)
    try:
        return df.sparkSession.sql(text)
    finally:  # the plan holds the table by now
        df.sparkSession.catalog.dropTempView(view)


def compile_query(df: DataFrame, query: dict) -> DataFrame:
    """The plan of a structured query object over ``df``."""
    return _compiled(df, query)[0]


def _compiled(df: DataFrame, query: dict) -> tuple[DataFrame, list[str]]:
    """The plan, and a message for each filter that was left out."""
    kept, skipped = apply_filters(df, query.get("filters"))
    kind, options = query.get("operation_type"), query.get("options") or {}
    if kind == "get_unique_values":
        return unique_values(kept, query.get("column_name"), options.get("drop_na", False), query.get("order_column")), skipped
    if kind == "group_by_aggregate":
        keys, column, function = (query.get(k) for k in ("group_by_columns", "aggregation_column", "aggregation_function"))
        if keys is None or column is None or function is None:
            raise QueryError("group_by_aggregate needs group_by_columns, aggregation_column and aggregation_function")
        return group_aggregate(kept, keys, column, function, options.get("output_column_name"), query.get("order_column")), skipped
    if kind == "find_top_n_rows":
        if not query.get("select_columns") or not query.get("condition_column"):
            raise QueryError("find_top_n_rows needs select_columns and condition_column")
        return top_rows(kept, query["select_columns"], query["condition_column"], query.get("sort_order", "descending"), query.get("n_rows", 1), query.get("tie_columns")), skipped
    if kind == "direct_sql_query":
        return sql_query(kept, query.get("sql_query")), skipped
    raise QueryError(f"no operation {kind!r}")


def shaped_result(df: DataFrame):
    """A whole result as plain values on the driver: a scalar, a record, a list or records; a message if empty."""
    rows = [r.asDict() for r in df.collect()]
    if not rows:
        return "the query gave no rows"
    if len(df.columns) == 1:
        values = [next(iter(r.values())) for r in rows]
        return values[0] if len(values) == 1 else values
    return rows[0] if len(rows) == 1 else rows


def respond(df: DataFrame, query: dict) -> dict:
    """success, result, error, error_details and skipped filters of a query; every failure is an answer, not an exception."""
    try:
        plan, skipped = _compiled(df, query)
        return {"success": True, "result": shaped_result(plan), "error": None, "error_details": None, "skipped_filters": skipped}
    except QueryError as why:
        return {"success": False, "result": None, "error": str(why), "error_details": type(why).__name__, "skipped_filters": []}
    except Exception as why:  # the engine's own errors are part of the answer, too
        return {"success": False, "result": None, "error": "the query failed", "error_details": str(why)[:500], "skipped_filters": []}


def respond_sheet(spark: SparkSession, path: str, query: dict) -> dict:
    """``respond`` over a sheet of an Excel file: the query's ``sheet_name`` (a name, or a number from 0), else the default one."""
    from ..sources import files

    try:
        return respond(files.read_excel(spark, path, query.get("sheet_name") or files.DEFAULT_SHEET), query)
    except (FileNotFoundError, ValueError) as why:
        return {"success": False, "result": None, "error": str(why), "error_details": type(why).__name__, "skipped_filters": []}
