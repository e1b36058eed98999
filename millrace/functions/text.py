"""Text functions, as Column expressions wherever Spark can express them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that end a sentence (fixed values).
TERMINATORS = "。？！.!?"
_BLANK = "(?U)^\\s+|\\s+$"


def stripped(c: Column) -> Column:
    """The text without white space, of any alphabet, at its ends."""
    return F.regexp_replace(c, _BLANK, "")


@F.pandas_udf(T.StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def normalized_text(c: Column) -> Column:
    """NFKD, lower case, stripped, white space runs as one space; plain ASCII skips Python."""
    text = c.cast("string")
    plain = ~text.rlike("[^\\x00-\\x7F]")
    # the UDF sees nulls for plain texts, so that no other text is sent to Python
    folded = F.when(plain, text).otherwise(_nfkd(F.when(plain, F.lit(None)).otherwise(text)))
    return F.regexp_replace(stripped(F.lower(folded)), "(?U)\\s+", " ")


def sentences(c: Column) -> Column:
    """Sentences with their terminators, stripped, blanks dropped; runs of terminators give one each."""
    parts = F.regexp_extract_all(c, F.lit(f"([^{TERMINATORS}]*[{TERMINATORS}]|[^{TERMINATORS}]+)"), F.lit(1))
    return F.filter(F.transform(parts, stripped), lambda s: F.length(s) > 0)


def code_blocks(c: Column) -> Column:
    """Blocks between blank lines, stripped; the whole text if there is but one."""
    parts = F.filter(F.transform(F.split(c, "\\n\\s*\\n"), stripped), lambda s: F.length(s) > 0)
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(c))


def without_fence(c: Column) -> Column:
    """The text without a leading (json) code fence and a trailing one."""
    return F.regexp_replace(F.regexp_replace(stripped(c), "^```(?:json)?\\s*", ""), "\\s*```$", "")


def salvaged_json(c: Column) -> Column:
    """From the first { to the last }, or null."""
    return F.nullif(F.regexp_extract(c, "(?s)\\{.*\\}", 0), F.lit(""))


def without_thoughts(c: Column) -> Column:
    """The text without think blocks, an open one at the end, and stray tags."""
    closed = F.regexp_replace(c, "(?is)<think[^>]*>.*?</think>\\s*", "")
    return stripped(F.regexp_replace(F.regexp_replace(closed, "(?is)<think[^>]*>.*$", ""), "(?i)</?think[^>]*>", ""))


def preview(c: Column, n: int) -> Column:
    """The first n characters, followed by ... if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, "[^/\\\\]+$", 0)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(c), "\\.[^.]+$", 0))


#: Beginnings of lines that are thoughts and no questions (fixed values).
FILLERS = ("好的，", "首先，", "因此，", "所以，", "根据这个原因，")
#: Parts of lines that are thoughts and no questions (fixed values).
FILLER_PARTS = ("我需要生成一个", "可能的澄清问题是", "澄清问题应该是", "接下来，")
#: Beginnings that make a line a question without its mark (fixed values).
OPENERS = ("请问您", "您对", "您具体指的是")
#: A whole text below this length that ends as a question is one (fixed value).
SHORT_QUESTION = 70
DEFAULT_QUESTION = "抱歉，我不太理解您的意思，请您再具体说明一下。"


def _starts(c: Column, heads: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | c.startswith(h)
    return out


def _has(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def last_question(c: Column) -> Column:
    """The last line that is a question and no thought, else the last such sentence, else a short whole question, else a default."""
    asks = lambda s: s.endswith("？") | s.endswith("?")
    lines = F.transform(F.split(stripped(F.coalesce(c, F.lit(""))), "\\r?\\n"), stripped)
    good = F.filter(lines, lambda s: (asks(s) & ~_starts(s, FILLERS) & ~_has(s, FILLER_PARTS)) | (~asks(s) & _starts(s, OPENERS)))
    parts = F.transform(F.regexp_extract_all(c, F.lit("([^。？！?]*[。？！?]|[^。？！?]+)"), F.lit(1)), stripped)
    openers = ("请问您", "您是想", "您具体指的是", "关于您提到的")
    more = F.filter(parts, lambda s: (asks(s) | _starts(s, openers)) & ~_starts(s, FILLERS[:2]) & ~_has(s, FILLER_PARTS[:2]))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    whole = stripped(c)
    short = F.when((F.length(whole) < SHORT_QUESTION) & asks(whole), whole)
    return F.coalesce(last(good), last(more), short, F.lit(DEFAULT_QUESTION))


def chat_turns(c: Column) -> Column:
    """(role, content) pairs of a text with <|im_start|>role ... <|im_end|> markers."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), "<\\|im_start\\|>"), lambda p: F.length(stripped(p)) > 0)
    return F.transform(
        parts,
        lambda p: F.struct(
            stripped(F.regexp_extract(p, "^([^\\n]*)", 1)).alias("role"),
            stripped(F.regexp_replace(F.regexp_replace(p, "^[^\\n]*\\n?", ""), "<\\|im_end\\|>", "")).alias("content"),
        ),
    )


#: Beginnings of suggestions that are cut off, and the suggestion where there is none (fixed values).
LEAD_INS = ("好的，", "当然，", "这里有一些建议：")
DEFAULT_SUGGESTION = "您可以尝试换个问法，或检查相关文档是否已在知识库中。"


def without_lead_in(c: Column) -> Column:
    """The text without one such beginning; a default where there is no text."""
    cut = F.regexp_replace(stripped(c), f"^({'|'.join(LEAD_INS)})\\s*", "")
    return F.when(F.length(c) > 0, cut).otherwise(F.lit(DEFAULT_SUGGESTION))


def first_truthy(*columns: Column, default: str = "") -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(default))


def finite(c: Column) -> Column:
    """The number, or null for NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def number(c: Column) -> Column:
    """The text as a double, or null."""
    return c.try_cast("double")


def amount_and_unit(c: Column) -> Column:
    """(amount, unit) of texts such as 46.5万元; both null if there is no number."""
    unit = F.when(c.contains("万元"), F.lit("万元"))
    amount = F.trim(F.replace(c, F.lit("万元"), F.lit(""))).try_cast("double")
    return F.struct(amount.alias("amount"), F.when(amount.isNotNull(), unit).alias("unit"))
