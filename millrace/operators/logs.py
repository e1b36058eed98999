"""Interaction logs and evaluations: cleaning, statistics and samples for fine-tuning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from . import order


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; rows without a key are left out."""
    others = [c for c in rows.columns if c != key]
    latest = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_row"))
    return latest.select(key, "_row.*")


def alias_value(json: Column, names: list[str]) -> Column:
    """The value of the first name that a JSON object has, even if it is null there."""
    keys = F.json_object_keys(json)
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.array_contains(keys, name), F.get_json_object(json, f"$.{name}")).otherwise(out)
    return out


def batch_counters(rows: DataFrame, task: Column, wanted: str, question: Column, answer: Column) -> DataFrame:
    """Rows read, of another task, without a field, with a blank question, and left to evaluate."""
    other = ~task.eqNullSafe(F.lit(wanted))
    missing = ~other & (question.isNull() | answer.isNull())
    blank = ~other & ~missing & (F.length(F.trim(question)) == 0)
    return rows.agg(
        F.count(F.lit(1)).alias("total_read"), F.count_if(other).alias("skipped_type"), F.count_if(missing).alias("skipped_missing"),
        F.count_if(blank).alias("skipped_empty"), F.count_if(~other & ~missing & ~blank).alias("evaluated"),
    )


_S, _B = T.StringType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: What a judge says of a generated query.
QUERY_EVALUATION = _struct(
    evaluation_summary=_struct(overall_quality_score_cypher=_S, main_strength_cypher=_S, main_weakness_cypher=_S),
    dimensions=_struct(
        syntactic_correctness=_struct(score=_S, reasoning=_S),
        schema_adherence=_struct(
            overall_score=_S, reasoning=_S, node_label_correctness=_struct(check_result=_B), entity_type_property_correctness=_struct(check_result=_B),
            relationship_type_correctness=_struct(check_result=_B), property_name_correctness=_struct(check_result=_B),
            hallucinated_schema_elements=_struct(check_result_hallucination_present=_B, elements_found=T.ArrayType(_S)),
        ),
        intent_accuracy=_struct(score=_S, explanation_of_cypher_retrieval=_S, semantic_alignment_with_question=_S, key_element_coverage_notes=_S, reasoning=_S),
    ),
    qwen_error_patterns_identified=T.ArrayType(_S),
    suggestion_for_improvement_cypher=_S,
)

#: What a judge says of an answer; the segments are a list or a text.
ANSWER_EVALUATION = _struct(
    evaluation_summary=_struct(overall_answer_quality_score=_S, main_strengths_answer=_S, main_weaknesses_answer=_S),
    dimensions=_struct(
        faithfulness=_struct(score=_S, reasoning=_S, problematic_answer_segments_faithfulness=_S),
        relevance=_struct(score=_S, reasoning=_S),
        completeness=_struct(context_sufficiency_assessment=_S, context_sufficiency_reasoning=_S, score=_S, reasoning=_S),
        coherence_fluency=_struct(score=_S, reasoning=_S),
        actionability_usability=_struct(score=_S, reasoning=_S),
    ),
    suggestion_for_answer_improvement=_S,
)


def flat_query_evaluation(rows: DataFrame, json: str = "evaluation") -> DataFrame:
    """One row of plain columns for each evaluation of a query; rows without an object are left out."""
    e = F.from_json(json, QUERY_EVALUATION)
    rows = rows.withColumn("_e", e).where("_e is not null")
    c = lambda path: F.col(f"_e.{path}")
    schema, intent = "dimensions.schema_adherence", "dimensions.intent_accuracy"
    joined = lambda x: F.coalesce(F.array_join(x, ", "), F.lit(""))
    made = {
        "overall_quality_score": c("evaluation_summary.overall_quality_score_cypher"), "main_strength": c("evaluation_summary.main_strength_cypher"),
        "main_weakness": c("evaluation_summary.main_weakness_cypher"), "syntax_score": c("dimensions.syntactic_correctness.score"),
        "syntax_reasoning": c("dimensions.syntactic_correctness.reasoning"), "schema_overall_score": c(f"{schema}.overall_score"),
        "schema_node_label_correct": c(f"{schema}.node_label_correctness.check_result"), "schema_entity_type_correct": c(f"{schema}.entity_type_property_correctness.check_result"),
        "schema_rel_type_correct": c(f"{schema}.relationship_type_correctness.check_result"), "schema_prop_name_correct": c(f"{schema}.property_name_correctness.check_result"),
        "schema_hallucinated_present": c(f"{schema}.hallucinated_schema_elements.check_result_hallucination_present"),
        "schema_hallucinated_elements": joined(c(f"{schema}.hallucinated_schema_elements.elements_found")), "schema_reasoning": c(f"{schema}.reasoning"),
        "intent_score": c(f"{intent}.score"), "intent_explanation": c(f"{intent}.explanation_of_cypher_retrieval"), "intent_alignment_notes": c(f"{intent}.semantic_alignment_with_question"),
        "intent_key_elements_notes": c(f"{intent}.key_element_coverage_notes"), "intent_reasoning": c(f"{intent}.reasoning"),
        "error_patterns": joined(c("qwen_error_patterns_identified")), "suggestion": c("suggestion_for_improvement_cypher"),
    }
    return rows.select(*(x for x in rows.columns if x not in (json, "_e")), *(v.alias(k) for k, v in made.items()))


def flat_answer_evaluation(rows: DataFrame, json: str = "evaluation") -> DataFrame:
    """One row of plain columns for each evaluation of an answer; rows without an object are left out."""
    rows = rows.withColumn("_e", F.from_json(json, ANSWER_EVALUATION)).where("_e is not null")
    c = lambda path: F.col(f"_e.{path}")
    segments = c("dimensions.faithfulness.problematic_answer_segments_faithfulness")
    listed = F.array_join(F.from_json(segments, T.ArrayType(_S)), "; ")
    made = {
        "overall_score": c("evaluation_summary.overall_answer_quality_score"), "main_strengths": c("evaluation_summary.main_strengths_answer"),
        "main_weaknesses": c("evaluation_summary.main_weaknesses_answer"),
        "problem_segments": F.coalesce(F.when(segments.startswith("["), listed).otherwise(segments), F.lit("")),
        "context_sufficiency": c("dimensions.completeness.context_sufficiency_assessment"), "context_reasoning": c("dimensions.completeness.context_sufficiency_reasoning"),
        "suggestion": c("suggestion_for_answer_improvement"),
    }
    for name, part in (("faithfulness", "faithfulness"), ("relevance", "relevance"), ("completeness", "completeness"), ("coherence", "coherence_fluency"), ("actionability", "actionability_usability")):
        made |= {f"{name}_score": c(f"dimensions.{part}.score"), f"{name}_reasoning": c(f"dimensions.{part}.reasoning")}
    return rows.select(*(x for x in rows.columns if x not in (json, "_e")), *(v.alias(k) for k, v in made.items()))


def describe(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles (exact, by linear interpolation) and max of a column's numbers."""
    c, named = F.col(f"`{column}`"), {b: f"by{i}_quartiles" for i, b in enumerate(by)}
    out = df.groupBy(*by).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    quartiles = order.quantiles(df, column, [0.25, 0.5, 0.75], list(by), ["p25", "p50", "p75"]).withColumnsRenamed(named)
    same = reduce(lambda x, y: x & y, [out[b].eqNullSafe(quartiles[n]) for b, n in named.items()], F.lit(True))
    return out.join(quartiles, same, "left").select(*by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value, nulls among them, by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column)


def issue_counts(df: DataFrame, wrong: list[str], bad: list[str]) -> DataFrame:
    """Rows in which a check that should be true is false, or a flag that should be false is true."""
    return df.agg(*(F.count_if(F.col(c) == F.lit(False)).alias(c) for c in wrong), *(F.count_if(F.col(c) == F.lit(True)).alias(c) for c in bad))


def top_tokens(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent comma-separated entries; ties go to the lesser one."""
    entries = df.select(F.explode(F.split(column, ",")).alias("token")).select(F.trim("token").alias("token")).where("length(token) > 0")
    return entries.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(n)


#: Texts and marks of the rules (fixed values).
CANNOT = "无法生成Cypher查询."
CANNOT_MARK = "无法生成Cypher查询"
NO_ANSWER = "根据目前提供的资料，我无法找到关于您问题的明确信息。"
QUERY_WORDS = ("MATCH ", "RETURN ", "CREATE ", "MERGE ", "WITH ", "OPTIONAL MATCH ")
QUERY_CORE = ("MATCH", "RETURN", "CREATE", "MERGE", "WITH")
NO_QUERY_MARKS = ("cannot be improved", "needs to be extended")
ERROR_WORDS = ("hallucinated", "schema violation", "syntax error")
NOT_AVAILABLE = ("information is not available", "context does not contain", "cannot be answered from the context", "should state that the information is not found")
#: Names of the rules in the samples (fixed values).
SOURCES = {
    "both_cannot": "qwen_and_gemini_cannot_generate",
    "cannot_unclear": "qwen_cannot_generate_gemini_unclear",
    "judged_cannot": "gemini_explicitly_cannot_generate_or_qwen_low_quality",
    "query_suggestion": "gemini_suggestion_for_review",
    "high_score": "qwen_high_score_by_gemini",
    "high_score_suggestion": "qwen_high_score_by_gemini_with_minor_gemini_suggestion",
    "no_answer_confirmed": "qwen_standard_no_answer_confirmed_by_gemini_context_insufficient",
    "no_answer_suggested": "gemini_suggests_no_answer_due_to_insufficient_context",
    "low_score_suggestion": "qwen_low_score_with_gemini_suggestion_for_review",
    "no_answer_disputed": "qwen_no_answer_but_gemini_disagrees_or_context_sufficient_for_review",
}
NOTHING_TO_IMPROVE = "No improvement needed."


def whole_score(c: Column) -> Column:
    """A score as an int, 0 if it isn't one."""
    return F.coalesce(c.try_cast("int"), F.lit(0))


def query_samples(rows: DataFrame) -> DataFrame:
    """Samples (completion, source_of_ideal, score) from generated queries and their evaluations.

    Columns read: interaction_id, question, prompt, generated, score, suggestion, judged (the
    judge's whole text). Rules apply in order; rows that none decides, or that need a look
    by hand, are left out.
    """
    blank = lambda c: F.length(tx.stripped(F.coalesce(c, F.lit("")))) == 0
    own = F.when(blank(F.col("generated")), F.lit(CANNOT)).otherwise(tx.stripped(F.col("generated")))
    said = tx.stripped(F.coalesce("suggestion", F.lit("")))
    score, judged = whole_score(F.col("score")), F.lower(F.coalesce("judged", F.lit("")))
    cannot, upper = said.contains(CANNOT_MARK), F.upper(said)
    words = F.lit(False)
    for w in QUERY_WORDS:
        words = words | upper.contains(w)
    unlike = cannot
    for m in NO_QUERY_MARKS:
        unlike = unlike | F.lower(said).contains(m)
    fenced = tx.stripped(F.regexp_replace(F.regexp_replace(said, "^```|```$", ""), "^\\s*(?i:cypher)", ""))
    clean = F.when(said.startswith("```") & said.endswith("```"), fenced).when(said.startswith("`") & said.endswith("`"), tx.stripped(F.regexp_replace(said, "^`|`$", ""))).otherwise(said)
    keyword = F.upper(clean).rlike("|".join(QUERY_CORE))
    is_cannot = own == CANNOT
    rule = (
        F.when(is_cannot & (cannot | (score <= 2)), SOURCES["both_cannot"])
        .when(is_cannot & (score >= 4) & upper.contains("MATCH"), F.lit(None))
        .when(is_cannot, SOURCES["cannot_unclear"])
        .when(score >= 4, SOURCES["high_score"])
        .when((F.length(said) > 0) & ~unlike & words, F.when(keyword, SOURCES["query_suggestion"]))
        .when(cannot | ((score <= 2) & judged.rlike("|".join(ERROR_WORDS))), SOURCES["judged_cannot"])
    )
    completion = F.when(rule == SOURCES["high_score"], own).when(rule == SOURCES["query_suggestion"], clean).otherwise(F.lit(CANNOT))
    return rows.where(F.length("question") > 0).select(
        "interaction_id", F.coalesce(F.nullif("prompt", F.lit("")), "question").alias("prompt"), completion.alias("completion"), own.alias("original"),
        score.alias("score"), rule.alias("source_of_ideal"),
    ).where("source_of_ideal is not null")


def answer_samples(rows: DataFrame) -> DataFrame:
    """Samples from answers and their evaluations, by rules in order.

    Columns read: interaction_id, prompt, answer, overall, faithfulness, relevance,
    completeness (texts; if any is no int all count as 0), sufficiency, suggestion.
    """
    scores = ["overall", "faithfulness", "relevance", "completeness"]
    sound = F.lit(True)
    for s in scores:
        sound = sound & F.col(s).try_cast("int").isNotNull()
    overall, faithful, relevant, complete = (F.when(sound, F.col(s).try_cast("int")).otherwise(0) for s in scores)
    answer = F.when(F.length(tx.stripped(F.coalesce("answer", F.lit("")))) == 0, F.lit(NO_ANSWER)).otherwise(tx.stripped(F.col("answer")))
    said = tx.stripped(F.coalesce("suggestion", F.lit("")))
    none, enough = answer == NO_ANSWER, F.coalesce("sufficiency", F.lit("Unknown"))
    more = (F.length(said) > 0) & (said != NOTHING_TO_IMPROVE)
    rule = (
        F.when(none & (enough == "Insufficient") & (overall >= 4), SOURCES["no_answer_confirmed"])
        .when(~none & (enough == "Insufficient") & (complete <= 2) & F.lower(said).rlike("|".join(NOT_AVAILABLE)), SOURCES["no_answer_suggested"])
        .when(~none & (overall >= 4) & (faithful >= 4) & (relevant >= 4), F.when(more, SOURCES["high_score_suggestion"]).otherwise(SOURCES["high_score"]))
        .when((overall < 4) & more & (F.length(said) > 10), SOURCES["low_score_suggestion"])
        .when(none & ((enough == "Sufficient") | ((enough == "Partially Sufficient") & (complete >= 3))) & (overall < 4), SOURCES["no_answer_disputed"])
    )
    completion = F.when(rule == SOURCES["no_answer_suggested"], F.lit(NO_ANSWER)).otherwise(answer)
    return rows.select("interaction_id", "prompt", completion.alias("completion"), answer.alias("original"), overall.alias("score"), rule.alias("source_of_ideal")).where("source_of_ideal is not null")


def context_documents(top: Column, debug: Column) -> Column:
    """The context of an answer's log: the record's own field, or, where that is null or empty, its debug information's."""
    return F.when(F.size(top) > 0, top).otherwise(debug)


def with_evaluations(logs: DataFrame, evaluations: DataFrame, key: str = "interaction_id", ref: str = "original_interaction_id_ref") -> DataFrame:
    """Logs joined with their evaluations; logs without one are left out."""
    return logs.join(evaluations.withColumnRenamed(ref, key), key)


def analysis_name(c: Column) -> Column:
    """eval_results_X.jsonl as analysis_X.csv."""
    return F.regexp_replace(F.regexp_replace(c, "eval_results_", "analysis_"), "\\.jsonl$", ".csv")


def day_stamp(c: Column) -> Column:
    """A time as the eight digits that daily files are named by."""
    return F.date_format(c, "yyyyMMdd")


def iso_stamp(c: Column) -> Column:
    """A time as ISO text in UTC, to the microsecond."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def digits_of(c: Column) -> Column:
    """The digits of a file's name, which tell its day."""
    return F.regexp_replace(c, "\\D", "")


def expanded_queries(original: DataFrame, more: DataFrame, key: str = "query_id") -> DataFrame:
    """A query and its expansions, each text once, the original first: rows (key, place, text)."""
    rows = original.select(key, F.lit(-1).alias("place"), "text").unionByName(more.select(key, "place", tx.stripped(F.col("text")).alias("text")))
    return rows.where("length(text) > 0").groupBy(key, "text").agg(F.min("place").alias("place"))
