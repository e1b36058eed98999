"""Interaction logs, evaluations, tasks, scalars and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions import text as tx
from ..operators import logs, tasks
from ..scratch import scratch_folder
from ..session import table
from ..sources import files, keyed
from ..streaming import ingest
from . import Catalogue

catalogue = Catalogue()


@catalogue.add("log_last_wins", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def log_last_wins(spark, sf_dir):
    return logs.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


_ALIASED = "CASE event_id % 4 WHEN 0 THEN '{\"question\":\"' || event_type || '\"}' WHEN 1 THEN '{\"user_question\":null,\"question\":\"later\"}' WHEN 2 THEN '{\"query\":\"' || user_id || '\"}' ELSE '{}' END"


@catalogue.add("log_alias_coalesce", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 2 THEN CAST(user_id AS VARCHAR) END AS question FROM events")
def log_alias_coalesce(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_ALIASED).alias("line"))
    return rows.select("event_id", logs.alias_value(F.col("line"), ["user_question", "question", "query"]).alias("question"))


@catalogue.add("batch_counters", "SELECT count(*) AS total_read, count(*) FILTER (event_type <> 'click') AS skipped_type, count(*) FILTER (event_type = 'click' AND user_id % 5 = 0) AS skipped_missing, count(*) FILTER (event_type = 'click' AND user_id % 5 = 1) AS skipped_empty, count(*) FILTER (event_type = 'click' AND user_id % 5 > 1) AS evaluated FROM events")
def batch_counters(spark, sf_dir):
    rows, k = table(spark, sf_dir, "events"), F.col("user_id") % 5
    question = F.when(k == 1, F.lit("  ")).when(k > 0, F.col("props"))
    return logs.batch_counters(rows, F.col("event_type"), "click", question, F.col("props"))


# Evaluations as JSON: scores from ids, a list of patterns, checks that are false now and then.
_QUERY_JSON = """'{"evaluation_summary":{"overall_quality_score_cypher":' || (doc_id % 6) || ',"main_strength_cypher":"s' || quality || '"},"dimensions":{"syntactic_correctness":{"score":"' || (doc_id % 5) || '"},"schema_adherence":{"overall_score":3,"node_label_correctness":{"check_result":' || CASE WHEN doc_id % 3 = 0 THEN 'false' ELSE 'true' END || '},"hallucinated_schema_elements":{"check_result_hallucination_present":' || CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END || ',"elements_found":["a","b' || quality || '"]}},"intent_accuracy":{"score":' || (doc_id % 4) || '}},"qwen_error_patterns_identified":["p' || (doc_id % 7) || '"," p' || (doc_id % 2) || ' "],"suggestion_for_improvement_cypher":"try"}'"""


def _query_evaluations(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.expr(_QUERY_JSON).alias("evaluation"))
    return logs.flat_query_evaluation(rows)


@catalogue.add("eval_flatten_query", "SELECT doc_id, CAST(doc_id % 6 AS VARCHAR) AS overall_quality_score, 's' || quality AS main_strength, CAST(doc_id % 5 AS VARCHAR) AS syntax_score, doc_id % 3 <> 0 AS schema_node_label_correct, toxic = 1 AS schema_hallucinated_present, 'a, b' || quality AS schema_hallucinated_elements, CAST(doc_id % 4 AS VARCHAR) AS intent_score, 'p' || (doc_id % 7) || ',  p' || (doc_id % 2) || ' ' AS error_patterns, 'try' AS suggestion FROM labels")
def eval_flatten_query(spark, sf_dir):
    names = ["doc_id", "overall_quality_score", "main_strength", "syntax_score", "schema_node_label_correct", "schema_hallucinated_present", "schema_hallucinated_elements", "intent_score", "error_patterns", "suggestion"]
    return _query_evaluations(spark, sf_dir).select(*names)


_ANSWER_JSON = """'{"evaluation_summary":{"overall_answer_quality_score":' || (doc_id % 6) || '},"dimensions":{"faithfulness":{"score":' || (doc_id % 5) || ',"problematic_answer_segments_faithfulness":' || CASE WHEN doc_id % 2 = 0 THEN '["x","y"]' ELSE '"whole"' END || '},"relevance":{"score":4},"completeness":{"score":"n/a","context_sufficiency_assessment":"Sufficient"}}}'"""


@catalogue.add("eval_flatten_answer", "SELECT doc_id, CAST(doc_id % 6 AS VARCHAR) AS overall_score, CAST(doc_id % 5 AS VARCHAR) AS faithfulness_score, CASE WHEN doc_id % 2 = 0 THEN 'x; y' ELSE 'whole' END AS problem_segments, '4' AS relevance_score, 'n/a' AS completeness_score, 'Sufficient' AS context_sufficiency, NULL::VARCHAR AS coherence_score FROM labels")
def eval_flatten_answer(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.expr(_ANSWER_JSON).alias("evaluation"))
    return logs.flat_answer_evaluation(rows).select("doc_id", "overall_score", "faithfulness_score", "problem_segments", "relevance_score", "completeness_score", "context_sufficiency", "coherence_score")


@catalogue.add("coerce_numeric", "SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) || '.5' END AS DOUBLE) AS number FROM events")
def coerce_numeric(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5")))
    return table(spark, sf_dir, "events").select("event_id", tx.number(text).alias("number"))


@catalogue.add("describe_scores", "SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max FROM events GROUP BY event_type")
def describe_scores(spark, sf_dir):
    out = logs.describe(table(spark, sf_dir, "events"), "value", ["event_type"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@catalogue.add("value_counts", "SELECT CASE WHEN event_type <> 'click' THEN event_type END AS event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    kind = F.when(F.col("event_type") != "click", F.col("event_type"))
    return logs.value_counts(table(spark, sf_dir, "events").select(kind.alias("event_type")), "event_type")


@catalogue.add("issue_counts", "SELECT count(*) FILTER (doc_id % 3 = 0) AS schema_node_label_correct, count(*) FILTER (toxic = 1) AS schema_hallucinated_present FROM labels")
def issue_counts(spark, sf_dir):
    return logs.issue_counts(_query_evaluations(spark, sf_dir), ["schema_node_label_correct"], ["schema_hallucinated_present"])


@catalogue.add("top5_patterns", "SELECT token, count(*) AS n FROM (SELECT unnest(['p' || (doc_id % 7), 'p' || (doc_id % 2)]) AS token FROM labels) GROUP BY token ORDER BY n DESC, token LIMIT 5")
def top5_patterns(spark, sf_dir):
    return logs.top_tokens(_query_evaluations(spark, sf_dir), "error_patterns")


_SAID_Q = f"CASE doc_id % 6 WHEN 0 THEN '{logs.CANNOT_MARK}' WHEN 1 THEN '```cypher MATCH (n) RETURN n```' WHEN 2 THEN '`match (n)`' WHEN 3 THEN 'This cannot be improved: MATCH x' WHEN 4 THEN 'no idea' ELSE '' END"
_MADE_Q = f"CASE doc_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN '{logs.CANNOT}' ELSE ' MATCH (d) ' END"
_RULE_Q = f"""CASE
  WHEN own = '{logs.CANNOT}' AND (contains(said, '{logs.CANNOT_MARK}') OR score <= 2) THEN 'qwen_and_gemini_cannot_generate'
  WHEN own = '{logs.CANNOT}' AND score >= 4 AND contains(upper(said), 'MATCH') THEN NULL
  WHEN own = '{logs.CANNOT}' THEN 'qwen_cannot_generate_gemini_unclear'
  WHEN score >= 4 THEN 'qwen_high_score_by_gemini'
  WHEN doc_id % 6 IN (1, 2) THEN 'gemini_suggestion_for_review'
  WHEN contains(said, '{logs.CANNOT_MARK}') OR (score <= 2 AND toxic = 1) THEN 'gemini_explicitly_cannot_generate_or_qwen_low_quality' END"""


@catalogue.add("finetune_query_cascade", f"""WITH l AS (SELECT *, {_SAID_Q} AS said, CASE WHEN doc_id % 4 IN (0, 1) THEN '{logs.CANNOT}' ELSE 'MATCH (d)' END AS own, CASE WHEN doc_id % 7 = 6 THEN 0 ELSE doc_id % 7 END AS score FROM labels), r AS (SELECT *, {_RULE_Q} AS rule FROM l)
SELECT doc_id AS interaction_id, CAST(score AS INTEGER) AS score, rule AS source_of_ideal, CASE rule WHEN 'qwen_high_score_by_gemini' THEN own WHEN 'gemini_suggestion_for_review' THEN CASE doc_id % 6 WHEN 1 THEN 'MATCH (n) RETURN n' ELSE 'match (n)' END ELSE '{logs.CANNOT}' END AS completion FROM r WHERE rule IS NOT NULL""")
def finetune_query_cascade(spark, sf_dir):
    k = F.col("doc_id") % 7
    rows = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("interaction_id"), F.lit("q").alias("question"), F.lit(None).cast("string").alias("prompt"), F.expr(_MADE_Q).alias("generated"),
        F.when(k == 6, F.lit("none")).otherwise(k.cast("string")).alias("score"), F.expr(_SAID_Q).alias("suggestion"),
        F.when(F.col("toxic") == 1, F.lit("A Syntax Error here")).otherwise(F.lit("fine")).alias("judged"),
    )
    return logs.query_samples(rows).select("interaction_id", "score", "source_of_ideal", "completion")


_SAID_A = "CASE doc_id % 4 WHEN 0 THEN 'No improvement needed.' WHEN 1 THEN 'The context does not contain it' WHEN 2 THEN 'short' ELSE 'Please add the missing numbers' END"
_ENOUGH = "CASE doc_id % 3 WHEN 0 THEN 'Insufficient' WHEN 1 THEN 'Sufficient' ELSE 'Partially Sufficient' END"


@catalogue.add("finetune_answer_cascade", f"""WITH l AS (SELECT doc_id, doc_id % 5 = 0 AS none, {_SAID_A} AS said, {_ENOUGH} AS enough, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1 + doc_id % 5 END AS o, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 3 + quality * 2 END AS f, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 4 END AS rel, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE doc_id % 4 END AS c FROM labels),
r AS (SELECT *, CASE
  WHEN none AND enough = 'Insufficient' AND o >= 4 THEN 'qwen_standard_no_answer_confirmed_by_gemini_context_insufficient'
  WHEN NOT none AND enough = 'Insufficient' AND c <= 2 AND doc_id % 4 = 1 THEN 'gemini_suggests_no_answer_due_to_insufficient_context'
  WHEN NOT none AND o >= 4 AND f >= 4 AND rel >= 4 THEN CASE WHEN doc_id % 4 <> 0 THEN 'qwen_high_score_by_gemini_with_minor_gemini_suggestion' ELSE 'qwen_high_score_by_gemini' END
  WHEN o < 4 AND doc_id % 4 IN (1, 3) THEN 'qwen_low_score_with_gemini_suggestion_for_review'
  WHEN none AND (enough = 'Sufficient' OR (enough = 'Partially Sufficient' AND c >= 3)) AND o < 4 THEN 'qwen_no_answer_but_gemini_disagrees_or_context_sufficient_for_review' END AS rule FROM l)
SELECT doc_id AS interaction_id, CAST(o AS INTEGER) AS score, rule AS source_of_ideal, CASE WHEN none OR rule = 'gemini_suggests_no_answer_due_to_insufficient_context' THEN '{logs.NO_ANSWER}' ELSE 'an answer' END AS completion FROM r WHERE rule IS NOT NULL""")
def finetune_answer_cascade(spark, sf_dir):
    d, text = F.col("doc_id"), lambda c: c.cast("string")
    rows = table(spark, sf_dir, "labels").select(
        d.alias("interaction_id"), F.lit("p").alias("prompt"), F.when(d % 5 == 0, F.lit(logs.NO_ANSWER)).otherwise(F.lit(" an answer ")).alias("answer"),
        F.when(d % 11 == 0, F.lit("bad")).otherwise(text(1 + d % 5)).alias("overall"), text(3 + F.col("quality") * 2).alias("faithfulness"), F.lit("4").alias("relevance"),
        text(d % 4).alias("completeness"), F.expr(_ENOUGH).alias("sufficiency"), F.expr(_SAID_A).alias("suggestion"),
    )
    return logs.answer_samples(rows).select("interaction_id", "score", "source_of_ideal", "completion")


@catalogue.add("log_eval_join", "SELECT event_id AS interaction_id, event_type, quality FROM events JOIN labels ON doc_id = event_id")
def log_eval_join(spark, sf_dir):
    e = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("original_interaction_id_ref"), "quality")
    return logs.with_evaluations(table(spark, sf_dir, "events").select(F.col("event_id").alias("interaction_id"), "event_type"), e)


@catalogue.add("latest_file")
def latest_file(spark, sf_dir):
    return files.latest_file(spark, f"{sf_dir}/*.parquet").select(tx.extension(F.col("path")).alias("extension"))


@catalogue.add("question_list", "SELECT conv_id, turn, trim(text) AS value FROM conversations WHERE turn % 3 <> 0 AND length(trim(text)) > 0")
def question_list(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    value = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  # "), "text")).otherwise(F.concat(F.lit(" "), "text"))
    return files.question_list(rows.select("conv_id", "turn", value.alias("value")))


@catalogue.add("json_lines", "SELECT event_id, CAST(user_id AS BIGINT) AS u FROM events WHERE event_id % 3 = 1")
def json_lines(spark, sf_dir):
    k = F.col("event_id") % 3
    line = F.when(k == 0, F.lit(" ")).when(k == 1, F.concat(F.lit('{"u":'), F.col("user_id").cast("string"), F.lit("}"))).otherwise(F.lit('{"u":'))
    from pyspark.sql import types as T

    rows = table(spark, sf_dir, "events").select("event_id", line.alias("value"))
    return files.json_lines(rows, T.StructType([T.StructField("u", T.LongType())]))


@catalogue.add("scrub_nonfinite", "SELECT event_id, CASE WHEN event_id % 4 IN (1, 2) THEN NULL ELSE value END AS value FROM events")
def scrub_nonfinite(spark, sf_dir):
    k = F.col("event_id") % 4
    v = F.when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", tx.finite(v).alias("value"))


@catalogue.add("strip_fence", "SELECT event_id, props AS text FROM events")
def strip_fence(spark, sf_dir):
    fenced = F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("```json\n")).otherwise(F.lit("```\n")), "props", F.lit("\n```  "))
    return table(spark, sf_dir, "events").select("event_id", tx.without_fence(fenced).alias("text"))


@catalogue.add("json_salvage", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN props END AS text FROM events")
def json_salvage(spark, sf_dir):
    said = F.when(F.col("event_id") % 5 == 0, F.lit("nothing")).otherwise(F.concat(F.lit("Sure:\n"), "props", F.lit("\nDone.")))
    return table(spark, sf_dir, "events").select("event_id", tx.salvaged_json(said).alias("text"))


@catalogue.add("strip_think", "SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS text FROM conversations")
def strip_think(spark, sf_dir):
    said = F.concat(F.lit("<THINK a='1'>let me\nsee</think>  "), "text", F.when(F.col("turn") % 2 == 0, F.lit("<think>open")).otherwise(F.lit("</think>")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.without_thoughts(said).alias("text"))


# One beginning is cut off, whatever its kind; a second one, or one within the text, stays; no text gives the default.
@catalogue.add("strip_lead_in", f"SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN '{tx.DEFAULT_SUGGESTION}' WHEN turn % 4 = 3 THEN '当然，' || trim(text, ' ' || chr(10)) ELSE trim(text, ' ' || chr(10)) END AS text FROM conversations")
def strip_lead_in(spark, sf_dir):
    heads = F.array(*map(F.lit, ("好的，", "当然， ", "这里有一些建议：", "好的，当然，")))
    said = F.when(F.col("conv_id") % 7 != 0, F.concat(F.get(heads, (F.col("turn") % 4).cast("int")), tx.stripped(F.col("text"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.without_lead_in(said).alias("text"))


@catalogue.add("last_question", f"SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'q' || conv_id || '?' WHEN 1 THEN 'Well. s' || conv_id || '?' WHEN 2 THEN '好的，s' || conv_id || '?' ELSE '{tx.DEFAULT_QUESTION}' END AS question FROM conversations")
def last_question(spark, sf_dir):
    c, k = F.col("conv_id").cast("string"), F.col("turn") % 4
    said = (
        F.when(k == 0, F.concat(F.lit("好的，what?\nq"), c, F.lit("?\n好的，now?")))
        .when(k == 1, F.concat(F.lit("Well. s"), c, F.lit("? Then on.")))
        .when(k == 2, F.concat(F.lit(" 好的，s"), c, F.lit("?")))  # a thought by its beginning, but short and a question as a whole
        .otherwise(F.concat(F.lit("好的，"), F.repeat(F.lit("long "), 20), F.lit("?")))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.last_question(said).alias("question"))


@catalogue.add("file_stamps", "SELECT event_id, strftime(ts, '%Y%m%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS iso, strftime(ts, '%Y%m%d') || event_id AS digits, 'analysis_' || event_id || '.csv' AS name FROM events")
def file_stamps(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    day, i = logs.day_stamp(F.col("ts")), F.col("event_id").cast("string")
    return rows.select("event_id", day.alias("day"), logs.iso_stamp(F.col("ts")).alias("iso"), logs.digits_of(F.concat(F.lit("log-"), day, F.lit("_"), i, F.lit(".jsonl"))).alias("digits"),
                       logs.analysis_name(F.concat(F.lit("eval_results_"), i, F.lit(".jsonl"))).alias("name"))


@catalogue.add("first_truthy", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role WHEN turn % 3 = 1 THEN text ELSE 'none' END AS said FROM conversations")
def first_truthy(spark, sf_dir):
    k = F.col("turn") % 3
    first, second = F.when(k == 0, F.col("role")).when(k == 1, F.lit("")), F.when(k == 1, F.col("text")).when(k == 2, F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.first_truthy(first, second, default="none").alias("said"))


@catalogue.add("stream_first_seen", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, 1 AS one FROM events) GROUP BY ALL")
def stream_first_seen(spark, sf_dir):
    """Each user's kinds of events, once each as long as the watermark reaches back over all of them."""
    found = ingest.first_seen(_stream(spark, sf_dir).select("ts", "user_id", "event_type"), "ts", ["user_id", "event_type"], "400 days")
    out = _drained(found, "append", spark, scratch_folder(spark, "stream"), found.schema)
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@catalogue.add("chat_parse", "SELECT conv_id, turn, 'system' AS role, 'be brief' AS content FROM conversations UNION ALL SELECT conv_id, turn, role, trim(text, ' ' || chr(10)) FROM conversations")
def chat_parse(spark, sf_dir):
    said = F.concat(F.lit("<|im_start|>system\nbe brief<|im_end|>\n<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.inline(tx.chat_turns(said)))


@catalogue.add("expand_dedupe", "SELECT item_id AS query_id, text, -1 AS place FROM benchmark UNION ALL SELECT item_id, 'about ' || trim(text), 1 FROM benchmark")
def expand_dedupe(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    more = q.select("query_id", F.posexplode(F.array(F.col("text"), F.concat(F.lit(" about "), F.trim("text")), F.concat(F.lit("about "), F.trim("text")), F.lit(" "))).alias("place", "text"))
    return logs.expanded_queries(q, more)


def _tasks(spark, sf_dir):
    """Orders as tasks."""
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("in_progress")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), status.alias("status"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("due_date"), F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 100).cast("int")).alias("reminder_offset_minutes"),
    )
    return rows


_TASKS = """t AS (SELECT o_orderkey AS id, o_orderpriority AS title, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'in_progress' END AS status, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS due_date, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 100 AS INTEGER) END AS off FROM orders),
tasks AS (SELECT *, due_date - to_minutes(off) AS reminder_time FROM t)"""


@catalogue.add("reminder_time", f"WITH {_TASKS} SELECT id, reminder_time FROM tasks")
def reminder_time(spark, sf_dir):
    return _tasks(spark, sf_dir).select("id", tasks.reminder_time(F.col("due_date"), F.col("reminder_offset_minutes")).alias("reminder_time"))


@catalogue.add("task_defaults", f"WITH {_TASKS} SELECT id, 'pending' AS status, CAST(0 AS INTEGER) AS priority, CAST(0 AS BIGINT) AS n_tags, reminder_time FROM tasks")
def task_defaults(spark, sf_dir):
    out = tasks.with_defaults(_tasks(spark, sf_dir).drop("status"))
    return out.select("id", "status", "priority", F.size("tags").cast("long").alias("n_tags"), "reminder_time")


@catalogue.add("task_patch", f"""WITH {_TASKS} SELECT id, CASE WHEN id % 5 = 0 THEN 'patched' ELSE title END AS title, CASE WHEN id % 10 = 0 THEN NULL ELSE due_date END AS due_date, CASE WHEN id % 5 = 0 AND id % 2 = 1 THEN 15 ELSE off END AS reminder_offset_minutes,
CASE WHEN id % 10 = 0 THEN NULL WHEN id % 5 = 0 THEN due_date - to_minutes(15) ELSE reminder_time END AS reminder_time FROM tasks""")
def task_patch(spark, sf_dir):
    rows = tasks.with_defaults(_tasks(spark, sf_dir))
    even = F.col("id") % 2 == 0
    patches = rows.where("id % 5 = 0").select(
        "id", F.when(even, F.array(F.lit("title"), F.lit("due_date"))).otherwise(F.array(F.lit("title"), F.lit("reminder_offset_minutes"))).alias("set_fields"),
        F.lit("patched").alias("title"), F.lit(None).cast("timestamp_ntz").alias("due_date"), F.lit(15).alias("reminder_offset_minutes"),
    ).distinct()
    return tasks.patched(rows, patches).select("id", "title", "due_date", "reminder_offset_minutes", "reminder_time")


@catalogue.add("task_page", f"WITH {_TASKS} SELECT id, created_at FROM tasks WHERE status = 'pending' ORDER BY created_at DESC NULLS LAST, id LIMIT 20 OFFSET 40")
def task_page(spark, sf_dir):
    return tasks.page(_tasks(spark, sf_dir), 40, 20, status="pending").select("id", "created_at")


@catalogue.add("task_complete", f"WITH {_TASKS} SELECT id, CASE WHEN id % 4 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN id % 4 = 0 AND status = 'completed' THEN 'already completed' END AS error FROM tasks WHERE id % 7 <> 0")
def task_complete(spark, sf_dir):
    rows = _tasks(spark, sf_dir)
    kept = tasks.deleted(rows, rows.where("id % 7 = 0"))
    return tasks.completed(kept, rows.where("id % 4 = 0")).select("id", "status", "error")


@catalogue.add("task_store_roundtrip", f"""WITH {_TASKS}, made AS (SELECT * FROM tasks WHERE id % 7 <> 0)
SELECT id, CASE WHEN id % 5 = 0 THEN 'patched' ELSE title END AS title, CASE WHEN id % 4 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN id % 10 = 0 THEN NULL ELSE due_date END AS due_date,
  CASE WHEN id % 10 = 0 THEN NULL WHEN id % 5 = 0 THEN due_date - to_minutes(15) ELSE reminder_time END AS reminder_time FROM made""")
def task_store_roundtrip(spark, sf_dir):
    """Tasks created in a stored table, patched, completed and deleted, each change put twice; then read back."""
    rows = tasks.with_defaults(_tasks(spark, sf_dir))
    store = keyed.KeyedTable.create(spark, scratch_folder(spark, "tasks"), rows.schema, ["id"], 16)
    even = F.col("id") % 2 == 0
    patches = rows.where("id % 5 = 0").select(
        "id", F.when(even, F.array(F.lit("title"), F.lit("due_date"))).otherwise(F.array(F.lit("title"), F.lit("reminder_offset_minutes"))).alias("set_fields"),
        F.lit("patched").alias("title"), F.lit(None).cast("timestamp_ntz").alias("due_date"), F.lit(15).alias("reminder_offset_minutes"),
    )
    for _ in range(2):
        store.insert(rows, 1)
        store.apply(patches, 2, tasks.patched)
        store.apply(rows.where("id % 4 = 0").select("id"), 3, lambda old, ids: tasks.completed(old, ids).drop("error"))
        store.delete(rows.where("id % 7 = 0"), 4)
    return store.read().select("id", "title", "status", "due_date", "reminder_time")


@catalogue.add("due_jobs", f"WITH {_TASKS}, j AS (SELECT id, 'reminder' AS job, reminder_time AS run_at FROM tasks WHERE status = 'pending' UNION ALL SELECT id, 'execution', due_date FROM tasks WHERE status = 'pending') SELECT * FROM j WHERE run_at <= TIMESTAMP '1997-01-01'")
def due_jobs(spark, sf_dir):
    return tasks.due_jobs(tasks.with_defaults(_tasks(spark, sf_dir)), F.lit("1997-01-01").cast("timestamp_ntz"))


@catalogue.add("calculator", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(-power(l_quantity, 2) + sqrt(l_extendedprice) * (1 - l_discount) / 3 + 120 - cos(pi() * l_tax), 6) AS value, round(l_quantity / nullif(l_tax, 0), 6) AS divided FROM lineitem")
def calculator(spark, sf_dir):
    names = {"q": F.col("l_quantity"), "p": F.col("l_extendedprice"), "d": F.col("l_discount"), "t": F.col("l_tax")}
    value = scalars.calculate("-q^2 + sqrt(p) * (1 - d) / 3 + 5! - cos(pi * t)", **names)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(value, 6).alias("value"), F.round(scalars.calculate("q / t", **names), 6).alias("divided"))


@catalogue.add("time_in_zone", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') || ' Asia/Shanghai +0800' AS clock, 'unknown time zone: Nowhere/Land' AS nowhere FROM events")
def time_in_zone(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", scalars.time_in_zone(ts).alias("clock"), scalars.time_in_zone(ts, "Nowhere/Land").alias("nowhere"))


def _stream(spark, sf_dir):
    """Events as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(out, mode: str, spark, folder: str, schema):
    """What a stream that runs until its files are read leaves in a folder that all executors share."""

    def put(batch, epoch: int) -> None:  # in complete mode the last batch has all
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/epoch={epoch}")

    out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


@catalogue.add("stream_windows", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Daily counts by a stream that runs until its files are read."""
    counts = ingest.windowed_counts(_stream(spark, sf_dir), "ts", "event_type")
    rows = _drained(counts, "complete", spark, scratch_folder(spark, "stream"), counts.schema)
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@catalogue.add("stream_windows_closed", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL")
def stream_windows_closed(spark, sf_dir):
    """Daily counts, told once when the watermark has passed their end, so that their state can go."""
    counts = ingest.windowed_counts(_stream(spark, sf_dir), "ts", "event_type")
    rows = _drained(counts, "append", spark, scratch_folder(spark, "stream"), counts.schema)
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# A user's request of a kind of event is served for five days; each entry begins with a miss.
_CACHE_DAYS = 5


@catalogue.add("result_cache", f"""WITH RECURSIVE e AS (SELECT user_id || '/' || event_type AS key, ts FROM events), m(key, made) AS (
  SELECT key, min(ts) FROM e GROUP BY key UNION ALL SELECT m.key, (SELECT min(ts) FROM e WHERE e.key = m.key AND e.ts >= m.made + INTERVAL {_CACHE_DAYS} DAY) FROM m WHERE m.made IS NOT NULL)
SELECT e.key, count(*) AS requests, count(*) - any_value(misses) AS hits FROM e JOIN (SELECT key, count(made) AS misses FROM m GROUP BY key) USING (key) GROUP BY e.key""")
def result_cache(spark, sf_dir):
    """Requests by user and kind of event, and how many a cache whose entries expire serves."""
    rows = _stream(spark, sf_dir).select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), "ts")
    served = ingest.cached_requests(rows, "key", "ts", _CACHE_DAYS * 86_400)
    out = _drained(served, "append", spark, scratch_folder(spark, "stream"), served.schema)
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"))


# Requests for kinds of events by user; a user's cache holds two results for five days.
_CACHE_ENTRIES = 2


@catalogue.add("result_cache_bounded")
def result_cache_bounded(spark, sf_dir):
    """Requests by user and kind of event, and how many a small cache of each user's serves."""
    served = ingest.bounded_cache(_stream(spark, sf_dir), "user_id", "event_type", "ts", _CACHE_ENTRIES, _CACHE_DAYS * 86_400)
    out = _drained(served, "append", spark, scratch_folder(spark, "stream"), served.schema)
    return out.groupBy("by", "key").agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"))


@catalogue.add("stream_log_append", "SELECT strftime(ts, '%Y%m%d') AS date, event_id, event_type FROM events")
def stream_log_append(spark, sf_dir):
    folder = scratch_folder(spark, "stream")
    ingest.log_stream(_stream(spark, sf_dir).select("event_id", "ts", "event_type"), f"{folder}/log", f"{folder}/state", "ts").awaitTermination()
    return spark.read.json(f"{folder}/log").select(F.col("date").cast("string").alias("date"), "event_id", "event_type")


@catalogue.add("context_fallback", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role ELSE 'debug' END AS source FROM conversations WHERE turn % 3 <> 2")
def context_fallback(spark, sf_dir):
    """The context of a log: its own field, or that of its debug information; without both it is left out."""
    top = F.when(F.col("turn") % 3 == 0, F.array("role")).when(F.col("turn") % 3 == 1, F.array().cast("array<string>"))
    debug = F.when(F.col("turn") % 3 != 2, F.array(F.lit("debug")))
    rows = table(spark, sf_dir, "conversations").withColumn("context", logs.context_documents(top, debug))
    return rows.where(F.size("context") > 0).select("conv_id", "turn", F.col("context")[0].alias("source"))


@catalogue.add("stream_ingest", "SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM benchmark WHERE length(trim(text)) > 0")
def stream_ingest(spark, sf_dir):
    """Benchmark items written as text files, taken in by the file stream."""
    folder = scratch_folder(spark, "stream")
    texts = table(spark, sf_dir, "benchmark").select(F.regexp_replace("text", "\\s+", " ").alias("value"))
    texts.write.option("lineSep", "\n\n").text(f"{folder}/in")
    ingest.ingest(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state").awaitTermination()
    said = F.explode(F.split("text", "\n\n"))
    return spark.read.parquet(f"{folder}/out").select(said.alias("line")).select(F.trim("line").alias("line")).where("length(line) > 0")


@catalogue.add("stream_due_timer", "SELECT event_id AS id, 'reminder' AS job FROM events WHERE event_id % 50 = 0 AND ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)")
def stream_due_timer(spark, sf_dir):
    jobs = _stream(spark, sf_dir).select(
        F.when(F.col("event_id") % 50 == 0, F.col("event_id")).alias("id"), F.lit("reminder").alias("job"),  # others only move the time on
        F.when(F.col("event_id") % 50 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("run_at"), F.col("ts").alias("seen_at"),
    )
    fired = ingest.due_timers(jobs)
    return _drained(fired, "append", spark, scratch_folder(spark, "stream"), fired.schema).select("id", "job")
