"""Queries that link questions, turns, answers and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.arrays import json_count
from tallyloom.functions.text import MATCH_TRIM, match_key
from tallyloom.operators import linkage
from tallyloom.operators.sequences import first_per_key, nearest_in_time, nearest_with_key
from tallyloom.session import load

TOLERANCE_US = 120_000_000


def _questions(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "query_records").where("query_id is not null and question is not null")
    return rows.select(F.col("query_id").alias("question_id"), match_key(F.col("question")).alias("key")).where("key <> ''").distinct()


def link_first_turn(spark: SparkSession, d: str) -> DataFrame:
    return linkage.first_turns(_questions(spark, d), linkage.asked_turns(load(spark, d, "messages"))).select("question_id", "message_id", "conversation_id", F.col("at").alias("at_us"))


def next_assistant_turn(spark: SparkSession, d: str) -> DataFrame:
    return linkage.next_answers(load(spark, d, "messages"))


def extract_records(spark: SparkSession, d: str) -> DataFrame:
    """Question, its first turn, the answer after it, and the newest record logged for that answer."""
    messages = load(spark, d, "messages")
    first = linkage.first_turns(_questions(spark, d), linkage.asked_turns(messages))
    answers = linkage.next_answers(messages)
    logs = load(spark, d, "query_records").where("message_id is not null").select(F.col("message_id").alias("answer_id"), "record_id", "provider", "model", F.unix_micros("logged_at").alias("logged"))
    newest = linkage.latest_log(logs, "answer_id", ["logged", "record_id"], ["record_id", "provider", "model"])
    return first.join(answers, "message_id", "left").join(newest, "answer_id", "left").select("question_id", "message_id", "answer_id", "wait_us", "record_id", "provider", "model", F.col("answer_id").isNotNull().alias("linked"))


def question_probe_counts(spark: SparkSession, d: str) -> DataFrame:
    turns = linkage.asked_turns(load(spark, d, "messages")).groupBy("key").agg(F.count("*").alias("n"))
    return _questions(spark, d).join(turns, "key", "left").groupBy("question_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_turns"))


def missing_questions(spark: SparkSession, d: str) -> DataFrame:
    turns = linkage.asked_turns(load(spark, d, "messages")).where("conversation_id is not null").select("key").distinct()
    nobody = spark.range(1).select(F.lit("q_nobody").alias("question_id"), F.lit("a question that nobody asked").alias("key"))
    q = _questions(spark, d).unionByName(nobody)
    found = q.join(turns, "key", "left_semi").select("question_id").distinct()
    return q.select("question_id").distinct().join(found, "question_id", "left_anti")


def _sittings(spark: SparkSession, d: str) -> DataFrame:
    return linkage.sittings(linkage.asked_turns(load(spark, d, "messages")), _questions(spark, d))


def sitting_groups(spark: SparkSession, d: str) -> DataFrame:
    return _sittings(spark, d).select("conversation_id", "matched", "missing", F.col("first_at").alias("first_us"), F.col("last_at").alias("last_us"))


def sitting_windows(spark: SparkSession, d: str) -> DataFrame:
    return linkage.sitting_windows(_sittings(spark, d))


def sitting_greedy_merge(spark: SparkSession, d: str) -> DataFrame:
    hits = linkage.asked_turns(load(spark, d, "messages")).where("conversation_id is not null").join(_questions(spark, d), "key")
    return linkage.merge_sittings(hits.select(F.lit("all").alias("cell"), "conversation_id", "question_id", "at"))


def _event_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = load(spark, d, "events").withColumn("at", F.unix_micros("ts"))
    left = events.where("event_type = 'purchase'").select(F.col("event_id").alias("left_id"), "user_id", F.col("at").alias("turn_at"))
    right = events.where("event_type = 'view'").select(F.col("event_id").alias("right_id"), "user_id", F.col("at").alias("log_at"))
    return left, right


def nearest_log_same_key(spark: SparkSession, d: str) -> DataFrame:
    left, right = _event_sides(spark, d)
    return nearest_with_key(left, right, ["user_id"], "turn_at", "log_at", TOLERANCE_US * 30).select("left_id", "right_id", F.col("skew").alias("skew_us"))


def nearest_log_any_key(spark: SparkSession, d: str) -> DataFrame:
    left, right = _event_sides(spark, d)
    return nearest_in_time(left.drop("user_id"), right.drop("user_id"), "turn_at", "log_at", TOLERANCE_US).select("left_id", "right_id", F.col("skew").alias("skew_us"))


def completion_links(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as turns, views as log entries; an entry of an even property names the purchase with its own id plus one."""
    events = load(spark, d, "events").withColumns({"at": F.unix_micros("ts"), "k": json_count(F.col("props"), "$.k")})
    turns = events.where("event_type = 'purchase'").select(F.col("event_id").alias("message_id"), F.col("user_id").alias("conversation_id"), "at")
    logs = events.where("event_type = 'view'").select(F.col("event_id").alias("log_id"), F.when(F.col("k") % 2 == 0, F.col("event_id") + 1).alias("message_id"), F.col("user_id").alias("conversation_id"), "at")
    return linkage.completion_links(turns, logs, TOLERANCE_US * 30)


def first_event_per_user(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events").withColumn("at_us", F.unix_micros("ts"))
    return first_per_key(events, ["user_id"], ["at_us", "event_id"], ["event_id", "event_type", "at_us"])


def served_documents(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "query_records").where("linked and trim(coalesce(governing_doc, '')) <> ''").select("cell_name", F.col("governing_doc").alias("document_name")).distinct()


def documents_with_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    from tallyloom.operators.ingest import documents_with_chunks

    docs = load(spark, d, "query_records").where("governing_doc is not null").select(F.col("governing_doc").alias("document_name")).distinct()
    chunks = load(spark, d, "chunk_rows").select("chunk_id", "document_name", F.length(F.coalesce("text", "normalised")).cast("bigint").alias("chunk_chars"), F.lit(None).cast("bigint").alias("chunk_at")).distinct()
    return documents_with_chunks(docs, chunks, "document_name").select("document_name", "n_chunks", "chars")


def shared_and_missing_queries(spark: SparkSession, d: str) -> DataFrame:
    """Question ids that both or only one of two cells answered, by set operations."""
    q = load(spark, d, "query_records").where("linked and query_id is not null")
    a, b = q.where("cell_name = 'control'").select("query_id"), q.where("cell_name = 'combined'").select("query_id")
    parts = {"both": a.intersect(b), "control_only": a.subtract(b), "combined_only": b.subtract(a)}
    out = [p.withColumn("part", F.lit(name)) for name, p in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).groupBy("part").agg(F.count("*").alias("n"))


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events").withColumn("k", json_count(F.col("props"), "$.k"))
    return events.groupBy("event_type").agg(F.count("k").alias("n_with_k"), F.sum("k").alias("sum_k"), F.countDistinct("k").alias("distinct_k"))


QUERIES = {
    f.__name__: f
    for f in (
        link_first_turn, next_assistant_turn, extract_records, question_probe_counts, missing_questions, sitting_groups, sitting_windows, sitting_greedy_merge, nearest_log_same_key,
        nearest_log_any_key, completion_links, first_event_per_user, served_documents, documents_with_chunk_counts, shared_and_missing_queries, event_properties,
    )
}

_TRIM = MATCH_TRIM.replace("'", "''").replace("\t", "' || chr(9) || '").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '")


def key_sql(c: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({c}, '')), '[\s\p{{Z}}]+', ' ', 'g'), ('{_TRIM}'))"


_ROLE = r"""CASE WHEN lower(regexp_replace(speaker, '[\s\p{Z}]+', '', 'g')) IN ('user', 'human', 'customer') THEN 'ask' WHEN lower(regexp_replace(speaker, '[\s\p{Z}]+', '', 'g')) IN ('assistant', 'ai', 'bot') THEN 'answer' END"""
_TURNS = f"""
    q AS (SELECT DISTINCT query_id AS question_id, {key_sql('question')} AS key FROM query_records WHERE query_id IS NOT NULL AND question IS NOT NULL),
    questions AS (SELECT * FROM q WHERE key <> ''),
    turns AS (SELECT DISTINCT {key_sql('content')} AS key, message_id, conversation_id, epoch_us(created_at) AS t_us FROM messages WHERE content IS NOT NULL AND created_at IS NOT NULL AND {_ROLE} = 'ask'),
    firsts AS (SELECT question_id, message_id, conversation_id, t_us FROM (SELECT *, row_number() OVER (PARTITION BY question_id, key ORDER BY t_us, message_id) AS n FROM questions JOIN turns USING (key)) WHERE n = 1)"""
_ANSWERS = f"""
    m AS (SELECT DISTINCT conversation_id, epoch_us(created_at) AS t_us, message_id, {_ROLE} AS role FROM messages WHERE conversation_id IS NOT NULL AND created_at IS NOT NULL),
    answers AS (
        SELECT a.message_id, arg_min(b.message_id, (b.t_us, b.message_id)) AS answer_id, min(b.t_us) - a.t_us AS wait_us
        FROM m a JOIN m b ON a.conversation_id = b.conversation_id AND a.role = 'ask' AND b.role = 'answer' AND b.t_us >= a.t_us GROUP BY a.message_id, a.t_us)"""
_NEAR = """
    l AS (SELECT event_id AS left_id, user_id, epoch_us(ts) AS lt FROM events WHERE event_type = 'purchase'),
    r AS (SELECT event_id AS right_id, user_id, epoch_us(ts) AS rt FROM events WHERE event_type = 'view')"""
_SITTINGS = f"""{_TURNS}, sit AS (
        SELECT conversation_id, count(DISTINCT question_id) AS matched, (SELECT count(DISTINCT question_id) FROM questions) - count(DISTINCT question_id) AS missing, min(t_us) AS first_us, max(t_us) AS last_us
        FROM turns JOIN questions USING (key) WHERE conversation_id IS NOT NULL GROUP BY 1)"""

SQL = {
    "link_first_turn": f"WITH {_TURNS} SELECT question_id, message_id, conversation_id, t_us AS at_us FROM firsts",
    "next_assistant_turn": f"WITH {_ANSWERS} SELECT * FROM answers",
    "extract_records": f"""
        WITH {_TURNS}, {_ANSWERS},
        newest AS (SELECT * FROM (SELECT message_id AS answer_id, record_id, provider, model, row_number() OVER (PARTITION BY message_id ORDER BY logged_at DESC NULLS LAST, record_id DESC) AS n FROM query_records WHERE message_id IS NOT NULL) WHERE n = 1)
        SELECT question_id, firsts.message_id, answers.answer_id, wait_us, record_id, provider, model, answers.answer_id IS NOT NULL AS linked FROM firsts LEFT JOIN answers USING (message_id) LEFT JOIN newest ON answers.answer_id = newest.answer_id""",
    "question_probe_counts": f"WITH {_TURNS} SELECT question_id, count(message_id) AS n_turns FROM questions LEFT JOIN turns USING (key) GROUP BY 1",
    "missing_questions": f"WITH {_TURNS} SELECT DISTINCT question_id FROM questions WHERE question_id NOT IN (SELECT question_id FROM questions JOIN turns USING (key) WHERE conversation_id IS NOT NULL) UNION ALL SELECT 'q_nobody'",
    "sitting_groups": f"WITH {_SITTINGS} SELECT * FROM sit",
    "sitting_windows": f"WITH {_SITTINGS} SELECT conversation_id, floor((first_us - 60000000) / 60000000)::BIGINT * 60 AS start_s, ceil((last_us + 60000000) / 60000000)::BIGINT * 60 AS end_s FROM sit",
    "sitting_greedy_merge": f"""
        WITH {_TURNS}, h AS (SELECT conversation_id, question_id, min(t_us) AS t FROM questions JOIN turns USING (key) WHERE conversation_id IS NOT NULL GROUP BY 1, 2),
        s AS (SELECT conversation_id, count(*) AS matched, min(t) AS first_us FROM h GROUP BY 1),
        f AS (SELECT question_id, min((-matched, first_us, conversation_id)) AS p FROM h JOIN s USING (conversation_id) GROUP BY 1),
        g AS (SELECT p, count(*) AS added FROM f GROUP BY 1)
        SELECT 'all' AS cell, p[3] AS conversation_id, row_number() OVER (ORDER BY p) - 1 AS step, added FROM g""",
    "nearest_log_same_key": f"WITH {_NEAR} SELECT left_id, right_id, skew_us FROM (SELECT left_id, right_id, abs(lt - rt) AS skew_us, row_number() OVER (PARTITION BY left_id ORDER BY abs(lt - rt), rt DESC, right_id) AS n FROM l JOIN r USING (user_id) WHERE abs(lt - rt) <= 3600000000) WHERE n = 1",
    "nearest_log_any_key": f"WITH {_NEAR} SELECT left_id, right_id, skew_us FROM (SELECT left_id, right_id, abs(lt - rt) AS skew_us, row_number() OVER (PARTITION BY left_id ORDER BY abs(lt - rt), rt DESC, right_id) AS n FROM l JOIN r ON rt BETWEEN lt - 120000000 AND lt + 120000000) WHERE n = 1",
    "completion_links": """
        WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t_us, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
        t AS (SELECT * FROM e WHERE event_type = 'purchase'), lg AS (SELECT event_id AS log_id, CASE WHEN k % 2 = 0 THEN event_id + 1 END AS message_id, user_id, t_us FROM e WHERE event_type = 'view'),
        x AS (SELECT message_id, arg_max(log_id, (t_us, log_id)) AS exact_id FROM lg WHERE message_id IS NOT NULL GROUP BY 1),
        n AS (SELECT left_id, right_id FROM (SELECT t.event_id AS left_id, log_id AS right_id, row_number() OVER (PARTITION BY t.event_id ORDER BY abs(t.t_us - lg.t_us), lg.t_us DESC, log_id) AS n FROM t JOIN lg ON t.user_id = lg.user_id AND lg.message_id IS NULL AND abs(t.t_us - lg.t_us) <= 3600000000) WHERE n = 1)
        SELECT t.event_id AS message_id, coalesce(exact_id, right_id) AS log_id, CASE WHEN exact_id IS NOT NULL THEN 'message_id' WHEN right_id IS NOT NULL THEN 'conversation+time' END AS link
        FROM t LEFT JOIN x ON t.event_id = x.message_id LEFT JOIN n ON t.event_id = n.left_id""",
    "first_event_per_user": "SELECT user_id, event_id, event_type, epoch_us(ts) AS at_us FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1",
    "served_documents": "SELECT DISTINCT cell_name, governing_doc AS document_name FROM query_records WHERE linked AND trim(coalesce(governing_doc, '')) <> ''",
    "documents_with_chunk_counts": """
        WITH docs AS (SELECT DISTINCT governing_doc AS document_name FROM query_records WHERE governing_doc IS NOT NULL), c AS (SELECT DISTINCT chunk_id, document_name, length(coalesce(text, normalised)) AS n FROM chunk_rows)
        SELECT document_name, count(chunk_id) AS n_chunks, coalesce(sum(n), 0)::BIGINT AS chars FROM docs LEFT JOIN c USING (document_name) GROUP BY 1""",
    "shared_and_missing_queries": """
        WITH q AS (SELECT query_id, bool_or(cell_name = 'control') AS a, bool_or(cell_name = 'combined') AS b FROM query_records WHERE linked AND query_id IS NOT NULL GROUP BY 1)
        SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'control_only' ELSE 'combined_only' END AS part, count(*) AS n FROM q WHERE a OR b GROUP BY 1""",
    "event_properties": "SELECT event_type, count(k) AS n_with_k, sum(k)::BIGINT AS sum_k, count(DISTINCT k) AS distinct_k FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
}
