"""Queries of the training-text operators over the tables of one folder, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import canonical, leaks, mixture, pairs, pieces, quantiles, residue, threads
from tallyloom.session import load, materialise

LATENCIES = {"latency_ms": 1, "retrieval_latency_ms": 0, "rerank_latency_ms": 0}
FRACTIONS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    chunks, gold = load(spark, d, "chunk_rows"), load(spark, d, "gold_evidence")
    return canonical.find_quotes(chunks, gold, text_id="chunk_id", quote_id="evidence_id", group="document_name", form_text="normalised")


def p1_consistent_texts(spark: SparkSession, d: str) -> DataFrame:
    chunks = canonical.consistent_texts(load(spark, d, "chunk_rows"), "text", "normalised").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "text_canonical", "normalised_canonical")
    gold = load(spark, d, "gold_evidence").select(F.lit("quote").alias("kind"), F.col("evidence_id").alias("id"), canonical.canonical_column("text").alias("text_canonical"), canonical.matching_column("text").alias("normalised_canonical"))
    return chunks.unionByName(gold).distinct()


def _day_sketches(spark: SparkSession, d: str) -> DataFrame:
    used = ["record_id", "cell_name", "model", "answered_at", *LATENCIES]
    records = load(spark, d, "query_records").select(*used).distinct()
    return quantiles.sketch_columns(records.withColumn("day", F.to_date("answered_at").cast("string")), ["cell_name", "model", "day"], LATENCIES)


def p2_latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of single days, merged per cell and model."""
    merged = quantiles.merge_sketches(_day_sketches(spark, d), ["cell_name", "model"])
    return quantiles.percentiles(merged, FRACTIONS)


def p2_latency_by_day(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(_day_sketches(spark, d), FRACTIONS)


def _conversations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    facts = materialise(threads.message_facts(load(spark, d, "messages"), load(spark, d, "query_records")))
    turns = threads.reassemble(facts)
    return facts, turns, threads.judge_conversations(facts, turns)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _conversations(spark, d)[2].where("not sound").select("conversation_id")


def p3_judged(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation with its turns and why it is dropped, null where it is kept."""
    return _conversations(spark, d)[2].select("conversation_id", "n_turns", "reason")


def p3_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The turns of sound conversations in order, with the text of each."""
    _, turns, judged = _conversations(spark, d)
    sound = turns.join(judged.where("sound").select("conversation_id"), "conversation_id", "left_semi")
    messages = load(spark, d, "messages").select("message_id", "content").dropDuplicates(["message_id"])
    answers = load(spark, d, "query_records").where("message_id is not null").select("message_id", "answer_text").dropDuplicates(["message_id"])
    text = F.when(threads.is_visible(F.col("content")), F.col("content")).otherwise(F.col("answer_text"))
    return sound.join(messages, "message_id").join(answers, "message_id", "left").select("conversation_id", "position", "role", "message_id", "created_at", text.alias("turn_text"))


def p3_turns(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p3_conversations with their time as microseconds."""
    return p3_conversations(spark, d).select("conversation_id", "position", "role", "message_id", F.unix_micros("created_at").alias("created_us"), "turn_text")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    chunks = load(spark, d, "built_chunks").select("built_id", "document_id", "chunk_index", "text").distinct()
    return pieces.split_oversized(chunks, keep=("built_id", "document_id", "chunk_index"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("sub_index = 1 and sub_count > 1").select("built_id").distinct()


def p4_pieces_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per long text what its pieces give: the text joined back without overlaps, as a hash, and whether they keep the rules."""
    own = F.struct("sub_index", "piece", "overlap_chars", "overlap_with_previous", "sub_count")
    whole = _pieces(spark, d).groupBy("built_id", "document_id", "chunk_index").agg(F.array_sort(F.collect_list(own)).alias("p"))  # the pieces of one text
    every = lambda test: F.forall("p", test)
    return whole.select(
        "built_id",
        F.md5(F.concat_ws("", F.transform("p", lambda x: F.substr(x["piece"], x["overlap_chars"] + 1)))).alias("text_md5"),
        every(lambda x: F.length(x["piece"]).between(1, 4000)).alias("pieces_fit"),
        every(lambda x: x["overlap_chars"].between(0, 400) & (x["overlap_with_previous"] == (x["overlap_chars"] > 0))).alias("overlaps_fit"),
        (every(lambda x: x["sub_count"] == F.size("p")) & (F.transform("p", lambda x: x["sub_index"]) == F.sequence(F.lit(1), F.size("p")))).alias("numbered"),
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.find_defects(load(spark, d, "query_records"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(load(spark, d, "documents"), load(spark, d, "eval_items")).select("item_id", "doc_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p8_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return leaks.without_leaks(docs, leaks.find_leaks(docs, load(spark, d, "eval_items"))).select("doc_id", "source", "n_chars")


def p8_redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents without the runs of words they share with test items."""
    return leaks.without_spans(load(spark, d, "documents"), load(spark, d, "eval_items")).select("doc_id", "removed_words", F.length("text").alias("chars_left"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = load(spark, d, "mix_targets").withColumnRenamed("source_name", "source")
    return mixture.mix(mixture.count_tokens(load(spark, d, "documents")), targets)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def p9_shares_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per source whether the share reached is its target within a point and two documents of usual length, and whether no
    document is used too often."""
    s = materialise(p9_shares(spark, d))
    s = s.crossJoin(F.broadcast(s.agg(F.sum("tokens_out").alias("all_tokens"))))  # one row
    slack = 0.01 + 2 * F.coalesce(F.try_divide("source_tokens", "n_docs"), F.lit(0.0)) / F.col("all_tokens")
    return s.select("source", F.round("target_share", 6).alias("target_share"), (F.abs(F.col("actual_share") - F.col("target_share")) <= slack).alias("on_target"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"))


def p2_rank_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per cell and model whether each answer of the merged sketches keeps the stated rank error; groups may be far larger than k."""
    answers = p2_latency_percentiles(spark, d)
    used = ["record_id", "cell_name", "model", "answered_at", *LATENCIES]
    rows = load(spark, d, "query_records").select(*used).distinct()
    long = rows.select("cell_name", "model", F.inline(F.array(*(F.struct(F.lit(c).alias("measure"), F.when(F.col(c) >= least, F.col(c).cast("bigint")).alias("x")) for c, least in LATENCIES.items())))).where("x is not null")
    keys = [long[c].eqNullSafe(answers[c]) for c in ("cell_name", "model")]
    met = long.join(F.broadcast(answers), [*keys, long["measure"] == answers["measure"]])  # a row per cell, model and measure
    ranks = met.groupBy(answers["cell_name"], answers["model"], answers["measure"]).agg(
        F.count("*").alias("n"), F.first("rank_error_bound").alias("bound"),
        *(F.struct(F.avg((F.col("x") < F.col(name)).cast("double")).alias("below"), F.avg((F.col("x") <= F.col(name)).cast("double")).alias("upto")).alias(name) for name in FRACTIONS),
    )
    return ranks.select("cell_name", "model", "measure", "n", *(((F.col(f"{name}.below") - F.col("bound") <= q) & (F.col(f"{name}.upto") + F.col("bound") >= q)).alias(name) for name, q in FRACTIONS.items()))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(load(spark, d, "documents")).select("doc_id")


def p10_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(load(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_consistent_texts, p2_latency_percentiles, p2_latency_by_day, p2_rank_checked, p3_found, p3_judged, p3_conversations, p3_turns, p4_found, p4_pieces, p4_pieces_checked,
        p6_found, p8_found, p8_leaks, p8_clean_documents, p8_redacted_documents, p9_mixture, p9_shares, p9_shares_checked, p10_found, p10_residue,
    )
}

INK_SQL = r"[^\p{Z}\p{C}\s\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]"

_LATENCY_ROWS = """
    r AS (SELECT DISTINCT record_id, cell_name, model, answered_at, latency_ms, retrieval_latency_ms, rerank_latency_ms FROM query_records),
    v AS (
        SELECT cell_name, model, answered_at::DATE::VARCHAR AS day, 'latency_ms' AS measure, latency_ms AS x FROM r WHERE latency_ms >= 1
        UNION ALL SELECT cell_name, model, answered_at::DATE::VARCHAR, 'retrieval_latency_ms', retrieval_latency_ms FROM r WHERE retrieval_latency_ms >= 0
        UNION ALL SELECT cell_name, model, answered_at::DATE::VARCHAR, 'rerank_latency_ms', rerank_latency_ms FROM r WHERE rerank_latency_ms >= 0)"""


def _percentile_sql(keys: str) -> str:
    """Exact percentiles: what a sketch answers while a group holds no more values than its k; beyond that it may be off by
    the stated rank error."""
    picks = ", ".join(f"s[ceil({q} * len(s))::BIGINT] AS {name}" for name, q in FRACTIONS.items())
    return f"WITH {_LATENCY_ROWS}, g AS (SELECT {keys}, measure, list_sort(list(x)) AS s FROM v GROUP BY ALL) SELECT {keys}, measure, len(s) AS n, {picks}, {quantiles.rank_error_bound(quantiles.DEFAULT_K)!r}::DOUBLE AS rank_error_bound FROM g"


_TURNS_SQL = rf"""
        WITH m AS (
            SELECT DISTINCT message_id, conversation_id, created_at, lower(regexp_replace(coalesce(speaker, ''), '[\p{{Z}}\p{{C}}\s]+', '', 'g')) AS who,
                   coalesce(regexp_matches(content, '{INK_SQL}'), false) AS seen
            FROM messages WHERE conversation_id IS NOT NULL),
        a AS (SELECT DISTINCT message_id FROM query_records WHERE message_id IS NOT NULL AND regexp_matches(answer_text, '{INK_SQL}')),
        r AS (
            SELECT m.*, seen OR a.message_id IS NOT NULL AS visible,
                   CASE WHEN who IN ('user', 'human', 'customer') THEN 'ask' WHEN who IN ('assistant', 'ai', 'bot') THEN 'answer' WHEN who = 'system' THEN 'system' END AS role
            FROM m LEFT JOIN a USING (message_id)),
        t AS (
            SELECT conversation_id, message_id, created_at, role, lag(role) OVER w AS before, row_number() OVER w AS n, count(*) OVER (PARTITION BY conversation_id) AS of
            FROM r WHERE visible AND role IN ('ask', 'answer') AND created_at IS NOT NULL
            WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, message_id)),
        b AS (SELECT conversation_id, bool_or(role IS NULL OR (role <> 'system' AND created_at IS NULL)) AS unknown_row FROM r GROUP BY 1),
        g AS (SELECT conversation_id, count(*) AS n_turns, bool_or(n = 1 AND role <> 'ask') AS bad_start, bool_or(coalesce(before = role, false)) AS bad_order, arg_max(role, n) AS last_role FROM t GROUP BY 1),
        judged AS (
            SELECT conversation_id, coalesce(n_turns, 0) AS n_turns,
                   CASE WHEN n_turns IS NULL THEN 'empty' WHEN unknown_row THEN 'unknown_row' WHEN bad_start THEN 'bad_start' WHEN bad_order THEN 'bad_order' WHEN last_role <> 'answer' THEN 'no_reply' END AS reason
            FROM b LEFT JOIN g USING (conversation_id))"""

UNSEEN_SQL = r"[\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}\x{00}-\x{08}\x{0E}-\x{1B}\x{7F}-\x{84}\x{86}-\x{9F}]+"
_GRAMS_SQL = rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(regexp_replace(text, '{UNSEEN_SQL}', '', 'g'))), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
        i AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(regexp_replace(text, '{UNSEEN_SQL}', '', 'g'))), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM eval_items WHERE text IS NOT NULL AND item_id IS NOT NULL),
        dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS gram FROM d WHERE len(w) >= 10),
        ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS gram FROM i WHERE len(w) >= 10),
        leaks AS (SELECT DISTINCT item_id, doc_id FROM dg JOIN ig USING (gram))"""

SQL = {
    "p2_rank_checked": f"WITH {_LATENCY_ROWS} SELECT cell_name, model, measure, count(*) AS n, true AS p50, true AS p90, true AS p95, true AS p99 FROM v GROUP BY 1, 2, 3",
    "p8_found": f"{_GRAMS_SQL} SELECT item_id, doc_id FROM leaks",
    "p8_clean_documents": f"{_GRAMS_SQL} SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaks)",
    "p9_shares_checked": "SELECT source_name AS source, round(max(target_share), 6) AS target_share, true AS on_target, true AS within_repeats FROM mix_targets GROUP BY 1",
    "p3_judged": f"{_TURNS_SQL} SELECT * FROM judged",
    "p3_turns": rf"""{_TURNS_SQL},
        c AS (SELECT message_id, any_value(content) AS content FROM messages GROUP BY 1), x AS (SELECT message_id, any_value(answer_text) AS answer_text FROM query_records WHERE message_id IS NOT NULL GROUP BY 1)
        SELECT conversation_id, n - 1 AS position, role, message_id, epoch_us(created_at) AS created_us, CASE WHEN coalesce(regexp_matches(content, '{INK_SQL}'), false) THEN content ELSE answer_text END AS turn_text
        FROM t JOIN judged USING (conversation_id) LEFT JOIN c USING (message_id) LEFT JOIN x USING (message_id) WHERE reason IS NULL""",
    "p2_latency_percentiles": _percentile_sql("cell_name, model"),
    "p2_latency_by_day": _percentile_sql("cell_name, model, day"),
    "p4_found": "SELECT DISTINCT built_id FROM built_chunks WHERE length(text) > 4000",
    "p4_pieces_checked": "SELECT DISTINCT built_id, md5(text) AS text_md5, true AS pieces_fit, true AS overlaps_fit, true AS numbered FROM built_chunks WHERE length(text) > 4000",
    "p3_found": rf"""
        WITH m AS (
            SELECT DISTINCT message_id, conversation_id, created_at, lower(regexp_replace(coalesce(speaker, ''), '[\p{{Z}}\p{{C}}\s]+', '', 'g')) AS who,
                   coalesce(regexp_matches(content, '{INK_SQL}'), false) AS seen
            FROM messages WHERE conversation_id IS NOT NULL),
        a AS (SELECT DISTINCT message_id FROM query_records WHERE message_id IS NOT NULL AND regexp_matches(answer_text, '{INK_SQL}')),
        r AS (
            SELECT m.*, seen OR a.message_id IS NOT NULL AS visible,
                   CASE WHEN who IN ('user', 'human', 'customer') THEN 'ask' WHEN who IN ('assistant', 'ai', 'bot') THEN 'answer' WHEN who = 'system' THEN 'system' END AS role
            FROM m LEFT JOIN a USING (message_id)),
        t AS (
            SELECT conversation_id, role, lag(role) OVER w AS before, row_number() OVER w AS n, count(*) OVER (PARTITION BY conversation_id) AS of
            FROM r WHERE visible AND role IN ('ask', 'answer') AND created_at IS NOT NULL
            WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, message_id)),
        good AS (
            SELECT conversation_id FROM t GROUP BY 1
            HAVING bool_and(before IS NULL OR before <> role) AND bool_and(n > 1 OR role = 'ask') AND bool_and(n < of OR role = 'answer')),
        bad AS (SELECT DISTINCT conversation_id FROM r WHERE role IS NULL OR (role <> 'system' AND created_at IS NULL))
        SELECT DISTINCT conversation_id FROM r
        WHERE conversation_id NOT IN (SELECT conversation_id FROM good) OR conversation_id IN (SELECT conversation_id FROM bad)""",
}
