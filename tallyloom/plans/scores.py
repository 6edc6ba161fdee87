"""Queries that score answers: abstention, agreement, overlap, tokens, latency, and texts themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.functions.arrays import settled
from tallyloom.operators import answers
from tallyloom.plans.retrieval import norm_sql
from tallyloom.session import load


def _records(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Logged records, repeats once."""
    return load(spark, d, "query_records").select("record_id", *columns).distinct()


def refusal_signals(spark: SparkSession, d: str) -> DataFrame:
    s = answers.refusal_signals(_records(spark, d, "cell_name", "answer_text", "linked"))
    return s.groupBy("cell_name").agg(F.count("*").alias("n"), F.count_if("marker_match").alias("marker_matches"), F.count_if("is_refusal").alias("refusals"))


def abstention_rates(spark: SparkSession, d: str) -> DataFrame:
    return answers.abstention_rates(answers.refusal_signals(_records(spark, d, "cell_name", "answer_text", "answerable", "linked")), "cell_name")


def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Two opinions on whether a record was refused: the refusal net and a negation in the first words."""
    r = _records(spark, d, "cell_name", "answer_text", "linked").where("linked")
    a = F.when(F.col("answer_text").isNotNull(), X.refused_by_net(F.col("answer_text")).cast("int"))
    b = F.when(F.trim("answer_text") != "", F.lower("answer_text").rlike("(^|[^a-z])(no|not|cannot|unable)([^a-z]|$)").cast("int"))
    out = answers.raw_agreement(r.select("cell_name", a.alias("a"), b.alias("b")), "a", "b", ["cell_name"])
    return out.select("cell_name", "n", F.round("agreement", 6).alias("agreement"))


def label_spellings(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d, "answerable", "linked").select(X.coerce_label(F.col("answerable").cast("string")).alias("a"), X.coerce_label(F.concat(F.lit(" "), F.upper(F.col("linked").cast("string")))).alias("b"))
    return r.groupBy("a", "b").agg(F.count("*").alias("n"))


def answer_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d, "cell_name", "answer_text", "gold_answer", "linked").where("linked")
    per = answers.token_overlap(rows, "record_id").join(rows.select("record_id", "cell_name"), "record_id")
    return per.groupBy("cell_name").agg(F.count("*").alias("n"), F.round(F.avg("token_f1"), 6).alias("token_f1"), F.round(F.avg("token_cosine"), 6).alias("token_cosine"))


def overlap_faithfulness(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d, "cell_name", "answer_text", "gold_answer", "linked", "answerable").where("linked and answerable").withColumn("reference", F.col("gold_answer"))
    per = answers.overlap_faithfulness(rows, "record_id").join(rows.select("record_id", "cell_name"), "record_id")
    return per.groupBy("cell_name").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"), F.round(F.avg("faithful"), 6).alias("strict_rate"))


def raga_overall(spark: SparkSession, d: str) -> DataFrame:
    """Field means over the answers that have the field, how many did, and the mean of the fields."""
    rows = _records(spark, d, "cell_name", "answer_text", "gold_answer", "linked").where("linked")
    over = answers.token_overlap(rows, "record_id")
    fields = rows.select("record_id", "cell_name").join(over, "record_id", "left").withColumn("answered", F.lit(1.0))
    means = fields.groupBy("cell_name").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("token_f1", "token_cosine")), F.count("token_f1").alias("n_scored"), F.count("*").alias("n"))
    return means.withColumn("overall", settled((F.col("token_f1") + F.col("token_cosine")) / 2, 5))


def token_totals(spark: SparkSession, d: str) -> DataFrame:
    return answers.token_totals(_records(spark, d, "cell_name", "linked", "tokens_total", "tokens_input", "tokens_output", "provider", "model"), "cell_name")


def provider_overview(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d, "cell_name", "linked", "provider").where("linked")
    return r.groupBy("cell_name").agg(F.count("*").alias("completions"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"), F.coalesce(F.bool_and(F.col("provider") == "ollama"), F.lit(False)).alias("local_only"))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d, "cell_name", "latency_ms", "linked").where("linked and latency_ms > 0")
    return answers.nearest_rank(r, ["cell_name"], "latency_ms", {"p50": 0.5, "p95": 0.95})


def latency_means(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d, "cell_name", "latency_ms", "retrieval_latency_ms", "rerank_latency_ms", "linked").where("linked and latency_ms > 0")
    return r.groupBy("cell_name").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 1).alias(f"mean_{c}") for c in ("latency_ms", "retrieval_latency_ms", "rerank_latency_ms")))


def pass_threshold(spark: SparkSession, d: str) -> DataFrame:
    ev = load(spark, d, "events").where("value is not null").select("event_type", (F.least(F.greatest(F.round("value", 2), F.lit(0.0)), F.lit(100.0)) / 100).alias("prob"))
    return answers.threshold_for_pass_rate(ev, ["event_type"], "prob").withColumn("threshold", F.round("threshold", 6))


def refusal_f1(spark: SparkSession, d: str) -> DataFrame:
    s = answers.refusal_signals(_records(spark, d, "cell_name", "answer_text", "answerable", "linked")).select("cell_name", (~F.col("answerable")).cast("int").alias("truth"), F.col("is_refusal").cast("int").alias("said"))
    return s.groupBy("cell_name").agg(F.round(answers.f1(F.col("truth"), F.col("said")), 6).alias("f1"))


def normalised_texts(spark: SparkSession, d: str) -> DataFrame:
    """chunk texts brought into matching form, by length and hash."""
    c = load(spark, d, "chunk_rows").where("text is not null").select("chunk_id", X.normalise_for_match(F.col("text")).alias("norm")).distinct()
    return c.select("chunk_id", F.length("norm").alias("chars"), F.md5("norm").alias("digest"), F.size(X.blank_tokens(F.col("norm"))).alias("tokens"))


def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, "gold_evidence").where("text is not null").select("evidence_id", "text").distinct()
    grams = X.shingles(X.blank_tokens(X.normalise_for_match(F.col("text"))), 5)
    return g.select("evidence_id", F.size(grams).alias("n_shingles"), F.size(F.array_distinct(grams)).alias("n_distinct"))


def table_like_texts(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "built_chunks").where("text is not null").select("built_id", "text").distinct()
    return b.select("built_id", X.looks_like_table(F.col("text")).alias("table_like"), F.round(X.blank_line_ratio(F.col("text")), 6).alias("blank_ratio"), X.is_bulleted(F.col("text")).alias("bulleted"))


def tightened_tables(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "built_chunks").where("table_raw is not null").select("built_id", "table_raw").distinct()
    return b.select("built_id", F.md5(X.collapse_table_padding(F.col("table_raw"))).alias("digest"))


def text_shapes(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "documents").where("text is not null")
    c = F.col("text")
    return t.select("doc_id", X.word_count(c).alias("words"), X.sentence_count(c).alias("sentences"), F.round(X.alpha_ratio(c), 6).alias("alpha_ratio"), F.size(X.word_tokens(c)).alias("ascii_tokens"), (F.upper(c) == c).alias("all_caps"))


def block_kinds(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "documents").where("text is not null").select(F.explode(X.filled_lines(F.col("text"))).alias("line"))
    return t.groupBy(X.classify_block(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


def filename_families(spark: SparkSession, d: str) -> DataFrame:
    """File names read as policy labels: the family before a size part and the unit of the size."""
    t = load(spark, d, "documents").where("filename is not null").select(F.concat(F.lower(F.regexp_extract("filename", r"^([A-Z]+)_", 1)), F.lit("_w"), F.coalesce(F.col("page_count"), F.lit(0)).cast("string")).alias("label"))
    return t.groupBy(X.policy_family(F.col("label")).alias("family"), X.policy_unit(F.col("label")).alias("unit")).agg(F.count("*").alias("n"))


def clipped_quotes(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, "gold_evidence").where("text is not null").select("evidence_id", "text", "page_number").distinct()
    return g.select("evidence_id", X.clip(F.col("text")).alias("quote"), X.coerce_page(F.col("page_number").cast("string")).alias("page"))


QUERIES = {
    f.__name__: f
    for f in (
        refusal_signals, abstention_rates, label_agreement, label_spellings, answer_overlap, overlap_faithfulness, raga_overall, token_totals, provider_overview, latency_percentiles, latency_means,
        pass_threshold, refusal_f1, normalised_texts, shingle_counts, table_like_texts, tightened_tables, text_shapes, block_kinds, filename_families, clipped_quotes,
    )
}

_NET = "(?i)" + "|".join(X.REFUSAL_NET).replace("'", "''")
_MARKER = X.ABSTENTION_MARKER.lower()
_R = "r AS (SELECT DISTINCT * EXCLUDE (logged_at) FROM query_records)"
_S = f"{_R}, s AS (SELECT *, contains(lower(answer_text), '{_MARKER}') AS marker_match, regexp_matches(answer_text, '{_NET}') OR contains(lower(answer_text), '{_MARKER}') AS is_refusal FROM r WHERE linked AND answer_text IS NOT NULL)"
_TOK = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9]+')"
_OVER = f"""
    {_R}, t AS (SELECT record_id, cell_name, {_TOK("coalesce(answer_text, '')")} AS a, {_TOK('gold_answer')} AS g FROM r WHERE linked AND gold_answer IS NOT NULL),
    o AS (
        SELECT record_id, cell_name, a, g, list_distinct(a) AS da, list_distinct(g) AS dg,
               coalesce(list_sum(list_transform(list_distinct(g), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) AS same, len(list_intersect(list_distinct(a), list_distinct(g))) AS common FROM t),
    f AS (SELECT record_id, cell_name, CASE WHEN same > 0 THEN 2.0 * same / (len(a) + len(g)) ELSE 0.0 END AS token_f1, CASE WHEN common > 0 THEN common / sqrt(len(da)::DOUBLE * len(dg)) ELSE 0.0 END AS token_cosine FROM o)"""
_LINES = lambda c: f"list_filter(string_split_regex({c}, '\\r\\n|\\r|\\n'), lambda x: length(trim(regexp_replace(x, '[\\s\\p{{Z}}]+', ' ', 'g'))) > 0)"
_BULLET = X.BULLET_REGEX.replace("'", "''")
_BLANKS = r"[\s\p{Z}]+"

SQL = {
    "refusal_signals": f"WITH {_S} SELECT cell_name, count(*) AS n, count(*) FILTER (marker_match) AS marker_matches, count(*) FILTER (is_refusal) AS refusals FROM s GROUP BY 1",
    "abstention_rates": f"""
        WITH {_S}, c AS (SELECT cell_name, count(*) FILTER (NOT coalesce(answerable, true)) AS u, count(*) FILTER (coalesce(answerable, true)) AS a, count(*) FILTER (is_refusal AND NOT coalesce(answerable, true)) AS ru, count(*) FILTER (is_refusal) AS rf FROM s GROUP BY 1)
        SELECT cell_name, u AS n_unanswerable, a AS n_answerable, rf AS refused, round(ru / nullif(u, 0), 4) AS abstention_recall, round(ru / nullif(rf, 0), 4) AS abstention_precision, round((rf - ru) / nullif(a, 0), 4) AS over_abstention FROM c""",
    "label_agreement": f"""
        WITH {_R}, p AS (SELECT cell_name, CASE WHEN answer_text IS NOT NULL THEN regexp_matches(answer_text, '{_NET}') END AS a, CASE WHEN trim(answer_text, ' ') <> '' THEN regexp_matches(lower(answer_text), '(^|[^a-z])(no|not|cannot|unable)([^a-z]|$)') END AS b FROM r WHERE linked)
        SELECT cell_name, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n, round(avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a = b)::INT END), 6) AS agreement FROM p GROUP BY 1""",
    "label_spellings": f"WITH {_R} SELECT answerable::INT AS a, linked::INT AS b, count(*) AS n FROM r GROUP BY 1, 2",
    "answer_overlap": f"WITH {_OVER} SELECT cell_name, count(*) AS n, round(avg(token_f1), 6) AS token_f1, round(avg(token_cosine), 6) AS token_cosine FROM f GROUP BY 1",
    "overlap_faithfulness": f"""
        WITH {_R}, t AS (SELECT cell_name, list_distinct({_TOK('answer_text')}) AS a, {_TOK('gold_answer')} AS g FROM r WHERE linked AND answerable AND answer_text IS NOT NULL AND trim(answer_text, ' ') <> '' AND gold_answer IS NOT NULL),
        s AS (SELECT cell_name, CASE WHEN len(a) > 0 THEN len(list_intersect(a, g)) / len(a) END AS score FROM t)
        SELECT cell_name, count(*) AS n, round(avg(score), 6) AS score, round(avg((score >= 0.5)::INT), 6) AS strict_rate FROM s GROUP BY 1""",
    "raga_overall": f"""
        WITH {_OVER}, x AS (SELECT r.cell_name, round(avg(token_f1), 6) AS token_f1, round(avg(token_cosine), 6) AS token_cosine, count(token_f1) AS n_scored, count(*) AS n FROM r LEFT JOIN f USING (record_id) WHERE linked GROUP BY 1)
        SELECT *, round((token_f1 + token_cosine) / 2 + 1e-8, 5) AS overall FROM x""",
    "token_totals": f"""
        WITH {_R}, x AS (
            SELECT cell_name, count(*) AS n_answers, count(*) FILTER (tokens_input IS NOT NULL AND tokens_output IS NOT NULL) AS n_split, count(*) FILTER ((tokens_input IS NULL OR tokens_output IS NULL) AND tokens_total IS NOT NULL) AS n_total_only,
                   sum(tokens_input) FILTER (tokens_output IS NOT NULL)::BIGINT AS tokens_in, sum(tokens_output) FILTER (tokens_input IS NOT NULL)::BIGINT AS tokens_out,
                   coalesce(string_agg(DISTINCT provider, ',' ORDER BY provider), '') AS providers, coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') AS models FROM r WHERE linked GROUP BY 1)
        SELECT *, round(n_split / n_answers, 4) AS coverage, CASE WHEN n_split / n_answers >= 0.8 THEN round(tokens_in / n_split, 6) END AS mean_in, CASE WHEN n_split / n_answers >= 0.8 THEN round(tokens_out / n_split, 6) END AS mean_out FROM x""",
    "provider_overview": f"WITH {_R} SELECT cell_name, count(*) AS completions, coalesce(string_agg(DISTINCT provider, ',' ORDER BY provider), '') AS providers, coalesce(bool_and(provider = 'ollama'), false) AS local_only FROM r WHERE linked GROUP BY 1",
    "latency_percentiles": f"""
        WITH {_R}, x AS (SELECT cell_name, latency_ms, row_number() OVER (PARTITION BY cell_name ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY cell_name) AS n FROM r WHERE linked AND latency_ms > 0)
        SELECT cell_name, max(n) AS n, max(CASE WHEN i = round_even((0.5 * (n - 1))::DOUBLE, 0) THEN latency_ms END) AS p50, max(CASE WHEN i = round_even((0.95 * (n - 1))::DOUBLE, 0) THEN latency_ms END) AS p95 FROM x GROUP BY 1""",
    "latency_means": f"WITH {_R} SELECT cell_name, count(*) AS n, round(avg(latency_ms), 1) AS mean_latency_ms, round(avg(retrieval_latency_ms), 1) AS mean_retrieval_latency_ms, round(avg(rerank_latency_ms), 1) AS mean_rerank_latency_ms FROM r WHERE linked AND latency_ms > 0 GROUP BY 1",
    "pass_threshold": """
        WITH x AS (SELECT event_type, least(greatest(round(value, 2), 0), 100) / 100 AS prob FROM events WHERE value IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY prob) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM x)
        SELECT event_type, round(least(1.0, max(CASE WHEN i = ceil(0.95 * n) THEN prob END) + 1e-6), 6) AS threshold FROM o GROUP BY 1""",
    "refusal_f1": f"""
        WITH {_S}, c AS (SELECT cell_name, count(*) FILTER (is_refusal AND NOT answerable) AS tp, count(*) FILTER (is_refusal AND answerable) AS fp, count(*) FILTER (NOT is_refusal AND NOT answerable) AS fn FROM s GROUP BY 1)
        SELECT cell_name, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
    "normalised_texts": f"WITH n AS (SELECT DISTINCT chunk_id, {norm_sql('text')} AS norm FROM chunk_rows WHERE text IS NOT NULL) SELECT chunk_id, length(norm) AS chars, md5(norm) AS digest, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS tokens FROM n",
    "shingle_counts": f"""
        WITH g AS (SELECT DISTINCT evidence_id, string_split({norm_sql('text')}, ' ') AS t FROM gold_evidence WHERE text IS NOT NULL), s AS (SELECT evidence_id, CASE WHEN len(t) <= 5 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END AS g FROM g)
        SELECT evidence_id, len(g) AS n_shingles, len(list_distinct(g)) AS n_distinct FROM s""",
    "table_like_texts": f"""
        WITH b AS (SELECT DISTINCT built_id, text, {_LINES('text')} AS f, string_split_regex(text, '\\r\\n|\\r|\\n') AS l FROM built_chunks WHERE text IS NOT NULL),
        x AS (SELECT *, list_transform(f, lambda x: rtrim(x, ' ')) AS r FROM b)
        SELECT built_id, len(r) >= 2 AND (len(list_filter(r, lambda x: contains(x, '|'))) >= 2 OR len(list_filter(r, lambda x: contains(x, '  '))) >= greatest(2, floor(len(r) * 0.5)::INT)) AS table_like,
               CASE WHEN length(text) = 0 THEN 0.0 ELSE round(len(list_filter(l, lambda x: trim(regexp_replace(x, '{_BLANKS}', ' ', 'g'), ' ') = '')) / len(l), 6) END AS blank_ratio,
               len(list_filter(f, lambda x: regexp_matches(x, '{_BULLET}'))) > 0 AS bulleted FROM x""",
    "tightened_tables": r"SELECT DISTINCT built_id, md5(regexp_replace(regexp_replace(table_raw, '[ \t]{2,}', ' ', 'g'), '\n(?:[ \t]*\n){2,}', chr(10) || chr(10), 'g')) AS digest FROM built_chunks WHERE table_raw IS NOT NULL",
    "filename_families": r"""
        WITH l AS (SELECT lower(regexp_extract(filename, '^([A-Z]+)_', 1)) || '_w' || coalesce(page_count, 0) AS label FROM documents WHERE filename IS NOT NULL)
        SELECT regexp_replace(label, '_[wto][0-9]+.*$', '') AS family, CASE regexp_extract(label, '_([wt])[0-9]+', 1) WHEN 'w' THEN 'words' WHEN 't' THEN 'tokens' END AS unit, count(*) AS n FROM l GROUP BY 1, 2""",
    "clipped_quotes": f"""
        WITH g AS (SELECT DISTINCT evidence_id, trim(regexp_replace(text, '{_BLANKS}', ' ', 'g'), ' ') AS t, page_number FROM gold_evidence WHERE text IS NOT NULL)
        SELECT evidence_id, CASE WHEN length(t) > 70 THEN substring(t, 1, 70) || '...' ELSE t END AS quote, CASE WHEN page_number >= 1 THEN page_number ELSE 1 END AS page FROM g""",
    "text_shapes": rf"""
        WITH t AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '') AS s FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, len(list_filter(string_split(trim(regexp_replace(text, '{_BLANKS}', ' ', 'g'), ' '), ' '), lambda w: w <> '')) AS words, len(list_filter(s, lambda x: len(list_filter(string_split_regex(x, '{_BLANKS}'), lambda w: w <> '')) >= 5)) AS sentences,
               CASE WHEN length(regexp_replace(text, '{_BLANKS}', '', 'g')) > 0 THEN round(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / length(regexp_replace(text, '{_BLANKS}', '', 'g')), 6) ELSE 0 END AS alpha_ratio,
               len({_TOK('text')}) AS ascii_tokens, upper(text) = text AS all_caps FROM t""",
}
