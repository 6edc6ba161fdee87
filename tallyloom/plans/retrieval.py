"""Queries on ranked retrieval, quotes and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.arrays import dot, l2_normalised
from tallyloom.operators import quotes, ranking
from tallyloom.session import load

K = 5


def _ranked(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked with rel, relevant counts, labels of the queries): every vector whose id is divisible by 20 asks all others."""
    vectors = load(spark, d, "embeddings").select("vec_id", "embedding", "label").where("embedding is not null")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    found = ranking.similar_chunks(asked, vectors.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("chunk_vec")), k)
    labels = vectors.select("vec_id", "label")
    mine, theirs = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), labels.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("chunk_label"))
    rel = ranking.relevance(F.col("query_label") == F.col("chunk_label"))
    ranked = found.join(mine, "query_id").join(theirs, "chunk_id").select("query_id", "chunk_id", "sim", "rank", rel.alias("rel"))
    size = labels.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    relevant = mine.where("query_id % 20 = 0").join(size, F.col("query_label") == F.col("label")).select("query_id", "n_relevant")
    return ranked, relevant, mine.where("query_id % 20 = 0")


def ir_metrics_by_cell(spark: SparkSession, d: str) -> DataFrame:
    ranked, relevant, labels = _ranked(spark, d, K)
    scores = ranking.metrics_at_k(ranked, relevant, K).join(labels, "query_id")
    return scores.groupBy(F.col("query_label").alias("cell")).agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(f"{m}_at_5") for m in ("recall", "mrr", "ndcg", "hit")))


def context_metrics(spark: SparkSession, d: str) -> DataFrame:
    ranked, relevant, _ = _ranked(spark, d, 10)
    found = ranking.context_metrics(ranked, relevant)
    return found.select("query_id", *(F.round(c, 6).alias(c) for c in ("context_precision", "context_recall", "context_relevancy")), "first_hit_rank")


def similarity_top_k(spark: SparkSession, d: str) -> DataFrame:
    ranked, _, _ = _ranked(spark, d, 50)
    return ranked.select("query_id", "chunk_id", F.round("sim", 6).alias("sim"), "rank")


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "embeddings")
    unit = l2_normalised(F.col("embedding"))
    return v.select("vec_id", F.round(dot(unit, unit), 6).alias("norm"), F.size("embedding").alias("dims"))


def served_pool_summary(spark: SparkSession, d: str) -> DataFrame:
    records = load(spark, d, "query_records").select("record_id", "cell_name", "linked", "top_n", "top_k").distinct()
    return ranking.pool_summary(records, "cell_name")


def right_version_by_order(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as served evidence: the dearest line's supplier governs, the cheapest one's is superseded."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    wanted = lines.groupBy(F.col("l_orderkey").alias("message_id")).agg(F.max_by("l_suppkey", F.struct("l_extendedprice", "l_linenumber")).alias("governing"), F.min_by("l_suppkey", F.struct("l_extendedprice", "l_linenumber")).alias("superseded"))
    served = lines.select(F.col("l_orderkey").alias("message_id"), F.col("l_suppkey").alias("document"), F.col("l_linenumber").alias("rank"))
    return ranking.right_version(served, wanted)


def served_rank(spark: SparkSession, d: str) -> DataFrame:
    from tallyloom.operators.linkage import served_ranks

    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("rerank"))
    return served_ranks(lines, "l_orderkey", "rerank", "l_discount", "l_linenumber").select("l_orderkey", "l_linenumber", "served_rank")


def _quote_match(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    gold, chunks = load(spark, d, "gold_evidence"), load(spark, d, "chunk_rows").where("text is not null")
    evidence, pool = quotes.prepared(gold, "evidence_id", "document_name", "text"), quotes.prepared(chunks, "chunk_id", "document_name", "text")
    return evidence, chunks, quotes.match_quotes(evidence, pool)


def gold_match(spark: SparkSession, d: str) -> DataFrame:
    return _quote_match(spark, d)[2]


def gold_match_ranked(spark: SparkSession, d: str) -> DataFrame:
    _, chunks, matches = _quote_match(spark, d)
    places = chunks.groupBy("chunk_id").agg(F.min("page_number").alias("page_number"), F.min("chunk_index").alias("chunk_index"))
    return quotes.ranked_matches(matches, places).select("evidence_id", "chunk_id", "score", "rank")


def gold_match_summary(spark: SparkSession, d: str) -> DataFrame:
    evidence, _, matches = _quote_match(spark, d)
    return quotes.match_summary(evidence, matches)


def gold_chunks_per_document(spark: SparkSession, d: str) -> DataFrame:
    evidence, _, matches = _quote_match(spark, d)
    owner = evidence.select(F.col("key").alias("evidence_id"), "document")
    lists = quotes.chunks_per_group(matches, owner, "document")
    return lists.select("document", F.array_join("chunk_ids", ",").alias("chunk_ids"))


def page_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Chunks in document order scored against the pages that gold quotes name."""
    chunks = load(spark, d, "chunk_rows").where("page_number is not null").groupBy("chunk_id").agg(F.min("document_name").alias("document"), F.min("page_number").alias("page_start"), F.min("chunk_index").alias("chunk_index")).withColumn("page_end", F.col("page_start"))
    gold = load(spark, d, "gold_evidence").where("page_number is not null").select(F.col("document_name").alias("document"), F.col("page_number").alias("page")).distinct()
    hits = ranking.page_relevant(chunks, gold).select("chunk_id", "document").withColumn("rel", F.lit(1))
    relevant = hits.groupBy(F.col("document").alias("query_id")).agg(F.count("*").alias("n_relevant"))
    # Only the first K of a document are kept, already before its chunks are shuffled.
    top = chunks.withColumn("rank", F.row_number().over(Window.partitionBy("document").orderBy("chunk_index", "chunk_id"))).where(F.col("rank") <= K)
    ranked = top.join(hits.select("chunk_id", "rel"), "chunk_id", "left").select(F.col("document").alias("query_id"), "rank", F.coalesce("rel", F.lit(0)).alias("rel"))
    scored = ranking.metrics_at_k(ranked, relevant, K)
    return scored.agg(F.count("*").alias("documents"), *(F.round(F.avg(m), 6).alias(m) for m in ("recall", "mrr", "ndcg", "hit")))


def served_context(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each building's file as a served list, rendered as one text, by length and hash."""
    from tallyloom.operators.context import rendered_context

    c = load(spark, d, "chunk_rows").where("text is not null").select("chunk_id", "document_name", "page_number", "chunk_index", "text").distinct()
    shown = rendered_context(c.withColumn("at", F.struct("chunk_index", "chunk_id")), "document_name", "at", "document_name", "page_number", "text")
    return shown.select("message_id", "n_passages", F.length("context").alias("chars"), F.md5("context").alias("digest"))


def documents_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Quoted document names found among the chunked ones, by each rule of matching."""
    from tallyloom.operators.context import basename, name_matches

    wanted = load(spark, d, "gold_evidence").where("document_name is not null").select(F.concat(F.lit("files/"), F.upper("document_name")).alias("wanted")).distinct()
    names = load(spark, d, "chunk_rows").select(F.col("document_name").alias("name")).distinct()
    met = wanted.withColumn("k", F.lower(basename(F.col("wanted")))).join(names.withColumn("k", F.lower(basename(F.col("name")))), "k")
    return met.agg(*(F.count_if(name_matches(F.col("name"), F.col("wanted"), how)).alias(how) for how in ("exact", "casefold", "basename")))


QUERIES = {
    f.__name__: f
    for f in (
        ir_metrics_by_cell, context_metrics, similarity_top_k, unit_vectors, served_pool_summary, right_version_by_order, served_rank, gold_match, gold_match_ranked,
        gold_match_summary, gold_chunks_per_document, page_relevance, served_context, documents_by_name,
    )
}


def _ranked_sql(k: int) -> str:
    return f"""
    v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE embedding IS NOT NULL),
    q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS query_label, (q.label = c.label)::INT AS rel, round(list_dot_product(q.e, c.e), 9) AS sim FROM q JOIN v c ON q.vec_id <> c.vec_id),
    ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM s) WHERE rank <= {k}),
    relevant AS (SELECT q.vec_id AS query_id, q.label AS query_label, (SELECT count(*) FROM v WHERE v.label = q.label) - 1 AS n_relevant FROM q)"""


_METRICS = """
    top AS (SELECT query_id, sum(rel) AS hits, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(rel / log2(rank + 1.0)) AS dcg FROM ranked WHERE rank <= 5 GROUP BY 1),
    scored AS (
        SELECT r.*, coalesce(hits, 0) / n_relevant AS recall, coalesce(1.0 / first, 0.0) AS mrr,
               coalesce(dcg, 0.0) / list_sum(list_transform(range(1, least(5, n_relevant)::BIGINT + 1), lambda i: 1.0 / log2(i + 1.0))) AS ndcg, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS hit
        FROM relevant r LEFT JOIN top USING (query_id) WHERE n_relevant > 0)"""


def norm_sql(c: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace({c}, '<[^>]+>', ' ', 'g')), '[^\p{{L}}\p{{N}}./%:]+', ' ', 'g'))"


_MATCHES = rf"""
    e AS (SELECT DISTINCT evidence_id, document_name AS document, {norm_sql('text')} AS norm FROM gold_evidence WHERE text IS NOT NULL AND document_name IS NOT NULL),
    ev AS (SELECT *, string_split(norm, ' ') AS toks FROM e WHERE norm <> ''),
    c AS (SELECT DISTINCT chunk_id, document_name AS document, {norm_sql('text')} AS norm FROM chunk_rows WHERE text IS NOT NULL AND document_name IS NOT NULL),
    ch AS (SELECT *, string_split(norm, ' ') AS toks FROM c WHERE norm <> ''),
    eg AS (SELECT *, list_distinct(CASE WHEN len(toks) <= 5 THEN [norm] ELSE list_transform(range(1, len(toks) - 3), lambda i: array_to_string(toks[i:i + 4], ' ')) END) AS grams FROM ev),
    cg AS (SELECT *, list_distinct(CASE WHEN len(toks) <= 5 THEN [norm] ELSE list_transform(range(1, len(toks) - 3), lambda i: array_to_string(toks[i:i + 4], ' ')) END) AS grams FROM ch),
    p AS (
        SELECT evidence_id, chunk_id, contains(cg.norm, eg.norm) AS inside, len(eg.toks) >= 5 AS long, len(eg.toks) AS words,
               len(list_intersect(eg.grams, cg.grams)) / len(eg.grams) AS gram_cover, len(list_intersect(list_distinct(eg.toks), cg.toks)) / len(list_distinct(eg.toks)) AS token_cover
        FROM eg JOIN cg USING (document)),
    matches AS (
        SELECT evidence_id, chunk_id, CASE WHEN inside THEN 1.0 ELSE round(CASE WHEN long THEN gram_cover ELSE token_cover END, 6) END AS score,
               CASE WHEN inside THEN 'containment' WHEN long THEN 'shingle' ELSE 'token' END AS method
        FROM p
        WHERE inside AND (words >= 3 OR token_cover > 0) OR (long AND gram_cover >= 0.6) OR (NOT long AND token_cover >= 0.9))"""

SQL = {
    "ir_metrics_by_cell": f"WITH {_ranked_sql(5)}, {_METRICS} SELECT query_label AS cell, count(*) AS n, round(avg(recall), 6) AS recall_at_5, round(avg(mrr), 6) AS mrr_at_5, round(avg(ndcg), 6) AS ndcg_at_5, round(avg(hit), 6) AS hit_at_5 FROM scored GROUP BY 1",
    "context_metrics": f"""
        WITH {_ranked_sql(10)},
        run AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM ranked),
        per AS (SELECT query_id, sum(CASE WHEN rel = 1 THEN so_far / rank END) AS ap, sum(rel) AS hits, avg(sim) AS rl, min(CASE WHEN rel = 1 THEN rank END) AS first_hit_rank FROM run GROUP BY 1)
        SELECT query_id, round(coalesce(ap / nullif(hits, 0), 0), 6) AS context_precision, round(coalesce(hits, 0) / n_relevant, 6) AS context_recall, round(rl, 6) AS context_relevancy, first_hit_rank
        FROM relevant LEFT JOIN per USING (query_id) WHERE n_relevant > 0""",
    "similarity_top_k": f"WITH {_ranked_sql(50)} SELECT query_id, chunk_id, round(sim, 6) AS sim, rank FROM ranked",
    "unit_vectors": """
        WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM n)
        SELECT vec_id, round(list_dot_product(u, u), 6) AS norm, len(u) AS dims FROM u""",
    "served_pool_summary": """
        WITH r AS (SELECT DISTINCT record_id, cell_name, linked, top_n, top_k FROM query_records WHERE linked),
        h AS (SELECT cell_name, string_agg(top_n || ':' || n, ' ' ORDER BY top_n) AS top_n_values FROM (SELECT cell_name, top_n, count(*) AS n FROM r WHERE top_n IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
        SELECT cell_name, count(*) AS n_records, count(top_n) AS n_with_top_n, count(*) - count(top_n) AS n_missing_top_n, min(top_n) AS top_n_min, max(top_n) AS top_n_max, min(top_k) AS top_k_min, max(top_k) AS top_k_max, any_value(top_n_values) AS top_n_values
        FROM r LEFT JOIN h USING (cell_name) GROUP BY 1""",
    "right_version_by_order": """
        WITH w AS (SELECT l_orderkey, arg_max(l_suppkey, (l_extendedprice, l_linenumber)) AS g, arg_min(l_suppkey, (l_extendedprice, l_linenumber)) AS s FROM lineitem GROUP BY 1),
        r AS (SELECT l_orderkey, min(CASE WHEN l_suppkey = g THEN l_linenumber END) AS good, min(CASE WHEN l_suppkey = s THEN l_linenumber END) AS old FROM lineitem JOIN w USING (l_orderkey) GROUP BY 1)
        SELECT l_orderkey AS message_id, (good IS NOT NULL AND (old IS NULL OR good < old))::INT AS right_version FROM r""",
    "served_rank": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_tax > 0.02 THEN l_tax END DESC NULLS LAST, l_discount DESC NULLS LAST, l_linenumber) - 1 AS served_rank FROM lineitem",
    "gold_match": f"WITH {_MATCHES} SELECT * FROM matches",
    "gold_match_ranked": f"""
        WITH {_MATCHES}, place AS (SELECT chunk_id, min(page_number) AS page_number, min(chunk_index) AS chunk_index FROM chunk_rows WHERE text IS NOT NULL GROUP BY 1)
        SELECT evidence_id, chunk_id, score, row_number() OVER (PARTITION BY evidence_id ORDER BY score DESC, page_number NULLS LAST, chunk_index NULLS LAST, chunk_id) AS rank FROM matches LEFT JOIN place USING (chunk_id)""",
    "gold_match_summary": f"""
        WITH {_MATCHES}, per AS (SELECT evidence_id, count(chunk_id) AS n FROM (SELECT DISTINCT evidence_id FROM ev) LEFT JOIN matches USING (evidence_id) GROUP BY 1)
        SELECT count(*) AS quotes, count(*) FILTER (n > 0) AS matched, count(*) FILTER (n = 0) AS unmatched, count(*) FILTER (n > 1) AS multi_chunk, (SELECT count(DISTINCT chunk_id) FROM matches) AS distinct_chunks,
               (SELECT count(*) FROM matches WHERE method = 'containment') AS by_containment, (SELECT count(*) FROM matches WHERE method = 'shingle') AS by_shingle, (SELECT count(*) FROM matches WHERE method = 'token') AS by_token FROM per""",
    "gold_chunks_per_document": f"""
        WITH {_MATCHES} SELECT document, coalesce(string_agg(DISTINCT chunk_id, ',' ORDER BY chunk_id), '') AS chunk_ids FROM (SELECT DISTINCT evidence_id, document FROM ev) LEFT JOIN matches USING (evidence_id) GROUP BY 1""",
    "page_relevance": f"""
        WITH c AS (SELECT chunk_id, min(document_name) AS document, min(page_number) AS page, min(chunk_index) AS chunk_index FROM chunk_rows WHERE page_number IS NOT NULL GROUP BY 1),
        g AS (SELECT DISTINCT document_name AS document, page_number AS page FROM gold_evidence WHERE page_number IS NOT NULL),
        ranked AS (SELECT c.document AS query_id, row_number() OVER (PARTITION BY c.document ORDER BY chunk_index, chunk_id) AS rank, (g.page IS NOT NULL)::INT AS rel FROM c LEFT JOIN g ON c.document = g.document AND c.page = g.page),
        relevant AS (SELECT query_id, sum(rel) AS n_relevant FROM ranked GROUP BY 1), {_METRICS}
        SELECT count(*) AS documents, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(hit), 6) AS hit FROM scored""",
    "served_context": r"""
        WITH c AS (SELECT DISTINCT chunk_id, document_name, page_number, chunk_index, text FROM chunk_rows WHERE text IS NOT NULL),
        p AS (SELECT document_name, chunk_index, chunk_id, CASE WHEN page_number IS NOT NULL THEN 'Page ' || page_number || ': ' ELSE '' END || text AS t FROM c),
        g AS (SELECT document_name, count(*) AS n, 'Document: ' || document_name || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY chunk_index, chunk_id) AS x FROM p GROUP BY 1)
        SELECT document_name AS message_id, n AS n_passages, length(x) AS chars, md5(x) AS digest FROM g""",
    "documents_by_name": """
        WITH w AS (SELECT DISTINCT 'files/' || upper(document_name) AS wanted FROM gold_evidence WHERE document_name IS NOT NULL), n AS (SELECT DISTINCT document_name AS name FROM chunk_rows)
        SELECT count(*) FILTER (name = wanted) AS "exact", count(*) FILTER (lower(name) = lower(wanted)) AS casefold, count(*) AS basename FROM w JOIN n ON lower(regexp_replace(wanted, '^.*/', '')) = lower(regexp_replace(name, '^.*/', ''))""",
}
