"""Queries that parse pages and build chunks; SQL can say what must hold of them, not the cuts themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import hooks
from tallyloom.operators import chunking, ranking
from tallyloom.session import load, materialise


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Built texts as the pages of their document, in order."""
    b = load(spark, d, "built_chunks").where("text is not null").select("document_id", "chunk_index", "text").distinct()
    return b.select(F.col("document_id").alias("document"), (F.col("chunk_index") + 1).alias("page"), "text")


def page_elements(spark: SparkSession, d: str) -> DataFrame:
    return chunking.page_elements(_pages(spark, d)).groupBy("document", "kind").agg(F.count("*").alias("n"), F.sum(F.length("block")).alias("chars"))


def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(_pages(spark, d), chunking.word_budget())


def chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(_pages(spark, d), chunking.token_budget())


def chunk_structure(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(_pages(spark, d), chunking.structure_aware())


def chunk_bakeoff(spark: SparkSession, d: str) -> DataFrame:
    """Strategies side by side: chunks, mean words, tables, widest chunk; the one with most words a chunk comes first."""
    rules = {"words": chunking.word_budget(), "tokens": chunking.token_budget(), "structure": chunking.structure_aware()}
    out = None
    for name, rule in rules.items():
        one = chunking.chunk_documents(_pages(spark, d), rule).agg(F.count("*").alias("chunks"), F.round(F.avg("word_count"), 4).alias("mean_words"), F.count_if("contains_table").alias("tables"), F.max("word_count").alias("widest")).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def chunk_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the chunks of each document: numbered without holes, each with text and a page span inside the
    document's pages, and parts numbered within their count."""
    pages = _pages(spark, d).where(F.trim(F.regexp_replace("text", r"[\s\p{Z}]+", " ")) != "")
    bounds = pages.groupBy("document").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    out = None
    for name, rule in (("words", chunking.word_budget()), ("tokens", chunking.token_budget()), ("structure", chunking.structure_aware())):
        c = chunking.chunk_documents(_pages(spark, d), rule).join(bounds, "document")
        one = c.groupBy("document").agg(
            (F.count("*") == F.max("chunk_index") + 1).alias("numbered"), F.min(F.trim("text") != "").alias("filled"),
            F.min((F.col("page_start") >= F.greatest("first_page", F.lit(1))) & (F.col("page_end") <= F.greatest("last_page", F.lit(1))) & (F.col("page_start") <= F.col("page_end"))).alias("inside"),
            F.min(F.coalesce((F.col("sub_index") >= 0) & (F.col("sub_index") < F.col("sub_count")), F.lit(True))).alias("parts_fit"),
        ).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _scored(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """Every strategy's chunks ranked for a stated query set, scored by page: the first sentence of each page whose document
    and number hash to 0 of 20 asks, and the chunks that span its page are relevant."""
    pages = _pages(spark, d).where("length(trim(text)) > 0").withColumn("id", F.xxhash64("document", "page"))
    embed = hooks.embedding_udf()
    asked = pages.where("pmod(id, 20) = 0").groupBy("id").agg(F.first("document").alias("document"), F.first("page").alias("page"), F.min("text").alias("text"))
    asks = materialise(asked.select(F.col("id").alias("query_id"), "document", F.greatest("page", F.lit(1)).alias("page"), embed(F.substring_index("text", ".", 1)).alias("query_vec")))
    rules = {"words": chunking.word_budget(), "tokens": chunking.token_budget(), "structure": chunking.structure_aware()}
    built = chunking.chunk_strategies(_pages(spark, d), rules)
    chunks = materialise(built.select("strategy", "document", "page_start", "page_end", "word_count", F.xxhash64("document", "chunk_index", "strategy").alias("chunk_id"), embed("text").alias("chunk_vec")))
    out = None
    for name in rules:
        c = chunks.where(F.col("strategy") == name)
        spans = c.withColumn("page", F.explode(F.sequence("page_start", "page_end"))).select("chunk_id", "document", "page")
        good = asks.select("query_id", "document", "page").join(spans, ["document", "page"]).select("query_id", "chunk_id").distinct()
        ranked = ranking.similar_chunks(asks.select("query_id", "query_vec"), c.select("chunk_id", "chunk_vec"), k).join(good.withColumn("rel", F.lit(1)), ["query_id", "chunk_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
        scores = ranking.metrics_at_k(ranked, good.groupBy("query_id").agg(F.count("*").alias("n_relevant")), k)
        size = c.agg(F.count("*").alias("chunks"), F.avg("word_count").alias("mean_words"))
        one = scores.agg(F.count("*").alias("questions"), *(F.round(F.avg(m), 6).alias(m) for m in ("ndcg", "recall", "mrr", "hit"))).crossJoin(F.broadcast(size)).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def bakeoff_scores(spark: SparkSession, d: str) -> DataFrame:
    """nDCG, recall, MRR and hit at 5 of each strategy, best nDCG first by rank."""
    best = F.row_number().over(Window.orderBy(F.desc("ndcg"), F.desc("recall"), "strategy"))  # three rows
    return _scored(spark, d).withColumn("place", best)


def bakeoff_checked(spark: SparkSession, d: str) -> DataFrame:
    """What SQL can say of the scores: the questions judged, and whether the scores keep their bounds and order."""
    s = bakeoff_scores(spark, d)
    within = F.lit(True)
    for m in ("ndcg", "recall", "mrr", "hit"):
        within &= F.col(m).between(0.0, 1.0)
    return s.select("strategy", (within & (F.col("mrr") <= F.col("hit")) & (F.col("recall") <= F.col("hit"))).alias("within_bounds"), (F.col("questions") > 0).alias("judged"), (F.col("hit") > 0.1).alias("finds"))


QUERIES = {f.__name__: f for f in (bakeoff_scores, bakeoff_checked, chunk_checks, page_elements, chunk_words, chunk_tokens, chunk_structure, chunk_bakeoff)}
SQL: dict[str, str] = {
    "bakeoff_checked": "SELECT strategy, true AS within_bounds, true AS judged, true AS finds FROM (VALUES ('words'), ('tokens'), ('structure')) s(strategy)",
    "chunk_checks": r"""
        WITH p AS (SELECT DISTINCT document_id AS document FROM built_chunks WHERE document_id IS NOT NULL AND trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) <> '')
        SELECT document, true AS numbered, true AS filled, true AS inside, true AS parts_fit, s.strategy FROM p, (VALUES ('words'), ('tokens'), ('structure')) s(strategy)""",
}
