"""Ranked retrieval: similarity, metrics at k, context metrics, pools, page relevance and version order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.arrays import dot

#: The most query vectors that are sent to every task; more go block by block.
QUERY_BLOCK = 4096
#: Chunks that are multiplied with a block of queries at once.
CHUNK_TILE = 2048
#: Products further apart than this never round to the same 9 digits.
ROUNDING = 1.1e-9


def _steady(vec: Column, dims: int) -> Column:
    """Vectors of `dims` numbers that are there and of a size that single precision holds."""
    return F.coalesce((F.size(vec) == dims) & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < 1e15)), F.lit(False))


def _k_best(asker: np.ndarray, exact: np.ndarray, ids: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that can be among the k best of their asker, the k-th best product of each of n askers).

    Products are compared before they are rounded to 9 digits: those that round to less than the k-th best are left out,
    and of equal ones the k smallest ids stay.
    """
    order = np.lexsort((ids, -exact, asker))
    q, d = asker[order], exact[order]
    at = np.arange(len(q))
    new_q = np.r_[True, q[1:] != q[:-1]]
    new_d = new_q | np.r_[True, d[1:] != d[:-1]]
    kth = np.full(n, -np.inf)
    last = at - np.maximum.accumulate(np.where(new_q, at, 0)) == k - 1
    kth[q[last]] = d[last]
    keep = (at - np.maximum.accumulate(np.where(new_d, at, 0)) < k) & (d >= kth[q] - ROUNDING)
    return order[keep], kth


def _nearest(query_ids: np.ndarray, queries: np.ndarray, batches: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, chunk, dot) of all that can be among the k best of a query, over (ids, vectors) of chunks.

    A product in single precision finds the candidates, with its error allowed for; their dot products are then added up
    in double precision and in order, as `dot` does.
    """
    n, dims = queries.shape
    exact_q, narrow_q = queries.astype(np.float64), queries.astype(np.float32)
    norm_q = np.sqrt((exact_q * exact_q).sum(axis=1))
    asker, exact, found, kth = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, query_ids.dtype), np.full(n, -np.inf)
    for all_ids, all_vectors in batches:
        for start in range(0, len(all_ids), CHUNK_TILE):
            ids, exact_c = all_ids[start : start + CHUNK_TILE], all_vectors[start : start + CHUNK_TILE].astype(np.float64)
            near = narrow_q @ exact_c.astype(np.float32).T
            for j in np.flatnonzero(np.isin(ids, query_ids)):
                near[query_ids == ids[j], j] = -np.inf
            off = (dims + 8) * 2.0**-23 * norm_q * np.sqrt((exact_c * exact_c).sum(axis=1).max()) + 1e-25
            floor = kth
            if len(ids) > k and np.isneginf(kth).any():
                floor = np.maximum(kth, np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k] - off)
            least = (floor - off - 2 * ROUNDING).astype(np.float32)
            q, c = np.divmod(np.flatnonzero(near >= np.nextafter(np.maximum(least, np.finfo(np.float32).min), np.float32(-np.inf))[:, None]), len(ids))
            q, c = q[near[q, c] > -np.inf], c[near[q, c] > -np.inf]
            if not len(q):
                continue
            sums = np.zeros(len(q))
            for i in range(dims):
                sums += exact_q[q, i] * exact_c[c, i]
            asker, exact, found = np.r_[asker, q], np.r_[exact, sums], np.r_[found, ids[c]]
            keep, kth = _k_best(asker, exact, found, k, n)
            asker, exact, found = asker[keep], exact[keep], found[keep]
    return query_ids[asker], found, exact


def _searched(queries: DataFrame, chunks: DataFrame, k: int, dims: int) -> DataFrame:
    """(query_id, chunk_id, sim) of candidates: each task multiplies its chunks with one block of queries and hands on k rows a query."""
    held = queries.select("query_id", "query_vec").toArrow()
    wide = pa.float64() if queries.schema["query_vec"].dataType.elementType.typeName() == "double" or chunks.schema["chunk_vec"].dataType.elementType.typeName() == "double" else pa.float32()

    def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return np.asarray(flat.flatten().cast(wide)).reshape(-1, dims)

    block = queries.sparkSession.sparkContext.broadcast((np.asarray(held["query_id"].cast(pa.int64())), matrix(held["query_vec"])))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = block.value
        found = _nearest(ids, vectors, ((np.asarray(b.column(0).cast(pa.int64())), matrix(b.column(1))) for b in batches if b.num_rows), k)
        for start in range(0, len(found[0]), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(x[start : start + 65536]) for x in found], ["query_id", "chunk_id", "dot"])

    out = chunks.select("chunk_id", "chunk_vec").mapInArrow(search, "query_id bigint, chunk_id bigint, dot double")
    return out.select(*(F.col(c).cast(df.schema[c].dataType).alias(c) for c, df in (("query_id", queries), ("chunk_id", chunks))), F.round("dot", 9).alias("sim"))


def similar_chunks(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, sim, rank) of the k most similar chunks, ranks from 1, ties by chunk id.

    A stated query set against all vectors: queries(query_id, query_vec) go out in blocks of bounded size; a task keeps
    its own k best per query before anything is shuffled, so what moves is k rows a query and task. Whole-number ids and
    vectors of one length are multiplied as matrices; pairs of anything else are taken one by one.
    """
    sim = F.round(dot(F.col("query_vec"), F.col("chunk_vec")), 9)
    whole = {"tinyint", "smallint", "int", "bigint"}
    plain = {queries.schema["query_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()} <= whole
    plain &= {queries.schema["query_vec"].dataType.simpleString(), chunks.schema["chunk_vec"].dataType.simpleString()} <= {"array<float>", "array<double>"}
    width = F.size("query_vec")
    size, least, dims = queries.agg(F.count("*"), F.min(width), F.max(width)).first()
    plain = plain and size > 0 and least == dims > 0 and queries.where(F.col("query_id").isNull() | ~_steady(F.col("query_vec"), dims)).isEmpty()
    out = None
    for block in range(max(1, -(-size // QUERY_BLOCK))):
        mine = queries if size <= QUERY_BLOCK else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-size // QUERY_BLOCK))) == block)
        rest = chunks
        if plain:
            steady = F.col("chunk_id").isNotNull() & _steady(F.col("chunk_vec"), dims)
            found, rest = _searched(mine, chunks.where(steady), k, dims), chunks.where(~steady)
            out = found if out is None else out.unionByName(found)
        pairs = rest.crossJoin(F.broadcast(mine)).where("query_id <> chunk_id").select("query_id", "chunk_id", sim.alias("sim"))
        out = pairs if out is None else out.unionByName(pairs)
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.asc("chunk_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def metrics_at_k(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per judged query: recall, mrr, ndcg, hit at k. ranked(query_id, rank from 1, rel), relevant(query_id, n_relevant).

    Only queries with something relevant are judged; one that was served nothing scores 0.
    """
    top = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(
        F.sum("rel").alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant").cast("int"))), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0))
    judged = relevant.where("n_relevant > 0").join(top, "query_id", "left")
    return judged.select(
        "query_id",
        (F.coalesce("hits", F.lit(0)) / F.col("n_relevant")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"),
    )


def context_metrics(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Per judged query: average precision divided by the hits, recall over what was served, mean score served."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = ranked.withColumn("so_far", F.sum("rel").over(order))
    per = run.groupBy("query_id").agg(
        F.sum(F.when(F.col("rel") == 1, F.col("so_far") / F.col("rank"))).alias("ap"), F.sum("rel").alias("hits"), F.avg("sim").alias("context_relevancy"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_hit_rank")
    )
    return relevant.where("n_relevant > 0").join(per, "query_id", "left").select(
        "query_id",
        F.coalesce(F.try_divide("ap", "hits"), F.lit(0.0)).alias("context_precision"),
        (F.coalesce("hits", F.lit(0)) / F.col("n_relevant")).alias("context_recall"),
        "context_relevancy",
        "first_hit_rank",
    )


def pool_summary(records: DataFrame, by: str) -> DataFrame:
    """Widths of the served pools of linked records per cell: counts, bounds and how often each top_n occurred."""
    rows = records.where("linked")
    widths = rows.where("top_n is not null").groupBy(by, "top_n").agg(F.count("*").alias("n"))
    histogram = widths.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top_n", "n"))), lambda x: F.concat_ws(":", x["top_n"], x["n"])), " ").alias("top_n_values"))
    counts = rows.groupBy(by).agg(
        F.count("*").alias("n_records"), F.count("top_n").alias("n_with_top_n"), F.count_if(F.col("top_n").isNull()).alias("n_missing_top_n"),
        F.min("top_n").alias("top_n_min"), F.max("top_n").alias("top_n_max"), F.min("top_k").alias("top_k_min"), F.max("top_k").alias("top_k_max"),
    )
    return counts.join(histogram, by, "left")


def right_version(served: DataFrame, wanted: DataFrame) -> DataFrame:
    """served(message_id, document, rank), wanted(message_id, governing, superseded): message_id, right_version 0 or 1.

    Right where the governing document was served, and before the superseded one if that was served too.
    """
    ranks = wanted.join(served, "message_id", "left").groupBy("message_id").agg(
        F.min(F.when(F.col("document") == F.col("governing"), F.col("rank"))).alias("good"), F.min(F.when(F.col("document") == F.col("superseded"), F.col("rank"))).alias("old")
    )
    return ranks.select("message_id", F.coalesce((F.col("good").isNotNull() & (F.col("old").isNull() | (F.col("good") < F.col("old")))).cast("int"), F.lit(0)).alias("right_version"))


def page_relevant(chunks: DataFrame, gold_pages: DataFrame) -> DataFrame:
    """Chunks whose page span holds a gold page of their document; chunks(document, page_start, page_end), gold(document, page).

    Spans are short, so a chunk lists its pages and meets the gold pages by equality.
    """
    pages = chunks.where("page_start is not null and page_end >= page_start").withColumn("page", F.explode(F.sequence("page_start", "page_end")))
    return chunks.join(pages.join(gold_pages.select("document", "page").distinct(), ["document", "page"], "left_semi").select("chunk_id").distinct(), "chunk_id", "left_semi")


def relevance(flag: Column) -> Column:
    return F.coalesce(flag.cast("int"), F.lit(0))
