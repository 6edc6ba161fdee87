"""Measurements of an ingest: time spans, token estimates and counts, build logs, chunking policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.spans import union_runs

CHARS_PER_TOKEN = 4.0


def documents_with_chunks(documents: DataFrame, chunks: DataFrame, key: str, policy: Column | None = None) -> DataFrame:
    """Every document with its chunk count, characters, and first and last stamp; one without (matching) chunks keeps its row.

    chunks(key, chunk_chars, chunk_at). Chunks are filtered and summed before they meet the documents.
    """
    side = chunks if policy is None else chunks.where(policy)
    sums = side.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_chunks"), F.sum("chunk_chars").alias("chars"), F.min("chunk_at").alias("first_chunk"), F.max("chunk_at").alias("last_chunk"))
    return documents.join(sums, key, "left").withColumns({"n_chunks": F.coalesce("n_chunks", F.lit(0)), "chars": F.coalesce("chars", F.lit(0))})


def stretch(basis: str, created: str = "created_us", first: str = "first_us", last: str = "last_us") -> tuple[Column, Column]:
    """Start and end of a document's ingest: lifecycle (created to last chunk), chunks (first to last), first_touch (created to first)."""
    pairs = {"lifecycle": (created, last), "chunks": (first, last), "first_touch": (created, first)}
    if basis not in pairs:
        raise ValueError(f"basis must be one of {sorted(pairs)}")
    return tuple(F.col(c) for c in pairs[basis])


def ingest_span(documents: DataFrame, by: list[str], basis: str, max_s: float | None = None) -> DataFrame:
    """Seconds of ingest per group: stretches merged where they overlap, and their plain sum; overruns are cut to max_s."""
    start, end = stretch(basis)
    rows = documents.where(start.isNotNull() & end.isNotNull() & (end > start)).select(*by, start.alias("lo"), (F.least(end, start + int(max_s * 1e6)) if max_s else end).alias("hi"))
    plain = rows.groupBy(*by).agg(F.count("*").alias("n_docs"), F.round(F.sum((F.col("hi") - F.col("lo")) / 1e6), 6).alias("sum_s"))
    # Equal starts keep the longest stretch before anything is ordered.
    merged = union_runs(rows.groupBy(*by, "lo").agg(F.max("hi").alias("hi")), *by)
    spans = merged.groupBy(*by).agg(F.count("*").alias("n_periods"), F.round(F.sum((F.col("hi") - F.col("lo")) / 1e6), 6).alias("span_s"))
    return plain.join(spans, by)


def token_estimate(documents: DataFrame, by: list[str], chars: str, passes: int = 1) -> DataFrame:
    """Tokens by characters: sum / 4 per pass, in millions."""
    return documents.groupBy(*by).agg(F.count("*").alias("n_docs"), F.round(F.sum(chars) / CHARS_PER_TOKEN * passes / 1e6, 8).alias("mtok"))


def token_counts(chunks: DataFrame, by: list[str], count: str, chars: Column, least_coverage: float = 0.95) -> DataFrame:
    """Logged counts where enough chunks have one, else the estimate: n_chunks, coverage, tokens, source."""
    sums = chunks.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.count(count).alias("n_counted"), F.sum(count).alias("logged"), F.sum(chars).alias("chars"))
    share = F.coalesce(F.try_divide(F.col("n_counted").cast("double"), F.col("n_chunks").cast("double")), F.lit(0.0))
    enough = share >= least_coverage
    return sums.select(*by, "n_chunks", F.round(share, 6).alias("coverage"), F.round(F.when(enough, F.col("logged").cast("double")).otherwise(F.col("chars") / CHARS_PER_TOKEN), 4).alias("tokens"), F.when(enough, "logged").otherwise("estimate").alias("token_source"))


def latest_builds(runs: DataFrame, key: str, at: str, run: str, columns: list[str], which: str = "latest") -> DataFrame:
    """The latest or first build of each document; builds without a stamp come before all others."""
    order = F.struct(F.col(at).isNotNull().alias("has"), F.col(at).alias("at"), F.col(run).alias("run"))
    pick = F.max_by if which == "latest" else F.min_by
    order = order if which == "latest" else F.struct(F.col(at).isNull().alias("has"), F.col(at).alias("at"), F.col(run).alias("run"))
    return runs.where(F.col(key).isNotNull()).groupBy(key).agg(pick(F.struct(*columns), order).alias("_b"), F.count("*").alias("n_runs")).select(key, "n_runs", "_b.*")


def build_totals(builds: DataFrame, by: list[str], ms: list[str]) -> DataFrame:
    """Hours and distinct policies over the kept builds."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in ms[1:]), F.coalesce(F.col(ms[0]), F.lit(0)))
    return builds.groupBy(*by).agg(F.count("*").alias("n_docs"), F.round(F.sum(total) / 3_600_000, 8).alias("hours"), F.array_join(F.array_sort(F.collect_set("policy")), ",").alias("policies"))


def policy_verdict(found: Column, expected: Column) -> Column:
    """unmeasured, unlabelled, mixed, mismatch or ok, from the distinct policies found (an array) and the one expected."""
    labelled = F.filter(found, lambda p: p.isNotNull() & (p != ""))
    return (
        F.when(found.isNull() | (F.size(found) == 0), "unmeasured").when(F.size(labelled) == 0, "unlabelled").when(F.size(labelled) > 1, "mixed")
        .when(F.element_at(labelled, 1) != expected, "mismatch").otherwise("ok")
    )


def prefer(measured: Column, declared: Column, upper_bound: Column | None = None) -> tuple[Column, Column]:
    """A measured quantity before a declared one; an upper bound only where nothing was declared. Value and provenance."""
    bound = upper_bound if upper_bound is not None else F.lit(False)
    exact = measured.isNotNull() & ~bound
    value = F.when(exact, measured).otherwise(F.coalesce(declared, measured))
    source = F.when(exact, "measured").when(declared.isNotNull(), "declared").when(measured.isNotNull(), "upper bound").otherwise("missing")
    return value, source
