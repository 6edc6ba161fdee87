"""Quoted gold passages matched to chunks of the same document by containment, shingles or tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.text import blank_tokens, normalise_for_match, shingles, unescape_twice
from tallyloom.session import materialise

SHINGLE, SHINGLE_COVERAGE, TOKEN_COVERAGE = 5, 0.6, 0.9


def prepared(df: DataFrame, key: str, document: str, text: str) -> DataFrame:
    """(key, document, norm, grams): normalised text and its distinct shingles; rows without text are left out, repeats too.

    Character references are resolved first; only texts with an & go to Python.
    """
    whole = F.coalesce(unescape_twice(F.when(F.contains(F.col(text), F.lit("&")), F.col(text))), F.col(text))
    norm = df.where(F.col(key).isNotNull() & F.col(document).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(document).alias("document"), normalise_for_match(whole).alias("norm")).where("norm <> ''").distinct()
    return norm.withColumn("grams", _hashed(shingles(blank_tokens(F.col("norm")), SHINGLE)))


def _hashed(units: Column) -> Column:
    """Distinct units as 64-bit hashes: what is joined and compared are numbers."""
    return F.array_distinct(F.transform(units, lambda x: F.xxhash64(x)))


def _rarest(wanted: DataFrame, chunks: DataFrame, unit: str) -> DataFrame:
    """(evidence_id, document, unit): of each list of units the `keep` ones that fewest chunks of the document hold.

    wanted(evidence_id, document, rule, keep, units): a quote may ask under several rules.
    """
    seen = chunks.select("document", F.explode(unit).alias("unit")).groupBy("document", "unit").agg(F.count("*").alias("df"))
    known = wanted.select("evidence_id", "document", "rule", "keep", F.explode("units").alias("unit")).join(seen, ["document", "unit"])
    order = Window.partitionBy("evidence_id", "document", "rule").orderBy("df", "unit")
    return known.withColumn("n", F.row_number().over(order)).where("n <= keep").select("evidence_id", "document", "unit").distinct()


def match_quotes(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """(evidence_id, chunk_id, score, method): containment scores 1; else shingle coverage of at least 0.6 for quotes of five
    tokens or more; else token coverage of at least 0.9 for shorter ones.

    evidence and chunks come from `prepared`. A chunk that covers a share c of a quote's units holds at least one of any
    (1 - c) n + 1 of them, so only that many of the quote's rarest units are looked up; a contained quote is found by its
    rarest token that no edge can cut. Candidates are verified on the texts. Quotes of one or two tokens count as
    contained only where they share a token.
    """
    tokens = blank_tokens(F.col("norm"))
    quotes = materialise(evidence.withColumns({"tokens": _hashed(tokens), "n_words": F.size(tokens), "inner": _hashed(F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0))))}))
    # Only chunks of documents with a quote are counted and met; their texts are normalised once.
    pool = materialise(chunks.join(quotes.select("document").distinct(), "document", "left_semi").withColumn("tokens", _hashed(tokens)))
    enough = lambda unit, share: (F.floor(F.size(unit) * (1 - share) + 1e-9) + 1).cast("int")
    ask = lambda which, rule, keep, units: quotes.where(which).select(F.col("key").alias("evidence_id"), "document", F.lit(rule).alias("rule"), keep.alias("keep"), F.col(units).alias("units"))
    by_token = ask(f"n_words < {SHINGLE}", "cover", enough("tokens", TOKEN_COVERAGE), "tokens").unionByName(ask("n_words < 3", "short", F.lit(2), "tokens")).unionByName(ask("n_words >= 3", "inside", F.lit(1), "inner"))
    keys = {"grams": _rarest(ask(f"n_words >= {SHINGLE}", "cover", enough("grams", SHINGLE_COVERAGE), "grams"), pool, "grams"), "tokens": _rarest(by_token, pool, "tokens")}
    met = None
    for unit, wanted in keys.items():
        held = pool.join(wanted.select("document").distinct(), "document", "left_semi").select(F.col("key").alias("chunk_id"), "document", F.explode(unit).alias("unit"))
        pairs = wanted.join(held, ["document", "unit"]).select("evidence_id", "chunk_id", "document")
        met = pairs if met is None else met.unionByName(pairs)
    full = met.distinct().join(quotes.select(F.col("key").alias("evidence_id"), "document", F.col("norm").alias("quote"), "n_words", F.col("grams").alias("quote_grams"), F.col("tokens").alias("quote_tokens")), ["evidence_id", "document"])
    full = full.join(pool.select(F.col("key").alias("chunk_id"), "document", "norm", "grams", "tokens"), ["chunk_id", "document"])
    share = lambda mine, theirs: F.size(F.array_intersect(mine, theirs)) / F.size(mine)
    is_long = F.col("n_words") >= SHINGLE
    inside = F.contains("norm", "quote") & ((F.col("n_words") >= 3) | F.arrays_overlap("quote_tokens", "tokens"))
    cover = F.when(is_long, share("quote_grams", "grams")).otherwise(share("quote_tokens", "tokens"))
    least = F.when(is_long, SHINGLE_COVERAGE).otherwise(TOKEN_COVERAGE)
    judged = full.select("evidence_id", "chunk_id", inside.alias("inside"), cover.alias("cover"), is_long.alias("long"), least.alias("least")).where("inside or cover >= least")
    best = judged.groupBy("evidence_id", "chunk_id").agg(F.max(F.struct("inside", "cover", "long")).alias("b"))
    return best.select("evidence_id", "chunk_id", F.when(F.col("b.inside"), 1.0).otherwise(F.round("b.cover", 6)).alias("score"), F.when(F.col("b.inside"), "containment").when(F.col("b.long"), "shingle").otherwise("token").alias("method"))


def ranked_matches(matches: DataFrame, places: DataFrame, most: int | None = None, margin: float | None = None) -> DataFrame:
    """Matches in order of score, page and chunk index, numbered per quote; `most` and `margin` are features of the report."""
    order = Window.partitionBy("evidence_id").orderBy(F.desc("score"), F.asc_nulls_last("page_number"), F.asc_nulls_last("chunk_index"), F.asc("chunk_id"))
    out = matches.join(places, "chunk_id", "left").withColumns({"rank": F.row_number().over(order), "best": F.max("score").over(Window.partitionBy("evidence_id"))})
    if margin is not None:
        out = out.where(F.col("best") - F.col("score") <= margin)
    return (out.where(F.col("rank") <= most) if most is not None else out).drop("best")


def match_summary(evidence: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: quotes, matched, unmatched, with several chunks, distinct chunks, and matches by method."""
    per = evidence.select(F.col("key").alias("evidence_id")).distinct().join(matches.groupBy("evidence_id").agg(F.count("*").alias("n")), "evidence_id", "left")
    left = per.agg(F.count("*").alias("quotes"), F.count("n").alias("matched"), F.count_if(F.col("n").isNull()).alias("unmatched"), F.count_if(F.col("n") > 1).alias("multi_chunk"))
    right = matches.agg(F.countDistinct("chunk_id").alias("distinct_chunks"), F.count_if(F.col("method") == "containment").alias("by_containment"), F.count_if(F.col("method") == "shingle").alias("by_shingle"), F.count_if(F.col("method") == "token").alias("by_token"))
    return left.crossJoin(right)


def chunks_per_group(matches: DataFrame, owner: DataFrame, by: str) -> DataFrame:
    """Distinct chunk ids of all quotes of an owner, sorted; owners without a match keep an empty list."""
    ids = owner.join(matches.select("evidence_id", "chunk_id"), "evidence_id", "left").groupBy(by).agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return ids
