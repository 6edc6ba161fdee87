"""Scores of answers: abstention, agreement, overlap with gold, gates, tokens and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.text import bound, coverage, marker_match, refused_by_net, word_tokens


def refusal_signals(records: DataFrame) -> DataFrame:
    """Adds marker_match and is_refusal to the linked records that have an answer."""
    answer = F.col("answer_text")
    return records.where("linked and answer_text is not null").withColumns({"marker_match": marker_match(answer), "is_refusal": refused_by_net(answer) | marker_match(answer)})


def abstention_rates(signals: DataFrame, by: str) -> DataFrame:
    """Recall, precision and over-abstention of refusing per cell; null where a denominator is 0."""
    refused, unanswerable = F.col("is_refusal"), ~F.coalesce(F.col("answerable"), F.lit(True))
    counts = signals.groupBy(by).agg(
        F.count_if(unanswerable).alias("n_unanswerable"), F.count_if(~unanswerable).alias("n_answerable"), F.count_if(refused & unanswerable).alias("refused_unanswerable"), F.count_if(refused).alias("refused")
    )
    rate = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 4)
    return counts.select(
        by, "n_unanswerable", "n_answerable", "refused",
        rate(F.col("refused_unanswerable"), F.col("n_unanswerable")).alias("abstention_recall"),
        rate(F.col("refused_unanswerable"), F.col("refused")).alias("abstention_precision"),
        rate(F.col("refused") - F.col("refused_unanswerable"), F.col("n_answerable")).alias("over_abstention"),
    )


def raw_agreement(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """n and the share of equal labels over the rows with both; null share where there are none."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return pairs.groupBy(*(by or [])).agg(F.count_if(both).alias("n"), F.avg(F.when(both, (F.col(a) == F.col(b)).cast("double"))).alias("agreement"))


def token_overlap(records: DataFrame, key: str, answer: str = "answer_text", gold: str = "gold_answer") -> DataFrame:
    """Token F1 (with multiplicity) and cosine of token sets per record with a gold answer; 0 without overlap."""
    pair = F.struct(word_tokens(F.coalesce(F.col(answer), F.lit(""))).alias("a"), word_tokens(F.col(gold)).alias("g"))

    def scores(p: Column) -> Column:
        a, g = p["a"], p["g"]
        same = F.aggregate(F.array_distinct(g), F.lit(0), lambda acc, w: acc + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(g, lambda x: x == w))))
        both = F.size(F.array_intersect(F.array_distinct(a), F.array_distinct(g)))
        f1 = F.when(same > 0, 2.0 * same / (F.size(a) + F.size(g))).otherwise(F.lit(0.0))
        cosine = F.when(both > 0, both / F.sqrt(F.size(F.array_distinct(a)).cast("double") * F.size(F.array_distinct(g)))).otherwise(F.lit(0.0))
        return F.struct(f1.alias("token_f1"), cosine.alias("token_cosine"))

    return records.where(F.col(gold).isNotNull()).select(key, bound(pair, scores).alias("_s")).select(key, "_s.token_f1", "_s.token_cosine")


def overlap_faithfulness(records: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """A deterministic stand-in for a span detector: share of answer tokens that the reference text holds, and a strict flag."""
    share = coverage(word_tokens(F.col("answer_text")), word_tokens(F.col("reference")))
    scored = records.where("answer_text is not null and trim(answer_text) <> '' and reference is not null").select(F.col(key).alias("key"), share.alias("score"))
    return scored.select(F.col("key").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("faithful"))


def span_faithfulness(spans: Column, answer: Column, threshold: float, limit: int = 0) -> Column:
    """From a detector's spans (start, end, confidence): 1 - flagged characters / answer length, and whether it passes."""
    strong = F.filter(spans, lambda s: s["confidence"] >= threshold)
    flagged = F.aggregate(strong, F.lit(0), lambda acc, s: acc + (s["end"] - s["start"]).cast("int"))
    return F.struct((1 - flagged / F.greatest(F.length(answer), F.lit(1))).alias("score"), (F.size(strong) <= limit).cast("int").alias("faithful"), F.size(strong).alias("n_spans"))


def ratio_of_means(rows: DataFrame, by: list[str], numerator: str, denominator: str) -> DataFrame:
    """n, both means and their ratio per group; null where the denominator's mean is 0."""
    means = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(numerator).alias("num_mean"), F.avg(denominator).alias("den_mean"))
    return means.withColumn("ratio", F.when(F.col("den_mean") != 0, F.col("num_mean") / F.col("den_mean")))


def token_totals(records: DataFrame, by: str, least_coverage: float = 0.8) -> DataFrame:
    """Tokens of linked records per cell: coverage of the in/out split, means per answer where coverage suffices."""
    rows = records.where("linked")
    split = F.col("tokens_input").isNotNull() & F.col("tokens_output").isNotNull()
    totals = rows.groupBy(by).agg(
        F.count("*").alias("n_answers"), F.count_if(split).alias("n_split"), F.count_if(~split & F.col("tokens_total").isNotNull()).alias("n_total_only"),
        F.sum(F.when(split, F.col("tokens_input"))).alias("tokens_in"), F.sum(F.when(split, F.col("tokens_output"))).alias("tokens_out"),
        F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
    )
    share = F.round(F.col("n_split") / F.col("n_answers"), 4)
    enough = F.col("n_split") / F.col("n_answers") >= least_coverage
    return totals.withColumns({
        "coverage": share, "mean_in": F.when(enough, F.round(F.col("tokens_in") / F.col("n_split"), 6)), "mean_out": F.when(enough, F.round(F.col("tokens_out") / F.col("n_split"), 6)),
    })


def nearest_rank(rows: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact percentiles without interpolation: the value at index round_half_even(p (n - 1)) of the sorted values.

    Equal values are counted before anything is ordered, so a group comes down to its distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumns({"_upto": F.sum("_c").over(order), "_n": F.sum("_c").over(Window.partitionBy(*by))})
    index = {name: F.bround(F.lit(p) * (F.col("_n") - 1), 0) for name, p in fractions.items()}
    return run.groupBy(*by).agg(F.max("_n").alias("n"), *(F.min(F.when(F.col("_upto") > i, F.col(value))).alias(name) for name, i in index.items()))


def threshold_for_pass_rate(rows: DataFrame, by: list[str], prob: str, share: float = 0.95) -> DataFrame:
    """The least threshold that lets at least this share of the values pass: the ceil(share n)-th value plus a hair, at most 1."""
    counts = rows.where(F.col(prob).isNotNull()).groupBy(*by, prob).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*by).orderBy(prob).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumns({"_upto": F.sum("_c").over(order), "_n": F.sum("_c").over(Window.partitionBy(*by))})
    return run.groupBy(*by).agg(F.least(F.lit(1.0), F.min(F.when(F.col("_upto") >= F.ceil(F.lit(share) * F.col("_n")), F.col(prob))) + 1e-6).alias("threshold"))


def f1(truth: Column, predicted: Column) -> Column:
    tp, fp, fn = F.count_if((truth == 1) & (predicted == 1)), F.count_if((truth == 0) & (predicted == 1)), F.count_if((truth == 1) & (predicted == 0))
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))
