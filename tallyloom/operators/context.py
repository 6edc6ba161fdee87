"""Served context as text, documents by name, and power that passed its coverage gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rendered_context(evidence: DataFrame, message: str, rank: str, document: str, page: str, text: str, header: str = "Document: ", separator: str = "\n\n") -> DataFrame:
    """One text per message: passages in served order, each with its page, a header where the document changes.

    A served list is bounded by the application's top_n, so its passages are joined in one row.
    """
    listed = evidence.groupBy(F.col(message).alias("message_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.coalesce(document, F.lit("")).alias("document"), F.col(page).alias("page"), F.coalesce(text, F.lit("")).alias("text")))).alias("items")
    )
    part = lambda x, i: F.concat(
        F.when((i == 0) | (F.get("items", i - 1)["document"] != x["document"]), F.concat(F.lit(header), x["document"], F.lit("\n"))).otherwise(F.lit("")),
        F.when(x["page"].isNotNull(), F.concat(F.lit("Page "), x["page"].cast("string"), F.lit(": "))).otherwise(F.lit("")),
        x["text"],
    )
    return listed.select("message_id", F.size("items").alias("n_passages"), F.array_join(F.transform("items", part), separator).alias("context"))


def basename(name: Column) -> Column:
    return F.regexp_replace(name, r"^.*[/\\]", "")


def name_matches(name: Column, wanted: Column, how: str = "exact") -> Column:
    """exact, casefold, basename or contains."""
    rules = {
        "exact": name == wanted,
        "casefold": F.lower(name) == F.lower(wanted),
        "basename": F.lower(basename(name)) == F.lower(basename(wanted)),
        "contains": F.contains(F.lower(name), F.lower(wanted)),
    }
    if how not in rules:
        raise ValueError(f"how must be one of {sorted(rules)}")
    return rules[how]


def gated_power(measured: DataFrame, by: str, span_s: str, covered_s: str, energy_wh: str, least_coverage: float = 0.8, nameplate_w: float | None = None) -> DataFrame:
    """Mean watts per cell where the meter covered enough of the time, else the nameplate as an upper bound, else nothing."""
    sums = measured.groupBy(by).agg(F.count("*").alias("n"), F.sum(span_s).alias("span_s"), F.sum(covered_s).alias("covered_s"), F.sum(energy_wh).alias("energy_wh"))
    share = F.coalesce(F.try_divide("covered_s", "span_s"), F.lit(0.0))
    passed = (share >= least_coverage) & (F.col("covered_s") > 0)
    fallback = F.lit(nameplate_w).cast("double")
    return sums.select(
        by, "n", F.round("span_s", 3).alias("span_s"), F.round(share, 4).alias("coverage"),
        F.round(F.when(passed, F.col("energy_wh") * 3600 / F.col("covered_s")).otherwise(fallback), 3).alias("mean_w"),
        F.when(passed, "measured").when(fallback.isNotNull(), "upper bound").otherwise("unmeasured").alias("kind"),
    )
