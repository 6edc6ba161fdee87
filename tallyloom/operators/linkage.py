"""Logged questions linked to their turns, answers, evidence and log entries, as keyed joins over all cells at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.text import match_key
from tallyloom.operators.sequences import nearest_in_time, nearest_with_key

ASKERS, ANSWERERS = ("user", "human", "customer"), ("assistant", "ai", "bot")


def speaker_role(speaker: Column) -> Column:
    """ask or answer, null for anyone else; case and blanks don't matter."""
    name = F.lower(F.regexp_replace(speaker, r"[\s\p{Z}]+", ""))
    return F.when(name.isin(*ASKERS), "ask").when(name.isin(*ANSWERERS), "answer")


def asked_turns(messages: DataFrame) -> DataFrame:
    """(key, message_id, conversation_id, at) of the asking turns; at counts microseconds. Repeated rows count once."""
    turns = messages.where(speaker_role(F.col("speaker")) == "ask").where("content is not null and message_id is not null and created_at is not null")
    return turns.select(match_key(F.col("content")).alias("key"), "message_id", "conversation_id", F.unix_micros("created_at").alias("at")).where("key <> ''").distinct()


def first_turns(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """For each question text the earliest turn that asks it, ties by message_id: question_id, message_id, conversation_id, at.

    Turns shrink to their first per key before they meet the questions, so a question asked by a third of all chats
    stays one row.
    """
    first = turns.groupBy("key").agg(F.min(F.struct("at", "message_id", "conversation_id")).alias("t"))
    return questions.join(first, "key").select("question_id", "t.message_id", "t.conversation_id", "t.at")


def next_answers(messages: DataFrame) -> DataFrame:
    """For each asking turn the first answer of its conversation not before it: message_id, answer_id, wait_us.

    Rows lie in ranges of (conversation, time); each range looks ahead by itself, and the first answer of a later
    range of the conversation fills in where a range has none, so a conversation of any length is spread out.
    """
    rows = messages.select("conversation_id", F.unix_micros("created_at").alias("at"), "message_id", speaker_role(F.col("speaker")).alias("role"))
    rows = rows.where("conversation_id is not null and at is not null and message_id is not null and role is not null").distinct()
    # An answer at the same moment counts, so answers sort before questions of equal time when looking back from the end.
    keyed = rows.withColumn("slot", F.floor(F.col("at") / 3_600_000_000))
    ahead = Window.partitionBy("conversation_id", "slot").orderBy(F.col("at").desc(), F.col("role").asc(), F.col("message_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    reply = F.when(F.col("role") == "answer", F.struct("at", "message_id"))
    inner = keyed.withColumn("reply", F.last(reply, ignorenulls=True).over(ahead))
    firsts = keyed.groupBy("conversation_id", "slot").agg(F.min(reply).alias("first_reply"))
    later = Window.partitionBy("conversation_id").orderBy("slot").rowsBetween(1, Window.unboundedFollowing)
    bridge = firsts.select("conversation_id", "slot", F.first("first_reply", ignorenulls=True).over(later).alias("later_reply"))
    joined = inner.where("role = 'ask'").join(bridge, ["conversation_id", "slot"]).withColumn("reply", F.coalesce("reply", "later_reply"))
    return joined.where("reply is not null").select("message_id", F.col("reply.message_id").alias("answer_id"), (F.col("reply.at") - F.col("at")).alias("wait_us"))


def latest_log(logs: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The newest log row per key; rows without a key are no exact match and left out."""
    return logs.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")).select(key, "_row.*")


def completion_links(turns: DataFrame, logs: DataFrame, tolerance_us: int = 120_000_000) -> DataFrame:
    """turns(message_id, conversation_id, at) with logs(log_id, message_id, conversation_id, at): message_id, log_id, link.

    An exact entry always wins, the newest one; else the nearest of the entries of the same conversation that name no
    message, within the tolerance, newest on equal skew.
    """
    exact = latest_log(logs, "message_id", ["at", "log_id"], ["log_id"]).withColumn("link", F.lit("message_id"))
    unnamed = logs.where("message_id is null and conversation_id is not null").select("conversation_id", F.col("log_id").alias("right_id"), F.col("at").alias("log_at"))
    near = nearest_with_key(turns.select(F.col("message_id").alias("left_id"), "conversation_id", F.col("at").alias("turn_at")), unnamed, ["conversation_id"], "turn_at", "log_at", tolerance_us)
    near = near.select(F.col("left_id").alias("message_id"), F.col("right_id").alias("near_id"))
    joined = turns.select("message_id").distinct().join(exact, "message_id", "left").join(near, "message_id", "left")
    return joined.select("message_id", F.coalesce("log_id", "near_id").alias("log_id"), F.when(F.col("log_id").isNotNull(), F.col("link")).when(F.col("near_id").isNotNull(), "conversation+time").alias("link"))


def score_overlap(evidence: DataFrame, logs: DataFrame, tolerance_us: int = 120_000_000, digits: int = 4, least: int = 1) -> DataFrame:
    """Search-log entries recognised by the scores they hold: message_id, log_id, matched, skew_us.

    evidence(message_id, at, score), logs(log_id, at, scores as an array). Scores are compared after rounding; an entry
    must hold at least `least` of the message's evidence rows within the tolerance. Best count wins, then nearness.
    """
    mine = evidence.where("score is not null").select("message_id", "at", F.round("score", digits).cast(f"decimal(18,{digits})").alias("score"), F.monotonically_increasing_id().alias("row"))
    theirs = logs.select("log_id", F.col("at").alias("log_at"), F.explode(F.array_distinct(F.transform("scores", lambda s: F.round(s, digits).cast(f"decimal(18,{digits})")))).alias("score"))
    near = mine.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("at") / tolerance_us) + i)))
    met = near.join(theirs.withColumn("_b", F.floor(F.col("log_at") / tolerance_us)), ["score", "_b"]).where(F.abs(F.col("at") - F.col("log_at")) <= tolerance_us)
    counts = met.groupBy("message_id", "log_id").agg(F.count("*").alias("matched"), F.min(F.abs(F.col("at") - F.col("log_at"))).alias("skew_us")).where(F.col("matched") >= least)
    return counts.groupBy("message_id").agg(F.min(F.struct((-F.col("matched")).alias("m"), "skew_us", "log_id")).alias("b")).select("message_id", "b.log_id", (-F.col("b.m")).alias("matched"), "b.skew_us")


def resolve_search_log(by_scores: DataFrame, turns: DataFrame, logs: DataFrame, tolerance_us: int = 120_000_000) -> DataFrame:
    """message_id, log_id, how: by scores where they matched, else by time alone."""
    near = nearest_in_time(turns.select(F.col("message_id").alias("left_id"), F.col("at").alias("turn_at")), logs.select(F.col("log_id").alias("right_id"), F.col("at").alias("log_at")), "turn_at", "log_at", tolerance_us)
    near = near.select(F.col("left_id").alias("message_id"), F.col("right_id").alias("near_id"))
    joined = turns.select("message_id").distinct().join(by_scores.select("message_id", "log_id"), "message_id", "left").join(near, "message_id", "left")
    return joined.select("message_id", F.coalesce("log_id", "near_id").alias("log_id"), F.when(F.col("log_id").isNotNull(), "scores").when(F.col("near_id").isNotNull(), "time").alias("how"))


def served_ranks(evidence: DataFrame, message: str, rerank: str, retrieval: str, chunk: str) -> DataFrame:
    """Adds served_rank from 0: by rerank score, then retrieval score, both falling with nulls last, then chunk id."""
    order = Window.partitionBy(message).orderBy(F.desc_nulls_last(rerank), F.desc_nulls_last(retrieval), F.col(chunk))
    return evidence.withColumn("served_rank", F.row_number().over(order) - 1)


def evidence_with_text(evidence: DataFrame, chunks: DataFrame, key: str, text: str) -> DataFrame:
    """Evidence keeps its row where the chunk is gone, with empty text."""
    return evidence.join(chunks.select(key, text), key, "left").withColumn(text, F.coalesce(text, F.lit("")))


def sittings(turns: DataFrame, questions: DataFrame) -> DataFrame:
    """Chats that asked benchmark questions: conversation_id, matched, missing, first_at, last_at.

    questions(question_id, key): several ids may share a text; a turn matches all of them.
    """
    total = questions.select("question_id").distinct().agg(F.count("*").alias("total"))
    hits = turns.where("conversation_id is not null").join(questions, "key").groupBy("conversation_id").agg(F.countDistinct("question_id").alias("matched"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return hits.crossJoin(F.broadcast(total)).select("conversation_id", "matched", (F.col("total") - F.col("matched")).alias("missing"), "first_at", "last_at")


def sitting_windows(found: DataFrame, pad_s: int = 60, round_s: int = 60) -> DataFrame:
    """Bounds padded, then rounded outwards to whole steps, in seconds."""
    us = 1_000_000
    return found.select(
        "conversation_id",
        (F.floor((F.col("first_at") - pad_s * us) / (round_s * us)) * round_s).alias("start_s"),
        (F.ceil((F.col("last_at") + pad_s * us) / (round_s * us)) * round_s).alias("end_s"),
    )


def merge_sittings(hits: DataFrame, most: int | None = None) -> DataFrame:
    """Greedy cover: per cell, chats in order of matches (then first time, then id) are taken while they add questions;
    cell, conversation_id, step (from 0), added. `most` stops it earlier, where only so many chats are wanted.

    hits(cell, conversation_id, question_id, at). The order never changes, so the chats taken are those that come first
    in it for some question: one aggregation per question instead of a round per chat.
    """
    pool = hits.groupBy("cell", "conversation_id", "question_id").agg(F.min("at").alias("at"))
    size = pool.groupBy("cell", "conversation_id").agg(F.count("*").alias("matched"), F.min("at").alias("first_at"))
    place = F.struct((-F.col("matched")).alias("m"), "first_at", "conversation_id")
    first = pool.join(size, ["cell", "conversation_id"]).groupBy("cell", "question_id").agg(F.min(place).alias("place"))
    taken = first.groupBy("cell", "place").agg(F.count("*").alias("added"))
    out = taken.select("cell", "place.conversation_id", (F.row_number().over(Window.partitionBy("cell").orderBy("place")) - 1).alias("step"), "added")
    return out if most is None else out.where(F.col("step") < most)
