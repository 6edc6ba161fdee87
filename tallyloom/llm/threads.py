"""Ordered conversations from message rows by pointer jumping.

`resolve_roots` follows parent pointers of any table by repeated squaring: a round replaces each pointer by its
pointer's pointer, so a path of n rows takes log2(n) joins; pointers to no row are orphans, rows that reach no
root in that many rounds lie on or behind a cycle. `reassemble` derives the pointers of a message log: rows are
range-partitioned by (conversation, time, id), so that one conversation may spread over many tasks; each task
jumps the pointers of all rows inside its range by squaring arrays, and the heads of the chains that cross a range border
are jumped by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.session import materialise, shuffle_width

# What may stand in the speaker column for either side.
ASKING = ("user", "human", "customer")
ANSWERING = ("assistant", "ai", "bot")
#: A character that leaves ink: neither blank, control, format nor filler.
INK = r"[^\p{Z}\p{C}\s͏ᅟᅠ឴឵᠋-᠎⠀ㅤ︀-️ﾠ]"


def is_visible(column):
    return F.coalesce(column.rlike(INK), F.lit(False))


def role_of(speaker):
    """ask, answer, system or null (unknown), of a speaker in any case and with stray blanks."""
    name = F.lower(F.regexp_replace(speaker, r"[\p{Z}\p{C}\s]+", ""))
    return F.when(name.isin(*ASKING), "ask").when(name.isin(*ANSWERING), "answer").when(name == "system", "system")


def resolve_roots(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """edges(id, parent, weight) -> (id, root, distance, orphan, cyclic).

    distance sums the weights of the steps to the root. parent null marks a root; a parent that is no id makes
    its row an orphan and a root of its own. Rows that never reach a root are cyclic, with root null. Null ids
    are left out; of repeated ids, the smallest parent counts.
    """
    base = edges.where("id is not null").groupBy("id").agg(F.min(F.struct("parent", "weight")).alias("e")).select("id", "e.parent", "e.weight")
    known = base.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    step = base.join(known, "parent", "left").select(
        "id",
        F.when(F.col("known"), F.col("parent")).alias("ptr"),
        F.when(F.col("known"), F.col("weight")).otherwise(F.lit(0)).cast("bigint").alias("distance"),
        (F.col("parent").isNotNull() & F.col("known").isNull()).alias("orphan"),
    )
    # ptr null: the row itself is its root. A row is done when its pointer's row is a root.
    state = materialise(step.withColumns({"done": F.col("ptr").isNull(), "root": F.when(F.col("ptr").isNull(), F.col("id"))}))
    total = state.count()
    for _ in range(min(max_rounds, max(1, total).bit_length() + 1)):
        open_rows = state.where("not done")
        if open_rows.isEmpty():
            break
        target = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("distance").alias("more"), F.col("done").alias("target_done"), F.col("root").alias("target_root"))
        moved = open_rows.drop("root").join(target, "ptr").select(
            "id",
            F.when(~F.col("target_done"), F.col("next")).alias("ptr"),
            (F.col("distance") + F.col("more")).alias("distance"),
            "orphan",
            F.col("target_done").alias("done"),
            F.col("target_root").alias("root"),
        )
        state = materialise(state.where("done").select("id", "ptr", "distance", "orphan", "done", "root").unionByName(moved))
    return state.select("id", "root", F.when(F.col("done"), F.col("distance")).alias("distance"), "orphan", (~F.col("done")).alias("cyclic"))


def jump(pointer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, steps to it) of every row by pointer jumping; a root points to itself."""
    steps = (pointer != np.arange(len(pointer))).astype(np.int64)
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            return pointer, steps
        steps, pointer = steps + steps[pointer], further


LINK_SCHEMA = "conversation_id string, message_id string, role string, created_at timestamp, range_no int, segment_first string, local_position bigint, parent_id string, parent_role string, segment_end boolean"


def _link_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parents inside one sorted range; repeated message rows are adjacent and count once."""
    part = TaskContext.get().partitionId()
    carry: pd.DataFrame | None = None
    last: tuple | None = None  # conversation, message, role, position, first message of the segment
    for pdf in batches:
        pdf = pdf if carry is None else pd.concat([carry, pdf], ignore_index=True)
        pdf = pdf.drop_duplicates(["conversation_id", "message_id"], keep="first", ignore_index=True)
        carry = pdf.tail(1)
        done = pdf.iloc[:-1]
        if len(done):
            out, last = _link_batch(done, last, part, carry["conversation_id"].iloc[0])
            yield out
    if carry is not None and len(carry):
        out, _ = _link_batch(carry, last, part, None)
        yield out


def _link_batch(pdf: pd.DataFrame, last: tuple | None, part: int, following: str | None) -> tuple[pd.DataFrame, tuple]:
    pdf = pdf.reset_index(drop=True)
    conv = pdf["conversation_id"]
    prev_conv = conv.shift(1)
    parent, parent_role = pdf["message_id"].shift(1), pdf["role"].shift(1)
    if last is not None:
        prev_conv.iloc[0], parent.iloc[0], parent_role.iloc[0] = last[0], last[1], last[2]
    starts = conv != prev_conv
    parent, parent_role = parent.mask(starts), parent_role.mask(starts)
    heads = starts.to_numpy().copy()
    heads[0] = True
    root, distance = jump(np.where(heads, np.arange(len(pdf)), np.arange(len(pdf)) - 1))
    position, first = pd.Series(distance), pd.Series(pdf["message_id"].to_numpy()[root])
    if last is not None and not starts.iloc[0]:
        continued = pd.Series(root == 0)
        position = position.mask(continued, position + last[3] + 1)
        first = first.mask(continued, last[4])
    ends = conv != conv.shift(-1)
    ends.iloc[-1] = following is None or conv.iloc[-1] != following
    out = pd.DataFrame({
        "conversation_id": conv, "message_id": pdf["message_id"], "role": pdf["role"], "created_at": pdf["created_at"], "range_no": part,
        "segment_first": first, "local_position": position, "parent_id": parent, "parent_role": parent_role, "segment_end": ends,
    })
    return out, (conv.iloc[-1], pdf["message_id"].iloc[-1], pdf["role"].iloc[-1], int(position.iloc[-1]), first.iloc[-1])


def message_facts(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """(conversation_id, message_id, role, created_at, visible) of every row of a conversation.

    Only rows without visible content are looked up among the answers, whose message has a visible answer_text.
    """
    facts = messages.where("conversation_id is not null").select("conversation_id", "message_id", role_of(F.col("speaker")).alias("role"), "created_at", is_visible(F.col("content")).alias("visible"))
    answered = answers.where(F.col("message_id").isNotNull() & is_visible(F.col("answer_text"))).select("message_id").distinct().withColumn("answered", F.lit(True))
    silent = facts.where("not visible and coalesce(role, '') <> 'system'").join(answered, "message_id", "left").withColumn("visible", F.coalesce("answered", F.lit(False))).drop("answered")
    return facts.where("visible or role = 'system'").unionByName(silent.select("conversation_id", "message_id", "role", "created_at", "visible"))


def reassemble(facts: DataFrame) -> DataFrame:
    """Turns in order: conversation_id, position, message_id, role, created_at, parent_id, parent_role, root_id, broken.

    Takes visible ask and answer rows with a time; order is created_at, then message_id.
    """
    turns = facts.where("visible and role in ('ask', 'answer') and created_at is not null and message_id is not null").select("conversation_id", "message_id", "role", "created_at")
    order = ["conversation_id", "created_at", "message_id"]
    ranged = turns.repartitionByRange(shuffle_width(turns.sparkSession), *order).sortWithinPartitions(*order)
    links = materialise(ranged.mapInPandas(_link_range, LINK_SCHEMA))
    # Only a conversation cut by a range border has two segments; a range has at most two such segments.
    ends = links.where("segment_end").select("conversation_id", "range_no", "segment_first", F.col("message_id").alias("last_id"), F.col("role").alias("last_role"), (F.col("local_position") + 1).alias("length"))
    border = ends.join(
        ends.groupBy("range_no").agg(F.min("conversation_id").alias("lowest"), F.max("conversation_id").alias("highest")), "range_no"
    ).where("conversation_id = lowest or conversation_id = highest")
    chain = Window.partitionBy("conversation_id").orderBy("range_no")
    crossing = border.withColumns({
        "parent": F.lag("segment_first").over(chain), "weight": F.lag("length").over(chain),
        "head_parent": F.lag("last_id").over(chain), "head_parent_role": F.lag("last_role").over(chain),
    })
    crossing = materialise(crossing)
    roots = resolve_roots(crossing.select(F.col("segment_first").alias("id"), "parent", F.coalesce("weight", F.lit(0)).cast("bigint").alias("weight")))
    moved = roots.where("cyclic or orphan or root <> id").join(crossing.select(F.col("segment_first").alias("id"), "head_parent", "head_parent_role"), "id").select(F.col("id").alias("segment_first"), "root", "distance", "head_parent", "head_parent_role", (F.col("orphan") | F.col("cyclic")).alias("broken"))
    head = F.col("message_id") == F.col("segment_first")
    return links.join(moved, "segment_first", "left").select(
        "conversation_id",
        (F.col("local_position") + F.coalesce("distance", F.lit(0))).alias("position"),
        "message_id",
        "role",
        "created_at",
        F.when(head & F.col("head_parent").isNotNull(), F.col("head_parent")).otherwise(F.col("parent_id")).alias("parent_id"),
        F.when(head & F.col("head_parent").isNotNull(), F.col("head_parent_role")).otherwise(F.col("parent_role")).alias("parent_role"),
        F.coalesce("root", "segment_first").alias("root_id"),
        F.coalesce("broken", F.lit(False)).alias("broken"),
    )


def judge_conversations(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conversation: turns, sound, and why not: empty, broken (an orphan or a cycle), unknown_row, bad_start, bad_order, no_reply.

    Sound conversations begin with asking, strictly alternate and end with an answer; any non-system row with
    unknown speaker or without a time makes one unsound, visible or not. Repeated rows count once,
    equal times are ordered by message_id, rows of no conversation belong to none, and empty tables give no rows.
    """
    rows = facts.groupBy("conversation_id").agg(F.max(F.coalesce(F.col("role") != "system", F.lit(True)) & (F.col("role").isNull() | F.col("created_at").isNull())).alias("unknown_row"))
    paths = turns.groupBy("conversation_id").agg(
        F.count("*").alias("n_turns"),
        F.max(F.col("parent_id").isNotNull() & (F.col("parent_role") == F.col("role"))).alias("bad_order"),
        F.max(F.col("parent_id").isNull() & (F.col("role") != "ask")).alias("bad_start"),
        F.max_by("role", "position").alias("last_role"),
        F.countDistinct("root_id").alias("n_roots"), F.max("broken").alias("broken"),
    )
    reason = (
        F.when(F.col("n_turns").isNull(), "empty").when(F.col("broken"), "broken").when(F.col("unknown_row"), "unknown_row").when(F.col("bad_start") | (F.col("n_roots") > 1), "bad_start")
        .when(F.col("bad_order"), "bad_order").when(F.col("last_role") != "answer", "no_reply")
    )
    return rows.join(paths, "conversation_id", "left").select("conversation_id", F.coalesce("n_turns", F.lit(0)).alias("n_turns"), reason.isNull().alias("sound"), reason.alias("reason"))
