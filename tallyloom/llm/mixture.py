"""Mixtures of sources at target shares of the tokens, by balanced sampling with the cube method.

Each document gets an expected number of copies; its whole part is kept, its fractional part is an inclusion
probability. The flight phase moves the probabilities of three documents at a time along the null space of the
balancing constraints (number of documents, number of tokens), until one of them is in or out. Blocks of
documents fly independently and leave at most two open each; these fly again, block by block, until a source
has at most two open documents, which land on the choice that misses the token total least.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import materialise

#: Documents of a block that flies in one task.
BLOCK = 1024
DEFAULT_TOKENIZER = os.environ.get("TALLYLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the published split pattern of the byte-level vocabulary.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: The most bytes a vocabulary file may hold to be sent to every task.
MAX_VOCABULARY = 64_000_000


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import base64

    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("mixture", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of each document; a null text has no tokens. Texts are read whole.

    The vocabulary file is read where the query is made and travels to the tasks, which need no file of their own.
    """
    if os.path.getsize(tokenizer) > MAX_VOCABULARY:
        raise ValueError(f"the vocabulary file is larger than {MAX_VOCABULARY} bytes")
    with open(tokenizer, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(vocabulary.value).encode_ordinary
        for pdf in batches:
            n = [len(encode(s)) if s else 0 for s in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": n})

    id_type = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).mapInPandas(counted, f"doc_id {id_type}, source string, tokens bigint")


def fly(pi: np.ndarray, tokens: np.ndarray, seed: int) -> np.ndarray:
    """The flight phase: probabilities that are 0, 1 or, for at most two documents, still between.

    The expected number of documents and of tokens stays as it was, and so does each document's probability.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    pi = pi.astype(float).copy()
    order = rng.permutation(len(pi)).tolist()
    draws = rng.random(len(pi) + 1).tolist()
    eps = 1e-9
    p, t = pi.tolist(), tokens.astype(float).tolist()
    open_docs: list[int] = []
    at = 0
    while True:
        while len(open_docs) < 3 and at < len(order):
            if eps < p[order[at]] < 1 - eps:
                open_docs.append(order[at])
            at += 1
        if len(open_docs) < 2 or len(open_docs) == 2 and t[open_docs[0]] != t[open_docs[1]]:
            break
        if len(open_docs) == 2:
            u = (1.0, -1.0)
        else:
            a, b, c = (t[i] for i in open_docs)
            u = (b - c, c - a, a - b)
            if not any(u):
                u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(open_docs, u) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(open_docs, u) if v)
        step = up if draws[at % len(draws)] * (up + down) < down else -down
        draws[at % len(draws)] = rng.random()
        for i, v in zip(open_docs, u):
            p[i] += step * v
        for i in open_docs:
            p[i] = 0.0 if p[i] < eps else 1.0 if p[i] > 1 - eps else p[i]
        open_docs = [i for i in open_docs if 0.0 < p[i] < 1.0]
    return np.array(p)


def land(pi: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Decides the last open documents (two at most after a flight) so that the token total is missed least."""
    p = pi.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    goal = float((p[left] * tokens[left]).sum())
    choices = [[bool(mask >> k & 1) for k in range(len(left))] for mask in range(2 ** len(left))]
    best = min(choices, key=lambda c: abs(goal - float((tokens[left] * np.array(c)).sum()))) if len(left) else []
    p[left] = np.array(best, float)
    return p


def plan_copies(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, source_tokens, copies): expected copies of each document.

    The mixture is the largest for which no source needs more than max_repeats copies of a document. Sources
    without tokens can give nothing and don't limit the others; sources without a target share aren't used.
    """
    fit = targets.where("target_share > 0 and max_repeats > 0").join(totals, "source", "left").withColumns({"n_docs": F.coalesce("n_docs", F.lit(0)), "source_tokens": F.coalesce("source_tokens", F.lit(0))})
    size = fit.where("source_tokens > 0").agg(F.min(F.col("max_repeats") * F.col("source_tokens") / F.col("target_share")).alias("size"))
    copies = F.when(F.col("source_tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("size") * F.col("target_share") / F.col("source_tokens"))).otherwise(F.lit(0.0))
    return fit.crossJoin(F.broadcast(size)).withColumn("copies", copies).drop("size")


def mix(counted: DataFrame, targets: DataFrame, seed: int = 20260) -> tuple[DataFrame, DataFrame]:
    """(documents with their copies, sources with the share reached).

    counted: doc_id, source, tokens. targets: source, target_share, max_repeats, one row per source (checked small:
    one row per source, no documents). Documents of null or untargeted sources get no row, nor do documents not drawn.
    """
    counted = materialise(counted.select("doc_id", "source", "tokens").where("doc_id is not null and source is not null").dropDuplicates(["doc_id"]))
    totals = counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("source_tokens"))
    plan = materialise(plan_copies(totals, targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))))
    sizes = plan.where("source_tokens > 0").agg(F.max("n_docs").alias("n")).first()["n"] or 0
    whole = F.floor(F.col("copies") + 1e-9)
    units = counted.join(F.broadcast(plan.where("source_tokens > 0").select("source", "copies", "n_docs")), "source").select(
        "doc_id", "source", "tokens", whole.cast("int").alias("whole"), F.greatest(F.lit(0.0), F.col("copies") - whole).alias("pi"), F.ceil(F.col("n_docs") / BLOCK).cast("int").alias("blocks")
    )
    id_type = units.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, source string, tokens bigint, whole int, pi double, block int"

    def flight(last: bool, level: int):
        def of_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("doc_id", ignore_index=True)
            digest = int.from_bytes(hashlib.blake2b(f"{key[0]}|{key[1]}|{level}|{seed}".encode(), digest_size=8).digest())
            p = fly(pdf["pi"].to_numpy(), pdf["tokens"].to_numpy(), digest)
            return pdf.assign(pi=land(p, pdf["tokens"].to_numpy()) if last else p)

        return of_block

    state = units.select("doc_id", "source", "tokens", "whole", "pi", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int").alias("block"))
    decided, blocks, level = [], max(1, -(-int(sizes) // BLOCK)), 0
    while True:
        flown = materialise(state.groupBy("source", "block").applyInPandas(flight(blocks == 1, level), schema))
        decided.append(flown.where("pi in (0.0, 1.0)"))
        if blocks == 1:
            break
        shrink = BLOCK // 2
        state = flown.where("pi not in (0.0, 1.0)").withColumn("block", F.floor(F.col("block") / shrink).cast("int"))
        blocks, level = -(-blocks // shrink), level + 1
    drawn = decided[0]
    for more in decided[1:]:
        drawn = drawn.unionByName(more)
    drawn = drawn.select("doc_id", "source", "tokens", (F.col("whole") + F.col("pi")).cast("int").alias("copies")).where("copies > 0")
    reached = drawn.groupBy("source").agg(F.count("*").alias("docs_used"), F.sum("copies").alias("docs_out"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens_out"), F.max("copies").alias("most_copies"))
    grand = reached.agg(F.sum("tokens_out").alias("all_tokens"))
    shares = plan.select("source", "target_share", "max_repeats", "n_docs", "source_tokens").join(reached, "source", "left").crossJoin(F.broadcast(grand)).select(
        "source", "target_share", "max_repeats", "n_docs", "source_tokens",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("docs_used", "docs_out", "tokens_out", "most_copies")),
        F.coalesce(F.col("tokens_out") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
    )
    return drawn, shares
