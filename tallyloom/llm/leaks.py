"""Passages of held-out test items inside a training corpus.

The word n-grams of the test side travel to every task as a hash set, in blocks of bounded size where it is large; each
training text is scanned window by window, and every hit is verified on the words themselves.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
UNSEEN = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠎ㅤ︀-️ﾠ\U000E0100-\U000E01EF]+|[\p{Cc}--\s]+", flags=regex.V1)
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
#: Characters of test items that are sent to every task at once (some 40 bytes of index a character, so 320 MB a worker).
BLOCK_CHARS = 8_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters or digits, without regard to case, punctuation, kinds of blank and invisible characters."""
    if not text.isascii() or _CONTROL.search(text):
        text = unicodedata.normalize("NFC", UNSEEN.sub("", text))
    return WORDS.findall(text.casefold())


class TestGrams:
    """The distinct n-grams of the test items, with the items of each."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.ids, self.items = n, {}, {}
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, text in items:
            words = words_of(text) if text else []
            self.items[item] = words
            codes = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], np.uint64)
            for at, h in enumerate(self.hashes(codes).tolist()):
                places[h].append((item, at))
        self.places = dict(places)
        self.known = np.array(sorted(self.places), np.uint64)

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        m = len(codes) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(m, np.uint64)
        for i in range(self.n):
            h = h * _MULTIPLIER + codes[i : i + m] + np.uint64(1)
        return h

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(item, first word, last word + 1) of each longest run of text words that stands in the item."""
        words = words_of(text)
        get = self.ids.get
        codes = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        if len(words) < self.n or not len(self.known):
            return []
        windows = self.hashes(codes)
        at = np.searchsorted(self.known, windows)
        hits = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] == windows)
        runs: dict[tuple[int, int], list[int]] = {}
        out = []
        for i in hits.tolist():
            gram = words[i : i + self.n]
            for item, j in self.places[int(windows[i])]:
                if self.items[item][j : j + self.n] != gram:
                    continue
                run = runs.get((item, i - j))
                if run is not None and i <= run[1] - self.n + 1:
                    run[1] = i + self.n
                else:
                    runs[item, i - j] = run = [i, i + self.n]
                    out.append((item, run))
        return [(item, a, b) for item, (a, b) in out]


def _test_grams(tests: DataFrame, item_id: str = "item_id", n: int = 10) -> list:
    """The n-grams of the test side as broadcast variables, one per block of items of about BLOCK_CHARS characters at most."""
    size = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // BLOCK_CHARS))
    out = []
    for block in range(blocks):
        mine = tests.select(item_id, "text").where(F.col(item_id).isNotNull() & (F.pmod(F.xxhash64(item_id), F.lit(blocks)) == block))
        out.append(tests.sparkSession.sparkContext.broadcast(TestGrams([tuple(r) for r in mine.collect()], n)))
    return out


def find_leaks(corpus: DataFrame, tests: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", n: int = 10) -> DataFrame:
    """One row per (item, document) that share a run of at least n words: item_id, doc_id, n_spans, longest_run, covered_words, item_words.

    Null or short texts and items share nothing; a repeated document or item counts once per id. A test side larger
    than BLOCK_CHARS is broadcast in blocks, each with a scan of the corpus of its own.
    """
    doc_type, item_type = corpus.schema[doc_id].dataType.simpleString(), tests.schema[item_id].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame], grams) -> Iterator[pd.DataFrame]:
        index = grams.value
        for pdf in batches:
            rows = []
            for doc, body in zip(pdf[doc_id], pdf[text]):
                by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for item, a, b in index.spans(body):
                    by_item[item].append((a, b))
                for item, runs in by_item.items():
                    covered = set().union(*(range(a, b) for a, b in runs))
                    rows.append((item, doc, len(runs), max(b - a for a, b in runs), len(covered), len(index.items[item])))
            yield pd.DataFrame(rows, columns=["item_id", "doc_id", "n_spans", "longest_run", "covered_words", "item_words"])

    wanted = corpus.select(doc_id, text).where(f"{doc_id} is not null and {text} is not null")
    schema = f"item_id {item_type}, doc_id {doc_type}, n_spans int, longest_run int, covered_words int, item_words int"
    found = reduce(DataFrame.unionByName, [wanted.mapInPandas(partial(scan, grams=g), schema) for g in _test_grams(tests, item_id, n)])
    return found.groupBy("item_id", "doc_id").agg(*(F.max(c).alias(c) for c in ("n_spans", "longest_run", "covered_words", "item_words")))


def without_leaks(corpus: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The corpus without the documents that leak; all its columns stay."""
    return corpus.join(leaks.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")


def without_spans(corpus: DataFrame, tests: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", n: int = 10) -> DataFrame:
    """(doc_id, text, removed_words): every text without the words it shares with a test item in runs of at least n.

    Texts that leak nothing stay as they are; others lose their invisible characters with the runs, and the words
    around a run stay apart by a blank. Null texts stay null. A test side larger than BLOCK_CHARS raises, since the runs of
    all its items are cut at once.
    """
    grams, *more = _test_grams(tests, item_id, n)
    if more:
        raise ValueError(f"the test side holds more than {BLOCK_CHARS} characters")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = grams.value
        for pdf in batches:
            out = [cut_spans(body, index) if body is not None else (None, 0) for body in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [t for t, _ in out], "removed_words": [k for _, k in out]})

    doc_type = corpus.schema[doc_id].dataType.simpleString()
    return corpus.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(scan, f"doc_id {doc_type}, text string, removed_words int")


def cut_spans(text: str, index: TestGrams) -> tuple[str, int]:
    runs = sorted((a, b) for _, a, b in index.spans(text))
    if not runs:
        return text, 0
    seen = unicodedata.normalize("NFC", UNSEEN.sub("", text))
    places = [m.span() for m in WORDS.finditer(seen)]
    kept, done, removed = [], 0, 0
    for a, b in runs:
        a = max(a, done)
        if a < b:
            kept.append(seen[places[done - 1][1] if done else 0 : places[a][0]])
            done, removed = b, removed + b - a
    kept.append(seen[places[done - 1][1] :])
    return " ".join(x.strip() for x in kept if x.strip()), removed
