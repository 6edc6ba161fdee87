"""Cutting oversized texts into overlapping pieces at natural boundaries by pointer doubling.

Every possible cut of a text gets one successor: the farthest legal end of the piece that would begin there,
overlap included. That is a join of the boundary table with itself on position, done by binary search. Squaring
the successor table gives the jumps of 2, 4, 8 ... pieces, and from these all cuts of the greedy chain at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Short forms whose full stop ends no sentence.
SHORT_FORMS = "abs al app approx art bzw ca cf cl co dr ed eg etc fig figs ggf hr hrsg ie inc inkl ltd max min mr mrs ms nr no núm op ord p par pos pp prof ref resp s sec sr st str tel u ul usw v vgl vol vs z zb".split()
BLANK = r"[^\S\r\n]"
PARAGRAPH = re.compile(rf"(?:{BLANK}*(?:\r\n|\r|\n)){{2,}}{BLANK}*")
LINE = re.compile(r"(?:\r\n|\r|\n)+\s*")
SENTENCE = regex.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+(?=[\"'“‘«(\[¿¡]*[\p{Lu}\p{Lt}\p{Lo}\p{N}\p{So}])")
CLAUSE = re.compile(r"[;:,]\s+")
WORD = re.compile(r"\s+")
#: Distance of the places at which text without boundaries may be cut.
HARD_STEP = 200


def _unbreakable(text: str, at: int) -> bool:
    """True inside a character as a reader sees it: before a mark or joiner, after a joiner, inside CR LF or a flag."""
    ch, before = text[at], text[at - 1]
    if before == "\r" and ch == "\n" or before == "‍":
        return True
    code = ord(ch)
    if code == 0x200D or 0xFE00 <= code <= 0xFE0F or 0x1F3FB <= code <= 0x1F3FF or 0xE0020 <= code <= 0xE007F:
        return True
    if code >= 0x300 and regex.match(r"\p{M}", ch):
        return True
    if 0x1F1E6 <= code <= 0x1F1FF and 0x1F1E6 <= ord(before) <= 0x1F1FF:
        run = 0
        while at - 1 - run >= 0 and 0x1F1E6 <= ord(text[at - 1 - run]) <= 0x1F1FF:
            run += 1
        return run % 2 == 1
    return False


def _whole(text: str, at: int, least: int) -> int:
    """The last place up to `at` that splits no visible character; `at` itself where there is none after `least`."""
    place = at
    while place > least and 0 < place < len(text) and _unbreakable(text, place):
        place -= 1
    return place if place > least else at


def _sentence_ends(text: str) -> list[int]:
    ends = []
    for m in SENTENCE.finditer(text):
        word = regex.search(r"[\p{L}\p{N}]*$", text[max(0, m.start() - 20) : m.start()]).group()
        stop = text[m.start()] == "."
        if not (stop and (word.lower() in SHORT_FORMS or len(word) == 1 and word.isupper())):
            ends.append(m.end())
    return ends


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places where a piece may end, and their strength: 5 paragraph, 4 line, 3 sentence, 2 clause, 1 word, 0 none."""
    found: dict[int, int] = {}
    for strength, ends in (
        (1, (m.end() for m in WORD.finditer(text))), (2, (m.end() for m in CLAUSE.finditer(text))), (3, _sentence_ends(text)),
        (4, (m.end() for m in LINE.finditer(text))), (5, (m.end() for m in PARAGRAPH.finditer(text))),
    ):
        found.update(dict.fromkeys(ends, strength))
    n = len(text)
    found[n] = 5
    natural = sorted(x for x in found if x > 0)
    before = 0
    for place in natural:
        if place - before > HARD_STEP:
            for at in range(before + HARD_STEP, place, HARD_STEP):
                found.setdefault(_whole(text, at, before), 0)
        before = place
    found.pop(0, None)
    places = np.array(sorted(found), np.int64)
    return places, np.array([found[x] for x in places], np.int8)


def cut(text: str, limit: int = 4000, overlap: int = 400) -> list[tuple[int, int]]:
    """(start, end) of each piece; ends strictly grow, pieces hold at most `limit` characters, and each start lies
    at most `overlap` before the end of the piece before. Text within the limit is one piece, empty text none."""
    if overlap < 0 or limit <= 2 * overlap or limit < 4 * HARD_STEP or overlap and overlap < HARD_STEP:
        raise ValueError("limit must exceed twice the overlap and four hard steps; an overlap is 0 or at least a hard step")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    places, strength = boundaries(text)
    nodes = np.concatenate(([0], places))
    levels = [places[strength >= s] for s in (5, 4, 3, 2, 1, 0)]

    # Where the piece after each cut begins: the first boundary of the strongest kind within the overlap.
    starts = nodes.copy()
    undecided = nodes > 0
    for at_level in (levels[2], levels[4], levels[5]) if overlap else ():
        i = np.searchsorted(at_level, nodes - overlap, "left")
        candidate = at_level[np.minimum(i, len(at_level) - 1)]
        hit = undecided & (candidate >= nodes - overlap) & (candidate < nodes)
        starts[hit] = candidate[hit]
        undecided &= ~hit

    # The farthest legal successor: the last boundary of the strongest kind in the second half of the piece.
    reach = starts + limit
    end = np.full(len(nodes), -1, np.int64)
    for at_level in levels:
        i = np.searchsorted(at_level, reach, "right") - 1
        candidate = at_level[np.maximum(i, 0)]
        hit = (end < 0) & (i >= 0) & (candidate > np.maximum(nodes, starts + limit // 2))
        end[hit] = candidate[hit]
    i = np.searchsorted(places, reach, "right") - 1  # at the end of the text the second half may hold no boundary
    end = np.where((end < 0) | (reach >= n), places[i], end)
    successor = np.searchsorted(nodes, end)

    # Squaring: after round r, `chain` holds the first 2**r cuts and `jump` leads 2**r pieces on.
    chain, jump, last = np.zeros(1, np.int64), successor, len(nodes) - 1
    while chain[-1] != last:
        chain = np.concatenate((chain, jump[chain]))
        jump = jump[jump]
    chain = chain[: int(np.argmax(chain == last)) + 1]
    return list(zip(starts[chain[:-1]].tolist(), nodes[chain[1:]].tolist()))


PIECE_COLUMNS = "sub_index int, sub_count int, overlap_with_previous boolean, overlap_chars int, char_start bigint, char_end bigint, piece string"
#: Characters of pieces that are handed on at once.
BATCH_CHARS = 4_000_000


def split_oversized(df: DataFrame, *, text: str = "text", limit: int = 4000, overlap: int = 400, keep: tuple[str, ...] = ()) -> DataFrame:
    """The pieces of every text over the limit: keep..., sub_index (from 1), sub_count, overlap_with_previous,
    overlap_chars, char_start, char_end, piece.

    Texts within the limit, empty and null texts give no row; repeated rows are cut each. Joining the pieces
    without their overlaps gives the text back, character by character. A text is cut once, and its pieces leave
    the task as finished rows, a few at a time.
    """
    big = df.select(*keep, F.col(text).alias("_text")).where(F.length("_text") > limit)
    kept = [f"`_k{i}` {big.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    names = [*(f"_k{i}" for i in range(len(keep))), *(x.split()[0] for x in PIECE_COLUMNS.split(", "))]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for pdf in batches:
            for *own, s in pdf.itertuples(index=False, name=None):
                cuts, before = cut(s, limit, overlap), 0
                for i, (a, b) in enumerate(cuts):
                    shared = before - a if i else 0
                    rows.append((*own, i + 1, len(cuts), shared > 0, shared, a, b, s[a:b]))
                    before, held = b, held + b - a
                    if held > BATCH_CHARS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
        yield pd.DataFrame(rows, columns=names)

    out = big.mapInPandas(pieces, ", ".join([*kept, PIECE_COLUMNS]))
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), *names[len(keep) :])
