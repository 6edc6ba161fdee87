"""One consistent form for text that looks the same but holds different characters, and quote look-up in it.

A text is mostly stable already. One regular expression, built from per-character quick checks, finds the
unstable segments together with the stable character before each (a combining mark needs its base); only
those segments are normalised and spliced back. Texts without such a segment are never rewritten.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that can't be told from a Latin letter by eye, in either case.
# A Cyrillic, Armenian, Cherokee or Coptic letter goes with its other case, so that changing case never changes the result.
LOOK_ALIKES = {
    "a": "А а Α α ɑ", "b": "В в Β", "c": "С с Ϲ ϲ", "e": "Е е Ε", "g": "ɡ", "h": "Н н Һ һ Η", "i": "І і Ι ι Ӏ ӏ",
    "j": "Ј ј Ϳ ϳ", "k": "К к Κ", "m": "М м Μ", "n": "Ν", "o": "О о Ο ο", "p": "Р р Ρ ρ", "q": "Ԛ ԛ", "s": "Ѕ ѕ",
    "t": "Т т Τ", "u": "υ", "v": "ν Ѵ ѵ", "w": "Ԝ ԝ", "x": "Х х Χ", "y": "У у Υ", "z": "Ζ", "d": "ԁ",
    "l": "Ꮮ ꮮ", "r": "Ꭱ Ꮢ ꭱ ꮢ",
    "-": "‐ ‑ ⁃ ﹣", "–": "−", "'": "＇", "/": "∕ ⁄", ":": "∶ ꞉", ".": "․",
}
# More of them, by script.
MORE_LOOK_ALIKES = {
    "a": "Ꭺ ꭺ Ⲁ ⲁ", "b": "Ᏼ ᏼ Ⲃ ⲃ", "c": "Ꮯ ꮯ Ⲥ ⲥ", "d": "Ꭰ ꭰ", "e": "Ꭼ ꭼ Ⲉ ⲉ", "g": "Ց ց Ꮐ ꮐ", "h": "Հ հ Ꮋ ꮋ Ⲏ ⲏ", "i": "Ⲓ ⲓ", "j": "Յ յ Ꭻ ꭻ", "k": "Ꮶ ꮶ Ⲕ ⲕ",
    "m": "Ꮇ ꮇ Ⲙ ⲙ", "n": "Ո ո Ⲛ ⲛ", "o": "Օ օ Ⲟ ⲟ", "p": "Ꮲ ꮲ Ⲣ ⲣ", "q": "Զ զ", "s": "Ꮪ ꮪ", "t": "Ꭲ ꭲ Ⲧ ⲧ", "u": "Ս ս", "v": "Ꮩ ꮩ", "w": "Ꮃ ꮃ", "x": "Ⲭ ⲭ", "y": "Ⲩ ⲩ", "z": "Ꮓ ꮓ Ⲍ ⲍ",
}
# Characters without ink that belong to no format category.
BLANK_LIKE = "\u2800"
INVISIBLE_MARKS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u3164\uffa0"
LOOK_OF = {x: latin for table in (LOOK_ALIKES, MORE_LOOK_ALIKES) for latin, others in table.items() for x in others.split()}
CONTROL_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85"


def _single(ch: str) -> str:
    """What one decomposed character becomes: itself, its plain-width form, its look-alike, a blank or nothing."""
    category = unicodedata.category(ch)
    if ch in CONTROL_BLANKS or ch in BLANK_LIKE or category in ("Zs", "Zl", "Zp"):
        return " "
    if category in ("Cf", "Cc") or ch in INVISIBLE_MARKS or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF:
        return ""
    if ch in LOOK_OF:
        return LOOK_OF[ch]
    kind = unicodedata.decomposition(ch).partition(" ")[0]
    if kind in ("<wide>", "<narrow>", "<font>") or 0xFB00 <= ord(ch) <= 0xFB06 or 0x2160 <= ord(ch) <= 0x217F:
        return "".join(LOOK_OF.get(x, x) for x in unicodedata.normalize("NFKC", ch))
    return ch


def _canon(segment: str) -> str:
    """Decompose, replace character by character, compose again."""
    apart = unicodedata.normalize("NFD", segment)
    return unicodedata.normalize("NFC", "".join(map(_single_cached, apart)))


_single_cached = lru_cache(maxsize=65536)(_single)


def _quick_check_fails(ch: str) -> bool:
    return (
        unicodedata.category(ch)[0] == "M"
        or not unicodedata.is_normalized("NFC", ch)
        or 0x1160 <= ord(ch) <= 0x11FF  # jamo that join the syllable before them
        or _canon(ch) != ch
        or not unicodedata.is_normalized("NFC", ch.casefold())
    )


@lru_cache(maxsize=1)
def unstable_pattern() -> re.Pattern:
    """Matches every run of characters that fail the quick check."""
    runs: list[list[int]] = []
    for cp in [*range(0x00, 0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE0200)]:
        if _quick_check_fails(chr(cp)):
            if runs and runs[-1][1] == cp - 1:
                runs[-1][1] = cp
            else:
                runs.append([cp, cp])
    inside = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    return re.compile(f"[{inside}]+")


@lru_cache(maxsize=100_000)
def _short_segment(segment: str) -> str:
    return _folded_segment(segment)


def _folded_segment(segment: str) -> str:
    return unicodedata.normalize("NFC", _canon(segment).casefold())


def _canon_segment(segment: str) -> str:
    """The consistent form of an unstable segment with the stable character before it, without regard to case."""
    return _short_segment(segment) if len(segment) <= 16 else _folded_segment(segment)


def canonical(text: str | None) -> str | None:
    """The consistent form: case, width, look-alikes, invisible characters and the amount of blank space agree.

    Accents and raised digits stay. Null stays null; text without visible characters becomes "".
    """
    if text is None:
        return None
    if text.isascii():
        if _ASCII_CONTROLS.search(text):
            text = _ASCII_CONTROLS.sub("", text)
        return " ".join(text.split()).lower()
    parts, done = [], 0
    for m in unstable_pattern().finditer(text):
        start = max(done, m.start() - 1)  # one stable character before the run, for marks to join
        parts += (text[done:start].casefold(), _canon_segment(text[start : m.end()]))
        done = m.end()
    parts.append(text[done:].casefold())  # what passes the quick check stays normal when its case is folded
    return " ".join(x for x in "".join(parts).split(" ") if x)


#: What is invisible among the plain characters; those that separate words are blanks.
_ASCII_CONTROLS = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]+")
_OUTSIDE_FORM = regex.compile(r"[^\p{L}\p{M}\p{N}./%:]+")


def matching_form(text: str | None) -> str | None:
    """The form of chunk_rows.normalised, of a text already canonical: only letters, digits and . / % : stay."""
    return None if text is None else _OUTSIDE_FORM.sub(" ", text).strip()


# ---- anchors: any quote of a class shares its one anchor with every text that contains it ----

#: class: least length, characters in a gram, grams in a window. Below the last length, grams get shorter.
CLASSES = ((0, 48, 16, 24), (1, 20, 8, 12), (2, 3, 3, 1), (3, 1, 1, 1))
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MULTIPLIERS[1]
    x = (x ^ (x >> np.uint64(27))) * _MULTIPLIERS[2]
    return x ^ (x >> np.uint64(31))


def _doubled(x: np.ndarray, width: int, join) -> np.ndarray:
    """join over every `width` neighbours, by joining runs of 1, 2, 4 ... and then two that overlap or touch."""
    run, level = 1, 0
    while run * 2 <= width:
        x, run, level = join(x[:-run], x[run:], level), run * 2, level + 1
    rest = width - run
    return x if not rest else join(x[:-rest], x[rest:], level)


def _grams(codes: np.ndarray, k: int, salt: int) -> np.ndarray:
    if len(codes) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = _doubled(codes, k, lambda a, b, level: a * _MULTIPLIERS[level] + b)
        return _mix(h + np.uint64((salt * 0x51ED2701 + 1) & 0xFFFFFFFF))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def class_of(quote: str) -> int:
    return next((c for c, least, _, _ in CLASSES if len(quote) >= least), -1)


def quote_anchor(quote: str, form: int) -> int:
    """The smallest gram of the quote's first window."""
    c, _, k, w = CLASSES[class_of(quote)]
    return int(_grams(_codes(quote), k, 8 * form + c)[:w].min().astype(np.int64))


def text_anchors(texts: list[str], form: int, c: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in the list, anchor) of the smallest gram of each window of each text, without repeats. All texts at once."""
    _, _, k, w = CLASSES[c]
    none = np.zeros(0, np.int64)
    if not texts:
        return none, none
    h = _grams(_codes("".join(texts)), k, 8 * form + c)
    if len(h) < w:
        return none, none
    smallest = _doubled(h, w, lambda a, b, _: np.minimum(a, b))
    ends = np.cumsum([len(t) for t in texts])
    first = np.arange(len(smallest))
    owner = np.searchsorted(ends, first, "right")
    whole = first + (w + k - 2) < ends[owner]  # windows that reach into the next text belong to none
    owner, anchors = owner[whole], smallest[whole]
    # Neighbouring windows mostly share their smallest gram; what repeats further on is dropped by sorting.
    fresh = np.ones(len(anchors), bool)
    fresh[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
    owner, anchors = owner[fresh], anchors[fresh]
    order = np.lexsort((anchors, owner))
    owner, anchors = owner[order], anchors[order]
    fresh = np.ones(len(anchors), bool)
    fresh[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], anchors[fresh].astype(np.int64)


@F.pandas_udf(T.StringType())
def canonical_column(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


@F.pandas_udf(T.StringType())
def matching_column(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: matching_form(canonical(s)), na_action="ignore")


def consistent_texts(df: DataFrame, *columns: str) -> DataFrame:
    """Adds <column>_canonical for each column; other columns and their order stay."""
    return df.withColumns({f"{c}_canonical": canonical_column(F.col(c)) for c in columns})


def _quote_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, group, mark, text in zip(pdf["quote_key"], pdf["group_key"], pdf["group_mark"], pdf["text"]):
            seen = canonical(text)
            for form, s in enumerate((seen, matching_form(seen))):
                if s:
                    rows.append((key, group, form, class_of(s), quote_anchor(s, form) ^ mark, s))
        yield pd.DataFrame(rows, columns=["quote_key", "group_key", "form", "size_class", "anchor", "quote"])


def _text_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets: dict[int, tuple[list[int], list[str]]] = {}
        for i, (text, form_text, wanted) in enumerate(zip(pdf["text"], pdf["form_text"], pdf["wanted"])):
            form = 0 if text is not None else 1
            classes = [w for w in map(int, wanted) if w // 4 == form]
            s = (matching_form(canonical(form_text)) if form else canonical(text)) if classes else None
            for w in classes if s else ():
                places, texts = sets.setdefault(w, ([], []))
                places.append(i)
                texts.append(s)
        rows, anchors = [], []
        for w, (places, texts) in sets.items():
            owner, found = text_anchors(texts, w // 4, w % 4)
            rows.append(np.array(places)[owner])
            anchors.append(found)
        at = np.concatenate(rows) if rows else np.zeros(0, int)
        found = np.concatenate(anchors) if anchors else np.zeros(0, np.int64)
        yield pd.DataFrame({"text_key": pdf["text_key"].to_numpy()[at], "anchor": found ^ pdf["group_mark"].to_numpy(np.int64)[at]})


def find_quotes(texts: DataFrame, quotes: DataFrame, *, text_id: str, quote_id: str, group: str, text: str = "text", form_text: str | None = None, quote: str = "text") -> DataFrame:
    """(text_id, quote_id) for every quote that reads the same as a passage of a text of the same group.

    Where `text` is null, the quote in matching form is looked for in `form_text`. Nulls in an id, group or
    quote match nothing, an empty quote matches nothing, repeated rows give one pair, and long texts are read
    whole. Both sides meet on the anchor mixed with the group's hash; a text sends one anchor per window, a quote
    exactly one, so no group is ever gathered or paired up, and each candidate pair is verified on its group and
    the whole texts.
    """
    form_col = F.col(form_text) if form_text else F.lit(None).cast("string")
    q = quotes.select(F.col(quote_id).alias("quote_key"), F.col(group).alias("group_key"), F.col(quote).alias("text")).where("quote_key is not null and group_key is not null and text is not null")
    t = texts.select(F.col(text_id).alias("text_key"), F.col(group).alias("group_key"), F.col(text).alias("text"), form_col.alias("form_text")).where("text_key is not null and group_key is not null and (text is not null or form_text is not null)")
    key_type, group_type, quote_type = t.schema["text_key"].dataType.simpleString(), t.schema["group_key"].dataType.simpleString(), q.schema["quote_key"].dataType.simpleString()
    q = q.withColumn("group_mark", F.xxhash64("group_key")).mapInPandas(_quote_rows, f"quote_key {quote_type}, group_key {group_type}, form int, size_class int, anchor bigint, quote string").distinct()
    # A text only sends the classes that quotes of its group have; at most eight numbers a group.
    wanted = q.groupBy("group_key").agg(F.collect_set(F.col("form") * 4 + F.col("size_class")).alias("wanted"))
    anchors = t.join(wanted, "group_key").withColumn("group_mark", F.xxhash64("group_key")).mapInPandas(_text_rows, f"text_key {key_type}, anchor bigint")
    candidates = anchors.join(q, "anchor").select("text_key", "group_key", "quote_key", "form", "quote")
    verified = candidates.join(t, ["text_key", "group_key"]).select(
        "text_key", "quote_key", "quote", "form", F.when(F.col("form") == 0, F.col("text")).when(F.col("text").isNull(), F.col("form_text")).alias("raw")
    )
    verified = verified.where("raw is not null").mapInPandas(_verify, f"text_key {key_type}, quote_key {quote_type}")
    return verified.distinct().select(F.col("text_key").alias(text_id), F.col("quote_key").alias(quote_id))


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo: dict[tuple[int, str], str] = {}
    for pdf in batches:
        keep = []
        for quote, form, raw in zip(pdf["quote"], pdf["form"], pdf["raw"]):
            key = (int(form), raw)
            if key not in memo:
                if len(memo) > 256:
                    memo.clear()
                seen = canonical(raw)
                memo[key] = matching_form(seen) if form else seen
            keep.append(quote in memo[key])
        yield pdf.loc[keep, ["text_key", "quote_key"]]

