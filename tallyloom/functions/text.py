"""Text functions as Column expressions; Python only where no built-in says the same."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters trimmed from both ends of a question before it is compared.
MATCH_TRIM = " \t\r\n\"'`“”‘’«»"
# Wordings of the refusal net.
REFUSAL_NET = (
    "insufficient information", "cannot answer", "can not answer", "can't answer", "unable to answer", "do(?:es)? not (?:contain|provide|include|have)",
    "no (?:relevant )?(?:information|evidence|context)", "not (?:enough|sufficient) (?:information|context|evidence)", "i (?:don'?t|do not) have (?:enough|sufficient)",
)
REFUSAL_REGEX = "(?i)" + "|".join(REFUSAL_NET)
# Fixed value: the marker an application answers with when it abstains.
ABSTENTION_MARKER = "I can not answer the question because of the insufficient information in documents."
# How a block starts when it is an item of a list.
BULLET_REGEX = r"^\s*(?:[\*\-·•‣⁃∙▪●◦▫]|\(?[0-9]{1,2}[\.\)]|\(?[a-zA-Z][\.\)])\s+"
# Spellings of the two labels of an annotator.
POSITIVE_LABELS, NEGATIVE_LABELS = ("1", "true", "yes", "y", "faithful", "supported"), ("0", "false", "no", "n", "hallucinated", "unfaithful", "unsupported")

BLANKS = r"[\s\p{Z}]+"


def collapse_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def match_key(c: Column, trim_set: str = MATCH_TRIM) -> Column:
    """Lower case, single blanks, no quotes or blanks at the ends. Null gives the empty key."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), BLANKS, " "), F.lit(trim_set))


def normalise_for_match(c: Column) -> Column:
    """Tags and everything but letters, digits and . / % : become blanks, in lower case."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, "<[^>]+>", " ")), r"[^\p{L}\p{N}./%:]+", " "))


@F.pandas_udf(T.StringType())
def unescape_twice(texts: pd.Series) -> pd.Series:
    """Character references resolved, also where they were escaped twice."""
    return texts.map(lambda s: html.unescape(html.unescape(s)) if "&" in s else s, na_action="ignore")


def blank_tokens(normalised: Column) -> Column:
    """Words between blanks; no words of an empty text."""
    return F.filter(F.split(normalised, " "), lambda w: w != "")


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once a row; inside a lambda an expression is else computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by blanks; n tokens or fewer are one shingle, no tokens none."""

    def of(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) == 0, F.array().cast("array<string>")).when((F.size(t) <= n) | F.lit(n <= 1), F.array(F.array_join(t, " "))).otherwise(runs)

    return bound(tokens, of)


def coverage(part: Column, whole: Column) -> Column:
    """Share of the distinct members of `part` that `whole` has too; null where part is empty."""
    mine = F.array_distinct(part)
    return F.try_divide(F.size(F.array_intersect(mine, whole)).cast("double"), F.size(mine).cast("double"))


def refused_by_net(c: Column) -> Column:
    return F.coalesce(c.rlike(REFUSAL_REGEX), F.lit(False))


def marker_match(c: Column, marker: str = ABSTENTION_MARKER) -> Column:
    """The marker alone or anywhere inside, in any case."""
    return F.coalesce(F.contains(F.lower(c), F.lit(marker.lower())), F.lit(False))


def coerce_label(c: Column) -> Column:
    """1, 0 or null from the usual spellings of a label."""
    word = F.lower(F.trim(c))
    return F.when(word.isin(*POSITIVE_LABELS), 1).when(word.isin(*NEGATIVE_LABELS), 0)


def lines_of(c: Column) -> Column:
    return F.split(c, r"\r\n|\r|\n")


def filled_lines(c: Column) -> Column:
    return F.filter(lines_of(c), lambda x: F.length(F.trim(F.regexp_replace(x, BLANKS, " "))) > 0)


def blank_line_ratio(c: Column, sample: int | None = None) -> Column:
    """The share of blank lines, of all lines or of the first `sample` ones."""
    some = lines_of(c) if sample is None else F.slice(lines_of(c), 1, sample)
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(F.size(F.filter(some, lambda x: F.trim(F.regexp_replace(x, BLANKS, " ")) == "")) / F.size(some))


def looks_like_table(c: Column, min_lines: int = 2, min_pipe_lines: int = 2, min_spaced: int = 2, spaced_share: float = 0.5) -> Column:
    """Enough lines with a pipe, or at least half of the lines with a run of blanks."""
    lines = F.transform(filled_lines(c), lambda x: F.rtrim(x))
    n = F.size(lines)
    piped = F.size(F.filter(lines, lambda x: x.contains("|")))
    spaced = F.size(F.filter(lines, lambda x: x.contains("  ")))
    return (n >= min_lines) & ((piped >= min_pipe_lines) | (spaced >= F.greatest(F.lit(min_spaced), F.floor(n * spaced_share).cast("int"))))


def collapse_table_padding(c: Column, max_blank_lines: int = 1) -> Column:
    """Runs of blanks inside lines become one; so many blank lines stay in a row."""
    tight = F.regexp_replace(c, r"[ \t]{2,}", " ")
    return F.regexp_replace(tight, r"\n(?:[ \t]*\n){%d,}" % (max_blank_lines + 1), "\n" * (max_blank_lines + 1))


def is_bulleted(c: Column) -> Column:
    return F.exists(filled_lines(c), lambda x: x.rlike(BULLET_REGEX))


def words_of(c: Column) -> Column:
    return blank_tokens(collapse_blanks(c))


def word_count(c: Column) -> Column:
    return F.size(words_of(c))


def capitalised_ratio(c: Column) -> Column:
    """Words in capitals or beginning with one and going on small, among the words that have a letter."""
    words = F.filter(words_of(c), lambda w: w.rlike(r"\p{L}"))
    caps = F.filter(words, lambda w: w.rlike(r"^\P{L}*(?:\p{Lu}[\P{Lu}]*|[\P{Ll}]+)$"))
    return F.coalesce(F.try_divide(F.size(caps).cast("double"), F.size(words).cast("double")), F.lit(0.0))


def alpha_ratio(c: Column) -> Column:
    """Letters among all characters that aren't blank."""
    ink = F.length(F.regexp_replace(c, BLANKS, ""))
    return F.when(ink > 0, F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / ink).otherwise(F.lit(0.0))


SENTENCE_BREAK = r"(?<=[.!?])\s+"


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_BREAK), lambda s: F.trim(s)), lambda s: s != "")


def sentence_count(c: Column, min_words: int = 5) -> Column:
    return F.size(F.filter(sentences(c), lambda s: F.size(F.filter(F.split(s, BLANKS), lambda w: w != "")) >= min_words))


def looks_like_narrative(c: Column, cap_ratio: float = 0.5, least_alpha: float = 0.5, min_sentences: int = 2, has_verb: Column | None = None) -> Column:
    """Prose: not mostly capitalised, mostly letters, and two sentences or a verb. The verb test is a hook for a model."""
    verb = has_verb if has_verb is not None else word_count(c) >= 8
    return (F.upper(c) != c) & (capitalised_ratio(c) <= cap_ratio) & (alpha_ratio(c) >= least_alpha) & ((sentence_count(c) >= min_sentences) | verb)


def looks_like_title(c: Column, max_words: int = 12) -> Column:
    """A short line without closing punctuation that is no bare number and no more than a sentence."""
    body = F.trim(c)
    return (F.length(body) > 0) & (word_count(body) <= max_words) & ~body.rlike(r"[.,:;]$") & ~F.regexp_replace(body, "[.,]", "").rlike(r"^\s*\d+\s*$") & (sentence_count(body) <= 1)


def classify_block(c: Column) -> Column:
    return F.when(is_bulleted(c) | looks_like_narrative(c), "narrative").when(looks_like_title(c), "heading").otherwise("narrative")


def top_level_heading(c: Column) -> Column:
    return (word_count(c) <= 8) & (F.upper(F.trim(c)) == F.trim(c))


def coerce_page(c: Column, default: int = 1) -> Column:
    page = c.try_cast("int")
    return F.when(page >= 1, page).otherwise(F.lit(default))


def policy_unit(label: Column) -> Column:
    """words, tokens or null, from a label such as sentence_w310_o62."""
    mark = F.regexp_extract(label, r"_([wt])[0-9]+", 1)
    return F.when(mark == "w", "words").when(mark == "t", "tokens")


def policy_family(label: Column) -> Column:
    return F.regexp_replace(label, r"_[wto][0-9]+.*$", "")


def policies_agree(found: Column, expected: Column, how: str = "exact") -> Column:
    if how == "exact":
        return found == expected
    return policy_family(found) == policy_family(expected) if how == "prefix" else policy_unit(found) == policy_unit(expected)


def clip(c: Column, n: int = 70) -> Column:
    folded = collapse_blanks(c)
    return F.when(F.length(folded) > n, F.concat(F.substring(folded, 1, n), F.lit("..."))).otherwise(folded)

