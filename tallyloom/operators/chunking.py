"""Pages to elements to chunks: word-budgeted, token-budgeted and structure-aware packing.

A document is one row holding its pages in order; one mapInPandas pass parses and packs it, so no document needs a
shuffle of its own and large ones stay on one executor only as large as their text. The three strategies are one packer
with different rules: what is atomic, what is carried over, and what happens to an atom beyond the budget.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import BULLET_REGEX, SENTENCE_BREAK

PARAGRAPH = re.compile(r"(?:[ \t]*\r?\n[ \t]*){2,}")
LINE = re.compile(r"[ \t]*\r?\n[ \t]*")
SENTENCE = re.compile(SENTENCE_BREAK)
BULLET = re.compile(BULLET_REGEX)
TOKEN = re.compile(r"\w+|[^\w\s]")
BLANK_SHARE = 0.1
#: Chunks that a task holds before it hands them on.
HELD_ROWS = 4096


@dataclass
class Element:
    kind: str  # heading, narrative or table
    text: str
    page: int


@dataclass
class Rules:
    """budget and overlap in units of `count`; carry: overlap by sentences; whole: elements stay in one piece."""

    budget: int = 310
    overlap: int = 62
    count: Callable[[str], int] = field(default=lambda s: len(s.split()))
    whole: bool = False
    split_tables: bool = False
    split_atoms: bool = False
    heading_share: float = 0.9
    count_headings: bool = False


def table_like(text: str) -> bool:
    lines = [x.rstrip() for x in text.splitlines() if x.strip()]
    if len(lines) < 2:
        return False
    return sum("|" in x for x in lines) >= 2 or sum("  " in x for x in lines) >= max(2, len(lines) // 2)


def blocks_of(text: str) -> list[str]:
    """Paragraphs; list items stay apart, and hard-wrapped lines are joined where blank lines are rare."""
    lines = text.splitlines()
    wrapped = not lines or sum(not x.strip() for x in lines) / len(lines) < BLANK_SHARE
    out = []
    for block in PARAGRAPH.split(text):
        if any(BULLET.match(x) for x in block.splitlines()):
            out += LINE.split(block)
        else:
            out.append(LINE.sub(" ", block) if wrapped else block)
    return [b.strip() for b in out if b.strip()]


def kind_of(block: str) -> str:
    """heading for a short line that reads as no sentence, else narrative."""
    words = block.split()
    letters = [w for w in words if any(ch.isalpha() for ch in w)]
    if BULLET.match(block) or not letters or len(words) > 12 or block[-1] in ".,:;" or block.replace(".", "").replace(",", "").strip().isdigit():
        return "narrative"
    capitals = sum(w[0].isupper() for w in letters) / len(letters)
    return "heading" if block == block.upper() or capitals >= 0.5 or len(words) <= 6 else "narrative"


def elements_of(pages: Iterable[tuple[int | None, str | None]]) -> Iterator[Element]:
    """Elements of pages in order; a page number that is none or below 1 counts as 1."""
    for number, text in pages:
        page = int(number) if number and number >= 1 else 1
        if not text or not text.strip():
            continue
        if table_like(text):
            yield Element("table", text.strip(), page)
            continue
        for block in blocks_of(text):
            yield Element(kind_of(block), block, page)


def sentences_of(text: str) -> list[str]:
    return [s.strip() for s in SENTENCE.split(text) if s.strip()]


def split_word(word: str, count: Callable[[str], int], budget: int) -> list[str]:
    """A word in as few parts as the budget allows; a single character is never cut."""
    parts = []
    while len(word) > 1 and count(word) > budget:
        fits, beyond = 1, len(word)
        while beyond - fits > 1:
            middle = (fits + beyond) // 2
            fits, beyond = (middle, beyond) if count(word[:middle]) <= budget else (fits, middle)
        parts.append(word[:fits])
        word = word[fits:]
    return [*parts, word]


def split_words(text: str, count: Callable[[str], int], budget: int) -> list[str]:
    """Parts at blanks within the budget; a word beyond it is cut."""
    parts, held, used = [], [], 0
    for w in (part for word in text.split() for part in split_word(word, count, budget)):
        n = count(w)
        if held and used + n > budget:
            parts.append(" ".join(held))
            held, used = [], 0
        held.append(w)
        used += n
    return parts + [" ".join(held)] if held else parts


def split_table(text: str, count: Callable[[str], int], budget: int, header_lines: int = 2) -> list[str]:
    """Parts at row borders, each with the header; a row beyond the room is cut at blanks."""
    lines = text.splitlines()
    header, rows = lines[:header_lines], [x for x in lines[header_lines:] if x.strip()]
    if not rows:
        return [text.strip()] if text.strip() else []
    room = budget - count("\n".join(header))
    if room <= 0:
        header, room = [], budget
    groups: list[list[str]] = []
    used = room + 1
    for row in rows:
        pieces = [row] if count(row) <= room else split_words(row, count, room)
        for piece in pieces:
            n = count(piece)
            if used + n > room or len(pieces) > 1:
                groups.append([])
                used = 0
            groups[-1].append(piece)
            used = used + n if len(pieces) == 1 else room + 1
    return ["\n".join([*header, *g]).strip() for g in groups]


def section_after(path: list[str], heading: str) -> list[str]:
    """A short heading in capitals begins a new path, any other one goes deeper."""
    top = len(heading.split()) <= 8 and heading == heading.upper()
    return [heading] if top else [*path, heading]


class Packer:
    """Collects units and hands out chunk rows."""

    def __init__(self, rules: Rules):
        self.rules, self.index, self.path = rules, 0, []
        self.units: list[tuple[str, str, int, int]] = []  # kind, text, page, size
        self.carried = 0  # units at the front that only repeat the chunk before
        self.opened: list[str] = []

    def size(self) -> int:
        return sum(n for kind, _, _, n in self.units if kind == "sentence" or self.rules.count_headings)

    def row(self, text: str, pages: list[int], sentences: int, **more) -> dict:
        base = {"chunk_index": self.index, "text": text, "word_count": len(text.split()), "sentence_count": sentences, "page_start": min(pages), "page_end": max(pages),
                "section_path": list(self.path), "contains_table": False, "overlap_with_previous": False, "sub_index": None, "sub_count": None, "sub_of": None}
        self.index += 1
        return base | more

    def flush(self, carry: bool = True) -> Iterator[dict]:
        if len(self.units) > self.carried:
            text = (" " if not self.rules.whole else "\n\n").join(u[1] for u in self.units).strip()
            path = self.opened if self.rules.whole else list(self.path)
            yield self.row(text, [u[2] for u in self.units], sum(len(sentences_of(u[1])) if self.rules.whole else 1 for u in self.units if u[0] == "sentence"), overlap_with_previous=self.carried > 0, section_path=path)
        tail: list = []
        if carry and self.rules.overlap and not self.rules.whole:
            used = 0
            for unit in reversed([u for u in self.units if u[0] == "sentence"]):
                if tail and used + unit[3] > self.rules.overlap:
                    break
                tail.insert(0, unit)
                used += unit[3]
            if used > self.rules.budget:
                tail = []
        self.units, self.carried = tail, len(tail)

    def add(self, kind: str, text: str, page: int, n: int) -> Iterator[dict]:
        if self.units and (kind == "sentence" or self.rules.count_headings) and self.size() + n > self.rules.budget:
            if len(self.units) > self.carried:
                yield from self.flush()
            if self.carried and self.size() + n > self.rules.budget and self.rules.count_headings:
                self.units, self.carried = [], 0  # the repeated tail would crowd out the new unit
        if not self.units:
            self.opened = list(self.path)
        self.units.append((kind, text, page, n))

    def parts(self, parts: list[str], page: int, of: str, table: bool = False, sentences: int = 0) -> Iterator[dict]:
        for i, part in enumerate(parts):
            yield self.row(part, [page], sentences, contains_table=table, sub_index=i, sub_count=len(parts), sub_of=of)

    def run(self, elements: Iterable[Element]) -> Iterator[dict]:
        r = self.rules
        for e in elements:
            size = r.count(e.text) if r.whole or e.kind == "heading" or (e.kind == "table" and r.split_tables) else 0
            if e.kind == "heading":
                self.path = section_after(self.path, e.text)
                if len(self.units) > self.carried and self.size() >= r.budget * r.heading_share:
                    yield from self.flush()
                if r.split_atoms and size > r.budget:
                    yield from self.flush(carry=False)
                    yield from self.parts(split_words(e.text, r.count, r.budget), e.page, "heading")
                else:
                    yield from self.add("heading", e.text, e.page, size)
            elif e.kind == "table":
                yield from self.flush(carry=False)
                if r.split_tables and size > r.budget:
                    yield from self.parts(split_table(e.text, r.count, r.budget), e.page, "table", table=True)
                else:
                    yield self.row(e.text, [e.page], 0, contains_table=True)
            elif r.whole and size <= r.budget:
                yield from self.add("sentence", e.text, e.page, size)
            elif r.whole:
                yield from self.flush(carry=False)
                groups: list[list[str]] = [[]]
                for s in sentences_of(e.text):
                    if groups[-1] and r.count(" ".join([*groups[-1], s])) > r.budget:
                        groups.append([])
                    groups[-1].append(s)
                yield from self.parts([" ".join(g) for g in groups if g], e.page, "sentence", sentences=1)
            else:
                for s in sentences_of(e.text):
                    n = r.count(s)
                    if r.split_atoms and n > r.budget:
                        yield from self.flush(carry=False)
                        yield from self.parts(split_words(s, r.count, r.budget), e.page, "sentence", sentences=1)
                    else:
                        yield from self.add("sentence", s, e.page, n)
        yield from self.flush(carry=False)


def word_budget(max_words: int = 310, overlap: int = 62) -> Rules:
    return Rules(budget=max_words, overlap=overlap)


def token_budget(max_tokens: int = 256, overlap: int = 64, reserve: int = 2, count: Callable[[str], int] | None = None) -> Rules:
    budget = max_tokens - reserve
    if budget <= 0:
        raise ValueError("max_tokens minus reserve leaves no room for text")
    return Rules(budget=budget, overlap=max(0, min(overlap, budget - 1)), count=count or (lambda s: len(TOKEN.findall(s))), split_tables=True, split_atoms=True, count_headings=True)


def structure_aware(max_tokens: int = 256, reserve: int = 2, count: Callable[[str], int] | None = None) -> Rules:
    return Rules(budget=max_tokens - reserve, overlap=0, count=count or (lambda s: len(TOKEN.findall(s))), whole=True, count_headings=True)


CHUNK_COLUMNS = "chunk_index int, text string, word_count int, sentence_count int, page_start int, page_end int, section_path array<string>, contains_table boolean, overlap_with_previous boolean, sub_index int, sub_count int, sub_of string"


def chunk_documents(pages: DataFrame, rules: Rules, *, document: str = "document", page: str = "page", text: str = "text") -> DataFrame:
    """Chunks of every document: document, chunk_index, text, counts, page span, section path, table and overlap flags, sub parts.

    pages has one row per page. Null and empty pages add nothing, a document without text has no chunk, rows without a
    document are left out, repeated pages count once.
    """
    return chunk_strategies(pages, {"": rules}, document=document, page=page, text=text).drop("strategy")


def chunk_strategies(pages: DataFrame, strategies: dict[str, Rules], *, document: str = "document", page: str = "page", text: str = "text") -> DataFrame:
    """The chunks of chunk_documents by each of the named rules, with the name as strategy; a document is parsed once for all."""
    kind = pages.schema[document].dataType.simpleString()
    rows = pages.where(F.col(document).isNotNull()).select(F.col(document).alias("document"), F.col(page).cast("int").alias("page"), F.col(text).alias("text")).distinct()
    whole = rows.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
    names = ["strategy", "document", *(c.strip().split()[0] for c in CHUNK_COLUMNS.split(", "))]

    def packed(pdf: pd.DataFrame) -> Iterator[dict]:
        for doc, listed in zip(pdf["document"], pdf["pages"]):
            elements = list(elements_of((p["page"], p["text"]) for p in listed))
            for name, rules in strategies.items():
                for row in Packer(rules).run(elements):
                    yield {"strategy": name, "document": doc} | row

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = packed(pdf)
            while out := list(islice(rows, HELD_ROWS)):
                yield pd.DataFrame(out, columns=names).astype({"sub_index": "Int64", "sub_count": "Int64"})

    return whole.mapInPandas(pack, f"strategy string, document {kind}, {CHUNK_COLUMNS}")


def page_elements(pages: DataFrame, *, document: str = "document", page: str = "page", text: str = "text") -> DataFrame:
    """(document, page, position, kind, block) of each page, without packing."""
    kind = pages.schema[document].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(d, e.page, i, e.kind, e.text) for d, p, t in zip(pdf["document"], pdf["page"], pdf["text"]) for i, e in enumerate(elements_of([(None if p != p else p, t)]))]
            yield pd.DataFrame(out, columns=["document", "page", "position", "kind", "block"])

    return pages.select(F.col(document).alias("document"), F.col(page).cast("int").alias("page"), F.col(text).alias("text")).mapInPandas(parse, f"document {kind}, page int, position int, kind string, block string")
