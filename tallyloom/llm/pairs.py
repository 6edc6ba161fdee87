"""Defective answers of question and answer pairs: empty, copied, refusal, other_language, truncated.

Refusals show as templates: the sentences of all answers that give no number of their own are clustered by MinHash,
every link verified by the Jaccard similarity of the word shingles themselves, with the words of the own question
masked. A cluster that recurs under unrelated prompts is a refusal template where it is drawn by questions that can't
be answered far more often than answers in general, or consists of words of every sentence with none of the matter
(none of questions and of gold answers), or declines in a known wording with hardly a word of the matter; the wordings
are the weakest of these signs. An answer is a refusal where such templates and courtesies are all it holds. Where a
sentence stops short is learnt from all answers: how often the last words before the end of a text end a sentence
elsewhere, or go on.
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
from pyspark.sql.window import Window

from tallyloom.session import materialise, shuffle_width

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Word overlap (Jaccard) of two questions below which they are unrelated.
UNRELATED = 0.2
#: Unrelated prompts beside the template's first one that a known wording needs, and that the other signs need.
LEAST_SAID, LEAST_TOLD = 1, 3
#: Odds of unanswerable prompts under a template, at the lower 95 % bound, as a multiple of the odds in all answers;
#: the least share of them; and the least prompts it is taken from.
LEAST_ODDS, LEAST_SHARE, LEAST_DRAWN = 3.0, 0.25, 10
#: A template says nothing where it has that many words, none of the matter, and at most that share of them is neither a
#: word of every sentence nor one of sources; in a known wording, that share may be of the matter.
LEAST_WORDS, MOST_OTHER, MOST_MATTER = 4, 0.3, 0.2
#: Words before the end of a text whose usual continuation is looked up, longest first.
CONTEXTS = (8, 5, 3, 2, 1)
#: Share of endings below which a context is taken to go on.
LEAST_ENDING = 0.15

_UNSEEN = regex.compile(r"[\p{Cf}͏᠋-᠎︀-️]+")
_CITATION = regex.compile(r"\[\d+\]|\((?:[^()\n]*\.\w{2,4}\b[^()\n]*|(?:p|pp|page|pages|seite|página|strona)\.? ?\d[^()\n]*)\)", regex.I)
_WORD, _PLAIN_WORD, _ASCII_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+"), re.compile(r"[a-z0-9]+"), re.compile(r"[A-Za-z0-9]+")
# Labels that may stand around a question that is only repeated.
LABELS = set("""question answer q a you asked your query prompt reply response the is was i re regarding frage antwort sie fragten ihre f pregunta respuesta usted preguntó su p r
    réponse vous avez demandé votre pytanie odpowiedź zapytano twoje""".split())  # fmt: skip

# Wordings that decline, or say that the sources don't tell, by language.
DECLINING = regex.compile(
    r"""
    \b(?:un|not\ )able\ to\b | \bunable\b | \b(?:can\ ?not|can'?t|could\ not|couldn'?t)\b.*\b(?:find|answer|help|assist|provide|determin|establish|locat|say|tell|confirm|give|comment|access|identif|verif|share|offer|be\ (?:established|determined|answered|given|found|said|confirmed))\w*
    | \bno\ (?:answer|information|knowledge|mention|details?|data|evidence|record|indication|reference)\b | \bnone\ of\ the\ .*\b(?:pages|sources|documents|extracts|records|passages|files|reports)\b
    | \b(?:do|does|did)(?:\ not|n'?t)\b.*\b(?:contain|mention|state|say|cover|include|specify|have|know|provide|address|discuss|tell|give|answer)\b
    | \bnot\ (?:enough|sufficient|stated|mentioned|available|specified|covered|contained|included|provided|given|supplied|recorded|found|present|clear|in\ the)\b | \binsufficient\b | \bsilent\ on\b | \bsays?\ nothing\b
    | \bfalls?\ outside\b | \boutside\ (?:the\ scope|what)\b | \bbeyond\ (?:the\ scope|what)\b | \bwould\ need\b.*\b(?:documents?|records?|information|context|sources?)\b | \bmust\ decline\b | \brather\ not\b | \bwere\ not\ supplied\b | \bwon'?t\ be\ able\b
    | \bkeine?\ (?:angaben?|informationen?|auskunft|antwort|hinweise?|daten)\b | \bnicht\ (?:beantworten|finden|enthalten|sagen|möglich|bekannt|angegeben|genannt|feststellen|helfen|ermitteln)\b | \bgeht\ .*\bnicht\ hervor\b | \bweiß\ .*\bnicht\b
    | \bn(?:e\ |')(?:\w+\ )?(?:trouv|peu[xt]|pouv|puis|dispos|sai[st]|connai|contien|mentionn|précis|indiqu|figur|permet|ai|est\ pas\ (?:indiqu|mentionn|précis|disponible|possible))\w*\b.*\b(?:pas|aucune?|rien)\b | \bn'est\ pas\ (?:indiqu|mentionn|précis|disponible|possible)\w* | \baucune?\ (?:information|réponse|mention|donnée|indication)\b | \bimpossible\ de\b
    | \bno\ (?:puedo|podemos|encuentro|encontré|dispongo|tengo|consta|sé|hay|figura|es\ posible|contienen|contiene|aparece|se\ (?:menciona|indica|encuentra|puede))\b
    | \bnie\ (?:mogę|możemy|znajduję|znalazłem|znaleziono|wiem|ma|jestem\ w\ stanie|zawierają|zawiera|podano|da\ się|można|potrafię)\b | \bbrak\ (?:informacji|danych|odpowiedzi)\b
    """,
    regex.X,
)
# Wordings beside a refusal that add nothing: courtesy, referral, announcement.
IDLE = regex.compile(
    r"""
    ^(?:h+m+|well|oh|ok(?:ay)?|sorry|apologies|regrettably|unfortunately|hello|hi|dear\ \w+|note|sure|certainly|of\ course)\b(?:\W*$|\W.{0,12}$)
    | ^(?:thank\ you|thanks|many\ thanks|sorry\ for|my\ apologies|i\ apologi[sz]e|good\ (?:question|morning|afternoon)|having\ (?:read|checked|reviewed|searched)|after\ (?:reading|checking|reviewing)|i\ (?:have\ )?(?:\w+ly\ )?(?:read|checked|reviewed|searched|looked)|as\ an?\ (?:ai|assistant|language))\b
    | ^(?:you|one)\ (?:may|might|could|can|should)\ (?:\w+\ ){0,2}(?:ask|contact|consult|check|refer|speak|try)\b | ^(?:please|kindly)\ (?:\w+\ )?(?:ask|contact|consult|check|refer|see|speak|try|provide|rephrase|supply|upload|let)\b
    | ^(?:is\ there\ anything|let\ me\ know|feel\ free|i\ hope|if\ you\ (?:need|have|can|would|like))\b
    | ^(?:bitte\ wenden|bitte\ fragen|wenden\ sie|fragen\ sie|leider$|danke|vielen\ dank|entschuldigung|es\ tut\ mir\ leid) | ^(?:veuillez|adressez|désolée?$|merci|je\ suis\ désolée?$|vous\ pouvez\ (?:demander|contacter)|contactez)
    | ^(?:consulte|pregunte|póngase|gracias|lo\ siento$|puede\ (?:preguntar|consultar|contactar)|contacte) | ^(?:proszę|dziękuję|niestety$|przepraszam|przykro\ mi|może\ pan|można\ zapytać|skontaktuj)
    """,
    regex.X,
)
# Joints after which a declining sentence may still give something.
TURN = regex.compile(r"([;:]|\s[-–—]\s|,?\s\b(?:but|while|however|although|though|whereas|yet|instead|so\ here|still|aber|jedoch|während|sondern|mais|cependant|tandis\ que|pero|aunque|sin\ embargo|mientras|ale|jednak|natomiast|lecz)\b)\s?", regex.X)
# The commonest function words of each language.
FUNCTION_WORDS = {
    "en": """the of and to in is was are were be been being that this these those it its on for with as by at from which not have has had must should there their they them no an or if when within after
        before what where who whom how why every each all any some both during until than then into under over about between through because so but do does did will would can could may might shall only
        also more most other such same his her our your you we he she out up off per none""",
    "de": """der die das und ist war sind waren ein eine einen einer eines im in den dem des zu zum zur mit von vom für auf nicht kein keine wurde wurden wird werden worden sich nach bei beim an am es aus als
        auch noch oder wenn hat haben hatte durch ohne wieder neben wer wann welche welcher welches wie wo was warum unter über während zwischen bis seit gegen um dass weil aber nur sehr schon alle jede
        jeder dieser diese dieses ihr ihre sein seine er sie wir ich man innerhalb lang""",
    "fr": """le la les de des du et est était étaient a ont été sont un une dans en pour par sur sous au aux pas ne se sa son ses que qui quoi ce cet cette ces avec ou où après avant il elle ils elles lors dont sans
        soit soient pendant puis quand quelle quel quelles quels comment pourquoi je nous vous leur leurs mais donc si plus très tout tous toute entre depuis jusque chez vers comme aussi même l d qu n jour""",
    "es": """el la los las de del y e es era eran fue fueron ha han son un una unos unas en para por con que se no al su sus sin lo le les como más muy durante después antes había estaba está esta este ese esa esos
        donde dónde quién cuándo qué cuál cómo dentro entre hasta desde sobre bajo pero si ya también cuando porque dio toda todo todos mismo tenía corresponde a""",
    "pl": """w we z ze i na do się nie jest był była było były są to ten ta te tego tej tym po od o u dla przez oraz które który która tych że przy ma mają być lub jako bez kto co kiedy jaka jaki jakie gdzie jak czy
        wynosiła wynosił budynku podczas pod nad za przed między już tylko także oraz albo ale przypada zostały został została a""",
    "it": "il lo gli di del della dello e è era sono un uno una in per con che non si da dal al nel nella alla dei delle questo questa dopo senza anche come più ha hanno stato stata quando chi quale",
    "nl": "de het een van en is was waren zijn in op voor met dat die deze niet geen te aan door er bij om naar wordt worden werd werden na ook maar als wie wat waar wanneer welke hoe",
    "pt": "o os as do da dos das e é era foi foram são um uma em para por com que se não ao no na nos nas seu sua sem como depois mais está estava quando quem qual onde também",
}
_LANGUAGES_OF: dict[str, tuple[str, ...]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in set(_words.split()):
        _LANGUAGES_OF[_w] = (*_LANGUAGES_OF.get(_w, ()), _lang)
#: Words of every sentence in the languages of the logs; those of others are left out, as Dutch "door" is a thing in English.
COMMON_WORDS = frozenset(w for lang in ("en", "de", "fr", "es", "pl") for w in FUNCTION_WORDS[lang].split())
# Letters and groups of letters that hint at one language.
LETTERS = {"de": r"[ßäöü]|sch|ung$|keit$", "fr": r"[çèêàùœîûôâëï]|é|eaux?$", "es": r"[ñáíúó]|ción$|dad$", "pl": r"[łąęśżźćń]|cz|rz|sz|dz|ów$", "pt": r"[ãõ]|ções$", "en": r"ght|th|wh|ing$|tion$"}
_LETTERS = {lang: regex.compile(x) for lang, x in LETTERS.items()}
YES_NO = set("yes no ja nein oui non sí si tak nie none n/a".split())
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())} | {
    "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "dwa": 2, "trzy": 3, "cztery": 4, "pięć": 5,
}
_QUOTED = regex.compile(r"[\"“„«][^\"“”„«»\n]+[\"”“»]")
_SENTENCE = regex.compile(r"(?<=[.!?…])[\"”’»)]*\s+|\s*[\r\n]+\s*")
_ITEM = regex.compile(r"^\s*(?:[-*•–]|\d{1,2}[.)]|[a-z][.)])\s+")
_ANNOUNCED = regex.compile(r"\b(\p{L}+|\d{1,2})\s+\p{L}+(?:\s\p{L}+){0,3}\s*:\s*$", regex.I)


def clean(text: str | None) -> str:
    if text is None:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text)).replace("’", "'").replace("‘", "'")
    return text.replace("*", " ").replace("`", " ").strip()


@lru_cache(maxsize=16)  # a record asks for the same few texts again and again; long ones must not pile up
def folded_words(text: str) -> tuple[str, ...]:
    return tuple(_PLAIN_WORD.findall(text.lower()) if text.isascii() else _WORD.findall(text.casefold()))


_LABEL_BEFORE = regex.compile(r"^(?:\W*\b(?:you asked|your question|question|q|frage|question posée|pregunta|pytanie)\b\W*[:\-]?)?\s*[\"'“”«»]*\s*", regex.I)
_CLOSERS = regex.compile(r"[\s?!.\"'”»)*]*")


def without_question(answer: str, question: str) -> tuple[str, bool]:
    """The answer without each repetition of the question's words and the labels before it; whether it held one."""
    q = " ".join(folded_words(question))
    if not q:
        return answer, False
    if f" {q} " not in f" {' '.join(folded_words(answer))} ":
        return answer, False
    places = [m.span() for m in _WORD.finditer(answer)]
    joined = f" {' '.join(answer[a:b].casefold() for a, b in places)} "
    at = joined.find(f" {q} ")
    if at < 0:
        return answer, False
    size, kept, done = q.count(" ") + 1, [], 0
    while at >= 0:
        first = joined.count(" ", 0, at)
        kept.append(answer[done : places[first][0]])
        done = _CLOSERS.match(answer, places[first + size - 1][1]).end()
        at = joined.find(f" {q} ", at + len(q) + 1)
    kept.append(answer[done:])
    return _LABEL_BEFORE.sub("", " ".join(kept).strip()), True


def is_copied(answer: str, question: str) -> bool:
    return _repeats(answer, question, *without_question(answer, question))


def _repeats(answer: str, question: str, rest: str, held: bool) -> bool:
    words, q = folded_words(answer), folded_words(question)
    if not q or not words:
        return False
    if held:
        return all(w in LABELS for w in folded_words(rest))
    first = next((i for i, w in enumerate(words) if w not in LABELS or w == q[0]), len(words))
    core = words[first:]
    return len(core) >= 4 and len(core) >= 0.6 * len(q) and (core == q[: len(core)] or core == q[-len(core) :])


_LETTERS_FIRST, _SMALL_FIRST = regex.compile(r"\p{L}{3,}"), regex.compile(r"\p{Ll}{3,}")


@lru_cache(maxsize=200_000)
def _votes(word: str, shouted: bool) -> tuple[tuple[str, float], ...]:
    """What one word says for each language: as a function word, and by the letters of its small part."""
    out = [(lang, 1.0) for lang in _LANGUAGES_OF.get(word.casefold(), ())]
    m = _LETTERS_FIRST.match(word.lower()) if shouted else _SMALL_FIRST.match(word)
    return (*out, *((lang, 0.4) for lang, hint in _LETTERS.items() if m and hint.search(m.group())))


def language_of(text: str) -> tuple[str | None, float]:
    """The likeliest language by function words and letters, and its lead; None where too little speaks for any.

    Quotations don't count, nor do the letters of names.
    """
    words = (_ASCII_WORD if text.isascii() else _WORD).findall(text)
    if any(mark in text for mark in "\"“„«"):
        outside = _QUOTED.sub(" ", text)
        beyond = _WORD.findall(outside)
        if len(beyond) >= 3:  # what is quoted as a whole has nothing else to go by
            text, words = outside, beyond
    if sum(map(str.isalpha, words)) < 3:
        return None, 0.0
    shouted = text == text.upper()
    score: dict[str, float] = {}
    for w in words:
        for lang, weight in _votes(w, shouted):
            score[lang] = score.get(lang, 0) + weight
    if not score:
        return None, 0.0
    ranked = sorted(score.values(), reverse=True)
    lead = ranked[0] - (ranked[1] if len(ranked) > 1 else 0)
    return (max(score, key=score.__getitem__), lead) if ranked[0] >= 0.8 and lead >= 0.4 else (None, lead)


def sentences_of(text: str) -> list[str]:
    return [x.strip() for x in _SENTENCE.split(text) if _WORD.search(x)]


_LEAD = regex.compile(r"^[^.:]{0,40}:\s")
# Numbers that tell nothing about the matter: references to sources, and how many sources there are.
_REFERENCE = regex.compile(r"\[\d{1,3}\]|\bpages?\ \d+\s?(?:-|–|to)\s?\d+\b|\b\d+\ (?:(?!of\b|in\b)\w+\ )?(?:documents|pages|sources|extracts|records|passages|files|reports|seiten|dokumente\w*|quellen|documentos|páginas|fuentes|dokument\w+|stron\w*)\b")
_ITEM_NUMBER = regex.compile(r"(?m)^\s*\d{1,2}[.)]\s+(?=\p{L})")
_CLAUSE = regex.compile(r"[,;:]|\b(?:and|so|because|und|weil|et|car|y|porque|oraz|ponieważ)\b")
# Words that speak of the sources, the question and the answering only.
OF_SOURCES = set("""document documents source sources page pages extract extracts record records passage passages file files report reports context text texts material materials information detail details data
    question questions answer answers matter subject point topic statement statements anything something nothing read reading checked searched reviewed looked went gone given giving give supplied provided retrieved asked ask
    find found finding hold holds held contain contains contained mention mentions mentioned state states stated say says said tell know known available able unable cannot cant sorry regret afraid unfortunately regrettably
    therefore carefully please help assist further still yet whatsoever none neither nor without against like""".split())  # fmt: skip
#: Words of a sentence up to which its declining wording alone decides, and share of new words beyond which a longer one tells something.
PLAIN_WORDS, MOST_NEW = 30, 0.25


def _holds_declining(s: str) -> bool:
    """DECLINING anywhere; long texts in overlapping windows, so that its gaps cost time in proportion."""
    words = s.split(" ")
    if len(words) <= 2 * PLAIN_WORDS:
        return bool(DECLINING.search(s))
    return any(DECLINING.search(" ".join(words[i : i + 2 * PLAIN_WORDS])) for i in range(0, len(words) - PLAIN_WORDS, PLAIN_WORDS))


def _tells_more(s: str, question: str) -> bool:
    """A long sentence that says much in words that are neither of the question nor about sources and answering."""
    asked = set(folded_words(question.casefold()))
    new = lambda words: sum(not (w in asked or w in OF_SOURCES or w in _LANGUAGES_OF or w.isdigit()) for w in words)
    words = folded_words(s)
    return new(words) > MOST_NEW * len(words) or any(new(folded_words(c)) > 3 and not _holds_declining(c) for c in _CLAUSE.split(s))


def without_label(sentence: str) -> str:
    """The sentence without a lead that is a label only, like 'Question 3:'."""
    m = _LEAD.match(sentence)
    return sentence[m.end() :] if m and all(w in LABELS or w.isdigit() for w in folded_words(m.group())) else sentence


def declines(sentence: str, question: str = "") -> bool:
    """A declining wording that gives no number but the question's, and no part after a joint that gives something instead."""
    s = " ".join(without_label(sentence).casefold().split())
    if _NUMBER.search(s) and not set(_NUMBER.findall(_REFERENCE.sub(" ", s))) <= set(_NUMBER.findall(question)):
        return False
    if not _holds_declining(s):
        return False
    s = _LEAD.sub("", s) if not DECLINING.search(s[:41].partition(":")[0]) else s
    parts = TURN.split(s)
    for part in parts[::2]:
        words = folded_words(part)
        if len(words) > 3 and not _holds_declining(part) and not IDLE.search(part.strip()):
            return False
    return len(folded_words(s)) <= PLAIN_WORDS or not _tells_more(s, question)


def opening_key(sentence: str, asked: frozenset[str] = frozenset()) -> str:
    """The sentence as a template: numbers are #, and each run of words of its question is *."""
    out: list[str] = []
    for w in folded_words(sentence):
        if w.isdigit():
            w = "#"
        elif w in asked:
            w = "*"
        if w != "*" or not out or out[-1] != "*":
            out.append(w)
    return " ".join(out)


def without_citations(text: str) -> str:
    """The text without the run of citations at its end, however long."""
    end = len(text)
    while True:
        while end and text[end - 1].isspace():
            end -= 1
        if not end or text[end - 1] not in ")]":
            return text[:end]
        at = text.rfind("(" if text[end - 1] == ")" else "[", 0, end)
        if at < 0 or not _CITATION.fullmatch(text, at, end):
            return text[:end]
        end = at


@lru_cache(maxsize=4096)
def _words_of_question(question: str) -> frozenset[str]:
    """Words of a question that may be repeated without telling anything; those of every sentence and of sources are none."""
    return frozenset(w for w in folded_words(question) if w not in COMMON_WORDS and w not in OF_SOURCES and not w.isdigit())


#: How a sentence reads by itself: nothing known, courtesy, or a declining wording.
OPEN_PART, IDLE_PART, SAID_PART = 0, 1, 2


def void_parts(rest: str, question: str) -> tuple[list[tuple[str, int]], bool]:
    """(template, kind) of each sentence where none gives a number of its own, else none; and whether the last sentence is
    the only one that is no courtesy. `rest` is the answer without its question."""
    sentences = sentences_of(_ITEM_NUMBER.sub("", without_citations(rest)))
    told = set(_NUMBER.findall(rest)) - set(_NUMBER.findall(question))
    for s in sentences if told else ():
        if not told.isdisjoint(_NUMBER.findall(s)):
            s = " ".join(s.casefold().split())
            if not told.isdisjoint(_NUMBER.findall(_REFERENCE.sub(" ", without_label(s)))) and not IDLE.search(s):
                return [], False
    asked, parts = _words_of_question(question), []
    for s in sentences:
        idle = bool(IDLE.search(" ".join(s.casefold().split())))
        tail = s.partition(":")[2].strip() if idle and ":" in s else ""
        said = declines(tail or s, question)
        parts.append((opening_key(without_label(tail or s), asked), SAID_PART if said else IDLE_PART if idle else OPEN_PART))
    return parts, bool(parts) and parts[-1][1] != IDLE_PART and all(k == IDLE_PART for _, k in parts[:-1])


def refusal_parts(answer: str, question: str) -> list[str]:
    """What the wording alone tells: templates of the declining sentences, where all others are courtesies; else none."""
    parts, _ = void_parts(without_question(answer, question)[0], question)
    return [] if any(kind == OPEN_PART for _, kind in parts) else [part for part, kind in parts if kind == SAID_PART]


# ---- unfinished answers ----

OPEN, SHUT = "([{“„«", ")]}””»"
_NUMBER = re.compile(r"\d+")
_TOKEN = re.compile(r"(?:[^\W_]|#)+(?:[.,'\-/:](?:[^\W_]|#)+)*|[.!?…]+(?=[\s\"'”»)\]]|$)|[\r\n]+")


def body_of(text: str | None) -> str:
    """The answer without trailing citations and blanks."""
    return without_citations(clean(text))


@lru_cache(maxsize=500_000)
def _code(token: str) -> int:
    h = 0xCBF29CE484222325
    for b in token.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


STOP = 1


def token_codes(text: str) -> list[int]:
    """Codes of words (numbers alike) and of sentence ends, as one sequence that begins with an end."""
    codes = [STOP]
    for t in _TOKEN.findall(_NUMBER.sub("#", text.casefold())):
        if t[0] in ".!?…\r\n":
            if codes[-1] != STOP:
                codes.append(STOP)
        else:
            codes.append(_code(t))
    return codes


def contexts(codes: np.ndarray, n: int) -> np.ndarray:
    """For each place, the hash of the n codes up to it; earlier sentences don't count, and places before n hash shorter."""
    h = np.zeros(len(codes), np.uint64)
    alive = np.ones(len(codes), bool)
    with np.errstate(over="ignore"):
        for back in range(n):
            c = np.zeros(len(codes), np.uint64)
            c[back:] = codes[: max(0, len(codes) - back)]
            alive[:back] = False
            h = np.where(alive, (h ^ c) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(back + 1), h)
            if back:
                alive &= c != STOP
    return h ^ np.uint64(n)


def last_contexts(codes: list[int]) -> list[int]:
    """`contexts` at the last place, for each of CONTEXTS; its two lowest bits are left free."""
    h, at, found, alive = 0, {}, set(CONTEXTS), True
    for back in range(max(CONTEXTS)):
        if alive and back < len(codes):
            c = codes[-1 - back]
            h = ((h ^ c) * 0x9E3779B97F4A7C15 + back + 1) & 0xFFFFFFFFFFFFFFFF
            alive = not back or c != STOP
        else:
            alive = False
        if back + 1 in found:
            at[back + 1] = (h ^ (back + 1)) & ~3
    return [at[n] - (1 << 64) if at[n] >> 63 else at[n] for n in CONTEXTS]


_PAIRED, _ITEM_MARK = re.compile(r"[(\[{«)\]}»]"), re.compile(r"(?m)^\s*(?:\d{1,2}|[a-zA-Z])[.)]\s")
_BRACKETS = dict(zip(SHUT, OPEN))


def visibly_open(body: str) -> bool:
    """An end that shows by itself: a joint, an open bracket or quotation, a dash, an ellipsis, a list without items."""
    last = body[-1]
    if last in ",;([{“„«‚‘–—-&/…" or body.endswith("...") or last == ":" or body[-2:] in (' "', " '"):
        return True
    text = _ITEM.sub("", body)
    depth: dict[str, int] = {}
    for ch in _PAIRED.findall(_ITEM_MARK.sub("", text)):
        if ch in "([{«":
            depth[ch] = depth.get(ch, 0) + 1
        else:
            depth[_BRACKETS[ch]] = max(0, depth.get(_BRACKETS[ch], 0) - 1)
    return any(depth.values()) or sum(map(text.count, "\"“”„")) % 2 == 1


_SAID = regex.compile(r"\b(\d{1,2}|" + "|".join(NUMBER_WORDS) + r")\s+\p{L}+(?:\s\p{L}+){0,3}\s*:\s*$")


def list_short(body: str) -> bool:
    """An announced number of items of which fewer came."""
    if ":" not in body:
        return False
    lines = [x for x in regex.split(r"[\r\n]+", body) if x.strip()]
    for i, line in enumerate(lines):
        m = _ANNOUNCED.search(line)
        if not m:
            continue
        items = 0
        for x in lines[i + 1 :]:
            if not _ITEM.match(x):
                break
            items += 1
        head = line[: m.end()].casefold()
        said = _SAID.search(head)
        if said:
            n = int(said.group(1)) if said.group(1).isdigit() else NUMBER_WORDS[said.group(1)]
            if items < n:
                return True
    return False


FINISHED = ".!?。！？"


def end_state(body: str) -> str:
    """shut, open (visibly), or unclear: the last words must tell."""
    if not body or not folded_words(body):
        return "shut"
    if visibly_open(body) or list_short(body):
        return "open"
    trimmed = body.rstrip("\"'”»)] ")
    return "shut" if trimmed and trimmed[-1] in FINISHED else "unclear"


@lru_cache(maxsize=4096)
def _short_question(question: str) -> tuple[str, str, str | None]:
    q = clean(question)
    key = opening_key(q)
    return q, " ".join(w for w in key.split() if w not in COMMON_WORDS and w != "#") or key, language_of(q)[0]


def _of_question(question: str | None) -> tuple[str, str, str | None]:
    """The question cleaned, its key (without numbers and the commonest words) and its language; the same questions come with many answers."""
    q = question or ""
    return _short_question(q) if len(q) < 2000 else _short_question.__wrapped__(q)


SPLIT_SCHEMA = "record_id {id}, question_key string, answerable boolean, defect string, parts array<struct<part: string, kind: int>>, ends array<bigint>, short_end boolean, sole boolean"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for rid, question, answer, answerable in zip(pdf["record_id"], pdf["question"], pdf["answer_text"], pdf["answerable"]):
            a, (q, key, lang_q) = clean(answer), _of_question(question)
            defect, parts, ends, short, sole = None, [], [], False, False
            if not folded_words(a):
                defect = "empty"
            elif _repeats(a, q, *(found := without_question(a, q))):
                defect = "copied"
            else:
                rest = found[0]
                parts, sole = void_parts(rest, q)
                body = without_citations(a)
                state = end_state(body)
                lang_a = language_of(rest)[0]
                if lang_a and lang_q and lang_a != lang_q:
                    defect = "other_language"
                elif state == "open":
                    defect = "truncated"
                elif state == "unclear":
                    ends = last_contexts(token_codes(body))
                    words = folded_words(body)
                    short = len(words) <= 4 or words[-1] in YES_NO and len(words) <= 2
                    if len(words) == 1 and words[0] in YES_NO:
                        ends, short = [], False
            rows.append((rid, key, None if answerable is None else bool(answerable), defect, parts, ends, short, sole))
        yield pd.DataFrame(rows, columns=["record_id", "question_key", "answerable", "defect", "parts", "ends", "short_end", "sole"])


#: Bits of the filter of contexts that are asked for; its size is the same for any number of them.
FILTER_BITS = 1 << 23


def _asked_filter(asked: DataFrame) -> np.ndarray:
    """One bit per asked context (a fixed number of bits, so a few others pass too)."""
    spot = F.pmod(F.col("context").bitwiseXOR(F.shiftrightunsigned("context", 29)), F.lit(FILTER_BITS))
    chunks = asked.select((spot + 1).alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    out = np.zeros(FILTER_BITS + 8 * 4096, bool)
    for row in chunks.collect():  # at most FILTER_BITS / 32768 rows of 4 KiB
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        at = (row["bucket"] - 1) * 32768
        out[at : at + len(bits)] = bits
    return np.packbits(out)


def _passes(bits: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    spot = ((contexts ^ (contexts >> np.uint64(29))).astype(np.int64) % FILTER_BITS).astype(np.int64)
    return (bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 == 1


def _context_counter(filter_bits):
    """Per batch: each asked context with how often a sentence ended, went on or the text broke off after it.

    All texts of a batch form one sequence; each begins with an end of sentence, so contexts never reach back into
    another text.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = filter_bits.value
        for pdf in batches:
            joined: list[int] = []
            lasts: list[int] = []
            for answer in pdf["answer_text"]:
                codes = token_codes(body_of(answer))
                if len(codes) > 1:
                    joined += codes
                    lasts.append(len(joined) - 1)
            if not joined:
                continue
            codes = np.array(joined, np.uint64)
            kind = np.where(np.append(codes[1:], STOP) == STOP, 0, 1).astype(np.uint64)
            kind[lasts] = 2
            use = codes != STOP
            both = []
            for n in CONTEXTS:
                c = contexts(codes, n)[use] & ~np.uint64(3)
                hit = _passes(bits, c)
                both.append(c[hit] | kind[use][hit])
            found, counts = np.unique(np.concatenate(both), return_counts=True)
            kind = found & np.uint64(3)
            yield pd.DataFrame({
                "context": (found & ~np.uint64(3)).astype(np.int64),
                "ended": np.where(kind == 0, counts, 0), "went_on": np.where(kind == 1, counts, 0), "broke_off": np.where(kind == 2, counts, 0),
            })

    return count


# ---- clusters of openings ----

_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63 - 1, size=(2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(key: str) -> set[str]:
    words = key.split()
    return {" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)} or {key}


def bands_of(key: str) -> list[int]:
    codes = np.array([_code(s) for s in shingles(key)], np.uint64)[:, None]
    mixed = codes * _SEEDS[0] + _SEEDS[1]
    mixed ^= mixed >> np.uint64(29)
    low = mixed.min(axis=0).reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        h = (h ^ low[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.astype(np.int64).tolist()


def _band_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(b, k) for k in pdf["part"] for b in bands_of(k)]
        yield pd.DataFrame(rows, columns=["band", "part"])


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = []
        for a, b in zip(pdf["part"], pdf["other"]):
            x, y = shingles(a), shingles(b)
            keep.append(len(x & y) >= SIMILARITY * len(x | y))
        yield pdf.loc[keep, ["part", "other"]]


def _gram_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(k, g, len(grams)) for k in pdf["part"] for grams in [shingles(k)] for g in grams]
        yield pd.DataFrame(rows, columns=["part", "gram", "size"])


def _labels_of(links: DataFrame) -> DataFrame:
    """(part, cluster) of all linked parts: each round takes the least label among the neighbours and then that label's own
    label, so chains of any length shrink by halves."""
    labels = materialise(links.select("part").distinct().withColumn("cluster", F.col("part")))
    changed = not links.isEmpty()
    while changed:
        told = links.join(labels.select(F.col("part").alias("other"), F.col("cluster").alias("told")), "other").groupBy("part").agg(F.min("told").alias("told"))
        hooked = labels.join(told, "part").select("part", F.col("cluster").alias("held"), F.least("cluster", "told").alias("cluster"))
        beyond = hooked.select(F.col("part").alias("cluster"), F.col("cluster").alias("beyond"))
        step = materialise(hooked.join(beyond, "cluster", "left").select("part", "held", F.least("cluster", F.coalesce("beyond", "cluster")).alias("cluster")))
        changed = not step.where("cluster <> held").isEmpty()
        labels = step.drop("held")
    return labels


def _pairs_apart(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, other): all pairs that may be similar and have no common label yet.

    Of two similar sets of n shingles, at least 0.8 n are common, so that any n - 0.8 n + 1 of the one hold a common one;
    each part is looked up by that many of its rarest.
    """
    grams = parts.mapInPandas(_gram_rows, "part string, gram string, size int")
    rare = grams.join(grams.groupBy("gram").agg(F.count("*").alias("df")), "gram").withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("df", "gram")))
    rare = rare.where(F.col("n") <= F.col("size") - F.ceil(F.col("size") * SIMILARITY - 1e-9) + 1).join(labels, "part", "left").select("gram", "part", "size", F.coalesce("cluster", "part").alias("cluster"))
    other = rare.select("gram", F.col("part").alias("other"), F.col("size").alias("other_size"), F.col("cluster").alias("other_cluster"))
    near = (F.col("part") < F.col("other")) & (F.col("cluster") != F.col("other_cluster")) & (F.least("size", "other_size") >= F.greatest("size", "other_size") * SIMILARITY - 1e-9)
    return rare.join(other, "gram").where(near).select("part", "other").distinct()


def cluster_openings(openings: DataFrame) -> DataFrame:
    """(part, cluster): distinct openings joined by verified similarity, cluster named by its least member.

    Members of a band are linked to the band's least member and to the next one in order, which joins most with at most
    2m links for m members; then every other pair that can be similar is met by its rarest shingles and verified too,
    unless it is in one cluster already. So the clusters are those of all pairs.
    """
    parts = materialise(openings.select("part").distinct())
    banded = parts.mapInPandas(_band_rows, "band bigint, part string")
    crowd = banded.join(banded.groupBy("band").agg(F.min("part").alias("least"), F.count("*").alias("n")).where("n > 1"), "band")
    after = F.lag("part").over(Window.partitionBy("band").orderBy("part"))
    pairs = crowd.withColumn("before", after).select("part", F.explode(F.array("least", "before")).alias("other")).where("other is not null and other <> part").distinct()
    both_ways = lambda pairs: (x := pairs.mapInPandas(_verified, "part string, other string")).union(x.select("other", "part")).distinct()
    links = materialise(both_ways(pairs))
    labels = _labels_of(links)
    late = materialise(both_ways(_pairs_apart(parts, labels)))
    if not late.isEmpty():
        labels = _labels_of(materialise(links.union(late)))
    return parts.join(labels, "part", "left").select("part", F.coalesce("cluster", "part").alias("cluster"))


def _is_plain(word: str):
    """A word of every sentence, of sources or of answering."""
    listed = ", ".join(f"'{w}'" for w in sorted(OF_SOURCES | COMMON_WORDS))
    return F.expr(f"{word} in ({listed})")


def _vocabulary(records: DataFrame) -> DataFrame:
    """(word) of the matter: what questions and gold answers say, but for words of every sentence and of sources."""
    texts = records.select(F.explode(F.array("question", "gold_answer")).alias("t")).where("t is not null").distinct()
    words = texts.select(F.explode(F.split(F.lower("t"), r"[^\p{L}\p{M}\p{N}]+")).alias("word")).where("word <> ''").distinct()
    return words.where("not word rlike '^[0-9]+$'").where(~_is_plain("word"))


def _related(mine, theirs):
    """Whether two questions share more than a few of their words."""
    a, b = (F.array_distinct(F.split(x, " ")) for x in (mine, theirs))
    return F.size(F.array_intersect(a, b)) >= UNRELATED * F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def template_kinds(openings: DataFrame, clusters: DataFrame, vocabulary: DataFrame, base_odds: float) -> DataFrame:
    """(part, cluster, refusal, idle) of every template.

    openings(record_id, question_key, answerable, part, kind); those of empty questions tell nothing. The first prompt of a cluster (by hash) is compared with
    each other one, so what is counted are prompts unrelated to it.
    """
    seen = openings.where("question_key <> ''").groupBy("part", "question_key").agg(
        F.count("*").alias("n"), F.count_if(~F.col("answerable")).alias("n_un"), F.count("answerable").alias("n_known"), F.count_if(F.col("kind") == SAID_PART).alias("said"), F.count_if(F.col("kind") == IDLE_PART).alias("idle")
    )
    asked = materialise(seen.join(clusters, "part").groupBy("cluster", "question_key").agg(*(F.sum(c).alias(c) for c in ("n", "n_un", "n_known", "said", "idle"))))
    first = asked.groupBy("cluster").agg(
        F.min_by("question_key", F.xxhash64("question_key")).alias("first_key"), *(F.sum(c).alias(c) for c in ("n", "said", "idle")),
        F.count_if(F.col("n_known") > 0).alias("n_known"), F.sum(F.try_divide("n_un", "n_known")).alias("n_un"),
    )
    apart = asked.select("cluster", "question_key").join(first.select("cluster", "first_key"), "cluster").where(~_related(F.col("question_key"), F.col("first_key"))).groupBy("cluster").agg(F.count("*").alias("unrelated"))
    words = first.select("cluster", F.explode(F.split("cluster", " ")).alias("word")).join(vocabulary.withColumn("matter", F.lit(True)), "word", "left")
    blank = words.groupBy("cluster").agg((F.count_if(~_is_plain("word")) / F.count("*")).alias("other"), (F.count("matter") / F.count("*")).alias("matter"))
    # Lower 95 % bound of the share of prompts that can't be answered.
    n, z = F.col("n_known").cast("double"), 1.645
    share = F.col("n_un") / n
    low = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    drawn = F.coalesce((low >= LEAST_SHARE) & (low >= (1 - low) * LEAST_ODDS * base_odds), F.lit(False)) & (F.col("n_known") >= LEAST_DRAWN) if base_odds > 0 else F.lit(False)
    courtesy = F.col("idle") * 2 > F.col("n")
    says_nothing = (F.col("matter") == 0) & (F.col("other") <= MOST_OTHER) & (F.size(F.split("cluster", " ")) >= LEAST_WORDS) & ~F.split("cluster", " ")[0].isin(*sorted(YES_NO))
    worded = (F.col("said") * 2 > F.col("n")) & (drawn | (F.col("matter") <= MOST_MATTER))
    refusal = ~courtesy & (worded & (F.col("unrelated") >= LEAST_SAID) | (drawn | says_nothing) & (F.col("unrelated") >= LEAST_TOLD))
    kinds = first.join(apart, "cluster", "left").join(blank, "cluster").withColumn("unrelated", F.coalesce("unrelated", F.lit(0)))
    kinds = kinds.select("cluster", refusal.alias("refusal"), courtesy.alias("idle"))
    return clusters.join(kinds, "cluster", "left").select("part", "cluster", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("refusal", "idle")))


def judge_pairs(records: DataFrame) -> DataFrame:
    """(record_id, defect, answerable): one row per linked record, defect null where none was found.

    Takes record_id, question, answer_text, answerable, linked and, where there is one, gold_answer. Records not linked
    have no row; repeated rows count once; null and blank answers are empty; a null question can neither be copied nor
    set the language. Refusals are named whether or not the question is answerable (callers filter), but where it is not,
    other defects go first.
    """
    used = ["record_id", "question", "answer_text", "answerable"]
    records = records if "gold_answer" in records.columns else records.withColumn("gold_answer", F.lit(None).cast("string"))
    # One shuffle serves the repeats and spreads the reading of the texts over all cores.
    linked = records.where("linked and record_id is not null").select(*used).repartition(shuffle_width(records.sparkSession), "record_id").dropDuplicates(["record_id"])
    id_type = linked.schema["record_id"].dataType.simpleString()
    judged = linked.mapInPandas(_judge, SPLIT_SCHEMA.format(id=id_type))
    judged = materialise(judged)

    openings = judged.select("record_id", "question_key", "answerable", F.inline("parts"))
    clusters = materialise(cluster_openings(openings))
    totals = judged.agg(F.count_if(~F.col("answerable")).alias("un"), F.count_if(F.col("answerable")).alias("ok")).first()
    kinds = template_kinds(openings, clusters, _vocabulary(records), totals["un"] / totals["ok"] if totals["ok"] else 0.0)
    verdict = openings.select("record_id", "part").join(kinds, "part").groupBy("record_id").agg(F.min(F.col("refusal") | F.col("idle")).alias("void"), F.max("refusal").alias("any"))
    refusals = verdict.where("void and any").select("record_id", F.lit(True).alias("refusal"))

    asked = judged.where("size(ends) > 0").select("record_id", "short_end", F.posexplode("ends").alias("rank", "context"))
    filter_bits = judged.sparkSession.sparkContext.broadcast(_asked_filter(asked))
    counts = linked.select("record_id", "answer_text").mapInPandas(_context_counter(filter_bits), "context bigint, ended bigint, went_on bigint, broke_off bigint")
    counts = counts.groupBy("context").agg(*(F.sum(c).alias(c) for c in ("ended", "went_on", "broke_off")))
    known = asked.join(counts, "context").where((F.col("ended") + F.col("went_on") >= F.when(F.col("rank") < len(CONTEXTS) - 1, 2).otherwise(10)) | (F.col("short_end") & (F.col("broke_off") + F.col("went_on") >= 3)))
    best = known.groupBy("record_id").agg(F.min_by(F.struct("ended", "went_on", "broke_off", "short_end"), "rank").alias("c"))
    finished = F.col("c.ended") + F.when(F.col("c.short_end"), F.col("c.broke_off")).otherwise(F.lit(0))
    share = finished / (finished + F.col("c.went_on"))
    verdicts = best.select("record_id", (share < LEAST_ENDING).alias("goes_on"))
    cut = judged.where("size(ends) > 0").select("record_id").join(verdicts, "record_id", "left").select("record_id", F.coalesce("goes_on", F.lit(True)).alias("goes_on"), F.coalesce("goes_on", F.lit(False)).alias("seen_open"))

    # Refusals go first where they are reported, unless all they say breaks off.
    cut_short = F.col("sole") & (F.coalesce(F.col("defect") == "truncated", F.lit(False)) | F.coalesce("seen_open", F.lit(False)))
    reported = F.col("refusal") & F.col("answerable") & ~cut_short
    return (
        judged.select("record_id", "answerable", "defect", "sole").join(refusals, "record_id", "left").join(cut, "record_id", "left")
        .select("record_id", F.coalesce(F.when(reported, "refusal"), "defect", F.when(F.col("goes_on"), "truncated"), F.when(F.col("refusal"), "refusal")).alias("defect"), "answerable")
    )


def find_defects(records: DataFrame) -> DataFrame:
    """(record_id, defect) of the defective records; a refusal counts only where the question is answerable."""
    return judge_pairs(records).where("defect is not null and (defect <> 'refusal' or answerable)").select("record_id", "defect")
