import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import pieces as P

LIMIT, OVER = 1000, 200


def check(text, limit=LIMIT, overlap=OVER):
    cuts = P.cut(text, limit, overlap)
    if not text:
        assert cuts == []
        return cuts
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (a, b), (c, d) in zip(cuts, cuts[1:]):
        assert b - overlap <= c <= b < d and a < c
    assert all(0 < b - a <= limit for a, b in cuts)
    back = text[cuts[0][0] : cuts[0][1]] + "".join(text[b:d] for (_, b), (_, d) in zip(cuts, cuts[1:]))
    assert back == text
    return cuts


def greedy(text, limit, overlap):
    """The same rule cut by cut, without doubling."""
    places, strength = P.boundaries(text)
    at, start, out = 0, 0, []
    n = len(text)
    while at < n:
        start = at
        if at:
            for least in (3, 1, 0):
                inside = [p for p, s in zip(places, strength) if s >= least and at - overlap <= p < at] if overlap else []
                if inside:
                    start = min(inside)
                    break
        reach, end = start + limit, None
        if reach < n:
            for least in (5, 4, 3, 2, 1, 0):
                ok = [p for p, s in zip(places, strength) if s >= least and max(at, start + limit // 2) < p <= reach]
                if ok:
                    end = max(ok)
                    break
        end = end or max(p for p in places if p <= reach)
        out.append((start, int(end)))
        at = int(end)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "A sentence. ", "x" * 333, "clause, ", "\r\n", "\n\n", "é", "👩‍👧", "　", "Dr. No ", "..", "🇩🇪"]), max_size=300))
def test_pieces_fit_and_give_the_text_back(parts):
    text = "".join(parts)
    cuts = check(text)
    if len(text) > LIMIT:
        assert cuts == greedy(text, LIMIT, OVER)


def test_no_boundaries_very_long_and_defaults():
    check("x" * 100_000, 4000, 400)
    check(("A sentence here. " * 60 + "\n\n") * 3000, 4000, 400)
    assert P.cut("", 4000) == [] and P.cut("short", 4000) == [(0, 5)] and P.cut("y" * 4000) == [(0, 4000)] and len(P.cut("y" * 4001)) == 2


def test_prefers_paragraphs_and_never_splits_characters():
    text = ("Some words here. " * 50).strip() + "\n\n" + "More words there. " * 100
    a, b = P.cut(text, 1000, 200)[0]
    assert text[:b].endswith("\n\n")
    marks = "é" * 3000
    assert all(marks[a] == "e" for a, _ in check(marks))
    crlf = "word\r\n" * 1000
    assert all(crlf[a] != "\n" for a, _ in check(crlf))


def test_short_forms_end_no_sentence():
    assert P._sentence_ends("See fig. 7 approx. 5 m. Next one. (Cf. App. 2) Then.") == [24, 34]


def test_bad_parameters():
    with pytest.raises(ValueError):
        P.cut("x", 500, 400)


def test_rows(spark):
    df = spark.createDataFrame([(1, "a b " * 1200, 9), (1, "a b " * 1200, 9), (2, None, 9), (3, "", 9), (4, "short", 9)], "built_id bigint, text string, piece int")
    got = P.split_oversized(df.distinct(), keep=("built_id",)).orderBy("sub_index").collect()
    assert [(r.built_id, r.sub_index, r.sub_count, r.overlap_with_previous) for r in got] == [(1, 1, 2, False), (1, 2, 2, True)]
    assert got[0].piece + got[1].piece[got[1].overlap_chars :] == "a b " * 1200
    assert P.split_oversized(df.limit(0), keep=("built_id",)).count() == 0
