import random

import pytest

from tallyloom.llm import canonical as C

CHUNK = "chunk_id string, document_name string, text string, normalised string, anchor bigint, form int, quote string"
QUOTE = "evidence_id string, document_name string, text string, form int, anchor bigint"


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Ｔｅｓｔ １２", "test 12"), ("café", "CAFÉ"), ("du​ty﻿ ro­om", "duty room"), ("a 　b", "a b"), ("Ѕосе", "soce"), ("ﬁre ﬂow oﬃce", "fire flow office"),
        ("re‑hang", "re-hang"), ("СОС", "coc"), ("НЕ", "не"), ("й", "й"), ("x͏y", "xy"), ("가", "가"), ("ë", "ё"), ("  many   blanks\n", "many blanks"),
    ],
)
def test_reads_the_same(a, b):
    assert C.canonical(a) == C.canonical(b)


@pytest.mark.parametrize(("a", "b"), [("é", "e"), ("m²", "m2"), ("ползвайте", "ползваите"), ("1", "l"), ("0", "O"), ("a b", "ab"), ("µS", "mS"), ("ł", "l")])
def test_reads_differently(a, b):
    assert C.canonical(a) != C.canonical(b)


def test_nulls_empty_and_long():
    assert C.canonical(None) is None and C.canonical("") == "" and C.canonical("​ ") == ""
    long = "Ｗord​ é " * 200_000
    assert C.canonical(long) == ("word é " * 200_000).strip()


def test_splicing_equals_the_whole():
    """Only segments are normalised, but the result is that of normalising everything."""
    rng = random.Random(1)
    pool = "abc ABC é é й ﬁ ｘ а ​   ² 가 각 ̣̇ ß"
    for _ in range(400):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        whole = C._canon(s).casefold()
        import unicodedata

        assert C.canonical(s) == " ".join(x for x in unicodedata.normalize("NFC", whole).split(" ") if x)


def test_matching_form():
    assert C.matching_form(C.canonical("The «Door» (A/B): 5.1 % of m²!")) == "the door a/b : 5.1 % of m²"
    assert C.matching_form(None) is None


def test_anchors_are_shared_by_every_container():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(400))
    others = ["", "ab", "x" * 60, text[:47]]
    for size in (1, 2, 3, 7, 19, 20, 21, 47, 48, 49, 120, 400):
        for _ in range(20):
            at = rng.randrange(len(text) - size + 1)
            quote = text[at : at + size]
            owner, anchors = C.text_anchors([*others, text, *others], 0, C.class_of(quote))
            assert C.quote_anchor(quote, 0) in set(anchors[owner == len(others)].tolist())


def test_texts_keep_their_anchors_to_themselves():
    texts = ["abc " * 9, "", "q", "the door is shut and the light is on " * 3, "zz" * 40]
    for c in range(4):
        owner, anchors = C.text_anchors(texts, 0, c)
        for i, text in enumerate(texts):
            assert sorted(anchors[owner == i].tolist()) == sorted(C.text_anchors([text], 0, c)[1].tolist())


def pairs(spark, chunks, quotes):
    c = spark.createDataFrame([(*r, 1, 2, "q") for r in chunks], CHUNK)
    q = spark.createDataFrame([(*r, 1, 2) for r in quotes], QUOTE)
    return {tuple(r) for r in C.find_quotes(c, q, text_id="chunk_id", quote_id="evidence_id", group="document_name", form_text="normalised").collect()}


def test_find_quotes(spark):
    chunks = [("c1", "D", "The Ｄoor is shut.", "unused"), ("c1", "D", "The Ｄoor is shut.", "unused"), ("c2", "D", None, "the door​ is shut"), ("c3", "E", "the door is shut", None), ("c4", "D", None, None), (None, "D", "the door is shut", None), ("c5", None, "the door", None), ("c6", "D", "", None)]
    quotes = [("e1", "D", "the  door, is shut!"), ("e2", "D", "the door is shut"), ("e2", "D", "the door is shut"), ("e3", "D", ""), ("e4", "D", None), ("e5", None, "door"), (None, "D", "door"), ("e6", "D", "oo"), ("e7", "D", "​")]
    assert pairs(spark, chunks, quotes) == {("c2", "e1"), ("c1", "e2"), ("c2", "e2"), ("c1", "e6"), ("c2", "e6")}
    assert pairs(spark, [], quotes) == set() and pairs(spark, chunks, []) == set()


def test_find_quotes_equals_brute_force(spark, small_dir):
    from tallyloom.llm.queries import p1_found

    got = {tuple(r) for r in p1_found(spark, small_dir).collect()}
    gold, chunks = spark.read.parquet(f"{small_dir}/gold_evidence.parquet").collect(), spark.read.parquet(f"{small_dir}/chunk_rows.parquet").collect()
    want = set()
    for g in gold:
        q = C.canonical(g.text)
        for c in chunks:
            if q and c.document_name == g.document_name:
                s, k = (C.canonical(c.text), q) if c.text is not None else (C.matching_form(C.canonical(c.normalised)), C.matching_form(q))
                if k and k in s:
                    want.add((c.chunk_id, g.evidence_id))
    assert got == want and got
