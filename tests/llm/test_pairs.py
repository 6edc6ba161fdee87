import pytest

from tallyloom.llm import pairs as P

REC = "record_id bigint, question string, answer_text string, answerable boolean, linked boolean, defect string, part string"
Q = "What fire door rating does the assessment give?"


def test_clusters_are_verified(spark):
    keys = ["i cannot find this in the documents provided to me at all today", "i cannot find this in the documents provided to me at all", "the rating of the door is fd thirty according to the report of may", "no", "unable to determine"]
    got = {r.part: r.cluster for r in P.cluster_openings(spark.createDataFrame([(k,) for k in keys + keys], "part string")).collect()}
    assert got[keys[0]] == got[keys[1]] == min(keys[:2]) and got[keys[2]] == keys[2] and got["no"] == "no" and len(got) == 5
    assert P.cluster_openings(spark.createDataFrame([], "part string")).count() == 0


def test_clusters_equal_brute_force(spark):
    import random

    draw = random.Random(5)
    base = [f"w{i}" for i in range(44)]
    keys = set()
    for _ in range(160):
        words = list(base)
        for at in draw.sample([0, 1, 2, 41, 42, 43, 20, 24], 3):
            words[at] = f"n{draw.randrange(12)}"
        keys.add(" ".join(words))
    keys = sorted(keys)
    cluster = {k: k for k in keys}
    grams = {k: P.shingles(k) for k in keys}
    for x in keys:
        for y in keys:
            if cluster[x] != cluster[y] and len(grams[x] & grams[y]) >= P.SIMILARITY * len(grams[x] | grams[y]):
                one, two = sorted((cluster[x], cluster[y]))
                cluster = {k: one if c == two else c for k, c in cluster.items()}
    assert 1 < len(set(cluster.values())) < len(keys)
    got = {r.part: r.cluster for r in P.cluster_openings(spark.createDataFrame([(k,) for k in keys], "part string")).collect()}
    assert got == cluster


@pytest.mark.parametrize(
    "text", ["I cannot find this in the documents provided.", "Hm. Unable to determine.", "Thank you for the question. I don’t have access to that detail.", "THE SUPPLIED DOCUMENTS DO NOT CONTAIN THIS INFORMATION. You may wish to ask the caretaker.", "Leider kann ich diese Frage nicht beantworten.", "Having read all pages: Unfortunately, the context is silent on this point.", f"You asked: {Q} I would need further documents before I could say.", "Désolé, je ne peux pas répondre à cette question."],
)
def test_declining(text):
    assert P.refusal_parts(P.clean(text), Q)


@pytest.mark.parametrize(
    "text", ["I cannot find the exact day, but page 40 gives 7 November 2015.", "The documents do not name the contractor; they do state that the caretaker must seal it.", "There is no information on the upper floors, while for the plant room the report records a loose wire.", "Sorry for the confusion earlier. The rating is FD30S.", "The inspector could not access the roof and was unable to test it, which is entered as limitation 8.8.", "La porte coupe-feu ne se referme pas complètement.", "No"],
)
def test_not_declining(text):
    assert not P.refusal_parts(P.clean(text), Q)


ASKED = "What is the reading for circuit 4?"
LONG = "Having gone through every one of the extracts that were retrieved for this question, I regret to say that none of them holds a statement on this matter, and I am therefore unable to give you an answer to it."


@pytest.mark.parametrize("text", ["I cannot find the reading for circuit 4 in the documents.", "Question 3: unable to determine.", "1. I cannot find this in the documents. [3]", "None of the 12 pages mentions it.", LONG, LONG + " (D.pdf, page 3)"])
def test_declining_with_numbers_or_at_length(text):
    assert P.refusal_parts(P.clean(text), ASKED)


@pytest.mark.parametrize(
    "text",
    ["I cannot find the reading for circuit 5 in the documents.", "Cavity barriers could not be verified behind the panels at level 12.", "I could not find it in the summary, see page 7 of the report.", "The rating is 30: no information beyond it.",
     "The inspector was unable to open the riser cupboard door on the third floor landing next to the lift motor room of the east wing of the building during the visit in the morning of the second day of the survey."],
)
def test_not_declining_with_numbers_or_at_length(text):
    assert not P.refusal_parts(P.clean(text), ASKED)


def test_refusals_with_numbers_are_found(spark):
    said = ["I cannot find the reading for circuit 4 in the documents.", "Question 3: unable to determine.", LONG]
    rows = [(10 * i + j, f"{q} Circuit 4?", a, True, True, "x", "y") for i, a in enumerate(said) for j, q in enumerate(["Who tests the alarm?", "What does the survey of the roof advise?"])]
    assert {r.record_id: r.defect for r in P.find_defects(spark.createDataFrame(rows, REC)).collect()} == {r[0]: "refusal" for r in rows}


def test_declining_answers_keep_other_defects(spark):
    rows = [(i, f"Which rating has door {chr(97 + i % 20)} of the east wing?", "The supplied documents do not contain this information on the door.", False, True) for i in range(20)]
    rows += [
        (100, Q, "Leider kann ich diese Frage nicht beantworten.", False, True), (101, "Who tests the alarm?", "Leider kann ich diese Frage nicht beantworten.", True, True), (102, "What does the survey of the roof advise?", "I cannot find this, because the (", False, True),
        (103, Q, "The supplied documents do not contain", True, True), (104, "Who tests the alarm?", "The supplied documents do not contain", True, True), (105, Q, "I cannot find this in the documents.", True, True), (106, "Who tests the alarm?", "I cannot find this in the documents.", False, True),
    ]
    got = {r.record_id: r.defect for r in P.find_defects(spark.createDataFrame([(*r, "x", "y") for r in rows], REC)).collect()}
    assert got == {100: "other_language", 101: "refusal", 102: "truncated", 103: "truncated", 104: "truncated", 105: "refusal"}


def test_many_declining_words_stay_quick():
    import time

    began = time.time()
    for text in ("I cannot xyz " * 50_000, "does not xyz " * 50_000, "[3] " * 20_000, "it is, " * 50_000 + "unable to say"):
        P.refusal_parts(P.clean(text), ASKED)
    assert time.time() - began < 30


@pytest.mark.parametrize(("text", "yes"), [(Q, True), (Q.upper(), True), (f"**{Q}**\n\n{Q}", True), (f"Question: {Q}\nAnswer:", True), (f"You asked: {Q}", True), (Q[:-1] + ".", True), (f"You asked: {Q} FD30.", False), ("FD30.", False), ("what fire door rating does the assessment", True)])
def test_copied(text, yes):
    assert P.is_copied(P.clean(text), P.clean(Q)) is yes


@pytest.mark.parametrize(("text", "lang"), [("Die Notbeleuchtung im Flur leuchtete 78 Minuten lang.", "de"), ("Le contrôleur demande que le passage de câbles soit rebouché.", "fr"), ("Pomiar obwodu 35 wykazał rezystancję 72.0 megaoma.", "pl"), ("La medida del circuito 53 dio una resistencia de 9.7.", "es"), ('The sign reads "Rauchen verboten" and is old.', "en"), ("FD30S", None), ("12 May 2020", None)])
def test_language(text, lang):
    assert P.language_of(text)[0] == lang


@pytest.mark.parametrize(("text", "state"), [("It closes.", "shut"), ("It closes. [3]", "shut"), ("It closes (D.pdf, page 3)", "unclear"), ("It closes,", "open"), ("It closes (", "open"), ('It says "as', "open"), ("Three actions are listed:\n1. One.\n2. Two.", "open"), ("Two actions are listed:\n1. One.\n2. Two.", "shut"), ("in particular:", "open"), ("It is re...", "open"), ("FD30", "unclear"), ("", "shut")])
def test_ends(text, state):
    assert P.end_state(P.body_of(text)) == state


def test_a_long_run_of_citations_is_left_out():
    assert P.body_of("It closes." + " [12]" * 300 + " (Door.pdf, page 3)" * 300) == "It closes."


def test_defects_of_a_small_log(spark):
    rows = []
    for i in range(40):
        rows.append((i, f"Which rating has door {chr(97 + i % 20)} of the east wing?", "The rating of the door was given as nominal by the survey.", True, True))
    rows += [
        (100, Q, None, True, True), (101, Q, " — ", True, True), (102, Q, Q, True, True), (103, Q, "Unable to determine.", True, True), (104, "Who tests the alarm?", "Unable to determine.", False, True), (105, Q, "Die Tür ist mit der Nummer 30 in dem Bericht.", True, True),
        (106, Q, "The rating of the door was given as nominal by the", True, True), (107, Q, "The rating of the door was given as nominal by the survey", True, True), (108, Q, "", True, False), (109, None, "The rating of the door was given as nominal by the survey.", True, True), (103, Q, "Unable to determine.", True, True), (None, Q, "", True, True), (110, Q, "", None, True),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], REC)
    got = {r.record_id: r.defect for r in P.find_defects(df).collect()}
    assert got == {100: "empty", 101: "empty", 102: "copied", 103: "refusal", 105: "other_language", 106: "truncated", 110: "empty"}
    assert P.find_defects(df.limit(0)).count() == 0


def test_long_texts_stay_quick():
    import time

    began = time.time()
    for text in ("I cannot say " * 50_000, "(" * 100_000, "word " * 200_000):
        a = P.clean(text)
        P.is_copied(a, Q), P.refusal_parts(a, Q), P.language_of(a), P.end_state(P.body_of(text)), P.token_codes(a)
    assert time.time() - began < 60
