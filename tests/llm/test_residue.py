import pytest

from tallyloom.llm import residue as R

BAD = [
    "Dear {{ tenant_name }}, we write.", "Report for ${site}.", "See #{flat_number}.", "Due <<Address>>.", "Dear &lt;client.address&gt;,", "By [name of assessor].", "By [Enter address here].", "On {% if x %}.", "At @@NEXT@@.", "For «Anschrift».",
    "Ref ~postcode~.", "Ref %PROPERTY_REF%.", "Ref __BUILDING__.", "Flat $FLAT_NO$.", "Dear {0},", "Rooms: [object Object]", "Seen by (assessor to be added).", "Am [Datum einfügen].", "Le [insérer la date].",
    "Please enable JavaScript to view this page.", "Real text. Bitte aktivieren Sie JavaScript, um fortzufahren. Real text.", "404 Not Found", "Access denied.", "Oops! Something.", "Bad Gateway The doors were checked.",
    "Traceback (most recent call last):", "KeyError: 'site' The doors", "java.lang.NullPointerException", "Lorem ipsum dolor sit amet", "Mattis porro cursus tempor ipsum finis.", "asdf asdf qwer", "xxxxx xxxx xxxxxxx", "Text text text text.", "Your text goes here.",
    "Seite nicht gefunden.", "Página no encontrada.", "Wewnętrzny błąd serwera.", "Votre texte ici.",
]
GOOD = [
    "The sign reads [NO SMOKING] and a second was asked for.", "The voice alarm script must be enabled by the duty electrician.", "Error bars of <10 ohms> apply.", "The logbook page could not be found, so the agent supplied a copy.", "Enter the reading [in ohms] on form 7.",
    "Fault code 404 was shown and cleared after a reset.", "Cables {A1, A2, B3} pass here [see Appendix C, item 8].", "Tag numbers <<12>> and <<13>> are stamped.", "The portal needs JavaScript, so paper forms were issued.", 'The message "access denied" was displayed.', "The label shows __7__ in raised type.",
    "It cost $78 and 7% of the sample of 34% passed.", "Drawing sheet XX was superseded.", "Access was denied to the roof.", "He said «Bonjour» [sic].", "", None,
]


MENTIONED = [
    "Residents reported that javascript is disabled on the lobby terminal.", "JavaScript is disabled on the terminal in the lobby of the east wing.", "a request timed out with 504 gateway timeout", "During the test a request timed out with 504 gateway timeout.",
    "Wir haben Sie nicht angetroffen, bitte versuchen Sie es später erneut.", "The draft still held lorem ipsum in two places of the second annex.", "The contractor said that the page you are looking for had been moved to the archive of the managing agent.",
]
SHOWN = ["JavaScript is disabled.", "504 Gateway Timeout", "HTTP Status 403 - Forbidden The lift was returned to service.", "Type your summary here A signal was lost for 7 hours.", "To use the records viewer, switch off your script blocker and refresh.", "Versuchen Sie es später erneut.", "Error: 502 bad gateway", "The doors on all floors were checked and found to close without a fault Please enable JavaScript to view this page", "The doors were checked and Traceback (most recent call last) came."]


@pytest.mark.parametrize("text", MENTIONED)
def test_unquoted_mentions(text):
    assert R.signs(text) == []


@pytest.mark.parametrize("text", SHOWN)
def test_messages_themselves(text):
    assert R.signs(text)


@pytest.mark.parametrize("text", BAD)
def test_residue(text):
    assert R.signs(text)


@pytest.mark.parametrize("text", GOOD)
def test_real_content(text):
    assert R.signs(text) == []


def test_rows(spark):
    df = spark.createDataFrame([(1, BAD[0], "k"), (1, BAD[0], "k"), (2, GOOD[0], "k"), (3, None, "k"), (None, BAD[0], "k"), (4, "", "k")], "doc_id bigint, text string, kinds string")
    assert [(r.doc_id, r.kinds) for r in R.find_residue(df).collect()] == [(1, ["template"]), (1, ["template"])]
    assert R.find_residue(df.limit(0)).count() == 0


def test_long_texts_stay_quick():
    import time

    began = time.time()
    R.signs("The door was checked and closed. " * 60_000)
    R.signs("{[<~%_" * 20_000)
    R.signs("word" * 200_000)
    assert time.time() - began < 60
