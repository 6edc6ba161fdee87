"""Recall and precision of refusals and residue on wordings their rules were not written for."""

import random

import held_out

from tallyloom.llm import pairs, residue

MATTERS = {
    "en": ["Who tests the sprinkler pump in {}?", "When was the roof of {} last surveyed?", "Which contractor relined the chimney at {}?", "How thick is the cladding on {}?", "What colour marks the gas riser inside {}?", "Why was the boiler of {} shut down?", "Where are the keys for the meter room kept at {}?", "Does {} need a second staircase?"],
    "de": ["Wer prüft die Sprinklerpumpe in {}?", "Wann wurde das Dach von {} zuletzt begutachtet?", "Welche Firma hat den Schornstein bei {} saniert?", "Wie dick ist die Fassade an {}?", "Welche Farbe hat die Gasleitung in {}?", "Warum wurde der Kessel von {} abgeschaltet?", "Wo liegen die Schlüssel zum Zählerraum von {}?", "Braucht {} ein zweites Treppenhaus?"],
    "fr": ["Qui contrôle la pompe des sprinklers de {} ?", "Quand la toiture de {} a-t-elle été expertisée ?", "Quelle entreprise a tubé la cheminée de {} ?", "Quelle est l'épaisseur du bardage de {} ?", "Quelle couleur signale la colonne de gaz de {} ?", "Pourquoi la chaudière de {} a-t-elle été arrêtée ?", "Où sont les clés du local des compteurs de {} ?", "Faut-il un second escalier à {} ?"],
    "es": ["¿Quién prueba la bomba de rociadores de {}?", "¿Cuándo se revisó el tejado de {}?", "¿Qué empresa revistió la chimenea de {}?", "¿Qué grosor tiene la fachada de {}?", "¿Qué color marca la tubería de gas de {}?", "¿Por qué se paró la caldera de {}?", "¿Dónde están las llaves del cuarto de contadores de {}?", "¿Necesita {} una segunda escalera?"],
    "pl": ["Kto sprawdza pompę tryskaczy w {}?", "Kiedy oglądano dach {}?", "Która firma naprawiła komin {}?", "Jak gruba jest elewacja {}?", "Jakim kolorem oznaczono pion gazowy w {}?", "Dlaczego wyłączono kocioł {}?", "Gdzie są klucze do licznikowni {}?", "Czy {} potrzebuje drugiej klatki?"],
}
SITES = ["Ashgrove", "Bellmont", "Corvane", "Dunlea", "Evermark"]


def _log(unanswerable_share: float) -> list[tuple]:
    """Each wording 24 times under unrelated prompts; declining ones come with questions that can't be answered that often,
    others with few. Every answering wording also comes 240 times with a figure of its own, and as a gold answer."""
    draw, rows = random.Random(11), []
    for table, share in ((held_out.DECLINING, unanswerable_share), (held_out.ANSWERING, 0.1)):
        for lang, sentence in held_out.lines(table):
            for i in range(24):
                question = MATTERS[lang][i % 8].format(draw.choice(SITES))
                rows.append((len(rows), question, sentence, draw.random() >= share, True, None, (table is held_out.DECLINING, lang)))
    for lang, sentence in held_out.lines(held_out.ANSWERING):
        for i in range(240):
            rows.append((len(rows), MATTERS[lang][i % 8].format(draw.choice(SITES)), f"{sentence[:-1]} ({i + 2} m).", True, True, sentence, (None, lang)))
    return rows


def _measured(spark, share: float) -> tuple[float, float]:
    rows = _log(share)
    schema = "record_id bigint, question string, answer_text string, answerable boolean, linked boolean, gold_answer string"
    found = {r.record_id for r in pairs.find_defects(spark.createDataFrame([r[:6] for r in rows], schema)).where("defect = 'refusal'").collect()}
    true = {r[0] for r in rows if r[6][0] and r[3]}
    return len(found & true) / len(true), len(found & true) / max(1, len(found))


def test_refusals_never_seen_before(spark):
    recall, precision = _measured(spark, 0.8)
    print(f"refusals drawn by unanswerable questions: recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.9


def test_refusals_of_answerable_questions_only(spark):
    recall, precision = _measured(spark, 0.0)
    print(f"refusals of answerable questions only: recall {recall:.3f}, precision {precision:.3f}")
    assert precision >= 0.9


def test_residue_never_seen_before():
    found = [bool(residue.signs(s)) for _, s in held_out.lines(held_out.RESIDUE)]
    wrong = [s for _, s in held_out.lines(held_out.REAL) if residue.signs(s)]
    recall, precision = sum(found) / len(found), sum(found) / (sum(found) + len(wrong))
    print(f"residue: recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.9


def test_residue_inside_real_text():
    """A message that stands in one place of a long text is found, a report of one beside it is not."""
    real = [s for _, s in held_out.lines(held_out.REAL)]
    for _, message in held_out.lines(held_out.RESIDUE):
        if residue.signs(message):
            assert residue.signs(" ".join(real[:10]) + "\n" + message + "\n" + " ".join(real[10:20]))
    assert residue.signs(" ".join(real)) == []
