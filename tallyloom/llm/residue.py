"""Template residue, filler, error pages and script notices inside documents.

A multi-pattern automaton finds the words and phrases of such texts, in nine languages, in one pass over a segment (a
sentence or line). Words of every sentence, numbers and addresses count for nothing; of the rest, the share that is
matched is the coverage. A segment is residue where its coverage is high, or where a stretch that is wholly matched
stands alone in it (it begins the segment or with a capital, and ends the segment or before a capital), and what is
matched tells it: a whole phrase, or a page with its failure, or scripts with their being needed or off. The gate is the
same for every phrase. It works on segments since a document is a case where such text stands in one place only.
Placeholders, stack traces and mock words have a syntax instead of a wording and are matched by it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame

from tallyloom.llm.pairs import FUNCTION_WORDS

# Phrases that tell or address a reader as only such text does.
PLAIN_SIGNS = {
    "script": """
        please enable javascript; enable javascript to; enable javascript in your browser
        requires javascript to; you need to turn on scripts; turn on javascript; activate javascript
        requires a browser with script support; switch off your script blocker; works only with active scripting; reload with scripting switched on
        client-side code could not be started; your browser is not supported; your browser does not support javascript; allow scripts to run on this
        bitte aktivieren sie javascript; diese seite benötigt javascript
        veuillez activer javascript; activez javascript; cette page nécessite javascript
        active javascript para; habilite javascript; debe activar javascript
        włącz obsługę javascript; włącz javascript; ta strona wymaga javascript
    """,
    "error": """
        could not connect to database; connection refused in; the upstream service did not answer
        the requested page could not be; requested url was not found; page can't be found; page cannot be found; the page you are looking for; the page you requested
        the resource you asked for was removed; please sign in again; you do not have permission to view; you are not authorised to view
        request a new one from the sender; an unexpected problem occurred; the record was not loaded
        this file is no longer available; something went wrong while loading; go back to the home page; wait a moment and reload; an error occurred while processing your request
        seite nicht gefunden; interner serverfehler; die seite wurde nicht gefunden
        bitte prüfen sie die eingegebene adresse
        page introuvable; erreur interne du serveur; vérifiez l'adresse saisie
        página no encontrada; error interno del servidor; compruebe la dirección
        nie znaleziono strony; wewnętrzny błąd serwera; strona nie istnieje
    """,
    "filler": """
        dolor sit amet; your text goes here; your text here; text goes here; type your summary here; type your text here; click here to enter text; insert text here
        dummy content; sample body copy; sample heading; replace this paragraph; replace this text; this is a placeholder
        hier steht später ihr text; hier text einfügen; ihr text hier; blindtext blindtext
        votre texte ici; texte de remplissage; texte factice; insérez votre texte
        texto de relleno; su texto aquí; texto de ejemplo; escriba aquí su texto
        tekst zastępczy; tutaj wpisz tekst; twój tekst tutaj; miejsce na tekst; przykładowy tekst; tu będzie tekst
    """,
}
# More such phrases, and single words that tell a message where they are all there is.
STANDING_ALONE = {
    "script": "javascript; cookies and javascript; scripting; to view this page; to continue; please enable scripts; enable scripts; javascript is disabled; javascript is required; javascript is turned off; javascript must be allowed; javascript must be enabled; javascript ist deaktiviert; javascript muss aktiviert; javascript est désactivé; javascript está desactivado; javascript está deshabilitado; obsługa javascript jest wyłączona",
    "error": """
        access denied; forbidden; gone; bad gateway; gateway timeout; too many requests; service unavailable; not found; page not found; file not found; internal server error; server error
        oops; please try again later; try again later; please try again; contact the administrator; request id; service temporarily unavailable; unauthorized; timed out; request timed out
        that page; use search; sprawdź adres; zugriff verweigert; accès refusé; acceso denegado; odmowa dostępu; sorry
        http status 4; http status 5; 404 not found; 403 forbidden; 500 internal server error; 502 bad gateway; 503 service unavailable; 504 gateway timeout; upstream timeout; your session has expired
        this link has expired; the portal is down for maintenance; ein fehler ist aufgetreten; sitzung ist abgelaufen; zugriff verweigert; versuchen sie es später erneut; veuillez réessayer plus tard; vuelva a intentarlo más tarde; spróbuj ponownie później; wystąpił błąd; sesja wygasła; une erreur s'est produite; votre session a expiré; se ha producido un error; su sesión ha caducado
    """,
    "filler": "blindtext; lorem; lorem ipsum; dummy text; placeholder text; filler text; sample text; platzhaltertext",
}
# Words such texts are made of, by what they name; they tell something only together.
SCRIPTS = """
    javascript; java script; script; scripts; scripting; cookie; cookies; skript; skripte; skripten; javascripts; skrypt; skrypty; skryptów; skryptom; plików cookie; script support
"""
PLACES = """
    page; pages; site; sites; website; web; webpage; portal; url; link; links; server; browser; resource; service; request; requested; file; document; content; session; connection; database; app; application; viewer;
    address; gateway; host; home page; homepage; http; https; comments; account; login; record; report; form; article; view
    seite; webseite; internetseite; dienst; datei; dokument; inhalt; sitzung; verbindung; adresse; ressource; startseite; anfrage; gesuchte; gesuchten; angeforderte; angeforderten; gewünschte; kommentare
    lien; serveur; navigateur; ressource; fichier; contenu; connexion; page d'accueil; demandée; demandé; recherchée; commentaires; adresse
    página; páginas; sitio; sitio web; enlace; servidor; navegador; recurso; servicio; archivo; documento; contenido; sesión; conexión; solicitada; solicitado; buscada; comentarios; página de inicio
    strona; strony; stronę; stronie; witryna; witryny; serwer; serwera; serwerem; przeglądarka; przeglądarki; zasób; zasobu; usługa; plik; pliku; dokumentu; treść; treści; sesja; połączenie; połączenia; żądana; żądanej; komentarze
    pagina; sito; collegamento; risorsa; richiesta; servizio; gevraagde; koppeling; bestand; bron; dienst; solicitação; ligação; ficheiro; arquivo; conteúdo
    ページ; サイト; サーバー; お探しの; リンク; ファイル
"""
FAILURES = """
    error; errors; not found; missing; does not exist; doesn't exist; no longer exists; no longer exist; do not exist; don't exist; not exist; unavailable; not available; no longer available; broken; expired; has expired; denied;
    timed out; time out; timeout; overloaded; failed; could not be loaded; couldn't be loaded; could not load; couldn't load; cannot be loaded; could not be found; couldn't be found; couldn't find; could not find; cannot find; can't find;
    cannot be displayed; can't be displayed; went wrong; moved; deleted; removed; unauthorised; unauthorized; not authorised; not authorized; not allowed; not permitted; no permission; permission; crashed; oops; whoops; down for maintenance; maintenance; 404
    fehler; serverfehler; nicht gefunden; nicht gefunden werden; fehlt; gibt es nicht; gibt es nicht mehr; existiert nicht; existiert nicht mehr; nicht verfügbar; nicht erreichbar; abgelaufen; fehlerhaft; ungültig; verweigert; zeitüberschreitung; überlastet;
    nicht geladen; nicht geladen werden; keine berechtigung; nicht berechtigt; hoppla; ups; aufgetreten; verschoben; gelöscht; wartung
    erreur; introuvable; manquant; manquante; n'existe plus; n'existe pas; indisponible; n'est pas disponible; plus disponible; expiré; rompu; cassé; refusé; dépassé; délai; surchargé; n'a pas pu être chargé; pas autorisé; non autorisé; oups; supprimé; supprimée; déplacée; maintenance; s'est produite
    error; errores; no encontrada; no encontrado; no se encontró; no hemos encontrado; no se encuentra; falta; no existe; ya no existe; no disponible; no está disponible; caducado; roto; denegado; agotado; tiempo de espera; saturado; no se pudo cargar; no se puede cargar; no tiene permiso; no autorizado; vaya; eliminada; mantenimiento; ha caducado
    błąd; nie znaleziono; nie udało się znaleźć; brak strony; nie istnieje; już nie istnieje; niedostępna; niedostępny; niedostępne; wygasł; wygasła; uszkodzony; przekroczono czas; przeciążona; przeciążony; nie można wczytać; nie udało się wczytać; nie masz uprawnień; brak uprawnień; ups; usunięta; usunięto; przerwa techniczna
    errore; non trovata; non trovato; non esiste; non esiste più; non disponibile; scaduta; scaduto; negato; niet gevonden; bestaat niet; bestaat niet meer; niet beschikbaar; verlopen; geweigerd; fout; não encontrada; não encontrado; não existe; erro; indisponível; expirou
    見つかりません; エラー; 存在しません; 利用できません; 期限切れ
"""
NEEDS = """
    needs; need; needed; requires; require; required; must; enable; enabled; allow; allowed; activate; activated; turn on; turned on; turned off; turn; switch on; switched on; switched off; switch; disabled; off; blocked; blocks; block; blocking; to be on; to be off; support; supported; without
    muss; müssen; braucht; benötigt; erfordert; benötigen; aktivieren; aktiviert; aktive; aktiven; einschalten; eingeschaltet; ausgeschaltet; deaktiviert; blockiert; erlauben; schalten; zulassen; ohne
    besoin; nécessite; exige; requiert; activer; activez; activé; activés; actifs; réactivez; désactivé; désactivés; bloque; bloqués; autoriser; autorisez; autorisez-les; sans; doit; doivent
    necesita; requiere; exige; active; activar; activado; activos; habilite; habilitar; desactivado; deshabilitado; bloquea; permita; permítalos; permitir; sin; debe
    wymaga; potrzebuje; włącz; włączyć; włączony; włączone; wyłączony; wyłączone; wyłączona; aktywnych; blokuje; zezwól; bez; musi; muszą; obsługi; obsługę; obsługa
    richiede; abilita; abilitare; attiva; attivare; disattivato; vereist; nodig; inschakelen; ingeschakeld; uitgeschakeld; requer; ative; ativar; desativado
    有効; 無効; 必要
"""
REQUESTS = """
    please; try; try again; again; later; reload; refresh; retry; contact; administrator; webmaster; support team; sorry; back; return; check; go; wait; moment; minute; minutes; sign in; log in; continue; see; show; read; use; search; looking; work; works; function; anymore; contacting; display; displayed; loading; loaded; load; followed; entered; correct; temporarily; temporary; currently; briefly; few; run
    bitte; erneut; versuchen; später; neu laden; laden; administrator; leider; prüfen; überprüfen; minuten; wenigen; anmelden; sehen; anzuzeigen; anzeigen; vorübergehend; eingegebene; wieder; funktionieren; technischer
    veuillez; réessayer; réessayez; plus tard; recharger; rechargez; actualisez; désolé; désolés; vérifiez; minutes; connecter; voir; afficher; fonctionner; fonctionnement; momentanément; temporairement; saisie; interne; accéder; connecté; connexion
    por favor; inténtelo; intente; vuelva; de nuevo; más tarde; recargue; actualice; lo sentimos; compruebe; minutos; unos; iniciar; ver; mostrar; funcionar; temporalmente; interno; acceder; conectar
    proszę; spróbuj; spróbować; ponownie; później; odśwież; przepraszamy; sprawdź; minut; kilka; zaloguj; zobaczyć; wyświetlić; działania; działać; chwilowo; tymczasowo; wewnętrzny; uszkodzony
    riprova; più tardi; spiacenti; opnieuw; probeer; later; tente; novamente; mais tarde; prego; ricarica
"""
FILLING = """
    placeholder; placeholders; dummy; sample; filler; lorem ipsum; mock; provisional; your text; insert; add; type; enter; put; write; here; to be replaced; replaced; replace
    platzhalter; blindtext; mustertext; beispieltext; fülltext; einfügen; ersetzt; ersetzen; hier; eintragen; ergänzen
    faux texte; texte factice; texte provisoire; remplacer; à remplacer; insérer; insérez; ajoutez; ici; saisissez
    texto simulado; texto provisional; texto de ejemplo; texto de muestra; sustituir; reemplazar; insertar; inserte; añada; aquí; escriba; pendiente
    tekst próbny; tekst tymczasowy; tekst zastępczy; tekst przykładowy; zastąpienia; wstaw; dodaj; tutaj; wpisz
    testo segnaposto; testo di prova; tijdelijke tekst; voorbeeldtekst; texto fictício
"""
FILLED = """
    text; copy; content; heading; paragraph; title; caption; summary; introduction; description; body; layout; note; details
    text; inhalt; überschrift; absatz; titel; einleitung; beschreibung; zusammenfassung
    texte; contenu; titre; paragraphe; introduction; description; résumé
    texto; contenido; título; párrafo; introducción; descripción; resumen
    tekst; treść; tytuł; akapit; wstęp; opis; podsumowanie; nagłówek
"""
# Words of the usual mock Latin.
MOCK_LATIN = set("""lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation
    ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident
    sunt culpa qui officia deserunt mollit anim id est laborum cursus mattis ornare varius turpis lectus quasi porro pulvinar pulvin finis finibus vestibulum curabitur praesent
    pellentesque maecenas vivamus aenean nullam donec vitae tellus sapien mauris massa nunc justo libero quam ligula""".split())  # fmt: skip
MASHED_KEYS = set("asdf asdfg asdfgh asdfghjkl qwer qwert qwerty qwertz azerty hjkl jkl zxcv zxcvb yxcv dfgh fghj sdfg".split())
MOCK_OR_MASHED = MOCK_LATIN | MASHED_KEYS
# Words that name a field, and words that tell to fill one in.
FIELD_WORDS = set("""name date address postcode zip city street building block tower landlord tenant owner occupier assessor surveyor inspector engineer contractor author role flat unit number no ref
    reference type panel floor area client customer site code report result meter serial job due next last uprn gas supply property title company email phone telephone time year month day
    signature version id value text field placeholder premises location photo photograph picture image logo visit inspection order invoice amount price total first surname manager agent
    datum name anschrift adresse gebäude gebaeude prüfer pruefer ort straße strasse hausnummer mieter
    date nom adresse immeuble contrôleur controleur bâtiment batiment locataire ville
    fecha nombre direccion dirección edificio inquilino ciudad data nazwa adres adresat budynek inspektor najemca miasto datę""".split())  # fmt: skip
TELLING_WORDS = set("""insert enter add fill complete completed select choose specify type einfügen eingeben eintragen ausfüllen insérer saisir indiquer compléter insertar introducir
    rellenar indicar completar wpisz wstaw uzupełnij podaj""".split())  # fmt: skip

HERE = frozenset("here hier ici aquí tutaj".split())

_FOLD = regex.compile(r"[\p{Cf}͏᠋-᠎︀-️]+")
_SEGMENTS = regex.compile(r"(?<=[.!?…])\s+|[\r\n]+|(?<=>)\s*(?=\p{Lu})")
_QUOTED = regex.compile(r"[\"“”„«»][^\"“”„«»\n]+[\"“”„«»]")
_ANY_NAME = r"[\p{L}_][\p{L}\p{N}_ .\-|:/]*"
_SURE = regex.compile(rf"\{{\{{[^{{}}\n]*\}}\}}|\$\{{[^{{}}\n]+\}}|\$\(\s*{_ANY_NAME}\)|#\{{[^{{}}\n]+\}}|\{{%[^%\n]+%\}}|@@{_ANY_NAME}@@|<<\s*{_ANY_NAME}>>|\[\[{_ANY_NAME}\]\]|\$[\p{{Lu}}_][\p{{Lu}}\p{{N}}_]{{2,}}\$|\[object Object\]|\{{\d{{1,2}}\}}|\{{\p{{Ll}}[\p{{Ll}}_]{{2,}}\}}|\([^()\n]+ to be (?:added|inserted|completed)\)|\bDD/MM/YYYY\b|\bXX[/.\-]XX[/.\-]XX(?:XX)?\b")
_NAMED = regex.compile(rf"\{{\s*({_ANY_NAME})\}}|\[\s*({_ANY_NAME})\]|<\s*({_ANY_NAME})>|«\s*({_ANY_NAME})»|~({_ANY_NAME})~|%({_ANY_NAME})%|__({_ANY_NAME}?)__")
_TRACE = regex.compile(r"\bat [\w$]+(?:\.[\w$<>]+)+\(\w+\.\w+:\d+\)|\b(?:java|javax|org|com)(?:\.\w+)+(?:Exception|Error)\b|(?:^|\s)[A-Z]\w*(?:Error|Exception): |\bFile \"[^\"]+\", line \d+|\{\"error\"\s*:|<noscript\b|\bError [45]\d\d\b\s*:|\bFatal error: |^Warning: \w+\(|\bTraceback \(most recent call last\)|\bmysqli_connect\(\)")
_PLAIN_WORD = re.compile(r"[^\W_]+")


def _is_field(inner: str) -> bool:
    """True where the text between ambiguous marks names a field or tells to fill one in."""
    inner = inner.strip()
    if not inner:
        return False
    if regex.search(r"\p{L}_\p{L}|\p{L}_\p{N}|\p{Ll}\.\p{Ll}|\p{Ll}\p{Lu}", inner):
        return True
    words = [w.casefold() for w in regex.findall(r"\p{Lu}?\p{Ll}+|\p{Lu}+|\p{N}+", inner)]
    if len(words) > 1 and (words[0] in TELLING_WORDS or words[-1] in TELLING_WORDS or words[-1] in HERE or words[:2] == ["name", "of"] or words[:3] == ["to", "be", "completed"]):
        return True
    named = [w for w in words if not w.isdigit()]
    return bool(named) and all(w in FIELD_WORDS for w in named)


#: Roles of what the automaton finds.
WHOLE, SCRIPT, PLACE, FAILURE, NEED, REQUEST, FILL, FILLED_PART = (1 << i for i in range(8))
#: Share of a segment's telling letters that must be matched.
SHARE = 0.6
# Words with which a report of a message begins, but no message.
REPORTING = frozenset("a an during after before when while as at in on by since from ein eine einen während nach als bei am im un une pendant après lors una uno durante después al podczas po gdy".split())
_NEUTRAL = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split()) | set("ref id code status html body div head span br p h1 h2 h3 title www com org it's we're you're i'm".split())


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """Every phrase with its length, roles and, for whole phrases, its kind."""
    known: dict[str, tuple[int, str | None]] = {}
    for table in (PLAIN_SIGNS, STANDING_ALONE):
        for kind, listed in table.items():
            known.update((x.strip(), (WHOLE, kind)) for x in re.split(r";|\n", listed) if x.strip())
    for role, listed in ((SCRIPT, SCRIPTS), (PLACE, PLACES), (FAILURE, FAILURES), (NEED, NEEDS), (REQUEST, REQUESTS), (FILL, FILLING), (FILLED_PART, FILLED)):
        for x in re.split(r";|\n", listed):
            if x := x.strip():
                roles, kind = known.get(x, (0, None))
                known[x] = roles | role, kind
    auto = ahocorasick.Automaton()
    for phrase, (roles, kind) in known.items():
        auto.add_word(phrase, (len(phrase), roles, kind))
    auto.make_automaton()
    return auto


def _fold(text: str) -> str:
    return " ".join(text.replace("’", "'").lower().split())


_TOKENS = regex.compile(r"[^\s,;:!?\"'“”„«»()<>{}\[\]|=*_#-]+(?:['’-][^\W_]+)*")


def _kind_of(roles: int, kinds: set[str]) -> str | None:
    """What the matched words tell together."""
    if roles & WHOLE and kinds:
        return min(kinds)
    if roles & SCRIPT and roles & NEED:
        return "script"
    if roles & FAILURE and roles & PLACE:
        return "error"
    if roles & FILL and roles & FILLED_PART:
        return "filler"
    return None


def _segment_sign(segment: str) -> tuple[str, float] | None:
    """(kind, coverage) of a segment that is such text, or in which such text stands alone."""
    folded = segment.lower()
    folded = folded.replace("’", "'") if "’" in folded else folded
    roles = 0
    for _, (_, role, _) in _automaton().iter(folded):
        roles |= role
    if not roles & WHOLE and _kind_of(roles, set()) is None:
        return None  # what is found could tell nothing, wherever it stands
    plain = " ".join(_QUOTED.sub(lambda m: " ┃ " if len(m.group()) < len(segment) - 2 else m.group(), segment).replace("’", "'").split())
    folded = plain.lower()
    if len(folded) != len(plain):
        plain = folded
    n = len(folded)
    hits = []
    for end, (length, roles, kind) in _automaton().iter(folded):
        start = end - length + 1
        if (start and folded[start - 1].isalnum() and folded[start].isalnum() or end + 1 < n and folded[end + 1].isalnum() and folded[end].isalnum()) and ord(folded[start]) < 0x3000:
            continue
        hits.append((start, end + 1, roles, kind))
    if not hits:
        return None
    covered = bytearray(n)
    for start, end, _, _ in hits:
        covered[start:end] = b"\1" * (end - start)

    # Stretches of words that are matched or count for nothing.
    tokens = []  # start, end, matched, telling letters
    for m in _TOKENS.finditer(folded):
        a, b = m.span()
        word = m.group().rstrip(".…")
        letters = sum(ch.isalpha() for ch in word)
        neutral = not letters or word in _NEUTRAL or any(ch.isdigit() for ch in word) or "/" in word or "." in word or "@" in word
        hit = sum(covered[a:b]) * 2 > b - a
        tokens.append((a, b, hit, 0 if neutral and not hit else letters, neutral))
    whole = sum(t[3] for t in tokens)
    if not whole:
        return None
    share = sum(t[3] for t in tokens if t[2]) / whole

    def told(a: int, b: int) -> str | None:
        inside = [h for h in hits if h[0] >= a and h[1] <= b]
        roles = 0
        for h in inside:
            roles |= h[2]
        return _kind_of(roles, {h[3] for h in inside if h[3]})

    opening = next((k for k, t in enumerate(tokens) if t[2]), 0)
    if share >= SHARE and not any(folded[t[0] : t[1]] in REPORTING or not t[4] for t in tokens[:opening]) and (kind := told(0, n)):
        return kind, share
    shouted = plain.isupper()
    i = 0
    while i < len(tokens):
        if not (tokens[i][2] or tokens[i][4]):
            i += 1
            continue
        j = i
        while j < len(tokens) and (tokens[j][2] or tokens[j][4]):
            j += 1
        # The stretch from token i to j - 1; it may be cut at capitals, since texts are joined without stops.
        begins = [k for k in range(i, j) if (k == 0 or plain[tokens[k][0]].isupper() and not shouted) and folded[tokens[k][0] : tokens[k][1]] not in REPORTING]
        ends = [k for k in range(i + 1, j + 1) if k == len(tokens) or plain[tokens[k][0]].isupper() and not shouted]
        if begins and ends and (kind := told(tokens[begins[0]][0], tokens[ends[-1] - 1][1])):
            return kind, share
        i = j
    return None


def _mock_words(text: str) -> bool:
    """Runs of mock Latin, of one word repeated, of mashed keys or of x."""
    words = _PLAIN_WORD.findall(text.lower())
    # Most texts hold too few words of any such kind to have a run of them.
    known = MOCK_OR_MASHED.intersection(words)
    if len(known) < 2 and "xxx" not in text and "XXX" not in text and not any(a == b == c for a, b, c in zip(words, words[1:], words[2:])):
        return False
    latin = same = keys = crosses = 0
    before = None
    for w in words:
        latin = latin + 1 if w in MOCK_LATIN else 0
        same = same + 1 if w == before and not w.isdigit() else 1
        keys = keys + 1 if w in MASHED_KEYS else 0
        crosses = crosses + 1 if len(w) >= 3 and not w.strip("x") else 0
        before = w
        if latin >= 5 or keys >= 2 or crosses >= 3 or same >= 3 and len(w) > 3:
            return True
    return False


#: Characters and words without which no placeholder and no trace can stand in a text.
_MARKS = re.compile(r"[{\[<«~%$#@]|__| to be |DD/MM|XX")
_TRACE_MARKS = ("Error", "Exception", 'File "', "<noscript", '"error"', "Warning:", "Fatal error", "Traceback", "mysqli")
_TRACE_CALL = re.compile(r"\(\w+\.\w+:\d")


def signs(text: str | None) -> list[tuple[str, str, float]]:
    """(kind, evidence, coverage of its segment) of all residue in a text; nulls and clean texts have none."""
    if not text:
        return []
    text = html.unescape(text) if "&" in text else text
    text = text if text.isascii() else _FOLD.sub("", text)
    found = []
    if _MARKS.search(text):
        found += [("template", m.group(), 1.0) for m in _SURE.finditer(text)]
        for m in _NAMED.finditer(text, overlapped=True):
            if _is_field(next(g for g in m.groups() if g is not None)):
                found.append(("template", m.group(), 1.0))
    if any(mark in text for mark in _TRACE_MARKS) or "(" in text and _TRACE_CALL.search(text):
        found += [("error" if "noscript" not in m.group() else "script", m.group(), 1.0) for m in _TRACE.finditer(text)]
    for segment in _SEGMENTS.split(text):
        if segment and (sign := _segment_sign(segment)):
            found.append((sign[0], segment, round(sign[1], 3)))
    if _mock_words(text):
        found.append(("filler", "mock words", 1.0))
    return found


def find_residue(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document to exclude: doc_id, kinds, n_signs, signs. Documents with a null id or text have none.

    A document given twice comes out twice; whole texts are read, in one pass and without a shuffle. signs holds every
    find with its kind, its text and the coverage of its segment.
    """
    id_type = documents.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, body in zip(pdf["doc_id"], pdf["text"]):
                if found := signs(body):
                    rows.append((doc, sorted({kind for kind, _, _ in found}), len(found), found))
            yield pd.DataFrame(rows, columns=["doc_id", "kinds", "n_signs", "signs"])

    wanted = documents.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text").where("doc_id is not null and text is not null")
    return wanted.mapInPandas(scan, f"doc_id {id_type}, kinds array<string>, n_signs int, signs array<struct<kind: string, evidence: string, coverage: double>>")
