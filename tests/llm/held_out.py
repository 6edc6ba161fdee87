"""Wordings for measuring problems 6 and 10 on texts their rules were not written for.

Written once, before the rules of this round; never edited to suit them.
"""

DECLINING = {
    "en": """
        Nothing in the papers speaks to this point.
        I have no idea.
        The material I was handed is mute about that.
        I looked everywhere and came up empty.
        Those files leave the matter open.
        This one I will have to pass on.
        You won't get that from what I was shown.
        The pages before me stay quiet on it.
        My sources don't go into that.
        It is not something the texts touch on.
        There is simply nothing here to go by.
        Whatever I read, it skipped this.
        I must leave that unanswered.
        That lies beyond the papers in front of me.
        No trace of it in anything I was given.
        I'd only be guessing, so I'll stop here.
        Sadly the bundle gives me no basis for a reply.
        The extracts I hold never get to that.
        Hard to say from what is here.
        Without more to read I can offer nothing.
    """,
    "de": """
        Das lässt sich den Unterlagen nicht entnehmen.
        Dazu schweigen die Texte.
        Darüber steht hier nichts.
        Ich habe dazu leider nichts gefunden.
        Die Akten geben das nicht her.
        Dazu kann ich nichts beitragen.
        Das bleibt nach den vorliegenden Seiten offen.
        Keine der Quellen geht darauf ein.
        Dafür fehlt mir die Grundlage.
        Aus dem Vorliegenden ergibt sich das nicht.
        Hierzu muss ich passen.
        Mir liegt dazu nichts vor.
        Das ist mir nicht bekannt.
        Ohne weitere Unterlagen bleibt das unklar.
        Die Auszüge behandeln diesen Punkt nicht.
        Davon ist nirgends die Rede.
        Ich müsste raten und lasse es lieber.
        Eine Antwort darauf ist mir nicht möglich.
        Leider gibt der Kontext dazu nichts preis.
        In keinem der Texte wird das erwähnt.
    """,
    "fr": """
        Cela ne ressort pas des documents.
        Les textes restent muets à ce sujet.
        Je n'en ai pas la moindre idée.
        Aucun des extraits n'aborde ce point.
        Rien de ce que j'ai lu ne permet de le dire.
        Je dois laisser cette question sans réponse.
        Les pages fournies n'en parlent pas.
        Il m'est impossible de répondre.
        Je préfère ne pas deviner.
        Les sources passent ce point sous silence.
        Cela dépasse ce que contiennent les dossiers.
        On ne trouve rien là-dessus.
        Je ne suis pas en mesure de vous le dire.
        Ce détail ne m'a pas été communiqué.
        Il me manque des éléments pour répondre.
        Nulle part il n'en est question.
        Le contexte ne dit rien de tel.
        Malheureusement je l'ignore.
        Faute de documents, je ne peux conclure.
        Ces rapports ne traitent pas de cela.
    """,
    "es": """
        Eso no se desprende de los documentos.
        Los textos guardan silencio al respecto.
        No tengo la menor idea.
        Ninguno de los extractos trata este punto.
        Nada de lo que he leído permite decirlo.
        Debo dejar esta pregunta sin respuesta.
        Las páginas recibidas no hablan de ello.
        Me resulta imposible contestar.
        Prefiero no adivinar.
        Las fuentes pasan por alto este asunto.
        Eso queda fuera de lo que contienen los expedientes.
        No se encuentra nada sobre ello.
        No estoy en condiciones de decírselo.
        Ese dato no me fue comunicado.
        Me faltan elementos para responder.
        En ninguna parte se menciona.
        El contexto no dice nada de eso.
        Lamentablemente lo desconozco.
        Sin más documentos no puedo concluir.
        Estos informes no se ocupan de eso.
    """,
    "pl": """
        Nie wynika to z dokumentów.
        Teksty milczą na ten temat.
        Nie mam pojęcia.
        Żaden z fragmentów nie porusza tej kwestii.
        Nic z tego, co czytałem, na to nie wskazuje.
        Muszę zostawić to pytanie bez odpowiedzi.
        Otrzymane strony o tym nie mówią.
        Nie potrafię na to odpowiedzieć.
        Wolę nie zgadywać.
        Źródła pomijają tę sprawę.
        To wykracza poza to, co jest w aktach.
        Nic na ten temat nie znalazłem.
        Nie jestem w stanie tego powiedzieć.
        Tej informacji mi nie przekazano.
        Brakuje mi podstaw do odpowiedzi.
        Nigdzie nie ma o tym mowy.
        Kontekst nic o tym nie mówi.
        Niestety tego nie wiem.
        Bez dalszych dokumentów nie mogę tego ocenić.
        Te raporty się tym nie zajmują.
    """,
}

ANSWERING = {
    "en": """
        The riser door was found without a closer and is to be fixed by the landlord.
        No defects were found in the lobby.
        The lift does not stop at the basement.
        None of the residents has to leave.
        The inspector could not open the hatch, which counts as a limitation of the survey.
        It was not replaced because the seal is sound.
        Nobody tests it at night.
        The panel is unable to report faults since the battery is flat.
        The report says nothing was stored in the shaft.
        Access was refused by the tenant of the top flat.
    """,
    "de": """
        Die Tür im Treppenhaus hat keinen Schließer und wird vom Vermieter instand gesetzt.
        Im Flur wurden keine Mängel gefunden.
        Der Aufzug hält nicht im Keller.
        Niemand muss die Wohnung verlassen.
        Die Klappe ließ sich nicht öffnen, was als Einschränkung vermerkt ist.
        Sie wurde nicht ersetzt, weil die Dichtung in Ordnung ist.
        Nachts prüft sie keiner.
        Die Zentrale meldet keine Störungen, weil die Batterie leer ist.
        Laut Bericht lag im Schacht nichts.
        Der Mieter der obersten Wohnung verweigerte den Zutritt.
    """,
    "fr": """
        La porte de l'escalier n'a pas de ferme-porte et sera réparée par le bailleur.
        Aucun défaut n'a été trouvé dans le couloir.
        L'ascenseur ne dessert pas le sous-sol.
        Personne n'a besoin de quitter son logement.
        La trappe n'a pas pu être ouverte, ce qui limite le contrôle.
        Il n'a pas été remplacé car le joint est sain.
        Personne ne la teste la nuit.
        La centrale ne signale plus les pannes car la batterie est vide.
        Selon le rapport, rien n'était entreposé dans la gaine.
        Le locataire du dernier étage a refusé l'accès.
    """,
    "es": """
        La puerta de la escalera no tiene cierre y la reparará el propietario.
        No se encontraron defectos en el pasillo.
        El ascensor no para en el sótano.
        Nadie tiene que salir de su vivienda.
        La trampilla no se pudo abrir, lo que limita la inspección.
        No se cambió porque la junta está en buen estado.
        Nadie la prueba de noche.
        La central no avisa de fallos porque la batería está descargada.
        Según el informe, en el hueco no había nada guardado.
        El inquilino del ático negó el acceso.
    """,
    "pl": """
        Drzwi na klatce nie mają samozamykacza i naprawi je właściciel.
        W korytarzu nie znaleziono usterek.
        Winda nie zatrzymuje się w piwnicy.
        Nikt nie musi opuszczać mieszkania.
        Klapy nie dało się otworzyć, co ogranicza przegląd.
        Nie wymieniono jej, bo uszczelka jest sprawna.
        W nocy nikt jej nie sprawdza.
        Centrala nie zgłasza awarii, bo bateria jest rozładowana.
        Według raportu w szybie nic nie składowano.
        Najemca z ostatniego piętra odmówił wstępu.
    """,
}

RESIDUE = {
    "en": """
        Oops, that page doesn't exist anymore.
        JavaScript needs to be on for this site to work.
        Error: page missing
        [Client Name Here]
        This content is unavailable because scripts are switched off.
        The link you followed is broken or has expired.
        Server error, try again in a few minutes.
        Your browser blocks scripts; allow them and reload the page.
        We couldn't find the page you were after.
        Placeholder copy, to be replaced.
        Hello {first_name}, your report is ready.
        Error 503: service temporarily overloaded
        This site needs JavaScript and cookies.
        Add your introduction here.
        You are not allowed to access this resource.
        Lorem ipsum dolor sit amet, consectetur adipiscing elit.
        Connection timed out while contacting the server.
        <insert date>
        Sorry, this document could not be loaded.
        Turn JavaScript back on to see the comments.
    """,
    "de": """
        Hoppla, diese Seite gibt es nicht mehr.
        Für diese Website muss JavaScript eingeschaltet sein.
        Fehler: Seite fehlt
        [Name des Kunden hier]
        Dieser Inhalt ist ohne aktive Skripte nicht verfügbar.
        Der Link ist fehlerhaft oder abgelaufen.
        Serverfehler, bitte in wenigen Minuten erneut versuchen.
        Ihr Browser blockiert Skripte, bitte erlauben und neu laden.
        Die gesuchte Seite konnte nicht gefunden werden.
        Platzhalter, wird noch ersetzt.
        Guten Tag {vorname}, Ihr Bericht liegt bereit.
        Fehler 503: Dienst vorübergehend überlastet
        Diese Seite braucht JavaScript und Cookies.
        Hier Einleitung einfügen.
        Sie haben keine Berechtigung für diese Ressource.
        Blindtext Blindtext Blindtext
        Zeitüberschreitung bei der Verbindung zum Server.
        <Datum einfügen>
        Dieses Dokument konnte leider nicht geladen werden.
        Schalten Sie JavaScript wieder ein, um die Kommentare zu sehen.
    """,
    "fr": """
        Oups, cette page n'existe plus.
        Ce site a besoin de JavaScript pour fonctionner.
        Erreur : page manquante
        [Nom du client ici]
        Ce contenu n'est pas disponible sans scripts actifs.
        Le lien est rompu ou a expiré.
        Erreur du serveur, réessayez dans quelques minutes.
        Votre navigateur bloque les scripts, autorisez-les et rechargez la page.
        La page demandée est introuvable.
        Texte provisoire, à remplacer.
        Bonjour {prenom}, votre rapport est prêt.
        Erreur 503 : service momentanément surchargé
        Cette page exige JavaScript et les cookies.
        Ajoutez votre introduction ici.
        Vous n'êtes pas autorisé à accéder à cette ressource.
        Faux texte faux texte faux texte
        Délai dépassé lors de la connexion au serveur.
        <insérer la date>
        Désolé, ce document n'a pas pu être chargé.
        Réactivez JavaScript pour voir les commentaires.
    """,
    "es": """
        Vaya, esta página ya no existe.
        Este sitio necesita JavaScript para funcionar.
        Error: falta la página
        [Nombre del cliente aquí]
        Este contenido no está disponible sin scripts activos.
        El enlace está roto o ha caducado.
        Error del servidor, inténtelo de nuevo en unos minutos.
        Su navegador bloquea los scripts, permítalos y recargue la página.
        No hemos encontrado la página solicitada.
        Texto provisional, pendiente de sustituir.
        Hola {nombre}, su informe está listo.
        Error 503: servicio temporalmente saturado
        Esta página exige JavaScript y cookies.
        Añada aquí su introducción.
        No tiene permiso para acceder a este recurso.
        Texto simulado texto simulado texto simulado
        Tiempo de espera agotado al conectar con el servidor.
        <insertar fecha>
        Lo sentimos, este documento no se pudo cargar.
        Vuelva a activar JavaScript para ver los comentarios.
    """,
    "pl": """
        Ups, ta strona już nie istnieje.
        Ta witryna potrzebuje JavaScript do działania.
        Błąd: brak strony
        [Nazwa klienta tutaj]
        Ta treść jest niedostępna bez aktywnych skryptów.
        Link jest uszkodzony lub wygasł.
        Błąd serwera, spróbuj ponownie za kilka minut.
        Twoja przeglądarka blokuje skrypty, zezwól na nie i odśwież stronę.
        Nie udało się znaleźć żądanej strony.
        Tekst tymczasowy, do zastąpienia.
        Dzień dobry {imie}, raport jest gotowy.
        Błąd 503: usługa chwilowo przeciążona
        Ta strona wymaga JavaScript i plików cookie.
        Tutaj dodaj wstęp.
        Nie masz uprawnień do tego zasobu.
        Tekst próbny tekst próbny tekst próbny
        Przekroczono czas połączenia z serwerem.
        <wstaw datę>
        Przepraszamy, nie można wczytać dokumentu.
        Włącz ponownie JavaScript, aby zobaczyć komentarze.
    """,
}

REAL = {
    "en": """
        The contractor asked whether lorem ipsum had been left in the brochure, and I said no.
        Tenants wrote that the page you requested through the intranet form was printed.
        The door entry server failed twice in March and was replaced by the managing agent.
        Access denied by the occupier of flat 12, so the meter was read from outside.
        The error in the pressure reading was traced to a worn gauge.
        Residents complained that the booking site told them to enable JavaScript before they could report a leak.
        Page 4 of the logbook is missing and the caretaker was asked to rewrite it.
        TBC TBC TBC
        The template used to cut the gasket was not found in the workshop.
        Insert the key, turn it to the left and reset the override switch.
    """,
    "de": """
        Der Hausmeister fragte, ob im Prospekt noch Blindtext stehe, und ich verneinte.
        Die Mieter schrieben, dass die angeforderte Seite über das Formular ausgedruckt wurde.
        Der Server der Türanlage fiel im März zweimal aus und wurde ersetzt.
        Der Zutritt zur Wohnung 12 wurde verweigert, der Zähler daher von außen abgelesen.
        Der Fehler in der Druckmessung ging auf ein verschlissenes Manometer zurück.
        Bewohner beklagten, dass das Portal sie zum Einschalten von JavaScript aufforderte, bevor sie ein Leck melden konnten.
        Seite 4 des Prüfbuchs fehlt und soll vom Hausmeister neu geschrieben werden.
        Die Schablone für die Dichtung wurde in der Werkstatt nicht gefunden.
        Schlüssel einführen, nach links drehen und den Schalter zurücksetzen.
        Das Dokument wurde dem Vermieter am Montag übergeben.
    """,
    "fr": """
        Le gardien a demandé s'il restait du faux texte dans la brochure, et j'ai dit que non.
        Les locataires ont écrit que la page demandée par le formulaire avait été imprimée.
        Le serveur de l'interphone est tombé en panne deux fois en mars et a été remplacé.
        L'accès au logement 12 a été refusé, le compteur a donc été lu de l'extérieur.
        L'erreur de mesure de pression venait d'un manomètre usé.
        Des résidents se plaignent que le portail leur demande d'activer JavaScript avant de signaler une fuite.
        La page 4 du registre manque et le gardien doit la réécrire.
        Le gabarit du joint est resté introuvable à l'atelier.
        Insérez la clé, tournez-la à gauche et réarmez le commutateur.
        Le document a été remis au bailleur lundi.
    """,
    "es": """
        El conserje preguntó si quedaba texto de relleno en el folleto, y le dije que no.
        Los inquilinos escribieron que la página solicitada por el formulario se había impreso.
        El servidor del portero automático falló dos veces en marzo y fue sustituido.
        Se negó el acceso a la vivienda 12, así que el contador se leyó desde fuera.
        El error en la lectura de presión se debía a un manómetro gastado.
        Los vecinos se quejan de que el portal les pide activar JavaScript antes de avisar de una fuga.
        Falta la página 4 del libro de registro y el conserje debe reescribirla.
        La plantilla de la junta no se encontró en el taller.
        Inserte la llave, gírela a la izquierda y rearme el interruptor.
        El documento se entregó al propietario el lunes.
    """,
    "pl": """
        Dozorca zapytał, czy w folderze został tekst zastępczy, i powiedziałem, że nie.
        Najemcy napisali, że strona zamówiona przez formularz została wydrukowana.
        Serwer domofonu zawiódł dwa razy w marcu i został wymieniony.
        Odmówiono dostępu do mieszkania 12, więc licznik odczytano z zewnątrz.
        Błąd pomiaru ciśnienia wynikał ze zużytego manometru.
        Mieszkańcy skarżyli się, że portal kazał im włączyć JavaScript, zanim zgłosili wyciek.
        W książce brakuje strony 4 i dozorca ma ją przepisać.
        Szablonu uszczelki nie znaleziono w warsztacie.
        Włóż klucz, obróć go w lewo i zresetuj przełącznik.
        Dokument przekazano właścicielowi w poniedziałek.
    """,
}


def lines(table: dict[str, str]) -> list[tuple[str, str]]:
    """(language, sentence) of a table."""
    return [(lang, x.strip()) for lang, block in table.items() for x in block.split("\n") if x.strip()]
