"""Template residue, filler, error messages and demands for scripts in place of content.

One automaton holds phrases, cues and filler words of all languages; it reads each page's title, headings and main body
once.  A phrase covers itself.  A cue says that something failed or is asked for; it covers its whole sentence if that
also names what failed (a page, a server, the reader's browser), in whatever words.  Filler and messages exclude a page
when what they cover is much of the text they stand in (a block for filler, the page for messages), so that a text about
errors stays.  Unfilled placeholders and left-over values exclude a page wherever they stand but in code samples.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.main_content import labelled

#: Share of a page's text that messages must cover, and share if its heading or title is a message by itself.
MESSAGE_COVERAGE, ANNOUNCED_COVERAGE = 0.25, 0.05
#: What a sentence known by cues counts for, against one known by its phrase.
CUE_WEIGHT = 0.75
#: Share of a block's words that filler must cover, and how many different filler words make evidence.
FILLER_COVERAGE, FILLER_KINDS = 0.75, 4

#: Messages shown instead of content, case ignored.
MESSAGES = """
page not found
not found
404
nothing lives at this address any more
nothing lives at this address
we could not find the page you asked for
the page you requested could not be found
the page you are looking for
this page does not exist
does not exist
oops
something went wrong
an error occurred
application error
a server-side exception has occurred
a client-side exception has occurred
internal server error
the server met an unexpected condition and stopped
the server encountered an error
error establishing a database connection
502 bad gateway
bad gateway
gateway timeout
upstream gave no answer
service unavailable
we are down for maintenance
please come back soon
please try again later
under maintenance
scheduled maintenance
access denied
forbidden
you do not have permission to view this resource
you don't have permission to access
permission denied
too many requests
slow down, you sent too many requests
rate limit exceeded
this product is gone
the item you look for has been removed or never existed
no longer available
traceback
typeerror
cannot read property
cannot read properties of
stack trace
failed to open stream
no such file or directory
fatal error
warning: include
uncaught exception
seite nicht gefunden
die gewünschte seite gibt es nicht mehr
die angeforderte seite
nicht gefunden
interner fehler
interner serverfehler
der server konnte die anfrage nicht bearbeiten
ein fehler ist aufgetreten
wartungsarbeiten
wir sind bald wieder für sie da
zugriff verweigert
kein zugriff
sie haben keine berechtigung
zu viele anfragen
dienst nicht verfügbar
page introuvable
la page demandée n'existe pas ou plus
la page demandée
erreur interne
erreur interne du serveur
le serveur a rencontré un problème
une erreur est survenue
accès refusé
accès interdit
vous n'avez pas accès à cette page
service indisponible
site en maintenance
trop de requêtes
página no encontrada
no hemos podido encontrar la página solicitada
la página solicitada
error interno
error interno del servidor
el servidor encontró un problema
se ha producido un error
acceso denegado
acceso prohibido
no tiene permiso para ver esta página
no tiene permiso
servicio no disponible
en mantenimiento
demasiadas solicitudes
you need to enable javascript to run this app
enable javascript
please enable javascript
this site doesn't work properly without javascript
doesn't work properly without javascript
without javascript
please turn on scripts in your browser to continue
turn on scripts
checking your browser before you go on
checking your browser
scripts and cookies must be allowed
javascript is disabled
javascript is required
requires javascript
verify you are human
bitte aktivieren sie javascript
bitte aktivieren sie javascript, um fortzufahren
aktivieren sie javascript
diese seite benötigt skripte
diese seite benötigt javascript
veuillez activer javascript
veuillez activer javascript pour afficher cette page
activez javascript
ce site a besoin des scripts pour fonctionner
ce site a besoin de javascript
active javascript para ver este sitio
active javascript
habilite javascript
esta aplicación necesita scripts para funcionar
esta aplicación necesita javascript
necesita javascript
""".strip().splitlines()

#: Words of filler text, by language.
FILLER = {
    "latin": "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna "
    "aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui "
    "officia deserunt mollit anim id est laborum",
    "en": "sample dummy filler placeholder text here goes your words line block paragraph copy demo example content more some",
    "de": "muster block absatz fülltext zeile mehr hier beispiel ihre platzhalter blindtext inhalt wörter noch text",
    "fr": "faux texte mots provisoire exemple ligne votre contenu remplissage paragraphe encore bloc suite ici",
    "es": "relleno párrafo más aquí falso contenido línea provisional prueba texto bloque ejemplo palabras su",
}
#: Words that people type to fill a field.
FILLER["typed"] = "asdf asdfasdf qwerty foo bar baz bla blah blub xxx xxxx yyy zzz aaa bbb test tests testing dummy"
#: Filler of the classic kind under another first word, and sentences that show a typeface.
SPECIMEN = re.compile(r"^\W*\w+ ipsum (?:dolor|amet|sit)\b|\bquick brown fox jumps over|\bboxkämpfer jagen|\bportez ce vieux whisky|\bveloz murciélago hindú", re.I)

#: Cues that something failed, is refused or is asked for, by language.
CUES = """
not found|can't find|cannot find|can not find|couldn't find|could not find|can't be found|cannot be found|couldn't be found|could not be found|unable to find|can't locate|doesn't exist|does not exist|no longer exists|never existed
isn't available|is not available|not available|no longer available|currently unavailable|temporarily unavailable|unavailable|offline|went wrong|gone wrong|broke|is broken|has failed|failed to load|failed|crashed|an error|unexpected error|error occurred
been blocked|is blocked|denied|forbidden|not allowed|not authorized|not authorised|no permission|permission to|been removed|been deleted|been moved|has moved|has expired|is missing|timed out|too many|try again|back soon|down for|under maintenance|being updated|overloaded
oops|whoops|uh oh|sorry|just a moment|one moment|please wait|are you human|you are human|not a robot|a robot|unusual traffic|suspicious activity
enable|turn on|switch on|activate|allow|requires|needs|must have|does not support|doesn't support|is disabled|is turned off|is off|verify|verifying|checking
nicht gefunden|nicht finden|existiert nicht|gibt es nicht|nicht mehr verfügbar|nicht verfügbar|nicht erreichbar|nicht vorhanden|schiefgelaufen|schief gelaufen|schiefgegangen|ein fehler|fehler aufgetreten|ist aufgetreten|gesperrt|verweigert|nicht erlaubt|nicht berechtigt|keine berechtigung|kein zugriff
gelöscht|entfernt|verschoben|abgelaufen|zu viele|erneut versuchen|noch einmal|später wieder|bald wieder|gewartet|wartung|überlastet|hoppla|ups|leider|einen moment|einen augenblick|bitte warten|kein roboter|ein mensch
aktivieren|aktiviere|einschalten|erlauben|benötigt|unterstützt kein|unterstützt keine|deaktiviert|ausgeschaltet|überprüfen|überprüft|geprüft
introuvable|n'existe pas|n'existe plus|pas trouvé|pas trouver|pas été trouvée|plus disponible|indisponible|pas disponible|inaccessible|mal passé|une erreur|erreur s'est|est survenue|refusé|bloqué|bloquée|interdit|pas autorisé|pas le droit|supprimée|supprimé|déplacée|expiré|trop de|réessayer|réessayez|de retour|en maintenance|en cours de maintenance|surchargé
oups|désolé|désolés|un instant|un moment|veuillez patienter|patientez|pas un robot|êtes humain
activer|activez|autoriser|autorisez|nécessite|ne prend pas en charge|désactivé|vérifier|vérifions|vérification
no encontrada|no encontrado|no encontramos|no se encuentra|no se encontró|no pudimos encontrar|no hemos encontrado|no existe|ya no existe|ya no está|no disponible|no está disponible|salió mal|ha ido mal|fue mal|un error|ha fallado|falló|denegado|bloqueado|bloqueada|prohibido|no autorizado|sin permiso|no tiene acceso|eliminada|eliminado|caducado|demasiadas|inténtelo|inténtalo|vuelva a intentar|volveremos|de vuelta|mantenimiento|saturado
vaya|ups|lo sentimos|un momento|espere|no es un robot|es humano
active|activa|activar|habilite|habilita|habilitar|permitir|permita|requiere|necesita|no admite|no soporta|desactivado|deshabilitado|verificar|verificando|comprobando
""".replace("\n", "|").strip("|").split("|")
#: What fails, refuses or is asked for in such a message, by language.
_THINGS = re.compile(
    r"\b(?:(?:web)?pages?|urls?|links?|address|(?:web)?site|resource|server|service|request|connection|database|something|browser|javascript|scripts?|js|cookies|access|you(?:'ve| have| are| do|r access| don't)|product|item|listing|document|file|captcha|human|robot"
    r"|(?:web)?seiten?|adresse|server|dienst|anfrage|verbindung|datenbank|etwas|zugriff|zugang|skripte?|sie haben|sie sind|produkt|artikel|datei|mensch|roboter"
    r"|lien|adresse|serveur|requête|connexion|base de données|quelque chose|navigateur|accès|vous (?:avez|êtes|n'avez)|produit|fichier|humain"
    r"|páginas?|enlace|dirección|sitio|servidor|servicio|solicitud|conexión|base de datos|algo|navegador|acceso|usted|ha sido|producto|archivo|humano)\b"
)
#: Cues that ask for scripts or prove a reader; they need the thing they ask for, not just any.
_ASKING = frozenset(
    """enable|turn on|switch on|activate|allow|requires|needs|must have|does not support|doesn't support|is disabled|is turned off|is off|verify|verifying|checking|aktivieren|aktiviere|einschalten|erlauben|benötigt|unterstützt kein|unterstützt keine|deaktiviert|ausgeschaltet|überprüfen|überprüft|geprüft
activer|activez|autoriser|autorisez|nécessite|ne prend pas en charge|désactivé|vérifier|vérifions|vérification|active|activa|activar|habilite|habilita|habilitar|permitir|permita|requiere|necesita|no admite|no soporta|desactivado|deshabilitado|verificar|verificando|comprobando""".replace("\n", "|").split("|")
)
_ASKED = re.compile(r"\b(?:java ?scripts?|scripts?|js|cookies|browser|human|robot|skripte?|mensch|roboter|navigateur|humain|navegador|humano)\b")
_SENTENCES = re.compile(r"(?<=[.!?…:])\s+|\n+")
#: Words in quotation marks are spoken of, not said.
_QUOTED = re.compile(r"[“„«\u2018‚‹][^“”„«»\u2018\u2019‹›\n]{1,200}[”“»\u2019‘›]|\"[^\"\n]{1,200}\"")

#: Values and instructions left in place of a title or heading, as a whole part of it.
LEFT_OVER = frozenset(
    """undefined|null|nan|none|[object object]|untitled|untitled document|untitled page|new page|sample page|test|test page|lorem ipsum
todo: page title|todo|tbd|insert title here|your headline here|your title here|page title|title goes here|titel hier einfügen|ihr titel hier
neue seite|beispielseite|unbenannt|ohne titel|votre titre ici|nouvelle page|page d'exemple|sans titre|título de ejemplo aquí|su título aquí
página de ejemplo|nueva página|sin título""".replace("\n", "|").split("|")
)
#: Instructions and empty values inside a text.
INSTRUCTIONS = re.compile(
    r"insert (?:your )?(?:text|title|content|description) here|(?:text|copy|content|title|description) goes here|your (?:text|headline|title|content) here"
    r"|hier steht ihr text|(?:text|titel) hier einfügen|votre (?:texte|titre) ici|(?:insérez|saisissez) votre (?:texte|titre)|escriba aquí su"
    r"|(?:inserte|introduzca) (?:aquí )?su (?:texto|título)|\bundefined undefined\b|\bsince null\b|\[object object\]|\bTODO:",
    re.I,
)
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{0,80}\}\}|\{%[^{}\n]{1,80}%\}|<%[=-]?[^<>\n]{1,80}%>|[$#]\{[^{}\n]{1,60}\}|\[\[[^\[\]\n]{1,60}\]\]"
    r"|%%?[A-Za-z]\w{2,40}%%?(?!\w)|__[A-Z][A-Z0-9_]{2,40}__|\{(?:\d{1,2}|[a-z][a-z0-9]*(?:[_.][a-z0-9]+)*)\}"
    r"|<<\s?[A-Za-z][\w .-]{0,40}\s?>>|\*\|[A-Z_:]{2,40}\|\*|@@[A-Z_]{2,40}@@|\$\$[A-Za-z]\w{1,40}\$\$|\{[a-z]+(?:[A-Z][a-z0-9]+)+\}"
    r"|\[(?:insert|enter|add|type|your|name of|einfügen|hier|ihr|ihre|insérer|votre|insertar|su) [^\[\]\n]{1,40}\]|\[(?:[A-Z][a-z]+ (?:Name|Title|Price|Here|City|Date|Company|Address)|(?:YOUR |INSERT )?[A-Z_]{4,20}|(?:Your|Insert) [A-Za-z ]{2,30})\]"
)
_WHOLE = frozenset(MESSAGES)
_CODE = re.compile(r"<(code|pre|kbd|samp)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_PARTS = re.compile(r"\s(?:[|–—\-·»/]|::)\s")
_WORD = re.compile(r"[^\W\d_]+")
HEADINGS = range(2, 8)


@cache
def automaton():
    """Phrases, cues and filler words of all languages; a value is (kind, length), the kind None for phrases, '' for cues."""
    import ahocorasick

    found = ahocorasick.Automaton()
    values: dict[str, list] = {}
    for phrase in MESSAGES:
        values.setdefault(f" {phrase} ", []).append((None, len(phrase)))
    for cue in CUES:
        values.setdefault(f" {cue} ", []).append(("", len(cue)))
    for lang, words in FILLER.items():
        for word in words.split():
            values.setdefault(f" {word} ", []).append((lang, len(word)))
    for key, value in values.items():
        found.add_word(key, value)
    found.make_automaton()
    return found


_SPLIT = re.compile(r"[^\w'\-]+")


def spaced(text: str) -> str:
    """Lower case with single spaces around words, so that phrases match whole words only."""
    return " " + " ".join(_SPLIT.split(text.lower().replace("\u2019", "'"))).strip() + " "


def covered(plain: str) -> tuple[int, bool, dict[str, list[str]]]:
    """Of a spaced text: characters that phrases cover, whether there is a cue, and the filler words by language."""
    upto, chars, cue, filler = 0, 0, False, {}
    for end, values in automaton().iter(plain):
        for kind, size in values:
            if kind is None:
                start = max(upto, end - size)
                chars += max(0, end - start)
                upto = max(upto, end)
            elif kind:
                filler.setdefault(kind, []).append(plain[end - size : end])
            else:
                cue = True
    return chars, cue, filler


def _is_message(plain: str) -> bool:
    """Whether a spaced sentence says by its cues that something failed, is refused or is asked for."""
    cues = {plain[end - size : end] for end, values in automaton().iter(plain) for kind, size in values if kind == ""}
    failing, asking = cues - _ASKING, cues & _ASKING
    return bool((failing and _THINGS.search(plain)) or (asking and _ASKED.search(plain)))


def message_chars(text: str, plain: str) -> float:
    """How much of a block messages cover: phrases as they are, sentences known by cues at their weight."""
    chars, cue, _ = covered(plain)
    if (chars or cue) and _QUOTED.search(text):
        text = _QUOTED.sub(" quoted ", text)
        chars, cue, _ = covered(spaced(text))
    if not cue:
        return chars
    total = 0.0
    for sentence in _SENTENCES.split(text):
        own = spaced(sentence)
        known = covered(own)[0]
        total += max(known, CUE_WEIGHT * (len(own) - 2)) if _is_message(own) else known
    return max(chars, total)


def _placeholder(text: str) -> bool:
    return bool(("{" in text or "%" in text or "[" in text or "__" in text or "<<" in text or "*|" in text or "@@" in text or "$$" in text) and PLACEHOLDER.search(text))


def _announces(text: str) -> bool:
    """Whether a part of a title or heading is a message and nothing else."""
    for part in _PARTS.split(text.strip()):
        if part.strip().lower() in _WHOLE:
            return True
        plain = spaced(part)
        if len(plain) > 2 and plain.count(" ") <= 12 and message_chars(part, plain) >= 0.7 * (len(plain) - 2):
            return True
    return False


def _filler(text: str, plain: str) -> bool:
    """Whether a block is filler: mostly filler words of one language, several different ones."""
    if SPECIMEN.search(text):
        return True
    words = plain.count(" ") - 1
    return any(len(found) >= FILLER_COVERAGE * words and len(found) >= FILLER_KINDS and (len(set(found)) >= FILLER_KINDS or lang == "typed") for lang, found in covered(plain)[2].items())


def is_residue(title: str | None, page: list, main: list[bool]) -> bool:
    """Whether a page shows residue instead of content; a page without any text does not."""
    title = title or ""
    if _placeholder(title) or INSTRUCTIONS.search(title):
        return True
    if any(part.strip().lower() in LEFT_OVER for part in _PARTS.split(title)):
        return True
    size, matched = 0, 0.0
    announced = False
    bare = not any(inside and not block.text.isspace() and block.text for block, inside in zip(page, main))
    for block, inside in zip(page, main):
        heading = block.kind in HEADINGS
        loose = block.kind > 8 and not block.links
        # Where no block is of a main body, every block that is no list of links is read.
        if not (inside or block.kind == 2 or loose or (bare and 2 * block.linked < len(block.text))):
            continue
        text = block.text
        if not text or text.isspace():
            continue
        if _placeholder(text) or INSTRUCTIONS.search(text):
            return True
        if heading and any(part.strip().lower() in LEFT_OVER for part in _PARTS.split(text.strip())):
            return True
        plain = spaced(text)
        announced = announced or (block.kind == 2 and _announces(text))
        size += len(plain) - 2
        matched += message_chars(text, plain)
        if _filler(text, plain):
            return True
    announced = announced or (0 < matched and _announces(title))
    return matched > 0 and (matched >= MESSAGE_COVERAGE * size or (announced and matched >= ANNOUNCED_COVERAGE * size))


def without_code(html: str | None) -> str | None:
    return _CODE.sub(" ", html) if html and ("<code" in html or "<pre" in html or "<CODE" in html or "<PRE" in html) else html


def residue_found(pages: DataFrame) -> DataFrame:
    """(page_id): pages to leave out; a repeated page_id counts once, null html and null titles hold nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            titles = b.column("title").to_pylist()
            htmls = [without_code(h) for h in b.column("html").to_pylist()]
            hit = [is_residue(t, page, main) for t, (page, main) in zip(titles, labelled(htmls))]
            yield pa.RecordBatch.from_arrays([b.column("page_id").filter(pa.array(hit, pa.bool_()))], names=["page_id"])

    return pages.where("page_id is not null").select("page_id", "title", "html").mapInArrow(run, "page_id bigint").distinct()


def without_residue(pages: DataFrame) -> DataFrame:
    """The pages that hold content."""
    return pages.join(residue_found(pages), "page_id", "left_anti")
