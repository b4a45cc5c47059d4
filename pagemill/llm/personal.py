"""Personal information in free text, found behind disguises and replaced by typed placeholders.

A text is normalised first: look-alike letters and full-width forms become ordinary ones, invisible characters vanish,
"at" and "dot" in words or brackets become signs, and spelled digits become digits.  Every normalised character keeps
the place of its source, so what is detected is mapped back and only those source characters are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds and their placeholders.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

#: The file of given names that counts, by region; a parameter.
GIVEN_NAMES = Path(__file__).with_name("given_names.txt")
GIVEN = frozenset(w for line in GIVEN_NAMES.read_text("utf-8").splitlines() if not line.startswith("#") for w in line.split())

_L = r"[^\W\d_]"
_CAP = "[A-ZÄÖÜÀÁÂÇÈÉÊËÌÍÎÏÑÒÓÔÙÚÛ]"

#: The transducers' alphabet: bracketed or spaced words for signs.
_AT = re.compile(
    r"(?<=\w)\s+@\s+(?=[\w-]+\.\w)|\s*[(\[{<]\s*(?:at|AT|ät|arroba|arobase|chez|klammeraffe|@)\s*[)\]}>]\s*|(?<=[\w])\s+(?:at|AT|arroba|arobase)\s+(?=(?:[\w-]+(?: (?:dot|DOT|punkt|punto|point) |\.))*[\w-]+\s*(?:\.|[(\[{<]\s*(?:dot|punkt|punto|point)|\s(?:dot|DOT|punkt|punto|point)\s))"
)
_DOT = re.compile(r"\s*[(\[{<]\s*(?:dot|DOT|punkt|punto|point|\.)\s*[)\]}>]\s*|(?<=[a-zA-Z0-9-])\s+(?:dot|DOT)\s+(?=[a-zA-Z])")
#: "point" and the like are signs only behind the sign of an address.
_POINT = re.compile(r" (?:punkt|punto|point) (?=[a-z]{2,10}\b)")
_IN_DOMAIN = re.compile(r"@[\w.-]+$")
#: Digits in words.
_DIGITS = {
    w: str(i)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, w in enumerate(words.split())
}
#: Words beside the digits in a number read aloud; they count inside a run of digit words only.
_REPEATS = {"double": 2, "triple": 3, "doppel": 2, "doble": 2}
_DIGITS_TOO = {"oh": "0", "o": "0", "nought": "0", "nil": "0", "zwo": "2"}
_digit_word = "|".join(sorted(_DIGITS, key=len, reverse=True))
_spoken = "|".join(sorted([*_DIGITS, *_DIGITS_TOO, *(f"(?:{r})[\\s-]+(?:{_digit_word}|oh|o)" for r in _REPEATS)], key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:oh\s+)?(?:plus\s+)?(?:(?:double|triple)[\s-]+)?(?:{_digit_word})(?:(?:[\s-]|,\s)+(?:{_spoken})\b){{4,}}", re.I)
_BEFORE_DIGIT = re.compile(r"\b(?:oh|plus|double|triple)\s+$", re.I)
_WORD = re.compile(r"\w+")


def _read_aloud(run: str) -> str:
    """The digits of a number in words."""
    out, times = "", 1
    for w in _WORD.findall(run.lower()):
        if w in _REPEATS:
            times = _REPEATS[w]
        else:
            out += "+" if w == "plus" else (_DIGITS.get(w) or _DIGITS_TOO[w]) * times
            times = 1
    return out

_IGNORABLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
#: Letters of other scripts that stand for Latin ones in addresses.
_DOUBLES = dict(zip("аеорсухіѕјοαρν", "aeopcyxisjoapv"))


class Normal(NamedTuple):
    text: str
    #: Source offset of every character, and one more for the end; None when nothing was changed.
    origin: list[int] | None
    #: Places of numbers that were written in words.
    spoken: tuple[tuple[int, int], ...] = ()

    def back(self, start: int, end: int) -> tuple[int, int]:
        if self.origin is None:
            return start, end
        return self.origin[start], self.origin[end - 1] + 1


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _near(text: str, pattern: re.Pattern, seen: list) -> Iterator[re.Match]:
    """Matches of a pattern that begins with white space or where one of the hints begins."""
    done = 0
    for last, (length, kind) in seen:
        start = max(done, last + 1 - length)
        if kind != "digit":
            while start > done and text[start - 1].isspace():
                start -= 1
            m = pattern.match(text, start)
            if m:
                yield m
                done = m.end()


def _spelled(text: str, seen: list) -> Iterator[re.Match]:
    """Numbers in words, each looked for from a digit word."""
    done = 0
    for last, (length, kind) in seen:
        start = max(0, last + 1 - length)
        if kind != "digit" or start < done:
            continue
        start += not text[start].isalpha()
        while ahead := _BEFORE_DIGIT.search(text, max(done, start - 8), start):
            start = ahead.start()
        m = _SPELLED.match(text, start)
        if m:
            yield m
            done = m.end()


def _hinted(text: str) -> list:
    """(last place, (length, kind)) of the hints; a blank stands before the text and after it."""
    return [(last - 1, found) for last, found in hints().iter(f" {_lower(text)} ")]


def _rewrite(text: str, origin: list[int] | None, pattern, to, seen: list | None = None) -> tuple[str, list[int] | None]:
    """Replaces matches, near the hints if given; the characters of a replacement point at the match, the last one at its end."""
    out, places, at = [], [], 0
    for m in pattern if not isinstance(pattern, re.Pattern) else pattern.finditer(text) if seen is None else _near(text, pattern, seen):
        new = to(m)
        if new is None:
            continue
        if origin is None:
            origin = list(range(len(text) + 1))
        out += [text[at : m.start()], new]
        places += origin[at : m.start()]
        places += [origin[m.start()]] * (len(new) - 1) + [origin[m.end() - 1]] if new else []
        at = m.end()
    if not out:
        return text, origin
    return "".join(out) + text[at:], places + origin[at:]


def _plain(m: re.Match) -> str:
    return unicodedata.normalize("NFKC", m[0])


_WIDE = re.compile("[\uff01-\uff5e\ufb00-\ufb06\U0001d400-\U0001d7ff\u3000\u00a0\u2000-\u200a\u202f\u205f]")
_MIXED = re.compile(rf"[{''.join(_DOUBLES)}]")


def _latin(m: re.Match) -> str | None:
    around = m.string[max(0, m.start() - 12) : m.end() + 12]
    return _DOUBLES[m[0]] if re.search("[a-zA-Z]", around) and not re.search("[джи-нтфц-яβ-κ]", around) else None


def normalise(text: str) -> Normal:
    origin = None
    if not text.isascii():
        if _IGNORABLE.search(text):
            text, origin = _rewrite(text, origin, _IGNORABLE, lambda m: "")
        if _WIDE.search(text):
            text, origin = _rewrite(text, origin, _WIDE, _plain)
        if _MIXED.search(text):
            text, origin = _rewrite(text, origin, _MIXED, _latin)
    seen = _hinted(text)
    if any(kind == "sign" for _, (_, kind) in seen) or _AT_WORD.search(text):
        text, origin = _rewrite(text, origin, _AT, lambda m: "@", seen)
        seen = _hinted(text)
        text, origin = _rewrite(text, origin, _DOT, lambda m: ".", seen)
        text, origin = _rewrite(text, origin, _POINT, lambda m: "." if _IN_DOMAIN.search(m.string[max(0, m.start() - 80) : m.start()]) else None)
    spoken: list[tuple[int, int]] = []
    if sum(kind == "digit" for _, (_, kind) in seen) >= 4:
        seen, shift = _hinted(text), 0
        for m in _spelled(text, seen):
            size = len(_read_aloud(m[0]))
            spoken.append((m.start() + shift, m.start() + shift + size))
            shift += size - len(m[0])
        text, origin = _rewrite(text, origin, _spelled(text, seen), lambda m: _read_aloud(m[0]))
    return Normal(text, origin, tuple(spoken))


@cache
def hints():
    """One automaton for what normalisation looks for: digit words and disguised signs, between spaces or in brackets."""
    import ahocorasick

    found = ahocorasick.Automaton()
    keys = {}
    for word in _DIGITS:
        keys |= dict.fromkeys((f" {word} ", f"-{word} ", f" {word}-", f" {word},"), "digit")
    for opening, closing in ("()", "[]", "{}", "<>"):
        for word in "at ät arroba arobase chez klammeraffe dot punkt punto point @ .".split():
            keys |= dict.fromkeys((f"{opening}{word}{closing}", f"{opening} {word} {closing}"), "sign")
    keys |= dict.fromkeys((" dot ", " arroba ", " arobase ", " @ "), "sign") | {" at ": "at"}
    for key, kind in keys.items():
        found.add_word(key, (len(key), kind))
    found.make_automaton()
    return found


_AT_WORD = re.compile(r" at [\w-]+(?:\.\w| ?[\[({<])", re.I)

EMAIL = re.compile(r"(?<![\w.+%-])[A-Za-z0-9À-ɏ](?:[A-Za-z0-9À-ɏ._%+'-]*[A-Za-z0-9À-ɏ_+-])?@(?:[A-Za-z0-9À-ɏ](?:[A-Za-z0-9À-ɏ-]*[A-Za-z0-9À-ɏ])?\.)+[A-Za-z]{2,24}(?![\w@-])")
#: Ends of file names that look like domains.
_FILES = frozenset("png jpg jpeg gif svg webp css js json html htm xml pdf zip mp4 ico woff ttf map md txt php py ts".split())

#: Words before a number that say it is no phone and no identity.
_NOT_PERSONAL = re.compile(r"(?:\b(?:order|ticket|sku|gtin|ean|isbn|issn|build|commit|port|range|version|crawl|invoice no\.?|article|artikel|article no\.?|bestellung|commande|pedido|auftrag|référence|ref\.?|package|answer came from|ip|serial|tracking|score went from)\b[\s:#.]*|#)$", re.I)
_GAP = r"[ \u00a0.\-/]"
PHONE = re.compile(
    r"(?<![\w.+/@#-])(?:"
    # Country codes with their own grouping, then any other.
    r"(?:\+|00)1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}"
    r"|(?:\+|00)44[ .-]?(?:\(0\)[ .-]?)?(?:\d{2}[ .-]?\d{4}[ .-]?\d{4}|\d{3,4}[ .-]?\d{3}[ .-]?\d{3,4})"
    r"|(?:\+|00)33[ .-]?(?:\(0\)[ .-]?)?\d(?:[ .-]?\d{2}){4}"
    r"|(?:\+|00)34[ .-]?\d{3}(?:[ .-]?\d{3}){2}|(?:\+|00)34[ .-]?\d{3}(?:[ .-]?\d{2}){3}"
    r"|(?:\+|00)49[ .-]?(?:\(0\)[ .-]?)?(?:\d{7,11}|\d{2,4}[ ./-]?(?:\d{6,8}|\d{3,5}(?:[ -]\d{1,4})?))(?!\d)"
    r"|(?:\+|00)(?!1|33|34|44|49)[2-9]\d{0,2}[ .-]?(?:\(0\)[ .-]?)?\d{1,4}(?:[ ./-]?\d{2,8}){1,4}"
    r"|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}"
    r"|020 \d{4} \d{4}|0[1-9](?:[ .-]?\d{2}){4}"
    r"|\(0\d{2,4}\) ?\d{3,6}(?:[ -]\d{2,4})?|0\d{2,4} ?/ ?\d{3,4}(?:[ -]?\d{2,4}){1,2}|0\d{2,4}[ /-]\d{3,8}(?:[ -]\d{1,4})?"
    r"|0\d{9,10}|[2-9]\d{2}[2-9]\d{6}"
    r"|[5-9]\d{2}(?:[ .-]?\d{3}){2}|[5-9]\d{2}(?:[ .-]?\d{2}){3}"
    r")(?![\w@/-]|\.\d)"
)
ID_NUMBER = re.compile(
    r"(?<![\w.+/@#-])(?:"
    r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|[12] ?\d{2} ?(?:0[1-9]|1[0-3]|[2-9]\d) ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3}(?: ?\d{2})?"
    r"|[XYZ]-?\d{7,8}-?[A-Z]|\d{8}-?[A-Z]"
    r"|\d{2} \d{3} \d{3} \d{3}|\d{11}"
    r"|[CFGHJKLMNPRTVWXYZ][0-9CFGHJKLMNPRTVWXYZ]{0,2}\d{6,8}[0-9D]?|[A-Z]{1,2}\d{6,8}|\d{2}[A-Z]{2}\d{5}"
    r")(?![\w@/-]|\.\d)"
)
#: Passports and identity cards with letters between or before the digits, five digits in all; they count after _ID_CONTEXT only.
MIXED_ID = re.compile(
    r"(?<![\w.+/@#-])(?=(?:[A-Z]*\d){5})(?:\d{2}[A-Z]{2}\d{5}|[CFGHJKLMNPRTVWXYZ][0-9CFGHJKLMNPRTVWXYZ]{8}[0-9]?D?|[A-Z]{3}\d{6}[A-Z]?)(?![\w@/-]|\.\d)"
)
#: What announces an identity number.
_ID_WORDS = (
    "social security|passport|national insurance|insurance number|tax|identity|id shown|id number|id card|personal number|ausweis|steuer|reisepass|versicherungsnummer|sozialversicherung|kundin|kunde"
    "|sécurité sociale|numéro fiscal|passeport|carte d'identité|fiche client|documento|identidad|pasaporte|dni|nie|nif|seguridad social|ficha"
).split("|")
_ID_CONTEXT = re.compile("|".join(rf"\b{w}\b" if w in ("dni", "nie", "nif") else rf"\b{w}" if w == "id card" else w for w in _ID_WORDS), re.I)

_NUM = r"\d{1,4}(?:\s?[A-Za-z](?![A-Za-z])|\s(?:bis|ter|quater)\b)?"
_NAMEWORD = rf"(?:{_CAP}(?:{_L}|['’-])*)"
#: Words that begin the sentence after a town.
_NEXT = "The|This|These|We|If|In|On|At|For|Please|Most|Both|You|Our|Your|It|Die|Der|Das|Wir|Wenn|Bitte|Im|Bei|Für|Les|Le|La|Si|Nous|Vous|Vérifiez|Los|Las|El|En|Encontramos|Revise|Tel|Tél|My|I"
_TOWN = rf"(?:{_NAMEWORD}(?:[ -](?!(?:{_NEXT})\b){_NAMEWORD}){{0,2}})(?!\w)"
#: Words for streets.
_EN_STREET = "Street|Road|Avenue|Lane|Court|Close|Drive|Boulevard|Way|Place|Square|Terrace|Crescent|Row|Walk|Mews|Hill|Gardens|Grove|Parade|St|Rd|Ave|Ln|Ct|Dr|Blvd|Pl|Sq"
_FR_STREET = "rue|avenue|boulevard|chemin|impasse|place|allée|allées|quai|cours|route|passage|square|ruelle|sentier|faubourg"
_ES_STREET = r"Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|Camino|Carrera|Carretera|Ronda|Travesía|Callejón|Glorieta|Rambla|Vía"
_DE_END = "straße|strasse|str\\.|gasse|weg|platz|allee|ufer|damm|ring|steig|chaussee|stieg|markt|graben|wall|hof|kamp"
_DE_AHEAD = "Am|An der|An den|Im|In der|In den|Auf der|Auf dem|Zum|Zur|Unter den|Hinter der|Beim|Vor dem"
ADDRESS_EN = re.compile(
    rf"(?<![\w#/.-])\d{{1,5}}[A-Z]?(?:-\d{{1,5}})?,? (?:{_NAMEWORD} ){{1,4}}(?:{_EN_STREET})\b(?:,? (?:Apt|Apartment|Flat|Unit|Suite|Ste|#)\.? ?\w{{1,5}}\b)?"
    rf"(?:, {_TOWN}(?:,? [A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}}|,? [A-Z]{{2}} \d{{5}}(?!\d)|,? \d{{5}}(?!\d))?)?"
)
ADDRESS_FR = re.compile(
    rf"(?<![\w#/.-]){_NUM},? (?:{_FR_STREET}) (?:(?:de la|de l['’]|du|des|de|d['’]|la|le|les)\s?)?{_CAP}[\w'’-]*(?:[ -]{_NAMEWORD})*(?:,? \d{{5}} {_TOWN}|, {_TOWN})?"
)
ADDRESS_ES = re.compile(
    rf"(?<![\w/])(?:{_ES_STREET})\s?(?:(?:de la|de los|de las|del|de)\s)?{_NAMEWORD}(?: (?:(?:de la|de los|del|de|y) )?{_NAMEWORD}){{0,3}},? (?:n\.?º ?|núm\.? ?|nº ?)?\d{{1,4}}\b"
    rf"(?:, ?\d{{1,2}}\.?º(?: ?[A-Z]\b)?)?(?:, ?\d{{5}} {_TOWN}|, {_TOWN})?"
)
ADDRESS_DE = re.compile(
    rf"(?<![\w/-])(?:{_CAP}[\w'’-]*(?:{_DE_END})|(?:{_DE_AHEAD}) {_CAP}[\w'’-]+(?: {_CAP}[\w'’-]+)?|{_CAP}[\w'’-]+[ -](?:Straße|Str\.|Weg|Platz|Allee|Gasse|Ring|Ufer|Damm))"
    rf" \d{{1,4}}(?: ?[a-z]\b)?(?:(?:,| in)? \d{{5}} {_TOWN}|, {_TOWN})?"
)

_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Madam|Herr|Herrn|Frau|Mme|Mlle|Madame|Monsieur|Sr|Sra|Srta|Señor|Señora|Señorita|Don|Doña|Dña)"
_PART = rf"(?:(?:von der|von dem|von|van der|van|zu|zum|de la|de los|de las|del|de|du|des|la|le|d['\u2019]|al) )"
_F = rf"{_L}[\w'\u2019]+(?:-{_L}[\w'\u2019]+)*"
AFTER_TITLE = re.compile(rf"(?<!\w){_TITLE}\.? (?:(?:Dr|Prof)\.? )?({_CAP}[\w'\u2019-]+(?: {_CAP}\.)?(?: {_PART}?{_CAP}[\w'\u2019-]+)?|{_PART}{_CAP}[\w'\u2019-]+)")
INITIAL_FIRST = re.compile(rf"({_CAP}(?<![\w@.+'\u2019-].)\. ?(?:{_CAP}\. ?){{0,2}})((?:{_PART})?{_CAP}[\w'\u2019]+(?:-{_CAP}[\w'\u2019]+)*)(?![\w@])")
FAMILY_INITIAL = re.compile(rf"({_CAP}(?<![\w@.+'\u2019-].)[\w'\u2019]+(?:-{_CAP}[\w'\u2019]+)*), ({_CAP}\.)(?!\w)")

#: Capitalised words that are no family name: function words, roles, places, days, nouns that begin sentences.
_NO_NAME = frozenset(
    """
the this that these those and or but if in on at for please most both you our your it its we they he she my as to of by with from what when where why how all no not yes new see then there here after before
der die das den dem des ein eine und oder aber wir sie er ich wenn bitte im bei für mit von zu nach auf alle neue hier dann ist hat ihr ihre
les le la un une et ou mais si nous vous il elle ils elles dans sur pour avec par ce cette ces mon ma mes tous est ici puis
los las el una y o pero nosotros usted ustedes él ella en con por para este esta estos su sus todos aquí es
president minister speaker chairman secretary director manager professor doctor officer judge captain general universe doktor präsident präsidentin professorin ministerin minister kollege kollegin direktor direktorin kanzler
président présidente ministre directeur directrice professeur docteur docteure maire presidente ministro ministra doctora profesor profesora alcalde directora
street road avenue lane court close drive boulevard way place square park garden gardens university college school airport church hospital hotel museum station bridge river lake island county city town
straße platz allee gasse weg kirche schule klinik universität flughafen bahnhof brücke rue calle plaza avenida iglesia hospital aeropuerto église hôpital gare
monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember
page pages site team support audit report index table section chapter figure version step plan note part inc ltd gmbh sa sl llc seite seiten abschnitt tabelle kapitel
""".split()
)
#: Given names that are words as well; beside an unknown word they count only where something announces a name.
_WORD_TOO = frozenset(
    """mark max ray bob ed ned ted lily daisy hazel will rose grace frank jack iris ben kai finn leon rosa alba dolores mercedes pilar martin jean luz marc luc lutz horst heinz emil concepción paris victoria mason harper heather holly virginia
georgia aurora consuelo esperanza asunción soledad remedios rosario milagros nieves violeta gema gloria jesús ángel domingo ama young marine
lies rune lasse norma lola sakura grant""".split())
#: A word that is often followed by a person, before an initial.
_BEFORE_NAME = re.compile(r"(?:^|[\s(\"“„«])(?:by|with|from|of|to|and|or|for|asked?|told|oder|ou|o|mit|von|und|an|bei|für|par|avec|de|et|à|pour|con|por|y|a|para)\s$", re.I)
_FRENCH = re.compile(r"\b(?:le|des|du|est|une|dans|pour|avec|chez|ce|nous|vous|habite|demeure|signale|rappellera|boulevard|rue)\b")


def unknown_name(word: str, text: str) -> bool:
    """Whether a capitalised word may be a family name no list holds: no common word, nor one that the text has in small letters."""
    low = word.lower()
    if len(word) < 2 or not word[0].isupper() or low in _NO_NAME or low in GIVEN or any(c.isdigit() or c == "_" for c in word):
        return False
    return low not in text or not re.search(rf"(?<![\w.@+-]){re.escape(low)}(?![\w@+-]|\.\w)", text)


#: What stands right before a name: labels, verbs and greetings that announce a person.
_NAME_CUE = re.compile(
    r"(?:\b(?:contact (?:is|person)|spoke (?:with|to)|talked (?:with|to)|met with|owner|writer|author|reviewer|assignee|goes to|done for|ping|ask(?:ed)? for|signed(?: by)?|(?:written|reported|prepared|reviewed|checked|approved|edited|taken|sent|made|drawn up) by|on behalf of"
    r"|(?:to|could you|can you|will you|please) (?:ring|phone|call|email|tell|ask|remind|invite|thank|meet|notify|contact|see)|(?:manager|accountant|lawyer|doctor|teacher|neighbour|colleague|director|assistant|agent) (?:is|was)"
    r"|my name is|i am|i'm|this is|dear|hi|hello|attn\.?|patient|customer|client|tenant|applicant|employee"
    r"|ansprechpartner(?:in)? ist|geht an|kundin|kunde|mein name ist|ich bin|gez\.|gezeichnet|verfasst von|autor(?:in)?|liebe[r]?|patientin|mieter(?:in)?"
    r"|contact est|vu avec|va à|je m['\u2019]appelle|je suis|signé|auteur|autrice|rédigé par|cher|chère|bonjour|patiente|cliente"
    r"|contacto es|hablado con|va a|me llamo|soy|firmado|autora|escrito por|estimad[oa]|querid[oa]|hola|paciente),?"
    r"|\b(?:from|to|cc|name|contact|owner|author|customer|client|von|an|kontakt|de|à|ficha|nombre|nom|para)\"? ?[:=] ?\"?)\s*$",
    re.I,
)
#: Closing words of a letter; the line after them is a name.
_SIGN_OFF = re.compile(
    r"\b(?:regards|sincerely|yours|cheers|thanks|thank you|best|grüße|grüßen|gruß|grüssen|cordialement|salutations|merci|bien à vous|saludos|atentamente|gracias|un abrazo)\b[^\n]{0,20}[,.!]?\s*\n\s*$", re.I
)
#: What people do in the words right after their name.
_ACTS = re.compile(
    r",?\s(?:\(|has |have |had |is |was |will |hat |ist |war |wird |a |est |était |va |ha |es |está |estaba )?\s?(?:said|says|wrote|writes|asked|asks|called|calls|replied|replies|reports?|reported|lives?|lived|works?|worked|signed|joined|told|rang|moved|thinks|confirmed|confirms|phoned|sent|sends|reachable|left"
    r"|sagt|sagte|schrieb|schreibt|meldet|meldete|fragt|fragte|rief|ruft|wohnt|arbeitet|zog|bestätigt|erreichbar|berichtet|unterschrieb|besprochen|gesprochen|getroffen"
    r"|dit|écrit|signale|signalé|demande|demandé|appelle|appelé|rappellera|habite|travaille|confirme|joignable|répond|répondu|déménagé"
    r"|dice|dijo|escribió|escribe|avisa|avisó|llamó|llama|pregunta|preguntó|vive|trabaja|confirma|confirmó|respondió|firmó)\b",
    re.I,
)
_FIELD_END = re.compile(r"\s?[<(|;/]|\",")


def _announced(text: str, at: int) -> bool:
    """Whether a label, a verb of contact or a closing word stands right before a place."""
    before = text[max(0, at - 60) : at]
    return bool(_NAME_CUE.search(before) or (before.endswith("\n") and _SIGN_OFF.search(before)))


def _introduced(text: str, at: int) -> bool:
    """Whether a preposition or anything stronger stands right before a place."""
    return bool(_BEFORE_NAME.search(text[max(0, at - 24) : at])) or _announced(text, at)


def _begins(text: str, at: int) -> bool:
    """Whether a sentence, line or list field begins at a place."""
    before = text[max(0, at - 3) : at].rstrip(" \"“„«(*")
    return at == 0 or not before or (before[-1] in ".!?\n:;|>•)" or before[-1].isdigit())


def _acts(text: str, end: int) -> bool:
    return bool(_ACTS.match(text, end) or _FIELD_END.match(text, end))


_SAINT = re.compile(r"(?:\b(?:San|Santa|Saint|Sainte|Sankt|St)\.?[ -])$")
_AFTER_GIVEN = re.compile(rf"((?: {_L}\.)? (?:{_PART})?)({_F})(?![\w@])")
_SECOND_GIVEN = re.compile(rf"[- ]({_L}[\w\u2019']*)")


def _given_first(text: str, at: int, end: int) -> tuple[int, int] | None:
    """A listed given name, perhaps a second one or an initial, and a family name."""
    first = text[at:end]
    second = _SECOND_GIVEN.match(text, end)
    if second and second[1].lower() in GIVEN and text[second.start()] in "- ":
        longer = _AFTER_GIVEN.match(text, second.end())
        if longer and _belongs(text, at, first, longer):
            return at, longer.end()
    m = _AFTER_GIVEN.match(text, end)
    return (at, m.end()) if m and _belongs(text, at, first, m) else None


def _belongs(text: str, at: int, first: str, m: re.Match) -> bool:
    """Whether a word after a given name is its family name."""
    last = m[2]
    if first.isupper() and len(first) > 1:
        return last.isupper() and len(last) > 2 and last.lower() not in _NO_NAME and (first.lower() not in _WORD_TOO or _introduced(text, at) or (_begins(text, at) and _acts(text, m.end())))
    if first[0].islower():
        # Small letters all through: something must announce the person, or the person must act.
        small = last[0].islower() and len(last) > 2 and last not in _NO_NAME and last not in _SMALL
        return small and (_announced(text, at) or (_begins(text, at) or _introduced(text, at)) and _acts(text, m.end()))
    if not last[0].isupper() or last.isupper():
        return False
    if _announced(text, at):
        return last.lower() not in _NO_NAME
    if first.lower() in _WORD_TOO or _SAINT.search(text[max(0, at - 8) : at]):
        return (_introduced(text, at) or _begins(text, at)) and unknown_name(last, text) and _acts(text, m.end())
    return not last.endswith(("'s", "\u2019s")) and (last.lower() in GIVEN or unknown_name(last, text))


def _family_first(text: str, at: int, end: int) -> tuple[int, int] | None:
    """A family name and a comma before the given name at ``at``."""
    if text[max(0, at - 2) : at] != ", ":
        return None
    m = _LAST_BEFORE.search(text, max(0, at - 80), at)
    if not m:
        return None
    first, last, start = text[at:end], m[1], m.start()
    rest = re.compile(rf"(?: {_L}\.)?(?![\w@-])").match(text, end)
    if not rest:
        return None
    word = last.split(" ")[-1]
    if first.isupper() and len(first) > 1:
        fits = word.isupper() and len(word) > 2
    elif first[0].islower():
        fits = word[0].islower() and word not in _SMALL and _announced(text, start)
    else:
        fits = word[0].isupper() and not word.isupper() and unknown_name(word, text)
    double = _TWO_LASTS.search(text, max(0, at - 100), at)
    if fits and double and not _announced(text, start) and unknown_name(double[1], text) and (_begins(text, double.start()) or _announced(text, double.start())):
        start = double.start()
    settled = _announced(text, start) or _introduced(text, start) or (_begins(text, start) or start == 0) and _acts(text, rest.end()) or bool(_FIELD_END.match(text, rest.end()))
    return (start, rest.end()) if fits and settled else None


_LAST_BEFORE = re.compile(rf"(?<![\w@.+'\u2019-])((?:{_PART})?{_F}), $")
_TWO_LASTS = re.compile(rf"(?<![\w@.+'\u2019-])({_CAP}{_L}+) {_CAP}{_L}+, $")
#: Words in small letters that follow a given name and are no family name.
_SMALL = frozenset(
    """and or but who has have had is was were will would can could said says wrote asked called told lives works also not from with at in on for to
und oder aber der die das hat ist war wird kann sagt schrieb fragt meldet wohnt auch nicht von mit bei zu et ou mais qui est était sera peut dit écrit demande habite aussi pas avec chez
y o pero que es está era será puede dijo escribe avisa vive también no con en""".split()
)


def _titled(text: str, at: int) -> tuple[int, int] | None:
    """The name after a form of address."""
    m = AFTER_TITLE.match(text, at)
    if not m:
        return None
    words = m[1].split(" ")
    if re.search(r"\d[A-Z]? (?:[A-Z]\w+ ){1,3}$", text[max(0, at - 40) : at]) and text.startswith("Dr", at):
        return None  # Drive, in an address
    # In German, nouns stand in capitals behind a name too.
    clean = [re.sub(r"['\u2019]s?$|-$", "", w) for w in words]
    if not words[0][0].isupper():
        return (m.start(1), m.end(1) - len(words[-1]) + len(clean[-1])) if unknown_name(clean[-1], text) else None
    given = words[0].lower() in GIVEN
    if not given and not unknown_name(clean[0], text):
        return None
    both = len(words) > 1 and unknown_name(clean[-1], text) and clean[0] == words[0] and (given or not m[0].startswith(("Herr", "Frau")))
    if both:
        return m.start(1), m.end(1) - len(words[-1]) + len(clean[-1])
    return m.start(1), m.start(1) + len(clean[0])


_TITLES = frozenset("mr mrs ms miss mx dr prof sir madam herr herrn frau mme mlle madame monsieur sr sra srta señor señora señorita don doña dña".split())
#: A given name of no list before a family name of no list.
UNLISTED_FIRST = re.compile(rf"({_CAP}(?<![\w@.+'\u2019-].)[^\W\d_A-Z]+(?:-{_CAP}[^\W\d_A-Z]+)?) ({_CAP}[\w'\u2019]+(?:-{_CAP}[\w'\u2019]+)*)(?![\w@])")


def _initials(text: str) -> Iterator[tuple[int, int]]:
    """Initials beside a family name, on either side."""
    for m in INITIAL_FIRST.finditer(text):
        last = m[2].split(" ")[-1]
        start, end = m.span()
        if not unknown_name(last, text) and last.lower() not in GIVEN:
            continue
        if m[1].strip() == "M." and _FRENCH.search(text[max(0, start - 80) : end + 80]) and text[max(0, start - 2) : start].strip() not in (":", "=", '"') and not _SIGN_OFF.search(text[max(0, start - 60) : start]):
            yield m.span(2)  # Monsieur
        elif _introduced(text, start) or (_begins(text, start) and _acts(text, end)):
            yield start, end
    for m in FAMILY_INITIAL.finditer(text):
        if unknown_name(m[1], text) and (_introduced(text, m.start()) or _FIELD_END.match(text, m.end()) or (_begins(text, m.start()) and _acts(text, m.end()))):
            yield m.span()


def _unlisted(text: str) -> Iterator[tuple[int, int]]:
    """Two capitalised words of no list where something announces a person, or a person acts."""
    at = 0
    while m := UNLISTED_FIRST.search(text, at):
        at = m.end(1)
        if m[1].lower() in _TITLES or m[1].lower() in GIVEN or m[2].endswith(("'s", "\u2019s")) or not unknown_name(m[2], text) or not unknown_name(m[1], text):
            continue
        start, end = m.span()
        if _announced(text, start) or ((_begins(text, start) or _introduced(text, start)) and _ACTS.match(text, end)):
            yield start, end


@cache
def triggers():
    """One automaton that finds where a costly pattern is worth a try, in a lower-cased text."""
    import ahocorasick

    found = ahocorasick.Automaton()
    words: dict[str, str] = dict.fromkeys(GIVEN, "given")
    words |= dict.fromkeys("mr mrs ms miss mx dr prof sir madam herr herrn frau mme mlle madame monsieur sr sra srta señor señora señorita don doña dña".split(), "title")
    for w in _EN_STREET.lower().split("|"):
        words[f" {w}"] = "en"
    for w in _FR_STREET.split("|"):
        words[f" {w} "] = "fr"
    for w in "calle c/ avenida avda av. plaza pza paseo camino carrera carretera ronda travesía callejón glorieta rambla vía".split():
        words[w] = "es"
    for w in _DE_END.replace("\\", "").split("|"):
        words[f"{w} "] = "de"
    for w in _DE_AHEAD.lower().split("|"):
        words[f"{w} "] = "de ahead"
    words |= {" straße ": "de", " weg ": "de"}
    words |= {w: "id" for w in _ID_WORDS if w not in words}
    for word, kind in words.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def _address(pattern: re.Pattern, text: str, start: int, last: int) -> Iterator[tuple[int, int, str]]:
    """Addresses that begin between two places; an address may be as long as its pattern allows."""
    at = max(0, start)
    while at <= last and (m := pattern.search(text, at)) and m.start() <= last:
        yield m.start(), m.start() + len(m[0].rstrip(" .,")), "address"
        at = m.end()


def _words_back(text: str, at: int, words: int) -> int:
    """Where the stretch of so many words before a place begins."""
    for _ in range(words):
        at = text.rfind(" ", 0, max(0, at))
        if at < 0:
            return 0
    return at + 1


_SENTENCE = re.compile(r"[.!?]\s|\n")


def _context(text: str, at: int, least: int = 120) -> str:
    """What stands before a place: its sentence and the one before, at least so many characters."""
    start = max(0, at - least)
    if start:
        back = text.rfind("\n", 0, start) + 1
        ends = [m.end() for m in _SENTENCE.finditer(text, back, at)]
        start = min(start, ends[-2] if len(ends) > 1 else back)
    return text[start:at]


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    """Addresses, each looked for from its sign backwards."""
    at = text.find("@")
    while at >= 0:
        start = at
        while start and (text[start - 1].isalnum() or text[start - 1] in "._%+'-"):
            start -= 1
        m = None
        while start < at and not m:
            m = EMAIL.match(text, start)
            start += 1
        if m and m[0].rsplit(".", 1)[1].lower() not in _FILES:
            yield *m.span(), "email"
        at = text.find("@", at + 1)


def detect(text: str, spoken: tuple[tuple[int, int], ...] = ()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the items of a normalised text, none inside another; ``spoken`` numbers stood in words."""
    found: list[tuple[int, int, str]] = []
    names: list[tuple[int, int] | None] = []
    low = _lower(text)
    size = len(text)
    named = False
    for last, (length, kind) in triggers().iter(low):
        at, end = last + 1 - length, last + 1
        if kind == "id":
            named = True
        elif kind == "given":
            if (at and (low[at - 1].isalnum() or low[at - 1] in "@.+_-")) or (end < size and low[end].isalnum()):
                continue
            names += [_given_first(text, at, end), _family_first(text, at, end)]
        elif kind == "title":
            if (at and low[at - 1].isalnum()) or not text[at].isupper() or (end < size and low[end] not in " ."):
                continue
            names.append(_titled(text, at))
        elif kind == "en":
            if text[at + 1].isupper() and (end == size or not low[end].isalnum()):
                start = _words_back(text, at, 6)
                if any(c.isdigit() for c in text[start:at]):
                    found += _address(ADDRESS_EN, text, start, at)
        elif kind == "fr":
            if text[max(0, at - 4) : at].strip(" ,")[-1:].isalnum() and any(c.isdigit() for c in text[max(0, at - 12) : at]):
                found += _address(ADDRESS_FR, text, at - 14, at)
        elif kind == "es":
            if text[at].isupper() and (not at or not low[at - 1].isalnum()):
                found += _address(ADDRESS_ES, text, at, at)
        elif kind == "de":
            if end < size and text[end].isdigit():
                found += _address(ADDRESS_DE, text, _words_back(text, at, 4), at)
        elif text[at].isupper() and (not at or not low[at - 1].isalnum()) and end < size and text[end].isupper():
            found += _address(ADDRESS_DE, text, at, at)
    found += _emails(text)
    taken = _outermost(found)
    done = 0
    for run in _NUMBER_RUN.finditer(text):
        start, end = max(done, run.start() - 5), min(size, run.end() + 12)
        for pattern, kind in ((ID_NUMBER, "id_number"), (PHONE, "phone")):
            for m in pattern.finditer(text, start, end):
                if _free(m.span(), taken) and not _NOT_PERSONAL.search(text[max(0, m.start() - 24) : m.start()]):
                    if kind == "phone" or _likely_id(text, m):
                        taken.append((*m.span(), kind))
    for m in MIXED_ID.finditer(text) if named else ():
        before = text[max(0, m.start() - 24) : m.start()]
        if _free(m.span(), taken) and not _NOT_PERSONAL.search(before) and _ID_CONTEXT.search(_context(text, m.start())):
            taken.append((*m.span(), "id_number"))
    for a, b in spoken:
        if 7 <= b - a <= 16 and _free((a, b), taken) and not _NOT_PERSONAL.search(text[max(0, a - 24) : a]):
            taken.append((a, b, "id_number" if b - a >= 8 and _ID_CONTEXT.search(text[max(0, a - 60) : a]) else "phone"))
    if _INITIAL.search(text):
        names += _initials(text)
    names += _unlisted(text)
    # A name that follows a town without a stop ends the address.
    for n in filter(None, names):
        taken = [
            (a, a + len(text[a : n[0]].rstrip(" ,.")), kind) if kind == "address" and a < text.rfind(",", a, n[0]) < n[0] < b and text[n[0] - 1] == " " and text[n[0] - 2] != "," else (a, b, kind)
            for a, b, kind in taken
        ]
    found = [(*n, "name") for n in names if n and _free(n, taken)]
    return _outermost(taken + found)


_NUMBER_RUN = re.compile(r"\d(?:[ .()/-]{0,3}\d){5,}")
_INITIAL = re.compile(rf"\b{_CAP}\. ?{_CAP}|, {_CAP}\.")


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


_SURE_ID = re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[XYZ]-?\d{7,8}-?[A-Z]|\d{8}-?[A-Z]|\d{2} \d{3} \d{3} \d{3}")


#: What announces a phone number.
_PHONE_CUE = re.compile(r"(?:\b(?:tel|tél|téléphone|phone|mobile|cell|fax|call|ring|whatsapp|telefon|handy|mobil|rückruf|anruf|appel|portable|teléfono|móvil|llamar?|llame)\b)[^\d\n]{0,16}$", re.I)


def _likely_id(text: str, m: re.Match) -> bool:
    if _PHONE_CUE.search(text[max(0, m.start() - 40) : m.start()]) and m[0].isdigit():
        return False
    if _SURE_ID.fullmatch(m[0]) or (_digits(m[0]) in (13, 15) and m[0][0] in "12"):
        return True
    return bool(_ID_CONTEXT.search(_context(text, m.start())))


def _free(span: tuple, taken: list[tuple[int, int, str]]) -> bool:
    return all(span[1] <= a or span[0] >= b for a, b, _ in taken)


def _outermost(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Items in order; of overlapping ones the longer stays, the earlier on a tie."""
    kept: list[tuple[int, int, str]] = []
    for item in sorted(set(found), key=lambda f: (f[0] - f[1], f[0])):
        if _free(item[:2], kept):
            kept.append(item)
    return sorted(kept)


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points of the source text; null and empty texts hold nothing."""
    if not text:
        return []
    normal = normalise(text)
    return [(*normal.back(a, b), kind) for a, b, kind in detect(normal.text, normal.spoken)]


def redact(text: str | None) -> str | None:
    """The text with a typed placeholder for each item, otherwise unchanged."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find(text):
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join(out) + text[at:]


def personal_found(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, start_pos) of every item; rows without doc_id or text have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, starts = [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for start, _, kind in find(text):
                    ids.append(doc)
                    kinds.append(kind)
                    starts.append(start)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(starts, pa.int32())], names=["doc_id", "kind", "start_pos"])

    source = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return source.mapInArrow(run, "doc_id bigint, kind string, start_pos int").distinct()


def redacted(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with placeholders; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([redact(t) for t in b.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), texts], names=["doc_id", "text"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text string")
