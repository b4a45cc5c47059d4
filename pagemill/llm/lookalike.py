"""One consistent form for texts that look alike.

Per text: invisible characters are deleted and every space becomes U+0020, forms that only repeat an ordinary
character (full-width, ligatures, styled letters) are replaced by it, accents are composed, and each word that holds
letters with a Latin double is searched as a lattice: at every place the letter itself or its double.  Viterbi takes
the path of the best character bigram score, where a bigram is scored inside one script only and leaving a script costs
a penalty; the scripts of the other words of the text are the prior.  A word of another script that holds a letter
without a Latin double, and no Latin one, is truly of that script and stays.

Bigrams are counted over all texts, over different words and only over such as prove their script: a word made of
look-alikes alone is no evidence, however often it stands, so spoofed words cannot vouch for themselves.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters with a Latin double, and the double below each.
_CYRILLIC = "АВЕЅІЈКМНОРСТХҮУԌԚԜаеѕіјорсхуүһԁԛԝӏкмтнвгп"
_CYR_LATIN = "ABESIJKMHOPCTXYYGQWaesijopcxyyhdqwlkmthbrn"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαβγεικνορτυχωη"
_GRE_LATIN = "ABEZHIKMNOPTYXabyeikvoptuxwn"
_ARMENIAN, _ARM_LATIN = "ՍՏՕօոսհցզ", "USOonuhgq"
_RARE_CYRILLIC, _RARE_CYR_LATIN = "ѠѡѴѵӀҽҺԌ", "WwVvIehG"
_CHEROKEE, _CHE_LATIN = "ᎪᏴᏟᎠᎬᏀᎻᎥᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHiJKLMPRSTVWZ"
_LISU, _LIS_LATIN = "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"
_PHONETIC, _PHO_LATIN = "ɑɡɩᴀʙᴄᴅᴇɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "agiabcdeghijklmnoprstuvwyz"
#: Letters that are only like their double: beside Latin letters they stand for it, but a word without any is of their script.
_ONLY_LIKE = frozenset("кмтнвгпһβγεκητχωҽ")
#: Letters that look the same even alone; other doubles standing alone are signs of their own (α, β).
_SAME_ALONE = frozenset("АВЕЅІЈКМНОРСТХаеѕіјорсухΑΒΕΖΗΙΚΜΝΟΡΤΥΧο" + _CHEROKEE + _LISU + _PHONETIC)


def _doubles() -> dict[str, str]:
    rows = (
        (_CYRILLIC, _CYR_LATIN), (_GREEK, _GRE_LATIN), (_ARMENIAN, _ARM_LATIN), (_RARE_CYRILLIC, _RARE_CYR_LATIN), (_CHEROKEE, _CHE_LATIN), (_LISU, _LIS_LATIN), (_PHONETIC, _PHO_LATIN),
    )
    return {letter: latin for letters, doubles in rows for letter, latin in zip(letters, doubles, strict=True)}


DOUBLES = _doubles()
#: Letters counted per script; their number bounds the bigram table (under 50,000 rows at any input size).
SCRIPTS = {"latin": "a-zß-öø-ÿā-ſ", "cyrillic": "а-џ", "greek": "ά-ώ"}
SWITCH = -9.0
#: What the scripts of the words around, nearer ones more, weigh against the word's own pairs.
CONTEXT = 3.0

_SPACES = {c: " " for c in map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x2800))}
_IGNORABLE = {
    *map(chr, (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x3164, 0xFEFF, 0xFFA0)),
    *map(chr, range(0x200B, 0x2010)), *map(chr, range(0x202A, 0x202F)), *map(chr, range(0x2060, 0x2070)),
    *map(chr, range(0xFE00, 0xFE10)), *map(chr, range(0xE0000, 0xE0080)), *map(chr, range(0xE0100, 0xE01F0)),
    *(c for c in map(chr, (*range(0x20), *range(0x7F, 0xA0))) if c not in "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85"),
}
_JOINED = re.compile("[\u0600-\u08ff\u0900-\u0dff\u0f00-\u109f\u1780-\u18af]")
_RTL = re.compile("[\u0590-\u08ff\ufb1d-\ufdff\ufe70-\ufefc]")
_BIDI = {*map(chr, (0x200E, 0x200F, 0x61C)), *map(chr, range(0x202A, 0x202F)), *map(chr, range(0x2066, 0x206A))}
_COMPAT = re.compile("[\uff01-\uffee\ufb00-\ufb17\u0132\u0133\u0149\u01c4-\u01cc\u01f1-\u01f3\u2160-\u217f\U0001d400-\U0001d7ff\u212a\u212b]")
#: A superset of the texts that may change: any character outside plain and typographic Latin.
SUSPECT = (
    r"[^\t\n\x0B\f\r\x20-\x7E\u00a1-\u00ac\u00ae-\u0131\u0134-\u0148\u014a-\u01c3\u01cd-\u01f0\u01f4-\u02ff"
    r"\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u22ff]"
)


def _pictogram(c: str) -> bool:
    return c >= "\U0001f000" or "\u2190" <= c <= "\u2bff" or c in "#*0123456789\u00a9\u00ae\u203c\u2049\u2122\u2139\u3030\u303d\u3297\u3299\u20e3\ufe0f"


def _visible(text: str) -> str:
    """Without ignorable characters; those that emoji or joining scripts need stay."""
    out: list[str] = []
    rtl = None
    for i, c in enumerate(text):
        if c in _SPACES:
            out.append(" ")
            continue
        if c in _IGNORABLE:
            before, after = out[-1] if out else "", text[i + 1 : i + 2]
            emoji = before != "" and (before >= "\U0001f000" or _pictogram(before)) and before not in "#*0123456789"
            if c == "\u200d":
                keep = (emoji and after != "" and _pictogram(after)) or bool(_JOINED.match(before) and _JOINED.match(after))
            elif c == "\u200c":
                keep = bool(_JOINED.match(before) and _JOINED.match(after))
            elif "\ufe00" <= c <= "\ufe0f":
                keep = (emoji and c in "\ufe0e\ufe0f") or (before in "#*0123456789" and before != "" and after == "\u20e3")
            elif "\U000e0020" <= c <= "\U000e007f":
                keep = before == "\U0001f3f4" or "\U000e0020" <= before <= "\U000e007e"
            elif c in _BIDI:
                rtl = bool(_RTL.search(text)) if rtl is None else rtl
                keep = rtl
            else:
                keep = False
            if not keep:
                continue
        out.append(c)
    return "".join(out)


def _composed(text: str) -> str:
    if unicodedata.is_normalized("NFC", text):
        return text
    return "\u2126".join(unicodedata.normalize("NFC", part) for part in text.split("\u2126"))


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o <= 0x1EFF:
        return "latin" if c.isalpha() else ""
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return "greek"
    if 0x400 <= o <= 0x52F:
        return "cyrillic"
    return "other" if c.isalpha() else ""


class Bigrams:
    """Log scores of letter pairs inside one script, '^' being the start of a word.

    A pair never seen scores by how often its first letter was: a script of which little is known is not ruled out.
    """

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.rows: Counter = Counter()
        for (script, pair), n in counts.items():
            self.rows[script, pair[0]] += n
        self.counts = counts

    def __call__(self, script: str, a: str, b: str) -> float:
        return math.log((self.counts.get((script, a + b), 0) + 0.5) / (self.rows[script, a] + 20))


def decode(word: str, score: Bigrams, prior: dict[str, float]) -> str:
    """The best path through the word's lattice."""
    states: list[tuple[float, str, str, str]] = [(0.0, "", "^", "")]  # score, script, last letter folded, spelling
    for c in word:
        choices = [c, DOUBLES[c]] if c in DOUBLES else [c]
        ahead: dict[tuple[str, str], tuple[float, str, str, str]] = {}
        for total, script, last, spelt in states:
            for x in choices:
                own = _script(x)
                low = x.lower()
                if not own:
                    step, now, low = 0.0, script, last
                elif not script:
                    step, now = score(own, "^", low) + prior.get(own, math.log(0.02)), own
                elif own == script:
                    step, now = score(own, last, low), own
                else:
                    step, now = SWITCH + score(own, "^", low), own
                found = (total + step, now, low, spelt + x)
                if (now, low) not in ahead or ahead[now, low][0] < found[0]:
                    ahead[now, low] = found
        states = list(ahead.values())
    return max(states, key=lambda s: (s[0], s[3] == word))[3]


_WORD = re.compile(r"[^\W_][\w\u0300-\u036f]*")


def _proves(c: str) -> bool:
    """Whether a letter cannot be taken for a Latin one."""
    return (c not in DOUBLES or c in _ONLY_LIKE) and _script(c) not in ("", "latin")


def _lattice(text: str, score: Bigrams) -> str:
    if not any(c in DOUBLES for c in text):
        return text
    words = list(_WORD.finditer(text))
    votes = [Counter(filter(None, map(_script, m[0]))) for m in words]
    # The script a word proves: all of its letters, one of them without a Latin double if it isn't Latin.
    pure = [next(iter(v)) if len(v) == 1 and ("latin" in v or any(_proves(c) for c in m[0])) else "" for m, v in zip(words, votes)]
    out, at = [], 0
    for i, m in enumerate(words):
        scripts = votes[i]
        if "latin" not in scripts and any(map(_proves, m[0])):
            continue  # truly of another script
        if any(c in DOUBLES for c in m[0]) and (len(scripts) > 1 or len(m[0]) > 1 or m[0] in _SAME_ALONE):
            around = Counter()
            for j, s in enumerate(pure):
                if j != i and s:
                    around[s] += 1 / abs(j - i)
            n = sum(around.values())
            prior = {s: CONTEXT * math.log((around[s] + 0.2) / (n + 0.8)) for s in ("latin", "cyrillic", "greek", "other")}
            out += [text[at : m.start()], decode(m[0], score, prior)]
            at = m.end()
    return "".join(out) + text[at:]


def canonical(text: str | None, score: Bigrams) -> str | None:
    """The consistent form of a text; None stays None, '' stays ''."""
    if not text:
        return text
    seen = _visible(text)
    seen = _COMPAT.sub(lambda m: unicodedata.normalize("NFKC", m[0]), seen)
    return _lattice(_composed(seen), score)


def fields(pages: DataFrame) -> DataFrame:
    """(page_id, field_name, pos, text) of every title and h1; null texts and null page_ids are left out."""
    title = F.array(F.struct(F.lit("title").alias("field_name"), F.lit(0).alias("pos"), F.col("title").alias("text")))
    h1s = F.transform(
        F.coalesce(F.col("h1s"), F.array().cast("array<string>")),
        lambda t, i: F.struct(F.lit("h1").alias("field_name"), i.alias("pos"), t.alias("text")),
    )
    return (
        pages.where("page_id is not null")
        .select("page_id", F.explode(F.concat(title, h1s)).alias("f"))
        .select("page_id", "f.field_name", "f.pos", "f.text")
        .where("text is not null")
    )


def bigrams(texts: DataFrame) -> Bigrams:
    """Counts of letter pairs over all different words of all texts that prove to be of one script.

    A word of another script than Latin proves it by a letter without a Latin double.  Words are combined before the
    shuffle; what reaches the driver is bounded by the alphabets in SCRIPTS.
    """
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("w"))
    words = words.distinct().withColumn("n", F.lit(1))
    low = "".join(sorted({c.lower() for c in DOUBLES} - _ONLY_LIKE))
    script = F.coalesce(*[F.when(F.col("w").rlike(f"^[{letters}]+$") & F.col("w").rlike(f"[^{low}]"), F.lit(s)) for s, letters in SCRIPTS.items()])
    marked = F.concat(F.lit("^"), F.col("w"))
    pairs = (
        words.select(script.alias("script"), "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring(marked, i, F.lit(2)))).alias("pair"))
        .where("script is not null")
        .groupBy("script", "pair")
        .agg(F.sum("n").alias("n"))
    )
    return Bigrams({(r.script, r.pair): r.n for r in pairs.collect()})


def canonical_fields(pages: DataFrame) -> DataFrame:
    """(page_id, field_name, pos, text, canonical): every text with its consistent form.

    Only texts with a character outside plain and typographic Latin leave the JVM; the others are their own form.
    """
    texts = fields(pages)
    score = bigrams(texts)

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["canonical"] = [canonical(t, score) for t in b["text"]]
            yield b

    schema = "page_id bigint, field_name string, pos int, text string, canonical string"
    suspect = F.col("text").rlike(SUSPECT)
    return texts.where(suspect).mapInPandas(convert, schema).unionByName(texts.where(~suspect).withColumn("canonical", F.col("text")))


def lookalike_found(pages: DataFrame) -> DataFrame:
    """(page_id, field_name, pos) of texts that differ from their consistent form; repeated rows count once."""
    return canonical_fields(pages).where("canonical <> text").select("page_id", "field_name", "pos").distinct()
