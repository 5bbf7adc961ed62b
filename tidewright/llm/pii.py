"""Personal information in free text: where it stands, and the same text with typed placeholders (problem 3).

Method: format-preserving Feistel pseudonyms. A number is brought to its plain value (no separators, no letter case, of a telephone number the digits
behind the country code), the value is permuted under a key within its format, and the result is laid into the writing it came in: so equal values
have equal pseudonyms in all documents and all writings, and different values different ones. Identity numbers with a check digit or letter are
verified, and valid ones become valid ones. Announced dates of birth are permuted among the days of two centuries. Mail addresses, street addresses
and names have no fixed format and get a keyed token.

Most is decided within one text, in one pass over the rows. What a text leaves open - two capitalized words that may be a name - the corpus decides:
a family or given name that some text shows for certain counts everywhere.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewright.session import materialize

TYPES = ("email", "address", "id_number", "phone", "name")  # where two would overlap, the earlier type wins

# ---------------------------------------------------------------- mail addresses
_DOMAIN = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_LOCAL = r"[A-Za-z0-9À-ÿ](?:[A-Za-z0-9À-ÿ._%+\-]*[A-Za-z0-9À-ÿ_+\-])?"
_AT = r"(?:@|\s@\s|\s?[\[({]\s?(?:at|AT|At|@)\s?[\])}]\s?|\sAT\s)"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT|Dot|\.)\s?[\])}]\s?|\sDOT\s)"
EMAIL = re.compile(rf"(?<![A-Za-z0-9À-ÿ._%+\-@/])(?:mailto:)?({_LOCAL}){_AT}({_DOMAIN}(?:{_DOT}{_DOMAIN})*{_DOT}([A-Za-z]{{2,24}}))(?![A-Za-z0-9@])")
SPELLED = re.compile(rf"(?<![A-Za-z0-9À-ÿ._%+\-@/])({_LOCAL})\s(?:at|arroba|chez)\s({_DOMAIN}(?:\s(?:dot|punkt|punto|point)\s{_DOMAIN})*\s(?:dot|punkt|punto|point)\s([A-Za-z]{{2,24}}))(?![A-Za-z0-9@])", re.I)
FILE_ENDING = frozenset("png jpg jpeg gif svg webp avif ico bmp tiff mp4 webm mp3 wav css js mjs ts tsx jsx json xml yml yaml toml md txt html htm php py rb go rs java jar zip gz tgz tar pdf csv log lock sh exe dll woff ttf".split())

# ---------------------------------------------------------------- identity numbers
_IDS = [
    r"(?<![\w.\-/])(?!000|666)\d{3}-\d{2}-\d{4}(?![\w/]|-\d|\.\d)",
    r"(?<![\w.\-/])\d{4}-\d{6}-\d(?![\w/]|-\d|\.\d)",
    r"(?<![\w\-])[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d](?![\w])",
    r"(?<![\w.\-/])\d{8}-?[A-Za-z](?!\w)",
    r"(?<![\w.\-/])[XYZxyz]-?\d{7,8}-?[A-Za-z](?!\w)",
    r"(?<![\w.\-/])[A-Za-z]{1,2}\d{6,9}(?![\w\-@]|\.\w)",
    r"(?<![\w.,\-/])[12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?\d{2} ?\d{3} ?\d{3} ?\d{2}(?![\w]|-\d)",
]
ID_SHAPES = re.compile("|".join(_IDS))
ANNOUNCED = re.compile(
    r"(?:\bSSN|social[ -]security(?:[ -](?:number|no\.?|#))?|sozialversicherungs(?:nummer|-?nr\.?)|n[uú]mero de la seguridad social|num[eé]ro de s[eé]curit[eé] sociale|"
    r"\bNIR\b|steuer-?(?:id(?:-?nr\.?)?|identifikationsnummer|nummer)|national (?:id|identity|insurance)(?: (?:card|number|no\.?))?|\bNI (?:number|no\.?)|\bNINO|"
    r"(?:identity|id) (?:card|number|no\.?)|passport(?: (?:number|no\.?|#))?|reisepass(?:-?nr\.?|nummer)?|pasaporte(?: n[uú]m\.?)?|passeport(?: n[o°]\.?)?|"
    r"personalausweis(?:-?nr\.?|nummer)?|ausweis(?:-?nr\.?|nummer)|driv(?:ing|er'?s?) licen[cs]e(?: (?:number|no\.?))?|f[uü]hrerschein(?:nummer|-?nr\.?)?|"
    r"\bDNI|\bNIE|\bNIF|\bCURP|tax (?:id|number)|\bTIN|\bITIN)\s*(?:is|was|:|=|#|n[o°º]\.?|nr\.?)?\s*:?\s*"
    r"([A-Za-z]{0,3}[ \-]?\d(?:[ .\-]?\d){5,14}(?:[ \-]?[A-Za-z](?![A-Za-z0-9]))?)", re.I)
#: A letter before the digits alone tells nothing without its announcement.
PLAIN_LETTERS = re.compile(r"^[A-Za-z]{1,2}\d{6,9}$")
#: Words before a number that make it something else.
NOT_PERSONAL = re.compile(
    r"(?:\b(?:order|invoice|sku|isbn|issn|ean|epoch|build|version|section|ticket|part|model|serial|batch|commit|port|page|rfc|cve|case|bestell\w*|rechnung\w*|"
    r"pedido|factura|commande|facture|tracking|ref(?:erence)?|log says|doi|asin|upc|vat|iban)\b[ .:#]*(?:(?:no|nr|number|num|id)\b[ .:#]*)?)$", re.I)

# ---------------------------------------------------------------- telephone numbers
_PHONES = [
    r"\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}",
    r"\+33 ?(?:\(0\) ?)?\d(?:[ .\-]?\d{2}){4}",
    r"\+34 ?\d{3} ?\d{3} ?\d{3}",
    r"(?:\+|\b00)(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2\d\d|3[578]\d|42\d|5\d\d|8[58]\d|9[679]\d)(?:[ ./\-]{0,2}\(?\d{1,5}\)?){2,7}",
    r"\+\d{8,15}",
    r"\(\d{3}\) ?\d{3}[ .\-]\d{4}",
    r"(?:1[ .\-])?\d{3}([.\- ])\d{3}\1\d{4}",
    r"0\d(?:[ .]\d{2}){4}",
    r"(?:\(0\d{2,5}\)|0\d{2,5})[ /\-]\d{3,8}(?:[ \-]\d{2,6}){0,2}",
    r"(?:6|7|9)\d{2} \d{3} \d{3}|(?:6|7|9)\d{2}(?: \d{2}){3}",
    r"[2-9]\d{2}-\d{4}",
]
PHONES = [re.compile(r"(?<![\w.,\-/+#$€£@:=%])(?:" + p + r")(?![\w%€$£]|[.,\-/]\d|[@:]\d)") for p in _PHONES]

# ---------------------------------------------------------------- street addresses
_TYPE_EN = r"(?:Street|St|Road|Rd|Avenue|Ave|Av|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Close|Crescent|Cres|Mews|Row|Gardens|Gdns|Hill|Way|Terrace|Ter|Place|Pl|Square|Sq|Walk|Grove|Parade|Circle|Cir|Highway|Hwy|Parkway|Pkwy|Trail|Rise|Quay|Wharf|Vale|Green|Loop|Alley)"
_CAP = r"(?:[A-ZÀ-Þ][\w'’\-]*|\d{1,3}(?:st|nd|rd|th))"
_UNIT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Ste|Room|Floor)\.? ?#?\w{1,5}, ?|#\d{1,4},? )?"
_EN = rf"{_UNIT}\d{{1,5}}[A-Za-z]?(?:-\d{{1,5}})?,? (?:[NSEW]\.? )?(?:{_CAP} ){{1,3}}{_TYPE_EN}\b"
# Without capitals: a street's type that is hardly anything else, after a word that leads to a place or before what ends an address.
_TYPE_LOW = r"(?:street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|drive|dr|court|ct|close|crescent|mews|row|gardens|way|terrace|place|square|walk|grove|hill|parkway|highway|quay|wharf)"
_LOW = rf"{_UNIT}\d{{1,5}}[a-z]? (?:[^\W\d_][\w'’\-]* ){{1,2}}{_TYPE_LOW}\b"
_LED = re.compile(r"\b(?:at|to|in|on|from) $", re.I)
_ENDED = re.compile(r"\.?(?: ?#\d|,? (?:apt|flat|unit|suite)\b|, [^\W\d_]{3,}|[.;!?]?(?:\s*$|\n))", re.I)
_FR = r"\d{1,4}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|all[ée]e|quai|cours|route|square|passage|sentier|villa)\s(?:(?:de|du|des|la|le|les|d['’]|l['’]|à|aux|et)\s?){0,3}[\w'’\-]+"
_ES = r"(?:(?:Calle|C/|Cl\.|Avenida|Avda\.?|Av\.|Plaza|Pza\.|Paseo|Camino|Carretera|Ronda|Traves[ií]a|Pasaje)\s?(?:(?:de|del|la|las|los|el)\s){0,3}[\w'’\-]+(?:\s(?:(?:de|del|la|las|los|el|y)\s){0,2}[\w'’\-]+){0,3}?,?\s(?:n\.?[ºo°]\s?)?\d{1,4}\b)"
_DE = r"[^\W\d_][\w\-]{2,}(?:stra(?:ß|ss)e|str\.|weg|allee|gasse|platz|damm|ufer|steig|pfad|chaussee|promenade)\s\d{1,4}(?:\s?[a-z])?\b"
_DE_CAP = r"(?:[A-ZÄÖÜ][\w\-]+\s(?:Stra(?:ß|ss)e|Str\.|Weg|Allee|Gasse|Platz|Damm|Ufer|Ring|Markt)|(?:Am|An der|Auf dem|Im|Zum|Zur|Unter den)\s[A-ZÄÖÜ][\w\-]+)\s\d{1,4}(?:\s?[a-z])?(?=,\s\d{5})"
_BOX = r"(?:P\.? ?O\.? ?Box|Postfach|Apartado(?: de Correos)?|B\.?P\.)\s\d{1,6}"
#: Patterns of streets, with the words one of which a text has where the pattern can match; looking for them first is many times faster.
STREETS = [(re.compile(r"(?<![\w.\-/#])(?:" + p + r")", f), hints) for p, f, hints in (
    (_EN, 0, ()), (_LOW, re.I, ()), (_FR, re.I, ()),
    (_ES, re.I, ("calle", "c/", "cl.", "avenida", "avda", "av.", "plaza", "pza", "paseo", "camino", "carretera", "ronda", "traves", "pasaje")),
    (_DE, re.I, ("straße", "strasse", "str.", "weg", "allee", "gasse", "platz", "damm", "ufer", "steig", "pfad", "chaussee", "promenade")),
    (_DE_CAP, 0, ("straße", "strasse", "str.", "weg", "allee", "platz", "damm", "ufer", "ring", "markt", "gasse", "am ", "an der", "auf dem", "im ", "zum", "zur", "unter den")),
    (_BOX, re.I, ("box", "postfach", "apartado", "bp", "b.p")),
)]
_PLACE_CODE = re.compile(r",\s\d{5}")
#: What may follow a street: unit, floor, postcode and town, state.
TAIL = re.compile(
    r"\.?(?:,? ?(?:#\s?\d{1,4}|(?:Apt|Apartment|Unit|Suite|Ste|Flat|Floor|Room|Esc\.|Piso|Wohnung|Bat\.|Bât\.)\.? ?#?\w{1,5}|\d{1,2}\.?[ºª°o]\.? ?[A-Za-z]?\b))?"
    r"(?:,? \d{4,5}(?:-\d{4})? [A-ZÀ-Þa-zà-þ][\w'’\-]+|, [A-ZÀ-Þ][\w'’\-]+(?: [A-ZÀ-Þ][\w'’\-]+)?(?:,? [A-Z]{2}(?: \d{5}(?:-\d{4})?)?\b(?! [a-z])|,? [A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2})?)?"
    r"(?:,? [A-Z]{2} \d{5}|,? [A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}\b)?", re.I)
#: What a capitalized word before a type can be without being a street.
NOT_STREET = re.compile(r"(?:^|\s)(?:view|records?|map|units?|smart|the|of|in|on|per|a|an|and|or|to|for|new|old|main menu)$", re.I)

# ---------------------------------------------------------------- names
STOP = frozenset(
    """the a an is are was were be been being am do does did has have had can could will would shall should may might must why how what when where who whom which whose whether
    if and or nor but so yet for to of in on at by with without within from into onto over under after before between among against about above below since until till than then that this
    these those it its he she they we you i my your his her our their me him them us not no yes as even also only just once please ask call text ring copy mail email contact thanks
    thank cc bcc dear hi hello hey best regards cheers said says asked according because although though however while during per via plus minus like unlike near every each any all some
    many most few both either neither other another such same old new more less very too again here there now today yesterday tomorrow monday tuesday wednesday thursday friday saturday sunday
    january february march april june july august september october november december looking use using see note let let's version build
    mr mrs ms miss mx dr prof professor sir madam lord lady mme mlle m herr frau fräulein señor señora sr sra srta don doña ing lic hr fr
    le la les un une des du de et ou où mais donc ni car que qui quoi dont est sont était ont avec sans sous sur dans par pour chez entre vers depuis avant après
    der die das ein eine einer eines einem einen und oder aber denn dass wenn als wie was wer wo ist sind war waren hat haben mit ohne von vom zu zum zur bei beim nach vor über unter für gegen durch
    el los las uno una unos unas y o u pero porque como cuando donde quien es son era fue han con sin sobre bajo entre hacia desde hasta para por según del al
    nous vous ils elles wir ihr sie er es man nosotros ellos ellas their old our office system data page site team plan user users version release company corp inc ltd gmbh""".split()
)
#: What follows a name of a product or a company, or is its second word.
COMPANY = re.compile(
    r"^,? (?:Corp|Inc|Ltd|LLC|GmbH|AG|SA|SL|SARL|PLC|Co|Group|Labs?|Cloud|Software|Systems|Insights|Studio|Router|Gateway|Archive|Hotel|University|Analytics|Suite|Platform|Engine|Server|Hub|Desk|Pro|Plus|"
    r"Tools?|Apps?|API|Search|Bot|Watch|Monitor|Tracker|Index|Media|Press|Bank|Foundation|Institute|Museum|School|College|Academy|Agency|Partners|Solutions|Technologies|Services|Network|Networks)\b", re.I)
#: Capitalized words after a given name, or a word that is one as well, that make it a product, a place or a sentence.
NOT_FAMILY = frozenset(
    """archive down period visited up out off list collect setting settings mode plan plans account app api button page pages menu panel dashboard report reports release update upgrade trial
    edition suite tool tools server service services platform network project team company bank store shop hotel market media news magazine press award awards prize
    street road avenue lane drive square park airport station city town county river lake island bay beach bridge hill valley university college school hospital church museum""".split()
)
#: Given names that are common words as well: alone they prove nothing about the word behind them.
COMMON_GIVEN = frozenset(
    """will mark grace hope may june april august rose lily ivy daisy violet faith joy dawn eve iris jade amber crystal summer autumn art bill bob chase chuck cliff dale dean drew earl frank gene
    grant guy harry jack jean josh lance lane max miles nick norm pat penny pierce ray reed rich rob robin rusty sandy skip sky sue ted tom victor wade ward stone belle claire merci soledad mercedes
    dolores consuelo pilar paz luz esperanza concepción ernst wolf rainer""".split()
)
_PARTS = r"(?:(?:van|von|de|der|den|la|del|di|da|le|du|ten|ter) ){0,3}"
_WORD = r"[^\W\d_]+(?:-[^\W\d_]+)?"
#: A capitalized word, the next word of a name, an initial, a word in lower case.
_UPPER = "A-ZÀ-ÖØ-ÞŠŽŁŚŻČĆŘŞİ"
CAPITAL = re.compile(rf"(?<![\w@.+\-/’'])([{_UPPER}][^\W\d_]+(?:-[^\W\d_]+)?)(?= (?:[^\W\d_]\. ?)?{_PARTS}[{_UPPER}]|, ?[{_UPPER}])")
REST = re.compile(rf" ?(?:[^\W\d_]\. ?)?{_PARTS}((?:[A-ZÀ-Þ]['’])?[A-ZÀ-ÖØ-ÞŠŽŁŚŻČĆŘŞİ][^\W\d_]+(?:-[A-ZÀ-Þ][^\W\d_]+)?)(?![\w@+]|[.\-_]\w|['’](?!s\b)\w)")
INITIALS = re.compile(r"(?<![\w@.+\-/’'])([A-ZÀ-ÖØ-Þ])\. ?(?:[A-ZÀ-ÖØ-Þ]\. ?)?(?=[A-ZÀ-Þ])")
TURNED = re.compile(rf", ?(?:({_WORD})(?: [A-Z]\.)?|([A-ZÀ-Þ])\.)(?![\w@]|[.\-]\w)")
LOWER = re.compile(rf"(?<![\w@.+\-/’'])([^\W\d_]{{3,}}(?:-[^\W\d_]+)?) (?:[^\W\d_]\. ?)?{_PARTS}([^\W\d_]{{3,}}(?:-[^\W\d_]+)?)(?![\w@+]|[.\-_]\w|['’](?!s\b)\w)")
#: Titles, and words that lead to a name or follow one.
TITLE = re.compile(r"(?<!\w)(?:mr|mrs|ms|mx|dr|prof|professor|sir|lady|herr|frau|mme|mlle|monsieur|madame|señor|señora|sr|sra|srta|don|doña)\.? $", re.I)
_CUE = (
    r"(?:by|cc|bcc|dear|hi|hello|hey|attn|signed|thanks|thank you|cheers|merci|gracias|danke|regards|sincerely|yours|grüße|saludos|cordialement|called|named|name is|i am|i['’]m|ich bin|je suis|soy|heiße|"
    r"me llamo|je m['’]appelle|according to|laut|selon|según|ask(?: for)?|(?:talked|spoke|speak|talk|write|wrote|reply|replied) (?:to|with)|met|interviewed|it was|as|contact|author|von|par|por)[,:]?\s+"
)
CUE = re.compile(rf"(?<!\w){_CUE}$", re.I)
#: A line of its own, as under a letter.
LINE_START, LINE_END = re.compile(r"(?:^|\n)[>*\- ]*(?:[—–-]\s*)?$"), re.compile(r"\s*(?:\n|$)")
#: The same words as texts, to be looked for in lower case.
CUES = (
    "by cc bcc dear hi hello hey attn signed thanks cheers merci gracias danke regards sincerely yours grüße saludos cordialement called named laut selon según ask met interviewed as contact author von par por heiße soy".split()
    + ["thank you", "name is", "i am", "i'm", "i’m", "ich bin", "je suis", "me llamo", "je m'appelle", "je m’appelle", "according to", "ask for", "it was"] + [f"{v} {w}" for v in ("talked", "spoke", "speak", "talk", "write", "wrote", "reply", "replied") for w in ("to", "with")]
)
CUES = [" " + c for c in CUES]
AFTER_CUE = re.compile(r"[,:]?\s+(?:(?:mr|mrs|ms|dr|prof|herr|frau|mme|mlle|sr|sra)\.? )?(?=[^\W\d_])", re.I)
SENTENCE = re.compile(r"(?:^|\n|[.!?] )(?=[a-zà-ÿ]{3,} [a-zà-ÿ]{3})")
SPEAKS = re.compile(r"^,? (?:said|says|wrote|writes|asked|asks|told|tells|thinks|thought|replied|answered|added|explained|argues|who|sagte|schrieb|meint|dit|écrit|dijo|escribió|here\b)(?!\w)", re.I)


def _free(spans: list, start: int, end: int) -> bool:
    return all(end <= x[0] or x[1] <= start for x in spans)


#: Without one of these a text cannot match the pattern; looking for them first is many times faster than the pattern.
_AT_HINT = re.compile(r"@|[\[({]\s?(?:at|AT|At)|\sAT\s")
_DOT_HINT = re.compile(r"\s(?:dot|punkt|punto|point)\s", re.I)
_ANNOUNCING = (
    "ssn", "social", "sozial", "seguridad", "curit", "nir", "steuer", "national", "ni n", "nino", "identity", "id card", "id n", "passp", "reisep", "pasap", "passep",
    "ausweis", "licen", "rerschein", "dni", "nie", "nif", "curp", "tax ", "tin",
)
DENSE = re.compile(r"\d(?:[ .()/\-]{0,3}\d){5}")


def _emails(t: str, spans: list) -> None:
    low = t.lower()
    marked = "@" in t or ("AT" in t or "(" in t or "[" in t or "{" in t) and _AT_HINT.search(t)
    patterns = [EMAIL] if marked else []
    patterns += [SPELLED] if any(w in low for w in ("dot", "punkt", "punto", "point")) and _DOT_HINT.search(t) else []
    for p in patterns:
        for m in p.finditer(t):
            ending = m.group(3)
            if ending.lower() in FILE_ENDING or _free(spans, m.start(1), m.end()) is False:
                continue
            spans.append((m.start(1), m.end(), "email"))


def _addresses(t: str, spans: list) -> None:
    low = t.lower()
    for k, (p, hints) in enumerate(STREETS):
        if hints and not any(h in low for h in hints) or k == 5 and not _PLACE_CODE.search(t):
            continue
        for m in p.finditer(t):
            start, end = m.start(), m.end()
            if not _free(spans, start, end):
                continue
            if k == 1 and not (_LED.search(t, max(0, start - 8), start) or _ENDED.match(t, end)):
                continue
            tail = TAIL.match(t, end)
            if tail:
                end = tail.end()
            spans.append((start, end, "address"))


def _gaps(t: str, spans: list) -> list[tuple[int, int]]:
    """The stretches that no occurrence holds yet."""
    out, at = [], 0
    for s, e, _ in sorted(spans):
        if at < s:
            out.append((at, s))
        at = max(at, e)
    return [*out, (at, len(t))]


def _ids(t: str, spans: list) -> None:
    low = t.lower()
    for m in ANNOUNCED.finditer(t) if any(h in low for h in _ANNOUNCING) else ():
        if _free(spans, m.start(1), m.end(1)):
            spans.append((m.start(1), m.end(1), "id_number"))
    for m in [m for a, b in _gaps(t, spans) for m in ID_SHAPES.finditer(t, a, b)]:
        value = m.group(0)
        if NOT_PERSONAL.search(t, max(0, m.start() - 24), m.start()):
            continue
        if PLAIN_LETTERS.match(value) and not re.match(r"^[A-Za-z]{2}\d{6}[A-Da-d]$", value):
            continue  # passports and licences count where they are announced
        spans.append((m.start(), m.end(), "id_number"))


def _phones(t: str, spans: list) -> None:
    for p in PHONES:
        for m in [m for a, b in _gaps(t, spans) for m in p.finditer(t, a, b)]:
            start, end = m.start(), m.end()
            if NOT_PERSONAL.search(t, max(0, start - 24), start):
                continue
            digits = sum(c.isdigit() for c in m.group(0))
            if not 7 <= digits <= 15:
                continue
            spans.append((start, end, "phone"))


def _names(t: str, spans: list, given: frozenset) -> None:
    """Names. Beside those that are certain, spans of kind name? with (given, family): names if the corpus proves the words elsewhere.

    Certain: a given name of the list before a capitalized word; a title, or a word that leads to a name, before two capitalized words or an
    initial and one; such words before what only persons do; a family name in capitals, a comma and a listed given name. Left open: other two
    capitalized words, initials, turned names, and names in lower case.
    """

    taken = list(spans)

    def add(start: int, end: int, first: str, family: str, sure: bool, shown: bool = False) -> None:
        if _free(taken, start, end):
            spans.append((start, end, "name" if sure else "name?", first.lower(), family.lower(), shown))
            if sure:
                taken.append(spans[-1])

    def family_like(word: str, end: int) -> bool:
        low = word.lower()
        return not (low in STOP or low in NOT_FAMILY or COMPANY.match(" " + word) or COMPANY.match(t[end : end + 16]))

    for m in CAPITAL.finditer(t):
        first, low, start, at = m.group(1), m.group(1).lower(), m.start(1), m.end(1)
        if low in STOP and low not in given:
            continue
        listed = low in given or low.split("-")[0] in given
        before = t[max(0, start - 24) : start]
        r = REST.match(t, at)
        if r and family_like(r.group(1), r.end()):
            if listed and low not in COMMON_GIVEN:
                add(start, r.end(), first, r.group(1), True)
                continue
            shouted = first.isupper() and r.group(1).isupper()
            titled = TITLE.search(before) is not None
            # A word of the language that is a name, too, in a text in capitals or at the start of a sentence says nothing.
            shown = titled or "'" in r.group(1) or "’" in r.group(1) or (not shouted and CUE.search(before) is not None and len(first) > 2) or (not shouted and (SPEAKS.match(t[r.end() : r.end() + 12]) is not None or (LINE_START.search(before) is not None and LINE_END.match(t, r.end()) is not None)))
            add(start, r.end(), first, r.group(1), shown, shown)
        back = TURNED.match(t, at)
        if back and family_like(first, at) and not listed:
            second = back.group(1) or back.group(2)
            if len(second) == 1 or (second[0].isupper() and second.lower() not in STOP - given):
                loud = first.isupper() and len(first) > 3 and not (second.isupper() and len(second) > 1)
                add(start, back.end(), second if len(second) > 1 else "", first, loud and second.lower() in given and second.lower() not in COMMON_GIVEN)
    for m in INITIALS.finditer(t):
        r = REST.match(t, m.end())
        if r and family_like(r.group(1), r.end()):
            before = t[max(0, m.start() - 24) : m.start()]
            shown = TITLE.search(before) is not None or CUE.search(before) is not None
            add(m.start(), r.end(), "", r.group(1), shown)
    # In lower case: a listed name, or what follows a word that leads to a name.
    low, starts = t.lower(), [m.end() for m in SENTENCE.finditer(t)]
    plain = " " + low.replace("\n", " ").replace("(", " ").replace('"', " ").replace(">", " ")
    for cue in CUES if len(low) == len(t) else ():
        at = plain.find(cue)
        while at >= 0:
            m = AFTER_CUE.match(t, at + len(cue) - 1)
            if m and low[m.end()] == t[m.end()]:
                starts.append(m.end())
            at = plain.find(cue, at + len(cue))
    if not given.isdisjoint(t.split()):
        starts += [m.start() for m in re.finditer(_WORD, t) if m.group(0) in given]
    for at in sorted(set(starts)):
        m = LOWER.match(t, at)
        if m and m.group(1).islower() and m.group(2).islower() and m.group(1) not in STOP - given and m.group(2) not in STOP:
            add(m.start(1), m.end(2), m.group(1), m.group(2), False)


def raw_spans(text: str | None, given: Iterable[str] = ()) -> list[tuple]:
    """(start, end, type) of what one text shows by itself, from 0. Names are (start, end, type, given, family, shown), of type name, or name? where
    the text alone does not tell; shown: the words around them show a name."""
    if not isinstance(text, str) or not text:
        return []
    given = given if isinstance(given, frozenset) else frozenset(g.lower() for g in given)
    spans: list[tuple] = []
    _emails(text, spans)
    if any(c.isdigit() for c in text):
        _addresses(text, spans)
        if DENSE.search(text):
            _ids(text, spans)
            _phones(text, spans)
    _names(text, spans, given)
    return spans


def proves(span: tuple, given: frozenset) -> tuple[str | None, str | None]:
    """The (given, family) that a span proves for others: a certain name its family name, and its given name where the words around it show a name."""
    if span[2] != "name":
        return None, None
    return (span[3] if span[5] and span[3] not in given and span[3] else None), span[4]


def holds(span: tuple, given: frozenset, givens: frozenset, families: frozenset) -> bool:
    """Whether an open name is one, given the names that are proven: of a family name that is proven, and of an initial, a listed or a proven given name."""
    return span[2] != "name?" or (span[4] in families and (not span[3] or span[3] in given or span[3] in givens))


def without_overlaps(spans: Iterable[tuple]) -> list[tuple[int, int, str]]:
    """(start, end, type) in order; of two that overlap the earlier, at one start the longer."""
    out: list[tuple[int, int, str]] = []
    for s in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or s[0] >= out[-1][1]:
            out.append((s[0], s[1], s[2].rstrip("?")))
    return out


def find_pii(text: str | None, given: Iterable[str] = ()) -> list[tuple[int, int, str]]:
    """(start, end, type) of the occurrences in a text that stands alone, from 0, in order, none overlapping. Null and empty texts have none."""
    given = given if isinstance(given, frozenset) else frozenset(g.lower() for g in given)
    spans = raw_spans(text, given)
    proven = [proves(s, given) for s in spans]
    givens, families = frozenset(g for g, _ in proven if g), frozenset(f for _, f in proven if f)
    return without_overlaps(s for s in spans if holds(s, given, givens, families))


BIRTH = re.compile(
    r"(?:\b(?:born(?: on)?|date of birth|birth ?date|dob|d\.o\.b\.|geboren(?: am)?|geburtsdatum|n[ée]{1,2}(?:\(e\))? le|date de naissance|nacid[oa] el|fecha de nacimiento)\s*(?:is|:|=|was)?\s*)"
    r"(\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?!\d)", re.I)


def find_birth_dates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, 'birth_date') of dates of birth that are announced as such. They are redacted, and are none of the types of find_pii."""
    if not isinstance(text, str):
        return []
    return [(m.start(1), m.end(1), "birth_date") for m in BIRTH.finditer(text)]


# ---------------------------------------------------------------- pseudonyms
ROUNDS = 10
ALPHABETS = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _round(key: bytes, tweak: str, i: int, half: int, modulus: int) -> int:
    mac = hmac.new(key, f"{tweak}|{i}|{half}|{modulus}".encode(), hashlib.sha256).digest()
    return int.from_bytes(mac, "big") % modulus


def feistel(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: an unbalanced Feistel network over a * b >= size, walked until the value is in range again."""
    if size < 2:
        return value
    a = int(size**0.5) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        if not back:
            for i in range(ROUNDS):
                if i % 2 == 0:
                    left = (left + _round(key, tweak, i, right, a)) % a
                else:
                    right = (right + _round(key, tweak, i, left, b)) % b
        else:
            for i in reversed(range(ROUNDS)):
                if i % 2 == 0:
                    left = (left - _round(key, tweak, i, right, a)) % a
                else:
                    right = (right - _round(key, tweak, i, left, b)) % b
        value = left * b + right
        if value < size:
            return value


def _permuted(text: str, key: bytes, tweak: str, back: bool = False) -> str:
    """The digits and ASCII letters of a text permuted as one value, each staying a digit or a letter of its case; all else stays.

    The tweak holds the type and the shape, so the permutation is a bijection on all texts of a shape."""
    slots = [(i, a) for i, c in enumerate(text) for a in ALPHABETS if c in a]
    size, value = 1, 0
    for i, a in slots:
        value, size = value * len(a) + a.index(text[i]), size * len(a)
    shape = "".join(next(("9Aa"[k] for k, a in enumerate(ALPHABETS) if c in a), c) for c in text)
    value = feistel(value, size, key, f"{tweak}|{shape}", back)
    out = list(text)
    for i, a in reversed(slots):
        value, r = divmod(value, len(a))
        out[i] = a[r]
    return "".join(out)


def _letter_23(digits: str) -> str:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23]  # fixed values of the Spanish check letter


def _mod_11_10(digits: str) -> str:
    p = 10
    for d in digits:
        p = ((int(d) + p) % 10 or 10) * 2 % 11
    return str((11 - p) % 10)


def _social_security(v: str) -> bool:
    return v[:3] not in ("000", "666") and v[0] != "9" and v[3:5] != "00" and v[5:] != "0000"


#: Numbers that can be verified, as (shape, value of the check, body that is permuted, rule for the body). The pseudonym of a valid one is valid.
CHECKED = [
    ("DNI", re.compile(r"\d{8}[A-Z]"), lambda v: _letter_23(v[:8]), slice(0, 8), None),
    ("NIE", re.compile(r"[XYZ]\d{7}[A-Z]"), lambda v: _letter_23("XYZ".index(v[0]).__str__() + v[1:8]), slice(1, 8), None),
    ("NIR", re.compile(r"[12]\d{2}(?:0[1-9]|1[0-2])\d{10}"), lambda v: f"{97 - int(v[:13]) % 97:02d}", slice(0, 13), re.compile(r"[12]\d{2}(?:0[1-9]|1[0-2])\d{8}").fullmatch),
    ("IdNr", re.compile(r"[1-9]\d{10}"), lambda v: _mod_11_10(v[:10]), slice(0, 10), re.compile(r"[1-9]\d{9}").fullmatch),
    ("SSN", re.compile(r"\d{9}"), lambda v: "" if _social_security(v) else "?", slice(0, 9), _social_security),
]


def checked_kind(canonical: str):
    """The entry of CHECKED that a number without separators, in capitals, satisfies; None if it satisfies none."""
    for kind in CHECKED:
        _, shape, check, _, _ = kind
        if shape.fullmatch(canonical) and (c := check(canonical)) != "?" and canonical.endswith(c):
            return kind
    return None


def permute_id(canonical: str, key: bytes, back: bool = False) -> str:
    """Another number of the same shape. One whose check digit or letter is right becomes one that is right, too, and the other way round: the body of
    a valid number is permuted among the valid ones of its kind; an invalid one is walked on until it is no valid one."""
    kind = checked_kind(canonical)
    if kind is None:
        value = canonical
        while True:
            value = _permuted(value, key, "id_number", back)
            if checked_kind(value) is None:
                return value
    name, _, check, body, rule = kind
    value = canonical[body]
    while True:
        value = _permuted(value, key, f"id_number|{name}", back)
        if rule is None or rule(value):
            break
    out = canonical[: body.start] + value + canonical[body.stop :]
    c = check(out)
    return out[: len(out) - len(c)] + c if c else out


#: Country codes of one and two digits; all others have three.
_ONE, _TWO = "17", frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def phone_parts(written: str) -> tuple[str, str, list[int]]:
    """(country code, the number behind it, the places of its digits in the writing); the prefixes + and 00 and a trunk zero in brackets are left aside.
    A national number has no country code, and its leading zeros count to it."""
    at = [i for i, c in enumerate(written) if c.isdigit()]
    abroad = written.startswith("+") or written.startswith("00")
    if not abroad:
        zeros = len(written[at[0] :]) - len(written[at[0] :].lstrip("0")) if at else 0
        return "0" * zeros, "".join(written[i] for i in at[zeros:]), at[zeros:]
    if not written.startswith("+"):
        at = at[2:]
    digits = "".join(written[i] for i in at)
    n = 1 if digits[:1] in _ONE else 2 if digits[:2] in _TWO else 3
    trunk = re.search(r"\(0\)", written)
    rest = [i for i in at[n:] if not (trunk and trunk.start() < i < trunk.end())]
    return digits[:n], "".join(written[i] for i in rest), rest


def permute_phone(written: str, key: bytes, back: bool = False) -> str:
    """The number behind the country code permuted and laid into the same writing, so one number in two writings stays one number."""
    code, number, places = phone_parts(written)
    out = list(written)
    for i, d in zip(places, _permuted(number, key, f"phone|{code}", back)):
        out[i] = d
    return "".join(out)


def permute_written_id(written: str, key: bytes, back: bool = False) -> str:
    """permute_id of the number without separators and letter case, laid into the same writing."""
    places = [i for i, c in enumerate(written) if c.isascii() and c.isalnum()]
    new = permute_id("".join(written[i] for i in places).upper(), key, back)
    out = list(written)
    for i, c in zip(places, new):
        out[i] = c.lower() if written[i].islower() else c
    return "".join(out)


def permute_date(day: datetime.date, key: bytes, first: datetime.date = datetime.date(1900, 1, 1), last: datetime.date = datetime.date(2099, 12, 31), back: bool = False) -> datetime.date:
    """Another day of the range; the same day always becomes the same. Days outside the range stay."""
    if not first <= day <= last:
        return day
    n = (last - first).days + 1
    return first + datetime.timedelta(days=feistel((day - first).days, n, key, "date", back))


def permute_written_date(written: str, key: bytes, back: bool = False) -> str:
    """A date in the order and with the separators it was written in (year first, else day first unless only month first is a date). What is no date
    between 1900 and 2099 is permuted digit by digit."""
    numbers = re.findall(r"\d+", written)
    orders = ([0, 1, 2],) if len(numbers[0]) == 4 else ([2, 1, 0], [2, 0, 1])
    for order in orders:
        try:
            day = datetime.date(*(int(numbers[k]) for k in order))
        except ValueError:
            continue
        new = permute_date(day, key, back=back)
        # Day first and month first are told apart by what is a date, so the result is laid down day first where it was read so.
        parts = dict(zip(order, (new.year, new.month, new.day)))
        it = iter(range(3))
        return re.sub(r"\d+", lambda m: str(parts[next(it)]).zfill(len(m.group(0))), written)
    return _permuted(written, key, "birth_date", back)


def placeholder(value: str, kind: str, key: bytes) -> str:
    """[PHONE:...], [ID_NUMBER:...] and [BIRTH_DATE:...] with another value in the same format; [EMAIL:...], [NAME:...] and [ADDRESS:...] with a keyed token."""
    if kind == "phone":
        return f"[PHONE:{permute_phone(value, key)}]"
    if kind == "id_number":
        return f"[ID_NUMBER:{permute_written_id(value, key)}]"
    if kind == "birth_date":
        return f"[BIRTH_DATE:{permute_written_date(value, key)}]"
    plain = " ".join(value.casefold().split())
    return f"[{kind.upper()}:{hmac.new(key, f'{kind}|{plain}'.encode('utf-8', 'surrogatepass'), hashlib.sha256).hexdigest()[:12]}]"


def replace_spans(text: str | None, spans: Iterable[tuple[int, int, str]], key: bytes) -> str | None:
    """The text with a placeholder for each span and every other character as it was."""
    if not isinstance(text, str):
        return None
    out, at = [], 0
    for s, e, kind in without_overlaps(spans):
        out += [text[at:s], placeholder(text[s:e], kind, key)]
        at = e
    return "".join([*out, text[at:]])


def redact(text: str | None, given: Iterable[str], key: bytes) -> str | None:
    """A text that stands alone with a placeholder for each occurrence and each date of birth."""
    return replace_spans(text, [*find_pii(text, given), *find_birth_dates(text)], key)


# ---------------------------------------------------------------- DataFrames
def given_name_set(names: DataFrame, column: str = "given_name", most: int = 100_000) -> frozenset:
    """The list of given names, lower case. It is a fixed lexicon: more than `most` names are an error, not a broadcast."""
    rows = names.select(F.lower(F.trim(F.col(column))).alias("n")).where("n <> ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} given names")
    return frozenset(r[0] for r in rows)


SPANS = "array<struct<s:int,e:int,k:string,given:string,family:string,shown:boolean>>"


def accepted_spans(rows: DataFrame, key_cols: list[str], text_col: str, names: frozenset) -> DataFrame:
    """_key (a struct of the key columns), s, e (from 0), k: the occurrences of each text, names that only the corpus proves among them.

    One pass over the texts writes down what each shows. A family name that some text shows for certain, and a given name that title or wording show,
    are proven for all texts; the open names are joined with them by these words. Only names are moved, never texts, and no list of them is sent around.
    """

    def found(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            spans = raw_spans(t, names)
            out.append([{"s": x[0], "e": x[1], "k": x[2], "given": x[3] if len(x) > 3 else None, "family": x[4] if len(x) > 3 else None, "shown": len(x) > 3 and x[5] and bool(x[3]) and x[3] not in names} for x in spans])
        return pd.Series(out)

    # Keys travel in a struct, so they may have any name.
    raw = rows.select(F.struct(*key_cols).alias("_key"), F.pandas_udf(found, SPANS)(F.col(text_col)).alias("_spans")).where(F.size("_spans") > 0)
    raw = materialize(raw, "spans").select("_key", F.explode("_spans").alias("o")).select("_key", "o.*")
    certain, unsure = raw.where("k <> 'name?'"), raw.where("k = 'name?'")
    families = certain.where("k = 'name'").select("family").distinct()
    givens = certain.where("k = 'name' and shown").select("given").distinct()
    listed = F.pandas_udf(lambda g: g.map(lambda x: not x or x in names).astype(bool), "boolean")(F.col("given"))
    unsure = unsure.join(families, "family", "left_semi").withColumn("listed", listed)
    held = unsure.where("listed").unionByName(unsure.where("not listed").join(givens, "given", "left_semi"))
    return certain.select("_key", "s", "e", "k").unionByName(held.select("_key", "s", "e", F.lit("name").alias("k")))


def spans_by_row(spans: DataFrame) -> DataFrame:
    """_key, spans: array of s, e, k in order, of two that overlap the earlier, at one start the longer. A text's spans are no more than its words."""
    each = F.transform(F.sort_array(F.collect_list(F.struct("s", (-F.col("e")).alias("n"), "k"))), lambda x: F.struct(x["s"].alias("s"), (-x["n"]).alias("e"), x["k"].alias("k")))
    kept = F.aggregate("_all", F.slice(F.col("_all"), 1, 0), lambda a, x: F.when((F.size(a) == 0) | (x["s"] >= F.get(a, F.size(a) - 1)["e"]), F.concat(a, F.array(x))).otherwise(a))
    return spans.groupBy("_key").agg(each.alias("_all")).select("_key", kept.alias("spans"))


def occurrences(rows: DataFrame, key_cols: list[str], text_col: str, names: frozenset) -> DataFrame:
    """key columns, pii_type, start_pos (from 1, in code points), end_pos: one row per occurrence. Keys tell the rows apart; null texts have none."""
    spans = spans_by_row(accepted_spans(rows, key_cols, text_col, names)).select("_key", F.explode("spans").alias("o"))
    return spans.select(*[F.col("_key")[c].alias(c) for c in key_cols], F.col("o.k").alias("pii_type"), (F.col("o.s") + 1).cast("long").alias("start_pos"), F.col("o.e").cast("long").alias("end_pos"))


def redacted(rows: DataFrame, key_cols: list[str], text_col: str, names: frozenset, key: bytes) -> DataFrame:
    """The rows with the text column replaced, dates of birth as well; every other column as it is. Keys tell the rows apart and may be null."""

    def change(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([replace_spans(t, [*((x["s"], x["e"], x["k"]) for x in (s if s is not None else ())), *find_birth_dates(t)], key) for t, s in zip(text, spans)], dtype=object)

    spans = spans_by_row(accepted_spans(rows, key_cols, text_col, names))
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.struct(*key_cols).alias("_own"))
    joined = packed.join(spans, F.col("_own").eqNullSafe(F.col("_key")), "left")
    new = F.pandas_udf(change, "string")(F.col("_row")[text_col], F.col("spans"))
    return joined.select(*[(new if c == text_col else F.col("_row")[c]).alias(c) for c in rows.columns])


def texts_with_pii(posts: DataFrame, citations: DataFrame) -> DataFrame:
    """record_table, record_key, text: each post once, however often it was fetched, and each citation."""
    p = posts.where("post_id is not null").groupBy(F.col("post_id").alias("record_key")).agg(F.max("selftext").alias("text"))
    p = p.select(F.lit("reddit_posts").alias("record_table"), "record_key", "text")
    c = citations.select(F.lit("discovered_citations").alias("record_table"), F.col("citation_id").cast("string").alias("record_key"), F.col("mention_context").alias("text"))
    return p.unionByName(c)
