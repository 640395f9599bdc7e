"""Personal information inside free text (problem 8).

Addresses of mail, phone numbers, identity numbers and street addresses are found by their written form and the words before
them.  Names are found by form and by how their words are written over the whole corpus: a pair of capitalised words, in any script that
has capitals, is a name when both are known from the contacts or hardly ever come in lower case.  Those counts come from a count-min
sketch of a fixed size over all texts.  In Chinese, Japanese and Korean script a name is two words, or one split by a middle dot, before an
honorific, or two words known from the contacts.

``redacted`` puts a typed placeholder in place of each occurrence, in the pass that finds them.

Surrogates are keyed replacements of the same kind, script and format, the same for the same entity everywhere.  They are made token by token:

* a word becomes a made-up word of its script and case, whose first letter only hangs on the first letter, so initials fit given names;
  a final vowel stays one (the tables tell no gender, and in many languages that letter does);
* digits, and letters of identity numbers, go through a keyed permutation of all strings of their form, so different ones stay different;
  country code, trunk zero and extension mark of a phone stay;
* words that mean a kind of street, particles of names, and the top domain stay.

A distributed check gives a word or number a further turn while its replacement is also another's, or is a real word or number of the corpus,
until none is left; words grow with their turns, so this ends.  Numbers of a form so crowded that no free one is found in ``CROWDED``
turns keep the plain permutation: still distinct, though maybe somebody's.

All matching runs on a copy of the text in which full-width forms, blanks and dashes are mapped one to one, so positions
are those of the text.  Defined results: null and empty texts give no rows; texts without cases come out unchanged.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, discard, table
from .sketch import decoded, sketch

KINDS = ("email", "id_number", "address", "phone", "name")
#: log2 of the cells of each of the four rows of the word sketch.
WORD_BITS = 20

_PLAIN = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_PLAIN |= dict.fromkeys([0xA0, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x202F, 0x205F, 0x3000], 0x20)
_PLAIN |= dict.fromkeys([0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2212], 0x2D)
_ANY_ODD = re.compile("[\xa0\u2000-\u200a\u2010-\u2015\u202f\u205f\u2212\u3000\uff01-\uff5e]")


def plain(text: str) -> str:
    """The text with full-width forms, blanks and dashes in ASCII, position by position."""
    return text.translate(_PLAIN) if not text.isascii() and _ANY_ODD.search(text) else text


# ---- mail addresses -----------------------------------------------------------------------------------------------

_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,62}[A-Za-z0-9])?$")
_HOST = re.compile(r"(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9])")
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|punto|point|Punkt)\s?[\])}>]\s?|\s(?:dot|DOT|punto|point|Punkt)\s)"
_HOST_SPOKEN = re.compile(rf"(?:[A-Za-z0-9\-]+{_DOT})+[A-Za-z]{{2,}}(?![A-Za-z0-9])")
_DOT_SPOKEN = re.compile(_DOT)
# a spoken dot in the mailbox, and what stands before it
_LOCAL_DOT = re.compile(r"(?<![A-Za-z0-9._%+\-])([A-Za-z0-9][A-Za-z0-9._%+\-]*)(?:\s?[\[({<]\s?(?:dot|DOT|punto|point|Punkt)\s?[\])}>]\s?|\s(?:dot|DOT|punto|point|Punkt)\s)$")
_AT = re.compile(r"@|[\[({<]\s?(?:at|AT|@|arroba)\s?[\])}>]\s?| (?:at|AT|arroba) ")
# Words that are no host and no mailbox.
_NOT_HOST = frozenset("the a an this that our your his her their my its which what any some each every no one two three four five six seven eight nine ten eleven twelve noon midnight".split())


def _mails(t: str):
    for m in _AT.finditer(t):
        mark = m[0].strip()
        local_end = m.start() - (t[m.start() - 1 : m.start()] == " " and mark[0] in "[({<")
        local = _LOCAL.search(t, max(0, local_end - 80), local_end)
        if not local:
            continue
        host = _HOST.match(t, m.end()) if mark == "@" else None
        if not host and (spoken := _HOST_SPOKEN.match(t, m.end())):
            first = _DOT_SPOKEN.split(spoken[0])[0].lower()
            # a bare "at" in running text needs a spoken dot, or a host in one lower-case word
            if first not in _NOT_HOST and local[0].lower() not in _NOT_HOST and (len(mark) != 2 or " " in spoken[0] or spoken[0] == spoken[0].lower()):
                host = spoken
        if host:
            start = local.start()
            while mark != "@" and (more := _LOCAL_DOT.search(t, _back(t, start, 4), start)) and more[1].lower() not in _NOT_HOST:
                start = more.start()
            yield start, host.end()


# ---- identity numbers ---------------------------------------------------------------------------------------------

_ID_WORD = re.compile(
    r"passport|passeport|reisepass|pasaporte|паспорт|パスポート|\bID\b|identity|identidad|identité|ausweis|удостоверен|"
    r"身分|身份|\bDNI\b|\bNIE\b|\bSSN\b|social security|sécurité sociale|seguridad social|sozialversicherung|national insurance|\bNINO\b|"
    r"personal number|national number",
    re.IGNORECASE,
)
_NOT_ID_WORD = re.compile(r"(?i)\b(?:ticket|order|batch|serial|revision|invoice|version|build|ratio)\b[^.\n]{0,12}$")
_SSN = re.compile(r"(?<![\w+\-.,/])\d{3}([- .])\d{2}\1\d{4}(?![\w]|[-.]\d)")
_NINO = re.compile(r"(?<![\w\-])[A-Za-z]{2}([ \-]?)\d{2}\1\d{2}\1\d{2}\1[A-Da-d](?![\w]|-\w)")
_PASSPORT = re.compile(r"(?<![\w\-])[A-Za-z] ?\d{7}[A-Za-z](?![\w]|-\w)")
_ID_LOOSE = re.compile(r"(?<![\w+\-.,/])(?:[A-Za-z]{1,2}[ \-]?)?\d(?:[ .\-/]?\d){5,13}(?:[ \-]?[A-Za-z])?(?![\w]|[-.]\d)")
_RUN = re.compile(r"\d(?:[ .\-/()]{0,3}\d){5,}")
_BREAK_BEFORE = re.compile(r"[.;!?。]\s|\n\s*\n|\d")
_NO_DOT = re.compile(r"\b[Nn][or]\.\s")


def _ids(t: str, runs: list[tuple[int, int]]):
    for start, end in runs:
        lo, hi = max(0, start - 4), min(len(t), end + 8)
        for p in (_SSN, _NINO, _PASSPORT):
            for m in p.finditer(t, lo, hi):
                if not _NOT_ID_WORD.search(t, max(0, m.start() - 30), m.start()):
                    if p is _PASSPORT and " " in m[0] and not _ID_WORD.search(t, max(0, m.start() - 40), m.start()):
                        continue
                    yield m.start(), m.end()
        # a number right behind the words for one, over a label's mark or a line end
        if (m := _ID_LOOSE.search(t, lo, hi)) and m.end() < hi or m and hi == len(t):
            before = t[max(0, m.start() - 60) : m.start()]
            words = list(_ID_WORD.finditer(before))
            if words and len(between := before[words[-1].end() :]) <= 32 and not _BREAK_BEFORE.search(_NO_DOT.sub("", between)):
                yield m.start(), m.end()


# ---- street addresses ---------------------------------------------------------------------------------------------



def _ranges(points: list[int]) -> str:
    """The points as ranges of a character class."""
    out, start = [], points[0]
    for a, b in zip(points, [*points[1:], -1]):
        if b != a + 1:
            out.append(chr(start) if a == start else f"{chr(start)}-{chr(a)}")
            start = b
    return "".join(out)


_UP = _ranges([c for c in range(0x41, 0x2000) if chr(c).isupper()])
_LET = r"[^\W\d_]"
_CAP = rf"[{_UP}]{_LET}*(?:['’\-]{_LET}+)*"
# Words for kinds of streets and parts of houses.
_EN_TYPE = r"(?:Street|St|Road|Rd|Lane|Ln|Terrace|Ter|Avenue|Ave|Court|Ct|Close|Drive|Dr|Way|Square|Sq|Crescent|Cres|Boulevard|Blvd|Place|Pl|Gardens|Grove|Hill|Row|Walk|Highway|Parkway|Mews|Quay)"
_UNIT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room|Floor|Wohnung|Whg|Appt?|Appartement|Piso|Stock|кв)\b\.? ?(?:no\. ?)?[0-9]{1,4}[A-Za-z]?,? +)"
_FLOOR = r"(?:,? (?:\d{1,2}(?:º|ª|°|\.|er?|ème|e|st|nd|rd|th) ?(?:[A-Z]\b|OG|Stock|[Ff]loor|étage|piso|planta)|(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|Floor|Wohnung|Appt?\.?|кв\.?) ?[0-9]{1,4}[A-Za-z]?))"
_GAP = r"(?:, ?|[ \t]*,?[ \t]*\r?\n[ \t]*)"
_TOWN = rf"{_CAP}(?:[ \-](?:(?:am|an der|sur|de|la|upon|le|del) )*{_CAP})?"
_CODE = r"(?:[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}|(?:[A-Z]{2} )?\d{4,6}(?:-\d{4})?)"
_EN_TAIL = rf"(?:\.?{_FLOOR})?(?:\.?{_GAP}{_TOWN}(?:,? {_CODE})?(?!{_LET}|\d)|\.?, {_CODE})?"
_LOCAL_TAIL = rf"(?:{_FLOOR})?(?:{_GAP}(?:{_CODE} {_TOWN}|{_TOWN}(?: {_CODE})?))?"
_START = r"(?<![\w.,\-/] )(?<![\w.\-/])"
_EN = re.compile(rf"(?<![\w.\-/])(?:{_UNIT})?\d{{1,5}}[A-Za-z]?(?: bis)?,? (?:{_CAP}\.? ){{1,3}}(?i:{_EN_TYPE})\b{_EN_TAIL}")
_DE = re.compile(rf"(?<![\w\-])(?:{_UNIT})?(?:[{_UP}](?:{_LET}|-)*(?i:straße|strasse|str\.|gasse|weg|platz|allee|ring|ufer|damm)|{_CAP} (?i:Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee)) \d{{1,4}} ?[a-zA-Z]?(?:-\d{{1,4}})?\b{_LOCAL_TAIL}")
_FR = re.compile(rf"(?<![\w.\-/])(?:{_UNIT})?\d{{1,4}}(?: ?(?i:bis|ter|quater))?,? (?i:rue|avenue|av\.|boulevard|bd|bld|place|allée|chemin|impasse|quai|cours|route|square) (?:(?i:de la |de l['’]|des |de |du |d['’]|l['’]))?{_CAP}(?: {_CAP})?{_LOCAL_TAIL}")
_ES = re.compile(rf"(?<![\w\-])(?:{_UNIT})?(?i:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|Camino|Ronda|Via|Viale|Piazza|Corso|Rua) (?:(?i:de la |de los |de |del |della ))?{_CAP}(?: {_CAP})?,? (?:n[º°.] ?)?\d{{1,4}}[A-Za-z]?\b{_LOCAL_TAIL}")
_RU = re.compile(rf"(?<!\w)(?:ул\.|улица|проспект|пр-т|пер\.|переулок) {_CAP}(?: {_CAP})?,? (?:д\. ?|дом )?\d{{1,4}}[а-яa-z]?(?:, ?кв\. ?\d+)?")
# where each pattern is worth a try: a cheap search for what every match has
_EN_HINT = re.compile(rf"\d[A-Za-z]?(?: bis)?,? (?:{_CAP}\.? ){{1,3}}(?i:{_EN_TYPE})\b")
_DE_HINT = re.compile(r"(?:traße|TRASSE|TRAßE|trasse|tr\.|TR\.|asse|ASSE|eg|EG|latz|LATZ|llee|LLEE|ing|RING|fer|UFER|amm|DAMM) \d")
_FR_HINT = re.compile(r"\d(?: ?(?:bis|ter|quater|BIS|TER))?,? (?:rue|avenue|av\.|boulevard|bd|bld|place|allée|chemin|impasse|quai|cours|route|square|RUE|AVENUE|BOULEVARD|PLACE|ALLÉE|CHEMIN|IMPASSE|QUAI|COURS|ROUTE|SQUARE|Rue|Avenue|Boulevard|Place|Allée|Chemin|Impasse|Quai|Cours|Route|Square) ")
_ES_HINT = re.compile(r"(?:Calle|CALLE|calle|C/|Avenida|AVENIDA|avenida|Avda|AVDA|Av\.|Plaza|PLAZA|Pza|Paseo|PASEO|Camino|CAMINO|Ronda|RONDA|Via|VIA|Viale|VIALE|Piazza|PIAZZA|Corso|CORSO|Rua|RUA) ")
_RU_HINT = re.compile(r"(?:ул\.|улица|проспект|пр-т|пер\.|переулок) ")
# towns before streets, without blanks: at least one unit of land, then numbers
_CJK = re.compile(r"(?:\d{3}-\d{4} ?)?[\u4e00-\u9fff]{2,}[\u3040-\u30ff\u4e00-\u9fff]*(?:[区市町村郡路街道号]|丁目)[\u3040-\u30ff\u4e00-\u9fff]*\d{1,4}(?:(?:丁目|番地?|号|-)\d{0,4})+")
_CJK_HINT = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]\d{1,4}(?:丁目|番|号|-)")
#: Pattern, hint, and how many words before the hint the pattern may begin.
_STREETS = ((_EN, _EN_HINT, 4), (_DE, _DE_HINT, 5), (_FR, _FR_HINT, 4), (_ES, _ES_HINT, 4), (_RU, _RU_HINT, 0), (_CJK, _CJK_HINT, 2))
_TOKEN_START = re.compile(r"(?<![^\W_])[^\W_]")
_ABBREVIATED = re.compile(r"(?i)\b(?:St|Rd|Ln|Ave|Ct|Dr|Sq|Pl|Blvd|Cres|Ter)$")
_LINE_TOWN = re.compile(rf"\n[ \t]*{_TOWN}$")
# Words that open a sentence or a line and are no towns.
_NO_TOWN = frozenset("The A An I We You He She It They If After Before Our Each Most Nobody No Not There Then Why Ask Compare See Call Phone Contact Write Send Address Deliver Parcel Signed Regards Attendees Minutes Interview Mr Ms Mrs Dr Prof Der Die Das Wir Ob Am Für Le La Les El Los Según Mañana Nous Où Après Этот Мы Всего Почему".split())


def _back(t: str, at: int, words: int) -> int:
    """Where the last ``words`` words before a position begin."""
    for _ in range(words):
        while at > 0 and t[at - 1].isspace():
            at -= 1
        while at > 0 and not t[at - 1].isspace():
            at -= 1
    return at


def _lines(t: str, at: int, lines: int) -> int:
    """The end of that many lines from a position on."""
    for _ in range(lines):
        at = t.find("\n", at) + 1
        if not at:
            return len(t)
    return at


def _around(t: str, p: re.Pattern, h: re.Match, words: int, last_end: int) -> re.Match | None:
    """The match that begins in the words before a hint, or at it, and goes over it; it may take this line and the three after."""
    low, high = max(last_end, _back(t, h.start(), words)), _lines(t, h.end(), 4)
    for start in _TOKEN_START.finditer(t, low, h.end()):
        if (m := p.match(t, start.start(), high)) and m.end() > h.start():
            return m
    return None


def _addresses(t: str):
    for p, hint, back in _STREETS:
        last_end = 0
        for h in hint.finditer(t):
            if h.start() < last_end or not (m := _around(t, p, h, back, last_end)):
                continue
            start, end = m.span()
            last_end = end
            text = m[0]
            # a town on a line of its own must end that line or carry a code
            if (x := _LINE_TOWN.search(text)) and not re.match(r"[ \t]*(?:[;,.。!?]|\r|\n|$)", t[end : end + 20]):
                end = start + x.start()
                text = t[start:end].rstrip()
                end = start + len(text)
            last = re.search(rf"(?:, ?|\n[ \t]*)({_CAP})$", text)
            if last and last[1] in _NO_TOWN:
                end = start + last.start()
                text = t[start:end].rstrip()
                end = start + len(text)
            if p is _EN and _ABBREVIATED.search(text) and (text[-2:].lower() == "st" and t[end : end + 1] == "." or re.match(r"\.(?:[ \t]+[a-z(]|[ \t]*[,;.])", t[end : end + 4])):
                end += 1
            yield start, end


# ---- phone numbers ------------------------------------------------------------------------------------------------

_PHONE = re.compile(r"(?<![\w.@+\-/,:])(?<![A-Za-z]-)(?:\+ ?|\(\+?)?\d{1,5}\)?(?:[ .\-/]{0,2}\(?\d{1,7}\)?){1,7}(?![\w@]|[.,:/\-]\d)")
_TEL_PHONE = re.compile(r"(?i)(?<=tel:)\+?\(?\d[\d().\-/ ]{5,18}\d")
_EXTENSION = re.compile(r"(?i)(?:,? ?(?:ext(?:ension)?\.?|x|durchwahl|dw\.?|poste|доб\.?|内線|#) ?\d{1,6}|-x\d{1,6})(?!\w)")
_CALL_WORD = re.compile(r"(?i)☎|☏|📞|phone|mobile|\btel\b|tel[.:]|\bfax\b|call|telefon|rückruf|anruf|handy|joindre|appel|llamar|móvil|teléfono|звонить|тел|電話|携帯|cell|whatsapp|reach|dial|ring|\bsms\b|portable")
# a word that directly labels the number after it, over marks and a "no." at most
_LABEL = re.compile(r"(?i)(?:\b(?:ticket|order|batch|serial|form|revision|invoice|version|build|ratio|host|ip|isbn|doi|section|lane|page|room)\b(?:[ \t]?(?:no|nr|num|number|id|code)\b\.?)?[ \t:=#*_`\"'(\[|]{0,5}|#|\bno\. )$")
_CALL_LABEL = re.compile(r"(?i)(?:phone|mobile|\btel|\bfax|cell|handy|whatsapp|☎|☏|📞)[.:]? ?(?:#|no\. )$")
_DATE = re.compile(r"(?:19|20)\d\d[-./](?:0?[1-9]|1[0-2])[-./](?:[0-2]?\d|3[01])(?:\D|$)|(?:[0-2]?\d|3[01])[-./](?:0?[1-9]|1[0-2])[-./](?:19|20)\d\d$")
_US = re.compile(r"(?:\+?1[ .\-])?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-/])\d{3}[ .\-]?\d{4}$")


# where a run too long for one number is cut: wide marks, then a bracket that opens, then a single slash
_CUTS = (re.compile(r" ?/ | / ?| {2,}"), re.compile(r" (?=\((?!0\)))"), re.compile(r"/(?=[0(])"))


def _single(t: str, a: int, b: int) -> list[tuple[int, int]]:
    """The run, or its parts if it has more than 15 digits and parts that all can be numbers."""
    run = t[a:b]
    if sum(map(str.isdigit, run)) > 15:
        for cut in _CUTS:
            edges = [0, *(x for m in cut.finditer(run) for x in m.span()), len(run)]
            parts = list(zip(edges[::2], edges[1::2]))
            if len(parts) > 1 and all(7 <= sum(map(str.isdigit, run[x:y])) <= 15 for x, y in parts):
                return [(a + x, a + y) for x, y in parts]
    return [(a, b)]


def _phone_matches(t: str, a: int, b: int):
    parts = _single(t, a, b)
    if len(parts) > 1:
        for (_, x), (y, _) in zip(parts, parts[1:]):
            t = t[:x] + " " * (y - x) + t[y:]
    for k, (x, y) in enumerate(parts):
        lo = parts[k - 1][1] if k else max(0, a - 3)
        hi = min(len(t), b + 8) if k == len(parts) - 1 else y
        while (m := _PHONE.search(t, lo, hi)) and (m.start() < y):
            yield m
            lo = m.end()


def _phones(t: str, runs: list[tuple[int, int]]):
    for a, b in runs:
        if m := _TEL_PHONE.search(t, max(0, a - 3), min(len(t), b + 8)):
            yield _with_extension(t, m.start(), m.end())
            continue
        for m in _phone_matches(t, a, b):
            if found := _phone(t, m):
                yield found


def _phone(t: str, m: re.Match) -> tuple[int, int] | None:
    start, end = m.span()
    text = m[0]
    if text.count("(") != text.count(")"):
        if text.startswith("(") and ")" not in text:
            start += 1
            text = text[1:]
        elif text.endswith(")"):
            end -= 1
            text = text[:-1]
        else:
            return None
    digits = re.sub(r"\D", "", text)
    groups = re.findall(r"\d+", text)
    if not 7 <= len(digits) <= 15 or _DATE.match(text):
        return None
    shape = [len(g) for g in groups]
    if "." in text and re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", text):
        return None
    called = _CALL_WORD.search(t, _back(t, start, 5), start)
    # a label holds against leading zeros too: tickets come as 0053 0062 400
    labelled = _LABEL.search(t, max(0, start - 32), start) and not _CALL_LABEL.search(t, max(0, start - 32), start)
    if text[0] == "+" and len(digits) >= 8:
        pass
    elif _US.match(text) and len(shape) > 1 and (digits[-10] not in "01" or not labelled):
        pass
    elif labelled:
        return None
    elif text.startswith("00") and digits[2] != "0" and len(digits) >= 11 and len(shape) > 2:
        pass
    elif digits[0] == "0" and digits[1] != "0" and len(digits) >= 9 and len(shape) > 1:
        pass
    elif called and len(digits) >= 7 and (len(shape) > 1 or len(digits) >= 9 and digits[0] in "01"):
        pass
    else:
        return None
    return _with_extension(t, start, end)


def _with_extension(t: str, start: int, end: int) -> tuple[int, int]:
    m = _EXTENSION.match(t, end)
    return start, m.end() if m else end


# ---- names --------------------------------------------------------------------------------------------------------

_PARTICLE = r"(?:(?:van der|van den|van|von der|von|de la|de los|de|del|della|di|da|dos|du|des|le|ten|ter|zu|zur|af|bin|ibn|al|el|d['’]|VAN DER|VAN DEN|VAN|VON DER|VON|DE LA|DE LOS|DE|DEL|DELLA|DI|DA|DOS|DU) ?(?<=[ '’]))"
_NWORD = rf"[{_UP}]{_LET}+(?:['’][{_UP}]{_LET}+)?(?:-[{_UP}]{_LET}+)*"
_INIT = rf"[{_UP}]\."
_SEP = r"(?:[ \t]+|[ \t]*\r?\n[ \t]*)"
_CAPITAL = re.compile(rf"[{_UP}](?:{_LET}+|\.)")
_FORWARD = re.compile(rf"(?P<a>{_NWORD})(?P<mid>(?:{_SEP}{_INIT})*){_SEP}(?P<p>{_PARTICLE})?(?P<b>{_NWORD})(?![^\W_]|@|-[^\W\d])")
_INITIAL = re.compile(rf"(?P<mid>{_INIT}(?:[ \t]?{_INIT})*){_SEP}(?P<p>{_PARTICLE})?(?P<b>{_NWORD})(?![^\W_]|@|-[^\W\d])")
_INVERTED = re.compile(rf"(?P<b>{_NWORD}),{_SEP}(?:(?P<a>{_NWORD})(?P<mid>(?:[ \t]{_INIT})*)|(?P<i>{_INIT}(?:[ \t]?{_INIT})*))(?![^\W_]|@|-[^\W\d])")
_PARTICLE_BEFORE = re.compile(rf"(?<![^\W_]){_PARTICLE}$")
_JOINED = re.compile(r"[@#\\+&\-'’]|[^\W_]")
_WORDS = re.compile(rf"{_LET}+")
_TITLE_BEFORE = re.compile(r"(?:\b(?:Mr|Ms|Mrs|Miss|Dr|Prof|Sir|Frau|Herrn?|Mme|Mlle|M|Sra?|Sres|Dra|Don|Doña|Sig|г-н|г-жа)\.? ?[\[*_`\"“(]{0,3}(?:People/)?)$")
# Capitalised words that are no part of a person's name unless the contacts know them: function words, titles, kinds of places, calendar.
NOT_NAMES = frozenset(
    """the a an this that these those there then than and or but nor so if when while where why what who how i we you he she it they
    my our your his her its their nobody each every most no not after before of in on at to from by with for
    as is are was were be been has have had do does did will would can could should may might must let please
    ask compare see call contact write send address phone attendees signed minutes meeting
    mr ms mrs miss dr prof sir madam regards dear hello hi thanks re cc bcc fwd note notes author interview
    street st road rd lane ln terrace avenue ave court ct close drive way square crescent boulevard place gardens grove hill row walk
    flat apt unit suite room floor apartment bridge board tower river lake mount university college school hospital station airport park
    january february march april may june july august september october november december
    monday tuesday wednesday thursday friday saturday sunday daily weekly monthly
    der die das den dem des ein eine einer eines und oder wir ihr sie er es ob am im an auf für mit von zu ende frau herr herrn wer was wie wo
    straße strasse gasse platz weg nr bitte
    le la les un une des du de et ou où nous vous il elle ils elles ce cet cette après avant selon dans sur sous avec pour par est
    mme mlle rue
    el los las una uno unos unas y o según mañana esta este estos en con por para del al qué quién cómo dónde sr sra dra calle avenida
    plaza paseo don doña
    этот эта это эти мы вы он она они всего почему ли и в на по""".split()
)
_HAN = r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af々〆ー]"
_CJK_NAME = re.compile(rf"(?<!{_HAN})(?P<b>{_HAN}{{1,8}}?)[ ・·](?P<a>{_HAN}{{1,8}}?)(?P<t>さん|さま|様|氏|先生|女士|씨|님)?(?!{_HAN})")
_CJK_GAP = re.compile(rf"{_HAN}[ ・·]{_HAN}")


class Names:
    """Decides whether words are written as names are: known ones, and the corpus's counts by case."""

    def __init__(self, given: frozenset[str], family: frozenset[str], cells: np.ndarray):
        self.given, self.family, self.cells = given, family, cells.reshape(4, -1)
        self.cache: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """2 for a known word, 1 for one hardly ever in lower case, 0.4 for a doubtful one, 0 for a plain word, less for a barred one."""
        got = self.cache.get(word)
        if got is None:
            key = word.lower()
            if key in self.given or key in self.family:
                got = 2.0
            elif key in NOT_NAMES:
                got = -9.0
            else:
                a, b = _cells(key)
                lower = float(decoded(np.minimum(self.cells[0, a], self.cells[1, b])))
                upper = float(decoded(np.minimum(self.cells[2, a], self.cells[3, b])))
                got = 1.0 if lower * 12 <= upper else 0.4 if lower <= upper else 0.0
            if len(self.cache) >= 200_000:
                self.cache.clear()
            self.cache[word] = got
        return got

    def compound(self, text: str) -> float:
        return min(map(self.weight, _WORDS.findall(text)))


def _cells(word: str) -> tuple[int, int]:
    h = xxhash.xxh3_64_intdigest(word)
    return h & (1 << WORD_BITS) - 1, h >> 64 - WORD_BITS


def _names(t: str, names: Names, taken: np.ndarray | None):
    found = []
    for c in _CAPITAL.finditer(t):
        at = c.start()
        initial = t[at + 1] == "."
        if not initial and names.weight(c[0]) < 0.4 or at and _JOINED.match(t[at - 1]):
            continue
        for p in (_INITIAL,) if initial else (_FORWARD, _INVERTED):
            if not (m := p.match(t, at)):
                continue
            start, end = m.span()
            family = names.compound(m["b"])
            given = names.compound(m["a"]) if p is not _INITIAL and m["a"] else 0.9
            least = min(family, given)
            if least < 0.4:
                continue
            if p is _INVERTED and (before := _PARTICLE_BEFORE.search(t, max(0, start - 10), start)):
                start = before.start()
            if taken is not None and taken[start:end].any():
                continue
            both = family + given + (_TITLE_BEFORE.search(t, max(0, start - 24), start) is not None)
            if p is _INVERTED:
                sure = family >= 1.0 and (given >= 1.0 or m["i"])
            else:
                sure = least >= 0.9 or both >= 2.3
            if sure:
                found.append((start, end, both + (0.5 if m["mid"] else 0)))
    if _CJK_GAP.search(t):
        for m in _CJK_NAME.finditer(t):
            known = all(w in names.given or w in names.family for w in (m["a"], m["b"]))
            if (m["t"] or known) and not (taken is not None and taken[m.start() : m.end("a")].any()):
                found.append((m.start(), m.end("a"), 3.0))
    # leftmost longest of overlapping ones, better evidence first
    found.sort(key=lambda x: (-x[2], x[0] - x[1], x[0]))
    kept: list[tuple[int, int]] = []
    for start, end, _ in found:
        if all(end <= a or start >= b for a, b in kept):
            kept.append((start, end))
    return sorted(kept)


def spans(text: str, names: Names) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of each case, in order, none overlapping another."""
    t = plain(text)
    taken = np.zeros(len(t) + 1, bool)
    out: list[tuple[int, int, str]] = []
    runs = [m.span() for m in _RUN.finditer(t)]
    for kind, cases in (("email", _mails(t)), ("address", _addresses(t)), ("id_number", _ids(t, runs)), ("phone", _phones(t, runs))):
        for start, end in sorted(set(cases), key=lambda x: (x[0] - x[1], x[0])):
            if not taken[start:end].any():
                taken[start:end] = True
                out.append((start, end, kind))
    for start, end in _names(t, names, taken):
        out.append((start, end, "name"))
    return sorted(out)


# ---- over tables --------------------------------------------------------------------------------------------------

_LINKS = re.compile(r"\[\[[^\]]*\]\]|^#.*$", re.MULTILINE)


def countable(text: str) -> list[str]:
    """Words of a text whose case tells something: none of mail addresses, handles, tags, headings and links' targets."""
    if "#" in text or "[[" in text:
        text = _LINKS.sub(" ", text)
    if "@" in text or "＠" in text or "at]" in text or "at)" in text or "#" in text:
        text = " ".join(c for c in text.split() if c[0] != "#" and "@" not in c and "＠" not in c and "[at]" not in c and "(at)" not in c)
    return _WORDS.findall(text)


def _word_cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the words of a batch: two rows for words in lower case, two for capitalised ones."""
    counted: Counter = Counter()
    for text in batch.column(0).to_pylist():
        counted.update(countable(text))
    cells, hits = [], []
    width = 1 << WORD_BITS
    for word, n in counted.items():
        a, b = _cells(word.lower())
        row = 2 if word[0] != word[0].lower() else 0
        cells += (row * width + a, (row + 1) * width + b)
        hits += (n, n)
    return np.array(cells, np.int64), np.array(hits, np.int64)


def word_counts(documents: DataFrame) -> np.ndarray:
    """The word sketch of all texts."""
    return sketch(documents.where(F.col("text") != "").select(F.col("text").cast("string")), _word_cells, WORD_BITS + 2)



def _held(documents: DataFrame, contacts: DataFrame):
    return documents.sparkSession.sparkContext.broadcast((word_counts(documents).tobytes(), *known_names(contacts)))


def _names_of(held) -> Names:
    cells, given, family = held.value
    return Names(given, family, np.frombuffer(cells, np.uint8))


_CASE = pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("kind", pa.string()), ("entity", pa.string())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("cases", pa.list_(_CASE))])
_FOUND_DDL = "doc_id long, text string, cases array<struct<start_pos: int, end_pos: int, kind: string, entity: string>>"


def detected(documents: DataFrame, contacts: DataFrame, texts: bool = False) -> DataFrame:
    """``doc_id, text, cases``: the cases of each document that has any, without its text; or of every document, with it."""
    held = _held(documents, contacts)

    def run(batches):
        names = _names_of(held)
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cases = [{"start_pos": a, "end_pos": b, "kind": k, "entity": t[a:b]} for a, b, k in spans(t, names)] if t else []
                if texts or cases:
                    rows.append((d, t if texts else None, cases))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, _FOUND)], schema=_FOUND)

    some = documents if texts else documents.where(F.col("text") != "")
    return some.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _FOUND_DDL)


def find(documents: DataFrame, contacts: DataFrame) -> DataFrame:
    """``doc_id, start_pos, end_pos, kind, entity`` of each case in ``documents``."""
    return detected(documents, contacts).select("doc_id", F.explode("cases").alias("c")).select("doc_id", "c.*")


#: Known names sent to the workers as they are; more go as a bitmap.
MOST_KNOWN = 500_000
#: log2 of the bits of that bitmap (16 MB), and its probes a word.
KNOWN_BITS, PROBES = 27, 6


class Probed:
    """A set of words as a bitmap of a fixed size; a word that is not in it passes now and then."""

    def __init__(self, bits: bytes, size: int):
        self.bits, self.mask = np.frombuffer(bits, np.uint8), (1 << size) - 1

    def __contains__(self, word: str) -> bool:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        at = [((h & self.mask) + i * (h >> 32 | 1)) & self.mask for i in range(PROBES)]
        return all(self.bits[x >> 3] >> (x & 7) & 1 for x in at)


def known_names(contacts: DataFrame, most: int = MOST_KNOWN, size: int = KNOWN_BITS) -> tuple:
    """Words of the contacts' given and family names in lower case, particles left out."""
    out = []
    for col in ("given_name", "family_name"):
        word = F.explode(F.regexp_extract_all(F.col(col), F.lit(r"(?:\p{Lu}|\p{Lo})[\p{L}'’]*"), F.lit(0)))
        words = contacts.where(F.col(col).isNotNull()).select(word.alias("w")).select(F.lower("w").alias("w")).distinct()
        got = words.limit(most + 1).collect()
        if len(got) <= most:
            out.append(frozenset(r.w for r in got))
            continue
        low, high = F.col("h").bitwiseAND(F.lit((1 << size) - 1)), F.shiftrightunsigned("h", 32).bitwiseOR(F.lit(1))
        at = words.select(F.xxhash64("w").alias("h")).select(F.explode(F.array(*((low + high * i).bitwiseAND(F.lit((1 << size) - 1)) + 1 for i in range(PROBES)))).alias("at"))
        bits = np.zeros(1 << size >> 3, np.uint8)
        for r in at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map")).collect():  # 2 ** KNOWN_BITS bits at most
            got = np.frombuffer(r.map, np.uint8)
            part = bits[(r.bucket - 1) * len(got) : r.bucket * len(got)]
            part[:] = got[: len(part)]
        out.append(Probed(bits.tobytes(), size))
    return out[0], out[1]


def redacted(documents: DataFrame, contacts: DataFrame) -> DataFrame:
    """``doc_id, text`` with typed placeholders, put in by the pass that finds the cases."""
    held = _held(documents, contacts)

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = _names_of(held)
        for texts in batches:
            yield pa.array([t and rewritten(t, [(a, b, f"[{k.upper()}]") for a, b, k in spans(t, names)]) for t in texts.to_pylist()], pa.string())

    return documents.select("doc_id", run(F.col("text").cast("string")).alias("text"))


def rewritten(text: str, cases: list[tuple[int, int, str]]) -> str:
    """A text with each ``(start, end, put)`` put in; cases in order."""
    out, at = [], 0
    for start, end, put in cases:
        out += (text[at:start], put)
        at = end
    return "".join([*out, text[at:]])


# ---- surrogates ---------------------------------------------------------------------------------------------------

_ONSETS = "b br c ch d dr f g gr h j k l m n p pr r s st t tr v w z".split()
_VOWELS = "a e i o u ai ea ou".split()
_CODAS = "n r l s th m nd rk x lt".split()
_CYR = ("б в г д к л м н п р с т".split(), "а е и о у".split(), "н р л с м в".split())
_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя"
# Letters of other scripts that a replacement may be made of, first and last code point, lower case where there is case.
_SCRIPTS = (
    (0x3B1, 0x3C9), (0x561, 0x586), (0x5D0, 0x5EA), (0x627, 0x64A), (0x915, 0x939), (0x10D0, 0x10F0), (0x3042, 0x3093), (0x30A2, 0x30F3), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)


def _digest(key: str, *parts: str):
    n = int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), key=key.encode()[:64], digest_size=32).digest())

    def take(size: int) -> int:
        nonlocal n
        n, r = divmod(n, size)
        return r

    return take


@lru_cache(64)
def _letters(key: str, alphabet: str) -> dict[str, str]:
    """A keyed permutation of an alphabet, without fixed letters."""
    left = sorted(alphabet, key=lambda c: _digest(key, "letter", c)(1 << 64))
    return dict(zip(left, left[1:] + left[:1]))


def _base(c: str) -> str:
    """The letter without its marks; one of the Latin or Cyrillic alphabet where it is of those scripts."""
    c = unicodedata.normalize("NFD", c.lower())[0]
    return {"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "t", "ß": "s", "æ": "a", "œ": "o", "ı": "i", "ы": "и", "ъ": "э", "ь": "э", "щ": "ш"}.get(c, c)


def is_initial(w: str) -> bool:
    return len(w) == 1 and _base(w) in _LATIN + _CYRILLIC


def initial(c: str, key: str) -> str:
    """What a word's first letter, Latin or Cyrillic, becomes."""
    c = _base(c)
    return _letters(key, _LATIN if c in _LATIN else _CYRILLIC)[c]


@lru_cache(200_000)
def word_surrogate(low: str, key: str, turn: int) -> str:
    """The replacement of a word in lower case: same script and first letter's image, a final vowel kept; longer with every fourth turn."""
    take, first = _digest(key, "word", low, str(turn)), _base(low[0])
    if first in _LATIN or first in _CYRILLIC:
        on, vo, co = (_ONSETS, _VOWELS, _CODAS) if first in _LATIN else _CYR
        head = initial(first, key)
        made = head if head in "aeiouаеиоуэюя" else head + vo[take(len(vo))]
        made += "".join(on[take(len(on))] + vo[take(len(vo))] for _ in range(2 + turn // 4))
        return made + (low[-1] if low[-1] in "aeioаеио" else co[take(len(co))])
    a, b = next((x for x in _SCRIPTS if x[0] <= ord(first) <= x[1]), (0x61, 0x7A))
    return "".join(chr(a + take(b - a + 1)) for _ in range(min(12, len(low)) + turn // 4))


def _cased(made: str, like: str) -> str:
    return made.upper() if like.isupper() and len(like) > 1 else made[0].upper() + made[1:] if like[0].isupper() else made


@lru_cache(200_000)
def permuted(x: int, size: int, *keys: str) -> int:
    """A keyed permutation of ``range(size)``: a Feistel network over two halves, walked until it is back in range."""
    if size < 2:
        return x
    half = math.isqrt(size - 1) + 1
    while True:
        a, b = divmod(x, half)
        for r in range(8):
            a, b = b, (a + _digest(keys[0], "round", str(r), str(b), *keys[1:])(1 << 128)) % half
        x = a * half + b
        if x < size:
            return x


def _recoded(text: str, *keys: str) -> str:
    """Digits and ASCII letters of a canonical form through one permutation of all strings of that form."""
    x, size = 0, 1
    for c in text:
        r = 10 if c.isdigit() else 26
        x, size = x * r + (int(c) if r == 10 else ord(c) - 97), size * r
    x = permuted(x, size, *keys, "".join("0" if c.isdigit() else "a" for c in text))
    out = []
    for c in reversed(text):
        x, r = divmod(x, 10 if c.isdigit() else 26)
        out.append(str(r) if c.isdigit() else chr(97 + r))
    return "".join(reversed(out))


def _house_number(digits: str, key: str) -> str:
    """A number of as many digits; one without a leading zero stays so."""
    if digits[0] == "0":
        return _recoded(digits, key, "digits")
    low = 10 ** (len(digits) - 1)
    return str(low + permuted(int(digits) - low, 9 * low, key, "digits"))


def _phone_parts(number: str) -> tuple[str, str, str]:
    """Country code with its plus, own digits, and extension of a phone number in plain form."""
    m = _EXTENSION.search(number)
    while m and m.end() < len(number):
        m = _EXTENSION.search(number, m.start() + 1)
    main, ext = (number[: m.start()], re.sub(r"\D", "", m[0])) if m else (number, "")
    abroad = re.match(r"[(\s]*(?:\+|00)\s*", main)
    digits = re.sub(r"\D", "", main[abroad.end() :].replace("(0)", "") if abroad else main)
    code = len(digits[:1] if digits[:1] in "17" else digits[:2]) if abroad else 0
    return "+" + digits[:code] if abroad else "", digits[code:], ext


def canonical(entity: str, kind: str) -> str:
    """What makes two writings of a number one entity: blanks, marks, and ``00`` for ``+`` do not."""
    low = plain(entity).lower()
    if kind == "phone":
        code, own, ext = _phone_parts(low)
        return f"{code} {own} {ext}"
    return re.sub(r"[^0-9a-z]", "", unicodedata.normalize("NFKD", low))


def number_surrogate(canon: str, kind: str, key: str, turn: int) -> str:
    """The replacement of a canonical number, canonical as well."""
    if kind == "phone":
        code, own, ext = canon.split(" ")
        trunk = own[:1] if own[:1] == "0" else ""
        return f"{code} {trunk}{_recoded(own[len(trunk):], key, 'phone', code, trunk, str(turn))} {_recoded(ext, key, 'ext', str(turn))}"
    return _recoded(canon, key, kind, str(turn))


# Words of addresses and names that stay.
_STREET_WORDS = frozenset("street st road rd lane ln terrace ter avenue ave court ct close drive dr way square sq crescent cres boulevard blvd place pl gardens grove hill row walk highway parkway mews quay straße strasse str gasse weg platz allee ring ufer damm rue av bd bld chemin impasse cours route calle avenida avda plaza pza paseo camino ronda via viale piazza corso rua ул улица проспект пр т пер переулок дом д кв flat apt apartment unit suite room floor wohnung whg appt app appartement piso stock bis quater og étage planta er ème e nd rd th no am an der sur de la las los del des du le upon".split())
_PARTICLES = frozenset("van von der den de la los del della di da dos du des le ten ter zu zur af bin ibn al el d".split())
_STREET_TAILS = ("straße", "strasse", "gasse", "platz", "weg", "allee", "ring", "ufer", "damm")
_TOKEN = re.compile(rf"{_LET}+|\d+")


def _pieces(entity: str, kind: str) -> list[tuple[int, int, str]]:
    """``(start, end, word)`` of the words of a mail address, address or name that are replaced, in lower case; initials and numbers are
    among them as one letter or digits."""
    t, out = plain(entity), []
    last, marks = len(t), []
    if kind == "email" and (m := _AT.search(t)):
        spoken = [x.span() for x in _DOT_SPOKEN.finditer(t)]
        last, marks = spoken[-1][1] if spoken and spoken[-1][0] >= m.end() else last, [m.span(), *spoken]
    for m in _TOKEN.finditer(t):
        a, b, w = m.start(), m.end(), m[0].lower()
        if a >= last or any(x <= a and b <= y for x, y in marks):
            continue
        if kind == "address":
            tail = next((x for x in _STREET_TAILS if w.endswith(x) and len(w) > len(x)), "")
            b, w = b - len(tail), w[: len(w) - len(tail)]
            if w in _STREET_WORDS or len(w) == 1 and not w.isdigit():
                continue
        if kind == "name" and w in _PARTICLES and (m[0] == w or t.isupper()):
            continue
        out.append((a, b, w))
    return out


def surrogate(entity: str, kind: str, key: str, turns: dict[tuple[str, str], int] | None = None) -> str:
    """A replacement of the same kind and format; ``turns`` of words (kind ``word``) and numbers that need a further one."""
    turns = turns or {}
    if kind in ("phone", "id_number"):
        canon = canonical(entity, kind)
        made = number_surrogate(canon, kind, key, turns.get((kind, canon), 0))
        if kind == "phone":
            code, own, ext = made.split(" ")
            made = code[1:] + own + ext
        flat = plain(entity)
        stays: set[int] = set()
        if kind == "phone" and (m := re.match(r"[(\s]*(?:\+|00)", flat)):
            stays = {*range(m.end()), *(i for x in re.finditer(r"\(0\)", flat) for i in range(*x.span()))}
        at = [i for i, c in enumerate(flat) if i not in stays and c.isascii() and (c.isdigit() or kind == "id_number" and c.isalpha())]
        out = list(entity)
        for i, c in zip(at, made):
            out[i] = c.upper() if flat[i].isupper() else chr(ord(entity[i]) - int(entity[i]) + int(c)) if entity[i].isdecimal() else c
        return "".join(out)
    out, at = [], 0
    for a, b, w in _pieces(entity, kind):
        like = entity[a:b]
        if w.isdigit():
            put = _house_number(w, key) if w.isascii() else like
        elif is_initial(w):
            put = _cased(initial(w, key), like)
        else:
            put = _cased(word_surrogate(w, key, turns.get(("word", w), 0)), like)
        out += (entity[at:a], put)
        at = b
    return "".join([*out, entity[at:]])


def items(entity: str, kind: str) -> list[tuple[str, str]]:
    """``(kind, key)`` of what must not be mixed up: the number, or the words."""
    if kind in ("phone", "id_number"):
        return [(kind, canonical(entity, kind))]
    return [("word", w) for _, _, w in _pieces(entity, kind) if not is_initial(w) and not w.isdigit()]


#: Turns after which numbers of a crowded form keep the plain permutation.
CROWDED = 24
#: Turns other than 0 that are sent to the workers as they are; more are joined to the documents.
MOST_TURNS = 200_000

_ITEMS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType())]))
_ITEMS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("key", pa.string())]))


@F.arrow_udf(_ITEMS)
def _items(cases: pa.Array) -> pa.Array:
    out = []
    for listed in cases.to_pylist():
        got = {x for c in listed or [] for x in items(c["entity"], c["kind"])}
        out.append([{"kind": k, "key": w} for k, w in got])
    return pa.array(out, _ITEMS_ARROW)


def _made_column(key: str):
    @F.arrow_udf(T.StringType())
    def made(kinds: pa.Array, keys: pa.Array, turns: pa.Array) -> pa.Array:
        return pa.array([word_surrogate(w, key, t) if k == "word" else number_surrogate(w, k, key, t) for k, w, t in zip(kinds.to_pylist(), keys.to_pylist(), turns.to_pylist())])

    return made


def _judged(now: DataFrame, real: DataFrame, made) -> DataFrame:
    """Whether each word's or number's replacement is a lesser one's too, or real."""
    tried = now.withColumn("made", made("kind", "key", "turn"))
    first = tried.groupBy("kind", "made").agg(F.min("key").alias("first"))
    return cut_lineage(
        tried.join(first, ["kind", "made"]).join(real, ["kind", "made"], "left")
        .select("kind", "key", "turn", ((F.col("key") != F.col("first")) | F.col("real").isNotNull()).alias("clash"))
    )


def turns_of(found: DataFrame, key: str, crowded: int = CROWDED) -> DataFrame:
    """``kind, key, turn`` of the words and numbers whose turn is not 0; one round after the other until nothing clashes."""
    made = _made_column(key)
    every = cut_lineage(found.select(F.explode(_items("cases")).alias("i")).select("i.kind", "i.key").distinct())
    real = every.select("kind", F.col("key").alias("made"), F.lit(True).alias("real"))
    form = F.regexp_replace(F.regexp_replace("key", "[0-9]", "0"), "[a-z]", "a").alias("form")
    now, last = every.withColumn("turn", F.lit(0)), None
    while True:
        judged = _judged(now, real, made)
        if last is not None:
            discard(last)
        left = judged.where("clash").agg(F.count("*").alias("n"), F.max(F.when(F.col("kind") != "word", F.col("turn"))).alias("turn")).first()
        if not left.n:
            return judged.where("turn > 0").select("kind", "key", "turn")
        now, last = judged, judged
        if (left.turn or 0) >= crowded:
            # numbers of these forms keep turn 0, which is distinct by itself
            full = judged.where((F.col("turn") >= crowded) & F.col("clash") & (F.col("kind") != "word")).select("kind", form).distinct()
            now = judged.select("*", form).join(full, ["kind", "form"], "left_anti")
        now = now.select("kind", "key", (F.col("turn") + F.col("clash").cast("int")).alias("turn"))


def surrogates(found: DataFrame, key: str, most: int = MOST_TURNS) -> DataFrame:
    """``found`` with ``puts``: for each of its cases the replacement.  ``found`` is read twice, so it should be a written table."""
    turns = cut_lineage(turns_of(found, key))
    more = F.lit(None).cast("array<struct<kind: string, key: string, turn: int>>")
    some = turns.limit(most + 1).collect()
    held = {} if len(some) > most else {(r.kind, r.key): r.turn for r in some}
    if len(some) > most:
        found = found.withColumn("row", F.monotonically_increasing_id())
        per_row = (
            found.select("row", F.explode(_items("cases")).alias("i")).select("row", "i.*").join(turns, ["kind", "key"])
            .groupBy("row").agg(F.collect_list(F.struct("kind", "key", "turn")).alias("more"))
        )
        found, more = found.join(per_row, "row", "left").drop("row"), F.col("more")
    shared = found.sparkSession.sparkContext.broadcast(held)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def puts(cases: pa.Array, more: pa.Array) -> pa.Array:
        out = []
        for listed, own in zip(cases.to_pylist(), more.to_pylist()):
            turns = {(x["kind"], x["key"]): x["turn"] for x in own} if own else shared.value
            out.append([surrogate(c["entity"], c["kind"], key, turns) for c in listed or []])
        return pa.array(out, pa.list_(pa.string()))

    return found.withColumn("puts", puts("cases", more)).drop("more")


@F.arrow_udf(T.StringType())
def _with_puts(texts: pa.Array, cases: pa.Array, puts: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), cases.to_pylist(), puts.to_pylist())
    return pa.array([t and rewritten(t, [(c["start_pos"], c["end_pos"], p) for c, p in zip(listed, put)]) for t, listed, put in rows], pa.string())


KEY = "notefathom"


def p8_found(spark: SparkSession, folder: str, key: str = KEY) -> DataFrame:
    """Every occurrence of personal information in the texts: the rows for which a replacement is made."""
    found = cut_lineage(detected(table(spark, folder, "documents"), table(spark, folder, "contacts")))
    rows = surrogates(found, key).select("doc_id", F.explode(F.arrays_zip("cases", "puts")).alias("c")).where(F.col("c.puts").isNotNull())
    return rows.select("doc_id", "c.cases.start_pos", "c.cases.end_pos", "c.cases.kind")


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The texts with typed placeholders."""
    return redacted(table(spark, folder, "documents"), table(spark, folder, "contacts"))


def p8_surrogates(spark: SparkSession, folder: str, key: str = KEY) -> DataFrame:
    """The texts with keyed replacements that look like what they stand for."""
    found = cut_lineage(detected(table(spark, folder, "documents"), table(spark, folder, "contacts"), texts=True))
    return surrogates(found, key).select("doc_id", _with_puts("text", "cases", "puts").alias("text"))
