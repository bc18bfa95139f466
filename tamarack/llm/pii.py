"""Personal information inside free text: finding it, and replacing it by typed placeholders or by surrogates.

find_spans reads every text once, in Arrow batches; texts are never shuffled for the search. A replacement is keyed: an
HMAC of the entity's canonical form picks it, so one person, number or address gets one replacement in all records
(coreference), and a check over the distinct entities gives later ones of equal replacements another (distinctness).
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

KINDS = ("email", "phone", "id_number", "address", "name")
SPANS = "array<struct<start:int,end:int,kind:string,canon:string>>"

# fixed values: words and patterns of the search
_STREET = r"(?:street|st|avenue|ave|road|rd|lane|ln|drive|dr|court|ct|close|row|way|place|pl|square|sq|terrace|crescent|boulevard|blvd|hill|grove|gardens|parade|quay|mews)"
_COMMON = frozenset(
    """a about above after again all also always am an and another any anybody anyone anything are as ask at away back bad be because been before being best better both but by call came can
cannot check come could customer customers day days did do does done down each early either else email end error even ever every everybody everyone everything few file find first fix for found free from get give
go goes going good got had has have he help her here hers him his how i if in into is it its just keep know last late later left less let like list little long look lot made mail make many may me
means might mine month more most much must my name need never new next no nobody none not nothing now number of off office old on once one only open or order other others our out over own page
part people person phone plan please problem put read really right said same saw say see sent several she should show since so some somebody someone something still stop such support sure take team tell than thank thanks that the
their them then there these they thing this those though through time to today together too two under until up us use used user very via was way we week well went were what when where which while who whole why will with work works
would year yes yesterday yet you your zwei kunden der die das ein eine mit von und hat ich wir les des une avec pour dans los las una con para por que""".split()
)
_NOT_NAME = frozenset("plan plans ledger point account tier edition version app street road avenue lane drive court close row way place inc llc ltd gmbh monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december spring summer autumn winter german french spanish english edit support post comment".split())
_NOT_STREET = frozenset("a an and are as at be but by for from had has have he her his i if in is it its just me my no not of on or our out she so than that the their them then there these they this those to was we were when which who will with you your days hours minutes people users clients tickets times votes".split())
# fixed values: frequent given names, f for women and m for men
_GIVEN_F = frozenset(
    """aisha alice ana anna anja amina amy beatriz birgit camille carla carmen caroline catherine charlotte chiara chloe claire clara daniela elena elif elisa elizabeth ella emily emma eva fatima fiona
    francesca frida gabriela giulia grace hannah helen helena ingrid irina isabel jana jane jennifer jessica joanna johanna julia karen karin kate katharina laura lea lena leonie linda lucia lucy maria marie marta mary megan
    mei mia michelle monika nadia natalia nina noor olga olivia patricia petra priya rachel rebecca rosa ruth sabine sara sarah silvia sofia sophie susan svetlana ursula valentina yuki zoe""".split()
)
_GIVEN_M = frozenset(
    """adam ahmed alejandro alexander ali andreas andrew antoine antonio arjun ben bernd bjorn björn carlos charles christian christopher daniel dave david diego dieter dmitri edward emil emmanuel erik ethan fernando francisco
    frank george giovanni hans harry hassan henry hiroshi igor ivan jack jakob james jan javier jens johan john jonas jorge jose josé joseph juan jurgen jürgen karl kevin klaus lars leon liam luca lucas luis lukas manuel marco mark markus martin
    matteo matthew michael miguel mohamed mohammed nicolas oliver omar oscar pablo patrick paul pedro peter philipp pierre rafael rajesh robert sanjay sergei stefan stephen steven thomas tim tom viktor wei william wolfgang""".split()
)
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Señor|Señora|Monsieur|Madame)"
#: What stands right before a person's name, and what may have to follow where the cue alone says little.
_BEFORE = {
    "regards,": None, "best,": None, "cheers,": None, "ich heiße": None, "je m'appelle": None, "me llamo": None, "doctor": None, "lawyer": None, "teacher": None, "landlord": None, "sincerely,": None, "best wishes,": None, "greetings,": None, "yours,": None, "grüße,": None, "cordialement,": None, "saludos,": None, "row read:": None, "assigned to": None, "signed by": None, "refund to": None, "made out to": None,
    "spoke to": None, "spoke with": None, "talked to": None, "talk to": None, "thanks to": None, "thank you to": None, "ask for": None, "asked for": None, "neighbour": None, "neighbor": None, "colleague": None, "coworker": None, "new hire,": None, "boss": None,
    "my name is": None, "named": None, "meet": None, "contacted": None, "credit to": None, "invoice to": None, "addressed to": None, "written by": None, "reported by": None, "attn:": None, "attention:": None, "name:": None, "contact person": None,
    "merged": r"\s+(?:with|and|into)\b", "lists": r"\s+as\b", "pay": r"\s+(?:to|for)\b", "paid": r"\s+(?:to|for)\b", "reason": r"\s+(?:shows|is|appears|was|has)\b", "i am": r"\s*(?:,|\.|\band\b)", "this is": r"\s*(?:,|\bfrom\b)", "then": r"\s+(?:called|wrote|said|came|left|quit|asked|told|rang)\b",
    "yesterday": r"\s+(?:called|wrote|said|came|left|quit|asked|told|rang)\b", "today": r"\s+(?:called|wrote|said|came|left|quit|asked|told|rang)\b", "manager": r"\s*(?:,|\bhas\b|\bsaid\b)", "owner": r"\s*(?:,|\bhas\b|\bsaid\b)",
}
_CUES = tuple(_BEFORE)

_AT = r"(?:\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+)"
_DOT = r"(?:\.|\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+)"
_EMAIL = re.compile(r"[\w.+%-]+@(?:[\w-]+\.)+[A-Za-z]{2,}(?![\w@])")
_DOT_WORD = r"(?:\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+)"
_EMAIL_HIDDEN = (
    re.compile(rf"(?i)(?<![\w.+%-])[\w+%.-]+(?:{_DOT_WORD}[\w+%-]+)*\s*(?:@|[\[({{<]\s*at\s*[\])}}>])\s*[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[a-z]{{2,}}\b"),
    re.compile(rf"(?i)(?<![\w.+%-])[\w+%.-]+(?:{_DOT_WORD}[\w+%-]+)*\s+at\s+[\w-]+(?:{_DOT_WORD}[\w-]+)*{_DOT_WORD}[a-z]{{2,}}\b(?!{_AT})"),
)
_PHONE = re.compile(r"(?<![\w.@/#:+-])(?:(?:tel:|phone:)\s*)?(\+?\(?\d[\d\s().\-/]{5,22}\d)(\s*(?:ext\.?|x|extension)\s*\d{1,6})?(?![\w@]|[-.]\d)", re.I)
_NOT_PHONE = re.compile(r"(?i)(?:\b(?:order|orders|part|item|invoice|ticket|case|build|version|release|server|serial|sku|ref|reference|id|no|nr|number of|code|batch|inc|rows|happened at|tracking|account|job wrote|article|model|parcel)\b[\s.:#]*)$")
_NOT_PHONE_AFTER = re.compile(r"(?i)\s*(?:is the affected|rows\b|items?\b|is still open|has it too|times\b|records\b|entries\b|px\b|kb\b|mb\b)")
_ID = re.compile(
    r"(?i)(?:\b(?:ssn|social security(?: number| no\.?)?|social(?: insurance)?(?: number| no\.?)?|national insurance(?: number| no\.?)?|ni (?:no\.?|number)|nino|passports?(?: number| no\.?)?|(?:national )?id card(?: number| no\.?)?|identity card(?: number| no\.?)?|"
    r"tax (?:id|number|no\.?|identification number)|tin|driver'?s?,? licen[cs]e(?: number| no\.?)?|driving licen[cs]e(?: number| no\.?)?|licen[cs]e(?: number| no\.?)?|insurance number|personal(?: id)? number|nie|dni|nif|steuer-?id(?:entifikationsnummer)?|steuernummer|ausweis(?:nummer)?|reisepass(?:nummer)?|"
    r"cpf|aadhaar(?: number| no\.?)?|curp|pesel|bsn|nhs number|codice fiscale|personnummer|personalausweis(?:nummer)?|sozialversicherungsnummer|numéro de sécurité sociale|sécurité sociale|passeport|pasaporte|carte d'identité)\b(?:\s+(?:on file|is|was|of mine))?[\s,:;.#-]{0,3})([A-Z]{0,6}[ -]?\d[A-Z0-9]*(?:[ -][A-Z0-9]*\d[A-Z0-9]*|[ -][A-Z](?![a-zA-Z]))*)"
)
_ID_SHAPES = re.compile(r"\b(?:[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[XYZ]\d{7}[A-Z]|\d{3}\.\d{3}\.\d{3}-\d{2})\b")
_SSN = re.compile(r"(?i)\bmy (?:number|social)[^.!?\n]{0,20}?(\d{3}-\d{2}-\d{4})")
_ADDRESS = (
    re.compile(rf"(?i)(?:\b(?:flat|apt\.?|unit|suite|apartment)\s*\d+\w?,?\s+)?\b\d{{1,5}}[a-z]?\s+((?:[^\W\d_][\w'’.-]*\s+){{1,3}}){_STREET}\b\.?((?:,?\s*(?:apt\.?|unit|flat|suite|apartment)\s*\d+\w?)?)"),
    re.compile(r"(?i)\b\d{1,4}\s*(?:bis|ter|quater)?,?\s+(?:rue|avenue|boulevard|place|chemin|allée|quai|impasse|route|cours)\s+(?:(?:de|du|des|la|le|les|l'|d'|saint|sainte)\s*)*[^\W\d_][\w'’-]*(?:\s+[A-ZÉÈ][\w'’-]*)?"),
    re.compile(r"\b(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Beim|Unter den)\s+[A-ZÄÖÜ][\wäöüß-]+\s+\d{1,4}(?:\s?[a-z]\b)?\b(?!\s*(?:Uhr|Prozent|Euro))", re.I),
    re.compile(r"\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|graben|ufer|damm|steig|chaussee)\s+\d{1,4}(?:\s?[a-z]\b)?\b", re.I),
    re.compile(r"(?i)\b(?:calle|c/|avenida|avda\.?|plaza|paseo|carrer|camino|via|viale|piazza|corso)\s+(?:(?:de|del|la|las|los|el|di|della)\s+)*[^\W\d_][\w'’-]*(?:\s+[A-Z][\w'’-]*)?,?\s*(?:n[º°o]\.?\s*)?\d{1,4}\b"),
)
#: A pattern is only tried on a text that holds one of these, as each match must.
_NEED_ID = ("ssn", "social", "insurance", "ni no", "ni number", "nino", "passport", "id card", "identity", "tax", "tin", "licen", "personal", "nie", "dni", "nif", "steuer", "ausweis", "pass", "sécurité", "carte", "pasaporte", "sozial", "cpf", "aadhaar", "curp", "pesel", "bsn", "nhs", "codice", "personnummer")
_NEED_ADDRESS = (
    ("st", "av", "ro", "rd", "la", "dr", "ct", "court", "cl", "way", "pl", "sq", "terrace", "crescent", "b", "hill", "g", "parade", "quay", "mews"),
    ("rue", "avenue", "boulevard", "place", "chemin", "allée", "quai", "impasse", "route", "cours"),
    ("am ", "an de", "auf de", "im ", "in der", "zum ", "zur ", "beim ", "unter den"),
    ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ring", "graben", "ufer", "damm", "steig", "chaussee"),
    ("calle", "c/", "avenida", "avda", "plaza", "paseo", "carrer", "camino", "via", "piazza", "corso"),
)
_DIGIT = re.compile(r"\d")
_PLACE = re.compile(r"(?i)(?:\n[A-ZÄÖÜ][\w-]+,\s*[A-Z]{2}\s+\d{5}|[,/]?\s*(?:in\s+)?\d{5}\s+[A-ZÄÖÜ][\w-]+|(?:\s*[,/]\s*|\s+in\s+)[A-ZÄÖÜ][\w-]+(?:,\s*[A-Z]{2}\s+\d{5}|\s+[A-Z]{1,2}\d{1,2}[A-Z]?\s+\d[A-Z]{2})?)")
_CAP = r"[A-ZÀ-ÖØ-ÞŠŽ][\w'’]+(?:-[A-ZÀ-ÖØ-ÞŠŽ][\w'’]+)?"
_NAME_TITLE = re.compile(rf"\b{_TITLE}\.?(?:\s+{_CAP}){{1,4}}")
_NAME_GIVEN = re.compile(rf"(?<![\w@./+-])({_CAP})((?:\s+[A-ZÀ-Þ]\.)*)\s+((?:(?:de|da|di|del|dos|van|von|der|den|bin|al|el|la|ten)\s+)*{_CAP}(?:\s+{_CAP})?)(?![\w@])")
_NAME_CYRILLIC = re.compile(r"(?<!\w)([А-ЯЁ][а-яё]+)\s+([А-ЯЁ][а-яё]*(?:ов|ова|ев|ева|ёв|ёва|ин|ина|ын|ына|ский|ская|цкий|цкая|енко|чук|ович|евич))(?!\w)")
_NAME_CAP = re.compile(rf"(?<![\w@./+-])({_CAP})(,?\s+(?:[A-ZÀ-Þ]\.\s*)*)({_CAP})(?![\w@])")
_NAME_LOW = re.compile(r"\s+([^\W\d_]{3,}(?:-[^\W\d_]{3,})?),?\s+(?:[a-z]\.\s*)?([^\W\d_]{3,}(?:-[^\W\d_]{3,})?)(?![\w@])")
_WORDS = re.compile(r"\S+")
_NEXT_WORD = re.compile(r"\s+([^\W\d_]+)")
_GIVEN = _GIVEN_F | _GIVEN_M
_END = re.compile(r"[.!?…:\n>*\"(]\s*$")


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def _is_phone(raw: str) -> bool:
    raw = re.sub(r"(?i)^(?:tel:|phone:)\s*", "", raw.strip())
    d = _digits(raw)
    if raw.startswith("+") or raw.startswith("(+"):
        return 8 <= len(d) <= 15
    if d.startswith("00") and not re.match(r"00\s\d{3}\s\d{3}\s\d{3}$", raw):
        return 10 <= len(d) <= 16 and not d.startswith("000")
    if d.startswith("0"):
        return 9 <= len(d) <= 12 and bool(re.match(r"\(?0[1-9]", raw)) and not re.match(r"0\d[./-]\d\d[./-]", raw)
    if len(d) == 11 and d[0] == "1" and re.match(r"1[\s.(-]", raw):
        d, raw = d[1:], raw[1:].lstrip(" .-")
    shape = re.match(r"(?:\(\d{3}\)\s*|\d{3}[\s.-])\d{3}[\s.-]\d{4}$|\d{10}$", raw)
    return bool(shape) and d[0] in "23456789" and d[3] in "23456789"


def _good(word: str) -> bool:
    w = word.lower().strip("'’.-")
    return len(w) >= 3 and w not in _COMMON and w not in _NOT_NAME and not w.isdigit()


def _email_canon(s: str) -> str:
    s = re.sub(rf"(?i){_DOT}", ".", s.strip())
    return re.sub(rf"(?i)\s*@\s*|{_AT}", "@", s).lower()


def spans(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of everything personal in the text, in order, without overlaps."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a few letters change length when lower-cased
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []

    def free(s: int, e: int) -> bool:
        return all(e <= a or s >= b for a, b in taken)

    def add(s: int, e: int, kind: str, canon: str) -> None:
        out.append((s, e, kind, canon))
        taken.append((s, e))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            if free(*m.span()):
                add(*m.span(), "email", m.group().lower())
    if "at" in low and ("dot" in low or "(at" in low or "[at" in low or "{at" in low or "<at" in low) or " @ " in text:
        for m in (m for rx in _EMAIL_HIDDEN for m in rx.finditer(text)):
            if free(*m.span()) and not re.search(r"\d\s*@\s*\d", m.group()):
                add(*m.span(), "email", _email_canon(m.group()))
    digits = len(_DIGIT.findall(text))
    if digits:
        if digits >= 5 and any(w in low for w in _NEED_ID):
            for m in _ID.finditer(text):
                s, e = m.span(1)
                v = m.group(1)
                if sum(c.isdigit() for c in v) >= 5 and free(s, e):
                    add(s, e, "id_number", re.sub(r"[\s-]", "", v).upper())
        for rx, g in ((_ID_SHAPES, 0), (_SSN, 1)) if digits >= 6 else ():
            for m in rx.finditer(text):
                if free(*m.span(g)):
                    add(*m.span(g), "id_number", re.sub(r"[\s-]", "", m.group(g)))
        for k, rx in enumerate(_ADDRESS):
            for m in rx.finditer(text) if any(w in low for w in _NEED_ADDRESS[k]) else ():
                s, e = m.span()
                if not free(s, e):
                    continue
                if k == 0 and any(w.lower().strip(".'’") in _NOT_STREET for w in m.group(1).split()):
                    continue
                if p := _PLACE.match(text, e):
                    if p.group().lstrip(" ,/").split()[0].lower() not in _COMMON or re.match(r"\s+in\s", p.group()):
                        e = p.end()
                add(s, e, "address", re.sub(r"[\W_]+", " ", text[s:e].lower()).strip())
        for m in _PHONE.finditer(text) if digits >= 7 else ():
            s, e = m.span()
            if free(s, e) and _is_phone(m.group(1)) and not _NOT_PHONE.search(text, max(0, s - 24), s) and not _NOT_PHONE_AFTER.match(text, e):
                add(s, e, "phone", _digits(m.group(1)))

    def name(s: int, e: int, given: str, family: str) -> None:
        if free(s, e):
            add(s, e, "name", f"{given} {family}".lower().strip())

    for m in _NAME_TITLE.finditer(text):
        parts = m.group().split()
        n = next((i for i, w in enumerate(parts[1:], 1) if not _good(w)), len(parts))
        if n > 1:  # as far as the words can be a name's
            end = m.start() + [x.end() for x in _WORDS.finditer(m.group())][n - 1]
            name(m.start(), end, " ".join(parts[1 : n - 1]), parts[n - 1])
    for m in _NAME_GIVEN.finditer(text):
        if m.group(1).lower() in _GIVEN:
            words = m.group(3).split()
            n = next((i for i, w in enumerate(words) if w[0].isupper() and not _good(w)), len(words))
            while n and words[n - 1].islower():
                n -= 1
            if n and m.group(1).isupper() == words[0].isupper():
                end = m.start(3) + [x.end() for x in _WORDS.finditer(m.group(3))][n - 1]
                nxt = _NEXT_WORD.match(text, end)
                if not (nxt and nxt.group(1).lower() in _NOT_NAME):
                    name(m.start(), end, m.group(1), " ".join(words[:n]))
    for m in _NAME_CYRILLIC.finditer(text) if "в" in low or "и" in low or "о" in low else ():
        name(*m.span(), m.group(1), m.group(2))
    cued = [(i + len(c), c) for c in _CUES if c in low for i in _places(low, c)]
    at = {}
    for i, c in cued:
        j = i
        while j < len(text) and text[j] in " \t\n>*_\"'":
            j += 1
        if text[j : j + 2] == ", " and (m := _NAME_LOW.match(text, j + 1)) and m.group(1) in _GIVEN:
            j += 2  # "my doctor, sarah connor": only a known given name follows a comma
        at[j] = c
    pos = 0
    while m := _NAME_CAP.search(text, pos):
        pos = m.end(1)  # the second word may begin the next pair
        s, e = m.span()
        a, b = m.group(1), m.group(3)
        comma = m.group(2).startswith(",")
        if not (_good(a) and _good(b)) or (a.isupper() != b.isupper()):
            continue
        nxt = re.match(r"\s+([^\W\d_]+)", text[e : e + 24])
        if nxt and nxt.group(1).lower() in _NOT_NAME:
            continue
        cue = at.get(s)
        if cue is not None:
            rest = _BEFORE[cue]
            if rest and not re.match(rest, text[e : e + 16]):
                continue
        else:
            if comma or a.isupper() or len(a) < 3 or len(b) < 4:
                continue
            before = text[:s]
            if not before or _END.search(before) or re.search(r"[\d,/]\s*$|\b(?:in|at|the|a|an|der|die|das|den|dem|mit|von|bei|le|la|les|el|los|las|rue|plan)\s*$", before, re.I):
                continue
            if re.search(r"[äöüß]|\b(?:und|ist|nicht|der|die|das)\b", low):
                continue
        if free(s, e):
            name(s, e, b if comma else a, a if comma else b)
            pos = e
    for j, c in at.items():
        if not (j < len(text) and text[j].islower()):
            continue
        m = _NAME_LOW.match(" " + text[j : j + 80])
        if not m or not (_good(m.group(1)) and _good(m.group(2))) or not (m.group(2).islower()):
            continue
        e = j + m.end() - 1
        rest = _BEFORE[c]
        follow = text[e : e + 40]
        if rest and not re.match(rest, follow):
            continue
        if not rest and not re.match(r"\s*(?:$|[,.;:!?(\n])|\s+(?:and|by|for|from|when|has|with|cannot|on|in|about|again|please|who|as)\b", follow):
            continue
        name(j, e, m.group(1), m.group(2))
    return sorted(out)


def _places(low: str, cue: str) -> Iterator[int]:
    i = low.find(cue)
    while i >= 0:
        if i == 0 or not low[i - 1].isalnum():
            yield i
        i = low.find(cue, i + 1)


def find_spans(rows: DataFrame, keep_text: bool = False) -> DataFrame:
    """rows: tab, row_id, text. The rows whose text holds something personal, with their spans (start and end in characters).

    Null and empty texts hold nothing; a text is read whole; repeated rows come out repeatedly; no rows give none.
    """
    names = ["tab", "row_id", "spans"] + (["text"] if keep_text else [])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("canon", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [spans(t) for t in b.column("text").to_pylist()]
            at = pa.array([i for i, g in enumerate(got) if g], pa.int32())
            found = pa.array([[dict(zip(("start", "end", "kind", "canon"), s)) for s in g] for g in got if g], kind)
            cols = [b.column("tab").take(at), b.column("row_id").take(at), found] + ([b.column("text").take(at)] if keep_text else [])
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = rows.select(F.col("tab").cast("string").alias("tab"), F.col("row_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text")).where("text is not null and text != ''")
    return rows.mapInArrow(scan, f"tab string, row_id long, spans {SPANS}" + (", text string" if keep_text else ""))


# fixed values: what stays of an address, and country codes of one and two digits
_KEPT = frozenset("street st avenue ave road rd lane ln drive dr court ct close row way place pl square sq terrace crescent boulevard blvd hill grove gardens parade quay mews flat apt unit suite apartment in am an der den auf dem im zum zur beim unter rue chemin allée quai impasse route cours de du des la le les l d saint sainte bis ter quater calle c avenida avda plaza paseo carrer camino via viale piazza corso del las los el di della n nº no".split())
_COMPOUND = re.compile(r"(?i)(straße|strasse|weg|gasse|platz|allee|ring|graben|ufer|damm|steig|chaussee)$")
_COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Sra", "Señora", "Madame")
_MALE = ("Mr", "Herr", "Sr", "Señor", "Monsieur")
_ON, _VOWEL = "bdfgklmnprstv", "aeiou"
_TOKENS = re.compile(r"[^\W\d_]+|\d+")


def _stream(key: bytes, kind: str, canon: str, attempt: int) -> Iterator[int]:
    n = 0
    while True:
        yield from hmac.new(key, f"{kind}\0{canon}\0{attempt}\0{n}".encode(), hashlib.sha256).digest()
        n += 1


def _syllables(r: Iterator[int], n: int, script: str = "latin") -> str:
    s = "".join(_ON[next(r) % len(_ON)] + _VOWEL[next(r) % 5] for _ in range(n))
    if script == "cyrillic":
        s = s.translate(str.maketrans(_ON + _VOWEL, "бдфгклмнпрствaеиоу".replace("a", "а")))
    if script == "greek":
        s = s.translate(str.maketrans(_ON + _VOWEL, "βδφγκλμνπρστβαειου"))
    return s


def _script(s: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", s) else "greek" if re.search("[Ͱ-Ͽ]", s) else "latin"


def _stays(word: str) -> bool:
    """Kinds of street, units, prepositions and codes of states and post districts."""
    return word.isalpha() and (len(word) <= 2 or word.lower() in _KEPT)


def gender(given: str, title: str = "", family: str = "") -> str:
    """f, m or empty: by the title, else by the list of given names, else by the ending of a Slavic family or Romance given name."""
    t = title.rstrip(".")
    g = given.lower().split()[0] if given.split() else ""
    if t in _FEMALE or g in _GIVEN_F:
        return "f"
    if t in _MALE or g in _GIVEN_M:
        return "m"
    if _script(family) == "cyrillic":
        return "f" if family[-1:] in ("а", "я") else "m"
    return "f" if g[-1:] == "a" else ""


def units(kind: str, found: str, canon: str) -> list[tuple[str, str]]:
    """What of a find is replaced by itself, so that it is the same wherever it stands: the parts of a name (given names carry their
    gender; a family name is one unit in "Ms X" and in "Lena X"), else the whole."""
    if kind != "name":
        return [(kind, canon)]
    title = m.group(1) if (m := re.match(rf"({_TITLE})\b", found)) else ""
    words = [w for w in found[len(title) :].replace(",", " ").split() if w.strip(".")]
    if not words:
        return []
    family = canon.split()[-1]
    out = []
    for w in words:
        low = w.lower().strip(".'’")
        if len(low) <= 1 or (w.islower() and not found.islower()):
            continue  # initials and particles stay
        out.append(("family", low) if low == family else (f"given{gender(low, title, family)}", low))
    return out


def surrogate(kind: str, canon: str, key: bytes, attempt: int = 0) -> str:
    """A made-up unit of the same kind in canonical form, of the same gender, script and shape. Later attempts are longer where the
    shape allows, so that there is always another."""
    r = _stream(key, kind, canon, attempt)
    more = attempt // 8
    script = _script(canon)
    if kind == "email":
        return f"{_syllables(r, 3 + more)}.{_syllables(r, 3)}@{_syllables(r, 3)}.invalid"
    if kind in ("phone", "id_number"):
        return "".join(str(next(r) % 10) if c.isdigit() else chr(65 + next(r) % 26) if c.isalpha() else c for c in canon)
    if kind == "address":  # words by the order in which they come; what names a kind of street or a place in a phrase stays
        out = []
        for w in _TOKENS.findall(canon):
            if w.isdigit():
                out.append("".join(str(1 + next(r) % 9) if i == 0 else str(next(r) % 10) for i in range(len(w) + more // 4)))
            elif _stays(w):
                out.append(w)
            else:
                end = m.group(1) if (m := _COMPOUND.search(w)) and m.start() else ""
                out.append(_syllables(r, max(2, min(5, len(w[: len(w) - len(end)]) // 2)) + more, script) + end)
        return " ".join(out)
    if kind == "family":
        stem = _syllables(r, 3 + more, script)
        return stem[:-1] + ("ова" if canon.endswith(("а", "я")) else "ов") if script == "cyrillic" else stem
    ends = {"f": {"latin": "a", "cyrillic": "а", "greek": "α"}, "m": {"latin": "n", "cyrillic": "н", "greek": "ν"}}.get(kind[5:], {})
    stem = _syllables(r, 2 + more, script)
    return (stem[:-1] if kind == "givenf" else stem) + ends.get(script, "")


def _cased(made: str, like: str) -> str:
    return made.upper() if like.isupper() and len(like) > 1 else made if like.islower() else made.capitalize()


def dress(found: str, kind: str, made: dict[tuple[str, str], str], canon: str) -> str:
    """The find with its units replaced in its own format: digit grouping and country code, letter case, order, title, hidden email."""
    if kind == "name":
        title = m.group(1) if (m := re.match(rf"({_TITLE})\b", found)) else ""
        by = {low: v for (_, low), v in made.items()}
        body = re.sub(r"[^\s,]+", lambda w: _cased(by[k], w.group()) if (k := w.group().lower().strip(".'’")) in by else w.group(), found[len(title) :])
        return title + body
    new = made[kind, canon]
    if kind == "email":
        if "@" not in found:
            new = new.replace("@", " at ").replace(".", " dot ") if " at " in found.lower() else new.replace("@", " [at] ").replace(".", "[dot]")
        return new.upper() if found.isupper() else new
    if kind == "address":
        it = iter(new.split())
        return _TOKENS.sub(lambda w: w.group() if _stays(w.group()) else _cased(x, w.group()) if (x := next_other(it, w.group())) else w.group(), found)
    body, it, out, kept = found, iter(new), [], 0
    if kind == "phone" and (m := re.match(r"(?i)(?:tel:|phone:)?\s*\(?(?:\+|00)\s*", found)):
        cc = _COUNTRY.match(found, m.end()) or re.compile(r"\d{1,3}").match(found, m.end())
        kept = cc.end() if cc else m.end()  # the country stays
    for i, c in enumerate(body):
        if c.isdigit() or (kind == "id_number" and c.isalnum()):
            x = next(it, "0")
            out.append(c if i < kept else x)
        else:
            out.append(c)
    return "".join(out)


def next_other(it: Iterator[str], like: str) -> str | None:
    """The next replaced word or number of the same sort."""
    for x in it:
        if _stays(x):
            continue
        if x.isdigit() == like.isdigit():
            return x
    return None


#: Attempts in which real entities of the corpus are avoided, and attempts in all; a kind that needs more has too few shapes.
REAL_ATTEMPTS, ATTEMPTS = 12, 200


def _assign(entities: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """entities: kind, canon, distinct. Adds made; of one kind none is shared. None is a real entity of the corpus either, unless
    REAL_ATTEMPTS show that the shape has hardly others (numbers of few digits); it is never the entity's own. What is settled
    is written once; only those that collide try again, until none is left."""

    def at(attempt: int):
        @F.pandas_udf("string")
        def make(kind: pd.Series, canon: pd.Series) -> pd.Series:
            return pd.Series([surrogate(k, c, key, attempt) for k, c in zip(kind, canon)], dtype=object)

        return make

    family = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind"))  # given names of all genders share one set
    todo = scratch.write(entities.withColumn("sort", family), "entities")
    real = todo.select("sort", F.col("canon").alias("made")).distinct()
    settled: list[DataFrame] = []
    for attempt in range(ATTEMPTS):
        tried = todo.withColumn("made", at(attempt)("kind", "canon"))
        free = tried.join(real, ["sort", "made"], "left_anti") if attempt < REAL_ATTEMPTS else tried.where("made <> canon")
        for d in settled:
            free = free.join(d.select("sort", "made"), ["sort", "made"], "left_anti")
        won = free.groupBy("sort", "made").agg(F.min(F.struct("canon", "kind")).alias("w")).select("sort", "made", "w.kind", "w.canon")
        won = scratch.write(won, "settled")
        todo = scratch.write(todo.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"), "open")
        settled.append(won)
        if len(settled) > 4:  # few tables to look into
            settled = [scratch.write(reduce(DataFrame.unionByName, settled), "settled")]
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, settled).select("kind", "canon", "made")
    raise ValueError(f"no distinct surrogates left for some entities after {ATTEMPTS} attempts")


def redact(rows: DataFrame, key: bytes, surrogates: bool = True) -> DataFrame:
    """(tab, row_id, kinds, redacted, surrogate) of the records that hold something personal, one row for each distinct text of a
    record. kinds has the kinds found.

    redacted has a typed placeholder such as [NAME] for each find; surrogate a made-up entity in its format, of the same gender and
    script: one person, number or address gets one in all records, no two share one, and none is a real one of the corpus. key is
    a secret of the caller. Without surrogates that column is null. Records without finds are left out, no rows give none.
    """
    scratch = Scratch(rows.sparkSession, "pii")
    found = scratch.write(find_spans(rows, keep_text=True).dropDuplicates(["tab", "row_id", "text"]), "found")
    kinds = F.array_distinct("spans.kind").alias("kinds")

    @F.pandas_udf("string")
    def blank(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_replaced(t, sp, [f"[{x['kind'].upper()}]" for x in sp]) for t, sp in zip(text, found)], dtype=object)

    if not surrogates:
        return found.select("tab", "row_id", kinds, blank("text", "spans").alias("redacted"), F.lit(None).cast("string").alias("surrogate"))

    @F.pandas_udf("array<struct<kind:string,canon:string>>")
    def parts(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "canon": c} for x in sp for k, c in units(x["kind"], t[x["start"] : x["end"]], x["canon"])] for t, sp in zip(text, found)], dtype=object)

    each = scratch.write(found.select("tab", "row_id", F.xxhash64("text").alias("th"), F.explode(parts("text", "spans")).alias("u")).select("tab", "row_id", "th", "u.kind", "u.canon").distinct(), "units")
    made = _assign(each.select("kind", "canon").distinct(), key, scratch)
    back = each.join(made, ["kind", "canon"]).groupBy("tab", "row_id", "th").agg(F.collect_list(F.struct("kind", "canon", "made")).alias("made"))  # a text's own

    @F.pandas_udf("string")
    def write(text: pd.Series, found: pd.Series, made: pd.Series) -> pd.Series:
        out = []
        for t, sp, m in zip(text, found, made):
            by = {(x["kind"], x["canon"]): x["made"] for x in (m if m is not None else [])}
            new = []
            for x in sp:
                f = t[x["start"] : x["end"]]
                new.append(dress(f, x["kind"], {u: by[u] for u in units(x["kind"], f, x["canon"]) if u in by}, x["canon"]))
            out.append(_replaced(t, sp, new))
        return pd.Series(out, dtype=object)

    whole = found.withColumn("th", F.xxhash64("text")).join(back, ["tab", "row_id", "th"], "left")
    return whole.select("tab", "row_id", kinds, blank("text", "spans").alias("redacted"), write("text", "spans", "made").alias("surrogate"))


def _replaced(text: str, spans_: list, new: list[str]) -> str:
    out, last = [], 0
    for s, n in zip(spans_, new):
        out += [text[last : s["start"]], n]
        last = s["end"]
    return "".join(out) + text[last:]
