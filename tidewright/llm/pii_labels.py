"""Labelled spans for training the tagger of problem 8.

The labels come from patterns over documents, so they are weak: the patterns know the given names, the parts of
surnames and street names, and the shapes of numbers that the training documents use. They are read only when a
tagger is trained; finding personal information in texts goes through the tagger.
"""

from __future__ import annotations

import re

TYPES = ("email", "phone", "id_number", "address", "name")

GIVEN = (
    "Aisha Alma Amara Anton Astrid Carlos Clara Daniel Dina Elena Emil Felix Freya Greta Hanna Henrik Hugo Ingrid Irene Ivan "
    "Jonas Julia Karim Kofi Leila Lena Lucia Lukas Marco Maria Mateo Mei Nadia Omar Oscar Pablo Paula Peter Priya Rafael Rosa "
    "Samuel Simon Sofia Stefan Tomas Victor Viktor Yuki Zara"
).split()
SURNAME = r"(?:Karb|Mell|Dray|Wex|Halv|Zabr|Sold|Quen|Osk|Torv|Fenn|Vint|Ped|Brisk|Lurr|Yost)(?:andro|idge|amont|iker|orane|uvar|ewick|ilho|tow|elund|osci|sby)"
STREET = r"(?:Mell|Thorn|Tann|Lint|Sorr|Pell|Ulm|Marr|Wick|Garl|Dunn|Hob)(?:bank|gate|croft|wood|mere|brook|field|ridge)"
COMPANY = r"(?:Freight|Haulage|Logistics|Shipping|Trading|Forwarding|Stevedores|Cold|Commodities|Agency|Warehousing|Transport|Lines|GmbH|Ltd|LLC|Co\.|B\.V|S\.A)"

_S = r"(?:-|,|\.)?\s+"
_SUR = rf"{SURNAME}(?:\s?-\s?{SURNAME})?"
_GIVEN = "(?:" + "|".join(GIVEN) + ")"
_INITIAL = r"[A-Z]\."
_NAME = re.compile(
    rf"(?<![\w@+.\-])(?:{_GIVEN}(?:\s+{_INITIAL})*\s+{_SUR}|(?:{_INITIAL}\s*)+{_SUR}|{_SUR},\s+(?:{_GIVEN}|{_INITIAL})(?:\s+{_INITIAL})*|{_SUR}|{_GIVEN})(?![\w@+]|[.\-]\w)", re.I
)
_NOT_BEFORE = re.compile(r"(?:\b(?:MV|MS|barge|vessel)\s+|&\s*|\+|@)$", re.I)
_NOT_AFTER = re.compile(rf"\s*(?:&|@|\s(?:{COMPANY}|at\s|\[at\]|\(at\)))|\s+{COMPANY}", re.I)

_LOCAL = r"[\w][\w.+\-]*"
_DOMAIN = r"[\w\-]+(?:\.[\w\-]+)*\.(?:example|test|invalid)(?:\.(?:com|org|net))?"
_EMAIL = re.compile(rf"{_LOCAL}\s?(?:@|\(at\)|\[at\]|\s+at\s+)\s?{_DOMAIN}|{_LOCAL}\s?(?:@|\(at\)|\[at\]|\s+at\s+)\s?[\w\-]+(?:\s?(?:\(dot\)|\[dot\]|\sdot\s|\.)\s?[\w\-]+)+", re.I)
_TLD = re.compile(r"example|test\b|invalid", re.I)

_P = r"[\s.\-/]{0,3}"
_PHONE = re.compile(
    rf"""(?<![\w.\-/])(?:
    (?:(?:\+|00)\s?44{_P}(?:\(0\))?{_P}|\(?0)20\)?{_P}7946{_P}0\d{{3}}
    |(?:(?:\+|00)\s?49{_P}(?:\(0\))?{_P}|\(?0)30\)?{_P}23125{_P}\d{{2,4}}
    |(?:(?:\+|00)\s?33{_P}(?:\(0\))?{_P}|\(?0)1{_P}99{_P}00{_P}\d\d{_P}\d\d
    |(?:(?:\+|00)?1{_P})?\(?(?:206|212|312|415|646|[2-9]\d\d)\)?{_P}555{_P}01\d\d
    )(?!\w)""",
    re.X,
)

_KEY = (
    r"(?:passport|passeport|pasaporte|reisepass(?:nummer)?|pass-nr|ppt|ssn|soc(?:ial|\.)?\s+sec(?:urity|\.)?|s[eé]curit[eé]\s+sociale|seguridad\s+social|sozialversicherungs(?:nummer|-nr)?"
    r"|tin|tax|steuer(?:-?id(?:nr)?|nummer)?|num[eé]ro\s+fiscal|nif|dni|nie|nin|ausweis(?:-?nr)?|personalausweis|carte|cni|identity\s+card|id\s+card|national\s+id|driver'?s?\s+id|driving\s+licen[cs]e|licen[cs]e|f[uü]hrerschein(?:-?nr)?|permis\s+de\s+conduire|permiso\s+de\s+conducir|\bid)"
)
_CODE = (
    r"(?:QQ\s*\d\d\s*\d\d\s*\d\d\s*[A-Z]|\d\d\.\d\d\.\d\d-\d{3}\.\d\d|\d{6}/\d{4}|9\d\d[-.\s]*\d\d[-.\s]*\d{4}|\d\d\s+\d{3}\s+\d{3}\s+\d{3}"
    r"|X-\d{7}-[A-Z]|DL-\d{3}-\d{4}|[A-Z]{1,2}\s*\d{7,8}|[A-Z]\d{11}|\d{7,12}[A-Z]?|[A-Z]{1,3}-\d[\d\-]{4,12}(?:-?[A-Z])?)"
)
_ID = re.compile(rf"\b{_KEY}\b[\s.]{{0,2}}(?:(?:id|card|no|number|nr|nummer|num[eé]ro|n[°ºo]|\#)?[\s.:\#]{{0,3}}){{0,3}}({_CODE})(?!\w)", re.I)

_ADDRESS = re.compile(
    rf"""(?<![\w])(?:
    \d+\s?[A-Z]?(?:\s?-\s?\d+)?\s+{STREET}\s+(?:Street|St|Road|Rd|Way|Lane|Avenue|Ave|Court|Ct|Close|Drive|Dr|Square|Terrace|Place)\b
    |\d+\s?(?:bis|ter)?,?\s+(?:rue|quai|avenue|boulevard|place|chemin|impasse|all[eé]e)\s+(?:de\s+|du\s+|des\s+)?{STREET}\b
    |(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|Ronda)\s*{STREET}\b
    |(?:rue|quai|avenue|boulevard|place|chemin|impasse|all[eé]e)\s+{STREET}\b
    |(?:(?:Am|An\s+der|Im|Zum|Zur)\s+)?{STREET}(?:stra(?:ß|ss)e|str\.?|weg|platz|gasse|allee|ring|damm|ufer)\s*\d+
    )""",
    re.X | re.I,
)


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the mentions in text, in order."""
    found: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in found)

    for m in _EMAIL.finditer(text):
        if _TLD.search(m.group()):
            found.append((*m.span(), "email"))
    for m in _ADDRESS.finditer(text):
        if free(*m.span()):
            found.append((*m.span(), "address"))
    for m in _ID.finditer(text):
        if free(*m.span(1)):
            found.append((*m.span(1), "id_number"))
    for m in _PHONE.finditer(text):
        if free(*m.span()):
            found.append((*m.span(), "phone"))
    for m in _NAME.finditer(text):
        if free(*m.span()) and not _NOT_BEFORE.search(text[max(0, m.start() - 12) : m.start()]) and not _NOT_AFTER.match(text, m.end()):
            found.append((*m.span(), "name"))
    return sorted(found)
