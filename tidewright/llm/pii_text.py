"""Training text of problem 8: names, streets, numbers and addresses made by rule, in made sentences and in documents.

Half of all names and streets are common ones, half are put together from syllables, so that the tagger has to go by
shape and surroundings. A document is a template: what `pii_labels` finds in it, and every other place where one of
its words stands (companies, vessels), is filled with made content each time it is read, so no name, street, number or
mail domain of the documents is ever seen in training.
"""

from __future__ import annotations

import re

import numpy as np

from .pii_labels import GIVEN, STREET, SURNAME, TYPES, spans

_GIVEN = (
    "James Mary Robert Patricia John Jennifer David Linda William Susan Joseph Karen Thomas Nancy Charles Lisa Matthew Betty Andrew Helen Kenneth Laura "
    "George Emma Edward Alice Brian Grace Kevin Ruth Jason Amy Eric Diane Jürgen Klaus Dieter Heike Sabine Monika Petra Jörg Uwe Birgit Katrin Markus "
    "Ulrich Anke Pierre Jean Michel Louise Camille Chloé Antoine Luc Hélène Sylvie Benoît Céline Mathieu Amélie José Manuel Carmen Lucía Javier Dolores "
    "Alejandro Pilar Raúl Inés Joaquín Teresa Ahmed Fatima Hassan Ling Wei Hiroshi Sakura Olga Dmitri Piotr Agnieszka Giulia Luca Giovanni João Ana Nkechi "
    "Kwame Ravi Anita Deepak Sven Björn Lars Maja Erik Kirsten Aoife Liam Niamh Owen"
).split()
_FAMILY = (
    "Smith Brown-Lee Jones Taylor Davies Evans Walker Wright Robinson Thompson White Hughes Edwards Green Hall Clarke Harris O'Brien McDonald Murphy Kelly "
    "Müller Schmidt Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Vogel Lehmann "
    "Martin Bernard Dubois Moreau Laurent Lefebvre Leroy Roux Girard Fournier Lambert Rousseau Blanc Guérin Faure Chevalier García Fernández López Martínez "
    "Sánchez Pérez Gómez Ruiz Díaz Moreno Álvarez Romero Navarro Torres Ramos Ortega Castillo Rossi Russo Bianchi Silva Santos Nguyen Tran Kim Park Chen "
    "Wang Liu Yamamoto Sato Suzuki Singh Patel Kumar Khan Ali Novak Kowalski Nowak Ivanova Petrov Jensen Nielsen Hansen Larsson Okafor Mensah Diallo"
).split()
_STREET = (
    "Church Park Mill Station High Victoria Green Queens Chapel London York Albert Castle North Elm Oak Maple Cedar Pine Washington Lincoln Linden Schiller "
    "Goethe Bahnhof Schul Kirch Garten Berg Wald Mozart Rosen Pasteur Gambetta République Liberté Paix Moulin Fleurs Hugo Mayor Sol Luna Cervantes Goya Alcalá Libertad Prado"
).split()
_HEAD = "b br c ch d dr f fl g gr h j k kl l m n p pr r s sch sh st t th tr v w wh z".split()
_MIDDLE = "a e i o u ai au ea ei ie oo ou".split()
_TAIL = "ck ff ll lm ln m n nd ng nn nt r rd rk rn rt s ss st t tt x".split()
_ENDS = "a er o in an ez ski sen son mann berg ley ton ham ford well man ini etti ov eau ard ier dahl qvist rup".split()
_SOFT = "b c d f g k l ll m mm n nn nd r rr rt s ss st t tt v x z br dr lv ns rc".split()
_LAST = "a a a o o e y ie us an en in el ar or er is os io ia as et ine el on i".split()
_PLACES = "Lisbon Hamburg Rotterdam Lyon Valencia Boston Leeds Bremen Porto Gdynia Oslo Antwerp Genoa Bilbao Rouen Kiel Cork Malmö Trieste Nantes".split()
_FIRMS = "Freight Haulage Logistics Shipping Trading Forwarding Stevedores Commodities Agency Warehousing Transport Lines Spedition Transports Transportes".split()
_LEGAL = ("GmbH", "Ltd", "LLC", "S.A.", "B.V.", "SARL", "Inc.", "AG", "S.L.", "& Co.", "")
_DOMAINS = ("com", "org", "net", "de", "fr", "es", "co.uk", "io", "eu", "info", "example", "example.com", "example.org", "test", "invalid", "nl", "co")
_DESKS = "info office sales support contact desk team hello admin service export import customs operations accounts orders dispatch booking".split()
_ROADS = {
    "en": "Street St Street St. Road Rd Rd. Lane Ln Avenue Ave Ave. Close Drive Dr Way Court Ct Square Place Terrace Crescent Boulevard Blvd Hill Gardens".split(),
    "de": "straße strasse str. weg platz gasse allee ring damm ufer".split(),
    "fr": "rue quai avenue boulevard place chemin impasse allée route cours".split(),
    "es": "Calle C/ Avenida Avda. Av. Plaza Paseo Camino Ronda Carrera".split(),
}
#: Places of a digit (0), a letter (A) and a letter or digit (X) in numbers of persons.
_IDS = (
    "000-00-0000|000 00 0000|000.00.0000|000000000|A0000000|A00000000|AA 0000000|AA0000000|AA000000A|AA 00 00 00 A|00000000A|A-0000000-A|A0000000A|0000000A|00 000 000 000|00000000000|AXXXXXXX0|"
    "AA-000-0000|A00000000000|000000/0000|00.00.00-000.00|0 00 00 00 000 000|0 00 00 00 000 000 00|00-0000000|AAAAA000000AA0AA|00000000|0000 0000 0000|AAA-0000-A"
).split("|")
_PHONES = (
    "+00 00 0000 0000|+00 (0) 00 0000 0000|+00 (0)00 0000 0000|+00 (0) 00 / 00000 000|+000000000000|00000 000000|000 0000 0000|0000 00-0000|(000) 000-0000|000-000-0000|000.000.0000|+0 000 000 0000|+0 (000) 000-0000|+0-000-000-0000|"
    "00 00 00 00 00|00.00.00.00.00|+00 0 00 00 00 00|+00 000 000 000|000 00 00 00|0000/000000|000/00000000|(00000) 00 00 00|0000 000 0000|00000000000|+0 000 0000000|+00 00 000000|+00 000 0000000|0000 00 00000000|00000 00 00 00 00|+00(0)0-00-00-00-00|"
    "0000 00 0000-0000|(000)000-0000|000 000 0000|0-000-000-0000|000-000-000-0000|+00 00/00000000|0000-0000000|+00 0000 000000|(0000) 0000-0000|(000) 0000 0000"
).split("|")
_ID_WORDS = {
    "en": "passport|passport no.|Passport number:|SSN|SSN:|social security no.|soc. sec. #|tax no.|personal tax no.|TIN|driving licence|driver's licence no.|licence no.|driver ID|national ID|ID card|identity card no.|NIN|NI number:|Ppt",
    "de": "Reisepass|Pass-Nr.|Ausweis-Nr.|Personalausweis|Steuer-ID|Steuernummer|Führerschein|Führerschein-Nr.|Sozialversicherungsnummer|SV-Nummer:|Reisepassnummer",
    "fr": "passeport|passeport n°|carte d'identité|CNI|numéro fiscal|permis de conduire|permis n°|numéro de sécurité sociale|sécurité sociale :",
    "es": "pasaporte|pasaporte n.º|DNI|NIE|NIF|permiso de conducir|número de seguridad social|tarjeta de identidad|carnet de conducir",
}
#: Made sentences. {n} name, {e} email, {p} phone, {k} word before a number of a person, {i} such a number, {a} address; others are no mentions.
_LINES = {
    "en": (
        "Please call {n} on {p} about this.|Contact: {n}, {e}|Attn: {t}{n}\n{a}\n{c} {5}|Regards,\n{n}\n{p}|Best wishes,\n{n}\n{F}|Driver {n} ({k} {i}) collected {2} drums.|I spoke with {n} and {n} yesterday.|Send the invoice to {e} or {e}.|"
        "Deliver to {a}, {c}.|{n}, {a}, {c} {5}|My {k} is {i} and I live at {a}.|Reach me at {p} or {e}.|Tel: {p} / fax: {p}|{t}{n} of {F} signed for {2} pallets.|{n} from the yard phoned about container {B}.|{F} sent {2} cartons from {c} to {c}.|"
        "Vessel {V} berths at {h} with booking {r}.|Seal {B} and lot {r} were checked on {d}.|Tariff heading {7} covers {2} reels; invoice {r}.|See {u} for the position.|Container {B}, seal no. {5}, weight {2}.{3} kg.|Meet {n} at the gate, {k} {i}.|{n} showed {k}: {i} at the gate.|"
        "Her number is {p}, after {h} only.|Hi {g},|Hello {n},|Dear {t}{s},|Thanks, {g}|Visitor pass for {n} was left at the desk.|name={n} | phone={p} | mail={e}|Ask {g} or {t}{s}; both are at {F}.|{n} <{e}> wrote at {h}:|Ship to: {n}; {a}; {p}|Street address: {a}.|"
        "mail {e} today|text {p} please|{s}, {g} - {k} {i}|The notary at {a} holds {k} {i} of {n}.|The cargo of {2} sacks moved from {c} to {c} on {d}.|Purchase order {r} with {2} lines, gross {2} kg, dock {1}.|Line {2} reads {3}; release {r}.|On {d} at {h} the {V} left berth {2}.|"
        "{n} ({e})|{n}, {p}|From: {n} <{e}>\nTo: {n} <{e}>|{n} will meet {n}.|Witness: {n}, born {d}, {k} {i}|I am {n}.|It was {n} who signed.|{a}|{n}|{k} {i}|Old address {a} is no longer used, write to {a}, Unit {1}.|Signed: {n}|cc {e}; {e}|Flight {r} and rate {2}.{2} per {3} kg"
    ),
    "de": (
        "Bitte rufen Sie {n} unter {p} an.|Mit freundlichen Grüßen\n{n}\n{F}|Ansprechpartner: {n}, {e}|Lieferadresse: {a}, {5} {c}|Fahrer ist {n}, {k} {i}.|Herr {s} wohnt {a}.|Frau {n} hat {2} Kartons abgeholt.|Unterlagen an {e} senden.|Tel. {p}, Fax {p}|{k}: {i}|"
        "Abholung bei {n}, {a}.|Das Schiff MS {V} liegt um {h} am Kai {2}.|Container {B} mit Plombe {5} steht in {c}.|Rechnung {r} vom {d} über {2} Kisten.|{F} lieferte {2} Fässer nach {c}.|Hallo {g},|Sehr geehrte Frau {s},|Kollege {n} ({e}) kommt um {h}.|Zolltarif {7}, Los {r}.|Am {d} wog die Ladung {2} kg."
    ),
    "fr": (
        "Veuillez appeler {n} au {p}.|Cordialement,\n{n}\n{F}|Contact : {n}, {e}|Livrer au {a}, {5} {c}.|Le chauffeur {n} a montré {k} {i}.|M. {s} habite {a}.|Mme {n} a signé pour {2} colis.|Envoyer les papiers à {e}.|tél. {p}|{k} {i}|"
        "{n}, {a} - {5} {c}|Le navire {V} est au quai {2} à {h}.|Conteneur {B}, scellé {5}, lot {r}.|La position {7} couvre {2} fûts.|{F} a livré {2} sacs de {c} à {c}.|Bonjour {g},|Chère Madame {s},|Facture {r} du {d}."
    ),
    "es": (
        "Llame a {n} al {p}.|Saludos,\n{n}\n{F}|Contacto: {n}, {e}|Entregar en {a}, {5} {c}.|El chofer {n} mostró su {k} {i}.|El Sr. {s} vive en {a}.|La señora {n} firmó {2} cajas.|Enviar los papeles a {e}.|tel. {p}|{k} {i}|"
        "{n}, {a}, {5} {c}|El buque {V} está en el muelle {2} a las {h}.|Contenedor {B}, precinto {5}, lote {r}.|La partida {7} cubre {2} bidones.|{F} entregó {2} sacos de {c} a {c}.|Hola {g},|Estimada {s},|Factura {r} del {d}."
    ),
}
_KIND = {"n": "name", "g": "name", "s": "name", "e": "email", "p": "phone", "i": "id_number", "a": "address"}
_SLOT = re.compile(r"\{(\w)\}")
_WORDS = re.compile(rf"(?<![^\W_])(?:(?P<s>{SURNAME})|(?P<t>{STREET})|(?P<g>{'|'.join(GIVEN)}))", re.I)
_LETTERS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

Segment = tuple[str, str, str]


class Maker:
    """Made content, from a seeded generator."""

    def __init__(self, seed: int | list[int]) -> None:
        self.rng = np.random.default_rng(seed)
        self.u = np.zeros(0)

    def unit(self) -> float:
        if not len(self.u):
            self.u = self.rng.random(8192)[::-1]
        x, self.u = self.u[-1], self.u[:-1]
        return x

    def pick(self, some):
        return some[int(self.unit() * len(some))]

    def shape(self, s: str, letters: str = _LETTERS) -> str:
        return "".join(self.pick(_DIGITS) if c == "0" else self.pick(letters) if c == "A" else self.pick(letters + _DIGITS) if c == "X" else c for c in s)

    def word(self) -> str:
        w = "".join(self.pick(_HEAD) + self.pick(_MIDDLE) for _ in range(1 + (self.unit() < 0.35)))
        w += self.pick(_TAIL) + (self.pick(_ENDS) if self.unit() < 0.7 else "")
        return w.capitalize()

    def given(self) -> str:
        if self.unit() < 0.4:
            return self.pick(_GIVEN)
        w = "".join((self.pick(_HEAD) if self.unit() < 0.8 else "") + self.pick(_MIDDLE) for _ in range(1 + (self.unit() < 0.4)))
        return (w + self.pick(_SOFT) + self.pick(_LAST)).capitalize()

    def family(self) -> str:
        s = self.pick(_FAMILY) if self.unit() < 0.45 else self.word()
        if self.unit() < 0.06:
            s += "-" + (self.pick(_FAMILY) if self.unit() < 0.5 else self.word())
        return s

    def initials(self) -> str:
        return " ".join(self.pick(_LETTERS) + "." for _ in range(1 + (self.unit() < 0.15)))

    def name(self) -> str:
        u = self.unit()
        if u < 0.5:
            return f"{self.given()} {self.family()}"
        if u < 0.62:
            return f"{self.family()}, {self.given()}"
        if u < 0.74:
            return f"{self.initials()} {self.family()}"
        if u < 0.82:
            return f"{self.given()} {self.initials()} {self.family()}"
        if u < 0.86:
            return f"{self.family()}, {self.initials()}"
        if u < 0.9:
            return f"{self.given()} {self.family().upper()}"
        return self.given() if u < 0.96 else self.family()

    def domain(self) -> str:
        d = self.word().lower() + (self.pick(("", "", "-", ".")) + self.pick(_FIRMS + ["mail", "cargo", "log", "group", "post"]).lower() if self.unit() < 0.6 else "")
        return f"{d}.{self.pick(_DOMAINS)}"

    def email(self) -> str:
        g, s = self.given().lower(), self.family().lower().replace("'", "")
        local = self.pick((f"{g}.{s}", f"{g}{s}", f"{g[0]}{s}", f"{g}_{s}", f"{s}_{g}", f"{g}-{s}", s, g, f"{g}{int(self.unit() * 100)}", self.pick(_DESKS), f"{self.pick(_DESKS)}.{self.pick(_DESKS)}", f"{g}+{self.pick(_DESKS)}", f"{g}+x{self.pick(_DIGITS)}"))
        d, u = self.domain(), self.unit()
        if u < 0.7:
            return f"{local}@{d}"
        if u < 0.76:
            return f"{local} @ {d}"
        at = self.pick((" at ", "(at)", " (at) ", "[at]", " [at] "))
        return local + at + (d.replace(".", self.pick((" dot ", " [dot] ", "[dot]", " (dot) ", "(dot)"))) if self.unit() < 0.6 else d)

    def phone(self) -> str:
        p = self.shape(self.pick(_PHONES))
        return self.pick((p, p, p, p.replace(" ", "-"), p.replace(" ", "."), p.replace(" ", "")))

    def number(self) -> str:
        n = self.shape(self.pick(_IDS))
        return n.lower() if self.unit() < 0.04 else n

    def street(self) -> str:
        return self.pick(_STREET) if self.unit() < 0.4 else self.word()

    def address(self, lang: str) -> str:
        n, road, name = str(1 + int(self.unit() ** 2 * 400)), self.pick(_ROADS[lang]), self.street()
        if self.unit() < 0.12:
            n += self.pick(("A", "B", "a", "c", " B"))
        elif self.unit() < 0.08:
            n += self.pick(("-", " - ", "–")) + str(int(n.rstrip("ABac ")) + 2)
        if lang == "en":
            return f"{n} {name} {road}" if self.unit() < 0.85 else f"{n} {name} {self.street()} {road}"
        if lang == "de":
            if self.unit() < 0.15:
                return f"{self.pick(('Am', 'An der', 'Im', 'Zum', 'Zur', 'Unter den'))} {name}{self.pick(('platz', 'ufer', 'weg', 'graben', 'berg', ''))} {n}"
            return f"{name}{road} {n}" if self.unit() < 0.75 else f"{name} {road.capitalize()} {n}" if self.unit() < 0.5 else f"{name}-{road.capitalize()} {n}"
        if lang == "fr":
            of = self.pick(("", "", "de ", "du ", "de la ", "des "))
            a = f"{road} {of}{name}"
            return a if self.unit() < 0.08 else f"{n}{self.pick(('', '', '', ' bis', ' ter'))}{self.pick((' ', ', '))}{a}"
        return f"{road}{'' if road == 'C/' and self.unit() < 0.5 else ' '}{self.pick(('', '', 'de ', 'del ', 'de la '))}{name}{self.pick((' ', ', ', ' n.º ', ', nº '))}{n}"

    def firm(self) -> str:
        who = self.family() if self.unit() < 0.5 else f"{self.family()} & {self.family()}" if self.unit() < 0.4 else self.word()
        return f"{who} {self.pick(_FIRMS)} {self.pick(_LEGAL)}".strip()

    def other(self, slot: str, lang: str) -> str:
        """Content that is no mention."""
        if slot == "c":
            return self.pick(_PLACES) if self.unit() < 0.4 else self.word() + self.pick(("", "haven", "port", "stad", "ville", "burg"))
        if slot == "F":
            return self.firm()
        if slot == "V":
            return f"{self.pick(('', 'MV ', 'MS ', 'barge '))}{self.given() if self.unit() < 0.5 else self.word()} {self.pick(('Spirit', 'Dawn', 'Trader', 'Star', 'Express', 'Queen', 'Bay', self.word()))}"
        if slot == "B":
            return self.shape(self.pick(("AAAU0000000", "AAAU 000000-0", "AA0000000")))
        if slot == "r":
            return self.shape(self.pick(("AA-000-0000", "INV/000000", "A00-0000", "AAA000000", "0000000000", "00-00000", "AA/0000/00", "00000000", "PO 0000000", "AA000000")))
        if slot == "t":
            return self.pick(("", "Mr ", "Ms ", "Mrs ", "Dr. ", "Capt. ", "Prof. ", "Mr. ", "Miss "))
        if slot == "k":
            return self.pick(_ID_WORDS[lang].split("|"))
        if slot == "h":
            return self.shape("1A:A0", "0123")
        if slot == "d":
            return self.shape(self.pick(("2020-0A-1A", "1A/0A/2024", "1A.0A.2025", "1A October", "1A.0A.")), "12345")
        if slot == "u":
            return self.pick(("https://", "www.", "http://track.")) + self.domain() + self.pick(("", "/box/", "/t?ref=")) + self.shape(self.pick(("", "000", "AA0000")))
        return self.shape({"7": "0000.00.00", "5": "00000"}.get(slot, "0" * (1 + int(self.unit() * int(slot)))))

    def mention(self, slot: str, lang: str) -> str:
        if slot == "a":
            return self.address(lang)
        return {"n": self.name, "g": self.given, "s": self.family, "e": self.email, "p": self.phone, "i": self.number}[slot]()

    def lines(self, n: int) -> list[Segment]:
        """n made sentences as segments (text, slot, language); the slot is empty where there is no mention."""
        out: list[Segment] = []
        lang = self.pick(("en", "en", "en", "de", "fr", "es"))
        for _ in range(n):
            line = self.pick(_LINES[lang].split("|") if self.unit() < 0.9 else _LINES[self.pick("en de fr es".split())].split("|"))
            at = 0
            for m in _SLOT.finditer(line):
                out.append((line[at : m.start()], "", lang))
                out.append((m.group(1), m.group(1) if m.group(1) in _KIND else "*", lang))
                at = m.end()
            out.append((line[at:] + self.pick((" ", "\n", "\n\n", " ")), "", lang))
        return out

    def like(self, text: str, slot: str, lang: str) -> str:
        """Made content in the case and, for names, the form of text."""
        if slot == "n":
            words = re.split(r"[\s]+", text.strip())
            if len(words) == 1 and "-" not in text:
                new = self.given() if text.capitalize() in GIVEN else self.family()
            else:
                form = [self.initials() if re.fullmatch(r"(?:\w\.)+", w) else self.given() if w.strip(",").capitalize() in GIVEN else self.family() for w in words]
                new = " ".join(f + ("," if w.endswith(",") else "") for f, w in zip(form, words))
        elif slot == "a":
            new = self.address("fr" if re.search(r"\b(?:rue|quai|avenue|place|chemin|impasse|boulevard|all[eé]e)\s", text) and not text.rstrip().lower().endswith(("avenue", "place")) else "es" if re.match(r"Calle|C/|Av|Plaza|Paseo|Camino|Ronda", text, re.I) else "de" if not text[:1].isdigit() else "en")
        else:
            new = self.mention(slot, lang)
        return new.upper() if text.isupper() and slot not in "pi" else new.lower() if text.islower() and slot != "e" else new

    def fill(self, parts: list[Segment]) -> tuple[str, list[tuple[int, int, str]]]:
        """The text of segments and its mentions."""
        out, found, at = [], [], 0
        for text, slot, lang in parts:
            if slot == "*":
                text = self.other(text, lang)
            elif slot in ("S", "G", "T"):
                new = {"S": self.family, "G": self.given, "T": self.street}[slot]()
                text = new.upper() if text.isupper() else new.lower() if text.islower() else new
            elif slot:
                text = self.mention(slot, lang) if len(text) == 1 else self.like(text, slot, lang)
                found.append((at, at + len(text), _KIND[slot]))
            out.append(text)
            at += len(text)
        return "".join(out), found


_OF = {"name": "n", "email": "e", "phone": "p", "id_number": "i", "address": "a"}


def template(text: str, lang: str = "en") -> list[Segment]:
    """A document as segments: its mentions, and the other places where a word of its vocabulary stands."""
    out: list[Segment] = []

    def plain(part: str) -> None:
        at = 0
        for m in _WORDS.finditer(part):
            out.append((part[at : m.start()], "", lang))
            out.append((m.group(), m.lastgroup.upper(), lang))
            at = m.end()
        out.append((part[at:], "", lang))

    at = 0
    for a, b, kind in spans(text):
        if a < at:
            continue
        plain(text[at:a])
        out.append((text[a:b], _OF[kind], lang))
        at = b
    plain(text[at:])
    return [p for p in out if p[0]]


def document(maker: Maker) -> list[Segment]:
    """A made document of a few sentences."""
    return maker.lines(1 + int(maker.unit() ** 2 * 12))
