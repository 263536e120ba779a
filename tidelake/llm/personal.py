"""Personal information in free text: anchors found by one automaton, occurrences grown around them by local parsers.

An Aho-Corasick automaton over fixed cues (the at-sign, digits, street words, titles, roles, field labels, common
given names, phrases around a person in English, German and French) reads each text once; line borders are anchors
too. At each hit a small deterministic parser expands to the borders of the address, number or name, however far they
lie, and validates it. Names found by a cue are then looked for again in the same text, by surname, whole or with the
given name or initials before it; a surname that goes on as a company's name is none. Where a word's reading depends
on the language (M.), the paragraph's function words tell it, or the whole text's where the paragraph has too few.
What is masked has no letters or digits to grow on.

Nothing is shared between texts, so the work is one narrow stage and any number of tasks."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.session import ship

NAME, EMAIL, PHONE, ID_NUMBER, ADDRESS = "NAME", "EMAIL", "PHONE", "ID_NUMBER", "ADDRESS"

# Cues, by what they anchor.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof.", "Professor", "Judge", "Justice", "Sir", "Herr", "Herrn", "Frau", "Zeuge", "Zeugin", "Zeugen", "Richter", "Richterin", "Rechtsanwalt", "Rechtsanwältin", "M.", "MM.", "Mme", "Mlle", "Me", "Maître", "témoin", "witness"]
ROLES = [
    "Claimant", "Counsel for the claimant", "Counsel for the defendant", "Respondent", "Defendant", "Presiding judge", "Registrar", "Witness", "Appellant", "Judge", "Counsel", "Clerk",
    "Urkundsbeamter", "Urkundsbeamtin", "Prozessbevollmächtigter", "Prozessbevollmächtigte", "Zeuge", "Zeugin", "Vorsitzende Richterin", "Vorsitzender Richter", "Beklagter", "Beklagte", "Kläger", "Klägerin",
    "Défendeur", "Défenderesse", "Présidente", "Président", "Demandeur", "Demanderesse", "Témoin", "Greffier", "Greffière", "Avocat", "Avocate",
]
#: Labels of fields, at the start of a line: a whole name stands after them.
LABELS = [
    "Name", "Full name", "Contact", "Contact person", "From", "To", "Cc", "Attn", "Attention", "Signed", "Signature", "Author", "Patient", "Customer", "Client", "Employee", "Employer", "Tenant", "Landlord", "Owner", "Applicant", "Plaintiff", "Attorney", "Solicitor", "Interpreter", "Expert", "Insured", "Beneficiary",
    "Vor- und Nachname", "Ansprechpartner", "Ansprechpartnerin", "Mieter", "Mieterin", "Vermieter", "Vermieterin", "Kunde", "Kundin", "Antragsteller", "Antragstellerin", "Gutachter", "Dolmetscher", "Unterzeichnet", "An", "Von",
    "Nom", "Nom et prénom", "Cliente", "Locataire", "Bailleur", "Bailleresse", "Interprète", "Signataire", "Auteur", "À", "De",
]
#: A name stands right after these (in small letters, wherever a sentence begins).
BEFORE_NAME = [
    "according to ", "report of ", "statement of ", "testimony of ", "evidence of ", "affidavit of ", "estate of ", "signature of ", "left with ", "sent to ", "handed to ", "paid to ", "addressed to ", "married to ", "signed by ", "written by ", "prepared by ", "represented by ", "accompanied by ", "employed by ", "treated by ", "cross-examination ", "tenant as ", "owner as ", "driver as ",
    "my name is ", "name is ", "i am ", "a man named ", "a woman named ", "named ", "called ", "please call ", "please contact ", "contact ", "ask for ", "speak to ", "spoke to ", "dear ", "sincerely, ", "regards, ",
    "akte steht ", "ging an ", "angaben von ", "aussage von ", "bericht von ", "gutachten von ", "unterschrift von ", "lagen bei ", "vertreten durch ", "begleitet von ", "unterzeichnet von ", "verheiratet mit ", "übergeben an ", "mein Name ist ", "Name ist ", "ich heiße ", "ich bin ", "namens ", "genannt ", "liebe ", "lieber ", "grüßen, ",
    "dossier mentionne ", "adressée à ", "adressé à ", "remise à ", "remis à ", "rapport de ", "déclaration de ", "témoignage de ", "signature de ", "selon ", "d'après ", "chez ", "signé par ", "signée par ", "représenté par ", "représentée par ", "accompagné de ", "je m'appelle ", "mon nom est ", "je suis ", "nommé ", "nommée ", "cher ", "chère ",
]
#: A name stands right before these; only persons do what they say.
AFTER_NAME = [
    " signed ", " gave evidence", " testified", " lived ", " lives ", " resides ", " resided ", " was born", " is married", " are siblings", " are married", " accepted that", " could be reached", " can be reached", " (national number", " (passport", " (born ", " was admitted", " told the ", " said that", " says that", " phoned ", " e-mailed ", " wrote to ",
    " zeichnete ", " unterschrieb ", " wohnte ", " wohnt ", " war nur unter", " ist erreichbar", " ist unter ", " sagte ", " sagt aus", " bezeugte ", " sind Geschwister", " ist verheiratet", " wurde geboren", " (geboren ",
    " a signé ", " a déclaré ", " n'était joignable", " est joignable", " demeurait ", " demeure ", " habite ", " habitait ", " sont frère et sœur", " a déposé", " a témoigné", " est né ", " est née ", " (né ", " (née ",
]
#: Common given names: a capitalised family name after one makes a person.
GIVEN = (
    "Adam Alan Albert Alexander Alice Amanda Amy Andrea Andrew Angela Anna Anne Anthony Barbara Benjamin Brian Caroline Catherine Charles Charlotte Christian Christine Christopher Claire Daniel David Deborah Diana Donald Dorothy Edward Eleanor Elizabeth Emily Emma Eric Eva Frances Frank George Georgia Grace Hannah Harry Helen Henry Ian Isabel Jack Jacob James Jane Janet Jason Jennifer Jessica Joan John Jonathan Joseph Joshua Julia Karen Kate Katherine Kenneth Kevin Laura Linda Lisa Louise Lucy Margaret Maria Mark Martin Mary Matthew Michael Michelle Nancy Nicholas Nicole Oliver Olivia Pamela Patricia Patrick Paul Peter Philip Rachel Rebecca Richard Robert Robin Roger Ronald Rose Ruth Ryan Samuel Sandra Sarah Scott Simon Sophie Stephen Steven Susan Teresa Thomas Timothy Victoria William "
    "Andreas Bernd Birgit Dieter Dirk Elke Franz Fritz Georg Gerhard Günter Hans Heike Heinrich Helga Horst Ingrid Jens Jörg Jürgen Karin Karl Katrin Klaus Kurt Manfred Matthias Monika Petra Ralf Renate Sabine Stefan Stefanie Susanne Sven Ulrike Ursula Uwe Walter Werner Wolfgang "
    "Antoine Camille Cécile Chantal Élodie François Françoise Gérard Guillaume Hélène Jacques Jean Jérôme Julien Laurent Luc Mathieu Michel Monique Nathalie Olivier Philippe Pierre Sylvie Thierry Véronique Yves José Juan Luis Carlos Carmen Ahmed Mohammed Fatima Ali Wei Li"
).split()
VERSUS = [" v ", " v. ", " ./. ", " c. "]
#: Kinds of streets, in full and short. The house before and the town after them are what makes an address.
STREETS = "Terrace Lane Street Road Avenue Drive Close Court Way Place Square Crescent Gardens Grove Hill Park Row Walk Mews Rise Boulevard Parkway Highway Circle St. Rd. Ave. Dr. Ln. Blvd. Pl. Sq.".split()
HOUSES = ["Cottage", "House", "Lodge", "Farm", "Villa", "Hall"]
STREET_WORDS = [f" {w}" for w in [*STREETS, *HOUSES]]
WAYS = ["rue", "avenue", "chemin", "boulevard", "place", "quai", "impasse", "allée", "route", "square", "cours", "passage", "sentier"]
WAY_WORDS = [f" {w} " for w in WAYS]
WEGS = ["str.", "straße", "strasse", "weg", "gasse", "platz", "allee", "ring", "damm", "ufer", "steig", "hof"]
WEG_WORDS = [*(w if w.endswith(".") else f"{w} " for w in WEGS), "Am ", "Im ", "Zum ", "Zur ", "An der ", "Auf dem "]
#: An identity number stands after these, in the same sentence.
ID_CUES = [
    "national number", "national insurance", "identity number", "identity card", "ID number", "ID no", "ID card", "passport", "social security", "SSN", "driving licence", "driver's license", "tax number", "tenant as",
    "Ausweis", "lautet ", "Reisepass", "Steuer-ID", "Steueridentifikationsnummer", "Sozialversicherungsnummer", "Führerschein",
    "identité", "pièce ", "passeport", "sécurité sociale", "permis de conduire", "numéro fiscal",
]
#: A number right after these is an account, a reading or a file.
NOT_PERSONAL = re.compile(r"(?:ledger|account|invoice|order|file|case|docket|reference|ref|serial|receipt|under number|numbered|meter read|Konto|Rechnung|Aktenzeichen|unter Nummer|Nummer|Zähler\w*|au compte|compte|facture|dossier|compteur\w*|sous le numéro|numéro|n°|units @)(?: no\.?| number| Nr\.?| n°)?:?\s*$|\b[A-Z]{2}\d\d(?: ?[A-Z\d]{4})*\s*$", re.I)
COMPANY = (
    "SARL SAS SA GmbH AG KG Ltd Limited plc PLC Inc Co Co. LLP LLC & Maritime Shipping Warehousing Estates Holdings Grain Logistics Freight Trading Partners Bank Insurance Lines Sons Brothers Group"
).split()
#: Capitalised words that are no part of a person's name.
NO_NAME = frozenset(
    [*COMPANY, "Registrar", "Headnote", "Leitsatz", "Sommaire", "Catchwords", "Schlagworte", "Act", "Order", "Rules", "Road", "Lane", "Terrace", "Street", "St", "Cottage", "Flat", "Harb", "Rep", "NLR", "EXC", "COA", "MC", "HC", "LT", "DC", "JUDGMENT", "ORDER", "URTEIL", "TENOR", "ARRÊT", "DISPOSITIF"]
    + [w for r in [*ROLES, *LABELS] for w in r.split()]
    + "Park Square Court Harbour Bridge University Hospital Airport County Island City Church School College Library Station Hotel Street Avenue Way Crown Supreme Appeal Tribunal".split()
    + "The A An In On At By Of To For From With Upon Before After Following Having Pursuant Relying Despite According Notwithstanding When Whether Where As It We He She Page Seite Le La Les L Un Une Au Aux À Il Elle En Dans Par Pour Sur Selon Der Die Das Den Dem Des Ein Eine Im Am Nach Vor Bei Mit Laut Gegen Ohne January February March April May June July August September October November December Januar Februar März Mai Juni Juli Oktober Dezember".split()
)

_UP = "A-ZÀ-ÖØ-Þ"
_LOW = "a-zß-öø-ÿ"
#: One part of a name: capitalised or all capitals, with an apostrophe or hyphens, perhaps broken at a line's end.
_PART = rf"(?:[OD][’'])?[{_UP}][\w{_LOW}]*(?:-\n[{_LOW}][\w]*)?(?:-\n?(?:[OD][’'])?[{_UP}][\w]*(?:-\n[{_LOW}]\w*)?)*"
_INIT = rf"[{_UP}]\."
_VON = r"(?:van|de|von|du|della|di|VAN|DE|VON)"
_S = r"[^\S\n]*\n?[^\S\n]*"  # white space with at most one line break
_SS = r"(?:[^\S\n]+\n?[^\S\n]*|\n[^\S\n]*)"
_FAMILY = rf"(?:{_VON}{_SS})?{_PART}"
FULL = rf"(?:{_INIT}(?:{_S}{_INIT})*|{_PART}(?:{_SS}{_INIT})*){_SS}{_FAMILY}"
SURNAME_FIRST = rf"{_VON}{_SS}[{_UP}][{_UP}’'-]+{_SS}{_PART}"
LISTED = rf"{_FAMILY},{_SS}{_PART}(?:{_SS}{_INIT})*"

_full, _listed, _family, _surname_first = re.compile(FULL), re.compile(LISTED), re.compile(_FAMILY), re.compile(SURNAME_FIRST)
_full_before = re.compile(rf"(?<![\w.&-])({FULL})\Z")
_family_before = re.compile(rf"(?<![\w.&-])({_FAMILY})\Z")
_title = re.compile(rf"(?:(?:{'|'.join(re.escape(t) for t in sorted(TITLES, key=len, reverse=True))})\.?{_SS})+")
_company_next = re.compile(rf"{_S}(?:&|(?:{'|'.join(re.escape(c) for c in COMPANY if c != '&')})(?!\w)|(?:[{_UP}][\w’']*(?:-\n\w+)?{_SS}){{0,2}}(?:Ltd|Limited|plc|GmbH|SARL|AG)\b)")
_dot = r"(?:\.|[ ]?[\[({]dot[\])}][ ]?)"
_email_right = re.compile(rf"[ ]?[A-Za-z0-9][\w-]*(?:{_dot}[\w-]+)*{_dot}[A-Za-z]{{2,}}")
_ids = re.compile(r"(?<![\w/-])(?:QQ ?\d\d ?\d\d ?\d\d ?[A-D]|ZZ ?\d{3} ?\d{4}|ZZ ?\d{6} ?[A-D]?|[A-Z]{2}\d{6,7}[A-D]?|\d{3}-\d\d-\d{4}|\d{3} \d\d \d{4}|[12] \d\d \d\d \d\d \d{3} \d{3}(?: \d\d)?|[12]\d{12}(?:\d\d)?|\d\d \d{3} \d{3} \d{3}|\d\d/\d{3}/\d{5}|\d{11})(?![\w/]|-\d)")
#: Right after a cue, with a few small words between, other shapes will do: letters and six digits or more.
_id_at_cue = re.compile(r"(?:[a-zà-ÿ]*[.:#°'’)]*\s*){0,4}?(?<![\w/-])((?=(?:[A-Z -]*\d){6})(?:[A-Z]{1,3}[ -]?)?\d[A-Z0-9]{5,12})(?![\w/]|[-.,]\d)")
#: A stretch that could hold a number; everything shorter is a date, an amount or a paragraph.
_digits = re.compile(r"\d[\d ().\-/]{5,}[\dA-D]")
_id_alone = re.compile(r"(?:QQ|ZZ)|\d{3}-\d\d-\d{4}$|[12] \d\d \d\d \d\d \d{3} \d{3}")
_phones = re.compile(
    r"(?<![\w/.+-])(?:"
    r"(?:\+|00)[1-9]\d{0,2}[ .\-/]?(?:\(0\)[ ]?)?\(?\d{1,5}\)?(?:[ .\-/]?\d{1,8}){1,5}"
    r"|\(0\d{1,5}\)[ ]?\d{2,8}(?:[ \-/]\d{2,6}){0,3}"
    r"|0\d{1,5}[/\-]\d{2,8}(?:-\d{2,6}){0,2}"
    r"|0\d(?:[ .\-]\d\d){4}"
    r"|0\d{1,4}(?:[ ]\d{2,8}){1,3}"
    r"|0\d{9,10}"
    r"|\(\d{3}\)[ ]?\d{3}-\d{4}"
    r"|\d{3}([.\- ])\d{3}\1\d{4}"
    r")(?![\w/]|-\d|\.\d)"
)
_WORD = rf"[{_UP}]\w+(?:-\n\w+)?"
_town = rf"{_SS}?(?:\d{{5}}{_SS})?{_WORD}"
_street = "(?:" + "|".join(re.escape(w) for w in STREETS) + ")"
_english = re.compile(rf"(?:(?:Flat|Apartment|Apt\.?|Unit|Suite){_SS}\d+\w?,{_SS})?\d+[A-Za-z]?{_SS}{_WORD}(?:{_SS}{_WORD}){{0,2}}?{_SS}{_street},{_town}")
_cottage = re.compile(rf"{_WORD}{_SS}(?:{'|'.join(HOUSES)}),{_SS}{_WORD}(?:{_SS}{_WORD})?{_SS}{_street},{_town}")
_french = re.compile(rf"\d+(?:{_SS}(?:bis|ter|quater))?,?{_SS}(?:{'|'.join(WAYS)}){_SS}(?:(?:de{_SS}la|du|des|de|d[’']){_SS}?)?{_WORD},{_town}")
_german = re.compile(rf"(?:[{_UP}]\w*(?:-\n\w+)?(?:{'|'.join(re.escape(w) for w in WEGS)})|(?:Am|Im|Zum|Zur|An{_SS}der|Auf{_SS}dem){_SS}{_WORD}){_SS}\d+{_S}[a-z]?,{_town}")
_line_name = re.compile(rf"[^\S\n]*((?:(?:{'|'.join(re.escape(t) for t in sorted(TITLES, key=len, reverse=True))})\.?[ ]+)*)({FULL})[^\S\n]*$", re.M)
_receipt = re.compile(r"\s+a\s+(?:signé|été)")
_court_line = re.compile(rf"[{_UP}]+ [{_UP}]{{2,3}}$")
_function_words = [re.compile(rf"\b(?:{w})\b") for w in ("le|la|les|des|une|du|et", "the|of|and|to|was", "der|die|das|und|den|von")]


def _french_words(text: str) -> tuple[bool, bool]:
    """Whether French function words outnumber English and German ones in a stretch, and whether it has enough of any to tell."""
    counts = [sum(1 for _ in p.finditer(text)) for p in _function_words]
    return counts[0] > max(counts[1:]), max(counts) >= 4 and sorted(counts)[-1] > 2 * sorted(counts)[-2]


class Languages:
    """Which paragraphs of a text are French."""

    def __init__(self, text: str) -> None:
        self.text, self.known, self.whole = text, {}, None

    def french(self, at: int) -> bool:
        start = self.text.rfind("\n\n", 0, at) + 1
        if start not in self.known:
            stop = self.text.find("\n\n", at)
            self.known[start] = _french_words(self.text[start : len(self.text) if stop < 0 else stop])
        own, sure = self.known[start]
        if sure:
            return own
        if self.whole is None:
            self.whole = _french_words(self.text)[0]
        return self.whole


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    cues: dict[str, list[str]] = {}

    def add(kind: str, words: Iterable[str]) -> None:
        for w in words:
            cues.setdefault(w, []).append(kind)

    add("email", ["@", "(at)", "[at]", "{at}"])
    add("title", [t + s for t in TITLES for s in (" ", ". ")])
    add("role", [r + ":" for r in ROLES])
    add("label", [x + ":" for x in LABELS])
    add("before", {x for w in BEFORE_NAME for x in (w, w[0].upper() + w[1:])})
    add("given", [g + " " for g in GIVEN])
    add("digit", "0123456789")
    add("after", AFTER_NAME)
    add("versus", VERSUS)
    add("street", STREET_WORDS)
    add("way", WAY_WORDS)
    add("weg", WEG_WORDS)
    add("id", {x for w in ID_CUES for x in (w, w[0].upper() + w[1:])})
    for w, kinds in cues.items():
        a.add_word(w, (len(w), tuple(kinds)))
    a.make_automaton()
    return a


_VONS = frozenset("van de von du della di VAN DE VON".split())


def _clean(name: str, short: bool = False) -> bool:
    """Whether a span reads as a person's name: enough letters (two if short), no word that persons are not called."""
    solid = False
    for part in name.split():
        part = part.strip(",")
        if len(part) < 2 or part[1] == "." and len(part) == 2 or part in _VONS:
            continue
        if len(part) < 3 and not (short and part.isalpha() and part[0].isupper() and part not in TITLES) or part in NO_NAME or part.rstrip(".") in NO_NAME or sum(map(str.isdigit, part)) > 2:
            return False
        solid = True
    return solid


_sentence_end = re.compile(r"(?<!\bno)(?<!\bNo)(?<!\bNr)[.;!?](?=\s+[A-ZÀ-ÖØ-Þ])")


def _words_before(text: str, at: int) -> str:
    """The last four words before a place."""
    start = at
    for _ in range(4):
        start = text.rfind(" ", 0, max(0, start - 1)) + 1
    return text[start:at]


def _name_may_begin(text: str, at: int) -> int:
    """How far to the left of a place words go on that could be parts of a name: capitalised ones, initials, particles, and what a line's end has broken."""
    while at:
        end = at
        while end and text[end - 1].isspace():
            end -= 1
        start = end
        while start and (not text[start - 1].isspace() or text[start - 1] == "\n" and text[start - 2 : start - 1] == "-"):
            start -= 1
        word = text[start:end]
        if not word or not (word.lstrip("([«\"„“")[:1].isupper() or word in _VONS) or "\n\n" in text[end:at]:
            return at
        at = start
    return 0


class Found:
    """Spans with their kinds, and which characters they take."""

    def __init__(self, size: int) -> None:
        self.kinds: dict[tuple[int, int], str] = {}
        self.taken = bytearray(size)

    def put(self, start: int, end: int, kind: str) -> None:
        self.kinds[start, end] = kind
        self.taken[start:end] = b"\1" * (end - start)

    def free(self, start: int, end: int) -> bool:
        return 1 not in self.taken[start:end]


class Finder:
    """Finds the occurrences in one text after another."""

    def __init__(self) -> None:
        self.cues = _automaton()

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind), by start, without overlaps."""
        found = Found(len(text))
        names: list[tuple[int, int]] = []
        language, addresses, numbers = Languages(text), {}, [0, 0]
        flat = text.replace("\n", " ")
        for last, (length, kinds) in self.cues.iter(flat):
            start, end = last + 1 - length, last + 1
            for kind in kinds:
                if kind == "digit":
                    if not start or not flat[start - 1].isdigit():
                        self._number(flat, start, numbers, found)
                elif kind == "email":
                    self._email(flat, start, end, found)
                elif kind == "street":
                    self._near(text, start, (_english, _cottage), addresses, found)
                elif kind == "way":
                    self._near(text, start, (_french,), addresses, found)
                elif kind == "weg":
                    self._near(text, start, (_german,), addresses, found)
                elif kind == "id":
                    self._identity(flat, end, found)
                elif kind == "title":
                    if start and (text[start - 1].isalnum() or text[start - 1] in "-&."):
                        continue
                    if not text.startswith("M.", start) or language.french(start):
                        self._after_title(text, end, names)
                elif kind == "role":
                    if start == 0 or text[start - 1] == "\n":
                        self._role(text, end, names, (_listed, _surname_first, _full, _family))
                elif kind == "label":
                    if start == 0 or text[start - 1] == "\n" or text[start - 2 : start] in ("; ", ", ", "| "):
                        self._role(text, end, names, (_listed, _surname_first, _full))
                elif kind == "before":
                    if not start or not text[start - 1].isalnum():
                        self._right(text, end, names)
                elif kind == "after":
                    self._left(text, start, names)
                elif kind == "given":
                    if not start or not (text[start - 1].isalnum() or text[start - 1] in "-&.’'"):
                        m = _full.match(text, start)
                        if m:
                            self._accept(text, *m.span(), names)
                else:
                    self._versus(text, start, end, names)
        at = 0
        while at >= 0:  # a name that is a line of its own
            m = _line_name.match(text, at)
            if m and _clean(m.group(2)) and not _court_line.match(m.group(2)) and text[m.start(2) - 1 : m.start(2)] in ("", "\n", " "):
                names.append(m.span(2))
            at = text.find("\n", at) + 1 or -1
        if "M." in text:
            names = [self._without_m(text, a, b) if language.french(a) else (a, b) for a, b in names]
        self._names(text, names, found, language)
        out, until = [], -1
        order = {EMAIL: 0, ID_NUMBER: 1, PHONE: 2, ADDRESS: 3, NAME: 4}
        claimed: list[tuple[int, int, str]] = []
        for (a, b), kind in sorted(found.kinds.items(), key=lambda x: (order[x[1]], x[0][0], -x[0][1])):
            claimed.append((a, b, kind))
        claimed.sort(key=lambda x: (x[0], order[x[2]], -x[1]))
        for a, b, kind in claimed:
            if a >= until:
                out.append((a, b, kind))
                until = b
            elif order[kind] < order[out[-1][2]]:
                out[-1] = (a, b, kind)
                until = b
        return out

    @staticmethod
    def _email(text: str, at: int, end: int, found: Found) -> None:
        stop = at - 1 if at and text[at - 1] == " " else at
        start = stop
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.+%-"):
            start -= 1
        right = _email_right.match(text, end)
        if right and start < stop and (text[stop - 1].isalnum() or text[stop - 1] == "_") and any(c.isalpha() for c in text[start:stop]):
            found.put(start, right.end(), EMAIL)

    @staticmethod
    def _near(text: str, at: int, patterns: tuple, known: dict, found: Found) -> None:
        """The address around a street word: its paragraph is read once for each kind of address."""
        lo = text.rfind("\n\n", 0, at) + 1
        for pattern in patterns:
            if (lo, pattern) not in known:
                hi = text.find("\n\n", at)
                known[lo, pattern] = [m.span() for m in pattern.finditer(text, lo, len(text) if hi < 0 else hi)]
            spans = known[lo, pattern]
            k = bisect_left(spans, at, key=lambda x: x[1])
            for a, b in spans[k : k + 2]:
                if a <= at + 4 and (a == 0 or not text[a - 1].isalnum()):
                    found.put(a, b, ADDRESS)
                    return

    @staticmethod
    def _identity(text: str, end: int, found: Found) -> None:
        """The number that follows a cue in its sentence."""
        stop = _sentence_end.search(text, end)
        stop = stop.start() if stop else len(text)
        m = _ids.search(text, end, stop) or _id_at_cue.match(text, end, stop)
        if m and not NOT_PERSONAL.search(_words_before(text, m.start(m.lastindex or 0))):
            found.put(*m.span(m.lastindex or 0), ID_NUMBER)

    @staticmethod
    def _number(text: str, at: int, until: list, found: Found) -> None:
        """A phone or identity number that begins with the digit at a place, or right before it. until: where the last of each kind ended."""
        if not _digits.match(text, at):
            return
        if at >= until[0]:
            for start in (at - 3, at - 2, at):
                m = _ids.match(text, start) if start >= 0 and (start == at or text[start : start + 2].isupper()) else None
                if m:
                    until[0] = m.end()
                    if _id_alone.match(m.group()) and not NOT_PERSONAL.search(_words_before(text, m.start())):
                        found.put(*m.span(), found.kinds.get(m.span(), ID_NUMBER))
                    break
        if at >= until[1]:
            start = at
            while start and text[start - 1] in "+(" and at - start < 2:
                start -= 1
            m = next((m for m in (_phones.match(text, s) for s in range(start, at + 1)) if m), None)
            if m:
                until[1] = m.end()
                digits = sum(c.isdigit() for c in m.group())
                if 9 <= digits <= 15 and (m.group()[0] != "0" or digits >= 10) and not NOT_PERSONAL.search(_words_before(text, m.start())) and found.free(*m.span()):
                    found.put(*m.span(), PHONE)

    @staticmethod
    def _accept(text: str, start: int, end: int, names: list) -> bool:
        if not _clean(text[start:end], short=True) or _company_next.match(text, end):
            return False
        names.append((start, end))
        return True

    def _after_title(self, text: str, at: int, names: list) -> None:
        more = _title.match(text, at)
        at = more.end() if more else at
        while at < len(text) and text[at] in " \n":
            at += 1
        for pattern in (_full, _family):
            m = pattern.match(text, at)
            if m and self._accept(text, *m.span(), names):
                return

    @staticmethod
    def _without_m(text: str, start: int, end: int) -> tuple[int, int]:
        """In French M. is a title, not an initial, unless one surname alone follows in a role, a receipt or a report."""
        if not text.startswith("M.", start):
            return start, end
        at = start + 2
        while text[at] in " \n":
            at += 1
        one = _family.fullmatch(text, at, end)
        if one and (_receipt.match(text, end) or text[max(0, start - 2) : start] == ": " or text[max(0, start - 11) : start].endswith("rapport de ")):
            return start, end
        return at, end

    def _role(self, text: str, at: int, names: list, shapes: tuple) -> None:
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        while at < stop and text[at] == " ":
            at += 1
        more = _title.match(text, at, stop)
        if more and not (text.startswith("M.", at) and not _full.match(text, more.end(), stop)):
            at = more.end()
        for pattern in shapes:
            m = pattern.match(text, at, stop)
            if m and self._accept(text, *m.span(), names):
                return

    def _right(self, text: str, at: int, names: list) -> None:
        while at < len(text) and text[at] in " \n":
            at += 1
        more = _title.match(text, at)
        if more and not text.startswith("M.", at):
            return  # the title is an anchor of its own
        for pattern in (_listed, _surname_first, _full):
            m = pattern.match(text, at)
            if m and self._accept(text, *m.span(), names):
                return

    def _left(self, text: str, at: int, names: list) -> None:
        lo = _name_may_begin(text, at)
        m = _full_before.search(text[lo:at])
        if m:
            start = lo + m.start(1)
            first = re.match(rf"{_PART}|{_INIT}", text[start:at])
            if first and first.group() in NO_NAME or first and first.group() in TITLES:
                return
            if self._accept(text, start, at, names):
                joined = re.search(r"\s(?:and|und|et)\s+(?:\w+\.?\s+)?\Z", text[max(0, start - 12) : start])
                if joined:
                    self._left(text, max(0, start - 12) + joined.start(), names)
                return
        m = _family_before.search(text[lo:at])
        if m and at - lo - m.start(1) > 1 and (lo + m.start(1) == 0 or text[max(0, lo + m.start(1) - 2) : lo + m.start(1)] in (". ", ".\n", "] ", ") ", "\n\n") or text[lo + m.start(1) - 1] == "\n"):
            self._accept(text, lo + m.start(1), at, names)

    def _versus(self, text: str, start: int, end: int, names: list) -> None:
        lo = _name_may_begin(text, start)
        m = _full_before.search(text[lo:start])
        if m:
            self._accept(text, lo + m.start(1), start, names)
        m = _full.match(text, end)
        if m:
            self._accept(text, *m.span(), names)

    def _names(self, text: str, names: list, found: Found, language: Languages) -> None:
        """Adds the names, and every further occurrence of their surnames."""
        spans, covered = {}, bytearray(len(text))
        surnames: set[str] = set()
        given: set[str] = set()
        for a, b in names:
            if not found.free(a, b):
                continue
            spans[a] = max(b, spans.get(a, 0))
            covered[a:b] = b"\1" * (b - a)
            flat = re.sub(r"-\n(?=[a-z])", "", text[a:b]).replace("\n", " ")
            if "," in flat:
                family, rest = (x.strip() for x in flat.split(",", 1))
            else:
                parts = flat.split()
                k = next((i for i, p in enumerate(parts) if p.lower() in ("van", "de", "von", "du", "della", "di")), len(parts) - 1)
                family, rest = " ".join(parts[k:]), " ".join(parts[:k])
                if len(parts) > 1 and parts[-2].isupper() and len(parts[-2]) > 2 and not parts[-1].isupper():
                    family, rest = " ".join(parts[:-1]), parts[-1]  # SURNAME Given
            surnames.add(family)
            given.update(p for p in rest.split() if len(p.rstrip(".")) > 1)
        known = {g.lower() for g in given}
        for family in {f for s in surnames for f in (s, s.upper(), s.title() if s.isupper() else s)}:
            if len(family) < 2:
                continue
            at = text.find(family)
            while at >= 0:
                end = at + len(family)
                if (at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "@-_.’'+")) and (end == len(text) or not (text[end].isalnum() or text[end] in "@_’")) and not _company_next.match(text, end):
                    start = self._grow(text, at, known)
                    if text.startswith("M.", start) and language.french(start):
                        start, _ = self._without_m(text, start, end)
                    if 1 not in covered[start:end] and found.free(start, end):
                        spans[start] = end
                        covered[start:end] = b"\1" * (end - start)
                at = text.find(family, end)
        until = -1
        for a, b in sorted(spans.items()):
            if a >= until:
                found.kinds[a, b] = NAME
                until = b

    @staticmethod
    def _grow(text: str, at: int, known: set[str]) -> int:
        """Leftwards from a surname over particle, initials and a known given name."""
        while at > 1 and text[at - 1].isspace():
            end = at - 1
            start = end
            while start and (text[start - 1] not in " \t\n([«\"„“" or text[start - 1] == "\n" and text[start - 2 : start - 1] == "-"):
                start -= 1
            word = text[start:end]
            if not (word.lower() in known or re.fullmatch(_INIT, word) or re.fullmatch(_VON, word)):
                return at
            at = start
        return at


def _spans(rows: DataFrame, kind: str, build) -> DataFrame:
    """Runs a batch function with a Finder per worker over (key, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for b in batches:
            yield build(finder, b)

    ship(rows.sparkSession)
    return rows.mapInArrow(run, kind)


def occurrences(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, start, stop: each occurrence, in characters from 0. Null and blank texts have none; repeated rows are reported each."""

    def build(finder: Finder, b: pa.RecordBatch) -> pa.RecordBatch:
        at, kinds, starts, stops = [], [], [], []
        for i, t in enumerate(b.column(1).to_pylist()):
            for a, z, kind in finder(t):
                at.append(i)
                kinds.append(kind)
                starts.append(a)
                stops.append(z)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], ["key", "kind", "start", "stop"])

    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    return _spans(rows, f"key {rows.schema['key'].dataType.simpleString()}, kind string, start int, stop int", build)


def redact(texts: DataFrame, text: str) -> DataFrame:
    """The table with [NAME], [EMAIL], [PHONE], [ID_NUMBER] and [ADDRESS] in the text column instead; all else as it was."""
    schema, place = texts.schema, texts.columns.index(text)

    def build(finder: Finder, b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in b.column(place).to_pylist():
            if t:
                parts, at = [], 0
                for a, z, kind in finder(t):
                    parts += [t[at:a], f"[{kind}]"]
                    at = z
                t = "".join(parts) + t[at:]
            out.append(t)
        columns = list(b.columns)
        columns[place] = pa.array(out, pa.string())
        return pa.RecordBatch.from_arrays(columns, b.schema.names)

    return _spans(texts, schema, build)
