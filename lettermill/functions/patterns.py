"""Recognisers of personal data in German letters, as patterns that `finding` runs on each text.

The word lists, tables and shapes below are fixed values: results depend on them exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

#: The white space and the ASCII word boundary that the shapes mean, whatever the engine's own classes are.
WS = r"[ \t\n\x0B\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
BLANKS = " \t\n\x0b\f\r\xa0"  # those of WS among Latin-1 characters
WB = r"(?a:\b)"
GAP = r"[ \t]*\n?[ \t]*"
TITLE = r"(?:(?:Dr|Prof|Dipl)\.[ \t]*(?:med\.[ \t]*|jur\.[ \t]*|Ing\.[ \t]*)?)?"
PHRASE = r"\p{Lu}[\p{L}'’\-]+(?:[ \t]+\p{Lu}[\p{L}'’\-]+){0,2}"
UPPER, LOWER = "[A-ZÄÖÜÀÁÉÓÚ]", "[a-zäöüßàáéóúâôû]"
GLYPH = "OolIiı|SsBZzGgq"

#: Words that are never a person's name.
NOT_A_NAME = (
    "damen", "herren", "herr", "frau", "damen und herren", "doktor", "professor", "kollege", "kollegin", "sachbearbeiter", "sachbearbeiterin",
    "ansprechpartner", "ansprechpartnerin", "bearbeiter", "bearbeiterin", "mitarbeiter", "mitarbeiterin", "antragsteller", "antragstellerin", "anwalt",
    "anwältin", "rechtsanwalt", "rechtsanwältin", "behörde", "amt", "abteilung", "ausländerbehörde", "bürgeramt", "landeshauptstadt", "stadt", "gemeinde",
    "auftrag", "vertretung", "unterschrift", "anlage", "anlagen", "betreff", "datum", "seite", "grüßen", "hochachtungsvoll",
)

#: Name particles that are no name of their own.
PARTICLES = ("van", "von", "de", "der", "den", "del", "della", "di", "da", "dos", "bin", "ibn", "al", "el", "abu", "ait", "ben", "dr", "prof", "herr", "frau", "mr", "mrs", "ms")

#: What a misread glyph in an account number may have been, and how many such glyphs are tried at most.
IBAN_REPAIRS = {"g": "96", "G": "69", "o": "0", "O": "0", "Q": "0", "D": "0", "l": "1", "L": "1", "I": "1", "i": "1", "|": "1", "s": "5", "S": "5", "B": "8", "Z": "2", "z": "2", "T": "7", "q": "9"}
IBAN_REPAIR_SITES = 6

ENTITY_TYPES = ("NAME", "ADDRESS", "DOB", "DATE", "STEUERID", "IBAN", "EMAIL", "PHONE", "AUSLNR", "AKTENZEICHEN", "INSURANCE", "PASSPORT", "POSTALCODE")


#: Letters that an engine takes for i, s or k when it ignores case, but that are none in a label.
ODD_FOLDS = "ıİſ\u212a"


def labels(names: str) -> str:
    """Labels, as alternatives of a pattern, in any letter case, with what may stand behind them."""
    return f"(?i:{names}){WS}*[:.]?{WS}*"


@dataclass(frozen=True)
class Recogniser:
    """A kind of personal data: what matches, which group of it is the value, what the value must fulfil, and strings one of which every match holds.

    hints are held as they stand, signs in lower case by the match in lower case; a text without any is not searched. The others say the same
    of texts of Latin-1 characters in a way that is found faster: strings one of which every match begins with (as they stand, or by
    low_starts in lower case), a digit run of one of those lengths, followed by one of those characters if given, that every other match begins
    with, or a core that every match holds behind nothing but characters of lead, the first of them one of head, or a pattern with the same matches.
    Texts are put together with a NUL behind each for these, so such a pattern neither takes a NUL nor asks for a text's beginning or end.
    """

    kind: str
    pattern: str
    group: int = 0
    check: str | None = None
    hints: tuple[str, ...] = ()
    signs: tuple[str, ...] = ()
    starts: tuple[str, ...] = ()
    low_starts: tuple[str, ...] = ()
    digits: tuple[int, ...] = ()
    behind: str = ""
    core: str | None = None
    lead: str = ""
    head: str = ""
    quick: str | None = None


def first(chars: str) -> str:
    """A character of a set that begins a word, written so that the set comes first and is looked for first."""
    return f"{chars}(?<={WB}{chars})"


_ROLES = "(?:Sachbearbeiter(?:in)?|Ansprechpartner(?:in)?|Bearbeiter(?:in)?|Sachgebietsleiter(?:in)?|Rechtsanwalt|Rechtsanwältin)"
_KIN = "(?:Ehefrau|Ehemann|Ehepartner(?:in)?|Sohn(?:es)?|Tochter|Kind(?:es)?|Vater[s]?|Mutter)"
_STREET = rf"(?:[Ss]tra(?:ß|ss|B|b|fs)e|[Ss]tr\.|[Ww]eg|[Aa]llee|[Pp]latz|[Gg]asse|[Rr]ing|[Dd]amm|[Uu]fer)"
_MONTHS = "Januar|Februar|März|Maerz|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"

#: The recognisers in order; order decides between spans of one place and length.
RECOGNISERS: list[Recogniser] = [
    Recogniser("NAME", rf"Sehr[ \t]+geehrte[rs]?[ \t]+(?:Herr|Frau){GAP}{TITLE}({PHRASE})", 1, "plausible_name", ("Sehr",), starts=("Sehr",)),
    Recogniser("NAME", rf"{_ROLES}[ \t]*[:.]?{GAP}(?:Herr|Frau)?{GAP}{TITLE}({PHRASE})", 1, "plausible_name", ("earbeiter", "Ansprechpartner", "Sachgebietsleiter", "Rechtsanw"), starts=("Sachbearbeiter", "Bearbeiter", "Ansprechpartner", "Sachgebietsleiter", "Rechtsanw")),
    Recogniser("NAME", rf"(?:i\.[ \t]*[AV]\.|gez\.){GAP}{TITLE}({PHRASE})", 1, "plausible_name", ("i.", "gez."), starts=("i.", "gez.")),
    Recogniser("NAME", rf"{WB}(?:Herrn|Herr|Frau){GAP}{TITLE}({PHRASE})", 1, "plausible_name", ("Herr", "Frau"), starts=("Herr", "Frau")),
    Recogniser("NAME", rf"{_KIN}{GAP}{TITLE}({PHRASE})", 1, "plausible_name", ("Ehe", "Sohn", "Tochter", "Kind", "Vater", "Mutter"), starts=("Ehe", "Sohn", "Tochter", "Kind", "Vater", "Mutter")),
    Recogniser("EMAIL", rf"{WB}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{WB}", hints=("@",), core="@", lead="A-Za-z0-9._%+-", head="A-Za-z0-9._%+-"),
    Recogniser("IBAN", rf"{WB}[A-Z]{{2}}[0-9GgOoQDLlIi|SsBZzTq]{{2}}(?:[ ]?[A-Z0-9gioqdlszt|]{{4}}){{2,7}}(?:[ ]?[A-Z0-9gioqdlszt|]{{1,4}})?{WB}", 0, "readable_iban", quick=rf"{first('[A-Z]')}[A-Z][0-9GgOoQDLlIi|SsBZzTq]{{2}}(?:[ ]?[A-Z0-9gioqdlszt|]{{4}}){{2,7}}(?:[ ]?[A-Z0-9gioqdlszt|]{{1,4}})?{WB}"),
    Recogniser("AUSLNR", labels("Ausländernummer|Auslaendernummer|AZR-Nummer|ZAR-Nummer") + r"([A-Za-z0-9][A-Za-z0-9\-/ ]{4,20}[A-Za-z0-9])", 1, signs=("nummer",), low_starts=("ausländernummer", "auslaendernummer", "azr-nummer", "zar-nummer")),
    Recogniser("AKTENZEICHEN", labels(r"Aktenzeichen|Az\.|Gesch\.-Z\.|Geschäftszeichen|Vorgangsnummer|Kundennummer") + r"([A-Za-z0-9][A-Za-z0-9\-/. ]{3,25}[A-Za-z0-9])", 1, signs=("zeichen", "az.", "gesch.-z.", "nummer"), low_starts=("aktenzeichen", "az.", "gesch.-z.", "geschäftszeichen", "vorgangsnummer", "kundennummer")),
    Recogniser("STEUERID", labels(r"Steuer-?ID|Steuer-?Identifikationsnummer|IdNr\.?|Steuernummer") + r"([0-9 ]{11,17})", 1, signs=("steuer", "idnr"), low_starts=("steuer", "idnr")),
    Recogniser("INSURANCE", labels("Krankenversicherungsnummer|Versichertennummer|Sozialversicherungsnummer") + r"([A-Za-z]?[0-9 ]{8,14}[A-Za-z]?)", 1, signs=("versich",), low_starts=("krankenversich", "versich", "sozialversich")),
    Recogniser("PASSPORT", labels("Passnummer|Reisepassnummer|Reisepass|Ausweisnummer") + r"([A-Za-z0-9]{6,12})", 1, signs=("pass", "ausweis"), low_starts=("passnummer", "reisepass", "ausweisnummer")),
    Recogniser("STEUERID", rf"{WB}[0-9]{{2}}[ ]?[0-9]{{3}}[ ]?[0-9]{{3}}[ ]?[0-9]{{3}}{WB}", 0, "plausible_tax_id", digits=(2, 5, 8, 11)),
    Recogniser("PHONE", rf"(?:(?:\+|00)49|\(0\)|{WB}0)(?:{WS}|[\-/])?[0-9]{{2,5}}(?:{WS}|[\-/])?[0-9]{{3,9}}(?:(?:{WS}|[\-/])?[0-9]{{1,6}})?{WB}", 0, "phone_length", ("0", "+49"), starts=("+49", "(0)", "0049"), digits=tuple(range(1, 64))),
    Recogniser("ADDRESS", rf"{WB}[0-9]{{5}}{WS}+{UPPER}{LOWER}+(?:[ -]{UPPER}{LOWER}+)*", digits=(5,), behind=BLANKS),
    Recogniser("ADDRESS", rf"{WB}{UPPER}{LOWER}*(?:-{UPPER}?{LOWER}+)*-?{_STREET}{WS}+(?:[0-9{GLYPH}]{{0,3}}[0-9][0-9{GLYPH}]{{0,3}}|[{GLYPH}])[a-zA-Z]?(?![A-Za-z0-9])", hints=("str", "Str", "eg", "llee", "latz", "asse", "ing", "amm", "fer"), core=rf"[eg.zmr](?={WS}+[0-9{GLYPH}])", lead=f"{UPPER[1:-1]}{LOWER[1:-1]}-", head=UPPER[1:-1]),
    Recogniser("DATE", rf"{WB}[0-9]{{1,2}}\.{WS}?[0-9]{{1,2}}\.{WS}?[0-9]{{2,4}}{WB}", hints=(".",), digits=(1, 2), behind="."),
    Recogniser("DATE", rf"{WB}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{WB}", hints=("-",), digits=(4,), behind="-"),
    Recogniser("DATE", rf"{WB}[0-9]{{1,2}}\.{WS}?(?:{_MONTHS}){WS}+[0-9]{{4}}{WB}", hints=tuple(_MONTHS.split("|")), digits=(1, 2), behind="."),
]


def register(recogniser: Recogniser) -> None:
    """Adds a recogniser behind those there are."""
    if recogniser.kind not in ENTITY_TYPES:
        raise ValueError(f"unknown entity type {recogniser.kind}")
    RECOGNISERS.append(recogniser)
