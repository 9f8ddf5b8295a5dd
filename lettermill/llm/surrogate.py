"""Keyed surrogates for personal data: same kind, gender, script and format, one for each distinct value."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, if_small, written

#: Surrogates that a value tries at most.
MOST_TRIES = 64
#: The key that the registered queries use; real runs pass their own secret.
QUERY_KEY = b"surrogates for registered queries"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Titles that tell a gender, in the languages looked at.
TITLES = {"m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Госпожа", "Κυρία")}
_GENDER = {t: g for g, many in TITLES.items() for t in many}
_PART = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
PATTERNS = (
    ("EMAIL", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"), 0),
    ("SECRET", re.compile(r"(?i:(?<![A-Za-z0-9])(?:token|secret|api[_-]?key|password|passwd)[\"']?\s*[:=]\s*[\"']?)([A-Za-z0-9_+/=-]{12,})"), 1),
    ("IBAN", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), 0),
    ("IP", re.compile(rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"), 0),
    ("CARD", re.compile(r"(?<![0-9])[2-6](?:[ -]?[0-9]){12,18}(?![0-9])"), 0),
    ("PHONE", re.compile(r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9])"), 0),
    ("SSN", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), 0),
    ("NAME", re.compile(rf"(?<!\w)(?:{'|'.join(sorted(_GENDER, key=len, reverse=True))})\.? ({_PART}(?: {_PART}){{0,2}})"), 1),
)
#: Issuer prefixes of payment cards with their lengths.
_CARD = re.compile(r"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5]|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]*|3[47][0-9]{13}|(?:6011|65)[0-9]*|35(?:2[89]|[3-8][0-9])[0-9]*|3(?:0[0-5]|[68][0-9])[0-9]{11}")
_ANY = re.compile("[0-9@=:]|" + "|".join(sorted(_GENDER, key=len, reverse=True)))

#: Parts from which surrogate names are made, by script: given names by gender, stems and endings of family names.
NAMES = {
    "latin": {
        "m": "Adrian Anton Benno Carlo David Emil Felix Georg Hugo Ivo Jonas Karl Leon Marco Nils Oskar Paul Ralf Simon Theo Ulrich Viktor".split(),
        "f": "Alba Berta Clara Dora Elena Frida Greta Hanna Ida Julia Klara Lena Marta Nora Olga Paula Rosa Sofia Tilda Ursula Vera Wanda".split(),
        "stem": "Adler Berg Dorn Eich Feld Gras Hain Kern Lind Moor Nord Ost Quell Rain Sand Tal Ufer Wald Weid Zeder".split(),
        "end": "mann hofer bach stein thal egger burg hausen inger au".split(),
    },
    "cyrillic": {
        "m": "Антон Борис Виктор Григорий Денис Егор Иван Кирилл Лев Марк".split(),
        "f": "Анна Вера Галина Дарья Елена Жанна Ирина Клара Лариса Мария".split(),
        "stem": "Бел Вол Гор Дуб Зим Кам Лес Мор Пол Реч".split(),
        "end": "ов ин енко ский ич".split(),
    },
    "greek": {
        "m": "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σταύρος Χρήστος".split(),
        "f": "Άννα Γεωργία Δήμητρα Ελένη Κατερίνα Μαρία Νίκη Σοφία".split(),
        "stem": "Αλεξ Βασιλ Γεωργ Δημ Κων Μιχ Νικ Παπ".split(),
        "end": "όπουλος ίδης άκης άδης έας".split(),
    },
}


def _luhn(digits: str) -> int:
    """What the digits, the last one as check digit, leave modulo 10."""
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits)))) % 10


def _iban_rest(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def script_of(word: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", word) else "greek" if re.search("[Ͱ-Ͽἀ-῿]", word) else "latin"


def _plausible(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "CARD":
        return _CARD.fullmatch(digits) is not None and len(digits) <= 19 and (len(digits) == 16 or digits[0] in "34") and _luhn(digits) == 0
    if kind == "IBAN":
        return _iban_rest(value.replace(" ", "")) == 1
    if kind == "PHONE":
        return 7 <= len(digits) <= 15
    if kind == "SECRET":
        return any(c.isdigit() for c in value)
    if kind == "NAME":
        return all(p[0].isupper() for p in value.split(" "))
    return True


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, extra) of the personal data in a text, without overlaps: earliest first, then longest.

    extra: a titled name's gender; of a further mention of a part of such a name, what that part is.
    """
    if not text or not _ANY.search(text):
        return []
    found = []
    for kind, pattern, group in PATTERNS:
        if kind == "EMAIL" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            start, end = m.span(group)
            if kind == "NAME":  # words from the first that is not capitalised on are no name
                parts = m[group].split(" ")
                n = next((i for i, p in enumerate(parts) if not p[0].isupper()), len(parts))
                end = start + len(" ".join(parts[:n]))
            if end > start and _plausible(kind, text[start:end]):
                found.append((start, end, kind, _GENDER[re.match(r"\w+", m[0])[0]] if kind == "NAME" else ""))
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return _with_mentions(text, out)


def _with_mentions(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """found and every other place where a part of a found name stands as a capitalised word of its own."""
    known: dict[str, str] = {}
    for start, end, kind, extra in found:
        if kind == "NAME":
            for what, canon, _ in units(text[start:end], kind, extra):
                known.setdefault(canon, what)
    if not known:
        return found
    parts = {p for start, end, kind, _ in found if kind == "NAME" for p in text[start:end].split(" ")}
    pattern = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(parts, key=lambda p: (-len(p), p))))})(?!\w)", re.IGNORECASE)
    out, k = [], 0
    for m in pattern.finditer(text):
        while k < len(found) and found[k][1] <= m.start():
            k += 1
        apart = k == len(found) or m.end() <= found[k][0]
        if apart and m[0][0].isupper() and m[0].casefold() in known:
            out.append((*m.span(), "NAME", known[m[0].casefold()]))
    return sorted(found + out)


def units(value: str, kind: str, extra: str) -> list[tuple[str, str, str]]:
    """(kind, canonical form, shape) of what gets a surrogate of its own: a name's parts, an address's mailbox and domain, or the whole value.

    Equal canonical forms refer to the same thing, however they are written.
    """
    if kind == "NAME" and extra not in TITLES:  # a part by itself
        return [(extra, value.casefold(), value)]
    if kind == "NAME":
        parts = value.split(" ")
        return [(f"GIVEN_{extra}" if i < len(parts) - 1 else "FAMILY", p.casefold(), p) for i, p in enumerate(parts)]
    if kind == "EMAIL":
        box, _, domain = value.partition("@")
        return [("MAILBOX", value.lower(), box), ("DOMAIN", domain.lower(), domain)]
    if kind in ("CARD", "IBAN"):
        return [(kind, re.sub("[ -]", "", value), value)]
    if kind == "PHONE":
        return [(kind, re.sub("[^0-9]", "", value), value)]
    return [(kind, value, value)]


class _Stream:
    """Choices drawn from a keyed hash of kind, value and attempt."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int):
        self.make = lambda n: hmac.new(key, f"{kind}\0{canon}\0{attempt}\0{n}".encode("utf-8", "surrogatepass"), hashlib.sha512).digest()
        self.n, self.rest = 0, b""

    def below(self, n: int) -> int:
        if len(self.rest) < 4:
            self.rest, self.n = self.make(self.n), self.n + 1
        x, self.rest = int.from_bytes(self.rest[:4], "big"), self.rest[4:]
        return x % n


def _alike(canon: str, draw: _Stream) -> str:
    """Letters for letters, digits for digits; a hexadecimal value stays hexadecimal."""
    hexadecimal = re.fullmatch("[0-9a-f]+|[0-9A-F]+", canon) is not None and len(canon) >= 12
    letters = "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"
    out = []
    for c in canon:
        if c.isascii() and c.isdigit():
            out.append("0123456789"[draw.below(10)])
        elif c.isascii() and c.isalpha():
            x = letters[draw.below(len(letters))]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The surrogate of a canonical form, itself in canonical form. Each attempt gives another one."""
    draw = _Stream(key, kind, canon, attempt)
    if kind == "MAILBOX":
        return _alike(canon.partition("@")[0] + "a" * (attempt // 4), draw)  # grows where its shape has too few values
    if kind == "DOMAIN":
        name, dot, top = canon.rpartition(".")
        return _alike(name + "a" * (attempt // 4), draw) + dot + top
    if kind == "IP":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "CARD":
        body = canon[:4] + "".join(str(draw.below(10)) for _ in canon[4:-1])
        return body + str(-_luhn(body + "0") % 10)
    if kind == "IBAN":
        body = _alike(canon[4:], draw)
        return f"{canon[:2]}{98 - _iban_rest(canon[:2] + '00' + body):02d}{body}"
    if kind == "PHONE":
        return canon[:1] + "".join(str(2 + draw.below(8)) if i == 0 else str(draw.below(10)) for i in range(len(canon) - 1))
    if kind == "FAMILY" or kind.startswith("GIVEN"):
        pool = NAMES[script_of(canon)]
        if kind == "FAMILY":
            middle = "".join(pool["end"][draw.below(len(pool["end"]))] for _ in range(attempt // 4))
            return pool["stem"][draw.below(len(pool["stem"]))].casefold() + middle + pool["end"][draw.below(len(pool["end"]))]
        name = pool[kind[-1]][draw.below(len(pool[kind[-1]]))].casefold()
        return name + "".join("-" + pool[kind[-1]][draw.below(len(pool[kind[-1]]))].casefold() for _ in range(-(-attempt // 4)))
    return _alike(canon, draw)


def _dressed(new: str, shape: str, kind: str) -> str:
    """A canonical surrogate in the spelling of what it replaces: its separators, its case."""
    if kind in ("CARD", "IBAN", "PHONE"):
        left = iter(new)
        return "".join(next(left) if c.isalnum() else c for c in shape)
    if kind == "FAMILY" or kind.startswith("GIVEN"):
        return new.upper() if shape.isupper() and len(shape) > 1 else new.title()
    if kind in ("MAILBOX", "DOMAIN"):
        return new.upper() if shape.isupper() else new.title() if shape.istitle() else new
    return new


def rewrite(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, int]:
    """The text with surrogates, and how many values it had."""
    spans = find(text)
    out, last = [], 0
    for start, end, kind, extra in spans:
        parts = [_dressed(surrogate(key, k, canon, attempts.get((k, canon), 0)), shape, k) for k, canon, shape in units(text[start:end], kind, extra)]
        out += [text[last:start], ("@" if kind == "EMAIL" else " ").join(parts)]
        last = end
    return ("".join(out) + text[last:], len(spans)) if spans else (text, 0)


def _occurrences(docs: DataFrame) -> DataFrame:
    """(of, kind, canon) of all values; `of` is a hash of the text they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kinds, canons = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for k, canon in {u[:2] for start, end, what, extra in find(text) for u in units(text[start:end], what, extra)}:
                    at.append(i)
                    kinds.append(k)
                    canons.append(canon)
            yield pa.RecordBatch.from_arrays([b.column("of").take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(canons, pa.string())], ["of", "kind", "canon"])

    text = F.col("text").cast("string")
    return docs.select(F.xxhash64(text).alias("of"), text.alias("text")).mapInArrow(run, "of long, kind string, canon string")


def _with_surrogate(values: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(key, *x) for x in zip(b.column("kind").to_pylist(), b.column("canon").to_pylist(), b.column("attempt").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("canon"), b.column("attempt"), pa.array(new, pa.string())], ["kind", "canon", "attempt", "surrogate"])

    return values.select("kind", "canon", "attempt").mapInArrow(run, "kind string, canon string, attempt int, surrogate string")


def attempts_for(values: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, attempt) of the values whose first surrogate is another's too, or equals a value of the corpus.

    Of those that share a surrogate the smallest value keeps it, settled ones first; the others try again until all differ. Only they are
    worked on in further rounds. A kind whose shape has too few surrogates for its values is an error after MOST_TRIES of them.
    """
    values = written(values.select("kind", "canon").distinct(), "pii-values")
    # no surrogate domain is a real one, so no surrogate address can be
    real = values.where(F.col("kind") != "MAILBOX").select("kind", F.col("canon").alias("surrogate")).distinct()
    within = F.when(F.col("kind") == "MAILBOX", F.regexp_extract("canon", "@(.*)$", 1)).otherwise("")  # a mailbox has to differ from others of its domain
    cell, value = ["kind", "within", "surrogate"], ["kind", "canon"]
    settled: list[DataFrame] = []
    pending, made = values, [values]
    for attempt in range(MOST_TRIES):
        tried = written(_with_surrogate(pending.withColumn("attempt", F.lit(attempt)), key).withColumn("within", within), "pii-tried")
        owner = tried.groupBy(*cell).agg(F.min("canon").alias("owner"))
        clash = tried.join(owner, cell).where("owner <> canon").select(*value).union(tried.join(real, ["kind", "surrogate"], "left_semi").select(*value))
        for earlier in settled:
            clash = clash.union(tried.join(earlier, cell, "left_semi").select(*value))
        pending = written(clash.distinct(), "pii-again")
        done = written(tried.join(pending, value, "left_anti"), "pii-settled")
        discard(tried)
        made += [pending, done]
        settled.append(done)
        if pending.isEmpty():
            break
    else:
        raise ValueError(f"more values of kind {pending.first()['kind']} than {MOST_TRIES} surrogates each can tell apart")
    out = settled[0].where("attempt > 0").select("kind", "canon", "attempt")
    for part in settled[1:]:
        out = out.union(part.select("kind", "canon", "attempt"))
    out = written(out, "pii-retried")
    discard(*made)
    return out


def with_surrogates(docs: DataFrame, key: bytes, count: str | None = None) -> DataFrame:
    """docs with every detected value in `text` replaced; n_chars, where present, follows. count: a column for the number of values.

    Found are mail and IP addresses, phone, card, account and social-security numbers, secrets, titled names and all
    capitalised mentions of these names' parts in the same text; numbers with a check digit only if it is right. A value has one surrogate throughout the corpus and no two values share one (see attempts_for); names
    keep their gender and script, other values their lengths, separators, character classes and check digits.
    Null and empty texts stay as they are. Repeated rows are rewritten alike; other columns pass through; an empty table gives none.
    """
    occurrences = written(_occurrences(docs), "pii-found")
    retried = attempts_for(occurrences, key)
    columns = docs.columns
    tried = None
    if not retried.isEmpty():
        tried = next(name for name in (f"__tried{i}" for i in range(len(columns) + 1)) if name not in columns)
        entry = F.struct(F.concat_ws("\x00", "kind", "canon").alias("k"), "attempt")
        of_text = occurrences.join(if_small(retried), ["kind", "canon"]).groupBy(F.col("of").alias(f"{tried}of")).agg(F.map_from_entries(F.collect_set(entry)).alias(tried))
        of_text = if_small(written(of_text, "pii-maps"))
        docs = docs.join(of_text, F.xxhash64(docs["text"].cast("string")) == F.col(f"{tried}of"), "left").select(*[docs[f"`{c}`"] for c in columns], tried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = b.column(tried).to_pylist() if tried else [None] * b.num_rows
            new = [rewrite(t, key, {tuple(k.split("\x00")): n for k, n in m} if m else {}) for t, m in zip(b.column("text").to_pylist(), maps, strict=True)]
            arrays = dict(zip(b.schema.names, b.columns, strict=True)) | {"text": pa.array([t for t, _ in new], pa.string())}
            if "n_chars" in arrays:
                sizes = [len(t) if n else old for (t, n), old in zip(new, arrays["n_chars"].to_pylist(), strict=True)]
                arrays["n_chars"] = pa.array(sizes, arrays["n_chars"].type)
            if count:
                arrays[count] = pa.array([n for _, n in new], pa.int64())
            names = [*columns, *([count] if count else [])]
            yield pa.RecordBatch.from_arrays([arrays[c] for c in names], names)

    schema = docs.select(*[F.col(f"`{c}`") for c in columns]).schema
    if count:
        schema = schema.add(count, "long")
    return docs.mapInArrow(run, schema)
