"""Small text functions: messages, commands, locales, fuzzy comparisons of evaluations."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest message, languages, commands by their synonyms, longest text that is still an answer.
MESSAGE_LIMIT = 4096
LOCALES = ("tr", "de", "en")
COMMANDS = {
    "start": "start", "onayla": "consent", "zustimmen": "consent", "agree": "consent", "taslak": "draft", "entwurf": "draft", "draft": "draft",
    "profil": "profile", "profile": "profile", "atla": "skip", "ueberspringen": "skip", "skip": "skip", "gec": "next", "weiter": "next", "next": "next",
    "sil": "delete", "loeschen": "delete", "delete": "delete", "yardim": "help", "hilfe": "help", "help": "help",
}
ANSWER_LIMIT = 80


def message_parts(text: Column, limit: int = MESSAGE_LIMIT) -> Column:
    """A text in parts of at most `limit` characters: cut at the last line end within the limit, else at the limit; one line end at a cut goes."""
    done = lambda s: F.length(s["rest"]) <= limit

    def step(s: Column, _: Column) -> Column:
        window = F.substring(s["rest"], 1, limit + 1)
        at = F.length(window) - F.locate("\n", F.reverse(window))  # characters before the last line end
        cut = F.when(F.contains(window, F.lit("\n")) & (at > 0), at).otherwise(F.lit(limit))
        rest = F.substr(s["rest"], cut + 1)
        rest = F.when(rest.startswith("\n"), F.substr(rest, F.lit(2))).otherwise(rest)
        moved = F.struct(F.concat(s["parts"], F.array(F.substr(s["rest"], F.lit(1), cut))).alias("parts"), rest.alias("rest"))
        return F.when(done(s), s).otherwise(moved)

    # a cut ends at a line end or takes the whole limit, so there are no more of them than both together; the fold stops moving when the rest fits
    rounds = F.sequence(F.lit(0), F.ceil(F.length(text) / limit).cast("int") + F.regexp_count(text, F.lit("\n")))
    start = F.struct(F.array().cast("array<string>").alias("parts"), text.alias("rest"))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.aggregate(rounds, start, step, lambda s: F.concat(s["parts"], F.when(s["rest"] != "", F.array(s["rest"])).otherwise(F.array().cast("array<string>")))))


class MessageParts:
    """The same as a table function, for texts of many parts: eval yields (part, chunk)."""

    def eval(self, text: str, limit: int) -> Iterator[tuple[int, str]]:
        part, rest = 0, text or ""
        while True:
            cut = len(rest)
            if cut > limit:
                cut = rest.rfind("\n", 0, limit + 1)
                cut = cut if cut > 0 else limit
            yield part, rest[:cut]
            after = rest[cut:]
            if not after:
                return
            rest = after[1:] if after[0] == "\n" else after
            part += 1
            if not rest:
                return


def locale_of(code: Column) -> Column:
    """One of LOCALES by a code's first two letters; English if it is another or null."""
    two = F.lower(F.substring(F.trim(code), 1, 2))
    return F.when(two.isin(*LOCALES), two).otherwise("en")


def approval(callback: Column) -> Column:
    """struct(action, draft_id) of approve:<id> or reject:<id>, else null."""
    shape = "(?s)^(approve|reject):(.+)$"
    return F.when(callback.rlike(shape), F.struct(F.regexp_extract(callback, shape, 1).alias("action"), F.regexp_extract(callback, shape, 2).alias("draft_id")))


def command(text: Column) -> Column:
    """The word behind a leading slash, up to white space or @, lower-cased; null for other texts."""
    return F.when(text.startswith("/"), F.lower(F.regexp_extract(text, r"^/([^\s@]*)", 1)))


def command_meaning(word: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in COMMANDS.items() for x in (k, v)])[word]


def postcode_city(text: Column) -> Column:
    """struct(postal_code, city): five digits and a city, or all of it as city."""
    shape = r"^([0-9]{5})\s+(.+)$"
    t = F.trim(text)
    return F.struct(F.nullif(F.regexp_extract(t, shape, 1), F.lit("")).alias("postal_code"), F.when(t.rlike(shape), F.regexp_extract(t, shape, 2)).otherwise(t).alias("city"))


def given_family(name: Column) -> Column:
    """struct(given, family): first and last part of a name with two parts or more."""
    parts = F.filter(F.split(F.trim(name), r"\s+"), lambda p: F.length(p) >= 2)
    return F.when(F.size(parts) >= 2, F.struct(F.element_at(parts, 1).alias("given"), F.element_at(parts, -1).alias("family")))


def error_class(message: Column) -> Column:
    """What a failure is told as: the first kind whose words it holds."""
    return F.when(message.rlike("(?i)s[ıi]z[ıi]nt[ıi]|leak"), "leak").when(message.rlike("(?i)ocr"), "ocr").when(message.rlike("(?i)json|[şs]ema|schema|zod"), "format").otherwise("other")


def unsupported_image(message: Column) -> Column:
    return message.rlike("(?i)desteklenmeyen görsel|unsupported image|image type|media type")


def loosely_matches(got: Column, want: Column) -> Column:
    """Whether either, reduced to German letters, holds the other's first ten."""
    bare = lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-zäöüß]", "")
    a, b = bare(got), bare(want)
    return F.contains(a, F.substring(b, 1, 10)) | F.contains(b, F.substring(a, 1, 10))


def names_overlap(a: Column, b: Column) -> Column:
    """Whether one name holds the other, letter case and white space aside; empty ones never do."""
    bare = lambda x: F.regexp_replace(F.lower(x), r"\s", "")
    return (bare(a) != "") & (bare(b) != "") & (F.contains(bare(a), bare(b)) | F.contains(bare(b), bare(a)))


def html_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def slot_texts(items: Column, most: int | None = None) -> Column:
    """Items with white space collapsed, without empty ones; the first `most`, if given."""
    clean = F.filter(F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.slice(clean, 1, most) if most else clean


def profile_token(field: Column) -> Column:
    return F.concat(F.lit("profile:"), field)


def field_of_token(token: Column, fields: tuple[str, ...]) -> Column:
    name = F.regexp_extract(token, "^profile:(.*)$", 1)
    return F.when(name.isin(*fields), name)
