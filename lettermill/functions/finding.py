"""What a task does with one text: find spans, settle overlaps, look for known values, put tokens in their place.

Spark partitions the texts and works on what comes out; here are only the helpers that its Arrow functions call.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import regex

from .patterns import IBAN_REPAIR_SITES, IBAN_REPAIRS, NOT_A_NAME, ODD_FOLDS, WS
from .tolerance import DIGRAPHS, _read, readings

_SPACES = re.compile(f"{WS}+")
_STOP = re.compile(f"(?:^|{WS})(?:{'|'.join(NOT_A_NAME)})[.,;:]?(?:{WS}|$)")
_ODD = re.compile(f"[{ODD_FOLDS}]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}")
_BLANK = frozenset(chr(c) for c in range(0x10000) if _SPACES.fullmatch(chr(c)))
#: What only one of str.split and WS takes for white space.
_DISPUTED = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x10000) if chr(c).isspace() != (chr(c) in _BLANK)) + "]")


class Span(NamedTuple):
    start: int
    end: int
    original: str
    type: str
    strategy: str
    ord: int


def folded(text: str) -> str:
    """Compatibility forms folded, lower-cased, white space collapsed and trimmed."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if _DISPUTED.search(text):
        return _SPACES.sub(" ", text.lower()).strip(" ")
    return " ".join(text.lower().split())


# ---- what a found value must fulfil


def plausible_name(value: str) -> bool:
    name = value.strip(" ")
    return len(name) >= 3 and not _STOP.search(name.lower()) and (_SPACES.search(name) is not None or name != name.upper())


def plausible_tax_id(value: str) -> bool:
    d = re.sub("[^0-9]", "", value)
    first = d[:10]
    return len(d) == 11 and d[0] != "0" and len(set(first)) >= 8 and sum(first.count(c) > 1 for c in set(first)) <= 1


def valid_iban(value: str) -> bool:
    """Shape and remainder 1 modulo 97, without spaces and dashes, in any case."""
    compact = _SPACES.sub("", value).replace("-", "").upper()
    return _IBAN.fullmatch(compact) is not None and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def readable_iban(value: str) -> bool:
    """Valid as it stands, or with some of its few misread glyphs read otherwise."""
    compact = _SPACES.sub("", value).replace("-", "")
    if valid_iban(compact):
        return True
    body = compact[2:]
    if len(compact) < 5 or not 0 < sum(c in IBAN_REPAIRS for c in body) <= IBAN_REPAIR_SITES:
        return False
    read = [compact[:2]]
    for c in body:
        read = [r + x for r in read for x in c + IBAN_REPAIRS.get(c, "")]
    return any(map(valid_iban, read))


def phone_length(value: str) -> bool:
    return 7 <= sum("0" <= c <= "9" for c in value) <= 15


# ---- spans


@lru_cache(maxsize=256)
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


_LATIN = {kind: "".join(chr(c) for c in range(256) if unicodedata.category(chr(c)).startswith(kind)) for kind in ("Lu", "L")}


@lru_cache(maxsize=256)
def _latin(pattern: str) -> re.Pattern:
    """The pattern for texts of Latin-1 characters, among which both engines mean the same."""
    return re.compile(pattern.replace(r"\p{Lu}", f"[{_LATIN['Lu']}]").replace(r"\p{L}", _LATIN["L"]))


@lru_cache(maxsize=256)
def _set(chars: str) -> frozenset[str]:
    inside = re.compile(f"[{chars}]")
    return frozenset(c for c in map(chr, range(256)) if inside.match(c))


_DIGITS = re.compile("[0-9]+")


def _quick_matches(text: str, low: str, runs: list[tuple[int, int]], pattern: str, ways: tuple) -> Iterable[re.Match]:
    """What the pattern finds in a text of Latin-1 characters, tried only where a match can begin. runs: the text's digit runs."""
    starts, low_starts, digits, behind, core, lead, head, quick = ways
    if quick:
        return _latin(quick).finditer(text)
    out, last = [], 0
    if core:
        hits = [m.start() for m in _latin(core).finditer(text)] if len(core) > 1 else _all(text, core)
        if hits:
            chars, first, match = _set(lead), _set(head), _latin(pattern).match
            for stop in hits:
                at = stop
                while at > last and text[at - 1] in chars:
                    at -= 1
                for start in range(at, stop):
                    if text[start] in first and (m := match(text, start)):
                        out.append(m)
                        last = m.end()
                        break
        return out
    places = []
    for s in starts:
        if s in text:
            places += _all(text, s)
    for s in low_starts:
        if s in low:
            places += _all(low, s)
    if digits:
        end = len(text)
        places += [a for a, b in runs if (b - a in digits or b - a > 63) and (not behind or b < end and text[b] in behind) and (not starts or text[a] == "0")]
    if places:
        match = _latin(pattern).match
        for start in sorted(set(places)) if len(places) > 1 else places:
            if start >= last and (m := match(text, start)):
                out.append(m)
                last = m.end()
    return out


def _all(text: str, piece: str) -> list[int]:
    """Where a piece begins in the text."""
    out, at = [], text.find(piece)
    while at >= 0:
        out.append(at)
        at = text.find(piece, at + 1)
    return out


def pattern_spans(text: str, recognisers: Iterable[tuple]) -> list[Span]:
    """Spans of recognisers given as (order, kind, pattern, group, check, hints, signs, quicker ways); without one of its hints, or of its signs in lower case, a text is not searched."""
    out, low, latin = [], text.lower(), _is_latin(text)
    runs = [m.span() for m in _DIGITS.finditer(text)] if latin else []
    for place, kind, pattern, group, check, hints, signs, *more in recognisers:
        ways = more[0] if more else ()
        quicker = latin and any(ways)
        if hints and not (quicker and ways[0]):
            for h in hints:
                if h in text:
                    break
            else:
                continue
        if signs:
            for h in signs:
                if h in low:
                    break
            else:
                continue
        for m in _quick_matches(text, low, runs, pattern, ways) if quicker else _compiled(pattern).finditer(text):
            value = m[group]
            if value is None:
                continue
            start = m.start() + (m[0].find(value) if group else 0)
            if group and not latin and _ODD.search(text, m.start(), m.start(group)):
                continue
            value = value.rstrip(" ")
            if value and (check is None or check(value)):
                out.append(Span(start, start + len(value), value, kind, "pattern", 1000 + place))
    return out


def _is_latin(text: str) -> bool:
    try:
        return text.isascii() or text.encode("latin-1") is not None
    except UnicodeEncodeError:
        return False


def resolved(spans: list[Span]) -> list[Span]:
    """Spans without overlaps: earliest start first, then the longer one, then known values, then the order they were found in."""
    out, last = [], -1
    for s in sorted(spans, key=lambda s: (s.start, -s.end, s.strategy != "known-value", s.ord)):
        if s.start >= last:
            out.append(s)
            last = s.end
    return out


def _end(text: str, units: tuple[tuple[str, ...] | None, ...], k: int, at: int) -> int | None:
    """Where a match of units from the k-th on ends that begins at `at`; the first reading that leads to the end counts, white space is taken whole."""
    while k < len(units):
        unit = units[k]
        if unit is None:
            stop = at
            while stop < len(text) and text[stop] in _BLANK:
                stop += 1
            if stop == at:
                return None
            k, at = k + 1, stop
            continue
        fit = [r for r in unit if text.startswith(r, at)]
        if not fit:
            return None
        if len(fit) > 1:
            return next((end for r in fit if (end := _end(text, units, k + 1, at + len(r))) is not None), None)
        k, at = k + 1, at + len(fit[0])
    return at


@lru_cache(maxsize=1 << 14)
def _head(units: tuple[tuple[str, ...] | None, ...]) -> re.Pattern:
    """Finds where a value that begins with these one or two units can begin: at a first character of the one, before a first character of the other."""
    sets = ["[" + re.escape("".join(sorted({r[0] for r in unit}))) + "]" if unit else WS for unit in units]
    alone = len(sets) > 1 and units[0] and all(len(r) == 1 for r in units[0])
    return re.compile(f"{sets[0]}(?={sets[1]})" if alone else sets[0])


def _apart(text: str, value: str, starts: Iterable[int]) -> list[tuple[int, int]]:
    """The value's places among ascending starts, left to right, without overlaps."""
    units, out, last = readings(value), [], 0
    for at in starts:
        if at < last:
            continue
        # no reading of a piece begins like the piece itself, so the value as it is written is the only match where it stands
        end = at + len(value) if text.startswith(value, at) else _end(text, units, 0, at)
        if end is not None and end > at:
            out.append((at, end))
            last = end
    return out


class Automaton:
    """Finds where any of many values stands in a text, however it may have been misread, in one run over the text.

    Values are entered from their end into a trie whose edges are what a piece may have been read as, character by character, so a run from the
    text's end stops where values begin. The sets of trie nodes that are alive at the same time are the automaton's states; they are made when a
    text first leads to them, and each next character is then one look-up, whatever the number of values.
    """

    #: States kept; an automaton with more begins anew from the set that it is in.
    MOST = 1 << 16

    def __init__(self, values: Iterable[str]):
        self.values = list(values)
        self.edges: list[dict[str, set[int]]] = [{}]  # of each node of the trie: characters to nodes
        self.begins: dict[int, list[int]] = {}  # nodes at which values are complete
        children: dict[tuple[int, tuple[str, ...] | None], int] = {}
        for i, value in enumerate(self.values):
            at = 0
            for unit in reversed(readings(value)):
                if (at, unit) not in children:
                    children[at, unit] = self._grown(at, unit)
                at = children[at, unit]
            if at:
                self.begins.setdefault(at, []).append(i)
        self._forget()

    def _grown(self, parent: int, unit: tuple[str, ...] | None) -> int:
        child = len(self.edges)
        self.edges.append({})
        if unit is None:  # one blank or more
            for c in _BLANK:
                self.edges[parent].setdefault(c, set()).add(child)
                self.edges[child][c] = {child}
            return child
        for reading in unit:
            at = parent
            for k in range(len(reading) - 1, -1, -1):
                to = child
                if k:
                    to = len(self.edges)
                    self.edges.append({})
                self.edges[at].setdefault(reading[k], set()).add(to)
                at = to
        return child

    def _forget(self) -> None:
        self.number: dict[frozenset[int], int] = {frozenset({0}): 0}
        self.nodes: list[frozenset[int]] = [frozenset({0})]
        self.steps: list[dict[str, int]] = [{}]
        self.ended: list[list[int]] = [[]]

    def _step(self, state: int, char: str) -> int:
        to = frozenset().union({0}, *(self.edges[n].get(char, ()) for n in self.nodes[state]))
        if len(self.nodes) > self.MOST and to not in self.number:
            self._forget()
            state = None
        if to not in self.number:
            self.number[to] = len(self.nodes)
            self.nodes.append(to)
            self.steps.append({})
            self.ended.append(sorted(i for n in to for i in self.begins.get(n, ())))
        if state is not None:
            self.steps[state][char] = self.number[to]
        return self.number[to]

    def found(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Of the values that stand in the text, by number: their places, left to right, without overlaps of one value."""
        starts: dict[int, list[int]] = {}
        state = 0
        for at in range(len(text) - 1, -1, -1):
            char = text[at]
            following = self.steps[state].get(char)
            state = self._step(state, char) if following is None else following
            for i in self.ended[state]:
                starts.setdefault(i, []).append(at)
        return {i: _apart(text, self.values[i], reversed(many)) for i, many in sorted(starts.items())}

    def places(self, text: str) -> list[list[tuple[int, int]]]:
        """The places of each value."""
        found = self.found(text)
        return [found.get(i, []) for i in range(len(self.values))]


#: From so many values on an automaton looks for all of them at once.
MANY = 24


@lru_cache(maxsize=16)
def automaton(values: tuple[str, ...]) -> Automaton:
    return Automaton(values)


def _classes() -> bytes:
    """For each Latin-1 character one that stands for all that visible ASCII characters may have been read as, in any value: equal for what may be confused."""
    root = list(range(256))
    for c in range(0x21, 0x7F):
        for wide in (True, False):
            for r in _read(chr(c), wide):
                if ord(r) < 256:  # a single character; longer readings are an error
                    a, b = root[c], root[ord(r)]
                    root = [a if x == b else x for x in root]
    return bytes(root)


_CLASSES = _classes()
#: Pieces of a value that may have been read as more or fewer characters, or are none that can be seen.
_ELASTIC = re.compile("(?i:" + "|".join(DIGRAPHS) + ")|[^!-~]")


def _classed(text: str) -> bytes | None:
    """The text by classes of characters that may be confused; None if not all are Latin-1."""
    try:
        return text.encode("latin-1").translate(_CLASSES)
    except UnicodeEncodeError:
        return None


def _sole(text: str, classed: bytes, value: str) -> list[tuple[int, int]] | None:
    """The value's places if it stands nowhere or once, just as it is written; None if that cannot be told at a glance.

    Wherever the value stands, however misread, its longest stretch of simple characters has to stand by class. Where that is but once and
    the value is there as written, nothing else matches, as no reading of a piece ends or begins like the piece itself.
    """
    own = _classed(value)
    if not own or value[0] in _BLANK or value[-1] in _BLANK:  # a blank at an end takes as many as there are
        return None
    a = b = at = 0
    for m in _ELASTIC.finditer(value):
        if m.start() - at > b - a:
            a, b = at, m.start()
        at = m.end()
    if len(value) - at > b - a:
        a, b = at, len(value)
    if a == b:
        return None
    found = classed.find(core := own[a:b])
    if found < 0:
        return []
    if classed.find(core, found + 1) >= 0 or found < a or not text.startswith(value, found - a):
        return None
    return [(found - a, found - a + len(value))]


def places(text: str, values: tuple[str, ...], again: bool = False) -> list[list[tuple[int, int]]]:
    """Of each value its places in the text. again: the values come with other texts too, so what is built for them is kept."""
    if len(values) >= MANY:
        return (automaton(values) if again else Automaton(values)).places(text)
    classed = _classed(text)
    told = [None if classed is None else _sole(text, classed, v) for v in values]
    return [_apart(text, v, (m.start() for m in _head(units[:2]).finditer(text))) if t is None and (units := readings(v)) else t or [] for t, v in zip(told, values, strict=True)]


def masked(text: str, recognisers: list, known: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str, str, str]]]:
    """The text with tokens, and (token, original, type, strategy) of each in order of first appearance."""
    where = places(text, tuple(value for value, _ in known), again=True) if known else []
    spans = [Span(a, b, text[a:b], kind, "known-value", i) for i, ((_, kind), many) in enumerate(zip(known, where, strict=True)) for a, b in many]
    first = resolved(spans + pattern_spans(text, recognisers))
    # each value found is looked for in the whole text; of one key the first span tells type and spelling
    keyed: dict[str, Span] = {}
    keys = {s.original: folded(s.original) for s in first}
    for s in first:
        if len(key := keys[s.original]) > 3:
            keyed.setdefault(key, s)
    classed = _classed(text)
    if classed is not None:  # values that stand nowhere else
        keyed = {k: s for k, s in keyed.items() if _sole(text, classed, s.original) is None}
    where = places(text, tuple(s.original for s in keyed.values()))
    again = [Span(a, b, text[a:b], s.type, s.strategy, 100_000 + i) for i, (s, many) in enumerate(zip(keyed.values(), where, strict=True)) for a, b in many]
    tokens: dict[tuple[str, str], tuple[str, str, str, str]] = {}
    numbers: dict[str, int] = {}
    out, at = [], 0
    for s in resolved(first + again) if again else first:
        key = (s.type, keys.get(s.original) or folded(s.original))
        if key not in tokens:
            numbers[s.type] = numbers.get(s.type, 0) + 1
            tokens[key] = (f"[[{s.type}_{numbers[s.type]}]]", s.original, s.type, s.strategy)
        out += [text[at : s.start], tokens[key][0]]
        at = s.end
    return "".join(out) + text[at:], list(tokens.values())


# ---- many texts at once

#: What stands between texts that are searched at once. No pattern with quicker ways holds it or looks for it; a text that holds it is searched alone.
_BETWEEN = "\0"
#: Characters that are searched at once; a longer text is searched alone.
_AT_ONCE = 1 << 17


def masked_many(texts: Sequence[str], recognisers: list, known: Sequence[list[tuple[str, str]]]) -> list[tuple[str, list[tuple[str, str, str, str]]]]:
    """What masked makes of each text with its known values. Latin-1 texts are put together and each recogniser runs over many of them at once."""
    out: list = [None] * len(texts)
    some, size = [], 0
    for i, text in enumerate(texts):
        if len(text) >= _AT_ONCE or _BETWEEN in text or not _is_latin(text):
            out[i] = masked(text, recognisers, known[i])
            continue
        if size + len(text) > _AT_ONCE:
            _masked_at_once(some, texts, recognisers, known, out)
            some, size = [], 0
        some.append(i)
        size += len(text)
    if some:
        _masked_at_once(some, texts, recognisers, known, out)
    return out


def _masked_at_once(some: list[int], texts: Sequence[str], recognisers: list, known: Sequence[list[tuple[str, str]]], out: list) -> None:
    """Puts into out what becomes of some of the texts. Spans are (start, -end, whether no known value, order, original, type) here, in the order in which they count."""
    joined = _BETWEEN.join([*(texts[i] for i in some), ""])
    raw = joined.encode("latin-1")
    low = joined.lower()
    spans = _quick_spans(joined, low, raw, [r for r in recognisers if len(r) > 7 and any(r[7])])
    rest = [r for r in recognisers if len(r) <= 7 or not any(r[7])]
    at = 0
    for i in some:
        text = texts[i]
        if known[i]:
            where = places(text, tuple(value for value, _ in known[i]), again=True)
            spans += [(at + a, -at - b, False, k, text[a:b], kind) for k, ((_, kind), many) in enumerate(zip(known[i], where, strict=True)) for a, b in many]
        if rest:
            spans += [(at + s.start, -at - s.end, True, s.ord, s.original, s.type) for s in pattern_spans(text, rest)]
        at += len(text) + 1
    first = _apart_spans(spans)
    classed, elastic = raw.translate(_CLASSES), _elastic(low, raw)
    keys = {value: folded(value) for value in {s[4] for s in first}}
    at = k = 0
    for i in some:
        end, own = at + len(texts[i]), k
        while k < len(first) and first[k][0] < end:
            k += 1
        out[i] = _tokened(joined, at, end, first[own:k], classed, elastic, keys) if own < k else (texts[i], [])
        at = end + 1


def _quick_spans(joined: str, low: str, raw: bytes, recognisers: list) -> list[tuple]:
    """The spans of recognisers that have quicker ways, in texts put together."""
    codes = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff((codes - np.uint8(48)) < 10, prepend=False, append=False))
    begins, ends = edges[::2], edges[1::2]
    sizes = np.minimum(ends - begins, 64)
    out = []
    for place, kind, pattern, group, check, _, _, (starts, low_starts, digits, behind, core, lead, head, quick) in recognisers:
        if core or quick:
            found = _quick_matches(joined, low, [], pattern, (starts, low_starts, digits, behind, core, lead, head, quick))
        else:
            tried = [p for s in starts for p in _all(joined, s)] + [p for s in low_starts for p in _all(low, s)]
            if digits:
                fit = np.zeros(65, bool)
                fit[[*digits, 64]] = True
                fit = fit[sizes]
                if behind:
                    fit &= np.isin(codes[ends], list(behind.encode("latin-1")))
                if starts:
                    fit &= codes[begins] == 48
                tried += begins[fit].tolist()
            found, match, last = [], _latin(pattern).match, 0
            for start in sorted(set(tried)):
                if start >= last and (m := match(joined, start)):
                    found.append(m)
                    last = m.end()
        for m in found:
            value = m[group]
            if value is None:
                continue
            start = m.start() + (m[0].find(value) if group else 0)
            value = value.rstrip(" ")
            if value and (check is None or check(value)):
                out.append((start, -start - len(value), True, 1000 + place, value, kind))
    return out


def _apart_spans(spans: list[tuple]) -> list[tuple]:
    """resolved, for spans as tuples."""
    out, last = [], -1
    for s in sorted(spans):
        if s[0] >= last:
            out.append(s)
            last = -s[1]
    return out


def _elastic(low: str, raw: bytes) -> list[int]:
    """Where characters stand that may be part of a piece that was read as more or fewer characters, or cannot be seen; see _ELASTIC."""
    codes, lows = np.frombuffer(raw, np.uint8), np.frombuffer(low.encode("latin-1"), np.uint8)
    there = (codes < 0x21) | (codes > 0x7E)
    for a, b in DIGRAPHS:
        pair = (lows[:-1] == ord(a)) & (lows[1:] == ord(b))
        there[:-1] |= pair
        there[1:] |= pair
    return np.flatnonzero(there).tolist()


def _stands_once(span: tuple, at: int, end: int, classed: bytes, elastic: list[int]) -> bool:
    """Whether a value found in the text from at to end certainly stands nowhere else, by the reasons of _sole."""
    start, stop, value = span[0], -span[1], span[4]
    if value[0] in _BLANK or value[-1] in _BLANK:
        return False
    a = b = begun = start
    k = bisect_left(elastic, start)
    while k < len(elastic) and elastic[k] < stop:
        if elastic[k] - begun > b - a:
            a, b = begun, elastic[k]
        begun = elastic[k] + 1
        k += 1
    if stop - begun > b - a:
        a, b = begun, stop
    core = classed[a:b]
    return a < b and classed.find(core, at, end) == a and classed.find(core, a + 1, end) < 0


def _tokened(joined: str, at: int, end: int, spans: list[tuple], classed: bytes, elastic: list[int], keys: dict[str, str]) -> tuple[str, list[tuple[str, str, str, str]]]:
    """What masked makes of the text from at to end, given its spans. keys: their values, folded."""
    keyed: dict[str, tuple] = {}
    for s in spans:
        if len(key := keys[s[4]]) > 3 and key not in keyed:
            keyed[key] = s
    others = [s for s in keyed.values() if not _stands_once(s, at, end, classed, elastic)]
    if others:
        text = joined[at:end]
        where = places(text, tuple(s[4] for s in others))
        again = [(at + a, -at - b, s[2], 100_000 + i, text[a:b], s[5]) for i, (s, many) in enumerate(zip(others, where, strict=True)) for a, b in many]
        spans = _apart_spans(spans + again)
    tokens: dict[tuple[str, str], tuple[str, str, str, str]] = {}
    numbers: dict[str, int] = {}
    out = []
    for start, stop, pattern, _, value, kind in spans:
        key = (kind, keys.get(value) or folded(value))
        made = tokens.get(key)
        if made is None:
            numbers[kind] = n = numbers.get(kind, 0) + 1
            made = tokens[key] = (f"[[{kind}_{n}]]", value, kind, "pattern" if pattern else "known-value")
        out += (joined[at:start], made[0])
        at = -stop
    return "".join(out) + joined[at:end], list(tokens.values())
