"""The stretch of a masked text that is most like a value, as a check that shares no rule with the masking.

Windows are first told apart by how many of their characters and pairs of characters the value has, counted for all places of the text at
once; edit distances of those left come from bit vectors, which give all lengths of a window that begins at one place in one run.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\[\[[A-Z]+_[0-9]+\]\]")
RESIDUE = "struct<value:string,window:string,score:double>"
#: Fixed value: the similarity from which a stretch counts as a residue.
LEAST = 0.8


def lowered(text: str) -> str:
    """Lower case, character by character: those whose lower case is longer stay, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def distances(masks: dict[str, int], size: int, text: str, start: int, longest: int) -> Iterator[int]:
    """Edit distance of the value to text[start : start + n], for n from 1 to longest. masks: of each of its characters, a bit for each place that has it."""
    whole, top = (1 << size) - 1, 1 << (size - 1)
    more, less, distance = whole, 0, size  # bits: where a column's numbers rise and fall from place to place
    for c in text[start : start + longest]:
        same = masks.get(c, 0)
        across = same | less
        down = (((same & more) + more) ^ more) | same
        up = less | (whole & ~(down | more))
        fall = more & down
        if up & top:
            distance += 1
        elif fall & top:
            distance -= 1
        up = (up << 1) | 1  # the first row rises by one a character, as all of a window counts
        fall <<= 1
        more = (fall | ~(across | up)) & whole
        less = up & across & whole
        yield distance


class Text:
    """A masked text, without its tokens, in which values are looked for."""

    def __init__(self, masked: str):
        self.hay = _TOKEN.sub(" ", masked)
        self.low = lowered(self.hay)
        self.codes = np.frombuffer(self.low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.pairs = self.codes[:-1] << 21 | self.codes[1:]

    def _starts(self, needle: str, low: int, high: int, least: float) -> np.ndarray:
        """Places at which a window long enough may reach `least`.

        d edits leave all but d of a window's characters, and all but 2 d of its pairs, among the value's.
        """
        codes = np.frombuffer(needle.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        known = np.concatenate([[0], np.cumsum(np.isin(self.codes, np.unique(codes)))])
        paired = np.concatenate([[0], np.cumsum(np.isin(self.pairs, np.unique(codes[:-1] << 21 | codes[1:])))])
        likely = np.zeros(len(self.codes), bool)
        for n in range(low, min(high, len(self.codes)) + 1):
            longest = max(n, len(needle))
            edits = math.floor((1 - least) * longest + 1e-9)
            fits = known[n:] - known[:-n] >= longest - edits
            fits &= paired[n - 1 :] - paired[: len(paired) - n + 1] >= longest - 1 - 2 * edits
            likely[: len(fits)] |= fits
        return np.flatnonzero(likely)

    def residue(self, value: str, least: float = LEAST) -> tuple[str, float] | None:
        """The window most like the value and its similarity, if any reaches `least`; of equal ones the shortest, then the leftmost."""
        needle, size = lowered(value), len(value)
        if not size:
            return None
        low, high = max(4, math.floor(size * 0.75)), math.ceil(size * 1.25)
        masks: dict[str, int] = {}
        for i, c in enumerate(needle):
            masks[c] = masks.get(c, 0) | 1 << i
        best, found = (least, -math.inf, 0), None
        for start in self._starts(needle, low, high, least).tolist():
            for n, d in enumerate(distances(masks, size, self.low, start, high), 1):
                score = 1 - d / max(n, size)
                if n >= low and (score, -n, -start) > best:
                    best, found = (score, -n, -start), (start, n)
        if found is None:
            return None
        start, n = found
        return self.hay[start : start + n], best[0]


def residues(masked: Column, values: Column, least: float = LEAST) -> Column:
    """array<struct(value, window, score)> of those of the values (an array) that a masked text still resembles somewhere, in their order.

    Windows have three quarters to five quarters of a value's length, 4 at least. A null text or array gives null; null and empty values have
    no residue.
    """

    @F.arrow_udf(f"array<{RESIDUE}>")
    def run(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for masked, many in zip(texts.to_pylist(), wanted.to_pylist(), strict=True):
            if masked is None or many is None:
                out.append(None)
                continue
            text = Text(masked)
            hits = [(v, text.residue(v, least)) for v in many if v]
            out.append([{"value": v, "window": hit[0], "score": hit[1]} for v, hit in hits if hit])
        return pa.array(out, pa.list_(pa.struct([("value", pa.string()), ("window", pa.string()), ("score", pa.float64())])))

    return run(masked, values)


def residue(masked: Column, value: Column, least: float = LEAST) -> Column:
    """struct(value, window, score) of the stretch of masked text most like the value, null if none reaches `least`."""
    return F.get(residues(masked, F.array(value), least), F.lit(0))
