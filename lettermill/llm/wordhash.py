"""Vectorised 64-bit hashes of words and word windows, for use inside tasks.

Words are maximal runs of bytes other than blank and the controls 9 to 13, so UTF-8 needs no decoding.
A word is read eight bytes at a time; each step is a bijection of the state, begun from the length, so that words of up to eight
bytes differ whenever their bytes do. Bytes are looked at in blocks, so what grows with a text is a few numbers for each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_WINDOW = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], np.uint64)
#: Fixed mixing constants of the splitmix64 finaliser, and its increment.
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Between tokens: spaces and ASCII punctuation.
_PUNCTUATED = _SPACE.copy()
_PUNCTUATED[[b for b in range(128) if not chr(b).isalnum()]] = True
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: The first k bytes of a little-endian number.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Bytes that are looked at together, and words longer than this are hashed one by one.
BLOCK, LONG = 1 << 20, 256


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= _MIX[0]
        x ^= x >> np.uint64(27)
        x *= _MIX[1]
        x ^= x >> np.uint64(31)
    return x


def raw(text: pa.Scalar | str | bytes | None) -> np.ndarray:
    """A text's UTF-8 bytes, of an Arrow value without a copy."""
    if isinstance(text, pa.Scalar):
        text = text.as_buffer() if text.is_valid else b""
    elif isinstance(text, str):
        text = text.encode("utf-8", "surrogatepass")
    return np.frombuffer(text or b"", np.uint8)


def spans(data: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word; `apart` tells the bytes between words."""
    edges, inside = [], False
    for lo in range(0, len(data), BLOCK):
        word = ~apart[data[lo : lo + BLOCK]]
        edge = np.flatnonzero(word[1:] != word[:-1]) + (lo + 1)
        edges.append(edge if word[0] == inside else np.concatenate(([lo], edge)))
        inside = bool(word[-1])
    if inside:
        edges.append(np.array([len(data)]))
    edge = np.concatenate(edges) if edges else np.empty(0, np.int64)
    return edge[0::2], edge[1::2]


def _eights(data: np.ndarray) -> tuple[np.ndarray, int]:
    """The eight bytes from each place on as one number, for all places but the last eight; also the number of such places."""
    n = max(0, len(data) - 8)
    return np.ndarray((n,), "<u8", data.data if n else b"", 0, (1,)), n


def spanned(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; spans are in order and end at or before the end of data."""
    many, inner = _eights(data)
    tail_at = max(0, len(data) - 16)
    tail, _ = _eights(np.concatenate([data[tail_at:], np.zeros(16, np.uint8)]))
    size = end - start

    def eight(at: np.ndarray) -> np.ndarray:
        k = int(np.searchsorted(at, inner)) if len(at) else 0  # places are in order
        return np.concatenate([many[at[:k]], tail[at[k:] - tail_at]]) if k < len(at) else many[at]

    with np.errstate(over="ignore"):
        out = mix(mix(size.astype(np.uint64) * _STEP) ^ (eight(start) & _FIRST[np.minimum(size, 8)])) if len(start) else np.empty(0, np.uint64)
        at = np.flatnonzero((size > 8) & (size <= LONG))
        k = 8
        while len(at):
            out[at] = mix(out[at] + _STEP ^ (eight(start[at] + k) & _FIRST[np.minimum(size[at] - k, 8)]))
            k += 8
            at = at[size[at] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, fold: bool = False, punctuated: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word; fold lower-cases A to Z first, punctuated lets ASCII punctuation end words too."""
    if fold:
        data = _LOWER[data]
    start, end = spans(data, _PUNCTUATED if punctuated else _SPACE)
    return spanned(data, start, end), start, end


def windows(code: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of `width` consecutive words."""
    n = len(code) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, width, np.uint64)
        for i in range(width):
            if i and i % len(_WINDOW) == 0:
                out = mix(out)
            out += code[i : i + n] * _WINDOW[i % len(_WINDOW)]
        return mix(out)


def stretches(texts: pa.Array, limit: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A column of texts in stretches of about `limit` bytes (BLOCK unless told), or one longer text: its first row, its bytes, and where each of its texts begins and the last ends."""
    limit = limit or BLOCK
    _, places, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = min(len(texts), max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1))
        yield lo, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text's bytes in parts of about BLOCK, cut at spaces; words stay whole."""
    lo = 0
    while lo < len(data):
        hi = lo + BLOCK
        while hi < len(data):
            near = np.flatnonzero(_SPACE[data[hi : hi + BLOCK]])
            hi += int(near[0]) if len(near) else BLOCK
            if len(near):
                break
        yield data[lo:hi]
        lo = hi


def words_of(data: np.ndarray, at: np.ndarray, fold: bool = False, punctuated: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie side by side: their hashes, the first word of each text and the end of the last one's, and each word's first byte and end."""
    if fold:
        data = _LOWER[data]
    apart = _PUNCTUATED if punctuated else _SPACE
    start, end = spans(data, apart)
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    torn = np.unique(inner[~apart[data[inner]] & ~apart[data[inner - 1]]])  # nothing between two texts
    if len(torn):
        start, end = np.sort(np.concatenate([start, torn])), np.sort(np.concatenate([end, torn]))
    return spanned(data, start, end), np.searchsorted(start, at), start, end


def _short(code: np.ndarray) -> np.ndarray:
    """The one shingle of a text with too few words."""
    with np.errstate(over="ignore"):
        whole = np.array([len(code)], np.uint64)
        for k in range(len(code)):
            whole = mix(whole * _WINDOW[0] + code[k : k + 1])
    return whole


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sets of distinct shingle hashes, sorted, of a column of texts: the first row of a stretch, the sets' sizes, and the sets side by side.

    A text of fewer words than `width` is one shingle, one without words has none.
    """
    for row, data, at in stretches(texts):
        code, first, _, _ = words_of(data, at, fold=True)
        w = windows(code, width)
        parts, sizes = [], np.zeros(len(at) - 1, np.int64)
        for i in range(len(at) - 1):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= width:
                x = np.sort(w[lo : hi - width + 1])
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif hi > lo:
                x = _short(code[lo:hi])
            else:
                continue
            parts.append(x)
            sizes[i] = len(x)
        yield row, sizes, np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The set of one text."""
    return next(shingle_sets(pa.array([text], pa.string()), width))[2]
