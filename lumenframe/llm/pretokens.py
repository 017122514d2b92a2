"""The matches of the tokenizers' splitting pattern, found for many texts at once.

The pattern takes, at each place, the first that fits of: a contraction
('s 't 're 've 'm 'll 'd); letters, numbers, or other signs, each run with at
most one blank before it; white space up to the last one before something else;
any white space.  All of that follows from the class of each code point and of
its neighbours, so array operations find every boundary.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

LETTER, NUMBER, OTHER, BLANK = 0, 1, 2, 3
#: Code points with Unicode's White_Space property.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What may follow an apostrophe in a contraction, in the pattern's order.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything = "".join(map(chr, points))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, everything):
            out[points[m.start()] : points[m.end() - 1] + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[list(WHITE_SPACE)] = BLANK
    return out


@dataclass
class Pieces:
    """Matches in a run of texts, by bytes of the joined texts."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # index of each text's first match, one more than there are texts


def pieces(data: np.ndarray, offsets: np.ndarray) -> Pieces:
    """The matches of each text, in order; together they are the text."""
    if not len(data):
        return Pieces(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    if data.max() < 0x80:
        points, byte_at = data, None
    else:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    n = len(points)
    kind = classes()[points]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets if byte_at is None else np.searchsorted(byte_at, offsets)] = True
    first, last = edge[:-1], edge[1:]

    begins = np.ones(n, dtype=bool)  # of runs of one class
    begins[1:] = kind[1:] != kind[:-1]
    begins |= first
    blank = kind == BLANK
    ends_blank = np.zeros(n, dtype=bool)  # the last blank before something else
    ends_blank[:-1] = blank[:-1] & ~blank[1:]
    ends_blank &= ~last
    joins = ends_blank & (points == 0x20)  # a blank that goes with what follows
    start = begins & ~blank
    start[1:] &= ~joins[:-1]
    start |= blank & begins
    start |= ends_blank

    quote = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & ~last[:-1]) if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        one = points[quote + 1]
        two = np.where((quote + 2 < n) & ~last[np.minimum(quote + 1, n - 1)], points[np.minimum(quote + 2, n - 1)], 0)
        size = np.zeros(len(quote), dtype=np.int64)
        for text in reversed(CONTRACTIONS):
            fits = (one == ord(text[0])) & ((two == ord(text[1])) if len(text) == 2 else True)
            size[fits] = len(text)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + 1 + size
        inside = after < n
        start[after[inside]] = True
    at = np.flatnonzero(start)
    if byte_at is not None:
        at = byte_at[at]
    return Pieces(data, at, np.append(at[1:], len(data)), np.searchsorted(at, offsets))
