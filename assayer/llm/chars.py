"""Code-point tables for numpy stages: class and lower case of every code point."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LIMIT = 0x110000


@functools.cache
def classes() -> np.ndarray:
    """uint8 class of each code point: letter (L*), number (N*), white space, other."""
    kind = {"L": LETTER, "N": NUMBER}
    category = unicodedata.category
    out = np.fromiter((kind.get(category(chr(c))[0], OTHER) for c in range(LIMIT)), np.uint8, LIMIT)
    out[WHITE_SPACE] = SPACE
    return out


@functools.cache
def lowered() -> np.ndarray:
    """uint32 lower case of each code point (itself where that is not one code point)."""
    out = np.arange(LIMIT, dtype=np.uint32)
    for c in range(LIMIT):
        if 0xD800 <= c < 0xE000:
            continue
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


def points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
