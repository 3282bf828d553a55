"""Code-point kernels for the character-level classifiers: one array for many texts, folded by lookup tables."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

SPACE, BREAK = 32, 0
_LIMIT = 0x110000


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((0xD800 <= c < 0xE000 or chr(c).isalpha() for c in range(_LIMIT)), bool, _LIMIT) & ~np.isin(np.arange(_LIMIT), np.arange(0xD800, 0xE000))


def joined_codes(texts: list[str | None]) -> np.ndarray:
    """Code points of the lower-cased texts, each followed by BREAK."""
    whole = "\0".join((t or "").replace("\0", " ") for t in texts) + "\0"
    return np.frombuffer(whole.lower().encode("utf-32-le", "replace"), np.uint32)


def spaced_letters(codes: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Codes with every run of non-letters made one SPACE; BREAKs stay, with a SPACE before and after each."""
    letter = letters()[codes] if table is None else table[codes] != SPACE
    values = codes if table is None else table[codes]
    out = np.where(letter, values, SPACE).astype(np.uint32)
    out[codes == BREAK] = BREAK
    wide = np.concatenate([[SPACE], np.repeat(out, np.where(out == BREAK, 3, 1))]).astype(np.uint32)
    at = np.flatnonzero(wide == BREAK)
    wide[at[0::3]] = SPACE
    wide[at[2::3]] = SPACE
    keep = np.ones(len(wide), bool)
    keep[1:] = (wide[1:] != SPACE) | (wide[:-1] != SPACE)
    return wide[keep]


@cache
def folded() -> np.ndarray:
    """Each code point's folded letter: accents dropped, look-alike letters and digit substitutions made one letter.

    Letters that share look-alikes fold together (i, l and 1 to i); what is no letter afterwards folds to SPACE."""
    table = np.full(_LIMIT, SPACE, np.uint32)
    for c in range(0x3000):
        base = unicodedata.normalize("NFKD", chr(c))[:1].lower()
        if base.isalpha():
            table[c] = ord(base[0])
    for c in range(0x3000, _LIMIT):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = c
    for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0x1D400, 0x1D6A4)):
        base = unicodedata.normalize("NFKD", chr(c)).lower()
        if len(base) == 1 and base.isalpha():
            table[c] = ord(base)
    for plain, alike in {
        "a": "аαɑ@4", "b": "Ьвβ8", "c": "сϲ¢", "d": "ԁ", "e": "еєε3€", "g": "ɡ9", "h": "һн", "i": "іιıl1ӏ|ɩ", "j": "ј", "k": "кκ", "m": "мμ",
        "n": "пη", "o": "оοσ0", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ5$", "t": "тτ7", "u": "υս", "v": "νѵ", "w": "ԝωш", "x": "хχ", "y": "уγ", "z": "ʐ",
    }.items():
        for x in {*alike, *alike.upper()} - {"L"}:
            for y in x.lower():
                table[ord(y)] = ord(plain)
    table[ord("l")] = ord("i")
    for c in range(0x250):  # accented l folds as l does
        if table[c] == ord("l"):
            table[c] = ord("i")
    return table


def drop_invisible(codes: np.ndarray) -> np.ndarray:
    """Codes without soft hyphens, joiners and combining marks, which split words invisibly."""
    gone = (codes == 0xAD) | ((codes >= 0x200B) & (codes <= 0x200F)) | (codes == 0x2060) | (codes == 0xFEFF) | ((codes >= 0x300) & (codes < 0x370))
    return codes[~gone] if gone.any() else codes


def fold(texts: list[str | None]) -> np.ndarray:
    """Folded words of the texts, separated by single SPACEs, with a BREAK after each text.

    The marks @ $ | and the currency signs that stand for letters count as such only before a letter or digit."""
    codes = drop_invisible(joined_codes(texts)).copy()
    table = folded()
    mark = np.isin(codes, [ord(x) for x in "@$|¢€"])
    if mark.any():
        after = np.concatenate([codes[1:], [SPACE]])
        word = (letters()[after]) | ((after >= 48) & (after <= 57))
        codes[mark & ~word] = SPACE
    return spaced_letters(codes, table)
