"""Stable placeholder names for hidden terms, and finding them again in text."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 256 words from a rule: each onset with each ending.
_ONSETS = "Bal Cor Dan Fen Gar Hol Jun Kel Lor Mar Nep Pol Quin Ros Tam Vel".split()
_ENDINGS = "ado bin cot dell ero fax gim hue ina jop kit lan mox nut orp zum".split()
WORDS = [a + b for a in _ONSETS for b in _ENDINGS]
STYLES = ("codename", "tag")


def fnv1a32(text: str) -> int:
    """32-bit FNV-1a over UTF-16 units."""
    raw = text.encode("utf-16-le", "surrogatepass")
    h = 2166136261
    for i in range(0, len(raw), 2):
        h = ((h ^ (raw[i] | raw[i + 1] << 8)) * 16777619) & 0xFFFFFFFF
    return h


def fnv1a32_column(c: Column) -> Column:
    """The same in SQL, for texts of the basic plane."""
    units = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


def _utf16(text: str) -> bytes:
    return text.encode("utf-16-be", "surrogatepass")


def assign_placeholders(terms: Iterable[str], seed: str, style: str = "codename", substrings: Iterable[str] = ()) -> dict[str, str]:
    """Folded term -> placeholder. Terms go in UTF-16 order and probe onward from their hash, so a name depends on
    the seed, the term, and on collisions with the terms before it."""
    terms = sorted(set(terms), key=_utf16)
    taken: set[str] = set()
    out: dict[str, str] = {}
    folded, inside = set(terms), list(substrings)
    for term in terms:
        h = fnv1a32(f"{seed}\0{term}")
        for name in _tags(h) if style == "tag" else _codenames(h):
            low = name.lower()
            if name not in taken and (style == "tag" or (low not in folded and not any(s in low for s in inside))):
                break
        taken.add(name)
        out[term] = name
    return out


def _codenames(h: int) -> Iterable[str]:
    n = len(WORDS)
    at, digit, step = h % n, 2 + (h // n) % 8, 0
    while True:
        yield f"{WORDS[(at + step) % n]}{(at + step) // n * 10 + digit}"
        step += 1


def _tags(h: int) -> Iterable[str]:
    while True:
        yield f"[hidden-{h:08x}"[:14] + "]"
        h = (h + 1) & 0xFFFFFFFF


#: A name may stand between underscores; a longer word around it is no use of it.
_NAME = re.compile(r"(?<![A-Za-z0-9])([A-Z][a-z]+[0-9]*)((?:e?s)?)(?![A-Za-z0-9])|(\[hidden-[0-9a-f]{6}\])((?:e?s)?)(?![A-Za-z0-9])")


def find_placeholders(text: str, known: frozenset[str] | set[str] | dict) -> list[tuple[int, int, str, str]]:
    """(start, end, name, plural suffix) of every known name, in order."""
    out = []
    for m in _NAME.finditer(text):
        word, suffix = (m[1], m[2]) if m[1] else (m[3], m[4])
        if word in known:
            out.append((m.start(), m.end(), word, suffix))
        elif not suffix:
            for cut in (1, 2):
                if word[-cut:] in ("s", "es") and word[:-cut] in known:
                    out.append((m.start(), m.end(), word[:-cut], word[-cut:]))
                    break
    return out
