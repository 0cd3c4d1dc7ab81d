"""Folding of text: case, accents and the style of separators do not count.

A run of white space, hyphens, dashes and underscores becomes one space; typographic apostrophes become plain; every other code point is
decomposed, loses its marks and is lower-cased by itself. `fold` runs in Arrow batches; `fold_column` stays in the JVM. Both are exact and equal
for every code point: the JVM's table is made from the rule itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The separators, by code point (first, last).
SEPARATOR_RANGES = [(0x09, 0x0D), (0x20, 0x20), (0x2D, 0x2D), (0x5F, 0x5F), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2010, 0x2015), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
SEPARATORS = frozenset(chr(c) for a, b in SEPARATOR_RANGES for c in range(a, b + 1))
SEPARATOR_CLASS = "[" + "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in SEPARATOR_RANGES) + "]"
APOSTROPHES = "‘’"


@lru_cache(maxsize=1 << 16)
def fold_char(ch: str) -> str:
    """The folded form of one code point: empty for marks, one space for separators."""
    if ch in SEPARATORS:
        return " "
    if ch in APOSTROPHES:
        return "'"
    bare = (c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c)[0] != "M")
    return "".join(c.lower() for c in bare)


_RUN = re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in SEPARATOR_RANGES) + "]+")


class _Fold(dict):
    """Code point -> folded form, filled as met; str.translate reads it without leaving C."""

    def __missing__(self, code: int) -> str:
        self[code] = folded = fold_char(chr(code))
        return folded


_FOLD = _Fold()


def fold_text(text: str) -> str:
    """Folded text; runs of separators are one space."""
    text = _RUN.sub(" ", text)
    return text.lower() if text.isascii() else text.translate(_FOLD)


def fold_term(term: str) -> str:
    return fold_text(term).strip(" ")


def fold_spans(text: str) -> tuple[str, Sequence[int], Sequence[int]]:
    """Folded text with the code-point span in `text` behind each of its characters; a run's space covers the run."""
    if text.isascii() or all(len(_FOLD[ord(c)]) == 1 for c in set(text)):
        # Letters stay one for one, so only runs of separators move what follows them.
        begin: list[int] = []
        end: list[int] = []
        at = 0
        for m in _RUN.finditer(text):
            if m.end() - m.start() > 1:
                begin.extend(range(at, m.start() + 1))
                end.extend(range(at + 1, m.start() + 1))
                end.append(m.end())
                at = m.end()
        begin.extend(range(at, len(text)))
        end.extend(range(at + 1, len(text) + 1))
        return fold_text(text), begin, end
    out: list[str] = []
    begin, end = [], []
    for i, ch in enumerate(text):
        if ch in SEPARATORS and out and out[-1] == " " and end[-1] == i:
            end[-1] = i + 1
            continue
        for c in _FOLD[ord(ch)]:
            out.append(c)
            begin.append(i)
            end.append(i + 1)
    return "".join(out), begin, end


def fold(c: Column | str) -> Column:
    """Exact folding, in Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else fold_text(t))

    return run(F.col(c) if isinstance(c, str) else c)


#: The ranges that can hold letters which fold to something else, and the syllables that fold to their parts.
_LETTERED = [(0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x1F000), (0x2F800, 0x2FA20), (0xE0100, 0xE01F0)]
_SYLLABLES, _LEADS, _VOWELS, _TAILS = (0xAC00, 0xD7A3), 0x1100, 0x1161, 0x11A7


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str]:
    """(letters that fold to one other, what they fold to); letters beyond the second's length fold to nothing."""
    pairs = [(chr(i), fold_char(chr(i))) for i in [*range(0x41, 0x5B), *(i for a, b in _LETTERED for i in range(a, b))] if chr(i) not in SEPARATORS]
    one = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in one) + "".join(a for a, b in pairs if not b), "".join(b for _, b in one)


def _syllable_parts(c: Column) -> Column:
    """Each composed syllable as its two or three letters, by the arithmetic of their code points."""
    row = lambda first, n: F.array(*[F.lit(chr(first + i)) for i in range(n)])

    def parts(ch: Column) -> Column:
        i = F.ascii(ch) - _SYLLABLES[0]
        tail = F.when(i % 28 > 0, F.element_at(row(_TAILS + 1, 27), F.greatest(i % 28, F.lit(1)))).otherwise("")
        whole = F.concat(F.element_at(row(_LEADS, 19), (F.floor(i / 588) + 1).cast("int")), F.element_at(row(_VOWELS, 21), (F.floor(i % 588 / 28) + 1).cast("int")), tail)
        return F.when((F.ascii(ch) >= _SYLLABLES[0]) & (F.ascii(ch) <= _SYLLABLES[1]), whole).otherwise(ch)

    return F.array_join(F.transform(F.split(c, ""), parts), "")


def fold_column(c: Column | str) -> Column:
    """Exact folding in the JVM: ASCII texts are lower-cased, others pass one table, and composed syllables their arithmetic."""
    c = F.col(c) if isinstance(c, str) else c
    spaced = F.regexp_replace(c, SEPARATOR_CLASS + "+", " ")
    src, dst = _tables()
    flat = F.translate(spaced, src[: len(dst)] + APOSTROPHES + src[len(dst) :], dst + "''")
    wide = F.when(c.rlike(f"[\\x{{{_SYLLABLES[0]:x}}}-\\x{{{_SYLLABLES[1]:x}}}]"), _syllable_parts(flat)).otherwise(flat)
    return F.when(c.rlike(r"[^\x00-\x7F]"), wide).otherwise(F.lower(spaced))
