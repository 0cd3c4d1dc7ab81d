"""The compiled dictionary that runs next to the data: one automaton over folded text.

All occurrences of all terms come from one pass of an Aho-Corasick automaton; those that stand as their term's mode asks are
ordered by start and length, and the leftmost longest of them are taken without overlap.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

import ahocorasick

from veilframe.functions.folding import fold_spans, fold_text
from veilframe.functions.names import find_placeholders

#: Fixed values of nested payloads.
MAX_DEPTH, MAX_JSON = 64, 2_000_000
COPIED_KEYS = frozenset(["type", "kind", "mode", "action", "media_type", "mediaType", "tool_use_id", "agentId"])
RESERVED_KEYS = frozenset(["tool", "tool_use_id", "agentId", "consent"])
_LINES = re.compile(r".*?(?:\n|\\n)|.+\Z", re.S)
_BASE64 = re.compile(r"[A-Za-z0-9+/=_-]+")
_INDENT = re.compile(r"\n([ \t]+)\S")


@dataclass(frozen=True)
class Term:
    folded: str
    canonical: str
    list_name: str
    drop: bool
    word_only: bool
    placeholder: str = ""
    restored: str | None = None


@dataclass
class Tally:
    """What one pass hid: counts, and [replaced, dropped] of each folded term."""

    replaced: int = 0
    dropped: int = 0
    hits: dict[str, list[int]] = field(default_factory=dict)

    def add(self, folded: str, dropped: bool) -> None:
        self.replaced += not dropped
        self.dropped += dropped
        self.hits.setdefault(folded, [0, 0])[dropped] += 1


class Dictionary:
    def __init__(self, terms: list[Term]):
        self.terms = {t.folded: t for t in terms}
        self.by_name = {t.placeholder: t for t in terms if t.placeholder}
        self._machine = None
        self._held: tuple = (None, [])

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "by_name": self.by_name, "_machine": None, "_held": (None, [])}

    @property
    def machine(self):
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for k in self.terms:
                self._machine.add_word(k, k)
            self._machine.make_automaton()
        return self._machine

    # --- matching

    def _accepted(self, text: str, begin: int, end: int, word_only: bool) -> int | None:
        """Length of the plural suffix where the term may stand, else None."""
        if not word_only:
            return 0
        if begin and text[begin - 1].isalnum() and not (text[begin - 1] in "ntr" and begin > 1 and text[begin - 2] == "\\"):
            return None
        for extra in ("", "s", "es"):
            stop = end + len(extra)
            if text.startswith(extra, end) and not (stop < len(text) and text[stop].isalnum()):
                return len(extra)
        return None

    def matches(self, folded: str) -> list[tuple[int, int, str, int]]:
        """(start, end of the term, folded term, suffix length) in folded text."""
        if not self.terms or not folded:
            return []
        found = []
        for last, key in self.machine.iter(folded):
            begin = last + 1 - len(key)
            extra = self._accepted(folded, begin, last + 1, self.terms[key].word_only)
            if extra is not None:
                found.append((begin, -len(key), key, extra))
        found.sort()
        out, free = [], 0
        for begin, size, key, extra in found:
            if begin >= free:
                free = begin - size + extra
                out.append((begin, begin - size, key, extra))
        return out

    def read(self, text: str) -> list[tuple[int, int, str, int]]:
        """matches() of the folded text; the last text's are held, as testing, dropping and replacing ask for the same one after another."""
        if self._held[0] is not text:
            self._held = (text, self.matches(fold_text(text)))
        return self._held[1]

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, folded term, suffix as written) in code points of the text."""
        found = self.read(text)
        if not found:
            return []
        _, begin, end = fold_spans(text)
        return [(begin[a], end[b + extra - 1], key, text[begin[b] : end[b + extra - 1]] if extra else "") for a, b, key, extra in found]

    def test(self, text: str) -> bool:
        return bool(self.read(text))

    def count(self, text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for _, _, key, _ in self.read(text):
            out[key] = out.get(key, 0) + 1
        return out

    # --- rewriting

    def replace(self, text: str, tally: Tally) -> str:
        out, at = [], 0
        for begin, end, key, suffix in self.find(text):
            out += [text[at:begin], self.terms[key].placeholder, suffix]
            tally.add(key, False)
            at = end
        return "".join([*out, text[at:]]) if out else text

    def rewrite(self, text: str, tally: Tally, allow_drop: bool = True) -> tuple[str, bool, bool]:
        """(value, changed, vanished) of one text."""
        kept = text
        if allow_drop and any(self.terms[k].drop for _, _, k, _ in self.read(text)):
            lines = _LINES.findall(text)
            stay = []
            for line in lines:
                hit = next((k for _, _, k, _ in self.matches(fold_text(line)) if self.terms[k].drop), None)
                if hit is None:
                    stay.append(line)
                else:
                    tally.add(hit, True)
            if not stay:
                return "", True, True
            kept = "".join(stay)
        value = self.replace(kept, tally)
        return value, value != text, False

    def rewrite_value(self, v: Any, tally: Tally, depth: int = 0) -> tuple[Any, bool, bool]:
        """rewrite() for nested values: vanished items leave their array, a vanished child takes its object with it; keys stay."""
        if depth > MAX_DEPTH:
            return v, False, False
        if isinstance(v, str):
            return self._string(v, tally, depth)
        if isinstance(v, list):
            got = [self.rewrite_value(x, tally, depth + 1) for x in v]
            return [x for x, _, gone in got if not gone], any(c or gone for _, c, gone in got), False
        if isinstance(v, dict):
            out, changed, vanished = {}, False, False
            for k, x in v.items():
                if k in COPIED_KEYS:
                    out[k] = x
                    continue
                # What else the object hides is counted too, whatever the order of its keys.
                out[k], c, gone = self.rewrite_value(x, tally, depth + 1)
                changed, vanished = changed | c, vanished | gone
            return (None, True, True) if vanished else (out, changed, False)
        return v, False, False

    def _string(self, s: str, tally: Tally, depth: int) -> tuple[Any, bool, bool]:
        if is_encoded(s) or not self.test(s):
            return s, False, False
        body = s.strip()
        if 2 <= len(body) <= MAX_JSON and body[0] + body[-1] in ("{}", "[]"):
            try:
                inner = json.loads(body)
            except ValueError:
                return self.rewrite(s, tally)
            value, changed, gone = self.rewrite_value(inner, tally, depth + 1)
            if gone:
                return "", True, True
            if not changed:
                return s, False, False
            at = s.index(body)
            indent = _INDENT.search(s)
            printed = json.dumps(value, ensure_ascii=False, indent=indent[1] if indent else None, separators=(",", ": ") if indent else (",", ":"))
            return s[:at] + printed + s[at + len(body) :], True, False
        return self.rewrite(s, tally)

    # --- placeholders in calls

    def guarded_in(self, call: dict) -> list[str]:
        """Names of placeholders in a call's own inputs that may not be used, in order of appearance."""
        out: dict[str, None] = {}
        for s in call_strings(call):
            for _, _, name, _ in find_placeholders(s, self.by_name):
                if self.by_name[name].restored is None:
                    out[name] = None
        return list(out)

    def restore(self, call: dict) -> tuple[dict, bool]:
        """The call with usable placeholders replaced by what they stand for."""
        changed = False

        def one(s: str) -> str:
            nonlocal changed
            out, at = [], 0
            for begin, end, name, suffix in find_placeholders(s, self.by_name):
                text = self.by_name[name].restored
                if text is not None:
                    out += [s[at:begin], text, suffix]
                    at = end
            changed |= bool(out)
            return "".join([*out, s[at:]])

        value = {k: v if k in RESERVED_KEYS else map_strings(v, one) for k, v in call.items()}
        return value, changed


def is_encoded(s: str) -> bool:
    return (s.startswith("data:") and ";base64," in s[:100]) or (len(s) >= 256 and _BASE64.fullmatch(s) is not None)


def map_strings(v: Any, f, depth: int = 0) -> Any:
    if depth > MAX_DEPTH:
        return v
    if isinstance(v, str):
        return f(v)
    if isinstance(v, list):
        return [map_strings(x, f, depth + 1) for x in v]
    if isinstance(v, dict):
        return {k: map_strings(x, f, depth + 1) for k, x in v.items()}
    return v


def call_strings(call: dict) -> list[str]:
    out: list[str] = []
    for k, v in call.items():
        if k not in RESERVED_KEYS:
            map_strings(v, lambda s: out.append(s) or s)
    return out
