"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds spans to them.

Spans are code points, end exclusive. The model reads overlapping windows; each character's emission is taken from the window whose middle is
nearest, and the text is then decoded once, by Viterbi with the CRF's transitions over the joined emissions, so a span across windows
is one span. Defined results: a null text has no spans, as the empty one; very long texts are read whole, in linear time; repeated rows and ties
get equal spans; an empty table gives no rows; further columns stay, but for those that the result's names replace. A span of the model
that overlaps a pattern span adds nothing, for the pattern's span stays.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .textkit import chunks

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Runs of digits are taken whole and tried from their beginnings only, which changes no match and takes linear time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The windows, their step, and the confidence from which a span of the model counts.
WINDOW, STEP, SURE = 96, 48, 0.6
#: No span has a character further than this from a carrier: a digit, an @ or an @ spelt out in brackets.
REACH = 48
HIDDEN, EMBED = 14, 8
#: Training windows, at most, and passes over batches.
FIT_WINDOWS, FIT_STEPS = 2400, 400
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, kinds in the order of KINDS; linear time for e-mails."""
    out: list[tuple[str, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# --- character classes -------------------------------------------------------------------------------------------

_SPECIAL = "@.+-() ,:;/_%=\"'\n[]"


def _class_table() -> np.ndarray:
    """Code point to input symbol: each digit as one class, letters by case, marks of their own."""
    t = np.full(128, 1, np.int64)
    for i in range(128):
        ch = chr(i)
        if ch.isdigit():
            t[i] = 2
        elif "a" <= ch <= "f":
            t[i] = 3
        elif ch.islower():
            t[i] = 4
        elif ch.isupper():
            t[i] = 5
        elif ch in _SPECIAL:
            t[i] = 6 + _SPECIAL.index(ch)
    return t


CLASSES = 6 + len(_SPECIAL) + 1
_TABLE = _class_table()


def symbols(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, _TABLE[np.minimum(c, 127)], CLASSES - 1)


class BiLstmCrf:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        h, e, k = HIDDEN, EMBED, len(TAGS)
        u = lambda *s: (r.normal(0, 0.3, s)).astype(np.float32)
        self.p = {"E": u(CLASSES, e), "Wf": u(e + h, 4 * h), "bf": np.zeros(4 * h, np.float32), "Wb": u(e + h, 4 * h), "bb": np.zeros(4 * h, np.float32), "O": u(2 * h, k), "ob": np.zeros(k, np.float32), "T": np.zeros((k, k), np.float32)}
        self.p["bf"][h : 2 * h] = self.p["bb"][h : 2 * h] = 1

    @staticmethod
    def _sig(x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * x))

    def _lstm(self, x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        n, t, h = len(x), x.shape[1], HIDDEN
        hs, hp, cp, tape = np.zeros((n, t, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        xin = x @ w[:EMBED] + b
        for i in range(t):
            a = xin[:, i] + hp @ w[EMBED:]
            s = self._sig(a[:, : 3 * h])
            ig, fg, og, g = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(a[:, 3 * h :])
            c = fg * cp + ig * g
            tc = np.tanh(c)
            if keep:
                tape.append((ig, fg, og, g, cp, tc, hp))
            hp, cp = og * tc, c
            hs[:, i] = hp
        return hs, tape

    def _back(self, dh: np.ndarray, x: np.ndarray, w: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dx, dw, db = np.zeros_like(x), np.zeros_like(w), np.zeros(w.shape[1], np.float32)
        nh = nc = np.zeros((len(x), HIDDEN), np.float32)
        for i in range(x.shape[1] - 1, -1, -1):
            ig, fg, og, g, cp, tc, hp = tape[i]
            d = dh[:, i] + nh
            dc = d * og * (1 - tc * tc) + nc
            da = np.concatenate([dc * g * ig * (1 - ig), dc * cp * fg * (1 - fg), d * tc * og * (1 - og), dc * ig * (1 - g * g)], 1)
            dw[:EMBED] += x[:, i].T @ da
            dw[EMBED:] += hp.T @ da
            db += da.sum(0)
            back = da @ w.T
            dx[:, i], nh, nc = back[:, :EMBED], back[:, EMBED:], dc * fg
        return dx, dw, db

    def emissions(self, ids: np.ndarray, keep: bool = False) -> tuple:
        p = self.p
        x = p["E"][ids]
        f, tf = self._lstm(x, p["Wf"], p["bf"], keep)
        b, tb = self._lstm(x[:, ::-1], p["Wb"], p["bb"], keep)
        both = np.concatenate([f, b[:, ::-1]], 2)
        return both @ p["O"] + p["ob"], x, both, tf, tb

    def _forward_backward(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n, t, k = em.shape
        trans = np.exp(self.p["T"]).astype(np.float64)
        top = em.max(2, keepdims=True)
        e = np.exp((em - top).astype(np.float64))
        a, b, z = np.zeros((n, t, k)), np.ones((n, t, k)), np.zeros((n, t))
        a[:, 0] = e[:, 0]
        for i in range(t):
            if i:
                a[:, i] = (a[:, i - 1] @ trans) * e[:, i]
            z[:, i] = a[:, i].sum(1)
            a[:, i] /= z[:, i, None]
        for i in range(t - 2, -1, -1):
            b[:, i] = ((b[:, i + 1] * e[:, i + 1]) @ trans.T) / z[:, i + 1, None]
        return a, b, e, np.log(z).sum(1) + top.sum((1, 2))

    def posterior(self, ids: np.ndarray) -> np.ndarray:
        a, b, _, _ = self._forward_backward(self.emissions(ids)[0])
        p = a * b
        return p / p.sum(2, keepdims=True)

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = FIT_STEPS, batch: int = 48, rate: float = 0.02, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        k = len(TAGS)
        for step in range(1, steps + 1):
            at = r.integers(0, len(ids), batch)
            x_id, y = ids[at], tags[at]
            em, x, both, tf, tb = self.emissions(x_id, keep=True)
            a, b, e, z = self._forward_backward(em)
            post = a * b
            post /= post.sum(2, keepdims=True)
            d_em = (post - np.eye(k)[y]).astype(np.float32) / batch
            trans = np.exp(self.p["T"])
            right = b[:, 1:] * e[:, 1:]
            pair = np.einsum("nti,ij,ntj->ntij", a[:, :-1], trans, right, optimize=True)
            pair /= pair.sum((2, 3), keepdims=True)
            g_t = pair.sum((0, 1)) / batch
            np.add.at(g_t, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1.0 / batch)
            d_both = d_em @ self.p["O"].T
            dxf, dwf, dbf = self._back(d_both[:, :, :HIDDEN], x, self.p["Wf"], tf)
            dxb, dwb, dbb = self._back(d_both[:, ::-1, HIDDEN:], x[:, ::-1], self.p["Wb"], tb)
            dx = dxf + dxb[:, ::-1]
            g_e = np.zeros_like(self.p["E"])
            np.add.at(g_e, x_id.ravel(), dx.reshape(-1, EMBED))
            grad = {"E": g_e, "Wf": dwf, "bf": dbf, "Wb": dwb, "bb": dbb, "O": both.reshape(-1, 2 * HIDDEN).T @ d_em.reshape(-1, k), "ob": d_em.sum((0, 1)), "T": g_t.astype(np.float32)}
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for q, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[q] = 0.9 * m[q] + 0.1 * g
                v[q] = 0.999 * v[q] + 0.001 * g * g
                self.p[q] = (self.p[q] - rate * (1 - 0.9 * step / steps) * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


# --- labelled windows --------------------------------------------------------------------------------------------


def synthetic_windows(n: int, seed: int = 1, missed: float = 0.45) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Seeded texts with labelled spans of all kinds among words, and with look-alikes that are none.

    A share `missed` of the spans is written as the patterns do not read it: spaced, split, or with marks spelt out.
    """
    r = random.Random(seed)
    pick = lambda s, k: "".join(r.choices(s, k=k))
    number = r.randrange
    low, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    word = lambda a=2, b=12: pick(low, number(a, b))

    def make(kind: str) -> str:
        hard = r.random() < missed
        if kind == "email":
            user = word(2, 9) + r.choice(["", "." + pick(dig, 2), "_" + pick(low, 3), "." + pick(low, 4)])
            host = [word(3, 8) + r.choice(["", pick(dig, 1)]), *r.choice(["com", "example.com", "org", "co.uk", "net", "de"]).split(".")]
            at, dot = r.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "."), (" (at) ", "."), (" @ ", " . ")]) if hard else ("@", ".")
            return user + at + dot.join(host)
        if kind == "ip":
            return (r.choice(["[.]", " . ", "(.)", "[dot]"]) if hard else ".").join(str(number(256)) for _ in range(4))
        if kind == "card":
            body = str(number(3, 7)) + pick(dig, 14)
            body += next(c for c in dig if luhn(body + c))
            gap = r.choice([".", "/", "  ", " - ", "_", "\n"]) if hard else r.choice(["", "", " ", "-"])
            return gap.join(body[i : i + 4] for i in range(0, 16, 4))
        x, y, z = pick("23456789", 1) + pick(dig, 2), pick("23456789", 1) + pick(dig, 2), pick(dig, 4)
        if hard:
            return r.choice([f"({x}) {y}-{z}", f"{x}-{y}-{z}", f"{x}.{y}.{z}", f"+{number(1, 99)}/{x}/{y}{z}", f"00{number(20, 99)} {x} {y} {z}", f"+ {number(1, 99)} {x} {y} {z}"])
        return r.choice([f"+1 ({x}) {y}-{z}", f"+{number(1, 99)} {x} {y} {z}", f"+1-{x}-{y}-{z}", f"+1{x}{y}{z}"])

    alike = [
        *[word] * 9,
        lambda: word(2, 8).capitalize(),
        lambda: word(4, 9) + "-" + word(2, 5),
        lambda: str(number(3000)),
        lambda: f"version {number(1, 9)}.{number(20)}.{number(9)}",
        lambda: f"{number(1, 99)}.{number(99)}",
        lambda: f"password={pick(hexa, 18)}",
        lambda: f'"{pick(hexa, 40)}"',
        lambda: "AKIA" + pick("ABCDEFGHJKLMNPQRSTUVWXYZ234567", 16),
        lambda: f"{number(1900, 2030)}-{number(10, 13)}-{number(10, 29)}",
        lambda: f"{number(1, 29)}.{number(1, 13)}.{number(1900, 2030)}",
        lambda: f"{number(10, 23)}:{number(10, 59)}:{number(10, 59)}",
        lambda: f"{number(1, 999)},{number(100, 999)},{number(100, 999)}",
        lambda: pick(dig, number(5, 12)),
        lambda: f"({number(1, 99)})",
        lambda: f"[{number(1, 99)}]",
        lambda: f"{number(1, 99)}-{number(100, 199)}",
        lambda: f"{number(1, 99)} / {number(100, 999)}",
        lambda: r.choice("@#.") + word(3, 9),
        lambda: r.choice(["!!", "|", "(at)", "[dot]"]),
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW + 40:
            kind = r.choice([*KINDS, "", "", "", "", "", ""])
            piece = make(kind) if kind else r.choice(alike)()
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + r.choice([" ", " ", " ", ", ", ".\n", "\n", "; ", ") "])
        cut = number(40)
        out.append((text[cut : cut + WINDOW], [(k, max(0, s - cut), min(WINDOW, e - cut)) for k, s, e in spans if e > cut and s < cut + WINDOW]))
    return out


def encode(windows: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    ids, tags = np.zeros((len(windows), WINDOW), np.int64), np.zeros((len(windows), WINDOW), np.int64)
    for i, (text, spans) in enumerate(windows):
        s = symbols(text[:WINDOW])
        ids[i, : len(s)] = s
        for kind, a, b in spans:
            t = 1 + 2 * KINDS.index(kind)
            tags[i, a:b] = t + 1
            if a < WINDOW:
                tags[i, a] = t
    return ids, tags


#: Models fitted in this process, by what they were fitted on.
_FITTED: dict[tuple, BiLstmCrf] = {}


def fit_pii(*, windows: int = FIT_WINDOWS, steps: int = FIT_STEPS, labelled: list[tuple[str, list[tuple[str, int, int]]]] = ()) -> BiLstmCrf:
    """Train on labelled spans: seeded synthetic windows, and any labelled windows of the caller's (texts of up to WINDOW characters)."""
    key = (windows, steps, tuple((text, tuple(spans)) for text, spans in labelled))
    if key not in _FITTED:
        model = BiLstmCrf()
        model.fit(*encode([*synthetic_windows(windows), *labelled]), steps=steps)
        _FITTED[key] = model
    return _FITTED[key]


# --- decoding ----------------------------------------------------------------------------------------------------

_SPELT = re.compile(r"[\[(] ?[aA][tT] ?[\])]")
_FORBIDDEN = np.float32(-1e4)


def allowed_places(text: str) -> np.ndarray:
    """Places that a span may hold, ascending: those within REACH of a carrier. All others are outside of any span by rule."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(((code >= 48) & (code <= 57)) | (code == 64))
    if "at" in text or "AT" in text or "At" in text or "aT" in text:
        at = np.sort(np.concatenate([at, [m.start() for m in _SPELT.finditer(text)]])).astype(np.int64)
    if not len(at):
        return at
    near = np.zeros(len(code) + 1, np.int32)
    np.add.at(near, np.maximum(at - REACH, 0), 1)
    np.add.at(near, np.minimum(at + REACH + 1, len(code)), -1)
    return np.flatnonzero(np.cumsum(near[:-1]) > 0)


def transitions(model: BiLstmCrf) -> np.ndarray:
    """The CRF's transitions; an inside tag follows only its own kind."""
    k = len(TAGS)
    t = model.p["T"].astype(np.float32).copy()
    for j in range(2, k, 2):
        t[[i for i in range(k) if i not in (j - 1, j)], j] = _FORBIDDEN
    return t


def viterbi(em: np.ndarray, trans: np.ndarray, size: int = 64) -> np.ndarray:
    """The best tags of one sequence of emissions, outside before and after it, exactly, in linear time and without a step for each character.

    The sequence is cut into pieces that move side by side: first each piece's best score from every tag to every tag, then the pieces in a
    row, then the paths within all pieces.
    """
    n, k = em.shape
    c = n // size + 1
    e = np.full((c * size, k), 0, np.float32)
    e[:n] = em
    e[n:, 1:] = _FORBIDDEN  # filled up with characters outside
    e = e.reshape(c, size, k)
    best = np.full((c, k, k), _FORBIDDEN * 100, np.float32)
    best[:, np.arange(k), np.arange(k)] = 0
    for i in range(size):
        ahead = best[:, :, :1] + trans[0]
        for q in range(1, k):
            np.maximum(ahead, best[:, :, q : q + 1] + trans[q], out=ahead)
        best = ahead + e[:, i, None, :]
    start = np.zeros((c, k), np.float32)
    start[0, 2::2] = _FORBIDDEN  # nothing is inside before the first character
    start[0, 1::2] = _FORBIDDEN
    for j in range(1, c):
        start[j] = (start[j - 1][:, None] + best[j - 1]).max(0)
        start[j] -= start[j].max()
    score, back = start, np.zeros((size, c, k), np.int8)
    for i in range(size):
        ahead = score[:, :1] + trans[0]
        for q in range(1, k):
            way = score[:, q : q + 1] + trans[q]
            back[i][way > ahead] = q
            np.maximum(ahead, way, out=ahead)
        score = ahead + e[:, i]
    # Where each end tag of a piece comes from, then the pieces' true end tags, then every tag.
    origin = np.tile(np.arange(k, dtype=np.int8), (c, 1))
    row = np.arange(c)
    for i in range(size - 1, -1, -1):
        origin = back[i][row[:, None], origin]
    end = np.zeros(c, np.int8)
    end[-1] = score[-1].argmax()
    for j in range(c - 1, 0, -1):
        end[j - 1] = origin[j, end[j]]
    tags = np.zeros((c, size), np.int8)
    now = end
    for i in range(size - 1, -1, -1):
        tags[:, i] = now
        now = back[i][row, now]
    return tags.ravel()[:n]


def joined_emissions(texts: list[str], places: list[np.ndarray], model: BiLstmCrf, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(emissions, posteriors) of the texts' places, one behind the other: each from the window whose middle is nearest.

    Windows begin at every multiple of STEP; equal windows are read once.
    """
    k = len(TAGS)
    total = sum(map(len, places))
    em, post = np.zeros((total, k), np.float32), np.zeros((total, k), np.float32)
    rows, aim, inside, base = [], [], [], 0
    for text, at in zip(texts, places):
        if not len(at):
            continue
        code = np.concatenate([symbols(text), np.zeros(WINDOW, np.int64)])
        number = np.maximum(0, (at - STEP // 2) // STEP)
        wanted, which = np.unique(number, return_inverse=True)
        rows.append(code[wanted[:, None] * STEP + np.arange(WINDOW)].astype(np.uint8))
        aim.append(base + which)
        inside.append(at - number * STEP)
        base += len(wanted)
    if not rows:
        return em, post
    windows, of = np.unique(np.concatenate(rows).view(f"V{WINDOW}").ravel(), return_inverse=True)
    windows = windows.view(np.uint8).reshape(-1, WINDOW)
    aim, inside = of[np.concatenate(aim)], np.concatenate(inside)
    order = np.argsort(aim, kind="stable")
    cut = np.searchsorted(aim[order], np.arange(0, len(windows) + batch, batch))
    for j, lo in enumerate(range(0, len(windows), batch)):
        e = model.emissions(windows[lo : lo + batch].astype(np.int64))[0]
        a, b, _, _ = model._forward_backward(e)
        p = a * b
        p /= p.sum(2, keepdims=True)
        own = order[cut[j] : cut[j + 1]]
        em[own], post[own] = e[aim[own] - lo, inside[own]], p[aim[own] - lo, inside[own]]
    return em, post


def model_spans(texts: list[str], model: BiLstmCrf, sure: float = SURE, places: list[np.ndarray] | None = None) -> list[list[tuple[str, int, int]]]:
    """Spans of the model: the joined emissions of each text decoded once, and every span whose least sure character is sure enough.

    places: what to read of each text; by default allowed_places(). Others are outside of spans by rule, so reading them too
    changes nothing.
    """
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    own = [allowed_places(t) for t in texts]
    read = own if places is None else places
    if not sum(map(len, own)):
        return out
    em, post = joined_emissions(texts, read, model)
    if places is not None:
        kept = np.concatenate([np.isin(r, o) for r, o in zip(read, own)])
        em, post = em[kept], post[kept]
    at, of = np.concatenate(own), np.repeat(np.arange(len(texts)), [len(x) for x in own])
    # Between stretches stands one character outside, so that none leads into the next.
    fresh = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(of) != 0)])
    shift = np.arange(len(at)) + np.cumsum(fresh)
    line = np.zeros((len(at) + int(fresh.sum()), len(TAGS)), np.float32)
    line[:, 1:] = _FORBIDDEN
    line[shift] = em
    tag = viterbi(line, transitions(model))[shift]
    sure_of = post[np.arange(len(at)), tag]
    begins = np.flatnonzero(tag % 2 == 1)
    inner = (tag % 2 == 0) & (tag > 0) & ~fresh
    stops = np.append(np.flatnonzero(~inner), len(tag))
    for i, j in zip(begins.tolist(), stops[np.searchsorted(stops, begins, side="right")].tolist()):
        if sure_of[i:j].min() >= sure:
            out[of[i]].append((KINDS[tag[i] // 2], int(at[i]), int(at[j - 1]) + 1))
    return out


def plausible(kind: str, s: str) -> bool:
    """What any span of the kind must hold, however it is written; keeps the model from adding fragments."""
    if kind == "email":
        return ("@" in s or _SPELT.search(s) is not None) and len(s) >= 6
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in parts)
    d = _digits(s)
    return 13 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15


def find_pii(texts: list[str | None], model: BiLstmCrf) -> list[tuple[list, list]]:
    """(pattern spans, spans the model adds) of each text."""
    held = [t if isinstance(t, str) else "" for t in texts]
    base = [base_spans(t) for t in held]
    extra = model_spans(held, model)
    out = []
    for t, b, more in zip(held, base, extra):
        added = [x for x in more if plausible(x[0], t[x[1] : x[2]]) and not any(x[1] < e and s < x[2] for _, s, e in b)]
        out.append((b, added))
    return out


def ordered(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or run of overlapping spans, becomes the name of its first kind in brackets."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _in_parts(texts: list[str | None], model: BiLstmCrf) -> Iterator[tuple[list, list]]:
    for _, held in chunks(texts):
        yield from find_pii(held, model)


def detect(docs: DataFrame, model: BiLstmCrf) -> DataFrame:
    """All columns of docs, and base_spans and added_spans: array<struct<kind,start,end>>; own columns of these names give way."""
    kind = "struct<base:array<struct<kind:string,start:int,end:int>>,added:array<struct<kind:string,start:int,end:int>>>"

    bounded_batches(docs.sparkSession)

    @F.pandas_udf(kind)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            got = list(_in_parts(s.tolist(), model))
            as_rows = lambda x: [{"kind": k, "start": a, "end": b} for k, a, b in x]
            yield pd.DataFrame({"base": [as_rows(b) for b, _ in got], "added": [as_rows(a) for _, a in got]})

    own = [c for c in docs.columns if c not in ("base_spans", "added_spans")]
    return docs.withColumn("__pii", found.asNondeterministic()(F.col("text"))).select(*own, F.col("__pii.base").alias("base_spans"), F.col("__pii.added").alias("added_spans"))


def mask(docs: DataFrame, model: BiLstmCrf) -> DataFrame:
    """docs with its text's spans replaced by [EMAIL], [IP], [CARD] or [PHONE]; null texts stay null."""

    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.tolist()
            yield pd.Series([redact(t, b + a) if isinstance(t, str) else None for t, (b, a) in zip(texts, _in_parts(texts, model))], dtype=object)

    return docs.withColumn("text", masked(F.col("text")))
