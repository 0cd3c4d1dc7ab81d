"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words, all of which are encoded, in fitting as in scoring. A passage's encoding is learnt: an
embedding of its hashed words, word beginnings and endings, and of its statistics. Gated attention weighs the encodings, and the weighted
representation is scored. Defined results: null and empty texts are a bag of one empty passage and get a score like any other; a very long
text is a large bag, encoded block by block; repeated rows and ties are scored alike; an empty table gives no rows; without labels the
model is the seeded one, and scores are still from 0 to 1; further columns stay, but for one of the score's name, which gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, labelled_texts
from .textkit import Texts, chunks, letter_table, mix, repeated, symbol_table

PASSAGE = 64
#: Labelled documents of each class that the model is fitted on, at most.
FIT_PER_CLASS = 1500
#: Code points of the fitted documents together, at most.
FIT_CHARS = 24_000_000
#: Buckets of hashed words, beginnings and endings; letters of a beginning or an ending; passages encoded at once.
BUCKETS, AFFIX, BLOCK = 512, 3, 4096
SYMBOLS = "#*$%&|<>!=~^_@"
FEATURES = 16


class Passages(NamedTuple):
    """Of every passage, documents ascending and at least one each: its document and statistics; and the bucket of each of its grams."""

    doc: np.ndarray
    stats: np.ndarray
    home: np.ndarray
    bucket: np.ndarray

    def counts(self, first: int, last: int) -> np.ndarray:
        """Grams by bucket of passages first to last - 1; `home` ascends."""
        lo, hi = np.searchsorted(self.home, [first, last])
        return np.bincount((self.home[lo:hi] - first) * BUCKETS + self.bucket[lo:hi], minlength=(last - first) * BUCKETS).reshape(-1, BUCKETS)


def grams(t: Texts, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, bucket) of every word, its beginning and its ending."""
    a, b = t.word_start, t.word_end
    parts = (t.word_hash(), t.span_hash(a, np.minimum(a + AFFIX, b)), t.span_hash(np.maximum(b - AFFIX, a), b))
    bucket = np.stack([mix(h + np.uint64(7 * i)) % np.uint64(BUCKETS) for i, h in enumerate(parts)], 1).astype(np.int64)
    return np.repeat(home, len(parts)), bucket.ravel()


def passages(texts: list[str]) -> Passages:
    t = Texts(texts)
    c = t.codes
    per = np.maximum(1, -(-t.n_words // PASSAGE))
    base = np.cumsum(per) - per
    total = int(per.sum())
    doc = np.repeat(np.arange(t.n), per)
    out = np.zeros((total, FEATURES), np.float32)
    none = np.zeros(0, np.int64)
    if not len(t.word_start):
        return Passages(doc, out, none, none)
    first = np.cumsum(t.n_words) - t.n_words
    home = base[t.word_doc] + (np.arange(len(t.word_doc)) - first[t.word_doc]) // PASSAGE
    words = np.bincount(home, minlength=total).astype(np.float64)
    w = np.maximum(words, 1)
    length = t.word_end - t.word_start

    def share(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return np.bincount(home, run[t.word_end] - run[t.word_start], minlength=total)

    low = np.minimum(c, 65535)
    chars = np.maximum(np.bincount(home, length, minlength=total), 1)
    h = t.word_hash()
    key = mix(h + mix(t.word_doc.astype(np.uint64)))
    old = repeated(key)
    anew = repeated(mix(key + mix(home.astype(np.uint64))))
    pair = mix(h[1:] * np.uint64(3) + mix(key[:-1]))
    old2 = repeated(pair) & (t.word_doc[1:] == t.word_doc[:-1])
    same = (h[1:] == h[:-1]) & (t.word_doc[1:] == t.word_doc[:-1])
    lone = (length == 1) & ~letter_table()[low[t.word_start]]
    symbol = symbol_table(SYMBOLS)[np.minimum(c, 255)]
    cols = [
        np.bincount(home, old, minlength=total) / w,
        np.bincount(home[1:], old2, minlength=total) / w,
        np.bincount(home[1:], same, minlength=total) / w,
        (words > 0) - np.bincount(home, anew, minlength=total) / w,
        np.bincount(home, lone, minlength=total) / w,
        np.bincount(home, symbol[t.word_end - 1], minlength=total) / w,
        share(symbol) / chars,
        share((c >= 65) & (c <= 90)) / chars,
        share((c >= 48) & (c <= 57)) / chars,
        share(letter_table()[low]) / chars,
        share(c > 127) / chars,
        share((c == 46) | (c == 44)) / chars,
        np.log1p(chars / w),
        np.log1p(words),
        np.bincount(home, length > 30, minlength=total) / w,
        np.log1p(t.n_words)[doc],
    ]
    for i, x in enumerate(cols):
        out[:, i] = x
    return Passages(doc, out, *grams(t, home))


class GatedAttention:
    """Encoder, gated attention and output of the model; fitted by Adam on batches of whole bags."""

    def __init__(self, seed: int = 7, hidden: int = 16, gate: int = 8):
        r = np.random.default_rng(seed)
        n = FEATURES
        self.p = {"W": r.normal(0, n**-0.5, (n, hidden)), "E": r.normal(0, 0.05, (BUCKETS, hidden)), "b": np.zeros(hidden), "V": r.normal(0, hidden**-0.5, (hidden, gate)), "U": r.normal(0, hidden**-0.5, (hidden, gate)), "w": r.normal(0, gate**-0.5, gate), "u": r.normal(0, hidden**-0.5, hidden), "c": np.zeros(1)}
        self.mean, self.scale = np.zeros(n), np.ones(n)

    def inputs(self, stats: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Standardised statistics, and counts of grams at length one."""
        c = counts.astype(np.float32)
        return np.clip((stats - self.mean) / self.scale, -6, 6), c / np.maximum(np.sqrt(np.einsum("ij,ij->i", c, c)), 1)[:, None]

    def encode(self, stats: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x, c = self.inputs(stats, counts)
        return np.tanh(x @ self.p["W"] + c @ self.p["E"].astype(np.float32) + self.p["b"])

    def attend(self, h: np.ndarray, doc: np.ndarray, n: int) -> dict:
        """The scores of n bags from their passages' encodings."""
        p = self.p
        a, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (a * g) @ p["w"]
        first = np.searchsorted(doc, np.arange(n))
        e = np.exp(e - np.maximum.reduceat(e, first)[doc])
        alpha = e / np.add.reduceat(e, first)[doc]
        z = np.add.reduceat(alpha[:, None] * h, first, axis=0)
        s = 1 / (1 + np.exp(-np.clip(z @ p["u"] + p["c"][0], -30, 30)))
        return {"h": h, "a": a, "g": g, "alpha": alpha, "z": z, "s": s, "first": first}

    def fit(self, stats: np.ndarray, counts: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, bags: int = 192, rate: float = 0.02, decay: float = 1e-4, drop: float = 0.3, seed: int = 9) -> None:
        """counts may be of any integer type. Of a batch's grams a share is left out, so that no bag is told by a few of its words."""
        r = np.random.default_rng(seed)
        self.mean, self.scale = stats.mean(0), stats.std(0) + 1e-3
        cut = np.searchsorted(doc, np.arange(len(y) + 1))
        m, v = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2))
        order = np.zeros(0, np.int64)
        for i in range(1, steps + 1):
            if len(order) < min(bags, len(y)):
                order = np.concatenate([order, r.permutation(len(y))])
            own, order = order[:bags], order[bags:]
            at = np.concatenate([np.arange(cut[j], cut[j + 1]) for j in own])
            bag = np.repeat(np.arange(len(own)), cut[own + 1] - cut[own])
            kept = counts[at] * (r.random((len(at), BUCKETS), np.float32) >= drop)
            x, c = self.inputs(stats[at], kept)
            p = self.p
            f = self.attend(np.tanh(x @ p["W"] + c @ p["E"].astype(np.float32) + p["b"]), bag, len(own))
            ds = (f["s"] - y[own]) * weight[own] / weight[own].sum()
            dz = ds[:, None] * p["u"]
            along = (f["h"] * dz[bag]).sum(1)
            de = f["alpha"] * (along - np.add.reduceat(f["alpha"] * along, f["first"])[bag])
            da, dg = de[:, None] * p["w"] * f["g"] * (1 - f["a"] ** 2), de[:, None] * p["w"] * f["a"] * f["g"] * (1 - f["g"])
            dh = (f["alpha"][:, None] * dz[bag] + da @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
            grad = {"W": x.T @ dh, "E": c.T @ dh.astype(np.float32), "b": dh.sum(0), "V": f["h"].T @ da, "U": f["h"].T @ dg, "w": (f["a"] * f["g"]).T @ de, "u": f["z"].T @ ds, "c": np.array([ds.sum()])}
            for k, g in grad.items():
                g = g + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for start, held in chunks(texts):
            p = passages(held)
            h = [self.encode(p.stats[i : i + BLOCK], p.counts(i, min(i + BLOCK, len(p.doc)))) for i in range(0, len(p.doc), BLOCK)]
            out[start : start + len(held)] = self.attend(np.concatenate(h), p.doc, len(held))["s"]
        return out


def _fit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for start, held in chunks(b["text"].tolist()):
            part, p = b.iloc[start : start + len(held)], passages(held)
            cut = np.searchsorted(p.doc, np.arange(len(held) + 1))
            counts = [np.minimum(p.counts(lo, hi), 255).astype(np.uint8).tobytes() for lo, hi in zip(cut, cut[1:])]
            yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["y"], "stats": [p.stats[lo:hi].tobytes() for lo, hi in zip(cut, cut[1:])], "counts": counts})


def fit_quality(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, remainder: int = 2, per_class: int = FIT_PER_CLASS, max_chars: int = FIT_CHARS) -> GatedAttention:
    """Fit on at most per_class labelled documents of either class, outside the held-out fold, and all of their passages."""
    bounded_batches(docs.sparkSession)
    rows = labelled_texts(docs, labels, "quality", modulus=modulus, remainder=remainder, per_class=per_class, max_chars=max_chars)
    # No more rows than labelled_texts() chose.
    got = sorted(rows.mapInPandas(_fit_rows, "doc_id long, y int, stats binary, counts binary").collect(), key=lambda r: r["doc_id"])
    model = GatedAttention()
    if got:
        stats = [np.frombuffer(r["stats"], np.float32).reshape(-1, FEATURES) for r in got]
        counts = np.concatenate([np.frombuffer(r["counts"], np.uint8).reshape(-1, BUCKETS) for r in got])
        y = np.array([r["y"] for r in got], float)
        # inverse class frequency, tempered: a rejected document should be junk, not merely unusual
        share = np.array([max((y == k).mean(), 1e-3) for k in (0, 1)])
        model.fit(np.concatenate(stats).astype(float), counts, np.repeat(np.arange(len(y)), [len(x) for x in stats]), y, np.where(y == 1, 2.0 / share[1], 1.0 / share[0]))
    return model


def score_quality(docs: DataFrame, model: GatedAttention, *, text: str = "text", score: str = "quality_score") -> DataFrame:
    """All columns of docs and the score; the model travels with the function (a few kilobytes)."""

    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model.score(s.tolist()))

    return docs.withColumn(score, scored(F.col(text)))
