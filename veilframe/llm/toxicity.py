"""Counterfactual-regularised toxicity classifier.

A document is the set of its words and word beginnings (4 to 7 letters), lower-cased; a linear model scores the features
that labels single out. In every labelled text that names an identity term the term is swapped for each other of its line, all features
of the swapped text are taken anew, and the change of its score is penalised, so that naming a group does not raise a score.
Defined results: null and empty texts have no features and get the intercept's score; very long texts are scored whole, in one pass; repeated rows
and ties are scored alike; an empty table gives no rows; without labels every score is a half; further columns stay, but for one
of the score's name, which gives way.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, labelled_texts, materialize
from .textkit import Texts, chunks, counted, mix

#: Toxic and other labelled documents, and their code points together, at most; features, and toxic documents that one must stand in.
FIT_TOXIC, FIT_OTHER, FIT_CHARS, MAX_FEATURES, MIN_DOCS = 2500, 5000, 40_000_000, 8192, 3
PREFIXES = (4, 5, 6, 7)
#: Identity terms, one line for each set of terms that may stand for one another.
IDENTITY = [
    "woman man girl boy female male",
    "women men girls boys females males",
    "gay lesbian straight bisexual transgender queer",
    "gays lesbians straights bisexuals transgenders queers",
    "muslim christian jew hindu buddhist atheist",
    "muslims christians jews hindus buddhists atheists",
    "islamic jewish catholic protestant",
    "black white asian hispanic african european",
    "blacks whites asians hispanics africans europeans",
    "immigrant refugee foreigner citizen native",
    "immigrants refugees foreigners citizens natives",
    "disabled deaf blind elderly young",
    "femme homme fille garçon",
    "femmes hommes filles garçons",
    "lesbienne hétérosexuel bisexuel transgenre homosexuel",
    "musulman chrétien juif hindou bouddhiste athée",
    "musulmans chrétiens juifs hindous bouddhistes athées",
    "noir blanc asiatique africain européen arabe",
    "noirs blancs asiatiques africains européens arabes",
    "immigré réfugié étranger citoyen",
    "immigrés réfugiés étrangers citoyens",
    "frau mann mädchen junge",
    "frauen männer jungen",
    "schwul lesbisch heterosexuell bisexuell transgeschlechtlich",
    "muslim christ jude hindu buddhist atheist",
    "muslime christen juden hindus buddhisten atheisten",
    "schwarze weiße asiaten afrikaner europäer araber",
    "einwanderer flüchtlinge ausländer bürger einheimische",
    "mujer hombre niña niño",
    "mujeres hombres niñas niños",
    "lesbiana heterosexual bisexual transgénero homosexual",
    "musulmán cristiano judío hindú budista ateo",
    "musulmanes cristianos judíos hindúes budistas ateos",
    "negro blanco asiático africano europeo árabe",
    "negros blancos asiáticos africanos europeos árabes",
    "inmigrante refugiado extranjero ciudadano",
    "inmigrantes refugiados extranjeros ciudadanos",
]


def word_hashes(words: list[str]) -> list[int]:
    t = Texts([w.lower() for w in words], letters=True)
    return t.word_hash().tolist()


def occurrences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word and its beginnings."""
    t = Texts([x.lower() for x in texts], letters=True)
    length = t.word_end - t.word_start
    doc, h = [t.word_doc], [t.word_hash()]
    for k in PREFIXES:
        at = np.flatnonzero(length > k)
        doc.append(t.word_doc[at])
        h.append(mix(t.span_hash(t.word_start[at], t.word_start[at] + k) + np.uint64(k)))
    return np.concatenate(doc), np.concatenate(h)


def term_hashes(term: str) -> set[int]:
    """The hashes of a term and its beginnings."""
    return set(occurrences([term])[1].tolist())


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """occurrences(), each hash once a document."""
    d, x, _ = counted(*occurrences(texts))
    return d, x


class Toxicity:
    def __init__(self) -> None:
        self.keys, self.weight, self.bias = np.zeros(0, np.uint64), np.zeros(0), 0.0
        self.table = np.zeros(1 << 16, bool)

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, feature numbers) of known features; a bitmap screens the search."""
        at = np.flatnonzero(self.table[(h >> np.uint64(48)).astype(np.int64)])
        if not len(self.keys):
            return at[:0], at[:0]
        j = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[j] == h[at]
        return at[ok], j[ok]

    def use(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys.astype(np.uint64))
        self.weight = np.zeros(len(self.keys))
        self.table[:] = False
        self.table[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def fit(self, doc: np.ndarray, col: np.ndarray, y: np.ndarray, swaps: list[tuple[list[int], list[int], float]], *, fairness: float = 5.0, decay: float = 2e-3, steps: int = 400, rate: float = 0.05) -> None:
        """Adam on weighted log loss, a ridge, and the squared change of score of every swap (features out, features in, weight)."""
        n, k = len(y), len(self.keys)
        m, v = np.zeros(k + 1), np.zeros(k + 1)
        share = max(y.mean(), 1e-3)
        wt = np.where(y == 1, 0.35 / share, 0.65 / max(1 - share, 1e-3))
        size = np.array([(len(out), len(come)) for out, come, _ in swaps], np.int64).reshape(-1, 2)
        which = np.repeat(np.arange(len(swaps)), size.sum(1))
        sign = np.repeat(np.tile([-1.0, 1.0], len(swaps)), size.ravel())
        feature = np.array([f for out, come, _ in swaps for f in [*out, *come]], np.int64)
        times = np.array([w for _, _, w in swaps], float)
        for i in range(1, steps + 1):
            z = self.bias + np.bincount(doc, self.weight[col], minlength=n)
            err = wt * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            g = np.bincount(col, err[doc], minlength=k) + decay * self.weight / 10
            if len(feature):
                change = np.bincount(which, sign * self.weight[feature], minlength=len(swaps))
                g += np.bincount(feature, sign * (2 * fairness * times * change)[which], minlength=k)
            g = np.append(g, err.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            # The step falls to nothing, so that the weights come to rest where the penalty is steep.
            step = rate * (1 - i / (steps + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
            self.weight -= step[:-1]
            self.bias -= step[-1]

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for start, held in chunks(texts):
            d, h = occurrences(held)
            at, j = self.known(h)
            once = np.unique(d[at] * max(len(self.keys), 1) + j)
            z = self.bias + np.bincount(once // max(len(self.keys), 1), self.weight[once % max(len(self.keys), 1)] if len(once) else None, minlength=len(held))
            out[start : start + len(held)] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        y = b["y"].to_numpy()
        for start, held in chunks(b["text"].tolist()):
            d, h = features(held)
            key, at = np.unique(h, return_inverse=True)
            yield pd.DataFrame({"h": key.view(np.int64), "n": np.bincount(at, minlength=len(key)), "n1": np.bincount(at, y[start + d], minlength=len(key)).astype(np.int64)})


def partners() -> dict[str, list[str]]:
    """The terms that each identity term may be swapped for."""
    out: dict[str, dict[str, None]] = {}
    for line in IDENTITY:
        for term in line.split():
            out.setdefault(term, {}).update((x, None) for x in line.split() if x != term)
    return {k: list(v) for k, v in out.items()}


def swapped_features(text: str, others: dict[str, list[str]]) -> list[tuple[str, str, set[int], set[int]]]:
    """(term, other, hashes that go, hashes that come) of a text with every occurrence of a term swapped for another.

    Features are of single words, so the swapped text's are the text's counts, less those of the term's occurrences, and those of
    the other term; this equals taking the features of the swapped text anew.
    """
    words = Counter(w for w in _words(text.lower()) if w in others)
    if not words:
        return []
    _, key, n = counted(*occurrences([text]))
    count = dict(zip(key.tolist(), n.tolist()))
    out = []
    for term, times in words.items():
        own = Counter(occurrences([term])[1].tolist())
        gone = {h for h, c in own.items() if count[h] == c * times}
        for other in others[term]:
            come = set(occurrences([other])[1].tolist())
            out.append((term, other, gone - come, {h for h in come if h not in count}))
    return out


def _words(text: str) -> list[str]:
    t = Texts([text], letters=True)
    return [text[a:b] for a, b in zip(t.word_start.tolist(), t.word_end.tolist())]


def weighed_swaps(found: Counter, others: dict[str, list[str]], place: dict[int, int]) -> list[tuple[list[int], list[int], float]]:
    """(features out, features in, weight): each pair of terms weighs one, a quarter for the bare terms and the rest for the texts' swaps."""
    own = {term: {place[h] for h in occurrences([term])[1].tolist() if h in place} for term in others}
    total: Counter = Counter()
    for (a, b, _, _), n in found.items():
        total[a, b] += n
    swaps = [(sorted(own[a] - own[b]), sorted(own[b] - own[a]), 0.25 if (a, b) in total else 1.0) for a, bs in others.items() for b in bs]
    swaps += [(sorted(out), sorted(come), 0.75 * n / total[a, b]) for (a, b, out, come), n in found.items()]
    return [s for s in swaps if s[0] or s[1]]


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, remainder: int = 0, fairness: float = 5.0, toxic: int = FIT_TOXIC, other: int = FIT_OTHER, max_chars: int = FIT_CHARS) -> Toxicity:
    """Fit on at most `toxic` and `other` labelled documents of the two classes, outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    rows = materialize(labelled_texts(docs, labels, "toxic", modulus=modulus, remainder=remainder, per_class=(other, toxic), max_chars=max_chars), "labelled")
    stats = rows.repartition(8, "doc_id").mapInPandas(_counts, "h long, n long, n1 long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).where(F.col("n1") >= MIN_DOCS)
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    p1, p0 = F.col("n1") / n1, (F.col("n") - F.col("n1")) / n0
    pool = (F.col("n") + 1) / (n1 + n0 + 2)
    signal = (p1 - p0) / F.sqrt(pool * (1 - pool) * (1.0 / n1 + 1.0 / n0))
    best = stats.withColumn("signal", signal).where("signal > 4").orderBy(F.desc("signal"), "h").limit(MAX_FEATURES).collect()
    model, others = Toxicity(), partners()
    model.use(np.array([r["h"] for r in best], np.int64).view(np.uint64) if best else np.zeros(0, np.uint64))
    model.use(np.concatenate([model.keys, np.array(word_hashes(list(others)), np.uint64)]))
    place = {h: int(i) for i, h in enumerate(model.keys.tolist())}

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, held in chunks(b["text"].tolist()):
                d, h = features(held)
                at, j = model.known(h)
                cut = np.searchsorted(d[at], np.arange(len(held) + 1))
                part = b.iloc[start : start + len(held)]
                inside = lambda hs: sorted(place[h] for h in hs if h in place)
                swaps = [[(x, y, inside(out), inside(come)) for x, y, out, come in swapped_features(t, others)] for t in held]
                yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["y"], "x": [j[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(len(held))], "swaps": [json.dumps(x) for x in swaps]})

    # As many rows as labelled_texts() chose.
    got = sorted(rows.repartition(8, "doc_id").mapInPandas(chosen, "doc_id long, y int, x binary, swaps string").collect(), key=lambda r: r["doc_id"])
    discard(rows)
    if got:
        xs = [np.frombuffer(r["x"], np.int32) for r in got]
        found = Counter((a, b, tuple(out), tuple(come)) for r in got for a, b, out, come in json.loads(r["swaps"]))
        model.fit(np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.concatenate(xs).astype(np.int64), np.array([r["y"] for r in got], float), weighed_swaps(found, others, place), fairness=fairness)
    return model


def score_toxicity(docs: DataFrame, model: Toxicity, *, text: str = "text", score: str = "toxic_score") -> DataFrame:
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model.score(s.tolist()))

    return docs.withColumn(score, scored(F.col(text)))
