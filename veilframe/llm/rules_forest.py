"""Quality rules: an isolation forest over rule statistics, its threshold calibrated on labelled rows.

Defined results: null and empty texts have all counts 0 and fail the base rules; very long texts are counted whole, in one pass; repeated
rows and ties are treated alike; an empty table gives no rows; no labelled row anywhere leaves the threshold at its default;
further columns, of whatever names, are ignored. Every labelled row counts in the forest's draws and in the threshold; rows of one id with equal statistics count once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, labelled_ids, materialize, scratch_scope
from .textkit import Texts, chunks, letter_table, mix, repeated, symbol_table

SYMBOLS = "#*$%&|<>"
#: Trees, and rows that each of them draws from all rows fitted.
TREES, SUBSAMPLE = 100, 256
#: Share of good labelled rows that the threshold must keep.
KEEP_GOOD = 0.99
#: Cells that scores are ranked in.
CELLS = 4096
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = 9


def rule_statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(counts in the order of COUNTS, ratios for the forest) of each text."""
    t = Texts(texts)
    n, c = t.n, t.codes
    counts = np.zeros((n, 5), np.int64)
    counts[:, 0] = t.n_words
    length = t.word_end - t.word_start
    counts[:, 1] = np.bincount(t.word_doc, length, minlength=n)
    counts[:, 2] = t.per_doc(symbol_table(SYMBOLS)[np.minimum(c, 255)])
    ends = np.flatnonzero(c == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    words_before = np.searchsorted(t.word_start, np.stack([begins, ends]))
    full = words_before[1] > words_before[0]
    begins, ends = begins[full], ends[full]
    line_doc = t.doc_of(begins)
    if len(begins):
        key = mix(t.span_hash(begins, ends) + mix(line_doc.astype(np.uint64)))
        counts[:, 3] = np.bincount(line_doc, repeated(key), minlength=n)
    h = t.word_hash() if len(t.word_start) else np.zeros(0, np.uint64)
    distinct = np.zeros(n)
    if len(h):
        key = mix(h + mix(t.word_doc.astype(np.uint64)))
        distinct = t.n_words - np.bincount(t.word_doc, repeated(key), minlength=n)
    if len(h) > 2:
        key = mix(mix(mix(h[:-2]) + h[1:-1]) * np.uint64(5) + h[2:])
        key = mix(key + mix(t.word_doc[2:].astype(np.uint64)))
        inside = np.flatnonzero(t.word_doc[2:] == t.word_doc[:-2])
        order = np.argsort(key[inside])
        k = key[inside][order]
        equal = k[1:] == k[:-1]
        twice = inside[order[np.concatenate([equal, [False]]) | np.concatenate([[False], equal])]] if len(k) else inside
        mark = np.zeros(len(h), bool)
        for i in range(3):
            mark[twice + i] = True
        counts[:, 4] = np.bincount(t.word_doc, mark, minlength=n)
    w, chars, lines = np.maximum(t.n_words, 1), np.maximum(counts[:, 1], 1), np.maximum(np.bincount(line_doc, minlength=n), 1)
    lone = (length == 1) & ~letter_table()[np.minimum(c, 65535)[t.word_start]]
    ratios = np.stack(
        [
            np.minimum(counts[:, 1] / w, 20),
            counts[:, 2] / w,
            counts[:, 3] / lines,
            counts[:, 4] / w,
            distinct / w**0.9,
            t.per_doc((c >= 65) & (c <= 90)) / chars,
            t.per_doc((c == 33) | (c == 63)) / w,
            np.bincount(t.word_doc, lone, minlength=n) / w,
            t.per_doc(letter_table()[np.minimum(c, 65535)]) / chars,
        ],
        1,
    )
    return counts, ratios


class IsolationForest:
    """Axis-parallel random splits; anomaly = 2 ** -(mean path length / c(subsample))."""

    def __init__(self, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11):
        r = np.random.default_rng(seed)
        size = min(subsample, len(x))
        self._plant((x[r.choice(len(x), size, replace=False)] for _ in range(trees)), trees, size, r)

    @classmethod
    def of_draws(cls, draws: list[np.ndarray], seed: int = 11) -> IsolationForest:
        """A tree for each draw; all are of one size."""
        out = cls.__new__(cls)
        out._plant(draws, len(draws), len(draws[0]), np.random.default_rng(seed))
        return out

    def _plant(self, draws: Iterable[np.ndarray], trees: int, size: int, r: np.random.Generator) -> None:
        self.size = max(2, size)
        depth = int(np.ceil(np.log2(self.size)))
        nodes = 2 ** (depth + 1) - 1
        self.feature, self.cut, self.path = (np.zeros((trees, nodes), d) for d in (np.int16, float, float))
        self.feature -= 1
        self.depth = depth
        for i, x in enumerate(draws):
            self._grow(i, 0, x, 0, r)

    @staticmethod
    def _c(n: float) -> float:
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def _grow(self, tree: int, node: int, x: np.ndarray, depth: int, r: np.random.Generator) -> None:
        wide = np.flatnonzero(x.max(0) > x.min(0)) if len(x) else []
        if depth == self.depth or len(x) <= 1 or not len(wide):
            self.path[tree, node] = depth + self._c(len(x))
            return
        f = r.choice(wide)
        cut = r.uniform(x[:, f].min(), x[:, f].max())
        self.feature[tree, node], self.cut[tree, node] = f, cut
        self._grow(tree, 2 * node + 1, x[x[:, f] <= cut], depth + 1, r)
        self._grow(tree, 2 * node + 2, x[x[:, f] > cut], depth + 1, r)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for i in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[i][node]
                right = x[row, np.maximum(f, 0)] > self.cut[i][node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            total += self.path[i][node]
        return 2.0 ** -(total / len(self.feature) / self._c(self.size))


class Rules:
    def __init__(self, forest: IsolationForest | None = None, threshold: float = 0.75):
        self.forest, self.threshold = forest, threshold

    def apply(self, texts: list[str | None]) -> pd.DataFrame:
        parts, scores = [np.zeros((0, 5), np.int64)], [np.zeros(0)]
        for _, held in chunks(texts):
            counts, ratios = rule_statistics(held)
            parts.append(counts)
            scores.append(self.forest.score(ratios) if self.forest else np.zeros(len(held)))
        c, s = np.concatenate(parts), np.concatenate(scores)
        failed = (c[:, 0] < 50) | (100 * c[:, 4] > 50 * c[:, 0])
        out = pd.DataFrame(dict(zip(COUNTS, c.T)))
        return out.assign(base_failed=failed, anomaly=s, kept=~failed & (s <= self.threshold))


def fit_rules(docs: DataFrame, labels: DataFrame, *, keep_good: float = KEEP_GOOD) -> Rules:
    """Fit the forest on labelled rows that pass the base rules; calibrate on both classes of them. All such rows enter.

    Each tree draws its rows from all good ones. The threshold keeps at least keep_good of the good rows and, above that, lies where
    most bad rows go. Statistics of labelled rows lie in scratch; nothing of their number comes to the driver.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, held in chunks(b["text"].tolist()):
                counts, ratios = rule_statistics(held)
                ok = (counts[:, 0] >= 50) & (100 * counts[:, 4] <= 50 * counts[:, 0])
                part = b.iloc[start : start + len(held)][ok]
                yield pd.DataFrame({"doc_id": part["doc_id"], "x": [r.tobytes() for r in ratios[ok]]})

    with scratch_scope(docs.sparkSession):
        # Statistics are joined, not texts, so that any number of labels may be shuffled.
        passing = docs.select("doc_id", "text").where("doc_id is not null").mapInPandas(run, "doc_id long, x binary")
        rows = materialize(passing.join(labelled_ids(labels, "quality", per_class=None), "doc_id").distinct().select(F.xxhash64("doc_id", "x").alias("h"), "x", "y"), "rules")
        n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
        if not n:
            return Rules()
        few = n.get(1, 0) < 8
        forest = IsolationForest.of_draws(draw_rows(rows if few else rows.where("y = 1"), sum(n.values()) if few else n[1]))
        if not n.get(1):
            return Rules(forest)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"s": forest.score(vectors(b["x"])), "y": b["y"]})

        return Rules(forest, calibrate(rows.select("x", "y").mapInPandas(score, "s double, y int"), keep_good))


def vectors(x: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x), float).reshape(-1, RATIOS)


def draw_rows(rows: DataFrame, n: int, trees: int = TREES, size: int = SUBSAMPLE) -> list[np.ndarray]:
    """For each tree `size` of the n rows (h, x), or all if they are fewer: those whose hashes, mixed anew for each tree, are lowest.

    Only hashes below a bound that some more than `size` rows are expected to fall below come to the driver; where too few do, the bound is raised.
    """
    size = min(size, n)
    expected = size + 10 * size**0.5
    while True:
        bound = np.uint64(min(2**64 - 1, int(2**64 * expected / n)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                h, x = b["h"].to_numpy(np.int64).view(np.uint64), b["x"].to_numpy()
                for i in range(trees):
                    key = mix(h + mix(np.full(1, i + 1, np.uint64)))
                    at = np.flatnonzero(key <= bound)
                    yield pd.DataFrame({"tree": np.full(len(at), i, np.int32), "key": key[at].view(np.int64), "x": x[at]})

        got: list[list[tuple[int, bytes]]] = [[] for _ in range(trees)]
        for r in rows.select("h", "x").mapInPandas(run, "tree int, key long, x binary").collect():
            got[r["tree"]].append((r["key"] % 2**64, bytes(r["x"])))
        if min(map(len, got)) >= size:
            return [vectors(x for _, x in sorted(g)[:size]) for g in got]
        if expected >= n:
            raise RuntimeError("the rows changed while they were drawn from")
        expected *= 2


def calibrate(scored: DataFrame, keep_good: float) -> float:
    """Of rows (s, y), some of them good: the cut of the greatest gain, the lowest of equal ones, among the quantile keep_good of the good scores and all scores above.

    Distinct scores are ranked within cells, whose totals alone are added up on the driver.
    """
    counted = scored.groupBy("s").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    each = materialize(counted.withColumn("cell", F.floor(F.col("s") * CELLS)), "scores")
    before, good, bad = [], 0, 0
    for r in each.groupBy("cell").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("cell").collect():
        before.append((r["cell"], good, bad))
        good, bad = good + r["good"], bad + r["bad"]
    start = scored.sparkSession.createDataFrame(before, "cell long, g long, b long")
    so_far = Window.partitionBy("cell").orderBy("s")
    upto = each.join(F.broadcast(start), "cell").select("s", (F.col("g") + F.sum("good").over(so_far)).alias("g"), (F.col("b") + F.sum("bad").over(so_far)).alias("b"))
    place = (good - 1) * keep_good
    k = int(place)
    low, high = upto.agg(F.min(F.when(F.col("g") > k, F.col("s"))), F.min(F.when(F.col("g") > k + 1, F.col("s")))).first()
    floor = float(np.quantile([low, low if high is None else high], place - k))
    if not bad:
        return floor
    gain = (bad - F.col("b")) / F.lit(float(bad)) - 4 * ((good - F.col("g")) / F.lit(float(good)))
    at_floor = upto.where(F.col("s") <= floor).agg(F.max("g").alias("g"), F.max("b").alias("b")).select(gain).first()[0]
    best = upto.where(F.col("s") >= floor).select("s", gain.alias("gain")).orderBy(F.desc("gain"), "s").first()
    return best["s"] if best["gain"] > at_floor else floor


def apply_rules(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id with the counts, base_failed, anomaly and kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = rules.apply(b["text"].tolist())
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean")
