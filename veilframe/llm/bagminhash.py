"""Near-duplicate documents by BagMinHash signatures of word-shingle multisets, banded and verified.

Texts that share a bucket of a band are candidates. First each bucket's texts are compared with one of them, its leader, which settles most
buckets; what is linked makes classes. In buckets whose other texts are still of several classes, each text outside the largest class is compared with
all texts of the bucket. All comparisons are exact and within buckets, so no two texts are compared for a chain of others
between them, and every pair of a bucket is either compared or already in one class. Defined results: null and empty texts, and texts
without words, are alone in their class. A text of one to four words has one shingle, all its words. Equal texts always share a class, repeated
rows and repeated or null doc_ids included; a class takes the smallest doc_id in it as its id, and of equal doc_ids any one row is kept. Very long
texts are signed and compared whole; an empty table gives no rows; further columns, of whatever names, are ignored, and kept by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, discard, materialize
from .textkit import Texts, chunks, counted, mix, shingles

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 6
#: Characters and texts of a block of a bucket, at most; two blocks meet in one task.
BLOCK_CHARS, BLOCK_TEXTS = 3_000_000, 1000
#: Rows of ids and digests that may be broadcast (about 70 bytes each); beyond it the join is shuffled.
BROADCAST_IDS = 200_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bag_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """BagMinHash of integer-weighted sets: n_docs x m ids of the first point of each component, 0 where a set is empty.

    An element's weight axis is cut into dyadic intervals [0,1), [1,2), [2,4), ...; each has its own seeded Poisson
    process in time, whose points fall on a component and a level of the interval. A point below the
    element's weight counts, the earliest point per component is the signature, and a process ends when its time passes
    the latest component of its document. Two sets agree in a component with the probability of
    their weighted Jaccard similarity. The winning point's id is kept, not its time, so no float is ever compared.
    """
    ids = np.zeros(n_docs * m, np.uint64)
    if not len(doc):
        return ids.reshape(n_docs, m)
    times = np.full(n_docs * m, np.inf)
    high = np.where(weight > 1, np.floor(np.log2(np.maximum(weight - 1, 1))).astype(np.int64) + 2, 1)
    proc = np.repeat(np.arange(len(doc)), high)
    level = np.arange(len(proc)) - np.repeat(np.cumsum(high) - high, high)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0)).astype(np.int64)
    span = np.where(level == 0, 1, low)
    p_doc, p_weight = doc[proc], weight[proc]
    seed = mix(element[proc] + (level.astype(np.uint64) + np.uint64(1)) * _STEP)
    clock, serial = np.zeros(len(proc)), np.zeros(len(proc), np.uint64)
    while len(p_doc):
        docs = np.unique(p_doc)
        block = int(np.clip(3 * m * len(docs) // len(p_doc), 1, 64))
        count = serial[:, None] + np.arange(1, block + 1, dtype=np.uint64)
        point = mix(seed[:, None] + count * _STEP)
        time = clock[:, None] + np.cumsum(-np.log(((point >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1) / span[:, None]
        spot = mix(point + _STEP)
        component = (spot % np.uint64(m)).astype(np.int64)
        y = low[:, None] + ((spot >> np.uint64(32)).astype(np.float64) * 2.0**-32 * span[:, None]).astype(np.int64)
        slot = p_doc[:, None] * m + component
        ok = (y < p_weight[:, None]) & (time < times[slot])
        at, when, who = slot[ok], time[ok], point[ok]
        np.minimum.at(times, at, when)
        won = times[at] == when
        ids[at[won]] = who[won]
        last = times.reshape(n_docs, m).max(axis=1)
        clock, serial = time[:, -1], serial + np.uint64(block)
        live = clock < last[p_doc]
        p_doc, p_weight, seed, clock, serial, low, span = (x[live] for x in (p_doc, p_weight, seed, clock, serial, low, span))
    return ids.reshape(n_docs, m)


def text_bands(texts: list[str], bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> np.ndarray:
    """Band keys, one row of `bands` per text; a text without words has zeros."""
    t = Texts(texts)
    doc, h, n = counted(*shingles(t, k))
    sig = bag_signatures(doc, h, n, t.n, bands * rows).reshape(t.n, bands, rows)
    key = np.zeros((t.n, bands), np.uint64)
    for r in range(rows):
        key = mix(key + sig[:, :, r] + _STEP)
    key = mix(key + np.arange(bands, dtype=np.uint64) * _STEP)
    key[t.n_words == 0] = 0
    return key.view(np.int64)


def multiset_jaccard(left: list[str], right: list[str], k: int = SHINGLE) -> np.ndarray:
    """Exact sum of minima over sum of maxima of the shingle counts; 0 where a text has no words."""
    n = len(left)
    t = Texts([*left, *right])
    doc, h, c = counted(*shingles(t, k))
    side, pair = doc >= n, np.where(doc >= n, doc - n, doc)
    order = np.lexsort((side, h, pair))
    pair, h, c, side = pair[order], h[order], c[order], side[order]
    both = np.flatnonzero((pair[1:] == pair[:-1]) & (h[1:] == h[:-1]) & ~side[:-1] & side[1:])
    low = np.bincount(pair[both], np.minimum(c[both], c[both + 1]), minlength=n)
    total = np.bincount(pair, c, minlength=n)
    return low / np.maximum(total - low, 1)


def _band_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = b["text"].tolist()
        for start, held in chunks(texts):
            part = b.iloc[start : start + len(held)]
            yield pd.DataFrame({"rid": part["rid"], "doc_id": part["doc_id"], "digest": part["digest"], "bands": list(text_bands(held)), "has_words": [bool(x.strip(" \t\n\x0b\x0c\r")) for x in held], "size": list(map(len, held))})


def overlaps(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, left: np.ndarray) -> np.ndarray:
    """Sum of minima of the multisets (document, element, count) of each of `left` with each of all n.

    Counts are written out one by one, which makes the minimum of two counts a product of zeros and ones; elements of one document
    only can add to no overlap. Common elements are summed as matrix products, rare ones pair by pair.
    """
    row = np.full(n, -1)
    row[left] = np.arange(len(left))
    _, inverse, many = np.unique(h, return_inverse=True, return_counts=True)
    ok = many[inverse] > 1
    doc, h, count = doc[ok], inverse[ok], count[ok]
    copy = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    doc, h = np.repeat(doc, count), np.repeat(h, count)
    column = np.unique(mix(h.astype(np.uint64)) + copy.astype(np.uint64) * _STEP, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    size = np.bincount(column)
    both = np.zeros((len(left), n), np.float32)
    common = size >= max(16, n // 16)
    number = np.cumsum(common) - 1
    dense = common[column]
    d, c = doc[dense], number[column[dense]]
    width = max(1, 8_000_000 // n)
    for first in range(0, int(common.sum()), width):
        lo, hi = np.searchsorted(c, [first, first + width])
        m = np.zeros((n, width), np.float32)
        m[d[lo:hi], c[lo:hi] - first] = 1
        both += m[left] @ m.T
    begin = np.cumsum(size) - size
    asked = np.flatnonzero(~dense & (row[doc] >= 0))
    ends = np.cumsum(size[column[asked]])
    for lo in range(0, int(ends[-1]) if len(ends) else 0, 4_000_000):
        part = asked[np.searchsorted(ends, lo, side="right") : np.searchsorted(ends, lo + 4_000_000, side="right")]
        times = size[column[part]]
        place = np.arange(int(times.sum())) + np.repeat(begin[column[part]] - (np.cumsum(times) - times), times)
        both += np.bincount(np.repeat(row[doc[part]], times) * n + doc[place], minlength=len(left) * n).reshape(both.shape)
    return both.astype(np.float64)


def links_within(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, threshold: float, left: np.ndarray | None = None) -> np.ndarray:
    """Whether each of `left` (by default all) and each of n multisets overlap by the threshold, exactly."""
    left = np.arange(n) if left is None else left
    total = np.bincount(doc, count, minlength=n)
    both = overlaps(doc, h, count, n, left)
    return both >= threshold * (total[left][:, None] + total[None, :] - both) - 1e-9


def classes_of(linked: np.ndarray) -> np.ndarray:
    """The first member of each one's class, from a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(np.where(linked, label[None, :], len(linked)).min(1), label)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _elements(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), texts and then shingles ascending."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for start, held in chunks(texts):
        d, h, c = counted(*shingles(Texts(held), k))
        found.append((d + start, h, c))
    return tuple(np.concatenate(x) for x in zip(*found))


def _edges(a: list, b: list) -> pd.DataFrame:
    return pd.DataFrame({"a": np.concatenate([np.zeros(0, np.int64), *a]), "b": np.concatenate([np.zeros(0, np.int64), *b])})


def _with_leader(threshold: float, k: int):
    """Texts against their leader: the edges (leader, text) of those that overlap enough."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["leader", "node"], kind="stable").reset_index(drop=True)
        doc, h, c = _elements(pdf["text"].tolist(), k)
        leader, node = pdf["leader"].to_numpy(), pdf["node"].to_numpy()
        total = np.bincount(doc, c, minlength=len(pdf))
        cut = np.flatnonzero(np.concatenate([[True], np.diff(leader) != 0, [True]]))
        edge = np.searchsorted(doc, np.arange(len(pdf) + 1))
        a, b = [], []
        for lo, hi in zip(cut, cut[1:]):
            first = lo + int(np.flatnonzero(node[lo:hi] == leader[lo])[0])
            own_h, own_c = h[edge[first] : edge[first + 1]], c[edge[first] : edge[first + 1]]
            part = slice(edge[lo], edge[hi])
            at = np.minimum(np.searchsorted(own_h, h[part]), len(own_h) - 1)
            both = np.bincount(doc[part] - lo, np.where(own_h[at] == h[part], np.minimum(c[part], own_c[at]), 0), minlength=hi - lo)
            ok = (both >= threshold * (total[lo:hi] + total[first] - both) - 1e-9) & (node[lo:hi] != leader[lo])
            a.append(leader[lo:hi][ok])
            b.append(node[lo:hi][ok])
        return _edges(a, b)

    return run


def _within(threshold: float, k: int):
    """The texts marked `asked` against all texts of their bucket in the task: a star of each class found."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # A text may stand in a task for several buckets, and as asked and as one of all.
        pdf = pdf.sort_values(["key", "node", "asked"]).drop_duplicates(["key", "node"], keep="last")
        nodes, which = np.unique(pdf["node"].to_numpy(), return_inverse=True)
        texts = pdf["text"].to_numpy()[np.unique(which, return_index=True)[1]]
        doc, h, c = _elements(texts.tolist(), k)
        edge = np.searchsorted(doc, np.arange(len(nodes) + 1))
        key, asked = pdf["key"].to_numpy(), pdf["asked"].to_numpy(bool)
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        a, b = [], []
        for lo, hi in zip(cut, cut[1:]):
            own, left = which[lo:hi], np.flatnonzero(asked[lo:hi])
            size = edge[own + 1] - edge[own]
            place = np.arange(int(size.sum())) + np.repeat(edge[own] - (np.cumsum(size) - size), size)
            hit = links_within(np.repeat(np.arange(hi - lo), size), h[place], c[place], hi - lo, threshold, left)
            linked = np.zeros((hi - lo, hi - lo), bool)
            linked[left] = hit
            label = classes_of(linked | linked.T)
            at = np.flatnonzero(label != np.arange(hi - lo))
            a.append(nodes[own[at]])
            b.append(nodes[own[label[at]]])
        return _edges(a, b)

    return run


def near_duplicates(docs: DataFrame, *, threshold: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """(rid, doc_id, digest, component_id, n_copies, kept) with one row for each input row.

    Exact copies collapse first. A hot bucket is cut into blocks, whichever way its texts are compared; tasks return stars and never
    pairs, so no candidate is dropped and nothing grows with the square of a group but the comparisons of texts that no leader settled.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    src = src.withColumn("digest", F.md5(F.col("text").cast("binary")))
    rows = src.withColumn("rid", F.monotonically_increasing_id())
    seen = materialize(rows.select("rid", "doc_id", "digest", "text").mapInPandas(_band_rows, "rid long, doc_id long, digest string, bands array<long>, has_words boolean, size long"), "bands")
    nodes = materialize(seen.where("has_words").groupBy("digest").agg(F.min("rid").alias("node")), "nodes")
    reps = seen.where("has_words").join(nodes.select(F.col("node").alias("rid")), "rid", "left_semi")
    band = reps.select(F.col("rid").alias("node"), F.explode("bands").alias("key"))
    # A bucket's leader is its first text; buckets of one text end here.
    lead = band.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "leader")
    bucket = materialize(band.join(lead, "key"), "buckets")
    texts = _texts(src, seen, bucket)
    stars = bucket.where("node <> leader").select("leader", "node").distinct()
    first = materialize(_star_edges(stars, texts, threshold, k), "links")
    class_of = connected_components(first, "classes")
    second = materialize(_bucket_edges(bucket, class_of, texts, threshold, k), "links")
    # The classes that the second comparison joins.
    at = lambda end: class_of.select(F.col("node").alias(end), F.col("component").alias(f"class_{end}"))
    between = second.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b"))
    joined = connected_components(between, "classes")
    of_class = joined.select(F.col("node").alias("own"), F.col("component").alias("whole"))
    of = nodes.join(class_of, "node", "left").withColumn("own", F.coalesce("component", "node")).join(of_class, "own", "left").select("digest", F.coalesce("whole", "own").alias("component"))
    member = seen.select("rid", "doc_id", "digest", "has_words").join(of, "digest", "left").withColumn("component", F.coalesce("component", F.col("rid")))
    member = materialize(member.select("rid", "doc_id", "digest", "component"), "members")
    # Most rows are a class of their own and need no join; the others' classes are few rows, or a join whose skew can be split.
    several = member.groupBy("component").agg(F.min("doc_id").alias("least"), F.min_by("rid", F.coalesce("doc_id", F.lit(2**63 - 1))).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = materialize(several, "several")
    side = F.broadcast(several) if several.count() <= BROADCAST_IDS else several
    out = member.join(side, "component", "left").select("rid", "doc_id", "digest", F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("n", F.lit(1)).alias("n_copies"), (F.col("rid") == F.coalesce("keep", "rid")).alias("kept"))
    out = materialize(out, "near")
    for done in (seen, nodes, bucket, texts, first, class_of, second, joined, member, several):
        discard(done)
    return out


def _texts(src: DataFrame, seen: DataFrame, bucket: DataFrame) -> DataFrame:
    """(node, text, size) of the candidates, read once more from the source and kept, compressed."""
    involved = seen.join(bucket.select(F.col("node").alias("rid")).distinct(), "rid", "left_semi")
    involved = materialize(involved.select(F.col("rid").alias("node"), F.col("doc_id").alias("i_doc"), F.col("digest").alias("i_digest"), "size"), "involved")
    side = F.broadcast(involved) if involved.count() <= BROADCAST_IDS else involved
    found = src.join(side, F.col("doc_id").eqNullSafe(F.col("i_doc")) & (F.col("digest") == F.col("i_digest"))).select("node", "text", "size")
    out = materialize(found.dropDuplicates(["node"]), "texts", codec="zstd")
    discard(involved)
    return out


def _blocks(n: str = "n", chars: str = "chars"):
    return F.greatest(F.ceil(F.col(chars) / BLOCK_CHARS), F.ceil(F.col(n) / BLOCK_TEXTS)).cast("int")


def _packs(total) -> int:
    """Tasks for the groups of one block, as many as their characters and texts fill."""
    return max(1, -(-2 * (total["chars"] or 0) // BLOCK_CHARS), -(-2 * (total["n"] or 0) // BLOCK_TEXTS))


def _star_edges(stars: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """(a, b): the leaders' links. A hot leader's texts are cut into blocks; only its own text goes to each."""
    size = texts.select("node", "size")
    stars = materialize(stars.join(size, "node"), "stars")
    per = stars.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars")).select("leader", _blocks().alias("blocks"), "n", "chars")
    per = materialize(per, "leaders")
    packs = _packs(per.agg((F.sum("n") + F.count(F.lit(1))).alias("n"), (2 * F.sum("chars")).alias("chars")).first())
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("leader"), F.lit(packs)).cast("int"))
    own = per.select("leader", F.col("leader").alias("node"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    others = stars.join(per.select("leader", "blocks"), "leader").select("leader", "node", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    tasks = own.unionByName(others).select("leader", "node", F.when(F.col("blocks") == 1, F.lit(-1).cast("long")).otherwise(F.col("leader")).alias("g"), F.coalesce(pack, "block").alias("i"))
    return tasks.join(texts.select("node", "text"), "node").groupBy("g", "i").applyInPandas(_with_leader(threshold, k), "a long, b long")


def _bucket_edges(bucket: DataFrame, class_of: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """(a, b): links that the leaders did not settle. Buckets of the same texts are compared once."""
    rest = bucket.where("node <> leader").select("key", "node").join(class_of, "node", "left").select("key", "node", F.coalesce("component", "node").alias("cls"))
    rest = materialize(rest, "rest")
    sets = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high")
    keys = sets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    still = materialize(rest.join(keys, "key", "left_semi").join(texts.select("node", "size"), "node"), "still")
    by_class = still.groupBy("key", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars"))
    per = by_class.groupBy("key").agg(F.max_by("cls", F.struct("n", -F.col("cls"))).alias("largest"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.max("n").alias("most"), F.max_by("chars", F.struct("n", -F.col("cls"))).alias("most_chars"))
    per = materialize(per.select("key", "largest", _blocks().alias("blocks"), F.greatest(F.ceil((F.col("chars") - F.col("most_chars")) / BLOCK_CHARS), F.ceil((F.col("n") - F.col("most")) / BLOCK_TEXTS)).cast("int").alias("asking"), "n", "chars"), "open")
    packs = _packs(per.where("blocks = 1").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).first())
    rows = still.join(per.select("key", "largest", "blocks", "asking"), "key").withColumn("asked", F.col("cls") != F.col("largest"))
    draw = F.xxhash64("node")
    alone = F.array(F.struct(F.lit(-1).cast("long").alias("g"), F.pmod(F.xxhash64("key"), F.lit(packs)).cast("int").alias("i"), F.lit(0).alias("j"), F.col("asked").alias("as_asked")))
    # As one of all, a text meets every block of those asked; as one asked, every block of all.
    of_all = F.transform(F.sequence(F.lit(0), F.col("asking") - 1), lambda i: F.struct(F.col("key").alias("g"), i.alias("i"), F.pmod(draw, F.col("blocks")).cast("int").alias("j"), F.lit(False).alias("as_asked")))
    of_asked = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.col("key").alias("g"), F.pmod(draw, F.col("asking")).cast("int").alias("i"), j.alias("j"), F.lit(True).alias("as_asked")))
    places = F.when(F.col("blocks") == 1, alone).when(F.col("asked"), F.concat(of_all, of_asked)).otherwise(of_all)
    tasks = rows.select("key", "node", F.explode(places).alias("t")).select("t.g", "t.i", "t.j", "key", "node", F.col("t.as_asked").alias("asked"))
    return tasks.join(texts.select("node", "text"), "node").groupBy("g", "i", "j").applyInPandas(_within(threshold, k), "a long, b long")


def keep_one(docs: DataFrame, *, threshold: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """docs without all but one row of each class.

    Rows to drop are told by doc_id and digest; where one of several equal rows stays, repeats of it are dropped afterwards.
    """
    groups = near_duplicates(docs, threshold=threshold, k=k).select("doc_id", "digest", "kept")
    per = groups.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    drop = per.where("not kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    drop = F.broadcast(drop) if groups.where("not kept").count() <= BROADCAST_IDS else drop
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    left = docs.withColumn("__d", digest).join(drop, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__d") == F.col("__digest")), "left_anti")
    again = per.where("kept and n > 1").select("doc_id", "digest")
    if not again.isEmpty():
        many = left.join(again.withColumnsRenamed({"doc_id": "__id", "digest": "__digest"}), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__d") == F.col("__digest")), "left_semi")
        empty = F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "     ")) == ""
        once = many.where(~empty).dropDuplicates(["doc_id", "__d"]).unionByName(many.where(empty))
        left = left.join(again.withColumnsRenamed({"doc_id": "__id", "digest": "__digest"}), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__d") == F.col("__digest")), "left_anti").unionByName(once)
    return left.drop("__d")
