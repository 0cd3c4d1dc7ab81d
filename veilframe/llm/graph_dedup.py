"""Embedding near-duplicates by a robust-pruned flat graph on overlapping cluster shards.

Each vector goes to the shards of its OVERLAP nearest clusters. Every shard builds a robust-pruned graph; the adjacency lists of all shards are
united; and in every shard a greedy search runs for each vector from the shard's medoids (and from the vector's own place in the
graph), then widens to all that the graph reaches within the links' radius and a margin. What it finds is verified in double precision.
A pair is counted in the first cluster that both share, whichever end found it, so counts are equal at both ends. A pair without
a common cluster needs OVERLAP clusters on either side that lie near enough to the border; a label of fewer than 2 * OVERLAP clusters has
none. Elsewhere vectors visit the nearest such clusters, and in rounds those that edges and near vectors lead to, and search
their graphs; these pairs are written out and counted once for both ends. Recall is audited by audit_recall().

Vectors are compared only within a label (null labels with nothing) and a length. Defined results: null, empty and zero vectors, and vectors
with null or non-finite components, link with nothing and are their own component; equal vectors collapse into one node with a
multiplicity and always link; repeated or null vec_ids are rows of their own; an empty table gives no rows; further columns, of whatever
names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize

SIMILARITY = 0.98
#: Nodes and bytes that the first centres are fitted on, at most, and such centres of a label; sampled nodes for each further centre; bytes of
#: all centres, at most (they go to every task).
FIT_ROWS, FIT_BYTES, FIRST, PER_CENTRE, CENTRE_BYTES = 20_000, 64_000_000, 256, 16, 200_000_000
#: Nodes a cluster should hold; clusters of a node; nodes of a shard's block, at most.
CLUSTER_NODES, OVERLAP, BLOCK = 1500, 3, 6000
#: Graph: nearest candidates of a node, nodes drawn for others, edges kept to either, pruning factor.
NEAR, FAR, DEGREE, AWAY, ALPHA = 32, 128, 16, 8, 1.2
#: Search: vectors at a time, medoids to start from, width of the greedy beam, and how far below the radius it widens.
BATCH, ENTRIES, BEAM, SLACK = 256, 8, 8, 0.03
#: Clusters beyond its own that a node visits unled, at most, and rounds of visits that are led to.
SURE, MAX_ROUNDS = 8, 60


def _units(values: list) -> list[np.ndarray | None]:
    """Vectors in double precision; None for a null one, null components as NaN."""
    return [None if v is None else np.asarray(v, dtype=np.float64) for v in values]


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        held = _units(b["embedding"].tolist())
        size = np.array([0 if x is None else len(x) for x in held])
        key: list[str | None] = [None] * len(b)
        unit: list[bytes | None] = [None] * len(b)
        for n in np.unique(size[size > 0]):
            at = np.flatnonzero(size == n)
            x = np.stack([held[i] for i in at]) + 0.0
            top = np.abs(x).max(1)
            ok = np.isfinite(x).all(1) & (top > 0)
            at, x = at[ok], x[ok]
            y = x / top[ok][:, None]
            y /= np.sqrt((y * y).sum(1, keepdims=True))
            for i, a, u in zip(at, x, y):
                key[i], unit[i] = f"{n}:{hashlib.md5(a.tobytes()).hexdigest()}", u.tobytes()
        grp = [f"{g}:{n}" if k and g is not None and g == g else None for k, g, n in zip(key, b["label"], size)]
        yield pd.DataFrame({"rid": b["rid"], "vec_id": b["vec_id"], "grp": grp, "key": key, "unit": unit})


def _matrix(rows: pd.Series, dtype=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1).astype(dtype)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 2) -> np.ndarray:
    """Unit centres of k clusters of unit rows."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        norm = np.sqrt((s * s).sum(1, keepdims=True))
        c = np.where(norm > 1e-9, s / np.maximum(norm, 1e-9), c)
    return c


def robust_prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each row of own the candidates that no kept, nearer one stands before (alpha times nearer to the candidate), -1 padded."""
    n = len(own)
    d_own = 2 - 2 * np.einsum("nd,ncd->nc", x[own], x[cand])
    order = np.argsort(d_own, axis=1, kind="stable")
    cand, d_own = np.take_along_axis(cand, order, 1), np.take_along_axis(d_own, order, 1)
    alive = cand != own[:, None]
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    out = np.full((n, degree), -1, np.int64)
    vec = x[cand]
    row = np.arange(n)
    for r in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        first = alive.argmax(1)
        out[some, r] = cand[row, first][some]
        d = 2 - 2 * np.einsum("nd,ncd->nc", vec[row, first], vec)
        alive &= ~(alpha * d <= d_own)
        alive[row, first] = False
    return out


def candidates(sim: np.ndarray, near: int, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of each row, and of FAR drawn nodes those whose ranks rise by half each (the nearest, the next, ...).

    Without the second, whose distances are of all scales, the edges of a dense crowd would all stay within it, however near the next
    crowd is.
    """
    drawn = r.permutation(sim.shape[1])[:FAR]
    ranks = np.unique((1.5 ** np.arange(40)).astype(np.int64) - 1)
    order = np.argsort(-sim[:, drawn], axis=1)[:, ranks[ranks < len(drawn)]]
    return np.argpartition(-sim, near - 1, axis=1)[:, :near], drawn[order]


def build_graph(x: np.ndarray, seed: int = 4) -> list[np.ndarray]:
    """Adjacency of unit rows x: robust-pruned candidates near and far, reverse edges, and all reachable from the medoid."""
    n = len(x)
    if n == 1:
        return [np.zeros(0, np.int64)]
    f = x.astype(np.float32)
    r = np.random.default_rng(seed)
    near = min(NEAR, n - 1)
    src, dst = [], []
    for at in range(0, n, 512):
        own = np.arange(at, min(n, at + 512))
        sim = f[own] @ f.T
        sim[np.arange(len(own)), own] = -2
        close, far = candidates(sim, near, r)
        kept = np.concatenate([robust_prune(f, own, close), robust_prune(f, own, far, AWAY)], 1)
        a, b = np.nonzero(kept >= 0)
        src.append(own[a])
        dst.append(kept[a, b])
    s, d = np.concatenate(src), np.concatenate(dst)
    edge = np.unique(np.concatenate([s * n + d, d * n + s]))
    s, d = edge // n, edge % n
    adj = np.split(d, np.searchsorted(s, np.arange(1, n)))
    # Whatever the medoid does not reach is tied to its nearest reached node, so that no part is lost to the search.
    seen = np.zeros(n, bool)
    front = np.array([medoid(f)])
    while True:
        while len(front):
            seen[front] = True
            front = np.unique(np.concatenate([adj[i] for i in front]))
            front = front[~seen[front]]
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return adj
        have = np.flatnonzero(seen)
        i = lost[0]
        j = have[(f[have] @ f[i]).argmax()]
        adj[i], adj[j] = np.append(adj[i], j), np.append(adj[j], i)
        front = np.array([i])


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def medoids(x: np.ndarray, most: int = ENTRIES) -> np.ndarray:
    """Entry nodes of a graph: the medoid, and those of some parts of its nodes."""
    c = spherical_kmeans(x, min(most, 1 + len(x) // 100), rounds=3)
    return np.unique(np.append((x @ c.T).argmax(0), medoid(x)))


def first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest cluster in both lists of each row (-1 is padding), or -1."""
    big = np.iinfo(np.int64).max
    out = np.full(len(a), big)
    for k in range(a.shape[1]):
        out = np.where((a[:, k] >= 0) & (a[:, [k]] == b).any(1), np.minimum(out, a[:, k]), out)
    return np.where(out == big, -1, out)


def open_clusters(x: np.ndarray, c: np.ndarray, lists: np.ndarray, threshold: float) -> np.ndarray:
    """(row, cluster) true where a linked node that shares no cluster with the row could lie.

    Such a node is no nearer to any cluster of the row's list than to any of its own, so the row is within the link's length
    of all those borders; and its whole list has to be open to the row.
    """
    n, k = len(x), len(c)
    wide = lists.shape[1]
    if k < 2 * wide:
        return np.zeros((n, k), bool)
    s, row = x @ c.T, np.arange(n)
    gap = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
    out = np.ones((n, k), bool)
    for j in range(wide):
        own = lists[:, j]
        out &= s[row, own][:, None] - s <= np.sqrt(max(2 - 2 * threshold, 0)) * gap[own] + 1e-6
        out[row, own] = False
    out[out.sum(1) < wide] = False
    return out


def _surely(x: np.ndarray, c: np.ndarray, may: np.ndarray, wide: int) -> np.ndarray:
    """The nearest open clusters: one of them is on every list that is wholly open, unless they are more than SURE."""
    s = np.where(may, x @ c.T, -np.inf)
    rank = np.argsort(np.argsort(-s, axis=1, kind="stable"), axis=1)
    return may & (rank < np.minimum(may.sum(1) - wide + 1, SURE)[:, None])


def _classes(hit: np.ndarray) -> np.ndarray:
    """The first row of each row's component in a symmetric matrix of links."""
    root = np.full(len(hit), -1)
    for i in range(len(hit)):
        if root[i] < 0:
            root[i], todo = i, [i]
            while todo:
                more = np.flatnonzero(hit[todo.pop()] & (root < 0))
                root[more] = i
                todo += more.tolist()
    return root


def _lists(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(r, np.int64) for r in rows])


def _one_hot(lists: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(lists), k), np.float32)
    out[np.arange(len(lists))[:, None], lists] = 1
    return out


class Adjacency(NamedTuple):
    """Lists of neighbours one behind the other: those of node i are ends[first[i] : first[i + 1]]."""

    first: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Adjacency:
        return cls(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64))

    @classmethod
    def among(cls, node: np.ndarray, lists: pd.Series) -> Adjacency:
        """From lists of node ids, by place among these nodes, which ascend; edges to others are left out."""
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        ends = np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in lists]])
        own = np.repeat(np.arange(len(node)), size)
        at = np.minimum(np.searchsorted(node, ends), len(node) - 1)
        there = node[at] == ends
        return cls(np.concatenate([[0], np.cumsum(np.bincount(own[there], minlength=len(node)))]), at[there])

    def pairs(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in nodes, neighbour) of all neighbours of the nodes."""
        size = self.first[nodes + 1] - self.first[nodes]
        place = np.arange(int(size.sum())) + np.repeat(self.first[nodes] - (np.cumsum(size) - size), size)
        return np.repeat(np.arange(len(nodes)), size), self.ends[place]

    def rows(self, nodes: np.ndarray) -> np.ndarray:
        """The nodes' neighbours as rows, -1 where they end."""
        size = self.first[nodes + 1] - self.first[nodes]
        out = np.full((len(nodes), max(1, int(size.max(initial=0)))), -1, np.int64)
        out[np.arange(out.shape[1]) < size[:, None]] = self.pairs(nodes)[1]
        return out


def _similarity(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, x.dtype), *[np.einsum("ij,ij->i", q[rows[i : i + 65_536]], x[cols[i : i + 65_536]]) for i in range(0, len(rows), 65_536)]])


def range_search(q: np.ndarray, x: np.ndarray, adjacency: Adjacency, entries: np.ndarray, radius: float, beam: int = BEAM, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of every node of the graph that the searches come to within the radius (a cosine) and a margin of slack.

    entries: nodes that each query's search starts from, -1 for none. A greedy search with a beam goes towards the query; from all that it met
    in the margin the search then widens, ring by ring, until no ring holds a new node in the margin.
    """
    q, x = q.astype(np.float32), x.astype(np.float32)
    n, m = len(q), len(x)
    sims = np.full((n, m), -2, np.float32)

    def compare(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Similarities of a row's nodes, which are noted; -2 where there is no node."""
        s = np.where(nodes >= 0, np.einsum("bd,bkd->bk", q[rows], x[nodes]), np.float32(-2))
        there = nodes >= 0
        sims.ravel()[(nodes + rows[:, None] * m)[there]] = np.maximum(s[there], -1)
        return s

    active = np.arange(n)
    pool = np.full((n, max(beam, entries.shape[1])), -1, np.int64)
    pool[:, : entries.shape[1]] = entries
    again = (pool[:, :, None] == pool[:, None, :]) & (np.arange(pool.shape[1])[:, None] > np.arange(pool.shape[1]))
    pool[again.any(2)] = -1
    score = compare(active, pool)
    top = np.argsort(-score, axis=1, kind="stable")[:, :beam]
    pool, score = np.take_along_axis(pool, top, 1), np.take_along_axis(score, top, 1)
    done = pool < 0
    while len(active):
        ahead = np.where(done[active], np.float32(-2), score[active])
        best = ahead.argmax(1)
        go = ahead[np.arange(len(active)), best] > -2
        active, best = active[go], best[go]
        done[active, best] = True
        near = adjacency.rows(pool[active, best])
        s = compare(active, near)
        s[(near[:, :, None] == pool[active][:, None, :]).any(2)] = -2
        # The pool stands first, so that ties change nothing and every search ends.
        ids, marks = np.concatenate([pool[active], near], 1), np.concatenate([done[active], s <= -2], 1)
        s = np.concatenate([score[active], s], 1)
        top = np.argsort(-s, axis=1, kind="stable")[:, :beam]
        pool[active], score[active], done[active] = (np.take_along_axis(v, top, 1) for v in (ids, s, marks))
    # Pairs are numbered query * m + node.
    flat = sims.ravel()
    ring = np.flatnonzero(flat >= radius - slack)
    while len(ring):
        new = np.zeros(n * m, bool)
        for i in range(0, len(ring), 65_536):
            part = ring[i : i + 65_536]
            own, near = adjacency.pairs(part % m)
            new[(part // m * m)[own] + near] = True
        key = np.flatnonzero(new)
        key = key[flat[key] == -2]
        flat[key] = np.maximum(_similarity(q, x, key // m, key % m), -1)
        ring = key[flat[key] >= radius - slack]
    return np.divmod(np.flatnonzero(flat >= radius - slack), m)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's graph: each node's neighbours by id."""
    pdf = pdf.sort_values("node")
    node = pdf["node"].to_numpy()
    return pd.DataFrame({"node": node, "near": [node[a] for a in build_graph(_matrix(pdf["unit"]))]})


def _search(threshold: float, centres: dict[str, np.ndarray]):
    """The nodes of a block searched for in another's graph and the other way round (or a block in its own): links counted here, a
    node each hangs with, clusters to visit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, cluster, c = pdf["i"].iloc[0], pdf["j"].iloc[0], pdf["cluster"].iloc[0], centres.get(pdf["grp"].iloc[0])
        parts = [pdf[pdf["block"] == b].sort_values("node") for b in sorted({i, j})]
        pdf = pd.concat(parts)
        first = [0, len(parts[0])][: len(parts)]
        node, mult, lists, x = pdf["node"].to_numpy(), pdf["mult"].to_numpy(), _lists(pdf["clusters"]), _matrix(pdf["unit"])
        n = len(node)
        may = open_clusters(x, c, lists, threshold) if c is not None else np.zeros((n, 1), bool)
        far = may.any()
        visit = np.zeros(may.shape, bool)
        has = _one_hot(lists, len(c)) if far else None
        links, hit = np.zeros(n, np.int64), np.zeros((n, n), bool)
        for base, part in zip(first, parts):
            members = np.arange(base, base + len(part))
            own = x[members]
            adjacency, centre = Adjacency.among(node[members], part["near"]), medoids(own)
            asking = members if i == j else np.setdiff1d(np.arange(n), members)
            for lo in range(0, len(asking), BATCH):
                ask = asking[lo : lo + BATCH]
                entries = np.concatenate([np.tile(centre, (len(ask), 1)), (ask - base)[:, None] if i == j else np.full((len(ask), 1), -1)], 1)
                a, b = range_search(x[ask], own, adjacency, entries, threshold, beam=BEAM if i != j else BEAM // 2)
                if far:
                    near = np.zeros((len(ask), len(own)), np.float32)
                    near[a, b] = 1
                    visit[ask] |= near @ has[members] > 0
                    visit[members] |= near.T @ has[ask] > 0
                a, b = ask[a], members[b]
                sure = (_similarity(x, x, a, b) >= threshold) & (a != b)
                hit[a[sure], b[sure]] = hit[b[sure], a[sure]] = True
            if far and i == j:
                for r in range(len(own)):
                    visit[base + r] |= has[base + adjacency.ends[adjacency.first[r] : adjacency.first[r + 1]]].any(0)
        if far and i == j:
            visit |= _surely(x, c, may, lists.shape[1])
        a, b = np.nonzero(np.triu(hit))
        here = first_common(lists[a], lists[b]) == cluster
        a, b = a[here], b[here]
        np.add.at(links, a, mult[b])
        np.add.at(links, b, mult[a])
        visit &= may
        return pd.DataFrame({"node": node, "links": links, "root": node[_classes(hit)], "visits": [np.flatnonzero(v) for v in visit]})

    return run


def _visit(threshold: float, centres: dict[str, np.ndarray]):
    """Visitors search a block's graph from its medoid: those linked that share no cluster, and the clusters that near members lead to."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        member, query = pdf[pdf["member"]].sort_values("node"), pdf[~pdf["member"]]
        c = centres[pdf["grp"].iloc[0]]
        if not len(member) or not len(query):
            return pd.DataFrame({"node": [], "far": [], "visits": []})
        x, lists, ids = _matrix(member["unit"]), _lists(member["clusters"]), member["node"].to_numpy()
        adjacency, centre = Adjacency.among(ids, member["near"]), medoids(x)
        q, own = _matrix(query["unit"]), _lists(query["clusters"])
        has, may, far, visits = _one_hot(lists, len(c)), open_clusters(q, c, own, threshold), [], []
        for lo in range(0, len(q), BATCH):
            ask = q[lo : lo + BATCH]
            a, b = range_search(ask, x, adjacency, np.tile(centre, (len(ask), 1)), threshold)
            near = np.zeros((len(ask), len(x)), np.float32)
            near[a, b] = 1
            visits += [np.flatnonzero(v) for v in (near @ has > 0) & may[lo : lo + BATCH]]
            sure = _similarity(ask, x, a, b) >= threshold
            a, b = a[sure], b[sure]
            apart = first_common(own[lo + a], lists[b]) < 0
            a, b = a[apart], b[apart]
            far += np.split(ids[b], np.searchsorted(a, np.arange(1, len(ask))))
        return pd.DataFrame({"node": query["node"].to_numpy(), "far": far, "visits": visits})

    return run


def link_embeddings(vectors: DataFrame, *, threshold: float = SIMILARITY) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row a vector."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label")).withColumn("rid", F.monotonically_increasing_id())
    seen = materialize(rows.mapInPandas(_clean, "rid long, vec_id long, grp string, key string, unit binary"), "vectors")
    live = seen.where("grp is not null")
    node = materialize(live.groupBy("grp", "key").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("mult")), "nodes")
    unit = live.join(node.select(F.col("node").alias("rid"), "mult"), "rid").select(F.col("rid").alias("node"), "grp", "mult", "unit")
    found = _search_shards(spark, unit, node, threshold)
    pairs = found.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b"))
    component = connected_components(pairs, "classes")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    per = node.join(links, "node", "left").join(component, "node", "left").select("grp", "key", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    member = seen.select("rid", "vec_id", "grp", "key").join(per, ["grp", "key"], "left")
    member = materialize(member.select("rid", "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "rid").alias("component")), "members")
    first = member.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = member.join(first, "component").select("vec_id", "n_links", "component_id", (F.col("vec_id").eqNullSafe(F.col("component_id"))).alias("kept"))
    discard(found)
    return out


def fit_centres(unit: DataFrame, node: DataFrame) -> dict[str, np.ndarray]:
    """Unit centres of the clusters of every group, about one for CLUSTER_NODES nodes.

    The first centres come from a bounded sample on the driver. A group that needs more gets them from tasks: each first centre's own
    sample is clustered by itself. All centres together are bounded by CENTRE_BYTES; beyond that shards grow and are cut into blocks.
    """
    wide = unit.agg(F.max(F.octet_length("unit"))).first()[0] or 8
    rows = max(64, min(FIT_ROWS, FIT_BYTES // wide))
    sample = unit.select("grp", "unit", "node").orderBy(F.xxhash64("node"), "node").limit(rows).collect()
    by: dict[str, list] = {}
    for r in sample:
        by.setdefault(r["grp"], []).append(r["unit"])
    # Groups without a node in the sample are small beside the others; they stay whole.
    sizes = {r["grp"]: r["n"] for r in node.where(F.col("grp").isin(list(by))).groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()} if by else {}
    centres, more = {}, []
    for g, u in sorted(by.items()):
        x, want = _matrix(pd.Series(u)), -(-sizes[g] // CLUSTER_NODES)
        centres[g] = spherical_kmeans(x, int(max(1, min(len(x) // 8, want, FIRST))))
        if want > 2 * len(centres[g]):
            more.append(g)
    total = sum(sizes[g] for g in more)
    if not total:
        return centres
    # PER_CENTRE sampled nodes for each centre that is wanted, and never more centres than fit.
    share = min(1.0, PER_CENTRE / CLUSTER_NODES, PER_CENTRE * (CENTRE_BYTES // (2 * wide)) / total)
    first = {g: centres[g] for g in more}

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, part in b.groupby("grp"):
                yield pd.DataFrame({"grp": g, "cell": (_matrix(part["unit"]) @ first[g].T).argmax(1), "unit": part["unit"]})

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["unit"])
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "centre": [c.tobytes() for c in spherical_kmeans(x, max(1, len(x) // PER_CENTRE))]})

    draw = F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(1 << 30)) < int(share * (1 << 30))
    cells = unit.where(F.col("grp").isin(more)).where(draw).select("grp", "unit").mapInPandas(near, "grp string, cell long, unit binary")
    found = cells.groupBy("grp", "cell").applyInPandas(split, "grp string, centre binary").collect()
    for g in more:
        own = sorted(r["centre"] for r in found if r["grp"] == g)
        if own:
            centres[g] = _matrix(pd.Series(own))
    return centres


def _search_shards(spark, unit: DataFrame, node: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root): of every node in every shard, the rows linked there that no earlier shard counts, and a node it hangs with."""
    centres = fit_centres(unit, node)
    wide, block_nodes = OVERLAP, BLOCK

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, part in b.groupby("grp"):
                c = centres.get(g)
                s = _matrix(part["unit"]) @ c.T if c is not None else np.zeros((len(part), 1))
                top = np.argsort(-s, axis=1, kind="stable")[:, :wide]
                yield pd.DataFrame({"node": part["node"], "grp": g, "mult": part["mult"], "unit": part["unit"], "clusters": list(top)})

    nodes = materialize(unit.mapInPandas(assign, "node long, grp string, mult long, unit binary, clusters array<long>"), "placed")
    blocks = nodes.select("grp", F.explode("clusters").alias("cluster")).groupBy("grp", "cluster").agg(F.ceil(F.count(F.lit(1)) / block_nodes).cast("int").alias("blocks"))
    blocks = materialize(blocks, "blocks")

    def dealt(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("cluster", F.explode("clusters")).join(blocks, ["grp", "cluster"])
        return placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    # Every block builds its graph; the lists of a node's blocks are united.
    edges = dealt(nodes.select("node", "grp", "unit", "clusters")).groupBy("grp", "cluster", "block").applyInPandas(_build, "node long, near array<long>")
    united = edges.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    graph = materialize(nodes.join(united, "node"), "graph")
    placed = dealt(graph)
    # Every pair of a shard's blocks is one task; one block is the rule.
    j = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = placed.withColumn("other", j).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")
    found = materialize(rows.groupBy("grp", "cluster", "i", "j").applyInPandas(_search(threshold, centres), "node long, links long, root long, visits array<long>"), "found")
    if all(len(c) < 2 * wide for c in centres.values()):
        return found.select("node", "links", "root")
    # Rounds of visits beyond the shards, until near nodes lead to no cluster that is new to a node.
    new = materialize(found.select("node", F.explode("visits").alias("cluster")).distinct(), "visits")
    done, far = new, []
    for _ in range(MAX_ROUNDS):
        if new.isEmpty():
            break
        query = new.join(nodes, "node")
        parts = query.groupBy("grp", "cluster").agg(F.ceil(F.count(F.lit(1)) / block_nodes).cast("int").alias("parts"))
        query = query.join(blocks, ["grp", "cluster"]).join(parts, ["grp", "cluster"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        member = placed.join(parts, ["grp", "cluster"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        none = F.expr("cast(null as array<long>)").alias("near")
        both = [member.select("grp", "cluster", "block", "part", "node", "unit", "clusters", "near", F.lit(True).alias("member")), query.select("grp", "cluster", "block", "part", "node", "unit", "clusters", none, F.lit(False).alias("member"))]
        got = both[0].unionByName(both[1]).groupBy("grp", "cluster", "block", "part").applyInPandas(_visit(threshold, centres), "node long, far array<long>, visits array<long>")
        got = materialize(got, "visited")
        far.append(got.select("node", F.explode("far").alias("end")))
        new = materialize(got.select("node", F.explode("visits").alias("cluster")).distinct().join(done, ["node", "cluster"], "left_anti"), "visits")
        done = done.unionByName(new)
    else:
        if not new.isEmpty():
            raise RuntimeError(f"visits did not settle in {MAX_ROUNDS} rounds")
    found = found.select("node", "links", "root")
    if far:
        pair = far[0]
        for f in far[1:]:
            pair = pair.unionByName(f)
        pair = pair.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()
        ends = pair.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pair.select(F.col("b").alias("node"), F.col("a").alias("root")))
        found = found.unionByName(ends.join(nodes.select(F.col("node").alias("root"), F.col("mult").alias("links")), "root").select("node", "links", "root"))
    return materialize(found, "links")


def audit_recall(vectors: DataFrame, linked: DataFrame, *, threshold: float = SIMILARITY, block: int = 256) -> DataFrame:
    """(expected, found): links of the queries whose id is divisible by 20, by brute force in blocks and as linked.

    The queries are joined to all rows block by block: a stated query set against all rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label")).withColumn("rid", F.monotonically_increasing_id())
    units = materialize(rows.mapInPandas(_clean, "rid long, vec_id long, grp string, key string, unit binary").where("grp is not null"), "audit")
    queries = units.where("vec_id % 20 = 0")
    parts = queries.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    queries = queries.join(parts, "grp").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")))
    blocks = queries.groupBy("grp", "part").agg(F.collect_list("rid").alias("ids"), F.collect_list("unit").alias("units"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, part in b.groupby(["grp", "part"]):
                ids = np.asarray(part["ids"].iloc[0])
                hit = _matrix(pd.Series(part["units"].iloc[0])) @ _matrix(part["unit"]).T >= threshold
                hit &= ids[:, None] != part["rid"].to_numpy()
                yield pd.DataFrame({"rid": ids, "n": hit.sum(1)})

    hits = units.select("grp", "rid", "unit").join(blocks, "grp").mapInPandas(count, "rid long, n long").groupBy("rid").agg(F.sum("n").alias("expected"))
    truth = queries.join(hits, "rid", "left").select("vec_id", F.coalesce("expected", F.lit(0)).alias("expected"))
    return truth.join(linked, "vec_id").agg(F.sum("expected").alias("expected"), F.sum(F.least("expected", "n_links")).alias("found"))
