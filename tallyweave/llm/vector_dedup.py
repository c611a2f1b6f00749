"""Near-duplicate vectors over a robust-pruned flat graph.

Vectors of a label are dealt to overlapping clusters, which are split again until each is
of a shard's size. Each shard builds a flat graph by batched insertion: greedy search on the
graph so far, robust pruning of what the search met, reverse edges. The shards' adjacency
lists are united, and every vector searches its shards from their medoids; once within range
the search expands over all neighbours in range. Where it meets a vector that is in other
shards too, it goes on in these, from that vector, until it meets no new shard. Links are
verified in double precision, and the recall of the result is audited against brute force.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm._shared import Scratch, components, join_copies


@dataclass(frozen=True)
class Settings:
    """``shard``: rows of a cluster, about, and of a block, at most about. ``overlap``:
    clusters that a vector joins. ``sample``: rows of a cluster, about, that the centroids
    it is split by are fitted on, and ``fanout`` the most of these. ``margin``: how much
    farther than the nearest a cluster may be for a vector to join it, below the first
    split. ``degree``, ``beam``, ``alpha``: edges kept by pruning, width of the greedy
    search, and how much nearer a kept neighbour must be to prune another. ``slack``: how
    far below the threshold the range search still expands. ``audit``: queries, about, of
    the recall audit. ``exact``: compare all rows of a label, in blocks, without a graph."""

    threshold: float = 0.93
    shard: int = 512
    overlap: int = 2
    sample: int = 4_096
    fanout: int = 256
    margin: float = 0.1
    degree: int = 20
    beam: int = 24
    alpha: float = 1.2
    slack: float = 0.08
    audit: int = 256
    recall: float = 0.97
    seed: int = 5
    exact: bool = False


# --- the graph of one shard -----------------------------------------------------


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def greedy(x: np.ndarray, near: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of many queries at once. ``near``: adjacency (node, slot), -1 where
    free. Marks in ``seen`` (query, node) every node it compared; returns the beams'
    nodes and similarities, best first (-1 where free)."""
    n = len(queries)
    ids = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), -np.inf, np.float32)
    first = start[:beam]
    ids[:, : len(first)], sims[:, : len(first)] = first, queries @ x[first].T
    seen[:, first] = True
    done = np.zeros((n, beam), bool)
    while True:
        todo = ~done & (ids >= 0)
        active = np.flatnonzero(todo.any(axis=1))
        if not len(active):
            break
        best = np.where(todo[active], sims[active], -np.inf).argmax(axis=1)
        done[active, best] = True
        next_ = near[ids[active, best]]
        new = (next_ >= 0) & ~seen[active[:, None], next_]
        seen[np.broadcast_to(active[:, None], new.shape)[new], next_[new]] = True
        found = np.where(new, np.einsum("qd,qrd->qr", queries[active], x[next_], optimize=False), np.float32(-np.inf))
        all_ids = np.concatenate([ids[active], np.where(new, next_, -1)], axis=1)
        all_sims = np.concatenate([np.where(ids[active] >= 0, sims[active], -np.inf), found], axis=1)
        all_done = np.concatenate([done[active], np.zeros_like(new)], axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        take = lambda a: np.take_along_axis(a, order, axis=1)
        ids[active], sims[active], done[active] = take(all_ids), take(all_sims), take(all_done)
        ids[~np.isfinite(sims)] = -1
    return ids, sims


def robust_prune(x: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Keeps of each node's pool (-1: free) the nearest, drops what lies ``alpha`` times
    nearer to it than to the node, and goes on with the rest, ``degree`` times at most."""
    out = np.full((len(nodes), degree), -1, np.int64)
    for at in range(0, len(nodes), 512):
        own, ids = nodes[at : at + 512], pool[at : at + 512]
        v = x[np.maximum(ids, 0)]
        far = 1 - np.einsum("nd,nmd->nm", x[own], v)
        open_ = (ids >= 0) & (ids != own[:, None])
        order = np.argsort(np.where(open_, far, np.inf), axis=1, kind="stable")
        ids, far, open_ = (np.take_along_axis(a, order, axis=1) for a in (ids, far, open_))
        v = np.take_along_axis(v, order[:, :, None], axis=1)
        open_[:, 1:] &= ids[:, 1:] != ids[:, :-1]
        apart = 1 - v @ v.transpose(0, 2, 1)
        rows = np.arange(len(own))
        for slot in range(degree):
            has = open_.any(axis=1)
            if not has.any():
                break
            pick = open_.argmax(axis=1)
            out[at : at + 512][has, slot] = ids[rows, pick][has]
            open_[rows, pick] = False
            open_ &= alpha * apart[rows, pick] > far
    return out


def build(x: np.ndarray, settings: Settings) -> np.ndarray:
    """Adjacency (node, slot) of a shard's graph, by insertion in batches that double
    until they are a fifth of what is in."""
    n, degree = len(x), settings.degree
    near = np.full((n, degree), -1, np.int64)
    if n < 2:
        return near
    order = np.random.default_rng(settings.seed).permutation(n)
    top = medoid(x)
    order = np.concatenate(([top], order[order != top]))
    done = 1
    while done < n:
        batch = order[done : done + max(1, min(done, max(64, done // 5)))]
        seen = np.zeros((len(batch), n), bool)
        beams, _ = greedy(x, near, x[batch], np.array([top]), settings.beam + degree, seen)
        near[batch] = robust_prune(x, batch, beams, degree, settings.alpha)
        source, target = np.repeat(batch, degree), near[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        hit, first, count = np.unique(target, return_index=True, return_counts=True)
        pool = np.full((len(hit), degree + int(count.max())), -1, np.int64)
        pool[:, :degree] = near[hit]
        row = np.repeat(np.arange(len(hit)), count)
        pool[row, degree + np.arange(len(target)) - np.repeat(first, count)] = source
        full = (pool >= 0).sum(axis=1) > degree
        for i in np.flatnonzero(~full):
            kept = pool[i][pool[i] >= 0]
            near[hit[i], : len(kept)] = kept
        for part in np.array_split(np.flatnonzero(full), max(1, int(full.sum()) * pool.shape[1] // 200_000)):
            if len(part):
                near[hit[part]] = robust_prune(x, hit[part], pool[part], degree, settings.alpha)
        done += len(batch)
    return near


class Graph:
    """Out-edges as rows padded with -1, for the greedy search, and the neighbours of
    either direction one after another, for the range search: in a dense group some
    nodes are on nobody's pruned list, but all have neighbours of their own. Both come as
    edges (source, target)."""

    def __init__(self, n: int, out: np.ndarray, either: np.ndarray):
        sizes, starts, flat = _by_source(n, out)
        self.near = np.full((n, max(1, int(sizes.max(initial=0)))), -1, np.int64)
        row = np.repeat(np.arange(n), sizes)
        self.near[row, np.arange(len(flat)) - starts[row]] = flat
        self.sizes, self.starts, self.flat = _by_source(n, either)

    def neighbours(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``nodes``, neighbour) of each neighbour of each node."""
        sizes = self.sizes[nodes]
        place = np.repeat(np.arange(len(nodes)), sizes)
        within = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return place, self.flat[self.starts[nodes][place] + within]


def _by_source(n: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and starts of the targets of each of n sources, and all targets, by source."""
    source, target = edges
    order = np.lexsort((target, source))
    sizes = np.bincount(source, minlength=n)
    return sizes, np.cumsum(sizes) - sizes, target[order]


def range_search(x: np.ndarray, graph: Graph, queries: np.ndarray, start: np.ndarray, settings: Settings, entries: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Boolean (query, node): nodes within ``threshold`` (as far as single precision
    tells) that the search met. Greedy first; then every node within ``slack`` of the
    threshold hands on its neighbours until none is new. ``entries`` (query, node) are
    met as well."""
    low, wide = np.float32(settings.threshold - 1e-4), np.float32(settings.threshold - settings.slack)
    seen = np.zeros((len(queries), len(x)), bool)
    hits = np.zeros((len(queries), len(x)), bool)
    beams, sims = greedy(x, graph.near, queries, start, settings.beam, seen)
    q, slot = np.nonzero((beams >= 0) & (sims >= wide))
    node = beams[q, slot]
    hits[q, node] = sims[q, slot] >= low
    known = np.zeros(seen.shape, bool)
    known[q, node] = True
    if entries is not None and len(entries[0]):
        eq, enode = entries[0][~known[entries]], entries[1][~known[entries]]
        sim = np.einsum("ij,ij->i", queries[eq], x[enode])
        known[eq, enode], hits[eq, enode] = True, sim >= low
        q, node = np.append(q, eq[sim >= wide]), np.append(node, enode[sim >= wide])
    while len(q):
        new_q, new_node = [], []
        for at in range(0, len(q), 1 << 15):
            place, b = graph.neighbours(node[at : at + (1 << 15)])
            a = q[at : at + (1 << 15)][place]
            fresh = ~known[a, b]
            pair = np.unique(a[fresh] * len(x) + b[fresh])
            a, b = pair // len(x), pair % len(x)
            known[a, b] = True
            sim = np.einsum("ij,ij->i", queries[a], x[b])
            hits[a, b] = sim >= low
            new_q.append(a[sim >= wide])
            new_node.append(b[sim >= wide])
        q, node = np.concatenate(new_q), np.concatenate(new_node)
    return hits


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, from links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


# --- the operator ------------------------------------------------------------------


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable() -> Column:
    """Whether a row can link at all."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0)


def _marks() -> list[Column]:
    return [F.xxhash64(F.lit(n), "label", "embedding").alias(f"mark{n}") for n in (1, 2)]


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """``label``, ``embedding``, ``least`` (the smallest vec_id), ``copies``, ``mark1``,
    ``mark2``: the distinct vectors that can link at all, equal ones collapsed."""
    usable = vectors.select("vec_id", "label", "embedding").filter(_usable())
    return usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).select("*", *_marks())


_CELL = ["label", "dims", "shard"]


def _fitted(rows: pd.DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray] | None:
    """Centroids of a sample of a cluster, by spherical k-means, and the part that each
    stands for; None if it can't be split. Centroids within ``slack`` and a little of linking
    are one part, so that a dense group is not parted: it becomes blocks of one cluster, which
    are searched in pairs. So does a cluster that would leave most of its rows together."""
    k = min(int(np.ceil(settings.overlap * rows["n"].iloc[0] / settings.shard)), settings.fanout, len(rows))
    if k <= settings.overlap:
        return None
    x = _unit(_vectors(rows.sort_values("mark1")["embedding"]))
    middle = x[np.random.default_rng(settings.seed).permutation(len(x))[:k]]
    for _ in range(8):
        nearest = (x @ middle.T).argmax(axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, nearest, x)
        some = np.abs(sums).max(axis=1) > 1e-12
        middle[some] = _unit(sums[some])
    a, b = np.nonzero(middle @ middle.T >= settings.threshold - settings.slack - 0.05)
    _, part = np.unique(_forest(len(middle), a, b), return_inverse=True)
    if part.max() + 1 <= settings.overlap:
        return None
    joined = _joined(x, middle, part, settings.overlap, None)
    return None if np.bincount(joined[1]).max() > 0.75 * len(x) else (middle, part)


def _joined(x: np.ndarray, middle: np.ndarray, part: np.ndarray, overlap: int, margin: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, part) of the ``overlap`` nearest parts of each row, within ``margin`` if given."""
    by = np.argsort(part, kind="stable")
    near = np.maximum.reduceat((x @ middle.T)[:, by], np.searchsorted(part[by], np.arange(part.max() + 1)), axis=1)
    best = np.argsort(-near, axis=1, kind="stable")[:, :overlap]
    which = np.ones(best.shape, bool)
    if margin is not None:
        sims = np.take_along_axis(near, best, axis=1)
        which = sims >= sims[:, :1] - margin
    row, slot = np.nonzero(which)
    return row, best[row, slot]


#: Rows of a cluster that are dealt to its parts in one task, and clusters up to which
#: tables about them are broadcast whole.
DEALT, CLUSTERS = 16_384, 100_000


def _child(shard: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Numbers of the parts of a cluster."""
    return (shard.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) + np.uint64(1)).view(np.int64)


def _shards(nodes: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """Nodes with each of their shards, ``shard``, ``block`` and ``blocks``.

    The label and length of a vector are the first cluster. A cluster that is too large is
    split by centroids of a bounded sample of its own; its rows are dealt in bounded tasks;
    parts that are still too large are split again. So no size of the table makes shards
    larger or what a task or the driver holds."""
    now = nodes.select("node", "label", "embedding", "copies", "mark1", F.size("embedding").alias("dims"), F.lit(0).cast("long").alias("shard"))
    done, margin = [], None
    while True:
        limit = settings.shard if margin is None else 2 * settings.shard
        sizes = scratch.keep(now.groupBy(*_CELL).agg(F.count("*").alias("n")), "sizes")
        large = sizes.filter(F.lit(not settings.exact) & (F.col("n") > limit)).withColumn("copies_", F.col("n"))
        if large.isEmpty():
            done.append(now)
            break
        met = join_copies(now, large, _CELL, "copies_", scratch, CLUSTERS)
        share = F.least(F.lit(1.0), F.lit(float(settings.sample)) / F.col("n"))
        drawn = met.filter("n IS NOT NULL").filter(F.pmod(F.xxhash64("mark1", F.lit(settings.seed)), F.lit(1 << 30)) < share * (1 << 30))
        label = nodes.schema["label"].dataType.simpleString()

        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            found = _fitted(rows, settings)
            if found is None:
                return pd.DataFrame({c: [] for c in (*_CELL, "part", "middle")}, dtype=object)
            own = {c: rows[c].iloc[0] for c in _CELL}
            return pd.DataFrame({**own, "part": found[1], "middle": list(found[0])})[[*_CELL, "part", "middle"]]

        cells = drawn.groupBy(*_CELL).applyInPandas(fit, f"label {label}, dims int, shard long, part int, middle array<double>")
        middles = scratch.keep(cells, "middles")
        parted = middles.groupBy(*_CELL).agg(F.lit(1).alias("parted")).join(large, _CELL)
        told = join_copies(now, parted, _CELL, "copies_", scratch, CLUSTERS)
        done.append(told.filter("parted IS NULL").select(*now.columns))
        salts = F.ceil(F.col("n") / DEALT).cast("int")
        left = told.filter("parted = 1").withColumn("salt", F.pmod(F.xxhash64("mark1", F.lit(settings.seed + 3)), salts).cast("int")).select(*now.columns, "salt")
        right = middles.join(large, _CELL).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select(*_CELL, "salt", "part", "middle")

        within = margin

        def deal(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):  # fewer rows than tasks for them
                return pd.DataFrame({c: [] for c in names}, dtype=object)
            own = own.sort_values("part", kind="stable")
            row, part = _joined(_unit(_vectors(rows["embedding"])), _vectors(own["middle"]), own["part"].to_numpy(np.int64), settings.overlap, within)
            out = rows.iloc[row].drop(columns="salt")
            return out.assign(shard=_child(out["shard"].to_numpy(np.int64), part))

        keys, names = [*_CELL, "salt"], now.columns
        now = scratch.hold(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(deal, now.schema))
        margin = settings.margin
    whole = reduce(DataFrame.unionByName, done)
    counts = whole.groupBy(*_CELL).agg(F.count("*").alias("copies_"), F.ceil(F.count("*") / (settings.shard * 2)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("mark1", F.lit(settings.seed + 1)), F.col("blocks")).cast("int")
    return join_copies(whole, scratch.keep(counts, "blocks"), _CELL, "copies_", scratch, CLUSTERS).withColumn("block", block)


def _graph(members: DataFrame, settings: Settings) -> DataFrame:
    """``node``, ``near``, ``back``, ``home``: each block's graph, out-edges and in-edges, the
    lists of a node united over its shards, and these shards."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("mark1", ignore_index=True)
        ids = rows["node"].to_numpy()
        near = np.full((len(ids), 1), -1) if settings.exact else build(_unit(_vectors(rows["embedding"])).astype(np.float32), settings)
        source, slot = np.nonzero(near >= 0)
        target = near[source, slot]
        by = np.argsort(target, kind="stable")
        back = np.split(ids[source[by]], np.searchsorted(target[by], np.arange(1, len(ids))))
        return pd.DataFrame({"node": ids, "shard": rows["shard"], "near": [ids[a[a >= 0]] for a in near], "back": back})

    lists = members.groupBy(*_CELL, "block").applyInPandas(of, "node long, shard long, near array<long>, back array<long>")
    united = (F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("near", "back"))
    return lists.groupBy("node").agg(*united, F.sort_array(F.collect_set("shard")).alias("home"))


class _Held:
    """The rows of a task, in arrays: vectors, homes, and the united lists as places."""

    def __init__(self, rows: pd.DataFrame):
        self.exact = _unit(_vectors(rows["embedding"]))
        self.ids, self.copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        self.out = self._edges(rows["near"])
        n = len(self.ids)
        both = np.concatenate([self.out, self._edges(rows["back"])], axis=1)
        pair = np.unique(both[0] * n + both[1])
        self.either = np.stack([pair // n, pair % n])
        self.home = np.zeros((len(rows), max(map(len, rows["home"]))), np.int64)
        self.homes = np.fromiter(map(len, rows["home"]), np.int64, len(rows))
        for i, shards in enumerate(rows["home"]):
            self.home[i, : len(shards)] = shards
        self.has = np.arange(self.home.shape[1])[None, :] < self.homes[:, None]

    def _edges(self, lists: pd.Series) -> np.ndarray:
        """(place, place) of the listed nodes that are here."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.concatenate(lists.to_numpy()).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
        order = np.argsort(self.ids, kind="stable")
        at = np.minimum(np.searchsorted(self.ids, flat, sorter=order), len(order) - 1)
        place = order[at]
        here = self.ids[place] == flat
        return np.stack([np.repeat(np.arange(len(lists)), sizes)[here], place[here]])

    def graph(self, base: np.ndarray) -> Graph:
        inside = np.full(len(self.ids), -1)
        inside[base] = np.arange(len(base))
        kept = (e[:, (inside[e[0]] >= 0) & (inside[e[1]] >= 0)] for e in (self.out, self.either))
        return Graph(len(base), *(inside[e] for e in kept))

    def share(self, a: np.ndarray, b: np.ndarray, below: int | None = None) -> np.ndarray:
        """Whether two rows have a shard in common, one with a number less than ``below``."""
        same = (self.home[a][:, :, None] == self.home[b][:, None, :]) & self.has[a][:, :, None] & self.has[b][:, None, :]
        if below is not None:
            same &= (self.home[a] < below)[:, :, None]
        return same.any(axis=(1, 2))

    def near(self, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        return np.einsum("ij,ij->i", self.exact[a], self.exact[b]) >= threshold

    def exits(self, q: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        """``node, visit, entries``: shards of the vectors met that the asking one is not in."""
        other = np.flatnonzero((self.homes[v] > 1) & ~((self.home[q] == self.home[v]).all(axis=1) & (self.homes[q] == self.homes[v])) if len(q) else np.zeros(0, bool))
        q, v = q[other], v[other]
        row, slot = np.nonzero(self.has[v])
        shard = self.home[v[row], slot]
        new = ~((self.home[q[row]] == shard[:, None]) & self.has[q[row]]).any(axis=1)
        frame = pd.DataFrame({"node": self.ids[q[row[new]]], "visit": shard[new], "entry": self.ids[v[row[new]]]})
        return frame.groupby(["node", "visit"])["entry"].agg(lambda x: sorted(set(x))).rename("entries").reset_index()


_FOUND = "node long, links long, root long, visit long, entries array<long>"


def _all_of(frames: list[pd.DataFrame]) -> pd.DataFrame:
    columns = [f.split(" ")[0] for f in _FOUND.split(", ")]
    kept = [f.reindex(columns=columns).astype({c: "Int64" for c in columns[:4]} | {"entries": object}) for f in frames if len(f)]
    for f in kept:
        f["entries"] = f["entries"].where(f["entries"].notna(), None)
    return pd.concat(kept, ignore_index=True) if kept else pd.DataFrame({c: [] for c in columns}, dtype=object)


def _found(rows: pd.DataFrame, shard: int, settings: Settings) -> pd.DataFrame:
    """Links within a shard's block (``side`` 0 only) or between two of its blocks, counted
    where the two nodes' first common shard is this one, and shards to go on in."""
    rows = rows.sort_values(["side", "mark1"], ignore_index=True)
    held, side = _Held(rows), rows["side"].to_numpy()
    pairs = []
    for asked, base_side in ((0, 1), (1, 0)) if side.max() > 0 else ((0, 0),):
        base, own = np.flatnonzero(side == base_side), np.flatnonzero(side == asked)
        x = held.exact[base].astype(np.float32)
        graph = held.graph(base)
        start = np.unique([medoid(x), *np.linspace(0, len(base) - 1, 4).astype(int)])
        for at in range(0, len(own), 2048):
            queries = held.exact[own[at : at + 2048]].astype(np.float32)
            if settings.exact:
                q, node = np.nonzero(queries @ x.T >= np.float32(settings.threshold - 1e-4))
            else:
                q, node = np.nonzero(range_search(x, graph, queries, start, settings))
            pairs.append(np.stack([own[at + q], base[node]]))
    a, b = np.concatenate(pairs, axis=1)
    exits = held.exits(a, b)
    a, b = np.minimum(a, b), np.maximum(a, b)
    n = len(held.ids)
    pair = np.unique(a[a != b] * n + b[a != b])
    a, b = pair // n, pair % n
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        keep[at : at + (1 << 16)] = held.near(p, q, settings.threshold) & ~held.share(p, q, shard)
    a, b = a[keep], b[keep]
    links = np.bincount(a, held.copies[b], n) + np.bincount(b, held.copies[a], n)
    some = np.flatnonzero(links)
    roots = held.ids[_least(_forest(n, a, b), held.ids)[some]]
    return _all_of([pd.DataFrame({"node": held.ids[some], "links": links[some].astype(np.int64), "root": roots}), exits])


def _least(root: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Place of the smallest id in each place's component."""
    order = np.argsort(ids, kind="stable")
    first = np.full(len(ids), -1)
    first[root[order[::-1]]] = order[::-1]
    return first[root]


def _search(with_graph: DataFrame, settings: Settings) -> DataFrame:
    """``_FOUND``: what each shard (or pair of its blocks) found."""
    tasks = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            F.least("block", other).alias("low"), F.greatest("block", other).alias("high"), (F.col("block") > other).cast("int").alias("side")
        ),
    )
    dealt = with_graph.withColumn("task", F.explode(tasks)).select("*", "task.low", "task.high", "task.side").drop("task")

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _found(rows, int(key[2]), settings)

    return dealt.groupBy(*_CELL, "low", "high").applyInPandas(of, _FOUND)


def _visited(rows: pd.DataFrame, settings: Settings) -> pd.DataFrame:
    """Links of visiting rows (``side`` 1) with a block of a shard that they are not in, as
    pairs (``node``, ``root``) of nodes without a common shard, and shards to go on in."""
    rows = rows.sort_values(["side", "mark1"], ignore_index=True)
    held, side = _Held(rows), rows["side"].to_numpy()
    base, own = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(base) or not len(own):
        return _all_of([])
    x = held.exact[base].astype(np.float32)
    graph, start = held.graph(base), np.unique([medoid(x), *np.linspace(0, len(base) - 1, 4).astype(int)])
    place = pd.Series(np.arange(len(base)), index=held.ids[base])
    frames = []
    for at in range(0, len(own), 1024):
        part = own[at : at + 1024]
        entries = [place.reindex(e).dropna().to_numpy(np.int64) for e in rows["entries"].iloc[part]]
        asked = np.repeat(np.arange(len(part)), [len(e) for e in entries])
        q, node = np.nonzero(range_search(x, graph, held.exact[part].astype(np.float32), start, settings, (asked, np.concatenate(entries))))
        a, b = part[q], base[node]
        close = held.near(a, b, settings.threshold)
        frames.append(held.exits(a[close], b[close]))
        new = close & ~held.share(a, b)
        frames.append(pd.DataFrame({"node": held.ids[a[new]], "root": held.ids[b[new]]}))
    return _all_of(frames)


def _across(with_graph: DataFrame, todo: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """``a, b``: links between nodes without a common shard. Nodes visit the shards that
    their search met, and from there others, each once."""
    nodes = with_graph.dropDuplicates(["node"]).drop("shard", "blocks", "block")
    shards = with_graph.groupBy(*_CELL).agg(F.max("blocks").alias("blocks"))
    pairs, seen = [], None
    while not todo.isEmpty():
        seen = todo.select("node", "visit") if seen is None else seen.unionByName(todo.select("node", "visit"))
        turns = todo.groupBy(F.col("visit").alias("shard")).agg(F.ceil(F.count("*") / (4 * settings.shard)).cast("int").alias("turns"))
        asked = todo.join(nodes, "node").withColumnRenamed("visit", "shard").join(turns, "shard").join(shards, _CELL)
        asked = asked.withColumn("turn", F.pmod(F.xxhash64("mark1"), F.col("turns")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        base = with_graph.join(turns, "shard").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        names = [*_CELL, "block", "turn", "node", "mark1", "embedding", "copies", "near", "back", "home"]
        nothing = F.array().cast("array<long>")
        both = base.select(*names, nothing.alias("entries"), F.lit(0).alias("side")).unionByName(asked.select(*names, "entries", F.lit(1).alias("side")))
        found = scratch.keep(both.groupBy(*_CELL, "block", "turn").applyInPandas(lambda rows: _visited(rows, settings), _FOUND), "visited")
        pairs.append(found.filter("root IS NOT NULL").select(F.least("node", "root").alias("a"), F.greatest("node", "root").alias("b")))
        todo = scratch.keep(_visits(found).join(seen, ["node", "visit"], "left_anti"), "visits")
    return reduce(DataFrame.unionByName, pairs).distinct() if pairs else todo.select(F.col("node").alias("a"), F.col("visit").alias("b"))


def _visits(found: DataFrame) -> DataFrame:
    return found.filter("visit IS NOT NULL").groupBy("node", "visit").agg(F.array_distinct(F.flatten(F.collect_list("entries"))).alias("entries"))


def near_duplicates(vectors: DataFrame, spark: SparkSession, settings: Settings = Settings()) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links`` (other vectors of its label within
    the threshold), ``component_id`` (smallest vec_id reachable), ``kept`` and
    ``audited_recall`` (of the whole run; null if there was nothing to find).

    Vectors that are null, zero or hold null, NaN or infinite components, have no label,
    no vec_id or a length of their own link with nothing; their component is their own
    vec_id. Equal vectors are one node whose copies count as links. Rows of one vec_id with
    several vectors each get the results of their own vector. Other columns are ignored, and
    an empty table gives no rows. A cluster that can't be split, such as a dense group, is
    cut into blocks by hash; every pair of its blocks is searched, so it costs time with its
    square over the block. Within a shard pairs never leave the task that finds them: it
    returns counts and a spanning forest.

    The audit takes the lower of two recalls: of all links of the audited nodes, and the mean
    over these nodes, so that a dense group can't hide what others lose. If it finds less than
    ``recall``, the run is made again with one more cluster for each vector and a wider beam,
    twice at most, and then by comparing all vectors of a label in blocks.
    """
    scratch = Scratch(spark, "vectors")
    # Written, as numbers given to rows change if a lost part is computed again.
    nodes = scratch.keep(distinct_vectors(vectors).withColumn("node", F.monotonically_increasing_id()), "nodes")
    audit = _audit_queries(nodes, settings)
    for attempt in range(4):
        found = scratch.keep(_links(nodes, settings, scratch), "found")
        recall = _recall(nodes, found, audit, spark, settings)
        if recall is None or recall >= settings.recall:
            break
        wider = {"overlap": settings.overlap + 1, "beam": settings.beam * 2}
        settings = replace(settings, **wider) if attempt < 2 else replace(settings, exact=True)
    roots = scratch.keep(components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch), "roots")
    narrow = nodes.select("node", "least", "copies", "mark1", "mark2")
    rooted = scratch.keep(roots.join(narrow.select("node", "least"), "node"), "rooted")
    tops = rooted.groupBy("root").agg(F.min("least").alias("top"), F.count("*").alias("members"))
    top_of = join_copies(rooted.select("node", "root"), tops, ["root"], "members", scratch).select("node", "top")
    per_node = (
        narrow.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .join(top_of, "node", "left")
        .select(
            "mark1", "mark2", "copies",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("top", "least").alias("component_id"),
        )
    )
    linked = scratch.keep(per_node.filter("n_links > 0"), "linked")
    # The hash passes over null components: rows that can't link get marks of their own.
    own_marks = [F.xxhash64(F.lit(-n), F.monotonically_increasing_id()) for n in (1, 2)]
    known = (F.when(_usable(), mark).otherwise(other).alias(f"mark{n}") for n, mark, other in zip((1, 2), _marks(), own_marks))
    rows = scratch.hold(vectors.select("vec_id", *known))
    own = F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("component_id")), F.col("vec_id"))
    return join_copies(rows, linked, ["mark1", "mark2"], "copies", scratch).select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        own.alias("component_id"),
        (F.col("vec_id") == own).alias("kept"),
        F.lit(recall).cast("double").alias("audited_recall"),
    )


def _links(nodes: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """``node, links, root``: parts of the numbers of links and of a spanning forest."""
    members = scratch.hold(_shards(nodes, settings, scratch))
    with_graph = scratch.hold(members.join(_graph(members, settings), "node"))
    found = scratch.keep(_search(with_graph, settings), "searched")
    cross = _across(with_graph, scratch.keep(_visits(found), "visits"), settings, scratch)
    weights = nodes.select("node", "copies")
    ends = cross.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
    added = ends.join(weights.withColumnRenamed("node", "other"), "other").select("node", F.col("copies").alias("links"), F.least("node", "other").alias("root"))
    return found.filter("root IS NOT NULL").select("node", "links", "root").unionByName(added)


def _audit_queries(nodes: DataFrame, settings: Settings) -> pd.DataFrame:
    """About ``audit`` nodes, chosen by hash."""
    part = min(1.0, settings.audit / max(1, nodes.count()))
    chosen = nodes.filter(F.pmod(F.xxhash64("mark1", F.lit(settings.seed + 2)), F.lit(1 << 30)) < int(part * (1 << 30)))
    return chosen.select("node", "label", "embedding").limit(4 * settings.audit).toPandas()


def _recall(nodes: DataFrame, found: DataFrame, audit: pd.DataFrame, spark: SparkSession, settings: Settings) -> float | None:
    """Links found of all links of the audited nodes; these are compared with every
    node, in blocks, and only their counts come back."""
    if not len(audit):
        return None
    sent = spark.sparkContext.broadcast(audit)

    def of(batches):
        asked = sent.value
        groups = [(k, g["node"].to_numpy(), _unit(_vectors(g["embedding"]))) for k, g in asked.groupby(["label", asked["embedding"].map(len)])]
        for rows in batches:
            for (label, size), names, x in groups:
                own = rows[(rows["label"] == label) & (rows["embedding"].map(len) == size)]
                if len(own):
                    near = (x @ _unit(_vectors(own["embedding"])).T >= settings.threshold) & (names[:, None] != own["node"].to_numpy()[None, :])
                    counts = (near * own["copies"].to_numpy()).sum(axis=1)
                    yield pd.DataFrame({"node": names[counts > 0], "n": counts[counts > 0]})

    true = nodes.mapInPandas(of, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    each = true.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    own = F.avg(F.least(F.lit(1.0), F.col("links") / F.col("n")))
    sums = each.agg(F.sum("n").alias("n"), F.sum("links").alias("links"), own.alias("own")).first()
    return None if not sums["n"] else min(1.0, sums["links"] / sums["n"], sums["own"])
