"""Near-duplicate vectors: hierarchical small-world graphs per shard of a label.

Vectors of a label are dealt over shards of bounded size. Each shard gets a
navigable small-world graph; every vector of the label then queries every
shard. A search keeps a beam of the best nodes seen. It ends when the beam has
room for vectors below the threshold, else the beam is doubled; and a shard
whose audit (queries compared with all its vectors) falls short of ``RECALL``
starts again with wider beams, up to the whole shard. Cosines of hits are taken
in double precision.

Equal vectors are one node with a number of copies. Searches return how many
links a vector has and, per task, a spanning forest of the links found, so a
dense cluster costs its members in rows, not its pairs.

Comparing all vectors of a label with all shards is what the method asks; the
work of a label grows with its vectors times its shards.

Only vectors of one dimension are compared, so a label's vectors of each
dimension have shards of their own.

Defined results: vectors that are null, empty, zero, or that hold null or
non-finite numbers link with nothing, as do rows with null label; repeated rows are vectors of their own; a
row without id has no class and is kept; an empty table gives an empty result.
Other columns are not carried along.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ziplore.llm.components import components
from ziplore.operators.joins import join_measured
from ziplore.session import pin

THRESHOLD = 0.93
#: Most vectors of a graph, and of the queries that one task puts to it.
SHARD = 8192
#: Neighbours per node above the ground layer (twice as many there), and the
#: beam while building.
NEIGHBOURS = 12
BUILD_BEAM = 48
#: First beam of searches, queries audited per shard, and the recall asked for.
BEAM = 48
AUDITED = 64
RECALL = 0.995
BATCH = 256


class Graph:
    """Layers of neighbour lists over unit vectors, built in batches."""

    def __init__(self, vectors: np.ndarray, seed: int = 11):
        self.x = vectors.astype(np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n)) / np.log(NEIGHBOURS)).astype(int), 6)
        # The entry is a node of the top layer; it comes first.
        order = np.r_[self.level.argmax(), rng.permutation(n)] if n else np.zeros(0, int)
        order = order[np.sort(np.unique(order, return_index=True)[1])]
        self.links = [
            np.full((n, NEIGHBOURS * (1 if k else 2)), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)
        ]
        self.entry = int(order[0]) if n else -1
        done = 1
        while done < n:
            size = min(BATCH, done, n - done)
            self._insert(order[done : done + size])
            done += size

    @classmethod
    def restored(cls, vectors: np.ndarray, links: list[np.ndarray], entry: int) -> Graph:
        graph = cls.__new__(cls)
        graph.x, graph.links, graph.entry = vectors.astype(np.float32), links, entry
        return graph

    def _insert(self, batch: np.ndarray) -> None:
        q = self.x[batch]
        at = np.full(len(batch), self.entry)
        inside = q @ q.T
        np.fill_diagonal(inside, -np.inf)
        for k in range(len(self.links) - 1, -1, -1):
            joins = self.level[batch] >= k
            ids, sims = self.search_layer(q, at, np.where(joins, BUILD_BEAM, 1).max() if joins.any() else 1, k)
            at = ids[:, 0]
            for i in np.flatnonzero(joins):
                # Nodes of the batch are not in the graph yet, so they are compared directly.
                mates = np.flatnonzero(joins & (inside[i] > -np.inf))
                near = mates[np.argsort(-inside[i][mates])[: NEIGHBOURS]]
                found = ids[i] >= 0
                candidates = np.r_[ids[i][found], batch[near]]
                closeness = np.r_[sims[i][found], inside[i][near]]
                self._connect(int(batch[i]), candidates, closeness, k)

    def _diverse(self, candidates: np.ndarray, closeness: np.ndarray, room: int) -> np.ndarray:
        """Near nodes that are not nearer to each other; then the nearest of the others."""
        order = np.argsort(-closeness, kind="stable")
        candidates, closeness = candidates[order], closeness[order]
        if len(candidates) <= room:
            return candidates
        between = self.x[candidates] @ self.x[candidates].T
        hidden, taken = np.zeros(len(candidates), bool), np.zeros(len(candidates), bool)
        for i in range(len(candidates)):
            if not hidden[i]:
                taken[i] = True
                hidden |= between[i] >= closeness
                if taken.sum() == room:
                    return candidates[taken]
        return np.r_[candidates[taken], candidates[~taken][: room - taken.sum()]]

    def _connect(self, node: int, candidates: np.ndarray, closeness: np.ndarray, k: int) -> None:
        links, room = self.links[k], self.links[k].shape[1]
        kept = self._diverse(candidates, closeness, NEIGHBOURS)
        # Mates of its batch may have linked to the node already.
        earlier = links[node][links[node] >= 0]
        own = np.r_[kept, earlier[~np.isin(earlier, kept)]]
        if len(own) > room:
            own = self._diverse(own, self.x[own] @ self.x[node], room)
        links[node, : len(own)] = own
        for other in kept:
            row = links[other]
            free = np.flatnonzero(row < 0)
            if node in row:
                continue
            if len(free):
                row[free[0]] = node
            else:
                around = np.r_[row, node]
                row[:] = self._diverse(around, self.x[around] @ self.x[other], room)

    def search_layer(self, q: np.ndarray, at: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` nodes of a layer from the starts ``at``, all queries in step; -1 where fewer."""
        n = len(q)
        rows = np.arange(n)
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -np.inf, np.float32)
        spent = np.ones((n, beam), bool)
        ids[:, 0], sims[:, 0], spent[:, 0] = at, np.einsum("bd,bd->b", q, self.x[at]), False
        seen = np.zeros((n, len(self.x)), bool)
        seen[rows, at] = True
        live, width = rows, max(1, beam // 24)
        while len(live):
            waiting = np.where(spent[live], -np.inf, sims[live])
            some = waiting.max(axis=1) > -np.inf
            live, waiting = live[some], waiting[some]
            if not len(live):
                break
            # Wide beams go on from several nodes at once.
            pick = np.argpartition(-waiting, width - 1, axis=1)[:, :width]
            open_ = np.take_along_axis(waiting, pick, 1) > -np.inf
            spent[live[:, None], pick] = True
            around = np.where(open_[:, :, None], self.links[k][ids[live[:, None], pick]], -1).reshape(len(live), -1)
            fresh = (around >= 0) & ~seen[live[:, None], around]
            # A node that two of them lead to counts once.
            order = np.argsort(around, axis=1, kind="stable")
            ranked = np.take_along_axis(around, order, 1)
            again = np.zeros(around.shape, bool)
            np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
            fresh &= ~again
            place = np.nonzero(fresh)
            seen[live[place[0]], around[place]] = True
            near = np.full(around.shape, -np.inf, np.float32)
            near[place] = np.einsum("pd,pd->p", q[live[place[0]]], self.x[around[place]])
            every = np.concatenate([sims[live], near], axis=1)
            best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            sims[live] = np.take_along_axis(every, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], around], axis=1), best, 1)
            spent[live] = np.take_along_axis(np.concatenate([spent[live], ~fresh], axis=1), best, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(sims > -np.inf, ids, -1), sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full(len(q), self.entry)
        for k in range(len(self.links) - 1, 0, -1):
            at = self.search_layer(q, at, 1, k)[0][:, 0]
        return self.search_layer(q, at, min(beam, len(self.x)), 0)


def hits(graph: Graph, vectors: np.ndarray, queries: np.ndarray, threshold: float, beam: int) -> list[np.ndarray]:
    """Per query the nodes at ``threshold`` or nearer; beams full of hits are doubled."""
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
    waiting = np.arange(len(queries))
    # Single precision may miss by rounding, so the beam looks a little further.
    margin = threshold - 1e-5
    while len(waiting):
        beam = min(beam, len(vectors))
        full = []
        step = max(1, min(BATCH, 1_000_000 // beam))
        for at in range(0, len(waiting), step):
            part = waiting[at : at + step]
            ids, sims = graph.search(queries[part].astype(np.float32), beam)
            near = sims >= margin
            over = near.all(axis=1) & (beam < len(vectors))
            full.append(part[over])
            for i in np.flatnonzero(~over):
                close = ids[i][near[i]]
                exact = vectors[close] @ queries[part[i]]
                found[part[i]] = close[exact >= threshold]
        waiting = np.concatenate(full)
        beam *= 2
    return found


def audited_beam(graph: Graph, vectors: np.ndarray, threshold: float) -> int:
    """The least beam, by doubling, at which a sample of the shard's own vectors finds enough of its links."""
    beam = min(BEAM, len(vectors))
    rng = np.random.default_rng(5)
    asked = rng.permutation(len(vectors))[:AUDITED]
    true = vectors[asked] @ vectors.T >= threshold
    while beam < len(vectors):
        got = hits(graph, vectors, vectors[asked], threshold, beam)
        if sum(map(len, got)) >= RECALL * true.sum():
            break
        beam = min(2 * beam, len(vectors))
    return beam


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links with the smallest node they reach by them."""
    nodes, flat = np.unique(np.r_[a, b], return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, u, label[v])
        np.minimum.at(least, v, label[u])
        least = least[least]
        if (least == label).all():
            return nodes, nodes[label]
        label = least


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build(group: pd.DataFrame) -> pd.DataFrame:
    vectors = _unit(group["embedding"])
    graph = Graph(vectors)
    beam = audited_beam(graph, vectors, THRESHOLD)
    held = (group["node"].to_numpy(), group["copies"].to_numpy(), vectors, graph.links, graph.entry, beam)
    return group[["label", "size", "shard"]].iloc[:1].reset_index(drop=True).assign(index=[pickle.dumps(held)])


def _query(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    columns = ["node", "links", "to"]
    if not len(index) or not len(asked):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
    ids, copies, vectors, graph_links, entry, beam = pickle.loads(index["index"].iloc[0])
    graph = Graph.restored(vectors, graph_links, entry)
    nodes = asked["node"].to_numpy()
    found = hits(graph, vectors, _unit(asked["embedding"]), THRESHOLD, beam)
    found = [f[ids[f] != node] for f, node in zip(found, nodes)]
    links = np.array([copies[f].sum() for f in found], np.int64)
    source = np.repeat(nodes, [len(f) for f in found])
    target = ids[np.concatenate(found)] if len(source) else source
    members, least = forest(source, target)
    out = pd.DataFrame({"node": nodes, "links": links, "to": nodes})
    tree = pd.DataFrame({"node": members, "links": 0, "to": least})
    return pd.concat([out[out["links"] > 0], tree[tree["node"] != tree["to"]]])[columns]


def near_duplicate_vectors(vectors: DataFrame) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id`` and ``kept``."""
    rows = pin(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("label").cast("string").alias("label"),
            F.col("embedding").cast("array<double>").alias("embedding"),
        )
    )
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = rows.filter(
        "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0"
    ).filter(finite & F.exists("embedding", lambda v: v != 0))
    hashed = sound.withColumns(
        {"h1": F.xxhash64("embedding"), "h2": F.xxhash64("embedding", F.lit(1)), "size": F.size("embedding")}
    )
    key = ["label", "size", "h1", "h2"]
    nodes = pin(
        hashed.groupBy(*key).agg(
            F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")
        )
    )
    owners = pin(
        join_measured(hashed.select("vec_id", *key), nodes.select(*key, "node", "copies"), key, "vec_id").select(
            "vec_id", "node", "copies"
        )
    )
    shards = nodes.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    dealt = join_measured(nodes, shards, ["label", "size"], "node").withColumn(
        "shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    )
    dealt = pin(dealt.select("label", "size", "shard", "shards", "node", "copies", "embedding"))
    index = pin(
        dealt.groupBy("label", "size", "shard").applyInPandas(_build, "label string, size int, shard int, index binary")
    )
    # Queries go to every shard of their label, dealt into parts like the shards themselves.
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    asked = dealt.select("label", "size", F.col("shard").alias("part"), "node", "embedding", every.alias("shard"))
    served = index.join(shards, ["label", "size"]).select("label", "size", "shard", "index", every.alias("part"))
    keys = ["label", "size", "shard", "part"]
    found = pin(
        served.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInPandas(_query, "node bigint, links bigint, to bigint")
    )
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.filter("node != to"), "node", "to").withColumnRenamed("id", "node")
    known = owners.select("node", "copies").distinct().join(counts, "node", "left").join(labels, "node", "left")
    answered = join_measured(owners.select("vec_id", "node"), known, ["node"], "vec_id").select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    answered = answered.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return rows.select("vec_id").join(answered, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
