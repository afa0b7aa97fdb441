"""Embedding near-dedup by hierarchical navigable small-world graphs, one per shard.

Equal vectors of a label are one class from the start. The classes of a label are dealt to
shards of bounded size by a digest; each shard gets a layered graph. An audit compares searches for
members, and for vectors just within the threshold of members, with a scan of the shard,
and doubles the beam until recall suffices. Every vector then searches every shard of
its label; where a whole beam is within the threshold the shard is scanned for that query. Links are
verified by cosine in double precision. Links are counted where they are found, and each task passes on
a spanning forest of its links only, so a group of near copies never becomes all its pairs.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .probminhash import mix
from .joins import salted_join
from .store import materialize, release

#: Neighbours of a node above and on the ground layer, beam while building and first beam of searches.
M, M0, BUILD_BEAM, BEAM = 12, 24, 48, 32
#: Vectors of a shard, and of a block of queries, on average at most; shards of a label at least.
SHARD, BLOCK, LEAST_SHARDS = 16_384, 16_384, 2
AUDITS, RECALL = 48, 0.97
#: Links found at once before they are turned to a forest.
LINKS = 2_000_000


class Graph:
    """A layered graph over unit vectors; layer 0 holds all of them."""

    def __init__(self, unit: np.ndarray, seeds: np.ndarray):
        self.v = unit.astype(np.float32)
        u = ((mix(seeds.astype(np.uint64) + np.uint64(77)) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
        level = np.minimum((-np.log(u) / np.log(M)).astype(int), 6)
        order = np.argsort(mix(seeds.astype(np.uint64) + np.uint64(5)), kind="stable")
        self.near = [np.full((len(seeds), M0 if layer == 0 else M), -1, np.int32) for layer in range(level.max(initial=0) + 1)]
        self.entry, self.top = int(order[0]), int(level[order[0]])
        a, size = 1, 1
        while a < len(order):
            self.insert(order[a : a + size], level)
            a += size
            size = min(2 * size, 256)

    def insert(self, batch: np.ndarray, level: np.ndarray) -> None:
        q = self.v[batch]
        at = np.full((len(batch), 1), self.entry)
        among = q @ q.T
        np.fill_diagonal(among, -2)
        for layer in range(max(self.top, int(level[batch].max())), -1, -1):
            mine = level[batch] >= layer
            if layer > self.top:
                ids, sims = np.full((len(batch), 1), -1), np.full((len(batch), 1), -2.0, np.float32)
            else:
                ids, sims = self.beam(q, at, layer, BUILD_BEAM if mine.any() else 1)
                at = ids[:, : max(1, BUILD_BEAM // 4)]
            if mine.any():
                peers = np.where(mine[None, :] & mine[:, None], among, -2)
                k = min(M, len(batch))
                top = np.argpartition(-peers, k - 1, axis=1)[:, :k]
                psim = np.take_along_axis(peers, top, axis=1)
                cand = np.concatenate([ids, np.where(psim > -2, batch[top], -1)], axis=1)
                csim = np.concatenate([np.where(ids >= 0, sims, -2), psim], axis=1)
                self.connect(batch[mine], cand[mine], csim[mine], layer)
        tallest = int(np.argmax(level[batch]))
        if level[batch[tallest]] > self.top:
            self.entry, self.top = int(batch[tallest]), int(level[batch[tallest]])

    def choose(self, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` candidates of each row, those first that are nearer to the node than to any chosen one."""
        order = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sims, order, axis=1)
        w = self.v[cand]
        gram = np.matmul(w, w.transpose(0, 2, 1))
        chosen = np.zeros(cand.shape, bool)
        for c in range(cand.shape[1]):
            close = (chosen & (gram[:, c, :] > sims[:, c, None])).any(axis=1)
            chosen[:, c] = (sims[:, c] > -2) & ~close & (chosen.sum(axis=1) < most)
        rank = np.where(chosen, 0, 1) + np.where(sims > -2, 0, 2)
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(sims, order, axis=1) > -2, np.take_along_axis(cand, order, axis=1), -1)

    def connect(self, nodes: np.ndarray, cand: np.ndarray, sims: np.ndarray, layer: int) -> None:
        near = self.near[layer]
        picked = self.choose(cand, sims, M)
        near[nodes, : picked.shape[1]] = picked
        back_to, back = picked.ravel(), np.repeat(nodes, picked.shape[1])
        keep = back_to >= 0
        back_to, back = back_to[keep], back[keep]
        order = np.argsort(back_to, kind="stable")
        targets, begin = np.unique(back_to[order], return_index=True)
        back = back[order]
        counts = np.diff(np.append(begin, len(back)))
        wide = np.full((len(targets), counts.max(initial=0)), -1, np.int32)
        wide[np.repeat(np.arange(len(targets)), counts), np.arange(len(back)) - np.repeat(begin, counts)] = back
        for a in range(0, len(targets), 256):
            t = targets[a : a + 256]
            both = np.sort(np.concatenate([near[t], wide[a : a + 256]], axis=1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1  # peers of one batch may name each other
            s = np.where(both >= 0, np.einsum("ncd,nd->nc", self.v[both], self.v[t]), -2)
            near[t] = self.pad(self.choose(both, s, near.shape[1]), near.shape[1])

    @staticmethod
    def pad(x: np.ndarray, width: int) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=-1)

    def beam(self, q: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best nodes that a beam search of each query reaches in a layer, best first; all queries step together."""
        near, n = self.near[layer], len(q)
        seen = np.zeros((n, len(self.v)), bool)
        ids = np.full((n, width), -1, np.int32)
        sims = np.full((n, width), -2, np.float32)
        done = np.ones((n, width), bool)
        live, fresh = np.arange(n), start
        while len(live):
            rows = live[:, None]
            good = fresh >= 0
            good &= ~seen[rows, np.maximum(fresh, 0)]
            r, c = np.nonzero(good)
            seen[live[r], fresh[r, c]] = True
            s = np.full(fresh.shape, -2, np.float32)
            s[r, c] = np.einsum("nd,nd->n", self.v[fresh[r, c]], q[live[r]])
            all_s = np.concatenate([sims[live], s], axis=1)
            order = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
            sims[live] = np.take_along_axis(all_s, order, axis=1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(good, fresh, -1)], axis=1), order, axis=1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~good], axis=1), order, axis=1)
            todo = np.where(done[live], -3, sims[live])
            best = todo.argmax(axis=1)
            on = todo[np.arange(len(live)), best] > -2
            live, best = live[on], best[on]
            done[live, best] = True
            fresh = near[ids[live, best]]
        return ids, sims

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full((len(q), 1), self.entry)
        for layer in range(self.top, 0, -1):
            at = self.beam(q, at, layer, 4)[0]
        return self.beam(q, at, 0, width)

    def audit_sample(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """``AUDITS`` members whose links can't fill the first beam and ``AUDITS`` whose links can, fewer where the shard has fewer.

        Members without a link to another tell nothing and are passed over; more are drawn until both are found or all are drawn.
        """
        order = np.random.default_rng(len(self.v)).permutation(len(self.v))
        sparse, dense = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a in range(0, len(order), 512):
            part = order[a : a + 512]
            others = (self.v[part] @ self.v.T >= threshold).sum(axis=1) - 1
            sparse = np.concatenate([sparse, part[(others > 0) & (others < BEAM)]])
            dense = np.concatenate([dense, part[others >= BEAM]])
            if len(sparse) >= AUDITS and len(dense) >= AUDITS:
                break
        return sparse[:AUDITS], dense[:AUDITS]

    def audited_width(self, threshold: float) -> int:
        """The first beam, doubled until audits find what a scan finds; the whole shard at last.

        Sparse members, dense members and vectors beside members have to reach ``RECALL`` each, as the mean
        over queries of the share of their links that is found; a member's hit on itself doesn't count.
        """
        rng = np.random.default_rng(len(self.v))
        member = self.v[rng.choice(len(self.v), min(AUDITS, len(self.v)), replace=False)]
        noise = rng.normal(size=member.shape)
        noise -= (noise * member).sum(axis=1, keepdims=True) * member
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-9)
        c = threshold + (1 - threshold) / 10
        beside = (c * member + np.sqrt(1 - c * c) * noise).astype(np.float32)
        audits = [(self.v[m], m[:, None]) for m in self.audit_sample(threshold)] + [(beside, np.full((len(beside), 1), -1))]
        width = BEAM
        while width < len(self.v):
            if all(self.recall(q, own, threshold, width) >= RECALL for q, own in audits):
                return width
            width *= 2
        return len(self.v)

    def recall(self, q: np.ndarray, own: np.ndarray, threshold: float, width: int) -> float:
        """Mean share of the links of ``q`` that a beam finds, without the node ``own`` of each; 1 if none has a link."""
        if not len(q):
            return 1.0
        true = ((q @ self.v.T >= threshold) & (np.arange(len(self.v)) != own)).sum(axis=1)
        ids, sims = self.search(q, width)
        full = sims[:, -1] >= threshold  # such queries scan the shard
        found = ((sims >= threshold) & (ids >= 0) & (ids != own)).sum(axis=1)
        some = true > 0
        return float(np.where(full, 1, np.minimum(found / np.maximum(true, 1), 1))[some].mean()) if some.any() else 1.0


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each id on a link to the smallest id that these links reach."""
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    least = np.arange(len(ids))
    while True:
        m = np.minimum(least[x], least[y])
        new = least.copy()
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        new = new[new]
        if (new == least).all():
            return ids, ids[least]
        least = new


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links_of(queries: pd.DataFrame, shard: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Link counts of the queries in one shard, and a spanning forest of those links."""
    columns = {"id": "int64", "other": "Int64", "n": "int64"}
    if queries.empty or shard.empty:
        return pd.DataFrame(columns=list(columns)).astype(columns)
    graph, ids, copies, exact, width = pickle.loads(shard["graph"].iloc[0])
    qid = queries["id"].to_numpy()
    q = unit(np.stack(queries["embedding"].to_numpy()).astype(np.float64))
    counts = np.zeros(len(q), np.int64)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def note(rows: np.ndarray, members: np.ndarray) -> None:
        cos = np.einsum("nd,nd->n", q[rows], exact[members])
        good = (cos >= threshold) & (qid[rows] != ids[members])
        np.add.at(counts, rows[good], copies[members[good]])
        held.append((qid[rows[good]], ids[members[good]]))
        if sum(len(h[0]) for h in held) > LINKS:
            fold()

    def fold() -> None:
        if held and sum(len(h[0]) for h in held):
            ends.append(forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])))
        held.clear()

    for a in range(0, len(q), 512):
        part = np.arange(a, min(a + 512, len(q)))
        if width < len(ids):
            found, sims = graph.search(q[part].astype(np.float32), width)
            hit = (found >= 0) & (sims >= threshold - 1e-4)
            full = hit.all(axis=1)
            r, c = np.nonzero(hit & ~full[:, None])
            note(part[r], found[r, c])
            part = part[full]
        for s in range(0, len(part), 128):
            p = part[s : s + 128]
            r, c = np.nonzero(q[p] @ exact.T >= threshold - 1e-9)
            note(p[r], c)
    fold()
    x = np.concatenate([e[0] for e in ends]) if ends else np.zeros(0, np.int64)
    y = np.concatenate([e[1] for e in ends]) if ends else np.zeros(0, np.int64)
    some = counts > 0
    return pd.concat([
        pd.DataFrame({"id": qid[some], "other": pd.array([pd.NA] * int(some.sum()), "Int64"), "n": counts[some]}),
        pd.DataFrame({"id": x[x != y], "other": pd.array(y[x != y], "Int64"), "n": np.zeros(int((x != y).sum()), np.int64)}),
    ]).astype(columns)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows with a null label or id, a null or empty vector, a zero vector or null or non-finite components
    link with nothing; vectors link only with those of equal label and length. Rows that
    repeat an id are vectors of their own, each counted and linked by itself; ``component_id`` is the smallest id among all vectors that
    links reach, and ``kept`` holds for every row of that id. Other columns are ignored.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    ok = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & fine, F.lit(False))
    v = v.withColumn("h", F.when(ok, F.xxhash64("label", "embedding")))
    # equal vectors of a label are one class; its number is what graphs, links and components know it by
    classes = materialize(
        v.filter("h is not null").groupBy("h", "label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("embedding")).withColumn("id", F.monotonically_increasing_id()), "hnsw-classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).select(
        "label", "dim", F.greatest(F.lit(LEAST_SHARDS), F.ceil(F.col("n") / shard)).cast("int").alias("shards"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = classes.join(F.broadcast(sizes) if sizes.limit(10_001).count() <= 10_000 else sizes, ["label", "dim"])
    members = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "h"), F.col("shards")).cast("int"))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "id"])
        exact = unit(np.stack(rows["embedding"].to_numpy()).astype(np.float64))
        graph = Graph(exact, rows["h"].to_numpy())
        packed = pickle.dumps((graph, rows["id"].to_numpy(), rows["copies"].to_numpy(), exact, graph.audited_width(threshold)))
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "blocks": [int(rows["blocks"].iloc[0])], "graph": [packed]})

    label = vectors.schema["label"].dataType.simpleString()
    graphs = materialize(members.groupBy("label", "dim", "shard").applyInPandas(build, f"label {label}, dim int, shard int, blocks int, graph binary"), "hnsw-graphs")
    each_block = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each_shard = (
        dealt.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "h"), F.col("blocks")).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("label", "dim", "shard", "block", "id", "embedding")
    )
    keys = ["label", "dim", "shard", "block"]
    found = each_shard.groupBy(*keys).cogroup(each_block.select(*keys, "graph").groupBy(*keys)).applyInPandas(lambda q, s: links_of(q, s, threshold), "id long, other long, n long")
    found = materialize(found, "hnsw-links")
    release(graphs)
    n = found.groupBy("id").agg(F.sum("n").alias("n"))
    comp = materialize(components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))), "hnsw-components")
    least = comp.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("component_id"))
    linked = salted_join(comp, least, ["component"], F.xxhash64("id")).select("id", "component_id")
    named = (
        classes.join(n, "id", "left").join(linked, "id", "left")
        .select("h", "label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component_id", "least").alias("component_id"))
    )
    of_class = classes.select("h", "label", "embedding", F.col("copies").alias("n"))
    out = salted_join(v, named, ["h", "label", "embedding"], F.xxhash64("vec_id"), "left", of_class, of_class.agg(F.sum("n")).head()[0] or 0)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
