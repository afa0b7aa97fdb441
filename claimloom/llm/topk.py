"""Exact top-k search by aggregation without random access.

A block of candidates has one sorted list per component, laid down once for all queries that meet the block. For a
query the lists are read side by side, best contributions first. A seen candidate's score lies between
what was read of it plus the worst, or the next, value of the lists it wasn't seen in. Reading goes on until
no candidate but k can reach the k-th best lower bound (ties included); the scores of those are then
resolved. If that needs whole lists, the scores are the sums of what was read. The k-th best score of a
block's earlier parts bounds its later ones, and a window merges the blocks' answers.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

#: Candidates, and queries, that meet in one task at most on average.
BLOCK, QUERY_BLOCK = 8_192, 4_096
#: Candidates of a block whose lists are read together.
PART = 2_048
#: Share of what is left of the lists that is read between two looks at the bounds.
STEP = 1 / 3
#: Whole numbers up to here are exact in double precision.
EXACT = float(1 << 53)


class Lists:
    """Sorted lists of one part of a block: places and values by component, smallest and largest first."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, self.rows, self.x = ids[order], rows[order], x[order].astype(np.int64)
        rising = np.argsort(self.x.T, axis=1, kind="stable")
        value = np.take_along_axis(self.x.T, rising, axis=1).astype(np.float64)
        self.rising, self.falling = (rising, value), (np.ascontiguousarray(rising[:, ::-1]), np.ascontiguousarray(value[:, ::-1]))
        self.largest = float(np.abs(value).max(initial=0))

    def best(self, q: np.ndarray, own: int, k: int, known: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Places and scores of the k best candidates but the row ``own`` (ties to smaller ids), how deep the lists were read and how many candidates were left then.

        ``known`` is a score that k other candidates reach: candidates below it may be left out.
        """
        n, w = len(self.ids), q.astype(np.float64)
        up, down = np.flatnonzero(w > 0), np.flatnonzero(w < 0)
        w = np.concatenate([w[up], w[down]])[:, None]
        read = lambda of, a, z: np.concatenate([self.falling[of][up, a:z], self.rising[of][down, a:z]])
        # sums of doubles are exact below EXACT; beyond that the bounds get a margin
        magnitude = float(np.abs(w).sum()) * self.largest
        margin = 0.0 if magnitude < EXACT else magnitude * 2.0**-40
        worst = read(1, n - 1, n) * w
        lower = np.full(n, worst.sum())
        others = self.rows != own
        seen = np.zeros((n, len(w)), np.float32)
        ahead_of = lambda at: (read(1, at, at + 1) * w).sum()
        # before its next values fall below the bound no list can rule out a row that wasn't seen
        depth = bisect.bisect_left(range(n), True, key=lambda at: bool(ahead_of(at) < known)) if known > -np.inf else n // 2
        at, left = 0, others if not len(w) else None
        while left is None:
            depth = min(n, max(at + 1, depth))
            place = read(0, at, depth)
            lower += np.bincount(place.ravel(), (read(1, at, depth) * w - worst).ravel(), minlength=n)
            at = depth
            kth = known
            if n > k:
                of_others = np.where(others, lower, -np.inf)
                kth = max(kth, np.partition(of_others, n - k)[n - k])
            if at == n:
                left = others & (lower + margin >= kth - margin)
                break
            seen[place, np.arange(len(w))[:, None]] = 1
            slack = (read(1, at, at + 1) * w - worst)[:, 0]
            upper = lower + slack.sum() * (1 + 1e-5) - (seen @ slack.astype(np.float32)).astype(np.float64)
            can = others & (upper + margin >= kth - margin)
            if can.sum() <= k:
                left = can
            depth = at + max(1, int((n - at) * STEP))
        left = np.flatnonzero(left)
        whole = at == n and not margin
        score = lower[left].astype(np.int64) if whole or not len(w) else products(self.x[left], q)
        top = np.lexsort((self.ids[left], -score))[:k]
        return left[top], score[top], at, len(left)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers; those beyond 64 bits become the nearest 64-bit number."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(1, len(q))
    if most < float(1 << 62):
        return x @ q.astype(np.int64)
    exact = [sum(a * b for a, b in zip(row, q.tolist(), strict=True)) for row in x.tolist()]
    return np.array([max(-(1 << 63) + 1, min((1 << 63) - 1, s)) for s in exact], dtype=np.int64)


def best_of(parts: list[Lists], q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best of all parts; what earlier parts hold bounds how deep later ones are read."""
    ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in parts:
        at, theirs, *_ = part.best(q, own, k, float(scores[-1]) if len(scores) >= k else -np.inf)
        ids, scores = np.concatenate([ids, part.ids[at]]), np.concatenate([scores, theirs])
        top = np.lexsort((ids, -scores))[:k]
        ids, scores = ids[top], scores[top]
    return ids, scores


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score of its k best other rows.

    Components become floor(scale * x), x as double; scores are integer inner products (those beyond 64 bits
    become the nearest 64-bit number); ties go to the smaller vec_id. Rows with a null id, a null vector or null or non-finite components
    take no part; a query meets the vectors of its own length. Every row is a query or candidate of its own, so of
    rows that repeat a query's id each has its answers, and they find each other. No candidate: no row. Other columns are ignored.
    """
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    v = v.select(F.monotonically_increasing_id().alias("n"), "vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("x"), F.size("embedding").alias("dim"))
    v = materialize(v, "topk-vectors")
    is_query = F.col("vec_id") % every == 0
    count = v.agg(F.count("*").alias("all"), F.count_if(is_query).alias("queries")).head()
    blocks = max(1, -(-count["all"] // block))
    # as many tasks as the cluster runs at once, if there are so many queries
    wanted = -(-2 * v.sparkSession.sparkContext.defaultParallelism // blocks)
    query_blocks = max(1, -(-count["queries"] // query_block), min(wanted, count["queries"] // 64))
    deal = lambda salt, parts: F.pmod(F.xxhash64(F.lit(salt), "n"), F.lit(parts)).cast("int")
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    queries = v.filter(is_query).withColumn("qb", deal("q", query_blocks)).withColumn("cb", spread(blocks))
    rows = v.withColumn("cb", deal("c", blocks)).withColumn("qb", spread(query_blocks))
    columns = {"n": "int64", "query_id": "int64", "vec_id": "int64", "score": "int64"}

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            x, ids, n = np.stack(c["x"].to_numpy()), c["vec_id"].to_numpy(), c["n"].to_numpy()
            parts = [Lists(ids[a : a + PART], n[a : a + PART], x[a : a + PART]) for a in range(0, len(c), PART)]
            for row, qid, x in q[["n", "vec_id", "x"]].itertuples(index=False):
                ids, scores = best_of(parts, np.asarray(x), row, k)
                out.append(pd.DataFrame({"n": np.full(len(ids), row), "query_id": np.full(len(ids), qid), "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame(columns=list(columns)).astype(columns)

    keys = ["qb", "cb", "dim"]
    found = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(search, "n long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
