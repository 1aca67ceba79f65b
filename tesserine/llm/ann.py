"""Approximate nearest neighbours: a navigable small-world graph per shard.

Equal vectors are one node that keeps the few least ids that a result can need,
so copies of one vector neither crowd a shard nor a neighbourhood.  Nodes are
dealt by hash into shards, of `shard` nodes until there are `most` shards and of
more nodes beyond, so a query goes to `most` shards at most; each shard builds its
graph, whose layers are flat arrays of neighbours, and answers every query; results
of the shards are merged.  Scores are cosines in double precision of the original
vectors.

Defined results: vectors that are null, empty, zero or hold a null or a
non-finite component take no part, neither as queries nor as candidates; only
vectors of equal length are compared; ties go to the smaller id; rows that
repeat an id with the same vector count once; an id with several vectors is
found once, with the nearest of them, and asks with each of its own; an empty table gives an empty
one; with few candidates all are returned.  Only the id and the vector are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


class Graph:
    """Hierarchical navigable small-world graph over unit vectors; layer l holds flat arrays of neighbours."""

    def __init__(self, unit: np.ndarray, links: int = 12, width: int = 64, seed: int = 7) -> None:
        self.x, self.links, self.width = unit, links, width
        n = len(unit)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(int), 12)
        self.near, self.count, self.at = [], [], []
        for layer in range(int(self.level.max(initial=0)) + 1):
            own = np.flatnonzero(self.level >= layer)
            at = np.full(n, -1, np.int32)
            at[own] = np.arange(len(own))
            self.at.append(at)
            self.near.append(np.full((len(own), links * (2 if layer == 0 else 1)), -1, np.int32))
            self.count.append(np.zeros(len(own), np.int32))
        self.seen = np.zeros(n, np.int32)
        self.stamp = 0
        self.entry = -1
        for i in range(n):
            self.insert(i)

    def walk(self, q: np.ndarray, start: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The width nearest nodes found from start, as (similarity, node)."""
        x, near, count, at, seen = self.x, self.near[layer], self.count[layer], self.at[layer], self.seen
        self.stamp += 1
        stamp = self.stamp
        todo, best = [(-s, i) for s, i in start], list(start)
        for _, i in start:
            seen[i] = stamp
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            s, i = heapq.heappop(todo)
            if -s < best[0][0] and len(best) >= width:
                break
            p = at[i]
            them = near[p, : count[p]]
            them = them[seen[them] != stamp]
            if not len(them):
                continue
            seen[them] = stamp
            sims = x[them] @ q
            if len(best) >= width:
                good = sims > best[0][0]
                them, sims = them[good], sims[good]
            for s, j in zip(sims.tolist(), them.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (s, j))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, j))
                else:
                    continue
                heapq.heappush(todo, (-s, j))
        return best

    def choose(self, sims: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """Neighbours nearer to the node than to one already chosen, then the nearest of the rest."""
        order = np.argsort(-sims, kind="stable")
        nodes, sims = nodes[order], sims[order]
        between = self.x[nodes] @ self.x[nodes].T
        taken, free = [], np.ones(len(nodes), bool)
        for k in range(len(nodes)):
            if free[k]:
                taken.append(k)
                if len(taken) == most:
                    break
                free &= between[k] <= sims
        if len(taken) < most:
            taken += [k for k in range(len(nodes)) if k not in set(taken)][: most - len(taken)]
        return nodes[taken]

    def insert(self, i: int) -> None:
        top = int(self.level[i])
        if self.entry < 0:
            self.entry = i
            return
        q, high = self.x[i], int(self.level[self.entry])
        found = [(float(self.x[self.entry] @ q), self.entry)]
        for layer in range(high, top, -1):
            found = [max(self.walk(q, found, 1, layer))]
        for layer in range(min(high, top), -1, -1):
            found = self.walk(q, found, self.width, layer)
            sims, nodes = np.array([s for s, _ in found], np.float32), np.array([j for _, j in found])
            near, count, at = self.near[layer], self.count[layer], self.at[layer]
            mine = self.choose(sims, nodes, self.links)
            near[at[i], : len(mine)] = mine
            count[at[i]] = len(mine)
            for j in mine.tolist():
                p = at[j]
                c = count[p]
                if c < near.shape[1]:
                    near[p, c] = i
                    count[p] = c + 1
                else:
                    them = np.append(near[p], i)
                    kept = self.choose(self.x[them] @ self.x[j], them, near.shape[1])
                    near[p, : len(kept)] = kept
                    count[p] = len(kept)
        if top > high:
            self.entry = i

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        if self.entry < 0:
            return np.zeros(0, np.int64)
        found = [(float(self.x[self.entry] @ q), self.entry)]
        for layer in range(int(self.level[self.entry]), 0, -1):
            found = [max(self.walk(q, found, 1, layer))]
        return np.array([j for _, j in self.walk(q, found, width, 0)])


def sound(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard: int = 4096, most: int = 256, width: int = 128, links: int = 12) -> DataFrame:
    """query_id, rank (from 1), key and score of the k nearest found of every query; is_query is an expression over the key."""
    good = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("e"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(sound(F.col("e")) & F.col("id").isNotNull())
    # the k + 1 least ids of a vector are all that a result can hold; tasks cut their own rows before the shuffle
    order = F.row_number().over(Window.partitionBy("e").orderBy("id"))
    nodes = good.select("id", "e").distinct().withColumn("r", order).filter(F.col("r") <= k + 1).groupBy("e").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = written(nodes, "nodes")
    shards = min(most, max(1, -(-nodes.count() // shard)))
    place = F.pmod(F.xxhash64("e"), F.lit(shards)).cast("int")
    nodes = nodes.select("ids", "e", F.size("e").alias("dim"), place.alias("shard"))
    asked = good.filter("asks").groupBy("e").agg(F.min("id").alias("q"))
    sent = asked.select("q", "e", F.size("e").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def answer(own: pd.DataFrame, them: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(them):
            return pd.DataFrame({"q": [], "id": [], "score": []})
        x, y = np.stack(own["e"].to_numpy()).astype(np.float64), np.stack(them["e"].to_numpy()).astype(np.float64)
        # by ids, so that a rerun builds the same graph
        turn = np.argsort([i[0] for i in own["ids"]])
        x, ids = x[turn], [own["ids"].iloc[t] for t in turn]
        size, length = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        unit = (x / size[:, None]).astype(np.float32)
        graph = Graph(unit, links)
        out = []
        for q, v, n in zip(them["q"], y, length, strict=True):
            found = graph.search((v / n).astype(np.float32), width)
            scores = x[found] @ v / (size[found] * n)
            best: dict[int, float] = {}  # an id counts with the nearest of its vectors
            for s, i in sorted((-s, int(i)) for s, f in zip(scores.tolist(), found.tolist(), strict=True) for i in ids[f]):
                if len(best) > k:
                    break
                best.setdefault(i, -s)
            out += [(q, i, s) for i, s in best.items()]
        return pd.DataFrame(out, columns=["q", "id", "score"])

    hits = nodes.groupBy("dim", "shard").cogroup(sent.groupBy("dim", "shard")).applyInPandas(answer, "q bigint, id bigint, score double")
    top = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    best = hits.groupBy("q", "id").agg(F.max("score").alias("score")).withColumn("r", top).filter(F.col("r") <= k + 1).drop("r")
    # every query of a vector takes its vector's result without itself
    who = good.filter("asks").select("id", "e").distinct().join(asked, "e").select(F.col("id").alias("query_id"), "q")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    found = who.join(best, "q").filter("query_id <> id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
