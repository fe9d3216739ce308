"""Hierarchical navigable small-world graphs, one per shard of bounded size.

Rows are dealt to shards by a hash of the vid; each shard's graph is built by one
task and kept as rows (shard, vid, level, vec or code, neighbours by level). A
search walks every shard's graph (or, for many queries, scans its rows) with the
queries sent along and merges the shards' lists. Levels come from a hash of the vid,
so the same rows give the same graph.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.operators import search as S
from vecloom.operators.filters import Filter, matching
from vecloom.operators.kmeans import training_sample
from vecloom.operators.quantize import ProductQuantizer, ScalarQuantizer
from vecloom.plans.config import IndexConfig, IndexType, InvalidParameter

#: Rows that a shard should hold; the number of shards follows from the row count.
SHARD_ROWS = 20_000
#: Links beyond the limit that a node may gather before its list is cut.
SLACK = 8
#: Share of matching rows of a shard below which a filtered search scans them instead of walking.
FEW = 0.25
#: Queries of a set from which a shard is scanned by matrix products, which takes less time than so many walks.
SCANNED = 1000
_GRAPH = "shard int, vid long, level int, vec array<float>, code binary, neighbors array<array<long>>"


def level_column(m: int, seed: int = 42) -> Column:
    """floor(-ln(u) / ln(m)), u from a hash of the vid."""
    u = (F.pmod(F.xxhash64("vid", F.lit(seed)), F.lit(65536)) + 1) / 65537.0
    return F.floor(-F.ln(u) / math.log(m)).cast("int")


class Graph:
    """One shard in memory."""

    def __init__(self, x: np.ndarray, metric: str, m: int):
        self.x, self.metric, self.m = np.asarray(x, np.float64), metric, m
        self.edges: list[list[list[int]]] = []
        self.entry, self.top = -1, -1
        self.norm = np.sqrt((self.x * self.x).sum(axis=1)) if len(self.x) else np.zeros(0)

    def near(self, q: np.ndarray, rows: list[int]) -> np.ndarray:
        x = self.x[rows]
        if self.metric == "l2":
            d = x - q
            return (d * d).sum(axis=1)
        if self.metric == "ip":
            return -(x @ q)
        if self.metric == "cosine":
            n = self.norm[rows] * math.sqrt(float(q @ q))
            return np.where(n < 1e-12, 1.0, 1 - (x @ q) / np.where(n < 1e-12, 1.0, n))
        return S.distances(self.metric, q[None], x)[0]

    def beam(self, q: np.ndarray, start: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef best that a best-first walk of one level reaches, nearest first."""
        seen = {i for _, i in start}
        todo = list(start)
        heapq.heapify(todo)
        best = [(-d, -i) for d, i in start]
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            fresh = [j for j in self.edges[i][level] if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for e, j in zip(self.near(q, fresh).tolist(), fresh, strict=True):
                if len(best) < ef or e < -best[0][0]:
                    heapq.heappush(todo, (e, j))
                    heapq.heappush(best, (-e, -j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, -i) for d, i in best)

    def spread(self, rows: list[int], near: np.ndarray, most: int) -> list[int]:
        """Up to `most` of the rows (nearest first): those that are nearer to the node than to any kept one, then the nearest others."""
        if len(rows) <= most:
            return rows
        x = self.x[rows]
        if self.metric == "l2":
            own = (x * x).sum(axis=1)
            between = own[:, None] + own[None, :] - 2 * (x @ x.T)
        elif self.metric == "ip":
            between = -(x @ x.T)
        elif self.metric == "cosine":
            unit = x / np.maximum(self.norm[rows], 1e-12)[:, None]
            between = 1 - unit @ unit.T
        else:
            between = S.distances(self.metric, x, x)
        shadowed, kept = np.zeros(len(rows), bool), []
        for i in range(len(rows)):
            if not shadowed[i]:
                kept.append(i)
                if len(kept) == most:
                    break
                shadowed |= between[i] < near
        others = [i for i in range(len(rows)) if i not in set(kept)][: most - len(kept)]
        return [rows[i] for i in kept + others]

    def trim(self) -> None:
        """Cuts the lists that hold more links than the limit."""
        for i, levels in enumerate(self.edges):
            for at, theirs in enumerate(levels):
                most = 2 * self.m if at == 0 else self.m
                if len(theirs) > most:
                    d = self.near(self.x[i], theirs)
                    order = np.argsort(d, kind="stable")
                    levels[at] = self.spread([theirs[o] for o in order], d[order], most)

    def connect(self) -> None:
        """Links every node that no walk of the lowest level reaches to the nearest one that is reached."""
        reached = np.zeros(len(self.edges), bool)

        def walk(i: int) -> None:
            todo = [i]
            reached[i] = True
            while todo:
                for j in self.edges[todo.pop()][0]:
                    if not reached[j]:
                        reached[j] = True
                        todo.append(j)

        if self.entry >= 0:
            walk(self.entry)
        for i in np.flatnonzero(~reached).tolist():
            if not reached[i]:
                known = np.flatnonzero(reached)
                nearest = int(known[np.argmin(self.near(self.x[i], known))])
                self.edges[nearest][0].append(i)
                self.edges[i][0].append(nearest)
                walk(i)

    def insert(self, i: int, level: int, ef: int) -> None:
        self.edges.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry, self.top = i, level
            return
        q = self.x[i]
        start = [(float(self.near(q, [self.entry])[0]), self.entry)]
        for at in range(self.top, level, -1):
            start = self.beam(q, start, 1, at)[:1]
        for at in range(min(level, self.top), -1, -1):
            start = self.beam(q, start, ef, at)
            most = 2 * self.m if at == 0 else self.m
            self.edges[i][at] = self.spread([j for _, j in start], np.array([d for d, _ in start]), most)
            for j in self.edges[i][at]:
                theirs = self.edges[j][at]
                theirs.append(i)
                if len(theirs) > most + SLACK:
                    d = self.near(self.x[j], theirs)
                    order = np.argsort(d, kind="stable")
                    self.edges[j][at] = self.spread([theirs[o] for o in order], d[order], most)
        if level > self.top:
            self.entry, self.top = i, level

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0 or k < 1:
            return []
        start = [(float(self.near(q, [self.entry])[0]), self.entry)]
        for at in range(self.top, 0, -1):
            start = self.beam(q, start, 1, at)[:1]
        return self.beam(q, start, max(ef, k), 0)[:k]


@dataclass
class HnswIndex:
    graph: DataFrame
    metric: str
    config: IndexConfig
    dim: int
    quantizer: ScalarQuantizer | ProductQuantizer | None = None
    rows: DataFrame | None = None  # the indexed rows, whose metadata filters need

    @classmethod
    def build(cls, rows: DataFrame, config: IndexConfig, metric: str = "l2") -> HnswIndex:
        metric = str(getattr(metric, "value", metric))
        sample = training_sample(rows)
        quantizer = None
        if config.type is IndexType.HNSW_SQ:
            quantizer = ScalarQuantizer.train(rows)
        elif config.type is IndexType.HNSW_PQ:
            quantizer = ProductQuantizer.train(sample, config.nsub, config.nbits, metric)
        shards = max(config.shards, math.ceil(rows.count() / SHARD_ROWS))
        dim, m, ef = sample.shape[1], config.m, config.ef_construction
        whole = isinstance(quantizer, ProductQuantizer)  # product codes are too coarse to link and rank by

        def build(batches):
            batches = [b for b in batches if b.num_rows]
            if not batches:
                return
            table = pa.Table.from_batches(batches).sort_by("vid")
            shard = table.column("shard")[0].as_py()
            at, x = S.matrix(table.column("vec"), dim)
            vid, level = table.column("vid").to_numpy()[at], table.column("level").to_numpy()[at]
            codes = None if quantizer is None else quantizer.encode(x)
            g = Graph(x if quantizer is None or whole else quantizer.decode(codes), metric, m)
            for i in range(len(at)):
                g.insert(i, int(level[i]), ef)
            g.trim()
            g.connect()
            out = {
                "shard": pa.array(np.full(len(at), shard, np.int32)), "vid": pa.array(vid), "level": pa.array(level.astype(np.int32)),
                "vec": table.column("vec").combine_chunks().take(pa.array(at)) if quantizer is None or whole else pa.nulls(len(at), pa.list_(pa.float32())),
                "code": pa.nulls(len(at), pa.binary()) if quantizer is None else pa.array([c.tobytes() for c in codes], pa.binary()),
                "neighbors": pa.array([[[int(vid[j]) for j in e] for e in edges] for edges in g.edges], pa.list_(pa.list_(pa.int64()))),
            }
            yield from pa.table(out).to_batches()

        dealt = rows.select("vid", "vec").filter("vid is not null and vec is not null")
        dealt = dealt.withColumn("level", level_column(m, config.seed)).withColumn("shard", F.pmod(F.xxhash64("vid"), F.lit(shards)).cast("int"))
        dealt = dealt.repartitionById(shards, F.col("shard"))  # a task for each shard
        return cls(dealt.mapInArrow(build, _GRAPH), metric, config, dim, quantizer, rows)

    def search(self, queries: DataFrame, k: int = 10, ef: int | None = None, where: Filter | Column | None = None) -> DataFrame:
        """Approximate top-k. With a filter, walks cross all nodes and keep matching ones, from a beam widened by
        their share; shards where few match, or too few are met, scan the matching ones. Shards are scanned as well
        for sets of many queries, if their metric has a product."""
        graph = self.graph.withColumn("ok", F.lit(True))
        if where is not None:
            if self.rows is None:
                raise InvalidParameter("a filtered search needs the indexed rows")
            hits = matching(self.rows, where).select("vid").distinct().withColumn("ok", F.lit(True))
            graph = self.graph.join(hits.hint("merge"), "vid", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        found = [graph.groupBy("shard").applyInArrow(self._walk(qid, q, k, ef), S._FOUND) for qid, q in S.packed_queries(queries, self.dim)]
        return S._ranked(reduce(DataFrame.union, found), self.metric, k)

    def _walk(self, qid: np.ndarray, q: np.ndarray, k: int, ef: int | None):
        metric, quantizer, ef = self.metric, self.quantizer, ef or self.config.ef_search
        dim, m = self.dim, self.config.m
        scanned = metric in ("l2", "ip", "cosine") and len(qid) >= SCANNED and 0 < k <= S.FEW and len(qid) * k <= S.HELD

        def walk(shard):
            shard = shard.sort_by("vid")
            vid = shard.column("vid").to_numpy()
            if quantizer is None:
                _, x = S.matrix(shard.column("vec"), dim)
            else:
                x = quantizer.decode(np.frombuffer(b"".join(shard.column("code").to_pylist()), np.uint8).reshape(len(vid), -1))
            exact, wide = x, k
            if isinstance(quantizer, ProductQuantizer) and shard.column("vec").null_count == 0:  # graphs of before have none
                exact, wide = S.matrix(shard.column("vec"), dim)[1], max(S.WIDE, S.WIDER * k) if k > 0 else k
            ok = shard.column("ok").to_numpy()
            matches = np.flatnonzero(ok)
            if scanned:
                held = S.Nearest(metric, q, k)
                held.add(vid[matches], exact[matches])
                return pa.Table.from_batches([held.found(qid)])
            g = Graph(x, metric, m)
            place = {int(v): i for i, v in enumerate(vid)}
            g.edges = [[[place[j] for j in level if j in place] for level in node] for node in shard.column("neighbors").to_pylist()]
            levels = shard.column("level").to_numpy()
            g.top = int(levels.max())
            g.entry = int(np.flatnonzero(levels == g.top)[0])
            ids, near = [], []
            share = len(matches) / len(ok)
            for query, vec in zip(qid, q.astype(np.float64), strict=True):
                rows = matches
                if share == 1:
                    rows = np.array([i for _, i in g.search(vec, wide, ef)], np.int64)
                elif share >= FEW:
                    rows = np.array([i for _, i in g.search(vec, math.ceil(wide / share), math.ceil(ef / share)) if ok[i]], np.int64)
                    rows = matches if len(rows) < min(k, len(matches)) else rows
                if wide > k or share < 1:
                    rows = rows[S._best(S.distances(metric, vec[None], exact[rows])[0], vid[rows], k)]
                ids.append((np.full(len(rows), query), vid[rows]))
                near.append(S.distances(metric, vec[None], exact[rows])[0])
            return pa.table({"query_id": pa.array(np.concatenate([a for a, _ in ids] or [np.zeros(0, np.int64)])), "vid": pa.array(np.concatenate([b for _, b in ids] or [np.zeros(0, np.int64)])), "distance": pa.array(np.concatenate(near or [np.zeros(0)]))})

        return walk

    def remove(self, vids: DataFrame) -> HnswIndex:
        """Without the nodes; links to them are skipped by searches."""
        return replace(self, graph=self.graph.join(vids.select("vid"), "vid", "left_anti"))

    def neighbors(self, vid: int, level: int = 0) -> DataFrame:
        return self.graph.filter(F.col("vid") == vid).select("vid", F.explode(F.coalesce(F.get("neighbors", F.lit(level)), F.array().cast("array<long>"))).alias("neighbor"))

    def max_level(self) -> int:
        return self.graph.agg(F.max("level")).first()[0]

    def entry_points(self) -> DataFrame:
        """shard, vid: where walks start."""
        return self.graph.groupBy("shard").agg(F.min_by("vid", F.struct(-F.col("level"), "vid")).alias("vid"))
