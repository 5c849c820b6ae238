"""Approximate nearest neighbours by cosine: a navigable small-world graph per shard, merged results.

Vectors that take part (no null, not zero, all components finite) are first reduced to distinct ones, each with the few
smallest ids that any answer can need, so copies neither crowd the graphs nor fill a task. Distinct vectors are dealt
by hash into shards: as many as the cluster works on at once, of ``shard_rows`` at least and ``shard_bytes`` at most, so
that their number, and with it the cost of a query, grows with memory limits only. A shard's hierarchical graph is built in one task and stored as a row of
flat arrays: the vectors, and per level the neighbours of each node in a matrix with a fixed number of places. All rows
are indexed.

A search sends every query to every shard, as the graphs hold different rows. Index rows and queries are brought
together by shard, the index row first; a task then streams the shard's queries in batches, so its memory is one shard
and one batch however many queries there are. Shard results are scored again from the original components in double
precision and merged by a window that keeps the best ``k`` before its shuffle.

Nulls and edge cases: vectors that take no part neither ask nor are found; vectors of another length than the query
are not found by it; repeated rows (equal id and vector) count once; rows of one id with different vectors ask and are
found each on its own; a query never finds its own id; very small and very large components are scaled by powers of two
before they are squared; ties go to the smaller id; fewer candidates than ``k`` give fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle, table


class Graph:
    """A hierarchical small-world graph over unit vectors, in flat arrays.

    ``near[l]`` is the matrix of neighbours on level l (-1: free) and ``rows[l]`` says which node each of its rows is.
    """

    def __init__(self, vectors: np.ndarray, links: int = 16, breadth: int = 96, seed: int = 7):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(np.int64), 8)
        top = int(self.level.max(initial=0))
        self.rows = [np.flatnonzero(self.level >= k) for k in range(top + 1)]
        self.place = [np.full(n, -1, np.int64) for _ in self.rows]
        for place, rows in zip(self.place, self.rows, strict=True):
            place[rows] = np.arange(len(rows))
        self.width = [2 * links] + [links] * top
        self.near = [np.full((len(r), w), -1, np.int32) for r, w in zip(self.rows, self.width, strict=True)]
        self.used = [np.zeros(len(r), np.int32) for r in self.rows]
        self.links, self.mark, self.turn = links, np.zeros(n, np.int64), 0
        self.entry = -1
        for i in range(n):
            self._insert(i, breadth)

    def _neighbours(self, node: int, level: int) -> np.ndarray:
        at = self.place[level][node]
        return self.near[level][at, : self.used[level][at]]

    def _greedy(self, query: np.ndarray, node: int, high: int, low: int) -> int:
        best = float(self.vectors[node] @ query)
        for level in range(high, low, -1):
            while True:
                around = self._neighbours(node, level)
                if not len(around):
                    break
                score = self.vectors[around] @ query
                k = int(score.argmax())
                if not score[k] > best:
                    break
                best, node = float(score[k]), int(around[k])
        return node

    def _search(self, query: np.ndarray, start: list[int], level: int, breadth: int) -> list[tuple[float, int]]:
        """The best ``breadth`` nodes found on a level, as (similarity, node), best first."""
        self.turn += 1
        turn, mark, vectors, near, place, used = self.turn, self.mark, self.vectors, self.near[level], self.place[level], self.used[level]
        best = [(float(vectors[s] @ query), s) for s in start]
        for s in start:
            mark[s] = turn
        heapq.heapify(best)
        ahead = [(-d, s) for d, s in best]
        heapq.heapify(ahead)
        while ahead:
            d, node = heapq.heappop(ahead)
            if len(best) >= breadth and -d < best[0][0]:
                break
            at = place[node]
            around = near[at, : used[at]]
            around = around[mark[around] != turn]
            if not len(around):
                continue
            mark[around] = turn
            score = vectors[around] @ query
            if len(best) >= breadth:
                good = score > best[0][0]
                around, score = around[good], score[good]
            for s, x in zip(score.tolist(), around.tolist(), strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (s, x))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, x))
                else:
                    continue
                heapq.heappush(ahead, (-s, x))
        return sorted(best, reverse=True)

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions first: a node closer to a chosen one than to the query waits."""
        nodes = np.array([x for _, x in found])
        score = np.array([s for s, _ in found])
        among = self.vectors[nodes] @ self.vectors[nodes].T
        chosen, waiting = [], []
        nearest = np.full(len(nodes), -np.inf)
        for k in range(len(nodes)):
            if nearest[k] < score[k]:
                chosen.append(k)
                np.maximum(nearest, among[k], out=nearest)
                if len(chosen) == most:
                    break
            else:
                waiting.append(k)
        chosen += waiting[: most - len(chosen)]
        return nodes[chosen].tolist()

    def _link(self, a: int, b: int, level: int) -> None:
        at = self.place[level][a]
        n = self.used[level][at]
        if n < self.width[level]:
            self.near[level][at, n] = b
            self.used[level][at] = n + 1
            return
        around = np.r_[self.near[level][at], b]
        score = self.vectors[around] @ self.vectors[a]
        order = np.argsort(-score, kind="stable")
        keep = self._choose([(float(score[k]), int(around[k])) for k in order], self.width[level])
        self.near[level][at, : len(keep)] = keep
        self.used[level][at] = len(keep)

    def _insert(self, i: int, breadth: int) -> None:
        if self.entry < 0:
            self.entry = i
            return
        query, high, own = self.vectors[i], int(self.level[self.entry]), int(self.level[i])
        start = [self._greedy(query, self.entry, high, own)]
        for level in range(min(high, own), -1, -1):
            found = self._search(query, start, level, breadth)
            for x in self._choose(found, self.links):
                self._link(i, x, level)
                self._link(x, i, level)
            start = [x for _, x in found]
        if own > high:
            self.entry = i

    def search(self, query: np.ndarray, k: int, breadth: int) -> list[int]:
        if self.entry < 0:
            return []
        start = self._greedy(query, self.entry, int(self.level[self.entry]), 0)
        return [x for _, x in self._search(query, [start], 0, max(k, breadth))[:k]]

    def flat(self) -> dict:
        return {
            "entry": self.entry,
            "level": self.level.astype(np.int32).tobytes(),
            "near": [m.tobytes() for m in self.near],
            "width": self.width,
        }

    @classmethod
    def load(cls, vectors: np.ndarray, flat: dict, links: int) -> Graph:
        self = cls(vectors[:0], links)
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        self.level = np.frombuffer(flat["level"], np.int32)
        self.entry, self.width, n = flat["entry"], list(flat["width"]), len(vectors)
        self.rows = [np.flatnonzero(self.level >= k) for k in range(len(self.width))]
        self.place = [np.full(n, -1, np.int64) for _ in self.rows]
        for place, rows in zip(self.place, self.rows, strict=True):
            place[rows] = np.arange(len(rows))
        self.near = [np.frombuffer(m, np.int32).reshape(-1, w) for m, w in zip(flat["near"], self.width, strict=True)]
        self.used = [(m >= 0).sum(axis=1) for m in self.near]
        self.mark = np.zeros(n, np.int64)
        return self


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to between a half and one. Exact; squares stay in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_INDEX = "shard int, dim int, entry int, level binary, near array<binary>, width array<int>, vectors binary, ids array<array<long>>"


def _build(links: int, breadth: int):
    def one(shard: int, rows: list[dict]) -> list[dict]:
        out = []
        for dim in sorted({len(r["v"]) for r in rows}):
            own = sorted((r for r in rows if len(r["v"]) == dim), key=lambda r: r["ids"])
            vectors = np.array([r["v"] for r in own], np.float64)
            graph = Graph(_unit(vectors), links, breadth)
            out.append({"shard": shard, "dim": dim, "vectors": vectors.tobytes(), "ids": [r["ids"] for r in own], **graph.flat()})
        return out

    schema = pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("entry", pa.int32()), ("level", pa.binary()), ("near", pa.list_(pa.binary())), ("width", pa.list_(pa.int32())), ("vectors", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != now:
                    if held:
                        yield pa.RecordBatch.from_pylist(one(now, held), schema)
                    now, held = row["shard"], []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist(one(now, held), schema)

    return run


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def build_index(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, shard_rows: int = 6000, shard_bytes: int = 64 << 20, links: int = 16, breadth: int = 96) -> DataFrame:
    """One row of flat arrays per shard (and vector length). Settled: a lost executor costs a re-read, no rebuild."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    # -0.0 and 0.0 are one number; equal vectors keep the k + 1 smallest ids, all that an answer can name
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("h", F.xxhash64("v"))
    first = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))
    few = rows.dropDuplicates(["h", "v", "id"]).withColumn("place", first).filter(F.col("place") <= k + 1)
    distinct = settle(few.groupBy("h", "v").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    n, size = distinct.agg(F.count("*"), F.sum(F.lit(8).cast("long") * F.size("v"))).first()
    at_once = max(1, vectors.sparkSession.sparkContext.defaultParallelism)
    shards = max(1, min(-(-n // shard_rows), at_once), -(-(size or 0) // shard_bytes))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")).select("shard", "v", "ids")
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard")
    return settle(dealt.mapInArrow(_build(links, breadth), _INDEX))


def _search(k: int, links: int, breadth: int):
    schema = pa.schema([("query", pa.int64()), ("vector", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, graphs = None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    shard, graphs = row["shard"], {}
                if row["query"] is None:
                    x = row["index"]
                    vectors = np.frombuffer(x["vectors"], np.float64).reshape(-1, x["dim"])
                    graphs[x["dim"]] = (vectors, Graph.load(_unit(vectors), x, links), x["ids"])
                    continue
                q = np.array(row["v"], np.float64)
                if len(q) not in graphs:
                    continue
                vectors, graph, ids = graphs[len(q)]
                found = graph.search(_unit(q[None])[0].astype(np.float32), breadth, breadth)
                own, q = _scaled(vectors[found]), _scaled(q[None])[0]
                score = (own * q).sum(axis=1) / (np.sqrt((own * own).sum(axis=1)) * np.sqrt((q * q).sum()))
                # own ids are left out before the best are taken, as they may fill the first places
                near = [(-float(s), i) for x, s in zip(found, score, strict=True) for i in ids[x] if i != row["query"]]
                out += [{"query": row["query"], "vector": row["vector"], "vec_id": i, "score": -s} for s, i in sorted(near)[:k]]
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def search(index: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, links: int = 16, breadth: int = 160) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each query, over all shards."""
    ask = queries.select(F.col(vec_id).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("v"))
    ask = ask.filter(F.col("query").isNotNull() & usable(F.col("v"))).distinct().withColumn("vector", F.xxhash64("v"))
    shards = index.agg(F.max("shard")).first()[0]
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards if shards is not None else 0)))
    whole = index.select("shard", F.lit(None).cast("long").alias("query"), F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("long").alias("vector"), F.struct("dim", "entry", "level", "near", "width", "vectors", "ids").alias("index"))
    asked = ask.select(everywhere.alias("shard"), "query", "v", "vector").withColumn("index", F.lit(None).cast(whole.schema["index"].dataType))
    together = whole.unionByName(asked).repartitionById((shards or 0) + 1, "shard").sortWithinPartitions("shard", F.col("query").asc_nulls_first())
    found = together.mapInArrow(_search(k, links, breadth), "query long, vector long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query", "vector").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", best).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int"), "vec_id", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(build_index(rows), rows.filter("vec_id % 50 = 0"))
