"""Approximate nearest neighbours by inner product: one navigable small-world graph per shard.

Equal vectors are one point of the index, with the smallest ids that have it. Points are dealt to shards by a hash;
each shard is one row of a table that holds its vectors, a hierarchical graph as flat neighbour arrays, and the ids.
Inner products become distances by one more component that brings all vectors to the length of the longest, so the
nearest point has the largest product. Blocks of queries go to every shard, whose graph moves once for several of them,
and the shards' results are merged.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonara.llm.common import mixed, stage

#: Vectors of a shard, about.
SHARD_ROWS = 8192
#: Queries that travel to a shard together.
BLOCK_QUERIES = 8192
#: Blocks of queries that one task asks of a shard; the shard's graph moves once for so many.
TASK_BLOCKS = 8
#: Links of a point on the upper levels; twice as many on the lowest.
LINKS = 16
BUILD_WIDTH = 80
SEARCH_WIDTH = 256

SHARD = "shard int, size int, entry int, levels binary, links binary, upper binary, vectors binary, ids binary, id_counts binary"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of rows with an id whose vector is not null, empty or zero and has only finite components."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(F.coalesce(fine, F.lit(False)))
    return rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))


def _points(k: int):
    """Per batch, the distinct vectors and their k smallest ids."""

    def run(batches):
        for pdf in batches:
            found: dict[bytes, list[int]] = {}
            for vec_id, v in zip(pdf["vec_id"], pdf["embedding"]):
                found.setdefault(np.asarray(v, np.float64).tobytes(), []).append(vec_id)
            yield pd.DataFrame({"vector": list(found), "ids": [sorted(set(i))[:k] for i in found.values()]})

    return run


class Graph:
    """Hierarchical navigable small world over the rows of ``x``, larger inner product being nearer."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, links: np.ndarray, upper: list[np.ndarray], entry: int):
        self.x, self.levels, self.links, self.upper, self.entry = x, levels, links, upper, entry

    def neighbours(self, node: int, level: int) -> np.ndarray:
        row = self.links[node] if level == 0 else self.upper[level - 1][node]
        return row[row >= 0]

    def nearest_on(self, q: np.ndarray, start: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` nearest points found on a level, as (similarity, node), nearest first."""
        seen = {node for _, node in start}
        frontier = [(-s, node) for s, node in start]
        heapq.heapify(frontier)
        best = list(start)
        heapq.heapify(best)
        rows = self.links if level == 0 else self.upper[level - 1]
        while frontier:
            s, node = heapq.heappop(frontier)
            if len(best) >= width and -s < best[0][0]:
                break
            new = [n for n in rows[node].tolist() if n >= 0 and n not in seen]
            if not new:
                continue
            seen.update(new)
            for t, n in zip((self.x[new] @ q).tolist(), new):
                if len(best) < width:
                    heapq.heappush(best, (t, n))
                    heapq.heappush(frontier, (-t, n))
                elif t > best[0][0]:
                    heapq.heapreplace(best, (t, n))
                    heapq.heappush(frontier, (-t, n))
        return sorted(best, reverse=True)

    def search(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        at = [(float(self.x[self.entry] @ q), self.entry)]
        for level in range(int(self.levels[self.entry]), 0, -1):
            at = self.nearest_on(q, at, 1, level)
        return self.nearest_on(q, at, width, 0)

    def _chosen(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Nearest first, passing over points that are nearer to one already chosen; then the nearest of the rest."""
        nodes = [n for _, n in found]
        if len(nodes) <= most:
            return nodes
        among = self.x[nodes] @ self.x[nodes].T
        chosen, rest = [], []
        for i, (s, _) in enumerate(found):
            if len(chosen) == most:
                break
            (rest if chosen and among[i, chosen].max() > s else chosen).append(i)
        return [nodes[i] for i in (chosen + rest)[:most]]

    @classmethod
    def build(cls, x: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH) -> Graph:
        n = len(x)
        draw = (mixed(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
        levels = np.floor(-np.log(draw.clip(1e-300)) / math.log(links)).astype(np.int32)
        top = int(levels.max())
        graph = cls(x, levels, np.full((n, 2 * links), -1, np.int32), [np.full((n, links), -1, np.int32) for _ in range(top)], 0)
        for node in range(1, n):
            graph._insert(node, links, width)
        return graph

    def _insert(self, node: int, links: int, width: int) -> None:
        q, mine = self.x[node], int(self.levels[node])
        at = [(float(self.x[self.entry] @ q), self.entry)]
        highest = int(self.levels[self.entry])
        for level in range(highest, mine, -1):
            at = self.nearest_on(q, at, 1, level)
        for level in range(min(mine, highest), -1, -1):
            at = self.nearest_on(q, at, width, level)
            rows = self.links if level == 0 else self.upper[level - 1]
            for other in self._chosen(at, links):
                self._link(rows, node, other)
                self._link(rows, other, node)
        if mine > highest:
            self.entry = node

    def _link(self, rows: np.ndarray, a: int, b: int) -> None:
        row = rows[a]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = b
            return
        nodes = np.r_[row, b]
        near = sorted(zip((self.x[nodes] @ self.x[a]).tolist(), nodes.tolist()), reverse=True)
        row[:] = self._chosen(near, len(row))


def build_index(vectors: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard (columns of ``SHARD``) over every usable vector; ids kept per distinct vector: k + 1.

    No more than k + 1 ids of a vector can be among the k nearest other rows of any query, as ties go to smaller ids.
    """
    rows = usable(vectors)
    points = rows.mapInPandas(_points(k + 1), "vector binary, ids array<long>").groupBy("vector").agg(F.collect_list("ids").alias("ids"))
    points = stage(points.select("vector", F.slice(F.array_sort(F.array_distinct(F.flatten("ids"))), 1, k + 1).alias("ids")), "points")
    n, longest = points.count(), _longest(points)
    shards = max(1, math.ceil(n / shard_rows))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort([i[0] for i in pdf["ids"]], kind="stable")]
        x = np.stack([np.frombuffer(v, np.float64) for v in pdf["vector"]])
        more = np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))
        graph = Graph.build(np.column_stack([x, more]).astype(np.float32))
        counts = np.array([len(i) for i in pdf["ids"]], np.int32)
        ids = np.concatenate([np.asarray(i, np.int64) for i in pdf["ids"]])
        upper = np.stack(graph.upper).tobytes() if graph.upper else b""
        return pd.DataFrame([(int(pdf["shard"].iloc[0]), len(x), graph.entry, graph.levels.tobytes(), graph.links.tobytes(), upper, x.tobytes(), ids.tobytes(), counts.tobytes())],
                            columns=["shard", "size", "entry", "levels", "links", "upper", "vectors", "ids", "id_counts"])

    dims = F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")
    same = points.withColumn("shard", dims).withColumn("length", F.octet_length("vector"))
    return stage(same.groupBy("shard", "length").applyInPandas(lambda pdf: build(pdf), SHARD), "graphs")


def _longest(points: DataFrame) -> float:
    def norms(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [max((float(np.linalg.norm(np.frombuffer(v, np.float64))) for v in pdf["vector"]), default=0.0)]})

    return points.mapInPandas(norms, "n double").agg(F.max("n")).first()[0] or 1.0


def _load(row) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(row["vectors"], np.float64).reshape(row["size"], -1)
    more = np.sqrt(np.maximum((x**2).sum(1).max() - (x**2).sum(1), 0))
    upper = np.frombuffer(row["upper"], np.int32).reshape(-1, row["size"], LINKS)
    graph = Graph(np.column_stack([x, more]).astype(np.float32), np.frombuffer(row["levels"], np.int32),
                  np.frombuffer(row["links"], np.int32).reshape(row["size"], -1), list(upper), row["entry"])
    counts = np.frombuffer(row["id_counts"], np.int32)
    return graph, x, np.frombuffer(row["ids"], np.int64), np.r_[0, np.cumsum(counts)]


def _searched(k: int, width: int):
    """A shard's rows come with its graph first, then the blocks of queries; blocks without a graph of their length find nothing."""

    def run(batches):
        at_hand, held = None, None
        for pdf in batches:
            for row in pdf.to_dict("records"):
                if row["kind"] == 0:
                    at_hand, held = (row["shard"], row["length"]), _load(row)
                    continue
                if at_hand != (row["shard"], row["length"]):
                    continue
                graph, x, ids, at = held
                queries = np.frombuffer(row["vectors"], np.float64).reshape(-1, x.shape[1])
                out = []
                for qid, q in zip(np.frombuffer(row["ids"], np.int64).tolist(), queries):
                    nodes = np.array([n for _, n in graph.search(np.r_[q, 0].astype(np.float32), max(width, k + 1))])
                    scores = x[nodes] @ q
                    near = [(-s, int(i)) for s, n in zip(scores.tolist(), nodes.tolist()) for i in ids[at[n]:at[n + 1]].tolist() if i != qid]
                    out += [(qid, i, -s) for s, i in heapq.nsmallest(k, near)]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def _query_blocks(batches):
    for pdf in batches:
        for length, same in pdf.groupby(pdf["embedding"].map(len)):
            for a in range(0, len(same), BLOCK_QUERIES):
                part = same.iloc[a:a + BLOCK_QUERIES]
                yield pd.DataFrame({"length": [8 * length], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()],
                                    "vectors": [np.stack(part["embedding"]).astype(np.float64).tobytes()]})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, width: int = SEARCH_WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, its own row left out.

    Nearest is the largest inner product, computed in double precision; ties go to the smaller vec_id. Rows whose
    vec_id is null, or whose vector is null, empty, zero or has null or non-finite components, neither ask nor answer.
    Vectors of another length than the query's are no candidates. Rows that repeat a vec_id and vector count once; a
    query row that repeats gives one set of ranks. Empty tables give no rows. Other columns are not read.
    """
    index = build_index(vectors, k, shard_rows).withColumn("length", (F.octet_length("vectors") / F.col("size")).cast("int"))
    graphs, last = index.agg(F.count(F.lit(1)), F.coalesce(F.max("shard"), F.lit(0))).first()
    ask = usable(queries).dropDuplicates(["vec_id", "embedding"])
    blocks = stage(ask.mapInPandas(_query_blocks, "length int, ids binary, vectors binary"), "queries")
    splits = max(1, math.ceil(blocks.count() / TASK_BLOCKS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = blocks.withColumn("split", F.pmod(F.xxhash64("ids"), F.lit(splits)).cast("int")).withColumn("shard", every(last + 1))
    both = index.withColumn("kind", F.lit(0)).withColumn("split", every(splits)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    key = ["shard", "length", "split"]
    sent = both.fillna(0, ["size", "entry"]).repartition(max(1, graphs * splits), *key).sortWithinPartitions(*key, "kind")
    found = sent.mapInPandas(_searched(k, width), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
