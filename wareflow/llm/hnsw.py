"""Nearest neighbours by hierarchical navigable small-world graphs, one for each shard.

Method. Rows are dealt evenly to shards of about `shard_rows` vectors. Each shard gets a graph: a
vector is on level l with probability m^-l and has up to m neighbours there (2m on level 0), chosen so
that they lie in different directions. The graph is stored as flat neighbour arrays beside the
vectors, a row for each shard. A query descends greedily to level 0 and keeps the `ef` best vectors
found there; shard results are merged. All rows are indexed; nothing is fitted on a sample.

Vectors are inserted, and queries searched, in batches that move in step as arrays. Equal vectors of a
shard are one node with a list of members, so copies don't fill up neighbour lists.

Index rows stay where they are stored. Queries come in blocks of bounded size; a block is sent to every task, which
goes through its index rows and keeps each query's best so far, so only these are shuffled to be merged.

Defined results
* A vector that is null, empty, zero, or has a null or non-finite component takes no part. Nor does
  one without an id. Vectors of different lengths never meet.
* Ties go to the smaller id. Fewer candidates than asked for: all that are found.
* Repeated rows count once. Rows with a query's id are its own and not its candidates; if a query id
  is repeated with several vectors, the least vector is the query.
* An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareflow.llm.store import Scratch

#: Vectors of a shard, bytes of a block of queries, and vectors inserted or queries searched in step.
SHARD_ROWS, BLOCK_BYTES, STEP = 8_192, 32 << 20, 256


class Graph:
    """A navigable small-world graph over the rows of `vectors` (float64)."""

    def __init__(self, vectors: np.ndarray, m: int, ef: int, seed: int = 0):
        self.vectors, self.m, self.ef = vectors, m, ef
        n = len(vectors)
        draws = np.random.default_rng(seed).random(n)
        self.levels = np.minimum((-np.log(1.0 - draws) / np.log(m)).astype(int), 8) if n else np.empty(0, int)
        self.neighbours = [np.full((n, 2 * m if level == 0 else m), -1, np.int32) for level in range(int(self.levels.max(initial=0)) + 1)]
        self.entry, self.top = -1, -1

    @classmethod
    def built(cls, vectors: np.ndarray, m: int, ef: int, seed: int = 0) -> "Graph":
        graph = cls(vectors, m, ef, seed)
        done = 0
        while done < len(vectors):
            size = min(STEP, max(1, done // 4))
            graph._insert(np.arange(done, min(done + size, len(vectors))))
            done += size
        return graph

    @classmethod
    def stored(cls, vectors: np.ndarray, widths: list[int], flat: np.ndarray, entry: int) -> "Graph":
        """A graph from its flat neighbour arrays."""
        graph = cls.__new__(cls)
        graph.vectors, graph.neighbours, at = vectors, [], 0
        for width in widths:
            graph.neighbours.append(flat[at : at + len(vectors) * width].reshape(len(vectors), width))
            at += len(vectors) * width
        graph.entry, graph.top = entry, len(widths) - 1
        return graph

    def _distances(self, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each point to its row of ids; infinite where an id is -1."""
        gap = self.vectors[ids] - points[:, None, :]
        out = np.einsum("qkd,qkd->qk", gap, gap)
        out[ids < 0] = np.inf
        return out

    def _descend(self, points: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        """Greedy walk on one level from the nodes `at`."""
        best = self._distances(points, at[:, None])[:, 0]
        moving = np.arange(len(points))
        while len(moving):
            near = self.neighbours[level][at[moving]]
            d = self._distances(points[moving], near)
            k = d.argmin(axis=1)
            found = d[np.arange(len(moving)), k]
            better = found < best[moving]
            moving_better = moving[better]
            best[moving_better] = found[better]
            at[moving_better] = near[better, k[better]]
            moving = moving_better
        return at

    def _beam(self, points: np.ndarray, begin: np.ndarray, level: int, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ef best nodes found on a level for each point, best first, with squared distances."""
        q = len(points)
        ids = np.full((q, ef), -1, np.int64)
        d = np.full((q, ef), np.inf)
        done = np.ones((q, ef), bool)
        begin = begin.reshape(q, -1)[:, :ef]
        w = begin.shape[1]
        ids[:, :w], d[:, :w] = begin, self._distances(points, begin)
        done[:, :w] = begin < 0
        seen = np.zeros((q, len(self.vectors) + 1), bool)
        np.put_along_axis(seen, np.where(begin < 0, len(self.vectors), begin), True, axis=1)
        active = np.arange(q)
        while len(active):
            # Expand the best few nodes that haven't been; what is full of better ones has none left.
            open_d = np.where(done[active], np.inf, d[active])
            pick = np.argpartition(open_d, min(wide, ef) - 1, axis=1)[:, :wide]
            chosen = np.take_along_axis(open_d, pick, axis=1) < np.inf
            busy = chosen.any(axis=1)
            active, pick, chosen = active[busy], pick[busy], chosen[busy]
            if not len(active):
                break
            rows = active[:, None]
            done[rows, pick] = True
            near = self.neighbours[level][np.where(chosen, ids[rows, pick], 0)].astype(np.int64)
            near[~chosen] = -1
            near = np.sort(near.reshape(len(active), -1), axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[rows, near] & (near >= 0)] = -1
            seen[rows, np.where(near < 0, len(self.vectors), near)] = True
            near_d = self._distances(points[active], near)
            every_id = np.concatenate((ids[active], near), axis=1)
            every_d = np.concatenate((d[active], near_d), axis=1)
            every_done = np.concatenate((done[active], near < 0), axis=1)
            best = np.argpartition(every_d, ef - 1, axis=1)[:, :ef]
            ids[active] = np.take_along_axis(every_id, best, axis=1)
            d[active] = np.take_along_axis(every_d, best, axis=1)
            done[active] = np.take_along_axis(every_done, best, axis=1)
        order = np.lexsort((ids, d), axis=1)
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(d, order, axis=1)

    def _chosen(self, points: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` of each row's ids: near ones that no chosen one is nearer to, then near ones."""
        d = self._distances(points, ids)
        order = np.argsort(d, axis=1, kind="stable")
        ids, d = np.take_along_axis(ids, order, axis=1), np.take_along_axis(d, order, axis=1)
        own = self.vectors[ids]
        norms = np.einsum("qkd,qkd->qk", own, own)
        between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(own, own.transpose(0, 2, 1))
        keep = np.zeros(ids.shape, bool)
        nearest = np.full(ids.shape, np.inf)
        for k in range(ids.shape[1]):
            keep[:, k] = (ids[:, k] >= 0) & (d[:, k] < nearest[:, k]) & (keep.sum(axis=1) < most)
            nearest = np.where(keep[:, k, None], np.minimum(nearest, between[:, k, :]), nearest)
        rank = np.where(keep, 0, 1) * ids.shape[1] + np.arange(ids.shape[1])
        rank[ids < 0] = 3 * ids.shape[1]
        take = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, take, axis=1)

    def _insert(self, new: np.ndarray) -> None:
        if self.entry < 0:
            self.entry, self.top = int(new[0]), int(self.levels[new[0]])
            return
        points = self.vectors[new]
        at = np.full(len(new), self.entry)
        highest = int(self.levels[new].max())
        for level in range(max(self.top, highest), -1, -1):
            on = np.flatnonzero(self.levels[new] >= level)
            if level > self.top:
                self._link(new[on], np.empty((len(on), 0), np.int64), level)
                continue
            if len(on):
                found, _ = self._beam(points[on], at[on], level, self.ef)
                self._link(new[on], found, level)
            at = self._descend(points, at, level)
        if highest > self.top:
            self.entry, self.top = int(new[self.levels[new].argmax()]), highest

    def _link(self, new: np.ndarray, found: np.ndarray, level: int) -> None:
        """Link new nodes to some of those found and of each other, both ways."""
        if len(new) > 1:
            gap = self.vectors[new]
            norms = np.einsum("qd,qd->q", gap, gap)
            d = norms[:, None] + norms[None, :] - 2 * gap @ gap.T
            np.fill_diagonal(d, np.inf)
            few = min(len(new) - 1, self.m)
            found = np.concatenate((found, new[np.argpartition(d, few - 1, axis=1)[:, :few]]), axis=1)
        if not found.shape[1]:
            return
        lists = self.neighbours[level]
        picked = self._chosen(self.vectors[new], found, self.m)
        lists[new, : picked.shape[1]] = picked
        source, target = np.repeat(new, picked.shape[1]), picked.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        extra = np.full((len(nodes), count.max()), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        both = np.sort(np.concatenate((lists[nodes].astype(np.int64), extra), axis=1), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        width = lists.shape[1]
        full = (both >= 0).sum(axis=1) > width
        packed = -np.sort(-both, axis=1)[:, :width]
        for a in range(0, int(full.sum()), STEP):
            rows = np.flatnonzero(full)[a : a + STEP]
            packed[rows] = self._chosen(self.vectors[nodes[rows]], both[rows], width)
        lists[nodes, : packed.shape[1]] = packed

    def search(self, points: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(node numbers, squared distances) of the ef best nodes found, best first; -1 after the last."""
        found, distances = [], []
        for a in range(0, len(points), STEP):
            own = points[a : a + STEP]
            at = np.full(len(own), self.entry)
            for level in range(self.top, 0, -1):
                at = self._descend(own, at, level)
            ids, d = self._beam(own, at, 0, min(ef, len(self.vectors)))
            found.append(ids)
            distances.append(d)
        return np.concatenate(found), np.concatenate(distances)


INDEX = "dim int, shard long, ids array<long>, begins array<int>, vectors binary, widths array<int>, neighbours binary, entry int"


def _build(part: pd.DataFrame, m: int, ef: int) -> pd.DataFrame:
    """The index row of one shard."""
    raw = np.stack(part["vector"].to_numpy()).astype(np.float64)
    ids = part["vec_id"].to_numpy(np.int64)
    order = np.lexsort((ids, *raw.T[::-1]))
    raw, ids = raw[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], (raw[1:] != raw[:-1]).any(axis=1))))
    mixed = np.random.default_rng(int(part["shard"].iloc[0])).permutation(len(first))
    edges = np.append(first, len(ids))
    counts = np.diff(edges)[mixed]
    members = np.concatenate([ids[edges[k] : edges[k + 1]] for k in mixed])
    vectors = raw[first[mixed]]
    graph = Graph.built(vectors, m, ef, seed=len(ids))
    return pd.DataFrame({
        "dim": [raw.shape[1]],
        "shard": [int(part["shard"].iloc[0])],
        "ids": [members],
        "begins": [np.concatenate(([0], np.cumsum(counts))).astype(np.int32)],
        "vectors": [vectors.tobytes()],
        "widths": [[x.shape[1] for x in graph.neighbours[: graph.top + 1]]],
        "neighbours": [b"".join(x.tobytes() for x in graph.neighbours[: graph.top + 1])],
        "entry": [graph.entry],
    })


def _search(queries: pd.DataFrame, index: pd.DataFrame, k: int, ef: int) -> pd.DataFrame:
    """A block of queries in one shard: query_id, vec_id, score."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if len(queries) and len(index):
        row = index.iloc[0]
        dim = int(row["dim"])
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
        graph = Graph.stored(vectors, list(row["widths"]), np.frombuffer(row["neighbours"], np.int32), int(row["entry"]))
        found, d = graph.search(np.stack(queries["vector"].to_numpy()).astype(np.float64), max(ef, 2 * k))
        begins, ids = np.asarray(row["begins"]), np.asarray(row["ids"])
        for query, nodes, squares in zip(queries["vec_id"], found, d):
            rows: list[tuple[float, int]] = []
            seen = {query}
            for node, square in zip(nodes.tolist(), squares.tolist()):
                if node < 0 or (len(rows) >= k and square > rows[k - 1][0]):
                    break
                # A node's members come by id: of equal vectors only the first k new ones can be among the k best.
                new = []
                for x in ids[begins[node] : begins[node + 1]].tolist():
                    if len(new) == k:
                        break
                    if x not in seen:
                        seen.add(x)
                        new.append((square, x))
                rows = sorted(rows + new)
            for square, vec_id in rows[:k]:
                out["query_id"].append(query)
                out["vec_id"].append(vec_id)
                out["score"].append(square**0.5)
    return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def usable(embeddings: DataFrame, vector: str, key: str) -> DataFrame:
    """vec_id, vector and dim of the rows that take part."""
    v = F.col(vector)
    finite: Column = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.where(F.col(key).isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(key).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"), F.size(v).alias("dim"))


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS, m: int = 16, ef: int = 64) -> DataFrame:
    """One row for each shard. rows: vec_id, vector, dim; repeated rows are one."""
    rows = rows.distinct()
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / shard_rows).alias("shards"))
    # The shard follows from the row itself, so a task that runs again deals its rows as before.
    dealt = rows.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.col("shards")))
    # A graph takes a task long for the few bytes it reads: adaptive execution would put many in one task.
    shards = sizes.agg(F.sum("shards").alias("n")).first()["n"] or 1
    dealt = dealt.select("dim", "shard", "vec_id", "vector").repartition(2 * shards, "dim", "shard")
    return dealt.groupBy("dim", "shard").applyInPandas(lambda part: _build(part, m, ef), INDEX)


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k best rows; a vec_id counts once."""
    found = found.sort_values(["query_id", "score", "vec_id"]).drop_duplicates(["query_id", "vec_id"])
    return found.groupby("query_id", sort=False).head(k)


def searched(index: DataFrame, queries: pd.DataFrame, k: int, ef: int) -> DataFrame:
    """query_id, vec_id and score of the best of each query in what a task has of the index. queries: a block of them."""
    sent = index.sparkSession.sparkContext.broadcast(dict(tuple(queries.groupby("dim"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pandas()
                own = sent.value.get(int(row["dim"].iloc[0]))
                if own is not None:
                    best = _best(pd.concat([best, _search(own, row, k, ef)], ignore_index=True), k)
        yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def search(index: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 10, ef: int = 128, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest found. queries: vec_id, vector, dim.

    index: a written one, as each block of queries reads it.
    """
    queries = queries.groupBy("vec_id", "dim").agg(F.min("vector").alias("vector"))
    queries = queries.groupBy("vec_id").agg(F.min(F.struct("dim", "vector")).alias("q")).select("vec_id", "q.dim", "q.vector")
    queries = scratch.keep(queries, "queries")
    size = queries.agg(F.sum(F.col("dim") * 8 + 8)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = []
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toPandas()  # about block_bytes
        found.append(scratch.keep(searched(index, own, k, ef), "found"))
    merged = reduce(DataFrame.union, found).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, is_query: Column, scratch: Scratch, k: int = 10, vector: str = "embedding", key: str = "vec_id", **how) -> DataFrame:
    """The k nearest rows of each row that `is_query` selects, by Euclidean distance."""
    rows = usable(embeddings, vector, key)
    index = scratch.keep(build_index(rows, **how), "index")
    return search(index, usable(embeddings.where(is_query), vector, key), scratch, k)
