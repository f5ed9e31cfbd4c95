"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into parts of equal size with few edges across. A small classifier learns
the part of a vector (and of its neighbours) from the vector alone. It places every vector of the table in a part and
sends every query to its most probable parts, until their probabilities add up to ``mass`` and they hold enough vectors;
the vectors found there are ranked by the exact distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.llm.common import Shared, map_rows, stored
from sliceweave.operators.ordering import top_k

#: Bound of the sample that the partitions are learnt from, and most parts that it can carry.
SAMPLE, MOST_PARTS = 12_000, 128
#: Vectors in a part, about, until there are ``MOST_PARTS``; vectors and queries compared in one task at once.
PART, BLOCK = 1024, 4096
#: Neighbours in the graph.
DEGREE = 10
#: A query visits its most probable parts until they hold this much probability.
MASS = 0.95
#: Units of the classifier's hidden layer.
HIDDEN = 64


def neighbour_graph(x: np.ndarray, degree: int = DEGREE, block: int = 512) -> np.ndarray:
    """The nearest other rows of each row."""
    n, square = len(x), (x * x).sum(axis=1)
    degree = min(degree, n - 1)
    out = np.empty((n, degree), np.int64)
    for at in range(0, n, block):
        d = square[None, :] - 2 * (x[at:at + block] @ x.T)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at:at + block] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 3, rounds: int = 40) -> np.ndarray:
    """Part of each node: ``parts`` (a power of two) parts of equal size, halved again and again.

    Each half follows the slowest mode of the neighbour graph inside the part (power iteration), cut at its median.
    """
    n, degree = graph.shape
    rng, part = np.random.default_rng(seed), np.zeros(n, np.int64)
    source = np.repeat(np.arange(n), degree)
    while part.max() + 1 < parts:
        inside = part[source] == part[graph.ravel()]
        a, b = source[inside], graph.ravel()[inside]
        weight = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1e-9
        groups = int(part.max()) + 1
        total = np.bincount(part, weight, groups)
        mode = rng.standard_normal(n)
        for _ in range(rounds):
            mode -= (np.bincount(part, weight * mode, groups) / total)[part]  # all parts at once, each without its mean
            mode = 0.5 * mode + 0.5 * (np.bincount(a, mode[b], n) + np.bincount(b, mode[a], n)) / weight
            mode /= np.sqrt(np.bincount(part, mode * mode, groups))[part] + 1e-30
        order = np.lexsort((mode, part))
        sizes = np.bincount(part, minlength=groups)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        part = 2 * part + (2 * rank >= sizes[part])
    return part


class Router:
    """Classifier from a vector to its part: one hidden layer, trained in numpy."""

    def __init__(self, size: int, parts: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(size, np.float32), np.float32(1)
        self.w = [(rng.standard_normal((size, HIDDEN)) * size**-0.5).astype(np.float32), np.zeros(HIDDEN, np.float32),
                  (rng.standard_normal((HIDDEN, parts)) * HIDDEN**-0.5).astype(np.float32), np.zeros(parts, np.float32)]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) * self.scale @ self.w[0] + self.w[1], 0)
        score = hidden @ self.w[2] + self.w[3]
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 25, batch: int = 128, rate: float = 3e-3, seed: int = 5) -> None:
        """``target``: share of each part among a row and its neighbours."""
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), np.float32(1 / (x.std() + 1e-12))
        x = (x - self.mean) * self.scale
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows, wanted = x[order[at:at + batch]], target[order[at:at + batch]]
                hidden = np.maximum(rows @ self.w[0] + self.w[1], 0)
                score = hidden @ self.w[2] + self.w[3]
                score = np.exp(score - score.max(axis=1, keepdims=True))
                d = (score / score.sum(axis=1, keepdims=True) - wanted) / len(rows)
                d_hidden = (d @ self.w[2].T) * (hidden > 0)
                t += 1
                for i, g in enumerate((rows.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ d, d.sum(axis=0))):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    self.w[i] -= np.float32(rate * (1 - 0.9 * epoch / epochs)) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def learn(sample: np.ndarray, parts: int) -> Router | None:
    """Router over ``parts`` parts; None if one part holds all."""
    if parts < 2 or len(sample) < 2 * parts:
        return None
    graph = neighbour_graph(sample)
    part = balanced_parts(graph, parts)
    near = np.concatenate([part[:, None], part[graph]], axis=1)
    target = np.zeros((len(sample), parts), np.float32)
    np.add.at(target, (np.arange(len(sample))[:, None], near), np.float32(1 / near.shape[1]))
    router = Router(sample.shape[1], parts)
    router.fit(sample, target)
    return router


def _matrix(column: pa.Array, kind) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _rank_block(k: int):
    def run(key, points: pa.Table, queries: pa.Table) -> pa.Table:
        """Nearest points of one block for the queries sent there: exact distances in double precision."""
        out: dict[str, list] = {"query": [], "distance": [], "ids": []}
        if points.num_rows and queries.num_rows:
            ids = points["ids"].to_pylist()
            first = np.array([i[0] for i in ids])
            base = _matrix(points["v"], np.float64)
            square = (base * base).sum(axis=1)
            asked = _matrix(queries["v"], np.float64)
            names = queries["query"].to_pylist()
            take = min(k, len(base))
            for at in range(0, len(asked), 256):
                q = asked[at:at + 256]
                rough = square[None, :] - 2 * (q @ base.T) + (q * q).sum(axis=1)[:, None]
                limit = np.partition(rough, take - 1, axis=1)[:, take - 1]
                limit = limit + 1e-9 * (np.abs(limit) + (q * q).sum(axis=1) + square.max())
                for i in range(len(q)):
                    near = np.flatnonzero(rough[i] <= limit[i])  # all that may be among the first, ties included
                    exact = np.sqrt(((base[near] - q[i]) ** 2).sum(axis=1))
                    best = np.lexsort((first[near], exact))[:take]
                    out["query"] += [names[at + i]] * len(best)
                    out["distance"] += exact[best].tolist()
                    out["ids"] += [ids[j] for j in near[best]]
        return pa.table(out, schema=pa.schema([("query", pa.int64()), ("distance", pa.float64()), ("ids", pa.list_(pa.int64()))]))

    return run


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", mass: float = MASS,
            sample: int = SAMPLE) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_column`` and ``score`` (Euclidean distance) of the nearest rows found.

    Each row of ``queries`` (same columns) is compared with the rows of ``df`` whose id differs from its own; ties go to
    the smaller id. Vectors that are null, empty, zero, or hold null or non-finite values, and rows with a null id, take
    no part. Rows equal in id and vector count once, and so do queries; an id with several vectors is found by any of
    them, and asks with all of them for its one list. All vectors must have one length; others are an
    error. Equal vectors are one point of the index that carries its ``k + 1`` smallest ids, as no more can be found.
    Fewer candidates than ``k`` give fewer rows; empty tables give an empty result. Other columns are left out.
    """
    spark = df.sparkSession

    def valid(frame: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_column}`")
        whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return frame.where(F.col(f"`{id_column}`").isNotNull() & F.coalesce(whole, F.lit(False))).select(
            F.col(f"`{id_column}`").cast("long").alias("id"), v.cast("array<float>").alias("v")).distinct()

    rows = stored(valid(df), "vectors")
    kept = top_k(rows, ["v"], [F.col("id")], k + 1, "place")
    points = stored(kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    facts = points.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if facts["n"] and facts["low"] != facts["high"]:
        raise ValueError("all vectors must have the same length")
    drawn = points.select("v", F.xxhash64("v").alias("draw")).orderBy("draw", "v").limit(sample).select("v").toArrow()
    parts = min(MOST_PARTS, 1 << max(0, (max(facts["n"], 1) // PART).bit_length() - 1))
    shared = Shared(spark, "router", learn(_matrix(drawn["v"], np.float32), parts) if drawn.num_rows else None)

    def own_part(vectors: pa.Array) -> dict:
        router = shared.get(lambda value: value)
        if router is None or not len(vectors):
            return {"part": [0] * len(vectors)}
        return {"part": router.probabilities(_matrix(vectors, np.float32)).argmax(axis=1).tolist()}

    def likely_parts(vectors: pa.Array) -> dict:
        router = shared.get(lambda value: value)
        if router is None or not len(vectors):
            return {"parts": [[0]] * len(vectors)}
        p = router.probabilities(_matrix(vectors, np.float32))
        order = np.argsort(-p, axis=1)
        before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
        visits = 1 + np.maximum((before < mass).sum(axis=1), (np.cumsum(held[order], axis=1) < k + 1).sum(axis=1))
        return {"parts": [o[:n].tolist() for o, n in zip(order, visits)]}

    placed = stored(map_rows(points, ["v"], "part int", own_part, ["v", "ids"], shared), "placed")
    counted = placed.groupBy("part").count()
    held = np.zeros(parts, np.int64)  # vectors of each part
    for row in counted.collect():
        held[row["part"]] = row["count"]
    sizes = counted.select(F.col("part").alias("_part"), F.expr(f"1 + count div {BLOCK}L").alias("blocks"))  # a row per part
    blocks = placed.join(F.broadcast(sizes), F.col("part") == F.col("_part")).withColumn("block", F.pmod(F.xxhash64("v"), "blocks")).select("part", "block", "v", "ids")
    asked = stored(valid(queries), "queries")
    distinct = asked.groupBy("v").agg(F.min("id").alias("query"))
    routed = map_rows(distinct, ["v"], "parts array<int>", likely_parts, ["query", "v"], shared)
    routed = routed.select("query", "v", F.explode("parts").alias("part")).join(F.broadcast(sizes), F.col("part") == F.col("_part"))
    routed = routed.select("query", "v", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    found = blocks.groupBy("part", "block").cogroup(routed.groupBy("part", "block")).applyInArrow(_rank_block(k + 1), "query long, distance double, ids array<long>")
    each = found.select("query", "distance", F.explode("ids").alias("id"))
    best = top_k(each, ["query"], [F.col("distance"), F.col("id")], k + 1, "place").select("query", "distance", F.col("id").alias("found"))
    named = asked.join(distinct.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v")).select("id", "query")
    pairs = named.join(best, "query").where("id <> found")
    ranked = top_k(pairs, ["id"], [F.col("distance"), F.col("found")], k, "rank")
    return ranked.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("found").alias(id_column), F.col("distance").alias("score"))
