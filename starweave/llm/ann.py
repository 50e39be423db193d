"""Approximate nearest neighbours by inner product over robust-pruned directed graphs.

Equal vectors are one node (with its smallest ids, as many as an answer can need). Nodes are dealt
into shards of about ``SHARD_ROWS`` by a hash of the vector, and within a shard into layers whose
lengths differ by a factor of ``LAYER`` at most. Each layer gets its own graph: greedy searches from
the medoid propose neighbours, and pruning with a relaxed distance keeps ``DEGREE`` diverse edges.
Its distances are those of the vectors with one more coordinate that makes them equally long; with
lengths so close, that coordinate does not hide the directions. A beam search by the inner product
itself answers every query in every shard, in blocks of queries, the longest layer first; a layer is
left out for the queries whose answers all exceed its longest length times the query's (the inner
product's bound). The whole beam is scored in double precision on the original vectors.

Defined results: vectors that are null, all zero, or hold a null or a non-finite component take no
part, neither as query nor as candidate; vectors are compared with those of the same length only;
null ids take no part; a repeated id is a candidate once per different vector; ties go to the
smaller id; an empty table gives an empty result; a query without candidates gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starweave.llm.common import col, stored

SHARD_ROWS = 8192
DEGREE = 40
BUILD_BEAM = 64
SEARCH_BEAM = 160
RELAX = 1.2
QUERY_BLOCK = 512
LAYER = 1.5  # longest to shortest vector of one graph


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int,
                step: int = 4, inner: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes met by a greedy walk, per query: (nodes, distances).

    Distances are squared, less the query's own square; with ``inner``, they are inner products times
    -2. Every round opens the ``step`` nearest unopened nodes of each query's beam. Free places hold -1.
    """
    q, n = len(queries), len(points)
    rows = np.arange(q)[:, None]
    norm = np.zeros(n, points.dtype) if inner else (points * points).sum(axis=1)
    met = np.zeros((q, n + 1), dtype=bool)
    met[:, [start, n]] = True  # column n stands for missing edges
    node = np.full((q, beam), -1, dtype=np.int64)
    dist = np.full((q, beam), np.inf, dtype=np.float32)
    opened = np.zeros((q, beam), dtype=bool)
    node[:, 0] = start
    dist[:, 0] = norm[start] - 2 * queries @ points[start]
    while True:
        wait = np.where(opened | (node < 0), np.inf, dist)
        pick = np.argpartition(wait, min(step, beam - 1), axis=1)[:, :step] if beam > step else np.argsort(wait, axis=1)[:, :step]
        ready = np.isfinite(np.take_along_axis(wait, pick, axis=1))
        live = np.flatnonzero(ready.any(axis=1))
        if not len(live):
            return node, dist
        opened[rows[live], pick[live]] |= ready[live]
        near = edges[np.where(ready[live], node[rows[live], pick[live]], n)].reshape(len(live), -1)
        near = np.where(met[live[:, None], near], n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        met[live[:, None], near] = True
        real = near < n
        safe = np.where(real, near, 0)
        d = norm[safe] - 2 * np.matmul(points[safe], queries[live][:, :, None])[:, :, 0]
        d = np.where(real, d, np.inf).astype(np.float32)
        all_node = np.concatenate([node[live], np.where(real, near, -1)], axis=1)
        all_dist = np.concatenate([dist[live], d], axis=1)
        all_open = np.concatenate([opened[live], np.zeros_like(real)], axis=1)
        best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        node[live], dist[live], opened[live] = (np.take_along_axis(x, best, axis=1) for x in (all_node, all_dist, all_open))


def prune(points: np.ndarray, own: np.ndarray, found: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each node ``own`` out of the candidates ``found`` (-1: none).

    The nearest candidate is kept; those that are nearer to it than to the node, by the relaxed
    measure, go; and so on.
    """
    n = len(points)
    found = np.where(found == own[:, None], -1, found)
    found = np.sort(found, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    safe = np.where(found < 0, 0, found)
    v = points[safe]
    norm = (v * v).sum(axis=2)
    me = points[own]
    d = norm + (me * me).sum(axis=1)[:, None] - 2 * np.matmul(v, me[:, :, None])[:, :, 0]
    d = np.where(found < 0, np.inf, d)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    out = np.full((len(own), degree), n, dtype=np.int64)
    rows = np.arange(len(own))
    left = d.copy()
    for k in range(degree):
        at = left.argmin(axis=1)
        ok = np.isfinite(left[rows, at])
        if not ok.any():
            break
        out[ok, k] = found[rows, at][ok]
        left[rows, at] = np.inf
        left[(relax * relax * between[rows, at] <= d) & ok[:, None]] = np.inf
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX,
          batch: int = 256, seed: int = 1) -> tuple[np.ndarray, int]:
    """Edges (one more row for "no node", missing edges are ``len(points)``) and the start node."""
    n = len(points)
    rng = np.random.default_rng(seed)
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n + 1, degree), n, dtype=np.int64)
    if n > 1:  # random first edges, pruned away as better ones are found
        edges[:n, :degree // 2] = rng.integers(0, n, (n, degree // 2))
    order = rng.permutation(n)
    for a in range(0, n, batch):
        own = order[a:a + batch]
        node, _ = beam_search(points, edges, start, points[own], beam)
        old = np.where(edges[own] == n, -1, edges[own])
        edges[own] = prune(points, own, np.concatenate([node, old], axis=1), degree, relax)
        # Edges back: a node that gets more than it can hold is pruned again.
        src, dst = np.repeat(own, degree), edges[own].ravel()
        src, dst = src[dst < n], dst[dst < n]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        who, first, size = np.unique(dst, return_index=True, return_counts=True)
        for b in range(0, len(who), 512):
            w, f, s = who[b:b + 512], first[b:b + 512], size[b:b + 512]
            width = 3 * degree
            for more in range(0, int(s.max()), width):  # all of them, a piece at a time
                to = np.flatnonzero(s > more)
                at = more + np.arange(min(width, int(s.max()) - more))
                new = np.where(at < s[to, None], src[np.minimum(f[to, None] + at, len(src) - 1)], -1)
                both = np.concatenate([np.where(edges[w[to]] == n, -1, edges[w[to]]), new], axis=1)
                edges[w[to]] = prune(points, w[to], both, degree, relax)
    return edges, start


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Lengths, without overflow on the way."""
    most = np.abs(vectors).max(axis=1, initial=0)
    safe = np.where(most > 0, most, 1)
    return most * np.sqrt(((vectors / safe[:, None]) ** 2).sum(axis=1))


def layers(size: np.ndarray) -> list[np.ndarray]:
    """Places of the vectors by length, longest layer first; a layer starts at the longest that is left."""
    order = np.argsort(-size, kind="stable")
    ranked, out, at = size[order], [], 0
    while at < len(order):
        to = int(np.searchsorted(-ranked, -ranked[at] / LAYER, side="right"))
        out.append(np.sort(order[at:to]))
        at = to
    return out


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors as single-precision points of length one: nearest means largest inner product."""
    unit = vectors / longest
    extra = np.sqrt(np.maximum(1 - (unit * unit).sum(axis=1), 0))
    return np.concatenate([unit, extra[:, None]], axis=1).astype(np.float32)


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("first_id", ignore_index=True)
    vectors = np.stack([np.asarray(v, dtype=np.float64) for v in rows["vector"]])
    size = lengths(vectors)
    parts = layers(size)
    graphs, starts = [], []
    for part in parts:
        # A layer within the beam's reach is scanned and needs no edges.
        edges, start = build(lifted(vectors[part], size[part].max())) if len(part) > SEARCH_BEAM else (np.empty((0, DEGREE)), 0)
        graphs.append(edges.astype(np.int32).ravel())
        starts.append(start)
    order = np.concatenate(parts)
    return pd.DataFrame({"dim": rows["dim"].iloc[:1].to_numpy(), "shard": rows["shard"].iloc[:1].to_numpy(),
                         "starts": [np.array(starts, dtype=np.int32)], "sizes": [np.array([len(x) for x in parts], dtype=np.int32)],
                         "vectors": [vectors[order].tobytes()], "edges": [np.concatenate(graphs).tobytes()],
                         "ids": [[np.asarray(i, dtype=np.int64) for i in rows["ids"].to_numpy()[order]]]})


def search_shard(vectors: np.ndarray, first_ids: np.ndarray, sizes: list[int], starts: list[int], edges: np.ndarray,
                 queries: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the ``top`` best nodes, ties to the smaller first id, and their scores; free places hold -1."""
    beam = max(SEARCH_BEAM, 4 * top)
    asked = lengths(queries)
    unit = (queries / asked[:, None]).astype(np.float32)
    node = np.full((len(queries), top), -1, dtype=np.int64)
    score = np.full((len(queries), top), -np.inf)
    at = edge = 0
    for n, start in zip(sizes, starts):
        part = vectors[at:at + n]
        longest = lengths(part).max()
        with np.errstate(over="ignore"):
            live = np.flatnonzero(score[:, -1] <= longest * asked * (1 + 1e-9))
        graph = None
        if n > SEARCH_BEAM:
            graph = edges[edge:edge + (n + 1) * DEGREE].reshape(n + 1, DEGREE).astype(np.int64)
            edge += graph.size
        if len(live):
            if graph is None:
                found = np.broadcast_to(np.arange(n), (len(live), n))
            else:
                found, _ = beam_search((part / longest).astype(np.float32), graph, start, unit[live], min(beam, n), inner=True)
            new = np.where(found < 0, -1, found + at)
            with np.errstate(over="ignore", invalid="ignore"):
                value = np.stack([(vectors[x] * queries[i]).sum(axis=1) for i, x in zip(live, np.maximum(new, 0))])
            new = np.concatenate([node[live], new], axis=1)
            value = np.concatenate([score[live], np.where(found < 0, -np.inf, value)], axis=1)
            best = np.lexsort((first_ids[new], new < 0, -value), axis=1)[:, :top]
            node[live], score[live] = np.take_along_axis(new, best, axis=1), np.take_along_axis(value, best, axis=1)
        at += n
    return node, score


def _answers(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                vectors = np.frombuffer(r["vectors"], dtype=np.float64).reshape(-1, r["dim"])
                first = np.array([i[0] for i in r["ids"]], dtype=np.int64)
                queries = np.array([q["vector"] for q in r["queries"]], dtype=np.float64)
                node, score = search_shard(vectors, first, r["sizes"], r["starts"], np.frombuffer(r["edges"], dtype=np.int32),
                                           queries, top)
                key, minus, ids = [], [], []
                for q, picks, scores in zip(r["queries"], node.tolist(), score.tolist()):
                    pairs = sorted((-s, i) for s, p in zip(scores, picks) if p >= 0 for i in r["ids"][p])[:top]
                    key += [q["key"]] * len(pairs)
                    minus += [m for m, _ in pairs]
                    ids += [i for _, i in pairs]
                yield pa.record_batch([pa.array(key, pa.int64()), pa.array(minus, pa.float64()), pa.array(ids, pa.int64())],
                                      names=["key", "minus", "vec_id"])

    return run


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, vector)`` of the rows that take part, vectors in double precision."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = df.select(col(df, id_col).cast("long").alias("vec_id"), col(df, vector_col).cast("array<double>").alias("vector"))
    return df.filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True))
                     & F.exists(v, lambda x: x != 0))


def build_index(vectors: DataFrame, ids: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard of ``vectors(vec_id, vector)``; each node keeps its ``ids`` smallest ids."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    # The row number's limit is applied in the map tasks first, so a vector that a third of all
    # rows share leaves each task with a few rows.
    few = vectors.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= ids)
    nodes = stored(few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
                   .withColumn("dim", F.size("vector")), "ann-nodes")
    sizes = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    nodes = nodes.join(F.broadcast(sizes), "dim").withColumn(
        "shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))
    nodes = nodes.select("dim", "shard", "vector", "ids", F.col("ids")[0].alias("first_id"))
    return stored(nodes.groupBy("dim", "shard").applyInPandas(
        _index, "dim int, shard int, starts array<int>, sizes array<int>, vectors binary, edges binary, ids array<array<bigint>>"), "ann-index")


def nearest(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest of each of ``queries(vec_id, vector)``."""
    asked = stored(queries.groupBy("vector").agg(F.min("vec_id").alias("key")), "ann-queries")
    total = asked.count()
    blocks = asked.withColumn("dim", F.size("vector")).withColumn(
        "block", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // QUERY_BLOCK)))))
    blocks = blocks.groupBy("dim", "block").agg(F.collect_list(F.struct("key", "vector")).alias("queries"))
    shards = index.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    blocks = blocks.join(F.broadcast(shards), "dim").select("dim", "queries", F.explode("shards").alias("shard"))
    pairs = index.join(blocks, ["dim", "shard"])
    found = pairs.mapInArrow(_answers(k + 1), "key long, minus double, vec_id long")
    # The row number's limit is applied in the tasks that search, so each sends k + 1 rows of a query at most.
    order = Window.partitionBy("key").orderBy("minus", "vec_id")
    found = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    best = stored(found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("minus", "vec_id"))).alias("found"))
                  .join(asked, "key").select("vector", "found"), "ann-found")
    rows = queries.select(F.col("vec_id").alias("query_id"), "vector").distinct().join(best, "vector")
    own = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    rows = rows.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("rank", "x"))
    return rows.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"),
                       (-F.col("x.minus")).alias("score"))


def search(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows to each row whose id is divisible by ``every``, other than itself."""
    vectors = stored(valid_vectors(df, id_col, vector_col), "ann-vectors")
    index = build_index(vectors, k + 1)
    return nearest(index, vectors.filter(F.col("vec_id") % every == 0), k)
