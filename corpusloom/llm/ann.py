"""Approximate nearest neighbours over robust-pruned directed graphs.

Vectors are dealt by hash to shards of a bounded size. Within a shard a directed graph is built in
batches: a greedy beam search over the graph so far proposes the nodes it passed as neighbours, and
relaxed distance pruning keeps those that no kept neighbour stands much closer to, so that edges
point in many directions. A query is answered by a beam search in every shard; the nodes found are
measured again in double precision and the best of all shards stay.

Every distinct vector is one node, whatever number of rows has it. A node keeps its smallest ids,
as many as an answer can hold, which loses none: further ids of a vector always come behind them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.runtime import bound_arrow_batches, durable

#: Vectors of a shard on average, and queries that search a shard together.
SHARD_ROWS, QUERY_ROWS = 4096, 512
#: Tasks that index or search at most; more shards share them.
MAX_TASKS = 20_000
#: Edges of a node; widths of the beam that proposes them and of the one that searches; slack of the pruning.
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 40, 80, 192, 1.2
#: Nodes that a beam expands at once, and nodes that are inserted at once.
EXPAND, BATCH = 4, 512


def beam_search(vectors: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the nodes of its final beam, nearest first (-1: none), and their squared distances."""
    n, q = len(vectors), len(queries)
    norms = np.einsum("ij,ij->i", vectors, vectors)
    own = np.einsum("ij,ij->i", queries, queries)
    beam = np.full((q, width), -1, dtype=np.int64)
    far = np.full((q, width), np.inf, dtype=np.float32)
    open_ = np.zeros((q, width), dtype=bool)
    seen = np.zeros((q, n + 1), dtype=bool)
    seen[:, n] = True  # where missing edges point
    beam[:, 0], open_[:, 0], seen[:, start] = start, True, True
    far[:, 0] = own + norms[start] - 2 * (queries @ vectors[start])
    while True:
        live = np.flatnonzero(open_.any(axis=1))
        if not len(live):
            return beam, far
        # the nearest nodes that aren't expanded yet
        order = np.argsort(~open_[live], axis=1, kind="stable")[:, :EXPAND]
        at = live[:, None]
        picked = np.where(open_[at, order], beam[at, order], n)
        open_[at, order] = False
        near = graph[picked].reshape(len(live), -1)
        near = np.sort(near, axis=1)
        fresh = ~seen[at, near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[at, near] = True
        near = np.where(fresh, near, n)
        most = max(1, int(fresh.sum(axis=1).max()))
        near = np.sort(near, axis=1)[:, :most]
        real = near < n
        safe = np.where(real, near, 0)
        dots = np.matmul(vectors[safe], queries[live][:, :, None])[:, :, 0]
        d = np.where(real, own[live][:, None] + norms[safe] - 2 * dots, np.inf).astype(np.float32)
        all_far = np.concatenate([far[live], d], axis=1)
        all_ids = np.concatenate([beam[live], np.where(real, near, -1)], axis=1)
        all_open = np.concatenate([open_[live], real], axis=1)
        best = np.argsort(all_far, axis=1, kind="stable")[:, :width]
        pick = np.arange(len(live))[:, None]
        far[live], beam[live], open_[live] = all_far[pick, best], all_ids[pick, best], all_open[pick, best]


def robust_prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each point's candidates (-1: none), at most `degree` diverse ones; -1 fills the rest.

    The nearest candidate stays, and every other that it stands closer to, by the factor alpha, than
    the point does goes; then the nearest of what is left, and so on.
    """
    b, c = candidates.shape
    candidates = np.sort(candidates, axis=1)
    valid = (candidates >= 0) & (candidates != points[:, None])
    valid[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    x = vectors[np.where(valid, candidates, 0)]
    p = vectors[points]
    far = ((x - p[:, None, :]) ** 2).sum(axis=2)
    far = np.where(valid, far, np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    pick = np.arange(b)[:, None]
    candidates, far, x = candidates[pick, order], far[pick, order], x[pick, order]
    norms = np.einsum("ijk,ijk->ij", x, x)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    alive = np.isfinite(far)
    out = np.full((b, degree), -1, dtype=np.int64)
    rows = np.arange(b)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        out[some, k] = candidates[rows, first][some]
        alive &= alpha * alpha * between[rows, first] > far
        alive[rows, first] = False
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges of each node (n: none), with one row more for the node that isn't there, and the start node."""
    n = len(vectors)
    graph = np.full((n + 1, degree), n, dtype=np.int64)
    start = int(np.argmin(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1)))
    order = np.random.default_rng(11).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at, size = 1, 16
    while at < n:
        batch = order[at : at + size]
        at, size = at + len(batch), min(2 * size, BATCH)
        _insert(vectors, graph, start, batch, degree, beam, alpha)
    return graph, start


def _insert(vectors: np.ndarray, graph: np.ndarray, start: int, batch: np.ndarray, degree: int, beam: int, alpha: float) -> None:
    n = len(vectors)
    passed, _ = beam_search(vectors, graph, start, vectors[batch], beam)
    # nodes of one batch don't see each other in the graph: the nearest of them are proposed too
    within = np.einsum("ij,ij->i", vectors[batch], vectors[batch])
    mutual = within[:, None] + within[None, :] - 2 * vectors[batch] @ vectors[batch].T
    np.fill_diagonal(mutual, np.inf)
    some = min(len(batch) - 1, degree // 2)
    if some > 0:
        passed = np.concatenate([passed, batch[np.argpartition(mutual, some - 1, axis=1)[:, :some]]], axis=1)
    kept = robust_prune(vectors, batch, passed, degree, alpha)
    graph[batch] = np.where(kept >= 0, kept, n)
    # the same edges backwards; nodes that get too many are pruned again
    to, from_ = kept.ravel(), np.repeat(batch, kept.shape[1])
    to, from_ = to[to >= 0], from_[to >= 0]
    order = np.argsort(to, kind="stable")
    to, from_ = to[order], from_[order]
    nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
    most = int(counts.max()) if len(counts) else 0
    if not most:
        return
    gained = np.full((len(nodes), most), -1, dtype=np.int64)
    gained[np.repeat(np.arange(len(nodes)), counts), np.arange(len(to)) - np.repeat(first, counts)] = from_
    had = np.where(graph[nodes] < n, graph[nodes], -1)
    both = np.concatenate([had, gained], axis=1)
    over = (both >= 0).sum(axis=1) > degree
    if over.any():
        for i in range(0, int(over.sum()), BATCH):
            some = np.flatnonzero(over)[i : i + BATCH]
            pruned = robust_prune(vectors, nodes[some], both[some], degree, alpha)
            graph[nodes[some]] = np.where(pruned >= 0, pruned, n)
    rest = np.flatnonzero(~over)
    packed = np.sort(np.where(both[rest] >= 0, both[rest], n), axis=1)[:, :degree]
    graph[nodes[rest], : packed.shape[1]] = packed


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0.0), F.lit(False))


def _index(nodes: DataFrame, spark_schema: str) -> DataFrame:
    def build(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        vectors = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        order = np.lexsort(vectors.T[::-1])  # whatever order the rows come in, the graph is the same
        vectors = np.ascontiguousarray(vectors[order])
        ids = group.column("ids").combine_chunks().take(pa.array(order))
        graph, start = build_graph(vectors.astype(np.float32))
        sizes = np.diff(ids.offsets.to_numpy())
        row = {"dim": dim, "shard": group.column("shard")[0].as_py(), "start": start, "vectors": vectors.tobytes(), "graph": graph.astype("<i4").tobytes(), "sizes": sizes.astype("<i4").tobytes(), "ids": ids.flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes()}
        types = [("dim", pa.int32()), ("shard", pa.int32()), ("start", pa.int32()), ("vectors", pa.binary()), ("graph", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())]
        return pa.Table.from_pylist([row], pa.schema(types))

    return nodes.groupBy("dim", "shard").applyInArrow(build, spark_schema)


def search(
    embeddings: DataFrame,
    is_query: Column,
    k: int = 10,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    search_beam: int = SEARCH_BEAM,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found of each query, its own left out.

    The score is the Euclidean distance in double precision; ties go to the smaller id. `is_query`
    says which rows are queries. Rows with a null id, or a vector that is null, zero or holds null
    or non-finite components, take no part, and vectors are compared with those of their own
    length. Rows that repeat an id and vector count once; an id with several vectors asks with the
    smallest, and is found by its nearest. An empty table gives no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    bound_arrow_batches(spark)
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & _usable(F.col("v")))
    # 0.0 and -0.0 are one value
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))

    first = Window.partitionBy("v").orderBy("id")
    few = rows.select("id", "v").withColumn("place", F.dense_rank().over(first)).filter(F.col("place") <= k + 1)
    nodes = few.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("dim", F.size("v"))
    nodes = durable(nodes)
    shards = {r["dim"]: -(-r["n"] // shard_rows) for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    per_dim = F.element_at(F.create_map(*(F.lit(x) for pair in shards.items() for x in pair)), F.col("dim"))
    # a shard is few bytes and much work: each gets a task of its own, up to MAX_TASKS of them
    tasks = min(MAX_TASKS, sum(shards.values()))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), per_dim).cast("int")).repartition(tasks, "dim", "shard")
    index = durable(_index(nodes, "dim int, shard int, start int, vectors binary, graph binary, sizes binary, ids binary"))

    asked = durable(rows.filter("asks").groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    blocks = -(-asked.count() // QUERY_ROWS) or 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        vectors = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        row = {"dim": dim, "ids": group.column("id").combine_chunks().to_numpy().astype("<i8").tobytes(), "vectors": vectors.tobytes()}
        return pa.Table.from_pylist([row], pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))

    packed = asked.groupBy("dim", "block").applyInArrow(pack, "dim int, ids binary, vectors binary")
    packed = packed.select(F.col("dim").alias("d"), F.explode(F.sequence(F.lit(0), (per_dim - 1).cast("int"))).alias("s"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    work = index.repartition(tasks, "dim", "shard").join(packed.repartition(tasks, "d", "s"), (F.col("dim") == F.col("d")) & (F.col("shard") == F.col("s"))).select("dim", "start", "vectors", "graph", "sizes", "ids", "query_ids", "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _answer({name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}, k, search_beam)

    found = work.mapInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answer(work: dict, k: int, search_beam: int) -> pa.RecordBatch:
    """The k best rows of one shard for each query of a block, measured in double precision."""
    dim = work["dim"]
    vectors = np.frombuffer(work["vectors"], dtype="<f8").reshape(-1, dim)
    graph = np.frombuffer(work["graph"], dtype="<i4").reshape(len(vectors) + 1, -1).astype(np.int64)
    ends = np.cumsum(np.frombuffer(work["sizes"], dtype="<i4"))
    ids = np.frombuffer(work["ids"], dtype="<i8")
    asking = np.frombuffer(work["query_ids"], dtype="<i8")
    queries = np.frombuffer(work["queries"], dtype="<f8").reshape(-1, dim)
    beam, _ = beam_search(vectors.astype(np.float32), graph, work["start"], queries.astype(np.float32), max(search_beam, 2 * k))
    out_q, out_v, out_s = [], [], []
    for q, (query_id, nodes) in enumerate(zip(asking.tolist(), beam, strict=True)):
        nodes = nodes[nodes >= 0]
        score = np.sqrt(((vectors[nodes] - queries[q]) ** 2).sum(axis=1))
        near = np.argsort(score, kind="stable")[: k + 1]
        cut = score[near[-1]]
        pairs = sorted((s, v) for s, node in zip(score.tolist(), nodes.tolist(), strict=True) if s <= cut for v in ids[(ends[node - 1] if node else 0) : ends[node]].tolist() if v != query_id)[:k]
        out_q += [query_id] * len(pairs)
        out_v += [v for _, v in pairs]
        out_s += [s for s, _ in pairs]
    return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], ["query_id", "vec_id", "score"])
