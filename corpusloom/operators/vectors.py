"""Exact vector search and vector arithmetic.

Both sides are packed into blocks of rows, every pair of blocks is one matrix product in Arrow
batches, and only what is asked for of it (the k best, a count) leaves the worker. Nothing is
broadcast, so neither side has to fit anywhere but a block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.runtime import bound_arrow_batches

BLOCK = 2048
#: Candidates that a task of a search holds at once.
HELD_BYTES = 32 << 20
#: Similarities are compared after rounding to so many places, so that their order doesn't depend on how sums were made.
PLACES = 9
ZERO = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def unit(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(ZERO))
    return F.transform(F.array(n), lambda m: F.transform(v, lambda x: x.cast("double") / m))[0]


def _packed(rows: DataFrame, blocks: int, prefix: str, same_group: bool) -> DataFrame:
    """One row per block: ids, groups, bounds and unit vectors as bytes. rows: id, grp (long or null), v and own, a number."""
    def pack(group: pa.Table) -> pa.Table:
        lists = group.column("v").combine_chunks()
        v = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
        v = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), ZERO)
        as_bytes = lambda name, kind: group.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(kind).tobytes()
        row = {"pool": group.column("pool")[0].as_py(), "block": group.column("block")[0].as_py(), "ids": as_bytes("id", "<i8"), "groups": as_bytes("grp", "<i8"), "own": as_bytes("own", "<f8"), "vectors": v.tobytes()}
        types = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
        return pa.table({prefix + name: pa.array([x], t) for (name, x), t in zip(row.items(), types, strict=True)})

    own = F.col("own") if "own" in rows.columns else F.lit(0.0)
    grp = F.coalesce("grp", F.lit(-1).cast("long"))
    dealt = rows.select("id", grp.alias("grp"), own.cast("double").alias("own"), F.col("v").cast("array<double>").alias("v"))
    dealt = dealt.withColumn("pool", F.col("grp") if same_group else F.lit(0).cast("long")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    schema = ", ".join(f"{prefix}{c}" for c in ("pool long", "block int", "ids binary", "groups binary", "own binary", "vectors binary"))
    return dealt.groupBy("pool", "block").applyInArrow(pack, schema)


def block_pairs(queries: DataFrame, candidates: DataFrame, answer: Callable, schema: str, names: list[str], *, same_group: bool = False) -> DataFrame:
    """Rows of `answer(query ids, query groups, bounds, candidate ids, candidate groups, similarities)` over all
    block pairs; with `same_group`, over those within a group alone."""
    bound_arrow_batches(queries.sparkSession)
    nq, nc = (max(1, -(-x.count() // BLOCK)) for x in (queries, candidates))
    a = _packed(queries, nq, "q", same_group)
    b = _packed(candidates, nc, "c", same_group)
    # packed rows are far larger than Spark takes them to be, and would be broadcast through the driver
    b = b.hint("merge")
    if same_group:
        both = a.join(b, F.col("qpool") == F.col("cpool"))
    else:
        both = a.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(nc - 1)))).join(b, F.col("to") == F.col("cblock"))
    both = both.select("qids", "qgroups", "qown", "qvectors", "cids", "cgroups", "cvectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qi, qg, own, qv, ci, cg, cv = (batch.column(j)[i].as_py() for j in range(7))
                qi, qg, ci, cg = (np.frombuffer(x, dtype="<i8") for x in (qi, qg, ci, cg))
                qv, cv = (np.frombuffer(x, dtype="<f8").reshape(n, -1) for x, n in ((qv, len(qi)), (cv, len(ci))))
                columns = answer(qi, qg, np.frombuffer(own, dtype="<f8"), ci, cg, np.round(qv @ cv.T, PLACES))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return both.mapInArrow(run, schema)


def _better(best: tuple | None, qi: np.ndarray, ci: np.ndarray, cg: np.ndarray, sim: np.ndarray, k: int) -> tuple:
    """The k best so far of each query after one more block: query ids, rows, ids, groups, similarities and each row's k-th best.

    ci goes up; -inf is no candidate. Of a row's equal similarities at the bound only the smallest ids are taken,
    so that a block never gives more than k a row.
    """
    floor = np.full(len(qi), -np.inf) if best is None else best[5]
    mask = (sim >= floor[:, None]) & (sim > -np.inf)
    if np.count_nonzero(mask) > 4 * k * len(qi) and k < len(ci):
        bound = np.partition(sim, len(ci) - k, axis=1)[:, len(ci) - k]
        above, level = sim > bound[:, None], sim == bound[:, None]
        room = k - above.sum(axis=1)
        crowded = np.flatnonzero(level.sum(axis=1) > room)
        level[crowded] &= np.cumsum(level[crowded], axis=1, dtype=np.int32) <= room[crowded, None]
        mask &= above | level
    rows, cols = np.nonzero(mask)
    ids, groups, scores = ci[cols], cg[cols], sim[rows, cols]
    if best is not None:
        rows, ids, groups, scores = (np.concatenate(x) for x in zip(best[1:5], (rows, ids, groups, scores), strict=True))
    order = np.lexsort((ids, -scores, rows))
    rows, ids, groups, scores = rows[order], ids[order], groups[order], scores[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    floor = np.full(len(qi), -np.inf)
    floor[rows[place == k - 1]] = scores[place == k - 1]
    kept = place < k
    rows = rows[kept]
    return qi[rows], rows, ids[kept], groups[kept], scores[kept], floor


def top_k(queries: DataFrame, candidates: DataFrame, k: int, *, not_self: bool = True, other_group: bool = False) -> DataFrame:
    """query_id, rank, id, grp, score: the k most similar candidates by cosine, ties to the smaller id.

    Both sides: id, grp, v (null groups allowed). Zero vectors are neither found nor answered. With
    `other_group`, candidates of the query's own group are left out before the ranking.

    A task holds HELD_BYTES of candidates and goes through them a block at a time for each block of queries;
    the k best so far of each query are all that it keeps and passes on.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                block, qi, qg, qv, ci, cg, cv = (batch.column(j)[i].as_py() for j in range(7))
                qi, qg, ci, cg = (np.frombuffer(x, dtype="<i8") for x in (qi, qg, ci, cg))
                qv, cv = (np.frombuffer(x, dtype="<f8").reshape(n, -1) for x, n in ((qv, len(qi)), (cv, len(ci))))
                order = np.argsort(ci, kind="stable")
                ci, cg = ci[order], cg[order]
                sim = np.round(qv @ cv[order].T, PLACES)
                sim[~np.isfinite(sim)] = -np.inf
                if not_self:
                    sim[qi[:, None] == ci[None, :]] = -np.inf
                if other_group:
                    sim[qg[:, None] == cg[None, :]] = -np.inf
                if block != at:
                    if best is not None:
                        yield named(*best)
                    at, best = block, None
                best = _better(best, qi, ci, cg, sim, k)
        if best is not None:
            yield named(*best)

    def named(queries, _, ids, groups, scores, __):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (queries, ids, groups, scores)], ["query_id", "id", "grp", "score"])

    some = norm(F.col("v")) > 0
    queries, candidates = queries.filter(some), candidates.filter(some)
    bound_arrow_batches(queries.sparkSession)
    nq = max(1, -(-queries.count() // BLOCK))
    size = candidates.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    nc = max(1, -(-size["n"] // BLOCK))
    groups = -(-nc // max(1, HELD_BYTES // (BLOCK * size["d"] * 8)))
    # a cross join of partitions: blocks are written once and read by each task that needs them, so that disk grows with the rows, not with their pairs
    a = _packed(queries, nq, "q", False).repartition(nq)
    b = _packed(candidates, nc, "c", False).repartition(groups).hint("shuffle_replicate_nl")
    found = a.crossJoin(b).select("qblock", "qids", "qgroups", "qvectors", "cids", "cgroups", "cvectors").mapInArrow(run, "query_id long, id long, grp long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "grp", "score")


def best_per_group(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, grp, id, score: the most similar candidate of each group for each query, ties to the smaller id.

    One pass over the blocks; a block gives one row per query and group. Zero vectors take no part.
    """
    def answer(qi, _, own, ci, cg, sim):
        order = np.lexsort((ci, cg))
        groups, first = np.unique(cg[order], return_index=True)
        best = [a + sim[:, order[a:b]].argmax(axis=1) for a, b in zip(first, [*first[1:], len(order)], strict=True)]
        cols = order[np.concatenate(best)]
        rows = np.tile(np.arange(len(qi)), len(groups))
        return qi[rows], np.repeat(groups, len(qi)), ci[cols], sim[rows, cols]

    some = norm(F.col("v")) > 0
    found = block_pairs(queries.filter(some), candidates.filter(some), answer, "query_id long, grp long, id long, score double", ["query_id", "grp", "id", "score"])
    best = found.groupBy("query_id", "grp").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("b"))
    return best.select("query_id", "grp", (-F.col("b.minus")).alias("id"), F.col("b.score").alias("score"))


def pessimistic_ranks(queries: DataFrame, candidates: DataFrame, *, mask_same_text: bool = False, same_group: bool = False) -> DataFrame:
    """query_id, rank (from 0): how many other candidates are at least as similar as the own positive.

    queries: id, grp, v and own (the similarity to its positive). With `mask_same_text`, a candidate
    with the query's id is its own text and counts only if it is the positive. With `same_group`,
    candidates of another group are no candidates. A pair of blocks gives one count per query.
    """
    def answer(qi, _, own, ci, cg, sim):
        above = sim >= own[:, None]
        if mask_same_text:
            above &= qi[:, None] != ci[None, :]
        return qi, above.sum(axis=1)

    rows = queries.select("id", "grp", "v", F.round("own", PLACES).alias("own"))
    counted = block_pairs(rows, candidates, answer, "query_id long, n long", ["query_id", "n"], same_group=same_group)
    return counted.groupBy("query_id").agg((F.sum("n") - 1).alias("rank"))


def mean_pool(tokens: DataFrame, vectors: DataFrame, weight: Column | None = None) -> DataFrame:
    """doc_id, v: (weighted) mean of the vectors of a document's known tokens; none known: no row.

    Tokens are counted by document first; a task adds up the vectors of each document it has and passes on
    one sum for each.
    """
    w = F.lit(1.0) if weight is None else weight
    counts = tokens.repartition("doc_id").groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    joined = counts.join(vectors, "token").select(F.col("doc_id").cast("long").alias("doc_id"), "n", w.cast("double").alias("w"), F.col("v").cast("array<double>").alias("v"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                docs, n, weights = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                v = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(docs), -1) * (n * weights)[:, None]
                order = np.argsort(docs, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], docs[order][1:] != docs[order][:-1]]))
                sums = np.add.reduceat(v[order], first, axis=0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(docs[order][first]), pa.array(np.add.reduceat(n[order], first)), lists], ["doc_id", "n", "v"])

    bound_arrow_batches(tokens.sparkSession)
    sums = joined.mapInArrow(add, "doc_id long, n long, v array<double>").groupBy("doc_id").agg(F.sum("n").alias("n"), F.collect_list("v").alias("parts"))
    total = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.col("parts")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return sums.select("doc_id", F.transform(total, lambda x: x / F.col("n")).alias("v"))


def sif_weight(frequency: Column, total: Column, alpha: float = 1e-3) -> Column:
    return alpha / (alpha + frequency / total)


def gram(rows: DataFrame, centred: bool) -> np.ndarray:
    """The d x d matrix of sums of products (of the centred rows), summed where the rows are."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                one = np.column_stack([np.ones(len(v)), v])
                total = one.T @ one if total is None else total + one.T @ one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = rows.select(F.col("v").cast("array<double>").alias("v")).mapInArrow(partial, "m binary").collect()  # one matrix per task
    if not parts:
        return np.zeros((0, 0))
    m = sum(np.frombuffer(p["m"]) for p in parts)
    m = m.reshape(int(np.sqrt(len(m))), -1)
    n, sums, products = m[0, 0], m[0, 1:], m[1:, 1:]
    return products - np.outer(sums, sums) / n if centred else products


def spectrum(rows: DataFrame, share: float = 0.95) -> dict[str, float]:
    """isotropy (smallest over largest singular value) and dimensions that hold a share of the variance."""
    g = gram(rows, centred=True)
    if not len(g):
        return {"isotropy": 0.0, "effective_dimensions": 0.0}
    values = np.clip(np.linalg.eigvalsh(g)[::-1], 0, None)
    total = values.sum()
    dims = int(np.searchsorted(np.cumsum(values) / total, share) + 1) if total > 0 else 0
    return {"isotropy": float(np.sqrt(values[-1] / values[0])) if values[0] > 0 else 0.0, "effective_dimensions": float(dims)}


def mean_pairwise_similarity(rows: DataFrame) -> DataFrame:
    """mean_similarity, pairs: mean cosine over all pairs of vectors that aren't zero, in one pass.

    The squared length of the sum of n unit vectors is n and twice the sum over pairs.
    """
    some = rows.filter(norm(F.col("v")) > 0).select(unit(F.col("v")).alias("v"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                sums = v.sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows] * len(sums)), pa.array(np.arange(len(sums))), pa.array(sums)], ["n", "d", "x"])

    sums = some.mapInArrow(add, "n long, d long, x double").groupBy("d").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = sums.agg(F.max("n").alias("n"), F.sum(F.col("x") * F.col("x")).alias("length"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return out.select(((F.col("length") - F.col("n")) / 2 / F.nullif(pairs, F.lit(0.0))).alias("mean_similarity"), F.coalesce(pairs, F.lit(0)).cast("long").alias("pairs"))


def remove_common_direction(rows: DataFrame) -> DataFrame:
    """Vectors without their part along the leading direction of all of them (two or more, else as they are)."""
    some = rows.filter(norm(F.col("v")) > 0)
    if some.limit(2).count() < 2:
        return rows
    _, vectors = np.linalg.eigh(gram(some, centred=False))
    direction = F.array(*(F.lit(float(x)) for x in vectors[:, -1]))
    return rows.withColumn("v", F.transform(F.array(dot(F.col("v"), direction)), lambda d: F.zip_with("v", direction, lambda x, y: x - d * y))[0])


def analogy(vectors: DataFrame, questions: DataFrame, k: int = 1) -> DataFrame:
    """Answers of a : b = c : ? by unit(b) - unit(a) + unit(c); the three themselves are no answers.

    vectors: id, grp, v; questions: question_id, a, b, c (ids).
    """
    units = vectors.select("id", unit(F.col("v")).alias("u"))
    side = lambda name: units.select(F.col("id").alias(name), F.col("u").alias(f"u_{name}"))
    q = questions.join(side("a"), "a").join(side("b"), "b").join(side("c"), "c")
    mixed = F.zip_with(F.zip_with("u_b", "u_a", lambda x, y: x - y), F.col("u_c"), lambda x, y: x + y)
    q = q.withColumn("v", mixed)
    found = top_k(q.select(F.col("question_id").alias("id"), F.lit(None).cast("long").alias("grp"), "v"), vectors, k + 3, not_self=False)
    found = found.join(questions.select(F.col("question_id").alias("query_id"), "a", "b", "c"), "query_id").filter((F.col("id") != F.col("a")) & (F.col("id") != F.col("b")) & (F.col("id") != F.col("c")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("query_id").alias("question_id"), "rank", "id", "score")


def hard_negatives(pairs: DataFrame, *, count: int = 4, pool: int = 32, maximum: float = 0.95, minimum: float = 0.0, margin: float | None = None) -> DataFrame:
    """Every near candidate of each anchor with what became of it.

    pairs: id, document (long), anchor (vector), positive (vector). Candidates are all positives. For
    each anchor the pool + 1 nearest are walked in order of similarity until `count` are accepted or
    one is too easy: its own positive, of the same document, too similar, not below its own positive
    by the margin, too easy, accepted. Columns: id, rank, candidate, score, own, reason, kept.
    """
    queries = pairs.select("id", F.col("document").alias("grp"), F.col("anchor").alias("v"))
    candidates = pairs.select("id", F.col("document").alias("grp"), F.col("positive").alias("v"))
    own = pairs.select(F.col("id").alias("query_id"), F.col("document"), F.round(cosine(F.col("anchor"), F.col("positive")), PLACES).alias("own"))
    near = top_k(queries, candidates, pool + 1, not_self=False).join(own, "query_id")
    reason = F.when(F.col("id") == F.col("query_id"), "own_positive").when(F.col("grp") == F.col("document"), "same_document").when(F.col("score") >= maximum, "too_similar")
    if margin is not None:
        reason = reason.when(F.col("score") >= F.col("own") - margin, "within_margin")
    reason = reason.when(F.col("score") <= minimum, "too_easy")
    near = near.withColumn("reason", F.coalesce(reason, F.lit("accepted")))
    order = Window.partitionBy("query_id").orderBy("rank")
    near = near.withColumn("taken", F.count_if(F.col("reason") == "accepted").over(order)).withColumn("ended", F.count_if(F.col("reason") == "too_easy").over(order))
    walked = (F.col("taken") - (F.col("reason") == "accepted").cast("int") < count) & (F.col("ended") - (F.col("reason") == "too_easy").cast("int") == 0)
    return near.filter(walked).select(F.col("query_id").alias("id"), "rank", F.col("id").alias("candidate"), "score", "own", "reason")


def negative_statistics(walked: DataFrame) -> DataFrame:
    """reason, n, mean_score, and of the accepted ones the share that outranks the own positive."""
    suspicious = F.avg(F.when(F.col("reason") == "accepted", (F.col("score") > F.col("own")).cast("double")))
    return walked.groupBy("reason").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), suspicious.alias("suspicion_rate"))
