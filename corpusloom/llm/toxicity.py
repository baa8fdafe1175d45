"""Toxicity by a factorization machine over hashed terms.

The model is fitted in one worker on a bounded sample of the labelled training rows. All terms that are frequent
enough in the sample, whatever their labels, go into the machine: a term may say nothing alone and
all beside another (an insult beside the mention of a group). Linear weights and, through factors,
weights for pairs of terms are learned together; both shrink towards zero, a term's factors as a
whole, so that of the many terms that say nothing none is left. A few last rounds without the shrinking
settle the weights that remain. The model holds these alone and travels in the closure of the scorer.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import bound_arrow_batches, durable

#: Rows of each label that the model is fitted on at most: the bound of what goes to the driver.
SAMPLE_PER_LABEL = 8_000
#: A term counts from this share of the sample's rows on, and from so many rows.
MIN_SHARE, MIN_ROWS = 0.002, 4
FACTORS, BATCH, RATE, PAIR_RATE = 8, 128, 0.2, 0.06
#: Rounds with and without shrinking, and before the first terms are left out; how much linear weights and factors shrink; the least linear weight that is kept.
ROUNDS, LAST_ROUNDS, SETTLED, SHRINK, SHRINK_PAIRS, LEAST = 20, 5, 6, 3e-4, 5e-3, 0.2
#: Lengths of the beginnings that count as terms beside whole words.
STEMS = (5, 7)
#: Spread of the factors at the start.
SPREAD = 0.05
NO_MODEL_SCORE = 0.0

_TERM = re.compile(r"[^\W\d_]+")


def hashed_terms(text: str) -> set[int]:
    """Distinct terms of the whole text, hashed: its words, and the beginnings that words share."""
    digest = xxhash.xxh32_intdigest
    words = set(_TERM.findall(text.lower()))
    begun = {w[:n] for n in STEMS for w in words if len(w) > n}
    return {digest(w) for w in words} | {digest(b, 1) for b in begun}


@dataclass
class Machine:
    terms: dict[int, int] = field(default_factory=dict)  # hashed term -> row of the weights
    intercept: float = 0.0
    linear: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))
    trained: bool = False

    def score(self, text: str) -> float:
        if not self.trained:
            return NO_MODEL_SCORE
        known = [self.terms[t] for t in hashed_terms(text) & self.terms.keys()]
        z = self.intercept
        if known:
            v = self.factors[known]
            z += float(self.linear[known].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum()))
        return 1.0 / (1.0 + math.exp(-min(max(z, -30.0), 30.0)))


def in_training(id_col: str) -> F.Column:
    """Rows whose labels may be learned from: crc32 of the id as text, modulo 5, isn't 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Learn from the training rows of `labels` (id, 0/1); rows with a null id or label teach nothing.

    Of each label, the SAMPLE_PER_LABEL rows with the smallest hash of their id are learned from; the
    shares of the labels are counted over all training rows. Null texts count as empty; repeated rows
    teach once each. Without rows of both labels there is no model, and every score is NO_MODEL_SCORE.
    """
    bound_arrow_batches(docs.sparkSession)
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter(f"id is not null and y in (0, 1) and {_training_sql('id')}")
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Machine()
    sample = [r for y in (0, 1) for r in usable.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_LABEL).collect()]
    spark = docs.sparkSession
    # 2 * SAMPLE_PER_LABEL rows at most; as a table, since a list would start Python workers of another kind on the executors
    chosen = spark.createDataFrame(pa.table({"id": pa.array([r["id"] for r in sample], pa.int64()), "y": pa.array([r["y"] for r in sample], pa.int32())}))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = durable(texts.join(F.broadcast(chosen), "id").select("y", "text"))
    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Machine()
    terms = frequent_terms(texts, max(MIN_ROWS, math.ceil(MIN_SHARE * sum(sizes.values()))))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [np.array(sorted(hashed_terms(t) & terms), dtype="<u4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known, type=pa.binary())], ["y", "terms"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((y, t) for batch in batches for y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = train([np.frombuffer(t, dtype="<u4") for _, t in rows], np.array([y for y, _ in rows], dtype=np.float64), counts)
        parts = [np.array(list(found.terms), dtype="<u4"), np.array([found.intercept]), found.linear, found.factors]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["terms", "intercept", "linear", "factors"])

    # one worker learns, from 2 * SAMPLE_PER_LABEL rows at most; the weights that are left come here
    learned = texts.mapInArrow(extract, "y int, terms binary").repartition(1).mapInArrow(learn, "terms binary, intercept binary, linear binary, factors binary").first()
    kept = np.frombuffer(learned["terms"], dtype="<u4")
    linear, factors = np.frombuffer(learned["linear"]), np.frombuffer(learned["factors"]).reshape(-1, FACTORS)
    return Machine({int(t): i for i, t in enumerate(kept)}, float(np.frombuffer(learned["intercept"])[0]), linear, factors, True)


def frequent_terms(texts: DataFrame, least: int) -> set[int]:
    """Terms of so many rows of the sample (y, text) at least. Counted where the texts are; only those go to the
    driver, and there are no more than the terms of a row on average over MIN_SHARE."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.fromiter(hashed_terms(t), dtype=np.int64) for t in batch.column(1).to_pylist()]
            if found:
                terms, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n)], ["term", "n"])

    counted = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return {r["term"] for r in counted.select("term").collect()}


def _training_sql(name: str) -> str:
    return f"crc32(cast(cast({name} as string) as binary)) % 5 != 0"


def train(rows: list[np.ndarray], y: np.ndarray, counts: dict[int, int]) -> Machine:
    """Fit on rows of distinct hashed terms; `counts` has how many rows of each label there are in all."""
    n1 = int(y.sum())
    n0 = len(y) - n1
    if not n0 or not n1:
        return Machine()
    begin = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    column = np.concatenate([np.zeros(0, "<u4"), *rows])
    terms = np.unique(column)
    column = np.searchsorted(terms, column).astype(np.int32)

    random = np.random.default_rng(7)
    w, v, w0 = np.zeros(len(terms)), random.normal(0, SPREAD, (len(terms), FACTORS)), math.log(n1 / n0)
    gw, gv, g0 = np.full(len(terms), 1e-6), np.full((len(terms), 1), 1e-6), 1e-2
    shrink, shrink_pairs = SHRINK, SHRINK_PAIRS
    for turn in range(ROUNDS + LAST_ROUNDS):
        if turn >= SETTLED:  # terms whose weights are zero by now are left out, in the end those with little too
            w = np.where(np.abs(w) >= (LEAST if turn == ROUNDS else 0.0), w, 0.0)
            left = (w != 0) | (v != 0).any(axis=1)
            place = np.cumsum(left) - 1
            begin, column = np.concatenate([[0], np.cumsum(left[column])])[begin], place[column[left[column]]]
            terms, w, v, gw, gv = terms[left], w[left], v[left], gw[left], gv[left]
        if turn == ROUNDS:
            shrink = shrink_pairs = 0.0
            linear, paired = w != 0, (v != 0).any(axis=1, keepdims=True)
        order = random.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            batch = order[at : at + BATCH]
            sizes = begin[batch + 1] - begin[batch]
            ids = column[np.repeat(begin[batch] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]
            who = np.repeat(np.arange(len(batch)), sizes)
            own = v[ids]
            sums = np.stack([np.bincount(who, weights=own[:, k], minlength=len(batch)) for k in range(FACTORS)], axis=1)
            squares = np.bincount(who, weights=(own * own).sum(1), minlength=len(batch))
            z = np.clip(w0 + np.bincount(who, weights=w[ids], minlength=len(batch)) + 0.5 * ((sums**2).sum(1) - squares), -30, 30)
            error = (1 / (1 + np.exp(-z)) - y[batch]) / len(batch)
            g0 += error.sum() ** 2
            w0 -= RATE * error.sum() / math.sqrt(g0)
            step = np.bincount(ids, weights=error[who], minlength=len(w))
            gw += step * step
            rate = RATE / (np.sqrt(gw) + 1e-3)
            pull = error[who, None] * (sums[who] - own)
            pair = np.stack([np.bincount(ids, weights=pull[:, k], minlength=len(w)) for k in range(FACTORS)], axis=1)
            gv += (pair * pair).sum(axis=1, keepdims=True)
            pair_rate = PAIR_RATE / (np.sqrt(gv) + 1e-3)
            if turn < ROUNDS:
                w = w - rate * step
                w = np.sign(w) * np.maximum(np.abs(w) - rate * shrink, 0)
                v = v - pair_rate * pair
                v *= np.maximum(0, 1 - pair_rate * shrink_pairs / (np.sqrt((v * v).sum(axis=1, keepdims=True)) + 1e-12))
            else:
                w = w - rate * step * linear
                v = v - pair_rate * pair * paired
    # the sample has the labels in other shares than the table
    w0 += math.log(counts[1] / counts[0]) - math.log(n1 / n0)
    return Machine({int(t): i for i, t in enumerate(terms)}, w0, w, v, True)


def scorer(machine: Machine):
    """Column function: score of a text column, 0 to 1; null counts as empty."""

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([machine.score(t or "") for t in texts.to_pylist()], pa.float64())

    return score


def score_documents(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    Null and empty texts get the score of a text without known terms; null ids stay (they count as
    the empty text in held_out); repeated rows give a row each; an empty table gives no rows; other
    columns are ignored.
    """
    bound_arrow_batches(docs.sparkSession)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), (~in_training(id_col)).alias("held_out"), scorer(machine)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, machine: Machine, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with all their columns.

    Null and empty texts get the score of a text without known terms; null ids and repeated rows are
    judged like any other; an empty table gives no rows.
    """
    bound_arrow_batches(docs.sparkSession)
    return docs.filter(scorer(machine)(F.col(text_col)) < threshold)
