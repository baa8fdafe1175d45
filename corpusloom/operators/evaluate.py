"""Retrieval evaluation: metrics of ranks, facets in one pass, language separation, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Z = 1.96


def scores(rank: str = "rank") -> list[Column]:
    """Aggregates of ranks from 0: recall at 1, 5 and 10, MRR, nDCG at 10 with one right answer."""
    r = F.col(rank)
    return [
        F.count("*").alias("queries"),
        *(F.avg((r < k).cast("double")).alias(f"recall_at_{k}") for k in (1, 5, 10)),
        F.avg(1 / (r + 1)).alias("mrr"),
        F.avg(F.when(r < 10, 1 / F.log2(r + 2)).otherwise(0.0)).alias("ndcg_at_10"),
    ]


def report(ranks: DataFrame, *facets: str) -> DataFrame:
    """facet, value and the scores: overall (facet `all`) and by each facet, null values left out.

    One pass over the ranks: every row is counted once for each grouping set.
    """
    sets = [[], *([F.col(f)] for f in facets)]
    out = ranks.groupingSets(sets, *(F.col(f) for f in facets)).agg(F.grouping_id().alias("g"), *scores())
    n = len(facets)
    facet, value = F.lit("all"), F.lit(None).cast("string")
    for i, f in enumerate(facets):
        mask = ((1 << n) - 1) ^ (1 << (n - 1 - i))
        facet = F.when(F.col("g") == mask, F.lit(f)).otherwise(facet)
        value = F.when(F.col("g") == mask, F.col(f).cast("string")).otherwise(value)
    out = out.withColumn("facet", facet).withColumn("value", value).filter((F.col("facet") == "all") | F.col("value").isNotNull())
    return out.select("facet", "value", "queries", "recall_at_1", "recall_at_5", "recall_at_10", "mrr", "ndcg_at_10")


def wilson(p: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of a share p of n."""
    centre = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    spread = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    return F.greatest(F.lit(0.0), centre - spread), F.least(F.lit(1.0), centre + spread)


def lift(recall: Column, candidates: Column) -> Column:
    """Recall at 1 over that of chance."""
    return recall * candidates


def language_separation(near: DataFrame, queries: DataFrame) -> DataFrame:
    """queries, observed, expected, ratio: how much more often than by chance the nearest wrong
    candidates are in the query's own language.

    near: query_id, grp (the candidate's language) of the nearest wrong candidates; queries: id, asked,
    found (languages of the query and of its positive).
    """
    pool = queries.groupBy(F.col("found").alias("language")).agg(F.count("*").alias("in_pool"))
    total = queries.agg(F.count("*").alias("total"))
    own = near.join(queries.select(F.col("id").alias("query_id"), "asked", "found"), "query_id")
    share = own.groupBy("query_id", "asked", "found").agg(F.avg((F.col("grp") == F.col("asked")).cast("double")).alias("share"))
    both = share.join(pool, F.col("asked") == F.col("language")).join(F.broadcast(total))
    chance = (F.col("in_pool") - (F.col("found") == F.col("asked")).cast("int")) / (F.col("total") - 1)
    out = both.agg(F.count("*").alias("queries"), F.avg("share").alias("observed"), F.avg(chance).alias("expected"))
    return out.withColumn("ratio", F.col("observed") / F.nullif(F.col("expected"), F.lit(0.0)))


def rank_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query: precision, recall, F1 at k, average precision, reciprocal rank, nDCG at k.

    ranked: query_id, rank (from 1), hit (0/1); relevant: query_id, n. Precision divides by k even if
    fewer were found; average precision by the number of relevant ones.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = ranked.withColumn("hits", F.sum("hit").over(order))
    within = F.col("rank") <= k
    out = rows.groupBy("query_id").agg(
        F.sum(F.when(within, F.col("hit")).otherwise(0)).alias("h"),
        F.sum(F.col("hit") * F.col("hits") / F.col("rank")).alias("ap"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(within, F.col("hit") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    out = out.join(relevant, "query_id")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    p, r = F.col("h") / k, F.coalesce(F.col("h") / F.nullif(F.col("n"), F.lit(0).cast("long")), F.lit(0.0))
    return out.select(
        "query_id",
        p.alias("precision"),
        r.alias("recall"),
        F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"),
        F.coalesce(F.col("ap") / F.nullif(F.col("n"), F.lit(0).cast("long")), F.lit(0.0)).alias("average_precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
    )


def accuracy(rows: DataFrame, predicted: str, expected: str) -> DataFrame:
    """n and the share of rows whose prediction is right; 0 without rows. Two nulls are equal."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col(predicted).eqNullSafe(F.col(expected)).cast("double")), F.lit(0.0)).alias("accuracy"))


def similarity_correlation(vectors: DataFrame, judged: DataFrame) -> DataFrame:
    """scored, correlation, coverage: Spearman of cosines with judged scores, over the pairs whose words are both known.

    vectors: word, v; judged: word_a, word_b, score. Fewer than two scored pairs have correlation 0.
    """
    from corpusloom.operators.vectors import PLACES, cosine

    side = lambda name: vectors.select(F.col("word").alias(f"word_{name}"), F.col("v").alias(f"v_{name}"))
    known = judged.join(side("a"), "word_a").join(side("b"), "word_b").select(F.round(cosine(F.col("v_a"), F.col("v_b")), PLACES).alias("cosine"), F.col("score").cast("double").alias("score"))
    asked = judged.agg(F.count("*").alias("asked"))
    return spearman(known, "cosine", "score").join(F.broadcast(asked)).select(F.col("n").alias("scored"), F.when(F.col("n") < 2, 0.0).otherwise(F.col("r")).alias("correlation"), F.coalesce(F.col("n") / F.nullif(F.col("asked"), F.lit(0).cast("long")), F.lit(0.0)).alias("coverage"))


def analogy_accuracy(vectors: DataFrame, questions: DataFrame) -> DataFrame:
    """attempted, accuracy, coverage of a : b = c : expected, over the questions whose words are all known.

    vectors: id, grp, v; questions: question_id, a, b, c, expected (ids).
    """
    from corpusloom.operators.vectors import analogy

    ids = vectors.select("id")
    known = questions
    for name in ("a", "b", "c", "expected"):
        known = known.join(ids.withColumnRenamed("id", name), name, "left_semi")
    best = analogy(vectors, known.select("question_id", "a", "b", "c"), 1).select("question_id", "id")
    right = known.select("question_id", "expected").join(best, "question_id", "left")
    asked = questions.agg(F.count("*").alias("asked"))
    out = accuracy(right, "id", "expected").join(F.broadcast(asked))
    return out.select(F.col("n").alias("attempted"), "accuracy", F.coalesce(F.col("n") / F.nullif(F.col("asked"), F.lit(0).cast("long")), F.lit(0.0)).alias("coverage"))


def average_ranks(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Ranks with ties averaged, from counts of distinct values: a running sum over those, not over rows."""
    from corpusloom.plans.ledger import numbered

    counts = numbered(rows.groupBy(column).agg(F.count("*").alias("c")), [F.col(column)], "place")
    bucket = counts.withColumn("range", F.floor(F.col("place") / 4096))
    sums = bucket.groupBy("range").agg(F.sum("c").alias("s"))
    shift = sums.select(F.col("range").alias("r")).join(sums, F.col("range") < F.col("r")).groupBy("r").agg(F.sum("s").alias("shift"))
    running = bucket.withColumn("upto", F.sum("c").over(Window.partitionBy("range").orderBy("place"))).join(shift, F.col("range") == F.col("r"), "left")
    placed = running.select(F.col(column).alias("__value"), (F.col("upto") + F.coalesce("shift", F.lit(0)) - (F.col("c") - 1) / 2).alias(out))
    return rows.join(placed, F.col(column) == F.col("__value")).drop("__value")


def pearson(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n and the correlation, 0 where it isn't defined."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    r = F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    return rows.agg(F.count("*").alias("n"), F.coalesce(r, F.lit(0.0)).alias("r"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    return pearson(average_ranks(average_ranks(rows, a, "__ra"), b, "__rb"), "__ra", "__rb")


def deltas(before: DataFrame, after: DataFrame, key: str, *metrics: str) -> DataFrame:
    """Before, after, difference, relative difference and whether it helped, of each metric."""
    both = before.select(key, *(F.col(m).alias(f"{m}_before") for m in metrics)).join(after.select(key, *(F.col(m).alias(f"{m}_after") for m in metrics)), key)
    out = [F.col(key)]
    for m in metrics:
        a, b = F.col(f"{m}_before"), F.col(f"{m}_after")
        out += [a, b, (b - a).alias(f"{m}_difference"), ((b - a) / F.nullif(a, F.lit(0.0))).alias(f"{m}_relative"), (b > a).alias(f"{m}_helped")]
    return both.select(*out)


def language_matrix(answers: DataFrame) -> DataFrame:
    """Accuracy of each ordered pair of languages, from rows of asked, found, hit."""
    return answers.groupBy("asked", "found").agg(F.count("*").alias("queries"), F.avg(F.col("hit").cast("double")).alias("accuracy"))
