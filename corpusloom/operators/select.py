"""Deterministic sampling, splitting, blending and capped selection.

Order comes from a hash of a seed and a row's key, so that results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_order(key: Column, seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"), 256)


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows (all, if fewer), uniformly by hash; each task passes on its n smallest only."""
    return rows.withColumn("__h", hash_order(F.col(key), seed)).orderBy("__h", key).limit(n).drop("__h")


def split(rows: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Adds `part`: train for the round(n * fraction) rows that come first by hash (1 to n - 1 of them), else test.

    The pivot's hash is looked up once, so rows are judged where they are.
    """
    hashed = rows.withColumn("__h", hash_order(F.col(key), seed))
    n = hashed.count()
    if not n:
        return rows.withColumn("part", F.lit("train"))
    pivot = max(1, min(n - 1, round(n * fraction)))
    from corpusloom.plans.ledger import numbered

    last = numbered(hashed.select("__h", key), [F.col("__h"), F.col(key)], "__n").filter(F.col("__n") == pivot).select(F.col("__h").alias("h"), F.col(key).alias("k")).first()
    before = (F.col("__h") < last["h"]) | ((F.col("__h") == last["h"]) & (F.col(key) <= last["k"]))
    return hashed.withColumn("part", F.when(before, "train").otherwise("test")).drop("__h")


def disjoint_split(pairs: DataFrame, key: str, target: int, seed: int = 0) -> DataFrame:
    """Adds `part`: whole keys, in hash order, are held out until they have `target` pairs."""
    from corpusloom.plans.ledger import numbered

    counts = numbered(pairs.groupBy(key).agg(F.count("*").alias("n")).withColumn("h", hash_order(F.col(key), seed)), [F.col("h"), F.col(key)], "place")
    # a key is taken while those before it have fewer than the target: at most `target` keys can be
    first = counts.filter(F.col("place") <= target)
    running = first.withColumn("before", F.sum("n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)))
    held = running.filter(F.coalesce("before", F.lit(0)) < target).select(F.col(key).alias("__held"))
    return pairs.join(held, F.col(key) == F.col("__held"), "left").withColumn("part", F.when(F.col("__held").isNotNull(), "eval").otherwise("train")).drop("__held")


def blend(pools: Iterable[tuple[str, DataFrame, int]], key: str, seed: int = 0) -> DataFrame:
    """So many rows of each pool, by hash, with the pool's name."""
    out = None
    for name, pool, n in pools:
        part = sample(pool, key, n, seed).withColumn("pool", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def oversample(rows: DataFrame, by: str, weights: dict) -> DataFrame:
    """Each row as many times as the weight of its group (1 if it has none), with `copy` from 1."""
    weight = F.lit(1)
    for value, n in weights.items():
        weight = F.when(F.col(by) == value, F.lit(n)).otherwise(weight)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), weight)))


def capped(rows: DataFrame, by: str, order: list[Column], per_group: int, n: int | None = None) -> DataFrame:
    """At most so many rows of each group by the order, then at most n in all."""
    out = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= per_group)
    return out.orderBy(*order).limit(n) if n is not None else out


def only(rows: DataFrame, facet: str, wanted: list) -> DataFrame:
    """Rows of the wanted values (all, if none is given); none left is an error that names what there is."""
    if not wanted:
        return rows
    out = rows.filter(F.col(facet).isin(list(wanted)))
    if out.isEmpty():
        there = sorted(str(r[0]) for r in rows.select(facet).distinct().limit(50).collect())
        raise ValueError(f"no {facet} among {list(wanted)}; there are {there}")
    return out


def stratified_clusters(rows: DataFrame, cluster: str, language: str, per_language: int, seed: int = 0) -> DataFrame:
    """Clusters held out for evaluation: in hash order, those with any language that still lacks some.

    The walk is sequential, but only the clusters that can be taken go to the driver: of each
    language, its first `per_language` by hash, so at most languages times per_language of them.
    """
    counts = rows.groupBy(cluster, language).agg(F.count("*").alias("n")).withColumn("h", hash_order(F.col(cluster), seed))
    few = counts.withColumn("place", F.row_number().over(Window.partitionBy(language).orderBy("h", cluster))).filter(F.col("place") <= per_language)
    wanted = few.select(cluster).distinct()
    walk: dict = {}
    for r in counts.join(wanted, cluster).collect():
        walk.setdefault((r["h"], r[cluster]), {})[r[language]] = r["n"]
    have: dict = {}
    taken = []
    for (_, name), languages in sorted(walk.items()):
        if any(have.get(x, 0) < per_language for x in languages):
            taken.append(name)
            for x, n in languages.items():
                have[x] = have.get(x, 0) + n
    spark = rows.sparkSession
    held = spark.createDataFrame([(x,) for x in taken], rows.select(F.col(cluster).alias("__held")).schema)
    return rows.join(held, F.col(cluster) == F.col("__held"), "left").withColumn("part", F.when(F.col("__held").isNotNull(), "eval").otherwise("train")).drop("__held")


def candidate_columns(pairs: DataFrame, batch: str, order: str) -> DataFrame:
    """batch, column, text: the positives of each batch in their order, then its distinct negatives that are
    none of its positives, in the order they first come. A batch is bounded by its size."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "positive", F.coalesce("negatives", F.array().cast("array<string>")).alias("negatives"))))
    rows = pairs.groupBy(batch).agg(ordered.alias("p")).select(batch, F.transform("p", lambda x: x["positive"]).alias("positives"), F.array_distinct(F.flatten(F.transform("p", lambda x: x["negatives"]))).alias("negatives"))
    extra = F.filter("negatives", lambda n: ~F.array_contains(F.col("positives"), n))
    return rows.select(batch, F.posexplode(F.concat("positives", extra)).alias("column", "text"))


def spaced(ids: list[int], n: int, gap: int) -> list[int]:
    """Ids at least `gap` apart, greedily from the smallest; the gap halves until there are n of them."""
    while True:
        out: list[int] = []
        for i in sorted(ids):
            if not out or i - out[-1] >= gap:
                out.append(i)
        if len(out) >= n or gap <= 1:
            return out[:n]
        gap //= 2


def dissimilar(texts: list[str], n: int, at_most: float = 0.6) -> list[str]:
    """Texts, in order, none of which shares more than a share of its words with one before it."""
    out: list[tuple[str, set[str]]] = []
    for t in texts:
        own = set(t.lower().split())
        if own and all(len(own & w) / len(own) <= at_most for _, w in out):
            out.append((t, own))
        if len(out) == n:
            break
    return [t for t, _ in out]


def distinct_positive_batches(pairs: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """Adds `batch`: rows dealt by hash order; within a batch the first row of each positive stays."""
    from corpusloom.plans.ledger import numbered

    dealt = numbered(pairs.withColumn("__h", hash_order(F.col(key), seed)), [F.col("__h"), F.col(key)], "__n")
    dealt = dealt.withColumn("batch", F.floor((F.col("__n") - 1) / size).cast("long"))
    place = F.row_number().over(Window.partitionBy("batch", "positive").orderBy("__n"))
    return dealt.withColumn("__p", place).filter("__p = 1").drop("__h", "__n", "__p")
