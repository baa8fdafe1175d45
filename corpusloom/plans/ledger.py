"""Ledgers: every row that an operator turns away has one reason, the first rule that hits, and the
counts of reasons add up to the rows that came in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.runtime import durable, few

REASON = "reject_reason"
ACCEPTED = "accepted"

Rules = list[tuple[str, Column]]


def first_hit(rules: Rules) -> Column:
    """Name of the first rule whose condition holds; null if none does."""
    out = F.when(F.lit(False), F.lit("").cast("string"))
    for name, condition in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(name))
    return out


def judge(df: DataFrame, rules: Rules) -> DataFrame:
    """Adds the reason column; rows that have a reason already keep it."""
    if REASON in df.columns:
        return df.withColumn(REASON, F.coalesce(REASON, first_hit(rules)))
    return df.withColumn(REASON, first_hit(rules))


def reject_repeats(df: DataFrame, key: Column, order: list[Column], name: str = "duplicate") -> DataFrame:
    """Of rows with one key that no rule has hit so far, all but the first are repeats.

    The first is an aggregate of digests and places with map-side combining, so a key with a great share
    of all rows is combined before the shuffle and no text moves. Only keys that repeat are joined back:
    broadcast if they are few, else by a shuffle that AQE can split. Columns of any name pass through.
    """
    marked = df.select(F.when(df[REASON].isNull(), F.sha2(key.cast("binary"), 256)).alias("key"), F.struct(*order).alias("place"), F.struct("*").alias("row"))
    groups = marked.filter("key is not null").groupBy(F.col("key").alias("k")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    joined = marked.join(few(groups.filter("n > 1").select("k", "first")), F.col("key") == F.col("k"), "left")
    repeat = F.col("first").isNotNull() & (F.col("place") != F.col("first"))
    return joined.select(F.col("row").withField(REASON, F.coalesce(F.col("row").getField(REASON), F.when(repeat, F.lit(name)))).alias("row")).select("row.*")


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col(REASON).isNull()).drop(REASON)


def ledger(df: DataFrame, *by: str) -> DataFrame:
    """reason, n (and the grouping columns): counts of all rows by reason, `accepted` among them."""
    return df.groupBy(*by, F.coalesce(F.col(REASON), F.lit(ACCEPTED)).alias("reason")).agg(F.count("*").alias("n"))


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """Adds the place of each row in a total order, from 1, without bringing all rows to one task.

    Rows are range-partitioned by the order; places within a partition are shifted by the sizes of
    those before, one number per partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    if not before:
        return placed.drop("__part").withColumn(name, F.lit(0).cast("long"))
    shift = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)), F.col("__part").cast("long"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.withColumn(name, (within + shift).cast("long")).drop("__part")
