"""Interval algebra on half-open spans, as expressions over sorted arrays of (begin, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_overlapping(spans: DataFrame, *by: str) -> DataFrame:
    """Spans that overlap or touch become one; rows of by..., begin, end.

    Null bounds come last: such a span begins nothing, unless there is no bound at all before it.
    """
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_last("begin"), F.asc_nulls_last("end"))
    latest = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.coalesce(latest.isNull() | (F.col("begin") > latest), F.lit(False)).cast("int"))
    grouped = marked.withColumn("__group", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "__group").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("__group")


def invert(merged: Column, length: Column) -> Column:
    """The gaps between sorted, disjoint spans within a length."""
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(merged, lambda s: s["end"].cast("long")))
    ends = F.concat(F.transform(merged, lambda s: s["begin"].cast("long")), F.array(length.cast("long")))
    return F.filter(F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("begin"), e.alias("end"))), lambda s: s["begin"] < s["end"])


def to_absolute(span: Column, parent: Column) -> Column:
    return F.struct((span["begin"] + parent["begin"]).alias("begin"), (span["end"] + parent["begin"]).alias("end"))


def within(span: Column, parent: Column) -> Column:
    return (span["begin"] >= parent["begin"]) & (span["end"] <= parent["end"]) & (span["begin"] <= span["end"])


def ordered(spans: Column) -> Column:
    """Whether each span begins where the one before it ends, or later."""
    n = F.greatest(F.size(spans) - 1, F.lit(0))
    return F.forall(F.zip_with(F.slice(spans, F.lit(1), n), F.slice(spans, F.lit(2), n), lambda a, b: a["end"] <= b["begin"]), lambda x: x)
