"""Streaming twins of the batch filters, for new corpus drops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators.corpus import sentence_rules
from corpusloom.plans.ledger import judge


def deduplicate_stream(docs: DataFrame, column: str = "text") -> DataFrame:
    """The first arrival of each text, white space made single; state holds one digest per text."""
    return docs.withColumn("digest", F.sha2(text.collapse(F.col(column)).cast("binary"), 256)).dropDuplicates(["digest"])


def deduplicate_within(docs: DataFrame, time: str, delay: str, column: str = "text") -> DataFrame:
    """The same with state bounded by a watermark: copies that arrive within the delay go."""
    marked = docs.withColumn("digest", F.sha2(text.collapse(F.col(column)).cast("binary"), 256))
    return marked.withWatermark(time, delay).dropDuplicatesWithinWatermark(["digest"])


def filter_stream(rows: DataFrame, column: str = "line") -> DataFrame:
    return judge(rows, sentence_rules(F.col(column)))


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts by tumbling windows, or sliding ones with `slide`; rows that come later than the delay are left out."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width, slide or width), by).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, time: str, by: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts by sessions: rows of one key with less than the gap between them."""
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that is there, once, into Parquet."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
