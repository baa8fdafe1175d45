"""Sinks. Spark's committers make every write atomic as a job."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text


def write_jsonl(rows: DataFrame, path: str, *, gzip: bool = False) -> int:
    """One JSON record per row; the number of rows written."""
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)
    return seen.get["n"]


def write_sentences(rows: DataFrame, path: str, column: str = "sentence") -> int:
    """One sentence per line, white space made single; blank ones are left out."""
    from pyspark.sql import Observation

    seen = Observation()
    flat = rows.select(text.collapse(F.col(column)).alias("value")).filter("value <> ''")
    flat.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(path)
    return seen.get["n"]


def write_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    """Fixed columns in a fixed order, missing ones empty."""
    rows.select(*(F.col(f) if f in rows.columns else F.lit("").alias(f) for f in fields)).write.mode("overwrite").option("header", True).csv(path)


def pair_records(pairs: DataFrame) -> DataFrame:
    """Pairs as they are stored: overlap in four places, no empty list of negatives."""
    out = pairs.withColumn("overlap", F.round("overlap", 4))
    return out.withColumn("negatives", F.when(F.size("negatives") > 0, F.col("negatives"))) if "negatives" in pairs.columns else out


def pairs_from_records(records: DataFrame) -> DataFrame:
    """Stored pairs: blank sides are refused, blank negatives dropped."""
    bad = (text.collapse(F.coalesce("anchor", F.lit(""))) == "") | (text.collapse(F.coalesce("positive", F.lit(""))) == "")
    out = records.withColumn("anchor", F.when(bad, F.raise_error(F.lit("a pair without anchor or positive")).cast("string")).otherwise(F.col("anchor")))
    if "negatives" not in records.columns:
        return out.withColumn("negatives", F.array().cast("array<string>"))
    return out.withColumn("negatives", F.filter(F.coalesce("negatives", F.array().cast("array<string>")), lambda n: text.collapse(n) != ""))


FORMAT_VERSION = 1


def save_table(rows: DataFrame, path: str, kind: str, **header: object) -> int:
    """A vocabulary, vectors, an index or a corpus as a table with a header: its kind, version, rows and more."""
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/rows")
    n = seen.get["n"]
    record = json.dumps({"kind": kind, "version": FORMAT_VERSION, "rows": n} | header, sort_keys=True, default=str)
    rows.sparkSession.createDataFrame([(record,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    return n


def load_table(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, dict]:
    """The rows and the header of such a table; another kind or version, or missing rows, is an error."""
    header = json.loads(spark.read.text(f"{path}/header").first()["value"])
    if (header.get("kind"), header.get("version")) != (kind, FORMAT_VERSION):
        raise ValueError(f"{path} holds {header.get('kind')} version {header.get('version')}, not {kind} version {FORMAT_VERSION}")
    rows = spark.read.parquet(f"{path}/rows")
    if (n := rows.count()) != header["rows"]:
        raise ValueError(f"{path} has {n} rows; its header says {header['rows']}")
    return rows, header


def markdown_report(title: str, rows: DataFrame) -> str:
    """A small metric table as Markdown."""
    columns = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    for r in rows.collect():
        lines.append("| " + " | ".join(f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) + " |")
    return "\n".join(lines)
