"""Curation of documents: duplicates, filters, audit, statistics, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import fixed, text
from corpusloom.plans.ledger import Rules, first_hit, judge, ledger

ID, TEXT, LANGUAGE = "doc_id", "text", "lang"


def lines(docs: DataFrame, *carry: str) -> DataFrame:
    """One row for each line of a text: doc_id, line_no (from 1), line."""
    return docs.select(ID, *carry, F.posexplode(F.split(TEXT, "\n", -1)).alias("p", "line")).select(ID, *carry, (F.col("p") + 1).cast("long").alias("line_no"), "line")


def paragraph_spans(docs: DataFrame) -> DataFrame:
    """doc_id, index, begin, end of the blocks between blank lines; spans are half-open, in code points."""
    parts = F.split(TEXT, r"\n[ \t]*\n[ \t\n]*", -1)
    gaps = F.concat(F.array(F.lit("")), F.regexp_extract_all(TEXT, F.lit(r"\n[ \t]*\n[ \t\n]*"), F.lit(0)))
    step = F.aggregate(
        F.arrays_zip(parts.alias("part"), gaps.alias("gap")),
        F.array(F.struct(F.lit("").alias("text"), F.lit(0).alias("begin"), F.lit(0).alias("end"))),
        lambda a, x: F.concat(a, F.array(F.struct(x["part"].alias("text"), (F.element_at(a, -1)["end"] + F.length(x["gap"])).alias("begin"), (F.element_at(a, -1)["end"] + F.length(x["gap"]) + F.length(x["part"])).alias("end")))),
    )
    left = lambda t: F.length(t) - F.length(F.regexp_replace(t, f"^{fixed.WS}", ""))
    right = lambda t: F.length(t) - F.length(F.regexp_replace(t, f"{fixed.WS}$", ""))
    full = F.filter(F.slice(step, 2, F.greatest(F.size(step) - 1, F.lit(1))), lambda s: F.regexp_replace(s["text"], fixed.WS, "") != "")
    trimmed = F.transform(full, lambda s: F.struct((s["begin"] + left(s["text"])).alias("begin"), (s["end"] - right(s["text"])).alias("end")))
    out = docs.select(ID, F.posexplode(trimmed).alias("p", "s"))
    return out.select(ID, F.col("p").cast("long").alias("index"), F.col("s.begin").cast("long").alias("begin"), F.col("s.end").cast("long").alias("end"))


def dedup_key(column: str = TEXT) -> Column:
    return F.sha2(text.collapse(F.col(column)).cast("binary"), 256)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of documents with the same text, white space made single: digest, first_id, copies."""
    return docs.groupBy(dedup_key().alias("digest")).agg(F.min(ID).alias("first_id"), F.count("*").alias("copies"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The first document, by id, of each group with the same text.

    Groups are made of digests, not texts; the texts meet the list of first ids by id.
    """
    keep = docs.select(ID, dedup_key().alias("digest")).groupBy("digest").agg(F.min(ID).alias(ID)).select(ID)
    return docs.join(keep, ID, "left_semi")


def sentence_rules(sentence: Column, low: int = 2, high: int = 10_000, script: str | None = None) -> Rules:
    """Blank, too short, too long, no letters, damaged, and if asked not of the script."""
    body = F.regexp_replace(sentence, f"^{fixed.WS}|{fixed.WS}$", "")
    damaged = F.length(body) - F.length(F.replace(body, F.lit("�"), F.lit("")))
    rules = [
        ("blank", F.length(body) == 0),
        ("too_short", F.length(body) < low),
        ("too_long", F.length(body) > high),
        ("no_letters", ~body.rlike(r"\p{L}")),
        ("encoding_damage", damaged > 0.10 * F.length(body)),
    ]
    return [*rules, ("script_mismatch", text.dominant_script(body)["script"] != script)] if script else rules


def sentence_filter(rows: DataFrame, column: str = "line", **limits) -> DataFrame:
    return judge(rows, sentence_rules(F.col(column), **limits))


def filter_sentences_within(docs: DataFrame, **limits) -> DataFrame:
    """Documents with the array of their lines that pass; those without any go."""
    kept = F.filter(F.split(TEXT, "\n", -1), lambda s: first_hit(sentence_rules(s, **limits)).isNull())
    return docs.withColumn("sentences", kept).filter(F.size("sentences") > 0)


def validate(docs: DataFrame, spans: str | None = None) -> DataFrame:
    """doc_id, problems: what makes a document unusable.

    With `spans`, a column of the paragraphs' start and end, in order, these are held against the text;
    else the paragraphs are those of the text.
    """
    whole = F.coalesce(F.col(TEXT), F.lit(""))
    found = [F.when(text.collapse(whole) == "", F.lit("empty text"))]
    if spans is None:
        found.append(F.when(F.size(text.paragraphs(whole)) == 0, F.lit("no paragraphs")))
    else:
        own = F.coalesce(spans, F.array().cast("array<struct<start: int, end: int>>"))
        outside = F.exists(own, lambda s: (s["start"] < 0) | (s["end"] > F.length(whole)) | (s["start"] >= s["end"]))
        overlap = F.exists(text.pairwise(own), lambda p: p["a"]["end"] > p["b"]["start"])
        found += [F.when(F.size(own) == 0, F.lit("no paragraphs")), F.when(outside, F.lit("span outside of the text")), F.when(overlap, F.lit("spans overlap"))]
    return docs.select(ID, F.array_compact(F.array(*found)).alias("problems"))


def audit(docs: DataFrame, n_sentences: Column | None = None, examples: int = 3) -> DataFrame:
    """Findings: code, severity, n, share, examples (the first ids).

    An empty document is only that. An error that hits less than a hundredth of the documents is a
    warning: damage in the source, not a broken extraction.
    """
    body = F.coalesce(F.col(TEXT), F.lit(""))
    count = n_sentences if n_sentences is not None else F.size(F.filter(F.split(body, "\n"), lambda s: text.collapse(s) != ""))
    damaged = F.length(body) - F.length(F.replace(body, F.lit("�"), F.lit("")))
    flags = {
        "too_short": F.length(text.collapse(body)) < fixed.SHORT_DOCUMENT,
        "no_language": F.coalesce(F.col(LANGUAGE), F.lit("")) == "",
        "unknown_script": ~text.has_script(body),
        "markup": text.has_markup(body),
        "encoding_damage": damaged > fixed.DAMAGE_SHARE * F.length(body),
        "single_sentence": count <= 1,
    }
    empty = text.collapse(body) == ""
    codes = F.when(empty, F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*(F.when(hit, F.lit(code)) for code, hit in flags.items()))))
    marked = docs.select(ID, codes.alias("codes"), F.when(~empty, dedup_key()).alias("digest"))
    groups = marked.filter("digest is not null").groupBy("digest").agg(F.min(ID).alias("first")).select("digest", "first")
    repeats = marked.join(groups, "digest").filter(F.col(ID) != F.col("first")).select(ID, F.lit("duplicate").alias("code"))
    hits = marked.select(ID, F.explode("codes").alias("code")).unionByName(repeats)
    total = docs.agg(F.count("*").alias("documents"))
    counted = _first_examples(hits, examples)
    severity = F.when(F.col("code").isin("empty", "markup"), F.when(F.col("share") < fixed.SYSTEMATIC_SHARE, "warning").otherwise("error")).when(F.col("code") == "single_sentence", "info").otherwise("warning")
    return counted.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("documents")).withColumn("severity", severity).select("code", "severity", "n", "share", "examples")


def _first_examples(hits: DataFrame, k: int) -> DataFrame:
    """Counts by code with the k smallest ids; rows beyond them are left out before the shuffle."""
    few = hits.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy(ID))).filter(F.col("place") <= k)
    first = few.groupBy("code").agg(F.sort_array(F.collect_list(ID)).alias("examples"))
    return hits.groupBy("code").agg(F.count("*").alias("n")).join(first, "code")


def statistics(docs: DataFrame, *by: str) -> DataFrame:
    """documents, sentences (non-blank lines), characters, words by the given columns."""
    body = F.coalesce(F.col(TEXT), F.lit(""))
    return docs.groupBy(*by).agg(
        F.count("*").alias("documents"),
        F.sum(F.size(F.filter(F.split(body, "\n"), lambda s: text.collapse(s) != "")).cast("long")).alias("sentences"),
        F.sum(F.length(body).cast("long")).alias("characters"),
        F.sum(F.regexp_count(body, F.lit(fixed.TEXT_WORD)).cast("long")).alias("words"),
    )


def length_summary(values: DataFrame, column: str, *by: str) -> DataFrame:
    """count, total, minimum, maximum, mean and exact interpolated percentiles of a column."""
    at = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = values.groupBy(*by).agg(
        F.count(column).alias("n"),
        F.sum(F.col(column).cast("long")).alias("total"),
        F.min(F.col(column).cast("long")).alias("minimum"),
        F.max(F.col(column).cast("long")).alias("maximum"),
        F.avg(column).alias("mean"),
        at.alias("at"),
    )
    return out.select(*by, "n", "total", "minimum", "maximum", "mean", F.col("at")[0].alias("median"), F.col("at")[1].alias("p95"), F.col("at")[2].alias("p99"))


def word_frequencies(docs: DataFrame, *by: str) -> DataFrame:
    """word, n of the folded words of all texts."""
    return docs.select(*by, F.explode(text.words(F.col(TEXT))).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))


def type_token_ratio(docs: DataFrame, *by: str) -> DataFrame:
    counts = word_frequencies(docs, *by)
    return counts.groupBy(*by).agg(F.count("*").alias("distinct_words"), F.sum("n").alias("words"), (F.count("*") / F.sum("n")).alias("ratio"))


def script_statistics(docs: DataFrame, *by: str) -> DataFrame:
    """Documents by dominant script, with the mean of its confidence."""
    profile = text.dominant_script(F.coalesce(F.col(TEXT), F.lit("")))
    rows = docs.select(*by, profile.alias("profile"))
    return rows.groupBy(*by, F.col("profile.script").alias("script")).agg(F.count("*").alias("documents"), F.avg("profile.confidence").alias("confidence"))


def filter_report(rows: DataFrame, *by: str) -> DataFrame:
    """The ledger with each reason's share of its group."""
    counts = ledger(rows, *by)
    total = counts.groupBy(*by).agg(F.sum("n").alias("all")) if by else counts.agg(F.sum("n").alias("all"))
    joined = counts.join(total, list(by)) if by else counts.join(F.broadcast(total))
    return joined.select(*by, "reason", "n", (F.col("n") / F.col("all")).alias("share"))


def stream_documents(docs: DataFrame, low: int = 1, high: int = 10_000, lowercase: bool = False) -> DataFrame:
    """The canonical scan: without copies, with the sentences that pass, and not the documents that have none."""
    out = filter_sentences_within(deduplicate(docs), low=low, high=high)
    return out.withColumn("sentences", F.transform("sentences", text.fold)) if lowercase else out
