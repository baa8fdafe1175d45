"""Alignment joins and hold-outs, each with the ledger of what found no partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.plans.ledger import REASON, first_hit


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row, by `order`, of each key; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__last"))
    return best.select(*keys, "__last.*")


def first_of(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__first"))
    return best.select(*keys, "__first.*")


def align_documents(source: DataFrame, links: DataFrame, target: DataFrame) -> DataFrame:
    """Two hops: source id to the linked title, title to the target document; with a status.

    source and target: doc_id, title, language, lead. links: from_id, title, link_order. The last
    link of a page and the last target of a title count; documents without title or lead are left
    out. Status: aligned, missing_langlink, missing_target.
    """
    whole = (text.collapse(F.coalesce("title", F.lit(""))) != "") & (text.collapse(F.coalesce("lead", F.lit(""))) != "")
    source, target = source.filter(whole), target.filter(whole)
    links = last_of(links.select("from_id", F.col("title").alias("linked"), "link_order"), ["from_id"], "link_order").select("from_id", text.title_key(F.col("linked")).alias("key"))
    target = target.select(text.title_key(F.col("title")).alias("key"), F.col("doc_id").alias("target_id"), F.col("title").alias("target_title"), F.col("language").alias("target_language"), F.col("lead").alias("target_lead"))
    target = last_of(target, ["key"], "target_id")
    source = source.select("doc_id", F.col("title").alias("source_title"), F.col("language").alias("source_language"), F.col("lead").alias("source_lead"))
    out = source.join(links, F.col("doc_id") == F.col("from_id"), "left").join(target, "key", "left")
    status = F.when(F.col("from_id").isNull(), "missing_langlink").when(F.col("target_id").isNull(), "missing_target").otherwise("aligned")
    return out.withColumn("status", status).drop("from_id", "key")


def section_key(number: Column) -> Column:
    return text.fold(F.regexp_replace(number, r"[\t-\r\x1c-\x20\x{85}\x{a0}]", ""))


def align_bilingual(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join of sections (number, heading, body, place) on their number, with a status.

    The first section of a number counts on each side. Status: no_number, duplicate (both with a
    side), left_only, right_only, empty_side, aligned. The heading is the left one, else the right.
    """
    def side(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        df = df.withColumn("key", section_key(F.coalesce("number", F.lit(""))))
        usable = df.filter(F.col("key") != "")
        first = first_of(usable.select("key", "heading", "body", "place"), ["key"], F.col("place"))
        repeated = usable.join(first.select("key", F.col("place").alias("first_place")), "key").filter(F.col("place") != F.col("first_place"))
        turned = df.filter(F.col("key") == "").select("key", F.lit(name).alias("side"), F.lit("no_number").alias("status"))
        turned = turned.unionByName(repeated.select("key", F.lit(name).alias("side"), F.lit("duplicate").alias("status")))
        return first.select("key", *(F.col(c).alias(f"{name}_{c}") for c in ("heading", "body"))), turned

    (a, not_a), (b, not_b) = side(left, "left"), side(right, "right")
    out = a.join(b, "key", "full_outer")
    blank = lambda c: text.collapse(F.col(c)) == ""
    status = F.when(F.col("right_body").isNull(), "left_only").when(F.col("left_body").isNull(), "right_only").when(blank("left_body") | blank("right_body"), "empty_side").otherwise("aligned")
    out = out.select("key", F.lit(None).cast("string").alias("side"), status.alias("status"), F.coalesce(F.nullif(F.col("left_heading"), F.lit("")), "right_heading").alias("heading"), "left_body", "right_body")
    empty = lambda df: df.select("key", "side", "status", *(F.lit(None).cast("string").alias(c) for c in ("heading", "left_body", "right_body")))
    return out.unionByName(empty(not_a)).unionByName(empty(not_b))


def align_provisions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on the normalized number; the last of the right side counts, left ones fan out."""
    right = last_of(right.select(section_key(F.col("number")).alias("key"), *(F.col(c).alias(f"right_{c}") for c in ("heading", "body", "language")), "place"), ["key"], "place").drop("place")
    left = left.select("doc_id", section_key(F.col("number")).alias("key"), F.col("place").alias("position"), *(F.col(c).alias(f"left_{c}") for c in ("heading", "body", "language")))
    return left.join(right, "key")


def zip_lines(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positional join of two numbered line tables (n, line); unequal lengths leave a null side."""
    return left.select("n", F.col("line").alias("anchor")).join(right.select("n", F.col("line").alias("positive")), "n", "full_outer")


def misaligned(zipped: DataFrame) -> DataFrame:
    """The lines that have no partner; empty if the files are of one length."""
    return zipped.filter(F.col("anchor").isNull() | F.col("positive").isNull())


def pivot_pairs(rows: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Pairs of languages that meet in a cluster: cluster, language_a < language_b, both texts, Jaccard.

    Of each cluster and language the longest text counts (ties to the smaller id). `exclude` lists
    clusters that are held out.
    """
    if exclude is not None:
        rows = rows.join(exclude.select("cluster").distinct(), "cluster", "left_anti")
    best = first_of(rows.select("cluster", "language", "doc_id", "text"), ["cluster", "language"], F.struct(-F.length("text"), F.col("doc_id")))
    a = best.select("cluster", F.col("language").alias("language_a"), F.col("doc_id").alias("id_a"), F.col("text").alias("text_a"))
    b = best.select(F.col("cluster").alias("c"), F.col("language").alias("language_b"), F.col("doc_id").alias("id_b"), F.col("text").alias("text_b"))
    both = a.join(b, (F.col("cluster") == F.col("c")) & (F.col("language_a") < F.col("language_b"))).drop("c")
    return both.withColumn("overlap", text.jaccard(F.col("text_a"), F.col("text_b")))


def without_held_out(pairs: DataFrame, held_out: DataFrame, *, missing_at_most: float = 0.05) -> DataFrame:
    """Pairs (document, anchor, positive) with the reason why each is held out, if it is.

    In order: its document is among the held-out ones, a side is a held-out text, a side is one but
    for case and white space. Held-out pairs without a document are refused above a share.
    """
    counts = held_out.agg(F.count("*").alias("n"), F.count_if(F.coalesce("document", F.lit("")) == "").alias("missing")).first()
    if counts["n"] and counts["missing"] / counts["n"] > missing_at_most:
        raise ValueError(f"{counts['missing']} of {counts['n']} held-out pairs name no document")
    documents = held_out.select("document").filter("document <> ''").distinct().select(F.col("document").alias("hd"))
    texts = held_out.select(F.explode(F.array("anchor", "positive")).alias("t")).filter("t is not null")
    exact = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    loose = lambda c: F.sha2(text.fold(text.collapse(F.col(c))).cast("binary"), 256)
    out = pairs.join(documents, F.col("document") == F.col("hd"), "left")
    for side in ("anchor", "positive"):
        for name, key in (("exact", exact), ("loose", loose)):
            keys = texts.select(key("t").alias(f"{name}_{side}")).distinct()
            out = out.join(keys, key(side) == F.col(f"{name}_{side}"), "left")
    hit = lambda name: F.col(f"{name}_anchor").isNotNull() | F.col(f"{name}_positive").isNotNull()
    reason = first_hit([("document", F.col("hd").isNotNull()), ("text", hit("exact")), ("normalized_text", hit("loose"))])
    return out.withColumn(REASON, reason).select(*pairs.columns, REASON)


def contained_passages(docs: DataFrame, passages: DataFrame, shingle: int = 8) -> DataFrame:
    """doc_id, item_id of the documents that hold a whole passage, words compared without case.

    Documents and passages meet on one run of `shingle` words, the passage's smallest by hash, and
    the whole passage is then looked for; a passage of fewer words meets on its first word.
    """
    def grams(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - shingle + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(shingle))))

    tokens = lambda t: F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    items = passages.select("item_id", tokens(F.col("text")).alias("passage")).filter(F.size("passage") > 0)
    long, short = items.filter(F.size("passage") >= shingle), items.filter(F.size("passage") < shingle)
    spaced = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    bodies = docs.select("doc_id", tokens(F.col("text")).alias("words")).filter(F.size("words") > 0)

    def meet(items: DataFrame, key: Column, keys: Column) -> DataFrame:
        looked = items.withColumn("key", key)
        found = bodies.withColumn("key", F.explode(F.array_distinct(keys))).join(looked, "key")
        return found.filter(F.contains(spaced(F.col("words")), spaced(F.col("passage")))).select("doc_id", "item_id")

    by_gram = meet(long, F.array_min(grams(F.col("passage"))), grams(F.col("words")))
    by_word = meet(short, F.xxhash64(F.col("passage")[0]), F.transform("words", lambda w: F.xxhash64(w)))
    return by_gram.unionByName(by_word)


def candidate_provenance(pairs: DataFrame) -> DataFrame:
    """Distinct positives with the first document that has each."""
    return pairs.groupBy("positive").agg(F.min("document").alias("document"), F.count("*").alias("n"))


def oov_removed(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return tokens.join(vocabulary.select("token", "id"), "token")
