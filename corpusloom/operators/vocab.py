"""Vocabularies, encodings and tokenizer metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text
from corpusloom.plans.ledger import numbered
from corpusloom.runtime import few

# Ids that every vocabulary begins with.
RESERVED = ["<pad>", "<unk>", "<s>", "</s>"]
PAD, UNK, BOS, EOS = range(4)


def vocabulary(counts: DataFrame, min_count: int = 1, max_size: int | None = None) -> DataFrame:
    """id, token, frequency of counts (word, n): commonest first, ties by token, ids after the reserved."""
    rows = counts.filter((F.col("n") >= min_count) & ~F.col("word").isin(RESERVED)).select(F.col("word").alias("token"), F.col("n").alias("frequency"))
    if max_size is not None:
        rows = rows.orderBy(F.desc("frequency"), "token").limit(max(0, max_size - len(RESERVED)))
    out = numbered(rows, [F.desc("frequency"), F.col("token")], "place")
    return out.select((F.col("place") + len(RESERVED) - 1).alias("id"), "token", "frequency")


def tokens(docs: DataFrame, *carry: str, kind: str = "word") -> DataFrame:
    """doc_id, position, token of the folded words (or white-space tokens) of each text."""
    found = text.words(F.col("text")) if kind == "word" else text.pre_tokens(F.col("text"), kind)
    return docs.select("doc_id", *carry, F.posexplode(found).alias("position", "token"))


def probes(vocab: DataFrame, n: int) -> DataFrame:
    """The n most frequent tokens, ties by token."""
    return vocab.orderBy(F.desc("frequency"), "token").limit(n)


def coverage(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Share of words, and of distinct words, that the vocabulary knows."""
    known = counts.join(vocab.select(F.col("token").alias("word"), "id"), "word", "left")
    return known.agg(
        F.sum("n").alias("words"),
        F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        F.count("*").alias("distinct_words"),
        F.count("id").alias("known_distinct"),
    ).withColumn("coverage", F.col("known") / F.nullif(F.col("words"), F.lit(0).cast("long")))


def encode(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, ids: words by their vocabulary ids, unknown ones as 1, in their order.

    A vocabulary of few rows is broadcast, so that tokens stay where their documents are; a larger one is
    joined by a shuffle.
    """
    found = tokens(docs).join(few(vocab.select("token", "id")), "token", "left")
    ids = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", F.coalesce("id", F.lit(UNK).cast("long")).alias("id")))).alias("x"))
    out = docs.select("doc_id").join(ids, "doc_id", "left")
    return out.select("doc_id", F.coalesce(F.transform("x", lambda s: s["id"]), F.array().cast("array<bigint>")).alias("ids"))


def decode(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, text: tokens of the ids joined by blanks, reserved ones skipped."""
    rows = encoded.select("doc_id", F.posexplode("ids").alias("position", "id")).join(vocab.select("id", "token"), "id")
    back = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "token"))), lambda s: s["token"]), " ").alias("text"))
    return encoded.select("doc_id").join(back, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def truncate(ids: Column, n: int) -> Column:
    return F.slice(ids, 1, n)


def pad_to(ids: Column, n: int, pad: int = PAD) -> Column:
    """Ids padded on the right to n (longer ones stay as they are)."""
    return F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.lit(n) - F.size(ids), F.lit(0))))


def attention_mask(ids: Column, n: int) -> Column:
    return F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), F.greatest(F.lit(n) - F.size(ids), F.lit(0))))


def tokenizer_metrics(found: DataFrame, sentences: DataFrame, vocab_size: int, *by: str) -> DataFrame:
    """Efficiency by group: found has token, id (null: unknown) and n; sentences has characters, words, n."""
    a = found.groupBy(*by).agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unknown"), F.count_distinct("id").alias("distinct_tokens"))
    b = sentences.groupBy(*by).agg(F.sum("n").alias("sentences"), F.sum("characters").alias("characters"), F.sum("words").alias("words"))
    both = a.join(b, list(by)) if by else a.join(F.broadcast(b))
    return both.select(
        *by,
        "tokens",
        (F.col("tokens") / F.col("sentences")).alias("tokens_per_sentence"),
        (F.col("characters") / F.col("tokens")).alias("characters_per_token"),
        (F.col("unknown") / F.col("tokens")).alias("unknown_rate"),
        "distinct_tokens",
        (F.col("distinct_tokens") / F.lit(vocab_size)).alias("utilisation"),
        (F.col("tokens") / F.col("words")).alias("fertility"),
    )


def fairness(metrics: DataFrame, column: str = "characters_per_token") -> DataFrame:
    """Least, most and their ratio over the languages."""
    positive = metrics.filter(F.col(column) > 0)
    return positive.agg(F.min(column).alias("least"), F.max(column).alias("most"), F.count("*").alias("languages")).withColumn("ratio", F.col("most") / F.col("least"))


def skip_grams(encoded: DataFrame, window: int, seed: int | None = None) -> DataFrame:
    """centre, context, n of all ids within a window of known ids; no self-join, no shuffle before counting.

    With a seed each place has a window of its own, 1 to `window` wide, by a hash of seed, doc_id and place.
    """
    ids = F.filter("ids", lambda i: i >= len(RESERVED))
    width = F.lit(window) if seed is None else (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "p"), F.lit(window)) + 1).cast("int")
    rows = encoded.select("doc_id", ids.alias("ids")).select("doc_id", "ids", F.posexplode("ids").alias("p", "centre")).withColumn("width", width)
    near = F.concat(F.slice("ids", F.greatest(F.col("p") - F.col("width") + 1, F.lit(1)), F.least(F.col("p"), F.col("width"))), F.slice("ids", F.col("p") + 2, F.col("width")))
    return rows.select("centre", F.explode(near).alias("context")).groupBy("centre", "context").agg(F.count("*").alias("n"))


def noise(vocab: DataFrame, exponent: float = 0.75) -> DataFrame:
    """id, probability of the noise distribution."""
    total = vocab.agg(F.sum(F.pow("frequency", F.lit(exponent))).alias("total"))
    return vocab.join(F.broadcast(total)).select("id", (F.pow("frequency", F.lit(exponent)) / F.col("total")).alias("probability"))


def cumulative_noise(vocab: DataFrame) -> DataFrame:
    """id, cumulative probability in id order; running sums within ranges, shifted by the ranges before."""
    parts = noise(vocab).withColumn("range", F.floor(F.col("id") / 4096))
    before = parts.groupBy("range").agg(F.sum("probability").alias("p"))
    a = before.select(F.col("range").alias("r"))
    shift = a.join(before, F.col("range") < F.col("r")).groupBy("r").agg(F.sum("p").alias("shift"))
    within = parts.withColumn("within", F.sum("probability").over(Window.partitionBy("range").orderBy("id")))
    return within.join(shift, F.col("range") == F.col("r"), "left").select("id", (F.col("within") + F.coalesce("shift", F.lit(0.0))).alias("cumulative"))


def keep_probability(vocab: DataFrame, threshold: float = 1e-3) -> DataFrame:
    """id, keep: chance that an occurrence survives subsampling."""
    total = vocab.agg(F.sum("frequency").alias("total"))
    share = F.col("frequency") / F.col("total")
    return vocab.join(F.broadcast(total)).select("id", F.least(F.lit(1.0), (F.sqrt(share / threshold) + 1) * threshold / share).alias("keep"))


def mask_tokens(encoded: DataFrame, rate: float = 0.15, mask_id: int = UNK, vocab_size: int = 1000, seed: int = 0) -> DataFrame:
    """doc_id, ids, masked, labels: a hash picks the positions; 8 of 10 are masked, one is another
    token, one stays; labels are -100 where nothing is asked. Reserved ids are never picked."""
    digest = lambda i: F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), i.cast("string")).cast("binary"), 256)
    part = lambda x, place: F.conv(F.substring(x["h"], 8 * place + 1, 8), 16, 10).cast("long")
    uniform = lambda x, place: part(x, place) / F.lit(float(1 << 32))
    drawn = encoded.select("doc_id", "ids", F.transform("ids", lambda x, i: F.struct(x.alias("id"), F.when(x >= len(RESERVED), digest(i)).alias("h"))).alias("drawn"))
    picked = lambda x: F.coalesce(uniform(x, 0) < rate, F.lit(False))
    other = lambda x: part(x, 2) % F.lit(vocab_size - len(RESERVED)) + len(RESERVED)
    masked = F.transform("drawn", lambda x: F.when(~picked(x), x["id"]).when(uniform(x, 1) < 0.8, F.lit(mask_id).cast("long")).when(uniform(x, 1) < 0.9, other(x)).otherwise(x["id"]))
    labels = F.transform("drawn", lambda x: F.when(picked(x), x["id"]).otherwise(F.lit(-100).cast("long")))
    return drawn.select("doc_id", "ids", masked.alias("masked"), labels.alias("labels"))
