"""Jobs made of operators: mining with its ledger, search over texts, selection and scoring of pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import corpus, evaluate, joins, pairs, select, vectors, vocab
from corpusloom.plans.config import CorpusSettings, NegativeSettings, PairSettings, SelectionSettings
from corpusloom.plans.ledger import accepted, ledger, numbered
from corpusloom.runtime import durable
from corpusloom.sources import readers

Encoder = Callable[[Column], Column]


def read_corpus(spark: SparkSession, settings: CorpusSettings) -> DataFrame:
    """Documents of a source as the operators take them: doc_id, text, lang, source, title, sections."""
    reader = readers.reader_for(settings.source, settings.format)
    options = {"text_field": settings.text_field} if reader is readers.read_jsonl else {}
    docs = reader(spark, settings.source, language=settings.language, **options)
    docs = docs.select(F.col("id").alias("doc_id"), "text", F.col("language").alias("lang"), "source", "title", "sections", "attributes")
    return docs.withColumn("text", text.fold(F.col("text"))) if settings.lowercase else docs


def mine_pairs(docs: DataFrame, settings: PairSettings | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Structural pairs of documents, the ledger by kind, and statistics that say which kinds leak."""
    s = settings or PairSettings()
    rows = docs.select("doc_id", F.col("lang").alias("language"), "title", text.paragraphs(F.col("text")).alias("paragraphs"), "sections")
    judged = pairs.structural_pairs(rows, anchor_at_least=s.minimum_anchor_characters, positive_at_least=s.minimum_positive_characters, positive_at_most=s.maximum_positive_characters, overlap_at_most=s.maximum_overlap)
    found = accepted(judged).drop("kind_rank", "position").withColumnRenamed("doc_id", "document")
    return found, ledger(judged, "kind"), pairs.pair_statistics(accepted(judged))


def mine_aligned(source: DataFrame, links: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Aligned pairs, the ledger of documents and that of pairs."""
    def lead(df: DataFrame) -> DataFrame:
        return df.select("doc_id", "title", F.col("lang").alias("language"), F.get(text.paragraphs(F.col("text")), F.lit(0)).alias("lead"))

    documents = joins.align_documents(lead(source), links, lead(target))
    judged = pairs.aligned_pairs(documents.filter("status = 'aligned'"))
    return accepted(judged), documents.groupBy("status").agg(F.count("*").alias("n")), ledger(judged, "kind")


def ingest_parallel(left: DataFrame, right: DataFrame, left_language: str, right_language: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of two line tables (n, line) and their ledger; files of unequal length are an error."""
    zipped = durable(joins.zip_lines(left, right))
    if (lost := joins.misaligned(zipped).count()) > 0:
        raise ValueError(f"{lost} lines have no partner")
    judged = pairs.bitext(zipped.select(F.col("n").alias("doc_id"), F.col("n").alias("position"), "anchor", "positive"))
    found = accepted(judged).withColumn("language", F.lit(left_language)).withColumn("positive_language", F.lit(right_language))
    return found, ledger(judged)


def with_ids(rows: DataFrame, *order: str) -> DataFrame:
    return numbered(rows, [F.col(c) for c in order], "id")


def mine_negatives(pair_rows: DataFrame, encode: Encoder, settings: NegativeSettings | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (document, anchor, positive, ...) with their hard negatives, and statistics of the walk.

    Candidates are the distinct positives. An anchor without a vector keeps the negatives it has;
    all columns stay.
    """
    s = settings or NegativeSettings()
    rows = durable(with_ids(pair_rows, "document", "anchor", "positive"))
    code = F.xxhash64("document")
    encoded = rows.select("id", code.alias("document"), encode(F.col("anchor")).alias("anchor"), encode(F.col("positive")).alias("positive"), F.col("positive").alias("text"))
    first = encoded.groupBy("text").agg(F.min("id").alias("first"))
    walk = durable(vectors.hard_negatives(encoded.select("id", "document", "anchor", "positive"), count=s.count, pool=s.pool, maximum=s.maximum_similarity, minimum=s.minimum_similarity, margin=s.margin))
    texts = encoded.select(F.col("id").alias("candidate"), "text").join(first.select(F.col("first").alias("candidate")), "candidate", "left_semi")
    taken = walk.filter("reason = 'accepted'").join(texts, "candidate")
    lists = taken.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("__found"))
    kept = F.col("negatives") if "negatives" in pair_rows.columns else F.array().cast("array<string>")
    out = rows.join(lists, "id", "left").withColumn("negatives", F.coalesce("__found", kept)).drop("__found", "id")
    return out, vectors.negative_statistics(walk)


def train_vectors(docs: DataFrame, *, size: int = 100, window: int = 5, min_count: int = 5, max_size: int = 200_000, epochs: int = 3, seed: int = 0, partitions: int = 8) -> tuple[DataFrame, DataFrame]:
    """A vocabulary (id, token, frequency) and a vector (token, v) for each of its words that was learned.

    Skip-grams are learned by the session's own Word2Vec, in so many partitions whose weights are
    averaged in every round; it has hierarchical softmax in place of negative samples.
    """
    from pyspark.ml.feature import Word2Vec

    counts = corpus.word_frequencies(docs)
    known = durable(vocab.vocabulary(counts, min_count, max_size))
    rows = docs.select(text.words(F.col("text")).alias("words")).filter(F.size("words") > 1)
    learner = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, numPartitions=partitions, inputCol="words", outputCol="v")
    found = learner.fit(rows).getVectors()
    from pyspark.ml.functions import vector_to_array

    return known, found.select(F.col("word").alias("token"), vector_to_array("vector").alias("v")).join(known.select("token"), "token", "left_semi")


def build_index(rows: DataFrame, encode: Encoder, *, text_col: str = "text", passage_prefix: str = "") -> DataFrame:
    """id, grp, v, text: non-blank texts with unit vectors; texts without a vector are left out."""
    full = rows.filter(text.collapse(F.col(text_col)) != "")
    out = full.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("grp"), encode(F.concat(F.lit(passage_prefix), F.col(text_col))).alias("v"), F.col(text_col).alias("text"))
    return out.filter(vectors.norm(F.col("v")) > 0).withColumn("v", vectors.unit(F.col("v")))


def search(index: DataFrame, questions: DataFrame, encode: Encoder, k: int = 10, *, query_prefix: str = "") -> DataFrame:
    """query_id, rank, id, text, score; a question without a vector has no hits. questions: id, text."""
    asked = questions.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("grp"), encode(F.concat(F.lit(query_prefix), "text")).alias("v"))
    hits = vectors.top_k(asked, index.select("id", "grp", "v"), k, not_self=False)
    return hits.join(index.select("id", "text"), "id").select("query_id", "rank", "id", "text", "score")


def select_pairs(pool: DataFrame, held_out: DataFrame | None, settings: SelectionSettings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training pairs, evaluation pairs and the ledger of what the hold-out turned away.

    Facets first, then the evaluation sample, then all that shares a document or a text with it (or
    with the given held-out pairs) leaves the pool, then the training sample, then prefixes.
    """
    s = settings
    pool = select.only(select.only(pool, "kind", s.kinds), "language", s.languages)
    key = F.sha2(F.concat_ws("\0", "document", "anchor", "positive").cast("binary"), 256)
    pool = pool.withColumn("__key", key)
    if held_out is None:
        held_out = durable(select.sample(pool, "__key", s.evaluation_pairs, s.seed + 10_000))
    judged = durable(joins.without_held_out(pool, held_out, missing_at_most=1.0))
    train = select.sample(accepted(judged), "__key", s.train_pairs, s.seed)
    prefix = lambda df: pairs.prefixed(df.drop("__key"), s.query_prefix, s.passage_prefix)
    return prefix(train), prefix(held_out), ledger(judged)


def score_pairs(pair_rows: DataFrame, encode: Encoder, limit: int = 2000) -> tuple[DataFrame, DataFrame]:
    """The retrieval report (all, language, kind, overlap band) and the language separation of pairs.

    The first `limit` pairs by document and text, those with a positive that came before left out.
    """
    order = ["document", "anchor", "positive"]
    few = pair_rows.orderBy(*order).limit(limit).withColumn("digest", F.sha2(text.collapse(F.col("positive")).cast("binary"), 256))
    rest = [c for c in few.columns if c != "digest"]
    first = few.groupBy("digest").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select("r.*")
    rows = durable(with_ids(first, *order))
    if rows.count() < 2:
        raise ValueError("two distinct positives at least")
    target = F.coalesce("positive_language", "language") if "positive_language" in rows.columns else F.col("language")
    encoded = durable(rows.select("id", F.xxhash64("language").alias("asked"), F.xxhash64(target).alias("found"), encode(F.col("anchor")).alias("q"), encode(F.col("positive")).alias("v")))
    queries = encoded.select("id", F.col("asked").alias("grp"), F.col("q").alias("v"), vectors.cosine(F.col("q"), F.col("v")).alias("own"), F.col("id").alias("positive_id"))
    candidates = encoded.select("id", F.col("found").alias("grp"), "v")
    ranks = vectors.pessimistic_ranks(queries, candidates).select(F.col("query_id").alias("id"), "rank")
    facets = rows.select("id", "language", "kind", text.band(F.col("overlap")).alias("overlap_band"))
    report = evaluate.report(ranks.join(facets, "id"), "language", "kind", "overlap_band")
    near = vectors.top_k(queries.select("id", "grp", "v"), candidates, 5)
    return report, evaluate.language_separation(near, encoded.select("id", "asked", "found"))


def describe(docs: DataFrame) -> dict[str, DataFrame]:
    """All of the `stats` report."""
    lines = corpus.lines(docs).filter(text.collapse(F.col("line")) != "").withColumn("chars", F.length("line"))
    return {
        "totals": corpus.statistics(docs),
        "languages": corpus.statistics(docs, "lang"),
        "scripts": corpus.script_statistics(docs),
        "sentence_lengths": corpus.length_summary(lines, "chars"),
        "words": corpus.word_frequencies(docs).orderBy(F.desc("n"), "word").limit(50),
        "types": corpus.type_token_ratio(docs),
    }
