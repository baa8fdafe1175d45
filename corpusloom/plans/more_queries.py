"""Registered queries of scripts and languages, readers, prose, word judgements, windows of streams and more."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import fixed, prose, text
from corpusloom.operators import corpus, evaluate, pairs, select, vectors, vocab
from corpusloom.plans.ledger import accepted, ledger
from corpusloom.plans.queries import S_CANDIDATES, S_ENCODED, S_LABELLED, S_QA, S_UNIT, docs_of, is_file, long, page_pairs, query, question_rows, s_ws, vectors_of, vocab_of
from corpusloom.runtime import ensure_checkpoint_dir, table

__all__: list[str] = []

# --- scripts: texts of the tables are Latin, so that others are set before them

SAMPLES = ["", "Привет мир это текст", "नमस्ते दुनिया यह पाठ है", "你好世界这是文本", "مرحبا بالعالم هذا نص", "γειά σου κόσμε", "123 --- 456", "こんにちは世界"]


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with a sample of another script before its first 0 to 20 characters; some have the sample alone."""
    sample = F.element_at(F.array(*(F.lit(s) for s in SAMPLES)), (F.pmod("doc_id", F.lit(len(SAMPLES))) + 1).cast("int"))
    cut = F.when(F.col("doc_id") % 3 == 0, F.lit(0)).when(F.col("doc_id") % 3 == 1, F.lit(3)).otherwise(F.lit(20))
    return docs_of(spark, sf).select("doc_id", "lang", F.concat(sample, F.lit(" "), F.left("text", cut)).alias("text"))


S_SAMPLES = "[" + ", ".join(f"'{s}'" for s in SAMPLES) + "]"
S_MIXED = f"m AS (SELECT doc_id, lang, {S_SAMPLES}[doc_id % {len(SAMPLES)} + 1] || ' ' || left(text, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 3 ELSE 20 END) AS text FROM documents)"
S_PROFILE = f"""{S_MIXED}, l AS (SELECT doc_id, lang, regexp_replace(text, '[^\\p{{L}}\\p{{M}}]', '', 'g') AS letters FROM m),
s AS (SELECT doc_id, lang, unnest([{", ".join(f"{{n: length(regexp_replace(letters, '[^{fixed.script_class(s)}]', '', 'g')), script: '{s}'}}" for s in fixed.SCRIPTS)}], recursive := true) FROM l),
profile AS (SELECT doc_id, lang, CASE WHEN sum(n) = 0 THEN 'Zzzz' ELSE arg_max(script, (n, script)) END AS script, CASE WHEN sum(n) = 0 THEN 0 ELSE max(n) / sum(n) END AS confidence FROM s GROUP BY doc_id, lang)"""


@query(f"WITH {S_PROFILE} SELECT doc_id, script, round(confidence, 6)::DOUBLE AS confidence FROM profile")
def script_profile(spark, sf):
    return mixed(spark, sf).select("doc_id", text.dominant_script(F.col("text")).alias("p")).select("doc_id", "p.script", F.round("p.confidence", 6).alias("confidence"))


S_TELLS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fixed.SCRIPT_TELLS.items()) + "}"


@query(f"WITH {S_PROFILE} SELECT lang, CASE WHEN confidence >= 0.8 THEN {S_TELLS}[script] END AS inferred, count(*)::BIGINT AS n FROM profile GROUP BY ALL")
def language_inference(spark, sf):
    return mixed(spark, sf).groupBy("lang", text.infer_language(F.col("text")).alias("inferred")).agg(F.count("*").alias("n"))


S_LANGUAGES = ", ".join(f"('{c}', '{n}', '{s}')" for c, (n, s) in fixed.LANGUAGES.items())
EXTRA_CODES = ["hi", "ur-PK", "zh_Hant", "xx", "m9", ""]


@query(f"""WITH l(code, name, script) AS (VALUES {S_LANGUAGES}), c AS (SELECT DISTINCT lang AS asked FROM documents UNION SELECT unnest({EXTRA_CODES})),
p AS (SELECT asked, lower(split_part(replace(trim(asked), '_', '-'), '-', 1)) AS p FROM c), n AS (SELECT asked, CASE WHEN regexp_full_match(p, '[a-z]{{2,3}}') THEN p END AS code FROM p)
SELECT asked, coalesce(name, n.code) AS name, script FROM n LEFT JOIN l USING (code)""")
def language_table(spark, sf):
    codes = docs_of(spark, sf).select(F.col("lang").alias("asked")).union(spark.createDataFrame([(c,) for c in EXTRA_CODES], "asked string")).distinct()
    return codes.select("asked", text.language_name(F.col("asked")).alias("name"), text.expected_script(F.col("asked")).alias("script"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'empty text; no paragraphs' WHEN doc_id % 7 = 1 THEN 'no paragraphs' WHEN doc_id % 7 = 2 THEN 'span outside of the text'
WHEN doc_id % 7 = 3 AND n_chars > 1 THEN 'spans overlap' ELSE '' END AS problems FROM (SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(trim(text)) > 0)""")
def validate_documents(spark, sf):
    """Documents with spans of paragraphs, most of which have one thing wrong."""
    docs = docs_of(spark, sf).filter("length(trim(text)) > 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.lit(" \n ")).otherwise(F.col("text")))
    n, place = F.length("text"), F.col("doc_id") % 7
    span = lambda a, b: F.struct(F.lit(a).cast("int").alias("start"), b.cast("int").alias("end"))
    spans = F.when(place == 2, F.array(span(0, n + 1))).when((place == 3) & (n > 1), F.array(span(0, n), span(1, n))).when(place.isin(0, 1), F.array().cast("array<struct<start: int, end: int>>")).otherwise(F.array(span(0, n)))
    return corpus.validate(docs.withColumn("spans", spans), spans="spans").select("doc_id", F.array_join("problems", "; ").alias("problems"))


@query(f"WITH {S_CANDIDATES}, k AS (SELECT CASE WHEN kind = 'adjacent' THEN 'trade_notification' ELSE kind END AS kind FROM judged WHERE reason IS NULL) SELECT kind, count(*)::BIGINT AS n, '' AS query, '' AS passage FROM k WHERE kind <> 'trade_notification' GROUP BY kind")
def prefix_regime_check(spark, sf):
    """Of pairs of an asymmetric kind and others, those whose prefixes aren't the ones of an asymmetric encoder."""
    rows = accepted(page_pairs(spark, sf)).withColumn("kind", F.when(F.col("kind") == "adjacent", "trade_notification").otherwise(F.col("kind")))
    return pairs.check_prefixes(rows, "query: ", "passage: ")


@query(f"WITH {S_QA.split('judged AS')[0].rstrip().rstrip(',')} SELECT CASE WHEN length(anchor) < 1 THEN 'short_query' WHEN length(positive) < 1 THEN 'short_answer' ELSE 'accepted' END AS reason, count(*)::BIGINT AS n FROM c GROUP BY 1")
def qa_pairs_naive(spark, sf):
    """The question filter with every rule relaxed: what it takes is what differs from this."""
    return ledger(pairs.question_answers(question_rows(spark, sf), **pairs.NAIVE_QUESTIONS))


# --- text


@query("""WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS t FROM documents), p AS (SELECT lang, t, length(t) - length(regexp_replace(t, '\\p{L}', '', 'g')) AS letters, regexp_extract_all(trim(regexp_replace(t, '\\s+', ' ', 'g')), '[^ ]+') AS w FROM l),
j AS (SELECT lang, NOT regexp_matches(t, '\\.{4,}') AND length(t) - length(replace(t, '*', '')) <= 1 AND length(t) - length(regexp_replace(t, '\\p{Nd}', '', 'g')) <= 0.12 * length(t) AND letters > 0
AND length(t) - length(regexp_replace(t, '\\p{Ll}', '', 'g')) >= 0.64 * letters AND ((length(t) - length(replace(t, '. ', ''))) / 2 >= 2 OR rtrim(t, ' ') LIKE '%.') AND NOT regexp_matches(lower(t), 'appellate jurisdiction|original jurisdiction|from the judgment and order|advs?\\.|for the appellant|for the respondent|for the appearing parties|for the petitioner|counsel for') AS prose,
length(t) BETWEEN 70 AND 190 AND regexp_matches(t, '^\\p{Lu}') AND rtrim(t, ' ') LIKE '%.' AND NOT coalesce(lower(regexp_extract(w[1], '^[\\p{L}\\p{N}_]*')) IN ('he','she','it','they','them','this','that','these','those','but','and','however','also','then','there','his','her','their','such','so','meanwhile','instead','yet','still','thus','hence'), false)
AND (NOT regexp_matches(array_to_string(w[1:4], ' '), '(?i)(^|[^\\p{L}\\p{N}_])(he|she|it|they|them|his|her|their|this|these)($|[^\\p{L}\\p{N}_])') OR lower(regexp_extract(w[1], '^[\\p{L}\\p{N}_]*')) IN ('the', 'a', 'an')) AS alone FROM p)
SELECT lang, count(*) FILTER (WHERE prose)::BIGINT AS prose, count(*) FILTER (WHERE alone)::BIGINT AS alone, count(*)::BIGINT AS n FROM j GROUP BY lang""")
def prose_filters(spark, sf):
    rows = docs_of(spark, sf).select("lang", F.explode(F.split("text", "\n", -1)).alias("t"))
    return rows.groupBy("lang").agg(F.count_if(prose.is_prose(F.col("t"))).alias("prose"), F.count_if(prose.stands_alone(F.col("t"))).alias("alone"), F.count("*").alias("n"))


@query("""SELECT doc_id, left(sha256(strlen(lang)::VARCHAR || ':' || lang || strlen(source)::VARCHAR || ':' || source || strlen(text)::VARCHAR || ':' || text), 16) AS items,
left(sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","missing":null,"source":"' || source || '"}'), 16) AS object FROM documents""")
def content_hashes(spark, sf):
    items = F.array("lang", "source", "text")
    fields = {"source": F.col("source"), "lang": F.col("lang"), "doc_id": F.col("doc_id"), "missing": F.lit(None).cast("string")}
    return docs_of(spark, sf).select("doc_id", text.hash_iterable(items).alias("items"), text.hash_object(fields).alias("object"))


@query(f"""WITH {S_ENCODED}, d AS (SELECT doc_id, list_transform(ids, lambda x, i: {{id: x, h: sha256('0:' || doc_id || ':' || (i - 1))}}) AS d FROM enc),
u AS (SELECT doc_id, list_transform(d, lambda x: {{id: x.id, a: ('0x' || substr(x.h, 1, 8))::BIGINT / 4294967296, b: ('0x' || substr(x.h, 9, 8))::BIGINT / 4294967296, c: ('0x' || substr(x.h, 17, 8))::BIGINT}}) AS d FROM d)
SELECT doc_id, sha256(array_to_string(list_transform(d, lambda x: CASE WHEN x.id < 4 OR x.a >= 0.15 THEN x.id WHEN x.b < 0.8 THEN 1 WHEN x.b < 0.9 THEN x.c % 1996 + 4 ELSE x.id END), ',')) AS masked,
sha256(array_to_string(list_transform(d, lambda x: CASE WHEN x.id >= 4 AND x.a < 0.15 THEN x.id ELSE -100 END), ',')) AS labels FROM u""")
def masked_tokens(spark, sf):
    out = vocab.mask_tokens(vocab.encode(docs_of(spark, sf), vocab_of(spark, sf)[1]), vocab_size=2000)
    sha = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ",").cast("binary"), 256).alias(c)
    return out.select("doc_id", sha("masked"), sha("labels"))


# --- readers and slices


@query(f"""SELECT 'jsonl' AS format, count(*)::BIGINT AS documents, sum(length(text))::BIGINT AS characters FROM documents WHERE {s_ws("text")} <> ''
UNION ALL SELECT 'lines', count(*), sum(length(t)) FROM (SELECT {s_ws("unnest(string_split(text, chr(10)))")} AS t FROM documents) WHERE t <> ''
UNION ALL SELECT 'csv', count(*), sum(length(q) + length(a)) FROM (SELECT {s_ws("source || ' ' || lang")} AS q, {s_ws("text")} AS a FROM documents) WHERE a <> ''""")
def readers_round_trip(spark, sf):
    """Documents written as JSON Lines, as lines and as a table, and what the readers find there."""
    from corpusloom.sources import readers, writers

    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/readers-{uuid.uuid4().hex}"
    docs = docs_of(spark, sf)
    writers.write_jsonl(docs.select(F.col("doc_id").cast("string").alias("id"), "text", "lang"), f"{root}/jsonl", gzip=True)
    writers.write_sentences(corpus.lines(docs), f"{root}/lines", "line")
    sheet = docs.select(F.concat_ws(" ", "source", "lang").alias("QueryText"), F.col("text").alias("KccAns"))
    sheet.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/csv")
    size = lambda df, name, chars: df.agg(F.lit(name).alias("format"), F.count("*").alias("documents"), F.sum(long(chars)).alias("characters"))
    found = size(readers.read_jsonl(spark, f"{root}/jsonl"), "jsonl", F.length("text"))
    found = found.unionByName(size(readers.read_lines(spark, f"{root}/lines"), "lines", F.length("text")))
    return found.unionByName(size(readers.read_questions(spark, f"{root}/csv"), "csv", F.length("question") + F.length("answer")))


@query(f"""WITH s AS (SELECT doc_id, lang, {s_ws("source || ' ' || lang")} AS source, {s_ws("left(text, 200)")} AS target FROM documents)
SELECT lang, source, target FROM s WHERE length(source) >= 6 AND length(target) >= 10 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 20""")
def bitext_slices(spark, sf):
    from corpusloom.sources import readers

    rows = docs_of(spark, sf).select("doc_id", "lang", F.struct(F.concat_ws(" ", "source", "lang").alias("en"), F.left("text", F.lit(200)).alias("xx")).alias("translation"))
    out = readers.bitext_slices(rows.filter("length(translation.en) >= 6"), "translation.en", "translation.xx", ["lang"], order="doc_id", at_least=6, at_most_rows=None)
    out = out.filter("length(target) >= 10")
    return readers.bitext_slices(out.select("lang", "place", "source", "target"), "source", "target", ["lang"], order="place", at_least=6, at_most_rows=20).select("lang", "source", "target")


@query("""WITH p AS (SELECT doc_id, doc_id // 32 AS batch, 'p' || (doc_id * 7 % 50) AS positive, ['p' || (doc_id % 7), 'n' || (doc_id % 5), 'n' || (doc_id % 3 + 10)] AS negatives FROM documents),
n AS (SELECT batch, doc_id, unnest(negatives) AS t, generate_subscripts(negatives, 1) AS i FROM p), f AS (SELECT batch, t, min((doc_id, i)) AS pl FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.batch = n.batch AND p.positive = n.t) GROUP BY ALL),
a AS (SELECT batch, positive AS text, 0 AS side, (doc_id, 0) AS pl FROM p UNION ALL SELECT batch, t, 1, pl FROM f)
SELECT batch::BIGINT AS batch, (row_number() OVER (PARTITION BY batch ORDER BY side, pl) - 1)::INT AS "column", text FROM a""")
def candidate_columns(spark, sf):
    d = F.col("doc_id")
    label = lambda name, c: F.concat(F.lit(name), c.cast("string"))
    rows = docs_of(spark, sf).select("doc_id", F.expr("doc_id div 32").alias("batch"), label("p", d * 7 % 50).alias("positive"), F.array(label("p", d % 7), label("n", d % 5), label("n", d % 3 + 10)).alias("negatives"))
    return select.candidate_columns(rows, "batch", "doc_id")


# --- judged words and analogies

S_JUDGED = """j AS (SELECT a.vec_id AS id, a.vec_id + CASE WHEN a.vec_id % 10 = 9 THEN 1000000 ELSE 1 END AS other, (a.vec_id * 37 % 101)::DOUBLE AS score FROM embeddings a),
k AS (SELECT round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS x, score AS y FROM j JOIN embeddings a ON a.vec_id = j.id JOIN embeddings b ON b.vec_id = j.other)"""


@query(f"""WITH {S_JUDGED}, r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b FROM k)
SELECT count(*)::BIGINT AS scored, round(corr(a, b), 6) AS correlation, round(count(*) / (SELECT count(*) FROM j), 6) AS coverage FROM r""")
def word_similarity(spark, sf):
    rows = vectors_of(spark, sf).select(F.col("id").cast("string").alias("word"), "id", "v")
    other = F.col("id") + F.when(F.col("id") % 10 == 9, F.lit(1_000_000)).otherwise(F.lit(1))
    judged = rows.select(F.col("word").alias("word_a"), other.cast("string").alias("word_b"), (F.col("id") * 37 % 101).cast("double").alias("score"))
    out = evaluate.similarity_correlation(rows.select("word", "v"), judged)
    return out.select("scored", F.round("correlation", 6).alias("correlation"), F.round("coverage", 6).alias("coverage"))


@query(f"""WITH {S_UNIT}, n AS (SELECT count(*) AS n FROM u), q AS (SELECT a.vec_id AS qid, e.vec_id AS expected, list_transform(range(1, len(a.v) + 1), lambda i: b.v[i] - a.v[i] + c.v[i]) AS v FROM u a JOIN u b ON b.vec_id = a.vec_id + 1 JOIN u c ON c.vec_id = a.vec_id + 2
JOIN u e ON e.vec_id = a.vec_id + 3 AND a.vec_id % 50 = 0 WHERE a.vec_id % 25 = 0),
t AS (SELECT qid, expected, u.vec_id AS id FROM q JOIN u ON u.vec_id NOT IN (qid, qid + 1, qid + 2) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(q.v, u.v), 9) DESC, u.vec_id) = 1)
SELECT count(*)::BIGINT AS attempted, round(avg((id = expected)::INT), 6) AS accuracy, round(count(*) / (SELECT count(*) FROM u WHERE vec_id % 25 = 0), 6) AS coverage FROM t""")
def analogy_accuracy(spark, sf):
    rows = vectors_of(spark, sf)
    expected = F.when(F.col("id") % 50 == 0, F.col("id") + 3).otherwise(F.lit(-1).cast("long"))
    questions = rows.filter("id % 25 = 0").select(F.col("id").alias("question_id"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") + 2).alias("c"), expected.alias("expected"))
    out = evaluate.analogy_accuracy(rows, questions)
    return out.select("attempted", F.round("accuracy", 6).alias("accuracy"), F.round("coverage", 6).alias("coverage"))


@query(f"WITH {S_LABELLED} SELECT count(*)::BIGINT AS n, round(avg((CASE WHEN a >= 300 THEN 1 ELSE 0 END = b)::INT), 6) AS accuracy FROM x")
def prediction_accuracy(spark, sf):
    labels = table(spark, sf, "labels").filter("quality IS NOT NULL").select("doc_id", F.col("quality").alias("expected"))
    rows = docs_of(spark, sf).join(labels, "doc_id").withColumn("predicted", (F.length("text") >= 300).cast("int"))
    return evaluate.accuracy(rows, "predicted", "expected").select("n", F.round("accuracy", 6).alias("accuracy"))


# --- streams


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream; a stream reads folders: the table's own, or the one that holds its file."""
    source = spark.readStream.schema(table(spark, sf, name).schema)
    file = f"{name}.parquet"
    return source.option("pathGlobFilter", file).parquet(sf) if is_file(spark, f"{sf}/{file}") else source.parquet(f"{sf}/{file}")


def drained(stream: DataFrame) -> DataFrame:
    from corpusloom.streaming import dedup

    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    dedup.drain(stream, f"{root}/out", f"{root}/state")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query(f"SELECT doc_id, 1::BIGINT AS survivors FROM documents QUALIFY row_number() OVER (PARTITION BY {s_ws('text')} ORDER BY doc_id) = 1")
def stream_dedup(spark, sf):
    """How many rows of each text the streaming deduplicator lets through, with the text's first id."""
    from corpusloom.streaming import dedup

    survivors = drained(dedup.deduplicate_stream(stream_of(spark, sf, "documents").select("doc_id", "text")).select("digest"))
    seen = survivors.groupBy("digest").agg(F.count("*").alias("survivors"))
    first = docs_of(spark, sf).select(corpus.dedup_key().alias("digest"), "doc_id").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return first.join(seen, "digest").select("doc_id", "survivors")


S_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query(f"""WITH e AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b, event_type FROM events), w AS (SELECT b - i * INTERVAL 30 MINUTE AS start, event_type FROM e, (SELECT unnest([0, 1]) AS i))
SELECT start::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n FROM w WHERE start + INTERVAL 1 HOUR <= {S_CLOSED} GROUP BY ALL""")
def stream_sliding_windows(spark, sf):
    """Windows of an hour every half hour that the watermark has closed."""
    from corpusloom.streaming import dedup

    out = drained(dedup.windowed_counts(stream_of(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", "event_type", "1 hour", "30 minutes"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


@query(f"""WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), g AS (SELECT *, sum((before IS NULL OR ts - before >= INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o),
s AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM g GROUP BY user_id, g) SELECT user_id, start::TIMESTAMP AS start, finish::TIMESTAMP AS finish, n::BIGINT AS n FROM s WHERE finish <= {S_CLOSED}""")
def stream_sessions(spark, sf):
    """Sessions of users, closed by the watermark."""
    from corpusloom.streaming import dedup

    out = drained(dedup.session_counts(stream_of(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id"), "ts", "user_id"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n")
