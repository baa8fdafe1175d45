"""Registered queries: each operator on the shared tables, with the same question in plain SQL.

The SQL is written on its own, for DuckDB over the same Parquet files, as an independent check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import fixed, text
from corpusloom.operators import corpus, evaluate, joins, pairs, select, spans, vectors, vocab
from corpusloom.plans.ledger import accepted, ledger, numbered
from corpusloom.runtime import spread, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- pieces of the SQL side


def s_ws(c: str) -> str:
    return f"trim(regexp_replace({c}, '{fixed.WS}', ' ', 'g'))"


def s_fold(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def s_words(c: str) -> str:
    return f"regexp_extract_all({s_fold(c)}, '{fixed.WORD}')"


def s_units(c: str) -> str:
    return f"list_distinct({s_words(c)})"


def s_overlap(a: str, p: str) -> str:
    return f"CASE WHEN len({s_units(a)}) = 0 THEN 0.0 ELSE len(list_intersect({s_units(a)}, {s_units(p)})) / len({s_units(a)}) END"


def s_strip_tags(c: str) -> str:
    c = f"regexp_replace({c}, '(?is)<(?:script|style)\\b[^>]*>.*?</(?:script|style)>', ' ', 'g')"
    c = f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"
    for entity, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{character}')"
    return s_ws(c)


def s_body(c: str) -> str:
    return f"regexp_replace({c}, '^{fixed.WS}|{fixed.WS}$', '', 'g')"


S_TEXT_WORD = fixed.TEXT_WORD.replace("'", "''")
S_LINES = "lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"
S_REASON = "coalesce(reason, 'accepted') AS reason"
LATIN = fixed.script_class("Latn")


def docs_of(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))


def long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# --- curation


@query(f"""SELECT lang, count(*)::BIGINT AS documents, sum(len(list_filter(string_split(text, chr(10)), lambda s: {s_ws("s")} <> '')))::BIGINT AS sentences,
sum(length(text))::BIGINT AS characters, sum(len(regexp_extract_all(text, '{S_TEXT_WORD}')))::BIGINT AS words FROM documents GROUP BY lang""")
def corpus_statistics_by_language(spark, sf):
    return corpus.statistics(docs_of(spark, sf), "lang")


@query(f"""WITH {S_LINES} SELECT lang, count(*)::BIGINT AS n, sum(length(line))::BIGINT AS total, min(length(line))::BIGINT AS minimum, max(length(line))::BIGINT AS maximum,
round(avg(length(line)), 6) AS mean, quantile_cont(length(line), 0.5)::DOUBLE AS median, round(quantile_cont(length(line)::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(length(line)::DOUBLE, 0.99), 6) AS p99
FROM lines WHERE {s_ws("line")} <> '' GROUP BY lang""")
def line_length_summary(spark, sf):
    rows = corpus.lines(docs_of(spark, sf), "lang").filter(text.collapse(F.col("line")) != "").withColumn("chars", F.length("line"))
    out = corpus.length_summary(rows, "chars", "lang")
    return out.select("lang", "n", "total", "minimum", "maximum", F.round("mean", 6).alias("mean"), "median", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"))


@query(f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY {s_ws('text')} ORDER BY doc_id) = 1")
def exact_dedup(spark, sf):
    return corpus.deduplicate(docs_of(spark, sf)).select("doc_id", "lang")


@query(f"SELECT sha256({s_ws('text')}) AS digest, min(doc_id) AS first_id, count(*)::BIGINT AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedup_groups(spark, sf):
    return corpus.exact_duplicates(docs_of(spark, sf)).filter("copies > 1")


S_SENTENCE = """CASE WHEN length(b) = 0 THEN 'blank' WHEN length(b) < 2 THEN 'too_short' WHEN length(b) > 10000 THEN 'too_long'
WHEN NOT regexp_matches(b, '\\p{L}') THEN 'no_letters' WHEN length(b) - length(replace(b, chr(65533), '')) > 0.10 * length(b) THEN 'encoding_damage' ELSE 'accepted' END"""


@query(f"WITH {S_LINES} SELECT lang, {S_SENTENCE} AS reason, count(*)::BIGINT AS n FROM (SELECT lang, {s_body('line')} AS b FROM lines) GROUP BY ALL")
def sentence_filter_ledger(spark, sf):
    return ledger(corpus.sentence_filter(corpus.lines(docs_of(spark, sf), "lang")), "lang")


@query(f"""WITH {S_LINES}, c AS (SELECT {S_SENTENCE} AS reason, count(*) AS n FROM (SELECT {s_body("line")} AS b FROM lines) GROUP BY 1)
SELECT reason, n::BIGINT AS n, round(n / (SELECT sum(n) FROM c), 9) AS share FROM c""")
def filter_report(spark, sf):
    out = corpus.filter_report(corpus.sentence_filter(corpus.lines(docs_of(spark, sf))))
    return out.select("reason", "n", F.round("share", 9).alias("share"))


@query(f"""WITH kept AS (SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY {s_ws("text")} ORDER BY doc_id) = 1),
ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM kept)
SELECT doc_id, count(*)::BIGINT AS sentences FROM (SELECT doc_id, b FROM (SELECT doc_id, {s_body("line")} AS b FROM ls) WHERE {S_SENTENCE.replace("< 2", "< 1")} = 'accepted') GROUP BY doc_id""")
def canonical_scan(spark, sf):
    return corpus.stream_documents(docs_of(spark, sf)).select("doc_id", long(F.size("sentences")).alias("sentences"))


S_MARKUP = " OR ".join(f"contains(text, '{m}')" for m in fixed.MARKUP)


@query(f"""WITH d AS (SELECT doc_id, text, lang, {s_ws("text")} AS b FROM documents), n AS (SELECT count(*) AS n FROM d),
hits AS (
SELECT doc_id, 'empty' AS code FROM d WHERE b = ''
UNION ALL SELECT doc_id, 'too_short' FROM d WHERE b <> '' AND length(b) < 40
UNION ALL SELECT doc_id, 'no_language' FROM d WHERE b <> '' AND coalesce(lang, '') = ''
UNION ALL SELECT doc_id, 'unknown_script' FROM d WHERE b <> '' AND NOT regexp_matches(b, '[{LATIN}]')
UNION ALL SELECT doc_id, 'markup' FROM d WHERE b <> '' AND ({S_MARKUP})
UNION ALL SELECT doc_id, 'encoding_damage' FROM d WHERE b <> '' AND length(text) - length(replace(text, chr(65533), '')) > 0.001 * length(text)
UNION ALL SELECT doc_id, 'single_sentence' FROM d WHERE b <> '' AND len(list_filter(string_split(text, chr(10)), lambda s: {s_ws("s")} <> '')) <= 1
UNION ALL SELECT doc_id, 'duplicate' FROM (SELECT doc_id, row_number() OVER (PARTITION BY b ORDER BY doc_id) AS r FROM d WHERE b <> '') WHERE r > 1),
c AS (SELECT code, count(*)::BIGINT AS n, list_sort(list(doc_id))[1:3] AS ex FROM hits GROUP BY code)
SELECT code, CASE WHEN code IN ('empty', 'markup') THEN CASE WHEN c.n / n.n < 0.01 THEN 'warning' ELSE 'error' END WHEN code = 'single_sentence' THEN 'info' ELSE 'warning' END AS severity,
c.n AS n, round(c.n / n.n, 9) AS share, array_to_string(ex, ',') AS examples FROM c, n""")
def corpus_audit(spark, sf):
    out = corpus.audit(docs_of(spark, sf))
    return out.select("code", "severity", "n", F.round("share", 9).alias("share"), F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


S_LETTERS = "regexp_replace(text, '[^\\p{L}\\p{M}]', '', 'g')"
S_LATIN = f"length(regexp_replace({S_LETTERS}, '[^{LATIN}]', '', 'g'))"
S_OTHER = " + ".join(f"length(regexp_replace({S_LETTERS}, '[^{fixed.script_class(s)}]', '', 'g'))" for s in fixed.SCRIPTS if s != "Latn")


@query("SELECT lang, script, count(*)::BIGINT AS documents FROM (SELECT lang, CASE WHEN regexp_matches(text, '[" + LATIN + "]') THEN 'Latn' ELSE 'Zzzz' END AS script FROM documents) GROUP BY ALL")
def script_statistics(spark, sf):
    return corpus.script_statistics(docs_of(spark, sf), "lang").select("lang", "script", "documents")


@query("""SELECT code, CASE WHEN regexp_full_match(p, '[a-z]{2,3}') THEN p END AS language FROM (SELECT code, lower(split_part(replace(trim(code), '_', '-'), '-', 1)) AS p FROM (
SELECT DISTINCT unnest([lang, upper(lang), ' ' || lang || '-Latn ', lang || '_XX', lang || '9', source]) AS code FROM documents))""")
def language_codes(spark, sf):
    code = F.explode(F.array(F.col("lang"), F.upper("lang"), F.concat(F.lit(" "), "lang", F.lit("-Latn ")), F.concat("lang", F.lit("_XX")), F.concat("lang", F.lit("9")), F.col("source")))
    return docs_of(spark, sf).select(code.alias("code")).distinct().select("code", text.language_code(F.col("code")).alias("language"))


@query(f"""SELECT doc_id, sha256({s_ws("regexp_replace(text, '[\\x{200b}\\x{feff}]', '', 'g')")}) AS whitespace, sha256({s_fold("text")}) AS folded, left(sha256(text), 16) AS digest,
sha256({s_fold(s_ws("replace(text, '_', ' ')"))}) AS title_key FROM documents""")
def normalize_text(spark, sf):
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    t = F.col("text")
    return docs_of(spark, sf).select("doc_id", sha(text.clean_whitespace(t)).alias("whitespace"), sha(text.fold(t)).alias("folded"), text.digest(t).alias("digest"), sha(text.title_key(t)).alias("title_key"))


@query("SELECT doc_id, sha256(strip_accents(text)) AS stripped, sha256(nfc_normalize(text)) AS nfc FROM documents")
def unicode_normal_forms(spark, sf):
    from corpusloom.functions import unicode

    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return docs_of(spark, sf).select("doc_id", sha(unicode.strip_accents(F.col("text"))).alias("stripped"), sha(unicode.normal_form(F.col("text"), "NFC")).alias("nfc"))


@query(f"SELECT page_id, sha256({s_strip_tags('html')}) AS digest, length({s_strip_tags('html')})::BIGINT AS n_chars FROM pages")
def html_strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_tags(F.col("html")).alias("t")).select("page_id", F.sha2(F.col("t").cast("binary"), 256).alias("digest"), long(F.length("t")).alias("n_chars"))


@query(f"""WITH {S_LINES}, t AS (SELECT doc_id, line_no, line FROM lines)
SELECT kind, count(*)::BIGINT AS tokens, count(DISTINCT token)::BIGINT AS distinct_tokens FROM (
SELECT 'whitespace' AS kind, unnest(regexp_extract_all(line, '[^{fixed.WS[1:-2]}]+')) AS token FROM t
UNION ALL SELECT 'punctuation', unnest(regexp_extract_all(line, '[\\p{{P}}\\p{{S}}]|[^{fixed.WS[1:-2]}\\p{{P}}\\p{{S}}]+')) FROM t
UNION ALL SELECT 'char', unnest(regexp_extract_all(line, '[^{fixed.WS[1:-2]}]')) FROM t) GROUP BY kind""")
def pre_tokenizers(spark, sf):
    docs = docs_of(spark, sf)
    kinds = [docs.select(F.lit(k).alias("kind"), F.explode(text.pre_tokens(F.col("text"), k)).alias("token")) for k in ("whitespace", "punctuation", "char")]
    rows = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy("kind", "token").agg(F.count("*").alias("n"))
    return rows.groupBy("kind").agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct_tokens"))


@query("""WITH b AS (SELECT doc_id, string_split(text || chr(10) || ' ' || chr(10) || lang, chr(10) || ' ' || chr(10)) AS p FROM documents)
SELECT doc_id, 0::BIGINT AS index, (length(p[1]) - length(ltrim(p[1])))::BIGINT AS begin, length(rtrim(p[1]))::BIGINT AS "end" FROM b WHERE trim(p[1]) <> ''
UNION ALL SELECT doc_id, CASE WHEN trim(p[1]) = '' THEN 0 ELSE 1 END, length(p[1]) + 3, length(p[1]) + 3 + length(p[2]) FROM b""")
def paragraph_spans(spark, sf):
    docs = docs_of(spark, sf).withColumn("text", F.concat("text", F.lit("\n \n"), "lang"))
    return corpus.paragraph_spans(docs)


# --- pairs

S_PAGE = f"""pg AS (SELECT page_id AS doc_id, regexp_extract(html, 'lang="([a-z]+)"', 1) AS language, {s_strip_tags("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title,
list_filter(list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda p: {s_strip_tags("p")}), lambda p: p <> '') AS ps FROM pages)"""
S_CANDIDATES = f"""{S_PAGE}, cand AS (
SELECT doc_id, 0 AS kr, 'title_lead' AS kind, 0::BIGINT AS position, title AS anchor, ps[1] AS positive FROM pg WHERE title <> '' AND len(ps) > 0
UNION ALL SELECT doc_id, 1, 'heading_section', 0, title, ps[2] FROM pg WHERE title <> '' AND len(ps) > 1
UNION ALL SELECT doc_id, 2, 'adjacent', i - 1, ps[i], ps[i + 1] FROM (SELECT doc_id, ps, unnest(range(1, len(ps))) AS i FROM pg)),
j1 AS (SELECT doc_id, kr, kind, position, anchor, left(positive, 2000) AS positive, CASE WHEN length(anchor) < 8 THEN 'short_anchor' WHEN length(positive) < 100 THEN 'short_positive' END AS r1 FROM cand),
j2 AS (SELECT *, CASE WHEN r1 IS NULL THEN {s_overlap("anchor", "positive")} END AS overlap FROM j1),
j3 AS (SELECT *, CASE WHEN r1 IS NOT NULL THEN r1 WHEN overlap > 0.9 THEN 'overlap' END AS r2 FROM j2),
judged AS (SELECT *, CASE WHEN r2 IS NOT NULL THEN r2 WHEN row_number() OVER (PARTITION BY r2 IS NULL, anchor, positive ORDER BY doc_id, kr, position) > 1 THEN 'duplicate' END AS reason FROM j3)"""


def page_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as documents: the headline is the title, each <p> a paragraph."""
    strip = text.strip_tags
    rows = spread(table(spark, sf, "pages").select("page_id", "html")).select(
        F.col("page_id").alias("doc_id"),
        F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("language"),
        strip(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)).alias("title"),
        F.filter(F.transform(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1)), strip), lambda p: p != "").alias("paragraphs"),
    )
    section = F.array(F.struct(F.col("title").alias("heading"), F.get("paragraphs", F.lit(1)).alias("text")))
    return rows.withColumn("sections", F.filter(section, lambda s: s["text"].isNotNull()))


def page_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.structural_pairs(page_documents(spark, sf), overlap_at_most=0.9)


@query(f"WITH {S_CANDIDATES} SELECT doc_id, kind, position, sha256(anchor) AS anchor, sha256(positive) AS positive, round(overlap, 4) AS overlap FROM judged WHERE reason IS NULL")
def structural_pairs(spark, sf):
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(c)
    return accepted(page_pairs(spark, sf)).select("doc_id", "kind", "position", sha("anchor"), sha("positive"), F.round("overlap", 4).alias("overlap"))


@query(f"WITH {S_CANDIDATES} SELECT kind, {S_REASON}, count(*)::BIGINT AS n FROM judged GROUP BY ALL")
def pair_ledger_by_kind(spark, sf):
    return pairs.pair_ledger(page_pairs(spark, sf))


@query(f"WITH {S_CANDIDATES} SELECT kind, count(*)::BIGINT AS n, round(avg(overlap), 6) AS mean_overlap, avg(overlap) > 0.75 AS leaky FROM judged WHERE reason IS NULL GROUP BY kind")
def leaky_kinds(spark, sf):
    out = pairs.pair_statistics(accepted(page_pairs(spark, sf)))
    return out.withColumn("mean_overlap", F.round("mean_overlap", 6))


@query(f"""WITH {S_LINES}, l AS (SELECT doc_id, lang, list({s_ws("line")} ORDER BY line_no) AS ps FROM lines GROUP BY ALL),
c AS (SELECT doc_id, ps[i] AS anchor, ps[i + 1] AS positive, i - 1 AS position FROM (SELECT doc_id, ps, unnest(range(1, len(ps))) AS i FROM (SELECT doc_id, list_filter(ps, lambda p: p <> '') AS ps FROM l))),
j AS (SELECT *, CASE WHEN length(anchor) < 8 THEN 'short_anchor' WHEN length(positive) < 100 THEN 'short_positive' END AS r FROM c),
k AS (SELECT *, CASE WHEN r IS NOT NULL THEN r WHEN row_number() OVER (PARTITION BY r IS NULL, anchor, left(positive, 2000) ORDER BY doc_id, position) > 1 THEN 'duplicate' END AS reason FROM j)
SELECT {S_REASON}, count(*)::BIGINT AS n FROM k GROUP BY 1""")
def line_adjacent_pairs(spark, sf):
    found = F.filter(F.transform(F.split("text", "\n", -1), text.collapse), lambda p: p != "")
    docs = docs_of(spark, sf).select("doc_id", F.col("lang").alias("language"), F.lit(None).cast("string").alias("title"), found.alias("paragraphs"), F.lit(None).cast("array<struct<heading: string, text: string>>").alias("sections"))
    return ledger(pairs.structural_pairs(docs))


S_QA = f"""q AS (SELECT conv_id AS doc_id, turn AS position, role, {s_ws("coalesce(text, '')")} AS anchor, lead({s_ws("coalesce(text, '')")}) OVER w AS positive, lead(role) OVER w AS next_role
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT doc_id, position, anchor, positive, count(*) OVER (PARTITION BY {s_fold("positive")}) AS times FROM q WHERE role = 'user' AND next_role = 'assistant'),
j AS (SELECT *, CASE WHEN {s_fold("anchor")} IN ({", ".join(f"'{w}'" for w in fixed.JUNK_QUESTIONS)}) OR regexp_full_match(anchor, '[^\\p{{L}}]+') THEN 'junk_query' WHEN length(anchor) < 8 THEN 'short_query'
WHEN length(positive) < 20 THEN 'short_answer' WHEN times >= 50 THEN 'boilerplate_answer' END AS r FROM c),
k AS (SELECT *, CASE WHEN r IS NOT NULL THEN r WHEN row_number() OVER (PARTITION BY r IS NULL, {s_fold("anchor")}, {s_fold("positive")} ORDER BY doc_id, position) > 1 THEN 'duplicate' END AS r2 FROM j),
judged AS (SELECT *, CASE WHEN r2 IS NULL THEN {s_overlap("anchor", "positive")} END AS overlap FROM k),
done AS (SELECT *, CASE WHEN r2 IS NOT NULL THEN r2 WHEN overlap > 0.7 THEN 'overlap' END AS reason FROM judged)"""


def question_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that follow questions: neighbouring turns meet on the turn's place in its conversation."""
    from pyspark.sql.window import Window

    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = turns.withColumn("answer", F.lead("text").over(order)).withColumn("next_role", F.lead("role").over(order))
    return turns.filter("role = 'user' AND next_role = 'assistant'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), F.col("text").alias("question"), "answer")


@query(f"WITH {S_QA} SELECT {S_REASON}, count(*)::BIGINT AS n, round(avg(overlap), 6) AS mean_overlap FROM done GROUP BY 1")
def qa_pairs_ledger(spark, sf):
    rows = pairs.question_answers(question_rows(spark, sf))
    return rows.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg("overlap"), 6).alias("mean_overlap"))


@query(f"WITH {S_QA} SELECT doc_id, position, sha256(anchor) AS anchor, sha256(positive) AS positive, round(overlap, 4) AS overlap FROM done WHERE reason IS NULL")
def qa_pairs(spark, sf):
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(c)
    return accepted(pairs.question_answers(question_rows(spark, sf))).select("doc_id", "position", sha("anchor"), sha("positive"), F.round("overlap", 4).alias("overlap"))


@query(f"WITH {S_LINES}, c AS (SELECT {s_fold(s_ws('line'))} AS line, count(*)::BIGINT AS n FROM lines GROUP BY 1) SELECT sha256(line) AS line, n FROM c WHERE line <> '' AND n >= 10")
def boilerplate_lines(spark, sf):
    rows = corpus.lines(docs_of(spark, sf)).select(text.fold(text.collapse(F.col("line"))).alias("t")).filter("t <> ''")
    return rows.groupBy(F.sha2(F.col("t").cast("binary"), 256).alias("line")).agg(F.count("*").alias("n")).filter("n >= 10")


S_NOTICE = f"""n AS (SELECT doc_id, {s_ws("split_part(text, chr(10), 1)")} AS anchor, {s_ws("substr(text, length(split_part(text, chr(10), 1)) + 2)")} AS positive FROM documents),
j AS (SELECT *, CASE WHEN regexp_matches(concat_ws(' ', anchor, positive), '{fixed.WITHDRAWN}') THEN 'withdrawn' WHEN regexp_matches(concat_ws(' ', anchor, positive), '{fixed.SUPERSEDED}') THEN 'superseded'
WHEN regexp_matches(positive, '{fixed.ANNEXURE}') THEN 'annexure_only' WHEN anchor = '' THEN 'empty_subject' WHEN length(anchor) < 12 THEN 'short_subject' WHEN length(positive) < 40 THEN 'short_body' END AS r FROM n),
k AS (SELECT *, CASE WHEN r IS NOT NULL THEN r WHEN row_number() OVER (PARTITION BY r IS NULL, {s_fold("anchor")}, {s_fold("positive")} ORDER BY doc_id) > 1 THEN 'duplicate' END AS r2 FROM j),
done AS (SELECT *, CASE WHEN r2 IS NOT NULL THEN r2 WHEN {s_overlap("positive", "anchor")} > 0.7 THEN 'overlap' END AS reason FROM k)"""


@query(f"WITH {S_NOTICE} SELECT {S_REASON}, count(*)::BIGINT AS n FROM done GROUP BY 1")
def notice_ledger(spark, sf):
    first = F.split("text", "\n", -1)[0]
    rows = docs_of(spark, sf).select("doc_id", first.alias("subject"), F.substring("text", F.length(first) + 2, F.length("text")).alias("body"))
    return ledger(pairs.notices(rows))


S_RANKED = "ranked AS (SELECT doc_id, lang, source, text, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rk FROM documents)"


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their place among those of their source and language."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("source", "lang").orderBy("doc_id")
    ids = docs_of(spark, sf).select("doc_id", F.row_number().over(order).alias("rk"))
    return docs_of(spark, sf).join(ids, "doc_id")


@query(f"""WITH l AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, text FROM documents WHERE lang = 'fr'), r AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, text FROM documents WHERE lang = 'de'),
z AS (SELECT coalesce(l.n, r.n) AS n, {s_ws("l.text")} AS anchor, {s_ws("r.text")} AS positive FROM l FULL JOIN r ON l.n = r.n),
j AS (SELECT *, CASE WHEN length(anchor) < 10 THEN 'short_anchor' WHEN length(positive) < 10 THEN 'short_positive' WHEN length(positive) > 2000 THEN 'long_positive' WHEN anchor = positive THEN 'identical' END AS r FROM z WHERE anchor IS NOT NULL AND positive IS NOT NULL),
k AS (SELECT CASE WHEN r IS NOT NULL THEN r WHEN row_number() OVER (PARTITION BY r IS NULL, anchor, positive ORDER BY n) > 1 THEN 'duplicate' END AS reason FROM j)
SELECT {S_REASON}, count(*)::BIGINT AS n FROM k GROUP BY 1 UNION ALL SELECT 'misaligned', count(*)::BIGINT FROM z WHERE anchor IS NULL OR positive IS NULL""")
def bitext_zip(spark, sf):
    side = lambda lang: numbered(docs_of(spark, sf).filter(F.col("lang") == lang), [F.col("doc_id")]).select("n", F.col("text").alias("line"))
    zipped = joins.zip_lines(side("fr"), side("de"))
    whole = zipped.filter(F.col("anchor").isNotNull() & F.col("positive").isNotNull())
    rows = whole.select(F.col("n").alias("doc_id"), F.col("n").alias("position"), "anchor", "positive")
    lost = joins.misaligned(zipped).agg(F.count("*").alias("n")).select(F.lit("misaligned").alias("reason"), "n")
    return ledger(pairs.bitext(rows)).unionByName(lost)


S_ALIGN = f"""src AS (SELECT doc_id, title, ps[1] AS lead FROM pg WHERE language = 'en' AND title <> '' AND len(ps) > 0), tgt AS (SELECT doc_id, title, ps[1] AS lead, {s_fold(s_ws("replace(title, '_', ' ')"))} AS key FROM pg WHERE language <> 'en' AND title <> '' AND len(ps) > 0
QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id DESC) = 1),
lk AS (SELECT e.doc_id AS from_id, {s_fold(s_ws("t.title"))} AS key FROM pg e JOIN pg t ON t.doc_id = e.doc_id + 1 WHERE e.language = 'en' AND e.doc_id % 5 <> 0),
al AS (SELECT s.doc_id, s.title AS source_title, s.lead AS source_lead, t.doc_id AS target_id, t.title AS target_title, t.lead AS target_lead,
CASE WHEN lk.from_id IS NULL THEN 'missing_langlink' WHEN t.doc_id IS NULL THEN 'missing_target' ELSE 'aligned' END AS status FROM src s LEFT JOIN lk ON s.doc_id = lk.from_id LEFT JOIN tgt t ON lk.key = t.key)"""


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    """English pages linked to the title of the page after them, which may be in another language."""
    pages = page_documents(spark, sf).withColumn("lead", F.get("paragraphs", F.lit(0)))
    english, other = pages.filter("language = 'en'"), pages.filter("language <> 'en'")
    titles = pages.select((F.col("doc_id") - 1).alias("from_id"), "title")
    links = english.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("from_id")).join(titles, "from_id").withColumn("link_order", F.col("from_id"))
    return joins.align_documents(english, links, other)


@query(f"WITH {S_PAGE}, {S_ALIGN} SELECT doc_id, target_id, status FROM al")
def aligned_two_hop_join(spark, sf):
    return aligned(spark, sf).select("doc_id", "target_id", "status")


@query(f"""WITH {S_PAGE}, {S_ALIGN}, c AS (SELECT doc_id, 0 AS p, 'aligned_title' AS kind, source_title AS anchor, target_lead AS positive FROM al WHERE status = 'aligned'
UNION ALL SELECT doc_id, 0, 'aligned_lead', source_lead, target_lead FROM al WHERE status = 'aligned' UNION ALL SELECT doc_id, 1, 'aligned_title', target_title, source_lead FROM al WHERE status = 'aligned'
UNION ALL SELECT doc_id, 1, 'aligned_lead', target_lead, source_lead FROM al WHERE status = 'aligned'),
j AS (SELECT doc_id, p, kind, anchor, left(positive, 2000) AS positive, CASE WHEN length(anchor) < 3 THEN 'short_anchor' WHEN length(positive) < 100 THEN 'short_positive' END AS r FROM c),
k AS (SELECT kind, CASE WHEN r IS NOT NULL THEN r WHEN row_number() OVER (PARTITION BY r IS NULL, anchor, positive ORDER BY doc_id, kind = 'aligned_lead', p) > 1 THEN 'duplicate' END AS reason FROM j)
SELECT kind, {S_REASON}, count(*)::BIGINT AS n FROM k GROUP BY ALL""")
def aligned_pair_ledger(spark, sf):
    return ledger(pairs.aligned_pairs(aligned(spark, sf).filter("status = 'aligned'")), "kind")


S_BILINGUAL = f"""{S_RANKED}, l AS (SELECT source || '.' || rk AS key, split_part(text, chr(10), 1) AS heading, text AS body, doc_id FROM ranked WHERE lang = 'fr'), r AS (SELECT source || '.' || rk AS key, split_part(text, chr(10), 1) AS heading, text AS body, doc_id FROM ranked WHERE lang = 'es')"""


def bilingual_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = ranked(spark, sf).select("doc_id", "lang", F.concat_ws(" . ", "source", F.col("rk").cast("string")).alias("number"), F.split("text", "\n", -1)[0].alias("heading"), F.col("text").alias("body"), F.col("doc_id").alias("place"))
    return rows.filter("lang = 'fr'"), rows.filter("lang = 'es'")


@query(f"""WITH {S_BILINGUAL} SELECT coalesce(l.key, r.key) AS key, CASE WHEN r.body IS NULL THEN 'left_only' WHEN l.body IS NULL THEN 'right_only' WHEN {s_ws("l.body")} = '' OR {s_ws("r.body")} = '' THEN 'empty_side' ELSE 'aligned' END AS status,
sha256(coalesce(nullif(l.heading, ''), r.heading)) AS heading FROM l FULL JOIN r ON l.key = r.key""")
def bilingual_full_outer(spark, sf):
    out = joins.align_bilingual(*bilingual_sides(spark, sf))
    return out.select("key", "status", F.sha2(F.col("heading").cast("binary"), 256).alias("heading"))


S_PROVISION = f"""{S_BILINGUAL}, a AS (SELECT l.key, l.doc_id AS left_id, l.heading AS lh, r.heading AS rh, l.body AS lb, r.body AS rb FROM l JOIN r ON l.key = r.key),
j AS (SELECT *, CASE WHEN regexp_matches({s_ws("lb")}, '{fixed.REPEALED}') THEN 'left_repealed' WHEN length({s_ws("lh")}) < 6 THEN 'left_short_heading' WHEN length({s_ws("lb")}) < 60 THEN 'left_short_body'
WHEN regexp_matches({s_ws("rb")}, '{fixed.REPEALED}') THEN 'right_repealed' WHEN length({s_ws("rh")}) < 6 THEN 'right_short_heading' WHEN length({s_ws("rb")}) < 60 THEN 'right_short_body' END AS r FROM a),
k AS (SELECT *, CASE WHEN r IS NOT NULL THEN r WHEN row_number() OVER (PARTITION BY r IS NULL, {s_ws("lb")}, {s_ws("rb")} ORDER BY left_id) > 1 THEN 'duplicate' END AS reason FROM j)"""


def aligned_provisions(spark: SparkSession, sf: str) -> DataFrame:
    left, right = bilingual_sides(spark, sf)
    return pairs.provisions(joins.align_provisions(left.withColumn("language", F.col("lang")), right.withColumn("language", F.col("lang"))))


@query(f"WITH {S_PROVISION} SELECT {S_REASON}, count(*)::BIGINT AS n FROM k GROUP BY 1")
def provision_ledger(spark, sf):
    return ledger(aligned_provisions(spark, sf))


@query(f"""WITH {S_PROVISION} SELECT left_id AS doc_id, 0 AS direction, 'fr' AS language, 'es' AS positive_language, sha256(lb) AS anchor FROM k WHERE reason IS NULL
UNION ALL SELECT left_id, 1, 'es', 'fr', sha256(rb) FROM k WHERE reason IS NULL""")
def provision_bidirectional(spark, sf):
    out = pairs.both_directions(accepted(aligned_provisions(spark, sf)))
    return out.select("doc_id", "direction", "language", "positive_language", F.sha2(F.col("anchor").cast("binary"), 256).alias("anchor"))


S_RELEASE = f"{S_RANKED}, rel AS (SELECT source || '/' || rk AS group_id, lang, {s_ws('split_part(text, chr(10), 1)')} AS title, {s_ws('text')} AS body FROM ranked)"


@query(f"""WITH {S_RELEASE}, c AS (SELECT a.lang AS language, b.lang AS positive_language, 'title_body' AS kind, a.title AS anchor, b.body AS positive FROM rel a JOIN rel b ON a.group_id = b.group_id AND a.lang <> b.lang
UNION ALL SELECT a.lang, b.lang, 'title_title', a.title, b.title FROM rel a JOIN rel b ON a.group_id = b.group_id AND a.lang <> b.lang),
j AS (SELECT *, CASE WHEN length(anchor) < 10 THEN 'short_anchor' WHEN length(positive) < CASE WHEN kind = 'title_body' THEN 40 ELSE 10 END THEN 'short_positive' WHEN kind = 'title_body' AND length(positive) > 2000 THEN 'long_positive' END AS r FROM c)
SELECT language, positive_language, kind, coalesce(r, 'accepted') AS reason, count(*)::BIGINT AS n FROM j GROUP BY ALL""")
def release_cross_lingual(spark, sf):
    rows = ranked(spark, sf).select(F.concat_ws("/", "source", F.col("rk").cast("string")).alias("group_id"), F.col("lang").alias("language"), F.split("text", "\n", -1)[0].alias("title"), F.col("text").alias("body"))
    return ledger(pairs.release_pairs(rows), "language", "positive_language", "kind")


S_TOKENS = lambda c: f"list_distinct(list_filter(regexp_split_to_array({c}, '{fixed.WS}'), lambda w: w <> ''))"


@query(f"""WITH b AS (SELECT source || ':' || (doc_id % 50) AS cluster, lang, doc_id, text FROM documents WHERE source || ':' || (doc_id % 50) NOT IN (SELECT source || ':' || (doc_id % 50) FROM documents WHERE doc_id % 41 = 0)
QUALIFY row_number() OVER (PARTITION BY cluster, lang ORDER BY length(text) DESC, doc_id) = 1)
SELECT x.cluster, x.lang AS language_a, y.lang AS language_b, x.doc_id AS id_a, y.doc_id AS id_b,
round(coalesce(len(list_intersect({S_TOKENS("x.text")}, {S_TOKENS("y.text")})) / nullif(len(list_distinct(list_concat({S_TOKENS("x.text")}, {S_TOKENS("y.text")}))), 0), 0), 6)::DOUBLE AS overlap
FROM b x JOIN b y ON x.cluster = y.cluster AND x.lang < y.lang""")
def pivot_nonpivot(spark, sf):
    docs = docs_of(spark, sf).withColumn("cluster", F.concat_ws(":", "source", (F.col("doc_id") % 50).cast("string"))).withColumn("language", F.col("lang"))
    out = joins.pivot_pairs(docs, exclude=docs.filter("doc_id % 41 = 0"))
    return out.select("cluster", "language_a", "language_b", "id_a", "id_b", F.round("overlap", 6).alias("overlap"))


@query(f"""WITH h AS (SELECT doc_id::VARCHAR AS document, text AS anchor, upper(split_part(text, chr(10), 1)) AS positive FROM documents WHERE doc_id % 23 = 0),
t AS (SELECT anchor AS t FROM h UNION SELECT positive FROM h), k AS (SELECT DISTINCT {s_fold(s_ws("t"))} AS k FROM t), d AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS first FROM documents)
SELECT coalesce(CASE WHEN doc_id::VARCHAR IN (SELECT document FROM h) THEN 'document' WHEN text IN (SELECT t FROM t) OR first IN (SELECT t FROM t) THEN 'text'
WHEN {s_fold(s_ws("text"))} IN (SELECT k FROM k) OR {s_fold(s_ws("first"))} IN (SELECT k FROM k) THEN 'normalized_text' END, 'accepted') AS reason, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM d GROUP BY 1""")
def holdout_antijoin(spark, sf):
    docs = docs_of(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("document"), F.col("text").alias("anchor"), F.split("text", "\n", -1)[0].alias("positive"))
    held = docs.filter("doc_id % 23 = 0").withColumn("positive", F.upper("positive"))
    out = joins.without_held_out(docs, held)
    return out.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


S_PLAIN = lambda c: f"' ' || array_to_string(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> ''), ' ') || ' '"


@query(f"""WITH d AS MATERIALIZED (SELECT doc_id, {S_PLAIN("text")} AS t FROM documents), b AS MATERIALIZED (SELECT item_id, {S_PLAIN("text")} AS p FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON contains(d.t, b.p) WHERE trim(p) <> ''""")
def benchmark_contamination(spark, sf):
    return joins.contained_passages(docs_of(spark, sf), table(spark, sf, "benchmark"))


# --- selection

S_HASH = lambda key, seed=0: f"sha256(concat('{seed}:', {key}))"


@query(f"SELECT doc_id FROM documents ORDER BY {S_HASH('doc_id', 17)}, doc_id LIMIT 100")
def hash_sample(spark, sf):
    return select.sample(docs_of(spark, sf).select("doc_id"), "doc_id", 100, 17)


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {S_HASH('doc_id', 3)}, doc_id) <= greatest(1, least(count(*) OVER () - 1, round(count(*) OVER () * 0.9))) THEN 'train' ELSE 'test' END AS part FROM documents")
def split_documents(spark, sf):
    return select.split(docs_of(spark, sf).select("doc_id"), "doc_id", 0.9, 3)


@query(f"""WITH {S_LINES}, c AS (SELECT doc_id, count(*) AS n, {S_HASH("doc_id", 5)} AS h FROM lines GROUP BY doc_id), r AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT CASE WHEN before < 250 THEN 'eval' ELSE 'train' END AS part, count(*)::BIGINT AS documents, sum(n)::BIGINT AS pairs, sum(doc_id)::BIGINT AS ids FROM r GROUP BY 1""")
def disjoint_pair_split(spark, sf):
    out = select.disjoint_split(corpus.lines(docs_of(spark, sf)), "doc_id", 250, 5)
    counts = out.groupBy("part", "doc_id").agg(F.count("*").alias("n"))
    return counts.groupBy("part").agg(F.count("*").alias("documents"), F.sum("n").alias("pairs"), F.sum("doc_id").alias("ids"))


@query(f"""SELECT doc_id, pool FROM (SELECT doc_id, 'english' AS pool FROM documents WHERE lang = 'en' ORDER BY {S_HASH("doc_id", 7)}, doc_id LIMIT 70)
UNION ALL SELECT doc_id, pool FROM (SELECT doc_id, 'other' AS pool FROM documents WHERE lang <> 'en' ORDER BY {S_HASH("doc_id", 7)}, doc_id LIMIT 30)""")
def blend_ratio(spark, sf):
    docs = docs_of(spark, sf).select("doc_id", "lang")
    return select.blend([("english", docs.filter("lang = 'en'"), 70), ("other", docs.filter("lang <> 'en'"), 30)], "doc_id", 7).select("doc_id", "pool")


@query("SELECT lang, count(*)::BIGINT AS rows, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, lang, unnest(range(CASE lang WHEN 'fr' THEN 3 WHEN 'es' THEN 2 ELSE 1 END)) FROM documents) GROUP BY lang")
def oversample_language(spark, sf):
    return select.oversample(docs_of(spark, sf).select("doc_id", "lang"), "lang", {"fr": 3, "es": 2}).groupBy("lang").agg(F.count("*").alias("rows"), F.sum("doc_id").alias("ids"))


S_LANGS = ("de", "en", "es", "fr")
S_LACKING = " OR ".join(f"(o.{x} > 0 AND w.{x} < 20)" for x in S_LANGS)


@query(f"""WITH RECURSIVE d AS (SELECT source || ':' || (doc_id % 10) AS cluster, lang FROM documents), c AS (SELECT cluster, {", ".join(f"count(*) FILTER (WHERE lang = '{x}') AS {x}" for x in S_LANGS)} FROM d GROUP BY cluster),
o AS (SELECT *, row_number() OVER (ORDER BY {S_HASH("cluster", 1)}, cluster) AS r FROM c),
w AS (SELECT 0::BIGINT AS r, '' AS cluster, false AS taken, {", ".join(f"0::BIGINT AS {x}" for x in S_LANGS)} UNION ALL
SELECT o.r, o.cluster, {S_LACKING}, {", ".join(f"w.{x} + CASE WHEN {S_LACKING} THEN o.{x} ELSE 0 END" for x in S_LANGS)} FROM w JOIN o ON o.r = w.r + 1)
SELECT CASE WHEN taken THEN 'eval' ELSE 'train' END AS part, lang, count(*)::BIGINT AS n FROM d JOIN w USING (cluster) GROUP BY ALL""")
def stratified_cluster_holdout(spark, sf):
    docs = docs_of(spark, sf).select("doc_id", "lang", F.concat_ws(":", "source", (F.col("doc_id") % 10).cast("string")).alias("cluster"))
    return select.stratified_clusters(docs, "cluster", "lang", 20, 1).groupBy("part", "lang").agg(F.count("*").alias("n"))


@query(f"""WITH {S_CANDIDATES} SELECT doc_id, kind, position FROM (SELECT doc_id, kind, kr, position, overlap, row_number() OVER (PARTITION BY doc_id ORDER BY round(overlap, 9), kr, position) AS r FROM judged WHERE reason IS NULL) WHERE r <= 2""")
def capped_per_document(spark, sf):
    rows = accepted(page_pairs(spark, sf))
    return select.capped(rows, "doc_id", [F.round("overlap", 9), F.col("kind_rank"), F.col("position")], 2).select("doc_id", "kind", "position")


@query(f"""WITH b AS (SELECT doc_id, {s_ws("text")} AS positive, ((row_number() OVER (ORDER BY {S_HASH("doc_id", 9)}, doc_id)) - 1) // 64 AS batch, {S_HASH("doc_id", 9)} AS h FROM documents)
SELECT doc_id, batch::BIGINT AS batch FROM b QUALIFY row_number() OVER (PARTITION BY batch, positive ORDER BY h, doc_id) = 1""")
def distinct_positive_batches(spark, sf):
    rows = docs_of(spark, sf).select("doc_id", text.collapse(F.col("text")).alias("positive"))
    return select.distinct_positive_batches(rows, "doc_id", 64, 9).select("doc_id", "batch")


# --- vocabulary

S_COUNTS = f"counts AS (SELECT word, count(*) AS n FROM (SELECT unnest({s_words('text')}) AS word FROM documents) GROUP BY word)"
S_VOCAB = f"{S_COUNTS}, vocab AS (SELECT (row_number() OVER (ORDER BY n DESC, word) + 3)::BIGINT AS id, word AS token, n::BIGINT AS frequency FROM (SELECT * FROM counts WHERE n >= 3 ORDER BY n DESC, word LIMIT 1996))"


def vocab_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    counts = corpus.word_frequencies(docs_of(spark, sf))
    return counts, vocab.vocabulary(counts, 3, 2000)


@query(f"WITH {S_COUNTS} SELECT word, n::BIGINT AS n FROM counts ORDER BY n DESC, word LIMIT 50")
def word_frequency_top(spark, sf):
    return corpus.word_frequencies(docs_of(spark, sf)).orderBy(F.desc("n"), "word").limit(50)


@query(f"WITH c AS (SELECT lang, unnest({s_words('text')}) AS w FROM documents) SELECT lang, count(DISTINCT w)::BIGINT AS distinct_words, count(*)::BIGINT AS words, round(count(DISTINCT w) / count(*), 9) AS ratio FROM c GROUP BY lang")
def type_token_ratio(spark, sf):
    out = corpus.type_token_ratio(docs_of(spark, sf), "lang")
    return out.withColumn("ratio", F.round("ratio", 9))


@query(f"WITH {S_VOCAB} SELECT * FROM vocab")
def vocabulary(spark, sf):
    return vocab_of(spark, sf)[1]


@query(f"WITH {S_VOCAB} SELECT sum(n)::BIGINT AS words, sum(CASE WHEN id IS NOT NULL THEN n ELSE 0 END)::BIGINT AS known, count(*)::BIGINT AS distinct_words, count(id)::BIGINT AS known_distinct, round(sum(CASE WHEN id IS NOT NULL THEN n ELSE 0 END) / sum(n), 9) AS coverage FROM counts LEFT JOIN vocab ON word = token")
def vocabulary_coverage(spark, sf):
    out = vocab.coverage(*vocab_of(spark, sf))
    return out.withColumn("coverage", F.round("coverage", 9))


S_ENCODED = f"{S_VOCAB}, tk AS (SELECT doc_id, unnest({s_words('text')}) AS token, generate_subscripts({s_words('text')}, 1) AS p FROM documents), enc AS (SELECT d.doc_id, coalesce(list(coalesce(v.id, 1) ORDER BY p) FILTER (WHERE p IS NOT NULL), []) AS ids FROM documents d LEFT JOIN tk USING (doc_id) LEFT JOIN vocab v ON tk.token = v.token GROUP BY d.doc_id)"


@query(f"WITH {S_ENCODED} SELECT doc_id, sha256(array_to_string(ids, ',')) AS ids, len(ids)::BIGINT AS n FROM enc")
def word_encode(spark, sf):
    out = vocab.encode(docs_of(spark, sf), vocab_of(spark, sf)[1])
    return out.select("doc_id", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids"), long(F.size("ids")).alias("n"))


@query(f"WITH {S_ENCODED} SELECT doc_id, array_to_string(list_concat(ids[1:64], list_transform(range(greatest(64 - len(ids), 0)), lambda x: 0)), ',') AS ids, least(len(ids), 64)::BIGINT AS attended FROM enc")
def encode_pad_truncate(spark, sf):
    out = vocab.encode(docs_of(spark, sf), vocab_of(spark, sf)[1])
    short = vocab.truncate(F.col("ids"), 64)
    attended = F.aggregate(vocab.attention_mask(short, 64), F.lit(0), lambda a, x: a + x)
    return out.select("doc_id", F.array_join(vocab.pad_to(short, 64).cast("array<string>"), ",").alias("ids"), long(attended).alias("attended"))


@query(f"WITH {S_ENCODED}, k AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM enc) SELECT e.doc_id, sha256(coalesce(string_agg(v.token, ' ' ORDER BY p), '')) AS text FROM enc e LEFT JOIN k USING (doc_id) LEFT JOIN vocab v ON k.id = v.id GROUP BY e.doc_id")
def word_decode(spark, sf):
    v = vocab_of(spark, sf)[1]
    out = vocab.decode(vocab.encode(docs_of(spark, sf), v), v)
    return out.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text"))


S_EFFICIENCY = f"""{S_VOCAB}, ft AS (SELECT lang, count(*) AS tokens, count(*) FILTER (WHERE id IS NULL) AS unknown, count(DISTINCT id) AS dt FROM (SELECT lang, unnest({s_words("text")}) AS token FROM documents) LEFT JOIN vocab USING (token) GROUP BY lang),
se AS (SELECT lang, sum(length(text)) AS ch, sum(len(regexp_extract_all(text, '[^{fixed.WS[1:-2]}]+'))) AS wd, count(*) AS n FROM documents GROUP BY lang)"""


def efficiency(spark: SparkSession, sf: str) -> DataFrame:
    docs = docs_of(spark, sf)
    v = vocab_of(spark, sf)[1]
    found = corpus.word_frequencies(docs, "lang").join(v.select(F.col("token").alias("word"), "id"), "word", "left")
    sentences = docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum(long(F.length("text"))).alias("characters"), F.sum(long(F.size(text.pre_tokens(F.col("text"), "whitespace")))).alias("words"))
    return vocab.tokenizer_metrics(found, sentences, 2000, "lang")


@query(f"WITH {S_EFFICIENCY} SELECT lang, tokens::BIGINT AS tokens, round(tokens / n, 6) AS tokens_per_sentence, round(ch / tokens, 6) AS characters_per_token, round(unknown / tokens, 6) AS unknown_rate, dt::BIGINT AS distinct_tokens, round(dt / 2000, 6) AS utilisation, round(tokens / wd, 6) AS fertility FROM ft JOIN se USING (lang)")
def tokenizer_efficiency(spark, sf):
    rounded = [F.round(c, 6).alias(c) for c in ("tokens_per_sentence", "characters_per_token", "unknown_rate", "utilisation", "fertility")]
    return efficiency(spark, sf).select("lang", "tokens", "distinct_tokens", *rounded)


@query(f"WITH {S_EFFICIENCY}, c AS (SELECT ch / tokens AS x FROM ft JOIN se USING (lang)) SELECT round(min(x), 6) AS least, round(max(x), 6) AS most, count(*)::BIGINT AS languages, round(max(x) / min(x), 6) AS ratio FROM c")
def language_fairness(spark, sf):
    out = vocab.fairness(efficiency(spark, sf))
    return out.select(F.round("least", 6).alias("least"), F.round("most", 6).alias("most"), "languages", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {S_ENCODED}, f AS (SELECT doc_id, list_filter(ids, lambda x: x >= 4) AS ids FROM enc), k AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM f)
SELECT a.id AS centre, b.id AS context, count(*)::BIGINT AS n FROM k a JOIN k b ON a.doc_id = b.doc_id AND abs(a.p - b.p) BETWEEN 1 AND 2 GROUP BY ALL HAVING count(*) >= 20""")
def skip_grams(spark, sf):
    return vocab.skip_grams(vocab.encode(docs_of(spark, sf), vocab_of(spark, sf)[1]), 2).filter("n >= 20")


@query(f"WITH {S_VOCAB} SELECT id, round(pow(frequency, 0.75) / sum(pow(frequency, 0.75)) OVER (), 9) AS probability, round(sum(pow(frequency, 0.75)) OVER (ORDER BY id) / sum(pow(frequency, 0.75)) OVER (), 6) AS cumulative FROM vocab")
def noise_distribution(spark, sf):
    v = vocab_of(spark, sf)[1]
    return vocab.noise(v).join(vocab.cumulative_noise(v), "id").select("id", F.round("probability", 9).alias("probability"), F.round("cumulative", 6).alias("cumulative"))


@query(f"WITH {S_VOCAB}, r AS (SELECT id, frequency / (SELECT sum(frequency) FROM vocab) AS s FROM vocab) SELECT id, round(least(1.0, (sqrt(s / 1e-3) + 1) * 1e-3 / s), 9) AS keep FROM r")
def subsample_keep(spark, sf):
    return vocab.keep_probability(vocab_of(spark, sf)[1]).select("id", F.round("keep", 9).alias("keep"))


# --- vectors

S_VEC = "e AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
S_SIM = "round(list_cosine_similarity(a.v, b.v), 9)"


def vectors_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("grp"), F.col("embedding").alias("v"))


@query(f"WITH {S_VEC} SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {S_SIM} DESC, b.vec_id)::INT AS rank, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 5 = 0 QUALIFY rank <= 5")
def knn_top_k(spark, sf):
    rows = vectors_of(spark, sf)
    return vectors.top_k(rows.filter("id % 5 = 0"), rows, 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {S_VEC} SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {S_SIM} DESC, b.vec_id)::INT AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id AND b.label <> a.label WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10")
def most_similar_excluding(spark, sf):
    """Nearest vectors, those of the query's own group left out before the ranking."""
    rows = vectors_of(spark, sf)
    return vectors.top_k(rows.filter("id % 50 = 0"), rows, 10, other_group=True).select("query_id", "id", "rank")


S_PAIRS = "p AS MATERIALIZED (SELECT a.vec_id // 2 AS id, a.label AS document, b.label AS found, a.embedding::DOUBLE[] AS q, b.embedding::DOUBLE[] AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"
S_WALK = f"""{S_PAIRS}, s AS (SELECT a.id, a.document, b.id AS candidate, b.document AS cd, round(list_cosine_similarity(a.q, b.v), 9) AS score, round(list_cosine_similarity(a.q, a.v), 9) AS own FROM p a JOIN p b ON true),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate) AS rank FROM s QUALIFY rank <= 33),
r AS (SELECT *, CASE WHEN candidate = id THEN 'own_positive' WHEN cd = document THEN 'same_document' WHEN score >= 0.30 THEN 'too_similar' WHEN score <= 0.05 THEN 'too_easy' ELSE 'accepted' END AS reason FROM n),
t AS (SELECT *, coalesce(sum((reason = 'accepted')::INT) OVER w, 0) AS taken, coalesce(sum((reason = 'too_easy')::INT) OVER w, 0) AS ended FROM r WINDOW w AS (PARTITION BY id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
walked AS (SELECT * FROM t WHERE taken < 4 AND ended = 0)"""


def vector_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Even vectors as anchors, the odd ones after them as their positives."""
    rows = vectors_of(spark, sf)
    a = rows.filter("id % 2 = 0").select(F.expr("id div 2").alias("id"), F.col("grp").alias("document"), F.col("v").alias("anchor"))
    b = rows.filter("id % 2 = 1").select(F.expr("id div 2").alias("id"), F.col("grp").alias("found"), F.col("v").alias("positive"))
    return a.join(b, "id")


def walked(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.hard_negatives(vector_pairs(spark, sf), maximum=0.30, minimum=0.05)


@query(f"WITH {S_WALK} SELECT id, candidate, rank::INT AS rank, round(score, 6) AS score FROM walked WHERE reason = 'accepted'")
def hard_negatives(spark, sf):
    return walked(spark, sf).filter("reason = 'accepted'").select("id", "candidate", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {S_WALK} SELECT reason, count(*)::BIGINT AS n, round(avg(score), 6) AS mean_score, round(avg(CASE WHEN reason = 'accepted' THEN (score > own)::INT END), 6) AS suspicion_rate FROM walked GROUP BY reason")
def hard_negative_statistics(spark, sf):
    out = vectors.negative_statistics(walked(spark, sf))
    return out.select("reason", "n", F.round("mean_score", 6).alias("mean_score"), F.round("suspicion_rate", 6).alias("suspicion_rate"))


S_RANKS = f"{S_PAIRS}, ranks AS (SELECT a.id, a.document, a.found, sum((round(list_cosine_similarity(a.q, b.v), 9) >= round(list_cosine_similarity(a.q, a.v), 9))::INT) - 1 AS rank FROM p a JOIN p b ON true GROUP BY a.id, a.document, a.found)"


def ranks_of(spark: SparkSession, sf: str) -> DataFrame:
    rows = vector_pairs(spark, sf)
    queries = rows.select("id", F.col("document").alias("grp"), F.col("anchor").alias("v"), vectors.cosine(F.col("anchor"), F.col("positive")).alias("own"), F.col("id").alias("positive_id"))
    ranks = vectors.pessimistic_ranks(queries, rows.select("id", F.col("found").alias("grp"), F.col("positive").alias("v")))
    return ranks.select(F.col("query_id").alias("id"), "rank").join(rows.select("id", "document", "found"), "id")


@query(f"WITH {S_RANKS} SELECT id, rank::BIGINT AS rank FROM ranks")
def retrieval_ranks(spark, sf):
    return ranks_of(spark, sf).select("id", "rank")


S_SCORES = "count(*)::BIGINT AS queries, round(avg((rank < 1)::INT), 6) AS recall_at_1, round(avg((rank < 5)::INT), 6) AS recall_at_5, round(avg((rank < 10)::INT), 6) AS recall_at_10, round(avg(1 / (rank + 1)), 6) AS mrr, round(avg(CASE WHEN rank < 10 THEN 1 / log2(rank + 2) ELSE 0 END), 6) AS ndcg_at_10"


@query(f"""WITH {S_RANKS}, f AS (SELECT rank, document::VARCHAR AS language, CASE WHEN rank % 3 = 0 THEN 'a' ELSE 'b' END AS kind FROM ranks)
SELECT 'all' AS facet, NULL::VARCHAR AS value, {S_SCORES} FROM f UNION ALL SELECT 'language', language, {S_SCORES} FROM f GROUP BY language UNION ALL SELECT 'kind', kind, {S_SCORES} FROM f GROUP BY kind""")
def retrieval_report(spark, sf):
    rows = ranks_of(spark, sf).select("rank", F.col("document").cast("string").alias("language"), F.when(F.col("rank") % 3 == 0, "a").otherwise("b").alias("kind"))
    out = evaluate.report(rows, "language", "kind")
    return out.select("facet", "value", "queries", *(F.round(c, 6).alias(c) for c in out.columns[3:]))


@query(f"""WITH {S_RANKS}, r AS (SELECT document AS language, count(*) AS n, avg((rank < 10)::INT) AS p FROM ranks GROUP BY 1)
SELECT language::BIGINT AS language, n::BIGINT AS n, round(greatest(0, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) AS low,
round(least(1, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) AS high, round(p * (SELECT count(*) FROM ranks), 6) AS lift FROM r""")
def wilson_interval(spark, sf):
    rows = ranks_of(spark, sf)
    total = rows.agg(F.count("*").alias("total"))
    r = rows.groupBy(F.col("document").alias("language")).agg(F.count("*").alias("n"), F.avg((F.col("rank") < 10).cast("double")).alias("p")).join(F.broadcast(total))
    low, high = evaluate.wilson(F.col("p"), F.col("n"))
    return r.select("language", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(evaluate.lift(F.col("p"), F.col("total")), 6).alias("lift"))


@query(f"""WITH {S_PAIRS}, s AS (SELECT a.id, a.document AS asked, a.found, b.found AS near, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.q, b.v), 9) DESC, b.id) AS r FROM p a JOIN p b ON a.id <> b.id QUALIFY r <= 5),
sh AS (SELECT id, asked, found, avg((near = asked)::INT) AS share FROM s GROUP BY ALL), pool AS (SELECT found AS l, count(*) AS n FROM p GROUP BY 1)
SELECT count(*)::BIGINT AS queries, round(avg(share), 6) AS observed, round(avg((n - (found = asked)::INT) / ((SELECT count(*) FROM p) - 1)), 6) AS expected, round(avg(share) / avg((n - (found = asked)::INT) / ((SELECT count(*) FROM p) - 1)), 5) AS ratio FROM sh JOIN pool ON asked = l""")
def language_separation(spark, sf):
    rows = vector_pairs(spark, sf)
    near = vectors.top_k(rows.select("id", F.col("document").alias("grp"), F.col("anchor").alias("v")), rows.select("id", F.col("found").alias("grp"), F.col("positive").alias("v")), 5)
    out = evaluate.language_separation(near, rows.select("id", F.col("document").alias("asked"), "found"))
    return out.select("queries", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), F.round("ratio", 5).alias("ratio"))


@query(f"WITH {S_PAIRS}, r AS (SELECT a.id, sum((round(list_cosine_similarity(a.q, b.v), 9) >= round(list_cosine_similarity(a.q, a.v), 9))::INT) - 1 AS rank FROM p a JOIN p b ON a.found = b.found GROUP BY a.id) SELECT id, rank::BIGINT AS rank FROM r")
def within_target_pool(spark, sf):
    rows = vector_pairs(spark, sf)
    queries = rows.select("id", F.col("found").alias("grp"), F.col("anchor").alias("v"), vectors.cosine(F.col("anchor"), F.col("positive")).alias("own"), F.col("id").alias("positive_id"))
    ranks = vectors.pessimistic_ranks(queries, rows.select("id", F.col("found").alias("grp"), F.col("positive").alias("v")), same_group=True)
    return ranks.select(F.col("query_id").alias("id"), "rank")


@query(f"""WITH {S_PAIRS}, pool AS (SELECT id * 2 AS t, q AS v FROM p UNION ALL SELECT id * 2 + 1, v FROM p),
r AS (SELECT a.id, sum((round(list_cosine_similarity(a.q, b.v), 9) >= round(list_cosine_similarity(a.q, a.v), 9))::INT) - 1 AS rank FROM p a JOIN pool b ON b.t <> a.id * 2 GROUP BY a.id) SELECT id, rank::BIGINT AS rank FROM r""")
def mixed_pool_masked(spark, sf):
    rows = vector_pairs(spark, sf)
    queries = rows.select((F.col("id") * 2).alias("id"), F.lit(None).cast("long").alias("grp"), F.col("anchor").alias("v"), vectors.cosine(F.col("anchor"), F.col("positive")).alias("own"), (F.col("id") * 2 + 1).alias("positive_id"))
    pool = vectors_of(spark, sf).join(rows.select(F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("id")), "id", "left_semi")
    ranks = vectors.pessimistic_ranks(queries, pool, mask_same_text=True)
    return ranks.select(F.expr("query_id div 2").alias("id"), "rank")


@query(f"""WITH {S_PAIRS}, s AS (SELECT a.id, a.document AS asked, b.found, b.id AS bid, row_number() OVER (PARTITION BY a.id, b.found ORDER BY round(list_cosine_similarity(a.q, b.v), 9) DESC, b.id) AS r FROM p a JOIN p b ON true QUALIFY r = 1)
SELECT asked::BIGINT AS asked, found::BIGINT AS found, count(*)::BIGINT AS queries, round(avg((bid = id)::INT), 6) AS accuracy FROM s GROUP BY ALL""")
def all_pairs_matrix(spark, sf):
    rows = vector_pairs(spark, sf)
    queries = rows.select("id", F.col("document").alias("grp"), F.col("anchor").alias("v"))
    out = vectors.best_per_group(queries, rows.select("id", F.col("found").alias("grp"), F.col("positive").alias("v")))
    answers = out.join(queries.select(F.col("id").alias("query_id"), F.col("grp").alias("asked")), "query_id").select("asked", F.col("grp").alias("found"), (F.col("id") == F.col("query_id")).cast("int").alias("hit"))
    out = evaluate.language_matrix(answers)
    return out.withColumn("accuracy", F.round("accuracy", 6))


S_TOKEN_VECTORS = f"{S_VOCAB}, tv AS (SELECT token, frequency, v FROM vocab JOIN (SELECT vec_id + 4 AS id, embedding::DOUBLE[] AS v FROM embeddings) USING (id)), tk AS (SELECT doc_id, unnest({s_words('text')}) AS token FROM documents)"


def token_vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = vocab_of(spark, sf)[1]
    given = table(spark, sf, "embeddings").select((F.col("vec_id") + 4).alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return vocab.tokens(docs_of(spark, sf)), v.join(given, "id").select("token", "frequency", "v")


@query(f"WITH {S_TOKEN_VECTORS} SELECT doc_id, round(avg(v[1]), 6) AS first, round(avg(v[64]), 6) AS last FROM tk JOIN tv USING (token) GROUP BY doc_id")
def mean_pooling(spark, sf):
    out = vectors.mean_pool(*token_vectors(spark, sf))
    return out.select("doc_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


@query(f"WITH {S_TOKEN_VECTORS}, w AS (SELECT token, 1e-3 / (1e-3 + frequency / (SELECT sum(frequency) FROM vocab)) AS w, v FROM tv) SELECT doc_id, round(avg(w * v[1]), 6) AS first, round(avg(w * v[64]), 6) AS last FROM tk JOIN w USING (token) GROUP BY doc_id")
def sif_weighted(spark, sf):
    tokens, known = token_vectors(spark, sf)
    total = vocab_of(spark, sf)[1].agg(F.sum("frequency").alias("total"))
    weighted = known.join(F.broadcast(total)).withColumn("weight", vectors.sif_weight(F.col("frequency"), F.col("total")))
    out = vectors.mean_pool(tokens, weighted, F.col("weight"))
    return out.select("doc_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


@query()
def sif_without_common_direction(spark, sf):
    return vectors.remove_common_direction(vectors_of(spark, sf)).select("id", F.round(F.col("v")[0], 6).alias("first"))


@query()
def embedding_spectrum(spark, sf):
    return spark.createDataFrame([tuple(vectors.spectrum(vectors_of(spark, sf)).values())], "isotropy double, effective_dimensions double")


S_UNIT = "u AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings)"


@query(f"""WITH {S_UNIT}, q AS (SELECT a.vec_id AS qid, list_transform(range(1, len(a.v) + 1), lambda i: b.v[i] - a.v[i] + c.v[i]) AS v FROM u a JOIN u b ON b.vec_id = a.vec_id + 1 JOIN u c ON c.vec_id = a.vec_id + 2 WHERE a.vec_id % 25 = 0)
SELECT qid AS question_id, u.vec_id AS id, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(q.v, u.v), 9) DESC, u.vec_id)::INT AS rank, round(list_cosine_similarity(q.v, u.v), 6) AS score FROM q JOIN u ON u.vec_id NOT IN (qid, qid + 1, qid + 2) QUALIFY rank <= 3""")
def analogy(spark, sf):
    rows = vectors_of(spark, sf)
    ids = rows.select("id")
    whole = ids.join(ids.select((F.col("id") - 1).alias("id")), "id").join(ids.select((F.col("id") - 2).alias("id")), "id")
    questions = whole.filter("id % 25 = 0").select(F.col("id").alias("question_id"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") + 2).alias("c"))
    return vectors.analogy(rows, questions, 3).select("question_id", "id", "rank", F.round("score", 6).alias("score"))


@query("SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) = 0)::BIGINT AS zero, round(avg(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))), 6) AS mean_norm FROM embeddings")
def zero_vectors(spark, sf):
    n = vectors.norm(F.col("v"))
    return vectors_of(spark, sf).agg(F.count("*").alias("n"), F.count_if(n == 0).alias("zero"), F.round(F.avg(n), 6).alias("mean_norm"))


@query(f"WITH {S_VEC} SELECT round(avg(list_cosine_similarity(a.v, b.v)), 6) AS mean_similarity, count(*)::BIGINT AS pairs FROM e a JOIN e b ON a.vec_id < b.vec_id")
def mean_pairwise_similarity(spark, sf):
    """Over all pairs of all vectors."""
    out = vectors.mean_pairwise_similarity(vectors_of(spark, sf))
    return out.select(F.round("mean_similarity", 6).alias("mean_similarity"), "pairs")


@query(f"""WITH {S_VEC}, n AS (SELECT a.vec_id AS q, (a.label = b.label)::INT AS hit, row_number() OVER (PARTITION BY a.vec_id ORDER BY {S_SIM} DESC, b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id QUALIFY rank <= 20),
h AS (SELECT *, sum(hit) OVER (PARTITION BY q ORDER BY rank) AS hits FROM n), rel AS (SELECT a.vec_id AS q, (SELECT count(*) - 1 FROM e b WHERE b.label = a.label) AS n FROM e a),
m AS (SELECT q, sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) AS k, sum(hit * hits / rank) AS ap, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(CASE WHEN rank <= 10 THEN hit / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY q)
SELECT q AS query_id, round(k / 10, 6) AS precision, round(coalesce(k / nullif(n, 0), 0), 6) AS recall, round(coalesce(2 * (k / 10) * (k / nullif(n, 0)) / nullif(k / 10 + k / nullif(n, 0), 0), 0), 6) AS f1, round(coalesce(ap / nullif(n, 0), 0), 6) AS average_precision, round(coalesce(1 / first, 0), 6) AS reciprocal_rank,
round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, greatest(least(n, 10), 1) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM m JOIN rel USING (q)""")
def rank_metrics(spark, sf):
    """Every vector asks all others. A null label is like no other: its row has zeros."""
    rows = vectors_of(spark, sf)
    # labels are ints, so no label equals what stands for null
    told = rows.withColumn("grp", F.coalesce("grp", F.lit(1 << 40)))
    near = vectors.top_k(told, told, 20).join(rows.select(F.col("id").alias("query_id"), F.col("grp").alias("own")), "query_id").withColumn("hit", (F.col("grp") == F.col("own")).cast("int"))
    sizes = rows.groupBy("grp").agg((F.count("*") - 1).alias("n"))
    relevant = rows.join(sizes, "grp", "left").select(F.col("id").alias("query_id"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    out = evaluate.rank_metrics(near.select("query_id", "rank", "hit"), relevant, 10)
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


S_LABELLED = "x AS (SELECT length(text)::DOUBLE AS a, quality::DOUBLE AS b FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


@query(f"""WITH {S_LABELLED}, r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM x)
SELECT count(*)::BIGINT AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r""")
def correlations(spark, sf):
    rows = docs_of(spark, sf).join(table(spark, sf, "labels").filter("quality IS NOT NULL").select("doc_id", "quality"), "doc_id").select(F.length("text").cast("double").alias("a"), F.col("quality").cast("double").alias("b"))
    p = evaluate.pearson(rows, "a", "b")
    s = evaluate.spearman(rows, "a", "b").select(F.col("n").alias("m"), F.col("r").alias("spearman"))
    return p.join(s, F.col("n") == F.col("m")).select("n", F.round("r", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query(f"""WITH {S_RANKS}, m AS (SELECT document AS language, avg((rank < 10)::INT) AS a, avg((rank < 20)::INT) AS b FROM ranks GROUP BY 1)
SELECT language::BIGINT AS language, round(a, 6) AS recall_before, round(b, 6) AS recall_after, round(b - a, 6) AS recall_difference, round((b - a) / nullif(a, 0), 6) AS recall_relative, b > a AS recall_helped FROM m""")
def metric_deltas(spark, sf):
    rows = ranks_of(spark, sf)
    at = lambda k: rows.groupBy(F.col("document").alias("language")).agg(F.avg((F.col("rank") < k).cast("double")).alias("recall"))
    out = evaluate.deltas(at(10), at(20), "language", "recall")
    return out.select("language", *(F.round(c, 6).alias(c) for c in ("recall_before", "recall_after", "recall_difference", "recall_relative")), "recall_helped")


# --- the rest


@query(f"WITH {S_CANDIDATES} SELECT doc_id, kind, position, sha256('query: ' || anchor) AS anchor, sha256('passage: ' || positive) AS positive FROM judged WHERE reason IS NULL")
def prefix_apply(spark, sf):
    rows = pairs.prefixed(accepted(page_pairs(spark, sf)), "query: ", "passage: ")
    return rows.select("doc_id", "kind", "position", F.sha2(F.col("anchor").cast("binary"), 256).alias("anchor"), F.sha2(F.col("positive").cast("binary"), 256).alias("positive"))


@query(f"WITH {S_CANDIDATES} SELECT CASE WHEN overlap < 0.3 THEN 'low' WHEN overlap < 0.7 THEN 'mid' ELSE 'high' END AS band, count(*)::BIGINT AS n FROM judged WHERE reason IS NULL GROUP BY 1")
def overlap_bands(spark, sf):
    return accepted(page_pairs(spark, sf)).groupBy(text.band(F.col("overlap")).alias("band")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, event_id % 997 AS b, event_id % 997 + event_id % 13 AS e FROM events), o AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM s),
g AS (SELECT *, sum((pe IS NULL OR b > pe)::INT) OVER (PARTITION BY user_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, min(b)::BIGINT AS begin, max(e)::BIGINT AS "end" FROM g GROUP BY user_id, g""")
def merge_spans(spark, sf):
    rows = table(spark, sf, "events").select("user_id", (F.col("event_id") % 997).alias("begin"), (F.col("event_id") % 997 + F.col("event_id") % 13).alias("end"))
    return spans.merge_overlapping(rows, "user_id")


@query()
def sentence_segmentation(spark, sf):
    from corpusloom.functions import unicode

    docs = docs_of(spark, sf).select("doc_id", "lang", F.explode(unicode.sentences(F.col("text"), F.col("lang"))).alias("s"))
    return docs.select("doc_id", "lang", "s.start", "s.end")


@query()
def script_aware_tokens(spark, sf):
    from corpusloom.functions import unicode

    @F.pandas_udf("array<string>")
    def run(texts):
        return texts.map(unicode.script_pre_tokens)

    run.func.__annotations__ = {}
    return docs_of(spark, sf).select("lang", F.explode(run("text")).alias("token")).groupBy("lang").agg(F.count("*").alias("tokens"), F.count_distinct("token").alias("distinct_tokens"))


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store that Spark reads is a file."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jvm_path).isFile()


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def events_by_hour(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*)::BIGINT AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf):
    rows = table(spark, sf, "lineitem").filter("l_shipdate <= timestamp '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey)::BIGINT AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def revenue_by_nation(spark, sf):
    t = lambda name: table(spark, sf, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    per_order = rows.groupBy("n_name", "o_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return per_order.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("orders"))


@query("""SELECT c_custkey, o_orderkey, rank::INT AS rank FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top_orders_per_customer(spark, sf):
    return select.capped(table(spark, sf, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("place").alias("rank"))
