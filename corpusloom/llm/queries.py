"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import ann, bpe, chat, fingerprints, html_text, line_dedup, ngram_lm, packing, simhash, toxicity
from corpusloom.runtime import table

#: A conversation whose texts hold the template's own control strings.
CONTROL_CONVERSATION = -7
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages, and how many characters it lost."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_repeated_lines(docs.withColumn("n_before", F.length("text")))
    return kept.select("doc_id", "text", (F.col("n_before") - F.length("text")).cast("long").alias("n_removed"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a document of several lines the first is the prompt: as many tokens as it has words bear no loss."""
    first = F.size(F.split(F.substring_index("text", "\n", 1), " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.instr("text", "\n") > 0, first).otherwise(0).alias("prompt_tokens"))
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), prompt_col="prompt_tokens")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = [(CONTROL_CONVERSATION, turn, role, CONTROL_TEXT) for turn, role in enumerate(("user", "assistant"))]
    extra = spark.createDataFrame(planted, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


QUERIES = {
    f.__name__: f
    for f in (op1_ann_search, op2_lm_score, op3_line_dedup, op4_html_extract, op5_toxicity, op6_bpe_roundtrip, op7_simhash_components, op8_fingerprints, op9_pack_documents, op10_chat_format)
}

#: None of these can be written in SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL: dict[str, str] = {}
