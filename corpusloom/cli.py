"""Commands: python -m corpusloom.cli stats --set corpus.source=DIR, and so on."""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.encoders import hash_encoder
from corpusloom.operators import corpus, pairs
from corpusloom.plans import config, pipelines
from corpusloom.plans.ledger import accepted, ledger
from corpusloom.runtime import bound_arrow_batches
from corpusloom.sources import readers, writers


def _session() -> SparkSession:
    return SparkSession.builder.appName("corpusloom").getOrCreate()


def _say(name: str, rows: DataFrame, n: int = 200) -> None:
    for r in rows.limit(n).collect():
        print(json.dumps({"report": name} | r.asDict(recursive=True), ensure_ascii=False, default=str))


def stats(spark: SparkSession, settings: config.Settings, args: argparse.Namespace) -> int:
    docs = pipelines.read_corpus(spark, settings.corpus)
    for name, rows in pipelines.describe(corpus.deduplicate(docs) if settings.corpus.deduplicate else docs).items():
        _say(name, rows)
    return 0


def validate(spark: SparkSession, settings: config.Settings, args: argparse.Namespace) -> int:
    """Findings; with --strict, 1 if there are errors."""
    docs = pipelines.read_corpus(spark, settings.corpus)
    findings = corpus.audit(docs)
    _say("findings", findings)
    if docs.isEmpty():
        print(json.dumps({"report": "findings", "code": "empty_corpus", "severity": "error"}))
        return 1
    return int(args.strict and findings.filter("severity = 'error'").count() > 0)


def extract(spark: SparkSession, settings: config.Settings, args: argparse.Namespace) -> int:
    articles = readers.read_mediawiki(spark, settings.corpus.source, settings.corpus.language)
    print(json.dumps({"written": writers.write_jsonl(corpus.deduplicate(articles.withColumnRenamed("id", "doc_id")), args.output, gzip=True)}))
    return 0


def mine_pairs(spark: SparkSession, settings: config.Settings, args: argparse.Namespace) -> int:
    docs = corpus.deduplicate(pipelines.read_corpus(spark, settings.corpus))
    found, counts, statistics = pipelines.mine_pairs(docs, settings.pairs)
    print(json.dumps({"written": writers.write_jsonl(writers.pair_records(found), args.output, gzip=True)}))
    _say("ledger", counts)
    _say("kinds", statistics)
    return 0


def extract_judgments(spark: SparkSession, settings: config.Settings, args: argparse.Namespace) -> int:
    """Documents of binary files by --reader module:function, from bytes to the texts of pages."""
    bound_arrow_batches(spark)  # workers learn where the package is
    module, _, function = args.reader.partition(":")
    documents = readers.read_with(spark, settings.corpus.source, getattr(importlib.import_module(module), function))
    print(json.dumps({"written": writers.write_jsonl(corpus.deduplicate(documents.withColumnRenamed("id", "doc_id")), args.output, gzip=True)}))
    return 0


def _write_judged(judged: DataFrame, args: argparse.Namespace) -> int:
    found = accepted(judged).drop("kind_rank", "position").withColumn("document", F.col("doc_id").cast("string")).drop("doc_id")
    print(json.dumps({"written": writers.write_jsonl(writers.pair_records(found), args.output, gzip=True)}))
    _say("ledger", ledger(judged))
    return 0


def mine_questions(spark: SparkSession, settings: config.Settings, args: argparse.Namespace) -> int:
    """Question and answer pairs of a call-centre table."""
    rows = pipelines.with_ids(readers.read_questions(spark, settings.corpus.source), "question", "answer", "created_on").withColumnRenamed("id", "doc_id")
    return _write_judged(pairs.question_answers(rows.select("doc_id", F.lit(0).cast("long").alias("position"), "question", "answer")), args)


def mine_notices(spark: SparkSession, settings: config.Settings, args: argparse.Namespace) -> int:
    """Subject and body pairs of a table of notifications."""
    rows = pipelines.with_ids(readers.read_notices(spark, settings.corpus.source), "number", "subject", "body").withColumnRenamed("id", "doc_id")
    return _write_judged(pairs.notices(rows.select("doc_id", "subject", "body")), args)


def extract_acts(spark: SparkSession, settings: config.Settings, args: argparse.Namespace) -> int:
    """Acts in JSON as documents with sections."""
    found = readers.acts(spark.read.option("recursiveFileLookup", True).text(settings.corpus.source, wholetext=True))
    body = F.array_join(F.transform("sections", lambda s: s["text"]), "\n\n")
    print(json.dumps({"written": writers.write_jsonl(found.withColumn("text", body).withColumn("language", F.lit(settings.corpus.language)), args.output, gzip=True)}))
    return 0


def mine_aligned(spark: SparkSession, settings: config.Settings, args: argparse.Namespace) -> int:
    """Pairs of two corpora, --target the other, whose pages --links (an SQL dump) connects."""
    target = pipelines.read_corpus(spark, dataclasses.replace(settings.corpus, source=args.target, language=args.target_language))
    links = readers.read_langlinks(spark, args.links, args.target_language)
    found, documents, counts = pipelines.mine_aligned(pipelines.read_corpus(spark, settings.corpus), links, target)
    print(json.dumps({"written": writers.write_jsonl(writers.pair_records(found.withColumnRenamed("doc_id", "document")), args.output, gzip=True)}))
    _say("documents", documents)
    _say("ledger", counts)
    return 0


def ingest_parallel(spark: SparkSession, settings: config.Settings, args: argparse.Namespace) -> int:
    """Pairs of two line-aligned files, the corpus's source and --target."""
    side = lambda path: spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n", -1)).alias("n", "line")).select(F.col("n").cast("long").alias("n"), "line")
    found, counts = pipelines.ingest_parallel(side(settings.corpus.source), side(args.target), settings.corpus.language or "", args.target_language)
    print(json.dumps({"written": writers.write_jsonl(writers.pair_records(found.withColumn("document", F.col("doc_id").cast("string"))), args.output, gzip=True)}))
    _say("ledger", counts)
    return 0


def prepare_eval(spark: SparkSession, settings: config.Settings, args: argparse.Namespace) -> int:
    """The held-out pairs, and the rest without what shares a document or a text with them."""
    train, held_out, counts = pipelines.select_pairs(writers.pairs_from_records(spark.read.json(settings.corpus.source)), None, settings.selection)
    written = {name: writers.write_jsonl(writers.pair_records(rows), f"{args.output}/{name}", gzip=True) for name, rows in (("train", train), ("eval", held_out))}
    print(json.dumps({"written": written}))
    _say("ledger", counts)
    return 0


def adapt(spark: SparkSession, settings: config.Settings, args: argparse.Namespace) -> int:
    """What a training run needs and what it will be held against: the selected pairs, and the report of the
    encoder as it is on the held-out ones. The training itself is another program's."""
    code = prepare_eval(spark, settings, args)
    report, separation = pipelines.score_pairs(spark.read.json(f"{args.output}/eval"), hash_encoder())
    _say("before", report)
    _say("separation", separation)
    return code


def train(spark: SparkSession, settings: config.Settings, args: argparse.Namespace) -> int:
    """A vocabulary and word vectors, saved with their headers."""
    docs = corpus.deduplicate(pipelines.read_corpus(spark, settings.corpus))
    known, found = pipelines.train_vectors(docs, min_count=args.min_count)
    print(json.dumps({"written": {"vocabulary": writers.save_table(known, f"{args.output}/vocabulary", "vocabulary"), "vectors": writers.save_table(found, f"{args.output}/vectors", "vectors")}}))
    return 0


def mine_negatives(spark: SparkSession, settings: config.Settings, args: argparse.Namespace) -> int:
    rows = writers.pairs_from_records(spark.read.json(settings.corpus.source))
    out, statistics = pipelines.mine_negatives(rows, hash_encoder(), settings.negatives)
    print(json.dumps({"written": writers.write_jsonl(writers.pair_records(out), args.output, gzip=True)}))
    _say("negatives", statistics)
    return 0


def search(spark: SparkSession, settings: config.Settings, args: argparse.Namespace) -> int:
    docs = pipelines.read_corpus(spark, settings.corpus)
    lines = pipelines.with_ids(corpus.lines(docs).select("doc_id", "line_no", "line"), "doc_id", "line_no").withColumnRenamed("line", "text")
    index = pipelines.build_index(lines, hash_encoder(), passage_prefix=settings.selection.passage_prefix)
    asked = spark.createDataFrame([(0, args.query)], "id long, text string")
    _say("hits", pipelines.search(index, asked, hash_encoder(), args.k, query_prefix=settings.selection.query_prefix))
    return 0


def evaluate(spark: SparkSession, settings: config.Settings, args: argparse.Namespace) -> int:
    report, separation = pipelines.score_pairs(spark.read.json(settings.corpus.source), hash_encoder())
    _say("retrieval", report)
    _say("separation", separation)
    return 0


COMMANDS = {"mine-questions": mine_questions, "mine-notices": mine_notices, "extract-acts": extract_acts, "extract-judgments": extract_judgments, "mine-aligned": mine_aligned, "ingest-parallel": ingest_parallel, "prepare-eval": prepare_eval, "finetune": adapt, "adapt": adapt, "train": train, "stats": stats, "validate": validate, "extract": extract, "mine-pairs": mine_pairs, "mine-negatives": mine_negatives, "search": search, "evaluate": evaluate}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusloom")
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("--config", help="a JSON file of settings")
    parser.add_argument("--profile")
    parser.add_argument("--set", action="append", default=[], dest="overrides", metavar="KEY=VALUE")
    parser.add_argument("--output", default="out")
    parser.add_argument("--query", default="")
    parser.add_argument("--target", default="", help="the other corpus or file")
    parser.add_argument("--target-language", default="")
    parser.add_argument("--links", default="")
    parser.add_argument("--reader", default="corpusloom.sources.readers:plain_pages", help="module:function from bytes to the texts of pages")
    parser.add_argument("--min-count", type=int, default=5)
    parser.add_argument("-k", type=int, default=10)
    parser.add_argument("--strict", action="store_true")
    args = parser.parse_args(argv)
    file = json.loads(Path(args.config).read_text(encoding="utf-8")) if args.config else None
    settings = config.load(file, args.profile, None, args.overrides)
    return COMMANDS[args.command](spark or _session(), settings, args)


if __name__ == "__main__":
    sys.exit(main())
