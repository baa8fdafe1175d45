import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import prose, text
from corpusloom.operators import evaluate, pairs, select, vectors, vocab
from corpusloom.plans.ledger import REASON, reject_repeats
from corpusloom.sources import readers, writers

LONG = "The court held that the notice was valid. It gave its reasons in full. The appeal fails."


def value(spark, function, t):
    return spark.createDataFrame([(t,)], "t string").select(function(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("t", "want"),
    [(LONG, True), ("Contents ......... 4. One. Two.", False), ("A * B * C. d. e.", False), ("12345 67890 a. b. c.", False), ("MR X AND MS Y. MR Z. MS W.", False), ("counsel for the one. and the other. yes.", False), ("no end in sight", False), ("ends here.", True), ("", False), (None, False), ("12", False)],
)
def test_is_prose(spark, t, want):
    assert value(spark, prose.is_prose, t) is want


@pytest.mark.parametrize(
    ("t", "want"),
    [
        ("Rivers in the north of the country carry more water in spring than in summer.", True),
        ("The river that they know carries more water in spring than in the summer months.", True),
        ("Rivers when they flood carry more water in spring than in all summer months taken.", False),
        ("However rivers in the north of the country carry more water in spring than others.", False),
        ("rivers in the north of the country carry more water in spring than in the summer.", False),
        ("Too short.", False),
        ("Rivers in the north of the country carry more water in spring than in the summer", False),
        (None, False),
    ],
)
def test_stands_alone(spark, t, want):
    assert value(spark, prose.stands_alone, t) is want


def test_cleaning_and_preview(spark):
    assert value(spark, lambda c: prose.clean(c, r"PAGE \d+"), " , The ofﬁ ce was certiﬁed PAGE 12 off  the list") == "The office was certified off the list"
    long = "One sentence of some words. " * 40
    cut = value(spark, lambda c: prose.preview(c, 600), long)
    assert cut.endswith("words.") and 400 <= len(cut) <= 720
    assert value(spark, lambda c: prose.preview(c, 20), "x" * 200) == "x" * 20 + "…"
    assert value(spark, prose.preview, "short") == "short"


def test_hashes(spark):
    row = spark.createDataFrame([(["ab", "c", "é"], ["a", "bc", "é"])], "a array<string>, b array<string>")
    got = row.select(text.hash_iterable(F.col("a")).alias("a"), text.hash_iterable(F.col("b")).alias("b"), text.hash_object({"z": F.lit(1), "a": F.lit("é"), "n": F.lit(None).cast("string")}).alias("o")).first()
    assert got["a"] == hashlib.sha256("2:ab1:c2:é".encode()).hexdigest()[:16] != got["b"]
    assert got["o"] == hashlib.sha256(json.dumps({"a": "é", "n": None, "z": 1}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:16]


def test_relaxed_filters_take_nothing(spark):
    rows = spark.createDataFrame([(1, 0, "ok", "yes"), (2, 0, "ok", "yes"), (3, 0, "How is rice grown here?", "Rice is grown in water in these fields.")], "doc_id long, position long, question string, answer string")
    reasons = lambda df: sorted(r[REASON] or "" for r in df.collect())
    assert reasons(pairs.question_answers(rows, **pairs.NAIVE_QUESTIONS)) == ["", "", ""]
    assert reasons(pairs.question_answers(rows)) == ["", "junk_query", "junk_query"]
    found = spark.createDataFrame([(1, "", "withdrawn"), (1, "", "withdrawn"), (2, "A subject of its own", "A body that was superseded by another notice of the year")], "doc_id long, subject string, body string")
    assert reasons(pairs.notices(found, **pairs.NAIVE_NOTICES)) == ["", "", ""]
    assert reasons(pairs.notices(found)) == ["superseded", "withdrawn", "withdrawn"]


def test_repeats_with_clashing_columns(spark):
    rows = spark.createDataFrame([(2, "a", 1, 2, 3, 4, None), (1, "a", 1, 2, 3, 4, None), (3, "b", 1, 2, 3, 4, "seen"), (4, "b", 1, 2, 3, 4, None)], f"doc_id long, t string, key int, k int, place int, first int, {REASON} string")
    out = reject_repeats(rows, F.col("t"), [F.col("doc_id")])
    assert out.columns == rows.columns
    assert {r["doc_id"]: r[REASON] for r in out.collect()} == {1: None, 2: "duplicate", 3: "seen", 4: None}


def test_judged_words_and_analogies(spark):
    rows = spark.createDataFrame([("a", 0, 0, [1.0, 0.0]), ("b", 1, 0, [0.9, 0.1]), ("c", 2, 0, [0.0, 1.0])], "word string, id long, grp long, v array<double>")
    judged = spark.createDataFrame([("a", "b", 9.0), ("a", "c", 1.0), ("b", "c", 2.0), ("a", "x", 5.0)], "word_a string, word_b string, score double")
    got = evaluate.similarity_correlation(rows.select("word", "v"), judged).first()
    assert (got["scored"], got["correlation"], got["coverage"]) == (3, 1.0, 0.75)
    none = evaluate.similarity_correlation(rows.select("word", "v"), judged.limit(0)).first()
    assert (none["scored"], none["correlation"], none["coverage"]) == (0, 0.0, 0.0)
    more = rows.select("id", "grp", "v").union(spark.createDataFrame([(3, 0, [0.05, 1.0])], "id long, grp long, v array<double>"))
    questions = spark.createDataFrame([(1, 0, 1, 2, 3), (2, 0, 1, 2, 99)], "question_id long, a long, b long, c long, expected long")
    got = evaluate.analogy_accuracy(more, questions).first()
    assert (got["attempted"], got["accuracy"], got["coverage"]) == (1, 1.0, 0.5)
    assert evaluate.accuracy(spark.createDataFrame([], "a int, b int"), "a", "b").first()["accuracy"] == 0.0
    mean = vectors.mean_pairwise_similarity(rows.select("v")).first()
    assert mean["pairs"] == 3


def test_candidate_columns(spark):
    rows = spark.createDataFrame([(0, 1, "p1", ["n", "p2", "n"]), (0, 0, "p0", ["p0", "m"]), (0, 2, "p2", None), (1, 0, "q", [])], "batch long, o long, positive string, negatives array<string>")
    got = select.candidate_columns(rows, "batch", "o").orderBy("batch", "column").collect()
    assert [r["text"] for r in got] == ["p0", "p1", "p2", "m", "n", "q"]


def test_windows_of_skip_grams(spark):
    rows = spark.createDataFrame([(i, [4, 5, 6, 7, 8]) for i in range(50)], "doc_id long, ids array<long>")
    whole = {(r["centre"], r["context"]): r["n"] for r in vocab.skip_grams(rows, 3).collect()}
    some = {(r["centre"], r["context"]): r["n"] for r in vocab.skip_grams(rows, 3, seed=1).collect()}
    assert whole[4, 7] == 50 and some[4, 5] == 50 and 5 < some[4, 7] < 35
    assert [r["token"] for r in vocab.probes(spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "token string, frequency long"), 2).collect()] == ["c", "a"]


def test_tables_with_headers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, token string")
    assert writers.save_table(rows, f"{tmp_path}/v", "vocabulary", language="en") == 2
    back, header = writers.load_table(spark, f"{tmp_path}/v", "vocabulary")
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")] and header["language"] == "en"
    with pytest.raises(ValueError, match="not index"):
        writers.load_table(spark, f"{tmp_path}/v", "index")
    rows.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/v/rows")
    with pytest.raises(ValueError, match="1 rows"):
        writers.load_table(spark, f"{tmp_path}/v", "vocabulary")


def test_judgement_files_and_slices(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"word_a": "a", "word_b": "b", "score": 3}\n')
    (tmp_path / "a.jsonl").write_text('{"a": "x", "b": "y", "c": "z", "expected": "w"}\n')
    assert tuple(readers.read_similarities(spark, str(tmp_path / "s.jsonl")).first()) == ("a", "b", 3.0)
    assert tuple(readers.read_analogies(spark, str(tmp_path / "a.jsonl")).first()) == ("x", "y", "z", "w")
    rows = spark.createDataFrame([(i, "en" if i % 2 else "ur", (f"a long  source {i}", "target text" if i else None)) for i in range(9)], "n long, lang string, t struct<en: string, ur: string>")
    got = readers.bitext_slices(rows, "t.en", "t.ur", ["lang"], order="n", at_most_rows=2).collect()
    assert sorted((r["lang"], r["source"]) for r in got) == [("en", "a long source 1"), ("en", "a long source 3"), ("ur", "a long source 2"), ("ur", "a long source 4")]
    assert readers.bitext_slices(rows, "t.en", "t.ur", order="n", at_most_rows=3).count() == 3
