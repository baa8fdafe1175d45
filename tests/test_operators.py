import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus, evaluate, joins, pairs, select, spans, vectors, vocab
from corpusloom.plans.ledger import accepted, judge, ledger, numbered, reject_repeats


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")


def test_ledger_reconciles_and_first_rule_wins(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(50)], "id long, v int")
    judged = judge(rows, [("small", F.col("v") < 3), ("even", F.col("v") % 2 == 0)])
    counts = {r["reason"]: r["n"] for r in ledger(judged).collect()}
    assert sum(counts.values()) == 50 and counts["small"] == sum(i % 7 < 3 for i in range(50))
    assert accepted(judged).count() == counts["accepted"]


def test_repeats_are_judged_among_open_rows(spark):
    rows = spark.createDataFrame([(1, "a", "short"), (2, "a", None), (3, "a", None), (4, "b", None)], "id long, k string, reject_reason string")
    got = {r["id"]: r["reject_reason"] for r in reject_repeats(rows, F.col("k"), [F.col("id")]).collect()}
    assert got == {1: "short", 2: None, 3: "duplicate", 4: None}


def test_numbered(spark):
    r = random.Random(1)
    values = [r.randint(0, 99) for _ in range(500)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v int").repartition(7)
    got = numbered(rows, [F.col("v"), F.col("id")]).orderBy("n").collect()
    assert [x["n"] for x in got] == list(range(1, 501))
    assert [(x["v"], x["id"]) for x in got] == sorted((v, i) for i, v in enumerate(values))
    assert numbered(rows.limit(0), [F.col("v")]).count() == 0


def test_results_do_not_depend_on_row_order(spark):
    r = random.Random(2)
    rows = [(i, f"{r.choice('abc')}  text {i % 9}") for i in range(60)]
    a = {x["doc_id"] for x in corpus.deduplicate(docs(spark, rows)).collect()}
    r.shuffle(rows)
    b = {x["doc_id"] for x in corpus.deduplicate(docs(spark, rows).repartition(5)).collect()}
    assert a == b


def test_sentence_rules(spark):
    cases = {" ": "blank", "a": "too_short", "x" * 10_001: "too_long", "12 !?": "no_letters", "ab�": "encoding_damage", "fine": None, "नमस्ते": None}
    rows = spark.createDataFrame([(k,) for k in cases], "line string")
    assert {r["line"]: r["reject_reason"] for r in corpus.sentence_filter(rows).collect()} == cases
    got = corpus.sentence_filter(rows, script="Latn").filter("line = 'नमस्ते'").first()
    assert got["reject_reason"] == "script_mismatch"


def test_audit(spark):
    good = "This is a document that is long enough to be fine.\nSecond line."
    rows = [(1, ""), (2, "short\nx"), (3, good), (4, good), (5, good + " [[x"), (6, good + "�"), (7, "1234567890 " * 6 + "\n1")]
    found = {r["code"]: r for r in corpus.audit(docs(spark, rows)).collect()}
    assert found["empty"]["examples"] == [1] and found["empty"]["severity"] == "error"
    assert found["duplicate"]["examples"] == [4] and found["markup"]["n"] == 1
    assert found["unknown_script"]["examples"] == [7] and found["encoding_damage"]["examples"] == [6]
    many = corpus.audit(docs(spark, [(i, f"{good} number {i}") for i in range(200)] + [(999, "")])).collect()
    assert [(r["code"], r["severity"]) for r in many] == [("empty", "warning")]


def test_percentiles_interpolate(spark):
    r = corpus.length_summary(spark.range(1, 101), "id").first()
    assert (r["median"], round(r["p95"], 2), round(r["p99"], 2)) == (50.5, 95.05, 99.01)


def structural(spark, paragraphs, title="A good title", sections=()):
    schema = "doc_id long, language string, title string, paragraphs array<string>, sections array<struct<heading: string, text: string>>"
    return spark.createDataFrame([(1, "en", title, paragraphs, list(sections))], schema)


def test_structural_pairs(spark):
    p = ["para one " + "x" * 100, "para two " + "y" * 100, "para three " + "z" * 2500]
    out = pairs.structural_pairs(structural(spark, p, sections=[("Heading here", "body " * 40), ("", "b"), ("Short one", "tiny")])).orderBy("kind_rank", "position").collect()
    assert [(r["kind"], r["position"], r["reject_reason"]) for r in out] == [("title_lead", 0, None), ("heading_section", 0, None), ("heading_section", 2, "short_positive"), ("adjacent", 0, None), ("adjacent", 1, None)] or [(r["kind"], r["reject_reason"]) for r in out] == [
        ("title_lead", None),
        ("heading_section", None),
        ("heading_section", "short_positive"),
        ("adjacent", None),
        ("adjacent", None),
    ]
    assert len(out[-1]["positive"]) == 2000
    assert pairs.structural_pairs(structural(spark, ["only one " + "x" * 100], title=None)).count() == 0


def test_question_answers(spark):
    long = "a long enough answer to a question"
    rows = [(1, 0, "ok", long), (1, 1, "1234567", long), (1, 2, "why so?", long), (1, 3, "what is the price", "short"), (2, 0, "how to grow rice", "Sow seeds in June and keep wet"), (3, 0, "HOW to grow rice", "sow seeds in june and keep wet"), (4, 0, "sow seeds in june", "Sow seeds in June and that is all of it")]
    rows += [(100 + i, 0, f"a question number {i}", "The same answer for everyone here") for i in range(50)]
    got = pairs.question_answers(spark.createDataFrame(rows, "doc_id long, position long, question string, answer string")).collect()
    reasons = {(r["doc_id"], r["position"]): r["reject_reason"] for r in got}
    assert len(got) == len(rows)
    assert [reasons[k] for k in ((1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (3, 0), (4, 0), (100, 0))] == ["junk_query", "junk_query", "short_query", "short_answer", None, "duplicate", "overlap", "boilerplate_answer"]


def test_notices(spark):
    body = "The rate of duty on imported goods is amended as set out below for all importers."
    rows = [(1, "Notice", body), (2, "Withdrawn notice of duty", body), (3, "Amendment of rates", body + " in supersession of the former"), (4, "Amendment of rates", "See the annexure"), (5, "", body + " x"), (6, "Amendment of rates of duty", body + " y"), (7, "Amendment of rates of DUTY", body + " Y"), (8, body, body), (9, "Long enough subject", "too short")]
    got = {r["doc_id"]: r["reject_reason"] for r in pairs.notices(spark.createDataFrame(rows, "doc_id long, subject string, body string")).collect()}
    assert got == {1: "short_subject", 2: "withdrawn", 3: "superseded", 4: "annexure_only", 5: "empty_subject", 6: None, 7: "duplicate", 8: "overlap", 9: "short_body"}


def test_bitext(spark):
    rows = [(1, 1, "a line in english", "une ligne en francais"), (2, 2, "short", "une ligne en francais"), (3, 3, "the same line", "the same line"), (4, 4, "a line in  english", "une ligne en francais"), (5, 5, "a line in english x", "y" * 2001)]
    got = {r["doc_id"]: r["reject_reason"] for r in pairs.bitext(spark.createDataFrame(rows, "doc_id long, position long, anchor string, positive string")).collect()}
    assert got == {1: None, 2: "short_anchor", 3: "identical", 4: "duplicate", 5: "long_positive"}


def test_provisions(spark):
    body = "A body of a provision that is certainly long enough to count as one."
    rows = [(1, 1, "Heading", body, "en", "Titel hier", body + " de", "de"), (2, 2, "Heading", "Repealed.", "en", "Titel hier", body, "de"), (3, 3, "Short", body, "en", "Titel hier", body, "de"), (4, 4, "Heading", body, "en", "Titel hier", "(aufgehoben)", "de"), (5, 5, "Heading", body, "en", "Titel hier", body + " de", "de")]
    frame = spark.createDataFrame(rows, "doc_id long, position long, left_heading string, left_body string, left_language string, right_heading string, right_body string, right_language string")
    out = pairs.provisions(frame)
    assert {r["doc_id"]: r["reject_reason"] for r in out.collect()} == {1: None, 2: "left_repealed", 3: "left_short_heading", 4: "right_repealed", 5: "duplicate"}
    both = pairs.both_directions(accepted(out)).orderBy("direction").collect()
    assert [(r["language"], r["positive_language"]) for r in both] == [("en", "de"), ("de", "en")]


def test_alignment(spark):
    schema = "doc_id long, title string, language string, lead string"
    source = spark.createDataFrame([(1, "One", "hi", "l"), (2, "Two", "hi", "l"), (3, "Three", "hi", "l"), (4, "", "hi", "l")], schema)
    target = spark.createDataFrame([(11, "uno", "ta", "first"), (12, "Uno", "ta", "last")], schema)
    links = spark.createDataFrame([(1, "nada", 1), (1, "UNO", 2), (2, "Dos", 1)], "from_id long, title string, link_order long")
    got = {r["doc_id"]: (r["status"], r["target_id"]) for r in joins.align_documents(source, links, target).collect()}
    assert got == {1: ("aligned", 12), 2: ("missing_target", None), 3: ("missing_langlink", None)}


def test_bilingual(spark):
    schema = "number string, heading string, body string, place long"
    left = spark.createDataFrame([("1", "h", "b", 1), ("1 ", "h2", "b2", 2), (None, "h", "b", 3), ("2", "h", "b", 4), ("4A", "", " ", 5)], schema)
    right = spark.createDataFrame([("1", "r", "rb", 1), ("3", "r", "rb", 2), ("4 a", "x", "y", 3)], schema)
    got = sorted((r["key"], r["status"], r["heading"]) for r in joins.align_bilingual(left, right).collect() if r["status"] not in ("no_number", "duplicate"))
    assert got == [("1", "aligned", "h"), ("2", "left_only", "h"), ("3", "right_only", "r"), ("4a", "empty_side", "x")]
    assert sorted(r["status"] for r in joins.align_bilingual(left, right).collect() if r["side"]) == ["duplicate", "no_number"]


def test_held_out(spark):
    rows = spark.createDataFrame([("d1", "a", "b"), ("d2", "TEXT one", "c"), ("d3", "x", "text  ONE"), ("d4", "y", "z")], "document string, anchor string, positive string")
    held = spark.createDataFrame([("d1", "TEXT one", "q")], "document string, anchor string, positive string")
    got = {r["document"]: r["reject_reason"] for r in joins.without_held_out(rows, held).collect()}
    assert got == {"d1": "document", "d2": "text", "d3": "normalized_text", "d4": None}
    with pytest.raises(ValueError, match="name no document"):
        joins.without_held_out(rows, held.withColumn("document", F.lit("")))


def test_selection(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    a = {r["k"] for r in select.sample(rows, "k", 100, 1).collect()}
    assert len(a) == 100 and a == {r["k"] for r in select.sample(rows.repartition(9), "k", 100, 1).collect()} and a != {r["k"] for r in select.sample(rows, "k", 100, 2).collect()}
    parts = {r["part"]: r["count"] for r in select.split(rows, "k", 0.8, 1).groupBy("part").count().collect()}
    assert parts == {"train": 800, "test": 200}
    held = select.stratified_clusters(rows.withColumn("c", F.col("k") % 50).withColumn("l", F.col("k") % 3), "c", "l", 30, 1)
    counts = {r["l"]: r["count"] for r in held.filter("part = 'eval'").groupBy("l").count().collect()}
    assert all(n >= 30 for n in counts.values())
    assert held.groupBy("c").agg(F.count_distinct("part").alias("n")).filter("n > 1").count() == 0
    with pytest.raises(ValueError, match="there are"):
        select.only(rows, "k", [-1])
    assert select.spaced([1, 2, 3, 10, 20], 3, 8) == [1, 10, 20] and len(select.spaced([1, 2, 3], 3, 50)) == 3
    assert select.dissimilar(["a b c", "a b d", "x y"], 3, 0.6) == ["a b c", "x y"]


def test_vocabulary(spark):
    counts = spark.createDataFrame([("b", 5), ("a", 5), ("c", 1), ("<unk>", 9), ("d", 7)], "word string, n long")
    got = [(r["id"], r["token"]) for r in vocab.vocabulary(counts, 2).orderBy("id").collect()]
    assert got == [(4, "d"), (5, "a"), (6, "b")]
    assert vocab.vocabulary(counts, 1, 6).count() == 2
    v = vocab.vocabulary(counts, 2)
    enc = {r["doc_id"]: r["ids"] for r in vocab.encode(docs(spark, [(1, "d a z"), (2, "")]), v).collect()}
    assert enc == {1: [4, 5, 1], 2: []}
    enc = spark.createDataFrame([(1, list(range(4, 104)))], "doc_id long, ids array<bigint>")
    masked = vocab.mask_tokens(enc, 0.5, vocab_size=200).first()
    asked = [i for i, x in enumerate(masked["labels"]) if x != -100]
    assert 25 < len(asked) < 75 and all(masked["masked"][i] == masked["ids"][i] for i in range(100) if i not in asked)


def test_skip_grams(spark):
    enc = spark.createDataFrame([(1, [4, 5, 1, 6])], "doc_id long, ids array<bigint>")
    got = {(r["centre"], r["context"]): r["n"] for r in vocab.skip_grams(enc, 1).collect()}
    assert got == {(4, 5): 1, (5, 4): 1, (5, 6): 1, (6, 5): 1}


def at(angle):
    return [math.cos(math.radians(angle)), math.sin(math.radians(angle))]


def test_hard_negatives_and_ranks(spark):
    rows = [(0, 0, at(0), at(60)), (1, 1, at(90), at(10)), (2, 2, at(180), at(80)), (3, 0, at(45), at(5)), (4, 3, at(0), at(100))]
    frame = spark.createDataFrame(rows, "id long, document long, anchor array<double>, positive array<double>")
    walk = vectors.hard_negatives(frame, count=2, maximum=0.99, minimum=0.0).filter("id = 0").orderBy("rank").collect()
    assert [(r["candidate"], r["reason"]) for r in walk] == [(3, "same_document"), (1, "accepted"), (0, "own_positive"), (2, "accepted")]
    margin = vectors.hard_negatives(frame, count=9, maximum=0.99, margin=0.1).filter("id = 0").collect()
    assert {r["candidate"]: r["reason"] for r in margin}[1] == "within_margin" and {r["candidate"]: r["reason"] for r in margin}[4] == "too_easy"
    queries = frame.select("id", F.col("document").alias("grp"), F.col("anchor").alias("v"), vectors.cosine(F.col("anchor"), F.col("positive")).alias("own"), F.col("id").alias("positive_id"))
    ranks = {r["query_id"]: r["rank"] for r in vectors.pessimistic_ranks(queries, frame.select("id", F.col("document").alias("grp"), F.col("positive").alias("v"))).collect()}
    assert ranks[0] == 2 and ranks[4] == 4
    same = spark.createDataFrame([(i, 0, [1.0, 0.0], 1.0, i) for i in range(5)], "id long, grp long, v array<double>, own double, positive_id long")
    assert {r["rank"] for r in vectors.pessimistic_ranks(same, same.select("id", "grp", "v")).collect()} == {4}  # collapsed: last


def test_zero_vectors_are_never_found(spark):
    frame = spark.createDataFrame([(0, None, [0.0, 0.0]), (1, None, [1.0, 0.0]), (2, None, [0.0, 1.0])], "id long, grp long, v array<double>")
    assert {(r["query_id"], r["id"]) for r in vectors.top_k(frame, frame, 5).collect()} == {(1, 2), (2, 1)}


def test_blocks_of_any_size_agree(spark, monkeypatch):
    r = random.Random(3)
    frame = spark.createDataFrame([(i, i % 3, [r.gauss(0, 1) for _ in range(6)]) for i in range(80)], "id long, grp long, v array<double>")
    one = sorted(vectors.top_k(frame, frame, 7).collect())
    monkeypatch.setattr(vectors, "BLOCK", 9)
    assert sorted(vectors.top_k(frame, frame, 7).collect()) == one


def test_spectrum_and_common_direction(spark):
    frame = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(1, 9)], "id long, v array<double>")
    assert vectors.spectrum(frame)["effective_dimensions"] == 1.0
    out = vectors.remove_common_direction(frame).collect()
    assert all(abs(x) < 1e-9 for r in out for x in r["v"])


def test_scores(spark):
    ranks = spark.createDataFrame([(0, "a"), (4, "a"), (20, None)], "rank long, language string")
    got = {(r["facet"], r["value"]): r for r in evaluate.report(ranks, "language").collect()}
    assert set(got) == {("all", None), ("language", "a")}
    assert got["all", None]["recall_at_5"] == pytest.approx(2 / 3) and got["language", "a"]["mrr"] == pytest.approx((1 + 1 / 5) / 2)
    low, high = evaluate.wilson(F.lit(0.0), F.lit(10))
    r = spark.range(1).select(low.alias("low"), high.alias("high")).first()
    assert r["low"] == 0.0 and 0 < r["high"] < 0.35


def test_average_ranks(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double")
    assert sorted(r["r"] for r in evaluate.average_ranks(rows, "v", "r").collect()) == [1.0, 2.5, 2.5, 4.0]
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert evaluate.pearson(flat, "a", "b").first()["r"] == 0.0


def test_spans(spark):
    rows = spark.createDataFrame([(1, 0, 3), (1, 2, 5), (1, 7, 9), (2, 1, 2)], "k long, begin long, end long")
    merged = spans.merge_overlapping(rows, "k")
    assert sorted(tuple(r) for r in merged.collect()) == [(1, 0, 5), (1, 7, 9), (2, 1, 2)]
    arrays = merged.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("m"))
    gaps = {r["k"]: [tuple(s) for s in r["g"]] for r in arrays.select("k", spans.invert(F.col("m"), F.lit(10)).alias("g")).collect()}
    assert gaps == {1: [(5, 7), (9, 10)], 2: [(0, 1), (2, 10)]}
    assert arrays.select(spans.ordered(F.col("m")).alias("o")).first()["o"] is True


def test_spans_with_nulls_as_in_sql(spark, tmp_path):
    import __spark_entry__
    import oracle

    ids = [*range(0, 400, 7), None, None]
    rows = spark.createDataFrame([(i, u) for u in (1, 2, None) for i in ids] + [(None, 3), (None, 3), (5, 4)], "event_id long, user_id long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert oracle.differences(spark, con, __spark_entry__.queries()["merge_spans"], __spark_entry__.oracle_sql()["merge_spans"], str(tmp_path)) == ""


def test_contained_passages(spark):
    d = docs(spark, [(1, "x A quick Brown fox jumps over the lazy dog today y"), (2, "nothing here"), (3, "quick")])
    b = spark.createDataFrame([(1, "a quick brown fox jumps over the lazy dog"), (2, "quick"), (3, "")], "item_id long, text string")
    assert sorted(tuple(r) for r in joins.contained_passages(d, b).collect()) == [(1, 1), (1, 2), (3, 2)]


def test_blocked_answers_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    r = np.random.default_rng(5)
    v, groups = r.normal(size=(40, 5)).round(3), r.integers(0, 4, 40)
    frame = spark.createDataFrame([(i, int(groups[i]), v[i].tolist()) for i in range(40)], "id long, grp long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round(u @ u.T, vectors.PLACES)
    own = np.array([sim[i, (i + 1) % 40] for i in range(40)])
    queries = frame.join(spark.createDataFrame([(i, float(own[i])) for i in range(40)], "id long, own double"), "id")
    rank = lambda **how: {x["query_id"]: x["rank"] for x in vectors.pessimistic_ranks(queries, frame, **how).collect()}
    assert rank() == {i: int((sim[i] >= own[i]).sum()) - 1 for i in range(40)}
    assert rank(mask_same_text=True) == {i: int((np.delete(sim[i], i) >= own[i]).sum()) - 1 for i in range(40)}
    assert rank(same_group=True) == {i: int((sim[i][groups == groups[i]] >= own[i]).sum()) - 1 for i in range(40)}
    best = {(x["query_id"], x["grp"]): x["id"] for x in vectors.best_per_group(frame, frame).collect()}
    assert best == {(i, g): int(np.flatnonzero(groups == g)[sim[i][groups == g].argmax()]) for i in range(40) for g in set(groups.tolist())}
    other = {(x["query_id"], x["rank"]): x["id"] for x in vectors.top_k(frame, frame, 3, other_group=True).collect()}
    for i in range(40):
        far = [j for j in sorted(range(40), key=lambda j: (-sim[i, j], j)) if groups[j] != groups[i]][:3]
        assert [other[i, k] for k in (1, 2, 3)] == far
    values = np.linalg.svd(v - v.mean(axis=0), compute_uv=False)
    got = vectors.spectrum(frame)
    assert got["isotropy"] == pytest.approx(values[-1] / values[0]) and got["effective_dimensions"] == 1 + int(np.searchsorted(np.cumsum(values**2) / (values**2).sum(), 0.95))


@pytest.mark.parametrize("same_group", [False, True])
def test_blocks_are_never_broadcast(spark, same_group):
    rows = spark.createDataFrame([(i, i % 2, [1.0, float(i)]) for i in range(20)], "id long, grp long, v array<double>")
    pairs = vectors.block_pairs(rows, rows, lambda qi, *_: (qi,), "query_id long", ["query_id"], same_group=same_group)
    assert pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_searches_keep_all_ties_and_every_row(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "HELD_BYTES", 16 * 3 * 8 * 2)
    r = np.random.default_rng(8)
    v = r.integers(-1, 2, size=(150, 3)).astype(float)
    v[20:90], v[7] = [1.0, 1.0, 0.0], 0.0
    ids = r.permutation(150)
    frame = spark.createDataFrame([(int(i), int(i) % 3, x.tolist()) for i, x in zip(ids, v, strict=True)], "id long, grp long, v array<double>")
    known = {int(i): x / np.linalg.norm(x) for i, x in zip(ids, v, strict=True) if x.any()}
    for how in ({}, {"other_group": True}, {"not_self": False}):
        got = {}
        for x in vectors.top_k(frame, frame, 5, **how).orderBy("query_id", "rank").collect():
            got.setdefault(x["query_id"], []).append(x["id"])
        far = lambda i, j: (not how.get("other_group") or i % 3 != j % 3) and (i != j or how.get("not_self") is False)
        assert got == {i: sorted((j for j in known if far(i, j)), key=lambda j: (-round(float(known[i] @ known[j]), vectors.PLACES), j))[:5] for i in known}


def test_rank_metrics_asks_with_every_vector(spark, tmp_path):
    import __spark_entry__
    import oracle

    r = np.random.default_rng(9)
    rows = [(i, r.normal(size=4).tolist(), None if i % 17 == 3 else i % 4 - 1) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert __spark_entry__.queries()["rank_metrics"](spark, str(tmp_path)).count() == 60
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert oracle.differences(spark, con, __spark_entry__.queries()["rank_metrics"], __spark_entry__.oracle_sql()["rank_metrics"], str(tmp_path)) == ""


def test_mean_pool_against_brute_force(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=(9, 4))
    known = spark.createDataFrame([(f"t{i}", v[i].tolist()) for i in range(8)], "token string, v array<double>")
    texts = {d: r.integers(0, 9, r.integers(1, 30)).tolist() for d in range(25)} | {99: [8, 8]}  # t8 isn't known
    tokens = spark.createDataFrame([(d, f"t{t}") for d, ts in texts.items() for t in ts], "doc_id long, token string").repartition(5)
    got = {x["doc_id"]: x["v"] for x in vectors.mean_pool(tokens, known).collect()}
    want = {d: np.mean([v[t] for t in ts if t < 8], axis=0) for d, ts in texts.items() if any(t < 8 for t in ts)}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d].tolist()) for d in got)
