import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.functions.encoders import encoder, hash_encoder
from corpusloom.plans import config, pipelines
from corpusloom.sources import writers

PAIR = "document string, anchor string, positive string, kind string, language string, positive_language string, overlap double"


def test_settings_layers():
    file = {"pairs": {"maximum_overlap": 0.5}, "profiles": {"strict": {"pairs": {"maximum_overlap": 0.25}}}}
    assert config.load(file, environment={}).pairs.maximum_overlap == 0.5
    assert config.load(file, "strict", {}).pairs.maximum_overlap == 0.25
    assert config.load(file, "strict", {"CORPUSLOOM_PAIRS__MAXIMUM_OVERLAP": "0.75"}).pairs.maximum_overlap == 0.75
    assert config.load(file, "strict", {"CORPUSLOOM_PAIRS__MAXIMUM_OVERLAP": "0.75"}, ["pairs.maximum_overlap=1"]).pairs.maximum_overlap == 1.0
    for bad in (["pairs.nothing=1"], ["pairs.maximum_overlap=2"], ["negatives.pool=1"], ["x"], ["corpus.lowercase=3"]):
        with pytest.raises(config.ConfigurationError):
            config.load(None, environment={}, overrides=bad)
    with pytest.raises(config.ConfigurationError, match="no profile"):
        config.load(file, "none", {})


def rows(n=60):
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        topic = r.sample(words, 8)
        out.append((f"d{i // 2}", " ".join(topic[:5]), " ".join(topic[2:] + ["x"]), "adjacent" if i % 3 else "title_lead", "en" if i % 2 else "fr", None, 0.4))
    return out


def test_negatives_scores_and_selection(spark):
    pairs = spark.createDataFrame(rows(), PAIR)
    encode = hash_encoder(32)
    out, statistics = pipelines.mine_negatives(pairs, encode, config.NegativeSettings(count=2, maximum_similarity=0.9, minimum_similarity=-1.0))
    assert out.count() == 60 and set(pairs.columns) < set(out.columns)
    texts = {r["positive"]: r["document"] for r in pairs.collect()}
    for r in out.collect():
        assert r["positive"] not in r["negatives"] and all(texts[n] != r["document"] for n in r["negatives"])
    assert {r["reason"] for r in statistics.collect()} >= {"accepted"}
    report, separation = pipelines.score_pairs(pairs, encode)
    overall = report.filter("facet = 'all'").first()
    assert overall["queries"] == 60 and overall["recall_at_1"] > 0.5
    assert {r["facet"] for r in report.collect()} == {"all", "language", "kind", "overlap_band"}
    assert separation.first()["queries"] == 60
    with pytest.raises(ValueError, match="two distinct"):
        pipelines.score_pairs(pairs.limit(1), encode)
    train, held, ledger = pipelines.select_pairs(pairs, None, config.SelectionSettings(train_pairs=20, evaluation_pairs=10, query_prefix="query: "))
    assert train.count() == 20 and held.count() == 10
    assert not {r["document"] for r in train.collect()} & {r["document"] for r in held.collect()}
    assert sum(r["n"] for r in ledger.collect()) == 60 and train.first()["anchor"].startswith("query: ")


def test_search(spark):
    texts = spark.createDataFrame([(1, "rice grows in water"), (2, "cars need fuel"), (3, " ")], "id long, text string")
    index = pipelines.build_index(texts, hash_encoder())
    assert index.count() == 2
    hits = pipelines.search(index, spark.createDataFrame([(7, "rice in water"), (8, "")], "id long, text string"), hash_encoder(), 2).collect()
    assert [(h["query_id"], h["id"]) for h in sorted(hits, key=lambda h: h["rank"])] == [(7, 1), (7, 2)]


def test_encoder_contract(spark):
    import numpy as np

    wrong = encoder(lambda: lambda texts: np.zeros((len(texts), 3)), 4)
    with pytest.raises(Exception, match="the encoder gave"):
        spark.createDataFrame([("a",)], "t string").select(wrong(F.col("t"))).collect()


def test_parallel(spark):
    left = spark.createDataFrame([(1, "one line here"), (2, "two lines here")], "n long, line string")
    right = spark.createDataFrame([(1, "une ligne ici"), (2, "court")], "n long, line string")
    found, ledger = pipelines.ingest_parallel(left, right, "en", "fr")
    assert [(r["language"], r["positive_language"]) for r in found.collect()] == [("en", "fr")]
    assert {r["reason"]: r["n"] for r in ledger.collect()} == {"accepted": 1, "short_positive": 1}
    with pytest.raises(ValueError, match="no partner"):
        pipelines.ingest_parallel(left, right.limit(1), "en", "fr")


def test_commands(spark, tmp_path, capsys):
    docs = [{"id": str(i), "title": f"Title number {i}", "language": "en", "text": "\n\n".join(f"Paragraph {j} of {i}. " + f"word{i}{j} " * 30 for j in range(3))} for i in range(5)]
    source = tmp_path / "docs.jsonl"
    source.write_text("\n".join(map(json.dumps, docs)))
    say = lambda *a: (cli.main([*a], spark), capsys.readouterr().out)
    code, out = say("stats", "--set", f"corpus.source={source}")
    assert code == 0 and '"documents": 5' in out
    code, out = say("validate", "--strict", "--set", f"corpus.source={source}")
    assert code == 0
    code, out = say("mine-pairs", "--set", f"corpus.source={source}", "--output", str(tmp_path / "pairs"))
    assert code == 0 and '"written": 15' in out
    code, out = say("mine-negatives", "--set", f"corpus.source={tmp_path / 'pairs'}", "--output", str(tmp_path / "negatives"))
    assert code == 0 and '"written": 15' in out
    code, out = say("evaluate", "--set", f"corpus.source={tmp_path / 'pairs'}")
    assert code == 0 and '"recall_at_1"' in out
    code, out = say("search", "--set", f"corpus.source={source}", "--query", "word01", "-k", "2")
    assert code == 0 and out.count('"rank"') == 2
    code, out = say("prepare-eval", "--set", f"corpus.source={tmp_path / 'pairs'}", "--set", "selection.evaluation_pairs=3", "--output", str(tmp_path / "prepared"))
    assert code == 0 and '"eval": 3' in out
    code, out = say("finetune", "--set", f"corpus.source={tmp_path / 'pairs'}", "--set", "selection.evaluation_pairs=4", "--output", str(tmp_path / "tuned"))
    assert code == 0 and '"report": "before"' in out
    code, out = say("train", "--set", f"corpus.source={source}", "--output", str(tmp_path / "model"), "--min-count", "2")
    assert code == 0
    known, header = writers.load_table(spark, str(tmp_path / "model/vocabulary"), "vocabulary")
    assert known.count() == header["rows"] > 5
    assert {r["token"] for r in writers.load_table(spark, str(tmp_path / "model/vectors"), "vectors")[0].collect()} <= {r["token"] for r in known.collect()}


def test_two_sided_commands(spark, tmp_path, capsys):
    say = lambda *a: (cli.main([*a], spark), capsys.readouterr().out)
    (tmp_path / "a.txt").write_text("one line here\ntwo lines here\n")
    (tmp_path / "b.txt").write_text("une ligne ici\ncourt\n")
    code, out = say("ingest-parallel", "--set", f"corpus.source={tmp_path / 'a.txt'}", "--set", "corpus.language=en", "--target", str(tmp_path / "b.txt"), "--target-language", "fr", "--output", str(tmp_path / "bitext"))
    assert code == 0 and '"written": 1' in out
    lead = " and more of it so that it is long enough for a lead" * 3
    for name, title in (("hi", "Earth"), ("ta", "Bhumi")):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"id": "1", "title": title, "language": name, "text": f"The lead of {title}{lead}"}))
    (tmp_path / "links.sql").write_text("INSERT INTO `langlinks` VALUES (1,'ta','Bhumi');\n")
    code, out = say("mine-aligned", "--set", f"corpus.source={tmp_path / 'hi.jsonl'}", "--target", str(tmp_path / "ta.jsonl"), "--target-language", "ta", "--links", str(tmp_path / "links.sql"), "--output", str(tmp_path / "aligned"))
    assert code == 0 and '"written": 4' in out
    (tmp_path / "scans").mkdir()
    (tmp_path / "scans/one.bin").write_bytes(b"a page of a judgment " * 20)
    code, out = say("extract-judgments", "--set", f"corpus.source={tmp_path / 'scans'}", "--output", str(tmp_path / "judgments"))
    assert code == 0 and '"written": 1' in out


def test_tables_and_acts(spark, tmp_path, capsys):
    say = lambda *a: (cli.main([*a], spark), capsys.readouterr().out)
    (tmp_path / "q.csv").write_text("QueryText,KccAns,CreatedOn\nHow is rice grown here in summer?,It grows in water in fields of the south.,1\nok,yes,2\n")
    code, out = say("mine-questions", "--set", f"corpus.source={tmp_path / 'q.csv'}", "--output", str(tmp_path / "q"))
    assert code == 0 and '"written": 1' in out and '"junk_query"' in out
    (tmp_path / "n.csv").write_text("NotificationNumber,Subject,Body\n1,Duty on steel from abroad,A duty of ten per cent applies to certain goods of that kind.\n2,Withdrawn duty,It is withdrawn\n")
    code, out = say("mine-notices", "--set", f"corpus.source={tmp_path / 'n.csv'}", "--output", str(tmp_path / "n"))
    assert code == 0 and '"written": 1' in out and '"withdrawn"' in out
    act = {"Act Title": "An Act", "Act ID": "7", "Enactment Date": "2000", "Chapters": {"1": {"Sections": {"1": {"heading": "H", "paragraphs": {"0": "First.", "1": "Second."}}}}}}
    (tmp_path / "act.json").write_text(json.dumps(act))
    code, out = say("extract-acts", "--set", f"corpus.source={tmp_path / 'act.json'}", "--output", str(tmp_path / "acts"))
    assert code == 0 and '"written": 1' in out
    assert spark.read.json(str(tmp_path / "acts")).first()["text"] == "First.\nSecond."
