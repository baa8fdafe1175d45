import bz2
import gzip
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import readers, writers
from corpusloom.streaming import dedup


def test_text_and_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Hello.\n\nWorld")
    (tmp_path / "b.txt").write_text("  \n ")
    with gzip.open(tmp_path / "c.txt.gz", "wt") as f:
        f.write("zipped")
    got = {r["title"]: r["text"] for r in readers.read_text(spark, str(tmp_path), "en").collect()}
    assert got == {"a": "Hello.\n\nWorld", "c": "zipped"}
    assert sorted((r["id"], r["text"]) for r in readers.read_lines(spark, str(tmp_path / "a.txt")).collect()) == [("a:1", "Hello."), ("a:3", "World")]


def test_jsonl(spark, tmp_path):
    rows = [{"id": "1", "text": "one", "language": "hi", "topic": "x"}, {"text": "two", "sections": [{"heading": "h", "text": "t"}]}, {"text": "  "}, {"_header": True, "text": "meta"}]
    path = tmp_path / "d.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    got = sorted(readers.read_jsonl(spark, str(path), language="en").collect(), key=lambda r: r["text"])
    assert [(r["text"], r["language"], r["attributes"]) for r in got] == [("one", "hi", {"topic": "x"}), ("two", "en", {})]
    assert len(got[1]["id"]) == 16 and got[1]["sections"][0]["heading"] == "h"
    path.write_text('{"body": "x"}\n')
    with pytest.raises(Exception, match="without the string text"):
        readers.read_jsonl(spark, str(path)).collect()


def test_reader_for():
    assert readers.reader_for("a/b.jsonl.gz") is readers.read_jsonl and readers.reader_for("a/b") is readers.read_text and readers.reader_for("x", "lines") is readers.read_lines
    with pytest.raises(readers.ReadError):
        readers.reader_for("x", "none")


def test_tables(spark, tmp_path):
    path = tmp_path / "k.csv"
    path.write_text('statename,QUERYTEXT,KccAns\nUP,"how  to\ngrow","sow ""it"""\nUP,,x\n')
    got = readers.read_questions(spark, str(path)).collect()
    assert [(r["question"], r["answer"], r["state"], r["crop"]) for r in got] == [("how to grow", 'sow "it"', "UP", "")]
    with pytest.raises(readers.ReadError, match="Subject"):
        readers.read_notices(spark, str(path))


def test_langlinks(spark):
    line = r"INSERT INTO `langlinks` VALUES (1,'ta','It\'s (a) title'),(2,'hi','x,y'),(3,'ta','back\\slash');"
    got = [tuple(r)[:3] for r in readers.langlinks(spark.createDataFrame([(line,), ("-- (9,'ta','no')",)], "value string")).collect()]
    assert got == [(1, "ta", "It's (a) title"), (2, "hi", "x,y"), (3, "ta", "back\\slash")]


DUMP = """<mediawiki><page><title>One</title><ns>0</ns><id>1</id><revision><text>'''One''' is a [[thing|thing]]. {prose}

== Part ==
Text of the part {{{{tpl}}}}.

== References ==
gone</text></revision></page>
<page><title>Two</title><ns>0</ns><id>2</id><redirect title="One"/><revision><text>#REDIRECT</text></revision></page>
<page><title>Talk</title><ns>1</ns><id>3</id><revision><text>{prose}</text></revision></page>
<page><title>Short</title><ns>0</ns><id>4</id><revision><text>short</text></revision></page>
<page><title>Dirty</title><ns>0</ns><id>5</id><revision><text>{prose} [[open {prose}</text></revision></page></mediawiki>"""


def test_mediawiki(spark, tmp_path):
    path = tmp_path / "dump.xml.bz2"
    path.write_bytes(bz2.compress(DUMP.format(prose="Some prose. " * 30).encode()))
    got = readers.read_mediawiki(spark, str(path), "en").collect()
    assert [(r["id"], r["title"]) for r in got] == [("1", "One")]
    assert [(s["heading"], s["text"]) for s in got[0]["sections"]] == [("Part", "Text of the part .")]
    assert "gone" not in got[0]["text"] and got[0]["text"].startswith("One is a thing.")


def test_formex_and_acts_and_releases(spark):
    xml = '<ACT><ARTICLE IDENTIFIER="001"><TI.ART>Article 1</TI.ART><STI.ART>Scope</STI.ART><PARAG IDENTIFIER="1"><NO.PARAG>1.</NO.PARAG><ALINEA>This <HT>act</HT> applies.</ALINEA></PARAG></ARTICLE></ACT>'
    got = readers.formex_articles(spark.createDataFrame([(xml,)], "value string")).first()
    assert (got["number"], got["heading"], got["body"]) == ("001", "Article 1 - Scope", "1.This act applies.")
    with pytest.raises(Exception, match="without articles"):
        readers.formex_articles(spark.createDataFrame([("<ACT/>",)], "value string")).collect()
    act = {"Act Title": "T", "Act ID": "A1", "Enactment Date": "d", "Parts": {"I": {"Sections": {"1": {"heading": "h", "paragraphs": {"10": "z", "2": "y"}}}}}, "Sections": {"9": {"heading": "e", "paragraphs": {}}}}
    got = readers.acts(spark.createDataFrame([(json.dumps(act),)], "value string")).first()
    assert got["id"] == "A1" and [tuple(s) for s in got["sections"]] == [("h", "y\nz")]
    html = '<div id="MinistryName">Min</div><h2 id="Titleh2">The title</h2><div class="ReleaseLang"><a href="?PRID=12">Hindi</a> <a href="?PRID=13">Tamil</a></div><script>x</script><p>Body &amp; more</p>'
    got = readers.releases(spark.createDataFrame([(html,)], "html string")).first()
    assert (got["title"], got["ministry"], got["siblings"]) == ("The title", "Min", {"12": "Hindi", "13": "Tamil"})


def test_injected_reader(spark, tmp_path):
    (tmp_path / "case.pdf").write_bytes(b"x" * 300)
    got = readers.read_with(spark, str(tmp_path / "case.pdf"), lambda b: [" page one " + "w " * 150, "", "page   two"]).first()
    assert got["id"] == "case" and got["text"].endswith("page two")


def test_translation_units(spark):
    rows = [("d", "1", "en", "a", "hi", "b"), ("d", "2", "en", "a", "ta", "b"), ("e", "3", "en", "a", "hi", "b"), ("d", "4", "en", " ", "hi", "b")]
    frame = spark.createDataFrame(rows, "dataset string, id string, src_lang string, src string, tgt_lang string, tgt string")
    got = {r["id"]: r["reject_reason"] for r in readers.translation_units(frame, dataset="d", target="hi").collect()}
    assert got == {"1": None, "2": "other_target", "3": "other_dataset", "4": "blank"}


def test_paginate():
    data = list(range(25))
    fetch = lambda offset, limit: {"records": data[offset : offset + min(limit, 4)], "total": 25}
    got = readers.paginate(fetch, 10)
    assert got["records"] == data and got["stopped"] == "complete" and got["shortfall"] == 0 and got["pages"] == 7
    assert readers.paginate(fetch, 10, 9)["records"] == data[:9]
    assert readers.paginate(lambda o, n: {"records": [], "total": 3}, 5)["shortfall"] == 3


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(" a  b ",), ("  ",), ("c",)], "sentence string")
    assert writers.write_sentences(rows, str(tmp_path / "s")) == 2
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()) == ["a b", "c"]
    assert writers.write_jsonl(rows, str(tmp_path / "j"), gzip=True) == 3
    pairs = spark.createDataFrame([("a", "p", 0.123456, ["n", " "]), ("b", "q", 0.5, [])], "anchor string, positive string, overlap double, negatives array<string>")
    writers.write_jsonl(writers.pair_records(pairs), str(tmp_path / "p"))
    back = writers.pairs_from_records(spark.read.schema("anchor string, positive string, overlap double, negatives array<string>").json(str(tmp_path / "p")))
    assert sorted((r["anchor"], r["overlap"], r["negatives"]) for r in back.collect()) == [("a", 0.1235, ["n"]), ("b", 0.5, [])]
    with pytest.raises(Exception, match="without anchor"):
        writers.pairs_from_records(spark.createDataFrame([(" ", "p")], "anchor string, positive string")).collect()
    writers.write_csv(rows, str(tmp_path / "c"), ["id", "sentence"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id", "sentence"]
    assert "| a b" in writers.markdown_report("T", spark.createDataFrame([("a b", 0.5)], "k string, v double"))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"text  {i % 5}") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    dedup.drain(dedup.deduplicate_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    dedup.drain(dedup.filter_stream(stream.select(F.col("text").alias("line"))), str(tmp_path / "out2"), str(tmp_path / "state2"))
    assert spark.read.parquet(str(tmp_path / "out2")).filter("reject_reason is null").count() == 20


def test_windows(spark, tmp_path):
    rows = [(f"2024-01-01 0{i % 3}:10:00", "a", i) for i in range(9)]
    frame = spark.createDataFrame(rows, "ts string, kind string, n int").withColumn("ts", F.to_timestamp("ts"))
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    dedup.windowed_counts(stream, "ts", "kind").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [3, 3, 3]
