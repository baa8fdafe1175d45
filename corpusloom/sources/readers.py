"""Corpus readers. Each returns documents: id, text, language, title, source, attributes, sections."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ElementTree
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import fixed, text, unicode

SECTIONS = "array<struct<heading: string, text: string>>"
DOCUMENT = ["id", "text", "language", "title", "source", "attributes", "sections"]
SUFFIXES = {".txt": "text", ".text": "text", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "jsonl", ".csv": "csv", ".xml": "xml"}


class ReadError(ValueError):
    """A source that isn't what it should be."""


def _document(df: DataFrame, language: str | None = None, **columns: Column) -> DataFrame:
    defaults = {"language": F.lit(language).cast("string"), "title": F.lit(None).cast("string"), "attributes": F.create_map().cast("map<string,string>"), "sections": F.array().cast(SECTIONS)}
    given = {"source": F.input_file_name()} | defaults | columns
    return df.select(*(given[c].alias(c) for c in DOCUMENT))


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?:\.[A-Za-z]+)?(?:\.gz)?$", "")


def _not_blank(column: str) -> Column:
    return text.collapse(F.col(column)) != ""


def read_text(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """One document per file, named by its content; blank files are skipped. Gzip is transparent."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).filter(_not_blank("value"))
    return _document(files, language, id=text.digest(F.col("value")), text=F.col("value"), title=_stem(F.input_file_name()))


def read_lines(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """One document per line that isn't blank, named file:line with lines counted from 1, blank ones too."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).withColumn("file", F.input_file_name())
    rows = files.select("file", F.posexplode(F.split("value", "\r?\n", -1)).alias("p", "line")).filter(_not_blank("line"))
    return _document(rows, language, id=F.concat(_stem(F.col("file")), F.lit(":"), (F.col("p") + 1).cast("string")), text=text.collapse(F.col("line")), source=F.col("file"))


def read_jsonl(spark: SparkSession, path: str, text_field: str = "text", language: str | None = None) -> DataFrame:
    """One document per record. The text field must be there and a string, else the read fails; blank
    texts are skipped; a missing id is the content's hash; unknown keys are attributes."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).filter(_not_blank("value"))
    fields = F.from_json("value", T.MapType(T.StringType(), T.StringType()), {"mode": "FAILFAST"})
    rows = raw.withColumn("f", fields).withColumn("body", F.col("f").getItem(text_field))
    whole = F.try_parse_json("value")
    is_string = F.schema_of_variant(F.try_variant_get(whole, f"$.{text_field}", "variant")) == "STRING"
    bad = F.raise_error(F.concat(F.lit(f"record without the string {text_field}: "), F.left("value", F.lit(80)))).cast("string")
    rows = rows.withColumn("body", F.when(F.coalesce(is_string, F.lit(False)), F.col("body")).otherwise(bad)).filter(_not_blank("body"))
    named = ["id", "language", "title", "sections", "_header", text_field]
    sections = F.from_json(F.col("f").getItem("sections"), SECTIONS)
    return _document(
        rows.filter(F.col("f").getItem("_header").isNull()),
        id=F.coalesce(F.col("f").getItem("id"), text.digest(F.col("body"))),
        text=F.col("body"),
        language=F.coalesce(F.col("f").getItem("language"), F.lit(language).cast("string")),
        title=F.col("f").getItem("title"),
        attributes=F.map_filter("f", lambda k, v: ~k.isin(named) & v.isNotNull()),
        sections=F.coalesce(sections, F.array().cast(SECTIONS)),
    )


READERS: dict[str, Callable[..., DataFrame]] = {"text": read_text, "lines": read_lines, "jsonl": read_jsonl}


def reader_for(path: str, kind: str = "auto") -> Callable[..., DataFrame]:
    """The reader of a kind; `auto` goes by the suffix under `.gz`, text if it says nothing."""
    if kind != "auto":
        if kind not in READERS:
            raise ReadError(f"no reader {kind!r}; there are {sorted(READERS)}")
        return READERS[kind]
    name = path.lower().removesuffix(".gz")
    suffix = name[name.rfind(".") :] if "." in name.rsplit("/", 1)[-1] else ""
    return READERS.get(SUFFIXES.get(suffix, "text"), read_text)


def read_table(spark: SparkSession, path: str, required: dict[str, str], optional: dict[str, str] | None = None) -> DataFrame:
    """CSV (gzip or not) by its header, whatever its case: output name -> header. White space is made
    single; a missing required column is an error that names what there is."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(path)
    there = {c.strip().lower(): c for c in raw.columns}
    missing = [h for h in required.values() if h.lower() not in there]
    if missing:
        raise ReadError(f"no column {missing}; there are {raw.columns}")
    column = lambda h: text.collapse(F.coalesce(F.col(f"`{there[h.lower()]}`"), F.lit(""))) if h.lower() in there else F.lit("")
    return raw.select(*(column(h).alias(name) for name, h in (required | (optional or {})).items()))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Call-centre rows; those without question or answer are skipped."""
    rows = read_table(spark, path, {"question": "QueryText", "answer": "KccAns"}, {"state": "StateName", "district": "DistrictName", "crop": "Crop", "query_type": "QueryType", "created_on": "CreatedOn"})
    return rows.filter((F.col("question") != "") & (F.col("answer") != ""))


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    rows = read_table(spark, path, {"subject": "Subject", "body": "Body"}, {"number": "NotificationNumber", "date": "Date", "instrument": "Instrument", "layer": "Layer", "year": "Year"})
    return rows.filter(F.col("body") != "")


def langlinks(lines: DataFrame, column: str = "value") -> DataFrame:
    """from_id, language, title, link_order of the tuples in INSERT lines of an SQL dump."""
    pattern = r"\((\d+),'((?:[^'\\]|\\.)*)','((?:[^'\\]|\\.)*)'\)"
    tuples = F.arrays_zip(*(F.regexp_extract_all(column, F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "a"), (2, "b"), (3, "c"))))
    rows = lines.filter(F.col(column).startswith("INSERT INTO")).select(F.posexplode(tuples).alias("link_order", "t"))
    plain = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    return rows.select(F.col("t.a").cast("long").alias("from_id"), plain(F.col("t.b")).alias("language"), plain(F.col("t.c")).alias("title"), "link_order")


def read_langlinks(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    rows = langlinks(spark.read.text(path))
    return rows.filter(F.col("language") == language) if language else rows


def articles(pages: DataFrame, language: str | None = None, at_least: int = 200) -> DataFrame:
    """Articles of pages (id, ns, redirect, title, wikitext): namespace 0, no redirects, long enough once
    stripped, without markup left over. Sections without prose go."""
    rows = pages.filter((F.col("ns").cast("string") == "0") & F.col("redirect").isNull()).withColumn("prose", unicode.wiki_prose(F.col("wikitext")))
    parts = F.split("prose", r"(?m)^\s*={2,6}\s*(?=\S)")
    lead = F.regexp_replace(parts[0], f"^{fixed.WS}|{fixed.WS}$", "")
    section = lambda p: F.struct(F.trim(F.regexp_extract(p, r"^(.+?)\s*={2,6}", 1)).alias("heading"), F.regexp_replace(F.regexp_replace(p, r"^.+?\s*={2,6}[ \t]*", ""), f"^{fixed.WS}|{fixed.WS}$", "").alias("text"))
    sections = F.filter(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), section), lambda s: (s["text"] != "") & ~F.lower(s["heading"]).isin(fixed.EMPTY_SECTIONS))
    rows = rows.withColumn("lead", lead).withColumn("parts", sections)
    body = F.concat_ws("\n\n", F.nullif(F.col("lead"), F.lit("")), F.array_join(F.transform("parts", lambda s: s["text"]), "\n\n"))
    rows = rows.withColumn("body", body).filter((F.length("body") >= at_least) & ~text.has_markup(F.col("body")))
    return _document(rows, language, id=F.col("id").cast("string"), text=F.col("body"), title=F.col("title"), sections=F.col("parts"), source=F.lit("wiki"))


def read_mediawiki(spark: SparkSession, path: str, language: str | None = None, at_least: int = 200) -> DataFrame:
    """Articles of a dump (bz2, gz or plain); copies are left to the deduplicator."""
    schema = "id long, ns long, title string, redirect struct<_title: string>, revision struct<text: struct<_VALUE: string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return articles(pages.select("id", "ns", F.col("redirect._title").alias("redirect"), "title", F.col("revision.text._VALUE").alias("wikitext")), language, at_least)


def formex_articles(documents: DataFrame, column: str = "value") -> DataFrame:
    """number, heading, body, place of the articles of acts in XML; an act without any is an error."""
    @F.pandas_udf("array<struct<number: string, heading: string, body: string>>")
    def parse(texts: pd.Series) -> pd.Series:
        def one(xml: str) -> list[dict]:
            found = []
            for a in ElementTree.fromstring(xml).iter("ARTICLE"):
                said = lambda e: " ".join("".join(e.itertext()).split()) if e is not None else ""
                heads = [said(a.find(t)) for t in ("TI.ART", "STI.ART")]
                body = " ".join(x for x in (said(c) for c in a if c.tag not in ("TI.ART", "STI.ART")) if x)
                found.append({"number": a.get("IDENTIFIER", ""), "heading": " - ".join(h for h in heads if h), "body": body})
            if not found:
                raise ReadError("an act without articles")
            return found

        return texts.map(one)

    rows = documents.select(F.posexplode(parse(F.col(column))).alias("place", "a"))
    return rows.select("a.number", "a.heading", "a.body", F.col("place").cast("long").alias("place"))


def releases(pages: DataFrame, column: str = "html") -> DataFrame:
    """Adds title, body, ministry, date and siblings (id -> language) of press-release pages."""
    by_id = lambda name: text.strip_tags(F.regexp_extract(column, rf"(?is)id=[\"']{name}[\"'][^>]*>(.*?)</", 1))
    ids = F.regexp_extract_all(column, F.lit(r"(?i)PRID=(\d+)[^>]*>\s*([^<]+?)\s*<"), F.lit(1))
    names = F.regexp_extract_all(column, F.lit(r"(?i)PRID=(\d+)[^>]*>\s*([^<]+?)\s*<"), F.lit(2))
    return pages.withColumn("title", by_id("Titleh2")).withColumn("ministry", by_id("MinistryName")).withColumn("date", by_id("PrDateTime")).withColumn("body", text.strip_tags(F.col(column))).withColumn("siblings", F.map_from_arrays(F.array_distinct(ids), F.slice(names, F.lit(1), F.greatest(F.size(F.array_distinct(ids)), F.lit(0)))))


def acts(documents: DataFrame, column: str = "value", at_least: int = 1) -> DataFrame:
    """id, title, enacted, sections of acts in JSON, whose sections stand at any depth."""
    @F.pandas_udf("struct<id: string, title: string, enacted: string, sections: array<struct<heading: string, text: string>>>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        def sections(node) -> Iterator[dict]:
            if isinstance(node, dict):
                for key, value in node.items():
                    if key == "Sections" and isinstance(value, dict):
                        for section in value.values():
                            parts = section.get("paragraphs", {}) if isinstance(section, dict) else {}
                            by_number = sorted(parts.items(), key=lambda x: (not x[0].isdigit(), int(x[0]) if x[0].isdigit() else 0, x[0]))
                            body = "\n".join(str(v).strip() for _, v in by_number if isinstance(v, str) and v.strip())
                            if body:
                                yield {"heading": str(section.get("heading", "")), "text": body}
                    else:
                        yield from sections(value)
            elif isinstance(node, list):
                for value in node:
                    yield from sections(value)

        rows = []
        for t in texts:
            act = json.loads(t)
            rows.append({"id": act.get("Act ID"), "title": act.get("Act Title"), "enacted": act.get("Enactment Date"), "sections": list(sections(act))})
        return pd.DataFrame(rows, columns=["id", "title", "enacted", "sections"])

    return documents.select(parse(F.col(column)).alias("a")).select("a.*").filter(F.size("sections") >= at_least)


def plain_pages(contents: bytes) -> list[str]:
    """Pages of extracted text in UTF-8, set apart by form feeds: a reader for `read_with`."""
    return contents.decode("utf-8", "replace").split("\f")


def read_with(spark: SparkSession, path: str, reader: Callable[[bytes], list[str]], at_least: int = 200) -> DataFrame:
    """Documents of binary files (PDF and the like) by an injected function from bytes to pages."""
    @F.pandas_udf("string")
    def extract(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: "\n\n".join(p.strip() for p in reader(bytes(b)) if p and p.strip()))

    rows = spark.read.format("binaryFile").load(path).withColumn("body", F.regexp_replace(F.regexp_replace(extract("content"), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))
    return _document(rows.filter(F.length("body") >= at_least), id=_stem(F.col("path")), text=F.col("body"), source=F.col("path"))


def translation_units(rows: DataFrame, dataset: str | None = None, source: str | None = None, target: str | None = None) -> DataFrame:
    """Rows of dataset, id, src_lang, src, tgt_lang, tgt with the reason why each is skipped."""
    from corpusloom.plans.ledger import judge

    rules = [("blank", (text.collapse(F.coalesce("src", F.lit(""))) == "") | (text.collapse(F.coalesce("tgt", F.lit(""))) == ""))]
    for name, column, wanted in (("other_target", "tgt_lang", target), ("other_source", "src_lang", source), ("other_dataset", "dataset", dataset)):
        if wanted is not None:
            rules.insert(0, (name, F.col(column) != wanted))
    return judge(rows, rules)


def read_similarities(spark: SparkSession, path: str) -> DataFrame:
    """word_a, word_b, score of a JSON Lines file of judged word pairs."""
    return spark.read.schema("word_a string, word_b string, score double").json(path)


def read_analogies(spark: SparkSession, path: str) -> DataFrame:
    """a, b, c, expected of a JSON Lines file of analogy questions."""
    return spark.read.schema("a string, b string, c string, expected string").json(path)


def bitext_slices(rows: DataFrame, source: str, target: str, by: list[str] | None = None, *, order: str, at_least: int = 10, at_most_rows: int | None = None) -> DataFrame:
    """Cleaned source and target of parallel rows, both long enough, the first so many of each group.

    Sides are columns, or fields of structs by a dotted name; only these and the group are read.
    """
    from pyspark.sql.window import Window

    side = lambda c: text.collapse(F.coalesce(F.col(c).cast("string"), F.lit("")))
    groups = by or []
    out = rows.select(*groups, F.col(order).alias("place"), side(source).alias("source"), side(target).alias("target")).filter((F.length("source") >= at_least) & (F.length("target") >= at_least))
    if at_most_rows is None:
        return out
    if not groups:
        return out.orderBy("place").limit(at_most_rows)
    return out.withColumn("n", F.row_number().over(Window.partitionBy(*groups).orderBy("place"))).filter(F.col("n") <= at_most_rows).drop("n")


def paginate(fetch: Callable[[int, int], dict], limit: int, at_most: int | None = None, sink: Callable[[list], None] | None = None) -> dict:
    """Records of a paginated service. Offsets advance by what was received; stops on an empty page, at
    `at_most` or when all are there. Returns records, pages, received, total, stopped and shortfall.

    With a `sink` each page goes there as it comes and none is held; `records` is then empty.
    """
    records: list = []
    pages, received, total, stopped = 0, 0, None, "empty"
    while True:
        page = fetch(received, limit)
        pages += 1
        total = page.get("total", total)
        got = page.get("records") or []
        if at_most is not None:
            got = got[: at_most - received]
        if not got:
            break
        received += len(got)
        (sink or records.extend)(got)
        if at_most is not None and received >= at_most:
            stopped = "at_most"
            break
        if total is not None and received >= total:
            stopped = "complete"
            break
    return {"records": records, "pages": pages, "received": received, "total": total, "stopped": stopped, "shortfall": max(0, (total or 0) - received)}
