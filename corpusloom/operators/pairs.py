"""Mining of anchor/positive pairs. Every miner returns its candidates with a reject reason, so that
the accepted pairs and the ledger come from one plan.

Columns of candidates: doc_id, kind, kind_rank, position, anchor, positive, language,
positive_language, overlap and reject_reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import fixed, text
from corpusloom.plans.ledger import REASON, Rules, judge, ledger, reject_repeats

ORDER = ["doc_id", "kind_rank", "position"]


def candidates(documents: DataFrame) -> DataFrame:
    """Structural candidates of documents with id, title, paragraphs and sections, in their order:
    title and first paragraph, heading and section, neighbouring paragraphs."""
    row = lambda rank, kind, position, anchor, positive: F.struct(F.lit(rank).alias("kind_rank"), F.lit(kind).alias("kind"), position.cast("long").alias("position"), anchor.alias("anchor"), positive.alias("positive"))
    lead = F.filter(F.array(row(0, "title_lead", F.lit(0), F.col("title"), F.get("paragraphs", F.lit(0)))), lambda x: x["anchor"].isNotNull() & x["positive"].isNotNull() & (text.collapse(x["anchor"]) != ""))
    sections = F.transform("sections", lambda s, i: row(1, "heading_section", i, s["heading"], s["text"]))
    sections = F.filter(sections, lambda x: (text.collapse(x["anchor"]) != "") & (text.collapse(x["positive"]) != ""))
    adjacent = F.transform(text.pairwise(F.col("paragraphs")), lambda p, i: row(2, "adjacent", i, p["a"], p["b"]))
    every = F.concat(lead, F.coalesce(sections, F.array().cast(lead_type())), adjacent)
    return documents.select("doc_id", "language", F.inline(every))


def lead_type() -> str:
    return "array<struct<kind_rank: int, kind: string, position: bigint, anchor: string, positive: string>>"


def structural_pairs(documents: DataFrame, *, anchor_at_least: int = 8, positive_at_least: int = 100, positive_at_most: int = 2000, overlap_at_most: float = 1.0) -> DataFrame:
    """Too short an anchor, too short a positive, too much overlap, repeated; long positives are cut."""
    rows = candidates(documents).withColumn("anchor", text.collapse(F.col("anchor"))).withColumn("positive", text.collapse(F.col("positive")))
    short = [("short_anchor", F.length("anchor") < anchor_at_least), ("short_positive", F.length("positive") < positive_at_least)]
    rows = judge(rows, short).withColumn("positive", F.left("positive", F.lit(positive_at_most)))
    return _finish(rows, overlap_at_most, overlap_first=True)


def _finish(rows: DataFrame, overlap_at_most: float, overlap_first: bool, reversed_overlap: bool = False, key: Column | None = None, drop_repeats: bool = True) -> DataFrame:
    """Overlap of the rows that are open, the overlap rule and the repeat rule in the miner's order.

    Where overlap comes first it still needs no computing before repeats are known: rows with one key
    have one overlap, so repeats of a pair that overlaps too much are just renamed.
    """
    sides = (F.col("positive"), F.col("anchor")) if reversed_overlap else (F.col("anchor"), F.col("positive"))
    key = F.concat_ws("\0", "anchor", "positive") if key is None else key
    rows = reject_repeats(rows, key, [F.col(c) for c in ORDER]) if drop_repeats else rows
    needed = F.col(REASON).isNull() | (F.col(REASON) == "duplicate") if overlap_first and overlap_at_most < 1 else F.col(REASON).isNull()
    rows = rows.withColumn("overlap", F.when(needed, text.overlap(*sides)))
    too_much = F.col("overlap") > overlap_at_most
    return rows.withColumn(REASON, F.when(needed & too_much, F.lit("overlap")).otherwise(F.col(REASON)))


#: Settings with every filter relaxed: what a filter takes is what differs from these.
NAIVE_QUESTIONS = {"question_at_least": 1, "answer_at_least": 1, "boilerplate_from": 0, "overlap_at_most": 1.0, "drop_junk": False, "drop_repeats": False}
NAIVE_NOTICES = {"subject_at_least": 0, "body_at_least": 0, "overlap_at_most": 1.0, "drop": [], "drop_repeats": False}


def question_answers(rows: DataFrame, *, question_at_least: int = 8, answer_at_least: int = 20, boilerplate_from: int = 50, overlap_at_most: float = 0.7, drop_junk: bool = True, drop_repeats: bool = True) -> DataFrame:
    """Candidates of doc_id, position, question, answer: junk, too short, boilerplate (from 1 on), repeated, overlap.

    An answer is boilerplate if it stands that often among all rows, whatever became of them. The
    first of repeated pairs counts as seen even if its overlap is then too great.
    """
    rows = rows.withColumn("anchor", text.collapse(F.col("question"))).withColumn("positive", text.collapse(F.col("answer"))).drop("question", "answer")
    often = rows.groupBy(F.sha2(text.fold(F.col("positive")).cast("binary"), 256).alias("digest")).agg(F.count("*").alias("times")).filter((F.col("times") >= boilerplate_from) & F.lit(boilerplate_from > 0))
    rows = rows.withColumn("digest", F.sha2(text.fold(F.col("positive")).cast("binary"), 256)).join(often, "digest", "left").drop("digest")
    rows = rows.withColumn("kind", F.lit("question_answer")).withColumn("kind_rank", F.lit(0))
    junk = text.fold(F.col("anchor")).isin(fixed.JUNK_QUESTIONS) | F.col("anchor").rlike(r"^[^\p{L}]+$")
    rows = judge(
        rows,
        [("junk_query", junk & F.lit(drop_junk)), ("short_query", F.length("anchor") < question_at_least), ("short_answer", F.length("positive") < answer_at_least), ("boilerplate_answer", F.col("times").isNotNull())],
    ).drop("times")
    return _finish(rows, overlap_at_most, overlap_first=False, key=F.concat_ws("\0", text.fold(F.col("anchor")), text.fold(F.col("positive"))), drop_repeats=drop_repeats)


def notices(rows: DataFrame, *, subject_at_least: int = 12, body_at_least: int = 40, overlap_at_most: float = 0.7, drop: list[str] | None = None, drop_repeats: bool = True) -> DataFrame:
    """Candidates of doc_id, subject, body: withdrawn, superseded, annexure alone, short, repeated, redundant.

    `drop` names those of the first four rules that apply (all by default).

    Redundancy is the share of the body's words in the subject: a subject drawn from its body is no
    fault, a body that says no more than the subject is.
    """
    rows = rows.withColumn("anchor", text.collapse(F.col("subject"))).withColumn("positive", text.collapse(F.col("body"))).drop("subject", "body")
    rows = rows.withColumn("kind", F.lit("trade_notification")).withColumn("kind_rank", F.lit(0)).withColumn("position", F.lit(0).cast("long"))
    both = F.concat_ws(" ", "anchor", "positive")
    optional = ("withdrawn", "superseded", "annexure_only", "empty_subject")
    rules = [
        ("withdrawn", both.rlike(fixed.WITHDRAWN)),
        ("superseded", both.rlike(fixed.SUPERSEDED)),
        ("annexure_only", F.col("positive").rlike(fixed.ANNEXURE)),
        ("empty_subject", F.col("anchor") == ""),
        ("short_subject", F.length("anchor") < subject_at_least),
        ("short_body", F.length("positive") < body_at_least),
    ]
    rows = judge(rows, [r for r in rules if drop is None or r[0] in drop or r[0] not in optional])
    return _finish(rows, overlap_at_most, overlap_first=False, reversed_overlap=True, key=F.concat_ws("\0", text.fold(F.col("anchor")), text.fold(F.col("positive"))), drop_repeats=drop_repeats)


def bitext(rows: DataFrame, *, at_least: int = 10, at_most: int = 2000) -> DataFrame:
    """Candidates of line-aligned anchor and positive: short, long (not cut), identical, repeated."""
    rows = rows.withColumn("anchor", text.collapse(F.col("anchor"))).withColumn("positive", text.collapse(F.col("positive")))
    rows = rows.withColumn("kind", F.lit("bitext")).withColumn("kind_rank", F.lit(0))
    rows = judge(
        rows,
        [
            ("short_anchor", F.length("anchor") < at_least),
            ("short_positive", F.length("positive") < at_least),
            ("long_positive", F.length("positive") > at_most),
            ("identical", F.col("anchor") == F.col("positive")),
        ],
    )
    return _finish(rows, 1.0, overlap_first=False)


def aligned_pairs(documents: DataFrame, *, anchor_at_least: int = 3, positive_at_least: int = 100, positive_at_most: int = 2000) -> DataFrame:
    """Both directions and both kinds (title to lead, lead to lead) of aligned documents.

    `documents`: doc_id, source_title, source_lead, source_language and the same for target. The
    pair's language is that of its positive, its anchor_language the other.
    """
    row = lambda rank, kind, position, anchor, positive, a, p: F.struct(F.lit(rank).alias("kind_rank"), F.lit(kind).alias("kind"), F.lit(position).cast("long").alias("position"), F.col(anchor).alias("anchor"), F.col(positive).alias("positive"), F.col(a).alias("anchor_language"), F.col(p).alias("language"), F.col(p).alias("positive_language"))
    sides = [("source", "target"), ("target", "source")]
    every = [row(i, kind, d, f"{a}_{side}", f"{b}_lead", f"{a}_language", f"{b}_language") for d, (a, b) in enumerate(sides) for i, (kind, side) in enumerate((("aligned_title", "title"), ("aligned_lead", "lead")))]
    rows = documents.select("doc_id", F.inline(F.array(*every)))
    rows = rows.withColumn("anchor", text.collapse(F.col("anchor"))).withColumn("positive", text.collapse(F.col("positive")))
    rows = judge(rows, [("short_anchor", F.length("anchor") < anchor_at_least), ("short_positive", F.length("positive") < positive_at_least)])
    return _finish(rows.withColumn("positive", F.left("positive", F.lit(positive_at_most))), 1.0, overlap_first=False)


def provisions(rows: DataFrame, *, heading_at_least: int = 6, body_at_least: int = 60) -> DataFrame:
    """Aligned provisions (doc_id, position and heading, body of left and right): repealed, short, repeated."""
    body = lambda side: text.collapse(F.col(f"{side}_body"))
    rules: Rules = []
    for side in ("left", "right"):
        rules += [
            (f"{side}_repealed", body(side).rlike(fixed.REPEALED)),
            (f"{side}_short_heading", F.length(text.collapse(F.col(f"{side}_heading"))) < heading_at_least),
            (f"{side}_short_body", F.length(body(side)) < body_at_least),
        ]
    return reject_repeats(judge(rows, rules), F.concat_ws("\0", body("left"), body("right")), [F.col("doc_id"), F.col("position")])


def both_directions(rows: DataFrame) -> DataFrame:
    """Two pairs of each aligned row (left and right text with their languages)."""
    way = lambda n, a, p: F.struct(F.lit(n).alias("direction"), F.col(f"{a}_body").alias("anchor"), F.col(f"{p}_body").alias("positive"), F.col(f"{a}_language").alias("language"), F.col(f"{p}_language").alias("positive_language"))
    return rows.select("doc_id", "position", F.inline(F.array(way(0, "left", "right"), way(1, "right", "left"))))


def release_pairs(releases: DataFrame, *, title_at_least: int = 10, body_at_least: int = 40, body_at_most: int = 2000, overlap_at_most: float = 1.0) -> DataFrame:
    """Ordered pairs of languages within each release group: title to body and title to title.

    `releases`: group_id, language, title, body. The overlap is rounded before its rule applies.
    """
    a = releases.select("group_id", F.col("language").alias("language"), text.collapse(F.col("title")).alias("title"))
    b = releases.select(F.col("group_id").alias("g"), F.col("language").alias("positive_language"), text.collapse(F.col("title")).alias("other"), text.collapse(F.col("body")).alias("body"))
    both = a.join(b, (F.col("group_id") == F.col("g")) & (F.col("language") != F.col("positive_language")))
    kinds = F.array(F.struct(F.lit("title_body").alias("kind"), F.col("body").alias("positive")), F.struct(F.lit("title_title").alias("kind"), F.col("other").alias("positive")))
    rows = both.select("group_id", "language", "positive_language", F.col("title").alias("anchor"), F.inline(kinds))
    rows = judge(
        rows,
        [
            ("short_anchor", F.length("anchor") < title_at_least),
            ("short_positive", F.length("positive") < F.when(F.col("kind") == "title_body", F.lit(body_at_least)).otherwise(F.lit(title_at_least))),
            ("long_positive", (F.col("kind") == "title_body") & (F.length("positive") > body_at_most)),
        ],
    )
    share = lambda x, y: F.when(F.size(x) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))
    own = F.array_distinct(text.words(F.col("anchor")))
    rows = rows.withColumn("overlap", F.when(F.col(REASON).isNull(), F.round(share(own, F.array_distinct(text.words(F.col("positive")))), 4)))
    return judge(rows, [("overlap", F.col("overlap") > overlap_at_most)])


def pair_statistics(pairs: DataFrame) -> DataFrame:
    """kind, n, mean_overlap and whether the kind leaks, of accepted pairs."""
    out = pairs.groupBy("kind").agg(F.count("*").alias("n"), F.avg("overlap").alias("mean_overlap"))
    return out.withColumn("leaky", F.col("mean_overlap") > 0.75)


def pair_ledger(rows: DataFrame) -> DataFrame:
    return ledger(rows, "kind")


def prefixed(pairs: DataFrame, query: str, passage: str) -> DataFrame:
    """Pairs with the markers of an asymmetric encoder; negatives are passages. All columns stay."""
    out = pairs.withColumn("anchor", F.concat(F.lit(query), "anchor")).withColumn("positive", F.concat(F.lit(passage), "positive"))
    return out.withColumn("negatives", F.transform("negatives", lambda n: F.concat(F.lit(passage), n))) if "negatives" in pairs.columns else out


def prefix_regime(kind: Column, side: int) -> Column:
    """The prefix that pairs of a kind are trained with: side 0 of the query, 1 of the passage."""
    out = F.lit("")
    for name, prefixes in fixed.PREFIXES.items():
        out = F.when(kind == name, F.lit(prefixes[side])).otherwise(out)
    return out


def check_prefixes(pairs: DataFrame, query: str, passage: str) -> DataFrame:
    """Kinds whose regime isn't the configured one: kind, n, query, passage."""
    kinds = pairs.groupBy("kind").agg(F.count("*").alias("n"))
    kinds = kinds.select("kind", "n", prefix_regime(F.col("kind"), 0).alias("query"), prefix_regime(F.col("kind"), 1).alias("passage"))
    return kinds.filter((F.col("query") != query) | (F.col("passage") != passage))
