"""Text functions as expressions over columns; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import fixed


def collapse(text: Column) -> Column:
    """White space made single, none at the ends."""
    return F.trim(F.regexp_replace(text, fixed.WS, " "))


def clean_whitespace(text: Column) -> Column:
    """The `whitespace` normalizer: zero-width space and byte-order mark go first; joiners stay."""
    return collapse(F.regexp_replace(text, r"[\x{200b}\x{feff}]", ""))


def fold(text: Column) -> Column:
    """Case-insensitive form, exact for scripts whose only special folding is that of sharp s."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def ascii_digits(text: Column) -> Column:
    """Decimal digits of the scripts in use, as ASCII."""
    starts = [0x660, 0x6F0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xE50, 0x1C50, 0xABF0, 0xFF10]
    return F.translate(text, "".join(chr(s + d) for s in starts for d in range(10)), "0123456789" * len(starts))


def words(text: Column) -> Column:
    """Letters and digits in a row, folded."""
    return F.regexp_extract_all(fold(text), F.lit(fixed.WORD), F.lit(0))


def text_words(text: Column) -> Column:
    """Words with their combining marks, joiners and inner apostrophes, as they stand."""
    return F.regexp_extract_all(text, F.lit(fixed.TEXT_WORD), F.lit(0))


def script_counts(text: Column) -> Column:
    """array<struct<n, script>> of the scripts whose letters or marks the text has.

    Text without a letter beyond the Latin ranges, which is nearly all of most corpora, is counted
    in one pass; only other text is looked through for every script.
    """
    letters = F.regexp_replace(text, r"[^\p{L}\p{M}]", "")
    count = lambda script: F.length(F.regexp_replace(letters, f"[^{fixed.script_class(script)}]", "")).cast("long")
    one = lambda script: F.struct(count(script).alias("n"), F.lit(script).alias("script"))
    latin = F.filter(F.array(one("Latn")), lambda x: x["n"] > 0)
    every = F.filter(F.array(*(one(s) for s in fixed.SCRIPTS)), lambda x: x["n"] > 0)
    return F.when(letters.rlike(f"[^{fixed.script_class('Latn')}]"), every).otherwise(latin)


def dominant_script(text: Column) -> Column:
    """struct<script, confidence>: the commonest script (ties to the greater code), Zzzz and 0 if none."""
    counts = script_counts(text)
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    best = F.array_max(counts)
    return F.struct(F.coalesce(best["script"], F.lit("Zzzz")).alias("script"), F.coalesce(best["n"] / F.nullif(total, F.lit(0).cast("long")), F.lit(0.0)).alias("confidence"))


def infer_language(text: Column) -> Column:
    """What the script alone tells of the language; null if mixed or shared by several."""
    told = F.create_map(*(F.lit(x) for pair in fixed.SCRIPT_TELLS.items() for x in pair))
    profile = dominant_script(text)
    return F.when(profile["confidence"] >= fixed.MIXED_BELOW, told[profile["script"]])


def language_code(code: Column) -> Column:
    """Primary subtag in lower case; null unless it is two or three letters."""
    primary = F.lower(F.split(F.replace(F.trim(code), F.lit("_"), F.lit("-")), "-")[0])
    return F.when(primary.rlike("^[a-z]{2,3}$"), primary)


def _of_language(code: Column, place: int) -> Column:
    known = F.create_map(*(F.lit(x) for c, row in fixed.LANGUAGES.items() for x in (c, row[place])))
    return F.try_element_at(known, language_code(code))


def language_name(code: Column) -> Column:
    """English name of a language; the code itself if it isn't known, null for what is no code."""
    return F.coalesce(_of_language(code, 0), language_code(code))


def expected_script(code: Column) -> Column:
    """The script that a language is usually written in; null if it isn't known."""
    return _of_language(code, 1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def units(text: Column) -> Column:
    """Distinct units that overlap is counted in: words, or pairs of characters where scripts set no blanks."""
    def pairs(joined: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(joined) - 1, F.lit(1))), lambda i: F.substring(joined, i, F.lit(2)))
        return F.when(F.length(joined) == 0, F.array().cast("array<string>")).otherwise(each)

    undelimited = text.rlike("[" + "".join(map(fixed.script_class, fixed.UNDELIMITED)) + "]") & dominant_script(text)["script"].isin(fixed.UNDELIMITED)
    return _let(words(text), lambda found: F.array_distinct(F.when(undelimited, _let(F.array_join(found, ""), pairs)).otherwise(found)))


def has_script(text: Column) -> Column:
    """Whether the text has a letter or mark of any known script; looks no further than the first."""
    return text.rlike("[" + "".join(map(fixed.script_class, fixed.SCRIPTS)) + r"&&[\p{L}\p{M}]]")


def overlap_of(anchor_units: Column, positive_units: Column) -> Column:
    """Share of the anchor's units that the positive has too; 0 for an anchor without any."""
    return F.when(F.size(anchor_units) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(anchor_units, positive_units)) / F.size(anchor_units))


def overlap(anchor: Column, positive: Column) -> Column:
    both = F.struct(units(anchor).alias("a"), units(positive).alias("p"))
    return _let(both, lambda u: overlap_of(u["a"], u["p"]))


def jaccard(a: Column, b: Column) -> Column:
    """Shared white-space tokens over all; 0 if there are none."""
    tokens = lambda t: F.array_distinct(F.filter(F.split(t, fixed.WS), lambda w: w != ""))
    return F.coalesce(F.size(F.array_intersect(tokens(a), tokens(b))) / F.nullif(F.size(F.array_union(tokens(a), tokens(b))), F.lit(0)), F.lit(0.0))


def digest(text: Column, size: int = 16) -> Column:
    """Content hash of text in NFC."""
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(size))


def hash_iterable(items: Column, size: int = 16) -> Column:
    """Digest of an array of strings (in NFC), in order; lengths set them apart, so ["ab", "c"] isn't ["a", "bc"]."""
    parts = F.transform(items, lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x))
    return digest(F.array_join(parts, ""), size)


def hash_object(fields: dict[str, Column], size: int = 16) -> Column:
    """Digest of an object as JSON with sorted keys, nulls included."""
    return digest(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), size)


def title_key(title: Column) -> Column:
    """Join key of a page title."""
    return fold(collapse(F.replace(title, F.lit("_"), F.lit(" "))))


def strip_tags(html: Column) -> Column:
    """Text of markup: scripts and styles go, tags become blanks, four entities are decoded."""
    text = F.regexp_replace(html, r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(character))
    return collapse(text)


def has_markup(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in fixed.MARKUP))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n[ \t]*\n[ \t\n]*"), lambda p: F.regexp_replace(p, f"^{fixed.WS}|{fixed.WS}$", "")), lambda p: p != "")


def band(value: Column) -> Column:
    """Name of the overlap band."""
    out = F.when(F.lit(False), F.lit(""))
    for name, low, high in fixed.BANDS:
        out = out.when((value >= low) & (value < high), F.lit(name))
    return out


def pre_tokens(text: Column, kind: str) -> Column:
    """Pre-tokenizers that a pattern can express: whitespace, char, punctuation."""
    pattern = {"whitespace": f"[^{fixed.WS[1:-2]}]+", "char": f"[^{fixed.WS[1:-2]}]", "punctuation": rf"[\p{{P}}\p{{S}}]|[^{fixed.WS[1:-2]}\p{{P}}\p{{S}}]+"}[kind]
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def pairwise(items: Column) -> Column:
    """array<struct<a, b>> of neighbours, without a shuffle."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
