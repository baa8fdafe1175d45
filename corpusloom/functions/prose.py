"""Whether a passage reads as prose and stands on its own; cleaning and trimming for display. All JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ligatures that survive extraction from PDF.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
# Phrases of front matter that is not reasoning.
FRONT_MATTER = [
    "appellate jurisdiction", "original jurisdiction", "from the judgment and order", "advs.", "adv.", "sr. adv",
    "for the appellant", "for the respondent", "for the appearing parties", "for the petitioner", "counsel for",
]
# First words, and pronouns among the first four, that need the sentence before.
LEADING = "he she it they them this that these those but and however also then there his her their such so meanwhile instead yet still thus hence".split()
PRONOUNS = "he she it they them his her their this these".split()


def clean(text: Column, running_header: str | None = None) -> Column:
    """Ligatures as letters, words rejoined where one was split by a blank, a running header (a pattern)
    and stray marks at the beginning gone, white space single."""
    for ligature, letters in LIGATURES.items():
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    text = F.regexp_replace(text, r"(?<=[A-Za-z])(ffi|ffl|fi|fl) (?=[a-z])", "$1")
    if running_header:
        text = F.regexp_replace(text, running_header, " ")
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"^[\s.,;:]+", "")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def is_prose(text: Column, *, digits_at_most: float = 0.12, lower_at_least: float = 0.64) -> Column:
    """No leader dots, marks or lists of numbers, mostly lower case, with sentence ends, no front matter.

    False for null and empty texts and for those without letters.
    """
    letters = _count(text, r"\p{L}")
    sentences = (F.length(text) - F.length(F.replace(text, F.lit(". "), F.lit("")))) / 2
    lower = F.lower(text)
    furniture = F.exists(F.array(*(F.lit(x) for x in FRONT_MATTER)), lambda x: F.contains(lower, x))
    good = ~text.rlike(r"\.{4,}") & (_count(text, r"\*") <= 1) & (_count(text, r"\p{Nd}") <= digits_at_most * F.length(text)) & (letters > 0)
    good = good & (_count(text, r"\p{Ll}") >= lower_at_least * letters) & ((sentences >= 2) | F.rtrim(text).endswith(".")) & ~furniture
    return F.coalesce(good, F.lit(False))


def stands_alone(text: Column, *, at_least: int = 70, at_most: int = 190) -> Column:
    """A declarative sentence that needs none before it: its length, a capital, a period, no leading
    word or early pronoun that points back."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    first = F.lower(F.regexp_extract(words[0], r"^[\p{L}\p{N}_]*", 0))
    early = F.exists(F.slice(words, 1, 4), lambda w: F.lower(w).rlike(rf"(?<![\p{{L}}\p{{N}}_])({'|'.join(PRONOUNS)})(?![\p{{L}}\p{{N}}_])"))
    fits = F.length(text).between(at_least, at_most) & text.rlike(r"^\p{Lu}") & F.rtrim(text).endswith(".")
    return F.coalesce(fits & ~first.isin(LEADING) & (~early | first.isin("the", "a", "an")), F.lit(False))


def preview(text: Column, limit: int = 600, reach: int = 200, beyond: int = 120) -> Column:
    """The text up to a sentence end near the limit, else cut there with an ellipsis."""
    window = F.left(text, F.lit(limit + beyond))
    upto = F.regexp_extract(window, r"(?s)^(.*[.?!]) ", 1)
    near = (F.length(upto) > 0) & (F.length(upto) - 1 >= limit - reach)
    return F.when(F.length(text) <= limit, text).when(near, F.trim(upto)).otherwise(F.concat(F.rtrim(F.left(text, F.lit(limit))), F.lit("…")))
