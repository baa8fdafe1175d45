"""Document fingerprints by winnowing, in DataFrame functions alone.

Each code point has a hash of 64 bits, and a run of K of them the polynomial over these with exclusive-or
for the sum and a shift for the power. It is rolled by doubling: the hash of 2 m code points comes from
those of the m first and the m next, so that a code point is hashed once, whatever K. Of every W runs in a
row the smallest hash is selected, the rightmost of equal ones, and keeps its position. Texts that share
SPAN = K + W - 1 code points share a selected hash, in any script and wherever the words begin; a text of
fewer has one window.

A hash and its position are one long, 32 bits of the hash above and the position counted down below, so
that the smallest long is the smallest hash with the rightmost position, and a window's minimum takes
log2(W) element-wise minima of shifted arrays.

What a window selects depends on the window alone, and positions never go back from one window to the
next. The fingerprint of an edited text is therefore put together from those of its two sources and from
the windows across the edit, which alone are hashed again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Code points of a run, and runs of a window (powers of two).
K, W = 8, 32
SPAN = K + W - 1
#: Characters of one range of documents; ranges are the unit of the one shuffle. Beyond MAX_RANGES they get
#: larger: a task sorts more, on disk if need be, and holds one row and the next.
RANGE_CHARS = 8_000_000
MAX_RANGES = 100_000

_POSITION_BITS = 31
_LAST_POSITION = (1 << _POSITION_BITS) - 1
_HASH_BITS = (1 << 63) - (1 << _POSITION_BITS)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _shifted(v: Column, step: int) -> Column:
    return F.slice(v, F.lit(step + 1), F.greatest(F.size(v), F.lit(1)))


def selected(text: Column) -> Column:
    """array<long>: the selected hashes with their positions, in their order; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    points = F.transform(F.split(text, ""), lambda c: F.xxhash64(c))
    points = F.when(F.length(text) >= K, points).otherwise(F.concat(points, F.array_repeat(F.lit(0).cast("long"), F.lit(K) - F.length(text))))

    def runs(v: Column, m: int = 1) -> Column:
        if 2 * m == K:
            both = lambda a, i: F.shiftleft(a, m).bitwiseXOR(F.get(v, i + m))
            return F.transform(v, lambda a, i: both(a, i).bitwiseAND(F.lit(_HASH_BITS)).bitwiseOR((F.lit(_LAST_POSITION) - i).cast("long")))
        return _let(F.zip_with(v, _shifted(v, m), lambda a, b: F.shiftleft(a, m).bitwiseXOR(b)), lambda h: runs(h, 2 * m))

    def minima(v: Column, step: int = 1) -> Column:
        if step == W:
            return v
        return _let(F.zip_with(v, _shifted(v, step), lambda a, b: F.least(a, b)), lambda m: minima(m, 2 * step))

    def windows(v: Column) -> Column:
        # the last K - 1 elements are null, for runs that the text hasn't, and are no minimum
        return F.array_distinct(F.slice(minima(v), F.lit(1), F.greatest(F.size(v) - (SPAN - 1), F.lit(1))))

    return F.when(text == "", F.array().cast("array<long>")).otherwise(_let(points, lambda v: _let(runs(v), windows)))


def _down(x: Column) -> Column:
    """The position, counted down."""
    return x.bitwiseAND(F.lit(_LAST_POSITION))


def selected_edited(chosen: Column, kept: Column, next_chosen: Column, taken: Column, edited: Column) -> Column:
    """`selected` of an edited text: `kept` code points of a text with `chosen`, then `taken` first ones of one with `next_chosen`.

    From the last window within what is kept to the first within what is taken, windows are looked at anew.
    Before and after, those entries of the two are taken over that stand before and after their choices; the
    last window of what is taken says where the second one's entries end.
    """
    def put(kept: Column, taken: Column, start: Column) -> Column:
        inside = taken >= SPAN
        across = selected(F.substring(edited, start + 1, F.when(inside, kept + SPAN - start).otherwise(F.length(edited))))
        end = selected(F.when(inside, F.substring(edited, kept + taken - SPAN + 1, F.lit(SPAN))).otherwise(F.lit("")))
        none = F.array().cast("array<long>")

        def joined(mid: Column, end: Column) -> Column:
            first, last = _down(mid[0]), _down(F.element_at(mid, -1)) + kept
            least = _down(end[0]) - (taken - SPAN)
            before = F.when(start > 0, _let(first, lambda f: F.filter(chosen, lambda x: _down(x) > f))).otherwise(none)
            after = F.when(inside, _let(F.struct(last.alias("l"), least.alias("e")), lambda b: F.transform(F.filter(next_chosen, lambda x: (_down(x) < b["l"]) & (_down(x) >= b["e"])), lambda x: x - kept))).otherwise(none)
            return F.concat(before, mid, after)

        return _let(across, lambda raw: _let(F.transform(raw, lambda x: x - start), lambda mid: _let(end, lambda e: F.when(F.size(mid) == 0, mid).otherwise(joined(mid, e)))))

    # lengths are counted once and not for each element
    return _let(F.struct(kept.cast("int").alias("k"), taken.cast("int").alias("t")), lambda n: put(n["k"], n["t"], F.greatest(n["k"] - SPAN, F.lit(0))))


def hashes(chosen: Column) -> Column:
    """The selected hashes without positions, each once."""
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, _POSITION_BITS)))


def as_string(chosen: Column) -> Column:
    """hash:position of all that is selected; empty for a text without words."""
    one = lambda x: F.concat(F.lower(F.hex(F.shiftright(x, _POSITION_BITS))), F.lit(":"), (F.lit(_LAST_POSITION) - x.bitwiseAND(F.lit(_LAST_POSITION))).cast("string"))
    return F.array_join(F.transform(chosen, one), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of selected hashes, 0 to 1; of two without any, 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def _range_of(key: Column, firsts: list) -> Column:
    """The place of the last of the sorted `firsts` that isn't above the key, found in two steps."""
    width = max(1, math.isqrt(len(firsts)))
    groups = [firsts[i : i + width] for i in range(0, len(firsts), width)]
    numbers = lambda text: F.split(text, ",").cast("array<decimal(38,0)>")
    below = lambda array: F.size(F.filter(array, lambda b: b <= key))
    group = F.greatest(below(numbers(F.lit(",".join(str(g[0]) for g in groups)))) - 1, F.lit(0))
    within = numbers(F.split(F.lit(";".join(",".join(map(str, g)) for g in groups)), ";")[group])
    return F.greatest(group * width + below(within) - 1, F.lit(0)).cast("int")


def _order_key() -> Column:
    """A number that orders rows by doc_id, null last, then a hash of the text."""
    digits = lambda x: x.cast("decimal(38,0)")
    of_id = F.coalesce(digits(F.col("doc_id")) + digits(F.lit(str(1 << 63))), digits(F.lit(str(1 << 64))))
    return (digits(of_id * F.lit(1 << 48).cast("decimal(15,0)")) + digits(F.xxhash64("text").bitwiseAND(F.lit((1 << 48) - 1)))).cast("decimal(38,0)")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, chosen and those of the next document (next_text, next_chosen) of every document.

    The order is by doc_id (null last; ties by a hash of the text), and the first follows the last.
    Texts move once, to ranges of that order, whatever ids are null or repeated; the first document of
    each range also goes to the range before, where it follows the last. Rows alike in id and text share
    a range, which a task sorts, on disk if need be, and goes through row by row. The ranges' first
    places, at most MAX_RANGES, go to the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("key", _order_key())
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = min(MAX_RANGES, max(1, chars // RANGE_CHARS))
    firsts = sorted(r["first"] for r in docs.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("first")).collect())
    last = max(0, len(firsts) - 1)
    own = _range_of(F.col("key"), firsts or [0])
    is_first = F.split(F.lit(",".join(map(str, firsts))), ",")[F.col("own")] == F.col("key").cast("string")
    before = F.when(is_first, F.when(F.col("own") == 0, F.lit(last)).otherwise(F.col("own") - 1))
    docs = docs.withColumn("own", own).withColumn("copies", F.array_compact(F.array(F.struct("own", F.lit(False).alias("copy")), F.when(is_first, F.struct(before.alias("own"), F.lit(True).alias("copy"))))))
    docs = docs.select("doc_id", "key", "text", F.inline("copies").alias("range", "copy"))
    placed = docs.repartition("range").withColumn("chosen", selected(F.col("text")))
    order = Window.partitionBy("range").orderBy("copy", "key")
    followed = placed.withColumn("next", F.lead(F.struct("text", "chosen")).over(order)).filter(~F.col("copy"))
    return followed.select("doc_id", "text", "chosen", F.col("next.text").alias("next_text"), F.col("next.chosen").alias("next_chosen"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document's with its last floor(n_chars / 2) code points replaced by as
    many of the next document's first (all, if it has fewer). Null and empty texts have the empty
    fingerprint, like to another empty one by 1 and to any other by 0. Null ids stay and come last;
    repeated rows give a row each, one following the other; a single document follows itself; an
    empty table gives no rows; other columns are ignored.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    both = with_next(docs).withColumn("edited", edited)
    both = both.withColumn("edited_chosen", selected_edited(F.col("chosen"), F.length("text") - half, F.col("next_chosen"), F.least(half, F.length("next_text")), F.col("edited"))).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    own = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited_sha256", "chosen", "edited_chosen", hashes(F.col("chosen")).alias("h"), hashes(F.col("edited_chosen")).alias("e"), hashes(F.col("next_chosen")).alias("x"))
    return own.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("chosen")).alias("fingerprint"),
        as_string(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("e")).alias("near_edited"),
        likeness(F.col("h"), F.col("x")).alias("near_next"),
    )
