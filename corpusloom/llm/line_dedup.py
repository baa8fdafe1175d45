"""Deletion of repeated passages by winnowing over line hashes.

A passage may begin anywhere in a line and be wrapped otherwise in its copy, so lines as written
don't show it. A text is read as lines of a fixed number of words, one beginning with each word, and
each of these lines has a hash, rolled on from word to word. Of every window of WINDOW lines the one
with the smallest hash is selected, the rightmost of equal ones: a run of MIN_WORDS words holds such
a window, so two texts that share the run select the same line in it, at the same place of the run.

Positions are joined on the selected hash: each place is held against the first one, by document and
position, that has it, which is one row a place, however many copies there are. Such a match is
extended both ways, word by word, over the windows that select the line; a match that grows to
MIN_WORDS words or more is a repeated run. Every window selects one line, so that the runs of
successive lines together cover the whole of what is repeated.

A window that differs from the one around the first place may still be repeated: its first place is
then another one. Such windows go on by their own hashes, each held against its first place. They are
dealt by the line and the words up to the first that differs, which equal windows have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.runtime import bound_arrow_batches, durable

#: Words of the shortest run that is deleted.
MIN_WORDS = 50

_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be divided by
#: More than the words of a line and its windows.
REACH = 1 << 15
#: Bytes that are hashed together.
_CHUNK = 1 << 19
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[*range(0x09, 0x0E), 0x20]] = True


def window_of(min_words: int) -> int:
    """Lines of a window; a line has min_words + 1 less so many words."""
    return max(1, min_words // 2)


class _Powers:
    """Powers of a base modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.known = np.uint64(base), np.ones(1, dtype=np.uint64)

    def first(self, n: int) -> np.ndarray:
        if n > len(self.known):
            out = np.full(max(n, 2 * _CHUNK), self.base, dtype=np.uint64)
            out[0] = 1
            self.known = np.multiply.accumulate(out)
        return self.known[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(pow(_BASE, -1, 1 << 64))


def _rolled(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of values (begin, end), from sums of values times powers."""
    n = len(values)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _UP.first(n))])
    h = (total[end] - total[begin]) * _DOWN.first(n + 1)[begin]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text (bytes) begin and end; white space is that of ASCII."""
    space = np.ones(len(data) + 2, dtype=bool)
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and where each text's words end."""
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    begin, end = word_bounds(data)
    out, low = [], 0
    while low < len(begin):
        high = max(low + 1, int(np.searchsorted(end, begin[low] + _CHUNK)))
        first = begin[low]
        out.append(_rolled(data[first : end[high - 1]].astype(np.uint64) + np.uint64(1), begin[low:high] - first, end[low:high] - first))
        low = high
    ends = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), ends


def selected(words: np.ndarray, ends: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (of first words, in all texts) and hashes, signed, of the selected lines.

    words, ends: hashes of the words of all texts and where each text ends; a window lies within a text.
    """
    return _selected(words, ends, min_words)[:2]


def _selected(words: np.ndarray, ends: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """`selected`, and how many words the windows that select a line reach before and after it."""
    n = len(words) - min_words + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    window = window_of(min_words)
    begin = np.arange(len(words) - min_words + window)
    h = _rolled(words, begin, begin + (min_words - window + 1))
    # the upper half of a hash and its place, counted down: the smallest is the rightmost of equal ones
    least = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - begin.astype(np.uint64))
    size = 1
    while size < window:
        step = min(size, window - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    text = np.searchsorted(ends, begin[:n], side="right")
    within = begin[:n] + min_words <= ends[text]
    at = (np.uint64(0xFFFFFFFF) - (least[within] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    starts = np.flatnonzero(within)
    fresh = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    at, last = at[fresh], starts[np.append(fresh[1:], len(starts)) - 1]
    return at, h[at].view(np.int64), at - starts[fresh], last - at + window - 1


def _groups(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in groups of about _CHUNK bytes, with the place of the first."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= _CHUNK:
            yield first, texts[first : i + 1]
            first, held = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def fingerprints(keyed: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """key, doc_id, at, fp, reach (arrays) of every text that has any. keyed: key, doc_id, text.

    reach: the words before a line that its windows hold, times REACH, and those after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _groups(pc.cast(batch.column(2), pa.binary()).to_pylist()):
                words, ends = word_hashes(texts)
                at, fp, before, after = _selected(words, ends, min_words)
                if len(at):
                    cuts = np.searchsorted(at, np.concatenate([[0], ends]))
                    some = np.flatnonzero(np.diff(cuts))
                    own = at - np.concatenate([[0], ends])[np.searchsorted(ends, at, side="right")]
                    offsets = pa.array(np.concatenate([[0], cuts[1:][some]]), pa.int32())
                    places = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (own.astype(np.int32), fp, (before * REACH + after).astype(np.int32))]
                    rows = pa.array(first + some)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *places], ["key", "doc_id", "at", "fp", "reach"])

    return keyed.mapInArrow(run, "key long, doc_id long, at array<int>, fp array<long>, reach array<int>")


def _contexts(keyed: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """fp, key, doc_id, at, before, after: the words on both sides of the places asked for, nearest first.

    keyed: key, text, and all other columns, so that the texts are dealt by key once for every use;
    wanted: key, doc_id, at, fp, reach. Rows with one key are alike and come together, so that the
    first of them answers for all.
    """
    length = min_words - window_of(min_words) + 1
    place = keyed.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fresh = np.flatnonzero(keys != np.concatenate([[keys[0] if last is None else last], keys[:-1]])) if len(keys) else keys
            if last is None and len(keys):
                fresh = np.union1d([0], fresh)
            last = keys[-1] if len(keys) else last
            for first, texts in _groups(pc.cast(batch.column(place).take(pa.array(fresh)), pa.binary()).to_pylist()):
                words, ends = word_hashes(texts)
                words = words.astype(np.uint32).view(np.int32)
                rows = fresh[first : first + len(texts)]
                lists = batch.column(batch.num_columns - 1).take(pa.array(rows))
                counts, asked = np.diff(lists.offsets.to_numpy()), lists.flatten()
                at, fp, reach = asked.field("at").to_numpy(), asked.field("fp"), asked.field("reach").to_numpy()
                low, high = np.repeat(np.concatenate([[0], ends[:-1]]), counts), np.repeat(ends, counts)
                place_ = low + at
                sides = []
                for step, begin, room in ((-1, place_ - 1, np.minimum(place_ - low, reach // REACH)), (1, place_ + length, np.minimum(high - place_ - length, reach % REACH))):
                    offsets = np.concatenate([[0], np.cumsum(room)])
                    within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], room)
                    sides.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(words[np.repeat(begin, room) + step * within])))
                ids = batch.column(batch.num_columns - 2).take(pa.array(np.repeat(rows, counts)))
                yield pa.RecordBatch.from_arrays([fp, pa.array(np.repeat(keys[rows], counts)), ids, pa.array(at), *sides], ["fp", "key", "doc_id", "at", "before", "after"])

    asked = wanted.groupBy(F.col("key").alias("k")).agg(F.max("doc_id").alias("asked_id"), F.collect_set(F.struct("at", "fp", "reach")).alias("asked"))
    both = keyed.hint("merge").join(asked, F.col("key") == F.col("k")).drop("k")
    return both.mapInArrow(run, "fp long, key long, doc_id long, at int, before array<int>, after array<int>")


def _common(a: str, b: str) -> Column:
    """How many words two arrays have in common from their beginnings on."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")


def _side(until: Column, low: Column, high: Column, reach: int, *known: Column | str) -> Column:
    """What windows with low to high words before the line have to go on by: none if there is none of them."""
    hashes = F.transform(F.sequence(high, low), lambda d: F.xxhash64(d, F.slice("before", F.lit(1), d), F.slice("after", F.lit(1), F.lit(reach) - d)))
    some = F.struct(F.xxhash64("fp", until, *known).alias("deal"), high.alias("most"), hashes.alias("windows"))
    return F.when(low <= high, some)


def repeated_spans(keyed: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """key, begin, end: words of runs that stand at an earlier place too. keyed: key, doc_id, text, and others.

    Places are ordered by doc_id (null last), then position. Of a run that overlaps its own first
    place, as in words that are repeated on and on, the first min_words words stay.
    """
    length, reach = min_words - window_of(min_words) + 1, window_of(min_words) - 1
    if reach >= REACH:
        raise ValueError(f"runs of {min_words} words are too long")
    found = durable(fingerprints(keyed.select("key", "doc_id", "text"), min_words=min_words))
    found = found.select("key", "doc_id", F.inline(F.arrays_zip("at", "fp", "reach")))
    often = durable(found.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("fp").alias("f")))
    places = durable(found.join(often, F.col("fp") == F.col("f"), "left_semi"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "at", "reach")
    first = durable(places.groupBy("fp").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select(F.col("fp").alias("f"), F.col("first.key").alias("first_key"), F.col("first.at").alias("first_at"), F.col("first.reach").alias("first_reach")))
    matched = places.join(first, F.col("fp") == F.col("f"))
    matched = matched.filter((F.col("key") != F.col("first_key")) | (F.col("at") != F.col("first_at")))
    keyed = keyed.drop("doc_id")  # all other columns go on to the end
    later = _contexts(keyed, matched.select("key", "doc_id", "at", "fp", "reach"), min_words)
    sources = _contexts(keyed, first.select(F.col("first_key").alias("key"), F.lit(None).cast("long").alias("doc_id"), F.col("first_at").alias("at"), F.col("f").alias("fp"), F.col("first_reach").alias("reach")), min_words)
    sources = sources.select(F.col("fp").alias("f"), F.col("key").alias("first_key"), F.col("at").alias("first_at"), F.col("before").alias("b"), F.col("after").alias("a"))
    both = later.join(sources, F.col("fp") == F.col("f")).withColumn("left", _common("before", "b")).withColumn("right", _common("after", "a"))
    begin, end = F.col("at") - F.col("left"), F.col("at") + length + F.col("right")
    begin = F.when(F.col("key") == F.col("first_key"), F.greatest(begin, F.col("first_at") - F.col("left") + min_words)).otherwise(begin)
    same = F.when((F.col("left") + F.col("right") + length >= min_words) & (begin < end), F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end")))
    # windows with so many words before the line that they differ there from the first place's; then those that differ after it alone
    low, high = F.lit(reach) - F.size("after"), F.size("before")
    before = _side(F.lit(-1) - F.col("left"), F.greatest(low, F.col("left") + 1), high, reach, F.slice("before", F.lit(1), F.col("left") + 1))
    after = _side(F.col("right"), low, F.least(high, F.col("left"), F.lit(reach - 1) - F.col("right")), reach, F.slice("after", F.lit(1), F.col("right") + 1))
    # a row for each side that goes on, or one without any; the run that is found already goes with the first
    rows = both.select("key", "doc_id", "at", same.alias("same"), F.filter(F.array(before, after), lambda x: x.isNotNull()).alias("sides"))
    rows = rows.filter(F.col("same").isNotNull() | (F.size("sides") > 0)).select("key", "doc_id", "at", "same", F.posexplode_outer("sides").alias("n", "side"))
    rows = rows.select(F.coalesce("side.deal", "key").alias("deal"), "key", "doc_id", "at", F.when(F.coalesce("n", F.lit(0)) == 0, F.col("same")).alias("same"), F.col("side.most").alias("most"), F.col("side.windows").alias("windows"))
    dealt = rows.repartition("deal").select("deal", "key", "doc_id", "at", "same", "most", F.posexplode_outer("windows").alias("i", "hash"))
    start = F.col("at") - F.col("most") + F.col("i")
    dealt = dealt.select("deal", "key", "doc_id", "hash", start.alias("start"), F.when(F.coalesce("i", F.lit(0)) == 0, F.col("same")).alias("same"))
    order = Window.partitionBy("deal", "hash").orderBy(F.col("doc_id").isNull(), "doc_id", "key", "start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = dealt.withColumn("first", F.first(F.struct("key", "start")).over(order))
    begin = F.when(F.col("key") == F.col("first.key"), F.greatest("start", F.col("first.start") + min_words)).otherwise(F.col("start"))
    again = F.when(F.col("hash").isNotNull() & (F.struct("key", "start") != F.col("first")), F.struct(begin.alias("begin"), (F.col("start") + min_words).alias("end")))
    return held.select("key", F.inline(F.filter(F.array("same", again), lambda x: x.isNotNull()))).filter("begin < end")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words (begin, end) of the spans, which may overlap.

    Of the white space around a deleted run the part before it stays, or the part after it if only that
    ends a line; at the text's beginning both go.
    """
    data = text.encode()
    begin, end = word_bounds(np.frombuffer(data, dtype=np.uint8))
    runs: list[list[int]] = []
    for b, e in sorted(spans):
        if runs and b <= runs[-1][1]:
            runs[-1][1] = max(e, runs[-1][1])
        else:
            runs.append([b, e])
    out, at = [], 0
    for b, e in runs:
        following = int(begin[e]) if e < len(begin) else len(data)
        if b:
            before, after = data[end[b - 1] : begin[b]], data[end[e - 1] : following]
            out += [data[at : end[b - 1]], after if b"\n" in after and (e == len(begin) or b"\n" not in before) else before if e < len(begin) else b""]
        at = following
    return (b"".join(out) + data[at:]).decode()


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    bounds = spans.offsets.to_numpy()
    begin, end = (spans.values.field(name).to_numpy() for name in ("begin", "end"))
    rows = zip(texts.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
    return pa.array([None if t is None else without_words(t, list(zip(begin[a:b].tolist(), end[a:b].tolist(), strict=True))) for t, a, b in rows], pa.string())


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, with all their columns, without the runs of words that came before.

    A run is min_words successive words or more, whatever the white space between them; its first
    place, by doc_id and position, stays, later ones go, in the same document too. A text that isn't
    touched stays as it is; one that loses all its words becomes empty; null stays null. Of rows with
    the same id and text all are treated alike, as one. Null ids come last. An empty table gives no
    rows. No row is dropped. Columns of any name pass through.
    """
    bound_arrow_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    doc_id = docs[id_col].cast("long")
    keyed = docs.select(doc_id.alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), "*").toDF("doc_id", "text", *names)
    # an untouched text is told from null by whether there is one
    keyed = keyed.withColumn("key", F.xxhash64("doc_id", "text")).withColumn(names[at], F.col(names[at]).isNotNull()).select("doc_id", "key", "text", *names)
    spans = repeated_spans(keyed, min_words=min_words)
    gone = spans.groupBy(F.col("key").alias("k")).agg(F.collect_set(F.struct("begin", "end")).alias("gone"))
    marked = keyed.drop("doc_id").join(gone, F.col("key") == F.col("k"), "left")
    touched = F.arrow_udf(_cut, "string")(F.when(F.col("gone").isNotNull(), F.col("text")), F.coalesce("gone", F.array().cast("array<struct<begin: int, end: int>>")))
    text = F.when(F.col("gone").isNotNull(), touched).when(F.col(names[at]), F.col("text"))
    return marked.withColumn(names[at], text).select(*names).toDF(*docs.columns)
