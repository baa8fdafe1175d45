"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

A count is kept as its level on a logarithmic scale. An n-gram of level q is put into the filter
once for each level up to q; to read a count, the filter is asked for level 1, 2 and so on until it
says no. No count is ever lost or read too low; a false positive reads it a level too high.

Tokenised blocks of documents send what they hold to segments by hash, once: the count of each distinct
word, and of each distinct bigram of the training documents. A word segment knows the exact training
counts of its words and writes the filter's unigrams; a bigram segment writes the filter's bigrams.

The base score needs the exact count of each word where its documents are. Frequent words, a list of
bounded length that a sample of the texts names, send their counts alone, and the whole counts of the
list are broadcast. Of other words a block sends the occurrences by document too, and the segment
returns to every block its documents' shares of the score. So no segment gets more because a word is
frequent; the list decides where a word is counted and not what comes out.

Bounded groups of bigram segments are broadcast one after another, the unigrams with each; a pass over
the texts adds up the bigrams of its group, and a document's score is the sum of the passes:

    p(w | u) = (c(u w) + MASS * p(w)) / (c(u) + MASS),   p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

with counts c from the filter, N training tokens and V distinct ones.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import bound_arrow_batches, durable

#: Base of the logarithmic scale; probes of level 1, and of each level after it.
BASE, FIRST_PROBES, MORE_PROBES = 1.5, 6, 2
#: Weight of the unigram model, in tokens.
MASS = 20.0
#: Bound of what is broadcast at once: the word segments and one group of bigram segments, which get half
#: of it at least. A larger model takes more passes over the texts and loses nothing.
MAX_FILTER_BYTES = 96 << 20
#: Level that no count of 64 bits is above.
MAX_LEVEL = 110
#: Words on the list of frequent ones, and texts of the sample that names them.
FREQUENT_WORDS, SAMPLE_TEXTS = 65_536, 4_000
#: Characters of input to one word segment and to one bigram segment, and tokens of a block.
WORD_SEGMENT_CHARS, PAIR_SEGMENT_CHARS = 64_000_000, 8_000_000
BLOCK_TOKENS, BLOCK_DOCS = 250_000, 60_000

_END = b""  # no word is empty
_WORDS, _PAIRS, _SHARES, _LISTED = 0, 1, -1, -2
_SEED = 7


def held_out(id_col: str) -> Column:
    """Rows that aren't learned from: crc32 of the id as text, modulo 5, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def tokens(text: bytes) -> list[bytes]:
    """Words of the text with ASCII letters in lower case, and one end."""
    return [*text.lower().split(), _END]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit mixer, for arrays."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + (second ^ np.uint64(0xD1B54A32D192ED03)))


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, and one more for each factor BASE."""
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """A count in the middle of each level; 0 for level 0."""
    low = np.ceil(BASE ** (levels - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE**levels - 1e-9) - 1)
    return np.where(levels > 0, np.sqrt(low * high), 0.0)


def probe_steps(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of one level begin, and how far they step."""
    a = mix(hashes + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return a, mix(a ^ np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


def write_filter(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Filter (bytes, a power of two of them) of distinct hashes with their counts."""
    levels = level_of(counts)
    bits = len(hashes) * FIRST_PROBES + int((levels - 1).sum()) * MORE_PROBES
    size = 1 << max(9, math.floor(math.log2(max(1, bits) / math.log(2) * 1.33)))
    filter_ = np.zeros(size, dtype=bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        for i in range(0, len(hashes), 1 << 18):
            own = hashes[i : i + (1 << 18)][levels[i : i + (1 << 18)] >= q]
            place, step = probe_steps(own, q)
            for _ in range(FIRST_PROBES if q == 1 else MORE_PROBES):
                filter_[place & np.uint64(size - 1)] = True
                place += step
    return np.packbits(filter_, bitorder="little")


def fold(filter_: np.ndarray, size: int) -> np.ndarray:
    """The filter in so many bytes, for positions modulo its new size."""
    return np.bitwise_or.reduce(filter_.reshape(-1, size), axis=0)


class CountFilter:
    """Segments of filters in one array: of `n_words` word segments, then of the bigram segments.

    Of the bigram segments only those of `group` (first, after the last) may be there, the others with
    size 0. No count is read above level `top`.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, n_words: int, group: tuple[int, int] | None = None, top: int = MAX_LEVEL):
        self.bits, self.n_words, self.n_pairs = bits, n_words, len(sizes) - n_words
        self.group, self.top = group or (0, self.n_pairs), top
        self.begin = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        self.mask = (sizes * 8 - 1).astype(np.uint64)

    @classmethod
    def of(cls, words: list[bytes], pairs: list[bytes]) -> CountFilter:
        parts = [np.frombuffer(b, dtype=np.uint8) for b in (*words, *pairs)]
        return cls(np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64), len(words))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Which bigrams are of the group."""
        segment = hashes % np.uint64(self.n_pairs)
        return (segment >= self.group[0]) & (segment < self.group[1])

    def counts(self, hashes: np.ndarray, kind: int) -> np.ndarray:
        n = self.n_words if kind == _WORDS else self.n_pairs
        if not n or not len(hashes):
            return np.zeros(len(hashes))
        segment = (hashes % np.uint64(n)).astype(np.int64) + (0 if kind == _WORDS else self.n_words)
        begin, mask = self.begin[segment], self.mask[segment]
        levels, live, q = np.zeros(len(hashes), dtype=np.int64), np.arange(len(hashes)), 1
        while len(live) and q <= self.top:
            place, step = probe_steps(hashes[live], q)
            for _ in range(FIRST_PROBES if q == 1 else MORE_PROBES):
                # one probe at a time: most n-grams that aren't there go at the first
                p = place & mask[live]
                byte = self.bits[begin[live] + (p >> np.uint64(3)).astype(np.int64)]
                still = (byte >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
                live, place, step = live[still], place[still] + step[still], step[still]
            levels[live] = q
            q += 1
        return count_of(levels)


class _Block:
    """Tokens of some documents as numbers of the block's own words."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {_END: 0}
        self.ids: list[int] = []
        self.ends: list[int] = []

    def add(self, text: bytes) -> None:
        get, number = self.number.setdefault, self.number
        self.ids += [get(w, len(number)) for w in tokens(text)]
        self.ends.append(len(self.ids))

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_TOKENS or len(self.ends) >= BLOCK_DOCS

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token ids, the document of each, the id before each (the end before a first one), hashes of the words."""
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(w, _SEED) for w in self.number], dtype=np.uint64)
        ids, ends = np.array(self.ids, dtype=np.int64), np.array(self.ends, dtype=np.int64)
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        return ids, doc, np.concatenate([[0], ids[:-1]]), hashes


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, list[tuple]]]:
    """Blocks of documents with the other columns of their rows; the text is the last column."""
    block, rows = _Block(), []
    for batch in batches:
        others = list(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True)) or [()] * batch.num_rows
        for row, text in zip(others, pc.cast(batch.columns[-1], pa.binary()).to_pylist(), strict=True):
            block.add(text)
            rows.append(row)
            if block.full():
                yield block, rows
                block, rows = _Block(), []
        del others
        pa.default_memory_pool().release_unused()
    if rows:
        yield block, rows


def _packed(*arrays: np.ndarray) -> bytes:
    return struct.pack(f"<{len(arrays)}q", *(len(a) for a in arrays)) + b"".join(a.tobytes() for a in arrays)


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}q", data), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data, dtype=kind, count=n, offset=at))
        at += n * np.dtype(kind).itemsize
    return out


def _cuts(to: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Of a sorted array each value with where it begins and ends."""
    at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else np.zeros(1, dtype=np.int64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(to[a]), a, b


def _listed(hashes: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    """The place of each hash in the sorted list; -1 if it isn't there."""
    if not len(sorted_list):
        return np.full(len(hashes), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_list, hashes), len(sorted_list) - 1)
    return np.where(sorted_list[at] == hashes, at, -1)


def _dealt(number: int, block: _Block, rows: list[tuple], n_words: int, n_pairs: int, frequent: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """What a block sends to each segment. rows: (key, held_out)."""
    ids, doc, before, hashes = block.arrays()
    keys = np.array([r[0] for r in rows], dtype="<i8")
    train = ~np.array([r[1] for r in rows], dtype=bool)
    learned = train[doc]
    in_train = np.bincount(ids[learned], minlength=len(hashes))
    to = (hashes % np.uint64(n_words)).astype(np.int64)
    order = np.argsort(to, kind="stable")  # words by segment
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    # occurrences by word, then document, of words that aren't on the list
    rare = _listed(hashes, frequent) < 0
    pairs, times = np.unique((rank[ids] * len(rows) + doc)[rare[ids]], return_counts=True)
    word, where = pairs // len(rows), pairs % len(rows)
    for s, low, high in _cuts(to[order]):
        a, b = np.searchsorted(word, (low, high))
        each = np.bincount(word[a:b] - low, minlength=high - low)
        present, place = np.unique(where[a:b], return_inverse=True)
        own = order[low:high]
        yield _WORDS, s, _packed(hashes[own], in_train[own].astype("<u4"), each.astype("<u4"), place.astype("<u2"), times[a:b].astype("<u4"), keys[present], np.array([number], dtype="<i8"))
    pairs, times = np.unique((before * len(hashes) + ids)[learned], return_counts=True)
    both = pair_hash(hashes[pairs // len(hashes)], hashes[pairs % len(hashes)])
    to = (both % np.uint64(n_pairs)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    both, times = both[order], times[order].astype("<u4")
    for s, a, b in _cuts(to[order]):
        yield _PAIRS, s, _packed(both[a:b], times[a:b])


_SEGMENT_SCHEMA = pa.schema([("kind", pa.int32()), ("segment", pa.int32()), ("block", pa.int64()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("payload", pa.binary())])


def _counted(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes with the sums of their counts."""
    hashes = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[first], np.add.reduceat(counts, first, dtype=np.int64)


def _segment(group: pa.Table) -> pa.Table:
    """A segment's filter; of a word segment also the counts of its listed words and its shares of the base
    score from other words, one row per block."""
    kind, segment = group.column("kind")[0].as_py(), group.column("segment")[0].as_py()
    blobs = [b.as_py() for b in group.column("payload")]
    if kind == _PAIRS:
        hashes, counts = _counted([_unpacked(b, "<u8", "<u4") for b in blobs])
        return pa.Table.from_pylist([{"kind": kind, "segment": segment, "tokens": 0, "distinct": len(hashes), "payload": write_filter(hashes, counts).tobytes()}], _SEGMENT_SCHEMA)
    parts = [_unpacked(b, "<u8", "<u4", "<u4", "<u2", "<u4", "<i8", "<i8") for b in blobs]
    hashes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
    known = counts > 0
    rows = [{"kind": kind, "segment": segment, "tokens": int(counts.sum()), "distinct": int(known.sum()), "payload": write_filter(hashes[known], counts[known]).tobytes()}]
    listed = np.zeros(len(hashes), dtype=bool)
    listed[inverse[np.concatenate([p[2] for p in parts]) == 0]] = True  # any other word stands in a document of its block
    rows.append({"kind": _LISTED, "segment": segment, "tokens": 0, "distinct": 0, "payload": _packed(hashes[listed], counts[listed].astype("<i8"))})
    log, at = np.log10(counts + 0.5), 0
    for own, _, each, place, times, keys, number in parts:
        of = inverse[at : at + len(own)]
        at += len(own)
        if not len(keys):
            continue
        of = np.repeat(of, each)
        sums = np.bincount(place, weights=times * log[of], minlength=len(keys))
        seen = np.bincount(place, weights=times * known[of], minlength=len(keys)).astype("<i8")
        all_ = np.bincount(place, weights=times, minlength=len(keys)).astype("<i8")
        rows.append({"kind": _SHARES, "segment": segment, "block": int(number[0]), "tokens": 0, "distinct": 0, "payload": _packed(keys, sums, seen, all_)})
    return pa.Table.from_pylist(rows, _SEGMENT_SCHEMA)


def _shares(group: pa.Table) -> pa.Table:
    """Sums over the word segments for each document of a block."""
    parts = [_unpacked(b.as_py(), "<i8", "<f8", "<i8", "<i8") for b in group.column("payload")]
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = [np.bincount(inverse, weights=np.concatenate([p[i] for p in parts])) for i in (1, 2, 3)]
    return pa.table({"k": pa.array(keys), "sum": pa.array(sums[0]), "known": pa.array(sums[1].astype(np.int64)), "n": pa.array(sums[2].astype(np.int64))})


def _frequent(texts: DataFrame, n_texts: int) -> np.ndarray:
    """Sorted hashes of the most frequent words of a sample of the texts (key, text)."""
    part = texts.filter(F.pmod("key", F.lit(max(1, n_texts // SAMPLE_TEXTS))) == 0).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in _blocks(batches):
            ids, _, _, hashes = block.arrays()
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.bincount(ids, minlength=len(hashes)))], ["hash", "n"])

    counted = part.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.desc("n"), "hash").limit(FREQUENT_WORDS).select("hash").collect()
    return np.sort(np.array([r["hash"] for r in found], dtype=np.int64).view(np.uint64))


def _gathered(segments: DataFrame, n_words: int, n_pairs: int, top: int) -> Iterator[CountFilter]:
    """The filter, a group of bigram segments at a time, each within MAX_FILTER_BYTES and fetched a partition at a time."""
    filters = segments.filter("kind >= 0").select("kind", "segment", F.length("payload").alias("size"), "payload")
    sizes = np.full(n_words + n_pairs, 64, dtype=np.int64)  # of a segment that got nothing
    place = lambda r: r["segment"] + (n_words if r["kind"] == _PAIRS else 0)
    for r in filters.drop("payload").collect():
        sizes[place(r)] = r["size"]
    room = max(MAX_FILTER_BYTES // 2, MAX_FILTER_BYTES - int(sizes[:n_words].sum()))
    low = 0
    while low < n_pairs:
        high = max(low + 1, int(np.searchsorted(np.cumsum(sizes[n_words + low :]), room, side="right")) + low)
        own = sizes.copy()
        own[n_words : n_words + low] = own[n_words + high :] = 0
        begin = np.concatenate([[0], np.cumsum(own)])
        bits = np.zeros(int(begin[-1]), dtype=np.uint8)
        wanted = (F.col("kind") == _WORDS) | ((F.col("segment") >= low) & (F.col("segment") < high))
        for r in filters.filter(wanted).select("kind", "segment", "payload").toLocalIterator():
            at = place(r)
            bits[begin[at] : begin[at + 1]] = np.frombuffer(r["payload"], dtype=np.uint8)
        yield CountFilter(bits, own, n_words, (low, high), top)
        low = high


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mass: float = MASS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    base_score is exact; score is the model's. Null and empty texts are one end token; null ids stay
    (they count as the empty text in held_out); repeated rows are learned from and scored once each;
    without training rows every count is 0; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("key"), held_out(id_col).alias("held_out"), text.alias("text"))
    n_texts, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n_words, n_pairs = 1 + chars // WORD_SEGMENT_CHARS, 1 + chars // PAIR_SEGMENT_CHARS

    frequent = spark.sparkContext.broadcast(_frequent(rows, n_texts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, (block, own) in enumerate(_blocks(batches)):
            sent = list(_dealt(first + i, block, own, n_words, n_pairs, frequent.value))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sent], pa.int32()), pa.array([x[1] for x in sent], pa.int32()), pa.array([x[2] for x in sent], pa.binary())], ["kind", "segment", "payload"])

    dealt = rows.select("key", "held_out", "text").mapInArrow(deal, "kind int, segment int, payload binary")
    segments = durable(dealt.groupBy("kind", "segment").applyInArrow(_segment, "kind int, segment int, block long, tokens long, distinct long, payload binary"))
    totals = segments.filter(F.col("kind") == _WORDS).agg(F.sum("tokens"), F.sum("distinct")).first()
    n, v = totals[0] or 0, totals[1] or 0
    floor = n + 0.5 * (v + 1)
    top = int(level_of(np.array([max(n, 1)]))[0])
    exact = [_unpacked(r["payload"], "<u8", "<i8") for r in segments.filter(F.col("kind") == _LISTED).select("payload").collect()]
    exact = [np.concatenate([x[i] for x in exact]) if exact else np.zeros(0, kind) for i, kind in ((0, "<u8"), (1, "<i8"))]
    order = np.argsort(exact[0])
    listed = spark.sparkContext.broadcast((exact[0][order], exact[1][order]))  # FREQUENT_WORDS at most

    def scored_with(model) -> DataFrame:
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filter_ = model.value
            for block, own in _blocks(batches):
                ids, doc, before, hashes = block.arrays()
                one = filter_.counts(hashes, _WORDS)
                pairs, inverse = np.unique(before * len(hashes) + ids, return_inverse=True)
                u, w = pairs // len(hashes), pairs % len(hashes)
                both = pair_hash(hashes[u], hashes[w])
                here = filter_.holds(both)
                u, w = u[here], w[here]
                two = np.minimum(filter_.counts(both[here], _PAIRS), np.minimum(one[u], one[w]))
                log = np.zeros(len(pairs))
                log[here] = np.log10((two + mass * (one[w] + 0.5) / floor) / (one[u] + mass))
                sums = np.bincount(doc, weights=log[inverse], minlength=len(own))
                sizes = np.bincount(doc, minlength=len(own))
                place = _listed(hashes, listed.value[0])
                counts = np.where(place >= 0, listed.value[1][np.maximum(place, 0)], 0) if len(listed.value[0]) else np.zeros(len(hashes))
                base = np.bincount(doc, weights=np.where(place >= 0, np.log10(counts + 0.5), 0.0)[ids], minlength=len(own))
                known = np.bincount(doc, weights=(counts > 0)[ids], minlength=len(own)).astype(np.int64)
                rest = np.bincount(doc, weights=(place < 0)[ids], minlength=len(own)).astype(np.int64)
                columns = [pa.array([r[i] for r in own], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(base, pa.float64()), pa.array(known), pa.array(rest)], ["doc_id", "key", "held_out", "n_tokens", "score", "listed", "listed_known", "rest"])

        return rows.mapInArrow(score, "doc_id long, key long, held_out boolean, n_tokens long, score double, listed double, listed_known long, rest long")

    scored, others = None, None
    for group, filter_ in enumerate(_gathered(segments, n_words, n_pairs, top)):
        whole = filter_.group == (0, n_pairs)
        model = spark.sparkContext.broadcast(filter_)
        del filter_
        part = scored_with(model)
        if not whole:  # the next group takes this one's place in memory
            part = durable(part if group == 0 else part.groupBy("key").agg(F.max("score").alias("score")))
            model.destroy()
        if group == 0:
            scored = part
        else:
            others = part if others is None else others.unionByName(part)
    if others is not None:
        others = others.groupBy(F.col("key").alias("other")).agg(F.sum("score").alias("more"))
        scored = scored.join(others, F.col("key") == F.col("other")).withColumn("score", F.col("score") + F.col("more")).drop("other", "more")

    shared = segments.filter(F.col("kind") == _SHARES).select("block", "payload").groupBy("block").applyInArrow(_shares, "k long, sum double, known long, n long")
    shared = shared.groupBy("k").agg(F.sum("sum").alias("sum"), F.sum("known").alias("known"), F.sum("n").alias("n"))
    both = scored.join(shared, F.col("key") == F.col("k"), "left")
    copies = F.col("n") / F.col("rest")  # rows with the same id and text were summed together
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("listed_known") + F.coalesce(F.round(F.col("known") / copies), F.lit(0)).cast("long")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("listed") + F.coalesce(F.col("sum") / copies, F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(floor))).alias("base_score"),
        "score",
    )
