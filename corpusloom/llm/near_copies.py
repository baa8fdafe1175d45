"""Near copies by exact Jaccard similarity of word shingles.

Two texts are linked if their sets of SHINGLE-word runs have a Jaccard similarity of 4/5 or more;
of each component of links the smallest id stays. Pairs are proposed in two ways and all of them
are verified on the whole sets:

* SimHash links: the grid join of `simhash`, over these shingles.
* Shared prefixes, which lose no pair. Put in one order for all texts, the n // 5 + SHARED first
  shingles of the larger of two sets of similarity 4/5 and the n // 9 + SHARED first of the smaller
  share SHARED at least, or all that the sets must share if those are fewer; and no shingle that they
  share has a place in both from which on too few are left. The order has shingles that are common in a
  sample last, so that common phrases propose little; it decides only the cost.

The texts of a shingle are first held against its smallest one, then against a few others of it, and
what that links becomes one component; only texts of different components are then paired with
each other, so a group of copies costs its size and not the square. Each set has a parity map, a bit
for the shingles of a hash being odd in number: two maps differ in no more bits than the sets in
shingles, so a pair whose maps differ too much is never made. Equal sets are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import simhash
from corpusloom.runtime import bound_arrow_batches, durable, durable_round, few

SHINGLE = 5
#: Shingles that the prefixes of a pair must share.
SHARED = 3
#: Other texts of each shingle that the texts are held against; longs of a parity map.
HEADS, MAP_LONGS = 2, 12
#: Texts whose shingles are counted for the order, and shingles that are put last at most.
SAMPLE_TEXTS, MAX_COMMON = 4_000, 200_000


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words; of a shorter text, of all its words."""
    words = text.lower().split()  # both of ASCII alone, as in simhash
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))  # noqa: B905
    return np.unique(np.fromiter((digest(g, simhash.SEED) for g in grams), dtype=np.uint64))


def node_of(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), simhash.SEED)).astype(np.int64))


def set_fingerprint(grams: np.ndarray) -> int:
    """SimHash of the set, signed."""
    counts = np.zeros(simhash.BITS, dtype=np.int64)
    for at in range(0, len(grams), 1 << 15):
        counts += simhash._bit_counts(grams[at : at + (1 << 15)])
    return int(np.packbits(2 * counts > len(grams)).view(">i8")[0])


def parity_map(grams: np.ndarray) -> bytes:
    """For each of 64 * MAP_LONGS hashes whether the set has an odd number of shingles with it."""
    odd = np.bincount((grams >> np.uint64(20)) % np.uint64(64 * MAP_LONGS), minlength=64 * MAP_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _close(na: Column, nb: Column, shared: Column) -> Column:
    """Jaccard similarity of 4/5 or more, in whole numbers."""
    return 9 * shared >= 4 * (na + nb)


def _map_texts(texts: DataFrame, make, schema: str) -> DataFrame:
    """`make` turns the shingle sets of a batch (of column text, the last one) into columns after the others."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in pc.cast(batch.columns[-1], pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *make(sets)], names)

    return texts.mapInArrow(run, schema)


def _grams(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs a, b of nodes whose sets are similar; only the sets that are asked for are made."""
    pairs = durable(pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    asked = pairs.select(F.col("a").alias("m")).union(pairs.select("b")).distinct()
    asked = few(classes.join(asked, F.col("node") == F.col("m"), "left_semi").select(F.col("smallest").alias("s")).distinct())
    some = texts.join(asked, F.col("doc_id") == F.col("s"), "left_semi").select("text")
    held = _map_texts(some, lambda sets: [pa.array([node_of(s) for s in sets], pa.int64()), _grams(sets)], "node long, grams array<long>")
    held = durable_round(held.dropDuplicates(["node"]))
    one, two = held.select(F.col("node").alias("m"), F.col("grams").alias("ga")), held.select(F.col("node").alias("o"), F.col("grams").alias("gb"))
    both = pairs.join(one, F.col("a") == F.col("m")).join(two, F.col("b") == F.col("o"))
    return durable(both.filter(_close(F.size("ga"), F.size("gb"), F.size(F.array_intersect("ga", "gb")))).select("a", "b"))


def _prefixes(texts: DataFrame, n_texts: int) -> DataFrame:
    """gram, node, n (size of the node's set), pos (the gram's place in it)."""
    part = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_texts // SAMPLE_TEXTS))) == 0).select("text")
    often = _map_texts(part, lambda sets: [_grams(sets)], "grams array<long>").select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    rows = often.orderBy(F.desc("n"), "gram").limit(MAX_COMMON).collect()
    grams = np.array([r["gram"] for r in rows], dtype=np.int64)
    order = np.argsort(grams)
    common = texts.sparkSession.sparkContext.broadcast((grams[order], np.array([r["n"] for r in rows], dtype=np.int64)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, times), done = common.value, set()  # copies within a task go at once
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for text in pc.cast(batch.column(0), pa.binary()).to_pylist():
                own = shingles(text)
                node = node_of(own)
                if node in done or not len(own):
                    continue
                done.add(node)
                own, count = own.view(np.int64), np.zeros(len(own), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    count = np.where(known[at] == own, times[at], 0)
                first = own[np.lexsort((own, count))[: len(own) // 5 + SHARED]]
                for column, values in zip(out, (first, np.full(len(first), node), np.full(len(first), len(own), dtype=np.int32), np.arange(len(first), dtype=np.int32)), strict=True):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["gram", "node", "n", "pos"])

    return texts.select("text").mapInArrow(run, "gram long, node long, n int, pos int")


def _maps_may(a: str, b: str, small: str, large: str) -> Column:
    """Whether sets with these parity maps (arrays) and sizes can be similar: they differ in (n + m) / 9 shingles at most."""
    differ = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, MAP_LONGS)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))
    return 9 * differ <= F.col(small) + F.col(large)


def _may(small: str, large: str, i: str, j: str) -> Column:
    """Whether sets of two sizes that share a shingle, at these places in them, can be similar."""
    n, m, i, j = F.col(small), F.col(large), F.col(i), F.col(j)
    return (5 * n >= 4 * m) & (9 * (F.least(i, j) + F.least(n - i, m - j)) >= 4 * (n + m))


def _proposed(rows: DataFrame) -> DataFrame:
    """Pairs a, b, of rows with both structs (node, n) for each shingle shared, that share enough."""
    na, nb = F.col("a.n"), F.col("b.n")
    must = lambda n: n - F.floor(n / 5)
    rows = rows.groupBy("a", "b").agg(F.count("*").alias("times"))
    return rows.filter(F.col("times") >= F.least(F.lit(SHARED), F.greatest(must(na), must(nb)))).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def _labelled(shared: DataFrame, found: DataFrame) -> DataFrame:
    """gram, node, n, pos with root, the smallest node that each is linked to."""
    reached = found.groupBy(F.col("a").alias("m")).agg(F.min("b").alias("r"))
    return shared.join(few(reached), F.col("node") == F.col("m"), "left").select("gram", "node", "n", "pos", F.coalesce("r", "node").alias("root"))


def _heads(rows: DataFrame, turns: range) -> DataFrame:
    """g and a few of its texts (heads) of each gram whose texts have several roots."""
    place = lambda i: F.struct(F.xxhash64(F.lit(i), "node").alias("turn"), "root", "pos", "node", "n")
    found = rows.groupBy(F.col("gram").alias("g")).agg(F.min("root").alias("one"), F.max("root").alias("two"), F.array(*(F.min(place(i)) for i in turns)).alias("heads"))
    return found.filter("one != two").select("g", "heads")


def _against(rows: DataFrame, turns: range) -> DataFrame:
    """Pairs a, b of each row with the heads of its gram."""
    both = rows.join(_heads(rows, turns), F.col("gram") == F.col("g")).select("node", "n", "pos", "root", F.explode("heads").alias("head"))
    both = both.filter((F.col("root") != F.col("head.root")) & _may("head.n", "n", "head.pos", "pos") & _may("n", "head.n", "pos", "head.pos"))
    return _proposed(both.select(F.struct("head.node", "head.n").alias("a"), F.struct("node", "n").alias("b")))


def links(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """node, root of all nodes (roots left out) that similar sets connect.

    texts: doc_id, text. classes: node, smallest (a doc_id that has the set), fp, map.
    """
    dealt = _prefixes(texts, classes.count()).repartition("gram")
    row = F.struct("n", "node", "pos")  # both sides use all columns, so the entries are made and dealt once
    several = dealt.groupBy("gram").agg(F.min(row).alias("head"), F.max(row).alias("last")).filter("head.node != last.node").select(F.col("gram").alias("g"))
    shared = durable(dealt.join(several, F.col("gram") == F.col("g")).select("gram", "node", "n", "pos").distinct())
    stars = _against(shared.withColumn("root", F.col("node")), range(1))
    of_fp = classes.groupBy("fp").agg(F.min("node").alias("m"))
    stars = stars.unionByName(classes.join(of_fp, "fp").select(F.col("node").alias("a"), F.col("m").alias("b")))
    left, right = of_fp.select(F.col("fp").alias("a"), F.col("m").alias("p")), of_fp.select(F.col("fp").alias("b"), F.col("m").alias("q"))
    grid = simhash.links(of_fp.select("fp"))
    stars = stars.unionByName(grid.join(left, "a").join(right, "b").select(F.col("p").alias("a"), F.col("q").alias("b")))
    found = simhash.partly_joined(_verified(stars, texts, classes), 2)
    again = _against(_labelled(shared, found), range(1, 1 + HEADS))
    found = simhash.partly_joined(found.unionByName(_verified(again, texts, classes)), 1)

    rest = _labelled(shared, found)
    mixed = rest.groupBy(F.col("gram").alias("g")).agg(F.min("root").alias("one"), F.max("root").alias("two")).filter("one != two").select("g")
    rest = durable_round(rest.join(mixed, F.col("gram") == F.col("g"), "left_semi"))
    rest = rest.join(classes.select(F.col("node").alias("m"), "map"), F.col("node") == F.col("m")).drop("m")
    larger = rest.select(F.col("gram").alias("g"), F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("root").alias("root2"), F.col("map").alias("map2"))
    smaller = rest.filter(F.col("pos") < F.floor(F.col("n") / 9) + SHARED)
    order = (F.col("n") < F.col("n2")) | (F.col("n") == F.col("n2")) & (F.col("node") < F.col("node2"))
    across = smaller.join(larger, (F.col("gram") == F.col("g")) & order & (F.col("root") != F.col("root2")) & _may("n", "n2", "pos", "pos2") & _maps_may("map", "map2", "n", "n2"))
    more = _verified(_proposed(across.select(F.struct("node", "n").alias("a"), F.struct(F.col("node2").alias("node"), F.col("n2").alias("n")).alias("b"))), texts, classes)
    return simhash.components(found.unionByName(more))


def _grouped(named: DataFrame, texts: DataFrame) -> DataFrame:
    """node, root of every node. named: doc_id, node, fp, map; texts: doc_id, text."""
    classes = durable(named.groupBy("node").agg(F.min("doc_id").alias("smallest"), F.min("fp").alias("fp"), F.min("map").alias("map")))
    reached = links(texts, classes)
    reached = reached.unionByName(reached.select(F.col("root").alias("node"), "root").distinct())
    return classes.join(reached.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select("node", F.coalesce("root", "node").alias("root"))


def _named(texts: DataFrame) -> DataFrame:
    """The columns before the last, the text, with node, fp and map."""
    types = ", ".join(f"{name} {kind}" for name, kind in texts.dtypes[:-1])
    make = lambda sets: [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([set_fingerprint(s) for s in sets], pa.int64()), pa.array([np.frombuffer(parity_map(s), dtype="<i8") for s in sets], pa.list_(pa.int64()))]
    return durable(_map_texts(texts, make, f"{types}, node bigint, fp bigint, map array<bigint>"))


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id of every document: the smallest doc_id that links of similar sets reach.

    Null and empty texts and others without words are equal to each other. A null id is nobody's
    smallest; repeated rows give a row each; an empty table gives no rows; other columns are ignored.
    """
    bound_arrow_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = _named(texts)
    grouped = durable(_grouped(named, texts))
    own = named.join(grouped.withColumnRenamed("node", "m"), F.col("node") == F.col("m"))
    smallest = durable(own.groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("component_id")))  # a side of its own, so that a large component is split
    return own.join(smallest, F.col("root") == F.col("r")).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the row with the smallest id.

    Rows are told apart by id and text: an id may have several texts, and each belongs to its own
    component. Of rows that share the smallest id of a component the one with the smallest hash of
    id and text stays; of rows with the same id and text, one. A row without an id is in no group
    and stays. An empty table gives no rows. Columns of any name pass through.
    """
    bound_arrow_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    keyed = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), "*").toDF("doc_id", "text", *names)
    keyed = keyed.withColumn("key", F.xxhash64("doc_id", "text"))
    named = keyed.filter("doc_id is not null")
    texts = named.select("doc_id", "text")
    rows = _named(named.select("key", "doc_id", "text"))
    grouped = durable(_grouped(rows, texts))
    own = rows.join(grouped.withColumnRenamed("node", "m"), F.col("node") == F.col("m")).select("key", "doc_id", "root")
    chosen = durable(own.groupBy(F.col("root").alias("r")).agg(F.min(F.struct("doc_id", "key")).alias("stays")))
    gone = own.join(chosen, F.col("root") == F.col("r")).filter("key != stays.key").select(F.col("key").alias("k")).distinct()
    kept = named.join(gone, F.col("key") == F.col("k"), "left_anti").dropDuplicates(["key"])
    return kept.select(*names).unionByName(keyed.filter("doc_id is null").select(*names)).toDF(*docs.columns)
