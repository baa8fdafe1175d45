"""Near-duplicates by SimHash, joined on a grid of segment popcounts.

A fingerprint is cut into segments and each segment is replaced by its number of set bits. Two
fingerprints that differ in d bits have popcount vectors at a Manhattan distance of at most d, so
the distance of the vectors is a lower bound that loses no pair. With d <= 3, one half of the
vector differs by at most 1: its cell in the grid of that half's popcounts is the same, or next to
it along one axis. Each fingerprint therefore looks into its own cell and, if the cell's parity is
even, into the cells next to it (an odd neighbour is found from the even side). Candidates are
verified exactly on the whole fingerprints within the join.

Equal fingerprints are one node from the start, so copies are never paired. Components come from
alternating large-star and small-star rounds over the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import FEW_ROWS, bound_arrow_batches, durable, durable_round

BITS, MAX_DISTANCE, SHINGLE = 64, 3, 3
SEED = 42
#: Bits of a segment; a half has this many of them.
SEGMENT = 2
AXES = BITS // 2 // SEGMENT
_CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash over word shingles, repeats included; a bit is set if over half of the hashes have it."""
    words = text.lower().split()  # both of ASCII alone, for bytes
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))  # noqa: B905
    counts, n = np.zeros(BITS, dtype=np.int64), 0
    held: list[int] = []
    for g in grams:
        held.append(digest(g, SEED))
        if len(held) == _CHUNK:
            counts, n = counts + _bit_counts(held), n + len(held)
            held.clear()
    if held:
        counts, n = counts + _bit_counts(held), n + len(held)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _bit_counts(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(bits), 255):  # sums of so many fit a byte
        counts += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return counts


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64 bits) of every whole text."""
    bound_arrow_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for t in pc.cast(batch.column(1), pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    return narrow.mapInArrow(run, "doc_id long, fp long")


def _cells(half: F.Column) -> tuple[F.Column, F.Column]:
    """Of 32 bits: the popcount vector, two bits to an axis, and its parity."""
    odd = F.lit(0x55555555)
    counts = (half.bitwiseAND(odd)) + (F.shiftright(half, 1).bitwiseAND(odd))
    return counts, F.bit_count(half) % 2


def links(fps: DataFrame) -> DataFrame:
    """Pairs a < b of different fingerprints at MAX_DISTANCE or less, from distinct `fp` without nulls; of none, no pairs."""
    sides = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    half = F.when(F.col("side") == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    cell, parity = _cells(F.col("half"))
    placed = sides.withColumn("half", half).select("fp", "side", cell.alias("cell"), parity.alias("parity"))
    axis = lambda i: F.shiftright("cell", 2 * i).bitwiseAND(F.lit(3))
    steps = F.array(
        F.lit(0).cast("long"),
        *(F.when((F.col("parity") == 0) & (axis(i) < SEGMENT), F.lit(1 << (2 * i)).cast("long")) for i in range(AXES)),
        *(F.when((F.col("parity") == 0) & (axis(i) > 0), F.lit(-(1 << (2 * i))).cast("long")) for i in range(AXES)),
    )
    looking = placed.select("fp", "side", "cell", F.explode(F.array_compact(steps)).alias("step"))
    looking = looking.select(F.col("fp").alias("a"), F.struct("side", (F.col("cell") + F.col("step")).alias("cell")).alias("key"), F.col("step"))
    there = placed.select(F.col("fp").alias("b"), F.struct("side", "cell").alias("key2"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE
    # within a cell every pair is seen from both of its fingerprints; across cells from the even one
    once = (F.col("step") != 0) | (F.col("a") < F.col("b"))
    found = looking.join(there, (F.col("key") == F.col("key2")) & near & once & (F.col("a") != F.col("b")))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _contracted(edges: DataFrame, small: bool) -> DataFrame:
    """One round on links u > v: the same components, with links to smaller nodes. `small`: there are few of
    them, and what is looked up by node is broadcast."""
    hint = F.broadcast if small else lambda df: df
    # large star: the greater neighbours of each node go to its smallest neighbour
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    large = both.join(hint(least), F.col("u") == F.col("n")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    # small star: the smaller neighbours of each node, and itself, go to the smallest
    least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
    joined = large.join(hint(least), F.col("u") == F.col("n"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(least.select("n", "m")).distinct()


def _edges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return durable_round(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of `pairs`, roots left out.

    Repeated and reversed pairs and pairs of one node with itself change nothing; neither side may be null;
    of no pairs, no rows.
    Every round replaces links by links to the smallest neighbour; both kinds of stars keep the
    components, and when a round changes nothing every node is linked to its root alone.
    """
    edges = _edges(pairs, a, b)
    before, small = None, edges.count() <= FEW_ROWS
    while True:
        edges = durable_round(_contracted(edges, small))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def partly_joined(pairs: DataFrame, rounds: int, a: str = "a", b: str = "b") -> DataFrame:
    """Links a > b with the components of `pairs` after so many rounds, in which most nodes have their root."""
    edges = _edges(pairs, a, b)
    small = edges.count() <= FEW_ROWS
    for _ in range(rounds):
        edges = durable_round(_contracted(edges, small))
    return edges.select(F.col("u").alias("a"), F.col("v").alias("b"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    component_id is the smallest doc_id that can be reached over links of MAX_DISTANCE bits or less,
    the document's own included. Null and empty texts have fingerprint zero and are linked like any
    other. A null id stays and is nobody's smallest; repeated rows give a row each; an empty table
    gives no rows; other columns are ignored.
    """
    found = durable(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    classes = durable(found.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    reached = components(links(classes.select("fp")))
    reached = reached.unionByName(reached.select(F.col("root").alias("node"), "root").distinct())
    grouped = classes.join(reached, F.col("fp") == F.col("node"), "left").select("fp", "smallest", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("smallest").alias("component_id"))
    of_fp = grouped.select(F.col("fp").alias("f"), "root").join(smallest, "root").select("f", "component_id")
    hex_ = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.join(of_fp, F.col("fp") == F.col("f")).select("doc_id", hex_.alias("fingerprint"), "component_id")
