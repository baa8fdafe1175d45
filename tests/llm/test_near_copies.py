import random

import corpus_pipeline
from corpusloom.llm import near_copies, simhash

SCHEMA = "doc_id long, text string"


def edited(r, words, n):
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"e{r.random()}"
    return " ".join(out)


def corpus():
    r, phrase, rows = random.Random(5), "one phrase that stands in many of the texts here", []
    for i in range(60):
        words = [f"w{int(500 * r.random() ** 2)}" for _ in range(r.randint(60, 300))]
        rows += [f"{' '.join(words)} {phrase}", edited(r, words, len(words) // 60), edited(r, words, len(words) // 25), edited(r, words, len(words) // 8)]
    group = [f"g{j}" for j in range(200)]
    rows += [edited(r, group, 4) for _ in range(40)]
    rows += [None, "", "a b", "A  b", "a b c", rows[7].upper()]
    r.shuffle(rows)
    return list(enumerate(rows))


def components(rows):
    sets = {i: set(near_copies.shingles((t or "").encode()).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(i, j) for i in sets for j in sets if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0)]
    for i, j in pairs:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    return {i: top(i) for i in sets}, pairs


def test_stage_drops_every_copy_at_four_fifths(spark):
    rows = corpus()
    want, pairs = components(rows)
    texts = dict(rows)
    fps = {i: simhash.fingerprint((t or "").encode()) for i, t in rows}
    assert sum((fps[i] ^ fps[j]).bit_count() > 3 for i, j in pairs) > 20  # pairs that 3 bits don't find
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {x.doc_id: x.component_id for x in near_copies.near_copies(docs).collect()} == want
    kept = corpus_pipeline.dedup_near(spark, docs, "").collect()
    assert {x.doc_id for x in kept} == set(want.values())
    assert all(x.text == texts[x.doc_id] for x in kept)


def test_no_text_is_lost_with_its_id(spark):
    """Rows are told apart by id and text; columns may have any name."""
    other = "another text of five words or more"
    rows = [(1, "a b"), (2, "A  b"), (2, other), (5, "c d"), (5, "e f"), (6, other.upper())]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], SCHEMA + ", __key int, __gone int, key int, node int")
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id, x.text) for x in kept.collect()) == [(1, "a b"), (2, other), (5, "c d"), (5, "e f")]


def test_maps_differ_no_more_than_the_sets():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (1, 40, 3000):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], r.integers(0, 1 << 63, n // 3, dtype=np.uint64)]))
        maps = [int.from_bytes(near_copies.parity_map(x), "big") for x in (a, b)]
        assert (maps[0] ^ maps[1]).bit_count() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_missing_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a b"), (None, "a b"), (1, "a b"), (1, "a b"), (2, "a b")]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((x.doc_id or 0, x.text) for x in kept) == [(0, "a b"), (0, "a b"), (1, "a b")]
    assert near_copies.drop_near_copies(spark.createDataFrame([], SCHEMA)).count() == 0
