import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import fingerprints, line_dedup, ngram_lm, simhash, toxicity

#: Extra columns have the names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, key long, fp long, n long, first string, range int, copy boolean, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 1, 1, "f", 1, True, 0.5) for i, t in rows], SCHEMA)


def words(r, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * r.random() ** 2)}" for _ in range(n))


def corpus(seed=1, n=80):
    r = random.Random(seed)
    rows = [(i, "\n".join(words(r, r.randint(1, 40)) for _ in range(r.randint(1, 6)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "   \n "), (n + 3, rows[4][1]), (n + 4, rows[4][1] + " more"), (None, "no id here"), (3, rows[3][1]), (n + 5, "LONG " * 4000), (n + 6, "é" * 3000)]
    return rows


# --- language model


@pytest.mark.parametrize("frequent", [1, 100, 65_536])
def test_base_score_and_counts(spark, monkeypatch, frequent):
    rows = corpus()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(t for i, text in rows if not out(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    monkeypatch.setattr(ngram_lm, "FREQUENT_WORDS", frequent)  # any list gives the same
    got = ngram_lm.score_documents(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for g in got:
        by_id[g.doc_id].append(g)
    for i, text in rows:
        for g in by_id[i]:
            assert (g.held_out, g.train_tokens) == (out(i), n)
        g = next(g for g in by_id[i] if g.n_tokens == len(tokens(text)))
        assert g.n_known == sum(counts[t] > 0 for t in tokens(text))
        assert g.base_score == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(text)), rel=1e-12)
        assert g.score <= 0
    seen = next(g for g in by_id[83] if g.n_tokens > 5)
    assert seen.score > seen.base_score  # a copy of a document
    assert ngram_lm.score_documents(frame(spark, [])).count() == 0


def test_score_against_brute_force(spark):
    """The filter's counts are the levels of the exact ones, but for a few that are read a level too high."""
    rows = [(i, t) for i, t in corpus(n=300) if i is not None]
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    one, two = Counter(), Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            one.update(tokens(text))
            two.update(zip([b"", *tokens(text)], tokens(text), strict=False))
    n, v = sum(one.values()), len(one)
    read = lambda c: float(ngram_lm.count_of(ngram_lm.level_of(np.array([c])))[0]) if c else 0.0
    level = {x: read(c) for x, c in (one | two).items()}

    def score(text):
        total, before = 0.0, b""
        for w in tokens(text):
            c, p = level.get(w, 0.0), level.get(before, 0.0)
            total += math.log10((min(level.get((before, w), 0.0), c, p) + ngram_lm.MASS * (c + 0.5) / (n + 0.5 * (v + 1))) / (p + ngram_lm.MASS))
            before = w
        return total

    got = ngram_lm.score_documents(frame(spark, rows)).collect()
    texts = defaultdict(set)
    for i, text in rows:
        texts[i].add(text)
    errors = [abs(g.score - score(t)) / abs(score(t)) for g in got for t in texts[g.doc_id] if len(texts[g.doc_id]) == 1]
    assert len(errors) > 250 and max(errors) < 0.15 and float(np.mean(errors)) < 0.04


def test_filter_never_reads_too_low_and_folds():
    r = np.random.default_rng(1)
    hashes = np.unique(r.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    counts = r.integers(1, 3000, len(hashes))
    one = ngram_lm.write_filter(hashes, counts)
    read = ngram_lm.CountFilter.of([one.tobytes()], []).counts(hashes, 0)
    want = ngram_lm.count_of(ngram_lm.level_of(counts))
    assert (read >= want - 1e-9).all() and (read > want + 1e-9).mean() < 0.35  # two probes of a filter that is half full
    absent = ngram_lm.CountFilter.of([one.tobytes()], []).counts(r.integers(0, 1 << 63, 20_000, dtype=np.uint64), 0)
    assert (absent > 0).mean() < 0.06
    small = ngram_lm.CountFilter.of([ngram_lm.fold(one, len(one) // 2).tobytes()], []).counts(hashes, 0)
    assert (small >= want - 1e-9).all()


def test_levels():
    counts = np.arange(1, 5000)
    levels = ngram_lm.level_of(counts)
    assert levels[0] == 1 and (np.diff(levels) >= 0).all()
    middle = ngram_lm.count_of(levels)
    assert (middle <= counts * 1.5).all() and (middle >= counts / 1.5).all()


# --- line dedup


def brute_lines(rows, min_words):
    """Texts as words, without those in a run of min_words words that stands at an earlier place."""
    docs = sorted(rows, key=lambda x: (x[0] is None, x[0]))
    first, left = {}, {}
    for d, (i, text) in enumerate(docs):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for a in range(len(words) - min_words + 1):
            at = first.setdefault(tuple(words[a : a + min_words]), (d, a))
            if at != (d, a):
                for x in range(max(a, at[1] + min_words) if at[0] == d else a, a + min_words):
                    gone[x] = True
        left[i] = None if text is None else [w.decode() for w, g in zip(words, gone, strict=True) if not g]
    return left


def test_passages_against_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(90):
        passages = [words(r, r.randint(30, 90), 5000) for _ in range(3)]
        rows.append([i, r.choice((" ", "\n")).join(passages)])
        if i % 3 == 1:  # within a line, wrapped otherwise, twice, and less than a passage
            source = rows[i - 1][1].split()
            a, n = r.randint(0, len(source) - 25), r.randint(10, 80)
            rows[i][1] += " " + "\n".join(source[a : a + n]) + " end of it"
        if i % 9 == 2:
            rows[i][1] += "\n" + rows[i][1] + "\n" + rows[0][1][:300]
    rows += [(200, "\n".join(["one line of six words here"] * 30)), (201, None), (202, ""), (203, " \n "), (204, "é ü " * 200)]
    for least in (20, 50):
        want = brute_lines(rows, least)
        got = {x.doc_id: x.text for x in line_dedup.drop_repeated_lines(frame(spark, rows).repartition(3), min_words=least).collect()}
        assert {i: None if t is None else t.split() for i, t in got.items()} == {i: None if w is None else " ".join(w).split() for i, w in want.items()}
    untouched = {i: t for i, t in rows if t is not None and len(t.encode().split()) == len(want[i])}
    assert len(untouched) > 40 and all(got[i] == t for i, t in untouched.items())


def test_passages_whose_lines_come_before_elsewhere(spark):
    """A line's first place may share less than a passage with later places that share more with each other."""
    r = random.Random(7)
    common = words(r, 40, 5000).split()
    rows = [(i, " ".join([words(r, 30, 5000), *common, words(r, 30, 5000)])) for i in range(2)]
    kinds = [(words(r, n, 5000).split(), words(r, m, 5000).split()) for n, m in ((30, 30), (0, 40), (40, 0), (5, 7), (12, 0))]
    for i in range(2, 40):
        before, after = kinds[i % 5]
        cut = r.randint(0, 20)
        rows.append((i if i % 7 else None, " ".join([words(r, 9, 5000), *before[cut:], *common, *after[: len(after) - cut // 2], words(r, 9, 5000)])))
    rows.append((41, " ".join([rows[3][1], rows[4][1], rows[3][1]])))
    for least in (20, 50):
        want = brute_lines(sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)), least)
        ids = [i for i, _ in rows if i is not None]
        got = {x.doc_id: x.text for x in line_dedup.drop_repeated_lines(frame(spark, rows).repartition(3), min_words=least).collect() if x.doc_id is not None}
        assert {i: got[i].split() for i in ids} == {i: want[i] for i in ids}


def test_winnowing_keeps_its_guarantee():
    """Few lines are selected, and of every run of min_words words a text selects the same lines as any other text."""
    r = random.Random(3)
    run = words(r, 50, 5000).encode()
    seen = set()
    for _ in range(50):
        text = b" ".join([words(r, r.randint(0, 70), 5000).encode(), run, words(r, r.randint(0, 70), 5000).encode()])
        hashes, ends = line_dedup.word_hashes([b"", text, b"x " * 60])
        at, fp = line_dedup.selected(hashes, ends)
        mine, begin = ends[1] - ends[0], text.decode().split().index(run.decode().split()[0])
        inside = {int(f) for a, f in zip(at, fp, strict=True) if begin <= a <= begin + 24}
        assert 0 < sum(a < mine for a in at) < mine / 5
        seen = seen & inside if seen else inside
    assert seen
    big = [bytes([97 + i % 26]) * (line_dedup._CHUNK // 3) + b" " + run for i in range(4)]  # words longer than a chunk
    one, _ = line_dedup.word_hashes(big)
    assert (one[1:51] == line_dedup.word_hashes([run])[0]).all() and len(set(one[::51].tolist())) == 4


@pytest.mark.parametrize(
    ("text", "spans", "left"),
    [("a b c d", [(1, 3)], "a d"), ("a b\nc d\ne", [(1, 3)], "a d\ne"), ("a b\nc d\ne", [(2, 4)], "a b\ne"), ("a b\nc", [(0, 1), (1, 2)], "c"), ("x a b\ny", [(1, 3)], "x\ny"), ("x a\n", [(0, 2)], ""), ("é a b \n", [(1, 3)], "é \n")],
)
def test_words_go_with_their_space(text, spans, left):
    assert line_dedup.without_words(text, spans) == left


def test_lines_keep_columns_and_rows(spark):
    long = " ".join(f"x{i}" for i in range(60))
    rows = [(2, f"own\n{long}"), (1, f"{long}\nother"), (None, f"{long}\nno id"), (3, "short\nshort"), (4, None), (5, f"in a {long} line"), (5, f"in a {long} line"), (5, "of the same id")]
    docs = frame(spark, rows).withColumn("__key", F.lit(1)).withColumn("__gone", F.lit("g")).withColumn("k", F.lit(2)).withColumn("gone", F.lit(3)).withColumn("at", F.lit(4))
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
    got = [(x.doc_id, x.text) for x in out.collect()]
    want = [(2, "own"), (1, f"{long}\nother"), (None, "no id"), (3, "short\nshort"), (4, None), (5, "in a line"), (5, "in a line"), (5, "of the same id")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all((x["__key"], x["__gone"], x.k, x.gone, x["at"]) == (1, "g", 2, 3, 4) for x in out.collect())
    assert line_dedup.drop_repeated_lines(frame(spark, [])).count() == 0


# --- SimHash


def brute_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_against_brute_force(spark):
    rows = [t for _, t in corpus()]
    for t in rows:
        assert simhash.fingerprint((t or "").encode()) == brute_fingerprint(t)
    some = spark.createDataFrame([(t,) for t in ("a b c", "é ü", "")], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(xxhash.xxh64_intdigest(r.t, 42) == r.h % (1 << 64) for r in some)


def test_links_against_brute_force(spark):
    r = random.Random(4)
    seeds = [r.getrandbits(64) for _ in range(150)]
    fps = set(seeds)
    for s in seeds:
        for _ in range(4):
            for b in r.sample(range(64), r.randint(1, 5)):
                s ^= 1 << b
            fps.add(s)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = sorted(signed(x) for x in fps)
    unsigned = [x % (1 << 64) for x in fps]
    want = {(fps[i], fps[j]) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (unsigned[i] ^ unsigned[j]).bit_count() <= 3}
    got = {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    assert got == want and len(want) > 50


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(500, n) for n in range(200, 260)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rows = corpus()
    got = simhash.near_duplicates(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    fps = {i: brute_fingerprint(t) for i, t in rows if i is not None}
    ids = sorted(fps)
    reach = {i: i for i in ids}
    for _ in ids:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and reach[b] > reach[a]:
                    reach[b], changed = reach[a], True
        if not changed:
            break
    for g in got:
        if g.doc_id is not None:
            assert (g.fingerprint, g.component_id) == (f"{fps[g.doc_id]:016x}", reach[g.doc_id])
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


# --- fingerprints


def brute_selected(point_hash, text):
    """The selected hashes with their positions, by definition: each run on its own, each window on its own."""
    digits = [point_hash[c] for c in text]
    if not digits:
        return ""
    digits += [0] * (fingerprints.K - len(digits))
    runs = []
    for i in range(len(digits) - fingerprints.K + 1):
        h = 0
        for j, d in enumerate(digits[i : i + fingerprints.K]):
            h ^= d << (fingerprints.K - 1 - j)
        runs.append(h >> 31 & 0xFFFFFFFF)
    out = []
    for i in range(max(1, len(runs) - fingerprints.W + 1)):
        window = runs[i : i + fingerprints.W]
        at = i + len(window) - 1 - window[::-1].index(min(window))
        if (runs[at], at) not in out:
            out.append((runs[at], at))
    return " ".join(f"{h:x}:{at}" for h, at in out)


def test_edits(spark):
    rows = corpus(n=40)
    got = fingerprints.fingerprint_edits(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    one = {i: t or "" for i, t in rows if i is not None and i != 3}
    order = sorted({i for i, _ in rows if i is not None})
    texts = {i: (t or "") for i, t in rows if i is not None}
    by_id = {g.doc_id: g for g in got if g.doc_id not in (None, 2, 3)}
    for g in by_id.values():
        t = one[g.doc_id]
        at = order.index(g.doc_id)
        following = texts[order[at + 1]] if at + 1 < len(order) else "no id here"
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    assert by_id[43].fingerprint == by_id[4].fingerprint  # a copy
    assert by_id[40].fingerprint == ""
    assert fingerprints.fingerprint_edits(frame(spark, [])).count() == 0
    single = fingerprints.fingerprint_edits(frame(spark, [(7, "abc def")])).collect()
    assert single[0].edited_sha256 == hashlib.sha256(b"abc abc").hexdigest() and single[0].near_next == 1.0
    nobody = fingerprints.fingerprint_edits(frame(spark, [(None, "a"), (None, "bb")])).collect()
    assert len(nobody) == 2


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_CHARS", 50)
    r = random.Random(8)
    rows = [(i * 7 - 300, words(r, r.randint(1, 30))) for i in range(90)]
    got = {g.doc_id: g.edited_sha256 for g in fingerprints.fingerprint_edits(frame(spark, rows).repartition(5)).collect()}
    for at, (i, t) in enumerate(rows):
        half = len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - half] + rows[(at + 1) % 90][1][:half]).encode()).hexdigest()


def test_selection_against_brute_force(spark):
    r = random.Random(6)
    texts = [words(r, n, 50)[:m] for n, m in ((0, 0), (1, 1), (9, 7), (9, 8), (9, 9), (20, 38), (20, 39), (20, 40), (90, 500))]
    texts += ["é😀 ü\n" * 30, "q" * 100, "".join(chr(0x4E00 + r.randint(0, 3000)) for _ in range(200))]
    points = sorted({c for t in texts for c in t})
    hashed = {x.c: x.h % (1 << 64) for x in spark.createDataFrame([(c,) for c in points], "c string").select("c", F.xxhash64("c").alias("h")).collect()}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprints.as_string(fingerprints.selected(F.col("t"))).alias("s")).collect()
    assert len(got) == len(texts)
    for x in got:
        assert x.s == brute_selected(hashed, x.t)


def test_edited_fingerprints_are_those_of_the_edited_texts(spark):
    r = random.Random(9)
    texts = [words(r, r.randint(0, 60), 50) for _ in range(40)] + ["", "x", "日本" * 70, "q" * 200, words(r, 400)]
    rows = [(t, o, k, n) for t, o in zip(texts, r.sample(texts, len(texts)), strict=True) for k in {0, min(1, len(t)), len(t) // 2, len(t)} for n in {0, min(38, len(o)), min(39, len(o)), min(40, len(o)), len(o) // 2, len(o)}]
    docs = spark.createDataFrame([(t, o, t[:k] + o[:n], k, n) for t, o, k, n in rows], "t string, o string, e string, k int, n int")
    chosen = lambda c: fingerprints.selected(F.col(c))
    made = fingerprints.selected_edited(chosen("t"), F.col("k"), chosen("o"), F.col("n"), F.col("e"))
    both = docs.select("k", "n", chosen("e").alias("a"), made.alias("b")).collect()
    assert len(both) > 500 and all(x.a == x.b for x in both)


def test_shared_runs_share_a_hash_in_any_script(spark):
    r = random.Random(10)
    run = "".join(chr(0x4E00 + r.randint(0, 3000)) for _ in range(fingerprints.SPAN))
    around = lambda: "".join(chr(0x4E00 + r.randint(0, 3000)) for _ in range(r.randint(0, 300)))
    docs = spark.createDataFrame([(around() + run + around(), around() + run + around()) for _ in range(60)], "a string, b string")
    h = lambda name: fingerprints.hashes(fingerprints.selected(F.col(name)))
    assert docs.filter(F.size(F.array_intersect(h("a"), h("b"))) == 0).count() == 0
    half = [(i, "".join(chr(0x4E00 + r.randint(0, 9000)) for _ in range(2000))) for i in range(8)]
    got = fingerprints.fingerprint_edits(frame(spark, half)).collect()
    assert min(g.near_edited for g in got) > 0.2 and max(g.near_next for g in got) < 0.05


def test_null_and_repeated_ids_are_dealt_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_CHARS", 500)
    r = random.Random(11)
    for rows in ([(None, words(r, 20)) for _ in range(60)], [(7, "the same text in every row " * 3)] * 60, [(r.choice((1, 2, None)), words(r, 20)) for _ in range(60)]):
        got = fingerprints.fingerprint_edits(frame(spark, rows).repartition(4)).collect()
        assert sorted(str(g.doc_id) for g in got) == sorted(str(i) for i, _ in rows)
        following = fingerprints.with_next(frame(spark, rows).repartition(4)).collect()
        assert sorted(f.text for f in following) == sorted(f.next_text for f in following) == sorted(t for _, t in rows)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            parts = fingerprints.with_next(frame(spark, rows).repartition(4)).select(F.spark_partition_id()).distinct().count()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert parts > 1 or len({t for _, t in rows}) == 1


def test_fingerprints_use_no_python(spark):
    plan = fingerprints.fingerprint_edits(frame(spark, corpus(n=5)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- toxicity


def labelled(seed=3, n=400):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.3
        text = words(r, r.randint(20, 60))
        if toxic:
            text += " idiot scum" if r.random() < 0.5 else " MORON, " + text
        rows.append((i, text))
        if i % 4:
            labels.append((i, int(toxic), "x"))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = labelled()
    docs, marks = frame(spark, rows), spark.createDataFrame([*labels, (None, 1, "y"), (5, None, "z")], "doc_id long, toxic int, text string")
    machine = toxicity.fit(docs, marks)
    got = {g.doc_id: g for g in toxicity.score_documents(docs, machine).collect()}
    truth = {i: t for i, t, _ in labels}
    held = [i for i in truth if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got.values())
    kept = toxicity.drop_toxic(docs, machine)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {i for i in got if not got[i].predicted}


def test_toxicity_starts_no_other_python_workers(spark, monkeypatch):
    """Rows that go through an RDD start Python workers besides those of the Arrow functions; they stay in an executor's memory."""
    rows, labels = labelled()
    docs, marks = frame(spark, rows), spark.createDataFrame([(i, t) for i, t, _ in labels], "doc_id long, toxic int")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert toxicity.fit(docs, marks).trained


def test_toxicity_learns_no_held_out_label(spark):
    rows, labels = labelled()
    docs = frame(spark, rows)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t, _ in labels]
    a = toxicity.fit(docs, spark.createDataFrame([(i, t) for i, t, _ in labels], "doc_id long, toxic int"))
    b = toxicity.fit(docs, spark.createDataFrame(turned, "doc_id long, toxic int"))
    assert a.terms == b.terms and (a.linear == b.linear).all() and a.intercept == b.intercept


def test_toxicity_edges(spark):
    rows, labels = labelled(n=40)
    none = toxicity.fit(frame(spark, rows), spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score_documents(frame(spark, [(1, None), (1, ""), (None, "x")]), none).collect()
    assert [(g.score, g.predicted) for g in got] == [(toxicity.NO_MODEL_SCORE, 0)] * 3
    assert toxicity.score_documents(frame(spark, []), none).count() == 0


def test_only_the_pair_tells(spark):
    """Toxic where one of two terms stands without the other: neither is more frequent in either label."""
    r = random.Random(1)
    rows, labels = [], []
    for i in range(3000):
        a, b = r.random() < 0.5, r.random() < 0.5
        text = words(r, r.randint(20, 60)).split() + ["slur"] * a + ["people"] * b
        r.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(a != b)))
    machine = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    truth = dict(labels)
    held = [g for g in toxicity.score_documents(frame(spark, rows), machine).collect() if g.held_out]
    assert sum(g.predicted == truth[g.doc_id] for g in held) > 0.95 * len(held)
    flat = toxicity.Machine(machine.terms, machine.intercept, machine.linear, machine.factors * 0, True)
    alone = [g for g in toxicity.score_documents(frame(spark, rows), flat).collect() if g.held_out]
    assert sum(g.predicted == truth[g.doc_id] for g in alone) < 0.75 * len(alone)
