import array
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import bpe, packing
from corpusloom.llm.chunk_tokens import ChunkTokenizer
from corpusloom.llm.queries import tokenizer_file

BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, score double, ids string, prompt string"


def odd_texts(n: int = 400) -> list[str]:
    rnd = random.Random(5)
    parts = ["a", "b", "é", " ", "  ", "\n", "'s", "'", "1", "23", "!", "\x1c", "\x85", "　", "Σ", "İ", "é", "日本", "<|endoftext|>", "<|startoftext|>", "\t", "ﬁ", "😀", "‍", "ß", "́", "the", "ing", "\x00", ".", ","]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(n)] + ["!" * 3000, "a" * 2000, " " * 100, "ab" * 999, ""]


def test_prefix_bpe_equals_the_library():
    ours, library = bpe.PrefixBpe(BYTE), Tokenizer.from_file(BYTE)
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        ids = ours.encode(text)
        assert array.array("I", ids).tolist() == want
        assert ours.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_known_pieces_can_be_let_go():
    ours, library = bpe.PrefixBpe(BYTE, keep=5), Tokenizer.from_file(BYTE)
    for text in odd_texts(60):
        assert array.array("I", ours.encode(text)).tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunk_tokens_equal_the_library():
    library = Tokenizer.from_file(WORD)
    for ours in (ChunkTokenizer(WORD), ChunkTokenizer(WORD, keep=5, hot=2)):
        for text in odd_texts():
            assert array.array("I", ours.encode(text)).tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunk_tokens_remember_so_many_words():
    """Within a long text too; what comes again stays known, and a forgotten word is learned again."""
    ours, library = ChunkTokenizer(WORD), Tokenizer.from_file(WORD)
    size = lambda: len(ours.known) + len(getattr(ours, "older", ()))
    texts = [" ".join(f"Again, w{i:x}z{i}q." for i in range(at, at + n)) for at, n in ((0, 20_000), (20_000, 200_000), (0, 1_000))]
    for text in texts:
        ids = ours.encode(text)
        assert size() <= 200_000 and len(ours.hot) <= 16_000
    assert array.array("I", ids).tolist() == library.encode(text, add_special_tokens=False).ids
    ours = ChunkTokenizer(WORD, keep=40, hot=0)
    for i in range(200):
        ours.encode(f"again w{i}")
        assert "again" in ours.known or "again" in ours.older


def test_encode_digests(spark):
    rows = [(1, "Hello there, world", 1.0, "x", "y"), (2, None, None, None, None), (2, "", 0.0, "", ""), (None, "ünï <|endoftext|> x", 0.0, "", "")]
    got = bpe.encode_digests(spark.createDataFrame(rows, SCHEMA), BYTE).collect()
    library = Tokenizer.from_file(BYTE)
    assert len(got) == 4
    for g, r in zip(sorted(got, key=lambda g: str(g)), sorted(got, key=lambda g: str(g)), strict=True):
        assert g == r
    by_id = defaultdict(list)
    for g in got:
        by_id[g.doc_id].append(g)
    for doc_id, text in ((1, rows[0][1]), (None, rows[3][1])):
        ids = library.encode(text, add_special_tokens=False).ids
        assert by_id[doc_id][0].n_tokens == len(ids)
        assert by_id[doc_id][0].ids_sha256 == hashlib.sha256(array.array("I", ids).tobytes()).hexdigest()
        assert by_id[doc_id][0].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert [g.n_tokens for g in by_id[2]] == [0, 0]
    assert bpe.encode_digests(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def test_encode_documents_round_trip(spark):
    texts = odd_texts(40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in bpe.encode_documents(docs, BYTE).collect():
        assert row.decoded == texts[row.doc_id]


def test_packer_keeps_every_limit():
    r = random.Random(3)
    for _ in range(300):
        tokens = r.choice([16, 64, 2048])
        segments, loss = r.choice([1, 2, 5, 128]), r.choice([tokens, tokens // 2, 7])
        sizes = [r.choice([1, 2, r.randint(1, tokens * 3)]) for _ in range(r.randint(0, 60))]
        prompts = [r.choice([0, 0, r.randint(0, tokens * 2)]) for _ in sizes]
        out = packing.BlockPacker(tokens, segments, loss).pack(sizes, prompts)
        got = defaultdict(list)
        for bin_ in out:
            assert bin_ and sum(p[2] for p in bin_) <= tokens and len(bin_) <= segments
            assert sum(packing.loss_of(p, prompts[p[0]]) for p in bin_) <= loss
            for d, at, length in bin_:
                assert length > 0
                got[d].append((at, length))
        for d, size in enumerate(sizes):
            at = 0
            for a, length in sorted(got[d]):
                assert a == at
                at += length
            assert at == size


def test_packer_refuses_limits_below_one():
    with pytest.raises(ValueError, match="limit"):
        packing.BlockPacker(0, 1, 1)


def test_pack_documents(spark):
    r = random.Random(9)
    texts = [None, "", "x", " ".join(r.choice(["the", "Quick", "brown", "fox,"]) for _ in range(9000))]
    texts += [" ".join(r.choice(["lorem", "ipsum", "dolor", "42"]) for _ in range(r.randint(1, 900))) for _ in range(60)]
    rows = [(i, t, 0.0, "ids", "p") for i, t in enumerate(texts)] + [(5, texts[5], 0.0, "", ""), (None, "no id", 0.0, "", "")]
    out = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), WORD, with_ids=True).collect()
    library = Tokenizer.from_file(WORD)
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in out:
        sequences[p.sequence_id].append(p)
        documents[p.doc_id].append(p)
        assert p.length == len(p.ids) and zlib.crc32(array.array("I", p.ids).tobytes()) == p.ids_crc32
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at == pieces[0].sequence_length
    total = sum(p.length for p in out)
    padded = sum(n if n & (n - 1) == 0 else 2048 for n in (s[0].sequence_length for s in sequences.values()))
    assert padded <= 1.01 * total
    for i, t in enumerate(texts):
        want = [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        pieces = sorted(documents[i], key=lambda p: p.start)
        assert {p.doc_tokens for p in pieces} == {len(want)}
        ids = [x for p in pieces for x in p.ids]
        assert ids == want if i != 5 else sorted(ids) == sorted(want * 2)
    assert documents[None]
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), WORD).count() == 0


def test_prompts_bear_no_loss(spark):
    docs = spark.createDataFrame([(i, "a b c d e f", 4) for i in range(50)], "doc_id long, text string, p long")
    out = packing.pack_documents(docs, WORD, prompt_col="p", max_loss=9, max_segments=4).groupBy("sequence_id").agg(F.sum("loss_tokens").alias("loss"), F.count("*").alias("n")).collect()
    assert all(r.loss <= 9 and r.n <= 4 for r in out)
