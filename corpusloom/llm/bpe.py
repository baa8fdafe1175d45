"""Byte-level BPE by dynamic programming over prefixes.

Whether a text's encoding may end in a token t depends on one thing: that t and the last token of
what stands before it are an encoding of their own. So every prefix of a pre-token has one last
token, found among the tokens that end there (an automaton over all tokens reports them, longest
first) by testing each against the stored last token of the shorter prefix. Following the stored
tokens back from the end gives the exact ids in time linear in the matches, with no merge loop.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import bound_arrow_batches

# The public byte-level pre-tokenizer's pattern and its printable stand-ins for bytes.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

#: Pieces of a text whose tokens don't depend on what stands around them: a run of other than
#: white space with the one blank before it, or white space.
_SPACE = "\t-\r \x85\xa0  -     　"
PIECE = regex.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def byte_letters() -> dict[str, int]:
    """Stand-in letter -> byte: printable bytes stand for themselves, the rest follow from U+0100 on."""
    rest = [b for b in range(256) if b not in PRINTABLE]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}

#: Characters of a piece that is remembered at most: with their number, this bounds the memory.
LONGEST = 64


class PrefixBpe:
    """Encoder and decoder of one vocabulary file (a tokenizers JSON with a byte-level BPE model)."""

    def __init__(self, path: str, keep: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        id_of: dict[bytes, int] = {}
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes_of[i] = to_bytes(token)
                id_of[self.bytes_of[i]] = i
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        # rank: when a token comes to be; halves: of what. Single bytes exist from the start.
        self.rank, self.halves = [-1] * size, [(-1, -1)] * size
        self.joins: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = (id_of[to_bytes(x)] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            t = id_of[self.bytes_of[a] + self.bytes_of[b]]
            self.joins[a, b] = r
            if self.rank[t] < 0:
                self.rank[t], self.halves[t] = r, (a, b)
        self.automaton = ahocorasick.Automaton()
        for token, i in id_of.items():
            if len(token) == 1 or self.rank[i] >= 0:
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.pre_token = regex.compile(PRE_TOKEN)
        self.special_split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.keep = keep
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens together encode to just these two."""
        key = (left, right)
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) > self.keep:
                self.pairs.clear()
            found = self.pairs[key] = self._boundary_holds(left, right)
        return found

    def _boundary_holds(self, left: int, right: int) -> bool:
        """Undo merges from the last to the first; at each moment no merge may bridge the boundary.

        `until` is the rank from which on the present neighbours are no longer there.
        """
        until = 1 << 60
        rank, halves, joins = self.rank, self.halves, self.joins
        while True:
            if joins.get((left, right), until) < until:
                return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            # of two merges of one rank, the left one happens first
            if rank[left] > rank[right]:
                until = rank[left]
                left = halves[left][1]
            else:
                until = rank[right] + 1
                right = halves[right][0]

    def pre_token_ids(self, piece: bytes) -> list[int]:
        last = [-1] * (len(piece) + 1)
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            if last[end + 1] < 0:
                start = end + 1 - length
                if not start or (last[start] >= 0 and self.compatible(last[start], token)):
                    last[end + 1] = token
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return ids[::-1]

    def _piece_ids(self, piece: str) -> bytes:
        ids = [i for word in self.pre_token.findall(piece) for i in self.pre_token_ids(word.encode())]
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.keep:  # those first seen are the frequent ones
            self.known = dict(itertools.islice(self.known.items(), self.keep // 2))
        known = self.known
        out = []
        for part in self.special_split.split(text) if self.special_split else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
                continue
            pieces = PIECE.findall(part)
            try:
                out.append(b"".join(map(known.__getitem__, pieces)))
            except KeyError:
                for p in pieces:
                    if (ids := known.get(p)) is None:
                        ids = self._piece_ids(p)
                        if len(p) <= LONGEST:
                            known[p] = ids
                    out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of the ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def shared(path: str) -> PrefixBpe:
    """One for each worker process: workers are used again by later tasks, which then know their words."""
    return PrefixBpe(path)


def _encoded(docs: DataFrame, vocabulary_path: str, id_col: str, text_col: str, schema: str, types: list[pa.DataType], columns) -> DataFrame:
    bound_arrow_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    names = [column.split(" ")[0] for column in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(vocabulary_path)
        for batch in batches:
            rows = [columns(bpe, t) for t in batch.column(1).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), types, strict=True))], names)

    return narrow.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded of every whole text.

    A null or empty text has no ids and decodes to the empty text; null ids stay; repeated rows are
    encoded once each; an empty table gives no rows; other columns are ignored.
    """

    def columns(bpe: PrefixBpe, text: str):
        ids = bpe.encode(text)
        return np.frombuffer(ids, dtype="<i4").tolist(), bpe.decode(ids)

    return _encoded(docs, vocabulary_path, id_col, text_col, "doc_id long, ids array<int>, decoded string", [pa.list_(pa.int32()), pa.string()], columns)


def encode_digests(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of `encode_documents`, made where
    the ids are, so that neither ids nor decoded texts leave the worker."""

    def columns(bpe: PrefixBpe, text: str):
        ids = bpe.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()

    return _encoded(docs, vocabulary_path, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()], columns)
