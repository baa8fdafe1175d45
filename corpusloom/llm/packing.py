"""Vector bin packing of documents into training sequences.

A document's ids are cut where they exceed a sequence; what is left over is an item with a size in
three dimensions (tokens, segments, loss-bearing tokens). Bins are filled one at a time by the
dot-product heuristic: of all items that fit in every dimension, the one whose size vector has the
largest dot product with the bin's free room goes in. A gap that no item fits is filled with the
head of a larger item. A bin left with another length than the full one is dealt out over powers
of two, which need no padding.

Every task packs the rows it has, block by block, so there is no shuffle and memory is bounded by
one block, however many rows there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import chunk_tokens
from corpusloom.runtime import bound_arrow_batches

END_ID = 1
MAX_TOKENS, MAX_SEGMENTS = 2048, 128
BLOCK_TOKENS = 2 << 20
#: No head shorter than this is cut from an item to fill a gap.
SHORTEST_CUT = 8

Piece = tuple[int, int, int]  # document's place in the block, start, length


class BlockPacker:
    """Packs one block of documents. Sizes are tokens; a document's first `prompt` tokens bear no loss."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int):
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("every limit must be at least 1")
        self.max_tokens, self.max_segments, self.max_loss = max_tokens, max_segments, max_loss

    def pack(self, sizes: list[int], prompts: list[int]) -> list[list[Piece]]:
        done: list[list[Piece]] = []
        items = _Items()
        for d, (n, p) in enumerate(zip(sizes, prompts, strict=True)):
            at = 0
            while at < n:
                length = self._reach(at, n, p, self.max_tokens, self.max_loss)
                if length == self.max_tokens:
                    done.append([(d, at, length)])
                else:
                    items.add((d, at, length), loss_of((d, at, length), p))
                at += length
        items.settle()
        while items.count:
            done += self._to_powers(self._fill(items, prompts))
        return done

    @staticmethod
    def _reach(at: int, end: int, prompt: int, tokens: int, loss: int) -> int:
        """Tokens from `at` that room for so many tokens and loss-bearing tokens holds."""
        return min(end - at, tokens, max(0, prompt - at) + loss)

    def _fill(self, items: _Items, prompts: list[int]) -> list[Piece]:
        tokens, segments, loss, bin_ = self.max_tokens, self.max_segments, self.max_loss, []
        while segments and (k := items.best(tokens, loss, tokens / self.max_tokens**2, segments / self.max_segments**2, loss / self.max_loss**2)) >= 0:
            piece = items.take(k)
            bin_.append(piece)
            tokens, segments, loss = tokens - piece[2], segments - 1, loss - loss_of(piece, prompts[piece[0]])
        if segments and tokens >= SHORTEST_CUT and items.count:
            d, at, length = items.take(items.largest())
            head = self._reach(at, at + length, prompts[d], tokens, loss)
            head = head if head >= SHORTEST_CUT else 0
            if head:
                bin_.append((d, at, head))
            if head < length:
                rest = (d, at + head, length - head)
                items.add(rest, loss_of(rest, prompts[d]))
                items.settle()
        return bin_

    def _to_powers(self, bin_: list[Piece]) -> list[list[Piece]]:
        total = sum(p[2] for p in bin_)
        if total > self.max_tokens - SHORTEST_CUT:
            return [bin_]
        out, todo = [], bin_[::-1]
        while total:
            want = 1 << (total.bit_length() - 1)
            total -= want
            part = []
            while want:
                d, at, length = todo.pop()
                take = min(length, want)
                part.append((d, at, take))
                want -= take
                if take < length:
                    todo.append((d, at + take, length - take))
            out.append(part)
        return out


def loss_of(piece: Piece, prompt: int) -> int:
    return max(0, piece[1] + piece[2] - max(piece[1], prompt))


class _Items:
    """Items by kind, that is by tokens and loss-bearing tokens; each is one segment."""

    def __init__(self) -> None:
        self.place: dict[tuple[int, int], int] = {}
        self.pieces: list[list[Piece]] = []
        self.count = 0
        self.size: list[tuple[int, int]] = []
        self.tokens = self.loss = np.zeros(0)

    def add(self, piece: Piece, loss: int) -> None:
        k = self.place.setdefault((piece[2], loss), len(self.pieces))
        if k == len(self.pieces):
            self.pieces.append([])
        self.pieces[k].append(piece)
        self.count += 1
        if k < len(self.tokens):
            self.tokens[k], self.loss[k] = self.size[k]

    def settle(self) -> None:
        """Arrays for kinds that came since; a kind without items is too large for any bin."""
        if len(self.tokens) < len(self.pieces):
            self.size = list(self.place)
            held = [bool(p) for p in self.pieces]
            self.tokens = np.array([t if h else np.inf for (t, _), h in zip(self.size, held, strict=True)], dtype=np.float64)
            self.loss = np.array([x if h else np.inf for (_, x), h in zip(self.size, held, strict=True)], dtype=np.float64)

    def best(self, tokens: int, loss: int, by_token: float, by_segment: float, by_loss: float) -> int:
        """The kind that fits and has the largest dot product with the room; -1 if none fits."""
        fits = np.flatnonzero((self.tokens <= tokens) & (self.loss <= loss))
        if not len(fits):
            return -1
        return int(fits[np.argmax(self.tokens[fits] * by_token + self.loss[fits] * by_loss + by_segment)])

    def largest(self) -> int:
        return int(np.argmax(np.where(np.isinf(self.tokens), -1, self.tokens)))

    def take(self, k: int) -> Piece:
        piece = self.pieces[k].pop()
        self.count -= 1
        if not self.pieces[k]:
            self.tokens[k] = self.loss[k] = np.inf
        return piece


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int | None = None,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pack whole documents into sequences; one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length and
    loss_tokens; with `with_ids` also the ids. `prompt_col` counts a document's leading tokens that
    bear no loss (absent or null: none); `max_loss` limits the loss-bearing tokens of a sequence.

    Null and empty texts are a document of the end id alone. A null id stays null; repeated rows are
    packed once each; an empty table gives no rows; other columns are ignored.
    """
    bound_arrow_batches(docs.sparkSession)
    loss_limit = max_loss or max_tokens
    prompt = F.coalesce(F.col(prompt_col).cast("long"), F.lit(0)) if prompt_col else F.lit(0).cast("long")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), prompt.alias("prompt"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, loss_tokens long"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chunk_tokens.shared(tokenizer_path)
        packer = BlockPacker(max_tokens, max_segments, loss_limit)
        end = np.array([end_id], dtype="<u4").tobytes()
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held: list[tuple[int | None, bytes, int]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            sizes = [len(x[1]) // 4 for x in held]
            prompts = [max(0, x[2]) for x in held]
            rows = []
            for pieces in packer.pack(sizes, prompts):
                offset, whole = 0, sum(p[2] for p in pieces)
                for piece in pieces:
                    d, at, length = piece
                    own = memoryview(held[d][1])[at * 4 : (at + length) * 4]
                    row = (held[d][0], at, length, zlib.crc32(own), sizes[d], sequence, offset, whole, loss_of(piece, prompts[d]))
                    rows.append((*row, np.frombuffer(own, dtype="<i4")) if with_ids else row)
                    offset += length
                sequence += 1
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, type=pa.int64()) for c in columns[:9]] + [pa.array(c, type=pa.list_(pa.int32())) for c in columns[9:]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "loss_tokens", "ids"]
            return pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

        for batch in batches:
            ids, texts, prompts = (batch.column(i).to_pylist() for i in range(3))
            for doc_id, text, p in zip(ids, texts, prompts, strict=True):
                own = tokenizer.encode(text)
                held.append((doc_id, own + end, p))
                tokens += len(own) // 4 + 1
                if tokens >= BLOCK_TOKENS:
                    yield flush()
                    held.clear()
                    tokens = 0
        if held:
            yield flush()

    return narrow.mapInArrow(run, schema)
