"""Token ids of whole texts by the tokenizers library, remembered per white-space chunk."""

from __future__ import annotations

import array
import functools
import itertools
import operator
import re
import unicodedata

import regex

from corpusloom.llm.bpe import byte_letters

#: White space as the tokenizer file's \s has it: str.split() without U+001C to U+001F.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")

# Fixed value: the tokenizer file's pattern of words.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Characters of a chunk that is remembered at most: with their number, this bounds the memory.
LONGEST = 64
#: Chunks and words that a worker remembers at most.
KEEP = 200_000


class ChunkTokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    For a tokenizer that lower-cases, drops white space and marks word ends, the ids of a text are
    those of its white-space chunks in order, and those of a chunk are those of its words. Chunks
    and words are remembered within a bound (a word is the chunk of itself), the first of them in a
    memory of their own that stays small; new words go to the library's model. When half the bound is
    full it becomes the older half, whose words are dropped unless they come again before the next is.
    """

    def __init__(self, path: str, keep: int = KEEP, hot: int = 16_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        special = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or "(?!)")
        self.letters = {b: c for c, b in byte_letters().items()}
        self.keep, self.most_hot = keep, hot
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.hot: dict[str, bytes] = {}

    def _learn_word(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.letters)
        ids = array.array("I", [t.id for t in self.tokenize(letters)]).tobytes()
        self._remember(word, ids)
        return ids

    def _remember(self, chunk: str, ids: bytes) -> None:
        if len(chunk) <= LONGEST:
            if len(self.known) >= self.keep // 2:
                self.known, self.older = {}, self.known
            self.known[chunk] = ids

    def _remembered(self, chunk: str) -> bytes | None:
        ids = self.known.get(chunk)
        if ids is None and (ids := self.older.get(chunk)) is not None:
            self._remember(chunk, ids)
        return ids

    def _words(self, chunk: str) -> list[str]:
        """A chunk's words as the tokenizer file's normalizer and pattern give them."""
        body, tail = (chunk[:-1], [chunk[-1]]) if chunk[-1] in ".," else (chunk, [])
        if body.isalpha() and (body.isascii() or "Σ" not in body and unicodedata.is_normalized("NFC", body)):
            low = body.lower()
            if low.isalpha():
                return [low, *tail]
        return _WORD.findall(self.library.normalizer.normalize_str(chunk))

    def _learn(self, chunk: str) -> bytes:
        if self.special.search(chunk):
            ids = array.array("I", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()
        else:
            ids = b"".join([self._remembered(w) or self._learn_word(w) for w in self._words(chunk)])
        self._remember(chunk, ids)
        if len(chunk) <= LONGEST and len(self.hot) < self.most_hot:
            self.hot[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        chunks = [c for c in _SPACE.split(text) if c] if _ODD.search(text) else text.split()
        ids = list(map(self.hot.get, chunks))
        if None in ids:
            rare = list(itertools.compress(chunks, map(operator.not_, ids)))
            more = list(map(self.known.get, rare))
            if None in more:
                get, learn = self._remembered, self._learn
                # a chunk may come again in the same text
                more = [get(c) or learn(c) if x is None else x for c, x in zip(rare, more, strict=True)]
            fill = iter(more)
            ids = [next(fill) if x is None else x for x in ids]
        return b"".join(ids)


@functools.lru_cache(maxsize=2)
def shared(path: str) -> ChunkTokenizer:
    """One for each worker process: workers are used again by later tasks, which then know their words."""
    return ChunkTokenizer(path)
