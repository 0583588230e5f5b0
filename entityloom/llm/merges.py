"""Token counts by byte-pair merging with a heap and a linked list (operator 9).

A word's symbols form a doubly linked list; a heap holds the adjacent pairs
that have a rank. The lowest rank, leftmost first, is merged again and again.
A text's count is its initial symbols minus the merges: no ids are made.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from entityloom.llm.tokens import default_tokenizer
from entityloom.llm.workers import kept

BYTE_TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Chunks remembered per worker before the memory is emptied; longer ones are not kept.
MEMORY_CHUNKS = 600_000
MEMORY_LENGTH = 48
#: White space as the library sees it (Python's own class has four more).
SPACE_POINTS = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE = re.escape("".join(map(chr, SPACE_POINTS)))
#: Runs that no word of the library's pattern crosses.
CHUNKS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Fixed by the vocabulary: how a chunk is split into words.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary's merges."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(shown))
    return [letters[b] for b in range(256)]


def count_merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges the ranks allow on one word."""
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if symbols[i] == left else n
        if j >= n or symbols[j] != right:
            continue  # one of the two has changed since
        merges += 1
        symbols[i] = left + right
        symbols[j] = ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get((symbols[i], symbols[k]))
            if rank is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0:
            rank = ranks.get((symbols[h], symbols[i]))
            if rank is not None:
                heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
    return merges


class TokenCounter:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        self.words = regex.compile(WORDS)
        special = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.memory: dict[str, int] = {}

    def word(self, word: str) -> int:
        symbols = [self.letters[b] for b in word.encode("utf-8", "replace")]
        return len(symbols) - count_merges(symbols, self.ranks)

    def _plain(self, text: str) -> int:
        chunks = CHUNKS.findall(text)
        memory, total = self.memory, 0
        if len(memory) > MEMORY_CHUNKS:
            memory.clear()
        for chunk in set(chunks).difference(memory):
            memory[chunk] = sum(map(self.word, self.words.findall(chunk)))
        total = sum(map(memory.__getitem__, chunks))
        for chunk in {c for c in chunks if len(c) > MEMORY_LENGTH}:
            del memory[chunk]
        return total

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def n_tokens(text: Column, tokenizer: str | None = None) -> Column:
    """Tokens of each whole text; null counts as empty and has none.

    A special token's string inside a text is one token, as the library has it
    by default.
    """
    path = tokenizer or default_tokenizer(BYTE_TOKENIZER)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = kept(("merges", path), lambda: TokenCounter(path))
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return counted(F.coalesce(text, F.lit("")))
