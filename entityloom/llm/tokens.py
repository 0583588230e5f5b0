"""Token ids of whole texts by the tokenizers library, with a bounded memory of words.

For the vocabulary ``word_bpe_49k.json`` no token spans white space and no rule
of its normaliser looks across it, so a text's ids are those of its words in
turn. Words repeat, so each task asks the library once per word it has not met
lately. Texts of ASCII and Latin letters are cut further, into the pieces that
the library cuts them into: words with and without a comma behind them are then
one. They are cut and numbered by numpy and Arrow, a chunk of texts at once, and
Python sees each piece once per chunk. A text with control characters that
Python but not the library takes for white space goes to the library whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa

from entityloom.llm.workers import kept, trim

WORD_TOKENIZER = "word_bpe_49k.json"
#: Words kept in memory per worker, in two generations: words met lately stay.
MEMORY_WORDS = 400_000
#: Texts outside the simple kind whose new words are asked for together.
BATCH_TEXTS = 256
#: Bytes of texts that are cut together (and the text that passes them).
CHUNK_BYTES = 1 << 21
#: Words that go to the library as one text.
ASK_WORDS = 4096
#: Texts after which a worker returns what asking for words has left free.
TRIM_TEXTS = 512
UNSURE = "\x1c\x1d\x1e\x1f"
#: A word that is one piece to the library, which ends with a token of its own kind.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
WORD_END = "</w>"
#: Kinds of bytes in texts whose lower case and pieces are beyond doubt: ASCII and
#: composed Latin letters. The pieces are by the vocabulary's own rule of cutting:
#: letters, single digits, other marks, and an apostrophe with a fixed ending.
SPACE, LETTER, DIGIT, MARK, DOUBT = range(5)
KINDS = np.full(256, MARK, dtype=np.uint8)
KINDS[list(b" \t\n\r\f\v")] = SPACE
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = LETTER
KINDS[list(b"0123456789")] = DIGIT
#: Unsure characters, lead bytes of other letters, and what follows 0xC3 in the signs for times and divided.
KINDS[[*UNSURE.encode(), *range(0xC0, 0xC3), *range(0xC4, 0x100), 0x97, 0xB7]] = DOUBT
LOWER = np.arange(256, dtype=np.uint8)
LOWER[[*range(0x41, 0x5B), *range(0x80, 0x9F)]] += 0x20
ENDINGS_1, ENDINGS_2 = b"stmd", (b"re", b"ve", b"ll")
#: Marks behind letters (but no apostrophe): the library always cuts between them.
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")


def default_tokenizer(name: str = WORD_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _words(text: str) -> list[str] | None:
    """What a text's ids can be joined from; a text that must go whole has none."""
    return None if any(c in text for c in UNSURE) else text.split()


def _cut(data: np.ndarray, cuts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-case pieces of the texts between ``cuts``, the first piece of each text, and the texts in doubt.

    Texts in doubt have no pieces. A special token's marks, which are looked
    for before the case is changed, put a text in doubt.
    """
    kind = KINDS[data]
    doubt = np.concatenate(
        [np.flatnonzero(kind == DOUBT), np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))]
    )
    doubted = np.unique(np.searchsorted(cuts, doubt, side="right") - 1)
    for k in doubted.tolist():
        kind[cuts[k] : cuts[k + 1]] = SPACE
    starts = np.ones(len(data), dtype=bool)
    starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    starts[cuts[:-1][cuts[:-1] < len(data)]] = True
    starts &= kind != SPACE
    low = LOWER[data]
    apostrophes = np.flatnonzero((low == ord("'")) & starts)
    if len(apostrophes):
        left = cuts[np.searchsorted(cuts, apostrophes, side="right")] - apostrophes - 1
        padded = np.concatenate([low, np.zeros(2, dtype=np.uint8)])
        one, two = padded[apostrophes + 1], padded[apostrophes + 2]
        length = np.where((left > 0) & np.isin(one, list(ENDINGS_1)), 1, 0)
        for first, second in ENDINGS_2:
            length[(left > 1) & (one == first) & (two == second)] = 2
        at, length = apostrophes[length > 0], length[length > 0]
        starts[at + 1] = False
        behind = at + 1 + length
        behind = behind[behind < len(data)]
        starts[behind] = kind[behind] != SPACE
    kept_bytes = kind != SPACE
    low = low[kept_bytes]
    offsets = np.append(np.flatnonzero(starts[kept_bytes]), len(low))
    pieces = pa.Array.from_buffers(
        pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(low)]
    )
    return pieces, np.searchsorted(np.flatnonzero(starts), cuts), doubted


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, memory_words: int = MEMORY_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence as InTurn, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # The same model for lower-case letters, which no rule of the vocabulary changes or cuts:
        # of ASCII, which stand for their own bytes, and of Latin ones.
        self.plain, self.latin = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        self.latin.pre_tokenizer = InTurn(
            [WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.memory: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.memory_words = memory_words
        self.since_trim = 0

    def _ask(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [as_bytes(x.ids) for x in found]

    def _ask_letters(self, words: list[str], tokenizer) -> list[bytes]:
        """Words of letters go as one text, which spares an answer for each."""
        if len(words) > ASK_WORDS:
            parts = (words[i : i + ASK_WORDS] for i in range(0, len(words), ASK_WORDS))
            return [x for part in parts for x in self._ask_letters(part, tokenizer)]
        raw = as_bytes(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids)
        ends = 4 * (np.flatnonzero(self.ends[as_ids(raw)]) + 1)
        if len(ends) != len(words):
            return self._ask(words)
        cuts = [0, *ends.tolist()]
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, words: set[str]) -> None:
        """Have all ``words`` in memory; what was not met since the last change of generation goes."""
        missing = words.difference(self.memory)
        if len(self.memory) + 2 * len(missing) > self.memory_words // 2:
            self.earlier, self.memory, missing = self.memory, {}, words
        memory, earlier = self.memory, self.earlier
        known = missing.intersection(earlier)
        memory.update(zip(known, map(earlier.__getitem__, known)))  # noqa: B905 - of one length
        new = missing.difference(known)
        plain = {w for w in new if w.isascii() and w.isalpha() and w.islower()}
        latin: set[str] = set()
        letters: set[str] = set()
        others: set[str] = set()
        pairs = []
        for w in new.difference(plain):
            core = w.rstrip(MARKS)
            if not core.isalpha() or not (core.isascii() or LETTERS.fullmatch(core)):
                others.add(w)
            elif len(core) == len(w):
                (latin if w.islower() else letters).add(w)
            else:
                tail = w[len(core) :]
                pairs.append((w, core, tail))
                letters.add(core)
                others.add(tail)
        for asked, ask in (
            (plain, partial(self._ask_letters, tokenizer=self.plain)),
            (latin, partial(self._ask_letters, tokenizer=self.latin)),
            (letters, partial(self._ask_letters, tokenizer=self.tokenizer)),
            (others, self._ask),
        ):
            here = [w for w in asked if w not in memory]
            if here:
                memory.update(zip(here, ask(here)))  # noqa: B905 - of one length
        for w, core, tail in pairs:
            memory[w] = memory[core] + memory[tail]

    def _encode_each(self, texts: Sequence[str]) -> list[bytes]:
        """Texts of any kind; those of a batch ask for their new words together."""
        out = []
        for first in range(0, len(texts), BATCH_TEXTS):
            part = texts[first : first + BATCH_TEXTS]
            split = [_words(t) for t in part]
            self._learn(set().union(*(w for w in split if w)))
            known = self.memory.__getitem__
            for text, words in zip(part, split, strict=True):
                out.append(self._ask([text])[0] if words is None else b"".join(map(known, words)))
        return out

    def _encode_chunk(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces, first_piece, doubted = _cut(data, cuts)
        found = pieces.dictionary_encode()
        words = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(set(words))
        raw = list(map(self.memory.__getitem__, words))
        known = as_ids(b"".join(raw))
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4
        begin = np.cumsum(size) - size
        number = found.indices.to_numpy()
        n = size[number]
        ends = np.cumsum(n)
        ids = known[np.repeat(begin[number] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.append(0, ends)[first_piece]
        counts = np.diff(bounds)
        if len(doubted):
            whole = self._encode_each([data[cuts[k] : cuts[k + 1]].tobytes().decode() for k in doubted.tolist()])
            parts, at = [], 0
            for k, own in zip(doubted.tolist(), map(as_ids, whole), strict=True):
                parts += [ids[at : bounds[k]], own]
                at = bounds[k]
                counts[k] = len(own)
            ids = np.concatenate([*parts, ids[at:]])
        return ids, counts

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) one behind the other, and how many each text has.

        With ``end_id``, this id ends every text.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        rows = len(texts)
        cuts = np.frombuffer(offsets or bytes(8), dtype=np.int64)[texts.offset : texts.offset + rows + 1]
        data = np.frombuffer(data or b"", dtype=np.uint8)
        found, counts = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        first = 0
        while first < rows:
            last = min(rows, int(np.searchsorted(cuts, cuts[first] + CHUNK_BYTES, side="right")))
            ids, n = self._encode_chunk(data[cuts[first] : cuts[last]], cuts[first : last + 1] - cuts[first])
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
            found.append(ids)
            counts.append(n)
            self.since_trim += last - first
            first = last
            if self.since_trim >= TRIM_TEXTS:
                self.since_trim = 0
                trim()
        return np.concatenate(found), np.concatenate(counts)

    def encode_all(self, texts: Sequence[str] | pa.Array, end_id: int | None = None) -> list[bytes]:
        """One value per text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        ids, n = self.encode_column(column, end_id)
        raw, cuts = ids.tobytes(), [0, *(4 * np.cumsum(n)).tolist()]
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def slices(batches, rows: int = 1000):
    """Record batches of at most so many rows, so that what is made of them stays small."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder; its memory of words outlives a task."""
    return kept(("words", path), lambda: WordEncoder(path))


def as_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4")


def as_bytes(ids: Sequence[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()
