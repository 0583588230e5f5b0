"""Language identification by cross-parsing against suffix automata (operator 5).

Each language is a suffix automaton over a bounded sample of labelled text. A
text is parsed greedily: the longest match with the sample is one phrase, the
next phrase starts behind it. Few phrases mean that the sample predicts the
text. Phrases are weighted by the bits that name one (the logarithm of the
sample's length), and the language with the fewest bits a symbol wins.

Letters are lower-cased; all else is one blank. Whole texts are parsed, in
blocks of ``BLOCK`` symbols side by side: a phrase ends with its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityloom.llm.workers import give_back, kept

UNKNOWN = "und"
#: Symbols of sample text per language, and in all.
SAMPLE_SYMBOLS = 32_000
ALL_SYMBOLS = 512_000
#: Documents looked at per language to fill the sample (on average).
SAMPLE_DOCUMENTS = 256
#: Columns of a dense table: blank, a letter the sample lacks, and a language's most frequent
#: letters. The transitions of its other letters are kept as sorted pairs; no letter is merged.
DENSE = 64
BLOCK = 256
#: Code points parsed together.
BATCH = 1 << 19


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from; a missing id is not held out (nor learned from)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, symbols: int = SAMPLE_SYMBOLS) -> dict[str, str]:
    """Sample text per language, from rows with text, language and an id that is not held out.

    Documents are chosen by the hash of their id, so the choice does not depend
    on their order; the driver gets about ``SAMPLE_DOCUMENTS`` texts a language.
    """
    known = docs.filter(
        F.col("lang").isNotNull()
        & F.col("text").isNotNull()
        & F.col("doc_id").isNotNull()
        & ~held_out()
    )
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    symbols = min(symbols, max(1, ALL_SYMBOLS // len(counts)))
    share = [x for k, n in counts.items() for x in (F.lit(k), F.lit(SAMPLE_DOCUMENTS / n))]
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = (
        known.withColumn("_place", place)
        .filter(F.col("_place") < F.create_map(*share)[F.col("lang")] * (1 << 30))
        .select("lang", "_place", "doc_id", F.substring("text", 1, symbols).alias("text"))
        .collect()
    )
    samples: dict[str, str] = {}
    for r in sorted(chosen, key=lambda r: (r.lang, r._place, r.doc_id, r.text)):
        if len(samples.get(r.lang, "")) < symbols:
            samples[r.lang] = samples.get(r.lang, "") + " " + r.text.lower()
    return {k: v[:symbols] for k, v in samples.items()}


def automaton_moves(sequence: np.ndarray) -> list[dict[int, int]]:
    """Transitions of all substrings, per state; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in sequence.tolist():
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return moves


def suffix_automaton(sequence: np.ndarray, width: int) -> np.ndarray:
    """Transitions [state, symbol] of all substrings; 0, the start, also marks a missing one."""
    return dense_moves(automaton_moves(sequence), width)


def dense_moves(moves: list[dict[int, int]], width: int) -> np.ndarray:
    """Transitions by symbols below ``width`` as a table."""
    table = np.zeros((len(moves), width), dtype=np.int32)
    for state, row in enumerate(moves):
        for c, target in row.items():
            if c < width:
                table[state, c] = target
    return table


class Automaton:
    """One language's transitions over its own columns: 0 blank, 1 absent, then its letters."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        found, counts = np.unique(sequence[sequence > 1], return_counts=True)
        own = found[np.lexsort((found, -counts))]
        self.column = np.ones(symbols, dtype=np.int32)  # of a symbol; no transition leads on by 1
        self.column[0] = 0
        self.column[own] = np.arange(2, len(own) + 2)
        moves = automaton_moves(self.column[sequence])
        self.width = min(DENSE, len(own) + 2)
        self.flat = dense_moves(moves, self.width).ravel()
        self.start = np.zeros(len(own) + 2, dtype=np.int32)
        self.start[list(moves[0])] = list(moves[0].values())
        self.rest = len(own) + 2 - self.width
        pairs = sorted(
            (state * self.rest + c - self.width, target)
            for state, row in enumerate(moves)
            for c, target in row.items()
            if c >= self.width
        )
        # Behind the pairs stands one that no state has, for searches that end there.
        self.keys = np.array([k for k, _ in pairs] + [-1], dtype=np.int64)
        self.targets = np.array([t for _, t in pairs] + [0], dtype=np.int32)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """State behind each state by its column, 0 where there is none."""
        if not self.rest:
            return self.flat[state * self.width + c]
        rare = np.flatnonzero(c >= self.width)
        target = self.flat[state * self.width + np.where(c < self.width, c, 1)]
        keys = state[rare].astype(np.int64) * self.rest + (c[rare] - self.width)
        at = np.searchsorted(self.keys[:-1], keys)
        target[rare] = np.where(self.keys[at] == keys, self.targets[at], 0)
        return target


class Parser:
    """The automata of all languages. Symbols: 0 blank, 1 a letter no sample has, then letters."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        letters = sorted({c for text in samples.values() for c in text if c.isalpha()})
        self.symbol = np.array([chr(i).isalpha() for i in range(0x110000)], dtype=np.int32)
        self.symbol[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
        sequences = [self.symbols(samples[k])[0] for k in self.languages]
        self.automata = [Automaton(s, len(letters) + 2) for s in sequences]
        self.weights = np.array([np.log2(len(s) + 2) for s in sequences])

    def symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with runs of blanks as one, and which code points they come from."""
        codes = self.symbol[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]
        kept = codes != 0
        kept[1:] |= codes[:-1] != 0
        at = np.flatnonzero(kept)
        return codes[at], at

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per text and language, and the number of letters of each text."""
        lowered = [t.lower() for t in texts]
        ends = np.cumsum([len(t) + 1 for t in lowered])
        codes, at = self.symbols("\n".join(lowered) + "\n")
        doc = np.searchsorted(ends, at, side="right")
        letters = np.bincount(doc[codes != 0], minlength=len(texts))
        sizes = np.bincount(doc, minlength=len(texts))
        first = np.cumsum(sizes) - sizes
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = first[owner] + number * BLOCK
        size = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        active = np.searchsorted(-size, -np.arange(BLOCK), side="left")  # blocks longer than a step
        found = np.zeros((len(texts), len(self.languages)))
        columns = [codes[start[: active[t]] + t] for t in range(BLOCK)]
        for k, automaton in enumerate(self.automata):
            state = np.zeros(len(owner), dtype=np.int32)
            phrases = np.zeros(len(owner), dtype=np.int32)
            for symbols in columns:
                if not len(symbols):
                    break
                c = automaton.column[symbols]
                now = state[: len(c)]
                target = automaton.step(now, c)
                miss = target == 0
                again = automaton.start[c]
                # A letter the sample lacks is a phrase of its own behind the one it ends.
                phrases[: len(c)] += miss
                phrases[: len(c)] += miss & (again == 0) & (now != 0)
                state[: len(c)] = np.where(miss, again, target)
            phrases += state != 0
            found[:, k] = np.bincount(owner, weights=phrases, minlength=len(texts)) * self.weights[k]
        return found, letters

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH):
                size += len(texts[to])
                to += 1
            bits, letters = self.bits(texts[at:to])
            for row, n in zip(bits, letters, strict=True):
                if not n or not self.languages:
                    out.append((UNKNOWN, 0.0))
                    continue
                best = int(row.argmin())
                rest = np.delete(row, best)
                out.append((self.languages[best], float(1 - row[best] / rest.min()) if len(rest) else 1.0))
            at = to
        return out


def identify(text: Column, samples: dict[str, str]) -> Column:
    """Struct (lang, score) of each text.

    ``und`` with score 0 for a null text, one without a letter, or when no
    language was learned. The score is the share of bits that the best language
    saves against the second; of equal languages the first by name wins.
    """
    key = hash(tuple(sorted(samples.items())))

    @F.pandas_udf("lang string, score double")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = kept(("language", key), lambda: Parser(samples))
        for texts in batches:
            yield pd.DataFrame(parser.predict(texts.tolist()), columns=["lang", "score"])
            give_back()

    return parsed(F.coalesce(text, F.lit("")))
