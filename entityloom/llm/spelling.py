"""Spelling variants by asymmetric chunks and grams (operator 12).

Of two words that differ by one edit, one gives its two disjoint chunks (the
halves), the other its grams. The edit lies in one half, so the other half
stands in the other word as it is: the front half where it was, the rear half
moved by the difference of the lengths, which is at most one. So every gram of
a chunk's length that lies at a distance of at most one from the chunk's place
joins with the chunk; candidates are verified by edit distance. The shorter of
two words (by length, then in code-point order) gives the chunks, so each pair
is met from one side.

A chunk that more than ``HOT`` words share is split: with one half equal, the
single edit lies in the other half of the words, and again leaves one of its
halves as it was. Such words join by the chunk together with that quarter.
Everything is DataFrame functions; counts of words merge map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityloom.session import materialise

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIVISOR = 31
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form is at least so many times as frequent.
TIMES = 10
HOT = 64
#: Each form is ten times as frequent as the word: a chain in 64-bit counts has fewer than 19 steps.
JUMPS = 5


def vocabulary(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all texts with their occurrences.

    Words are runs of letters with A to Z in lower case; where 31 divides the
    CRC-32 of ``<id>:<run>``, the run's code point at that hash modulo its length
    is left out. Only words of at least 7 code points with 2 occurrences are
    returned. A null text has no words; a null id counts as the empty text.
    Whole texts are read at any length; rows with one id count one by one.
    """
    runs = docs.select(
        F.coalesce(F.col(row_id).cast("string"), F.lit("")).alias("d"),
        F.explode(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("r"),
    )
    size = F.char_length("r")
    at = (F.col("h") % size).cast("int")
    cut = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, size))
    hashed = runs.filter(size >= LEAST_LENGTH).withColumn(
        "h", F.crc32(F.concat("d", F.lit(":"), "r").cast("binary"))
    )
    words = hashed.select(F.when(F.col("h") % DIVISOR == 0, cut).otherwise(F.col("r")).alias("word"))
    counted = words.filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word")
    return counted.agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _key(*parts: Column | str) -> Column:
    return F.xxhash64(*parts)


def _chunks(words: DataFrame) -> DataFrame:
    """(key, word, rest, length): both halves of each word; ``rest`` is the other half."""
    size = F.char_length("word")
    half = F.floor(size / 2).cast("int")
    front, rear = F.substring("word", F.lit(1), half), F.substring("word", half + 1, size)
    halves = F.array(
        F.struct(F.lit(0).alias("part"), front.alias("chunk"), rear.alias("rest")),
        F.struct(F.lit(1).alias("part"), rear.alias("chunk"), front.alias("rest")),
    )
    made = words.select("word", size.alias("length"), F.explode(halves).alias("x"))
    return made.select(_key("length", "x.part", "x.chunk").alias("key"), "word", "x.rest", "length")


def _grams(words: DataFrame) -> DataFrame:
    """(key, word, rest, length): what of each word can equal a half of a word as long or one shorter.

    ``length`` is that of the other word. A single edit leaves the front half at
    a shift of 0, the rear half at that of the lengths' difference; other grams
    within shift one would join with nothing that passes verification.
    """
    size = F.char_length("word")
    made = words.select(
        "word", size.alias("size"), F.explode(F.array(size, size - 1)).alias("length")
    ).filter(F.col("length") >= LEAST_LENGTH)
    half = F.floor(F.col("length") / 2).cast("int")
    rear = F.col("length") - half
    start = F.col("size") - rear
    halves = F.array(
        F.struct(
            F.lit(0).alias("part"),
            F.substring("word", F.lit(1), half).alias("chunk"),
            F.substring("word", half + 1, F.col("size")).alias("rest"),
        ),
        F.struct(
            F.lit(1).alias("part"),
            F.substring("word", start + 1, rear).alias("chunk"),
            F.substring("word", F.lit(1), start).alias("rest"),
        ),
    )
    made = made.withColumn("x", F.explode(halves))
    return made.select(_key("length", "x.part", "x.chunk").alias("key"), "word", "x.rest", "length")


def _split(keyed: DataFrame, own: bool) -> DataFrame:
    """Keys of hot chunks again, each with a half of the rest; of the shorter word if ``own``."""
    size = F.char_length("rest")
    # Both sides cut where the shorter rest has its middle.
    shorter = size if own else size - (F.char_length("word") - F.col("length"))
    half = F.floor(shorter / 2).cast("int")
    rear = shorter - half
    quarters = F.array(
        F.struct(F.lit(0).alias("part"), F.substring("rest", F.lit(1), half).alias("chunk")),
        F.struct(F.lit(1).alias("part"), F.substring("rest", size - rear + 1, rear).alias("chunk")),
    )
    made = keyed.select("key", "word", F.explode(quarters).alias("x"))
    return made.select(_key("key", "x.part", "x.chunk").alias("key"), "word")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of all distinct words of at least seven code points that differ by one edit, each pair once."""
    chunks, grams = _chunks(words), _grams(words)
    hot = materialise(
        chunks.groupBy("key").agg(F.count("*").alias("words")).filter(F.col("words") > HOT).select("key"), "hot"
    )

    def all_keys(keyed: DataFrame, own: bool) -> DataFrame:
        cool = keyed.join(hot, "key", "left_anti").select("key", "word")
        return cool.unionByName(_split(keyed.join(hot, "key", "left_semi"), own))

    left = all_keys(chunks, True).withColumnRenamed("word", "a")
    right = all_keys(grams, False).withColumnRenamed("word", "b")
    size_a, size_b = F.char_length("a"), F.char_length("b")
    first = (size_a < size_b) | ((size_a == size_b) & (F.col("a") < F.col("b")))
    met = left.join(right, "key").filter(first & (size_b - size_a <= 1))
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a table (word, n).

    Two words are near if they differ by one inserted, deleted or replaced code
    point. A word's form is its near word with the largest n, the first in
    code-point order of several, if that is at least ten times its own; else
    null. ``root`` follows the forms to the last one. An empty table gives none.
    """
    words = materialise(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = words.select(F.col("word").alias("b"), F.col("n").alias("other"))
    best = (
        both.join(counts, "b")
        .groupBy(F.col("a").alias("word"))
        .agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("other"), "b")).alias("best"))
        .select("word", "n_near", F.col("best.b").alias("b"), (-F.col("best.col1")).alias("m"))
    )
    much = F.col("m") >= TIMES * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word",
        F.when(much, F.col("b")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(much, F.col("m")).alias("form_n"),
    )
    formed = materialise(formed, "formed")
    steps = formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(JUMPS):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = steps.join(further, "root", "left")
        moved = materialise(
            jumped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "roots",
        )
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return formed.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
