"""Benchmark decontamination by winnowing, in DataFrame functions only (operator 7).

Word k-grams are hashed; of every ``w`` neighbouring hashes the least is kept.
Two texts that share ``k + w - 1`` words share a kept hash, so with k = 5 and
w = 6 no common window of ten words is missed. Documents meet the benchmark in
a join of kept hashes; hits are then extended: windows whose least hash was met
are compared word by word. Items shorter than a window are one window of their
own length, for which every gram of that length is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityloom.session import materialise

WINDOW = 10
GRAM = 5
#: Rows up to which a side of hashes, windows or candidates is broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 100_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a whole text; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def _smallest(*values: Column) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def _over(column: str, n: int, combine) -> Column:
    """``combine`` of every ``n`` neighbouring elements; empty for a shorter array."""

    def at(i: Column) -> Column:
        return combine(*(F.get(column, i + j) for j in range(n)))

    return F.when(
        F.size(column) >= n, F.transform(F.sequence(F.lit(0), F.size(column) - n), at)
    ).otherwise(F.array().cast("array<bigint>"))


def _with_minima(df: DataFrame, spans: list[int], gram: int) -> DataFrame:
    """Adds ``_minima``: per span length, the least hash of each of its windows.

    Every step is a column of its own that later steps name more than once, so
    that Spark computes it once per row. For the same reason arrays are exploded
    with their outer form: the inner one would have Spark filter on the array's
    size first, far below, by computing it all again.
    """
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    names = []
    for span in spans:
        k = min(gram, span) if span == max(spans) else span
        grams, least = f"_grams{span}", f"_least{span}"
        df = df.withColumn(grams, _over("_hashes", k, lambda *x: F.xxhash64(*x)))
        df = df.withColumn(least, _over(grams, span - k + 1, _smallest))
        names.append(least)
    return df.withColumn("_minima", F.array(*names))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast behind a check of the size; otherwise the join is left to Spark."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _windows(words_: str, at: Column, span: Column) -> Column:
    return F.array_join(F.slice(words_, at + 1, span), " ")


def hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """(doc_id, row_hash, n_hit, items, spans) of every row of ``docs`` that is hit.

    ``spans`` are the hit words as merged (start, end) positions, ``items`` the
    ids found, sorted as strings (a missing id is an empty string, items with
    the same id count as one). Null and empty texts have no words; items without
    words hit nothing; with an empty benchmark no row is hit. Rows with the same
    id, or none, are judged each by its text (``row_hash``), equal ones as one;
    other columns are not read.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("row_hash"),
        words(F.col("text")).alias("_words"),
    )
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("_item"),
        words(F.col("text")).alias("_words"),
    ).filter(F.size("_words") > 0)
    items = items.withColumn("_span", F.least(F.size("_words"), F.lit(window)))
    # At most ``window`` values: the lengths of short items, and the window itself.
    spans = sorted({r[0] for r in items.select("_span").distinct().collect()} | {window})
    place = F.create_map(*(x for i, s in enumerate(spans) for x in (F.lit(s), F.lit(i))))

    hashed = _with_minima(items, spans, gram)
    kept = hashed.select(
        F.explode_outer(F.array_distinct(F.get("_minima", place[F.col("_span")]))).alias("_hash")
    ).distinct()
    met = (
        _with_minima(base, spans, gram)
        .select(
            "doc_id", "row_hash", F.explode_outer(F.array_distinct(F.flatten("_minima"))).alias("_hash")
        )
        .join(_small(kept), "_hash")
        .groupBy("doc_id", "row_hash")
        .agg(F.collect_set("_hash").alias("_met"))
    )
    candidates = materialise(met, "candidates")

    known = (
        items.select(
            "_item",
            "_span",
            F.explode_outer(
                F.transform(
                    F.sequence(F.lit(0), F.size("_words") - F.col("_span")),
                    lambda i: F.array_join(F.slice("_words", i + 1, F.col("_span")), " "),
                )
            ).alias("_text"),
        )
        .groupBy("_text", "_span")
        .agg(F.sort_array(F.collect_set("_item")).alias("_items"))
    )
    texts = docs.select(
        F.col("doc_id").cast("long").alias("_id"),
        F.xxhash64("text").alias("_row"),
        F.col("text").alias("_text"),
    )
    same = (F.col("_id").eqNullSafe(F.col("doc_id"))) & (F.col("_row") == F.col("row_hash"))
    found = (
        _with_minima(
            texts.join(_small(candidates), same)
            .dropDuplicates(["doc_id", "row_hash"])
            .select("doc_id", "row_hash", "_met", words(F.col("_text")).alias("_words")),
            spans,
            gram,
        )
        .select(
            "doc_id",
            "row_hash",
            "_words",
            "_met",
            F.posexplode_outer("_minima").alias("_place", "_least"),
        )
        .select(
            "doc_id",
            "row_hash",
            "_words",
            F.get(F.array(*map(F.lit, spans)), F.col("_place")).alias("_span"),
            F.explode_outer(
                F.filter(
                    F.transform(
                        "_least", lambda h, i: F.when(F.array_contains("_met", h), i)
                    ),
                    lambda i: i.isNotNull(),
                )
            ).alias("_at"),
        )
        .select(
            "doc_id",
            "row_hash",
            "_at",
            "_span",
            _windows("_words", F.col("_at"), F.col("_span")).alias("_text"),
        )
        .join(_small(known), ["_text", "_span"])
        .groupBy("doc_id", "row_hash")
        .agg(
            F.sort_array(
                F.collect_set(F.struct(F.col("_at").alias("start"), (F.col("_at") + F.col("_span")).alias("end")))
            ).alias("_hits"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"),
        )
    )
    merged = F.aggregate(
        "_hits",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, hit: F.when(
            (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= hit["start"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(
                    F.struct(
                        F.get(done, F.size(done) - 1)["start"].alias("start"),
                        F.greatest(F.get(done, F.size(done) - 1)["end"], hit["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(hit))),
    )
    counted = F.aggregate(
        "_hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda done, hit: F.struct(
            (done["n"] + F.greatest(F.lit(0), hit["end"] - F.greatest(done["end"], hit["start"]))).alias("n"),
            F.greatest(done["end"], hit["end"]).alias("end"),
        ),
    )["n"]
    return found.select(
        "doc_id",
        "row_hash",
        counted.cast("long").alias("n_hit"),
        "items",
        merged.alias("spans"),
    )


def same_row(hit: DataFrame, docs: DataFrame) -> Column:
    """Join condition between ``hits`` and the table they were found in."""
    return hit["doc_id"].eqNullSafe(docs["doc_id"]) & (hit["row_hash"] == F.xxhash64(docs["text"]))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every row of ``docs``, hit or not."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("_row"),
        F.size(words(F.col("text"))).cast("long").alias("n_words"),
    )
    found = hits(docs, benchmark, window, gram).withColumnRenamed("doc_id", "_id")
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_row") == F.col("row_hash"))
    return sized.join(found, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with all its columns, less the rows that hold a window of the benchmark."""
    found = materialise(hits(docs, benchmark).select("doc_id", "row_hash"), "contaminated")
    return docs.join(_small(found), same_row(found, docs), "left_anti")
