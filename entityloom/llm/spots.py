"""SpotSigs document fingerprints, in DataFrame functions only (operator 1).

Every common word is an anchor; with the next content words it forms a spot
signature. A document's fingerprint is the set of its signatures. Two sets
whose sizes differ too much cannot be alike, so documents are partitioned by
set length and only neighbouring lengths are compared, through an index of
their rarest signatures.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityloom.session import materialise

CHAIN = 2
SIMILARITY = 0.8
#: Hexadecimal digits kept of a signature's hash.
DIGITS = 8
#: Documents with neighbouring ids that a task looks at together.
BUCKET_BITS = 8
#: Common words of English, German, French and Spanish.
ANCHORS = tuple(
    dict.fromkeys(
        "a an and are as at be by for from in is it of on or that the this to was were what will with "
        "der die das den dem ein eine und oder ist war von zu mit auf für nicht sich im "
        "le la les des un une et est dans pour qui que sur pas par au aux du de en ce "
        "el los las y del una con para por se su no lo al más".split()
    )
)
NOT_WORD = r"[^\p{L}\p{N}]+"


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Adds ``out``: the sorted distinct signatures of a text column.

    A text without anchors takes every word for one; a text without words has
    the hash of the text itself, an empty one nothing. Each step is a column
    that later steps name more than once, so Spark computes it once per row.
    """
    w, anchors, content = f"_{out}_words", f"_{out}_anchors", f"_{out}_content"

    def signature(*parts: Column) -> Column:
        return F.substring(F.md5(F.concat_ws(" ", *parts).cast("binary")), 1, DIGITS)

    spots = F.transform(
        anchors,
        # The j-th anchor at word i has i - j content words before it.
        lambda i, j: signature(F.get(w, i), F.slice(content, i - j + 1, F.lit(chain))),
    )
    every = F.transform(w, lambda x, i: signature(x, F.slice(w, i + 2, F.lit(chain))))
    return (
        df.withColumn(w, F.array_remove(F.split(F.lower(text), NOT_WORD), ""))
        .withColumn(
            anchors,
            F.filter(
                F.transform(w, lambda x, i: F.when(x.isin(*ANCHORS), i)), lambda i: i.isNotNull()
            ),
        )
        .withColumn(content, F.filter(w, lambda x: ~x.isin(*ANCHORS)))
        .withColumn(
            out,
            F.sort_array(
                F.array_distinct(
                    F.when((F.size(anchors) > 0) & (F.size(content) >= 0), spots)
                    .when(F.size(w) > 0, every)
                    .when(F.col(text) != "", F.array(signature(F.col(text))))
                    .otherwise(F.array().cast("array<string>"))
                )
            ),
        )
        .drop(w, anchors, content)
    )


def likeness(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature columns; two empty sets are alike.

    Where the sizes alone put it below ``least``, it is 0 without a comparison.
    """
    na, nb = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    return (
        F.when((na == 0) & (nb == 0), 1.0)
        .when(F.least(na, nb) < F.greatest(na, nb) * least, 0.0)
        .otherwise(shared / (na + nb - shared))
    )


def length_class(n: int | Column, least: float = SIMILARITY) -> Column:
    """Partition of a set length: sets at least ``least`` alike lie in the same or the next one."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / -math.log(least)).cast("int")


def near_pairs(signed: DataFrame, least: float = SIMILARITY, row: str = "doc_id") -> DataFrame:
    """(a, b, likeness) of distinct fingerprints at least ``least`` alike, with a < b.

    ``signed`` has ``row`` and ``signatures``; a and b are the smallest ``row``
    of their fingerprints, so copies are one. Only the first signatures by
    rarity (as many as a similar set must share one of) are indexed, by length
    class; the sizes prune again before sets are compared. Empty sets pair with
    nothing. All joins are left to Spark, which splits hot signatures.
    """
    sets = (
        signed.filter(F.size("signatures") > 0)
        .groupBy("signatures")
        .agg(F.min(row).alias("id"))
        .filter("id IS NOT NULL")
    )
    spread = sets.select("id", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    counts = spread.groupBy("s").agg(F.count("*").alias("df"))
    ranked = spread.join(counts, "s").withColumn(
        "rank", F.row_number().over(Window.partitionBy("id").orderBy("df", "s"))
    )
    index = ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select(
        "s", "id", "n", length_class(F.col("n"), least).alias("class")
    )
    other = index.select("s", F.col("id").alias("b"), F.col("n").alias("m"), F.col("class"))
    reach = index.withColumn("class", F.explode(F.array("class", F.col("class") + 1)))
    met = (
        reach.join(other, ["s", "class"])
        .filter("id <> b AND least(n, m) >= greatest(n, m) * " + str(least))
        .select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))
        .distinct()
    )
    one = sets.select(F.col("id").alias("a"), F.col("signatures").alias("_a"))
    two = sets.select(F.col("id").alias("b"), F.col("signatures").alias("_b"))
    compared = met.join(one, "a").join(two, "b")
    return compared.select("a", "b", likeness("_a", "_b", least).alias("likeness")).filter(
        F.col("likeness") >= least
    )


def following(keys: DataFrame) -> DataFrame:
    """(k, next): the next smaller of the distinct values k; the largest behind the smallest.

    Values are range-partitioned and written; only the largest value of each
    partition is ordered in one task.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.distinct().repartitionByRange(parts, "k").withColumn("part", F.spark_partition_id())
    written = materialise(placed, "keys")
    order = Window.orderBy(F.col("part").desc())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = (
        written.groupBy("part")
        .agg(F.max("k").alias("head"))
        .select(
            "part",
            F.coalesce(F.lead("head").over(order), F.first("head").over(whole)).alias("behind"),
        )
    )
    inside = F.lead("k").over(Window.partitionBy("part").orderBy(F.col("k").desc()))
    return (
        written.withColumn("next", inside)
        .join(heads, "part")
        .select("k", F.coalesce("next", "behind").alias("next"))
    )


def with_next(docs: DataFrame, columns: list[str], tie: str) -> DataFrame:
    """Adds ``next_<column>`` of the document behind in descending ``doc_id`` order.

    The last is followed by the first. Rows without ``doc_id`` come last; rows
    that share one follow each other by ``tie``.
    """
    missing = F.lit(-(1 << 60)) - F.pmod(F.xxhash64(tie), F.lit(4096))
    bucketed = docs.withColumn(
        "_bucket", F.coalesce(F.shiftright("doc_id", BUCKET_BITS), missing)
    )
    order = Window.partitionBy("_bucket").orderBy(F.col("doc_id").desc_nulls_last(), tie)
    placed = bucketed.withColumns(
        {f"_next_{c}": F.lead(c).over(order) for c in columns} | {"_place": F.row_number().over(order)}
    )
    first = placed.filter("_place = 1").select(
        F.col("_bucket").alias("next"), *(F.col(c).alias(f"_head_{c}") for c in columns)
    )
    chain = following(docs.select(F.coalesce(F.shiftright("doc_id", BUCKET_BITS), missing).alias("k")))
    bridge = chain.join(first, "next").drop("next").withColumnRenamed("k", "_bucket")
    return placed.join(bridge, "_bucket", "left").select(
        *docs.columns,
        *(F.coalesce(f"_next_{c}", f"_head_{c}").alias(f"next_{c}") for c in columns),
    )
