"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityloom.llm import (
    huffman,
    language,
    licenses,
    merges,
    negatives,
    packing,
    simhash,
    spelling,
    spots,
    substrings,
    topk,
    toxicity,
    winnowing,
)
from entityloom.llm.workers import share_path
from entityloom.session import shared_folder


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    share_path(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_spot_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, compared with each other."""
    docs = _documents(spark, folder).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    signed = spots.with_signatures(docs, "text", "signatures")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = spots.with_next(signed, ["text", "signatures"], "text").withColumn(
        "edited",
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)),
    )
    return spots.with_signatures(edited, "edited", "edited_signatures").select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("signatures", " ").alias("fingerprint"),
        F.array_join("edited_signatures", " ").alias("edited_fingerprint"),
        spots.likeness("signatures", "edited_signatures").alias("near_edited"),
        spots.likeness("signatures", "next_signatures").alias("near_next"),
        spots.length_class(F.size("signatures")).alias("length_class"),
    )


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Words, base phrases and license labels of every document."""
    found = _documents(spark, folder).select("doc_id", licenses.scan_licenses(F.col("text")).alias("found"))
    return found.select("doc_id", "found.*").drop("spans")


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document, with the checksum of its ids and its place in a window."""
    return packing.pack(_documents(spark, folder), with_ids=False)


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document as read back from the Huffman files."""
    target = f"{shared_folder(spark)}/huffman-{uuid.uuid4().hex}"
    huffman.write_ids(_documents(spark, folder), target)
    return huffman.read_ids(spark, target, with_ids=False)


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _documents(spark, folder)
    found = language.identify(F.col("text"), language.learn(docs))
    return docs.select("doc_id", language.held_out().alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score"
    )


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_documents(spark, folder))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item, and the items."""
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = winnowing.contamination(_documents(spark, folder), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score and decision of every document."""
    docs = _documents(spark, folder)
    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = docs.select(
        "doc_id",
        language.held_out().alias("held_out"),
        toxicity.toxicity(F.col("text"), model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= toxicity.DECISION).cast("int"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document."""
    text = F.coalesce("text", F.lit(""))
    return (
        _documents(spark, folder)
        .select(
            "doc_id",
            F.octet_length(text).cast("long").alias("n_bytes"),
            merges.n_tokens(F.col("text")).alias("n_tokens"),
        )
        .withColumn("over_limit", F.col("n_tokens") > merges.LIMIT)
    )


def op10_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Words removed from every document, and the digest of what is kept."""
    docs = _documents(spark, folder).select("doc_id", "text")
    found = substrings.with_removal(docs, "found").select("doc_id", "found.*")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


def _embeddings(spark: SparkSession, folder: str) -> DataFrame:
    share_path(spark)
    return spark.read.parquet(f"{folder}/embeddings.parquet")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    number, label = F.col("vec_id"), F.col("label")
    changed = F.when(number % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(
        _embeddings(spark, folder), number % 50 == 0, "vec_id", changed, "embedding", factor=256.0
    )


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word with its more frequent form and the root of its forms."""
    return spelling.variants(spelling.vocabulary(_documents(spark, folder)))


def op13_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector."""
    return topk.search(
        _embeddings(spark, folder), F.col("vec_id") % 20 == 0, "vec_id", "embedding", factor=64.0, k=20
    )


QUERIES = {
    "op1_spot_signatures": op1_spot_signatures,
    "op2_licenses": op2_licenses,
    "op3_packing": op3_packing,
    "op4_token_files": op4_token_files,
    "op5_language": op5_language,
    "op6_simhash": op6_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_substrings": op10_substrings,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_top_k": op13_top_k,
}
OP10_SQL = """
WITH d AS (
    SELECT doc_id, list_filter(
        regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), win AS (
    SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS s
    FROM d, unnest(range(1, len(w) - 48)) AS t(i)
), least AS (
    SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING count(*) > 1
), hit AS (
    SELECT DISTINCT doc_id, i + k AS p
    FROM (SELECT doc_id, i FROM win JOIN least USING (s) WHERE doc_id > m), range(50) AS r(k)
), removed AS (
    SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE
        list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i])
    END, ' ')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id)
"""

OP7_SQL = """
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM benchmark
), sized AS (
    SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0
), item AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
    FROM sized, unnest(range(1, len(w) - n + 2)) AS t(i)
), win AS (
    SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
    FROM d, (SELECT DISTINCT n FROM item) AS sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
), hit AS (
    SELECT doc_id, i, n, item_id FROM win JOIN item USING (s, n)
), n_hit AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(10) AS r(k) WHERE k < n GROUP BY doc_id
), ids AS (
    SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(len(ids), 0)::BIGINT AS n_items,
    sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
    n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP1_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents
), e AS (
    SELECT doc_id, text, coalesce(lead(text) OVER o, first_value(text) OVER o) AS behind,
        coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id
    FROM d WINDOW o AS (ORDER BY doc_id DESC)
), edited AS (
    SELECT doc_id, next_id, length(text) AS n, substr(text, 1, length(text) - length(text) // 2)
        || substr(behind, 1, length(text) // 2) AS text
    FROM e
), t AS (
    SELECT doc_id, 0 AS kind, text FROM d UNION ALL SELECT doc_id, 1, text FROM edited
), words AS (
    SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
    FROM t
), parts AS (
    SELECT *, list_filter(w, lambda x: NOT list_contains(ANCHORS, x)) AS c,
        list_filter(range(1, len(w) + 1), lambda i: list_contains(ANCHORS, w[i])) AS p
    FROM words
), signed AS (
    SELECT doc_id, kind, list_sort(list_distinct(CASE
        WHEN len(p) > 0 THEN list_transform(p, lambda i, j: substr(md5(array_to_string(
            list_concat([w[i]], c[i - j + 1 : i - j + 2]), ' ')), 1, 8))
        WHEN len(w) > 0 THEN list_transform(range(1, len(w) + 1), lambda i: substr(md5(array_to_string(
            list_concat([w[i]], w[i + 1 : i + 2]), ' ')), 1, 8))
        WHEN text <> '' THEN [substr(md5(text), 1, 8)]
        ELSE [] END)) AS s
    FROM parts
), near AS (
    SELECT x.doc_id, n, sha256(text) AS edited_sha256, a.s AS a, b.s AS b, c.s AS c
    FROM edited AS x
    JOIN signed AS a ON a.doc_id = x.doc_id AND a.kind = 0
    JOIN signed AS b ON b.doc_id = x.doc_id AND b.kind = 1
    JOIN signed AS c ON c.doc_id = x.next_id AND c.kind = 0
)
SELECT doc_id, n::BIGINT AS n_chars, edited_sha256, array_to_string(a, ' ') AS fingerprint,
    array_to_string(b, ' ') AS edited_fingerprint,
    CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE
        / (len(a) + len(b) - len(list_intersect(a, b))) END AS near_edited,
    CASE WHEN len(a) = 0 AND len(c) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, c))::DOUBLE
        / (len(a) + len(c) - len(list_intersect(a, c))) END AS near_next,
    floor(ln(greatest(len(a), 1)::DOUBLE) / -ln(0.8::DOUBLE))::INTEGER AS length_class
FROM near
""".replace("ANCHORS", "[" + ", ".join(f"'{w}'" for w in spots.ANCHORS) + "]")

_VECTORS = """
    SELECT vec_id, COLUMNS list_transform(embedding, lambda x: floor(FACTOR * x::DOUBLE)) AS w
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""

OP13_SQL = f"""
WITH v AS ({_VECTORS.replace("FACTOR", "64").replace("COLUMNS", "")}), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
    FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
    vec_id, score
FROM scored QUALIFY rank <= 20
"""

OP11_SQL = f"""
WITH v AS ({_VECTORS.replace("FACTOR", "256").replace("COLUMNS", "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,")} AND label IS NOT NULL),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
        list_inner_product(a.w, r.w)::BIGINT AS score
    FROM v AS a JOIN v AS r ON a.vec_id <> r.vec_id
    WHERE a.vec_id % 50 = 0
), positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

#: The database counts edits of bytes: for that, letters beyond ASCII take bytes that no word holds.
_ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
_FREE_BYTES = "".join(c for c in map(chr, range(0x20, 0x7F)) if not c.islower() and c != "'")[:64]

#: CRC-32 in SQL: the table of the reversed polynomial is made by its rule, bytes come from hex digits.
OP12_SQL = """
WITH RECURSIVE bits AS (
    SELECT b, b AS c, 0 AS k FROM (SELECT unnest(range(256)) AS b)
    UNION ALL
    SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
    SELECT list(c ORDER BY b) AS steps FROM bits WHERE k = 8
), runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS r
    FROM documents WHERE text IS NOT NULL
), counted AS (
    SELECT d, r, count(*) AS times, hex(encode(d || ':' || r)) AS digits FROM runs GROUP BY d, r
), hashed AS (
    SELECT r, times, xor(list_reduce(
        list_transform(range(0, length(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT),
        lambda h, byte: xor(h >> 8, steps[(xor(h, byte) & 255) + 1]), 4294967295), 4294967295) AS h
    FROM counted, crc
), made AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word,
        times
    FROM hashed
), words AS (
    SELECT word, sum(times)::BIGINT AS n, translate(word, 'ACCENTED', 'FREE') AS bytes
    FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n
    FROM words AS a JOIN words AS b ON length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1
    WHERE a.word <> b.word AND levenshtein(a.bytes, b.bytes) = 1
), best AS (
    SELECT word, n, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n
    FROM near GROUP BY word, n
), formed AS (
    SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
        CASE WHEN other_n >= 10 * words.n THEN other END AS form,
        CASE WHEN other_n >= 10 * words.n THEN other_n END AS form_n
    FROM words LEFT JOIN best USING (word)
), chain AS (
    SELECT word, word AS root FROM formed
    UNION ALL
    SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NOT NULL
), ends AS (
    SELECT chain.word, root FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NULL
)
SELECT formed.word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM formed JOIN ends USING (word)
""".replace("ACCENTED", _ACCENTED).replace("FREE", _FREE_BYTES)

ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_top_k": OP13_SQL,
    "op1_spot_signatures": OP1_SQL,
    "op7_decontamination": OP7_SQL,
    "op10_substrings": OP10_SQL,
}
