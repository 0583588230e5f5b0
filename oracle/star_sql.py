"""DuckDB SQL that states each registered query on its own, from the raw tables.

Statistics are exact integer ones, so both engines give the same doubles: a
value is scaled and rounded half-even to BIGINT, added up as HUGEINT and only
then divided.
"""

from __future__ import annotations

# The parameters of the registered queries.
SEED = 7
FOLDS = 10
CHUNK = 32
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def units(expr: str, scale: int) -> str:
    scaled = f"({expr})::DOUBLE" if scale == 0 else f"({expr})::DOUBLE * {10.0**scale:.1f}"
    return f"round_even({scaled}, 0)::BIGINT"


def variance(n: str, s: str, ss: str, scale: int) -> str:
    """Sample variance from exact count, sum and sum of squares."""
    r = f"(({s}) % ({n}))"
    spread = (
        f"(({ss}) - (({s}) // ({n})) * (({s}) + {r}))::DOUBLE"
        f" - ({r}::DOUBLE * {r}::DOUBLE) / ({n})::DOUBLE"
    )
    divisor = f"{10.0 ** (2 * scale):.1f}"
    return f"CASE WHEN {n} > 1 THEN greatest({spread}, 0.0) / (({n})::DOUBLE - 1.0) / {divisor} END"


def stat(expr: str, op: str, scale: int, cond: str | None = None, zero: bool = False) -> str:
    """One aggregate; ``cond`` restricts it to a branch, ``zero`` is the zero mode."""
    u = units(expr, scale)
    if cond:
        u = f"CASE WHEN {cond} THEN {u} END"
    power = f"{10.0**scale:.1f}"
    rows = f"count(*) FILTER (WHERE {cond})" if cond else "count(*)"
    n, s = f"count({u})", f"sum({u})::HUGEINT"
    made = {
        "count": n,
        "size": rows,
        "min": f"min({u})::DOUBLE / {power}",
        "max": f"max({u})::DOUBLE / {power}",
        "sum": f"coalesce(sum({u})::BIGINT, 0)::DOUBLE / {power}",
        "mean": f"sum({u})::BIGINT::DOUBLE / (nullif({n}, 0)::DOUBLE * {power})",
        "nunique": f"count(DISTINCT CASE WHEN {cond or 'TRUE'} THEN {expr} END)",
    }
    if op == "var":
        return variance(n, s, f"sum(({u})::HUGEINT * ({u})::HUGEINT)", scale)
    if cond and not zero and op in ("count", "size", "sum", "nunique"):
        return f"CASE WHEN {rows} > 0 THEN {made[op]} END"
    return made[op]


Spec = tuple[str, str, str, int]  # name, operations, expression, scale


def stats(specs: list[Spec], prefix: str, cond: str | None = None) -> list[str]:
    return [
        f'{stat(expr, op, scale, cond)} AS "{prefix}{name}_{op.upper()}"'
        for name, ops, expr, scale in specs
        for op in ops.split()
    ]


def shares(column: str, values, prefix: str = "", missing: bool = True) -> list[str]:
    made = [
        f"(count(*) FILTER (WHERE {column} = '{v}'))::DOUBLE / count(*)::DOUBLE AS \"{prefix}{column}_{v}_MEAN\""
        for v in values
    ]
    if missing:
        made.append(
            f'(count(*) FILTER (WHERE {column} IS NULL))::DOUBLE / count(*)::DOUBLE AS "{prefix}{column}_nan_MEAN"'
        )
    return made


def grouped(source: str, key: str, items: list[str]) -> str:
    return f"SELECT {key}, {', '.join(items)} FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}"


def plain(name: str, ops: str, scale: int) -> Spec:
    return (name, ops, name, scale)


# --- history rows ---------------------------------------------------------------------------

DAY = "date_diff('day', DATE '1998-01-01', {}::DATE)"
CHILD_ITEMS = [
    *stats(
        [
            plain("l_linenumber", "min max size", 0),
            plain("l_extendedprice", "max sum", 2),
            plain("l_quantity", "sum", 2),
        ],
        "",
    ),
    *shares("l_returnflag", ("A", "N", "R")),
]
HISTORY = f"""
per_order AS ({grouped("lineitem", "l_orderkey", CHILD_ITEMS)}),
order_rows AS (
  SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice, o_orderstatus, o_orderpriority,
         {DAY.format("o_orderdate")} AS days, per_order.*
  FROM orders LEFT JOIN per_order ON l_orderkey = o_orderkey),
line_rows AS (
  SELECT o_custkey AS c_custkey, o_totalprice, lineitem.*,
         {DAY.format("o_orderdate")} AS day_due, {DAY.format("l_shipdate")} AS day_paid,
         l_extendedprice AS amount_due, l_extendedprice * (1.0::DOUBLE - l_discount) AS amount_paid,
         nullif(l_discount, 0.0) AS discount,
         date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS day_gap
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
event_rows AS (
  SELECT user_id AS c_custkey, event_id, event_type, value, hour(ts) AS hour FROM events)
"""
LAYOUT = f"""
layout AS (
  SELECT c_custkey, row_number() OVER (ORDER BY md5('{SEED}:' || c_custkey), c_custkey) - 1 AS app_index
  FROM customer)
"""


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN ({a})::DOUBLE / ({b})::DOUBLE END"


PRICE_SHARE = ratio("l_extendedprice", "o_totalprice")
PAID_PERC = ratio("amount_paid", "amount_due")
PAST_DUE = "greatest(day_paid - day_due, 0)"
BEFORE_DUE = "greatest(day_due - day_paid, 0)"
PAID_DIFF = "amount_due - amount_paid"

ORDER_SPECS = [
    plain("days", "min max mean var", 0),
    plain("o_totalprice", "max mean sum", 2),
    plain("l_extendedprice_SUM", "max mean sum", 2),
    plain("l_extendedprice_MAX", "mean", 2),
    plain("l_quantity_SUM", "sum", 2),
    plain("l_linenumber_MIN", "min", 0),
    plain("l_linenumber_MAX", "max", 0),
    plain("l_linenumber_SIZE", "mean sum", 0),
]
CHILD_SHARES = [plain(f"l_returnflag_{v}_MEAN", "mean", 6) for v in ("A", "N", "R", "nan")]
LINE_SPECS = [
    plain("l_quantity", "min max mean", 2),
    plain("l_extendedprice", "min max mean", 2),
    ("PRICE_SHARE", "min max mean var", PRICE_SHARE, 6),
    plain("l_tax", "min max mean", 2),
    plain("discount", "min max mean", 2),
    plain("day_gap", "min max mean", 0),
    plain("l_linenumber", "mean sum", 0),
]
PAY_SPECS = [
    plain("l_linenumber", "nunique", 0),
    ("DPD", "max mean sum", PAST_DUE, 0),
    ("DBD", "max mean sum", BEFORE_DUE, 0),
    ("PAID_PERC", "max mean sum var", PAID_PERC, 6),
    ("PAID_DIFF", "max mean sum var", PAID_DIFF, 2),
    plain("amount_due", "max mean sum", 2),
    plain("amount_paid", "min max mean sum", 2),
    plain("day_paid", "max mean sum", 0),
]
ANY = "min max mean sum var"
WIDE_SPECS = [
    plain("l_partkey", ANY, 0),
    plain("l_suppkey", ANY, 0),
    plain("l_linenumber", ANY, 0),
    plain("l_quantity", ANY, 2),
    plain("l_extendedprice", ANY, 2),
    plain("l_discount", ANY, 2),
    plain("l_tax", ANY, 2),
]
STATUS_SPECS = [
    ("status_F", ANY, "(l_linestatus IS NOT DISTINCT FROM 'F')::INT", 0),
    ("status_O", ANY, "(l_linestatus IS NOT DISTINCT FROM 'O')::INT", 0),
    ("status_nan", ANY, "(l_linestatus IS NULL)::INT", 0),
]

ORDER_ITEMS = [
    *stats(ORDER_SPECS + CHILD_SHARES, "ORD_"),
    *stats(ORDER_SPECS, "OPEN_", "o_orderstatus = 'O'"),
    *stats(ORDER_SPECS, "DONE_", "o_orderstatus = 'F'"),
    *shares("o_orderstatus", ("F", "O", "P"), "ORD_"),
    *shares("o_orderpriority", PRIORITIES, "ORD_"),
]
LINE_ITEMS = [
    *stats(LINE_SPECS, "PREV_"),
    *stats(LINE_SPECS, "ACC_", "l_returnflag = 'A'"),
    *stats(LINE_SPECS, "RET_", "l_returnflag = 'R'"),
    *shares("l_returnflag", ("A", "N", "R"), "PREV_"),
    *shares("l_linestatus", ("F", "O"), "PREV_"),
]
EVENT_ITEMS = [
    *stats([plain("value", "max mean size", 2), plain("hour", "max mean", 0)], "EVT_"),
    "count(*) AS EVT_COUNT",
    *shares("event_type", EVENT_TYPES, "EVT_"),
]
PAY_ITEMS = [*stats(PAY_SPECS, "PAY_"), "count(*) AS PAY_COUNT"]
WIDE_ITEMS = [*stats(WIDE_SPECS + STATUS_SPECS, "CC_"), "count(*) AS CC_COUNT"]

APPLICATION = f"""
base AS (
  SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment,
         CASE WHEN c_acctbal < 0 THEN 'debit' ELSE 'credit' END AS side,
         c_acctbal AS balance, nullif(c_nationkey, 24) AS nation, quality AS target
  FROM customer LEFT JOIN labels ON doc_id = c_custkey),
kept AS (SELECT * FROM base WHERE segment IS DISTINCT FROM 'MACHINERY'),
sides AS (
  SELECT side AS s, dense_rank() OVER (ORDER BY min(c_custkey)) - 1 AS code FROM kept GROUP BY side),
application AS (
  SELECT c_custkey, code AS side, balance, nation, target,
         {", ".join(f"(segment IS NOT DISTINCT FROM '{v}')::INT AS segment_{v}" for v in SEGMENTS)},
         (segment IS NULL)::INT AS segment_nan,
         {ratio("balance", "nation")} AS balance_per_nation,
         {ratio("nation", "balance")} AS nation_per_balance
  FROM kept JOIN sides ON s = side)
"""

# --- long features of the declarative functions ---------------------------------------------

Declared = tuple[str, str, str | None, list[Spec]]  # component id, title, branch, features
ORDER_SHORT = [
    plain("days", "mean var", 0),
    plain("o_totalprice", "mean sum", 2),
    plain("l_linenumber_SIZE", "mean sum", 0),
]
LINE_SHORT = [
    plain("l_quantity", "mean", 2),
    ("PRICE_SHARE", "mean var", PRICE_SHARE, 6),
    plain("l_linenumber", "mean sum", 0),
]
ROWS = [("ROW_COUNT", "count", "1", 0)]
DECLARED: dict[str, tuple[str, list[Declared]]] = {
    "orders": (
        "order_rows",
        [
            ("B01", "all orders", None, ORDER_SHORT),
            ("B02", "open orders", "o_orderstatus = 'O'", ORDER_SHORT),
            ("B03", "done orders", "o_orderstatus = 'F'", ORDER_SHORT),
        ],
    ),
    "lines": (
        "line_rows",
        [
            ("P01", "all lines", None, LINE_SHORT),
            ("P02", "accepted lines", "l_returnflag = 'A'", LINE_SHORT),
            ("P03", "returned lines", "l_returnflag = 'R'", LINE_SHORT),
        ],
    ),
    "events": (
        "event_rows",
        [
            ("POS01", "event count", None, ROWS),
            ("POS02", "event means", None, [plain("value", "mean", 2), plain("hour", "mean", 0)]),
        ],
    ),
    "payments": (
        "line_rows",
        [
            ("I01", "payment count", None, ROWS),
            (
                "I02",
                "payment aggregates",
                None,
                [
                    ("DPD", "mean sum", PAST_DUE, 0),
                    ("PAID_PERC", "mean sum var", PAID_PERC, 6),
                    plain("amount_paid", "mean sum", 2),
                ],
            ),
            ("I03", "payment difference", None, [("PAID_DIFF", "mean sum var", PAID_DIFF, 2)]),
        ],
    ),
    "wide": (
        "line_rows",
        [
            ("C01", "line count", None, ROWS),
            (
                "C02",
                "line aggregates",
                None,
                [
                    plain("l_quantity", "mean sum var", 2),
                    plain("l_extendedprice", "mean sum var", 2),
                    plain("l_tax", "mean sum var", 2),
                ],
            ),
        ],
    ),
}


def declared_long(name: str) -> str:
    """SELECT of long features of one function; needs the HISTORY and LAYOUT tables."""
    source, components = DECLARED[name]
    items, rows = [], []
    for cid, title, cond, specs in components:
        for feature, ops, expr, scale in specs:
            for op in ops.split():
                column = f"x{len(items)}"
                items.append(f"{stat(expr, op, scale, cond, True)} AS {column}")
                value = f"coalesce({column}, 0)" if op in ("count", "sum") else column
                rows.append(
                    f"SELECT '{cid}' AS component_id, '{title}' AS component, app_index,"
                    f" '{feature}' AS feature, '{op}' AS operation, {value}::DOUBLE AS value,"
                    f" (hit IS NOT NULL)::INT AS source_present FROM joined"
                )
    agg = grouped(source, "c_custkey", [*items, "1 AS hit"])
    joined = f"SELECT app_index, g.* EXCLUDE (c_custkey) FROM layout LEFT JOIN ({agg}) g USING (c_custkey)"
    return f"(WITH joined AS MATERIALIZED ({joined}) {' UNION ALL '.join(rows)})"


def declared_statistics(name: str) -> str:
    source, components = DECLARED[name]
    items, rows = [], []
    for cid, title, cond, specs in components:
        for feature, _, expr, scale in specs:
            i = len(rows)
            u = units(expr, scale)
            u = f"CASE WHEN {cond} THEN {u} END" if cond else u
            items += [
                f"count({u}) AS n{i}",
                f"sum({u})::BIGINT AS s{i}",
                f"sum(({u})::HUGEINT * ({u})::HUGEINT)::HUGEINT AS q{i}",
            ]
            rows.append(
                f"SELECT '{cid}' AS component_id, '{title}' AS component, app_index, '{feature}' AS feature,"
                f" coalesce(n{i}, 0)::DOUBLE AS count,"
                f" coalesce(s{i}::DOUBLE / {10.0**scale:.1f}, 0.0) AS sum,"
                f" coalesce(q{i}::DOUBLE / {10.0 ** (2 * scale):.1f}, 0.0) AS sum_squares FROM joined"
            )
    agg = grouped(source, "c_custkey", items)
    joined = f"SELECT app_index, g.* EXCLUDE (c_custkey) FROM layout LEFT JOIN ({agg}) g USING (c_custkey)"
    return f"(WITH joined AS MATERIALIZED ({joined}) {' UNION ALL '.join(rows)})"


def moments_sql(source: str, key: str, expr: str, cond: str, scale: int) -> str:
    u = f"CASE WHEN {cond} THEN {units(expr, scale)} END"
    return f"""
      SELECT {key}, count({u})::DOUBLE AS count,
             coalesce(sum({u})::BIGINT, 0)::DOUBLE / {10.0**scale:.1f} AS sum,
             coalesce(sum(({u})::HUGEINT * ({u})::HUGEINT), 0)::DOUBLE / {10.0 ** (2 * scale):.1f} AS sum_squares
      FROM {source} GROUP BY {key}"""


def numbered(source: str, key: str, seed: int, alias: str, partition: str = "") -> str:
    by = f"PARTITION BY {partition} " if partition else ""
    return f"row_number() OVER ({by}ORDER BY md5('{seed}:' || {key}), {key}) - 1 AS {alias} FROM {source}"


LINE_SCORE = (
    "1.5::DOUBLE + (l_quantity * 0.5::DOUBLE + l_extendedprice * (-0.001)::DOUBLE"
    " + l_discount * 12.0::DOUBLE + l_tax * 3.25::DOUBLE)"
)
DOCUMENTS = """
docs AS (
  SELECT documents.doc_id, lang, n_chars, quality AS target
  FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id)
"""
SENDERS = """
senders AS (
  SELECT 'orders' AS source, o_custkey::VARCHAR AS key FROM orders
  UNION ALL SELECT 'events', user_id::VARCHAR FROM events
  UNION ALL SELECT 'supplier', s_suppkey::VARCHAR FROM supplier
  UNION ALL SELECT 'nation', n_nationkey::VARCHAR FROM nation)
"""
EVENT_KEYS = "event_keys AS (SELECT DISTINCT user_id AS c_custkey FROM events)"
CELLS = f"""
{LAYOUT.strip()},
placed AS (
  SELECT user_id AS c_custkey, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS slot,
         value, hour(ts) AS hour, (event_type = 'purchase')::INT AS mask FROM events),
width AS (SELECT max(slot) + 1 AS w FROM placed),
cells AS (
  SELECT app_index, slot AS cell, value, hour, mask, w
  FROM placed JOIN layout ON placed.c_custkey = layout.c_custkey CROSS JOIN width)
"""


def cents(name: str) -> str:
    return f"string_agg(round_even({name}::DOUBLE * 100.0, 0)::BIGINT::VARCHAR, ',' ORDER BY cell) AS {name}_cents"


def quality(name: str, table: str, key: str) -> str:
    return f"""
      SELECT '{name}' AS table_name, sum(n)::BIGINT AS rows, 0::BIGINT AS blank_rows, count(*) AS unique_keys,
             count(*) FILTER (WHERE n > 1) AS repeated_keys, max(n) = 1 AS valid
      FROM (SELECT {key}, count(*) AS n FROM {table} GROUP BY {key})"""


def fingerprint(source: str, size: int = 65_536) -> str:
    def level(below: str, by: str) -> str:
        return f"""(SELECT {by} AS pos, sha256(string_agg(t, '' ORDER BY pos)) AS t, sum(n)::BIGINT AS n
          FROM {below} GROUP BY {by})"""

    slots = f"""(SELECT app_index AS pos, sha256(app_index::VARCHAR || ':=' || c_custkey::VARCHAR) AS t, 1 AS n
      FROM {source})"""
    blocks = level(level(slots, f"pos // {size}"), f"pos // {size}")
    return f"SELECT n AS slots, t AS fingerprint FROM {level(blocks, 'pos - pos')}"


def other_layout(seed: int) -> str:
    return f"(SELECT c_custkey, {numbered('customer', 'c_custkey', seed, 'app_index')})"


def agreement(name: str, left: tuple[str, int], right: tuple[str, int]) -> str:
    def side(source: str, seed: int) -> str:
        return f"(SELECT k, {numbered(source, 'k', seed, 'p')})"

    return f"""
      SELECT '{name}' AS pair, count(a.p) AS left_rows, count(b.p) AS right_rows,
             count(*) FILTER (WHERE b.p IS NULL) AS left_only,
             count(*) FILTER (WHERE a.p IS NULL) AS right_only,
             count(*) FILTER (WHERE a.p <> b.p) AS moved
      FROM {side(*left)} a FULL JOIN {side(*right)} b USING (k)"""


ROUNDED = f"""
means AS (SELECT o_custkey AS c_custkey, {stat("o_totalprice", "mean", 2)} AS expected FROM orders GROUP BY 1),
compared AS (
  SELECT c_custkey, expected, round_even(expected * 1000.0, 0) / 1000.0 AS actual,
         abs(expected - round_even(expected * 1000.0, 0) / 1000.0) AS absolute_error FROM means)
"""
MINIMUM = [
    *stats([plain("value", "count min max mean sum var", 2)], "EVT_"),
    *stats([plain("value", "count min max mean sum var", 2)], "BUY_", "event_type = 'purchase'"),
]
ZERO_OPS = ("count", "sum", "mean")
ZERO_ITEMS = [
    f'{stat("value", op, 2, cond, True)} AS "{prefix}value_{op.upper()}"'
    for prefix, cond in (("ALL_", None), ("BUY_", "event_type = 'purchase'"))
    for op in ZERO_OPS
]
ZERO_COLUMNS = ", ".join(
    f"coalesce({p}value_{op.upper()}, 0) AS {p}value_{op.upper()}" if op != "mean" else f"{p}value_MEAN"
    for p in ("ALL_", "BUY_")
    for op in ZERO_OPS
)
SEGMENT_ITEMS = [
    item
    for prefix, cond in (("ALL_", None), ("OPEN_", "o_orderstatus = 'O'"), ("DONE_", "o_orderstatus = 'F'"))
    for item in stats([plain("o_totalprice", "size mean sum var", 2)], prefix, cond)
]
GRADED = f"""
scored AS (
  SELECT doc_id, n_chars // 10 AS score, quality FROM documents JOIN labels USING (doc_id)),
folded AS (SELECT score, quality, fold FROM (
  SELECT score, quality, (row_number() OVER (ORDER BY md5('1001:' || doc_id), doc_id) - 1) % {FOLDS} AS fold
  FROM scored)),
all_folds AS (SELECT fold, score, quality FROM folded UNION ALL SELECT -1, score, quality FROM folded),
merged AS (
  SELECT fold, score, count(*) FILTER (WHERE quality = 1) AS pos, count(*) FILTER (WHERE quality = 0) AS neg
  FROM all_folds GROUP BY fold, score),
ranked AS (
  SELECT *, sum(neg) OVER (PARTITION BY fold ORDER BY score) - neg AS below FROM merged)
"""

ORACLE_SQL: dict[str, str] = {
    "scan_limit": "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 10",
    "numeric_parse": """
      SELECT c_custkey, split_part(c_name, '#', 2)::DOUBLE AS name_number,
             CASE c_nationkey WHEN 3 THEN 12.5::DOUBLE WHEN 4 THEN 1000.0::DOUBLE END AS mixed_number,
             NULL::DOUBLE AS segment_number FROM customer""",
    "key_normalise": """
      SELECT c_custkey, CASE WHEN c_nationkey <> 0 THEN c_name END AS key FROM customer""",
    "append_missing_cols": f"WITH {DOCUMENTS} SELECT doc_id, lang, n_chars, target FROM docs",
    "label_split": f"""
      WITH {DOCUMENTS} SELECT doc_id, CASE WHEN target IS NULL THEN 'test' ELSE 'train' END AS part FROM docs""",
    "filter_ne_keep_null": """
      SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer
      WHERE c_mktsegment <> 'MACHINERY'""",
    "sentinel_to_null": """
      SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_discount END AS discount FROM lineitem""",
    "ratio_features": f"""
      SELECT l_orderkey, l_linenumber, {ratio("l_extendedprice", "l_discount")} AS price_per_discount,
             {ratio("l_extendedprice", "l_quantity")} AS price_per_unit,
             {ratio("l_discount", "l_tax")} AS discount_per_tax,
             {ratio("l_quantity", "l_extendedprice")} AS units_per_price,
             {ratio("l_quantity", "l_linenumber")} AS units_per_line FROM lineitem""",
    "difference_feature": f"""
      WITH {HISTORY} SELECT l_orderkey, l_linenumber, {PAID_DIFF} AS paid_diff FROM line_rows""",
    "positive_difference": f"""
      WITH {HISTORY}, late AS (
        SELECT l_orderkey, l_linenumber, nullif(day_paid, l_linenumber) - day_due AS gap FROM line_rows)
      SELECT l_orderkey, l_linenumber,
             CASE WHEN gap > 0 THEN gap WHEN gap <= 0 THEN 0 END::DOUBLE AS past_due,
             CASE WHEN gap < 0 THEN -gap WHEN gap >= 0 THEN 0 END::DOUBLE AS before_due,
             CASE WHEN gap > 0 THEN gap ELSE 0 END::DOUBLE AS past_due_zero,
             CASE WHEN gap < 0 THEN -gap ELSE 0 END::DOUBLE AS before_due_zero
      FROM late""",
    "label_encode": """
      WITH p AS (SELECT o_orderpriority AS v, dense_rank() OVER (ORDER BY min(o_orderkey)) - 1 AS code
                 FROM orders GROUP BY 1),
           s AS (SELECT o_orderstatus AS v, dense_rank() OVER (ORDER BY min(o_orderkey)) - 1 AS code
                 FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
      SELECT o_orderkey, p.code AS o_orderpriority, coalesce(s.code, -1) AS status
      FROM orders JOIN p ON p.v = o_orderpriority LEFT JOIN s ON s.v = o_orderstatus""",
    "one_hot": f"""
      WITH base AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer)
      SELECT c_custkey, {", ".join(f"coalesce(segment = '{v}', FALSE)::INT AS segment_{v}" for v in SEGMENTS)},
             (segment IS NULL)::INT AS segment_nan FROM base""",
    "one_hot_discovered": f"""
      SELECT o_orderkey, {", ".join(f"(o_orderstatus = '{v}')::INT AS o_orderstatus_{v}" for v in "FOP")},
             {", ".join(f"(o_orderpriority = '{v}')::INT AS " + chr(34) + f"o_orderpriority_{v}" + chr(34) for v in PRIORITIES)}
      FROM orders""",
    "branch_mask": """
      SELECT o_orderkey, (o_orderstatus = 'O')::INT::DOUBLE AS open_mask,
             (o_orderstatus = 'P')::INT::DOUBLE AS other_mask FROM orders""",
    "missing_compaction": """
      SELECT 'M01' AS component_id, 'discount' AS feature, count(*) FILTER (WHERE l_discount = 0) AS dropped
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      UNION ALL SELECT 'M01', 'DISC_PER_TAX', count(*) FILTER (WHERE l_tax = 0)
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      UNION ALL SELECT 'M01', 'PAID_DIFF', 0""",
    "linear_score": f"SELECT l_orderkey, l_linenumber, {LINE_SCORE} AS score FROM lineitem",
    "linear_score_array": """
      SELECT vec_id, 1.5::DOUBLE + list_reduce(list_prepend(0.0::DOUBLE,
               list_transform(embedding, lambda x, i: x::DOUBLE * (i::DOUBLE / 64.0::DOUBLE))),
               lambda a, b: a + b) AS score FROM embeddings""",
    "polynomial_score": """
      WITH e AS (SELECT event_id, value / 100.0::DOUBLE AS x FROM events)
      SELECT event_id, ((2.0::DOUBLE * x + 0.75::DOUBLE) * x + (-1.5)::DOUBLE) * x + 0.25::DOUBLE AS score FROM e""",
    "grouped_multi_agg": grouped(
        "(SELECT o_custkey AS c_custkey, o_totalprice FROM orders)",
        "c_custkey",
        [*stats([plain("o_totalprice", "count min max mean sum var", 2)], ""), "count(*) AS orders"],
    ),
    "group_count": "SELECT user_id AS c_custkey, count(*) AS events FROM events GROUP BY user_id",
    "group_nunique": """
      SELECT l_suppkey, count(DISTINCT l_linenumber) AS "l_linenumber_NUNIQUE",
             count(DISTINCT l_partkey) AS "l_partkey_NUNIQUE", count(*) AS lines
      FROM lineitem GROUP BY l_suppkey""",
    "category_share": grouped(
        "(SELECT o_custkey AS c_custkey, * FROM orders)",
        "c_custkey",
        [*shares("o_orderpriority", PRIORITIES), *shares("o_orderstatus", ("F", "O", "P"), missing=False)],
    ),
    "two_level_agg": f"WITH {HISTORY} "
    + grouped(
        "order_rows",
        "c_custkey",
        stats(
            [
                plain("l_linenumber_MIN", "min", 0),
                plain("l_linenumber_MAX", "max", 0),
                plain("l_linenumber_SIZE", "mean sum", 0),
                *CHILD_SHARES,
            ],
            "ORD_",
        ),
    ),
    "segmented_agg": grouped(
        "(SELECT o_custkey AS c_custkey, * FROM orders)", "c_custkey", SEGMENT_ITEMS
    ),
    "segmented_agg_zero": f"""
      WITH {HISTORY}, g AS ({grouped("event_rows", "c_custkey", ZERO_ITEMS)})
      SELECT customer.c_custkey, {ZERO_COLUMNS} FROM customer LEFT JOIN g USING (c_custkey)""",
    "wide_agg_all_numeric": grouped(
        "lineitem",
        "l_suppkey",
        [*stats([s for s in WIDE_SPECS if s[0] != "l_suppkey"], "CC_"), "count(*) AS CC_COUNT"],
    ),
    "masked_moments": moments_sql("lineitem", "l_suppkey", "l_extendedprice", "l_returnflag = 'A'", 2),
    "difference_moments": f"WITH {HISTORY} "
    + moments_sql("line_rows", "c_custkey", PAID_DIFF, "l_returnflag = 'R'", 2),
    "dot_product_agg": f"""
      SELECT l_suppkey, sum({units("l_quantity * l_extendedprice", 2)})::BIGINT::DOUBLE / 100.0 AS dot
      FROM lineitem GROUP BY l_suppkey""",
    "finalise_moments": """
      WITH g AS (
        SELECT user_id, count(*) AS n, sum(c)::BIGINT::DOUBLE AS s, sum(c * c)::BIGINT::DOUBLE AS ss
        FROM (SELECT user_id, round_even(value * 100.0, 0)::BIGINT AS c FROM events) GROUP BY user_id)
      SELECT *, s / n::DOUBLE AS mean,
             CASE WHEN n > 1 THEN greatest(ss - (s * s) / n::DOUBLE, 0.0) / (n::DOUBLE - 1.0) END AS var FROM g""",
    "chunked_dot_product": f"""
      WITH cells AS (
        SELECT vec_id, unnest(range(len(embedding))) AS position, unnest(embedding)::DOUBLE AS x FROM embeddings)
      SELECT vec_id, count(DISTINCT position // {CHUNK}) AS chunks,
             sum({units("x * ((position + 1)::DOUBLE / 64.0)", 6)})::BIGINT::DOUBLE / 1000000.0 AS dot
      FROM cells GROUP BY vec_id""",
    "restricted_child_count": """
      SELECT o_orderkey AS l_orderkey, count(l_orderkey) AS child_rows
      FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY o_orderkey""",
    "sufficient_stats": f"WITH {HISTORY}, {LAYOUT} SELECT * FROM {declared_statistics('orders')}",
    "presence_flag": f"""
      WITH {LAYOUT} SELECT app_index, (count(user_id) > 0)::INT AS source_present
      FROM layout LEFT JOIN events ON user_id = c_custkey GROUP BY app_index""",
    "long_features": f"""
      WITH {HISTORY}, {LAYOUT} SELECT * EXCLUDE (source_present) FROM {declared_long("events")}""",
    "scan_counters": """
      SELECT (SELECT count(*) FROM events) AS rows_scanned,
             (SELECT count(*) FROM events WHERE user_id IN (SELECT c_custkey FROM customer)) AS rows_matched,
             (SELECT count(*) FROM customer) AS entities,
             (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT user_id FROM events)) AS entities_matched,
             (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events))
               AS entities_unmatched""",
    "tolerance_compare": f"WITH {ROUNDED} SELECT *, absolute_error <= 0.0001::DOUBLE AS passed FROM compared",
    "tolerance_summary": f"""
      WITH {ROUNDED} SELECT count(*) AS checked_rows, max(absolute_error) AS max_absolute_error,
             {stat("absolute_error", "mean", 9)} AS mean_absolute_error,
             bool_and(absolute_error <= 0.0001::DOUBLE) AS passed FROM compared""",
    "topk_mean": f"""
      WITH best AS (
        SELECT p_brand, {stat("p_retailprice", "mean", 6)} AS m FROM part GROUP BY p_brand
        ORDER BY m DESC, p_brand LIMIT 5)
      SELECT p_brand, p_partkey, p_retailprice FROM part WHERE p_brand IN (SELECT p_brand FROM best)""",
    "mean_by_group": f"""
      SELECT l_partkey, {stat("l_extendedprice", "mean", 6)} AS mean FROM lineitem GROUP BY l_partkey""",
    "fn_application": f"WITH {APPLICATION} SELECT * FROM application",
    "fn_two_level_segmented": f"WITH {HISTORY} {grouped('order_rows', 'c_custkey', ORDER_ITEMS)}",
    "fn_segmented_ratio": f"WITH {HISTORY} {grouped('line_rows', 'c_custkey', LINE_ITEMS)}",
    "fn_count_means": f"WITH {HISTORY} {grouped('event_rows', 'c_custkey', EVENT_ITEMS)}",
    "fn_payment_behaviour": f"WITH {HISTORY} {grouped('line_rows', 'c_custkey', PAY_ITEMS)}",
    "fn_wide_numeric": f"WITH {HISTORY} {grouped('line_rows', 'c_custkey', WIDE_ITEMS)}",
    "end_to_end_features": f"""
      WITH {HISTORY}, {APPLICATION},
        a AS ({grouped("order_rows", "c_custkey", ORDER_ITEMS)}),
        b AS ({grouped("line_rows", "c_custkey", LINE_ITEMS)}),
        c AS ({grouped("event_rows", "c_custkey", EVENT_ITEMS)}),
        d AS ({grouped("line_rows", "c_custkey", PAY_ITEMS)}),
        e AS ({grouped("line_rows", "c_custkey", WIDE_ITEMS)})
      SELECT * FROM application LEFT JOIN a USING (c_custkey) LEFT JOIN b USING (c_custkey)
        LEFT JOIN c USING (c_custkey) LEFT JOIN d USING (c_custkey) LEFT JOIN e USING (c_custkey)""",
    "left_join_features": f"""
      WITH {HISTORY}, g AS ({grouped("event_rows", "c_custkey", MINIMUM)})
      SELECT c_custkey, c_nationkey, g.* EXCLUDE (c_custkey) FROM customer LEFT JOIN g USING (c_custkey)""",
    "selected_entity_probe": """
      SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice
      FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0""",
    "semi_join_keys": """
      SELECT c_custkey, c_name FROM customer
      WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
    "anti_join_keys": """
      SELECT c_custkey, c_name FROM customer
      WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)""",
    "aligned_layout": f"""
      WITH {LAYOUT}, {EVENT_KEYS}
      SELECT app_index, e.c_custkey FROM layout LEFT JOIN event_keys e ON e.c_custkey = layout.c_custkey""",
    "match_mapping": f"""
      WITH {LAYOUT}, {EVENT_KEYS} SELECT app_index, c_custkey FROM layout JOIN event_keys USING (c_custkey)""",
    "presence_mask": f"""
      WITH {LAYOUT}, {EVENT_KEYS}
      SELECT app_index, (e.c_custkey IS NOT NULL)::INT::DOUBLE AS present
      FROM layout LEFT JOIN event_keys e ON e.c_custkey = layout.c_custkey""",
    "alignment_counts": f"""
      WITH {EVENT_KEYS}
      SELECT count(*) AS dense_slots, count(e.c_custkey) AS intersection,
             count(*) - count(e.c_custkey) AS receiver_unmatched
      FROM customer LEFT JOIN event_keys e ON e.c_custkey = customer.c_custkey""",
    "bundle_join": f"WITH {HISTORY}, {LAYOUT} "
    + " UNION ALL ".join(f"SELECT '{name}' AS function, * FROM {declared_long(name)}" for name in DECLARED),
    "dense_index": """
      SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name) - 1 AS app_index FROM customer""",
    "shuffled_dense_index": f"WITH {LAYOUT} SELECT * FROM layout",
    "kfold_assign": f"""
      SELECT c_custkey, (i % {FOLDS})::INT AS fold
      FROM (SELECT c_custkey, {numbered("customer", "c_custkey", 1001, "i")})""",
    "stratified_kfold": f"""
      SELECT doc_id, quality, (i % {FOLDS})::INT AS fold
      FROM (SELECT doc_id, quality, {numbered("labels", "doc_id", 1001, "i", "quality")})""",
    "roc_auc": f"""
      WITH {GRADED}
      SELECT fold::INT AS fold, sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives,
             sum(pos * (2 * below + neg))::BIGINT::DOUBLE
               / nullif(2.0 * sum(pos)::DOUBLE * sum(neg)::DOUBLE, 0) AS auc
      FROM ranked GROUP BY fold""",
    "distinct_keys": "SELECT DISTINCT l_orderkey::VARCHAR AS l_orderkey FROM lineitem",
    "key_audit": """
      SELECT count(*) AS source_rows, count(DISTINCT l_orderkey) AS unique_keys,
             count(*) - count(DISTINCT l_orderkey) AS duplicate_rows_removed, 0::BIGINT AS blank_rows
      FROM lineitem""",
    "key_union": f"WITH {SENDERS} SELECT DISTINCT key FROM senders",
    "key_union_audit": f"""
      WITH {SENDERS}
      SELECT source, count(*) AS source_rows, count(DISTINCT key) AS unique_keys,
             count(*) - count(DISTINCT key) AS duplicate_rows_removed, 0::BIGINT AS blank_rows
      FROM (SELECT * FROM senders UNION ALL SELECT '(union)', key FROM senders) GROUP BY source""",
    "key_intersection": "SELECT c_custkey AS key FROM customer INTERSECT SELECT user_id FROM events",
    "key_difference": "SELECT c_custkey AS key FROM customer EXCEPT SELECT user_id FROM events",
    "pack_vectors": f"""
      WITH {CELLS}
      SELECT app_index, (cell // {CHUNK})::INT AS chunk, count(*)::INT AS cells,
             {cents("value")}, {cents("hour")}, {cents("mask")}
      FROM cells GROUP BY app_index, cell // {CHUNK}
      UNION ALL SELECT app_index, 0, 0, '', '', '' FROM layout WHERE app_index NOT IN (SELECT app_index FROM cells)""",
    "packed_moments": f"""
      WITH {CELLS}, m AS (SELECT app_index, {units("value", 2)}::HUGEINT AS u FROM cells WHERE mask = 1)
      SELECT layout.app_index, count(u)::DOUBLE AS count, coalesce(sum(u), 0)::DOUBLE / 100.0 AS sum,
             coalesce(sum(u * u), 0)::DOUBLE / 10000.0 AS sum_squares
      FROM layout LEFT JOIN m USING (app_index) GROUP BY layout.app_index""",
    "packed_dot": f"""
      WITH {CELLS}, m AS (SELECT app_index, {units("value * hour::DOUBLE", 2)} AS u FROM cells)
      SELECT layout.app_index, coalesce(sum(u), 0)::DOUBLE / 100.0 AS dot
      FROM layout LEFT JOIN m USING (app_index) GROUP BY layout.app_index""",
    "pack_difference_vectors": f"""
      WITH {HISTORY}, {LAYOUT}, placed AS (
        SELECT c_custkey, amount_due AS value, amount_paid AS right_side, (l_returnflag = 'R')::INT AS mask,
               row_number() OVER (PARTITION BY c_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
                 l_quantity, l_tax, l_shipdate, amount_due, amount_paid, l_returnflag = 'R') - 1 AS slot
        FROM line_rows),
      cells AS (
        SELECT app_index, slot AS cell, value, right_side, mask
        FROM layout JOIN placed ON placed.c_custkey = layout.c_custkey)
      SELECT app_index, (cell // {CHUNK})::INT AS chunk, {cents("value")},
             {cents("right_side").replace("right_side_cents", "right_cents")}, {cents("mask")}
      FROM cells GROUP BY app_index, cell // {CHUNK}
      UNION ALL SELECT app_index, 0, '', '', '' FROM layout WHERE app_index NOT IN (SELECT app_index FROM cells)""",
    "pack_width": """
      WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), c AS (SELECT count(*) AS slots FROM customer)
      SELECT slots, max(n) AS width, sum(n)::BIGINT AS matched, (slots * max(n) - sum(n))::BIGINT AS padding
      FROM g, c GROUP BY slots""",
    "flatten_vectors": f"WITH {CELLS} SELECT app_index * w + cell AS position, value FROM cells",
    "vector_manifest": f"""
      WITH {CELLS}, n AS (
        SELECT count(*) AS present, ((SELECT count(*) FROM layout) * max(w))::BIGINT AS elements FROM cells)
      SELECT unnest(['value', 'hour', 'mask']) AS vector, elements, present FROM n""",
    "array_dot": """
      SELECT vec_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(embedding, list_reverse(embedding)),
               lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), lambda a, b: a + b) AS dot FROM embeddings""",
    "array_moments": """
      WITH v AS (
        SELECT vec_id, list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: {
                 'x': p[1]::DOUBLE, 'd': p[1]::DOUBLE - p[2]::DOUBLE,
                 'm': CASE WHEN p[1] > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END}) AS c FROM embeddings),
      w AS (
        SELECT vec_id, list_transform(c, lambda p: p.m) AS n, list_transform(c, lambda p: p.m * p.x) AS s,
               list_transform(c, lambda p: p.m * p.x * p.x) AS q, list_transform(c, lambda p: p.m * p.d) AS ds,
               list_transform(c, lambda p: p.m * p.d * p.d) AS dq FROM v)
      SELECT vec_id, list_reduce(list_prepend(0.0::DOUBLE, n), lambda a, b: a + b) AS count,
             list_reduce(list_prepend(0.0::DOUBLE, s), lambda a, b: a + b) AS sum,
             list_reduce(list_prepend(0.0::DOUBLE, q), lambda a, b: a + b) AS sum_squares,
             list_reduce(list_prepend(0.0::DOUBLE, ds), lambda a, b: a + b) AS difference_sum,
             list_reduce(list_prepend(0.0::DOUBLE, dq), lambda a, b: a + b) AS difference_sum_squares
      FROM w""",
    "key_quality": quality("customer", "customer", "c_custkey")
    + " UNION ALL "
    + quality("orders", "orders", "o_custkey"),
    "repeated_keys": """
      SELECT o_custkey::VARCHAR AS key, count(*) AS rows FROM orders GROUP BY o_custkey HAVING count(*) > 1""",
    "dense_index_check": f"""
      WITH {LAYOUT}, x AS (
        SELECT 'layout' AS layout, app_index FROM layout UNION ALL SELECT 'orders', o_custkey FROM orders)
      SELECT layout, count(*) AS rows, min(app_index) AS lowest, max(app_index) AS highest,
             count(DISTINCT app_index) AS different,
             min(app_index) = 0 AND max(app_index) = count(*) - 1 AND count(DISTINCT app_index) = count(*) AS dense
      FROM x GROUP BY layout""",
    "ordered_key_agreement": f"""
      WITH r AS (SELECT DISTINCT o_custkey AS k FROM orders), s AS (SELECT DISTINCT user_id AS k FROM events),
      x AS ({agreement("same", ("r", SEED), ("r", SEED))} UNION ALL
            {agreement("sets", ("r", SEED), ("s", SEED))} UNION ALL
            {agreement("orders", ("r", SEED), ("r", SEED + 1))})
      SELECT *, CASE WHEN left_only > 0 OR right_only > 0 THEN 'sets differ'
                     WHEN moved > 0 THEN 'different orders' ELSE 'agree' END AS verdict FROM x""",
    "coverage_check": """
      WITH n AS (SELECT count(*) AS n FROM customer)
      SELECT 'POS01' AS component_id, 'ROW_COUNT' AS feature, 'count' AS operation, (n + 1) // 2 AS rows,
             (n + 1) // 2 AS slots, FALSE AS complete FROM n
      UNION ALL SELECT 'POS02', 'value', 'mean', n, n, TRUE FROM n
      UNION ALL SELECT 'POS02', 'hour', 'mean', n, n, TRUE FROM n""",
    "layout_fingerprint": f"WITH {LAYOUT} {fingerprint('layout')}",
    "layout_fingerprint_blocks": f"WITH {LAYOUT} {fingerprint('layout', 100)}",
    "bundle_compatibility": f"""
      WITH {LAYOUT}, other AS (SELECT * FROM {other_layout(SEED + 1)}), x AS (
        SELECT 'orders' AS bundle, * FROM ({fingerprint("layout")}) UNION ALL
        SELECT 'events', * FROM ({fingerprint("layout")}) UNION ALL
        SELECT 'lines', * FROM ({fingerprint("other")}))
      SELECT *, (SELECT count(DISTINCT fingerprint) = 1 AND count(DISTINCT slots) = 1 FROM x) AS compatible FROM x""",
    "oof_coverage": f"""
      SELECT doc_id, quality::DOUBLE AS label, (i % 10)::INT AS fold, TRUE AS in_range
      FROM (SELECT doc_id, quality, {numbered("(SELECT * FROM documents JOIN labels USING (doc_id))", "doc_id", 1001, "i")})
      UNION ALL SELECT doc_id, NULL, NULL, TRUE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "stage_finalise": f"WITH {HISTORY}, {LAYOUT} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS function, * EXCLUDE (source_present) FROM {declared_long(name)}"
        for name in ("orders", "events")
    ),
    "fold_importance_totals": """
      SELECT (i + 1)::INT AS fold, 14::BIGINT AS features, 1.0::DOUBLE AS importance FROM range(10) AS t(i)""",
    "mean_of_given_scores": "SELECT doc_id, ("
    + " + ".join(f"((n_chars * {i + 3}) % 101) / 128.0::DOUBLE" for i in range(10))
    + ") / 10.0::DOUBLE AS score FROM documents",
    "csv_typed_scan": "SELECT c_acctbal, c_custkey, c_mktsegment FROM customer",
    "csv_text_scan": """
      SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus FROM orders""",
    "json_sink": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
    "sink_keeps_what_is_there": "SELECT c_custkey, TRUE AS refused FROM customer",
    "submission_sink": 'SELECT c_custkey, c_nationkey AS "TARGET" FROM customer',
    "vector_sink": """
      SELECT c_nationkey::DOUBLE AS value, (SELECT count(*) FROM customer)::BIGINT AS elements FROM customer""",
    "model_features": """
      SELECT * EXCLUDE (l_orderkey, l_partkey, l_suppkey, l_shipdate, l_returnflag) FROM lineitem""",
    "stage_resume": f"WITH {HISTORY}, {LAYOUT} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS stage, TRUE AS loaded, count(*) AS rows FROM {declared_long(name)}"
        for name in ("orders", "events")
    ),
    "stage_summary": """
      SELECT 'prices' AS stage, count(DISTINCT o_custkey) AS rows FROM orders
      UNION ALL SELECT 'events', count(DISTINCT user_id) FROM events
      UNION ALL SELECT 'layout', count(*) FROM customer""",
}
ORACLE_SQL["function_by_name"] = ORACLE_SQL["grouped_multi_agg"]
