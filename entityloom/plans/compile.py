"""Compiles feature functions to grouped aggregates.

All components of a function share one scan. Where a grouping has many aggregates,
a row is narrower than its buffers: rows are moved to their key once, and one
grouping behind that holds all buffers without a second shuffle. A table with a
key of very many rows is not moved but merged by map tasks, in parts that stay
within Spark's generated code and read their own columns each.

Branches are never filtered copies joined back. They are conditional aggregates
of the same grouping as long as its buffers stay within that width. Beyond it,
rows are first merged per key and branch value, with one set of buffers however
many branches there are, and the few merged rows are combined per key.

Every aggregate but ``nunique`` is algebraic, so map tasks can merge the rows of a
key before any shuffle, and then a key that holds a large part of the table costs
one buffer per map task. Distinct counts are grouped on their own: Spark then
merges equal values before it counts, and the wide buffers stay out of it.

Aggregates and outputs are SQL text over generated column names.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from entityloom.functions import fixedpoint as fx, scalars
from entityloom.operators.ordering import largest_group
from entityloom.plans.spec import Feature, HistoryFunction
from entityloom.sources.readers import require_columns

SMALL_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType)
WHOLE_NUMBERS = (*SMALL_NUMBERS, T.LongType)
MERGE = {"min": "min", "max": "max", "ssw": "try_sum"}  # every other statistic merges by addition
COUNTS = ("n", "size", "hits")
WIDE_PARTS = ("wh", "ssw", "ssd")  # of units of more than 31 bits
# Spark leaves generated code for rows wider than 100 fields; beyond
# the second width merging per branch value measured faster than conditionals.
MAX_BUFFERS = 95
MAX_CONDITIONAL_BUFFERS = 80
# Groupings of more aggregates get their rows by key first, unless a
# key has more rows than one task should take.
MAX_UNMOVED_AGGREGATES = 40
MAX_MOVED_ROWS = 1 << 20
Branch = tuple[str, str] | None


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def _text(value: str | None) -> str:
    """SQL literal."""
    if value is None:
        return "NULL"
    quoted = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{quoted}'"


def _number(df: DataFrame, name: str) -> Column:
    text = isinstance(df.schema[name].dataType, T.StringType)
    return scalars.parse_number(column(name)) if text else scalars.finite(column(name))


def feature_value(df: DataFrame, feature: Feature) -> Column:
    """The feature's finite double per row, missing when a source is missing."""
    if feature.transform == "rows":
        return F.lit(1.0)
    values = [_number(df, name) for name in feature.columns]
    if feature.transform == "identity":
        return values[0]
    if feature.transform == "child_size":
        return F.nullif(values[0], F.lit(0.0))
    if len(values) != 2:
        raise ValueError(f"feature {feature.name}: {feature.transform} needs two source columns")
    if feature.transform == "ratio":
        return scalars.ratio(*values)
    if feature.transform == "difference":
        return scalars.finite(scalars.difference(*values))
    missing = "zero" if feature.transform == "positive_difference_zero" else "drop"
    return scalars.positive_difference(*values, missing=missing)


def _is_of(df: DataFrame, feature: Feature, types: tuple) -> bool:
    """Whether a feature is a column of one of the types as it stands."""
    same = feature.transform == "identity" and feature.scale == 0
    return same and isinstance(df.schema[feature.columns[0]].dataType, types)


def feature_units(df: DataFrame, feature: Feature) -> Column:
    if _is_of(df, feature, SMALL_NUMBERS):
        return column(feature.columns[0]).cast("int")
    if _is_of(df, feature, WHOLE_NUMBERS):
        return column(feature.columns[0]).cast("bigint")
    return fx.to_units(feature_value(df, feature), feature.scale)


class _Plan:
    """Row columns, aggregates per key (and branch) and distinct counts, each kept once."""

    def __init__(self, df: DataFrame, key: str, functions: Sequence[HistoryFunction]):
        self.df = df.filter(column(key).isNotNull())
        self.key = key
        self.rows: dict[tuple, tuple[str, Column]] = {}
        self.limbs: dict[str, str] = {}  # text over row columns -> name
        self.base: dict[str, tuple[str, str]] = {}  # aggregate text -> name, kind
        self.wanted: dict[tuple[str, Branch], str] = {}  # base name, branch -> name
        self.distinct: dict[str, str] = {}  # row column -> name
        # Texts that are used repeatedly -> name: over the statistics, and over these and the statistics.
        self.derived: tuple[dict[str, str], dict[str, str]] = ({}, {})
        self.branches = sorted({c.branch for fn in functions for c in fn.components if c.branch})
        features = [f for fn in functions for c in fn.components for f in c.features]
        mergeable = all(f.scale is not None or "var" not in f.operations for f in features)
        one_column = len({name for name, _ in self.branches}) == 1
        width = _conditional_width(functions, self.kind)
        self.two_levels = one_column and mergeable and width > MAX_CONDITIONAL_BUFFERS

    def kind(self, feature: Feature) -> str:
        """Type of the units of an exact feature."""
        if _is_of(self.df, feature, SMALL_NUMBERS):
            return "int"
        return "long" if _is_of(self.df, feature, WHOLE_NUMBERS) else "double"

    def row(self, signature: tuple, make) -> str:
        if signature not in self.rows:
            self.rows[signature] = (f"r{len(self.rows)}", make())
        return self.rows[signature][0]

    def _within(self, branch: Branch, signature: tuple, make) -> str:
        """Row column that is missing outside the branch."""
        if branch is None:
            return self.row(signature, make)
        inside = column(branch[0]).eqNullSafe(F.lit(branch[1]))
        return self.row((*signature, branch), lambda: F.when(inside, make()))

    def value(self, feature: Feature, branch: Branch = None) -> str:
        def make() -> Column:
            return feature_value(self.df, feature) if feature.scale is None else feature_units(self.df, feature)

        signature = (feature.transform, feature.columns, feature.scale)
        return self._within(None if self.two_levels else branch, signature, make)

    def limb(self, text: str) -> str:
        """Row column made from other row columns, once for all aggregates that read it."""
        return text if text == "NULL" else self.limbs.setdefault(text, f"l{len(self.limbs)}")

    def mark(self) -> str:
        """Row column with the branch value, missing outside all branches."""
        name = self.branches[0][0]
        values = [value for _, value in self.branches]
        return self.row(("mark",), lambda: F.when(column(name).isin(values), column(name)))

    def aggregate(self, kind: str, text: str, branch: Branch) -> str:
        """Name of a statistic; ``text`` aggregates row columns."""
        base = self.base.setdefault(text, (f"b{len(self.base)}", kind))[0]
        if not self.two_levels:
            return base
        return self.wanted.setdefault((base, branch), f"w{len(self.wanted)}")

    def derive(self, text: str, level: int) -> str:
        """Name of a column made once per key, behind the grouping."""
        return self.derived[level].setdefault(text, f"x{level}_{len(self.derived[level])}")

    def size(self, branch: Branch) -> str:
        if branch is None or self.two_levels:
            return self.aggregate("size", "count(1)", branch)
        return self.aggregate("size", f"count({self._within(branch, ('one',), lambda: F.lit(1))})", branch)

    def hits(self, name: str, value: str | None) -> str:
        of = self.row(("raw", name), lambda: column(name))
        return self.aggregate("hits", f"count_if({of} <=> {_text(value)})", None)

    def nunique(self, name: str, branch: Branch) -> str:
        of = self._within(branch, ("raw", name), lambda: column(name))
        return self.distinct.setdefault(of, f"d{len(self.distinct)}")

    def grouped(self) -> DataFrame:
        """One row per key with all requested statistics."""
        if not self.base:
            self.size(None)
        if self.two_levels:
            self.mark()
        moved = len(self.base) > MAX_UNMOVED_AGGREGATES and largest_group(self.df, self.key) <= MAX_MOVED_ROWS
        source = self.df.hint("rebalance", column(self.key)) if moved else self.df
        rows = source.select(column(self.key).alias("k"), *[c.alias(n) for n, c in self.rows.values()])
        split = rows.selectExpr("*", *[f"{text} AS {name}" for text, name in self.limbs.items()])
        parts = [self._aggregated(split, part) for part in self._parts(None if moved else MAX_BUFFERS)]
        parts += [_group(rows, ["k"], {name: f"count(DISTINCT {of})"}) for of, name in self.distinct.items()]
        joined = reduce(lambda left, right: left.join(right, "k"), parts)
        for texts in self.derived:
            joined = joined.selectExpr("*", *[f"{text} AS {name}" for text, name in texts.items()])
        return joined.withColumnRenamed("k", self.key)

    def _parts(self, widest: int | None) -> list[dict[str, str]]:
        """Aggregates ``name -> text`` in parts of at most ``widest`` buffers.

        Parts are cut in feature order, so each reads its own columns only.
        """
        parts: list[dict[str, str]] = [{}]
        width = 0
        for text, (name, kind) in self.base.items():
            fields = 3 if kind == "var" else 1
            if widest and width + fields > widest:
                parts.append({})
                width = 0
            parts[-1][name] = text
            width += fields
        return parts

    def _aggregated(self, rows: DataFrame, part: Mapping[str, str]) -> DataFrame:
        if not self.two_levels:
            return _group(rows, ["k"], part)
        per_branch = _group(rows, ["k", self.mark()], part)
        return _group(per_branch, ["k"], self._merged(part))

    def _merged(self, part: Mapping[str, str]) -> dict[str, str]:
        """The statistics per key from those per key and branch value."""
        kinds = dict(self.base.values())
        merged = {}
        for (base, branch), name in self.wanted.items():
            if base not in part:
                continue
            picked = f"CASE WHEN {self.mark()} = {_text(branch[1])} THEN {base} END" if branch else base
            text = f"{MERGE.get(kinds[base], 'sum')}({picked})"
            merged[name] = f"coalesce({text}, 0L)" if kinds[base] in COUNTS else text
        return merged


def _conditional_width(functions: Sequence[HistoryFunction], kind_of: Callable[[Feature], str]) -> int:
    """Buffers of a single grouping with one conditional aggregate per branch."""
    needs = {
        "count": "n",
        "sum": "s wh",
        "mean": "n s wh",
        "var": "n s wh hi lo ssw ssd",
        "min": "min",
        "max": "max",
        "size": "size",
        "nunique": "",
    }
    buffers = {
        (c.branch, f.transform, f.columns, f.scale, kind)
        for function in functions
        for c in function.components
        for f in c.features
        for op in f.operations
        for kind in needs[op].split()
        if not (kind in WIDE_PARTS and kind_of(f) == "int")
    }
    hits = sum(len(share.outputs()) for function in functions for share in function.shares)
    return len(buffers) + hits + len({c.branch for fn in functions for c in fn.components})


def _group(rows: DataFrame, keys: Sequence[str], aggregates: Mapping[str, str]) -> DataFrame:
    """``GROUP BY`` with many aggregates given as text, handed to Spark in one call."""
    items = ", ".join([*keys, *[f"{text} AS {name}" for name, text in aggregates.items()]])
    return rows.sparkSession.sql(f"SELECT {items} FROM {{rows}} GROUP BY {', '.join(keys)}", rows=rows)


def _parts(plan: _Plan, feature: Feature, branch: Branch, squares: bool) -> tuple[str, ...]:
    """Names of the parts of an exact sum or sum of squares."""
    units = plan.value(feature, branch)
    limbs = [plan.limb(text) for text in fx.limbs(units, plan.kind(feature))]
    made = fx.square_sums(units, *limbs) if squares else fx.sums(*limbs)
    return tuple(plan.aggregate(part, text, branch) for part, text in made.items())


def _exact(plan: _Plan, feature: Feature, branch: Branch, squares: bool) -> tuple[str, str]:
    """Columns with the exact sum, or sum of squares, and with the same as a double."""
    parts = _parts(plan, feature, branch, squares)
    exact = plan.derive(fx.exact_squares(*parts) if squares else fx.exact_total(*parts), 0)
    whole = fx.combined_squares if squares else fx.total
    return exact, plan.derive(whole(*parts, exact=exact), 1)


def _statistic(plan: _Plan, feature: Feature, kind: str, branch: Branch) -> str:
    """Name or text of one statistic: n, s, ss, min, max, var."""
    of = plan.value(feature, branch)
    if kind == "ss":
        if feature.scale is None:
            return plan.aggregate("ss", f"sum({of} * {of})", branch)
        return _exact(plan, feature, branch, True)[1]
    if kind == "s" and feature.scale is not None:
        return _exact(plan, feature, branch, False)[1]
    name = {"n": "count", "s": "sum", "min": "min", "max": "max", "var": "var_samp"}[kind]
    return plan.aggregate(kind, f"{name}({of})", branch)


def _operation(plan: _Plan, feature: Feature, operation: str, branch: Branch) -> str:
    if operation == "size" or (feature.transform == "rows" and operation == "count"):
        return plan.size(branch)
    if operation == "nunique":
        return plan.nunique(feature.columns[0], branch)

    def get(kind: str) -> str:
        return _statistic(plan, feature, kind, branch)

    exact = feature.scale is not None
    if operation == "count":
        return get("n")
    if operation in ("min", "max"):
        return fx.from_units(get(operation), feature.scale) if exact else get(operation)
    if operation == "sum":
        total = fx.from_units(get("s"), feature.scale) if exact else get("s")
        return f"coalesce({total}, 0.0D)"
    if operation == "mean":
        return fx.mean(get("n"), get("s"), feature.scale or 0)
    if exact:
        (whole, total), (squares, rounded) = (_exact(plan, feature, branch, x) for x in (False, True))
        doubles = None if plan.kind(feature) == "int" else (total, rounded)
        return fx.sample_variance(get("n"), whole, squares, doubles, feature.scale)
    return get("var")


def _plan(df: DataFrame, functions: Sequence[HistoryFunction]) -> _Plan:
    keys = {function.key for function in functions}
    if len(keys) != 1:
        raise ValueError(f"functions over one table need one key, got {sorted(keys)}")
    for function in functions:
        require_columns(df, function.required_columns(), function.name)
        function.output_columns()
    return _Plan(df, keys.pop(), functions)


def aggregate_histories(
    df: DataFrame, functions: Sequence[HistoryFunction], empty: str = "null"
) -> DataFrame:
    """One row per key with the outputs of all ``functions`` over ``df``.

    ``empty`` is the value of counts and sums of a branch without rows:
    ``'null'`` leaves them missing, ``'zero'`` makes them 0.
    """
    if empty not in ("null", "zero"):
        raise ValueError(f"unknown empty mode: {empty}")
    plan = _plan(df, functions)
    outputs = [f"{text} AS `{name}`" for function in functions for name, text in _outputs(plan, function, empty)]
    return plan.grouped().selectExpr(f"`{plan.key}`", *outputs)


def _outputs(plan: _Plan, function: HistoryFunction, empty: str) -> list[tuple[str, str]]:
    """``(column name, text over the statistics)`` of every output."""
    made: list[tuple[str, str]] = []
    for component, feature, operation, name in function.outputs():
        branch = component.branch
        text = _operation(plan, feature, operation, branch)
        if branch and empty == "null" and operation in ("count", "size", "sum", "nunique"):
            text = f"CASE WHEN {plan.size(branch)} > 0 THEN {text} END"
        made.append((name, text))
    for share in function.shares:
        for value, name in share.outputs():
            hits, size = plan.hits(share.column, value), plan.size(None)
            made.append((name, f"cast({hits} AS double) / cast({size} AS double)"))
    return made


def aggregate_history(df: DataFrame, function: HistoryFunction, empty: str = "null") -> DataFrame:
    return aggregate_histories(df, [function], empty)


def attach(
    entity: DataFrame,
    features: DataFrame,
    key: str,
    functions: Sequence[HistoryFunction] = (),
    empty: str = "null",
) -> DataFrame:
    """Left join one feature table; in the zero mode absent counts and sums are 0."""
    joined = entity.join(features, key, "left")
    if empty == "zero":
        additive = [c for f in functions for c in f.additive_columns()]
        joined = joined.fillna(0, subset=additive)
    return joined


def _inline(df: DataFrame, keep: Sequence[str], names: Sequence[str], entries: Sequence[Sequence[str]]) -> DataFrame:
    """One output row per entry, each a list of SQL texts for ``names``."""
    structs = [
        f"named_struct({', '.join(f'{_text(n)}, {e}' for n, e in zip(names, entry))})" for entry in entries
    ]
    kept = [f"`{k}`" for k in keep]
    return df.selectExpr(*kept, f"inline(array({', '.join(structs)}))")


def long_features(
    entity: DataFrame,
    df: DataFrame,
    function: HistoryFunction,
    index: str = "app_index",
    present: str | None = None,
) -> DataFrame:
    """One row per ``(slot, component, feature, operation)``, zero mode.

    Columns: ``component_id, component, app_index, feature, operation, value``,
    and with ``present`` a 0/1 column of that name: does any feature of the
    slot have a value in the history?
    """
    long = _long(entity, df, [function], index, present or "_present").drop("function")
    return long if present else long.drop("_present")


def bundle_features(
    entity: DataFrame,
    histories: Mapping[str, DataFrame],
    functions: Sequence[HistoryFunction],
    index: str = "app_index",
    present: str = "source_present",
) -> DataFrame:
    """The long features of several functions in one table, with a ``function`` column.

    Functions over one history share its scan, its grouping and one join to the
    slots; ``histories`` are named by the functions' ``table``.
    """
    by_table: dict[str, list[HistoryFunction]] = {}
    for function in functions:
        by_table.setdefault(function.table, []).append(function)
    parts = [_long(entity, histories[table], group, index, present) for table, group in by_table.items()]
    return reduce(DataFrame.unionByName, parts)


def _long(
    entity: DataFrame, df: DataFrame, functions: Sequence[HistoryFunction], index: str, present: str
) -> DataFrame:
    plan = _plan(df, functions)
    entries: list[list[str]] = []
    marks = {}
    for number, function in enumerate(functions):
        texts = dict(_outputs(plan, function, "zero"))
        additive = set(function.additive_columns())
        counts = [
            plan.size(c.branch) if f.transform == "rows" else _statistic(plan, f, "n", c.branch)
            for c in function.components
            for f in c.features
        ]
        mark = f"_present{number}"
        marks[mark] = F.expr(f"cast(coalesce({' > 0 OR '.join(counts)} > 0, false) AS int)")
        for c, f, op, name in function.outputs():
            value = f"cast({texts[name]} AS double)"
            value = f"coalesce({value}, 0.0D)" if name in additive else value
            labels = [_text(x) for x in (function.name, c.id, c.title, f.name, op)]
            entries.append([*labels, value, mark])
    slots = entity.select(index, plan.key)
    joined = slots.join(plan.grouped(), plan.key, "left").withColumns(marks)
    names = ["function", "component_id", "component", "feature", "operation", "value", present]
    return _inline(joined, [index], names, entries).select(
        "function", "component_id", "component", index, "feature", "operation", "value", present
    )


def sufficient_statistics(
    entity: DataFrame, df: DataFrame, function: HistoryFunction, index: str = "app_index"
) -> DataFrame:
    """Long ``(count, sum, sum_squares)`` per slot, component and feature."""
    plan = _plan(df, [function])
    entries: list[list[str]] = []
    for component in function.components:
        for feature in component.features:
            if feature.transform == "rows":
                n = s = ss = plan.size(component.branch)
            else:
                n, s, ss = [_statistic(plan, feature, k, component.branch) for k in ("n", "s", "ss")]
                if feature.scale is not None:
                    s = fx.from_units(s, feature.scale)
                    ss = fx.from_units(ss, 2 * feature.scale)
            numbers = [f"coalesce(cast({x} AS double), 0.0D)" for x in (n, s, ss)]
            entries.append([_text(component.id), _text(component.title), _text(feature.name), *numbers])
    joined = entity.select(index, function.key).join(plan.grouped(), function.key, "left")
    names = ["component_id", "component", "feature", "count", "sum", "sum_squares"]
    return _inline(joined, [index], names, entries).select(
        "component_id", "component", index, "feature", "count", "sum", "sum_squares"
    )


def missing_counts(df: DataFrame, function: HistoryFunction) -> DataFrame:
    """Keyed rows per feature that carry no value, as ``(component_id, feature, dropped)``."""
    plan = _plan(df, [function])
    totals: list[Column] = []
    entries: list[list[str]] = []
    for component in function.components:
        for feature in component.features:
            if feature.transform == "rows":
                continue
            alias = f"m{len(totals)}"
            totals.append(F.expr(f"count_if({plan.value(feature)} IS NULL)").alias(alias))
            entries.append([_text(component.id), _text(feature.name), alias])
    rows = plan.df.select(*[c.alias(n) for n, c in plan.rows.values()])
    return _inline(rows.agg(*totals), [], ["component_id", "feature", "dropped"], entries)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns in schema order."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)
    ]


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """All columns but the target, the identifiers and the index."""
    return [c for c in df.columns if c not in set(exclude)]
