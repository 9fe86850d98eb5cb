"""Runs a list of measures as grouped aggregations, one row per key.

Measures are split by the physical operator they allow: fixed-width ones share a hash
aggregate; text and ordered rows share one aggregate over a packed row; medians and distinct
counts go over a narrow long form. The parts meet again on the key, which they are already
partitioned by, so joining them adds no exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions import aggregates as A
from evenkeel.functions.aggregates import Measure
from evenkeel.functions.scalar import nan_to_null, to_double
from evenkeel.operators.ordering import exact_quantiles
from evenkeel.operators.skew import HOT_ROWS, hot_cell, hot_cells, unpivot

FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def source_column(m: Measure, schema: T.StructType) -> Column:
    """The measure's input with its cast, fill and row filter."""
    dtype = schema[m.col].dataType
    x = F.col(m.col)
    if m.mode != "raw":
        x = to_double(x)
        if isinstance(dtype, (T.FractionalType, T.StringType)):
            x = nan_to_null(x)
    if m.fill is not None:
        x = F.coalesce(x, F.lit(m.fill))
    if m.only is not None:
        name, value = m.only
        x = F.when(F.col(name) == F.lit(value), x)
    return x


def is_fixed_width(m: Measure, schema: T.StructType) -> bool:
    return m.mode != "raw" or isinstance(schema[m.col].dataType, FIXED_WIDTH)


def group_medians(
    df: DataFrame, key: str, columns: Mapping[str, Column], hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Exact median per key. Keys above ``hot_rows`` rows are selected through value buckets
    instead of being gathered in one buffer; None says that there are none."""
    medians = [F.median(c).alias(out) for out, c in columns.items()]
    cells = [] if hot_rows is None else hot_cells(df, key, hot_rows)
    if not cells:
        return df.groupBy(key).agg(*medians)
    hot = hot_cell(key).isin(cells)
    cold = df.where(~hot).groupBy(key).agg(*medians)
    # Grouped by hash and flag, which are never null: a key of null is a key like any other.
    at = ["__null", "__at"]
    rows = df.where(hot).withColumns({"__null": F.col(key).isNull(), "__at": F.xxhash64(key)})
    keys = rows.groupBy(*at, key).agg(F.lit(1).alias("__one")).drop("__one")
    long = exact_quantiles(rows, columns, [0.5], group=at, groups=None)
    picked = long.groupBy(*at).agg(*[F.max(F.when(F.col("feature") == out, F.col("q"))).alias(out) for out in columns])
    return cold.unionByName(keys.join(picked, at, "left").drop(*at))


def join_parts(left: DataFrame, right: DataFrame, key: str, nulls: bool = True) -> DataFrame:
    """Two tables of one row per key side by side; a key of null meets itself. Without such keys (``nulls``) the join
    needs no exchange; with them Spark deals both sides out again."""
    if not nulls:
        return left.join(right, key)
    other = right.withColumnRenamed(key, "__key")
    return left.join(other, left[key].eqNullSafe(other["__key"]), "left").drop("__key")


def group_distincts(df: DataFrame, key: str, columns: Mapping[str, Column]) -> DataFrame:
    """Distinct values per key with null counted as a value.

    Goes through (key, column, value) rows, so a hot key is spread by its values.
    """
    outs = list(columns)
    entries = [(str(i), {"v": columns[o].cast("string")}) for i, o in enumerate(outs)]
    values = unpivot(df, [key], entries, name="slot").groupBy(key, "slot", "v").agg(F.lit(1).alias("one"))
    return values.groupBy(key).agg(
        *[F.count(F.when(F.col("slot") == str(i), F.lit(1))).alias(o) for i, o in enumerate(outs)]
    )


def _after_grouping(m: Measure, decision: Column) -> Column:
    """Turn a statistic of the day number into one of (decision - day)."""
    x = F.col(m.out)
    if m.op in ("std", "var", "gap", "count", "nunique"):
        return x
    if m.op == "sum":
        return F.coalesce(F.col(f"__n_{m.out}") * decision - x, F.lit(0.0))
    return decision - x


def aggregate_by_key(
    df: DataFrame,
    key: str,
    measures: Sequence[Measure],
    order: Sequence[str] = (),
    decisions: DataFrame | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One row per key with one column per measure, in the order given.

    ``decisions`` (key, __decision_date) is needed by ``before`` measures only, and joins the
    grouped rows, never the raw ones. ``hot_rows`` of None says that no key is null or has many rows.
    """
    schema = df.schema
    if not measures:
        return df.select(key).distinct()
    inputs: dict[tuple, Column] = {}
    plain: list[Column] = []
    firsts: list[tuple[Measure, Column]] = []
    lasts: list[tuple[Measure, Column]] = []
    text: list[Column] = []
    medians: dict[str, Column] = {}
    distincts: dict[str, Column] = {}
    ordinal = A.order_key(order) if order else None
    long_order = len(order) == 1 and isinstance(schema[order[0]].dataType, T.IntegralType)

    for m in measures:
        A.check_op(m.op)
        if m.op == "row_count":
            plain.append(F.count(F.lit(1)).alias(m.out))
            continue
        source = (m.col, m.mode == "raw", m.fill, m.only)
        if source not in inputs:
            inputs[source] = source_column(m, schema)
        x = inputs[source]
        op = A.BEFORE_OPS.get(m.op, m.op) if m.mode == "before" else m.op
        if op == "median":
            medians[m.out] = x
        elif op == "nunique":
            distincts[m.out] = x
        elif op in A.ORDERED_OPS:
            if ordinal is None:
                raise ValueError(f"{m.out}: first/last need an order")
            if long_order and is_fixed_width(m, schema):
                pick = A.first_by if op == "first" else A.last_by
                plain.append(pick(x, ordinal).alias(m.out))
            else:
                (firsts if op == "first" else lasts).append((m, x))
        elif is_fixed_width(m, schema):
            plain.append(A.PLAIN_OPS[op](x).alias(m.out))
            if op == "sum" and m.mode == "before":
                plain.append(F.count(x).alias(f"__n_{m.out}"))
        else:
            text.append(A.PLAIN_OPS[op](x).alias(m.out))

    for rows, pick, name in ((firsts, A.first_by, "__first"), (lasts, A.last_by, "__last")):
        if rows:
            packed = F.struct(*[x.alias(m.out) for m, x in rows])
            text.append(pick(packed, ordinal).alias(name))

    parts = []
    if text and len(plain) <= 1:
        text, plain = [*plain, *text], []
    if plain:
        parts.append(df.groupBy(key).agg(*plain))
    if text:
        parts.append(df.groupBy(key).agg(*text))
    if distincts:
        parts.append(group_distincts(df, key, distincts))
    if medians:
        parts.append(group_medians(df, key, medians, hot_rows))
    out = parts[0]
    for part in parts[1:]:
        out = join_parts(out, part, key, nulls=hot_rows is not None)

    unpack = {m.out: F.col(f"__first.`{m.out}`") for m, _ in firsts}
    unpack |= {m.out: F.col(f"__last.`{m.out}`") for m, _ in lasts}
    before = {m.out: m for m in measures if m.mode == "before"}
    if before:
        if decisions is None:
            raise ValueError("measures relative to the decision date need decisions")
        if unpack:
            out = out.withColumns(unpack)
            unpack = {}
        out = out.join(decisions, key, "left")
    decision = F.col("__decision_date")
    return out.select(
        key,
        *[
            (
                unpack[m.out]
                if m.out in unpack
                else _after_grouping(m, decision)
                if m.out in before
                else F.col(f"`{m.out}`")
            ).alias(m.out)
            for m in measures
        ],
    )
