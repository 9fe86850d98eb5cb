"""Row-level expressions with the null rules the feature code relies on."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.naming import DEFAULT, Naming

NULL_DOUBLE = "double"
# Fixed values of the string hash.
HASH_MODULUS = 2147483647
HASH_SEED = 42


def null_of(dtype: str) -> Column:
    return F.lit(None).cast(dtype)


def to_double(c: Column | str) -> Column:
    """Lenient cast: text that is no number becomes null."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, null_of("double"))


def day_number(c: Column, dtype: T.DataType) -> Column:
    """Days since 1970-01-01 as int; malformed or partial text becomes null."""
    if isinstance(dtype, T.StringType):
        # The shortest full date is yyyy-m-d; shorter text would be read as year or month.
        return F.unix_date(F.when(F.length(F.trim(c)) >= 8, c.try_cast("date")))
    if isinstance(dtype, T.NullType):
        return null_of("int")
    return F.unix_date(c.cast("date"))


def normalize_dates(df: DataFrame, naming: Naming = DEFAULT) -> DataFrame:
    """Turn every date-named, non-numeric column into int days."""
    out = {
        f.name: day_number(F.col(f.name), f.dataType)
        for f in df.schema.fields
        if naming.is_date(f.name) and not isinstance(f.dataType, T.NumericType)
    }
    return df.withColumns(out) if out else df


def days_before(decision: Column | str, event: Column | str) -> Column:
    """Positive when the event lies before the decision."""
    return to_double(decision) - to_double(event)


def days_after(event: Column | str, decision: Column | str) -> Column:
    """Positive when the event lies after the decision."""
    return to_double(event) - to_double(decision)


def decision_month(days: Column) -> Column:
    return F.month(F.date_from_unix_date(days.cast("int")))


def decision_weekday(days: Column) -> Column:
    """ISO weekday, Monday = 1."""
    return F.weekday(F.date_from_unix_date(days.cast("int"))) + 1


def safe_div(num: Column, den: Column) -> Column:
    """Quotient where the denominator is positive."""
    return F.when(den > 0, num / den)


def safe_ratio(num: Column, den: Column, eps: float = 1e-6) -> Column:
    """Quotient where the denominator is not close to zero."""
    return F.when(F.abs(den) > eps, num / den)


def _balanced(parts: Sequence[Column], op) -> Column:
    """Combine as a balanced tree: a 600-deep chain would overflow the analyzer."""
    layer = list(parts)
    while len(layer) > 1:
        layer = [op(*layer[i : i + 2]) if i + 1 < len(layer) else layer[i] for i in range(0, len(layer), 2)]
    return layer[0]


def sum_of_row(parts: Sequence[Column]) -> Column:
    return _balanced(parts, lambda a, b: a + b)


def any_of_row(parts: Sequence[Column]) -> Column:
    return _balanced(parts, lambda a, b: a | b)


def null_count_row(names: Sequence[str]) -> Column:
    return sum_of_row([F.col(n).isNull().cast("int") for n in names])


def max_of_row(parts: Sequence[Column]) -> Column:
    """Largest non-null value of the row."""
    return parts[0] if len(parts) == 1 else F.greatest(*parts)


def min_of_row(parts: Sequence[Column]) -> Column:
    return parts[0] if len(parts) == 1 else F.least(*parts)


def hash_string(c: Column, seed: int = HASH_SEED) -> Column:
    """Non-negative seeded hash, null as -1: the first 60 bits of the md5 of seed and text, so other engines get the same."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c)), 1, 15), 16, 10).cast("long")
    code = F.pmod(bits, F.lit(HASH_MODULUS)).cast("int")
    return F.when(c.isNull(), F.lit(-1)).otherwise(code)


def hash_string_columns(df: DataFrame, seed: int = HASH_SEED) -> DataFrame:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: hash_string(F.col(n), seed) for n in names}) if names else df


def fill_missing(df: DataFrame, number: float = -1, text: str = "Missing", skip: Sequence[str] = ()) -> DataFrame:
    """Constant fill by type; whole-number columns keep their type."""
    out = {}
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, T.NumericType):
            out[f.name] = F.coalesce(F.col(f.name), F.lit(number).cast(f.dataType))
        elif isinstance(f.dataType, T.StringType):
            out[f.name] = F.coalesce(F.col(f.name), F.lit(text))
    return df.withColumns(out) if out else df


def clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def month_period(year: Column, month: Column) -> Column:
    return year * 12 + month


def week_index(days: Column, origin: Column | int) -> Column:
    """Whole weeks since the origin day, rounded down also before it."""
    origin = F.lit(origin) if isinstance(origin, int) else origin
    return F.floor((days - origin) / F.lit(7.0)).cast("long")


def log_ratio_term(p: Column, q: Column) -> Column:
    """One bin's share of a divergence sum."""
    return (p - q) * F.log(p / q)


def age_years(days: Column) -> Column:
    return days / F.lit(365.25)


def all_of_row(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def log1p_count(count: Column) -> Column:
    return F.log1p(count)


def has_record(count: Column) -> Column:
    """1 where a count is above zero, 0 where it is not, null where it is missing."""
    return (count > 0).cast("int")


def chosen(condition: Column, value: Column | None = None) -> Column:
    """The value where the condition holds, else null; without a value a 0/1 flag of the condition."""
    return F.when(condition, 1).otherwise(0) if value is None else F.when(condition, value)
