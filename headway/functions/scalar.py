"""Small Column helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_of(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def clip(value, low=None, high=None) -> Column:
    """Bound a value; null stays null."""
    value = col_of(value)
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def ratio(top, bottom) -> Column:
    """Quotient with division by zero and NaN as null."""
    out = F.try_divide(col_of(top).cast("double"), col_of(bottom).cast("double"))
    return F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out)


def normalize(value, mean, std) -> Column:
    return (col_of(value) - col_of(mean)) / col_of(std)


def denormalize(value, mean, std) -> Column:
    return col_of(value) * col_of(std) + col_of(mean)


def relabel(value, names: Mapping[str, str]) -> Column:
    """Replace known values, keep the rest."""
    value = col_of(value)
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)


def mps_to_mph(value) -> Column:
    return col_of(value) * 2.23694


def mph_to_mps(value) -> Column:
    return col_of(value) * 0.44704


def m_to_mi(value) -> Column:
    return col_of(value) / 1000 / 1.609


def mi_to_km(value) -> Column:
    return col_of(value) * 1.60934


def hash_number(keys, seed: int) -> Column:
    """A number below 2**48 that depends only on the key values and the seed.

    Made from MD5 of the joined texts, so that another engine can repeat a
    split, a sample or a random step.
    """
    text = F.concat_ws("|", *[col_of(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def param_of(name) -> Column:
    """``aux_power_kw`` from ``aux_power_kw-3``."""
    return F.split_part(col_of(name), F.lit("-"), F.lit(1))


def archetype_of(model) -> Column:
    """``GRU`` from ``GRU_STATIC_TUNED``."""
    return F.split_part(col_of(model), F.lit("_"), F.lit(1))


def is_tuned(model) -> Column:
    return F.element_at(F.split(col_of(model), "_"), -1) == "TUNED"


def day_of_file(name) -> Column:
    """The date from a name that starts with ``yyyy_MM_dd``."""
    return F.to_date(F.substring(col_of(name), 1, 10), "yyyy_MM_dd")


def array_from_text(text) -> Column:
    """An array of doubles held as text, as in the vehicle table."""
    return F.from_json(col_of(text), "array<double>")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing means null everywhere: comparisons with NaN differ from pandas."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")).cast(dict(df.dtypes)[c]) for c in floats})
