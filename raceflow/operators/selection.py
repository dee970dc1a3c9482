"""Column and row selection."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LeakageError(ValueError):
    """A post-event column is present among the features."""


def tolerant_select(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def reindex_fill(df: DataFrame, wanted: Sequence[str], fill: float = 0) -> DataFrame:
    """Exactly the wanted columns; absent ones and NULLs become ``fill``."""
    return df.select(*[(F.coalesce(F.col(c), F.lit(fill)) if c in df.columns else F.lit(fill)).alias(c)
                       for c in wanted])


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Sorted names of numeric columns that no pattern matches from the start."""
    patterns = [re.compile(p) for p in exclude]
    return sorted({f.name for f in df.schema
                   if isinstance(f.dataType, (T.NumericType, T.BooleanType))
                   and not any(p.match(f.name) for p in patterns)})


def columns_like(df: DataFrame, prefixes: Sequence[str] = (), suffixes: Sequence[str] = (),
                 contains: Sequence[str] = ()) -> list[str]:
    """Names belonging to a family given by prefix, suffix or substring."""
    return [c for c in df.columns
            if c.startswith(tuple(prefixes)) or c.endswith(tuple(suffixes)) or any(s in c for s in contains)]


def without_leakage(df: DataFrame, forbidden: Sequence[str], reject: bool = False) -> DataFrame:
    """Drop post-event columns, or refuse a frame that carries them."""
    found = [c for c in forbidden if c in df.columns]
    if found and reject:
        raise LeakageError(f"post-event columns present: {found}")
    return df.drop(*found)


def clean_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys as trimmed text; rows with a missing or literal ``nan`` key are dropped."""
    df = df.withColumns({k: F.trim(F.col(k).cast("string")) for k in keys})
    for k in keys:
        df = df.filter(F.col(k).isNotNull() & ~F.lower(k).isin("nan", ""))
    return df


def set_where(df: DataFrame, rules: Mapping[str, Sequence[tuple[Column, Column]]]) -> DataFrame:
    """Per column, the first (mask, value) that holds replaces its value."""
    updates = {}
    for name, cases in rules.items():
        out = F.col(name) if name in df.columns else F.lit(None)
        for mask, value in reversed(cases):
            out = F.when(mask, value).otherwise(out)
        updates[name] = out
    return df.withColumns(updates)


def relabel(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def template_name(template: str, context) -> str:
    """Column name for a context value: blanks and slashes become underscores."""
    return template.format(context=str(context).replace(" ", "_").replace("/", "_"))


def trailing_months(df: DataFrame, day: str, as_of: Column, months: int) -> DataFrame:
    """Rows of the last 30·months days up to ``as_of``."""
    return df.filter((F.col(day) >= F.date_sub(as_of, 30 * months)) & (F.col(day) <= as_of))


def value_bets(df: DataFrame, probability: str, odds: str, min_ev: float, min_probability: float) -> DataFrame:
    p, o = F.col(probability), F.col(odds)
    return df.filter((p * o >= min_ev) & (p >= min_probability) & (o >= 1.0))
