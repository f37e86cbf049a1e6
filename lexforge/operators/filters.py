"""Metadata filters compiled to columns, and row predicates."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compile_filter(spec: Mapping[str, Any] | None, field=F.col, known: set[str] | None = None) -> Column:
    """A conjunction of equality, ``$eq``, ``$in`` and ``$gte``/``$lte``.

    A value of None ignores its key; a field that is missing (not in ``known``, or null in a row) or an
    operator that is unknown excludes.
    """
    test = F.lit(True)
    for key, want in (spec or {}).items():
        if want is None:
            continue
        if known is not None and key not in known:
            return F.lit(False)
        value = field(key)
        if isinstance(want, Mapping):
            for op, x in want.items():
                part = {
                    "$eq": lambda: value == x,
                    "$in": lambda: value.isin(*x),
                    "$gte": lambda: value >= x,
                    "$lte": lambda: value <= x,
                }.get(op, lambda: F.lit(False))()
                test &= part
        elif isinstance(want, (list, tuple, set)):
            test &= value.isin(*want)
        else:
            test &= value == want
    return F.coalesce(test, F.lit(False))


def metadata_filter(df: DataFrame, spec: Mapping[str, Any] | None, map_col: str | None = None) -> DataFrame:
    """Rows that match; fields are columns, or keys of a map column."""
    if map_col:
        return df.where(compile_filter(spec, lambda k: F.try_element_at(map_col, F.lit(k))))
    return df.where(compile_filter(spec, known=set(df.columns)))


def merge_filters(explicit: Mapping[str, Any], generic: Mapping[str, Any] | None) -> dict[str, Any]:
    """Explicit fields that are set, overridden by a generic filter."""
    return {k: v for k, v in explicit.items() if v is not None} | dict(generic or {})


def contains_any(text: Column, terms: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    test = F.lit(False)
    for t in terms:
        test |= F.contains(low, F.lit(t.lower()))
    return test


def not_processed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in a checkpoint table."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def upsert(base: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Last write wins: for each key the row of highest version; changes win ties."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c != "_new"]
    best = both.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(version, "_new")).alias("r"))
    return best.select("r.*")
