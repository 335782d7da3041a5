"""How joined values become columns: replace modes, first and last match, folds, ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILL, OVERWRITE = "+", "-"


def merged(existing: Column, new: Column, mode: str = FILL) -> Column:
    """'+' fills what is missing, '-' overwrites where there is a new value."""
    return F.coalesce(existing, new) if mode == FILL else F.coalesce(new, existing)


def match_value(value: Column, order: Column, mode: str = FILL) -> Column:
    """Aggregate over matches in database order: the first value that isn't missing, or the last for '-'."""
    known = F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))
    return (F.min(known) if mode == FILL else F.max(known))["v"]


def fold(*values: Column) -> Column:
    """Databases in order of the plan: the first that has a value wins."""
    return F.coalesce(*values)


def merged_filters(existing: Column, new: Column, mode: str = FILL) -> Column:
    """FILTER sets: filled only where there are none, or replaced."""
    empty = existing.isNull() | (F.size(existing) == 0)
    return F.when(empty, new).otherwise(existing) if mode == FILL else F.coalesce(new, existing)


def merged_flag(existing: Column, new: Column) -> Column:
    return F.coalesce(existing, F.lit(False)) | F.coalesce(new, F.lit(False))


def ordered_distinct(value: Column, order: Column, sep: str = ",") -> Column:
    """Aggregate: different values in order of their first occurrence, joined; null if there is none."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.cast("string").alias("v")))))
    found = F.array_distinct(F.transform(pairs, lambda x: x["v"]))
    return F.when(F.size(found) > 0, F.array_join(found, sep))


def ordered_list(value: Column, order: Column, sep: str = "|") -> Column:
    """Aggregate: all values in order, joined; a missing one is '.'."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(value.cast("string"), F.lit(".")).alias("v"))))
    return F.array_join(F.transform(pairs, lambda x: x["v"]), sep)


def per_allele(value: Column, allele: Column) -> Column:
    """Aggregate: one string per allele in allele order, comma-joined, '.' where there is none; null if all are missing."""
    return without_empty(ordered_list(value, allele, ","))


def without_empty(text: Column) -> Column:
    """A list string of separators and dots alone is no value."""
    return F.when(text.rlike(r"[^|,.]"), text)


def typed_region_value(values: Column, kind: str) -> Column:
    """A region list as its tag's type: numbers take the list's first, flags are true unless it is a dot."""
    first = F.split(values, ",")[0]
    if kind == "Integer":
        return first.try_cast("int")
    if kind == "Float":
        return first.try_cast("float")
    if kind == "Flag":
        return F.coalesce(values != ".", F.lit(False))
    return values


def annotate(target: DataFrame, matches: DataFrame, key: str, columns: list[tuple[str, str]], order: str) -> DataFrame:
    """target with columns [(name, mode)] taken from its matches (key, order, names), one row for each row of target."""
    found = matches.groupBy(key).agg(*[match_value(F.col(c), F.col(order), m).alias(f"_new_{c}") for c, m in columns])
    out = target.join(found, key, "left")
    for c, mode in columns:
        out = out.withColumn(c, merged(F.col(c), F.col(f"_new_{c}"), mode) if c in target.columns else F.col(f"_new_{c}"))
    return out.drop(*[f"_new_{c}" for c, _ in columns])
