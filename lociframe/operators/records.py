"""Edits of variant records: alleles, ids, filters, quality, and values and genotypes of samples.

Functions take and give columns or DataFrames in the shape of sources.vcf.read_vcf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.vcf import Tag, VcfHeader
from .merge_back import FILL, merged


def added_id(ids: Column, new: Column) -> Column:
    """An id put behind those there are, once; null adds nothing."""
    return F.array_join(F.array_distinct(F.array_compact(F.concat(F.coalesce(F.split(ids, ";"), F.array().cast("array<string>")), F.array(new)))), ";")


def added_filter(filters: Column, new: Column) -> Column:
    """A filter added once. PASS takes the place of all, and gives way to any other."""
    others = F.array_remove(F.coalesce(filters, F.array().cast("array<string>")), "PASS")
    return F.when(new == "PASS", F.array(F.lit("PASS"))).otherwise(F.array_distinct(F.array_append(others, new)))


def removed_filter(filters: Column, old: Column, then_pass: bool = False) -> Column:
    """A filter taken off; of an empty list PASS is made where that is asked for and something was taken off."""
    left = F.filter(filters, lambda x: x != old)
    return F.when((F.size(left) == 0) & (F.size(filters) > 0), F.array(F.lit("PASS"))).otherwise(left) if then_pass else left


def has_filter(filters: Column, name: str) -> Column:
    """Whether a filter is set; without any, PASS is."""
    return F.array_contains(filters, name) | ((F.size(filters) == 0) if name in ("PASS", ".") else F.lit(False))


def with_alleles(df: DataFrame, ref: Column, alts: Column) -> DataFrame:
    """Other alleles; the end follows the reference, unless END gave it."""
    by_ref = F.col("end") == F.col("start") + F.length("ref")
    new = df.withColumns({"_ref": ref, "_alts": alts}).withColumn("end", F.when(by_ref, F.col("start") + F.length("_ref")).otherwise(F.col("end")))
    return new.withColumns({"ref": F.col("_ref"), "alts": F.col("_alts")}).drop("_ref", "_alts")


def with_quality(df: DataFrame, new: Column, mode: str = FILL) -> DataFrame:
    """QUAL filled where it is missing, or overwritten where there is a new value ('-')."""
    return df.withColumn("qual", merged(F.col("qual"), new.cast("float"), mode))


def sample_values(samples: Column, tag: str) -> Column:
    """A database's FORMAT values as a map by sample."""
    return F.map_from_entries(F.transform(samples, lambda s: F.struct(s["name"], s["fmt"][tag])))


def with_format(df: DataFrame, header: VcfHeader, tag: Tag, values: Column, mode: str = FILL) -> tuple[DataFrame, VcfHeader]:
    """A FORMAT tag set from a map of sample names to values; samples that it lacks keep theirs. A new tag comes last."""
    new = VcfHeader.parse(header.lines())
    have = [t for t in header.format if t != "GT"]
    new.format.setdefault(tag.name, tag)

    def one(s: Column) -> Column:
        value = F.try_element_at("_values", s["name"]).cast(new.format[tag.name].sql)
        fields = [(merged(s["fmt"][t], value, mode) if t == tag.name else s["fmt"][t]).alias(t) for t in have]
        return F.struct(s["name"].alias("name"), s["gt"].alias("gt"), F.struct(*fields, *([] if tag.name in have else [value.alias(tag.name)])).alias("fmt"))

    return df.withColumn("_values", values).withColumn("samples", F.transform("samples", one)).drop("_values"), new


def with_genotypes(df: DataFrame, values: Column, mode: str = FILL) -> DataFrame:
    """Genotypes (struct<alleles, phased>) from a map by sample: '+' where none is called, '-' wherever there is a new one."""

    def one(s: Column) -> Column:
        new = F.try_element_at("_values", s["name"])
        called = F.exists(s["gt"]["alleles"], lambda x: x >= 0)
        gt = F.when(F.coalesce(called, F.lit(False)), s["gt"]).otherwise(F.coalesce(new, s["gt"])) if mode == FILL else F.coalesce(new, s["gt"])
        return s.withField("gt", gt)

    return df.withColumn("_values", values).withColumn("samples", F.transform("samples", one)).drop("_values")


def _subset(values: Column, number: str, keep: Column, n: Column) -> Column:
    """The values of the alleles kept, n alleles having been there; lists of another length stay as they are. Without alternatives a list of these is null."""
    pick = lambda wanted: F.transform(wanted, lambda i: F.get(values, i.cast("int")))
    if number == "A":
        left = F.transform(F.filter(keep, lambda i: i > 0), lambda i: F.get(values, i - 1))
        return F.when((F.size(values) == n - 1) & (F.size(left) == 0), None).when(F.size(values) == n - 1, left).otherwise(values)
    each = F.when(F.size(values) == n, pick(keep))
    if number == "R":
        return each.otherwise(values)
    pairs = F.flatten(F.transform(keep, lambda j, b: F.transform(F.slice(keep, F.lit(1), b + 1), lambda i: F.floor(j * (j + 1) / 2 + i))))
    # Of one allele alone both forms have one value, so which is asked first is the same.
    return F.when(F.size(values) == F.floor(n * (n + 1) / 2), pick(pairs)).when(F.size(values) == n, pick(keep)).otherwise(values)


def with_kept_alleles(df: DataFrame, header: VcfHeader, keep: Column) -> DataFrame:
    """Only the alleles numbered in `keep` (ascending, 0 for the reference first); A, R and G values and genotypes follow.

    A called allele that isn't kept becomes missing. G values are by genotype, or by allele where a sample has one copy.
    """
    df = df.withColumns({"_keep": keep, "_n": F.size("alts") + 1})
    k, n = F.col("_keep"), F.col("_n")
    many = lambda t: t.number in ("A", "R", "G") and t.sql.startswith("array")
    new = {"alts": F.transform(F.filter(k, lambda i: i > 0), lambda i: F.get("alts", i - 1))}
    have = df.select("info.*").columns
    if any(many(header.info[t]) for t in have if t in header.info):
        new["info"] = F.struct(*[(_subset(F.col("info")[t], header.info[t].number, k, n) if t in header.info and many(header.info[t]) else F.col("info")[t]).alias(t) for t in have])
    tags = [t for t in header.format.values() if t.name != "GT"]

    def one(s: Column) -> Column:
        place = lambda a: F.array_position(k, a)
        calls = F.transform(s["gt"]["alleles"], lambda a: F.when(place(a) > 0, (place(a) - 1).cast("int")))
        fields = [(_subset(s["fmt"][t.name], t.number, k, n) if many(t) else s["fmt"][t.name]).alias(t.name) for t in tags]
        return F.struct(s["name"].alias("name"), F.struct(calls.alias("alleles"), s["gt"]["phased"].alias("phased")).alias("gt"), *([F.struct(*fields).alias("fmt")] if fields else []))

    if header.samples:
        new["samples"] = F.transform("samples", one)
    return df.withColumns(new).drop("_keep", "_n")


def trimmed_alleles(df: DataFrame, header: VcfHeader) -> DataFrame:
    """Without the alternative alleles that no genotype calls; records without samples stay as they are."""
    called = F.array_distinct(F.flatten(F.transform("samples", lambda s: F.coalesce(s["gt"]["alleles"], F.array().cast("array<int>")))))
    every = F.sequence(F.lit(0), F.size("alts"))
    return with_kept_alleles(df, header, F.when(F.size("samples") > 0, F.filter(every, lambda i: (i == 0) | F.array_contains(called, i))).otherwise(every))


def without_alleles(df: DataFrame, header: VcfHeader, drop: Column) -> DataFrame:
    """Without the alternative alleles numbered in `drop`."""
    return with_kept_alleles(df, header, F.filter(F.sequence(F.lit(0), F.size("alts")), lambda i: (i == 0) | ~F.array_contains(drop, i)))
