"""Joins, windows, expansion and aggregation that the other operators and the registered queries build on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts for each core, where rows are dealt for the work that is in them.
PARTS = 4


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in PARTS parts for each core: small files are few splits, and parts that are small in bytes are joined, however much work is in a row."""
    return df.repartition(PARTS * df.sparkSession.sparkContext.defaultParallelism, *keys)


def allele_join(left: DataFrame, right: DataFrame, keys: list[str], alleles: str, classes: str | None = None, how: str = "left", prefix: str = "d_") -> DataFrame:
    """Equi-join on keys (contig, start, end) with a shared allele string and, where given, a shared variant class."""
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    match = F.arrays_overlap(left[alleles], r[prefix + alleles])
    for k in keys:
        match &= left[k] == r[prefix + k]
    if classes:
        match &= left[classes].bitwiseAND(r[prefix + classes]) != 0
    return left.join(r, match, how)


def class_join(left: DataFrame, right: DataFrame, keys: list[str], alleles: str, other: Column | None = None, prefix: str = "d_") -> DataFrame:
    """The left allele_join, where many rows have the same keys and alleles: the lists are compared once for each pair of different ones.

    other: what has to hold of the two rows besides. Keys and alleles of the right side don't come back. Each left class comes once with the right rows
    it links to, and is joined to its own rows in one step, so that no pair is sorted or shuffled after it is made.
    """
    by = [*keys, alleles]
    classes = left.select(*by).distinct()
    there = right.select(*by).distinct().toDF(*[f"_o_{c}" for c in by])
    same = F.arrays_overlap(classes[alleles], there[f"_o_{alleles}"])
    for k in keys:
        same &= classes[k] == there[f"_o_{k}"]
    r = dealt(right.select(*[F.col(c).alias(f"_r_{c}" if c in by else prefix + c) for c in right.columns]), *[f"_r_{c}" for c in by])
    links = classes.join(there, same)
    linked = links.join(r, [links[f"_o_{c}"] == r[f"_r_{c}"] for c in by]).select(*[F.col(c).alias(f"_l_{c}") for c in by], *[prefix + c for c in right.columns if c not in by])
    # As many parts as rows of the result ask for: a few bytes of a class make many pairs.
    a, b = dealt(left, *by), dealt(linked, *[f"_l_{c}" for c in by])
    match = a[alleles] == b[f"_l_{alleles}"]
    for k in keys:
        match &= a[k] == b[f"_l_{k}"]
    return a.join(b, match if other is None else match & other, "left").drop(*[f"_l_{c}" for c in by])


def renamed_values(df: DataFrame, column: str, table: DataFrame, old: str, new: str, order: str | None = None) -> DataFrame:
    """Values replaced by a two-column table's, kept where it has none; of duplicate keys the first by `order` wins, without one the least new one."""
    t = table.groupBy(F.col(old).alias("_old")).agg((F.min_by(new, order) if order else F.min(new)).alias("_new"))
    return df.join(t, df[column] == t._old, "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def whitelisted(df: DataFrame, names: DataFrame, name: str, listed: Column) -> DataFrame:
    """Rows for which `listed` doesn't hold, and of the others those whose name is in the list."""
    n = names.select(F.col(names.columns[0]).alias("_n")).distinct().withColumn("_in", F.lit(True))
    return df.join(n, df[name] == n._n, "left").where(~listed | F.col("_in").isNotNull()).drop("_n", "_in")


def full_outer_sites(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "full_outer")


#: Rows of one key that a single task sweeps; keys with more are swept in ranges.
MOST_OF_A_KEY = 5_000_000


def gap_sessions(df: DataFrame, on: str, at: str, gap, tie: str, name: str = "session", most: int = MOST_OF_A_KEY, parts: int = 64) -> DataFrame:
    """Numbers runs of rows whose steps are at most `gap` (a larger step starts a new run), from 1 by key.

    Where a key has more than `most` rows all are dealt to ranges of (key, position): a range needs the last row before
    it and how many runs its first key has had, a row for each range, which the driver hands on.
    """
    top = df.groupBy(on).count().agg(F.max("count")).first()[0] or 0
    if top <= most:
        order = Window.partitionBy(on).orderBy(at, tie)
        new = F.coalesce((F.col(at) - F.lag(at).over(order) > gap).cast("int"), F.lit(1))
        return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(order)).drop("_new")
    place = F.struct(F.col(on).alias("k"), F.col(at).alias("x"), F.col(tie).alias("t"))
    ranged = df.repartitionByRange(max(parts, top // most + 1), on, at, tie).groupBy(F.spark_partition_id().alias("_p")).agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"))
    bounds = [(i, r["_lo"], r["_hi"]) for i, r in enumerate(ranged.orderBy("_lo").collect())]
    before = [None, *[hi for _, _, hi in bounds[:-1]]]
    kind = df.select(place.alias("p")).schema["p"].dataType.simpleString()
    spans = df.sparkSession.createDataFrame([(*b, x) for b, x in zip(bounds, before, strict=True)], f"_r int, _lo {kind}, _hi {kind}, _before {kind}")
    placed = df.join(F.broadcast(spans), (place >= F.col("_lo")) & (place <= F.col("_hi")))
    order = Window.partitionBy("_r", on).orderBy(at, tie)
    last = F.coalesce(F.lag(at).over(order), F.when(F.col("_before.k").eqNullSafe(F.col(on)), F.col("_before.x")))
    flagged = placed.withColumn("_new", F.coalesce((F.col(at) - last > gap).cast("int"), F.lit(1)))
    runs = {r["_r"]: r["n"] for r in flagged.where(F.col("_hi.k").eqNullSafe(F.col(on))).groupBy("_r").agg(F.sum("_new").alias("n")).collect()}
    had, held = [], 0
    for i, lo, hi in bounds:
        same = i > 0 and before[i]["k"] == lo["k"]
        had.append((i, held if same else 0))
        held = runs.get(i, 0) + (held if same and lo["k"] == hi["k"] else 0)
    flagged = flagged.join(F.broadcast(df.sparkSession.createDataFrame(had, "_r int, _had bigint")), "_r")
    number = F.sum("_new").over(order) + F.when(F.col("_lo.k").eqNullSafe(F.col(on)), F.col("_had")).otherwise(0)
    return flagged.withColumn(name, number).select(*df.columns, name)


def numbered_blocks(df: DataFrame, on: str, order: str, minus: Column) -> Column:
    """Exon numbers: in order on the plus strand, backwards on the minus strand."""
    n = F.row_number().over(Window.partitionBy(on).orderBy(order))
    return F.when(minus, F.count("*").over(Window.partitionBy(on)) - n + 1).otherwise(n)


def cumulative_offset(on: str, order: str, length: str) -> Column:
    """Where each block starts in the joined sequence."""
    return F.coalesce(F.sum(length).over(Window.partitionBy(on).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def exploded(df: DataFrame, values: Column, index: str, value: str) -> DataFrame:
    return df.select("*", F.posexplode(values).alias(index, value))


def alleles_of(ref: Column, alts: Column) -> Column:
    """One entry per allele, the reference first."""
    return F.concat(F.array(ref), alts)


def picked(values: Column, number: str, allele: Column) -> Column:
    """The value of one allele: R has one for each, A none for the reference, others stay whole."""
    return F.get(values, allele) if number == "R" else F.get(values, allele - 1) if number == "A" else F.array_join(values.cast("array<string>"), ",")


def depth_and_fraction(reads: DataFrame, site: str, allele: str, alleles: list[str]) -> DataFrame:
    """Counts and shares of each allele by site, zeros where there is none."""
    total = F.count_if(F.col(allele).isin(alleles))
    each = [F.count_if(F.col(allele) == a) for a in alleles]
    return reads.groupBy(site).agg(F.array(*each).alias("depth"), F.array(*[F.when(total > 0, e / total).otherwise(F.lit(0.0)) for e in each]).alias("fraction"))


def top_by(df: DataFrame, on: str, value: str, score: Column, tie: str) -> DataFrame:
    """The row value of highest score by key, the least tie among equal ones."""
    return df.groupBy(on).agg(F.max_by(value, F.struct(score, -F.col(tie))).alias(value))


def minus_one_mask(flags: Column, mask: int) -> Column:
    """Reads without any of these flag bits."""
    return flags.bitwiseAND(mask) == 0


def numbered(df: DataFrame, order: str, name: str, parts: int = 64) -> DataFrame:
    """df with row numbers from 1 by a column of unique values: ranges are counted, then numbered within, so no task has all rows."""
    ranged = df.repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id())
    bounds = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi")).where("_n > 0").orderBy("_lo").collect()  # one row a range
    starts, before = [], 0
    for b in bounds:
        starts.append((b["_lo"], b["_hi"], before))
        before += b["_n"]
    if not starts:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    kind = df.schema[order].dataType.simpleString()
    spans = df.sparkSession.createDataFrame(starts, f"_lo {kind}, _hi {kind}, _before bigint")
    placed = df.join(F.broadcast(spans), (F.col(order) >= F.col("_lo")) & (F.col(order) <= F.col("_hi")))
    return placed.withColumn(name, F.row_number().over(Window.partitionBy("_before").orderBy(order)) + F.col("_before")).drop("_lo", "_hi", "_before")
