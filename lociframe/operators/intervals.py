"""Interval joins by binning, and interval-set algebra by window sweeps. Intervals are 0-based, half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the finest bins; each coarser level is FANOUT times as wide.
BIN, FANOUT = 8192, 64


def _level(length: Column, bin_width: int, levels: int) -> Column:
    """The level at which an interval of this length spans few bins."""
    out = F.lit(levels - 1)
    for k in range(levels - 2, -1, -1):
        out = F.when(length <= bin_width * FANOUT ** (k + 1), F.lit(k)).otherwise(out)
    return out


def _levels(regions: DataFrame, start: str, end: str, bin_width: int) -> int:
    """How many levels the longest region needs: one pre-aggregated number."""
    return _levels_for(regions.agg(F.max(F.col(end) - F.col(start))).first()[0] or 0, bin_width)


def _levels_for(longest: int, bin_width: int) -> int:
    n = 1
    while longest > bin_width * FANOUT**n:
        n += 1
    return n


def _bins(lo: Column, hi: Column, width: int) -> Column:
    return F.sequence(F.floor(lo / width), F.floor(hi / width))


def range_join(points: DataFrame, regions: DataFrame, *, on: str = "chrom", pos: str = "pos", start: str = "start", end: str = "end", how: str = "inner", bin_width: int = BIN) -> DataFrame:
    """Pairs with start <= pos < end on the same contig; how: inner, left, left_semi or left_anti.

    An equi-join on (contig, level, bin): a long region goes to coarser bins, so it is never copied to more
    than FANOUT + 1 of them, and a point looks into one bin for each level in use. Columns of regions that
    points have as well are dropped; empty regions (start >= end) match nothing.
    """
    regions = regions.where(F.col(start) < F.col(end))
    levels = _levels(regions, start, end, bin_width)
    own = [c for c in regions.columns if c not in points.columns or c in (start, end)]
    r = regions.select(F.col(on).alias("_c"), *[F.col(c).alias(f"_r_{c}") for c in own])
    s, e = F.col(f"_r_{start}"), F.col(f"_r_{end}")
    r = r.withColumn("_l", _level(e - s, bin_width, levels))
    at = [_bins(s, e - 1, bin_width * FANOUT**k) for k in range(levels)]
    bins = at[-1]
    for k in range(levels - 2, -1, -1):
        bins = F.when(F.col("_l") == k, at[k]).otherwise(bins)
    r = r.withColumn("_b", F.explode(bins))
    p = points.withColumn("_at", F.explode(F.array(*[F.struct(F.lit(k).alias("l"), F.floor(F.col(pos) / (bin_width * FANOUT**k)).alias("b")) for k in range(levels)]))) if levels > 1 else points.withColumn("_at", F.struct(F.lit(0).alias("l"), F.floor(F.col(pos) / bin_width).alias("b")))
    match = (p[on] == r._c) & (p._at.l == r._l) & (p._at.b == r._b) & (p[pos] >= s) & (p[pos] < e)
    names = [F.col(f"_r_{c}").alias(c) for c in own if c not in points.columns]
    if how in ("inner", "left") and levels == 1:
        return p.join(r, match, how).select(*points.columns, *names)
    if how == "inner":
        return p.join(r, match).select(*points.columns, *names)
    if levels == 1:
        return p.join(r, match, how).select(*points.columns)
    # With several levels a point has a row for each: what else is asked is decided by place, on which alone matches depend.
    if how == "left":
        hit, rest = (range_join(points, regions, on=on, pos=pos, start=start, end=end, how=h, bin_width=bin_width) for h in ("inner", "left_anti"))
        return hit.unionByName(rest, allowMissingColumns=True)
    places = points.select(on, pos).distinct()
    hit = range_join(places, regions, on=on, pos=pos, start=start, end=end, bin_width=bin_width).select(F.col(on).alias("_c"), F.col(pos).alias("_x")).distinct()
    return points.join(hit, (points[on] == hit._c) & (points[pos] == hit._x), how).select(*points.columns)


def overlap_join(left: DataFrame, right: DataFrame, *, on: str = "chrom", start: str = "start", end: str = "end", prefix: str = "r_", closed_start: bool = False, bin_width: int = BIN, longest: int | None = None) -> DataFrame:
    """Pairs of intervals that overlap; the right side's columns get a prefix. longest: of the left intervals' lengths, where it is known.

    Long intervals go to coarser bins: each stands in the bins of its own level, FANOUT + 1 at most, and in two of each
    coarser one; a pair meets at the coarser level of both. It is kept in just one bin, that of the greater of the two
    starts, so no duplicates arise and no distinct is needed. closed_start counts left.start == right.end as an overlap,
    as a scheme of 1-based closed starts does.
    """
    slack = 1 if closed_start else 0
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    rs, re_ = F.col(prefix + start), F.col(prefix + end)
    levels = max(_levels(left, start, end, bin_width) if longest is None else _levels_for(longest, bin_width), _levels(right, start, end, bin_width))
    widths = [bin_width * FANOUT**k for k in range(levels)]

    def dealt(df: DataFrame, lo: Column, hi: Column, name: str) -> DataFrame:
        own = _level(hi - lo + 1, bin_width, levels)
        none = F.array().cast("array<struct<m:int,b:bigint>>")
        named = lambda k: lambda b: F.struct(F.lit(k).alias("m"), b.alias("b"))
        at = [F.when(own <= k, F.transform(_bins(lo, hi, w), named(k))).otherwise(none) for k, w in enumerate(widths)]
        return df.withColumn(name + "l", own).withColumn(name, F.explode(F.flatten(F.array(*at))))

    lb = dealt(left, F.col(start), F.greatest(F.col(start), F.col(end) - 1), "_b")
    rb = dealt(r, rs, F.greatest(rs, re_ - 1 + slack), "_rb")
    meet = (lb[on] == rb[prefix + on]) & (F.col("_b.m") == F.col("_rb.m")) & (F.col("_b.b") == F.col("_rb.b")) & (lb[start] < re_ + slack) & (rs < lb[end])
    width = F.element_at(F.array(*map(F.lit, widths)), F.col("_b.m") + 1)
    first = (F.col("_b.m") == F.greatest("_bl", "_rbl")) & (F.col("_b.b") == F.floor(F.greatest(lb[start], rs) / width))
    return lb.join(rb, meet & first).drop("_b", "_bl", "_rb", "_rbl")


def relation_join(targets: DataFrame, regions: DataFrame, mode: str = "ex", longest: int = 100, **columns) -> DataFrame:
    """Overlaps in a mode: ex (target inside region), in (region inside target) or ov; targets below `longest` only."""
    start, end, p = columns.get("start", "start"), columns.get("end", "end"), columns.get("prefix", "r_")
    joined = overlap_join(targets.where(F.col(end) - F.col(start) < longest), regions, **columns)
    inside = (F.col(start) >= F.col(p + start)) & (F.col(end) <= F.col(p + end))
    around = (F.col(start) <= F.col(p + start)) & (F.col(end) >= F.col(p + end))
    return joined.where({"ex": inside, "in": around, "ov": F.lit(True)}[mode])


#: Coordinates of a stretch that one task sweeps; what goes on from stretch to stretch are a few numbers each.
STRETCH = 1 << 20


def _carried(rows: DataFrame, on: str, sums: list[Column], carried: dict[str, Column]) -> DataFrame:
    """rows with what the stretches before, or the one after, hand on: sums by (contig, _b), then windows over these few rows."""
    bins = rows.groupBy(F.col(on).alias("_on"), F.col("_b").alias("_at")).agg(*sums).select("_on", "_at", *[v.alias(k) for k, v in carried.items()])
    return rows.join(bins, F.col(on).eqNullSafe(F.col("_on")) & (F.col("_b") == F.col("_at")), "left").drop("_on", "_at")


def _across(before: bool = True):
    """The window over a contig's stretches in order: what lies before each, or just their order."""
    order = Window.partitionBy("_on").orderBy("_at")
    return order.rowsBetween(Window.unboundedPreceding, -1) if before else order


def merge_intervals(df: DataFrame, *, on: str = "chrom", start: str = "start", end: str = "end", stretch: int = STRETCH) -> DataFrame:
    """Union of intervals by key; touching ones become one. Contigs are swept in stretches, which are then stitched."""
    rows = df.where(F.col(start) <= F.col(end)).select(on, start, end, F.floor(F.col(start) / stretch).alias("_b"))
    rows = _carried(rows, on, [F.max(end).alias("_m")], {"_reach": F.max("_m").over(_across())})
    order = Window.partitionBy(on, "_b").orderBy(start, end)
    reach = F.greatest("_reach", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_new", (reach.isNull() | (F.col(start) > reach)).cast("int")).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Group 0 of a stretch goes on with the last group that began before it.
    pieces = rows.groupBy(on, "_b", "_g").agg(F.min(start).alias("_s"), F.max(end).alias("_e"))
    pieces = _carried(pieces, on, [F.max(F.when(F.col("_g") > 0, F.col("_s"))).alias("_m")], {"_from": F.max("_m").over(_across())})
    return pieces.groupBy(on, F.when(F.col("_g") == 0, F.col("_from")).otherwise(F.col("_s")).alias(start)).agg(F.max("_e").alias(end))


def sweep(sets: list[DataFrame], keep, *, on: str = "chrom", start: str = "start", end: str = "end", stretch: int = STRETCH) -> DataFrame:
    """Stretches where keep(covers) holds, covers being how many intervals of each set cover them, merged."""
    edges, n = None, range(len(sets))
    for i, df in enumerate(sets):
        for col, step in ((start, 1), (end, -1)):
            part = df.where(F.col(start) < F.col(end)).select(F.col(on).alias(on), F.col(col).alias("_x"), *[F.lit(step if j == i else 0).alias(f"_d{j}") for j in n])
            edges = part if edges is None else edges.unionByName(part)
    edges = edges.groupBy(on, "_x").agg(*[F.sum(f"_d{j}").alias(f"_d{j}") for j in n]).withColumn("_b", F.floor(F.col("_x") / stretch))
    carried = {f"_c{j}": F.sum(f"_d{j}").over(_across()) for j in n} | {"_next": F.lead("_x").over(_across(False))}
    edges = _carried(edges, on, [F.min("_x").alias("_x"), *[F.sum(f"_d{j}").alias(f"_d{j}") for j in n]], carried)
    order = Window.partitionBy(on, "_b").orderBy("_x")
    edges = edges.select(on, F.col("_x").alias(start), F.coalesce(F.lead("_x").over(order), "_next").alias(end), *[(F.coalesce(f"_c{j}", F.lit(0)) + F.sum(f"_d{j}").over(order)).alias(f"_c{j}") for j in n])
    return merge_intervals(edges.where(F.col(end).isNotNull()).where(keep([F.col(f"_c{j}") for j in n])).select(on, start, end), on=on, start=start, end=end, stretch=stretch)


def intersect_intervals(a: DataFrame, b: DataFrame, **names) -> DataFrame:
    return sweep([a, b], lambda c: (c[0] > 0) & (c[1] > 0), **names)


def subtract_intervals(a: DataFrame, b: DataFrame, **names) -> DataFrame:
    return sweep([a, b], lambda c: (c[0] > 0) & (c[1] == 0), **names)


def union_intervals(a: DataFrame, b: DataFrame, **names) -> DataFrame:
    return sweep([a, b], lambda c: (c[0] > 0) | (c[1] > 0), **names)


def flank(df: DataFrame, left: int, right: int, *, start: str = "start", end: str = "end") -> DataFrame:
    """Widen (or, with negative values, trim) intervals; those that would invert stay as they are."""
    s, e = F.greatest(F.col(start) - left, F.lit(0)), F.col(end) + right
    ok = s < e
    return df.withColumns({start: F.when(ok, s).otherwise(F.col(start)), end: F.when(ok, e).otherwise(F.col(end))})


def round_up(df: DataFrame, width: int, *, start: str = "start", end: str = "end") -> DataFrame:
    """Pad intervals to a least width on both sides, an odd base at the end."""
    short = F.greatest(F.lit(width) - (F.col(end) - F.col(start)), F.lit(0))
    before = F.floor(short / 2)
    return df.withColumns({start: F.greatest(F.col(start) - before, F.lit(0)), end: F.col(end) + (short - before)})


def normalised(df: DataFrame, *, start: str = "start", end: str = "end") -> DataFrame:
    """Swapped bounds put right, a missing end one base after the start."""
    e = F.coalesce(F.col(end), F.col(start) + 1)
    return df.withColumns({start: F.least(F.col(start), e), end: F.greatest(F.col(start), e)})


def totals(df: DataFrame, *, on: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """Regions and bases before and after merging."""
    m = merge_intervals(df, on=on, start=start, end=end)
    count = lambda d, p: d.agg(F.count("*").alias(f"{p}regions"), F.coalesce(F.sum(F.col(end) - F.col(start)), F.lit(0)).cast("bigint").alias(f"{p}bases"))
    return count(df, "").crossJoin(count(m, "merged_"))  # one row each


def regions_near(targets: DataFrame, regions: DataFrame, gap: int, *, on: str = "chrom", start: str = "start", end: str = "end", bin_width: int = BIN) -> DataFrame:
    """What of the regions lies on or near each target, merged.

    Targets are merged first. Overlaps are clipped to the target. To its left, regions within `gap` are taken, clipped to
    that window's start, where nothing overlaps the target or the first overlap starts more than `gap` after it; to its
    right, clipped to the window's end, only where nothing overlaps.
    """
    names = dict(on=on, start=start, end=end)
    t = merge_intervals(targets.where(F.col(start) < F.col(end)), **names).select(on, start, end)
    r = regions.where(F.col(start) < F.col(end)).select(on, start, end)
    rs, re_ = F.col(f"r_{start}"), F.col(f"r_{end}")
    joined = lambda a: overlap_join(a, r, bin_width=bin_width, **names)
    inside = joined(t).select(on, F.col(start).alias("_s"), F.col(end).alias("_e"), F.greatest(start, rs).alias(start), F.least(end, re_).alias(end))
    first = inside.groupBy(F.col(on).alias("_on"), "_s", "_e").agg(F.min(start).alias("_first"))
    t = t.join(first, (F.col(on) == F.col("_on")) & (F.col(start) == F.col("_s")) & (F.col(end) == F.col("_e")), "left")
    none = F.col("_first").isNull()
    left = t.where(none | (F.col("_first") - F.col(start) > gap)).select(on, F.greatest(F.col(start) - gap, F.lit(0)).alias("_lo"), F.col(start).alias("_hi"))
    left = left.where("_lo < _hi").select(on, F.col("_lo").alias(start), F.col("_hi").alias(end))
    right = t.where(none).select(on, F.col(end).alias(start), (F.col(end) + gap).alias(end))
    found = inside.select(on, start, end)
    found = found.unionByName(joined(left).select(on, F.greatest(start, rs).alias(start), re_.alias(end)))
    found = found.unionByName(joined(right).select(on, rs.alias(start), F.least(end, re_).alias(end)))
    return merge_intervals(found, **names)
