"""The operators applied to the driver's tables, one registered query each, with the same in SQL.

Names start with the operators' ids in the survey's inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles as al
from ..functions import sequence as sq
from ..functions import text as tx
from ..operators import intervals as iv
from ..operators import merge_back as mb
from ..operators import relational as rl
from ..operators.nearest import nearest
from ..shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.lit("c1").alias("chrom"), (F.col("o_orderkey") % 14000).alias("pos"))


def _regions(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand", F.lit("c1").alias("chrom"), (F.col("p_partkey") * 7).alias("start"), (F.col("p_partkey") * 7 + F.col("p_size")).alias("end"))


_P = "(select o_orderkey, o_orderkey % 14000 pos from orders)"
_R = '(select p_partkey, p_brand, p_partkey * 7 as "start", p_partkey * 7 + p_size as "end" from part)'
_IN = 'pos >= "start" and pos < "end"'
BIN = 64  # these tables' regions are at most 50 wide


@query(f"select o_orderkey, pos, p_partkey from {_P} join {_R} on {_IN}")
def jn2_range_join_points(spark, d):
    return iv.range_join(_points(spark, d), _regions(spark, d), bin_width=BIN).select("o_orderkey", "pos", "p_partkey")


@query(f"select o_orderkey, pos, p_partkey from {_P} left join {_R} on {_IN}")
def jn2_left_range_join(spark, d):
    return iv.range_join(_points(spark, d), _regions(spark, d), how="left", bin_width=BIN).select("o_orderkey", "pos", "p_partkey")


@query(f"select o_orderkey, pos, string_agg(p_brand, ',' order by o) brands from (select o_orderkey, pos, p_brand, min(p_partkey) o from {_P} join {_R} on {_IN} group by 1, 2, 3) group by 1, 2")
def jn2_agg1_region_list(spark, d):
    j = iv.range_join(_points(spark, d), _regions(spark, d), bin_width=BIN)
    return j.groupBy("o_orderkey", "pos").agg(mb.ordered_distinct(F.col("p_brand"), F.col("p_partkey")).alias("brands"))


@query(f"select o_orderkey, pos, string_agg(p_brand, '|' order by p_partkey) brands from {_P} join {_R} on {_IN} group by 1, 2")
def agg2_ordered_list(spark, d):
    j = iv.range_join(_points(spark, d), _regions(spark, d), bin_width=BIN)
    return j.groupBy("o_orderkey", "pos").agg(mb.ordered_list(F.col("p_brand"), F.col("p_partkey")).alias("brands"))


@query(f"select o_orderkey, count(*) total, count(*) filter (p_brand like '%1') transcripts, bool_or(p_brand like '%3') gene from {_P} join {_R} on {_IN} group by 1")
def agg4_overlap_counts(spark, d):
    j = iv.range_join(_points(spark, d), _regions(spark, d), bin_width=BIN)
    return j.groupBy("o_orderkey").agg(F.count("*").alias("total"), F.count_if(F.col("p_brand").endswith("1")).alias("transcripts"), F.bool_or(F.col("p_brand").endswith("3")).alias("gene"))


@query(f"select o_orderkey, pos from {_P} p where exists (select 1 from {_R} r where {_IN})")
def jn5_flt11_covered(spark, d):
    return iv.range_join(_points(spark, d), _regions(spark, d), how="left_semi", bin_width=BIN).select("o_orderkey", "pos")


@query(f"select o_orderkey, pos from {_P} p where not exists (select 1 from {_R} r where {_IN})")
def jn5_flt11_not_covered(spark, d):
    return iv.range_join(_points(spark, d), _regions(spark, d), how="left_anti", bin_width=BIN).select("o_orderkey", "pos")


def _spans(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.lit("c1").alias("chrom"), (F.col("c_custkey") * 11).alias("start"), (F.col("c_custkey") * 11 + F.col("c_nationkey") + 1).alias("end"))


_S = '(select c_custkey, c_custkey * 11 as s, c_custkey * 11 + c_nationkey + 1 as e from customer)'


@query(f'select c_custkey, p_partkey, greatest(s, "start") lo, least(e, "end") hi from {_S} join {_R} on s < "end" and "start" < e')
def jn3_jn10_overlap_join(spark, d):
    j = iv.overlap_join(_spans(spark, d), _regions(spark, d), bin_width=BIN)
    return j.select("c_custkey", F.col("r_p_partkey").alias("p_partkey"), F.greatest("start", "r_start").alias("lo"), F.least("end", "r_end").alias("hi"))


@query(f"""select c_custkey, p_partkey, 'ex' as mode from {_S} join {_R} on s >= "start" and e <= "end" where e - s < 15
union all select c_custkey, p_partkey, 'in' from {_S} join {_R} on s <= "start" and e >= "end" where e - s < 15
union all select c_custkey, p_partkey, 'ov' from {_S} join {_R} on s < "end" and "start" < e where e - s < 15""")
def jn12_relation_modes(spark, d):
    out = None
    for mode in ("ex", "in", "ov"):
        one = iv.relation_join(_spans(spark, d), _regions(spark, d), mode, longest=15, bin_width=BIN).select("c_custkey", F.col("r_p_partkey").alias("p_partkey"), F.lit(mode).alias("mode"))
        out = one if out is None else out.union(one)
    return out


_C = "(select c_nationkey chrom, c_custkey % 997 as s, c_custkey % 997 + 1 + c_custkey % 13 as e from customer)"
_D = "(select s_nationkey chrom, s_suppkey * 7 % 997 as s, s_suppkey * 7 % 997 + 20 as e from supplier)"
_MERGE = """select chrom, cast(min(s) as bigint) "start", cast(max(e) as bigint) "end" from (select *, sum(n) over (partition by chrom order by s, e rows unbounded preceding) g from
 (select *, case when s <= max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end n from {0})) group by chrom, g"""
_UNITS = "(select distinct chrom, unnest(range(s, e)) u from {0})"


def _set_a(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("chrom"), (F.col("c_custkey") % 997).alias("start"), (F.col("c_custkey") % 997 + 1 + F.col("c_custkey") % 13).alias("end"))


def _set_b(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("chrom"), (F.col("s_suppkey") * 7 % 997).alias("start"), (F.col("s_suppkey") * 7 % 997 + 20).alias("end"))


def _runs(units: str) -> str:
    return f'select chrom, cast(min(u) as bigint) "start", cast(max(u) + 1 as bigint) "end" from (select chrom, u, u - row_number() over (partition by chrom order by u) g from ({units})) group by chrom, g'


@query(_MERGE.format(_C))
def set1_interval_merge(spark, d):
    return iv.merge_intervals(_set_a(spark, d))


@query(_runs(f"select chrom, u from {_UNITS.format(_C)} union select chrom, u from {_UNITS.format(_D)}"))
def set2_set8_set9_interval_union(spark, d):
    return iv.union_intervals(_set_a(spark, d), _set_b(spark, d))


@query(_runs(f"select chrom, u from {_UNITS.format(_C)} intersect select chrom, u from {_UNITS.format(_D)}"))
def set3_interval_intersect(spark, d):
    return iv.intersect_intervals(_set_a(spark, d), _set_b(spark, d))


@query(_runs(f"select chrom, u from {_UNITS.format(_C)} except select chrom, u from {_UNITS.format(_D)}"))
def set4_interval_difference(spark, d):
    return iv.subtract_intervals(_set_a(spark, d), _set_b(spark, d))


@query('select c_custkey, case when greatest(s - 3, 0) < e - 2 then greatest(s - 3, 0) else s end "start", case when greatest(s - 3, 0) < e - 2 then e - 2 else e end "end" from ' + _S)
def set5_flank_trim(spark, d):
    return iv.flank(_spans(spark, d), 3, -2).select("c_custkey", "start", "end")


@query('select c_custkey, greatest(s - greatest(20 - (e - s), 0) // 2, 0) "start", e + greatest(20 - (e - s), 0) - greatest(20 - (e - s), 0) // 2 "end" from ' + _S)
def set6_round_up(spark, d):
    return iv.round_up(_spans(spark, d), 20).select("c_custkey", "start", "end")


@query(f'with m as ({_MERGE.format(_C)}) select (select count(*) from {_C}) regions, (select cast(sum(e - s) as bigint) from {_C}) bases, (select count(*) from m) merged_regions, (select cast(sum("end" - "start") as bigint) from m) merged_bases')
def agg9_interval_totals(spark, d):
    return iv.totals(_set_a(spark, d))


@query('select c_custkey, least(a, coalesce(b, a + 1)) "start", greatest(a, coalesce(b, a + 1)) "end" from (select c_custkey, c_custkey % 50 a, case when c_custkey % 3 > 0 then c_nationkey end b from customer)')
def src19_normalised_bounds(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 50).alias("start"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey").cast("bigint")).alias("end"))
    return iv.normalised(c).select("c_custkey", "start", "end")


_EV = "(select *, epoch_us(ts) us from events)"


def _events(spark, d):
    return table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query(f"""with v as (select event_id, user_id, us from {_EV} where event_type = 'view'), k as (select event_id, user_id, us from {_EV} where event_type = 'click'),
p as (select v.event_id, max((k.us, k.event_id)) m from v join k on k.user_id = v.user_id and k.us <= v.us group by 1), n as (select v.event_id, min((k.us, k.event_id)) m from v join k on k.user_id = v.user_id and k.us >= v.us group by 1),
j as (select v.event_id, v.us, case when v.us - p.m[1] <= 36000000000 then p.m end p, case when n.m[1] - v.us <= 36000000000 then n.m end n from v left join p using (event_id) left join n using (event_id))
select event_id, p[2] prev_event_id, n[2] next_event_id, case when p is null and n is null then null when n is null then 'prev' when p is null then 'next' when us < (p[1] + n[1]) / 2 then 'prev' else 'next' end nearest from j""")
def jn4_win2_win3_nearest(spark, d):
    e = _events(spark, d)
    left = e.where("event_type = 'view'").select("event_id", "user_id", "us")
    right = e.where("event_type = 'click'").select("event_id", "user_id", "us")
    out = nearest(left, right, on="user_id", left_at="us", right_start="us", right_end="us", payload=["event_id"], tolerance=36_000_000_000)
    return out.select("event_id", "prev_event_id", "next_event_id", "nearest")


@query("""select event_id, user_id, cast(sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as session from
(select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 1 hour then 0 else 1 end n from events)""")
def win1_stm2_gap_sessions(spark, d):
    e = _events(spark, d)
    return rl.gap_sessions(e, "user_id", "us", 3_600_000_000, "event_id").select("event_id", "user_id", F.col("session").cast("bigint").alias("session"))


@query("select a.p_partkey, b.p_partkey as other from part a left join part b on a.p_type = b.p_type and a.p_size = b.p_size and a.p_partkey <> b.p_partkey and list_has_any(string_split(a.p_name, ' '), string_split(b.p_name, ' '))")
def jn1_allele_join(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_size", F.split("p_name", " ").alias("alts"))
    # Rows that match themselves only stay, as left rows without a match do.
    return rl.class_join(p, p, ["p_type", "p_size"], "alts", F.col("p_partkey") != F.col("d_p_partkey")).select("p_partkey", F.col("d_p_partkey").alias("other"))


@query("select user_id, arg_min(value, event_id) filter (value > 50) first_value, arg_max(value, event_id) filter (value > 50) last_value from events group by 1")
def mrg2_first_last_match(spark, d):
    e = table(spark, d, "events")
    v = F.when(F.col("value") > 50, F.col("value"))
    return e.groupBy("user_id").agg(mb.match_value(v, F.col("event_id")).alias("first_value"), mb.match_value(v, F.col("event_id"), "-").alias("last_value"))


@query("select c_custkey, coalesce(case when c_acctbal > 0 then c_mktsegment end, 'fill') filled, coalesce(case when c_nationkey % 2 = 0 then 'new' end, c_mktsegment) overwritten from customer")
def mrg1_replace_modes(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", mb.merged(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), F.lit("fill")).alias("filled"), mb.merged(F.col("c_mktsegment"), F.when(F.col("c_nationkey") % 2 == 0, F.lit("new")), "-").alias("overwritten"))


@query("""select o_orderkey, coalesce(case when c.c_acctbal > 5000 then c.c_name end, case when s.s_acctbal > 0 then s.s_name end, n.n_name) as name from orders
left join customer c on c.c_custkey = o_custkey left join supplier s on s.s_suppkey = o_custkey left join nation n on n.n_nationkey = c.c_nationkey""")
def mrg3_database_fold(spark, d):
    o, c, s, n = (table(spark, d, x) for x in ("orders", "customer", "supplier", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(s, o.o_custkey == s.s_suppkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    return j.select("o_orderkey", mb.fold(F.when(F.col("c_acctbal") > 5000, F.col("c_name")), F.when(F.col("s_acctbal") > 0, F.col("s_name")), F.col("n_name")).alias("name"))


@query("select c_custkey, c_acctbal > 0 or c_nationkey > 12 as flag, case when len(f) = 0 then ['PASS'] else f end[1] as filter from (select *, case when c_custkey % 2 = 0 then [c_mktsegment] else [] end f from customer)")
def mrg5_mrg7_flag_and_filter(spark, d):
    c = table(spark, d, "customer")
    f = F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>"))
    return c.select("c_custkey", mb.merged_flag(F.col("c_acctbal") > 0, F.col("c_nationkey") > 12).alias("flag"), mb.merged_filters(f, F.array(F.lit("PASS")))[0].alias("filter"))


@query("select p_partkey, try_cast(string_split(v, ',')[1] as integer) as i, v <> '.' as flag from (select p_partkey, case when p_size > 25 then p_size || ',' || p_brand else '.' end v from part)")
def mrg9_typed_region_values(spark, d):
    v = F.when(F.col("p_size") > 25, F.concat(F.col("p_size").cast("string"), F.lit(","), "p_brand")).otherwise(".")
    return table(spark, d, "part").select("p_partkey", mb.typed_region_value(v, "Integer").alias("i"), mb.typed_region_value(v, "Flag").alias("flag"))


@query("select o_orderkey, case when count(*) filter (l_linenumber <= 7 and l_quantity > 10) = 0 then null else string_agg(case when l_quantity > 10 then l_returnflag else '.' end, ',' order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) end tags from orders join lineitem on l_orderkey = o_orderkey group by 1")
def mrg11_agg5_per_allele_strings(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderkey").agg(mb.per_allele(F.when(F.col("l_quantity") > 10, F.col("l_returnflag")), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")).alias("tags"))


@query("select l_orderkey, bit_or(case l_returnflag when 'A' then 1 when 'N' then 2 else 4 end) as classes from lineitem group by 1")
def agg6_bit_or_class(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bit_or(F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(4)).alias("classes"))


@query("select l_orderkey, l_linenumber, l_shipdate, max(l_shipdate) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity rows unbounded preceding) as reach from lineitem")
def agg7_running_max(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.max("l_shipdate").over(w).alias("reach"))


@query("""select l_orderkey, count(*) filter (l_returnflag = 'A') a, count(*) filter (l_returnflag = 'N') n, count(*) filter (l_returnflag = 'A') / count(*) filter (l_returnflag in ('A', 'N', 'R')) af from lineitem group by 1""")
def agg8_jn14_allele_depth(spark, d):
    out = rl.depth_and_fraction(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])
    return out.select("l_orderkey", F.col("depth")[0].alias("a"), F.col("depth")[1].alias("n"), F.col("fraction")[0].alias("af"))


@query("select l_orderkey, cast(sum(case when l_linestatus = 'O' then 1 else 0 end) as bigint) ac, count(*) an from lineitem group by 1")
def agg12_allele_counts(spark, d):
    g = table(spark, d, "lineitem").withColumn("gt", F.array(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)))
    return g.select("l_orderkey", F.explode("gt").alias("a")).groupBy("l_orderkey").agg(F.count_if(F.col("a") > 0).alias("ac"), F.count("*").alias("an"))


@query("select count(*) as records, count(distinct o_custkey) as customers from orders")
def agg13_record_count(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("records"), F.count_distinct("o_custkey").alias("customers"))


@query("select c_nationkey, aa, ab, bb, round(case when 2 * aa + ab = 0 or 2 * bb + ab = 0 then 0 else (aa - n * p * p) ** 2 / (n * p * p) + (ab - 2 * n * p * (1 - p)) ** 2 / (2 * n * p * (1 - p)) + (bb - n * (1 - p) ** 2) ** 2 / (n * (1 - p) ** 2) end, 6) as hwe from (select *, (2 * aa + ab) / (2.0::double * n) p from (select c_nationkey, count(*) n, count(*) filter (c_custkey % 4 = 0) aa, count(*) filter (c_custkey % 4 in (1, 2)) ab, count(*) filter (c_custkey % 4 = 3) bb from customer group by 1))")
def agg14_genotype_counts_hwe(spark, d):
    m = F.col("c_custkey") % 4
    g = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count_if(m == 0).alias("aa"), F.count_if(m.isin(1, 2)).alias("ab"), F.count_if(m == 3).alias("bb"))
    return g.select("c_nationkey", "aa", "ab", "bb", F.round(tx.hardy_weinberg(F.col("aa"), F.col("ab"), F.col("bb")), 6).alias("hwe"))


@query("select label, arg_max(vec_id, (abs(embedding[1]), -vec_id)) as vec_id from embeddings group by 1")
def agg11_best_scoring(spark, d):
    return rl.top_by(table(spark, d, "embeddings"), "label", "vec_id", F.abs(F.col("embedding")[0]), "vec_id")


@query("""select l_orderkey, l_linenumber, l_partkey, row_number() over w as n, count(*) over (partition by l_orderkey) - row_number() over w + 1 as minus_n,
cast(coalesce(sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)""")
def win4_win5_exon_numbers_offsets(spark, d):
    li = table(spark, d, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")).withColumn("q", F.col("l_quantity").cast("bigint"))
    n = lambda minus: rl.numbered_blocks(li, "l_orderkey", "o", F.lit(minus)).cast("bigint")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", n(False).alias("n"), n(True).alias("minus_n"), rl.cumulative_offset("l_orderkey", "o", "q").alias("offset"))


@query("select distinct p_brand, p_size from part order by p_brand, p_size")
def srt1_srt3_sort_dedup(spark, d):
    return table(spark, d, "part").select("p_brand", "p_size").distinct().orderBy("p_brand", "p_size")


@query("select p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ' ') as sorted from part")
def srt2_list_sort(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.split("p_name", " ")), " ").alias("sorted"))


@query("select * from (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) r from customer) where r <= 3")
def lim1_top_rows(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", F.row_number().over(w).cast("bigint").alias("r")).where("r <= 3")


@query("select coalesce(c.k, s.k) as nationkey, c.n as customers, s.n as suppliers from (select c_nationkey k, count(*) n from customer where c_nationkey < 20 group by 1) c full join (select s_nationkey k, count(*) n from supplier where s_nationkey > 4 group by 1) s on c.k = s.k")
def jn9_full_outer_sites(spark, d):
    c = table(spark, d, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").where("s_nationkey > 4").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return rl.full_outer_sites(c, s, ["nationkey"])


@query("select c_custkey, coalesce(n.n_name, 'other') as nation from customer left join (select * from nation where n_nationkey % 2 = 0) n on n_nationkey = c_nationkey")
def jn7_dictionary_rename(spark, d):
    n = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("k"), "n_name")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    out = rl.renamed_values(c, "nation", n, "k", "n_name")
    return out.withColumn("nation", F.when(F.col("nation").rlike("^[0-9]+$"), "other").otherwise(F.col("nation")))


@query("select p_partkey, p_brand from part where p_size > 25 or p_brand in (select p_brand from part where p_partkey % 100 = 1)")
def jn8_src23_whitelist(spark, d):
    p = table(spark, d, "part")
    return rl.whitelisted(p, p.where("p_partkey % 100 = 1").select("p_brand"), "p_brand", F.col("p_size") <= 25).select("p_partkey", "p_brand")


@query("select doc_id, concat(substr(text, 21, 10), '.', substr(text, 34, 10)) as flank from documents where length(text) >= 43 union all select doc_id, null from documents where length(text) < 43")
def seq11_flanks(spark, d):
    return table(spark, d, "documents").select("doc_id", sq.flanks(F.col("text"), F.lit(30), F.lit(3)).alias("flank"))


_DNA = "translate(substr(md5(cast(p_partkey as varchar)), 1, 24), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _dna(spark, d):
    return table(spark, d, "part").select("p_partkey", F.translate(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 24), "0123456789abcdef", "ACGTACGTACGTACGT").alias("dna"))


@query(f"select p_partkey, translate(reverse({_DNA}), 'ACGT', 'TGCA') as rc, regexp_matches({_DNA}, '^[ACGT]+$') as pure, instr('ACGT', substr({_DNA}, 1, 1)) - 1 as code from part")
def seq1_seq2_flt9_revcomp(spark, d):
    return _dna(spark, d).select("p_partkey", sq.reverse_complement(F.col("dna")).alias("rc"), sq.is_acgt(F.col("dna")).alias("pure"), sq.base_code(F.substring("dna", 1, 1)).cast("bigint").alias("code"))


_CODONS = "case " + " ".join(f"when c = '{c}' then '{a}'" for c, a in sq.CODE.items()) + " end"


@query(f"""select p_partkey, string_agg({_CODONS}, '' order by i) as aa, instr(string_agg({_CODONS}, '' order by i), '*') as stop,
case when instr(string_agg({_CODONS}, '' order by i), '*') > 0 then substr(string_agg({_CODONS}, '' order by i), 1, instr(string_agg({_CODONS}, '' order by i), '*')) else string_agg({_CODONS}, '' order by i) end as protein
from (select p_partkey, i, substr({_DNA}, i * 3 + 1, 3) c from part, range(8) t(i)) group by 1""")
def seq5_seq6_seq7_translate(spark, d):
    s = F.col("dna")
    return _dna(spark, d).select("p_partkey", sq.amino_acids(s).alias("aa"), sq.stop_position(s).cast("bigint").alias("stop"), sq.translated(s).alias("protein"))


@query(f"select p_partkey, substr({_DNA}, 1, p_size % 20) || 'TTT' || substr({_DNA}, p_size % 20 + 3) as mutated, upper({_DNA}) = {_DNA} as same from part")
def seq8_seq12_mutate(spark, d):
    p = _dna(spark, d).join(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    return p.select("p_partkey", sq.mutated(F.col("dna"), F.col("p_size") % 20, F.lit(2), F.lit("TTT")).alias("mutated"), sq.same_dna(F.lower("dna"), F.col("dna")).alias("same"))


@query(f"select p_partkey, round(case substr({_DNA}, 1, 1) when 'A' then 1.5 when 'C' then -1.0 when 'G' then 0.25 else 0.0 end + case substr({_DNA}, 2, 1) when 'A' then 0.5 when 'C' then 2.0 when 'G' then -0.75 else 1.0 end, 6)::double as score from part")
def seq16_matrix_score(spark, d):
    return _dna(spark, d).select("p_partkey", F.round(sq.matrix_score(F.col("dna"), [[1.5, -1.0, 0.25, 0.0], [0.5, 2.0, -0.75, 1.0]]), 6).alias("score"))


@query("""select a.n_nationkey, b.n_nationkey as other, case when upper(a.n_name) = upper(b.n_name) then 0 when length(a.n_name) <> length(b.n_name) then 4
when len(list_filter(range(1, length(a.n_name) + 1), lambda i: upper(a.n_name[i]) <> upper(b.n_name[i]))) = 1 then 1 else 2 end as class from nation a, nation b""")
def map4_variant_class(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    # A query over all pairs of a table of fixed size (25 nations).
    pairs = n.crossJoin(n.select(F.col("n_nationkey").alias("other"), F.col("n_name").alias("o")))
    return pairs.select("n_nationkey", "other", al.allele_class(F.col("n_name"), F.col("o")).alias("class"))


_PRE = "len(list_filter(range(1, least(length(r), length(a)) + 1), lambda i: r[:i] = a[:i]))"


@query(f"""with p as (select p_partkey, upper(p_brand) r, upper(p_type) a from part), q as (select p_partkey, {_PRE} pre, r[{_PRE} + 1:] r, a[{_PRE} + 1:] a from p),
s as (select *, len(list_filter(range(1, least(length(r), length(a)) + 1), lambda i: right(r, i) = right(a, i))) suf from q)
select p_partkey, 100 + pre as "start", 100 + pre + length(r) - suf as "end", left(r, length(r) - suf) as ref, left(a, length(a) - suf) as alt from s""")
def map5_seq9_trim(spark, d):
    t = al.trimmed(F.lit(100), F.upper("p_brand"), F.upper("p_type"))
    return table(spark, d, "part").select("p_partkey", t.alias("t")).select("p_partkey", F.col("t.start").cast("bigint").alias("start"), F.col("t.end").cast("bigint").alias("end"), F.col("t.ref").alias("ref"), F.col("t.alt").alias("alt"))


@query("""select p_partkey, array_to_string(list_transform(a, lambda x: case when list_position(b, x) is null or list_position(b, x) = 0 then '.' else cast(list_position(b, x) * 10 as varchar) end), ',') as values from
(select p_partkey, string_split(upper(p_name), ' ') a, list_reverse(string_split(upper(p_name), ' '))[1:1] || ['NONE'] b from part)""")
def map1_map2_map3_allele_remap(spark, d):
    alts = F.split("p_name", " ")
    db = F.concat(F.slice(F.reverse(alts), 1, 1), F.array(F.lit("none")))
    vals = al.remapped(F.array(F.lit(10), F.lit(20)), F.lit("A"), alts, F.lit("a"), db)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(vals, lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",").alias("values"))


@query("""select c_custkey, case when a is null or b is null then 'UNKN' when a = b and a = 0 then 'HOM_RR' when a = b then 'HOM_AA' when a = 0 or b = 0 then 'HET_RA' else 'HET_AA' end as kind,
coalesce(cast(a as varchar), '.') || '/' || coalesce(cast(b as varchar), '.') as gt, coalesce(['A', 'C', 'G'][a + 1], '.') || '|' || coalesce(['A', 'C', 'G'][b + 1], '.') as tgt,
cast(greatest(coalesce(a, 0), coalesce(b, 0)) * (greatest(coalesce(a, 0), coalesce(b, 0)) + 1) // 2 + least(coalesce(a, 0), coalesce(b, 0)) as integer) as idx, coalesce(a > 0, false) or coalesce(b > 0, false) as called_alt, a is not null or b is not null as covered
from (select c_custkey, case when c_custkey % 7 > 0 then cast(c_custkey % 3 as integer) end a, case when c_custkey % 5 > 0 then cast(c_nationkey % 3 as integer) end b from customer)""")
def map7_map8_map9_map10_flt4_flt5_genotypes(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, (F.col("c_custkey") % 3).cast("int")).alias("a"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_nationkey") % 3).alias("b"))
    gt = F.array("a", "b")
    lo, hi = (f(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))) for f in (F.least, F.greatest))
    bases = F.array(*map(F.lit, "ACG"))
    return c.select("c_custkey", al.genotype_type(gt).alias("kind"), al.genotype_text(gt, F.lit(False)).alias("gt"), al.genotype_text(gt, F.lit(True), bases).alias("tgt"), al.genotype_index(lo, hi).alias("idx"), F.coalesce(al.called_alt(gt), F.lit(False)).alias("called_alt"), F.coalesce(al.covered(gt), F.lit(False)).alias("covered"))


@query("select p_partkey, i - 1 as allele, w[i] as value, case when i > 1 then w2[i - 1] end as a_value from (select p_partkey, unnest(range(1, len(w) + 1)) i, w, w[2:] w2 from (select p_partkey, string_split(p_name, ' ') w from part))")
def exp2_exp3_exp4_prj6_explode_alleles(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    p = p.withColumn("alts", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))))
    e = rl.exploded(p, rl.alleles_of(F.col("w")[0], F.col("alts")), "allele", "base")
    return e.select("p_partkey", F.col("allele").cast("bigint").alias("allele"), rl.picked(F.col("w"), "R", F.col("allele")).alias("value"), rl.picked(F.col("alts"), "A", F.col("allele")).alias("a_value"))


@query("select vec_id, unnest(range(len(embedding))) as sample, unnest(embedding) as value from embeddings")
def exp1_explode_samples(spark, d):
    e = rl.exploded(table(spark, d, "embeddings"), F.col("embedding"), "sample", "value")
    return e.select("vec_id", F.col("sample").cast("bigint").alias("sample"), "value")


@query("select event_id, cast(props->>'$.k' as varchar) as k from events")
def jsn1_json_path(spark, d):
    return table(spark, d, "events").select("event_id", tx.json_path(F.col("props"), "$.k").alias("k"))


@query("""select p_partkey, replace(p_name || ';' || p_brand, ';', '|') as clean, try_cast(string_split(p_size || ',x', ',')[1] as integer) as first, try_cast(string_split(p_size || ',x', ',')[2] as integer) as second,
regexp_matches(p_brand, '^[0-9]+$') as brand_number, p_size + 255 as parsed from part""")
def str1_str2_str3_str4_flt8_values(spark, d):
    p = table(spark, d, "part")
    values = tx.typed_list(F.concat(F.col("p_size").cast("string"), F.lit(",x")), "Integer")
    parsed = tx.parsed_integer(F.lit("0xFF")) + tx.parsed_integer(F.col("p_size").cast("string"))
    return p.select("p_partkey", tx.sanitised(F.concat("p_name", F.lit(";"), "p_brand")).alias("clean"), values[0].alias("first"), values[1].alias("second"), tx.is_number_like(F.col("p_brand")).alias("brand_number"), parsed.alias("parsed"))


@query("select url_decode(url_encode(url)) as url, base64(encode(url)) as encoded, md5(url) as digest from pages")
def str7_decode_digest(spark, d):
    return table(spark, d, "pages").select(F.url_decode(F.url_encode("url")).alias("url"), tx.base64_text(F.col("url")).alias("encoded"), F.md5("url").alias("digest"))


@query("select c_custkey from customer where c_mktsegment is not null and c_nationkey & 5 = 0 and c_acctbal > 0 and list_contains([c_mktsegment], 'BUILDING') is not null")
def flt6_flt10_predicates(spark, d):
    c = table(spark, d, "customer")
    return c.where(F.col("c_mktsegment").isNotNull() & rl.minus_one_mask(F.col("c_nationkey"), 5) & (F.col("c_acctbal") > 0)).select("c_custkey")


@query("select o_orderkey, cast(o_totalprice as double) as total from orders where o_orderstatus = 'F' union all select l_orderkey, cast(l_extendedprice as double) from lineitem where l_linestatus = 'F'")
def set8_union_by_name(spark, d):
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_totalprice").alias("total"))
    b = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("total"))
    return a.unionByName(b, allowMissingColumns=True)


_LC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
_TABLE = ", ".join(f"count(*) filter (l_returnflag = '{f}' and l_linestatus = '{s}') {f.lower()}{s.lower()}" for f in "AN" for s in "FO")


@query(f"""with g as (select l_linenumber, {_TABLE} from lineitem group by 1), t as (select l_linenumber, af, af + ao as r, af + nf as c, af + ao + nf + no as n from g),
x as (select *, unnest(range(greatest(0, r + c - n), least(r, c) + 1)) x from t), p as (select *, {_LC.format('r', 'x')} + {_LC.format('(n - r)', '(c - x)')} - {_LC.format('n', 'c')} lp from x),
h as (select l_linenumber, lp here from p where x = af) select l_linenumber, round(least(1, sum(exp(lp)) filter (lp <= here + 1e-9)), 9) as p from p join h using (l_linenumber) group by 1""")
def mth1_fisher_exact(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_linenumber").agg(*[F.count_if((F.col("l_returnflag") == f) & (F.col("l_linestatus") == s)).alias(f"{f}{s}".lower()) for f in "AN" for s in "FO"])
    return g.select("l_linenumber", F.round(tx.fisher_exact("af", "ao", "nf", "no"), 9).alias("p"))


@query("""select l_quantity::integer q, l_linenumber n, round(1 - list_sum(list_transform(range(0, l_linenumber), lambda k: exp(k * ln(l_quantity::double / 7) - l_quantity::double / 7 - lgamma(k + 1)))), 8) as gamma_share,
 round(list_sum(list_transform(range(l_linenumber, 9), lambda k: exp(lgamma(9) - lgamma(k + 1) - lgamma(9 - k) + k * ln(l_quantity::double / 51) + (8 - k) * ln(1 - l_quantity::double / 51)))), 8) as beta_share,
 round(lgamma(l_quantity::double / 3), 8) as log_gamma from (select distinct l_quantity, l_linenumber from lineitem)""")
def mth1_incomplete_integrals(spark, d):
    """Chances that a count reaches l_linenumber: Poisson's by the incomplete gamma function, of eight trials by the incomplete beta function."""
    q = table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("q"), F.col("l_linenumber").alias("n")).distinct()
    x, n = F.col("q").cast("double"), F.col("n").cast("double")
    return q.select("q", "n", F.round(tx.incomplete_gamma(n, x / 7), 8).alias("gamma_share"), F.round(tx.incomplete_beta(n, 9 - n, x / 51), 8).alias("beta_share"), F.round(tx.log_gamma(x / 3), 8).alias("log_gamma"))


@query(f"select o_orderkey, pos, min(p_partkey) as p_partkey from {_P} join {_R} on {_IN} group by 1, 2")
def stm1_stream_annotate(spark, d):
    from ..streaming.annotate_stream import annotated_once

    return annotated_once(spark, f"{d}/orders.parquet", _regions(spark, d))
