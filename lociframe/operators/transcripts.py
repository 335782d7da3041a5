"""Places on transcripts for both ends of regions, with column functions only; and names of changes taken back to the genome."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.consequence import Transcript
from ..functions.names import change_on_genome, parsed_name
from ..shipping import ship
from .intervals import range_join


def located(pos: str, blocks: str, strand: str) -> Column:
    """struct<pos, offset, exon>: where a genomic position (0-based, inside the transcript) is on it, exons being numbered along it.

    In an intron the base of the nearer exon's edge is named with the distance to it (of equal ones the edge to the left on
    the genome): above 0 behind the exon, below 0 ahead of it. blocks: 0-based exons, array<struct<start, end>>.
    """
    size = "x.end - x.start"
    body = f"""named_struct('b', bs[k - 1], 'x', aggregate(slice(bs, 1, k - 1), 0, (n, x) -> n + {size}), 'all', aggregate(bs, 0, (n, x) -> n + {size}), 'k', k, 'n', size(bs), 'next', get(bs, k).start)"""
    with_k = f"transform(array(size(filter(bs, x -> x.start <= {pos}))), k -> {body})[0]"
    found = f"transform(array(array_sort({blocks})), bs -> {with_k})[0]"
    left, right = f"({pos} - f.b.end + 1)", f"(f.next - {pos})"
    inside, near_left = f"{pos} < f.b.end", f"{left} <= {right}"
    # x: the base of the joined exons in genome order; by: how far the position is to the right of it.
    x = f"case when {inside} then f.x + {pos} - f.b.start when {near_left} then f.x + f.b.end - f.b.start - 1 else f.x + f.b.end - f.b.start end"
    by = f"case when {inside} then 0 when {near_left} then {left} else -{right} end"
    k = f"case when {inside} or {near_left} then f.k else f.k + 1 end"
    turned = f"{strand} = '-'"
    told = f"named_struct('pos', if({turned}, f.all - ({x}), {x} + 1), 'offset', if({turned}, -({by}), {by}), 'exon', if({turned}, f.n - ({k}) + 1, {k}))"
    return F.expr(f"transform(array({found}), f -> {told})[0]")


def located_ends(regions: DataFrame, transcripts: DataFrame, key: str) -> DataFrame:
    """regions with start_on and end_on: the first and the last base on all transcripts over them, like T(G):n.12+3,EX2|..., or Intergenic.

    regions have chrom, start, end (0-based, half-open) and a key; transcripts are those of read_gene_predictions. Both ends are sought in one
    join; transcripts are named in the order of their begin, then of their names. Regions of the same key have to be equal.
    """
    ends = regions.select(F.col(key).alias("_key"), "chrom", F.explode(F.array(F.struct(F.lit("s").alias("end"), F.col("start").alias("pos")), F.struct(F.lit("e").alias("end"), (F.col("end") - 1).alias("pos")))).alias("_e"))
    points = ends.select("_key", "chrom", F.col("_e.end").alias("_end"), F.col("_e.pos").alias("pos")).distinct()
    t = transcripts.select("chrom", "name1", "name2", "strand", F.col("txstart").alias("start"), F.col("txend").alias("end"), "blocks")
    met = range_join(points, t).withColumn("_at", located("pos", "blocks", "strand"))
    shown = F.concat("name1", F.lit("("), "name2", F.lit("):n."), F.col("_at.pos"), F.when(F.col("_at.offset") > 0, F.concat(F.lit("+"), "_at.offset")).when(F.col("_at.offset") < 0, F.col("_at.offset").cast("string")).otherwise(""), F.lit(",EX"), F.col("_at.exon"))
    listed = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_end") == which, F.struct("start", "name1", shown.alias("text"))))), lambda x: x["text"]), "|")
    wide = met.groupBy("_key").agg(listed("s").alias("_s"), listed("e").alias("_e"))
    out = regions.join(wide, regions[key] == wide["_key"], "left")
    named = lambda c: F.when(F.col(c) != "", F.col(c)).otherwise("Intergenic")
    return out.select(*[regions[c] for c in regions.columns], named("_s").alias("start_on"), named("_e").alias("end_on"))


_PLACED = "chrom string, start int, end int, ref string, alt string, change string, problem string"


def places_of_names(df: DataFrame, name: str, elements: DataFrame) -> DataFrame:
    """df with chrom, start, end, ref, alt, change and problem of the changes that a column names (columns of these names are replaced).

    elements are those of read_gea; transcripts are found by their names as they are written. Places are 0-based and half-open, bases on
    the plus strand; what isn't known is null, and problem says why. Names on contigs (g.) need no transcript. Rows are
    sorted by transcript in each task, so that a transcript is set up once there.
    """
    ship(df.sparkSession)
    told = [x.split(" ")[0] for x in _PLACED.split(", ")]
    own = [c for c in df.columns if c not in told]
    t = elements.where(F.lower("biotype").isin("mrna", "ncrna")).groupBy(F.col("name").alias("_on")).agg(F.min_by(F.struct("chrom", "strand", "cds_start", "cds_end", "blocks", "cigar"), "_ord").alias("_t")).hint("merge")
    on = F.trim(F.regexp_extract(F.coalesce(F.col(name), F.lit("")), r"^\s*[\"']?([^:(\"']+)", 1))
    rows = df.select(*own, on.alias("_of")).join(t, F.col("_of") == F.col("_on"), "left").drop("_of")
    schema = StructType(df.select(*own).schema.fields + StructType.fromDDL(_PLACED).fields)
    types = [{"string": pa.string(), "int": pa.int32()}[x.split(" ")[1]] for x in _PLACED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str | None, Transcript | None] = (None, None)
        for b in batches:
            out = []
            texts, names, raw = (b.column(b.schema.get_field_index(c)) for c in (name, "_on", "_t"))
            for i, (text, of) in enumerate(zip(texts.to_pylist(), names.to_pylist(), strict=True)):
                n = parsed_name(text)
                if n is None:
                    out.append((None,) * 6 + ("not a name",))
                    continue
                if of != known[0]:
                    r = raw[i].as_py()
                    cds = (r["cds_start"], r["cds_end"]) if r and r["cds_start"] is not None and r["cds_end"] is not None and r["cds_end"] > r["cds_start"] else None
                    known = of, r and Transcript(of, r["strand"] or "+", [(x["start"], x["end"]) for x in r["blocks"]], cds, [(x["op"], x["len"]) for x in r["cigar"] or []])
                place = change_on_genome(n, known[1] if n.kind in "cn" else None)
                chrom = n.on if n.kind in "gm" else raw[i].as_py()["chrom"] if of else None
                out.append((chrom, place.get("start"), place.get("end"), place.get("ref"), place.get("alt"), n.change, place["problem"]))
            cells = [pa.array(c, x) for c, x in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], x) for x in types]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in own), *cells], names=[*own, *told])

    return rows.sortWithinPartitions("_on").mapInArrow(run, schema)
