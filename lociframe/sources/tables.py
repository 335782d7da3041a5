"""Region tables, rename tables, name lists, gene models, sequences and configuration."""

from __future__ import annotations

import json
import posixpath
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vcf import Tag, VcfHeader, _typed, head_lines, sniff, with_order


def read_regions(spark: SparkSession, path: str, columns: list[str] | None = None) -> tuple[DataFrame, dict[str, Tag]]:
    """A region table with ##INFO lines and a '#chr start end tags' title: (rows with _ord, the tags bound)."""
    head = head_lines(spark, path)
    declared = VcfHeader.parse(head).info
    title = [x.strip() for x in head[-1].lstrip("#").split("\t")]
    if len(title) < 4:
        raise ValueError(f"{path}: a title line of four columns or more is needed")
    bound = {t: declared[t] for t in (columns or declared) if t in declared and t in title}
    cells = with_order(spark.read.text(path).where("not startswith(value, '#')")).select(F.col("_vid").alias("_ord"), F.split("value", "\t").alias("c")).where("size(c) > 3")
    cell = lambda i: F.get("c", F.lit(i))
    rows = cells.select("_ord", cell(0).alias("chrom"), cell(1).try_cast("int").alias("start"), cell(2).try_cast("int").alias("end"), *[F.when(cell(title.index(t)) != ".", cell(title.index(t))).alias(t) for t in bound])
    return rows.where("start is not null and end is not null"), bound


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Two columns or more; comments skipped, swapped bounds put right, a missing end one base."""
    from ..operators.intervals import normalised

    c = spark.read.text(path).where("value <> '' and not startswith(value, '#') and not startswith(value, 'track') and not startswith(value, 'browser')").select(F.split("value", r"\s+").alias("c")).where("size(c) > 1")
    return normalised(c.select(F.get("c", F.lit(0)).alias("chrom"), F.get("c", F.lit(1)).try_cast("int").alias("start"), F.get("c", F.lit(2)).try_cast("int").alias("end")).where("start is not null"))


def write_bed(df: DataFrame, path: str, columns: list[str] | None = None, track: str | None = None) -> None:
    """Tab-separated, by contig and start; with a track line for a detail track."""
    lines = df.orderBy("chrom", "start", "end").select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns or ("chrom", "start", "end")]).alias("value"))
    if track:
        lines = df.sparkSession.createDataFrame([(f'track name="{track}" type=bedDetail',)], "value string").union(lines)
    lines.write.mode("overwrite").text(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' and not startswith(name, '#')").distinct()


def read_rename_table(spark: SparkSession, path: str) -> DataFrame:
    """old, new: of duplicates the first in the file."""
    c = with_order(spark.read.text(path).where("value <> '' and not startswith(value, '#')")).select("_vid", F.split("value", r"\s+").alias("c")).where("size(c) > 1")
    return c.groupBy(F.col("c")[0].alias("old")).agg(F.min_by(F.col("c")[1], "_vid").alias("new"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A table whose last comment line is its title, the first column being chr or chrom."""
    title = [x.strip() for x in head_lines(spark, path)[-1].lstrip("#").split("\t")]
    if title[0].lower() not in ("chr", "chrom"):
        raise ValueError(f"{path}: the title must start with chr or chrom")
    rows = with_order(spark.read.text(path).where("value <> '' and not startswith(value, '#')")).select("_vid", F.split("value", "\t").alias("c"))
    return rows.select("_vid", *[F.get("c", F.lit(i)).alias(t.lower() if t.lower() in ("chr", "chrom", "pos", "ref", "alt", "start", "end") else t) for i, t in enumerate(title)])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, title, seq, one row per sequence; for transcripts. Whole genomes: chunked()."""
    r = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    title = F.substring_index("value", "\n", 1)
    return r.select(F.split(title, r"\s")[0].alias("name"), F.trim(title).alias("title"), F.regexp_replace(F.substr("value", F.length(title) + 2), r"\s", "").alias("seq"))


def transcript_version(name, title):
    """The version of NAME.VERSION, else of the title."""
    own, other = F.regexp_extract(name, r"\.([0-9]+)$", 1), F.regexp_extract(title, r"\.([0-9]+)", 1)
    return F.coalesce(F.when(own != "", own), F.when(other != "", other)).cast("int")


def chunked(sequences: DataFrame, size: int = 1 << 16, overlap: int = 2048) -> DataFrame:
    """name, chunk, offset, seq: stretches that overlap, so that a short lookup needs one of them."""
    n = F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(F.length("seq") - 1, F.lit(0)) / size))
    return sequences.select("name", "seq", F.explode(n).alias("chunk")).select("name", "chunk", (F.col("chunk") * size).alias("offset"), F.substr("seq", F.col("chunk") * size + 1, F.lit(size + overlap)).alias("seq"))


def read_gea(spark: SparkSession, path: str) -> DataFrame:
    """Gene elements: 13 columns; blocks 0-based half-open, alignment as an array of (op, len), geometry not yet derived."""
    if sniff("\n".join(head_lines(spark, path)[:1]).encode()) != "gea":
        raise ValueError(f"{path} isn't a gene element table")
    c = with_order(spark.read.text(path).where("value <> '' and not startswith(value, '#')")).select(F.col("_vid").alias("_ord"), F.split("value", "\t").alias("c"))
    g = lambda i: F.when(F.get("c", F.lit(i)) != ".", F.get("c", F.lit(i)))
    ints = lambda x: F.transform(F.filter(F.split(x, ","), lambda y: y != ""), lambda y: y.try_cast("int"))
    cigar = F.regexp_extract(F.coalesce(g(12), F.lit("")), r"(?:^|;)alignment_state=([^;]*)", 1)
    ops = F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]*[MID*])"), 1), lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.coalesce(F.substr(x, F.lit(1), F.length(x) - 1).try_cast("int"), F.lit(0)).alias("len")))
    blocks = F.when(g(10).isNull(), F.array(F.struct(g(1).cast("int").alias("start"), g(2).cast("int").alias("end")))).otherwise(F.arrays_zip(ints(g(10)).alias("start"), ints(g(11)).alias("end")))
    strand = F.when(g(6) == "+-", None).otherwise(F.when(g(6) != "*", g(6)))
    return c.select("_ord", g(0).alias("chrom"), g(1).cast("int").alias("start"), g(2).cast("int").alias("end"), g(3).alias("name"), g(4).alias("biotype"), g(5).alias("gene"), strand.alias("strand"), g(7).try_cast("int").alias("cds_start"), g(8).try_cast("int").alias("cds_end"), blocks.alias("blocks"), ops.alias("cigar"), g(12).alias("info"))


def gea_lines(df: DataFrame) -> DataFrame:
    dot = lambda x: F.coalesce(x.cast("string"), F.lit("."))
    ends = [F.array_join(F.col(f"blocks.{k}").cast("array<string>"), ",") for k in ("start", "end")]
    return df.select("_ord", F.concat_ws("\t", "chrom", *[dot(F.col(c)) for c in ("start", "end", "name", "biotype", "gene", "strand", "cds_start", "cds_end")], F.size("blocks").cast("string"), *ends, dot(F.col("info"))).alias("value"))


# Where the dialects of gene prediction tables have their columns.
_EXT = ["name1", "chrom", "strand", "txstart", "txend", "cdsstart", "cdsend", "exon_count", "exonstarts", "exonends"]
DIALECTS = {
    "genePred": _EXT,
    "genePredExt": [*_EXT, "score", "name2"],
    "refGene": ["bin", *_EXT, "score", "name2"],
    "refFlat": ["name2", *_EXT],
}


def read_gene_predictions(spark: SparkSession, path: str, dialect: str) -> DataFrame:
    """name1, name2, chrom, strand, 0-based bounds, blocks; one shape for all four dialects."""
    cols = DIALECTS[dialect]
    c = spark.read.text(path).where("value <> '' and not startswith(value, '#')").select(F.split("value", "\t").alias("c"))
    g = lambda n: F.get("c", F.lit(cols.index(n))) if n in cols else F.lit(None).cast("string")
    ints = lambda x: F.transform(F.filter(F.split(x, ","), lambda y: y != ""), lambda y: y.cast("int"))
    return c.select(g("name1").alias("name1"), F.coalesce(g("name2"), g("name1")).alias("name2"), g("chrom").alias("chrom"), g("strand").alias("strand"), *[g(n).cast("int").alias(n) for n in ("txstart", "txend", "cdsstart", "cdsend", "exon_count")], F.arrays_zip(ints(g("exonstarts")).alias("start"), ints(g("exonends")).alias("end")).alias("blocks"))


def find_predictions(df: DataFrame, gene: str | None = None, transcript: str | None = None) -> DataFrame:
    """By gene, or by transcript (any version if none is named), whatever the case."""
    if gene:
        df = df.where(F.lower("name2") == gene.lower())
    if transcript:
        want, have = transcript.lower(), F.lower("name1")
        df = df.where(have == want if "." in want else F.substring_index(have, ".", 1) == want)
    return df


def exon_table(df: DataFrame) -> DataFrame:
    """A row per exon, numbered along the transcript."""
    e = df.select("*", F.posexplode("blocks").alias("i", "b"))
    n = F.when(F.col("strand") == "-", F.col("exon_count") - F.col("i")).otherwise(F.col("i") + 1)
    return e.select("name1", "name2", "chrom", "strand", F.col("b.start").alias("start"), F.col("b.end").alias("end"), n.alias("exon"))


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """name, weights array<array<double>>: each after a '>' line, four numbers a row."""
    r = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    lines = F.filter(F.split(F.trim("value"), "\n"), lambda x: F.trim(x) != "")
    return r.select(F.split(lines[0], r"\s")[0].alias("name"), F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda y: y.cast("double"))).alias("weights"))


def read_sam(spark: SparkSession, path: str, least_quality: int = 0, mask: int = 0x4 | 0x200 | 0x400) -> DataFrame:
    """Alignments of SAM text: see alignments_of. Zipped text and BAM: sources.hts.read_lines gives their lines."""
    return alignments_of(with_order(spark.read.text(path)), least_quality, mask)


def alignments_of(lines: DataFrame, least_quality: int = 0, mask: int = 0x4 | 0x200 | 0x400) -> DataFrame:
    """Alignments by lines (_vid, value): _vid, name, flag, chrom, start, end, mapq, cigar, seq, qual, tags; unmapped, failed and duplicate reads left out."""
    c = lines.where("value <> '' and not startswith(value, '@')").select("_vid", F.split("value", "\t").alias("c"))
    c_ = lambda i: F.get("c", F.lit(i))
    ops = F.transform(F.regexp_extract_all(c_(5), F.lit("([0-9]+[MIDNSHP=X])"), 1), lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.substr(x, F.lit(1), F.length(x) - 1).cast("int").alias("len")))
    cell = F.slice("c", F.lit(12), F.greatest(F.size("c") - 11, F.lit(0)))
    tags = F.map_from_entries(F.transform(cell, lambda x: F.struct(F.substr(x, F.lit(1), F.lit(2)), F.substr(x, F.lit(4)))))
    df = c.select("_vid", c_(0).alias("name"), c_(1).try_cast("int").alias("flag"), c_(2).alias("chrom"), (c_(3).try_cast("int") - 1).alias("start"), c_(4).try_cast("int").alias("mapq"), ops.alias("cigar"), c_(9).alias("seq"), c_(10).alias("qual"), tags.alias("tags"))
    spans = lambda which: F.aggregate("cigar", F.lit(0), lambda n, o: n + F.when(o["op"].isin(*which), o["len"]).otherwise(0))
    df = df.withColumn("end", F.col("start") + spans("MDN=X")).withColumn("query_length", spans("MIS=X"))
    return df.where((F.col("flag").bitwiseAND(mask) == 0) & (F.col("mapq") >= least_quality))


def read_info_tags(lines: list[str]) -> dict[str, Tag]:
    return dict(VcfHeader.parse(lines).info)


def without_comments(text: str) -> str:
    """JSON with // and # comments and trailing commas made plain; strings stay as they are."""
    out, i, quoted = [], 0, False
    while i < len(text):
        ch = text[i]
        if quoted:
            out.append(text[i : i + 2] if ch == "\\" else ch)
            quoted, i = ch != '"', i + (2 if ch == "\\" else 1)
            continue
        if ch == "#" or text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
            continue
        quoted = ch == '"'
        out.append(ch)
        i += 1
    return re.sub(r",(\s*[}\]])", r"\1", "".join(out))


@dataclass
class Database:
    file: str
    columns: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Config:
    vcf: list[Database] = field(default_factory=list)
    bed: list[Database] = field(default_factory=list)
    gene_data: str | None = None
    transcripts: str | None = None
    transcript_list: str | None = None
    gene_list: str | None = None
    reference: str | None = None
    gene_columns: list[tuple[str, str]] = field(default_factory=list)
    modules: list[str] = field(default_factory=list)


REFUSED = frozenset(["CHROM", "POS", "REF", "ALT", "QUAL", "INFO", "FORMAT"])


def column_list(text: str | None) -> list[tuple[str, str]]:
    """'A,+B,-C,INFO/D' as [(name, '+' or '-')]; fixed and FORMAT columns are refused."""
    out = []
    for part in (text or "").split(","):
        part = part.strip()
        mode = part[0] if part[:1] in ("+", "-") else "+"
        name = part.lstrip("+-").removeprefix("INFO/")
        if name and name not in REFUSED and not name.startswith(("FORMAT/", "FMT/")):
            out.append((name, mode))
    return out


def load_config(text: str, base: str = "") -> Config:
    """The databases of a JSON configuration; relative paths are taken from `base`."""
    raw = json.loads(without_comments(text))
    path = lambda p: p if not p or "://" in p or p.startswith("/") else posixpath.join(base, p)
    dbs = lambda key: [Database(path(x["file"]), column_list(x.get("columns"))) for x in raw.get(key, []) if x.get("file")]
    gene = next((raw[k] for k in ("mc", "hgvs") if k in raw), {})
    named = [x for key in ("module", "plugins") for x in ([raw[key]] if isinstance(raw.get(key), str) else raw.get(key, []))]
    return Config(dbs("vcf"), dbs("bed"), path(gene.get("gene_data")), path(gene.get("refseq") or gene.get("transcripts")), path(gene.get("trans_list") or gene.get("transcripts_list")), path(gene.get("gene_list") or gene.get("genes_list")), path(raw.get("ref") or raw.get("reference")), column_list(gene.get("columns")), named)


def typed_columns(df: DataFrame, tags: dict[str, Tag]) -> DataFrame:
    for t in tags.values():
        df = df.withColumn(t.name, _typed(F.col(t.name), t))
    return df
