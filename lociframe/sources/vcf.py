"""Variant call text files as DataFrames: header to schema, typed INFO, samples, and back to text.

Positions are 0-based half-open in columns start and end; `pos` is the 1-based one. `_vid` is a row's place
in the file, which output order and merge-back rest on.
"""

from __future__ import annotations

import os
import re
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"Integer": "int", "Float": "float", "String": "string", "Character": "string"}
_PAIR = re.compile(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)')


@dataclass
class Tag:
    name: str
    number: str = "1"
    type: str = "String"
    description: str = ""

    @property
    def sql(self) -> str:
        if self.type == "Flag" or self.number == "0":
            return "boolean"
        base = TYPES.get(self.type, "string")
        return base if self.number == "1" else f"array<{base}>"

    def line(self, kind: str = "INFO") -> str:
        return f'##{kind}=<ID={self.name},Number={self.number},Type={self.type},Description="{self.description}">'


@dataclass
class VcfHeader:
    version: str = "VCFv4.2"
    info: OrderedDict[str, Tag] = field(default_factory=OrderedDict)
    format: OrderedDict[str, Tag] = field(default_factory=OrderedDict)
    contigs: OrderedDict[str, int | None] = field(default_factory=OrderedDict)
    filters: OrderedDict[str, str] = field(default_factory=OrderedDict)
    other: list[str] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, lines: list[str]) -> VcfHeader:
        h = cls()
        for line in lines:
            if line.startswith("##fileformat="):
                h.version = line.split("=", 1)[1].strip()
            elif m := re.match(r"##(INFO|FORMAT|FILTER|contig)=<(.*)>\s*$", line):
                kv = {k: v.strip('"') for k, v in _PAIR.findall(m[2])}
                if m[1] in ("INFO", "FORMAT"):
                    tag = Tag(kv["ID"], kv.get("Number", "1"), kv.get("Type", "String"), kv.get("Description", ""))
                    (h.info if m[1] == "INFO" else h.format)[tag.name] = tag
                elif m[1] == "FILTER":
                    h.filters[kv["ID"]] = kv.get("Description", "")
                else:
                    h.contigs[kv["ID"]] = int(kv["length"]) if kv.get("length", "").isdigit() else None
            elif line.startswith("##"):
                h.other.append(line)
            elif line.startswith("#CHROM"):
                h.samples = line.rstrip("\n").split("\t")[9:]
        return h

    def lines(self) -> list[str]:
        out = [f"##fileformat={self.version}", *self.other]
        out += [f'##FILTER=<ID={k},Description="{v}">' for k, v in self.filters.items()]
        out += [t.line() for t in self.info.values()] + [t.line("FORMAT") for t in self.format.values()]
        out += [f"##contig=<ID={k}" + (f",length={v}" if v else "") + ">" for k, v in self.contigs.items()]
        cols = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"] + (["FORMAT", *self.samples] if self.samples else [])
        return [*out, "\t".join(cols)]

    def with_tags(self, tags: list[Tag], provenance: list[str] = ()) -> VcfHeader:
        """Tags added where the header lacks them (its own types stay), and provenance lines."""
        new = VcfHeader.parse(self.lines())
        for t in tags:
            new.info.setdefault(t.name, t)
        new.other += [x for x in provenance if x not in new.other]
        return new

    def merged(self, other: VcfHeader) -> VcfHeader:
        new = self.with_tags(list(other.info.values()), other.other)
        for mine, theirs in ((new.format, other.format), (new.contigs, other.contigs), (new.filters, other.filters)):
            for k, v in theirs.items():
                mine.setdefault(k, v)
        new.samples += [s for s in other.samples if s not in new.samples]
        return new


def head_lines(spark: SparkSession, path: str) -> list[str]:
    """The comment lines that a file, or the first file of a folder that has any lines, starts with; however many there are."""
    out: list[str] = []
    for f in sorted(spark.read.text(path).inputFiles()):
        n = 1 << 12
        while True:
            lines = [r.value for r in spark.read.text(f).limit(n).collect()]
            end = next((i for i, x in enumerate(lines) if not x.startswith("#")), None)
            if end is not None:
                return out + lines[:end]
            if len(lines) < n:
                out += lines
                break
            n *= 8
    return out


def read_header(spark: SparkSession, path: str) -> VcfHeader:
    """The header of a file or of a folder of parts, from the lines before the first record."""
    return VcfHeader.parse(head_lines(spark, path))


def sniff(first: bytes) -> str:
    """The format that a file's first bytes announce."""
    for magic, name in ((b"\x1f\x8b", "gzip"), (b"CRAM", "cram"), (b"BAM\1", "bam"), (b"BCF", "bcf"), (b"CSI\1", "csi"), (b"TBI\1", "tbi"), (b"BEA\2", "bea"), (b"##fileformat=VCF", "vcf"), (b"##fileformat=GenomeElementAnnotation", "gea"), (b"@HD\t", "sam"), (b"@SQ\t", "sam"), (b">", "fasta")):
        if first.startswith(magic):
            return name
    return "text"


def _typed(raw: Column, tag: Tag) -> Column:
    kind = tag.sql
    if kind == "boolean":
        return raw.isNotNull()
    one = lambda x: F.when(x != ".", x.try_cast(kind.removeprefix("array<").rstrip(">")))
    return F.transform(F.split(raw, ","), one) if kind.startswith("array") else one(raw)


#: Bits of _vid for a row's place in its task, which monotonically_increasing_id has, and for its file and split together.
ROW_BITS, PLACE_BITS = 33, 30
#: Files whose order is kept; their names are broadcast, at most some 100 MB.
MOST_FILES = 1 << 20


def split_bits(files: int) -> int:
    """What a file's splits are numbered with where there are so many files."""
    if files > MOST_FILES:
        raise ValueError("too many files to keep in order")
    return PLACE_BITS - max(files - 1, 0).bit_length()


def _bytes(size: str) -> int:
    """Spark's sizes: '128m', '64k', '134217728b', '4194304'."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * (" kmgtp".index(unit or " "))


def with_order(lines: DataFrame) -> DataFrame:
    """_vid: rows in file order, by file name, then split, then place within it, however splits are dealt to tasks.

    Splits start at multiples of a size that is never under the lesser of maxPartitionBytes and openCostInBytes, so a start
    divided by that numbers them, whatever their size. A split that is shorter all the same, as these settings were changed before
    the plan ran, or a file of more splits than fit the number, is an error and never mixes records.
    """
    spark = lines.sparkSession
    files = sorted(lines.inputFiles())
    bits = split_bits(len(files))
    unit = max(1, min(_bytes(spark.conf.get(f"spark.sql.files.{x}")) for x in ("maxPartitionBytes", "openCostInBytes")))
    row = F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1)
    start, size = F.col("_metadata.file_block_start"), F.col("_metadata.file_block_length")
    short = (size < unit) & (start + size < F.col("_metadata.file_size"))
    number = F.floor(start / unit)
    refused = lambda why: F.raise_error(F.concat(F.lit(why + ": "), "_metadata.file_path")).cast("bigint")
    split = F.when(short, refused("split settings were changed after the plan was made")).when(number >= 1 << bits, refused("too many splits of a file to keep in order")).otherwise(number)
    at = F.shiftleft(split, ROW_BITS) + row
    if len(files) < 2:
        return lines.withColumn("_vid", at)
    # The two name local files with one slash or with three; the folder that all share isn't sent.
    names = [re.sub("^([^/:]+):/+", r"\1:/", f) for f in files]
    shared = os.path.commonprefix(names)
    numbered = spark.createDataFrame([(f[len(shared) :], i) for i, f in enumerate(names)], "_file string, _n bigint")
    named = lines.select("*", F.expr("substr(regexp_replace(_metadata.file_path, '^([^/:]+):/+', '$1:/'), " + str(len(shared) + 1) + ")").alias("_file"), at.alias("_at"))
    n = F.coalesce("_n", F.raise_error(F.concat(F.lit("not among the files listed: "), "_file")).cast("bigint"))
    return named.join(F.broadcast(numbered), "_file", "left").select(*lines.columns, (F.shiftleft(n, ROW_BITS + bits) + F.col("_at")).alias("_vid"))


def read_vcf(spark: SparkSession, path: str, header: VcfHeader | None = None, tags: list[str] | None = None, place: str = "int") -> DataFrame:
    """Variants: _vid, chrom, start, end, pos, id, ref, alts, qual, filters, info, extra_info, samples.

    info has a field for each declared tag (or each in `tags`); undeclared keys go to extra_info, '' for flags.
    place is the type of start, end, pos and the tag END: places over 2^31 need bigint, and are null as int.
    Columns that a query doesn't use are pruned; bgzip files are read as gzip here, by blocks through sources.hts.
    """
    h = header or read_header(spark, path)
    return variants_of(with_order(spark.read.text(path).where("not startswith(value, '#') and value <> ''")), h, tags, place)


def variants_of(lines: DataFrame, h: VcfHeader, tags: list[str] | None = None, place: str = "int") -> DataFrame:
    """The columns of read_vcf from its lines (_vid, value)."""
    df = lines.select("_vid", F.split("value", "\t").alias("c"))
    c = lambda i: F.when(F.get("c", F.lit(i)) != ".", F.get("c", F.lit(i)))
    pairs = F.filter(F.split(c(7), ";"), lambda x: x != "")
    kv = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda x: F.substring_index(x, "=", 1))), lambda k: F.struct(k, F.get(F.transform(F.filter(pairs, lambda x: F.substring_index(x, "=", 1) == k), lambda x: F.when(x.contains("="), F.substr(x, F.length(k) + 2)).otherwise("")), F.lit(0)))))
    df = df.withColumn("kv", F.coalesce(kv, F.create_map().cast("map<string,string>")))
    known = [h.info[t] for t in (tags if tags is not None else h.info) if t in h.info]
    own_end = F.try_element_at("kv", F.lit("END")).try_cast(place)
    value = lambda t: own_end if t.name == "END" and t.sql == "int" else _typed(F.try_element_at("kv", F.lit(t.name)), t)
    info = F.struct(*[value(t).alias(t.name) for t in known]) if known else F.struct(F.lit(None).cast("string").alias("_none"))
    declared = F.array(*[F.lit(t) for t in h.info]) if h.info else F.array().cast("array<string>")
    alts = F.when(c(4).isNull(), F.array().cast("array<string>")).otherwise(F.split(c(4), ","))
    keys = F.split(c(8), ":")
    out = df.select("_vid", c(0).alias("chrom"), (c(1).try_cast(place) - 1).alias("start"), F.coalesce(own_end, c(1).try_cast(place) - 1 + F.length(c(3))).alias("end"), c(1).try_cast(place).alias("pos"), c(2).alias("id"), c(3).alias("ref"), alts.alias("alts"), c(5).try_cast("float").alias("qual"), F.when(c(6).isNull(), F.array().cast("array<string>")).otherwise(F.split(c(6), ";")).alias("filters"), info.alias("info"), F.map_filter("kv", lambda k, v: ~F.array_contains(declared, k)).alias("extra_info"), "c", keys.alias("keys"))
    names = F.array(*[F.lit(s) for s in h.samples]) if h.samples else F.array().cast("array<string>")

    def sample(name: Column, i: Column) -> Column:
        cells = F.split(F.get("c", i + 9), ":")
        value = lambda tag: F.when(F.array_position("keys", tag) > 0, F.get(cells, (F.array_position("keys", tag) - 1).cast("int")))
        gt = value("GT")
        fmt = [_typed(F.when(value(t.name) != ".", value(t.name)), t).alias(t.name) for t in h.format.values() if t.name != "GT"]
        calls = F.transform(F.split(gt, "[/|]"), lambda x: F.when(x != ".", x.try_cast("int")))
        return F.struct(name.alias("name"), F.struct(calls.alias("alleles"), gt.contains("|").alias("phased")).alias("gt"), *([F.struct(*fmt).alias("fmt")] if fmt else []))

    return out.withColumn("samples", F.transform(names, sample)).drop("c", "keys")


def format_value(value: Column, tag: Tag) -> Column:
    from ..functions.text import general_format

    kind = tag.sql
    text = (lambda x: general_format(x.cast("double"))) if "float" in kind else (lambda x: x.cast("string"))
    if kind.startswith("array"):
        return F.array_join(F.transform(value, lambda x: F.coalesce(text(x), F.lit("."))), ",")
    return text(value)


def vcf_lines(df: DataFrame, header: VcfHeader, keep: list[str] = ()) -> DataFrame:
    """One text line per record, in file order, with columns to keep beside it."""
    fields = []
    for t in header.info.values():
        if t.name not in df.select("info.*").columns:
            continue
        v = F.col("info")[t.name]
        shown = F.concat(F.lit(t.name + "="), format_value(v, t)) if t.sql != "boolean" else F.lit(t.name)
        fields.append(F.when(v if t.sql == "boolean" else v.isNotNull(), shown))
    extra = F.transform(F.map_entries("extra_info"), lambda x: F.when(x["value"] == "", x["key"]).otherwise(F.concat(x["key"], F.lit("="), x["value"])))
    info = F.array_join(F.concat(F.array_compact(F.array(*fields)) if fields else F.array().cast("array<string>"), extra), ";")
    dot = lambda x: F.coalesce(F.when(x != "", x), F.lit("."))
    from ..functions.text import general_format

    cells = [F.col("chrom"), (F.col("start") + 1).cast("string"), dot(F.col("id")), F.col("ref"), dot(F.array_join("alts", ",")), dot(general_format(F.col("qual").cast("double"))), dot(F.array_join("filters", ";")), dot(info)]
    if header.samples:
        from ..functions.alleles import genotype_text

        tags = [t for t in header.format.values() if t.name != "GT"]
        one = lambda s: F.concat_ws(":", genotype_text(s["gt"]["alleles"], s["gt"]["phased"]), *[F.coalesce(format_value(s["fmt"][t.name], t), F.lit(".")) for t in tags])
        cells += [F.lit(":".join(["GT", *[t.name for t in tags]])), F.array_join(F.transform("samples", one), "\t")]
    return df.select("_vid", F.concat_ws("\t", *cells).alias("value"), *keep)


def write_vcf(df: DataFrame, header: VcfHeader, path: str, compression: str | None = None) -> None:
    """Header and records as text, in order; rows are range-partitioned, and the header leads the first part."""
    spark = df.sparkSession
    head = spark.createDataFrame([(i - (1 << 40), x) for i, x in enumerate(header.lines())], "_vid bigint, value string")
    lines = head.union(vcf_lines(df, header)).orderBy("_vid").select("value")
    (lines.write.option("compression", compression) if compression else lines.write).mode("overwrite").text(path)


def subset_samples(df: DataFrame, header: VcfHeader, names: list[str]) -> tuple[DataFrame, VcfHeader]:
    new = VcfHeader.parse(header.lines())
    new.samples = [s for s in header.samples if s in names]
    return df.withColumn("samples", F.filter("samples", lambda s: s["name"].isin(names))), new


def rename_tags(df: DataFrame, header: VcfHeader, names: dict[str, str]) -> tuple[DataFrame, VcfHeader]:
    """INFO/old -> new in both header and records; unknown names are left out."""
    names = {k.removeprefix("INFO/"): v for k, v in names.items()}
    new = VcfHeader.parse(header.lines())
    new.info = OrderedDict((names.get(k, k), Tag(names.get(k, k), t.number, t.type, t.description)) for k, t in header.info.items())
    have = df.select("info.*").columns
    return df.withColumn("info", F.struct(*[F.col("info")[c].alias(names.get(c, c)) for c in have])), new


def rename_contigs(df: DataFrame, header: VcfHeader, names: dict[str, str]) -> tuple[DataFrame, VcfHeader]:
    """Contigs renamed by a table, others kept. UCSC and NCBI styles of the main contigs: see contig_style."""
    names = {k.removeprefix("CTG/"): v for k, v in names.items()}
    new = VcfHeader.parse(header.lines())
    new.contigs = OrderedDict((names.get(k, k), v) for k, v in header.contigs.items())
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
    return (df.withColumn("chrom", F.coalesce(F.try_element_at(table, F.col("chrom")), "chrom")) if names else df), new


def contig_style(style: str) -> dict[str, str]:
    """From bare numbers to chr names ('ucsc') or back ('ncbi'), made by rule: 1 to 22, X, Y and the mitochondrion."""
    pairs = {str(x): f"chr{x}" for x in [*range(1, 23), "X", "Y"]} | {"MT": "chrM"}
    return pairs if style == "ucsc" else {v: k for k, v in pairs.items()}


def region(text: str) -> tuple[str, int, int | None]:
    """'c1', 'c1:120', 'c1:1,000-2,000' (1-based, both ends in) as (contig, start, end), 0-based half-open; without an end: None."""
    m = re.fullmatch(r"(.+?)(?::([\d,]+)(-([\d,]*))?)?", text.strip())
    if not m or not m[1]:
        raise ValueError(f"not a region: {text}")
    number = lambda x: int(x.replace(",", "")) if x else None
    beg, end = number(m[2]), number(m[4])
    if beg is None:
        return m[1], 0, None
    if m[3] is None:
        return m[1], beg - 1, None
    if end is not None and end < beg:
        raise ValueError(f"not a region: {text}")
    return m[1], beg - 1, end


def restricted(df: DataFrame, regions: list[str], start: str = "start", end: str = "end", chrom: str = "chrom") -> DataFrame:
    """Rows that overlap one of the regions, by comparisons with constants, which partitioned and sorted Parquet tables push down to the scan."""
    keep = F.lit(False)
    for c, s, e in map(region, regions):
        keep |= (F.col(chrom) == c) & (F.col(end) > s) & (F.lit(True) if e is None else F.col(start) < e)
    return df.where(keep)
