"""Column functions over alleles and genotypes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REF, SNP, MNP, INDEL, OTHER, BND = 0, 1, 2, 4, 8, 16


def allele_class(ref: Column, alt: Column) -> Column:
    """REF 0, SNP 1, MNP 2, INDEL 4, OTHER 8, BND 16, of one alternative allele."""
    r, a = F.upper(ref), F.upper(alt)
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(r), F.lit(1))), F.lit(0), lambda n, i: n + (F.substring(r, i, F.lit(1)) != F.substring(a, i, F.lit(1))).cast("int"))
    return (
        F.when(alt.isNull() | alt.isin(".", "X", "*", "<X>", "<*>") | (r == a), REF)
        .when(alt.contains("[") | alt.contains("]"), BND)
        .when(alt.startswith("<"), OTHER)
        .when(F.length(r) != F.length(a), INDEL)
        .when(same == 1, SNP)
        .when(same > 1, MNP)
        .otherwise(REF)
    )


def record_class(ref: Column, alts: Column) -> Column:
    """The classes of all alternative alleles, or-ed."""
    return F.aggregate(alts, F.lit(0), lambda acc, a: acc.bitwiseOR(allele_class(ref, a)))


def is_variant(ref: Column, alts: Column) -> Column:
    return record_class(ref, alts) != REF


def is_nonref(alt: Column) -> Column:
    return alt.isin("<NON_REF>", "<*>")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where the value is computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings, case-insensitive."""
    same = lambda z: F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.length(z["a"]), F.length(z["b"])), F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substring(z["a"], i, F.lit(1)) == F.substring(z["b"], i, F.lit(1))), acc + 1).otherwise(acc))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(_once(F.struct(F.upper(a).alias("a"), F.upper(b).alias("b")), same))


def trimmed(start: Column, ref: Column, alt: Column) -> Column:
    """struct<start, end, ref, alt, kind>: the common prefix off first, then the common suffix; 0-based, half-open.

    A pure insertion lies between two bases: start = end. kind: ref, snv, ins, del, delins.
    """
    left = _once(common_prefix(ref, alt), lambda p: F.struct(p.alias("p"), F.substr(ref, p + 1).alias("r"), F.substr(alt, p + 1).alias("a")))
    both = _once(left, lambda x: F.struct(x["p"].alias("p"), x["r"].alias("r"), x["a"].alias("a"), common_prefix(F.reverse(x["r"]), F.reverse(x["a"])).alias("s")))

    def told(x: Column) -> Column:
        r, a = (F.substr(x[c], F.lit(1), F.length(x[c]) - x["s"]) for c in "ra")
        n, m = (F.length(x[c]) - x["s"] for c in "ra")
        kind = F.when((n == 0) & (m == 0), "ref").when(n == 0, "ins").when(m == 0, "del").when((n == 1) & (m == 1), "snv").otherwise("delins")
        return F.struct((start + x["p"]).alias("start"), (start + x["p"] + n).alias("end"), r.alias("ref"), a.alias("alt"), kind.alias("kind"))

    return _once(both, told)


def compatible_refs(a: Column, b: Column) -> Column:
    """Whether one reference allele is a prefix of the other, whatever the case."""
    return F.upper(a).startswith(F.upper(b)) | F.upper(b).startswith(F.upper(a))


def remapped(values: Column, ref: Column, alts: Column, db_ref: Column, db_alts: Column, number: str = "A") -> Column:
    """A database's per-allele values in the order of the target's alleles; missing where it lacks the allele.

    Where one reference is longer, its surplus is appended to the other side's alleles before they are
    compared. A database whose references don't fit, or with a wrong count of values, gives nulls.
    """
    more_db, more = F.substr(F.upper(ref), F.length(db_ref) + 1), F.substr(F.upper(db_ref), F.length(ref) + 1)
    known = F.transform(db_alts, lambda x: F.concat(F.upper(x), more_db))
    first = 1 if number == "R" else 0
    fits = compatible_refs(ref, db_ref) & (F.size(values) == F.size(db_alts) + first)
    found = F.transform(alts, lambda x: F.when(fits, F.get(values, F.array_position(known, F.concat(F.upper(x), more)).cast("int") - 1 + first + F.when(F.array_position(known, F.concat(F.upper(x), more)) == 0, -1000).otherwise(0))))
    return F.concat(F.array(F.when(fits, F.get(values, F.lit(0)))), found) if number == "R" else found


def genotype_type(alleles: Column) -> Column:
    """HOM_RR, HOM_AA, HET_RA, HET_AA, HAPL_R, HAPL_A or UNKN, of allele numbers (null or negative: not called)."""
    called = F.filter(alleles, lambda x: x >= 0)
    n, d = F.size(called), F.array_distinct(called)
    ref = F.array_contains(called, 0)
    return (
        F.when(alleles.isNull() | (n == 0) | (n < F.size(alleles)), "UNKN")
        .when(n == 1, F.when(ref, "HAPL_R").otherwise("HAPL_A"))
        .when(F.size(d) == 1, F.when(ref, "HOM_RR").otherwise("HOM_AA"))
        .otherwise(F.when(ref, "HET_RA").otherwise("HET_AA"))
    )


def genotype_text(alleles: Column, phased: Column, texts: Column | None = None) -> Column:
    """Allele numbers, or bases where texts are given, joined by / or |; '.' for what isn't called."""
    shown = F.transform(alleles, lambda x: F.when(x.isNull() | (x < 0), F.lit(".")).otherwise(F.get(texts, x) if texts is not None else x.cast("string")))
    return F.when(phased, F.array_join(shown, "|")).otherwise(F.array_join(shown, "/"))


def genotype_index(i: Column, j: Column) -> Column:
    """The place of genotype i/j (i <= j) among all of a site."""
    return (j * (j + 1) / 2 + i).cast("int")


def called_alt(alleles: Column) -> Column:
    return F.exists(alleles, lambda x: x > 0)


def covered(alleles: Column) -> Column:
    return F.exists(alleles, lambda x: x >= 0)
