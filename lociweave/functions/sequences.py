"""Scalar functions on alleles, regions and annotatables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complement(seq: Column) -> Column:
    """A-T and C-G swapped in upper case; anything else N."""
    up = F.regexp_replace(F.upper(seq), "[^ACGTN]", "N")
    return F.translate(up, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading characters that two texts share."""
    # The longest group that the second line begins with too.
    return F.length(F.regexp_extract(F.concat(a, F.lit("\n"), b), r"^(.*).*\n\1", 1))


def trim_left(pos: Column, ref: Column, alt: Column) -> Column:
    """struct(pos, ref, alt) without the shared start."""
    k = common_prefix(ref, alt)
    return F.struct((pos + k).alias("pos"), F.substring(ref, k + 1, F.length(ref)).alias("ref"), F.substring(alt, k + 1, F.length(alt)).alias("alt"))


def trim_right(pos: Column, ref: Column, alt: Column) -> Column:
    """struct(pos, ref, alt) without the shared end."""
    k = common_prefix(F.reverse(ref), F.reverse(alt))
    return F.struct(pos.alias("pos"), F.substring(ref, F.lit(1), F.length(ref) - k).alias("ref"), F.substring(alt, F.lit(1), F.length(alt) - k).alias("alt"))


def trim_both(pos: Column, ref: Column, alt: Column, left_first: bool = True) -> Column:
    first, second = (trim_left, trim_right) if left_first else (trim_right, trim_left)
    t = first(pos, ref, alt)
    return second(t["pos"], t["ref"], t["alt"])


def trim_parsimonious(pos: Column, ref: Column, alt: Column) -> Column:
    """Shared end, then shared start, but at least one base of each is left."""
    k = F.least(common_prefix(F.reverse(ref), F.reverse(alt)), F.least(F.length(ref), F.length(alt)) - 1)
    k = F.greatest(k, F.lit(0))
    r = F.substring(ref, F.lit(1), F.length(ref) - k)
    a = F.substring(alt, F.lit(1), F.length(alt) - k)
    j = F.greatest(F.least(common_prefix(r, a), F.least(F.length(r), F.length(a)) - 1), F.lit(0))
    return F.struct((pos + j).alias("pos"), F.substring(r, j + 1, F.length(r)).alias("ref"), F.substring(a, j + 1, F.length(a)).alias("alt"))


# Names under which copy number gains and losses are given.
_GAIN = ("cnv+", "duplication", "large_insertion", "gain", "large_duplication")
_LOSS = ("cnv-", "deletion", "large_deletion", "loss")


def cnv_type(name: Column) -> Column:
    """LARGE_DUPLICATION or LARGE_DELETION, or null for another name."""
    n = F.lower(F.trim(name))
    return F.when(n.isin(*_GAIN), "LARGE_DUPLICATION").when(n.isin(*_LOSS), "LARGE_DELETION")


def parse_region(text: Column) -> Column:
    """``chr``, ``chr:10`` or ``chr:1,000-2,000`` -> struct(chrom, start, stop);
    a missing end is open (null)."""
    rx = r"^([^:]+)(?::([\d,]+)(?:-([\d,]+))?)?$"

    def number(k: int) -> Column:
        return F.nullif(F.replace(F.regexp_extract(text, rx, k), F.lit(","), F.lit("")), F.lit("")).cast("bigint")

    return F.when(text.rlike(rx), F.struct(F.regexp_extract(text, rx, 1).alias("chrom"), number(2).alias("start"), F.when(text.contains(":"), F.coalesce(number(3), number(2))).alias("stop")))


# --- annotatables -----------------------------------------------------------

ANNOTATABLE = "struct<type:string,chrom:string,pos:bigint,pos_end:bigint,ref:string,alt:string>"


def _annotatable(kind: Column, chrom: Column, pos: Column, end: Column, ref: Column | None = None, alt: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(kind.alias("type"), chrom.alias("chrom"), pos.cast("bigint").alias("pos"), end.cast("bigint").alias("pos_end"), (none if ref is None else ref).alias("ref"), (none if alt is None else alt).alias("alt"))


def position(chrom: Column, pos: Column) -> Column:
    return _annotatable(F.lit("POSITION"), chrom, pos, pos)


def region(chrom: Column, start: Column, stop: Column) -> Column:
    return _annotatable(F.lit("REGION"), chrom, start, stop)


def allele(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """A small variant. An insertion spans its base and the next; a deletion or
    complex change reaches one base beyond its reference allele."""
    nr, na = F.length(ref), F.length(alt)
    kind = (
        F.when((nr == 1) & (na == 1), "SUBSTITUTION")
        .when((nr == 1) & (na > 1) & F.startswith(alt, ref), "SMALL_INSERTION")
        .when((nr > 1) & (na == 1) & F.startswith(ref, alt), "SMALL_DELETION")
        .otherwise("COMPLEX")
    )
    end = F.when((nr == 1) & (na == 1), pos).when((nr == 1) & (na > 1) & F.startswith(alt, ref), pos + 1).otherwise(pos + nr)
    return _annotatable(kind, chrom, pos, end, ref, alt)


def cnv(chrom: Column, start: Column, stop: Column, kind: Column) -> Column:
    return _annotatable(cnv_type(kind), chrom, start, stop)


def parse_annotatable(text: Column) -> Column:
    """``TYPE(arg,...)`` -> annotatable, null if it has another form."""
    name = F.upper(F.regexp_extract(text, r"^\s*([A-Za-z_]+)\(", 1))
    args = F.split(F.regexp_extract(text, r"\(([^)]*)\)", 1), r"\s*,\s*")
    chrom, two, three, four = F.trim(F.get(args, F.lit(0))), F.get(args, F.lit(1)), F.get(args, F.lit(2)), F.trim(F.get(args, F.lit(3)))
    number = two.try_cast("bigint")
    return (
        F.when(name == "POSITION", position(chrom, number))
        .when(name == "REGION", region(chrom, number, three.try_cast("bigint")))
        .when(name.isin("LARGE_DUPLICATION", "LARGE_DELETION"), cnv(chrom, number, three.try_cast("bigint"), name))
        .when(name.isin("VCFALLELE", "SUBSTITUTION", "SMALL_INSERTION", "SMALL_DELETION", "COMPLEX"), allele(chrom, number, F.trim(three), four))
    )


#: Column layouts of input rows, in the order in which they are tried.
LAYOUTS = (
    ("cnv", ("chrom", "pos_beg", "pos_end", "cnv_type")),
    ("region", ("chrom", "pos_beg", "pos_end")),
    ("allele", ("chrom", "pos", "ref", "alt")),
    ("vcf_like", ("vcf_like",)),
    ("dae", ("chrom", "pos", "variant")),
    ("location", ("location", "variant")),
    ("position", ("chrom", "pos")),
)


def choose_layout(columns: dict[str, str]) -> tuple[str, tuple[str, ...]]:
    """``columns``: role -> column of the input; "-" rules a role out."""
    have = {k for k, v in columns.items() if v != "-"}
    for name, roles in LAYOUTS:
        if have.issuperset(roles):
            return name, roles
    raise ValueError(f"no layout fits the columns {sorted(have)}")


def from_row(columns: dict[str, str]) -> Column:
    """The annotatable of an input row, its layout chosen from what is there.
    Layouts that need the genome (``dae`` and ``location`` with ins/del) give
    substitutions only here; ``operators.sequence.resolve_variants`` does the rest."""
    name, roles = choose_layout(columns)
    c = [F.col(columns[r]) for r in roles]
    if name == "cnv":
        return cnv(c[0], c[1], c[2], c[3])
    if name == "region":
        return region(c[0], c[1], c[2])
    if name == "allele":
        return allele(c[0], c[1], c[2], c[3])
    if name == "vcf_like":
        p = F.split(c[0], ":")
        return allele(p[0], p[1].cast("bigint"), p[2], p[3])
    if name == "position":
        return position(c[0], c[1])
    if name == "dae":
        chrom, pos, variant = c
    else:
        chrom, pos, variant = F.split(c[0], ":")[0], F.split(c[0], ":")[1].cast("bigint"), c[1]
    sub = parse_variant(variant)
    return F.when(sub["kind"] == "sub", allele(chrom, pos, sub["ref"], sub["alt"]))


def parse_variant(text: Column) -> Column:
    """``sub(A->C)``, ``ins(ACG)``, ``del(3)``, ``complex(AC->G)`` ->
    struct(kind, ref, alt, length); null parts where a form has none."""
    pair, one = r"^(sub|complex|comp)\(([ACGTNacgtn]+)->([ACGTNacgtn]+)\)$", r"^(ins)\(([ACGTNacgtn]+)\)$"
    gone = r"^(del)\((\d+)\)$"

    def ex(rx: str, k: int) -> Column:
        return F.nullif(F.regexp_extract(text, rx, k), F.lit(""))

    kind = F.coalesce(F.when(ex(pair, 1) == "comp", "complex").otherwise(ex(pair, 1)), ex(one, 1), ex(gone, 1))
    return F.struct(kind.alias("kind"), ex(pair, 2).alias("ref"), F.coalesce(ex(pair, 3), ex(one, 2)).alias("alt"), ex(gone, 2).cast("bigint").alias("length"))
