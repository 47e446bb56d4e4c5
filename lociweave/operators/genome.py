"""Reference sequences as chunk tables, and operators that read bases.

A genome is (chrom, chunk, seq): chunks of fixed size. Reading bases is an
equi-join on (chrom, chunk); an allele only needs the chunk of its position and
its neighbours, so an annotated table meets at most a few chunks a row, and no
genome is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..shared import kept
from .overlap import overlap_join

CHUNK = 1 << 16


def from_sequences(spark: SparkSession, seqs: dict[str, str], chunk: int = CHUNK) -> DataFrame:
    rows = [(c, k, s[k * chunk : (k + 1) * chunk]) for c, s in seqs.items() for k in range(-(-len(s) // chunk))]
    return spark.createDataFrame(rows, "chrom string, chunk bigint, seq string")


_LINE = "part int, nth int, chrom string, at bigint, s string"


def _fasta_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of a task's part of the file: which of its headers they follow (0:
    none, the contig began in an earlier part), and the bases since."""
    from pyspark import TaskContext

    part, nth, at = TaskContext.get().partitionId(), 0, 0
    for pdf in batches:
        rows = []
        for text in pdf["value"]:
            if text.startswith(">"):
                nth, at = nth + 1, 0
                rows.append((part, nth, (text[1:].split() or [""])[0], 0, ""))
            elif text := text.strip():
                rows.append((part, nth, None, at, text))
                at += len(text)
        yield pd.DataFrame(rows, columns=["part", "nth", "chrom", "at", "s"])


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """Contigs begin at ``>``. Each task counts bases over its own part of the
    file; the parts and contigs (one row each) are put in order and tell where
    every line lies in its contig. Runs."""
    lines = kept(spark.read.text(path).mapInPandas(_fasta_lines, _LINE), "fasta")
    runs = lines.groupBy("part", "nth").agg(F.max("chrom").alias("chrom"), F.sum(F.length("s")).alias("n"))
    order = Window.partitionBy(F.lit(1)).orderBy("part", "nth")
    runs = runs.withColumn("contig", F.sum(F.when(F.col("chrom").isNotNull(), 1).otherwise(0)).over(order))
    runs = runs.withColumn("chrom", F.max("chrom").over(Window.partitionBy("contig")))
    before = Window.partitionBy("contig").orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("chrom", F.col("part").alias("p"), F.col("nth").alias("k"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    placed = lines.where("s <> ''").drop("chrom").join(runs, (F.col("part") == F.col("p")) & (F.col("nth") == F.col("k"))).withColumn("at", F.col("begin") + F.col("at"))
    first, last = F.floor(F.col("at") / chunk), F.floor((F.col("at") + F.length("s") - 1) / chunk)
    cut = placed.withColumn("chunk", F.explode(F.sequence(first, last))).select(
        "chrom", "chunk", F.greatest(F.col("at"), F.col("chunk") * chunk).alias("b"), F.substring("s", F.greatest(F.col("chunk") * chunk - F.col("at"), F.lit(0)).cast("int") + 1, F.least((F.col("chunk") + 1) * chunk - F.greatest(F.col("at"), F.col("chunk") * chunk), F.length("s")).cast("int")).alias("part")
    )
    return cut.groupBy("chrom", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "part"))), lambda x: x["part"]), "").alias("seq"))


def contig_lengths(genome: DataFrame) -> DataFrame:
    return genome.groupBy("chrom").agg(F.sum(F.length("seq")).cast("bigint").alias("length"))


def split_genome(genome: DataFrame, size: int) -> DataFrame:
    from .regions import split

    return split(contig_lengths(genome), size)


def bases(df: DataFrame, genome: DataFrame, chrom: str, begin: str, end: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds the bases of [begin, end], cut to the contig; an unknown contig, or a
    span outside it, gives "". Each distinct span is read once."""
    b = F.greatest(F.col(begin).cast("bigint"), F.lit(1).cast("bigint"))
    place = F.struct(F.col(chrom).alias("c"), b.alias("b"), F.col(end).cast("bigint").alias("e"))
    one = df.select(place.alias("__id")).distinct().select("__id", F.col("__id.c").alias("__c"), F.col("__id.b").alias("__b"), F.col("__id.e").alias("__e")).where("__e >= __b")
    one = one.withColumn("__k", F.explode(F.sequence(F.floor((F.col("__b") - 1) / chunk), F.floor((F.col("__e") - 1) / chunk))))
    hit = one.join(genome, (F.col("__c") == F.col("chrom")) & (F.col("__k") == F.col("chunk")))
    lo = F.greatest(F.col("__b") - 1 - F.col("__k") * chunk, F.lit(0)).cast("int")
    hi = F.least(F.col("__e") - F.col("__k") * chunk, F.lit(chunk)).cast("int")
    part = F.substring("seq", lo + 1, hi - lo)
    told = hit.groupBy("__id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", part.alias("p")))), lambda x: x["p"]), "").alias(name))
    return df.join(told, place == F.col("__id"), "left").drop("__id").withColumn(name, F.coalesce(name, F.lit("")))


def _pieces(genome: DataFrame, piece: int, chunk: int) -> DataFrame:
    """The genome in pieces of a chunk, so that a row that needs a few bases does
    not carry a chunk through a join."""
    if piece == chunk:
        return genome
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.length("seq") / piece) - 1))
    one = genome.where("seq <> ''").select("chrom", "chunk", "seq", k.alias("__k"))
    return one.select("chrom", (F.col("chunk") * (chunk // piece) + F.col("__k")).alias("chunk"), F.substring("seq", (F.col("__k") * piece + 1).cast("int"), F.lit(piece)).alias("seq"))


_PIECE = 1 << 12


def near_bases(df: DataFrame, genome: DataFrame, chrom: str, begin: str, end: str, name: str, piece: int = _PIECE, chunk: int = CHUNK) -> DataFrame:
    """``bases`` for spans of at most a piece: they lie in one piece or two
    neighbours, so two joins bring them to the row and nothing is regrouped."""
    b, e = F.when(F.col(begin).isNotNull(), F.greatest(F.col(begin).cast("bigint"), F.lit(1).cast("bigint"))), F.col(end).cast("bigint")
    # Rows without a span get keys that nothing has, spread over tasks.
    apart = -1 - F.pmod(F.xxhash64(*[F.col(c) for c, t in df.dtypes if "map<" not in t]), F.lit(1 << 20))
    g0 = _pieces(genome, piece, chunk)
    out = df.withColumns({"__k0": F.coalesce(F.floor((b - 1) / piece), apart), "__k1": F.coalesce(F.floor((e - 1) / piece), apart)})
    for k in (0, 1):
        g = g0.select(F.col("chrom").alias(f"__gc{k}"), F.col("chunk").alias(f"__gk{k}"), F.col("seq").alias(f"__gs{k}"))
        on = (F.col(chrom) == F.col(f"__gc{k}")) & (F.col(f"__k{k}") == F.col(f"__gk{k}"))
        out = out.join(g, on & (F.col("__k1") == F.col("__k0") + 1) if k else on, "left")
    both = F.concat(F.coalesce("__gs0", F.lit("")), F.coalesce("__gs1", F.lit("")))
    # Where the first piece is not there, neither is what follows.
    seq = F.substring(both, (b - F.col("__k0") * piece).cast("int"), (e - b + 1).cast("int"))
    told = F.when(F.col("__gs0").isNotNull() & (e >= b), seq).otherwise(F.lit(""))
    return out.withColumn(name, told).drop("__k0", "__k1", "__gc0", "__gk0", "__gs0", "__gc1", "__gk1", "__gs1")


def resolve_variants(df: DataFrame, genome: DataFrame, chrom: Column, pos: Column, variant: Column, name: str = "ann") -> DataFrame:
    """Alleles of ``sub/ins/del/complex`` variants: an insertion or deletion
    takes the base before it from the genome."""
    p = S.parse_variant(variant)
    one = df.withColumns({"__vc": chrom, "__vp": pos.cast("bigint"), "__v": p})
    one = one.withColumns({"__fb": F.when(F.col("__v.kind").isin("ins", "del"), F.col("__vp") - 1).otherwise(F.col("__vp")), "__fe": F.when(F.col("__v.kind") == "del", F.col("__vp") + F.col("__v.length") - 1).when(F.col("__v.kind") == "ins", F.col("__vp") - 1).otherwise(F.col("__vp") - 1)})
    one = bases(one, genome, "__vc", "__fb", "__fe", "__s")
    k = F.col("__v.kind")
    out = (
        F.when(k.isin("sub", "complex"), S.allele(F.col("__vc"), F.col("__vp"), F.col("__v.ref"), F.col("__v.alt")))
        .when((k == "ins") & (F.col("__s") != ""), S.allele(F.col("__vc"), F.col("__fb"), F.col("__s"), F.concat("__s", F.col("__v.alt"))))
        .when((k == "del") & (F.length("__s") == F.col("__v.length") + 1), S.allele(F.col("__vc"), F.col("__fb"), F.col("__s"), F.substring("__s", 1, 1)))
    )
    return one.withColumn(name, out).drop("__vc", "__vp", "__v", "__fb", "__fe", "__s")


def normalise(pos: int, ref: str, alt: str, base) -> tuple[int, str, str]:
    """Left-aligned, parsimonious allele. ``base``: pos -> base, None beyond the
    contig; it may raise ``Beyond``. An allele off the contig stays as it is."""
    given = pos, ref, alt
    while True:
        moved = False
        if ref and alt and ref[-1] == alt[-1]:
            ref, alt, moved = ref[:-1], alt[:-1], True
        if (not ref or not alt) and pos > 1:
            b = base(pos - 1)
            if b is None:
                return given
            pos, ref, alt, moved = pos - 1, b + ref, b + alt, True
        if not moved:
            break
    while len(ref) >= 2 and len(alt) >= 2 and ref[0] == alt[0]:
        pos, ref, alt = pos + 1, ref[1:], alt[1:]
    return pos, ref, alt


class Beyond(Exception):
    """A walk came to the end of the bases that are known."""


def extend(pos: int, ref: str, alt: str, base) -> tuple[int, str, str]:
    """The allele with every base to its right and left over which it could
    slide, and one anchor base on either side where there is one. ``base``: pos
    -> base, None beyond the contig; it may raise ``Beyond``."""
    while ref and alt and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    while ref and alt and ref[0] == alt[0]:
        pos, ref, alt = pos + 1, ref[1:], alt[1:]
    if not ref or not alt:
        moving = ref or alt
        n, end = len(moving), pos + len(ref)
        # A base joins while it equals the one that a whole copy of what moves is away.
        left: list[str] = []
        while (b := base(pos - len(left) - 1)) is not None and b == (moving[-1 - len(left)] if len(left) < n else left[len(left) - n]):
            left.append(b)
        right: list[str] = []
        while (b := base(end + len(right))) is not None and b == (moving[len(right)] if len(right) < n else right[len(right) - n]):
            right.append(b)
        before, after = "".join(reversed(left)), "".join(right)
        pos, ref, alt = pos - len(left), before + ref + after, before + alt + after
    before, after = base(pos - 1), base(pos + len(ref))
    if before is not None:
        pos, ref, alt = pos - 1, before + ref, before + alt
    if after is not None:
        ref, alt = ref + after, alt + after
    return pos, ref, alt


#: Bases read on either side of an allele; what needs more reads more. In the
#: last step whole chunks are put together, and a walk of over 64 million bases,
#: in a genome of contigs that long, fails rather than stop short.
_MARGINS = (1000, 24_000, 1 << 26)


def _with_stretch(df: DataFrame, genome: DataFrame, ann: str, margin: int) -> DataFrame:
    """Adds __sb, __se and __stretch: the bases around an allele."""
    a = F.col(ann)
    begin = F.greatest(a["pos"] - margin, F.lit(1).cast("bigint"))
    one = df.withColumns({"__c": a["chrom"], "__sb": begin, "__se": a["pos"] + F.length(a["ref"]) + margin})
    for piece in (_PIECE, CHUNK):
        if 2 * margin + 200 <= piece:
            # A longer allele is read to the end of what fits; its walk then asks for more.
            one = one.withColumn("__se", F.least("__se", F.col("__sb") + piece - 1))
            return near_bases(one, genome, "__c", "__sb", "__se", "__stretch", piece).drop("__c")
    return bases(one, genome, "__c", "__sb", "__se", "__stretch").drop("__c")


class Stretch:
    """Bases around a place, from what was joined to the row: begin to end were
    asked for, so a base between them that is not there is beyond the contig."""

    def __init__(self, begin: int, end: int, seq: str):
        self.begin, self.end, self.seq = begin, end, seq

    def base(self, pos: int) -> str | None:
        i = pos - self.begin
        if 0 <= i < len(self.seq):
            return self.seq[i]
        if pos < 1 or self.begin <= pos <= self.end or pos > self.end and len(self.seq) < self.end - self.begin + 1:
            return None
        raise Beyond


_WALKED = "struct<pos:bigint,ref:string,alt:string,more:boolean>"


def _walker(step):
    """``step(pos, ref, alt, base)`` over rows; ``more`` where a stretch was too short."""

    def run(pos: pd.Series, ref: pd.Series, alt: pd.Series, begin: pd.Series, end: pd.Series, seq: pd.Series) -> pd.DataFrame:
        out = []
        for p, r, a, b, e, s in zip(pos, ref, alt, begin, end, seq, strict=True):
            if r is None or a is None or b is None or pd.isna(b):
                out.append((None, None, None, False))
                continue
            if not s:  # a contig that the genome does not have
                out.append((int(p), r, a, False))
                continue
            try:
                out.append((*step(int(p), r, a, Stretch(int(b), int(e), s.upper()).base), False))
            except Beyond:
                out.append((None, None, None, True))
        return pd.DataFrame(out, columns=["pos", "ref", "alt", "more"]).astype({"pos": "Int64", "more": bool})

    return F.pandas_udf(run, _WALKED)


def _walked(alleles: DataFrame, genome: DataFrame, step) -> DataFrame:
    """(__p, __w): what ``step`` makes of the distinct alleles ``__p``. Runs: the
    few that need more bases than a stretch has are taken aside and read more,
    and all is a table in the end, so that what builds on it builds on no plan."""
    walk, done = _walker(step), None
    for margin in _MARGINS:
        d = _with_stretch(alleles, genome, "__p", margin)
        told = kept(d.select("__p", walk("__p.pos", "__p.ref", "__p.alt", "__sb", "__se", "__stretch").alias("__w")), "alleles")
        ready = told.where("not __w.more").select("__p", F.struct("__w.pos", "__w.ref", "__w.alt").alias("__w"))
        done = ready if done is None else done.unionByName(ready)
        alleles = told.where("__w.more").select("__p")
        if alleles.isEmpty():
            return done
    raise ValueError("an allele slides over more bases than can be read")


def _sliding(df: DataFrame, ann: str) -> DataFrame:
    """The distinct alleles ``__p`` of a column that can be written in more than one way."""
    p = F.col("__p")
    return df.select(F.col(ann).alias("__p")).where(p["ref"].isNotNull() & p["alt"].isNotNull() & ((F.length(p["ref"]) > 1) | (F.length(p["alt"]) > 1))).distinct()


def annotate_normalised(df: DataFrame, genome: DataFrame, name: str = "normalized", ann: str = "ann") -> DataFrame:
    """Adds the normalised allele as an annotatable; annotatables that are not
    alleles, substitutions, and alleles on a contig that the genome does not have
    stay as they are; the first two read no bases. One row per row: each distinct
    allele is worked on once, when this is called (it runs jobs), and joined back."""
    told = _walked(_sliding(df, ann), genome, normalise)
    w = F.col("__w")
    moved = F.when(w["pos"].isNotNull(), S.allele(F.col(f"{ann}.chrom"), w["pos"], w["ref"], w["alt"])).otherwise(F.col(ann))
    return df.join(told, F.col(ann) == F.col("__p"), "left").withColumn(name, moved).drop("__p", "__w")


# --- liftover ----------------------------------------------------------------


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a chain file: (src_chrom, src_begin, src_end, dst_chrom,
    dst_begin, dst_size, strand, score, chain_id); 0-based, half-open; dst_begin
    counts on the target's own strand."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                lines = text.split("\n")
                h = lines[0].split()
                score, src, s_at, dst, size, strand, d_at, chain = float(h[1]), h[2], int(h[5]), h[7], int(h[8]), h[9], int(h[10]), h[12] if len(h) > 12 else ""
                for line in lines[1:]:
                    p = line.split()
                    if not p:
                        continue
                    n = int(p[0])
                    rows.append((src, s_at, s_at + n, dst, d_at, size, strand, score, chain))
                    if len(p) > 1:
                        s_at, d_at = s_at + n + int(p[1]), d_at + n + int(p[2])
            yield pd.DataFrame(rows, columns=["src_chrom", "src_begin", "src_end", "dst_chrom", "dst_begin", "dst_size", "strand", "score", "chain_id"])

    # A chain is a paragraph: the separator makes it one row.
    text = spark.read.option("lineSep", "\n\n").text(path).select(F.regexp_replace("value", r"(?m)^#.*\n?", "").alias("value")).select(F.trim(F.regexp_replace("value", r"^\n+", "")).alias("value")).where("value like 'chain%'")
    return text.mapInPandas(blocks, "src_chrom string, src_begin bigint, src_end bigint, dst_chrom string, dst_begin bigint, dst_size bigint, strand string, score double, chain_id string")


def lift_positions(df: DataFrame, blocks: DataFrame, chrom: str, pos: str, name: str = "lifted") -> DataFrame:
    """Adds struct(chrom, pos, strand): the place in the best chain's block that
    holds the 1-based position, or null. One row per row; each distinct position
    is looked up once."""
    one = df.select(F.col(chrom).alias("__c"), F.col(pos).cast("bigint").alias("__p")).where("__c is not null and __p is not null").distinct()
    b = blocks.select("src_chrom", (F.col("src_begin") + 1).alias("__sb"), F.col("src_end").alias("__se"), "dst_chrom", "dst_begin", "dst_size", "strand", "score", "chain_id")
    hit = overlap_join(one.withColumn("__q", F.col("__p")), b, ("__c", "__p", "__q"), ("src_chrom", "__sb", "__se"))
    at = F.col("dst_begin") + F.col("__p") - F.col("__sb")
    there = F.when(F.col("strand") == "+", at + 1).otherwise(F.col("dst_size") - at)
    best = F.max_by(F.struct(F.col("dst_chrom").alias("chrom"), there.alias("pos"), "strand"), F.struct("score", "chain_id"))
    told = hit.groupBy("__c", "__p").agg(best.alias(name))
    return df.join(told, (F.col(chrom) == F.col("__c")) & (F.col(pos).cast("bigint") == F.col("__p")), "left").drop("__c", "__p")


def lift_regions(df: DataFrame, blocks: DataFrame, name: str = "lifted", ann: str = "ann") -> DataFrame:
    """Regions and copy number variants: both ends must land on one contig."""
    one = df.withColumns({"__lc": F.col(f"{ann}.chrom"), "__a": F.col(f"{ann}.pos"), "__b": F.col(f"{ann}.pos_end")})
    one = lift_positions(lift_positions(one, blocks, "__lc", "__a", "__la"), blocks, "__lc", "__b", "__lb")
    a, b = F.col("__la"), F.col("__lb")
    lifted = F.struct(F.col(f"{ann}.type").alias("type"), a["chrom"].alias("chrom"), F.least(a["pos"], b["pos"]).alias("pos"), F.greatest(a["pos"], b["pos"]).alias("pos_end"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("alt"))
    return one.withColumn(name, F.when(a["chrom"] == b["chrom"], lifted)).drop("__lc", "__a", "__b", "__la", "__lb")


def lift_alleles(df: DataFrame, blocks: DataFrame, source: DataFrame, target: DataFrame, name: str = "lifted", ann: str = "ann", mode: str = "bcf") -> DataFrame:
    """Small variants, normalised in the source and again in the target genome.

    ``bcf``: a substitution maps its base, which in the target must be the ref
    or the alt (then they swap); others map both anchors of the allele with all
    it could slide over, to one contig and strand and at most ten times the
    length, and the target's bases must be the ref or the alt. ``basic``: the
    first base is mapped and the target's bases are taken for the ref.
    A null annotatable stands for what cannot be lifted. One row per row: each
    distinct allele is lifted once, when this is called (it runs jobs).
    """
    own = df.select(F.col(ann).alias("__own")).where(F.col("__own.ref").isNotNull() & F.col("__own.alt").isNotNull()).distinct()
    n = F.col("__n")
    wide = annotate_normalised(own, source, "__n", "__own")
    plain = F.struct(n["pos"].alias("pos"), n["ref"].alias("ref"), n["alt"].alias("alt"))
    if mode == "basic":
        wide = wide.withColumn("__w", plain)
    else:
        told = _walked(_sliding(wide, "__n"), source, extend)
        wide = wide.join(told, n == F.col("__p"), "left").withColumn("__w", F.coalesce("__w", plain)).drop("__p")
    wide = kept(wide.select("__own", F.col("__own.chrom").alias("__lc"), "__w", F.col("__w.pos").alias("__a"), (F.col("__w.pos") + F.length("__w.ref") - 1).alias("__b")), "widened")
    both = kept(lift_positions(lift_positions(wide, blocks, "__lc", "__a", "__la"), blocks, "__lc", "__b", "__lb"), "lifted")
    a, b, size = F.col("__la"), F.col("__lb"), F.length("__w.ref")
    lo = F.least(a["pos"], b["pos"])
    hi = F.greatest(a["pos"], b["pos"])
    ok = (a["chrom"] == b["chrom"]) & (a["strand"] == b["strand"]) & (hi - lo + 1 <= 10 * size) if mode == "bcf" else a.isNotNull()
    if mode == "basic":
        lo = F.when(a["strand"] == "-", a["pos"] - size + 1).otherwise(a["pos"])
        hi = lo + size - 1
    placed = both.withColumns({"__tc": F.when(ok, a["chrom"]), "__tb": F.when(ok, lo), "__te": F.when(ok, hi), "__flip": a["strand"] == "-"})
    placed = bases(placed, target, "__tc", "__tb", "__te", "__seq")
    turn = lambda c: F.when(F.col("__flip"), S.reverse_complement(c)).otherwise(c)
    ref, alt, seq = turn(F.col("__w.ref")), turn(F.col("__w.alt")), F.upper("__seq")
    at = F.when(seq == "", F.lit(None))
    if mode == "bcf":
        made = at.when(seq == ref, S.allele(F.col("__tc"), F.col("__tb"), ref, alt)).when(seq == alt, S.allele(F.col("__tc"), F.col("__tb"), alt, ref))
    else:
        made = at.when(seq != alt, S.allele(F.col("__tc"), F.col("__tb"), seq, alt))
    lifted = kept(placed.select("__own", made.alias("__made")), "placed")
    told = annotate_normalised(lifted, target, "__x", "__made").select("__own", F.col("__x").alias(name))
    return df.join(told, F.col(ann) == F.col("__own"), "left").drop("__own")


def map_chroms(df: DataFrame, mapping: dict[str, str] | DataFrame | None = None, add_prefix: str = "", del_prefix: str = "", ann: str = "ann", name: str = "mapped") -> DataFrame:
    """Adds the annotatable with its chrom renamed; null where a table does not
    know the chrom. A prefix is taken off as a whole, never character by character."""
    a = F.col(ann)
    if mapping is None:
        c = a["chrom"]
        if del_prefix:
            c = F.when(F.startswith(c, F.lit(del_prefix)), F.substring(c, len(del_prefix) + 1, 1 << 30)).otherwise(c)
        new = F.concat(F.lit(add_prefix), c)
        return df.withColumn(name, a.withField("chrom", new))
    if isinstance(mapping, DataFrame):
        m = mapping.select(F.col(mapping.columns[0]).alias("__from"), F.col(mapping.columns[1]).alias("__to"))
        return df.join(m, a["chrom"] == F.col("__from"), "left").withColumn(name, F.when(F.col("__to").isNotNull(), a.withField("chrom", F.col("__to")))).drop("__from", "__to")
    new = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[a["chrom"]] if mapping else F.lit(None).cast("string")
    return df.withColumn(name, F.when(new.isNotNull(), a.withField("chrom", new)))
