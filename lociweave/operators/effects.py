"""Effects of variants on transcripts.

Candidates come from one overlap join of variants with transcripts, widened by
the promoter length; the coding sequence of each candidate transcript is built
once per transcript from the genome chunks, not per variant. Variants are
brought to their transcript, a function names the effect of each, and a grouping
puts a variant's effects in order.
"""

from __future__ import annotations

from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import spans
from .genes import effect_in, genes_with_effect
from .genome import CHUNK
from .overlap import overlap_join
from .transcripts import INTERGENIC, cds_regions

LIMIT = 15_000_000

# The effects and their severity, the larger the worse.
SEVERITY = {
    "CNV+": 35, "CNV-": 35, "tRNA:ANTICODON": 30, "all": 24, "splice-site": 23, "frame-shift": 22, "nonsense": 21, "no-frame-shift-newStop": 20,
    "noStart": 19, "noEnd": 18, "missense": 17, "no-frame-shift": 16, "CDS": 15, "synonymous": 14, "coding_unknown": 13, "regulatory": 12,
    "3'UTR": 11, "5'UTR": 10, "intron": 9, "non-coding": 8, "5'UTR-intron": 7, "3'UTR-intron": 6, "promoter": 5, "non-coding-intron": 4,
    "unknown": 3, "intergenic": 2, "no-mutation": 1,
}
# Names for groups of effects.
GROUPS = {
    "coding": ["nonsense", "frame-shift", "splice-site", "no-frame-shift-newStop", "missense", "no-frame-shift", "noStart", "noEnd", "synonymous"],
    "noncoding": ["non coding", "intron", "intergenic", "3'UTR", "5'UTR"],
    "CNV": ["CNV+", "CNV-"],
    "LGDs": ["frame-shift", "nonsense", "splice-site", "no-frame-shift-newStop"],
    "nonsynonymous": ["nonsense", "frame-shift", "splice-site", "no-frame-shift-newStop", "missense", "no-frame-shift", "noStart", "noEnd"],
    "UTRs": ["3'UTR", "5'UTR", "3'UTR-intron", "5'UTR-intron"],
}
# The standard genetic code.
CODONS = {
    "TTT": "Phe", "TTC": "Phe", "TTA": "Leu", "TTG": "Leu", "TCT": "Ser", "TCC": "Ser", "TCA": "Ser", "TCG": "Ser",
    "TAT": "Tyr", "TAC": "Tyr", "TAA": "End", "TAG": "End", "TGT": "Cys", "TGC": "Cys", "TGA": "End", "TGG": "Trp",
    "CTT": "Leu", "CTC": "Leu", "CTA": "Leu", "CTG": "Leu", "CCT": "Pro", "CCC": "Pro", "CCA": "Pro", "CCG": "Pro",
    "CAT": "His", "CAC": "His", "CAA": "Gln", "CAG": "Gln", "CGT": "Arg", "CGC": "Arg", "CGA": "Arg", "CGG": "Arg",
    "ATT": "Ile", "ATC": "Ile", "ATA": "Ile", "ATG": "Met", "ACT": "Thr", "ACC": "Thr", "ACA": "Thr", "ACG": "Thr",
    "AAT": "Asn", "AAC": "Asn", "AAA": "Lys", "AAG": "Lys", "AGT": "Ser", "AGC": "Ser", "AGA": "Arg", "AGG": "Arg",
    "GTT": "Val", "GTC": "Val", "GTA": "Val", "GTG": "Val", "GCT": "Ala", "GCC": "Ala", "GCA": "Ala", "GCG": "Ala",
    "GAT": "Asp", "GAC": "Asp", "GAA": "Glu", "GAG": "Glu", "GGT": "Gly", "GGC": "Gly", "GGA": "Gly", "GGG": "Gly",
}
_PAIR = str.maketrans("ACGTN", "TGCAN")

EFFECT = "struct<effect:string,gene:string,transcript_id:string,strand:string,prot_pos:int,prot_length:int,which_intron:int,how_many_introns:int,dist_from_coding:bigint,aa_change:string,severity:int>"


def amino_acids(seq: str, first: int = 0, end: int | None = None) -> list[str]:
    """Codons ``first`` to ``end`` of a reading; ``?`` for one that is not whole or known."""
    n = -(-len(seq) // 3)
    return [CODONS.get(seq[3 * k : 3 * k + 3], "?") for k in range(max(0, first), n if end is None else min(end, n))]


def _turned(s: str) -> str:
    return s.translate(_PAIR)[::-1]


class _Transcript:
    def __init__(self, strand, cds_begin, cds_end, tx_begin, tx_end, exons, coding):
        self.plus = strand != "-"
        self.cds = (cds_begin, cds_end)
        self.tx = (tx_begin, tx_end)
        self.exons = [(e["start"], e["stop"]) for e in exons]
        self.coding = coding  # bases of the coding regions in genome order
        self.codes = cds_begin < cds_end
        self.regions = [(max(a, cds_begin), min(b, cds_end)) for a, b in self.exons if max(a, cds_begin) <= min(b, cds_end)] if self.codes else []
        self.introns = [(a[1] + 1, b[0] - 1) for a, b in zip(self.exons, self.exons[1:], strict=False)]
        self.length = sum(b - a + 1 for a, b in self.regions)
        self.reading = self.read(coding)

    def offset(self, pos: int) -> int:
        """Coding bases before ``pos`` in genome order."""
        return sum(min(b, pos - 1) - a + 1 for a, b in self.regions if a < pos)

    def codon(self, first: bool) -> list[tuple[int, int]]:
        """Genome spans of the first or last codon in reading direction."""
        need, out = 3, []
        at_left = first == self.plus
        for a, b in self.regions if at_left else reversed(self.regions):
            n = min(need, b - a + 1)
            out.append((a, a + n - 1) if at_left else (b - n + 1, b))
            need -= n
            if not need:
                break
        return out

    def read(self, seq: str) -> str:
        return seq if self.plus else _turned(seq)


def _overlaps(spans, a: int, b: int) -> bool:
    return any(x <= b and y >= a for x, y in spans)


def effect_on(t: _Transcript, pos: int, ref: str, alt: str, promoter: int) -> dict | None:
    """The first effect that applies, in the order of the checks; None if none does."""
    shared = 0
    while shared < min(len(ref), len(alt)) and ref[shared] == alt[shared]:
        shared += 1
    pos, ref, alt = pos + shared, ref[shared:], alt[shared:]
    last = max(pos, pos + len(ref) - 1)
    introns = len(t.introns)
    out = {"how_many_introns": introns}
    if promoter:
        edge = t.exons[0][0] if t.plus else t.exons[-1][1]
        if t.plus and pos < edge and last >= edge - promoter or not t.plus and last > edge and pos <= edge + promoter:
            return {**out, "effect": "promoter", "dist_from_coding": edge - last if t.plus else pos - edge}
    if last < t.tx[0] or pos > t.tx[1]:
        return None
    if not t.codes:
        return {**out, "effect": "non-coding" if _overlaps(t.exons, pos, last) else "non-coding-intron"}
    inserted = not ref
    for k, (a, b) in enumerate(t.introns):
        # The two bases at either end of an intron; an insertion between exon and intron leaves them whole.
        for x, y in ((a, a + 1), (b - 1, b)):
            hit = pos <= y and last >= x if not inserted else x < pos <= y
            if hit and b > a:
                which = k + 1 if t.plus else introns - k
                return {**out, "effect": "splice-site", "which_intron": which}
    in_cds = _overlaps(t.regions, pos, last)
    before = t.coding
    if in_cds:
        # The coding sequence with the variant in it; bases outside of coding regions take no part.
        lo = t.offset(pos)
        gone = sum(1 for p in range(pos, pos + len(ref)) if any(a <= p <= b for a, b in t.regions))
        inside = any(a <= pos <= b for a, b in t.regions)
        new = alt if inside or gone == len(ref) else alt[len(alt) - gone :] if gone else ""
        after = before[:lo] + new + before[lo + gone :]
        old_p, new_p = t.reading, t.read(after)
        at = lo if t.plus else t.length - lo - gone
        prot = at // 3 + 1
        width = max(gone, len(new), 1)
        out |= {"prot_pos": prot, "prot_length": t.length // 3}
        # Only the codons that the variant touches are translated.
        a, b = prot - 1, (at + width - 1) // 3 + 1
        old_aa, new_aa = amino_acids(old_p, a, b), amino_acids(new_p, a, b)
        out["aa_change"] = f"{','.join(old_aa)}->{','.join(new_aa)}"
        if _overlaps(t.codon(True), pos, last) and (inserted is False or at < 3) and new_p[:3] != old_p[:3]:
            return {**out, "effect": "noStart"}
        if _overlaps(t.codon(False), pos, last):
            n = -(-len(old_p) // 3)
            stop = amino_acids(new_p, n - 1, n) == ["End"]
            stays = len(new_p) == len(old_p) and stop and amino_acids(old_p, n - 1, n) == ["End"]
            if not stays and not stop:
                return {**out, "effect": "noEnd"}
            if not stays:
                return {**out, "effect": "3'UTR"}
        change = len(new) - gone
        if change:
            if change % 3:
                return {**out, "effect": "frame-shift"}
            stop = "End" in amino_acids(new_p, a, a + len(new) // 3 + 1) and "End" not in old_aa
            return {**out, "effect": "no-frame-shift-newStop" if stop else "no-frame-shift"}
        if "End" in new_aa and "End" not in old_aa:
            return {**out, "effect": "nonsense"}
        if "?" in new_aa or "?" in old_aa:
            return {**out, "effect": "coding_unknown"}
        return {**out, "effect": "missense" if old_aa != new_aa else "synonymous"}
    if pos < t.cds[0] or last > t.cds[1]:
        left = last < t.cds[0]
        side = "5'UTR" if left == t.plus else "3'UTR"
        far = t.cds[0] - last if left else pos - t.cds[1]
        if _overlaps(t.exons, pos, last):
            return {**out, "effect": side, "dist_from_coding": far}
        which = next((k for k, (a, b) in enumerate(t.introns) if pos <= b and last >= a), None)
        return {**out, "effect": f"{side}-intron", "dist_from_coding": far, "which_intron": None if which is None else which + 1 if t.plus else introns - which}
    which = next((k for k, (a, b) in enumerate(t.introns) if pos <= b and last >= a), 0)
    a, b = t.introns[which] if t.introns else (pos, pos)
    return {**out, "effect": "intron", "which_intron": which + 1 if t.plus else introns - which, "dist_from_coding": min(pos - a, b - last) + 1}


def coding_sequences(transcripts: DataFrame, genome: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``transcripts`` with ``coding``: the bases of their coding regions, in
    genome order, one join with the chunks for all."""
    one = transcripts.select("tr_id", F.col("chrom").alias("__c"), F.posexplode(cds_regions()).alias("__n", "__r"))
    one = one.withColumn("__k", F.explode(F.sequence(F.floor((F.col("__r.start") - 1) / chunk), F.floor((F.col("__r.stop") - 1) / chunk))))
    hit = one.join(genome, (F.col("__c") == F.col("chrom")) & (F.col("__k") == F.col("chunk")))
    lo = F.greatest(F.col("__r.start") - 1 - F.col("__k") * chunk, F.lit(0)).cast("int")
    hi = F.least(F.col("__r.stop") - F.col("__k") * chunk, F.lit(chunk)).cast("int")
    seq = hit.groupBy("tr_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__k", F.substring("seq", lo + 1, hi - lo).alias("p")))), lambda x: x["p"]), "").alias("coding"))
    return transcripts.join(seq, "tr_id", "left").withColumn("coding", F.upper(F.coalesce("coding", F.lit(""))))


def _row(effect: Column, gene: Column | None = None, tr: Column | None = None, strand: Column | None = None) -> Column:
    s, i, b = (F.lit(None).cast(t) for t in ("string", "int", "bigint"))
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[effect]
    return F.struct(
        effect.alias("effect"), (s if gene is None else gene).alias("gene"), (s if tr is None else tr).alias("transcript_id"), (s if strand is None else strand).alias("strand"), i.alias("prot_pos"), i.alias("prot_length"),
        i.alias("which_intron"), i.alias("how_many_introns"), b.alias("dist_from_coding"), s.alias("aa_change"), severity.alias("severity"),
    )


_FIELDS = ("effect", "prot_pos", "prot_length", "which_intron", "how_many_introns", "dist_from_coding", "aa_change")
_CALLED = "struct<effect:string,prot_pos:int,prot_length:int,which_intron:int,how_many_introns:int,dist_from_coding:bigint,aa_change:string>"
_KINDS = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string())
_VARIANTS = 20_000  # of a transcript in one task's group


def _called(hits: DataFrame, transcripts: DataFrame, genome: DataFrame, promoter: int) -> DataFrame:
    """``hits`` (variant and tr_id) with ``__e``, what the variant does there.

    Variants come to their transcript, which is built once for all of a group;
    its sequence travels once a group, not with every variant. A transcript
    that very many variants hit is several groups.
    """
    groups = hits.groupBy("tr_id").agg(F.ceil(F.count("*") / _VARIANTS).cast("int").alias("__parts"))
    tx = coding_sequences(transcripts.join(groups, "tr_id"), genome).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    tx = tx.select(*[F.col(c).alias(f"m_{c}") for c in ("tr_id", "__part", "strand", "cds_begin", "cds_end", "tx_begin", "tx_end", "exons", "coding")])
    dealt = hits.join(groups, "tr_id").withColumn("__part", F.pmod(F.xxhash64("__pos", "__ref", "__alt"), F.col("__parts").cast("long")).cast("int")).drop("__parts")

    def run(variants: pa.Table, model: pa.Table) -> pa.Table:
        (m,) = model.to_pylist()
        t = _Transcript(m["m_strand"], m["m_cds_begin"], m["m_cds_end"], m["m_tx_begin"], m["m_tx_end"], m["m_exons"], m["m_coding"])
        cols: list[list] = [[] for _ in _FIELDS]
        for pos, ref, alt in zip(*(variants.column(c).to_pylist() for c in ("__pos", "__ref", "__alt")), strict=True):
            got = effect_on(t, pos, ref.upper(), alt.upper(), promoter) or {}
            for c, f in zip(cols, _FIELDS, strict=True):
                c.append(got.get(f))
        told = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=list(_FIELDS))
        return variants.drop_columns(["__part"]).append_column("__e", told)

    schema = hits.schema.simpleString().removeprefix("struct<").removesuffix(">")
    return dealt.groupBy("tr_id", "__part").cogroup(tx.groupBy("m_tr_id", "m___part")).applyInArrow(run, f"{schema},__e:{_CALLED}").select(*hits.columns, "__e")


def variant_effects(df: DataFrame, transcripts: DataFrame, genome: DataFrame, promoter_len: int = 0, ann: str = "ann", limit: int = LIMIT) -> DataFrame:
    """Adds ``effects``: array of effect structs, worst first, of equals by
    transcript. Copy number variants give CNV+ or CNV- and regions unknown for
    each transcript they overlap; with no transcript or no effect it is one
    ``intergenic`` (for a variant longer than ``limit``: ``unknown`` or CNV)."""
    a = F.col("__id")
    narrow = df.select(F.col(ann).alias("__id")).where("__id is not null").distinct()
    narrow = narrow.select(
        "__id", a["type"].alias("__type"), a["chrom"].alias("__chrom_a"), a["pos"].alias("__pos"), a["pos_end"].alias("__stop"), a["ref"].alias("__ref"), a["alt"].alias("__alt"),
        F.greatest(a["pos"] - F.when(a["ref"].isNotNull(), promoter_len).otherwise(0), F.lit(1).cast("bigint")).alias("__begin"), (F.when(a["ref"].isNotNull(), a["pos"] + F.length(a["ref"]) + promoter_len).otherwise(a["pos_end"])).alias("__end"),
    ).where(F.col("__stop") - F.col("__pos") + 1 <= limit)
    tx = transcripts.select("tr_id", "gene", "strand", F.col("chrom").alias("__t_chrom"), "tx_begin", "tx_end")
    hits = overlap_join(narrow, tx, ("__chrom_a", "__begin", "__end"), ("__t_chrom", "tx_begin", "tx_end")).select("__type", "__chrom_a", "__pos", "__stop", "__ref", "__alt", "tr_id", "gene", "strand")
    small = F.col("__ref").isNotNull() & F.col("__alt").isNotNull()
    called = _called(hits.where(small), transcripts, genome, promoter_len).unionByName(hits.where(~small).withColumn("__e", F.lit(None).cast(_CALLED)))
    place = [F.col(c).alias(n) for c, n in (("__type", "type"), ("__chrom_a", "chrom"), ("__pos", "pos"), ("__stop", "pos_end"), ("__ref", "ref"), ("__alt", "alt"))]
    called = called.withColumn("__id", F.struct(*place))
    effect = F.when(F.col("__ref").isNotNull(), F.col("__e.effect")).when(F.col("__type") == "LARGE_DUPLICATION", "CNV+").when(F.col("__type") == "LARGE_DELETION", "CNV-").otherwise("unknown")
    base = _row(effect, F.col("gene"), F.col("tr_id"), F.col("strand"))
    for f in _FIELDS[1:]:
        base = base.withField(f, F.col(f"__e.{f}"))
    per = called.withColumn("__x", base).where("__x.effect is not null")
    # Worst first: a negative severity leads the sort key.
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("__x.severity")).alias("o"), F.col("tr_id").alias("t"), F.col("__x").alias("x")))), lambda e: e["x"])
    told = per.groupBy("__id").agg(listed.alias("effects"))
    out = df.join(told, F.col(ann) == F.col("__id"), "left").drop("__id")
    long = F.col(f"{ann}.pos_end") - F.col(f"{ann}.pos") + 1 > limit
    lone = F.when(long & (F.col(f"{ann}.type") == "LARGE_DUPLICATION"), "CNV+").when(long & (F.col(f"{ann}.type") == "LARGE_DELETION"), "CNV-").when(long, "unknown").otherwise("intergenic")
    return out.withColumn("effects", F.coalesce("effects", F.array(_row(lone))))


def _details(x: Column) -> Column:
    """What is told of an effect beyond its name, by kind of effect."""
    kind = x["effect"]
    say = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    place = F.concat(say(x["prot_pos"]), F.lit("/"), say(x["prot_length"]))
    change = F.concat(F.lit("("), say(x["aa_change"]), F.lit(")"))
    return (
        F.when(kind.isin("noStart", "noEnd", "CDS", "all"), say(x["prot_length"]))
        .when(kind.isin("intron", "5'UTR-intron", "3'UTR-intron", "non-coding-intron"), F.concat(say(x["which_intron"]), F.lit("/"), say(x["how_many_introns"]), F.lit("["), say(x["dist_from_coding"]), F.lit("]")))
        .when(kind.isin("no-frame-shift", "no-frame-shift-newStop", "missense", "nonsense", "coding_unknown"), F.concat(place, change))
        .when(kind.isin("frame-shift", "splice-site", "synonymous"), place)
        .when(kind == "no-mutation", F.lit("no-mutation"))
        .when(kind.isin("5'UTR", "3'UTR", "promoter"), say(x["dist_from_coding"]))
        .otherwise(F.lit("None"))
    )


def worst_genes(effects: Column) -> Column:
    """Genes of the worst effect, sorted and joined by ``;``."""
    worst = F.get(effects, F.lit(0))["effect"]
    hit = F.filter(effects, lambda x: (x["effect"] == worst) & x["gene"].isNotNull())
    return F.array_join(F.array_sort(F.array_distinct(F.transform(hit, lambda x: x["gene"]))), ";")


def all_genes(effects: Column) -> Column:
    hit = F.filter(effects, lambda x: x["gene"].isNotNull())
    return F.array_join(F.array_sort(F.array_distinct(F.transform(hit, lambda x: x["gene"]))), ";")


def summarise(df: DataFrame, lists: list[str] | None = None, effects: str = "effects") -> DataFrame:
    """worst_effect, gene_effects (``gene:effect|...``), effect_details
    (``transcript:gene:effect:details|...``) and a sorted gene list for each
    effect or group name in ``lists`` (column ``<name>_genes``)."""
    e = F.col(effects)
    worst = F.get(e, F.lit(0))["effect"]
    lone = worst.isin("intergenic", "no-mutation")
    gene = lambda x: F.coalesce(x["gene"], F.lit("intergenic"))
    pairs = F.array_distinct(F.transform(e, lambda x: F.concat(gene(x), F.lit(":"), x["effect"])))
    per_tr = F.transform(e, lambda x: F.concat_ws(":", F.coalesce(x["transcript_id"], F.lit("intergenic")), gene(x), x["effect"], _details(x)))
    out = df.withColumns({"worst_effect": worst, "gene_effects": F.when(lone, F.concat(worst, F.lit(":"), worst)).otherwise(F.array_join(pairs, "|")), "effect_details": F.when(lone, F.concat_ws(":", worst, worst, worst, worst)).otherwise(F.array_join(per_tr, "|"))})
    return out.withColumns({f"{n}_genes": genes_with_effect(e, effect_in(GROUPS, [n])) for n in lists or []})


# --- what is told of a place, without a struct for each pair ---------------------

_TOLD = ("worst_effect", "gene_effects", "effect_details", "gene_list")


def _said(x) -> str:
    return "None" if x is None else str(x)


def _detail(e: dict) -> str:
    """``_details`` of an effect as ``effect_on`` gives it."""
    kind, get = e["effect"], e.get
    if kind in ("noStart", "noEnd", "CDS", "all"):
        return _said(get("prot_length"))
    if kind in ("intron", "5'UTR-intron", "3'UTR-intron", "non-coding-intron"):
        return f"{_said(get('which_intron'))}/{_said(get('how_many_introns'))}[{_said(get('dist_from_coding'))}]"
    place = f"{_said(get('prot_pos'))}/{_said(get('prot_length'))}"
    if kind in ("no-frame-shift", "no-frame-shift-newStop", "missense", "nonsense", "coding_unknown"):
        return f"{place}({_said(get('aa_change'))})"
    if kind in ("frame-shift", "splice-site", "synonymous"):
        return place
    return _said(get("dist_from_coding")) if kind in ("5'UTR", "3'UTR", "promoter") else "None"


_A_DETAIL = 32  # bytes of a transcript's part of the details, about
_FIRST = itemgetter(0)
_COPIES = {"LARGE_DUPLICATION": "CNV+", "LARGE_DELETION": "CNV-"}


def _effects_fold(told: list[str], promoter: int):
    lists = {c: set(effect_in(GROUPS, [c.removesuffix("_genes")])) for c in told if c not in _TOLD}
    ordered = bool({"gene_effects", "effect_details", "gene_list"} & set(told))

    def one(found: list[tuple[dict, list]]) -> list:
        """The row of a place, from its effects and the transcripts that have each."""
        # Worst first: by severity lists of (transcript, gene, effect, details).
        by: dict[int, list] = {}
        for e, members in found:
            kind, text = e["effect"], _detail(e)
            by.setdefault(-SEVERITY[kind], []).extend([(tr, gene, kind, text) for tr, gene in members])
        rows = [r for k in sorted(by) for r in sorted(by[k], key=_FIRST)]
        pairs = dict.fromkeys([(g, x) for _, g, x, _ in rows])
        out = {"worst_effect": rows[0][2], "gene_effects": "|".join(dict.fromkeys([f"{'intergenic' if g is None else g}:{x}" for g, x in pairs]))}
        if "effect_details" in told:
            out["effect_details"] = "|".join([f"{t}:{'intergenic' if g is None else g}:{x}:{text}" for t, g, x, text in rows])
        out["gene_list"] = list(dict.fromkeys(g for g, _ in pairs if g is not None))
        for c, kinds in lists.items():
            out[c] = sorted({g for g, x in pairs if x in kinds and g is not None})
        return [out[c] for c in told]

    def run(places: pa.Table, records: pa.Table) -> pa.Table | None:
        records = records.sort_by("tx_begin")
        begin, end = (records.column(c).to_numpy() for c in ("tx_begin", "tx_end"))
        column = records.column("members").combine_chunks()
        out = []
        small = pc.is_valid(places.column("__ref"))
        large = places.filter(pc.invert(small))
        places = places.filter(pc.and_(small, pc.is_valid(places.column("__alt"))))
        if large.num_rows and not ordered:
            # All effects of such a place are the same, so sets of genes tell everything.
            names = spans.Names(pa.ListArray.from_arrays(column.offsets, column.flatten().field("gene")))
            known = pc.is_valid(names.names).to_numpy(zero_copy_only=False)
            effect = [_COPIES.get(t, "unknown") for t in large.column("__type").to_pylist()]
            for i, j, own, rec in spans.pairs((large.column("__begin").to_numpy(), large.column("__end").to_numpy()), (begin, end), names.words):
                over = np.zeros(j - i, bool)
                over[own] = True
                bits = names.union(j - i, own, rec)[over] & known
                kind = np.array(effect[i:j], object)[over]
                cols = {"__id": large.column("__id").slice(i, j - i).filter(pa.array(over)), "worst_effect": pa.array(kind, pa.string())}
                cols |= {c: spans.listed(bits & np.isin(kind, list(kinds))[:, None], names.names) for c, kinds in lists.items()}
                out.append(pa.table({c: cols[c] for c in ["__id", *told]}))
        members = []
        if ordered or places.num_rows:
            flat, cuts = column.flatten(), (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
            known = list(zip(flat.field("tr_id").to_pylist(), flat.field("gene").to_pylist(), strict=True))
            members = [known[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        kinds = [pa.string() if c in ("worst_effect", "gene_effects", "effect_details") else pa.list_(pa.string()) for c in told]

        def each(some: pa.Table, called):
            """``called(row, record)``: the effect of a place on a record."""
            for i, j, own, rec in spans.pairs((some.column("__begin").to_numpy(), some.column("__end").to_numpy()), (begin, end)):
                at, rows = [], []
                cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else [0]
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    k = int(own[a])
                    found = [(e, members[r]) for r in rec[a:b].tolist() if (e := called(i + k, r))]
                    if found:
                        at.append(k)
                        rows.append(one(found))
                    if len(rows) >= 256:  # texts are long where many transcripts lie
                        yield i, at, rows
                        at, rows = [], []
                yield i, at, rows

        def add(some: pa.Table, called):
            for i, at, rows in each(some, called):
                cols = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
                out.append(pa.table([some.column("__id").slice(i).take(pa.array(at, pa.int64())), *cols], names=["__id", *told]))

        if large.num_rows and ordered:
            kind = [{"effect": _COPIES.get(t, "unknown")} for t in large.column("__type").to_pylist()]
            add(large, lambda k, _: kind[k])
        if places.num_rows:
            built: dict[int, _Transcript] = {}
            model = [list(r.values()) for r in records.select(["strand", "cds_begin", "cds_end", "tx_begin", "tx_end", "exons", "coding"]).to_pylist()]
            pos, ref, alt = (places.column(c).to_pylist() for c in ("__pos", "__ref", "__alt"))

            def called(k: int, r: int) -> dict | None:
                if r not in built:
                    built[r] = _Transcript(*model[r])
                return effect_on(built[r], pos[k], ref[k].upper(), alt[k].upper(), promoter)

            add(places, called)
        return pa.concat_tables(out) if out else None

    return run


def annotate_effects(df: DataFrame, transcripts: DataFrame, genome: DataFrame, wanted: list[str], promoter_len: int = 0, ann: str = "ann", limit: int = LIMIT) -> DataFrame:
    """Adds the columns ``wanted`` of ``summarise``, and of ``gene_list`` (genes,
    worst effect first), as they are over ``variant_effects``, without the
    effects themselves. Each distinct annotatable is looked up once; transcripts
    of one shape are one record, on which an effect is worked out once. Details
    have a part for every transcript, so for them the rows go to the texts."""
    told = list(dict.fromkeys(wanted))
    long_texts = "effect_details" in told
    a = F.col("__id")
    apart = a["pos_end"] - a["pos"] + 1 <= limit

    def place(rows: DataFrame) -> DataFrame:
        return rows.select(
            *rows.columns, a["type"].alias("__type"), a["chrom"].alias("__chrom_a"), a["pos"].cast("bigint").alias("__pos"), a["ref"].alias("__ref"), a["alt"].alias("__alt"),
            F.greatest(a["pos"] - F.when(a["ref"].isNotNull(), promoter_len).otherwise(0), F.lit(1)).cast("bigint").alias("__begin"), (F.when(a["ref"].isNotNull(), a["pos"] + F.length(a["ref"]) + promoter_len).otherwise(a["pos_end"])).cast("bigint").alias("__end"),
        )

    def filed(rows: DataFrame) -> DataFrame:
        """By its own bases, which need narrow spans; the transcripts are wide by the promoter instead."""
        return place(rows).withColumns({"__file": F.when(apart & (F.col("__end") >= F.col("__begin")), F.col("__chrom_a")), "__last": F.when(F.col("__ref").isNotNull(), F.col("__end") - promoter_len).otherwise(F.col("__end"))})

    kind = df.schema[ann]
    id_field = StructField("__id", kind.dataType, kind.nullable)
    shape = ("chrom", "strand", "tx_begin", "tx_end", "cds_begin", "cds_end", "exons")
    shapes = transcripts.groupBy(*shape).agg(F.collect_list(F.struct("tr_id", "gene")).alias("members")).withColumn("tr_id", F.array_min(F.transform("members", lambda m: m["tr_id"])))
    shapes = coding_sequences(shapes, genome).select(F.col("chrom").alias("__t_chrom"), *shape[1:], "members", "coding")
    array = ArrayType(StringType())
    schema = StructType([id_field, *[StructField(c, StringType() if c in _TOLD[:3] else array) for c in told]])
    run, named = _effects_fold(told, promoter_len), {c: f"__t_{k}" for k, c in enumerate(told)}
    if long_texts:
        rest = [c for c in df.columns if c != ann]
        rows = df.select(F.col(ann).alias("__id"), F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(True).alias("__row")]).alias("__row"))
        wide = lambda t: t.withColumns({"__from": F.col("tx_begin") - promoter_len, "__to": F.col("tx_end") + promoter_len})
        sizes = wide(transcripts.select(F.col("chrom").alias("__t_chrom"), "tx_begin", "tx_end"))
        found = spans.fold_rows(rows, filed, wide(shapes), sizes, ("__file", "__pos", "__last"), ("__t_chrom", "__from", "__to"), run, schema, _A_DETAIL).withColumnsRenamed(named)
        out, absent = found.withColumnRenamed("__id", ann), F.col(named["effect_details"]).isNull()
    else:
        narrow = place(df.select(F.col(ann).alias("__id")).where("__id is not null").distinct()).where(apart)
        found = spans.fold(narrow, shapes, ("__chrom_a", "__begin", "__end"), ("__t_chrom", "tx_begin", "tx_end"), run, schema).withColumnsRenamed(named)
        out, absent = df.join(found, F.col(ann) == F.col("__id"), "left"), F.col("__id").isNull()
    long = F.col(f"{ann}.pos_end") - F.col(f"{ann}.pos") + 1 > limit
    worst = F.when(long & (F.col(f"{ann}.type") == "LARGE_DUPLICATION"), "CNV+").when(long & (F.col(f"{ann}.type") == "LARGE_DELETION"), "CNV-").when(long, "unknown").otherwise(INTERGENIC)
    none = F.array().cast("array<string>")
    # An effect without a transcript: a lone name stands for all parts, others have no gene to name.
    lone = worst == INTERGENIC
    alone = {
        "worst_effect": worst, "gene_effects": F.when(lone, F.concat(worst, F.lit(":"), worst)).otherwise(F.concat(F.lit("intergenic:"), worst)),
        "effect_details": F.when(lone, F.concat_ws(":", worst, worst, worst, worst)).otherwise(F.concat(F.lit("intergenic:intergenic:"), worst, F.lit(":None"))),
    }
    if not long_texts:
        return out.withColumns({c: F.when(absent, alone.get(c, none)).otherwise(F.col(f"__t_{k}")) for k, c in enumerate(told)}).drop("__id", *named.values())
    out = out.select(ann, "__rows", *[F.when(absent, alone.get(c, none)).otherwise(F.col(t)).alias(t) for c, t in named.items()])
    out = out.select(ann, *named.values(), F.explode("__rows").alias("__row"))
    return out.select(*[F.col(c) if c == ann else F.col("__row").getField(c).alias(c) for c in df.columns if c not in named], *[F.col(t).alias(c) for c, t in named.items()])


def parse_effects(text: Column) -> Column:
    """``gene:effect|...`` -> array<struct<gene,effect>>."""
    parts = F.filter(F.split(text, r"\|"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.split(x, ":")[0].alias("gene"), F.element_at(F.split(x, ":"), -1).alias("effect")))


def parse_effect_details(text: Column) -> Column:
    """``transcript:gene:effect:details|...`` -> array<struct<transcript_id,gene,effect,details>>."""
    parts = F.filter(F.split(text, r"\|"), lambda x: x != "")
    name = lambda x, k: F.get(F.split(x, ":", 4), F.lit(k))
    return F.transform(parts, lambda x: F.struct(name(x, 0).alias("transcript_id"), name(x, 1).alias("gene"), name(x, 2).alias("effect"), name(x, 3).alias("details")))
