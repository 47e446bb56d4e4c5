"""YAML pipelines: parsed and checked on the driver, compiled to one lazy DataFrame.

Annotators run in order, each a left enrichment: one row per input row, columns
added. Neighbouring annotators that read one score in the same way are merged,
so a resource is joined once however many annotators name it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import compile_transform
from ..functions.values import stringify
from ..operators import effects, genes, genome, scores, transcripts
from .catalog import Catalog

_OLD_AGGREGATORS = ("position_aggregator", "nucleotide_aggregator", "gene_aggregator", "allele_aggregator", "fragment_aggregator")
_PREAMBLE = ("summary", "description", "input_reference_genome", "metadata")
_ALIASES = {
    "position_score_annotator": "position_score", "allele_score_annotator": "allele_score", "np_score": "allele_score", "np_score_annotator": "allele_score", "fragment_score_annotator": "fragment_score",
    "cnv_collection": "fragment_score", "cnv_collection_annotator": "fragment_score", "gene_score": "gene_score_annotator", "gene_set": "gene_set_annotator", "chrom_mapping_annotator": "chrom_mapping", "bcf_liftover_annotator": "liftover_annotator",
}


class PipelineProblem(ValueError):
    """A pipeline that cannot be planned."""


@dataclass(frozen=True)
class Attr:
    name: str
    source: str
    internal: bool = False
    aggregator: str | None = None
    value: str | None = None


@dataclass(frozen=True)
class Spec:
    """One annotator of a pipeline."""

    type: str
    resource: str | None = None
    attributes: tuple[Attr, ...] = ()
    params: tuple[tuple[str, object], ...] = ()
    input_annotatable: str | None = None
    id: str = ""

    def param(self, name: str, default=None):
        return dict(self.params).get(name, default)

    def identity(self) -> tuple:
        return self.type, self.resource, self.attributes, tuple(p for p in self.params if p[0] != "work_dir"), self.input_annotatable


@dataclass
class Pipeline:
    specs: list[Spec]
    preamble: dict = field(default_factory=dict)

    def attributes(self) -> list[Attr]:
        return [a for s in self.specs for a in s.attributes]


def _attribute(raw) -> Attr:
    if isinstance(raw, str):
        return Attr(raw, raw)
    raw = dict(raw)
    name = raw.pop("name", None) or raw.pop("destination", None)
    raw.pop("destination", None)
    source = raw.pop("source", None) or name
    name = name or source
    if not name:
        raise PipelineProblem("an attribute without name and source")
    aggregator = raw.pop("aggregator", None)
    for old in _OLD_AGGREGATORS:
        aggregator = aggregator or raw.pop(old, None)
    out = Attr(name, source, bool(raw.pop("internal", False)), aggregator, raw.pop("value", None))
    raw.pop("description", None)
    if raw:
        raise PipelineProblem(f"attribute {name}: unused {sorted(raw)}")
    return out


# What each annotator may be told beside resource, attributes and input.
_PARAMS = {
    "position_score": (),
    "allele_score": ("mode", "allele_filter", "include_attributes"),
    "fragment_score": ("fragment_filter", "cnv_filter"),
    "gene_score_annotator": ("input_gene_list",),
    "gene_set_annotator": ("input_gene_list",),
    "simple_effect_annotator": ("gene_models",),
    "effect_annotator": ("gene_models", "genome", "promoter_len"),
    "normalize_allele_annotator": ("genome",),
    "liftover_annotator": ("chain", "source_genome", "target_genome", "mode"),
    "basic_liftover_annotator": ("chain", "source_genome", "target_genome"),
    "chrom_mapping": ("mapping", "add_prefix", "del_prefix"),
    "debug_annotator": ("value",),
}
_RESOURCE_KEYS = ("resource_id", "resource")
_TYPES = {"position_score": ("position_score",), "allele_score": ("allele_score", "np_score"), "fragment_score": ("fragment_score", "cnv_collection")}
_EXTRA: dict[str, object] = {}


def register(name: str, plan) -> None:
    """Adds an annotator type: ``plan(df, spec, catalog, ann) -> df``,
    which must keep one row per row and add the spec's attributes by source name."""
    _EXTRA[name] = plan


def parse(text: str, catalog: Catalog | None = None, rename_repeated: bool = False) -> Pipeline:
    """Forms: ``- type``, ``- type: resource`` (with ``*``), ``- type: {...}``;
    optionally under ``annotators`` with a ``preamble``."""
    raw = yaml.safe_load(text) or []
    preamble: dict = {}
    if isinstance(raw, dict):
        preamble = raw.get("preamble") or {}
        if set(preamble) - set(_PREAMBLE):
            raise PipelineProblem(f"preamble: unknown {sorted(set(preamble) - set(_PREAMBLE))}")
        if set(raw) - {"preamble", "annotators"}:
            raise PipelineProblem(f"unknown {sorted(set(raw) - {'preamble', 'annotators'})}")
        raw = raw.get("annotators") or []
    specs: list[Spec] = []
    for k, item in enumerate(raw):
        if isinstance(item, str):
            name, body = item, {}
        elif isinstance(item, dict) and len(item) == 1:
            name, body = next(iter(item.items()))
            body = {} if body is None else {"resource_id": body} if isinstance(body, str) else dict(body)
        else:
            raise PipelineProblem(f"annotator {k}: {item!r}")
        kind = _ALIASES.get(name, name)
        if kind == "liftover_annotator" and name == "basic_liftover_annotator":
            kind = name
        if kind not in _PARAMS and kind not in _EXTRA:
            raise PipelineProblem(f"unknown annotator {name!r}")
        resource = next((body.pop(r) for r in _RESOURCE_KEYS if r in body), None)
        attributes = tuple(_attribute(a) for a in body.pop("attributes", None) or ())
        into = body.pop("input_annotatable", None)
        body.pop("work_dir", None)
        if kind in _PARAMS and (unused := set(body) - set(_PARAMS[kind])):
            raise PipelineProblem(f"{name}: unused parameters {sorted(unused)}")
        params = tuple(sorted(body.items(), key=lambda p: p[0]))
        if resource and "*" in resource:
            if catalog is None:
                raise PipelineProblem("a wildcard needs a catalogue")
            names = [r.id for r in catalog.matching(resource, _TYPES.get(kind, ()))]
        else:
            names = [resource]
        for r in names:
            specs.append(Spec(kind, r, attributes, tuple((a, _frozen(b)) for a, b in params), into, f"A{len(specs)}"))
    if catalog is not None:
        specs = [_with_defaults(s, catalog) for s in specs]
    seen: dict[str, str] = {}
    out: list[Spec] = []
    for s in specs:
        attrs = []
        for a in s.attributes:
            if a.name in seen:
                if not rename_repeated:
                    raise PipelineProblem(f"attribute {a.name!r} is produced twice")
                a = replace(a, name=f"{a.name}_{s.id}")
            seen[a.name] = s.id
            attrs.append(a)
        out.append(replace(s, attributes=tuple(attrs)))
    for s in out:
        if s.input_annotatable and s.input_annotatable not in seen:
            raise PipelineProblem(f"no attribute {s.input_annotatable!r} to read annotatables from")
    return Pipeline(out, preamble)


def _frozen(x):
    return tuple(sorted((k, _frozen(v)) for k, v in x.items())) if isinstance(x, dict) else tuple(map(_frozen, x)) if isinstance(x, list) else x


def _with_defaults(s: Spec, catalog: Catalog) -> Spec:
    if s.attributes:
        return s
    if s.resource:
        r = catalog.get(s.resource)
        if r.default_attributes:
            return replace(s, attributes=tuple(_attribute(a) for a in r.default_attributes))
        if isinstance(r.value, scores.Score):
            return replace(s, attributes=tuple(Attr(v, v) for v in r.value.values))
        if s.type == "gene_score_annotator":
            return replace(s, attributes=tuple(Attr(c, c) for c in r.value.columns if c != "gene"))
    fixed = {
        "effect_annotator": ("worst_effect", "gene_effects", "effect_details", "gene_list"),
        "simple_effect_annotator": ("worst_effect", "gene_effects", "genes"),
        "gene_set_annotator": ("in_sets",),
        "normalize_allele_annotator": ("normalized_allele",),
        "liftover_annotator": ("liftover_annotatable",),
        "basic_liftover_annotator": ("liftover_annotatable",),
        "chrom_mapping": ("renamed_chromosome",),
        "debug_annotator": ("debug",),
    }.get(s.type, ())
    return replace(s, attributes=tuple(Attr(n, n, internal=s.type in ("normalize_allele_annotator", "liftover_annotator", "basic_liftover_annotator", "chrom_mapping")) for n in fixed))


def merge(specs: list[Spec]) -> list[Spec]:
    """Neighbours that read one score in the same way, as one annotator."""
    out: list[Spec] = []
    for s in specs:
        p = out[-1] if out else None
        if p and s.type in _TYPES and (p.type, p.resource, p.params, p.input_annotatable) == (s.type, s.resource, s.params, s.input_annotatable):
            out[-1] = replace(p, attributes=p.attributes + s.attributes)
        else:
            out.append(s)
    return out


def annotate(df: DataFrame, pipeline: Pipeline, catalog: Catalog, ann: str = "ann", keep_internal: bool = False) -> DataFrame:
    """``df`` with the pipeline's attributes, one row per row; no action runs.
    Attributes belong to places (or gene lists): every distinct one is looked up
    once and its attributes go to all rows that have it, so rows need no ids,
    and those that repeat stay as many. Internal attributes are dropped at the end.
    Where annotators read nothing but such columns, all run over their distinct
    values, and rows are joined once, with what is left at the end."""
    specs = merge(pipeline.specs)
    read = [c for c in dict.fromkeys([ann, *[c for s in specs for c in sorted(consumed(s))]]) if c in df.columns]
    kinds = dict(df.dtypes)
    if len(specs) > 1 and not any(s.type in _EXTRA for s in specs) and read != df.columns and ann in read and not any("map<" in kinds[c] for c in read):
        told = annotate(df.select(*read).distinct(), pipeline, catalog, ann, keep_internal)
        told = told.withColumnsRenamed({c: f"__in{k}" for k, c in enumerate(read)})
        same = [F.col(c).eqNullSafe(F.col(f"__in{k}")) for k, c in enumerate(read)]
        return df.join(told, same, "left").drop(*[f"__in{k}" for k in range(len(read))])
    for s in specs:
        df = _run(df, s, pipeline, catalog, s.input_annotatable or ann)
        kinds = dict(df.dtypes)
        for a in s.attributes:
            if a.value:
                kind = kinds[a.name]
                kind = "array" if kind.startswith("array") else {"int": "bigint", "float": "double"}.get(kind, kind)
                df = df.withColumn(a.name, compile_transform(a.value, F.col(a.name), kind)[0])
    if not keep_internal:
        df = df.drop(*[a.name for a in pipeline.attributes() if a.internal])
    return df


def printable(df: DataFrame, pipeline: Pipeline, ann: str = "ann", show=stringify) -> DataFrame:
    """``df`` with collections of position scores as text: what a substitution
    reads at its one base is a value, not a list or map of it. ``show`` prints
    the others."""
    kinds = dict(df.dtypes)
    point = F.col(f"{ann}.type") == "SUBSTITUTION"
    out = {}
    for s in pipeline.specs:
        for a in s.attributes:
            kind = kinds.get(a.name, "")
            if s.type == "position_score" and not s.input_annotatable and kind.startswith(("array", "map")):
                c = F.col(a.name)
                one = F.get(c if kind.startswith("array") else F.map_keys(c), F.lit(0)).cast("string")
                out[a.name] = F.when(c.isNotNull(), F.when(point, one).otherwise(show(c, kind)))
    return df.withColumns(out) if out else df


def _asked(s: Spec) -> list[scores.Attribute]:
    return [scores.Attribute(a.source, a.name, a.aggregator) for a in s.attributes]


def _renamed(df: DataFrame, s: Spec, made: list[str]) -> DataFrame:
    """Columns that an operator adds under fixed names, as the attributes asked for."""
    for a in s.attributes:
        if a.source not in made:
            raise PipelineProblem(f"{s.type} has no {a.source!r}")
    out = df.withColumns({f"__x_{k}": F.col(f"__m_{a.source}") for k, a in enumerate(s.attributes)}) if s.attributes else df
    out = out.drop(*[f"__m_{m}" for m in made])
    return out.withColumnsRenamed({f"__x_{k}": a.name for k, a in enumerate(s.attributes)})


def _run(df: DataFrame, s: Spec, pipeline: Pipeline, catalog: Catalog, ann: str) -> DataFrame:
    if s.type in _EXTRA:
        return _EXTRA[s.type](df, s, catalog, ann)
    if s.type in _TYPES:
        score = catalog.get(s.resource).value
        if s.type == "position_score":
            return scores.annotate_position(df, score, _asked(s), ann)
        if s.type == "allele_score":
            return scores.annotate_allele(df, score, _asked(s), ann, s.param("mode", "exact"), s.param("allele_filter"))
        asked = [a for a in _asked(s) if a.source != "count"]
        count = next((a.name for a in s.attributes if a.source == "count"), None)
        return scores.annotate_fragment(df, score, asked, ann, s.param("fragment_filter") or s.param("cnv_filter"), count)
    if s.type == "gene_score_annotator":
        table, out = catalog.get(s.resource).value, df
        for a in s.attributes:
            out = genes.annotate_gene_score(out, table, a.source, a.name, s.param("input_gene_list", "gene_list"), aggregator=a.aggregator)
        return out
    if s.type == "gene_set_annotator":
        per = {a.source: a.name for a in s.attributes if a.source != "in_sets"}
        name = next((a.name for a in s.attributes if a.source == "in_sets"), "__in_sets")
        return genes.annotate_gene_sets(df, catalog.get(s.resource).value, name, per, s.param("input_gene_list", "gene_list")).drop("__in_sets")
    # Each distinct annotatable once. Structs are equal if all their parts are, nulls too.
    narrow = df.select(F.col(ann).alias("__ann")).where("__ann is not null").distinct()
    back = lambda told, made: _renamed(df.join(told.select(F.col("__ann").alias("__j"), *[F.col(m).alias(f"__m_{m}") for m in made]), F.col(ann) == F.col("__j"), "left").drop("__j"), s, made)
    if s.type == "simple_effect_annotator":
        models = catalog.get(s.param("gene_models") or s.resource or catalog.gene_models).value
        told = transcripts.annotate_simple_effects(narrow, models, "__ann").withColumn("gene_list", F.col("genes"))
        return back(told, ["worst_effect", "gene_effects", "genes", "gene_list", *[f"{c}_genes" for c in transcripts.SIMPLE]])
    if s.type == "effect_annotator":
        ref = s.param("gene_models") or s.resource or catalog.gene_models
        models = catalog.get(ref)
        where = s.param("genome") or models.labels.get("reference_genome") or pipeline.preamble.get("input_reference_genome") or catalog.genome
        lists = [a.source.removesuffix("_genes") for a in s.attributes if a.source.endswith("_genes")]
        told = effects.variant_effects(narrow, models.value, catalog.get(where).value, int(s.param("promoter_len", 0)), "__ann")
        told = effects.summarise(told, lists).withColumn("gene_list", F.array_distinct(F.transform(F.filter("effects", lambda x: x["gene"].isNotNull()), lambda x: x["gene"])))
        return back(told, ["effects", "worst_effect", "gene_effects", "effect_details", "gene_list", *[f"{n}_genes" for n in lists]])
    if s.type == "normalize_allele_annotator":
        where = s.param("genome") or s.resource or pipeline.preamble.get("input_reference_genome") or catalog.genome
        return back(genome.annotate_normalised(narrow, catalog.get(where).value, "normalized_allele", "__ann"), ["normalized_allele"])
    if s.type in ("liftover_annotator", "basic_liftover_annotator"):
        chain = catalog.get(s.param("chain") or s.resource)
        source = catalog.get(s.param("source_genome") or chain.labels.get("source_genome")).value
        target = catalog.get(s.param("target_genome") or chain.labels.get("target_genome")).value
        mode = "basic" if s.type.startswith("basic") else s.param("mode", "bcf")
        small = narrow.where("__ann.ref is not null")
        large = narrow.where("__ann.ref is null")
        told = genome.lift_alleles(small, chain.value, source, target, "liftover_annotatable", "__ann", mode).select("__ann", "liftover_annotatable")
        told = told.unionByName(genome.lift_regions(large, chain.value, "liftover_annotatable", "__ann").select("__ann", "liftover_annotatable"))
        return back(told, ["liftover_annotatable"])
    if s.type == "chrom_mapping":
        m = s.param("mapping")
        mapping = dict(m) if m is not None else catalog.get(s.resource).value if s.resource else None
        return back(genome.map_chroms(narrow, mapping, s.param("add_prefix", ""), s.param("del_prefix", ""), "__ann", "renamed_chromosome"), ["renamed_chromosome"])
    return df.withColumns({a.name: F.lit(s.param("value", "debug")) for a in s.attributes})


# --- reannotation --------------------------------------------------------------


@dataclass(frozen=True)
class Change:
    copied: tuple[str, ...]
    computed: tuple[str, ...]
    deleted: tuple[str, ...]
    run: tuple[Spec, ...]


def consumed(s: Spec) -> set[str]:
    got = {s.input_annotatable} if s.input_annotatable else set()
    if s.type in ("gene_score_annotator", "gene_set_annotator"):
        got.add(str(s.param("input_gene_list", "gene_list")))
    return got


def reannotation(old: Pipeline, new: Pipeline, full: bool = False) -> Change:
    """What to run on rows that ``old`` annotated so that they are as ``new``
    says: annotators that are new, those that use what a new one makes, and
    those that make an internal attribute which one that runs needs."""
    before = {s.identity() for s in old.specs}
    run = [full or s.identity() not in before for s in new.specs]
    moved = True
    while moved:
        moved = False
        made = {a.name for s, r in zip(new.specs, run, strict=True) if r for a in s.attributes}
        need = {c for s, r in zip(new.specs, run, strict=True) if r for c in consumed(s)}
        for k, s in enumerate(new.specs):
            hidden = {a.name for a in s.attributes if a.internal}
            if not run[k] and (consumed(s) & made or hidden & need):
                run[k] = moved = True
    computed = tuple(a.name for s, r in zip(new.specs, run, strict=True) if r for a in s.attributes)
    copied = tuple(a.name for s, r in zip(new.specs, run, strict=True) if not r for a in s.attributes if not a.internal)
    deleted = tuple(a.name for a in old.attributes() if not a.internal and a.name not in copied)
    return Change(copied, computed, deleted, tuple(s for s, r in zip(new.specs, run, strict=True) if r))


def reannotate(df: DataFrame, old: Pipeline, new: Pipeline, catalog: Catalog, ann: str = "ann", full: bool = False) -> DataFrame:
    change = reannotation(old, new, full)
    return annotate(df.drop(*change.deleted), Pipeline(list(change.run), new.preamble), catalog, ann)


def describe(pipeline: Pipeline, old: Pipeline | None = None) -> list[tuple[str, str, str]]:
    """(attribute, annotator, COMPUTED, COPIED, ADDED or DELETED)."""
    if old is None:
        return [(a.name, s.id, "COMPUTED") for s in pipeline.specs for a in s.attributes]
    change = reannotation(old, pipeline)
    had = {a.name for a in old.attributes()}
    out = [(a.name, s.id, "COPIED" if a.name in change.copied else "COMPUTED" if a.name in had else "ADDED") for s in pipeline.specs for a in s.attributes]
    return out + [(n, "", "DELETED") for n in change.deleted if n not in {a.name for a in pipeline.attributes()}]
