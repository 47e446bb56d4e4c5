"""Adapters for annotators that live outside Spark: models and command-line tools."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pipeline import Spec, register


def python_annotator(name: str, run: Callable[[pd.DataFrame], pd.DataFrame], outputs: dict[str, str]) -> None:
    """Registers ``run``: a frame of (type, chrom, pos, pos_end, ref, alt) to one
    of the same length with the columns of ``outputs`` (name -> SQL type). It
    sees each distinct annotatable once."""

    def plan(df: DataFrame, spec: Spec, catalog, ann: str) -> DataFrame:
        src = df.select(F.col(ann).alias("__a")).where("__a is not null").distinct().select("__a.*")
        names = list(outputs)

        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = run(pdf)
                if len(out) != len(pdf):
                    raise ValueError(f"{name}: {len(out)} rows for {len(pdf)}")
                yield pd.concat([pdf.reset_index(drop=True), out[names].reset_index(drop=True).add_prefix("__o_")], axis=1)

        kinds = [f"{f.name} {f.dataType.simpleString()}" for f in src.schema] + [f"__o_{k} {t}" for k, t in outputs.items()]
        told = src.mapInPandas(go, ", ".join(kinds))
        told = told.select(F.struct(*src.columns).alias("__j"), *[F.col(f"__o_{a.source}").alias(a.name) for a in spec.attributes])
        return df.join(told, F.col(ann) == F.col("__j"), "left").drop("__j")

    register(name, plan)


def command_annotator(name: str, command: list[str], outputs: list[str]) -> None:
    """A tool that reads ``chrom pos ref alt`` lines and writes a line of
    tab-separated results for each, in order. One process per partition batch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        text = "".join("\t".join(str(x) for x in r) + "\n" for r in pdf[["chrom", "pos", "ref", "alt"]].itertuples(index=False))
        got = subprocess.run(command, input=text, capture_output=True, text=True, check=True).stdout.splitlines()
        return pd.DataFrame([(line.split("\t") + [None] * len(outputs))[: len(outputs)] for line in got], columns=outputs)

    python_annotator(name, run, dict.fromkeys(outputs, "string"))


def one_hot(seq: str) -> np.ndarray:
    """(length, 4) for A, C, G, T; any other base is a row of zeros."""
    out = np.zeros((len(seq), 4), np.int8)
    codes = np.frombuffer(seq.upper().encode(), np.uint8)
    for k, b in enumerate(b"ACGT"):
        out[codes == b, k] = 1
    return out


def worst_consequence(terms: pd.Series, ranks: dict[str, int]) -> pd.Series:
    """Of comma or & separated terms the one of the greatest rank."""
    return terms.map(lambda t: max(t.replace("&", ",").split(","), key=lambda x: ranks.get(x, -1)) if t else None)
