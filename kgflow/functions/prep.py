"""P operators: prompts, training pairs, splits and batched inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgflow.functions.forms import entities


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill_prompt(template: str, question) -> Column:
    """``{{input}}`` -> question, ``{{output}}`` -> empty."""
    return F.replace(F.replace(F.lit(template), F.lit("{{input}}"), _c(question)), F.lit("{{output}}"), F.lit(""))


def fill_training(template: str, inp, out) -> Column:
    """Both slots filled."""
    return F.replace(F.replace(F.lit(template), F.lit("{{input}}"), _c(inp)), F.lit("{{output}}"), _c(out))


def with_prefix(c, prefix: str) -> Column:
    """Constant instruction prefix."""
    return F.concat(F.lit(prefix), _c(c))


def definition_prompts(df: DataFrame, id_col: str, form_col: str, question_col: str,
                       template: str) -> DataFrame:
    """One prompt per (row, mention position): ``<ENTITY>`` and ``<QUESTION>``."""
    ex = df.select(id_col, question_col, F.posexplode(entities(form_col)).alias("pos", "mention"))
    prompt = F.replace(F.replace(F.lit(template), F.lit("<ENTITY>"), F.col("mention")),
                       F.lit("<QUESTION>"), F.col(question_col))
    return ex.select(id_col, "pos", "mention", prompt.alias("prompt"))


def split_side(key, dev_share: float = 0.2, seed: str = "0") -> Column:
    """P5: deterministic train/dev assignment from ``md5(seed:key)`` -- stable
    across runs, engines and partitionings (DuckDB's md5 agrees)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string"))), 1, 8), 16, 10)
    return F.when(h.cast("bigint") / F.lit(4294967296.0) < dev_share, "dev").otherwise("train")


def training_pairs(df: DataFrame, target: str = "output") -> DataFrame:
    """Choose the target: ``output`` (logical form) or ``SPARQL`` (first
    element of the list; null for an empty one)."""
    if target == "SPARQL":
        return df.withColumn("target", F.try_element_at("SPARQL", F.lit(1)))
    return df.withColumn("target", F.col(target))


def sentences(c) -> Column:
    """One sentence per line (split after . ! ? followed by blanks)."""
    return F.regexp_replace(_c(c), r"([.!?])[ \t]+", "$1\n")


def infer(df: DataFrame, prompt_col: str, model_factory: Callable[[], Callable[[list[str]], list[str]]],
          batch: int = 16, out_col: str = "generation", done: DataFrame | None = None,
          key: str | None = None) -> DataFrame:
    """Batched inference on the executors.

    ``model_factory`` is called once per partition (model load), the returned
    callable maps a list of prompts to a list of outputs.  With ``done`` (a
    previous partial output holding ``key``) the finished rows are skipped by
    an anti-join, so a failed run resumes where it stopped.
    """
    if done is not None and key:
        df = df.join(done.select(key), key, "left_anti")
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, T.StringType())])
    cols = df.columns

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for pdf in it:
            outs: list[str] = []
            prompts = pdf[prompt_col].tolist()
            for i in range(0, len(prompts), batch):
                outs.extend(model(prompts[i:i + batch]))
            res = pdf[cols].copy()
            res[out_col] = outs
            yield res

    return df.mapInPandas(run, schema)
