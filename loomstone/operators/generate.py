"""Prompts as columns, and generation through a pluggable text generator, flat or bottom-up."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..store import keep
from . import graph


class TextGenerator(Protocol):
    """Anything that turns prompts into continuations; it is pickled to the executors."""

    def generate(self, prompts: list[str]) -> list[str]: ...


class EchoGenerator:
    """A stand-in without a model: tells how many words the prompt has."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [f" Summary of {len(p.split())} words." for p in prompts]


def render(template: str, **fields: Column) -> Column:
    """``template`` with each ``{field}`` replaced; what is put in is not looked at again."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[fields[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def plain_prompt(template: str, test: bool) -> Column:
    return render(template, code=F.col("code"), doc=F.lit("") if test else F.col("doc"))


def synthesis_prompt(template: str) -> Column:
    return plain_prompt(template, False)


def context_prompt(template: str, test: bool, doc: str = "doc", words: int = 20) -> Column:
    """Also fills ``num_doc_words`` (``words`` in a test) and ``lever`` (empty), and strips the result."""
    n = F.lit(str(words)) if test else F.size(X.words(doc)).cast("string")
    return X.strip(render(template, lever=F.lit(""), num_doc_words=n, context=F.col("context"), code=F.col("code"), doc=F.lit("") if test else F.col(doc)))


def generate(df: DataFrame, prompt: Column, generator: TextGenerator, batch: int = 4, longest_answer: int | None = None) -> DataFrame:
    """Adds ``whole_text`` (prompt and continuation) and ``prompt_len``. Long prompts first inside a task, ``batch`` at a time.

    With ``longest_answer`` (in characters) batches of shorter prompts are larger,
    as :func:`loomstone.operators.graph.dynamic_batches` deals them.
    """
    if batch < 1:
        raise ValueError(f"a batch has at least one prompt, not {batch}")
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            order = sorted(range(len(f)), key=lambda i: -len(f["__prompt"].iloc[i] or ""))
            out: list[str | None] = [None] * len(f)
            lengths = [len(f["__prompt"].iloc[i] or "") for i in order]
            dealt = [(at, batch) for at in range(0, len(order), batch)] if longest_answer is None else graph.dynamic_batches(lengths, batch, longest_answer)
            for at, n in dealt:
                some = order[at : at + n]
                prompts = [f["__prompt"].iloc[i] or "" for i in some]
                for i, p, t in zip(some, prompts, generator.generate(prompts), strict=True):
                    out[i] = p + t
            yield f[names].assign(whole_text=out, prompt_len=[len(p or "") for p in f["__prompt"]])

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema) + ", whole_text string, prompt_len int"
    return df.withColumn("__prompt", prompt).mapInPandas(run, schema)


def generate_bottom_up(functions: DataFrame, template: str, generator: TextGenerator, batch: int = 4, cycle_repeats: int = 2) -> DataFrame:
    """``id, generated_context, whole_text, prompt_len``: callees first, each caller's prompt holds what its callees got.

    One pass per height over the rows of that height; state is written to the
    shared folder after each.  Members of a circle are visited again and keep
    their last text.
    """
    plan = keep(graph.schedule(functions, cycle_repeats), "schedule")
    top = plan.agg(F.max("height")).first()[0]
    state = None
    for height in range(0, -1 if top is None else top + 1):
        rows = functions.join(plan.where(F.col("height") == height).select("id"), "id", "left_semi")
        if state is None:
            known = functions.withColumn("__said", F.lit(""))
        else:
            said = F.substr("whole_text", F.col("prompt_len") + 1)
            known = functions.join(state.select("id", said.alias("__said")), "id", "left").fillna("", ["__said"])
        context = graph.callee_context(known, doc="__said", with_parameters=True, stripped=True)
        ready = rows.drop("context").join(context, "id")
        prompt = X.strip(render(template, context=F.col("context"), code=F.col("code"), doc=F.lit("")))
        new = generate(ready, prompt, generator, batch).select("id", F.col("context").alias("generated_context"), "whole_text", "prompt_len")
        state = keep(new if state is None else state.join(new.select("id"), "id", "left_anti").unionByName(new), "state")
    return state if state is not None else functions.select("id", F.lit("").alias("generated_context"), F.lit("").alias("whole_text"), F.lit(0).alias("prompt_len")).where("false")
