"""Renaming callees in code and context, the same way wherever a seed is the same."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def new_names(functions: DataFrame, shortest: int = 3, longest: int = 7, seed: int = 0) -> DataFrame:
    """``name, new_name`` of the different short names (after the last ``:``); no two new names are equal.

    A name's letters come from its hash.  Names whose letters, filled up to
    ``longest``, meet get a number, spelt in letters, and so one or more letters
    beyond ``longest``; the first of each stays as it is.
    """
    names = functions.select(X.last_part("name", ":").alias("name")).distinct()
    size = F.lit(shortest) + F.pmod(F.xxhash64(F.lit(seed), "name"), F.lit(longest - shortest + 1)).cast("int")
    letter = lambda i: F.substr(F.lit(LETTERS), F.pmod(F.xxhash64(F.lit(seed), "name", i), F.lit(52)).cast("int") + 1, F.lit(1))
    first = F.array_join(F.transform(F.sequence(F.lit(1), size), letter), "")
    stem = F.rpad("first", longest, "Z")
    # numbered over the filled stem: "abc" and "abcZ" share one
    met = F.row_number().over(Window.partitionBy(stem).orderBy("name")) - 1
    spelt = F.translate(met.cast("string"), "0123456789", LETTERS[:10])
    unique = F.when(met > 0, F.concat(stem, spelt)).otherwise(F.col("first"))
    return names.withColumn("first", first).withColumn("new_name", unique).select("name", "new_name")


def obfuscate(functions: DataFrame, everything: DataFrame, rate: float = 0.5, shortest: int = 3, longest: int = 7, seed: int = 0) -> DataFrame:
    """``functions`` with callee names replaced in ``context`` and in the body of ``code``; signatures stay.

    A callee is renamed if its name is an identifier that occurs as a whole word
    in both, and if the coin that its row, place and seed decide falls so.
    """
    named = everything.select(F.col("id").alias("dst"), X.last_part("name", ":").alias("name")).join(new_names(everything, shortest, longest, seed), "name")
    coin = F.pmod(F.xxhash64(F.lit(seed), "src", "pos"), F.lit(1_000_000)) / 1e6 < rate
    e = functions.select(F.col("id").alias("src"), F.posexplode("to").alias("pos", "dst")).where((F.col("src") != F.col("dst")) & coin).join(named, "dst")
    renames = e.where(F.col("name").rlike(r"^[a-zA-Z0-9_]+\z")).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "new_name"))).alias("__renames"))
    rows = functions.join(renames.withColumnRenamed("src", "id"), "id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [renamed(c, x, r if r is not None else []) for c, x, r in zip(b["code"], b["context"], b["__renames"], strict=True)]
            yield b.drop(columns="__renames").assign(code=[p[0] for p in pairs], context=[p[1] for p in pairs])

    return rows.select(*functions.columns, "__renames").mapInPandas(run, functions.schema)


def renamed(code: str, context: str, renames: list) -> tuple[str, str]:
    """(code, context) after the renames, one after the other."""
    head, brace, body = (code or "").partition("{")
    if not brace or context is None:
        return code, context
    for r in renames:
        word = re.compile(rf"(?<![a-zA-Z0-9_]){re.escape(r['name'])}(?![a-zA-Z0-9_])")
        if word.search(context) and word.search(body):
            context, body = word.sub(r["new_name"], context), word.sub(r["new_name"], body)
    return head + brace + body, context
