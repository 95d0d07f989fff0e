"""Summary metrics: verbosity (native), triviality and fuzzy likeness (Arrow UDFs).

A metric is a function from columns to a column; :data:`METRICS` is the registry
that :func:`with_metrics` applies.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X

# Fixed values of triviality.
COMMON_WORDS = (
    "return", "get", "given", "input", "output", "value", "information", "to", "current", "param", "parameter",
    "example", "true", "false", "see", "function", "name", "pre", "post", "set", "assign", "assigned",
)
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
#: Short English stop words; a fuller list may be passed in its place.
STOPWORDS = frozenset(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
)
#: Word -> its abbreviations. The full table of some 280 words is a parameter (a JSON file), not part of the package.
ABBREVIATIONS = {
    "address": ("addr",), "argument": ("arg",), "array": ("arr",), "buffer": ("buf", "buff"), "character": ("char",), "command": ("cmd",), "configuration": ("cfg", "conf", "config"),
    "context": ("ctx",), "destination": ("dest", "dst"), "directory": ("dir",), "error": ("err",), "function": ("fn", "func"), "index": ("idx",), "initialize": ("init",), "length": ("len",),
    "memory": ("mem",), "message": ("msg",), "number": ("num",), "pointer": ("ptr",), "previous": ("prev",), "source": ("src",), "string": ("str",), "temporary": ("temp", "tmp"), "value": ("val",),
}


def verbosity(doc: Column) -> Column:
    """0 to 1: length over 250 characters, and passages of 30 or 50 characters (with more than three words) that recur.

    At 551 characters and more the length alone gives 1, so windows are cut from shorter texts only.
    """
    n = F.length(doc)
    by_length = F.when(n > 550, 1.0).when((n > 250) & (n < 550), (n - 250) / 300).otherwise(0.0)
    short = F.when(n <= 550, doc)

    def recurs(size: int) -> Column:
        own = F.filter(X.windows(short, size, (F.length(short) - size).cast("int")), lambda w: F.size(X.words(w)) > 3)
        return F.size(own) > F.size(F.array_distinct(own))

    repeated = F.when(recurs(50), 1.0).when(recurs(30), 0.4).otherwise(0.0)
    return F.when(n > 550, 1.0).otherwise(F.least(F.lit(1.0), by_length + repeated))


def name_parts(name: str) -> set[str]:
    """Lower-case parts of an identifier: between underscores, at changes of case, runs of digits and of others; and the whole."""
    out = {name.lower()}
    for piece in name.split("_"):
        starts = [i for i, c in enumerate(piece) if i == 0 or c.isupper() and (piece[i - 1].islower() or piece[i + 1 : i + 2].islower())]
        for part in (piece[i:j] for i, j in zip(starts, [*starts[1:], len(piece)], strict=True)):
            out.add(part.lower())
            out.update(m.lower() for m in re.findall(r"\d+|\D+", part))
    return out


def likeness(word: str, part: str, short_forms: dict[str, tuple[str, ...]], common: frozenset[str]) -> float:
    """How far ``part`` of a name gives ``word`` away; the first rule that applies counts."""
    prefix = next((k for k, (a, b) in enumerate(zip(word, part, strict=False)) if a != b), min(len(word), len(part)))
    rules: list[tuple[bool, float]] = [
        (word == part, 1.0), (part in short_forms.get(word, ()), 0.9), (len(part) >= 3 and word.startswith(part), 0.8), (len(word) >= 4 and word in part, 0.8),
        (prefix >= 3, prefix / max(len(word), len(part), 1)), (word in common, 0.5), (len(word) >= 4 and word[:4] in part, 0.5), (word.startswith(part), 0.3),
    ]
    return next((score for holds, score in rules if holds), 0.0)


def triviality_of(doc: str, name: str, code: str, short_forms: dict[str, tuple[str, ...]], common: frozenset[str], stop: frozenset[str], longest: int = 150) -> float:
    """0 to 1: how much of a summary merely repeats the function's name and signature."""
    if len(doc.strip()) > longest:
        return 0.0
    alnum = re.compile(r"[^a-zA-Z0-9]+")
    said = {w.lower() for w in alnum.sub(" ", doc.replace("'s", " ")).split()} - stop
    if len(said) < 2:
        return 1.0
    head, _, _ = code.partition("(")
    inside = code.split(")")[0].rsplit("(", 1)[-1]
    before = " ".join(head.split(" ")[:-1])
    own = name_parts(name)
    others = {p for w in set(alnum.sub(" ", f"{before} {inside}").split()) if len(w) > 2 for p in name_parts(w)} - own
    spell = lambda w: DIGITS[int(w)] if len(w) == 1 and w in "0123456789" else w
    total = 0.0
    for w in map(spell, said):
        total += max([likeness(w, spell(p), short_forms, common) for p in own] + [0.6 * likeness(w, spell(p), short_forms, common) for p in others] + [0.0])
    share = total / (len(said) - 0.5)
    return 1.0 if share >= 0.85 else max(0.0, (share - 0.6) / 0.25)


def short_forms(table: dict[str, tuple[str, ...]] | None = None) -> dict[str, tuple[str, ...]]:
    """The table and its plurals; "destination" also gets "dst" (its plural does not)."""
    table = dict(ABBREVIATIONS if table is None else table)
    plural = {f"{w}s": (*a, *(f"{x}s" for x in a)) for w, a in table.items()}
    out = plural | table
    if "destination" in out and "dst" not in out["destination"]:
        out["destination"] = (*out["destination"], "dst")
    return out


def read_abbreviations(spark: SparkSession, path: str) -> dict[str, tuple[str, ...]]:
    """A full table from a JSON file: ``{word: [short, ...]}``, or a list of ``{"word": ..., "abbrs": [{"abbr": ...}, ...]}``.

    A word listed twice keeps its last entry.
    """
    table = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if isinstance(table, list):
        table = {e["word"]: [a["abbr"] for a in e["abbrs"]] for e in table}
    return {word: tuple(shorts) for word, shorts in table.items()}


def read_words(spark: SparkSession, path: str) -> frozenset[str]:
    """Stop words, one a line or as a JSON list; single letters other than ``a`` count for nothing."""
    text = spark.read.text(path, wholetext=True).first()[0]
    found = json.loads(text) if text.lstrip().startswith("[") else text.split()
    return frozenset(w for w in found if len(w) > 1 or w == "a")


def triviality(doc: Column, name: Column, code: Column, abbreviations: dict[str, tuple[str, ...]] | None = None, stopwords: frozenset[str] = STOPWORDS) -> Column:
    """Null in any input gives null."""
    forms, common = short_forms(abbreviations), frozenset(COMMON_WORDS) | {f"{w}s" for w in COMMON_WORDS}

    @F.pandas_udf("double")
    def score(d: pd.Series, n: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if None in (x, y, z) else triviality_of(x, y, z, forms, common, stopwords) for x, y, z in zip(d, n, c, strict=True)], dtype="float64")

    return score(doc, name, code)


def partial_ratio_of(a: str, b: str) -> int:
    """0 to 100: the best likeness of the shorter text with a part of the longer one of its length."""
    if not a or not b:
        return 0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best, matcher = 0.0, SequenceMatcher(None, short, long, autojunk=False)
    for i, j, _ in matcher.get_matching_blocks():
        start = max(0, min(j - i, len(long) - len(short)))
        ratio = SequenceMatcher(None, short, long[start : start + len(short)], autojunk=False).ratio()
        if ratio > 0.995:
            return 100
        best = max(best, ratio)
    return int(round(100 * best))


def partial_ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if None in (p, q) else partial_ratio_of(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return score(a, b)


METRICS: dict[str, Callable[[Column], Column]] = {
    "Verbosity": verbosity,
    "Triviality": lambda doc: triviality(doc, F.col("name"), F.col("code")),
}


def registry(abbreviations: dict[str, tuple[str, ...]] | None = None, stopwords: frozenset[str] | None = None) -> dict[str, Callable[[Column], Column]]:
    """:data:`METRICS`, with other tables for triviality where they are given."""
    stop = STOPWORDS if stopwords is None else stopwords
    return METRICS | {"Triviality": lambda doc: triviality(doc, F.col("name"), F.col("code"), abbreviations, stop)}


def with_metrics(df: DataFrame, names: dict[str, str], doc: str = "generated_summary", metrics: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """``df`` with a column for each metric of the registry that ``names`` maps to a column name."""
    metrics = METRICS if metrics is None else metrics
    return df.withColumns({column: metrics[metric](F.col(doc)) for metric, column in names.items()})
