"""The commands: ``python -m loomstone <command> [options]``.

A thin layer over ``plans.pipelines``.  Paths may be anything Spark reads; what
they hold goes by their ending (see ``sources.tables.read_rows``).  Generators,
judges and trainers are named ``module:object`` and called without arguments
(trainers with the rows).
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from .functions import metrics as M
from .operators import graph, relational
from .plans import pipelines as P
from .ship import ship
from .sources import tables

Options = argparse.Namespace
COMMANDS: dict[str, tuple[Callable[[SparkSession, Options], DataFrame | None], str]] = {}


def command(options: str):
    """Registers a function under its name. ``options``: names; ``*`` takes several, ``?`` may be left out, ``!`` is a switch."""

    def put(f):
        COMMANDS[f.__name__] = (f, options)
        return f

    return put


def _named(name: str):
    module, _, thing = name.partition(":")
    return getattr(importlib.import_module(module), thing)


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _by_split(rows: DataFrame, work: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``work(rows, is it train)`` on each split by itself; rows without splits are one that is not train."""
    if "split" not in rows.columns:
        return work(rows, False)
    names = sorted(r[0] for r in rows.select("split").distinct().collect())  # a few
    return reduce(DataFrame.unionByName, [work(rows.where(rows["split"] == n), n == "train") for n in names] or [work(rows, False)])


def _train_only(rows: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return work(rows) if "split" not in rows.columns else work(rows.where("split = 'train'")).unionByName(rows.where("split <> 'train'"))


def _predictions(spark: SparkSession, o: Options, bottom_up: bool) -> DataFrame | None:
    rows, template, generator = tables.read_rows(spark, o.input), _text(spark, o.template), _named(o.generator)()
    out = _by_split(rows, lambda r, _: P.predict(r, template, generator, bottom_up))
    if not o.benchmark:
        return out
    tables.write_predictions(P.keep(out, "predictions"), tables.read_rows(spark, o.benchmark), o.output, o.short)
    return None


@command("input output csv")
def merge_json(spark, o):
    return P.merge(tables.read_repositories(spark, o.input), tables.read_information(spark, o.csv))


@command("input output threshold? usevendor!")
def find_duplicates(spark, o):
    return P.find_duplicates(tables.read_rows(spark, o.input), round(100 * float(o.threshold or 0.9)), o.usevendor)


@command("input output key?")
def convert_data_to_array(spark, o):
    return tables.as_array(tables.read_rows(spark, o.input), o.key or "test")


@command("input output ids* depth?")
def get_subset(spark, o):
    rows = tables.read_rows(spark, o.input)
    found = graph.closure(rows, rows.where(rows["id"].isin(o.ids)), None if o.depth is None else int(o.depth))
    return rows.join(found.select("id"), "id", "left_semi")


@command("input output csv benchmark train* test* test_paths*")
def merge_and_dedup(spark, o):
    return P.merge_and_dedup(tables.read_repositories(spark, o.input), tables.read_information(spark, o.csv), tables.read_rows(spark, o.benchmark), o.train, o.test, o.test_paths)


@command("input output")
def get_context(spark, o):
    return _by_split(tables.read_rows(spark, o.input), P.get_context)


@command("input output everything rate? seed?")
def obfuscate(spark, o):
    everything = tables.read_rows(spark, o.everything)
    return _train_only(tables.read_rows(spark, o.input), lambda r: P.obfuscate_train(r, everything, float(o.rate or 0.5), int(o.seed or 0)))


@command("input output")
def dedup_train(spark, o):
    return _train_only(tables.read_rows(spark, o.input), P.dedup_train)


@command("input output template generator benchmark? short?")
def run_predict(spark, o):
    return _predictions(spark, o, False)


@command("input output template generator benchmark? short?")
def run_recursive_predict(spark, o):
    return _predictions(spark, o, True)


@command("input output template generator use_doc! use_context!")
def run_synthesize(spark, o):
    return P.synthesize(tables.read_rows(spark, o.input), _text(spark, o.template), _named(o.generator)(), o.use_doc, o.use_context)


def _metrics(spark: SparkSession, o: Options) -> dict:
    """The metrics, with the full tables of triviality where the options name them."""
    return M.registry(M.read_abbreviations(spark, o.abbreviations) if o.abbreviations else None, M.read_words(spark, o.stopwords) if o.stopwords else None)


@command("input output lenient! use_doc! abbreviations? stopwords?")
def run_finalize_synth(spark, o):
    return P.dedup_train(P.keep(P.finalize_synthesis(tables.read_rows(spark, o.input), not o.lenient, o.use_doc, _metrics(spark, o)), "final"))


@command("input output doc? abbreviations? stopwords?")
def evaluate_auto_metrics(spark, o):
    return P.evaluate(tables.read_rows(spark, o.input), o.doc or "generated_summary", _metrics(spark, o))


@command("input predictions output scores judge doc?")
def run_qa_tests(spark, o):
    """Rows with answers and scores to ``--output``, the register of scores as CSV to ``--scores``."""
    rows, register = P.question(tables.read_rows(spark, o.input), tables.read_rows(spark, o.predictions), _named(o.judge)(), o.doc or "generated_summary")
    rows = P.keep(rows, "answers")
    register.orderBy("test").write.mode("overwrite").option("header", "true").csv(o.scores)
    return rows


@command("input output judge doc? budget?")
def add_gpt_fact_halluc_responses(spark, o):
    return P.review_facts(tables.read_rows(spark, o.input), _named(o.judge)(), o.doc or "generated_summary", int(o.budget or 21))


@command("anchor base output judge doc? budget?")
def compare_pairwise_sufficiency_by_gpt(spark, o):
    name = lambda p: PurePosixPath(p).name.split(".")[0]
    return P.compare(tables.read_rows(spark, o.anchor), tables.read_rows(spark, o.base), _named(o.judge)(), name(o.anchor), name(o.base), o.doc or "generated_summary", int(o.budget or 21))


@command("automatic annotated output")
def merge_all_metrics(spark, o):
    return relational.merge_metrics(tables.read_rows(spark, o.annotated), tables.read_rows(spark, o.automatic))


@command("input trainer")
def run_train(spark, o):
    _named(o.trainer)(relational.require_columns(tables.read_rows(spark, o.input)))


@command("input trainer columns* head?")
def run_alignment(spark, o):
    _named(o.trainer)(tables.read_columns(spark, o.input, o.columns, None if o.head is None else int(o.head)))


OVERWRITES = {"evaluate_auto_metrics", "run_qa_tests", "add_gpt_fact_halluc_responses", "compare_pairwise_sufficiency_by_gpt", "merge_all_metrics"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomstone", description=__doc__.split("\n")[0])
    subs = top.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        sub = subs.add_parser(name)
        for option in options.split():
            flag, kind = option.rstrip("*?!"), option[-1]
            extra = {"*": {"nargs": "+", "required": True}, "?": {}, "!": {"action": "store_true"}}.get(kind, {"required": True})
            sub.add_argument(f"--{flag.replace('_', '-')}", dest=flag, **extra)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs one command; its rows go to ``--output``, which may not be there yet, but for results that are made anew each time."""
    o = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("loomstone").getOrCreate()
    ship(spark)
    out = COMMANDS[o.command][0](spark, o)
    if out is not None:
        tables.write_rows(out, o.output, over=o.command in OVERWRITES)
    return 0
