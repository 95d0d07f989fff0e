"""The commands, end to end, over DataFrames of function tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as X
from ..operators import filters, generate, graph, judging, obfuscate, relational, similarity
from ..store import keep

FIELDS = ("doc", "code", "doc+code")


def merge(raw: DataFrame, info: DataFrame) -> DataFrame:
    """Rows of ready repositories, ids with their repository in front, in one order."""
    return relational.in_one_order(relational.prefix_ids(relational.ready_repositories(raw, info), F.col("repo")))


def find_duplicates(rows: DataFrame, percent: int = 90, use_vendor: bool = False, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``field, id, class, links`` of every row that has the field, and the classes' ``nearest`` others with their similarity.

    Copies of a row are in its class; two rows are neighbours if they share a
    class or if one's class is among the other's nearest.
    """
    if not use_vendor:
        rows = rows.where(~filters.flag("vendor"))
    found = similarity.near_rows(rows, list(fields), percent)
    return found.withColumn("field", F.element_at(F.array(*map(F.lit, fields)), F.col("field") + 1))


def merge_and_dedup(raw: DataFrame, info: DataFrame, benchmark: DataFrame, train: list[str], test: list[str], test_paths: list[str], percent: int = 90) -> DataFrame:
    """Ready repositories, routed to splits; train rows similar to test rows leave; test is what the benchmark reaches."""
    rows = keep(relational.route(merge(raw, info), train, test, test_paths), "routed")
    tests = rows.where("split = 'test'")
    kept = similarity.without_leaks(rows.where("split = 'train'"), tests, [similarity.joined_field(f) for f in FIELDS], percent)
    relational.keep_benchmark(tests, benchmark)
    return kept.unionByName(tests.join(graph.closure(tests, benchmark).select("id"), "id", "left_semi"))


def get_context(rows: DataFrame, train: bool) -> DataFrame:
    """Contexts from rows as they are; then cleaning, then the filters."""
    out = rows.drop("context").join(graph.callee_context(rows, late_null="None"), "id")
    doc = F.coalesce("doc", F.lit(""))
    out = out.withColumns({"raw_doc": doc, "doc": X.collapse_repeats(X.trim_edges(doc)), "name": X.strip("name")})
    return (filters.SHARED + (filters.TRAIN if train else filters.FilterChain())).apply(out)


def dedup_train(rows: DataFrame, doc: str = "doc", percent: int = 90) -> DataFrame:
    kept = similarity.greedy_dedup(rows, [doc, "code", f"{doc}+code"], percent)
    return rows.join(kept.where("kept").select("id"), "id", "left_semi")


def obfuscate_train(rows: DataFrame, everything: DataFrame, rate: float = 0.5, seed: int = 0) -> DataFrame:
    return obfuscate.obfuscate(rows, everything, rate, seed=seed)


def predict(rows: DataFrame, template: str, generator: generate.TextGenerator, bottom_up: bool = False) -> DataFrame:
    rows = keep(filters.SHARED.apply(rows), "valid")
    if bottom_up:
        return relational.prediction(rows.join(generate.generate_bottom_up(rows, template, generator), "id"))
    return relational.prediction(generate.generate(rows, generate.context_prompt(template, True), generator))


def synthesize(rows: DataFrame, template: str, generator: generate.TextGenerator, use_doc: bool = False, use_context: bool = False) -> DataFrame:
    """Summaries for rows that pass the chain before synthesis, as ``synth_doc``."""
    rows = graph.prune_to(rows, rows.where(~filters.flag("non_function")))
    rows = rows.withColumn("code", X.strip(F.when(filters.flag("macro_exp"), F.col("macro_code")).otherwise(F.col("code"))))
    if use_doc:
        rows = rows.withColumn("doc", X.trim_lines("doc"))
    rows = filters.pre_synthesis(use_doc, use_context).apply(rows)
    out = relational.prediction(generate.generate(rows.drop("synth_doc"), generate.synthesis_prompt(template), generator))
    return out.withColumnRenamed("generated_summary", "synth_doc")


def finalize_synthesis(rows: DataFrame, strict: bool = True, use_doc: bool = False, metrics: dict | None = None) -> DataFrame:
    """Cleans and filters ``synth_doc``, attaches contexts made of it, filters again and makes it the doc."""
    doc = X.drop_name_prefix(X.trim_lines("synth_doc"), "name")
    if strict:
        doc = X.cut_signature(doc, "code")
    rows = rows.withColumn("synth_doc", X.trim_lines(doc, X.EDGE_QUOTED))
    chain = filters.synth_summary(metrics=metrics) if strict else filters.synth_summary(0.8, 0.9, copies=False, metrics=metrics)
    rows = keep(chain.apply(rows), "summaries")
    rows = keep(rows.drop("context").join(graph.callee_context(rows, doc="synth_doc"), "id"), "contexts")
    target = filters.STRICT_TARGET if strict else filters.history_target(use_doc)
    out = graph.referentially_closed(target.apply(rows), rows)
    return out.withColumn("doc", F.col("synth_doc")).drop("synth_doc", "prompt", "prompt_len", "whole_text")


def evaluate(rows: DataFrame, doc: str = "generated_summary", metrics: dict | None = None) -> DataFrame:
    if "split" in rows.columns and rows.where("split = 'train'").take(1):
        raise ValueError("train rows are not evaluated")
    return M.with_metrics(rows, {"Verbosity": "Verbosity_auto", "Triviality": "Triviality_auto"}, doc, metrics)


def review_facts(rows: DataFrame, judge: generate.TextGenerator, doc: str = "generated_summary", budget: int = 21) -> DataFrame:
    """Adds the judge's review of each summary; refuses ``budget`` rows or more before any call."""
    return keep(judging.review_facts(relational.within_budget(rows, budget), judge, doc), "reviews")


def compare(anchor: DataFrame, base: DataFrame, judge: generate.TextGenerator, anchor_name: str, base_name: str, doc: str = "generated_summary", budget: int = 21) -> DataFrame:
    """One row of statistics: which of two sets of summaries the judge finds more complete."""
    verdicts = judging.compare_pairs(anchor, relational.within_budget(base, budget), judge, doc)
    return judging.comparison_statistics(verdicts, anchor_name, base_name)


def question(tests: DataFrame, predictions: DataFrame, judge: generate.TextGenerator, doc: str = "generated_summary") -> tuple[DataFrame, DataFrame]:
    """(rows with answers and scores, register): claims a summary should make and facts it must not state."""
    rows = relational.contained_in(tests, predictions)
    rows = judging.ask_claims(rows, judge, "sufficiency_claims", "Yes", doc)
    rows = judging.ask_claims(rows, judge, "illegal_facts", "No", doc)
    results = judging.claim_results(rows, "sufficiency_claims", "Yes").unionByName(judging.claim_results(rows, "illegal_facts", "No"))
    return rows, relational.score_register(results)
