"""Questions to a judging model as prompt columns, and what its answers come to.

A judge is a ``TextGenerator``.  Every answer may cost money, so a null prompt
is never asked, and callers write answers to the shared folder before they read
them twice.  The texts of the prompts are parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..store import keep
from . import relational
from .generate import TextGenerator, render

FACTS = "You review summaries of C and C++ functions. List what the summary says wrongly, with a quotation each, then what neither code nor context bears out. What it leaves out is no mistake.\n\n<code>\n{code}\n</code>\n\n<docstring>\n{doc}\n</docstring>"
COMPARE = "Which summary of this code is more complete, or are they alike? Be brief.\n\n<code>\n{code}\n</code>\n\n<summary_A>\n{doc_a}\n</summary_A>\n\n<summary_B>\n{doc_b}\n</summary_B>\n\nAnswer:"
GRADE = "\n\nNow answer with one letter: A or B for the more complete summary, C if they are alike.\nLetter:"
QUESTIONS = 'Answer every question from the docstring alone, in order, one line each, with Yes or No.\n\nDocstring:\n"""{doc}"""\n\nQuestions:\n{questions}'


def turns(judge: TextGenerator, prompts: list[str], system: str | None) -> list[str]:
    """The judge's answers. A judge that has ``chat`` gets the system text as a turn of its own, any other one before the prompt."""
    if system is None:
        return judge.generate(prompts)
    if hasattr(judge, "chat"):
        return judge.chat([[("system", system), ("user", p)] for p in prompts])
    return judge.generate([f"{system}\n\n{p}" for p in prompts])


def ask(df: DataFrame, prompt: Column, judge: TextGenerator, column: str, batch: int = 16, system: str | None = None) -> DataFrame:
    """``df`` with the judge's answer to ``prompt`` as ``column`` (which it replaces); a null prompt gets a null answer."""
    if batch < 1:
        raise ValueError(f"a batch has at least one prompt, not {batch}")
    rest = df.drop(column)
    names = [*rest.columns, column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(b.num_columns - 1).to_pylist()
            at, said = [k for k, p in enumerate(asked) if p is not None], [None] * len(asked)
            for i in range(0, len(at), batch):
                some = at[i : i + batch]
                for k, answer in zip(some, turns(judge, [asked[k] for k in some], system), strict=True):
                    said[k] = answer
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(said, pa.string())], names=names)

    schema = T.StructType([*rest.schema.fields, T.StructField(column, T.StringType())])
    return rest.withColumn("__prompt", prompt).mapInArrow(run, schema)


def review_facts(rows: DataFrame, judge: TextGenerator, doc: str = "generated_summary", template: str = FACTS, response: str = "fact_halluc_response", asked: str = "fact_halluc_user_prompt", system: str | None = None) -> DataFrame:
    """``rows`` with the prompt about a summary's mistakes and inventions, and the answer to it; null docs or code ask nothing."""
    rows = rows.withColumn(asked, render(template, code=X.strip("code"), doc=X.strip(doc)))
    return ask(rows, F.col(asked), judge, response, system=system)


def compare_pairs(anchor: DataFrame, base: DataFrame, judge: TextGenerator, doc: str = "generated_summary", template: str = COMPARE, grade: str = GRADE, system: str | None = None) -> DataFrame:
    """``ord, name, anchor_id, base_id, rationale, verdict`` for the base row of each anchor's name.

    Two turns: the judge thinks, then sees its own words and gives a letter;
    any other answer is ``N``.  Names that are not one to one raise ValueError.
    """
    pairs = relational.anchor_pairs(anchor, base)
    a = anchor.select(F.col("id").alias("anchor_id"), "ord", "code", F.col(doc).alias("doc_a"))
    b = base.select(F.col("id").alias("base_id"), F.col(doc).alias("doc_b"))
    both = pairs.join(a, "anchor_id").join(b, "base_id")
    text = lambda c: F.coalesce(c, F.lit(""))
    first = render(template, code=text("code"), doc_a=text("doc_a"), doc_b=text("doc_b"))
    thought = keep(ask(both.withColumn("first", first), F.col("first"), judge, "rationale", system=system), "rationale")
    said = keep(ask(thought, F.concat("first", F.lit(" "), text("rationale"), F.lit(grade)), judge, "verdict", system=system), "verdict")
    return said.select("ord", "name", "anchor_id", "base_id", "rationale", relational.verdict(F.col("verdict")).alias("verdict"))


def comparison_statistics(verdicts: DataFrame, anchor_name: str, base_name: str) -> DataFrame:
    """One row: ``score, anchor_name, base_file_name, pair_assessments``. The list has a line per pair, which the budget of paid calls bounds."""
    line = F.concat("verdict", F.lit(" ("), "name", F.lit(", "), "base_id", F.lit(")"))
    lines = verdicts.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))), lambda x: x["t"]).alias("pair_assessments"))
    score = relational.win_rate(verdicts).select("score", F.lit(anchor_name).alias("anchor_name"), F.lit(base_name).alias("base_file_name"))
    return score.crossJoin(lines)  # one row each


def questions_of(claims: Column | str, start: str) -> Column:
    return F.transform(F.col(claims) if isinstance(claims, str) else claims, lambda q: F.concat(F.lit(start + " "), q, F.lit("?")))


def ask_claims(rows: DataFrame, judge: TextGenerator, claims: str, wanted: str, doc: str = "generated_summary", start: str = "Does it say that", template: str = QUESTIONS, system: str | None = None) -> DataFrame:
    """Adds ``<claims>_answers`` (a map by question) and ``<claims>_score``: the share of claims whose answer starts with ``wanted``.

    Rows without claims are not asked; both are null there.  Equal claims share
    one entry but all count as asked; a question beyond the last line of the
    answer has a null answer.
    """
    some = F.size(claims) > 0
    prompt = render(template, doc=F.coalesce(doc, F.lit("")), questions=F.array_join(questions_of(claims, start), "\n"))
    rows = keep(ask(rows, F.when(some, prompt), judge, "__said", system=system), "answers")
    answers = F.when(some, X.answers_by_question(questions_of(claims, start), F.coalesce("__said", F.lit(""))))
    rows = rows.withColumn(f"{claims}_answers", answers).drop("__said")
    return rows.withColumn(f"{claims}_score", relational.pass_score(F.col(f"{claims}_answers"), F.col(claims), wanted))


def claim_results(rows: DataFrame, claims: str, wanted: str) -> DataFrame:
    """``test, passed, total`` of every row that was asked, for ``score_register``."""
    good = F.size(F.filter(F.map_values(f"{claims}_answers"), lambda x: F.startswith(x, F.lit(wanted))))
    return rows.where(F.col(f"{claims}_answers").isNotNull()).select(F.lit(f"{claims}_score").alias("test"), good.alias("passed"), F.size(claims).alias("total"))
