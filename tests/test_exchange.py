"""Tables of triviality, benchmark files, single JSON objects, batches, judges with a system turn, answers with comments, the QA command."""

import json
import sys
import types

import pytest
from pyspark.sql import functions as F

from loomstone import cli
from loomstone.functions import metrics, text
from loomstone.operators import generate, graph, judging
from loomstone.sources import tables


def test_triviality_tables_come_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"word": "quux", "abbrs": [{"abbr": "qx", "degree": "green"}, {"abbr": "qqx"}]}]))
    (tmp_path / "b.json").write_text(json.dumps({"quux": ["qx", "qqx"]}))
    (tmp_path / "stop.txt").write_text("the\na\nb\nof\n")
    (tmp_path / "stop.json").write_text(json.dumps(["the", "a", "b", "of"]))
    one, two = (metrics.read_abbreviations(spark, str(tmp_path / f)) for f in ("a.json", "b.json"))
    assert one == two == {"quux": ("qx", "qqx")}
    assert metrics.read_words(spark, str(tmp_path / "stop.txt")) == metrics.read_words(spark, str(tmp_path / "stop.json")) == {"the", "a", "of"}
    rows = spark.createDataFrame([("1", "Widget of the quux", "qx_widget", "int qx_widget(int x) { return x; }")], "id string, generated_summary string, name string, code string")
    rows.write.parquet(str(tmp_path / "in"))
    for extra in ([], ["--abbreviations", str(tmp_path / "a.json"), "--stopwords", str(tmp_path / "stop.txt")]):
        assert cli.main(["evaluate_auto_metrics", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), *extra], spark) == 0
        got = spark.read.parquet(str(tmp_path / "out")).first()
        assert got["Triviality_auto"] == (1.0 if extra else pytest.approx(max(0.0, (1 / 1.5 - 0.6) / 0.25)))


def test_benchmarks_last_file_wins_and_objects_round_trip(spark, tmp_path):
    for k, (folder, wrap) in enumerate((("a", True), ("b", False), ("c", True))):
        (tmp_path / "in" / folder).mkdir(parents=True)
        rows = {"x/1": {"name": f"n{k}", "doc": None if k == 1 else "d"}, f"x/{k + 5}": {"name": "own", "to": ["x/1"]}}
        (tmp_path / "in" / folder / "random_test_dataset.json").write_text(json.dumps({"train": {}, "test": rows} if wrap else rows))
    got = {r["id"]: r["name"] for r in tables.read_benchmarks(spark, str(tmp_path / "in")).collect()}
    assert got == {"x/1": "n2", "x/5": "own", "x/6": "own", "x/7": "own"}
    rows = spark.createDataFrame([('q"1', 2, "two", ["a"]), ("z", 1, None, []), ("é", 3, "three\nlines", None)], "id string, ord long, doc string, to array<string>")
    tables.write_object(rows.repartition(3), str(tmp_path / "o.json"))
    parts = list((tmp_path / "o.json").glob("part-*"))
    whole = json.loads(parts[0].read_text())
    assert len(parts) == 1 and list(whole) == ["z", 'q"1', "é"] and whole["é"] == {"ord": 3, "doc": "three\nlines", "to": None}
    back = tables.read_functions(spark, str(tmp_path / "o.json"))
    assert {(r["id"], r["doc"]) for r in back.collect()} == {("z", None), ('q"1', "two"), ("é", "three\nlines")}
    tables.write_object(rows.where("false"), str(tmp_path / "e.json"))
    assert json.loads(next((tmp_path / "e.json").glob("part-*")).read_text()) == {}


class Counting:
    """Tells how many prompts came with each one."""

    def generate(self, prompts):
        return [f" {len(prompts)}" for _ in prompts]


def test_batches_grow_as_prompts_shrink(spark):
    lengths = [1000, 200, 100, 90, 80, 70, 60, 50, 40, 30]
    rows = spark.createDataFrame([(str(n), "p" * n) for n in lengths], "id string, code string").coalesce(1)
    got = {int(r["id"]): int(r["whole_text"].split()[-1]) for r in generate.generate(rows, F.col("code"), Counting(), 2, 100).collect()}
    want = {lengths[k]: n for at, n in graph.dynamic_batches(lengths, 2, 100) for k in range(at, at + n)}
    assert got == want and max(got.values()) > 2
    assert {r["whole_text"].split()[-1] for r in generate.generate(rows, F.col("code"), Counting(), 4).collect()} == {"4", "2"}
    for wrong in (0, -1):
        with pytest.raises(ValueError, match="at least one"):
            generate.generate(rows, F.col("code"), Counting(), wrong)
        with pytest.raises(ValueError, match="at least one"):
            judging.ask(rows, F.col("code"), Counting(), "said", wrong)
        with pytest.raises(ValueError, match="at least one"):
            graph.dynamic_batches([1], wrong, 1)


class Chat(Counting):
    def chat(self, talks):
        return ["|".join(f"{who}:{said}" for who, said in t) for t in talks]


class Plain:
    def generate(self, prompts):
        return prompts


def test_judges_get_a_system_turn(spark):
    rows = spark.createDataFrame([("1", "hi"), ("2", None)], "id string, p string")
    said = lambda judge, system: [r["said"] for r in judging.ask(rows, F.col("p"), judge, "said", system=system).orderBy("id").collect()]
    assert said(Chat(), "be kind") == ["system:be kind|user:hi", None]
    assert said(Plain(), "be kind") == ["be kind\n\nhi", None]
    assert said(Plain(), None) == ["hi", None]


def test_answers_with_comments(spark):
    rows = spark.createDataFrame([(["a?", "b?"], "Yes. it does\nNo.. not at all"), ([], "")], "q array<string>, r string")
    got = [r[0] for r in rows.select(text.answers_with_comments("q", "r")).collect()]
    assert [tuple(x) for x in got[0]] == [("a?", "Yes", "it does"), ("b?", "No", "not at all")] and got[1] == []
    with pytest.raises(Exception, match="answers: 1, questions: 2"):
        rows.where("size(q) = 2").select(text.answers_with_comments("q", F.lit("Yes"))).collect()


def test_qa_command(spark, tmp_path):
    module = types.ModuleType("qa_parts")

    class Judge:
        def generate(self, prompts):
            return ["\n".join("Yes" if "sorts" in q else "No" for q in p.split("Questions:\n")[1].split("\n")) for p in prompts]

    module.Judge = Judge
    sys.modules["qa_parts"] = module
    try:
        claims = "sufficiency_claims array<string>, illegal_facts array<string>"
        spark.createDataFrame([("r/1", 0, "n1", "c", ["it sorts", "it frees"], ["it locks"]), ("r/2", 1, "n2", "c", [], [])], f"id string, ord long, name string, code string, {claims}").write.parquet(str(tmp_path / "tests"))
        spark.createDataFrame([("1", "n1", "It sorts."), ("2", "n2", "x")], "id string, name string, generated_summary string").write.parquet(str(tmp_path / "said"))
        at = lambda n: str(tmp_path / n)
        assert cli.main(["run_qa_tests", "--input", at("tests"), "--predictions", at("said"), "--output", at("out"), "--scores", at("scores"), "--judge", "qa_parts:Judge"], spark) == 0
        got = {r["id"]: (r["sufficiency_claims_score"], r["illegal_facts_score"]) for r in spark.read.parquet(at("out")).collect()}
        assert got == {"r/1": (0.5, 1.0), "r/2": (None, None)}
        scores = {r["test"]: r["pooled"] for r in spark.read.option("header", "true").csv(at("scores")).collect()}
        assert scores == {"illegal_facts_score": "1.0", "sufficiency_claims_score": "0.5"}
    finally:
        del sys.modules["qa_parts"]
